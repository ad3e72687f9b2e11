"""Training-data operators: ten independent DataFrame operators and their queries.

Nothing outside this folder and ``corpus_pipeline.py`` imports it.
"""
