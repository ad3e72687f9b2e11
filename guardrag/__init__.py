"""guardrag: guarded retrieval over document collections, as Spark DataFrame jobs.

Typical use::

    from guardrag import get_spark, ingest_documents, ask_batch, answers_of
    spark = get_spark()
    store, rejects = ingest_documents(docs, content_col="text", title_col="title")
    audit = ask_batch(questions, store)          # one audit row per question
    answers = answers_of(audit)
"""

from guardrag.config import (
    AskOptions,
    ChunkingOptions,
    DisclaimerOptions,
    IngestionOptions,
    QueryOptions,
    RelevanceOptions,
    RetrievalOptions,
)
from guardrag.functions.embedding import constant_embedder, hashing_embedder, model_embedder
from guardrag.functions.gates import is_low_confidence, is_too_long, keyword_count, relevance
from guardrag.functions.pii import contains_pii, scrub, with_scrub
from guardrag.functions.safety import model_answerer, output_safety, template_answer, with_output_safety
from guardrag.functions.similarity import cosine
from guardrag.operators.chunking import chunk_documents
from guardrag.operators.retrieval import search, topk_batch
from guardrag.operators.store import compact_store, read_rejects, read_store, upsert, upsert_store, validate_chunks, write_snapshot
from guardrag.plans.ask import answers_of, ask_batch, ask_pii_report, run_ask
from guardrag.plans.ingest import ingest_documents, ingest_to_store
from guardrag.session import get_spark
from guardrag.sources.files import read_documents
from guardrag.sources.queries import read_queries

__all__ = [
    "AskOptions", "ChunkingOptions", "compact_store", "DisclaimerOptions", "IngestionOptions", "QueryOptions", "RelevanceOptions",
    "RetrievalOptions", "answers_of", "ask_batch", "ask_pii_report", "chunk_documents", "constant_embedder",
    "contains_pii", "cosine", "get_spark", "hashing_embedder", "ingest_documents", "ingest_to_store",
    "is_low_confidence", "is_too_long", "keyword_count", "model_answerer", "model_embedder", "output_safety", "read_documents", "read_queries",
    "read_rejects", "read_store", "relevance", "run_ask", "scrub", "search", "template_answer", "topk_batch", "upsert", "upsert_store",
    "validate_chunks", "with_output_safety", "with_scrub", "write_snapshot",
]
