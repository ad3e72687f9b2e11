"""Catalogue queries of the model slots, the question check and the answer sink (T3a, A3, R3, S7), with DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from guardrag.functions.embedding import model_embedder
from guardrag.functions.safety import model_answerer
from guardrag.operators.answer import assemble_context
from guardrag.operators.audit import write_answers
from guardrag.operators.chunking import chunk_documents
from guardrag.operators.retrieval import split_questions, topk_batch
from guardrag.operators.store import store_dimension
from guardrag.plans import catalog as base
from guardrag.plans import edge_queries as edge
from guardrag.plans import fixtures as fx
from guardrag.session import scratch_path

#: The embedding model of the query: how often each of these letters occurs.
LETTERS = "aeinst"


def load_letter_model():
    """A model that needs no weights: one vector of letter counts per text."""
    return lambda texts: [[float(t.count(ch)) for ch in LETTERS] for t in texts]


def q_embed_model(spark, d):
    """Every chunk of every document through the model slot, one call per Arrow batch."""
    chunks = chunk_documents(fx.table(spark, d, "documents"), "text", "source", "doc_id", base.LINE)
    return chunks.withColumn("embedding", model_embedder(load_letter_model)("content")).select("chunk_id", base._ints(F.col("embedding")).alias("embedding"))


SQL_EMBED_MODEL = "WITH RECURSIVE " + fx.sql_chunks("documents", "CAST(doc_id AS VARCHAR)", "text", "source") + f"""
SELECT chunk_id, concat_ws(',', {', '.join(f"length(content) - length(replace(content, '{ch}', ''))" for ch in LETTERS)}) AS embedding FROM chunks"""


def load_listing_model():
    """An answer model that needs no weights: it lists what it was given."""
    return lambda questions, contexts: [f"{len(q)} characters, {len(c)} passages: {' | '.join(c)}" for q, c in zip(questions, contexts, strict=True)]


def q_answer_model(spark, d):
    """Every vector as a question against every vector: the retrieved passages through the answer slot."""
    context = assemble_context(base._vector_topk(spark, d))
    return context.select("query_id", model_answerer(load_listing_model)("query_id", "context").alias("answer"))


SQL_ANSWER_MODEL = base.SQL_VECTOR_RANKED + f"""
SELECT query_id, length(query_id) || ' characters, ' || count(*) || ' passages: ' || string_agg(content, ' | ' ORDER BY rank) AS answer
FROM ranked WHERE rank <= {base.VECTOR_K} GROUP BY query_id"""


def q_topk_checked(spark, d):
    """Questions with missing, empty or too short vectors are returned with the reason, the others with their ranking."""
    store = fx.vector_store(spark, d)
    vector = F.when(F.col("vec_id") % 50 != 4, F.col("embedding"))
    asked = fx.faulty_vectors(spark, d).select(F.col("vec_id").cast("string").alias("query_id"), vector.alias("embedding"))
    good, bad = split_questions(asked, store_dimension(store))
    ranked = topk_batch(store, good, base.VECTOR_K).select(
        "query_id", F.col("rank").cast("bigint").alias("rank"), "chunk_id", F.col("score").cast("double").alias("score"), F.lit(None).cast("string").alias("reason"))
    return ranked.unionByName(bad.select("query_id", "reason"), allowMissingColumns=True)


SQL_TOPK_CHECKED = f"""WITH {fx.SQL_FAULTY}, {fx.SQL_VSTORE},
asked AS (SELECT CAST(vec_id AS VARCHAR) AS query_id, CASE WHEN vec_id % 50 <> 4 THEN embedding END AS embedding FROM faulty),
told AS (SELECT *, CASE WHEN coalesce(len(embedding), 0) = 0 THEN 'empty_vector' WHEN len(embedding) <> 64 THEN 'dimension_mismatch' END AS reason FROM asked),
scored AS (
  SELECT q.query_id, c.chunk_id, {fx.sql_cosine('c.embedding', 'q.embedding')} AS score
  FROM (SELECT * FROM told WHERE reason IS NULL) q CROSS JOIN vstore c),
ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY isnan(score), score DESC, chunk_id) AS rank FROM scored)
SELECT query_id, CAST(rank AS BIGINT) AS rank, chunk_id, CAST(score AS DOUBLE) AS score, NULL::VARCHAR AS reason FROM ranked WHERE rank <= {base.VECTOR_K}
UNION ALL SELECT query_id, NULL, NULL, NULL, reason FROM told WHERE reason IS NOT NULL"""


def q_answers_sink(spark, d):
    """The answer table as it is read back from the sink, of one run among two."""
    path = scratch_path(spark, "answers-sink")
    answers = edge.q_answers(spark, d)
    write_answers(answers, path, "first")
    write_answers(answers.limit(0), path, "second")
    return spark.read.schema(answers.schema).parquet(f"{path}/run_id=first")


QUERIES = {"embed_model": q_embed_model, "answer_model": q_answer_model, "topk_checked": q_topk_checked, "answers_sink": q_answers_sink}

ORACLES = {"embed_model": SQL_EMBED_MODEL, "answer_model": SQL_ANSWER_MODEL, "topk_checked": SQL_TOPK_CHECKED, "answers_sink": edge.SQL_ANSWERS}
