"""Further catalogue queries: inputs that the plain tables never hold (missing and repeated ids, irregular
vectors, characters outside the basic plane, blank turns) and the ingest path through the store."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from guardrag.config import EMPTY_QUERY_REASON, NO_KEYWORD_REASON, PII_PATTERNS, ChunkingOptions
from guardrag.functions import gates, pii
from guardrag.functions.embedding import hashing_embedder
from guardrag.functions.text import is_blank
from guardrag.operators.answer import assemble_context
from guardrag.operators.chunking import chunk_documents
from guardrag.operators.retrieval import topk_batch
from guardrag.operators.store import read_rejects, read_store, upsert, validate_chunks
from guardrag.plans import catalog as base
from guardrag.plans import fixtures as fx
from guardrag.plans.ask import answers_of, ask_batch
from guardrag.plans.ingest import ingest_to_store
from guardrag.session import scratch_path
from guardrag.streaming.ingest import start_ingest_stream

# --- questions without ids, with repeated ids, and their answers (S4, R6, A11, A12, S7) ---------------------


def _ask(spark: SparkSession, d: str, questions: DataFrame) -> DataFrame:
    return ask_batch(questions, base.document_store(spark, d), as_of=F.to_timestamp(F.lit(base.AS_OF)))


def q_ask_no_id(spark, d):
    """Question texts only: every row gets an id of its own and one audit record."""
    audit = _ask(spark, d, fx.user_questions(spark, d).select("query"))
    has_id = F.col("query_id").rlike("^[0-9a-f]{32}$") & F.col("correlation_id").rlike("^[0-9a-f]{32}$")
    return base._ask_out(audit).withColumn("has_id", has_id).drop("query_id", "correlation_id")


SQL_ASK_NO_ID = f"SELECT * EXCLUDE (query_id, correlation_id), true AS has_id FROM ({base.SQL_ASK_BATCH})"


def q_ask_repeated_ids(spark, d):
    """All questions of a conversation share one id; each is still answered on its own."""
    questions = fx.user_questions(spark, d).withColumn("query_id", F.split_part("query_id", F.lit(":"), F.lit(1)))
    return base._ask_out(_ask(spark, d, questions))


SQL_ASK_REPEATED_IDS = f"""SELECT * REPLACE (split_part(query_id, ':', 1) AS query_id, md5(split_part(query_id, ':', 1)) AS correlation_id)
FROM ({base.SQL_ASK_BATCH})"""


def q_answers(spark, d):
    """The answer table of the ask pipeline."""
    return answers_of(base.ask_audit(spark, d)).withColumn("sources", F.array_join("sources", ", "))


SQL_ANSWERS = f"SELECT query_id, scrubbed_response AS answer, sources FROM ({base.SQL_ASK_BATCH})"

# --- retrieval over irregular vectors (R6, R7, R8) ----------------------------------------------------------


def _edge_vectors(spark, d):
    """By vec_id % 50: zero, NaN, two tiny scales, one tied vector; all others as they are."""
    e = fx.table(spark, d, "embeddings")
    m = F.col("vec_id") % 50

    def scaled(by: float):
        return F.transform("embedding", lambda x: x * F.lit(by).cast("float"))

    ones = F.transform("embedding", lambda x: F.lit(1.0).cast("float"))
    vec = (F.when(m == 0, scaled(0.0)).when(m == 1, F.transform("embedding", lambda x, i: F.when(i == 0, F.lit(float("nan")).cast("float")).otherwise(x)))
           .when(m == 2, scaled(1e-21)).when(m == 3, ones).when(m == 4, scaled(1e-20)).otherwise(F.col("embedding")))
    return e.select(F.col("vec_id").cast("string").alias("id"), vec.alias("embedding"))


SQL_EDGE_VECTORS = """ev AS (
  SELECT CAST(vec_id AS VARCHAR) AS id, CASE vec_id % 50
           WHEN 0 THEN list_transform(embedding, lambda x: x * 0.0::FLOAT)
           WHEN 1 THEN list_transform(embedding, lambda x, i: CASE WHEN i = 1 THEN 'nan'::FLOAT ELSE x END)
           WHEN 2 THEN list_transform(embedding, lambda x: x * 1e-21::FLOAT)
           WHEN 3 THEN list_transform(embedding, lambda x: 1.0::FLOAT)
           WHEN 4 THEN list_transform(embedding, lambda x: x * 1e-20::FLOAT)
           ELSE embedding END AS embedding
  FROM embeddings)"""


def q_topk_edge(spark, d):
    """Every vector as a question, reversed, against every vector; all regular and irregular pairs."""
    v = _edge_vectors(spark, d)
    ranked = topk_batch(v.withColumnRenamed("id", "chunk_id"), v.select(F.col("id").alias("query_id"), F.reverse("embedding").alias("embedding")), base.VECTOR_K)
    return ranked.select("query_id", F.col("rank").cast("bigint").alias("rank"), "chunk_id", F.col("score").cast("double").alias("score"))


SQL_TOPK_EDGE = f"""WITH {SQL_EDGE_VECTORS},
scored AS (
  SELECT q.id AS query_id, c.id AS chunk_id, {fx.sql_cosine('c.embedding', 'q.rev')} AS score
  FROM (SELECT id, list_reverse(embedding) AS rev FROM ev) q CROSS JOIN ev c)
SELECT query_id, rank, chunk_id, CAST(score AS DOUBLE) AS score
FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY isnan(score), score DESC, chunk_id) AS rank FROM scored) WHERE rank <= {base.VECTOR_K}"""

THRESHOLD = 0.34


def q_context_confidence(spark, d):
    """The confidence gate at a threshold near the median top score, so both outcomes occur."""
    ctx = assemble_context(base._vector_topk(spark, d))
    return ctx.select("query_id", gates.is_low_confidence("top_score", THRESHOLD).alias("low_confidence"))


SQL_CONTEXT_CONFIDENCE = base.SQL_VECTOR_RANKED + f"""
SELECT query_id, max(score) < CAST({THRESHOLD} AS FLOAT) AS low_confidence FROM ranked WHERE rank = 1 GROUP BY query_id"""

# --- store and ingest (S2, S3, S5, R9, T4) ------------------------------------------------------------------


def q_chunk_upsert_edge(spark, d):
    """Null and repeated keys on both sides: one row per key, the highest sequence wins."""
    e = fx.table(spark, d, "embeddings")
    key = F.when(F.col("vec_id") % 100 != 7, (F.col("vec_id") % 100).cast("string"))
    existing = e.select(key.alias("chunk_id"), "embedding", (F.col("vec_id") * 2).alias("ingest_seq"))
    updates = e.where("vec_id % 3 = 0").select(key.alias("chunk_id"), F.reverse("embedding").alias("embedding"), (F.col("vec_id") * 2 + 1).alias("ingest_seq"))
    return upsert(existing, updates).select("chunk_id", "ingest_seq", F.col("embedding")[0].cast("double").alias("first_x"))


SQL_CHUNK_UPSERT_EDGE = """WITH u AS (
  SELECT CASE WHEN vec_id % 100 <> 7 THEN CAST(vec_id % 100 AS VARCHAR) END AS chunk_id, embedding, vec_id * 2 AS ingest_seq FROM embeddings
  UNION ALL
  SELECT CASE WHEN vec_id % 100 <> 7 THEN CAST(vec_id % 100 AS VARCHAR) END, list_reverse(embedding), vec_id * 2 + 1 FROM embeddings WHERE vec_id % 3 = 0)
SELECT chunk_id, ingest_seq, CAST(embedding[1] AS DOUBLE) AS first_x
FROM (SELECT *, row_number() OVER (PARTITION BY chunk_id ORDER BY ingest_seq DESC) AS rn FROM u) WHERE rn = 1"""


def _blank_lines():
    """Paragraphs parted by blank lines, as the default chunking expects."""
    return F.replace(F.col("text"), F.lit("\n"), F.lit("\n\n"))


def q_stream_ingest_store(spark, d):
    """The documents as a stream through the whole ingest path: chunk, embed, validate, commit; then the store is read."""
    root, ckpt = scratch_path(spark, "ingest-store"), scratch_path(spark, "ingest-store-ckpt")
    docs = base._parquet_stream(spark, d, "documents").select(F.col("doc_id").alias("id"), F.col("source").alias("title"), _blank_lines().alias("content"))
    start_ingest_stream(spark, root, ckpt, docs=docs, available_now=True, id_col="id").awaitTermination()
    stored = read_store(spark, root)
    return stored.select(
        "chunk_id", "document_id", F.col("pos").cast("bigint").alias("pos"), "title", F.length("content").cast("bigint").alias("n_chars"), "content",
        F.size("embedding").cast("bigint").alias("dim"))


SQL_STREAM_INGEST_STORE = f"SELECT *, 64::BIGINT AS dim FROM ({base.SQL_CHUNK_BLANKLINE})"


def _uneven_embedder(content):
    """An embedder with faults: nothing for lengths divisible by 5, half a vector for lengths divisible by 7."""
    full = hashing_embedder(64)(content)
    return F.when(F.length(content) % 5 == 0, F.array().cast("array<float>")).when(F.length(content) % 7 == 0, F.slice(full, 1, 32)).otherwise(full)


def q_ingest_rejects(spark, d):
    """What an ingest refuses, read back from the store; the dimension is that of the first valid chunk."""
    root = scratch_path(spark, "ingest-rejects")
    docs = fx.table(spark, d, "documents").withColumn("text", _blank_lines())
    ingest_to_store(docs, root, content_col="text", title_col="source", id_col="doc_id", embedder=_uneven_embedder)
    return read_rejects(spark, root).select("document_id", F.col("pos").cast("bigint").alias("pos"), "reason")


SQL_INGEST_REJECTS = "WITH RECURSIVE " + fx.sql_chunks(
    "(SELECT doc_id, replace(text, chr(10), chr(10) || chr(10)) AS text, source FROM documents)", "CAST(doc_id AS VARCHAR)", "text", "source", sep="chr(10) || chr(10)") + """,
sized AS (
  SELECT document_id, pos, CASE WHEN length(content) % 5 = 0 THEN 0 WHEN length(content) % 7 = 0 THEN 32 ELSE 64 END AS dim FROM chunks),
expected AS (SELECT arg_min(dim, (document_id, pos)) AS dim FROM sized WHERE dim > 0)
SELECT document_id, CAST(pos AS BIGINT) AS pos, CASE WHEN s.dim = 0 THEN 'empty_embedding' ELSE 'dimension_mismatch' END AS reason
FROM sized s, expected e WHERE s.dim <> e.dim"""


def q_validate_derived(spark, d):
    """T4 with the dimension of the first chunk, here the shortened vectors' one."""
    m = F.col("vec_id") % 50
    v = fx.faulty_vectors(spark, d).withColumn("order", F.when(m == 1, F.col("vec_id")).otherwise(F.col("vec_id") + 1_000_000_000))
    valid, rejects = validate_chunks(v, order_cols=["order"])
    return valid.select("vec_id", F.lit(None).cast("string").alias("reason")).unionByName(rejects.select("vec_id", "reason"))


SQL_VALIDATE_DERIVED = f"""WITH {fx.SQL_FAULTY}
SELECT vec_id, CASE WHEN embedding IS NULL OR len(embedding) = 0 THEN 'empty_embedding'
                    WHEN chunk_id IS NULL OR chunk_id = '' THEN 'empty_id'
                    WHEN len(embedding) <> 32 THEN 'dimension_mismatch' END AS reason
FROM faulty"""

# --- chunking outside the basic plane (T1b) -----------------------------------------------------------------


def q_chunk_astral(spark, d):
    """Every document with emoji paragraphs added; lengths and carries count UTF-16 units."""
    text = F.concat_ws("\n", "text", F.expr("repeat('🙂', 300 - cast(doc_id % 300 as int))"), F.expr("repeat('a🙂', cast(doc_id % 200 as int))"), "text")
    docs = fx.table(spark, d, "documents").withColumn("text", text)
    out = chunk_documents(docs, "text", "source", "doc_id", ChunkingOptions(separator="\n"))
    return out.select("document_id", F.col("pos").cast("bigint").alias("pos"), "content")


def _len16(x: str) -> str:
    return f"(length({x}) + len(regexp_extract_all({x}, '[\\x{{10000}}-\\x{{10FFFF}}]')))"


def _right16(x: str, n: int) -> str:
    best = f"list_max(list_filter(range({n // 2}, {n + 1}), lambda k: {_len16(f'right({x}, k)')} <= {n}))"
    return f"(CASE WHEN {_len16(f'right({x}, {best})')} < {n} THEN chr(65533) ELSE '' END || right({x}, {best}))"


def _sql_chunk_astral(max_len: int = 500, overlap: int = 50) -> str:
    full = f"{_len16('cur')} + {_len16('ps[i + 1]')} > {max_len} AND length(cur) > 0"
    return f"""WITH RECURSIVE paras AS (
  SELECT CAST(doc_id AS VARCHAR) AS document_id, list_filter(string_split(
           text || chr(10) || repeat('🙂', 300 - CAST(doc_id % 300 AS INT)) || chr(10) || repeat('a🙂', CAST(doc_id % 200 AS INT)) || chr(10) || text, chr(10)),
         lambda x: length(x) > 0) AS ps FROM documents),
fold AS (
  SELECT document_id, ps, 0 AS i, '' AS cur, NULL::VARCHAR AS emitted FROM paras
  UNION ALL
  SELECT document_id, ps, i + 1,
         CASE WHEN {full} THEN (CASE WHEN {_len16('cur')} > {overlap} THEN {_right16('cur', overlap)} ELSE '' END) || ps[i + 1] || chr(10)
              ELSE cur || ps[i + 1] || chr(10) END,
         CASE WHEN {full} THEN cur END
  FROM fold WHERE i < len(ps)),
pieces AS (
  SELECT document_id, i AS step, emitted AS content FROM fold WHERE emitted IS NOT NULL
  UNION ALL
  SELECT document_id, i + 1, cur FROM fold WHERE i = len(ps) AND length(cur) > 0)
SELECT document_id, row_number() OVER (PARTITION BY document_id ORDER BY step) - 1 AS pos, content FROM pieces"""


# --- blank turns (G5, G6, G9) and placeholders (P10) --------------------------------------------------------


def q_relevance_blank(spark, d):
    """Turns of which a third are null, empty, or white space only (ASCII and Unicode)."""
    m = (F.col("conv_id") + F.col("turn")) % 12
    text = (F.when(m == 0, F.lit(None)).when(m == 1, F.lit("")).when(m == 2, F.lit(" \t\n ")).when(m == 3, F.lit("  "))
            .otherwise(F.col("text")).cast("string"))
    rel = gates.relevance("text")
    return fx.table(spark, d, "conversations").withColumn("text", text).select(
        "conv_id", "turn", is_blank("text").alias("is_blank"), rel["is_relevant"].alias("is_relevant"), rel["rejection_reason"].alias("rejection_reason"))


SQL_RELEVANCE_BLANK = f"""WITH conv AS (
  SELECT conv_id, turn, CASE (conv_id + turn) % 12 WHEN 0 THEN NULL WHEN 1 THEN '' WHEN 2 THEN ' ' || chr(9) || chr(10) || ' '
                             WHEN 3 THEN chr(160) || chr(8195) ELSE text END AS text,
         (conv_id + turn) % 12 < 4 OR regexp_matches(text, '^\\s*$') AS blank FROM conversations)
SELECT conv_id, turn, blank AS is_blank, NOT blank AND {base.SQL_KW_COUNT} >= 1 AS is_relevant,
       CASE WHEN blank THEN {base._sql_str(EMPTY_QUERY_REASON)}
            WHEN {base.SQL_KW_COUNT} < 1 THEN {base._sql_filled(NO_KEYWORD_REASON, required="'1'", found="'0'")} END AS rejection_reason
FROM conv"""


def q_pii_placeholders(spark, d):
    """Findings one by one: how often each placeholder stands for which type in a document."""
    docs = pii.with_scrub(fx.documents_with_pii(spark, d), "text", "p")
    # explode_outer: a plain explode infers a filter on the findings, which would evaluate the scrub twice.
    found = docs.select("doc_id", F.explode_outer("p_findings").alias("f")).where("f is not null")
    return found.groupBy("doc_id", F.col("f.pii_type").alias("pii_type"), F.col("f.placeholder").alias("placeholder")).agg(F.count("*").alias("n"))


SQL_PII_PLACEHOLDERS = base.SQL_STAGES + ", found AS (\n" + "\n  UNION ALL\n".join(
    f"  SELECT id AS doc_id, '{t}' AS pii_type, '{placeholder}' AS placeholder, CAST(c{i} AS BIGINT) AS n FROM s8"
    for i, (t, placeholder, *_r) in enumerate(PII_PATTERNS, 1)) + ")\nSELECT * FROM found WHERE n > 0"


QUERIES = {
    "ask_no_id": q_ask_no_id, "ask_repeated_ids": q_ask_repeated_ids, "answers": q_answers, "topk_edge": q_topk_edge,
    "context_confidence": q_context_confidence, "chunk_upsert_edge": q_chunk_upsert_edge, "stream_ingest_store": q_stream_ingest_store,
    "ingest_rejects": q_ingest_rejects, "validate_derived": q_validate_derived, "chunk_astral": q_chunk_astral,
    "relevance_blank": q_relevance_blank, "pii_placeholders": q_pii_placeholders,
}

ORACLES = {
    "ask_no_id": SQL_ASK_NO_ID, "ask_repeated_ids": SQL_ASK_REPEATED_IDS, "answers": SQL_ANSWERS, "topk_edge": SQL_TOPK_EDGE,
    "context_confidence": SQL_CONTEXT_CONFIDENCE, "chunk_upsert_edge": SQL_CHUNK_UPSERT_EDGE, "stream_ingest_store": SQL_STREAM_INGEST_STORE,
    "ingest_rejects": SQL_INGEST_REJECTS, "validate_derived": SQL_VALIDATE_DERIVED, "chunk_astral": _sql_chunk_astral(),
    "relevance_blank": SQL_RELEVANCE_BLANK, "pii_placeholders": SQL_PII_PLACEHOLDERS,
}
