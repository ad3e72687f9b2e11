"""Query catalogue: one Spark query per operator and the equivalent DuckDB SQL.

Each Spark query takes ``(spark, sf_dir)`` and reads whole driver tables (see
``fixtures`` for the deterministic per-row additions). Every computed column
has the same name and type family in both forms: integers as BIGINT, scores as
DOUBLE (exact widening of the float score), arrays joined into strings.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from guardrag.config import (
    ANSWER_TEMPLATE,
    AUDIT_LABELS,
    DISCLAIMER_TEXT,
    DISCLAIMER_TRIGGER_KEYWORDS,
    EMPTY_QUERY_REASON,
    FINANCIAL_KEYWORDS,
    LOW_CONFIDENCE_RESPONSE,
    NO_KEYWORD_REASON,
    OFF_TOPIC_RESPONSE,
    PII_PATTERNS,
    QUERY_TOO_LONG_RESPONSE,
    TRUNCATED_QUERY_MARKER,
    AskOptions,
    ChunkingOptions,
)
from guardrag.functions import gates, pii
from guardrag.functions.chunking import split_paragraphs
from guardrag.functions.embedding import constant_embedder, hashing_embedder
from guardrag.functions.safety import disclaimer_triggered, template_answer, with_output_safety
from guardrag.functions.similarity import cosine
from guardrag.functions.text import is_blank, utf16_length
from guardrag.operators.answer import assemble_context
from guardrag.operators.audit import audit_line
from guardrag.operators.chunking import chunk_documents
from guardrag.operators.pii_report import pii_type_report
from guardrag.operators.retrieval import search, topk_batch
from guardrag.operators.store import upsert, validate_chunks
from guardrag.plans import fixtures as fx
from guardrag.plans.ask import ask_batch, ask_pii_report, route
from guardrag.session import materialize, scratch_path
from guardrag.sources.tables import spread
from guardrag.streaming.ask import start_ask_stream
from guardrag.streaming.ingest import start_chunk_stream

Query = Callable[[SparkSession, str], DataFrame]

LINE = ChunkingOptions(separator="\n")  # raw documents hold single newlines only
AS_OF = "2026-01-01 00:00:00"
VECTOR_K = 5
VECTOR_THRESHOLD = 0.6


def _sql_str(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def _sql_text(s: str) -> str:
    """A SQL string expression for text that may contain newlines."""
    parts = s.split("\n")
    return " || chr(10) || ".join(_sql_str(p) for p in parts) if len(parts) > 1 else _sql_str(s)


def _sql_filled(template: str, **values: str) -> str:
    """A canned text as a SQL concatenation, its ``{names}`` replaced by SQL expressions."""
    parts = re.split(r"\{(\w+)\}", template)
    return " || ".join(values[x] if i % 2 else _sql_str(x) for i, x in enumerate(parts) if x)


def _sql_list(words) -> str:
    return "[" + ", ".join(_sql_str(w) for w in dict.fromkeys(w.lower() for w in words)) + "]"


def _sql_pattern(pii_type: str) -> str:
    for t, _ph, ci, rx in PII_PATTERNS:
        if t == pii_type:
            return _sql_str(("(?i)" if ci else "") + rx)
    raise KeyError(pii_type)


def _types_string(findings: Column) -> Column:
    return F.array_join(F.transform(findings, lambda x: F.concat(x["pii_type"], F.lit(";"))), "")


SQL_TYPES_STRING = " || ".join(f"repeat('{t};', CAST(c{i} AS INTEGER))" for i, (t, *_r) in enumerate(PII_PATTERNS, 1))

# ---------------------------------------------------------------------------
# P1–P12
# ---------------------------------------------------------------------------

PII_SHORT = {
    "UkIban": "pii_iban", "CreditCardNumber": "pii_card", "UkNationalInsuranceNumber": "pii_nino",
    "UkSortCode": "pii_sort_code", "UkBankAccountNumber": "pii_account", "UkPostcode": "pii_postcode",
    "UkPhoneNumber": "pii_phone", "EmailAddress": "pii_email",
}


def _pii_single(pii_type: str) -> Query:
    def q(spark, d):
        docs = fx.documents_with_pii(spark, d)
        return docs.select("doc_id", pii.match_count("text", pii_type).cast("bigint").alias("n_matches"))
    return q


def _pii_single_sql(pii_type: str) -> str:
    return f"""WITH {fx.SQL_DOCS_PII}
SELECT doc_id, CAST(coalesce(len(regexp_extract_all(text, {_sql_pattern(pii_type)})), 0) AS BIGINT) AS n_matches
FROM docs_pii"""


def q_pii_scrub(spark, d):
    docs = fx.documents_with_pii(spark, d)
    return docs.select("doc_id", pii.scrub_text("text").alias("scrubbed_text"))


SQL_STAGES = f"""WITH {fx.SQL_DOCS_PII},
{fx.sql_pii_stages("docs_pii", "doc_id", "text")}"""

SQL_PII_SCRUB = SQL_STAGES + "\nSELECT id AS doc_id, t8 AS scrubbed_text FROM s8"


def q_pii_scrub_pages(spark, d):
    """P9/P10 on raw web pages: scrubbed html and the redaction count per page."""
    pages = pii.with_scrub(fx.table(spark, d, "pages"), "html", "p")
    return pages.select("page_id", F.col("p_text").alias("scrubbed_html"), F.col("p_count").cast("bigint").alias("n_findings"))


SQL_PII_SCRUB_PAGES = f"""WITH {fx.sql_pii_stages("pages", "page_id", "html")}
SELECT id AS page_id, t8 AS scrubbed_html, CAST(c1 + c2 + c3 + c4 + c5 + c6 + c7 + c8 AS BIGINT) AS n_findings FROM s8"""


def q_pii_findings(spark, d):
    docs = pii.with_scrub(fx.documents_with_pii(spark, d), "text", "p")
    return docs.select("doc_id", F.col("p_count").cast("bigint").alias("n_findings"),
                       _types_string(F.col("p_findings")).alias("finding_types"))


SQL_PII_FINDINGS = SQL_STAGES + f"""
SELECT id AS doc_id, CAST(c1 + c2 + c3 + c4 + c5 + c6 + c7 + c8 AS BIGINT) AS n_findings,
       {SQL_TYPES_STRING} AS finding_types
FROM s8"""


def q_pii_contains(spark, d):
    docs = fx.documents_with_pii(spark, d)
    return docs.select("doc_id", pii.contains_pii("text").alias("contains_pii"))


SQL_PII_CONTAINS = f"""WITH {fx.SQL_DOCS_PII}
SELECT doc_id, coalesce(NOT (text IS NULL OR regexp_matches(text, '^\\s*$')) AND ({' OR '.join(f"regexp_matches(text, {_sql_pattern(t)})" for t, *_ in PII_PATTERNS)}), false) AS contains_pii
FROM docs_pii"""


def q_pii_report(spark, d):
    docs = pii.with_scrub(fx.documents_with_pii(spark, d), "text", "p")
    return pii_type_report(docs, "p_counts", "document").select(
        "direction", "pii_type", F.col("redactions").cast("bigint").alias("redactions"),
        F.col("items").cast("bigint").alias("items"))


SQL_PII_REPORT = SQL_STAGES + "\n, counts AS (\n" + "\n  UNION ALL\n".join(
    f"  SELECT id, '{t}' AS pii_type, c{i} AS n FROM s8" for i, (t, *_r) in enumerate(PII_PATTERNS, 1)
) + """)
SELECT 'document' AS direction, pii_type, CAST(sum(n) AS BIGINT) AS redactions,
       CAST(count(DISTINCT id) AS BIGINT) AS items
FROM counts WHERE n > 0 GROUP BY pii_type"""


# ---------------------------------------------------------------------------
# G1–G9
# ---------------------------------------------------------------------------


def q_length_gate(spark, d):
    conv = fx.table(spark, d, "conversations")
    too_long = gates.is_too_long("text", 1000)
    return conv.select(
        "conv_id", "turn", utf16_length("text").cast("bigint").alias("n_chars"), too_long.alias("too_long"),
        F.when(too_long, gates.truncation_marker("text")).alias("audit_query"),
        F.when(too_long, gates.too_long_message()).alias("response"))


SQL_LENGTH_GATE = f"""SELECT conv_id, turn, CAST(length(text) AS BIGINT) AS n_chars, length(text) > 1000 AS too_long,
       CASE WHEN length(text) > 1000 THEN {_sql_filled(TRUNCATED_QUERY_MARKER, n='CAST(length(text) AS VARCHAR)')} END AS audit_query,
       CASE WHEN length(text) > 1000 THEN {_sql_str(QUERY_TOO_LONG_RESPONSE.replace('{0}', '1000'))} END AS response
FROM conversations"""


def q_relevance_check(spark, d):
    conv = fx.table(spark, d, "conversations")
    rel = gates.relevance("text")
    return conv.select("conv_id", "turn", is_blank("text").alias("is_blank"),
                       rel["keyword_matches"].cast("bigint").alias("keyword_matches"),
                       rel["is_relevant"].alias("is_relevant"), rel["rejection_reason"].alias("rejection_reason"))


SQL_KW_COUNT = f"len(list_filter({_sql_list(FINANCIAL_KEYWORDS)}, lambda k: contains(lower(text), k)))"
SQL_BLANK = "(text IS NULL OR regexp_matches(text, '^\\s*$'))"
SQL_RELEVANCE = f"""SELECT conv_id, turn, {SQL_BLANK} AS is_blank,
       CAST(CASE WHEN {SQL_BLANK} THEN 0 ELSE {SQL_KW_COUNT} END AS BIGINT) AS keyword_matches,
       NOT {SQL_BLANK} AND {SQL_KW_COUNT} >= 1 AS is_relevant,
       CASE WHEN {SQL_BLANK} THEN {_sql_str(EMPTY_QUERY_REASON)}
            WHEN {SQL_KW_COUNT} < 1 THEN {_sql_filled(NO_KEYWORD_REASON, required="'1'", found=f'CAST({SQL_KW_COUNT} AS VARCHAR)')} END AS rejection_reason
FROM conversations"""


def q_outcome_routing(spark, d):
    r = route(fx.user_questions(spark, d))
    return r.select("query_id", F.coalesce("outcome", F.lit("pass")).alias("outcome"))


SQL_ROUTE_CASE = f"""CASE WHEN length(query) > 1000 THEN 'too_long'
            WHEN regexp_matches(query, '^\\s*$') OR len(list_filter({_sql_list(FINANCIAL_KEYWORDS)}, lambda k: contains(lower(query), k))) < 1 THEN 'off_topic'
            ELSE 'pass' END"""
SQL_OUTCOME_ROUTING = f"""WITH {fx.SQL_QUESTIONS}
SELECT query_id, {SQL_ROUTE_CASE} AS outcome FROM questions"""


# ---------------------------------------------------------------------------
# T1–T5
# ---------------------------------------------------------------------------


def q_split_paragraphs(spark, d):
    docs = fx.table(spark, d, "documents")
    ps = split_paragraphs("text", "\n")
    return docs.select("doc_id", F.size(ps).cast("bigint").alias("n_paragraphs"),
                       F.aggregate(ps, F.lit(0).cast("bigint"), lambda a, p: a + F.length(p)).alias("paragraph_chars"))


SQL_SPLIT = """SELECT doc_id, CAST(len(ps) AS BIGINT) AS n_paragraphs,
       CAST(list_reduce(list_transform(ps, lambda p: length(p)::BIGINT), lambda a, v: a + v, 0::BIGINT) AS BIGINT) AS paragraph_chars
FROM (SELECT doc_id, list_filter(string_split(text, chr(10)), lambda x: length(x) > 0) AS ps FROM documents)"""


def _chunk_out(ch: DataFrame) -> DataFrame:
    return ch.select("chunk_id", "document_id", F.col("pos").cast("bigint").alias("pos"), "title",
                     F.length("content").cast("bigint").alias("n_chars"), "content")


def q_chunk_documents(spark, d):
    return _chunk_out(chunk_documents(fx.table(spark, d, "documents"), "text", "source", "doc_id", LINE))


SQL_CHUNK_OUT = "SELECT chunk_id, document_id, CAST(pos AS BIGINT) AS pos, title, CAST(length(content) AS BIGINT) AS n_chars, content FROM chunks"
SQL_CHUNK_DOCUMENTS = "WITH RECURSIVE " + fx.sql_chunks("documents", "CAST(doc_id AS VARCHAR)", "text", "source") + "\n" + SQL_CHUNK_OUT


def q_chunk_documents_blankline(spark, d):
    docs = fx.table(spark, d, "documents").withColumn("text", F.replace("text", F.lit("\n"), F.lit("\n\n")))
    return _chunk_out(chunk_documents(docs, "text", "source", "doc_id", ChunkingOptions()))


SQL_CHUNK_BLANKLINE = "WITH RECURSIVE " + fx.sql_chunks(
    "(SELECT doc_id, replace(text, chr(10), chr(10) || chr(10)) AS text, source FROM documents)",
    "CAST(doc_id AS VARCHAR)", "text", "source", sep="chr(10) || chr(10)") + "\n" + SQL_CHUNK_OUT


def q_embed_constant(spark, d):
    docs = fx.table(spark, d, "documents").withColumn("e", constant_embedder("text"))
    return docs.select("doc_id", F.size("e").cast("bigint").alias("dim"),
                       *[F.col("e")[i].cast("double").alias(f"e{i}") for i in range(3)])


SQL_EMBED_CONSTANT = """SELECT doc_id, CAST(3 AS BIGINT) AS dim, CAST(0.02::FLOAT AS DOUBLE) AS e0,
       CAST(0.36::FLOAT AS DOUBLE) AS e1, CAST(0.91::FLOAT AS DOUBLE) AS e2 FROM documents"""


def _ints(v: Column) -> Column:
    return F.array_join(F.transform(v, lambda x: x.cast("int").cast("string")), ",")


def q_embed_hashing(spark, d):
    ch = chunk_documents(fx.table(spark, d, "documents"), "text", "source", "doc_id", LINE)
    ch = ch.withColumn("embedding", hashing_embedder(64)(F.col("content")))
    return ch.select("chunk_id", _ints(F.col("embedding")).alias("embedding"))


SQL_EMBED_HASHING = "WITH RECURSIVE " + fx.sql_chunks("documents", "CAST(doc_id AS VARCHAR)", "text", "source") + f"""
SELECT chunk_id, array_to_string(list_transform({fx.sql_hash_embedding('content')}, lambda x: CAST(CAST(x AS INTEGER) AS VARCHAR)), ',') AS embedding
FROM chunks"""


def q_chunk_validate(spark, d):
    valid, rejects = validate_chunks(fx.faulty_vectors(spark, d), expected_dim=64)
    return valid.select("vec_id", F.lit(None).cast("string").alias("reason")).unionByName(
        rejects.select("vec_id", "reason"))


SQL_CHUNK_VALIDATE = f"""WITH {fx.SQL_FAULTY}
SELECT vec_id, CASE WHEN embedding IS NULL OR len(embedding) = 0 THEN 'empty_embedding'
                    WHEN chunk_id IS NULL OR chunk_id = '' THEN 'empty_id'
                    WHEN len(embedding) <> 64 THEN 'dimension_mismatch' END AS reason
FROM faulty"""


def q_chunk_upsert(spark, d):
    e = fx.table(spark, d, "embeddings")
    existing = e.select(F.col("vec_id").cast("string").alias("chunk_id"), "embedding",
                        F.lit(1).cast("bigint").alias("ingest_seq"))
    updates = e.select(F.col("vec_id").cast("string").alias("chunk_id"), F.reverse("embedding").alias("embedding"),
                       F.when(F.col("vec_id") % 10 == 0, F.lit(2)).otherwise(F.lit(0)).cast("bigint").alias("ingest_seq"))
    out = upsert(existing, updates)
    return out.select("chunk_id", "ingest_seq", F.col("embedding")[0].cast("double").alias("first_x"),
                      F.element_at("embedding", -1).cast("double").alias("last_x"))


SQL_CHUNK_UPSERT = """WITH existing AS (
  SELECT CAST(vec_id AS VARCHAR) AS chunk_id, embedding, CAST(1 AS BIGINT) AS ingest_seq, 0 AS src FROM embeddings),
updates AS (
  SELECT CAST(vec_id AS VARCHAR) AS chunk_id, list_reverse(embedding) AS embedding,
         CAST(CASE WHEN vec_id % 10 = 0 THEN 2 ELSE 0 END AS BIGINT) AS ingest_seq, 1 AS src FROM embeddings),
u AS (SELECT * FROM existing UNION ALL SELECT * FROM updates),
r AS (SELECT *, row_number() OVER (PARTITION BY chunk_id ORDER BY ingest_seq DESC NULLS LAST, src DESC) AS rn FROM u)
SELECT chunk_id, ingest_seq, CAST(embedding[1] AS DOUBLE) AS first_x, CAST(embedding[len(embedding)] AS DOUBLE) AS last_x
FROM r WHERE rn = 1"""


# ---------------------------------------------------------------------------
# R1–R9
# ---------------------------------------------------------------------------


def q_cosine_pairs(spark, d):
    a = fx.faulty_vectors(spark, d).select(F.col("vec_id"), F.col("embedding").alias("a"))
    b = fx.faulty_vectors(spark, d).select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("b"))
    return a.join(b, "vec_id").select("vec_id", cosine("a", "b").cast("double").alias("score"))


SQL_COSINE_PAIRS = f"""WITH {fx.SQL_FAULTY}
SELECT x.vec_id, CAST({fx.sql_cosine('x.embedding', 'y.embedding')} AS DOUBLE) AS score
FROM faulty x JOIN faulty y ON y.vec_id = x.vec_id + 1"""


def _vector_topk(spark, d, k=VECTOR_K):
    return topk_batch(fx.vector_store(spark, d), fx.vector_queries(spark, d), k, carry=["content", "title"])


def q_topk_batch(spark, d):
    r = _vector_topk(spark, d)
    return r.select("query_id", F.col("rank").cast("bigint").alias("rank"), "chunk_id",
                    F.col("score").cast("double").alias("score"))


SQL_VECTOR_RANKED = f"""WITH {fx.SQL_VSTORE},
scored AS (
  SELECT q.query_id, c.chunk_id, c.content, c.title, {fx.sql_cosine('c.embedding', 'q.embedding')} AS score
  FROM vquery q CROSS JOIN vstore c),
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY isnan(score), score DESC, chunk_id) AS rank FROM scored)"""

SQL_TOPK_BATCH = SQL_VECTOR_RANKED + f"""
SELECT query_id, CAST(rank AS BIGINT) AS rank, chunk_id, CAST(score AS DOUBLE) AS score FROM ranked WHERE rank <= {VECTOR_K}"""


def _max_vector(df: DataFrame, col: str = "embedding") -> list[float]:
    """Element-wise max over all vectors: a bounded (dim-sized) aggregate."""
    rows = (df.select(F.posexplode(col).alias("i", "x")).groupBy("i").agg(F.max("x").alias("m"))
            .orderBy("i").collect())
    return [r["m"] for r in rows]


def q_topk_single(spark, d):
    store = fx.vector_store(spark, d)
    r = search(store, _max_vector(fx.table(spark, d, "embeddings")), VECTOR_K)
    return r.select(F.col("rank").cast("bigint").alias("rank"), "chunk_id", F.col("score").cast("double").alias("score"))


SQL_TOPK_SINGLE = f"""WITH {fx.SQL_VSTORE},
el AS (SELECT unnest(embedding) AS x, unnest(range(len(embedding))) AS i FROM embeddings),
qv AS (SELECT list(m ORDER BY i) AS embedding FROM (SELECT i, max(x) AS m FROM el GROUP BY i)),
scored AS (SELECT c.chunk_id, {fx.sql_cosine('c.embedding', 'qv.embedding')} AS score FROM vstore c CROSS JOIN qv)
SELECT CAST(row_number() OVER (ORDER BY isnan(score), score DESC, chunk_id) AS BIGINT) AS rank, chunk_id,
       CAST(score AS DOUBLE) AS score
FROM scored ORDER BY isnan(score), score DESC, chunk_id LIMIT {VECTOR_K}"""


def q_topk_zero(spark, d):
    """With k = 0 every question gets an empty ranking (and stays in the output)."""
    q = fx.vector_queries(spark, d)
    r = topk_batch(fx.vector_store(spark, d), q, 0)
    n = r.groupBy("query_id").agg(F.count(F.lit(1)).alias("n_results"))
    return q.select("query_id").join(n, "query_id", "left").select(
        "query_id", F.coalesce("n_results", F.lit(0)).cast("bigint").alias("n_results"))


SQL_TOPK_ZERO = f"""WITH {fx.SQL_VSTORE}
SELECT query_id, CAST(0 AS BIGINT) AS n_results FROM vquery"""


def q_context_sources(spark, d):
    ctx = assemble_context(_vector_topk(spark, d))
    low = gates.is_low_confidence("top_score", VECTOR_THRESHOLD)
    return ctx.select("query_id", F.col("top_score").cast("double").alias("top_score"), low.alias("low_confidence"),
                      F.array_join("context", ",").alias("context"), F.array_join("sources", ", ").alias("sources"))


SQL_CONTEXT_SOURCES = SQL_VECTOR_RANKED + f"""
SELECT query_id, CAST(max(CASE WHEN rank = 1 THEN score END) AS DOUBLE) AS top_score,
       max(CASE WHEN rank = 1 THEN score END) < CAST({VECTOR_THRESHOLD} AS FLOAT) AS low_confidence,
       string_agg(content, ',' ORDER BY rank) AS context, string_agg(title, ', ' ORDER BY rank) AS sources
FROM ranked WHERE rank <= {VECTOR_K} GROUP BY query_id"""


# ---------------------------------------------------------------------------
# A1–A13
# ---------------------------------------------------------------------------


def q_template_answer(spark, d):
    conv = fx.table(spark, d, "conversations")
    nxt = conv.select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("next_text"))
    users = conv.filter(F.col("role") == "user").join(nxt, ["conv_id", "turn"], "left")
    ctx = F.when(F.col("next_text").isNull(), F.array().cast("array<string>")).otherwise(F.array("next_text"))
    return users.select("conv_id", "turn", template_answer(F.col("text"), ctx).alias("answer"))


SQL_TEMPLATE_ANSWER = f"""SELECT u.conv_id, u.turn, {_sql_filled(ANSWER_TEMPLATE, question='u.text', context="coalesce(n.text, '')")} AS answer
FROM conversations u LEFT JOIN conversations n ON n.conv_id = u.conv_id AND n.turn = u.turn + 1
WHERE u.role = 'user'"""


def q_disclaimer(spark, d):
    conv = fx.table(spark, d, "conversations")
    return conv.select("conv_id", "turn", disclaimer_triggered("text").alias("disclaimer_triggered"))


SQL_DISCLAIMER = f"""SELECT conv_id, turn, coalesce(len(list_filter({_sql_list(DISCLAIMER_TRIGGER_KEYWORDS)}, lambda k: contains(lower(text), k))) > 0, false) AS disclaimer_triggered
FROM conversations"""


def q_output_safety(spark, d):
    out = with_output_safety(fx.documents_with_pii(spark, d), "text", prefix="o")
    return out.select("doc_id", F.col("o_response").alias("filtered_response"),
                      F.col("o_count").cast("bigint").alias("redaction_count"),
                      F.col("o_disclaimer").alias("disclaimer_appended"))


SQL_OUTPUT_SAFETY = SQL_STAGES + f"""
, trig AS (SELECT *, NOT (t0 IS NULL OR regexp_matches(t0, '^\\s*$'))
                      AND coalesce(len(list_filter({_sql_list(DISCLAIMER_TRIGGER_KEYWORDS)}, lambda k: contains(lower(t8), k))) > 0, false) AS appended
           FROM s8)
SELECT id AS doc_id,
       CASE WHEN t0 IS NULL OR regexp_matches(t0, '^\\s*$') THEN coalesce(t0, '')
            WHEN appended THEN t8 || {_sql_text(DISCLAIMER_TEXT)} ELSE t8 END AS filtered_response,
       CAST(CASE WHEN t0 IS NULL OR regexp_matches(t0, '^\\s*$') THEN 0 ELSE c1 + c2 + c3 + c4 + c5 + c6 + c7 + c8 END AS BIGINT) AS redaction_count,
       appended AS disclaimer_appended
FROM trig"""


def document_store(spark: SparkSession, d: str) -> DataFrame:
    """The chunk store built from every document: chunk, embed, validate, checkpoint."""
    ch = chunk_documents(fx.table(spark, d, "documents"), "text", "source", "doc_id", LINE)
    ch = ch.withColumn("embedding", hashing_embedder(64)(F.col("content")))
    store, _rejects = validate_chunks(ch, expected_dim=64)
    return materialize(store, "document-store")


def ask_audit(spark: SparkSession, d: str, opts: AskOptions = AskOptions(), strategy: str = "auto") -> DataFrame:
    """Questions (user turns) against the chunk store built from every document."""
    return ask_batch(fx.user_questions(spark, d), document_store(spark, d), opts,
                     as_of=F.to_timestamp(F.lit(AS_OF)), strategy=strategy)


def _ask_out(a: DataFrame) -> DataFrame:
    return a.select(
        "query_id", "outcome", "correlation_id", "scrubbed_query", "scrubbed_response",
        F.array_join("sources", ", ").alias("sources"), F.col("top_confidence_score").cast("double").alias("top_score"),
        "was_rejected_for_length", "was_rejected_for_relevance", "was_low_confidence",
        F.col("input_pii_redaction_count").cast("bigint").alias("input_pii"),
        F.col("output_pii_redaction_count").cast("bigint").alias("output_pii"), "disclaimer_appended")


def q_ask_batch(spark, d):
    return _ask_out(ask_audit(spark, d))


def _parquet_stream(spark: SparkSession, d: str, name: str) -> DataFrame:
    """A table as a file stream, whether it is one file or a folder of files: a pattern takes either, a plain path or ``pathGlobFilter`` only one of them."""
    path = f"{d.rstrip('/')}/{name}.parquet"
    return spark.readStream.schema(spark.read.parquet(path).schema).parquet(f"{path[:-1]}[t]")


def q_stream_ingest(spark, d):
    """The documents table as a file stream, chunked per micro-batch (availableNow)."""
    sink, ckpt = scratch_path(spark, "stream-ingest"), scratch_path(spark, "stream-ingest-ckpt")
    q = start_chunk_stream(
        _parquet_stream(spark, d, "documents"),
        lambda df: _chunk_out(chunk_documents(spread(df, ["doc_id"]), "text", "source", "doc_id", LINE)),
        sink, ckpt)
    q.awaitTermination()
    return spark.read.parquet(sink).drop("batch_id")


def q_stream_ask(spark, d):
    """Conversations as a stream of questions, answered per micro-batch."""
    sink, ckpt = scratch_path(spark, "stream-ask"), scratch_path(spark, "stream-ask-ckpt")
    q = start_ask_stream(_parquet_stream(spark, d, "conversations"), document_store(spark, d), sink, ckpt,
                         available_now=True, as_of=F.to_timestamp(F.lit(AS_OF)),
                         prepare=lambda df: fx.questions_from(spread(df, ["conv_id", "turn"])))
    q.awaitTermination()
    return _ask_out(spark.read.parquet(sink).drop("batch_id"))


def q_pii_report_ask(spark, d):
    rep = ask_pii_report(ask_audit(spark, d))
    return rep.select("direction", "pii_type", F.col("redactions").cast("bigint").alias("redactions"),
                      F.col("items").cast("bigint").alias("items"))


def q_audit_lines(spark, d):
    return ask_audit(spark, d).select("query_id", audit_line().alias("line"))


def _sql_ask() -> str:
    opts = AskOptions()
    kw = _sql_list(FINANCIAL_KEYWORDS)
    dis = _sql_list(DISCLAIMER_TRIGGER_KEYWORDS)
    chunks = fx.sql_chunks("documents", "CAST(doc_id AS VARCHAR)", "text", "source")
    q_stages = fx.sql_pii_stages("survivors", "query_id", "query", prefix="q")
    ans_stages = fx.sql_pii_stages("raw_answers", "query_id", "raw", prefix="a")
    off_stages = fx.sql_pii_stages("(SELECT * FROM routed WHERE outcome = 'off_topic')", "query_id", "query", prefix="o")
    thr = f"CAST({opts.query.confidence_threshold} AS FLOAT)"
    return f"""WITH RECURSIVE {chunks},
store AS (SELECT chunk_id, content, title, {fx.sql_hash_embedding('content')} AS embedding FROM chunks),
{fx.SQL_QUESTIONS},
routed AS (
  SELECT query_id, query,
         CASE WHEN length(query) > {opts.query.max_query_length} THEN 'too_long'
              WHEN regexp_matches(query, '^\\s*$') OR len(list_filter({kw}, lambda k: contains(lower(query), k))) < 1 THEN 'off_topic'
         END AS outcome
  FROM questions),
survivors AS (SELECT query_id, query FROM routed WHERE outcome IS NULL),
{q_stages},
qemb AS (SELECT id AS query_id, t8 AS in_text, c1 + c2 + c3 + c4 + c5 + c6 + c7 + c8 AS in_count,
                {fx.sql_hash_embedding('t8')} AS embedding FROM q8),
scored AS (
  SELECT q.query_id, c.chunk_id, c.content, c.title, {fx.sql_cosine('c.embedding', 'q.embedding')} AS score
  FROM qemb q CROSS JOIN store c),
ranked AS (
  SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY isnan(score), score DESC, chunk_id) AS rank FROM scored)
  WHERE rank <= {opts.query.top_k}),
ctx AS (
  SELECT query_id, max(CASE WHEN rank = 1 THEN score END) AS top_score,
         string_agg(content, ',' ORDER BY rank) AS context, string_agg(title, ', ' ORDER BY rank) AS sources
  FROM ranked GROUP BY query_id),
joined AS (
  SELECT q.query_id, q.in_text, q.in_count, coalesce(x.top_score, 0.0::FLOAT) AS top_score, x.context, x.sources,
         coalesce(x.top_score, 0.0::FLOAT) < {thr} AS low
  FROM qemb q LEFT JOIN ctx x ON q.query_id = x.query_id),
raw_answers AS (
  SELECT query_id, {_sql_filled(ANSWER_TEMPLATE, question='in_text', context="coalesce(context, '')")} AS raw
  FROM joined WHERE NOT low),
{ans_stages},
safe AS (
  SELECT id AS query_id, c1 + c2 + c3 + c4 + c5 + c6 + c7 + c8 AS out_count,
         NOT (t0 IS NULL OR regexp_matches(t0, '^\\s*$'))
           AND coalesce(len(list_filter({dis}, lambda k: contains(lower(t8), k))) > 0, false) AS appended,
         t8
  FROM a8),
{off_stages}
SELECT query_id, 'too_long' AS outcome, md5(query_id) AS correlation_id,
       {_sql_filled(TRUNCATED_QUERY_MARKER, n='CAST(length(query) AS VARCHAR)')} AS scrubbed_query,
       {_sql_str(QUERY_TOO_LONG_RESPONSE.replace('{0}', str(opts.query.max_query_length)))} AS scrubbed_response,
       '' AS sources, 0.0::DOUBLE AS top_score, true AS was_rejected_for_length, false AS was_rejected_for_relevance,
       false AS was_low_confidence, 0::BIGINT AS input_pii, 0::BIGINT AS output_pii, false AS disclaimer_appended
FROM routed WHERE outcome = 'too_long'
UNION ALL
SELECT id, 'off_topic', md5(id), t8, {_sql_str(OFF_TOPIC_RESPONSE)}, '', 0.0::DOUBLE, false, true, false, 0::BIGINT, 0::BIGINT, false
FROM o8
UNION ALL
SELECT query_id, 'low_confidence', md5(query_id), in_text, {_sql_str(LOW_CONFIDENCE_RESPONSE)}, '', CAST(top_score AS DOUBLE),
       false, false, true, CAST(in_count AS BIGINT), 0::BIGINT, false
FROM joined WHERE low
UNION ALL
SELECT j.query_id, 'answered', md5(j.query_id), j.in_text,
       CASE WHEN s.appended THEN s.t8 || {_sql_text(DISCLAIMER_TEXT)} ELSE s.t8 END,
       coalesce(j.sources, ''), CAST(j.top_score AS DOUBLE), false, false, false, CAST(j.in_count AS BIGINT),
       CAST(s.out_count AS BIGINT), s.appended
FROM joined j JOIN safe s ON j.query_id = s.query_id"""


SQL_ASK_BATCH = _sql_ask()

def _sql_pii_report_ask() -> str:
    head, _sep, _tail = SQL_ASK_BATCH.partition("\nSELECT query_id, 'too_long' AS outcome")
    unpivot = "\n  UNION ALL\n".join(
        f"  SELECT '{direction}' AS direction, '{t}' AS pii_type, c{i} AS n FROM {cte}"
        for direction, cte in (("input", "q8"), ("output", "a8"))
        for i, (t, *_r) in enumerate(PII_PATTERNS, 1))
    return f"""{head},
counts AS (
{unpivot})
SELECT direction, pii_type, CAST(sum(n) AS BIGINT) AS redactions, CAST(count(*) AS BIGINT) AS items
FROM counts WHERE n > 0 GROUP BY direction, pii_type"""


def _sql_audit_lines() -> str:
    body = SQL_ASK_BATCH
    head, sep, tail = body.partition("\nSELECT query_id, 'too_long' AS outcome")
    final = sep.lstrip("\n") + tail
    ts = AS_OF
    rounded = "printf('%.3f', (floor(abs(top_score * 1000.0) + 0.5) * sign(top_score) / 1000.0) + 0.0)"
    values = ("correlation_id", f"'{ts}'", rounded, "CASE WHEN was_low_confidence THEN 'True' ELSE 'False' END", "CAST(input_pii AS VARCHAR)",
              "CAST(output_pii AS VARCHAR)", "CASE WHEN disclaimer_appended THEN 'True' ELSE 'False' END", "CAST(n_sources AS VARCHAR)",
              "coalesce(scrubbed_query, '')", "coalesce(scrubbed_response, '')", "sources")
    line = " || ".join(f"{_sql_str(label)} || {value}" for label, value in zip(AUDIT_LABELS, values, strict=True))
    sources_count = "CASE WHEN sources = '' THEN 0 ELSE len(string_split(sources, ', ')) END"
    return f"""{head},
audit AS (
{final})
SELECT query_id, {line} AS line
FROM (SELECT *, {sources_count} AS n_sources FROM audit)"""


# ---------------------------------------------------------------------------
# Registry
# ---------------------------------------------------------------------------

QUERIES: dict[str, Query] = {
    **{PII_SHORT[t]: _pii_single(t) for t, *_r in PII_PATTERNS},
    "pii_scrub": q_pii_scrub,
    "pii_findings": q_pii_findings,
    "pii_scrub_pages": q_pii_scrub_pages,
    "pii_contains": q_pii_contains,
    "pii_report": q_pii_report,
    "length_gate": q_length_gate,
    "relevance_check": q_relevance_check,
    "outcome_routing": q_outcome_routing,
    "split_paragraphs": q_split_paragraphs,
    "chunk_documents": q_chunk_documents,
    "chunk_documents_blankline": q_chunk_documents_blankline,
    "embed_constant": q_embed_constant,
    "embed_hashing": q_embed_hashing,
    "chunk_validate": q_chunk_validate,
    "chunk_upsert": q_chunk_upsert,
    "cosine_pairs": q_cosine_pairs,
    "topk_batch": q_topk_batch,
    "topk_single": q_topk_single,
    "topk_zero": q_topk_zero,
    "context_sources": q_context_sources,
    "template_answer": q_template_answer,
    "disclaimer": q_disclaimer,
    "output_safety": q_output_safety,
    "ask_batch": q_ask_batch,
    "audit_lines": q_audit_lines,
    "pii_report_ask": q_pii_report_ask,
    "stream_ingest": q_stream_ingest,
    "stream_ask": q_stream_ask,
}

ORACLES: dict[str, str] = {
    **{PII_SHORT[t]: _pii_single_sql(t) for t, *_r in PII_PATTERNS},
    "pii_scrub": SQL_PII_SCRUB,
    "pii_findings": SQL_PII_FINDINGS,
    "pii_scrub_pages": SQL_PII_SCRUB_PAGES,
    "pii_contains": SQL_PII_CONTAINS,
    "pii_report": SQL_PII_REPORT,
    "length_gate": SQL_LENGTH_GATE,
    "relevance_check": SQL_RELEVANCE,
    "outcome_routing": SQL_OUTCOME_ROUTING,
    "split_paragraphs": SQL_SPLIT,
    "chunk_documents": SQL_CHUNK_DOCUMENTS,
    "chunk_documents_blankline": SQL_CHUNK_BLANKLINE,
    "embed_constant": SQL_EMBED_CONSTANT,
    "embed_hashing": SQL_EMBED_HASHING,
    "chunk_validate": SQL_CHUNK_VALIDATE,
    "chunk_upsert": SQL_CHUNK_UPSERT,
    "cosine_pairs": SQL_COSINE_PAIRS,
    "topk_batch": SQL_TOPK_BATCH,
    "topk_single": SQL_TOPK_SINGLE,
    "topk_zero": SQL_TOPK_ZERO,
    "context_sources": SQL_CONTEXT_SOURCES,
    "template_answer": SQL_TEMPLATE_ANSWER,
    "disclaimer": SQL_DISCLAIMER,
    "output_safety": SQL_OUTPUT_SAFETY,
    "ask_batch": SQL_ASK_BATCH,
    "audit_lines": _sql_audit_lines(),
    "pii_report_ask": _sql_pii_report_ask(),
    "stream_ingest": SQL_CHUNK_DOCUMENTS,
    "stream_ask": SQL_ASK_BATCH,
}
