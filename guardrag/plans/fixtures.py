"""Test inputs derived from the driver tables, in Spark and in SQL.

The raw tables lack most of what the operators look for (no blank-line
paragraphs, only a few kinds of personal data, almost no on-topic questions),
so every row gets a deterministic addition computed from its own id. No row is
dropped: each query runs over the whole table. Spark and SQL forms below are
the same expressions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from guardrag.sources.tables import read_table


# Row keys of the driver tables, used to spread single-split scans over all cores.
TABLE_KEYS = {
    "documents": ["doc_id"], "conversations": ["conv_id", "turn"], "embeddings": ["vec_id"],
    "pages": ["page_id"], "labels": ["doc_id"], "benchmark": ["item_id"],
}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return read_table(spark, f"{sf_dir.rstrip('/')}/{name}.parquet", TABLE_KEYS.get(name))


# ---------------------------------------------------------------------------
# Documents with one personal-data snippet each, chosen by doc_id % 10.
# ---------------------------------------------------------------------------


def _pii_snippet(doc_id: Column) -> Column:
    n6 = F.lpad((doc_id % 1000000).cast("string"), 6, "0")
    email = F.concat(F.lit("mail u"), doc_id.cast("string"), F.lit("@mail.example.com"))
    m = doc_id % 10
    return (
        F.when(m == 0, F.concat(F.lit("IBAN GB29NWBK60161331"), n6))
        .when(m == 1, F.concat(F.lit("card 4111111111"), n6))
        .when(m == 2, F.concat(F.lit("NI AB"), n6, F.lit("C")))
        .when(m == 3, F.concat(F.lit("sort 12-34-"), F.lpad((doc_id % 100).cast("string"), 2, "0")))
        .when(m == 4, F.concat(F.lit("Account number: 12"), n6))
        .when(m == 5, F.lit("at SW1A 1AA"))
        .when(m == 6, F.concat(F.lit("call 07700 900"), F.lpad((doc_id % 1000).cast("string"), 3, "0")))
        .when(m == 7, email)
        .when(m == 8, F.concat(email, F.lit(", NI AB"), n6, F.lit("C, sort 12-34-56")))
        .otherwise(F.lit("no identifiers"))
    )


def documents_with_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return docs.withColumn("text", F.concat(F.col("text"), F.lit(" "), _pii_snippet(F.col("doc_id")), F.lit(".")))


SQL_PII_SNIPPET = """CASE doc_id % 10
      WHEN 0 THEN 'IBAN GB29NWBK60161331' || lpad(CAST(doc_id % 1000000 AS VARCHAR), 6, '0')
      WHEN 1 THEN 'card 4111111111' || lpad(CAST(doc_id % 1000000 AS VARCHAR), 6, '0')
      WHEN 2 THEN 'NI AB' || lpad(CAST(doc_id % 1000000 AS VARCHAR), 6, '0') || 'C'
      WHEN 3 THEN 'sort 12-34-' || lpad(CAST(doc_id % 100 AS VARCHAR), 2, '0')
      WHEN 4 THEN 'Account number: 12' || lpad(CAST(doc_id % 1000000 AS VARCHAR), 6, '0')
      WHEN 5 THEN 'at SW1A 1AA'
      WHEN 6 THEN 'call 07700 900' || lpad(CAST(doc_id % 1000 AS VARCHAR), 3, '0')
      WHEN 7 THEN 'mail u' || CAST(doc_id AS VARCHAR) || '@mail.example.com'
      WHEN 8 THEN 'mail u' || CAST(doc_id AS VARCHAR) || '@mail.example.com, NI AB'
                  || lpad(CAST(doc_id % 1000000 AS VARCHAR), 6, '0') || 'C, sort 12-34-56'
      ELSE 'no identifiers' END"""

SQL_DOCS_PII = f"""docs_pii AS (
  SELECT doc_id, text || ' ' || {SQL_PII_SNIPPET} || '.' AS text, lang, source
  FROM documents)"""


# ---------------------------------------------------------------------------
# Questions: the user turns of ``conversations``, one addition per (conv_id + turn) % 4:
# 0 on-topic, 1 on-topic with personal data, 2 over-long, 3 unchanged.
# ---------------------------------------------------------------------------


def user_questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return questions_from(table(spark, sf_dir, "conversations"))


def questions_from(conversations: DataFrame) -> DataFrame:
    conv = conversations.filter(F.col("role") == "user")
    m = (F.col("conv_id") + F.col("turn")) % 4
    query = (
        F.when(m == 0, F.concat(F.col("text"), F.lit(" what is the fund yield")))
        .when(m == 1, F.concat(F.col("text"), F.lit(" STOCK market risk, mail u1@mail.example.com")))
        .when(m == 2, F.concat(F.col("text"), F.lit("x" * 1000)))
        .otherwise(F.col("text"))
    )
    return conv.select(F.concat_ws(":", F.col("conv_id").cast("string"), F.col("turn").cast("string")).alias("query_id"),
                       query.alias("query"))


SQL_QUESTIONS = """questions AS (
  SELECT CAST(conv_id AS VARCHAR) || ':' || CAST(turn AS VARCHAR) AS query_id,
         CASE (conv_id + turn) % 4
           WHEN 0 THEN text || ' what is the fund yield'
           WHEN 1 THEN text || ' STOCK market risk, mail u1@mail.example.com'
           WHEN 2 THEN text || repeat('x', 1000)
           ELSE text END AS query
  FROM conversations WHERE role = 'user')"""


# ---------------------------------------------------------------------------
# Vectors. Faults by vec_id % 50 (0 empty, 1 truncated to 32, 2 empty id,
# 3 zero vector). For retrieval every row is stored, and every row, with its
# vector reversed, is also a question: all rows take part on both sides.
# ---------------------------------------------------------------------------


def faulty_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "embeddings")
    m = F.col("vec_id") % 50
    vec = (
        F.when(m == 0, F.array().cast("array<float>"))
        .when(m == 1, F.slice(F.col("embedding"), 1, 32))
        .when(m == 3, F.transform(F.col("embedding"), lambda x: x * F.lit(0.0).cast("float")))
        .otherwise(F.col("embedding"))
    )
    cid = F.when(m == 2, F.lit("")).otherwise(F.col("vec_id").cast("string"))
    return e.select("vec_id", cid.alias("chunk_id"), vec.alias("embedding"), "label")


SQL_FAULTY = """faulty AS (
  SELECT vec_id,
         CASE WHEN vec_id % 50 = 2 THEN '' ELSE CAST(vec_id AS VARCHAR) END AS chunk_id,
         CASE vec_id % 50
           WHEN 0 THEN []::FLOAT[]
           WHEN 1 THEN embedding[1:32]
           WHEN 3 THEN list_transform(embedding, lambda x: x * 0.0::FLOAT)
           ELSE embedding END AS embedding,
         label
  FROM embeddings)"""


def vector_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "embeddings")
    return e.select(F.col("vec_id").cast("string").alias("chunk_id"), "embedding",
                    F.col("vec_id").cast("string").alias("content"), F.col("label").cast("string").alias("title"))


def vector_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "embeddings")
    return e.select(F.col("vec_id").cast("string").alias("query_id"), F.reverse("embedding").alias("embedding"))


SQL_VSTORE = """vstore AS (
  SELECT CAST(vec_id AS VARCHAR) AS chunk_id, embedding, CAST(vec_id AS VARCHAR) AS content,
         CAST(label AS VARCHAR) AS title
  FROM embeddings),
vquery AS (
  SELECT CAST(vec_id AS VARCHAR) AS query_id, list_reverse(embedding) AS embedding FROM embeddings)"""


# ---------------------------------------------------------------------------
# SQL building blocks shared by the oracles.
# ---------------------------------------------------------------------------


def sql_cosine(a: str, b: str) -> str:
    """R1/R2 in DuckDB: float32 products, left-to-right double sum, float result."""
    dot = f"list_reduce(list_transform(range(len({a})), lambda i: ({a}[i+1] * {b}[i+1])::DOUBLE), lambda s, v: s + v, 0.0::DOUBLE)"
    ma = f"list_reduce(list_transform({a}, lambda x: (x * x)::DOUBLE), lambda s, v: s + v, 0.0::DOUBLE)"
    mb = f"list_reduce(list_transform({b}, lambda x: (x * x)::DOUBLE), lambda s, v: s + v, 0.0::DOUBLE)"
    eps = "CAST('5e-324' AS DOUBLE)"
    return (f"(CASE WHEN {a} IS NULL OR {b} IS NULL OR len({a}) <> len({b}) THEN 0.0::FLOAT "
            f"WHEN {ma} <= {eps} OR {mb} <= {eps} THEN 0.0::FLOAT "
            f"ELSE ({dot} / (sqrt({ma}) * sqrt({mb})))::FLOAT END)")


def sql_hash_embedding(text: str, dim: int = 64) -> str:
    buckets = (f"list_transform(regexp_extract_all(lower({text}), '[\\p{{L}}\\p{{N}}]+'), "
               f"lambda t: (('0x' || substr(md5(t), 1, 8))::BIGINT % {dim}))")
    return f"list_transform(range({dim}), lambda i: len(list_filter({buckets}, lambda b: b = i))::FLOAT)"


def sql_chunks(source_cte: str, id_expr: str, text_expr: str, title_expr: str, sep: str = "chr(10)",
               max_len: int = 500, overlap: int = 50) -> str:
    """T1 as a recursive CTE: one step per paragraph, emitting a chunk when full.

    Produces CTE ``chunks(document_id, pos, content, title, chunk_id)``.
    ``sep`` is a SQL expression for the literal separator.
    """
    return f"""paras AS (
  SELECT {id_expr} AS document_id, {title_expr} AS title,
         list_filter(string_split({text_expr}, {sep}), lambda x: length(x) > 0) AS ps
  FROM {source_cte}),
fold AS (
  SELECT document_id, title, ps, 0 AS i, '' AS cur, NULL::VARCHAR AS emitted FROM paras
  UNION ALL
  SELECT document_id, title, ps, i + 1,
         CASE WHEN length(cur) + length(ps[i + 1]) > {max_len} AND length(cur) > 0
              THEN (CASE WHEN length(cur) > {overlap} THEN right(cur, {overlap}) ELSE '' END) || ps[i + 1] || chr(10)
              ELSE cur || ps[i + 1] || chr(10) END,
         CASE WHEN length(cur) + length(ps[i + 1]) > {max_len} AND length(cur) > 0 THEN cur END
  FROM fold WHERE i < len(ps)),
chunk_rows AS (
  SELECT document_id, title, i AS step, emitted AS content FROM fold WHERE emitted IS NOT NULL
  UNION ALL
  SELECT document_id, title, i + 1 AS step, cur AS content FROM fold WHERE i = len(ps) AND length(cur) > 0),
chunks AS (
  SELECT document_id, CAST(row_number() OVER (PARTITION BY document_id ORDER BY step) - 1 AS INTEGER) AS pos,
         content, title,
         md5(document_id || ':' || CAST(row_number() OVER (PARTITION BY document_id ORDER BY step) - 1 AS VARCHAR)) AS chunk_id
  FROM chunk_rows)"""


def sql_pii_stages(source_cte: str, id_col: str, text_col: str, prefix: str = "s") -> str:
    """P9/P10 staged in SQL: s0..s8 texts and c1..c8 counts, each count taken on its own stage input."""
    from guardrag.config import PII_PATTERNS

    ctes = [f"{prefix}0 AS (SELECT {id_col} AS id, {text_col} AS t0 FROM {source_cte})"]
    for i, (_t, ph, ci, rx) in enumerate(PII_PATTERNS, start=1):
        pat_sql = (("(?i)" if ci else "") + rx).replace("'", "''")
        ctes.append(
            f"{prefix}{i} AS (SELECT *, "
            f"coalesce(len(regexp_extract_all(t{i - 1}, '{pat_sql}')), 0) AS c{i}, "
            f"regexp_replace(t{i - 1}, '{pat_sql}', '{ph}', 'g') AS t{i} FROM {prefix}{i - 1})"
        )
    return ",\n".join(ctes)
