"""Document → chunk table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from guardrag.config import ChunkingOptions
from guardrag.functions.chunking import chunk_text


def document_id(title_col: str, content_col: str, id_col: str | None = None):
    """The given id, else a content hash, so a re-run assigns the same id."""
    if id_col:
        return F.col(id_col).cast("string")
    return F.md5(F.concat_ws("\u0000", F.coalesce(F.col(title_col), F.lit("")), F.coalesce(F.col(content_col), F.lit(""))))


def chunk_id(doc_id_col: str = "document_id", pos_col: str = "pos"):
    """Deterministic chunk id (32 hex chars), stable under retries."""
    return F.md5(F.concat(F.col(doc_id_col), F.lit(":"), F.col(pos_col).cast("string")))


def chunk_documents(docs: DataFrame, content_col: str = "content", title_col: str = "title",
                    id_col: str | None = None, opts: ChunkingOptions = ChunkingOptions(),
                    random_ids: bool = False) -> DataFrame:
    """One row per chunk, in order: (chunk_id, document_id, pos, content, title).

    ``random_ids=True`` reproduces the original's fresh ids per ingest call (a new
    32-hex id per document and per chunk, so re-ingesting duplicates). Such ids are
    not replay-safe: write the result before anything that may be recomputed.

    Narrow: each document is chunked inside its own row and exploded in place.
    The ``_outer`` generator stops Spark from inferring ``size(chunks) > 0`` as a
    filter, which would run the fold twice (and below any repartition).
    """
    exploded = docs.select(
        document_id(title_col, content_col, id_col).alias("document_id"),
        F.col(title_col).cast("string").alias("title"),
        F.posexplode_outer(chunk_text(F.col(content_col), opts)).alias("pos", "content"),
    ).filter(F.col("pos").isNotNull())
    if random_ids:
        exploded = docs.withColumn("_doc", F.replace(F.uuid(), F.lit("-"), F.lit(""))).select(
            F.col("_doc").alias("document_id"), F.col(title_col).cast("string").alias("title"),
            F.posexplode_outer(chunk_text(F.col(content_col), opts)).alias("pos", "content"),
        ).filter(F.col("pos").isNotNull())
        cid = F.replace(F.uuid(), F.lit("-"), F.lit(""))
    else:
        cid = chunk_id()
    return exploded.select(cid.alias("chunk_id"), "document_id", F.col("pos").cast("int").alias("pos"),
                           "content", "title")
