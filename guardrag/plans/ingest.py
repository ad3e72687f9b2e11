"""The ingest pipeline (S3): documents → chunks → embeddings → validated store rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from guardrag.config import ChunkingOptions
from guardrag.functions.embedding import Embedder, hashing_embedder
from guardrag.operators.chunking import chunk_documents
from guardrag.operators.store import read_rejects, read_store, upsert_store, validate_chunks
from guardrag.session import materialize


def ingest_documents(docs: DataFrame, *, content_col: str = "content", title_col: str = "title",
                     id_col: str | None = None, chunking: ChunkingOptions = ChunkingOptions(),
                     embedder: Embedder | None = None, expected_dim: int | None = None,
                     store: DataFrame | None = None, mode: str = "quarantine",
                     materialize_embeddings: bool = True) -> tuple[DataFrame, DataFrame]:
    """Chunk, embed and validate. Returns ``(valid_chunks, rejects)``.

    Narrow all the way: chunking explodes rows in place, the embedder is a column
    expression, validation a filter. Nothing shuffles until the store write.
    The embedded chunks are written once (shared checkpoint folder) before
    validation, so deriving the dimension, the valid rows and the rejects all
    read them instead of calling the embedder again.
    """
    embedder = embedder or hashing_embedder(64)
    chunks = chunk_documents(docs, content_col, title_col, id_col, chunking)
    chunks = chunks.withColumn("embedding", embedder(F.col("content")))
    if materialize_embeddings:
        chunks = materialize(chunks, "ingest-embedded")
    return validate_chunks(chunks, expected_dim, store=store, order_cols=["document_id", "pos"], mode=mode)


def ingest_to_store(docs: DataFrame, root: str, ingest_seq: int | None = None, **kwargs) -> tuple[int, DataFrame | None]:
    """Ingest into the store at ``root``: append the batch as the next version together with the
    rejected chunks. Returns (version, rejects).

    ``ingest_seq`` left out is the version, so the last commit wins. The dimension is that of the store, else of the
    batch's first valid chunk; writers that start an empty store at once should be given ``expected_dim``.
    """
    spark = docs.sparkSession
    valid, rejects = ingest_documents(docs, store=read_store(spark, root), **kwargs)
    if ingest_seq is not None:
        valid = valid.withColumn("ingest_seq", F.lit(ingest_seq).cast("bigint"))
    version = upsert_store(valid, root, rejects=rejects)
    return version, read_rejects(spark, root, version)
