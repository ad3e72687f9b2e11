"""Chunking as a table function (T1c): a lateral join yields chunk by chunk, and no array of a whole document's chunks exists."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from guardrag.config import ChunkingOptions
from guardrag.functions.chunking import last_units, utf16_units


def paragraphs_of(text: str, separator: str) -> Iterator[str]:
    """The non-empty pieces between separators, one at a time."""
    at = 0
    while at <= len(text):
        end = text.find(separator, at) if separator else -1
        if end < 0:
            end = len(text)
        if end > at:
            yield text[at:end]
        at = end + max(1, len(separator))


def chunks_of(text: str, separator: str, max_len: int, overlap: int) -> Iterator[str]:
    """The greedy packing of ``pack_paragraphs``, holding one open chunk."""
    parts: list[str] = []
    size = 0
    for p in paragraphs_of(text, separator):
        units = utf16_units(p)
        if size and size + units > max_len:
            chunk = "".join(parts)
            yield chunk
            parts = [last_units(chunk, overlap)] if size > overlap else []
            size = overlap if size > overlap else 0
        parts += (p, "\n")
        size += units + 1
    if parts:
        yield "".join(parts)


class ChunkTable:
    """``chunk_table(text, separator, max_len, overlap)`` → rows (pos, content); a null text has none."""

    def eval(self, text: str, separator: str, max_len: int, overlap: int) -> Iterator[tuple[int, str]]:
        if text:
            yield from enumerate(chunks_of(text, separator, max_len, overlap))


def chunk_table():
    return F.udtf(ChunkTable, returnType="pos int, content string")


def register_chunk_table(spark: SparkSession, name: str = "chunk_table") -> None:
    """For SQL: ``SELECT d.*, c.pos, c.content FROM docs d, LATERAL chunk_table(d.text, '\\n', 500, 50) c``."""
    spark.udtf.register(name, chunk_table())


def chunk_documents_lateral(docs: DataFrame, content_col: str = "content", title_col: str = "title", id_col: str | None = None,
                            opts: ChunkingOptions = ChunkingOptions()) -> DataFrame:
    """``chunk_documents`` as a lateral join: (chunk_id, document_id, pos, content, title). Narrow: no shuffle."""
    from guardrag.operators.chunking import chunk_id, document_id

    own = docs.select(document_id(title_col, content_col, id_col).alias("document_id"), F.col(title_col).cast("string").alias("title"), F.col(content_col).alias("_text"))
    table = chunk_table()(F.col("_text").outer(), F.lit(opts.separator), F.lit(opts.max_chunk_length), F.lit(opts.overlap))
    joined = own.lateralJoin(table)
    return joined.select(chunk_id().alias("chunk_id"), "document_id", "pos", "content", "title")
