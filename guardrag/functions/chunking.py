"""Paragraph chunking (T1a, T1b): an Arrow function, one linear pass per document.

A document is chunked wherever it lives, with no shuffle. The fold copies each
character a bounded number of times, so time grows with the text, also for documents of many
megabytes (built-in array functions copy their array for every chunk). Lengths count
UTF-16 units: a character outside the basic plane counts two.

Rules reproduced exactly:
* a paragraph is never split; the size test ignores the appended newline;
* a buffer is emitted when ``len(cur) + len(p) > max_len`` and ``cur`` is non-empty;
* after an emit the last ``overlap`` characters (newline included) are carried,
  only when the emitted buffer is longer than ``overlap``; the carry plus the next
  paragraph is not re-tested;
* every paragraph is followed by ``\\n``; a non-empty buffer is flushed at the end.
"""

from __future__ import annotations

from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from guardrag.config import ChunkingOptions
from guardrag.functions.text import col_, literal_split_regex


def split_paragraphs(text: Column | str, separator: str = "\n\n") -> Column:
    """Split on a literal separator and drop zero-length pieces (no trimming)."""
    pieces = F.split(col_(text), literal_split_regex(separator), -1)
    return F.filter(pieces, lambda p: F.length(p) > 0)


def utf16_units(text: str) -> int:
    return len(text) if text.isascii() else len(text.encode("utf-16-le", "surrogatepass")) >> 1


def last_units(text: str, n: int) -> str:
    """The last ``n`` UTF-16 units of a text; half of a character that is cut in two becomes U+FFFD."""
    tail = text[-n:] if n else ""
    if utf16_units(tail) == len(tail):
        return tail
    units, at = 0, len(tail)
    while at and units < n:
        at -= 1
        units += 2 if tail[at] > "\uffff" else 1
    return ("\ufffd" + tail[at + 1:]) if units > n else tail[at:]


def pack_paragraphs(paragraphs: list[str], max_len: int, overlap: int) -> list[str]:
    """The fold over one document's paragraphs: one pass, each character copied a bounded number of times."""
    out: list[str] = []
    parts: list[str] = []
    size = 0
    for p in paragraphs:
        units = utf16_units(p)
        if size and size + units > max_len:
            chunk = "".join(parts)
            out.append(chunk)
            parts = [last_units(chunk, overlap)] if size > overlap else []
            size = overlap if size > overlap else 0
        parts += (p, "\n")
        size += units + 1
    if parts:
        out.append("".join(parts))
    return out


#: Bytes of a batch's texts that are Python strings at once (one huge text counts as it is).
SLICE_BYTES = 1 << 20


def _by_slices(values: pa.Array, fold) -> pa.Array:
    """``fold`` of every value, a bounded slice after the other: texts as Python strings take several times their bytes, and so do their chunks."""
    rows = max(1, len(values) * SLICE_BYTES // max(1, values.get_total_buffer_size()))
    parts = [pa.array([fold(v) for v in values.slice(s, rows).to_pylist()], pa.list_(pa.string())) for s in range(0, len(values), rows)]
    return pa.concat_arrays(parts) if parts else pa.array([], pa.list_(pa.string()))


@lru_cache(maxsize=None)
def _packer(max_len: int, overlap: int):
    @F.arrow_udf("array<string>")
    def pack(paragraphs: pa.Array) -> pa.Array:
        return _by_slices(paragraphs, lambda ps: None if ps is None else pack_paragraphs(ps, max_len, overlap))

    return pack


@lru_cache(maxsize=None)
def _chunker(separator: str, max_len: int, overlap: int):
    @F.arrow_udf("array<string>")
    def chunk(texts: pa.Array) -> pa.Array:
        return _by_slices(texts, lambda t: pack_paragraphs([p for p in (t.split(separator) if separator else [t]) if p], max_len, overlap) if t else [])

    return chunk


def pack_chunks(paragraphs: Column, max_len: int = 500, overlap: int = 50) -> Column:
    """Greedy ordered packing of paragraphs into chunk strings (array<string>), lengths in UTF-16 units."""
    return _packer(max_len, overlap)(paragraphs)


def chunk_text(text: Column | str, opts: ChunkingOptions = ChunkingOptions()) -> Column:
    """T1a + T1b: text → array of chunk strings. Null text → empty array."""
    return _chunker(opts.separator, opts.max_chunk_length, opts.overlap)(col_(text))
