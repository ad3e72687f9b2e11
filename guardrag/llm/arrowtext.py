"""Text columns as flat byte arrays: helpers shared by the Arrow functions of this package.

Everything here works on one Arrow batch at a time and looks at whole texts. A text
column becomes one ``uint8`` array plus row offsets; spans (words, k-grams) are
hashed for a whole batch at once with a prefix sum, so no Python loop runs per byte
or per word.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Multiplier of the span hash (odd, so it has an inverse modulo 2**64).
_BASE = 0x9E3779B97F4A7C15
_U = np.uint64
_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}
_BYTE_CODES = np.random.default_rng(20240229).integers(1, 2**63, 256, dtype=np.uint64) | _U(1)

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string or binary array; null is the empty text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null(b"" if pa.types.is_binary(column.type) or pa.types.is_large_binary(column.type) else "")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offs, data = column.buffers()
    offsets = np.frombuffer(offs, dtype=np.int64 if wide else np.int32)[column.offset:column.offset + len(column) + 1].astype(np.int64) \
        if len(column) else np.zeros(1, np.int64)
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[offsets[0]:offsets[-1]], offsets - offsets[0]


def pieces(batches: Iterator[pa.RecordBatch], text_col: str, max_bytes: int = 1 << 21) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Cut batches into slices of about ``max_bytes`` of text (always whole rows); bounds the scratch arrays."""
    for batch in batches:
        if not batch.num_rows:
            continue
        data, offsets = text_bytes(batch.column(batch.schema.get_field_index(text_col)))
        at = 0
        while at < batch.num_rows:
            end = int(np.searchsorted(offsets, offsets[at] + max_bytes, side="right")) - 1
            end = min(max(end, at + 1), batch.num_rows)
            yield batch.slice(at, end - at), data[offsets[at]:offsets[end]], offsets[at:end + 1] - offsets[at]
            at = end


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """base**i and base**-i modulo 2**64 for i < n (cached, grown by doubling)."""
    size = 1 << max(16, int(n).bit_length())
    if size not in _powers:
        steps = np.full((2, size), _BASE, dtype=np.uint64)
        steps[1] = pow(_BASE, -1, 2**64)
        steps[:, 0] = 1
        up, down = np.cumprod(steps, axis=1, dtype=np.uint64)
        _powers.clear()
        _powers[size] = up, down
    return _powers[size]


def mix(h: np.ndarray) -> np.ndarray:
    """Finaliser of a 64-bit hash (xor-shift and multiply)."""
    h = h ^ (h >> _U(30))
    h *= _U(0xBF58476D1CE4E5B9)
    h ^= h >> _U(27)
    h *= _U(0x94D049BB133111EB)
    h ^= h >> _U(31)
    return h


def prefix_sums(data: np.ndarray) -> np.ndarray:
    """Running sum of code(byte) * base**-position; a span's hash is a difference, shifted back to position 0."""
    _, down = powers(len(data) + 1)
    out = np.zeros(len(data) + 1, dtype=np.uint64)
    np.cumsum(_BYTE_CODES[data] * down[:len(data)], out=out[1:])
    return out


def span_hashes(sums: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    up, _ = powers(len(sums))
    return mix((sums[ends] - sums[starts]) * up[starts])


def kgram_hashes(data: np.ndarray, k: int, step: int = 1 << 16) -> np.ndarray:
    """64-bit hash of the k bytes at every position 0 .. n-k (empty if n < k), in cache-sized steps."""
    n = len(data) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = np.empty(n, np.uint64)
    up, _ = powers(step + k + 1)
    for s in range(0, n, step):
        m = min(step, n - s)
        sums = prefix_sums(data[s:s + m + k - 1])
        out[s:s + m] = mix((sums[k:] - sums[:-k]) * up[:m])
    return out


def word_spans(data: np.ndarray, offsets: np.ndarray, is_word: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Maximal runs of word bytes that do not cross rows: (starts, ends, first word of each row, n_rows + 1 entries)."""
    inside = is_word[data]
    first, last = inside.copy(), inside.copy()
    first[1:] &= ~inside[:-1]
    last[:-1] &= ~inside[1:]
    edges = offsets[1:-1]
    edges = edges[(edges > 0) & (edges < len(data))]
    first[edges] = inside[edges]
    last[edges - 1] = inside[edges - 1]
    starts = np.flatnonzero(first)
    return starts, np.flatnonzero(last) + 1, np.searchsorted(starts, offsets)


def sliding_min(values: np.ndarray, width: int) -> np.ndarray:
    """Minimum of every ``width`` consecutive values, by doubling."""
    out, have = values, 1
    while have * 2 <= width:
        out = np.minimum(out[:-have], out[have:])
        have *= 2
    if width > have:
        out = np.minimum(out[:-(width - have)], out[width - have:])
    return out


def ranges(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Concatenation of arange(start, start + length) over all pairs."""
    total = int(lengths.sum())
    if not total:
        return np.zeros(0, np.int64)
    ends = np.cumsum(lengths)
    return np.arange(total, dtype=np.int64) + np.repeat(starts - (ends - lengths), lengths)
