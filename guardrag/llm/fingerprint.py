"""Document fingerprints from prefix polynomial hashes.

For a text's bytes two modular prefix arrays are kept (modulo the primes 2**31 - 1 and
2**31 - 19, with fixed bases). Any span's hash pair is a difference of two prefix entries, brought to
position 0, so span equality is one comparison and the longest common extension of two
positions is a binary search over lengths.

The fingerprint of a text is the hash of the whole text (16 hex digits) followed by the ``size`` smallest of the
distinct hashes of its spans of ``span`` bytes, 8 digits each with the top bit set. Texts under 8 * ``span`` bytes also hold the ``size`` smallest
of their spans of ``span`` / 6 bytes (a shorter text is one span), top bit clear, and texts under 2 * ``span`` bytes hold only these. Likeness of two
fingerprints is the share of common values among the ``size`` smallest of their union, an estimate of the Jaccard likeness of the span
sets: of the long spans if both have some, else of the short ones (0 if one has none). It is 1 for equal texts. Two empty texts are alike, an empty
and another text are not.

``edited_pairs`` gives each document's text an edit that borrows from the next document in
descending key order. Documents are dealt into key ranges, and the first document of a range is
also sent to the range before it, so no task sees more than one range and the text is
shuffled once. A key (or null) that many rows share has several ranges, by text digest; rows that are equal in both stay together.

Edge cases: null text is empty; null keys come last; repeated keys are ordered by text hash;
an empty table gives no rows; a single document is its own next.
"""

from __future__ import annotations

import hashlib
import math
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SPAN = 24
SIZE = 48
#: Marks the hash of a long span.
LONG = np.uint32(1 << 31)
MAX_RANGES = 1_000_000
PRIMES = ((1 << 31) - 1, (1 << 31) - 19)
BASES = (1_000_003, 911_382_323)
_U = np.uint64
_tables: dict[int, list[tuple[np.ndarray, np.ndarray]]] = {}


def _powers(n: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each prime: base**i and base**-i, i < n (cached, grown by doubling)."""
    size = 1 << max(12, int(n).bit_length())
    if size not in _tables:
        made = []
        for p, base in zip(PRIMES, BASES):
            both = []
            for b in (base, pow(base, -1, p)):
                out = np.ones(1, dtype=np.uint64)
                while len(out) < size:
                    out = np.concatenate((out, out * _U(pow(b, len(out), p)) % _U(p)))
                both.append(out)
            made.append(tuple(both))
        _tables.clear()
        _tables[size] = made
    return _tables[size]


class PrefixHash:
    """Prefix arrays of one byte sequence."""

    def __init__(self, data: np.ndarray):
        self.n = len(data)
        codes = data.astype(np.uint64) + _U(1)
        self.sums, self.down = [], []
        for p, (up, down) in zip(PRIMES, _powers(self.n + 1)):
            sums = np.zeros(self.n + 1, dtype=np.uint64)
            np.cumsum(codes * up[:self.n] % _U(p), out=sums[1:])
            self.sums.append(sums % _U(p))
            self.down.append(down)

    def span(self, start, length) -> np.ndarray:
        """62-bit hash of span(s) [start, start + length); equal spans have equal hashes."""
        start, end = np.asarray(start), np.asarray(start) + np.asarray(length)
        parts = [(s[end] + _U(p) - s[start]) % _U(p) * d[start] % _U(p) for p, s, d in zip(PRIMES, self.sums, self.down)]
        return parts[0] << _U(31) | parts[1]

    def equal(self, i: int, other: PrefixHash, j: int, length: int) -> bool:
        return bool(self.span(i, length) == other.span(j, length))

    def common_extension(self, i: int, other: PrefixHash, j: int) -> int:
        """Length of the longest common extension of position i here and j there, by binary search."""
        return bisect_left(range(min(self.n - i, other.n - j)), 1, key=lambda m: int(not self.equal(i, other, j, m + 1)))


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> _U(31))) * _U(0x7FB5D329728EA185)
    h = (h ^ (h >> _U(27))) * _U(0x81DADEF4BC2DD44D)
    return h ^ (h >> _U(33))


def sketch(text: bytes, span: int = SPAN, size: int = SIZE) -> tuple[str, np.ndarray]:
    """(fingerprint, its sorted span values as uint32)."""
    return _sketch(text, span, size)[:2]


def _sketch(text: bytes, span: int, size: int) -> tuple[str, np.ndarray, PrefixHash]:
    data = np.frombuffer(text, dtype=np.uint8)
    hashes = PrefixHash(data)
    whole = int(hashes.span(0, hashes.n)) if hashes.n else 0
    values = [np.zeros(0, np.uint32)]
    if 0 < hashes.n < 8 * span:
        values.append(_smallest(hashes, min(max(1, span // 6), hashes.n), size))
    if hashes.n >= 2 * span:
        values.append(_smallest(hashes, span, size) | LONG)
    both = np.concatenate(values)
    return f"{whole:016x}" + both.astype(">u4").tobytes().hex(), both, hashes


def _smallest(hashes: PrefixHash, width: int, size: int) -> np.ndarray:
    spans = (_mix(hashes.span(np.arange(hashes.n - width + 1), width)) >> _U(33)).astype(np.uint32)
    # Nearly all values exceed the wanted smallest ones: cut before sorting, then check that enough are left.
    values = np.unique(spans[spans <= min(2**31 - 1, (4 * size << 31) // len(spans))])
    return (values if len(values) >= size else np.unique(spans))[:size]


def likeness(a: str, b: str, size: int = SIZE) -> float:
    """Likeness of two fingerprints, 0 to 1."""
    if a[:16] == b[:16]:
        return 1.0
    return _overlap(*(np.frombuffer(bytes.fromhex(x[16:]), dtype=">u4").astype(np.uint32) for x in (a, b)), size)


def _overlap(a: np.ndarray, b: np.ndarray, size: int = SIZE) -> float:
    if not len(a) or not len(b):
        return float(len(a) == len(b))
    # Short spans stand first, long ones behind.
    at, bt = np.searchsorted(a, LONG), np.searchsorted(b, LONG)
    a, b = (a[at:], b[bt:]) if at < len(a) and bt < len(b) else (a[:at], b[:bt])
    if not len(a) or not len(b):
        return 0.0
    both = np.union1d(a, b)[:size]
    return float(np.isin(both, a, assume_unique=True)[np.isin(both, b, assume_unique=True)].sum()) / len(both)


def edit(text: str, following: str) -> str:
    """The last floor(n/3) code points replaced by the first as many (or all) of the following text."""
    cut = len(text) // 3
    return text[:len(text) - cut] + following[:cut]


def fingerprints(docs: DataFrame, key_col: str = "doc_id", text_col: str = "text", span: int = SPAN, size: int = SIZE) -> DataFrame:
    """(key, fingerprint) of every document, in place."""
    kind = docs.schema[key_col].dataType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            prints = [sketch((t or "").encode(), span, size)[0] for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(prints, pa.string())], names=[key_col, "fingerprint"])

    return docs.select(f"`{key_col}`", f"`{text_col}`").mapInArrow(run, f"`{key_col}` {kind.simpleString()}, fingerprint string")


class KeyRanges:
    """Ranges of (descending key, text digest), numbered in that order: between the cuts, and over the digests of a key that several cuts fall on."""

    def __init__(self, cuts: np.ndarray, null_parts: int):
        self.cuts, self.parts = np.unique(cuts, return_counts=True)
        self.parts[self.parts < 2] = 0  # how many ranges a key has to itself
        q, at = len(self.cuts), 0
        self.between, self.own = np.zeros(q + 1, np.int64), np.zeros(q, np.int64)
        for i in range(q, -1, -1):
            self.between[i], at = at, at + 1
            if i:
                self.own[i - 1], at = at, at + self.parts[i - 1]
        self.null, self.null_parts = at, max(1, null_parts)

    def number(self, keys: pa.Array, digests: pa.Array) -> np.ndarray:
        """The range of each row; keys stay 64-bit integers, whether or not there are nulls among them."""
        absent = keys.is_null().to_numpy(zero_copy_only=False)
        values = keys.fill_null(0).to_numpy().astype(np.int64)
        share = np.array([int(d[:8], 16) for d in digests.to_pylist()], dtype=np.int64)
        i = np.searchsorted(self.cuts, values, side="right")
        out = self.between[i]
        if len(self.cuts):
            before = np.maximum(i - 1, 0)
            hot = (i > 0) & (self.cuts[before] == values) & (self.parts[before] > 0)
            out = np.where(hot, self.own[before] + (share * self.parts[before] >> 32), out)
        return np.where(absent, self.null + (share * self.null_parts >> 32), out)


def edited_pairs(docs: DataFrame, key_col: str = "doc_id", text_col: str = "text", range_bytes: int = 2 << 20,
                 span: int = SPAN, size: int = SIZE) -> DataFrame:
    """Per document: key, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next, common_bytes (the longest
    common extension of the starts of the text and its edited text)."""
    spark = docs.sparkSession
    text = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    docs = docs.select(F.col(f"`{key_col}`").cast("long").alias("key"), text.alias("text"), F.md5(text).alias("digest"))
    size_of = docs.agg(F.sum(F.octet_length("text") + 64).alias("b"), F.count("key").alias("n"), F.count("*").alias("rows")).first()
    n_ranges = min(MAX_RANGES, max(1, math.ceil((size_of["b"] or 0) / range_bytes)))
    cuts = np.zeros(0, np.int64)
    if n_ranges > 1 and size_of["n"]:
        shares = [i / n_ranges for i in range(1, n_ranges)]
        cuts = np.array(docs.agg(F.percentile_approx("key", shares, max(10_000, 4 * n_ranges))).first()[0], np.int64)
    plan = spark.sparkContext.broadcast(KeyRanges(cuts, math.ceil(n_ranges * (size_of["rows"] - size_of["n"]) / max(1, size_of["rows"]))))  # at most MAX_RANGES numbers

    @F.arrow_udf("int")
    def range_of(keys: pa.Array, digests: pa.Array) -> pa.Array:
        return pa.array(plan.value.number(keys, digests), pa.int32())

    placed = docs.withColumn("part", range_of("key", "digest"))
    # The first document of a range is the one with the largest key, then the smallest digest; null keys come last.
    tops = placed.groupBy("part").agg(F.max("key").alias("top"), F.min(F.struct(-F.col("key").cast("decimal(20,0)"), F.col("digest").alias("d"))).alias("first"))
    tops = sorted(((r["part"], r["top"], r["first"]["d"]) for r in tops.collect()), key=lambda r: r[0])  # one row per range
    # It is sent to the range before it too; that of the first range to the last.
    before = spark.createDataFrame([(part, top, d, tops[i - 1][0]) for i, (part, top, d) in enumerate(tops)], "part int, top long, top_digest string, before int")
    is_top = F.col("key").eqNullSafe(F.col("top")) & (F.col("digest") == F.col("top_digest"))
    sent = F.when(is_top, F.array(F.struct(F.lit(0).alias("head"), "part"), F.struct(F.lit(1).alias("head"), F.col("before").alias("part")))).otherwise(F.array(F.struct(F.lit(0).alias("head"), "part")))
    dealt = placed.join(F.broadcast(before), "part").select("key", "text", "digest", F.explode(sent).alias("to")).select("key", "text", "digest", "to.head", "to.part")

    def run(table: pa.Table) -> pa.Table:
        keys = table.column("key").to_pylist()
        texts = table.column("text").to_pylist()
        heads_ = table.column("head").to_pylist()
        digest = table.column("digest").to_pylist()
        rank = sorted(range(len(keys)), key=lambda i: (heads_[i], keys[i] is None, -(keys[i] or 0), digest[i]))
        own = [i for i in rank if not heads_[i]]
        after = own[1:] + [i for i in rank if heads_[i]][:1]
        done: dict[int, tuple[str, np.ndarray, PrefixHash]] = {}
        out: list[tuple] = []
        for i, j in zip(own, after):
            for x in (i, j):
                if x not in done:
                    done[x] = _sketch(texts[x].encode(), span, size)
            changed = edit(texts[i], texts[j]).encode()
            mine, other, new = done.pop(i), done[j] if j != i else None, _sketch(changed, span, size)
            other = other or mine
            out.append((keys[i], len(texts[i]), hashlib.sha256(changed).hexdigest(), mine[0], new[0],
                        1.0 if mine[0][:16] == new[0][:16] else _overlap(mine[1], new[1], size),
                        1.0 if mine[0][:16] == other[0][:16] else _overlap(mine[1], other[1], size), mine[2].common_extension(0, new[2], 0)))
        columns = list(zip(*out)) if out else [[]] * 8
        kinds = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64(), pa.int64())
        return pa.table([pa.array(c, t) for c, t in zip(columns, kinds)],
                        names=[key_col, "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next", "common_bytes"])

    return dealt.groupBy("part").applyInArrow(run, _RESULT.format(key=key_col))


_RESULT = ("`{key}` long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, "
           "near_edited double, near_next double, common_bytes long")
