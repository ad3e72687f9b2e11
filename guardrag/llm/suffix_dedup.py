"""Exact removal of repeated byte strings with suffix arrays built by two-stage sorting.

Every text is its UTF-8 bytes. A window is a string of ``length`` consecutive bytes of one
document. A byte is removed when some window over it also starts in a document with a smaller key.

How the corpus is cut into tasks. Each window has one anchor: the 16 bytes with the smallest hash inside it
(leftmost of equals). Equal windows have equal anchors, so windows can be dealt by the anchor's
hash. The windows of one anchor occurrence are consecutive; their union is a segment of 50 to
84 bytes.

1. Blocks of documents send the hashes of their anchors (4 bytes each, distinct per block) to hash buckets.
   A bucket answers which ones occur in several blocks (one bit each).
2. Blocks send the distinct segments of shared anchors to the buckets, each with the smallest key it has in the block.
   A bucket builds the suffix array of its segments: suffixes smaller than their successor are sorted
   directly, the others are induced by scanning the first-byte buckets upwards. Adjacent common
   prefixes of at least ``length`` bytes join windows to classes; the smallest key of a class
   decides. The answer is one bit per window: a smaller key than the block's own has it.
3. Blocks mark windows, join their bytes to runs and cut these out.

Anchors only decide what is worth sorting and where; a hash collision costs time, never a wrong byte.

Scale: the text is shuffled once (the block exchange is reused by all three steps); a passage that
every document holds is sent once per block, not once per document, so no task grows with it. Task memory is a
block or a bucket, both of ``block_bytes`` order.

Edge cases: null text is empty; texts shorter than ``length`` are kept whole; documents with equal keys are the same
document as far as "smaller" goes and keep each other's bytes; null keys count as smaller than all others; an empty
table gives no rows; other columns are passed through.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from guardrag.llm.arrowtext import kgram_hashes, prefix_sums, ranges, sliding_min, span_hashes, text_bytes
from guardrag.llm.columns import put_back, set_aside

LENGTH = 50
ANCHOR = 16
BLOCK_BYTES = (4 << 20, 256 << 20)
MAX_BLOCKS = 400_000
_U = np.uint64
_STEP = 1 << 18


class Segments:
    """Anchors and segments of a block of documents; the same for the same set of rows in any order."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, keys: np.ndarray, buckets: int, length: int):
        self.data, self.offsets, self.keys, self.buckets, self.length = data, offsets, keys, buckets, length
        self._runs()
        low = self.anchor & _U((1 << 48) - 1)
        self.bucket = (low % _U(buckets)).astype(np.int64)
        value = (low // _U(buckets)).astype(np.uint32)
        self.ids, self.id_of = np.unique((self.bucket.astype(np.uint64) << _U(32)) | value, return_inverse=True)
        self.id_bucket = (self.ids >> _U(32)).astype(np.int64)

    def _runs(self) -> None:
        """Maximal runs of windows with one anchor: first window, end, anchor hash, document."""
        n, span = len(self.data), self.length - ANCHOR + 1
        total = max(0, n - self.length + 1)
        starts, owners, hashes = [], [], []
        room = np.repeat(self.offsets[1:], np.diff(self.offsets))  # end of the document at each byte
        for s in range(0, total, _STEP):
            m = min(_STEP, total - s)
            h = kgram_hashes(self.data[s:s + m + self.length - 1], ANCHOR)
            key = (h & ~_U(0xFFFFFFFF)) | np.arange(len(h), dtype=np.uint64)
            at = (sliding_min(key, span) & _U(0xFFFFFFFF)).astype(np.int64)
            owner = np.where(np.arange(s, s + m) + self.length <= room[s:s + m], at + s, -1)
            change = np.flatnonzero(np.concatenate(([True], owner[1:] != owner[:-1])))
            starts.append(change + s)
            owners.append(owner[change])
            hashes.append(h[at[change]])
        if not starts:
            self.first = self.end = self.doc = np.zeros(0, np.int64)
            self.anchor = np.zeros(0, np.uint64)
            return
        start, owner, anchor = (np.concatenate(x) for x in (starts, owners, hashes))
        new = np.concatenate(([True], owner[1:] != owner[:-1]))
        start, owner, anchor = start[new], owner[new], anchor[new]
        end = np.append(start[1:], total)
        real = owner >= 0
        self.first, self.end, self.anchor = start[real], end[real], anchor[real]
        self.doc = np.searchsorted(self.offsets, self.first, side="right") - 1

    def bucket_cuts(self, bucket: np.ndarray) -> list[tuple[int, int, int]]:
        """(bucket, from, to) over an array sorted by bucket."""
        cut = np.flatnonzero(np.concatenate(([True], bucket[1:] != bucket[:-1]))) if len(bucket) else np.zeros(0, np.int64)
        return list(zip(bucket[cut].tolist(), cut.tolist(), [*cut[1:].tolist(), len(bucket)]))

    def choose(self, bits: dict[int, bytes]) -> None:
        """Keep runs whose anchor occurs in several documents; number their distinct segments in bucket order."""
        shared = np.zeros(len(self.ids), dtype=bool)
        for b, lo, hi in self.bucket_cuts(self.id_bucket):
            if b in bits:
                shared[lo:hi] = np.unpackbits(np.frombuffer(bits[b], dtype=np.uint8), count=hi - lo).astype(bool)
        if len(self.first):
            low, high = np.full(len(self.ids), len(self.offsets)), np.full(len(self.ids), -1)
            np.minimum.at(low, self.id_of, self.doc)
            np.maximum.at(high, self.id_of, self.doc)
            shared |= low != high
        run = np.flatnonzero(shared[self.id_of]) if len(self.first) else np.zeros(0, np.int64)
        self.first, self.end, self.doc, bucket, anchor = self.first[run], self.end[run], self.doc[run], self.bucket[run], self.anchor[run]
        text = span_hashes(prefix_sums(self.data), self.first, self.end + self.length - 1)
        order = np.lexsort((text, anchor, bucket))
        same = np.zeros(len(order), dtype=bool)
        if len(order):
            same[1:] = (text[order][1:] == text[order][:-1]) & (anchor[order][1:] == anchor[order][:-1]) & (bucket[order][1:] == bucket[order][:-1])
        self.segment = np.empty(len(order), dtype=np.int64)
        self.segment[order] = np.cumsum(~same) - 1
        self.sample = order[~same]  # one run of each segment
        self.segment_bucket = bucket[self.sample]
        self.segment_key = np.minimum.reduceat(self.keys[self.doc[order]], np.flatnonzero(~same)) if len(order) else np.zeros(0, np.int64)
        self.windows = (self.end - self.first)[self.sample]


def direct_sort(text: np.ndarray, at: np.ndarray, depth: int) -> np.ndarray:
    """Positions sorted by the ``depth`` bytes that follow (rounded up to words of 8); ties keep any order."""
    words = np.ndarray(shape=(len(text) - 7,), dtype=">u8", buffer=text, strides=(1,))
    order = at[np.argsort(words[at].astype(np.uint64), kind="stable")]
    new = np.ones(len(order), dtype=bool)
    w = words[order]
    new[1:] = w[1:] != w[:-1]
    for d in range(8, depth, 8):
        group = np.cumsum(new)
        tied = np.flatnonzero(~new | np.append(~new[1:], False))
        if not len(tied):
            break
        w = words[order[tied] + d].astype(np.uint64)
        by = np.lexsort((w, group[tied]))
        order[tied], w, g = order[tied[by]], w[by], group[tied][by]
        new[tied[1:]] |= (w[1:] != w[:-1]) & (g[1:] == g[:-1])
    return order


def smaller_than_successor(text: np.ndarray) -> np.ndarray:
    """Type of every suffix; equal neighbours have the type of the next unequal pair to their right, the end counts as smaller."""
    step = np.zeros(len(text), dtype=np.int8)
    step[:-1] = np.sign(text[1:].astype(np.int16) - text[:-1].astype(np.int16))
    step[-1] = 1
    where = np.where(step != 0, np.arange(len(text)), len(text) - 1)
    return step[np.minimum.accumulate(where[::-1])[::-1]] > 0


def suffix_array(text: np.ndarray, needed: np.ndarray, depth: int) -> np.ndarray:
    """Two-stage sorting of the ``needed`` suffixes by at least ``depth`` bytes.

    ``text`` ends with ``depth`` + 8 padding bytes. ``needed`` must hold, with each suffix larger than its
    successor, that successor too.
    """
    smaller = smaller_than_successor(text)
    direct = np.flatnonzero(needed & smaller)
    direct = direct_sort(text, direct, depth) if len(direct) else direct
    induced = needed & ~smaller
    first = text[direct]
    order = np.argsort(first, kind="stable")  # already grouped: the sort key begins with this byte
    cuts = np.searchsorted(first[order], np.arange(257))
    waiting: list[list[np.ndarray]] = [[] for _ in range(256)]
    # Suffixes whose successor is not needed cannot be induced; there are none but at the padded end.
    out = []
    for c in range(256):
        part = np.concatenate(waiting[c]) if waiting[c] else np.zeros(0, np.int64)
        parts = [part]
        while len(part):  # predecessors with the same first byte follow in waves
            before = part[part > 0] - 1
            part = before[induced[before] & (text[before] == c)]
            parts.append(part)
        bucket = np.concatenate([*parts, direct[order[cuts[c]:cuts[c + 1]]]])
        waiting[c] = []
        if len(bucket):
            out.append(bucket)
            before = bucket[bucket > 0] - 1
            before = before[induced[before] & (text[before] > c)]
            byte = text[before]
            by = np.argsort(byte, kind="stable")
            before, byte = before[by], byte[by]
            cut = np.flatnonzero(np.concatenate(([True], byte[1:] != byte[:-1]))) if len(byte) else np.zeros(0, np.int64)
            for lo, hi in zip(cut.tolist(), [*cut[1:].tolist(), len(byte)]):
                waiting[int(byte[lo])].append(before[lo:hi])
    return np.concatenate(out) if out else np.zeros(0, np.int64)


def common_prefixes(text: np.ndarray, order: np.ndarray, length: int) -> np.ndarray:
    """Bytes (up to ``length``, in steps of 8) that each suffix of ``order`` shares with the one before it."""
    words = np.ndarray(shape=(len(text) - 7,), dtype=">u8", buffer=text, strides=(1,))
    out = np.zeros(len(order), dtype=np.int32)
    alive = np.arange(1, len(order))
    for d in [*range(0, length - 7, 8), *([length - 8] if length % 8 else [])]:
        alive = alive[words[order[alive] + d] == words[order[alive - 1] + d]]
        out[alive] = min(d + 8, length)
    return out


def window_minima(segments: list[bytes], keys: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """(smallest key of each window's class, first window of each segment) for distinct segments."""
    sizes = np.array([len(s) for s in segments], dtype=np.int64)
    depth = -(-length // 8) * 8
    text = np.frombuffer(b"".join(segments) + bytes(2 * depth + 16), dtype=np.uint8)
    starts = np.concatenate(([0], np.cumsum(sizes)))[:-1]
    counts = sizes - length + 1
    first = np.concatenate(([0], np.cumsum(counts)))
    # Windows, and what follows each segment's last window up to a suffix that is sorted directly.
    smaller = smaller_than_successor(text)
    after = np.where(smaller, np.arange(len(text)), len(text) - 1)
    after = np.minimum.accumulate(after[::-1])[::-1]
    stop = after[starts + counts - 1] + 1
    edge = np.zeros(len(text) + 1, dtype=np.int32)
    np.add.at(edge, starts, 1)
    np.add.at(edge, stop, -1)
    needed = np.cumsum(edge[:-1]) > 0
    window = ranges(starts, counts)
    number = np.full(len(text), -1, dtype=np.int64)
    number[window] = np.arange(len(window))
    order = suffix_array(text, needed, depth)
    order = order[number[order] >= 0]
    if len(order) != len(window):
        raise AssertionError("a window was not sorted")
    classes = np.flatnonzero(common_prefixes(text, order, length) < length)
    own = np.repeat(keys, counts)[number[order]]
    least = np.minimum.reduceat(own, classes) if len(classes) else own
    out = np.empty(len(window), dtype=np.int64)
    out[number[order]] = np.repeat(least, np.diff(np.append(classes, len(order))))
    return out, first


_RESULTS = ("__bytes", "__removed", "__spans", "__kept")
_BLOB = "bucket long, block long, kind int, body binary"


def _blobs(rows: list[tuple[int, int, int, bytes]]) -> pa.Table:
    columns = list(zip(*rows)) if rows else [[]] * 4
    return pa.table([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int64(), pa.int32(), pa.binary()))], names=["bucket", "block", "kind", "body"])


def _bits_of(table: pa.Table, kind: int) -> dict[int, bytes]:
    return {b: body for b, k, body in zip(table.column("bucket").to_pylist(), table.column("kind").to_pylist(), table.column("body").to_pylist()) if k == kind}


def remove_repeats(docs: DataFrame, key_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, whole_characters: bool = False) -> DataFrame:
    """``docs`` without the text, with __bytes, __removed, __spans (removed runs) and __kept (binary, what is left) added.

    Columns of the input named like these are replaced. ``whole_characters`` keeps every byte of a code point that is not removed as a whole, so the rest is valid UTF-8.
    """
    if length < ANCHOR + 8:
        raise ValueError(f"length must be at least {ANCHOR + 8}")
    given = docs.columns
    docs, names = set_aside(docs, (*_RESULTS, "__key", "__text", "__block"))
    key_col, text_col = names.get(key_col, key_col), names.get(text_col, text_col)
    total = docs.agg(F.sum(F.octet_length(F.col(f"`{text_col}`")) + 64)).first()[0] or 0
    block_bytes = min(max(BLOCK_BYTES[0], total // MAX_BLOCKS), BLOCK_BYTES[1])
    blocks = max(1, math.ceil(total / block_bytes))
    others = [c for c in docs.columns if c != text_col]
    dealt = docs.select(*[F.col(f"`{c}`") for c in others],
                        F.coalesce(F.col(f"`{key_col}`").cast("long"), F.lit(-2**63)).alias("__key"),
                        F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("__text"),
                        F.pmod(F.xxhash64(F.col(f"`{key_col}`"), F.col(f"`{text_col}`")), F.lit(blocks)).alias("__block"))
    dealt = dealt.repartition("__block")

    def read(table: pa.Table) -> tuple[Segments, int]:
        data, offsets = text_bytes(table.column("__text"))
        return Segments(data, offsets, table.column("__key").to_numpy(), blocks, length), table.column("__block")[0].as_py()

    def anchors(table: pa.Table) -> pa.Table:
        s, block = read(table)
        values = (s.ids & _U(0xFFFFFFFF)).astype(np.uint32)
        return _blobs([(b, block, 0, values[lo:hi].tobytes()) for b, lo, hi in s.bucket_cuts(s.id_bucket)])

    def shared(table: pa.Table) -> pa.Table:
        lists = [np.frombuffer(x, dtype=np.uint32) for x in table.column("body").to_pylist()]
        values, counts = np.unique(np.concatenate(lists), return_counts=True)
        repeated = values[counts > 1]
        rows = []
        for bucket, block, own in zip(table.column("bucket").to_pylist(), table.column("block").to_pylist(), lists):
            bits = np.isin(own, repeated, assume_unique=True)
            if bits.any():
                rows.append((bucket, block, 0, np.packbits(bits).tobytes()))
        return _blobs(rows)

    def segments(table: pa.Table, answers: pa.Table) -> pa.Table:
        if not table.num_rows:
            return _blobs([])
        s, block = read(table)
        s.choose(_bits_of(answers, 0))
        raw, begin, end = s.data.tobytes(), s.first[s.sample].tolist(), (s.end[s.sample] + length - 1).tolist()
        rows = []
        for b, lo, hi in s.bucket_cuts(s.segment_bucket):
            sizes = np.array([end[i] - begin[i] for i in range(lo, hi)], dtype=np.int32)
            rows.append((b, block, 1, np.int32(hi - lo).tobytes() + sizes.tobytes() + s.segment_key[lo:hi].tobytes()
                         + b"".join(raw[begin[i]:end[i]] for i in range(lo, hi))))
        return _blobs(rows)

    def sort(table: pa.Table) -> pa.Table:
        requests, texts, keys = [], [], []
        for bucket, block, body in zip(table.column("bucket").to_pylist(), table.column("block").to_pylist(), table.column("body").to_pylist()):
            n = int(np.frombuffer(body, np.int32, 1)[0])
            cut = np.concatenate(([0], np.cumsum(np.frombuffer(body, np.int32, n, 4)))) + 4 + 12 * n
            requests.append((bucket, block, n))
            keys.append(np.frombuffer(body, np.int64, n, 4 + 4 * n))
            texts.append(pa.Array.from_buffers(pa.binary(), n, [None, pa.py_buffer(cut.astype(np.int32).tobytes()), pa.py_buffer(body)]))
        own = np.concatenate(keys)
        coded = pa.chunked_array(texts).combine_chunks().dictionary_encode()
        number = coded.indices.to_numpy()
        least = np.full(len(coded.dictionary), 2**63 - 1, dtype=np.int64)
        np.minimum.at(least, number, own)
        minima, first = window_minima(coded.dictionary.to_pylist(), least, length)
        rows, at = [], 0
        for bucket, block, n in requests:
            which = number[at:at + n]
            counts = first[which + 1] - first[which]
            bits = minima[ranges(first[which], counts)] < np.repeat(own[at:at + n], counts)
            at += n
            rows.append((bucket, block, 1, np.packbits(bits).tobytes()))
        return _blobs(rows)

    added = [T.StructField("__bytes", T.LongType()), T.StructField("__removed", T.LongType()), T.StructField("__spans", T.LongType()), T.StructField("__kept", T.BinaryType())]
    result = T.StructType([*[docs.schema[c] for c in others], *added])

    def cut(table: pa.Table, answers: pa.Table) -> pa.Table:
        if not table.num_rows:
            out = table.select(others)
            for f in added:
                out = out.append_column(f.name, pa.array([], pa.binary() if f.name == "__kept" else pa.int64()))
            return out
        s, _ = read(table)
        s.choose(_bits_of(answers, 0))
        replies = _bits_of(answers, 1)
        first = np.concatenate(([0], np.cumsum(s.windows)))
        elsewhere = np.zeros(first[-1], dtype=bool)
        for b, lo, hi in s.bucket_cuts(s.segment_bucket):
            elsewhere[first[lo]:first[hi]] = np.unpackbits(np.frombuffer(replies[b], dtype=np.uint8), count=int(first[hi] - first[lo])).astype(bool)
        counts = s.end - s.first
        hit = elsewhere[ranges(first[s.segment], counts)] | np.repeat(s.keys[s.doc] > s.segment_key[s.segment], counts)
        starts = np.zeros(len(s.data) + 1, dtype=np.int32)
        starts[ranges(s.first, counts)[hit] + 1] = 1
        seen = np.cumsum(starts)
        gone = seen[1:] > seen[np.maximum(np.arange(len(s.data)) - length + 1, 0)]
        if whole_characters:
            lead = np.flatnonzero((s.data & 0xC0) != 0x80)
            if len(lead):
                gone = np.repeat(np.logical_and.reduceat(gone, lead), np.diff(np.append(lead, len(gone))))
        total_gone = np.concatenate(([0], np.cumsum(gone)))
        opens = gone.copy()
        opens[1:] &= ~gone[:-1]
        edges = s.offsets[1:-1]
        edges = edges[edges < len(gone)]
        opens[edges] = gone[edges]
        total_opens = np.concatenate(([0], np.cumsum(opens)))
        left = s.data[~gone].tobytes()
        at = s.offsets - total_gone[s.offsets]
        kept = pa.Array.from_buffers(pa.binary(), table.num_rows, [None, pa.py_buffer(at.astype(np.int32).tobytes()), pa.py_buffer(left)])
        out = table.select(others)
        for name, column in (("__bytes", pa.array(np.diff(s.offsets))), ("__removed", pa.array(np.diff(total_gone[s.offsets]))),
                             ("__spans", pa.array(np.diff(total_opens[s.offsets]))), ("__kept", kept)):
            out = out.append_column(name, column)
        return out

    bits = dealt.groupBy("__block").applyInArrow(anchors, _BLOB).groupBy("bucket").applyInArrow(shared, _BLOB)
    asked = dealt.groupBy("__block").cogroup(bits.groupBy("block")).applyInArrow(segments, _BLOB)
    answers = bits.unionByName(asked.groupBy("bucket").applyInArrow(sort, _BLOB))
    found = dealt.groupBy("__block").cogroup(answers.groupBy("block")).applyInArrow(cut, result)
    return found.select(*put_back([c for c in given if names.get(c, c) in others and c.lower() not in _RESULTS], names), *_RESULTS) if names else found


def deduplicate(docs: DataFrame, key_col: str = "doc_id", text_col: str = "text", chars_col: str = "n_chars", length: int = LENGTH) -> DataFrame:
    """``docs`` with the repeated strings cut out of the text (whole code points) and its length in ``chars_col`` set anew."""
    text = F.when(F.col("__had"), F.decode("__kept", "UTF-8"))
    rows, names = set_aside(docs, (*_RESULTS, "__had"))
    own = {c: F.col(f"`{names.get(c, c)}`") for c in docs.columns}
    rows = rows.withColumn("__had", F.col(f"`{names.get(text_col, text_col)}`").isNotNull())
    found = remove_repeats(rows, names.get(key_col, key_col), names.get(text_col, text_col), length, whole_characters=True)
    if chars_col in own:
        own[chars_col] = F.when(F.col("__had") & (F.col("__removed") > 0), F.length(text)).otherwise(own[chars_col]).cast(docs.schema[chars_col].dataType)
    own[text_col] = text
    return found.select(*[column.alias(c) for c, column in own.items()])
