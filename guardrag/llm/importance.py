"""Target-distribution importance resampling on hashed word n-grams, with an Aho-Corasick dictionary of word payloads.

Features of a text are all runs of one to ``GRAMS`` consecutive words, joined by one space; a feature's bucket is its CRC-32 modulo
``BUCKETS``. Documents are drawn by the log ratio of the target's and the corpus's bucket frequencies plus Gumbel noise.

1. **Dictionary.** The distinct words of a piece of texts enter an Aho-Corasick automaton as `` word ``, bounded by the delimiter,
   each with a payload: the CRC of the word, the CRC of the word with a leading space, and the length that this adds.
2. **Scan.** The automaton runs over the piece and emits one payload per word, in the order of the text.
3. **Composition.** A CRC is linear: crc(A + B) = shift(crc(A), len(B)) ^ crc(B), where the shift is a 32 x 32 bit matrix for each
   length. Payloads of adjacent words compose into the CRCs of two- and three-word features; no n-gram string is ever built.
4. **Counting and scoring.** Every text is scanned once. Its bucket numbers are written as a binary column (2 bytes a feature); counts of
   the corpus and scores of the documents are both read from this table.

Scale: dictionaries are local to a piece (about 1 MiB of text, or one longer text), so nothing that grows is broadcast. A task gives at
most ``BUCKETS`` partial counts; ``BUCKETS`` gains go to the tasks. Ranks come from a range partitioning of the scores: partition counts
give each one's first rank and only partitions that hold drawn rows are numbered. Rows with equal scores and ids are kept apart by
a row number, so a group of repeated rows spreads over partitions.

Edge cases: null texts and texts without words have no features, weight 0, and are never drawn (under ``MIN_WORDS`` words). A null id is
hashed as ``null`` and ranks after equal scores with an id. Repeated rows are scored and ranked one by one. An empty corpus gives no rows;
an empty target gives gains from its zero counts. Very long texts are scanned whole. Other columns are ignored by ``score_documents`` and
returned unchanged by ``resample``.
"""

from __future__ import annotations

import zlib

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from guardrag.llm.arrowtext import pieces
from guardrag.session import materialize

GRAMS, BUCKETS = 3, 10000
MIN_WORDS, PERCENT, SEED = 20, 5, 42
PIECE_BYTES = 1 << 20

#: Word bytes (digits, letters, everything beyond ASCII) with A-Z lower-cased; all others become the delimiter.
_NORMAL = np.array([c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256)], np.uint8)
_DIRECT = 256


def _byte_table() -> np.ndarray:
    table = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        table = np.where(table & 1, table >> 1 ^ np.uint32(0xEDB88320), table >> 1)
    return table


def _shift_tables() -> np.ndarray:
    """[length, byte position, byte value]: the CRC of what follows when ``length`` zero bytes are appended."""
    step, basis = _byte_table(), np.uint32(1) << np.arange(32, dtype=np.uint32)
    images = np.empty((_DIRECT, 32), np.uint32)
    for length in range(_DIRECT):
        images[length] = basis
        basis = step[basis & np.uint32(255)] ^ basis >> np.uint32(8)
    out = np.zeros((_DIRECT, 4, 256), np.uint32)
    values = np.arange(256)
    for bit in range(8):
        on = values >> bit & 1 == 1
        for byte in range(4):
            out[:, byte, on] ^= images[:, 8 * byte + bit, None]
    return out


_SHIFT = _shift_tables()


def shifted(crc: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """CRC-32 values moved over ``lengths`` following bytes (any length, in steps of up to 255)."""
    crc, left = crc.astype(np.uint32), np.asarray(lengths).astype(np.int64)
    while True:
        now = np.minimum(left, _DIRECT - 1)
        crc = (_SHIFT[now, 0, crc & np.uint32(255)] ^ _SHIFT[now, 1, crc >> np.uint32(8) & np.uint32(255)]
               ^ _SHIFT[now, 2, crc >> np.uint32(16) & np.uint32(255)] ^ _SHIFT[now, 3, crc >> np.uint32(24)])
        left = left - now
        if not left.any():
            return crc


def word_payloads(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Payloads of all words in the order of the texts, by an automaton over their distinct words.

    (CRC, CRC with a leading space, length with the space, first word of each row).
    """
    # One delimiter goes before each row and one behind the last, so that no word crosses rows.
    spread = np.full(len(data) + len(offsets), 32, np.uint8)
    spread[np.arange(len(data)) + np.repeat(np.arange(1, len(offsets)), np.diff(offsets))] = _NORMAL[data]
    flat = spread.tobytes().decode("utf-8", "surrogateescape")
    inside = spread != 32
    first = np.flatnonzero(inside[1:] & ~inside[:-1])
    rows = np.searchsorted(first, offsets + np.arange(len(offsets)))
    words = [w for w in set(flat.split(" ")) if w]
    if not words:
        return np.zeros(0, np.uint32), np.zeros(0, np.uint32), np.zeros(0, np.int64), rows
    machine = ahocorasick.Automaton(ahocorasick.STORE_INTS)
    payloads = np.empty((2, len(words)), np.uint32)
    lengths = np.empty(len(words), np.int64)
    for k, word in enumerate(words):
        machine.add_word(f" {word} ", k)
        raw = word.encode("utf-8", "surrogateescape")
        payloads[:, k] = zlib.crc32(raw), zlib.crc32(b" " + raw)
        lengths[k] = len(raw) + 1
    machine.make_automaton()
    found = np.fromiter((k for _, k in machine.iter(flat)), dtype=np.int32)
    return payloads[0][found], payloads[1][found], lengths[found], rows


def feature_buckets(data: np.ndarray, offsets: np.ndarray, grams: int = GRAMS, buckets: int = BUCKETS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bucket of every feature, row after row; first feature of each row; words of each row)."""
    crc, spaced, lengths, rows = word_payloads(data, offsets)
    n = np.diff(rows)
    row_end = np.repeat(rows[1:], n)
    at = np.arange(len(crc))
    parts, owners, run = [crc % np.uint32(buckets)], [np.repeat(np.arange(len(n)), n)], crc
    for g in range(1, grams):
        fits = at + g < row_end
        at, row_end, owner = at[fits], row_end[fits], owners[-1][fits]
        run = shifted(run[fits], lengths[at + g]) ^ spaced[at + g]
        parts.append(run % np.uint32(buckets))
        owners.append(owner)
    owner = np.concatenate(owners)
    order = np.argsort(owner, kind="stable")
    return np.concatenate(parts)[order].astype(np.uint16), np.searchsorted(owner[order], np.arange(len(n) + 1)), n


_FEATURES = "row long, key string, n_words long, n_features long, buckets binary"


def features(texts: DataFrame, grams: int = GRAMS, buckets: int = BUCKETS) -> DataFrame:
    """(row, key, n_words, n_features, buckets) of (row, key, text): bucket numbers of every text as unsigned 16-bit integers."""
    if buckets > 1 << 16:
        raise ValueError("bucket numbers are kept in 16 bits")

    def run(batches):
        for batch, data, offsets in pieces(batches, "text", PIECE_BYTES):
            found, first, words = feature_buckets(data, offsets, grams, buckets)
            bodies = [found[a:b].tobytes() for a, b in zip(first[:-1].tolist(), first[1:].tolist())]
            yield pa.RecordBatch.from_arrays([batch.column("row"), batch.column("key"), pa.array(words, pa.int64()), pa.array(np.diff(first), pa.int64()), pa.array(bodies, pa.binary())],
                                             names=["row", "key", "n_words", "n_features", "buckets"])

    return texts.select("row", "key", "text").mapInArrow(run, _FEATURES)


def bucket_counts(found: DataFrame, buckets: int = BUCKETS) -> np.ndarray:
    """Features in each bucket, over all rows."""
    def run(batches):
        total = np.zeros(buckets, np.int64)
        for b in batches:
            for body in b.column("buckets"):
                total += np.bincount(np.frombuffer(body.as_buffer(), np.uint16), minlength=buckets)
        own = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(own, pa.int32()), pa.array(total[own], pa.int64())], names=["bucket", "n"])

    out = np.zeros(buckets, np.int64)
    for r in found.select("buckets").mapInArrow(run, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect():
        out[r["bucket"]] = r["n"]
    return out


def bucket_gains(corpus: np.ndarray, target: np.ndarray) -> np.ndarray:
    """floor(1000 ln) of the smoothed frequency ratio of every bucket."""
    s, t, total_s, total_t, k = corpus.astype(float), target.astype(float), float(corpus.sum()), float(target.sum()), float(len(corpus))
    return np.floor(1000 * np.log((t + 1) * (total_s + k) / ((s + 1) * (total_t + k)))).astype(np.int64)


def weighted(found: DataFrame, gains: np.ndarray) -> DataFrame:
    """(row, key, n_words, n_features, weight): the sum of gains over a text's features."""
    def run(batches):
        for b in batches:
            weights = [int(gains[np.frombuffer(body.as_buffer(), np.uint16)].sum()) for body in b.column("buckets")]
            yield pa.RecordBatch.from_arrays([b.column(c) for c in ("row", "key", "n_words", "n_features")] + [pa.array(weights, pa.int64())],
                                             names=["row", "key", "n_words", "n_features", "weight"])

    return found.mapInArrow(run, "row long, key string, n_words long, n_features long, weight long")


def gumbel(key, seed: int):
    """floor(-1000 ln(-ln(u))) of the uniform number that a key's SHA-256 gives."""
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(key, F.lit("null"))), 256), 1, 8), 16, 10).cast("double")
    return F.floor(F.lit(-1000.0) * F.log(-F.log((h + F.lit(0.5)) / F.lit(4294967296.0))))


def ranked(scored: DataFrame, drawn: int) -> DataFrame:
    """``scored`` (a written table) with ``rank`` of the ``drawn`` highest scores among rows with ``eligible``; ties to the smaller ``order``, then row."""
    order = [F.desc("score"), F.asc_nulls_last("order"), F.asc("row")]
    dealt = scored.where("eligible").repartitionByRange(*order).withColumn("part", F.spark_partition_id())
    dealt = materialize(dealt, "importance-ranges")
    before, offsets = 0, []
    for r in dealt.groupBy("part").count().orderBy("part").collect():  # a row per partition
        if before < drawn:
            offsets.append((r["part"], before))
        before += r["count"]
    rest = scored.where("not eligible").withColumn("rank", F.lit(None).cast("long"))
    if not offsets:
        return rest.unionByName(dealt.drop("part").withColumn("rank", F.lit(None).cast("long")))
    last = offsets[-1][0]
    first = F.element_at(F.create_map(*[F.lit(x) for pair in offsets for x in pair]), F.col("part"))
    place = first + F.row_number().over(Window.partitionBy("part").orderBy(*order))
    top = dealt.where(F.col("part") <= last).withColumn("place", place).withColumn("rank", F.when(F.col("place") <= drawn, F.col("place")).cast("long"))
    low = dealt.where(F.col("part") > last).withColumn("rank", F.lit(None).cast("long"))
    return rest.unionByName(top.drop("part", "place")).unionByName(low.drop("part"))


def _texts(rows: DataFrame, key_col: str | None, text_col: str) -> DataFrame:
    key = F.col(f"`{key_col}`").cast("string") if key_col else F.lit(None).cast("string")
    return rows.select(F.monotonically_increasing_id().alias("row"), key.alias("key"), F.col(f"`{text_col}`").alias("text"))


def _scored(texts: DataFrame, kind, target: DataFrame, target_col: str, min_words: int, percent: int, seed: int) -> DataFrame:
    found = materialize(features(texts), "importance-features")
    gains = bucket_gains(bucket_counts(found), bucket_counts(features(_texts(target, None, target_col))))
    scored = weighted(found, gains).withColumn("score", F.col("weight") + gumbel(F.col("key"), seed))
    scored = materialize(scored.withColumns({"eligible": F.col("n_words") >= min_words, "order": F.col("key").cast(kind)}), "importance-scores")
    return ranked(scored, scored.where("eligible").count() * percent // 100)


def score_documents(docs: DataFrame, target: DataFrame, key_col: str = "doc_id", text_col: str = "text", target_col: str = "text",
                    min_words: int = MIN_WORDS, percent: int = PERCENT, seed: int = SEED) -> DataFrame:
    """(key, n_words, n_features, weight, score, rank) of every document; ``rank`` is null where it is not drawn."""
    out = _scored(_texts(docs, key_col, text_col), docs.schema[key_col].dataType, target, target_col, min_words, percent, seed)
    return out.select(F.col("order").alias(key_col), "n_words", "n_features", "weight", "score", "rank")


def resample(docs: DataFrame, target: DataFrame, key_col: str = "doc_id", text_col: str = "text", target_col: str = "text",
             min_words: int = MIN_WORDS, percent: int = PERCENT, seed: int = SEED) -> DataFrame:
    """The rows of ``docs`` that are drawn, with all their columns. Rows are numbered in a written copy, so repeated ids stay apart."""
    numbered = materialize(docs.select(F.monotonically_increasing_id().alias("row"), F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc")), "importance-rows")
    texts = numbered.select("row", F.col("doc").getField(key_col).cast("string").alias("key"), F.col("doc").getField(text_col).alias("text"))
    drawn = _scored(texts, docs.schema[key_col].dataType, target, target_col, min_words, percent, seed).where("rank is not null")
    return numbered.join(drawn.select("row"), "row", "left_semi").select("doc.*")
