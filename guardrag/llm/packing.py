"""Lexical retrieval packing into fixed-length sequences with a sharded BM25 index.

Documents are tokenised whole (byte-level BPE, one end id 0 after each). A document's full windows of ``length`` ids
become sequences of their own; what is left is a remainder of fewer ids. A seed remainder opens a sequence, its
highest-scoring unused neighbours by BM25 fill it, and the last one is cut where the sequence is full; its rest
stays available. When no neighbour shares a term, the next unused remainder continues. The
end is cut into sequences whose lengths are powers of two, which need no padding.

Remainders are dealt to index shards by lexical nearness, so that a seed's neighbours lie in its own shard: a bounded sample of
remainders (256, by smallest hash) are representatives, every remainder is described by its three best ones by BM25, in order, and the shards
are consecutive ranges of this description of about ``shard_tokens`` ids. Inside a shard all terms of the seed score all
remainders. Neighbours in other shards are not retrieved; the README has the share that is missed. ``pack_everywhere`` asks all shards, in
rounds, at a cost that grows with the square of the corpus.

Terms are token ids, so corpus statistics (documents per term, number and mean length of remainders) have a fixed size whatever
the corpus: one number per id of the vocabulary, counted over all documents with partial aggregation and broadcast.

Tokenising works on distinct pieces: a text is cut before every single space that is followed by a
printable ASCII character or a Latin letter, where the pre-tokeniser always cuts too; each distinct piece of
a slice is encoded once and the ids are gathered. The file's added tokens (``<|endoftext|>``) are cut out first and get their
own ids. Tests compare this with the ``tokenizers`` library on whole texts.

Scale: text is read once; ids travel as 2-byte numbers through one written table, and the remainders through one shuffle. A task holds one shard
at a time, and its work depends on the shard's size, not on the corpus. Equal remainders are told apart by their row number, so a
large group of copies is a run of rows that several shards share. The driver holds the representatives and one number per id of the vocabulary.

Edge cases: null text is empty and packs as its end id; repeated rows are packed separately; null ids keep a null id;
a document longer than a sequence spans several; an empty table gives no rows.
"""

from __future__ import annotations

import json
import math
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from guardrag.llm.arrowtext import pieces, prefix_sums, ranges, span_hashes
from guardrag.session import materialize

LENGTH = 1024
END_ID = 0
SHARD_TOKENS = 1 << 20
REPRESENTATIVES = 256
K1, B = 1.2, 0.75
#: ``pack_everywhere``: seeds of a round are a quarter of the unused remainders within these bounds. Entries of all lists of a round, and of one list at least.
MIN_SEEDS, MAX_SEEDS = 1 << 10, 1 << 16
LIST_ENTRIES, MIN_LIST = 1 << 20, 10
#: Weights are whole multiples of 1/256, so that sums are exact in any order; seeds that are scored at a time.
UNIT, BLOCK = 256, 256
_LOW = 0xFFFFFFFF
#: Bytes after a space at which a text may be cut: printable ASCII, and the lead byte of the Latin letters U+00C0 to U+00FF.
_CUT_AFTER = np.zeros(256, dtype=bool)
_CUT_AFTER[0x21:0x7F] = _CUT_AFTER[0xC3] = True


class Encoder:
    """Ids of whole texts by a byte-level BPE file; distinct pieces are encoded once per slice.

    ``encode_texts`` follows the file, ``encode`` reads its added tokens as ordinary text.
    """

    def __init__(self, path: str):
        import tiktoken

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        if any(t.get("single_word") or t.get("lstrip") or t.get("rstrip") for t in spec.get("added_tokens", [])):
            raise ValueError("added tokens that depend on their neighbours are not supported")
        vocabulary, added = spec["model"]["vocab"], {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
        self.size = max([*vocabulary.values(), *added.values()]) + 1
        self.added = {token.encode(): i for token, i in added.items()}
        self.literal = re.compile(b"|".join(re.escape(t) for t in sorted(self.added, key=len, reverse=True)))
        # The file spells bytes as printable characters: printable Latin-1 stands for itself, the others follow from U+0100.
        plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
        other = [b for b in range(256) if b not in set(plain)]
        byte_of = {chr(b): b for b in plain} | {chr(0x100 + i): b for i, b in enumerate(other)}
        ranks = {bytes(byte_of[c] for c in token): i for token, i in vocabulary.items() if token not in added}
        pattern = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
        self.bpe = tiktoken.Encoding("pieces", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self.length_of = np.zeros(self.size, dtype=np.int64)
        for token, i in ranks.items():
            self.length_of[i] = len(token)

    def encode(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all rows in a row, first id of each row) of UTF-8 rows."""
        n = len(data)
        if not n:
            return np.zeros(0, np.uint16), np.zeros(len(offsets), np.int64)
        cut = np.zeros(n, dtype=bool)
        cut[:-1] = (data[:-1] == 32) & _CUT_AFTER[data[1:]]
        edges = offsets[:-1][np.diff(offsets) > 0]
        ends = offsets[1:][np.diff(offsets) > 0] - 1
        cut[ends] = False  # a space that ends a row is no cut, whatever the next row begins with
        cut[edges] = True
        start = np.flatnonzero(cut)
        end = np.append(start[1:], n)
        _, sample, number = np.unique(span_hashes(prefix_sums(data), start, end), return_index=True, return_inverse=True)
        raw = data.tobytes()
        # Distinct pieces that begin with a space follow each other as they would in a text; others are encoded alone.
        spaced = data[start[sample]] == 32
        joined = np.flatnonzero(spaced)
        text = b"".join(raw[start[i]:end[i]] for i in sample[joined])
        ids = np.array(self.bpe.encode_ordinary(text.decode()), dtype=np.uint16)
        begin = np.concatenate(([0], np.cumsum((end - start)[sample[joined]])))
        at = np.searchsorted(np.concatenate(([0], np.cumsum(self.length_of[ids]))), begin)
        first, count = np.zeros(len(sample), np.int64), np.zeros(len(sample), np.int64)
        first[joined], count[joined] = at[:-1], np.diff(at)
        more, total = [ids], len(ids)
        for k in np.flatnonzero(~spaced).tolist():
            own = np.array(self.bpe.encode_ordinary(raw[start[sample[k]]:end[sample[k]]].decode()), dtype=np.uint16)
            first[k], count[k] = total, len(own)
            more.append(own)
            total += len(own)
        ids = np.concatenate(more)
        counts = count[number]
        out = ids[ranges(first[number], counts)]
        return out, np.concatenate(([0], np.cumsum(counts)))[np.searchsorted(start, offsets)]

    def encode_texts(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """As ``encode``, with each added token of the file as its own id; the texts around it are encoded by themselves."""
        raw = data.tobytes()
        if not any(token in raw for token in self.added):
            return self.encode(data, offsets)
        rows = zip(offsets[:-1].tolist(), offsets[1:].tolist())
        found = [(m.start(), m.end(), self.added[m.group()]) for lo, hi in rows for m in self.literal.finditer(raw, lo, hi)]
        begin, end, special = np.array(found, dtype=np.int64).reshape(-1, 3).T
        keep = np.ones(len(data), dtype=bool)
        keep[ranges(begin, end - begin)] = False
        gone = np.concatenate(([0], np.cumsum(~keep)))
        edges = np.concatenate((offsets, begin))
        order = np.argsort(edges, kind="stable")  # a row that begins with a literal comes before the cut
        cut = order >= len(offsets)
        ids, first = self.encode(data[keep], (edges - gone[edges])[order])
        return np.insert(ids, first[cut], special.astype(np.uint16)), (first + np.cumsum(cut))[~cut]


_encoders: dict[str, Encoder] = {}


def _encoder(path: str) -> Encoder:
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


def tokenise(docs: DataFrame, path: str, key_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(key, ids, terms): the ids of every document with its end id, as 2-byte numbers, in place."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(path)
        if encoder.size > 1 << 16:
            raise ValueError("ids do not fit two bytes")
        for batch, data, offsets in pieces(batches, "text"):
            ids, first = encoder.encode_texts(data, offsets)
            at = first + np.arange(len(first))
            with_end = np.full(len(ids) + batch.num_rows, END_ID, dtype=np.uint16)
            with_end[np.arange(len(ids)) + np.repeat(np.arange(batch.num_rows), np.diff(first))] = ids
            body = pa.Array.from_buffers(pa.binary(), batch.num_rows, [None, pa.py_buffer((2 * at).astype(np.int32).tobytes()), pa.py_buffer(with_end.tobytes())])
            yield pa.RecordBatch.from_arrays([batch.column(0), body], names=["key", "ids"])

    texts = docs.select(F.col(f"`{key_col}`").cast("long").alias("key"), F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("text"))
    return texts.mapInArrow(run, "key long, ids binary")


def _remainder(ids: np.ndarray, length: int) -> np.ndarray:
    return ids[len(ids) // length * length:]


def term_statistics(tokens: DataFrame, length: int = LENGTH) -> tuple[np.ndarray, int, float]:
    """(remainders per term, number of remainders, their mean length) over all documents."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, rows, ids_in = np.zeros(1 << 16, dtype=np.int64), 0, 0
        for batch in batches:
            for body in batch.column(0):
                rest = _remainder(np.frombuffer(body.as_buffer(), dtype=np.uint16), length)
                if len(rest):
                    seen[np.unique(rest)] += 1
                    rows += 1
                    ids_in += len(rest)
        found = np.flatnonzero(seen)
        yield pa.RecordBatch.from_arrays([pa.array([*found.tolist(), -1, -2], pa.int32()), pa.array([*seen[found].tolist(), rows, ids_in], pa.int64())], names=["term", "n"])

    sums = {r["term"]: r["n"] for r in tokens.select("ids").mapInArrow(count, "term int, n long").groupBy("term").agg(F.sum("n").alias("n")).collect()}  # one row per id
    documents, ids_in = sums.pop(-1, 0), sums.pop(-2, 0)
    frequency = np.zeros(1 << 16, dtype=np.int64)
    for term, n in sums.items():
        frequency[term] = n
    return frequency, documents, ids_in / max(1, documents)


class Bm25Index:
    """Inverted index of one shard's remainders; scores are BM25 with the corpus's statistics.

    Terms that many of its remainders hold are rows of a matrix, the others are postings.
    """

    def __init__(self, rests: list[np.ndarray], frequency: np.ndarray, documents: int, mean: float):
        self.count = len(rests)
        lengths = np.array([len(r) for r in rests])
        doc = np.repeat(np.arange(len(rests)), lengths)
        pair, tf = np.unique(np.concatenate(rests).astype(np.int64) << 32 | doc, return_counts=True)
        term, self.doc = pair >> 32, pair & _LOW
        idf = np.log1p((documents - frequency + 0.5) / (frequency + 0.5))
        weight = idf[term] * tf * (K1 + 1) / (tf + K1 * (1 - B + B * lengths[self.doc] / max(mean, 1e-9)))
        weight = np.maximum(1, np.rint(UNIT * weight))
        exact = np.float32 if weight.max() * lengths.max() < 1 << 24 else np.float64
        self.weight = weight.astype(exact)
        self.begin = np.searchsorted(term, np.arange((1 << 16) + 1))
        held = np.diff(self.begin)
        common = np.flatnonzero(held * 16 > self.count)
        self.row = np.full(1 << 16, -1)
        self.row[common] = np.arange(len(common))
        self.matrix = np.zeros((len(common), self.count), dtype=exact)
        at = ranges(self.begin[common], held[common])
        self.matrix[np.repeat(np.arange(len(common)), held[common]), self.doc[at]] = self.weight[at]
        self.terms = self.first = None

    def scores(self, terms: np.ndarray, first: np.ndarray) -> np.ndarray:
        """Scores (in units) of all remainders for each query; ``terms`` are the queries' distinct terms in a row."""
        query = np.repeat(np.arange(len(first) - 1), np.diff(first))
        row = self.row[terms]
        asked = np.zeros((len(first) - 1, len(self.matrix)), dtype=self.matrix.dtype)
        asked[query[row >= 0], row[row >= 0]] = 1
        out = asked @ self.matrix
        rare, query = terms[row < 0].astype(np.int64), query[row < 0]
        n = self.begin[rare + 1] - self.begin[rare]
        at = ranges(self.begin[rare], n)
        np.add.at(out.reshape(-1), np.repeat(query * self.count, n) + self.doc[at], self.weight[at])
        return out

    def score_of(self, seed: int) -> np.ndarray:
        """Scores (in units) of all remainders for one of them: only the postings of its own terms are read."""
        if self.terms is None:
            order = np.argsort(self.doc, kind="stable")
            held = np.repeat(np.arange(1 << 16), np.diff(self.begin))
            self.terms, self.first = held[order], np.searchsorted(self.doc[order], np.arange(self.count + 1))
        own = self.terms[self.first[seed]:self.first[seed + 1]]
        row = self.row[own]
        out = self.matrix[row[row >= 0]].sum(axis=0)
        rare = own[row < 0]
        n = self.begin[rare + 1] - self.begin[rare]
        at = ranges(self.begin[rare], n)
        return out + np.bincount(self.doc[at], weights=self.weight[at], minlength=self.count)

    def neighbours(self, seed: int) -> np.ndarray:
        """Documents that share a term with ``seed``, best first; ties by number."""
        own = np.unique(np.repeat(np.arange(1 << 16), np.diff(self.begin))[self.doc == seed])
        score = self.scores(own, np.array([0, len(own)]))[0]
        found = np.flatnonzero(score > 0)
        return found[np.lexsort((found, -score[found]))]


def enter(best: np.ndarray, index: Bm25Index, numbers: np.ndarray, terms: np.ndarray, first: np.ndarray) -> None:
    """Enter an index's remainders into the lists of all queries: codes of score and number, best first, 0 where a list ends."""
    k = best.shape[1]
    for a in range(0, len(best), BLOCK):
        b = min(a + BLOCK, len(best))
        score = index.scores(terms[first[a]:first[b]], first[a:b + 1] - first[a])
        floor = np.maximum(best[a:b, -1] >> 32, 1)
        if index.count > k:
            floor = np.maximum(floor, np.partition(score, index.count - k, axis=1)[:, index.count - k])
        query, doc = np.nonzero(score >= floor[:, None].astype(score.dtype))
        codes = np.concatenate((best[a:b].reshape(-1), score[query, doc].astype(np.int64) << 32 | (_LOW - numbers[doc])))
        query = np.concatenate((np.repeat(np.arange(b - a), k), query))
        order = np.lexsort((-codes, query))
        begin = np.searchsorted(query[order], np.arange(b - a))
        best[a:b] = codes[order[begin[:, None] + np.arange(k)]]


class Packer:
    """State of the packing: what is left of each remainder, the open sequences, and the pieces of the full ones."""

    def __init__(self, lengths: np.ndarray, length: int = LENGTH):
        self.length, self.sequence = length, 0
        self.left, self.begin = lengths.astype(np.int32), np.zeros(len(lengths), dtype=np.int32)
        self.used, self.cut = lengths == 0, np.zeros(len(lengths), dtype=bool)
        self.waiting: list[tuple[int, list]] = []  # open sequences by seed whose lists are used up
        self.idle: list[list] = []  # open sequences whose seeds have no neighbour left
        self.out: list[tuple[int, int, int, int, int]] = []  # remainder, start, length, sequence, offset

    def seeds(self) -> tuple[list[int], int]:
        """(what to ask for next, entries of a list): open sequences first, then rests of cut remainders, then the next unused."""
        free = np.flatnonzero(~self.used)
        if not len(free):
            return [], 0
        count = min(MAX_SEEDS, max(MIN_SEEDS, len(free) // 4))
        self.asked = [seed for seed, _ in self.waiting[:count]]
        self.fresh = free[np.argsort(~self.cut[free], kind="stable")][:max(0, count - len(self.asked))].tolist()
        seeds = self.asked + self.fresh
        return seeds, max(MIN_LIST, LIST_ENTRIES // len(seeds))

    def fill(self, lists: dict[int, np.ndarray], entries: int) -> None:
        """Fill sequences by the lists of the seeds asked for; a list of fewer than ``entries`` is a whole ranking."""
        again, self.waiting = self.waiting[:len(self.asked)], self.waiting[len(self.asked):]
        for seed, line in again:
            self._extend(seed, line, lists, entries)
        for seed in self.fresh:
            if not self.used[seed]:
                self._extend(seed, self.idle.pop() if self.idle else [], lists, entries)

    def _extend(self, seed: int, line: list, lists: dict[int, np.ndarray], entries: int) -> None:
        while True:
            while self.left[seed]:
                line = self._take(seed, line)
            if not line:
                return
            cut = -1
            for i in lists[seed].tolist():
                if not self.used[i]:
                    line = self._take(i, line)
                    if not line:
                        cut = i if self.left[i] else -1
                        break
            if line:
                if len(lists[seed]) < entries:
                    self.idle.append(line)
                else:
                    self.waiting.append((seed, line))
                return
            if cut < 0 or cut not in lists:
                return
            seed = cut  # a remainder that was cut opens the next sequence

    def _take(self, i: int, line: list) -> list:
        """Put remainder i into an open sequence; cut it where the sequence is full. The open sequence, empty when it was full."""
        at = line[-1][2] + line[-1][3] if line else 0
        n = min(int(self.left[i]), self.length - at)
        line.append((i, int(self.begin[i]), n, at))
        self.begin[i] += n
        self.left[i] -= n
        self.used[i], self.cut[i] = self.left[i] == 0, True
        if at + n < self.length:
            return line
        self.out.extend((d, s, m, self.sequence, o) for d, s, m, o in line)
        self.sequence += 1
        return []

    def finish(self) -> None:
        """Nothing is unused: open sequences are joined, and the end is cut into powers of two."""
        pieces = [(d, s, n) for line in [*(line for _, line in self.waiting), *self.idle] for d, s, n, _ in line]
        self.waiting, self.idle = [], []
        size = sum(n for _, _, n in pieces)
        rest = size % self.length
        parts = [self.length] * (size // self.length) + [1 << k for k in range(rest.bit_length() - 1, -1, -1) if rest >> k & 1]
        k = at = 0
        for d, s, n in pieces:
            while n:
                put = min(n, parts[k] - at)
                self.out.append((d, s, put, self.sequence, at))
                s, n, at = s + put, n - put, at + put
                if at == parts[k]:
                    k, at, self.sequence = k + 1, 0, self.sequence + 1

    def pieces(self) -> np.ndarray:
        """The pieces of full sequences since the last call."""
        done, self.out = np.array(self.out, dtype=np.int64).reshape(-1, 5), []
        return done


def _numbers(rows: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Numbers from 0 of the rows of the written table, from the ids that Spark gave them (partition, then place)."""
    return starts[rows >> 33] + (rows & ((1 << 33) - 1))


def _remainders(batches: Iterator[pa.RecordBatch], starts: np.ndarray, wanted: np.ndarray, length: int) -> Iterator[tuple[int, np.ndarray]]:
    """(number, ids) of the wanted remainders."""
    for batch in batches:
        number = _numbers(batch.column(0).to_numpy(), starts)
        for k in np.flatnonzero(wanted[number]).tolist():
            yield int(number[k]), _remainder(np.frombuffer(batch.column(1)[k].as_buffer(), dtype=np.uint16), length)


def seed_terms(spark: SparkSession, tokens: DataFrame, starts: np.ndarray, seeds: list[int], total: int, length: int) -> tuple[np.ndarray, np.ndarray]:
    """(the distinct terms of the seeds in a row, first of each)."""
    wanted = np.zeros(total, dtype=bool)
    wanted[seeds] = True
    shared = spark.sparkContext.broadcast((starts, np.packbits(wanted)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        starts, bits = shared.value
        found = [(n, np.unique(ids).tobytes()) for n, ids in _remainders(batches, starts, np.unpackbits(bits).view(bool), length)]
        yield pa.RecordBatch.from_arrays([pa.array([n for n, _ in found], pa.int64()), pa.array([t for _, t in found], pa.binary())], names=["number", "terms"])

    found = tokens.select("row", "ids").mapInArrow(run, "number long, terms binary").toArrow()  # the seeds of one round
    shared.destroy()
    terms = dict(zip(found["number"].to_pylist(), found["terms"].to_pylist()))
    own = [np.frombuffer(terms[s], dtype=np.uint16) for s in seeds]
    return np.concatenate(own), np.concatenate(([0], np.cumsum([len(t) for t in own])))


def rank(spark: SparkSession, tokens: DataFrame, starts: np.ndarray, statistics: tuple[np.ndarray, int, float], queries: tuple[np.ndarray, np.ndarray],
         used: np.ndarray, entries: int, length: int, shard_tokens: int) -> list[np.ndarray]:
    """The best unused remainders for each query over all index shards, best first; ties by number."""
    shared = spark.sparkContext.broadcast((starts, statistics, queries, np.packbits(~used)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        starts, statistics, (terms, first), bits = shared.value
        best = np.zeros((len(first) - 1, entries), dtype=np.int64)
        numbers, rests, size = [], [], 0
        for number, ids in _remainders(batches, starts, np.unpackbits(bits).view(bool), length):
            numbers.append(number)
            rests.append(ids)
            size += len(ids)
            if size >= shard_tokens:
                enter(best, Bm25Index(rests, *statistics), np.array(numbers), terms, first)
                numbers, rests, size = [], [], 0
        if rests:
            enter(best, Bm25Index(rests, *statistics), np.array(numbers), terms, first)
        found = np.flatnonzero(best[:, 0])
        counts = (best[found] > 0).sum(axis=1)
        codes = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(counts))), pa.int32()), pa.array(best[best > 0], pa.int64()))
        yield pa.RecordBatch.from_arrays([pa.array(found, pa.int64()), codes], names=["query", "codes"])

    lists = tokens.select("row", "ids").mapInArrow(run, "query long, codes array<long>").groupBy("query") \
        .agg(F.slice(F.sort_array(F.flatten(F.collect_list("codes")), False), 1, entries).alias("codes")).toArrow()  # one round's lists
    shared.destroy()
    out = [np.zeros(0, dtype=np.int64)] * (len(queries[1]) - 1)
    for part in lists.to_batches():
        codes = part.column(1)
        flat, first = _LOW - (codes.flatten().to_numpy() & _LOW), np.concatenate(([0], np.cumsum(codes.value_lengths().to_numpy())))
        for k, query in enumerate(part.column(0).to_pylist()):
            out[query] = flat[first[k]:first[k + 1]]
    return out


_PIECE = "key long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def _crc(ids: np.ndarray) -> int:
    return zlib.crc32(ids.astype("<u4").tobytes())


def representatives(tokens: DataFrame, statistics: tuple[np.ndarray, int, float], length: int, count: int = REPRESENTATIVES) -> Bm25Index | None:
    """An index of a bounded sample of remainders (those with the smallest hashes); None if no remainder holds an id."""
    rest = F.expr(f"substring(ids, int(octet_length(ids) div {2 * length} * {2 * length} + 1))")
    sample = (tokens.select(rest.alias("rest")).where(F.octet_length("rest") > 2).select("rest", F.xxhash64("rest").alias("h")).distinct()
              .orderBy("h", "rest").limit(count).collect())
    return Bm25Index([np.frombuffer(r["rest"], dtype=np.uint16) for r in sample], *statistics) if sample else None


def nearest_representatives(index: Bm25Index | None, rests: list[np.ndarray], depth: int = 3) -> np.ndarray:
    """For each remainder the numbers of its best representatives, best first, packed into one number; equal remainders have equal numbers."""
    out = np.zeros(len(rests), dtype=np.int64)
    if index is None:
        return out
    for a in range(0, len(rests), BLOCK):
        terms = [np.unique(r) for r in rests[a:a + BLOCK]]
        score = index.scores(np.concatenate(terms), np.concatenate(([0], np.cumsum([len(t) for t in terms])))).astype(np.int64)
        codes = score << 32 | (_LOW - np.arange(index.count))
        best = -np.sort(-codes, axis=1)[:, :depth]
        for k in range(best.shape[1]):
            out[a:a + BLOCK] = out[a:a + BLOCK] << 16 | np.where(best[:, k] >> 32 > 0, _LOW - (best[:, k] & _LOW) + 1, 0)
    return out


def pack_shard(rests: list[np.ndarray], statistics: tuple[np.ndarray, int, float], length: int = LENGTH, first_look: int = 64) -> list[tuple[int, int, int, int, int]]:
    """(remainder, start, length, sequence, offset) of every piece of one shard.

    The next unused remainder is the seed of a sequence; its unused neighbours fill it, best first by BM25 over all terms of the seed (ties by number).
    What is cut off where a sequence is full opens the next one. With no neighbour left, the next unused remainder goes on. The shard's
    end is cut into powers of two.
    """
    index = Bm25Index(rests, *statistics)
    left, begin = np.array([len(r) for r in rests]), np.zeros(len(rests), dtype=np.int64)
    unused = left > 0
    out: list[tuple[int, int, int, int, int]] = []
    line: list[tuple[int, int, int, int]] = []
    sequence = size = at = 0

    def take(i: int) -> bool:
        """Put remainder i into the open sequence; true if that is full now."""
        nonlocal sequence, size, line
        n = min(int(left[i]), length - size)
        line.append((i, int(begin[i]), n, size))
        begin[i] += n
        left[i] -= n
        size += n
        unused[i] = left[i] > 0
        if size < length:
            return False
        out.extend((d, s, m, sequence, o) for d, s, m, o in line)
        sequence, line, size = sequence + 1, [], 0
        return True

    seed = -1
    while True:
        if seed < 0 or not unused[seed]:
            while at < len(rests) and not unused[at]:
                at += 1
            if at == len(rests):
                break
            seed = at
        if take(seed):
            continue  # what is left of it is the next seed
        codes = np.where(unused, index.score_of(seed).astype(np.int64), 0) << 32 | (_LOW - np.arange(index.count))
        full = False
        for look in (min(first_look, index.count), index.count):
            best = codes if look == index.count else codes[np.argpartition(codes, index.count - look)[index.count - look:]]
            for code in np.sort(best)[::-1].tolist():
                i = _LOW - (code & _LOW)
                if code >> 32 and unused[i]:
                    full = take(i)
                    if full:
                        seed = i
                        break
            if full:
                break
        if not full:
            seed = -1
    parts = [1 << k for k in range(size.bit_length() - 1, -1, -1) if size >> k & 1]
    at = 0
    for d, s, n, _ in line:
        while n:
            put = min(n, parts[0] - at)
            out.append((d, s, put, sequence, at))
            s, n, at = s + put, n - put, at + put
            if at == parts[0]:
                parts, sequence, at = parts[1:], sequence + 1, 0
    return out


def pack(docs: DataFrame, tokenizer_path: str, key_col: str = "doc_id", text_col: str = "text", length: int = LENGTH,
         shard_tokens: int = SHARD_TOKENS) -> DataFrame:
    """One row per piece: key, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    Remainders are dealt to shards by lexical nearness; a shard is indexed and packed by the task that holds it. Sequence ids are odd for full
    windows of one document and even for packed remainders.
    """
    spark = docs.sparkSession
    tokens = materialize(tokenise(docs, tokenizer_path, key_col, text_col).withColumn("row", F.monotonically_increasing_id()), "tokens")
    statistics = term_statistics(tokens, length)
    index = representatives(tokens, statistics, length)
    shared = spark.sparkContext.broadcast((statistics, index))  # a number per id of the vocabulary, and a bounded sample of remainders

    def windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 36
        for batch in batches:
            out = []
            for key, body in zip(batch.column(0).to_pylist(), batch.column(1)):
                ids = np.frombuffer(body.as_buffer(), dtype=np.uint16)
                for k in range(len(ids) // length):
                    out.append((key, k * length, length, _crc(ids[k * length:(k + 1) * length]), len(ids), 2 * number + 1, 0))
                    number += 1
            yield _piece_batch(out)

    def near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _, index = shared.value
        for batch in batches:
            bodies = [np.frombuffer(x.as_buffer(), dtype=np.uint16) for x in batch.column(2)]
            whole = np.array([len(x) for x in bodies], dtype=np.int64)
            rests = [_remainder(x, length) for x in bodies]
            some = np.flatnonzero([len(r) > 0 for r in rests])
            rests = [rests[i] for i in some]
            place = nearest_representatives(index, rests)
            yield pa.RecordBatch.from_arrays([pa.array(place, pa.int64()), batch.column(0).take(pa.array(some)), batch.column(1).take(pa.array(some)), pa.array(whole[some], pa.int64()),
                                              pa.array([r.tobytes() for r in rests], pa.binary())], names=["place", "row", "key", "total", "rest"])

    def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        statistics, _ = shared.value
        number = TaskContext.get().partitionId() << 36
        held: list[tuple[int, int, np.ndarray]] = []
        size = 0

        def flush() -> pa.RecordBatch:
            nonlocal number, held, size
            pieces = pack_shard([r for _, _, r in held], statistics, length)
            out = [(held[i][0], held[i][1] // length * length + s, n, _crc(held[i][2][s:s + n]), held[i][1], 2 * (number + q), o) for i, s, n, q, o in pieces]
            number += pieces[-1][3] + 1
            held, size = [], 0
            return _piece_batch(out)

        for batch in batches:
            for key, total, body in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2)):
                rest = np.frombuffer(body.as_py(), dtype=np.uint16)
                held.append((key, total, rest))
                size += len(rest)
                if size >= shard_tokens:
                    yield flush()
        if held:
            yield flush()

    rest_ids = F.pmod(F.octet_length("ids") / 2, F.lit(length))
    shards = max(1, math.ceil((tokens.agg(F.sum(rest_ids)).first()[0] or 0) / shard_tokens))
    placed = tokens.select("row", "key", "ids").mapInArrow(near, "place long, row long, key long, total long, rest binary")
    # The row number keeps equal remainders apart, so a group of copies spreads over shards like any other run of rows.
    dealt = placed.repartitionByRange(shards, "place", "row").sortWithinPartitions("place", "row")
    whole = tokens.select("key", "ids").mapInArrow(windows, _PIECE)
    return whole.unionByName(dealt.select("key", "total", "rest").mapInArrow(fill, _PIECE)).withColumnRenamed("key", key_col)


def pack_everywhere(docs: DataFrame, tokenizer_path: str, key_col: str = "doc_id", text_col: str = "text", length: int = LENGTH,
         shard_tokens: int = SHARD_TOKENS) -> DataFrame:
    """As ``pack``, with every seed against all remainders of all shards, in rounds. For corpora of one driver's size: its work grows with the square of the
    corpus and two numbers per document reach the driver.

    Sequence ids are odd for full windows of one document and even for packed remainders.
    """
    spark = docs.sparkSession
    tokens = materialize(tokenise(docs, tokenizer_path, key_col, text_col).withColumn("row", F.monotonically_increasing_id()), "tokens")
    sizes = tokens.select("row", (F.octet_length("ids") / 2).cast("long").alias("n")).toArrow()  # two numbers a document
    rows, counts = sizes["row"].to_numpy(), sizes["n"].to_numpy()
    order = np.argsort(rows)
    rows, counts = rows[order], counts[order]
    starts = np.searchsorted(rows >> 33, np.arange((int(rows[-1]) >> 33) + 1 if len(rows) else 0))
    statistics = term_statistics(tokens, length)

    packer, packed = Packer(counts % length, length), []

    def keep() -> None:
        done = packer.pieces()
        if len(done):
            at = pa.table({"row": rows[done[:, 0]], "start": done[:, 1], "length": done[:, 2], "sequence_id": 2 * done[:, 3], "offset": done[:, 4]})
            packed.append(materialize(spark.createDataFrame(at), "pieces"))

    while (asked := packer.seeds())[0]:
        seeds, entries = asked
        queries = seed_terms(spark, tokens, starts, seeds, len(rows), length)
        found = rank(spark, tokens, starts, statistics, queries, packer.used, entries, length, shard_tokens)
        packer.fill(dict(zip(seeds, found)), entries)
        keep()
    packer.finish()
    keep()

    shared = spark.sparkContext.broadcast(starts)

    def windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            number = _numbers(batch.column("row").to_numpy(), shared.value).tolist()
            out = []
            for n, key, body in zip(number, batch.column("key").to_pylist(), batch.column("ids")):
                ids = np.frombuffer(body.as_buffer(), dtype=np.uint16)
                out.extend((key, k * length, length, _crc(ids[k * length:(k + 1) * length]), len(ids), ((n << 24) + k) * 2 + 1, 0) for k in range(len(ids) // length))
            yield _piece_batch(out)

    def remainders(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            key, total, body, start, size, sequence, offset = (batch.column(c) for c in ("key", "total", "rest", "start", "length", "sequence_id", "offset"))
            out = []
            for k, x, b, s, n, q, o in zip(key.to_pylist(), total.to_pylist(), body, start.to_pylist(), size.to_pylist(), sequence.to_pylist(), offset.to_pylist()):
                out.append((k, x // length * length + s, n, _crc(np.frombuffer(b.as_buffer(), dtype=np.uint16)[s:s + n]), x, q, o))
            yield _piece_batch(out)

    whole = tokens.mapInArrow(windows, _PIECE)
    if packed:
        pieces = packed[0]
        for more in packed[1:]:
            pieces = pieces.unionByName(more)
        total = (F.octet_length("ids") / 2).cast("long")
        rests = tokens.select("row", "key", total.alias("total"), F.expr(f"substring(ids, int(octet_length(ids) div {2 * length} * {2 * length} + 1))").alias("rest"))
        whole = whole.unionByName(rests.join(pieces, "row").mapInArrow(remainders, _PIECE))
    return whole.withColumnRenamed("key", key_col)


def _piece_batch(rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows)) or [[]] * 7
    return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=["key", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"])
