"""Benchmark decontamination with a generalised suffix automaton.

The normalised words of all test items go into one suffix automaton. Document words
are streamed through it while the longest match ending at each word is tracked; a
match that reaches a window (``window`` consecutive item words, or a whole item of
fewer words) marks its words as hit. Spans of hit words, their coverage of the
document and the items they come from decide what is contaminated; ``remove_spans`` cuts
spans beyond a length or a coverage limit out of the text, ``drop_contaminated`` drops documents.

Words are ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` after lower-casing A-Z, on UTF-8 bytes.

Only runs of words whose m-grams all occur in some item (m = min(4, shortest window))
are streamed: a window cannot lie outside them, so the result is unchanged, and the
cost of ordinary text is a few vector operations per byte.

Scale: documents are scanned in place (no shuffle). Items are broadcast in shards of a
checked size (``shard_bytes``); beyond one shard the documents are scanned once per
shard, with each pass's spans carried along in a written table, so memory stays bounded.

Edge cases: null or empty text has no words and no hits; null item text has none
either; a null item id is written as "null"; items that share an id count once;
repeated documents are judged alike, row by row; an empty item table hits nothing.
"""

from __future__ import annotations

import hashlib
import math
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from guardrag.llm.arrowtext import LOWER, mix, pieces, prefix_sums, ranges, span_hashes, text_bytes, word_spans
from guardrag.llm.columns import put_back, set_aside
from guardrag.session import materialize

WINDOW = 13
SHARD_BYTES = 1 << 20

IS_WORD = np.ones(256, dtype=bool)
IS_WORD[0x00:0x30] = IS_WORD[0x3A:0x61] = IS_WORD[0x7B:0x80] = False

_MULT = np.uint64(0xD6E8FEB86659FD93)
_FILTER_BITS = 20

#: Result columns: words, hit words, longest match, flat [start, end) word spans, items with occurring windows.
N_WORDS, N_HIT, LONGEST, SPANS, ITEMS = "__n_words", "__n_hit", "__longest", "__spans", "__items"
_CUT = "__cut"
_FIELDS = [T.StructField(N_WORDS, T.LongType()), T.StructField(N_HIT, T.LongType()), T.StructField(LONGEST, T.LongType()),
           T.StructField(SPANS, T.ArrayType(T.LongType())), T.StructField(ITEMS, T.ArrayType(T.StringType()))]


def words_of(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hash of every word, first word of each row)."""
    data = LOWER[data]
    starts, ends, rows = word_spans(data, offsets, IS_WORD)
    return span_hashes(prefix_sums(data), starts, ends), rows


def _gram_hashes(hashes: np.ndarray, m: int) -> np.ndarray:
    n = len(hashes) - m + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = hashes[:n].copy()
    for j in range(1, m):
        out *= _MULT
        out += hashes[j:j + n]
    return mix(out)


class SuffixAutomaton:
    """Generalised suffix automaton over word numbers; states know which items contain them."""

    def __init__(self, sequences: list[list[int]], window: int):
        self.window = window
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length = [-1], [0]
        ends: list[set[int]] = [set()]
        final: list[tuple[int, int]] = []
        for item, seq in enumerate(sequences):
            last = 0
            for w in seq:
                last = self._extend(last, w, ends)
                ends[last].add(item)
            if seq and len(seq) < window:
                final.append((last, item))
        for state in sorted(range(1, len(self.length)), key=self.length.__getitem__, reverse=True):
            ends[self.link[state]] |= ends[state]
        self.items = ends
        #: Whole short items that end where a state's strings end: (length, item), own ones first.
        self.short: dict[int, list[tuple[int, int]]] = {}
        for state, item in final:
            self.short.setdefault(state, []).append((len(sequences[item]), item))

    def _extend(self, last: int, w: int, ends: list[set[int]]) -> int:
        nxt, link, length = self.next, self.link, self.length
        if w in nxt[last]:
            q = nxt[last][w]
            return q if length[q] == length[last] + 1 else self._clone(last, w, q, ends)
        cur = len(length)
        nxt.append({})
        link.append(0)
        length.append(length[last] + 1)
        ends.append(set())
        p = last
        while p >= 0 and w not in nxt[p]:
            nxt[p][w] = cur
            p = link[p]
        if p >= 0:
            q = nxt[p][w]
            link[cur] = q if length[q] == length[p] + 1 else self._clone(p, w, q, ends)
        return cur

    def _clone(self, p: int, w: int, q: int, ends: list[set[int]]) -> int:
        nxt, link, length = self.next, self.link, self.length
        copy = len(length)
        nxt.append(dict(nxt[q]))
        link.append(link[q])
        length.append(length[p] + 1)
        ends.append(set())
        link[q] = copy
        while p >= 0 and nxt[p].get(w) == q:
            nxt[p][w] = copy
            p = link[p]
        return copy

    def scan(self, words: list[int]) -> tuple[list[tuple[int, int]], set[int], int]:
        """(hit spans as [start, end), items with occurring windows, longest match) of a word sequence."""
        nxt, link, length, window = self.next, self.link, self.length, self.window
        spans: list[tuple[int, int]] = []
        items: set[int] = set()
        state = have = longest = 0
        for i, w in enumerate(words):
            while state and w not in nxt[state]:
                state = link[state]
                have = length[state]
            if w in nxt[state]:
                state = nxt[state][w]
                have += 1
            reach = 0
            if have > longest:
                longest = have
            if have >= window:
                reach = have
                v = state
                while length[link[v]] >= window:
                    v = link[v]
                items |= self.items[v]
            if self.short:
                v = state
                while v > 0:
                    for size, item in self.short.get(v, ()):
                        if size <= have:
                            items.add(item)
                            reach = max(reach, size)
                    v = link[v]
            if reach:
                start = i + 1 - reach
                while spans and spans[-1][1] >= start:
                    start = min(start, spans.pop()[0])
                spans.append((start, i + 1))
        return spans, items, longest


class ItemIndex:
    """Automaton, vocabulary and m-gram filter of one shard of items; built once per Python worker."""

    def __init__(self, items: list[tuple[str, str]], window: int):
        data, offsets = text_bytes(pa.array([t for _, t in items], pa.string()))
        hashes, rows = words_of(data, offsets)
        self.vocabulary, ids = np.unique(hashes, return_inverse=True)
        sequences = [ids[a:b].tolist() for a, b in zip(rows[:-1], rows[1:])]
        self.names = [name for name, _ in items]
        self.automaton = SuffixAutomaton(sequences, window)
        shortest = min([min(len(s), window) for s in sequences if s], default=0)
        self.m = min(4, shortest)
        if self.m:
            grams = _gram_hashes(hashes, self.m)
            own = np.flatnonzero(np.arange(len(grams)) + self.m <= np.repeat(rows[1:], np.diff(rows))[:len(grams)])
            self.grams = np.unique(grams[own])
            self.filter = np.zeros(1 << _FILTER_BITS, dtype=bool)
            self.filter[(self.grams >> np.uint64(64 - _FILTER_BITS)).astype(np.int64)] = True
        self.seen: dict[bytes, tuple] = {}

    def match(self, hashes: np.ndarray, rows: np.ndarray) -> dict[int, tuple[list[int], set[int], int]]:
        """Row number -> (flat word spans within the row, items, longest match), for rows with a candidate run."""
        found: dict[int, tuple[list[int], set[int], int]] = {}
        if not self.m or not len(hashes):
            return found
        grams = _gram_hashes(hashes, self.m)
        at = np.flatnonzero(self.filter[(grams >> np.uint64(64 - _FILTER_BITS)).astype(np.int64)])
        place = np.minimum(np.searchsorted(self.grams, grams[at]), len(self.grams) - 1)
        at = at[self.grams[place] == grams[at]]
        row = np.searchsorted(rows, at, side="right") - 1
        keep = at + self.m <= rows[row + 1]
        at, row = at[keep], row[keep]
        if not len(at):
            return found
        head = np.ones(len(at), dtype=bool)
        head[1:] = (np.diff(at) > self.m) | (np.diff(row) > 0)
        first = np.flatnonzero(head)
        last = np.append(first[1:], len(at)) - 1
        begin, end, owner = at[first], at[last] + self.m, row[first]
        ids = np.searchsorted(self.vocabulary, hashes[ranges(begin, end - begin)]).astype(np.int32)
        cut = np.concatenate(([0], np.cumsum(end - begin)))
        for b, r, lo, hi in zip(begin.tolist(), owner.tolist(), cut[:-1].tolist(), cut[1:].tolist()):
            key = ids[lo:hi].tobytes()
            got = self.seen.get(key)
            if got is None:
                if len(self.seen) > 20_000:
                    self.seen.clear()
                got = self.seen[key] = self.automaton.scan(ids[lo:hi].tolist())
            spans, items, longest = got
            old = found.setdefault(r, ([], set(), 0))
            shift = b - int(rows[r])
            old[0].extend(x + shift for span in spans for x in span)
            old[1].update(items)
            found[r] = (old[0], old[1], max(old[2], longest))
        return found


_index_cache: dict[str, ItemIndex] = {}


def merge_spans(flat: list[int], more: list[int]) -> list[int]:
    """Union of two flat span lists."""
    pairs = sorted([*zip(flat[::2], flat[1::2]), *zip(more[::2], more[1::2])])
    out: list[int] = []
    for a, b in pairs:
        if out and a <= out[-1]:
            out[-1] = max(out[-1], b)
        else:
            out += [a, b]
    return out


def match_items(docs: DataFrame, items: DataFrame, text_col: str = "text", item_id_col: str = "item_id",
                item_text_col: str = "text", window: int = WINDOW, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """``docs`` with the columns N_WORDS, N_HIT, LONGEST, SPANS and ITEMS added; columns of the input with these names are replaced."""
    spark = docs.sparkSession
    items = items.select(F.coalesce(F.col(item_id_col).cast("string"), F.lit("null")).alias("id"),
                         F.coalesce(F.col(item_text_col), F.lit("")).alias("text"))
    size = items.agg(F.sum(F.octet_length("text") + 16)).first()[0] or 0
    docs = docs.select(*[f"`{c}`" for c in docs.columns if c.lower() not in {x.name for x in _FIELDS}])
    n_shards = max(1, math.ceil(1.25 * size / shard_bytes)) if size > shard_bytes else 1
    for shard in range(n_shards):
        own = items if n_shards == 1 else items.where(F.pmod(F.xxhash64("id", "text"), F.lit(n_shards)) == shard)
        listed = spark.sparkContext.broadcast((uuid.uuid4().hex, sorted((r["id"], r["text"]) for r in own.collect())))
        docs = _scan(docs, listed, text_col, window, again=shard > 0)
        if shard + 1 < n_shards:
            docs = materialize(docs, "decontaminate")
            listed.destroy()
    return docs


def _scan(docs: DataFrame, listed, text_col: str, window: int, again: bool) -> DataFrame:
    kept = [f for f in docs.schema.fields if not again or f.name not in {x.name for x in _FIELDS}]
    order = [f.name for f in kept]
    docs = docs.select(*[f"`{c}`" for c in order], *([x.name for x in _FIELDS] if again else []))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, data, offsets in pieces(batches, text_col):
            shard, named = listed.value
            if shard not in _index_cache:
                _index_cache.clear()
                _index_cache[shard] = ItemIndex(named, window)
            index = _index_cache[shard]
            hashes, rows = words_of(data, offsets)
            found = index.match(hashes, rows)
            n = batch.num_rows
            spans: list[list[int]] = batch.column(len(order) + 3).to_pylist() if again else [[] for _ in range(n)]
            names: list[list[str]] = batch.column(len(order) + 4).to_pylist() if again else [[] for _ in range(n)]
            longest = batch.column(len(order) + 2).to_numpy(zero_copy_only=False).copy() if again else np.zeros(n, np.int64)
            for r, (more, which, most) in found.items():
                spans[r] = merge_spans(spans[r], more)
                names[r] = sorted({*names[r], *(index.names[i] for i in which)})
                longest[r] = max(longest[r], most)
            hit = [sum(s[1::2]) - sum(s[::2]) for s in spans]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:len(order)], pa.array(np.diff(rows), pa.int64()), pa.array(hit, pa.int64()), pa.array(longest, pa.int64()),
                 pa.array(spans, pa.list_(pa.int64())), pa.array(names, pa.list_(pa.string()))],
                names=[*order, *(x.name for x in _FIELDS)])

    return docs.mapInArrow(scan, T.StructType([*kept, *_FIELDS]))


def contaminated(min_share: float = 0.05):
    """Rule of a contaminated document: a hit, and hit words at least ``min_share`` of its words."""
    return (F.col(N_HIT) > 0) & (F.col(N_HIT) * F.lit(round(1 / min_share)) >= F.col(N_WORDS))


def drop_contaminated(docs: DataFrame, items: DataFrame, text_col: str = "text", **options) -> DataFrame:
    """The documents that are not contaminated, with their own columns unchanged."""
    rows, names = set_aside(docs, (x.name for x in _FIELDS))
    return match_items(rows, items, names.get(text_col, text_col), **options).where(~contaminated()).select(*put_back(docs.columns, names))


def remove_spans(docs: DataFrame, items: DataFrame, text_col: str = "text", chars_col: str | None = None, max_words: int = WINDOW - 1,
                 max_share: float = 0.05, **options) -> DataFrame:
    """``docs`` with benchmark spans cut out of the text, the other columns unchanged.

    A span (a longest run of hit words) of more than ``max_words`` words goes, whatever the document's size; where hit words are at least
    ``max_share`` of its words, all of its spans go. From a span's first byte to its last goes; separators beside it stay. Null stays null; ``chars_col``,
    if given, is set to the new length of a text that was cut. A second scan in place, no shuffle.
    """
    rows, names = set_aside(docs, (*(x.name for x in _FIELDS), _CUT))
    text = names.get(text_col, text_col)
    found = match_items(rows, items, text, **options)
    order = [*found.columns, _CUT]
    share = round(1 / max_share) if max_share > 0 else 0

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, data, offsets in pieces(batches, text):
            starts, ends, first = word_spans(LOWER[data], offsets, IS_WORD)
            gone = np.zeros(len(data) + 1, dtype=np.int32)
            n_words, n_hit = (batch.column(order.index(c)).to_pylist() for c in (N_WORDS, N_HIT))
            for r, flat in enumerate(batch.column(order.index(SPANS)).to_pylist()):
                every = n_hit[r] > 0 and (not share or n_hit[r] * share >= n_words[r])
                for a, b in zip(flat[::2], flat[1::2]):
                    if every or b - a > max_words:
                        gone[starts[first[r] + a]] += 1
                        gone[ends[first[r] + b - 1]] -= 1
            stays = np.cumsum(gone[:-1]) == 0
            left = np.concatenate(([0], np.cumsum(stays)))[offsets]
            whole = batch.column(order.index(text))
            texts = pa.Array.from_buffers(pa.string(), batch.num_rows, [None, pa.py_buffer(left.astype(np.int32).tobytes()), pa.py_buffer(data[stays].tobytes())])
            texts = pc.if_else(pc.is_valid(whole), texts, pa.scalar(None, pa.string()))
            yield pa.RecordBatch.from_arrays([*batch.columns, texts], names=order)

    found = found.mapInArrow(cut, T.StructType([*found.schema.fields, T.StructField(_CUT, T.StringType())]))
    own = {c: F.col(f"`{names.get(c, c)}`") for c in docs.columns}
    if chars_col in own:
        changed = F.octet_length(F.col(_CUT)) < F.octet_length(own[text_col])
        own[chars_col] = F.when(changed, F.length(_CUT)).otherwise(own[chars_col]).cast(docs.schema[chars_col].dataType)
    own[text_col] = F.col(_CUT)
    return found.select(*[column.alias(c) for c, column in own.items()])


def digest_of_items(column: str = ITEMS):
    """Lower-case hex SHA-256 of the sorted item ids, joined by commas."""
    return F.sha2(F.array_join(F.array_sort(column), ","), 256)


def digest_of_ids(ids: list[str]) -> str:
    return hashlib.sha256(",".join(sorted(ids)).encode()).hexdigest()
