"""Exact Jaccard self-join of documents on word shingles, as a metric-space join.

A document's set holds its distinct five-word shingles (the whole sequence if it has fewer words; words are
``[^\\x20\\x09-\\x0D]+`` after lower-casing A-Z). Jaccard distance 1 - |x & y| / |x | y| is a metric; two
documents link when it is at most 0.25. Shingles are 64-bit hashes.

Documents meet by a prefix filter on rare shingles first: pivots drawn from all documents are useless for shingle sets, as nearly
all distances are 1. The metric join works on what meets: pivots, balls and windows inside a task, Voronoi regions above.

Steps:

1. **Who can have a partner.** A linked pair shares 3/4 of either set, so a document with more than n/4 shingles that
   nobody else has links with nothing. Blocks of documents send 4-byte hashes of a fixed share of
   their shingles to buckets; the answer is one bit each: does it occur elsewhere? (Collisions only keep a document longer.)
2. **Classes.** Equal sets are one class with one copy of the set, so a text that fills a third of the table is one node.
3. **Regions.** Over the classes that are left, each shingle's count and the smallest class that has it are found.
   A class enters the regions of its n/4 + 1 rarest shared shingles, the region being named by
   that smallest class. A linked pair shares one of these shingles, so it meets in a region.
4. **Metric join in a region.** A member becomes a pivot; its exact distances to all others define a ball (distance up to
   0.25: linked), a window (up to 0.5) and the rest, which by the triangle inequality holds no
   partner of the ball. Ball members are settled by their pivot; window members that are not yet connected
   become pivots themselves; then a member outside all balls is the next pivot.
5. **Large regions** (over ``region_cap`` members or ``REGION_BYTES``). Members with over a quarter of shingles that nobody else in the region has leave.
   Eight pivots create Voronoi regions; a member is copied to the earlier regions whose pivot is at most 0.5 further
   away than its own, so partners on a border meet; what lies in a ball is linked and stays only where an outsider can come near. Regions that are still
   too large are cut again with new pivots. Where the distances do not cut (over 0.7 of the pairs would be left, for one region keeps most members or
   windows copy too much), the region is joined in tiles of two bounded chunks, only where distance bands around one pivot and the counts of lonely shingles allow links.
6. **Components** of the links among classes by alternating star contraction; members join back by class.

Scale: text is shuffled once (the exchange is reused), shingles of all documents as 4-byte hashes for a share, full sets only for
documents that can have partners. No pair list, no cross join; links inside a region are a star.

Edge cases: null or empty texts, and texts without words, have an empty set and link with nothing; null ids take no
part in the join and have a null component; rows with equal ids are separate rows; an empty table
gives no rows.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from guardrag.llm.arrowtext import LOWER, mix, prefix_sums, ranges, span_hashes, text_bytes, word_spans
from guardrag.session import materialize, scratch_path

WORDS = 5
#: Similarity of linked documents as a ratio of integers.
NEAR = (3, 4)
#: A region is joined by one task up to this many members and bytes of shingles.
REGION_CAP, REGION_BYTES = 4000, 64 << 20
#: Pivots of a round of Voronoi regions, rounds, and the share of pairs beyond which a round is no progress and tiles are used instead.
PIVOTS, ROUNDS, PAIRS = 8, 6, 0.7
BLOCK_BYTES = (4 << 20, 256 << 20)
MAX_BLOCKS = 400_000
#: Share of the hash space whose shingles are counted in step 1, in sixteenths.
COUNTED = 6
BINS = 20

IS_WORD = np.ones(256, dtype=bool)
IS_WORD[[0x20, *range(0x09, 0x0E)]] = False
_MULT = np.uint64(0xD6E8FEB86659FD93)
_U = np.uint64


def shingle_sets(data: np.ndarray, offsets: np.ndarray, words: int = WORDS) -> tuple[np.ndarray, np.ndarray]:
    """(sorted distinct shingle hashes of all rows in a row, first shingle of each row)."""
    data = LOWER[data]
    starts, ends, rows = word_spans(data, offsets, IS_WORD)
    hashes = span_hashes(prefix_sums(data), starts, ends)
    n = np.diff(rows)
    counts = np.where(n >= words, n - words + 1, np.minimum(n, 1))
    row = np.repeat(np.arange(len(n)), counts)
    at = ranges(rows[:-1], counts)
    last = rows[1:][row] - 1
    out = hashes[at] if len(at) else np.zeros(0, np.uint64)
    for j in range(1, words):
        inside = at + j <= last
        nxt = hashes[np.minimum(at + j, len(hashes) - 1)] if len(at) else out
        out = np.where(inside, out * _MULT + nxt, out)
    out = mix(out)
    order = np.lexsort((out, row))
    out, row = out[order], row[order]
    keep = np.ones(len(out), dtype=bool)
    keep[1:] = (out[1:] != out[:-1]) | (row[1:] != row[:-1])
    return out[keep], np.searchsorted(row[keep], np.arange(len(n) + 1))


def _identity(tokens: np.ndarray, buckets: int) -> np.ndarray:
    """Bucket (upper 32 bits) and 4-byte value of a shingle."""
    low = tokens & _U((1 << 48) - 1)
    return (low % _U(buckets)) << _U(32) | (low // _U(buckets)) & _U(0xFFFFFFFF)


def _cuts(ids: np.ndarray) -> list[tuple[int, int, int]]:
    bucket = (ids >> _U(32)).astype(np.int64)
    cut = np.flatnonzero(np.concatenate(([True], bucket[1:] != bucket[:-1]))) if len(bucket) else np.zeros(0, np.int64)
    return list(zip(bucket[cut].tolist(), cut.tolist(), [*cut[1:].tolist(), len(bucket)]))


class LinkFinder:
    """Links among the sets of one region or tile: pivots, balls, windows, recursion."""

    def __init__(self, tokens: np.ndarray, first: np.ndarray, near: tuple[int, int] = NEAR):
        self.sizes = np.diff(first)
        self.count = len(self.sizes)
        self.near = near
        _, number = np.unique(tokens, return_inverse=True)
        self.tokens, self.first = number, first
        order = np.argsort(number, kind="stable")
        self.holder = np.repeat(np.arange(self.count), self.sizes)[order]
        self.begin = np.searchsorted(number[order], np.arange((number.max() if len(number) else -1) + 2))
        self.root = np.arange(self.count)

    def shared(self, p: int) -> np.ndarray:
        """|x & p| for all x."""
        own = self.tokens[self.first[p]:self.first[p + 1]]
        at = self.begin[own]
        return np.bincount(self.holder[ranges(at, self.begin[own + 1] - at)], minlength=self.count)

    def _unite(self, members: np.ndarray) -> None:
        roots = np.unique(self.root[members])
        if len(roots) > 1:
            self.root[np.isin(self.root, roots[1:])] = roots[0]

    def run(self) -> np.ndarray:
        """Smallest member number of each member's component."""
        a, b = self.near
        radius = 1 - a / b
        settled = np.zeros(self.count, dtype=bool)
        asked = np.zeros(self.count, dtype=bool)
        windows: list[tuple[int, np.ndarray]] = []

        def pivot(p: int) -> None:
            both = self.shared(p)
            union = self.sizes + self.sizes[p] - both
            ball = np.flatnonzero(b * both >= a * union)
            self._unite(ball)
            settled[ball] = True
            asked[p] = True
            # By the triangle inequality a ball member's partner is within twice the radius of the pivot.
            window = np.flatnonzero((b * both < a * union) & (both >= (1 - 2 * radius - 1e-9) * union))
            windows.append((p, window))

        # The largest sets first: a document and its shortened copies tend to lie in the ball of the longest.
        for p in np.argsort(-self.sizes, kind="stable").tolist():
            if not settled[p]:
                pivot(p)
        at = 0
        while at < len(windows):
            p, window = windows[at]
            at += 1
            for x in window.tolist():
                if self.root[x] != self.root[p] and not asked[x]:
                    pivot(x)
        return self.root


def _table(columns: dict[str, tuple]) -> pa.Table:
    return pa.table([pa.array(v, t) for v, t in columns.values()], names=list(columns))


_BLOB = "bucket long, block long, body binary"


def _blobs(rows: list[tuple[int, int, bytes]]) -> pa.Table:
    bucket, block, body = zip(*rows) if rows else ([], [], [])
    return _table({"bucket": (bucket, pa.int64()), "block": (block, pa.int64()), "body": (body, pa.binary())})


def _bodies(table: pa.Table) -> dict[int, bytes]:
    return dict(zip(table.column("bucket").to_pylist(), table.column("body").to_pylist()))


def _sets(table: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    data, offsets = text_bytes(table.column("tokens"))
    return data.view(np.uint64) if data.flags.aligned and data.ctypes.data % 8 == 0 else np.frombuffer(data.tobytes(), np.uint64), offsets // 8


def _shingled(docs: DataFrame, key_col: str, text_col: str, words: int) -> DataFrame:
    """(key, n, d1, d2, tokens): set size and digest of every document; the set itself for one document per block and
    class that can have a partner."""
    total = docs.agg(F.sum(F.octet_length(F.col(f"`{text_col}`")) + 64)).first()[0] or 0
    size = min(max(BLOCK_BYTES[0], total // MAX_BLOCKS), BLOCK_BYTES[1])
    blocks = max(1, math.ceil(total / size))
    dealt = docs.select(F.col(f"`{key_col}`").cast("long").alias("key"), F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("text"),
                        F.pmod(F.xxhash64(F.col(f"`{key_col}`"), F.col(f"`{text_col}`")), F.lit(blocks)).alias("block")).repartition("block")

    def read(table: pa.Table):
        tokens, first = shingle_sets(*text_bytes(table.column("text")), words)
        doc = np.repeat(np.arange(table.num_rows), np.diff(first))
        picked = np.flatnonzero((tokens >> _U(60)) < _U(COUNTED))
        ids, number = np.unique(_identity(tokens[picked], blocks), return_inverse=True)
        return tokens, first, doc[picked], ids, number

    def offer(table: pa.Table) -> pa.Table:
        _, _, _, ids, _ = read(table)
        values = (ids & _U(0xFFFFFFFF)).astype(np.uint32)
        block = table.column("block")[0].as_py()
        return _blobs([(b, block, values[lo:hi].tobytes()) for b, lo, hi in _cuts(ids)])

    def answer(table: pa.Table) -> pa.Table:
        lists = [np.frombuffer(x, dtype=np.uint32) for x in table.column("body").to_pylist()]
        values, counts = np.unique(np.concatenate(lists), return_counts=True)
        often = values[counts > 1]
        rows = []
        for bucket, block, own in zip(table.column("bucket").to_pylist(), table.column("block").to_pylist(), lists):
            bits = np.isin(own, often, assume_unique=True)
            if bits.any():
                rows.append((bucket, block, np.packbits(bits).tobytes()))
        return _blobs(rows)

    def decide(table: pa.Table, answers: pa.Table) -> pa.Table:
        if not table.num_rows:
            return _table({"key": ([], pa.int64()), "n": ([], pa.int64()), "d1": ([], pa.int64()), "d2": ([], pa.int64()), "tokens": ([], pa.binary())})
        tokens, first, doc, ids, number = read(table)
        bits = _bodies(answers)
        common = np.bincount(number, minlength=len(ids)) > 1
        for b, lo, hi in _cuts(ids):
            if b in bits:
                common[lo:hi] |= np.unpackbits(np.frombuffer(bits[b], dtype=np.uint8), count=hi - lo).astype(bool)
        n = np.diff(first)
        alone = np.bincount(doc[~common[number]], minlength=len(n))
        sums = []
        for salt in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F):
            run = np.concatenate(([_U(0)], np.cumsum(mix(tokens ^ _U(salt)), dtype=np.uint64)))
            sums.append((run[first[1:]] - run[first[:-1]]).view(np.int64))
        keys = table.column("key").to_pylist()
        can = (n > 0) & (alone * NEAR[1] <= n * (NEAR[1] - NEAR[0]))
        best: dict[tuple, int] = {}
        for i in np.flatnonzero(can).tolist():
            if keys[i] is not None:
                c = (int(sums[0][i]), int(sums[1][i]), int(n[i]))
                if c not in best or keys[i] < keys[best[c]]:
                    best[c] = i
        chosen = set(best.values())
        sets = [tokens[first[i]:first[i + 1]].tobytes() if i in chosen else None for i in range(len(n))]
        return _table({"key": (keys, pa.int64()), "n": (n, pa.int64()), "d1": (sums[0], pa.int64()), "d2": (sums[1], pa.int64()), "tokens": (sets, pa.binary())})

    bits = dealt.groupBy("block").applyInArrow(offer, _BLOB).groupBy("bucket").applyInArrow(answer, _BLOB)
    return dealt.groupBy("block").cogroup(bits.groupBy("block")).applyInArrow(decide, "key long, n long, d1 long, d2 long, tokens binary")


_MEMBER = "region long, id long, tokens binary"


def _regions(sets: DataFrame, block_bytes: int) -> DataFrame:
    """(region, id, tokens): classes in the regions of their rarest shared shingles; ``id`` is a class's smallest key."""
    total = sets.agg(F.sum(F.octet_length("tokens") + 64)).first()[0] or 0
    blocks = max(1, math.ceil(total / block_bytes))
    dealt = sets.select("key", "d1", "d2", "n", "tokens", F.pmod(F.xxhash64("d1", "d2", "n"), F.lit(blocks)).alias("block")).repartition("block")

    def read(table: pa.Table):
        table = table.sort_by([("d1", "ascending"), ("d2", "ascending"), ("n", "ascending"), ("key", "ascending")])
        d = np.stack([table.column(c).to_numpy() for c in ("d1", "d2", "n")])
        new = np.ones(table.num_rows, dtype=bool)
        new[1:] = (d[:, 1:] != d[:, :-1]).any(axis=0)
        table = table.filter(pa.array(new))
        tokens, first = _sets(table)
        ids, number = np.unique(_identity(tokens, blocks), return_inverse=True)
        keys = table.column("key").to_numpy()
        return tokens, first, ids, number, keys, np.repeat(np.arange(len(keys)), np.diff(first))

    def offer(table: pa.Table) -> pa.Table:
        _, _, ids, number, keys, doc = read(table)
        block = table.column("block")[0].as_py()
        count = np.minimum(np.bincount(number, minlength=len(ids)), 255).astype(np.uint8)
        least = np.full(len(ids), 2**63 - 1, dtype=np.int64)
        np.minimum.at(least, number, keys[doc])
        values = (ids & _U(0xFFFFFFFF)).astype(np.uint32)
        return _blobs([(b, block, values[lo:hi].tobytes() + least[lo:hi].tobytes() + count[lo:hi].tobytes()) for b, lo, hi in _cuts(ids)])

    def answer(table: pa.Table) -> pa.Table:
        parts = []
        for body in table.column("body").to_pylist():
            m = len(body) // 13
            parts.append((np.frombuffer(body, np.uint32, m), np.frombuffer(body, np.int64, m, 4 * m), np.frombuffer(body, np.uint8, m, 12 * m)))
        value, least, count = (np.concatenate(x) for x in zip(*parts))
        _, number = np.unique(value, return_inverse=True)
        total_count = np.minimum(np.bincount(number, weights=count), 255).astype(np.uint8)
        first_key = np.full(len(total_count), 2**63 - 1, dtype=np.int64)
        np.minimum.at(first_key, number, least)
        rows, at = [], 0
        for bucket, block, (own, _, _) in zip(table.column("bucket").to_pylist(), table.column("block").to_pylist(), parts):
            which = number[at:at + len(own)]
            at += len(own)
            rows.append((bucket, block, total_count[which].tobytes() + first_key[which[total_count[which] > 1]].tobytes()))
        return _blobs(rows)

    def place(table: pa.Table, answers: pa.Table) -> pa.Table:
        region, member = [], []
        if table.num_rows:
            tokens, first, ids, number, keys, doc = read(table)
            bodies = _bodies(answers)
            count, name = np.zeros(len(ids), dtype=np.uint8), np.zeros(len(ids), dtype=np.int64)
            for b, lo, hi in _cuts(ids):
                count[lo:hi] = np.frombuffer(bodies[b], np.uint8, hi - lo)
                name[lo:hi][count[lo:hi] > 1] = np.frombuffer(bodies[b], np.int64, -1, hi - lo)
            n = np.diff(first)
            order = np.lexsort((tokens, count[number], doc))
            rank = np.arange(len(order)) - first[doc[order]]
            spare = n * (NEAR[1] - NEAR[0]) // NEAR[1]
            alone = np.bincount(doc[count[number] == 1], minlength=len(n))
            used = (rank <= spare[doc[order]]) & (count[number[order]] > 1) & (alone <= spare)[doc[order]]
            pairs = np.unique(np.stack((name[number[order[used]]], doc[order[used]])), axis=1) if used.any() else np.zeros((2, 0), np.int64)
            region, member = pairs[0].tolist(), pairs[1].tolist()
            sets_ = [tokens[first[i]:first[i + 1]].tobytes() for i in member]
            return _table({"region": (region, pa.int64()), "id": (keys[member] if member else [], pa.int64()), "tokens": (sets_, pa.binary())})
        return _table({"region": ([], pa.int64()), "id": ([], pa.int64()), "tokens": ([], pa.binary())})

    replies = dealt.groupBy("block").applyInArrow(offer, _BLOB).groupBy("bucket").applyInArrow(answer, _BLOB)
    return dealt.groupBy("block").cogroup(replies.groupBy("block")).applyInArrow(place, _MEMBER)


def _join_units(units: DataFrame, block_bytes: int) -> DataFrame:
    """Links (a, b), a star per component, inside each unit of (unit, id, tokens); small units share a task."""
    total = units.agg(F.sum(F.octet_length("tokens") + 64)).first()[0] or 0
    parts = max(1, math.ceil(total / block_bytes))

    def join(table: pa.Table) -> pa.Table:
        table = table.sort_by([("unit", "ascending"), ("id", "ascending")])
        unit, ids = table.column("unit").to_numpy(), table.column("id").to_numpy()
        tokens, first = _sets(table)
        a, b = [], []
        cut = np.flatnonzero(np.concatenate(([True], unit[1:] != unit[:-1])))
        for lo, hi in zip(cut.tolist(), [*cut[1:].tolist(), len(unit)]):
            if hi - lo > 1:
                root = LinkFinder(tokens[first[lo]:first[hi]], first[lo:hi + 1] - first[lo]).run()
                far = np.flatnonzero(ids[lo:hi] != ids[lo:hi][root])
                a.append(ids[lo:hi][far])
                b.append(ids[lo:hi][root[far]])
        joined = [np.concatenate(x) if x else np.zeros(0, np.int64) for x in (a, b)]
        return _table({"a": (joined[0], pa.int64()), "b": (joined[1], pa.int64())})

    return (units.withColumn("part", F.pmod(F.xxhash64("unit"), F.lit(parts))).repartition("part")
            .groupBy("part").applyInArrow(join, "a long, b long"))


def _lonely(rows: DataFrame) -> DataFrame:
    """``rows`` with ``alone``: how many of a member's shingles no other member of its region has; hopeless members are left out.

    Linked members share shingles that have two holders here, so a member with more than a quarter of lonely shingles links with nobody in
    the region, and of two linked members one has at most a seventh (7 * shared >= 3 * (n + m) and shared <= n - alone, for both).
    """
    def unpack(batches):
        for batch in batches:
            tokens, first = _sets(pa.Table.from_batches([batch]))
            row = np.repeat(np.arange(batch.num_rows), np.diff(first))
            region, ids = batch.column("region").to_numpy(), batch.column("id").to_numpy()
            for lo in range(0, len(tokens), 1 << 18):
                at = row[lo:lo + (1 << 18)]
                yield pa.RecordBatch.from_arrays([pa.array(region[at]), pa.array(ids[at]), pa.array(tokens[lo:lo + (1 << 18)].view(np.int64))],
                                                 names=["region", "id", "token"])

    holders = (rows.select("region", "id", "tokens").mapInArrow(unpack, "region long, id long, token long")
               .groupBy("region", "token").agg(F.count("*").alias("holders"), F.min("id").alias("id")).where("holders = 1"))
    alone = holders.groupBy("region", "id").agg(F.count("*").alias("alone"))
    n = F.octet_length("tokens") / 8
    return (rows.select("region", "id", "tokens").join(alone, ["region", "id"], "left").withColumn("alone", F.coalesce("alone", F.lit(0)))
            .where(F.col("alone") * NEAR[1] <= n * (NEAR[1] - NEAR[0])))


def _sizes(rows: DataFrame) -> DataFrame:
    return rows.groupBy("region").agg(F.count("*").alias("count"), F.sum(F.octet_length("tokens")).cast("long").alias("bytes"))


def _fits(cap: int):
    return (F.col("count") <= cap) & (F.col("bytes") <= REGION_BYTES)


_EMPTY_PLACES = _table({"region": ([], pa.int64()), "id": ([], pa.int64()), "tokens": ([], pa.binary()), "alone": ([], pa.int64()), "home": ([], pa.int32()),
                        "ball": ([], pa.bool_()), "places": ([], pa.list_(pa.int32())), "distances": ([], pa.list_(pa.float64())), "linked": ([], pa.list_(pa.int64()))})


def _nearest(rows: DataFrame, sizes: DataFrame, cap: int, salt: int) -> DataFrame:
    """Distances to ``PIVOTS`` pivots of the region, as places: a member's Voronoi region and the earlier ones in whose window it lies.

    Let x be nearest to pivot p, its partner y to q: d(x, q) <= d(y, q) + r <= d(y, p) + r <= d(x, p) + 2r. So x is copied to
    the regions that come before its own and whose pivot is at most 2r further away than its own, and the pair meets in the earlier region.
    """
    light = F.min_by("id", F.struct(F.col("alone") / F.octet_length("tokens"), "id"))  # the member most like the others
    drawn = rows.groupBy("region").agg(F.array_distinct(F.array(light, *[F.min_by("id", F.xxhash64("id", F.lit(salt * PIVOTS + j))) for j in range(1, PIVOTS)])).alias("drawn"))
    pivots = drawn.select("region", F.explode("drawn").alias("id")).join(rows.select("region", "id", "tokens"), ["region", "id"])
    parts = sizes.select("region", F.ceil(F.greatest(F.col("count") / cap, F.col("bytes") / REGION_BYTES)).cast("long").alias("parts"))
    dealt = rows.join(parts, "region").withColumn("part", F.pmod(F.xxhash64("id"), F.col("parts"))).drop("parts")
    centres = pivots.join(parts, "region").select("region", "id", "tokens", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)).alias("part"))
    centres = materialize(centres, "pivots")
    radius = 1 - NEAR[0] / NEAR[1]
    schema = "region long, id long, tokens binary, alone long, home int, ball boolean, places array<int>, distances array<double>, linked array<long>"

    def measure(table: pa.Table, centres: pa.Table) -> pa.Table:
        if not table.num_rows:
            return _EMPTY_PLACES
        tokens, first = _sets(table)
        centres = centres.sort_by("id")
        theirs, begin = _sets(centres)
        holder, n, pivot = np.repeat(np.arange(table.num_rows), np.diff(first)), np.diff(first), centres.column("id").to_numpy()
        d, inside = np.ones((table.num_rows, len(pivot))), np.zeros((table.num_rows, len(pivot)), dtype=bool)
        for j in range(len(pivot)):
            own = theirs[begin[j]:begin[j + 1]]
            shared = np.bincount(holder[np.isin(tokens, own)], minlength=len(n))
            union = n + len(own) - shared
            d[:, j], inside[:, j] = 1 - shared / union, NEAR[1] * shared >= NEAR[0] * union
        row = np.arange(len(n))
        home = d.argmin(axis=1)
        goes = (d <= d[row, home][:, None] + 2 * radius + 1e-9) & (np.arange(len(pivot)) <= home[:, None])
        ids = table.column("id").to_numpy()
        return pa.table({
            "region": table.column("region"), "id": table.column("id"), "tokens": table.column("tokens"), "alone": table.column("alone"),
            "home": pa.array(home, pa.int32()), "ball": pa.array(inside[row, home]),
            "places": pa.array([np.flatnonzero(g).tolist() for g in goes], pa.list_(pa.int32())),
            "distances": pa.array([x[g].tolist() for x, g in zip(d, goes)], pa.list_(pa.float64())),
            "linked": pa.array([pivot[i & (pivot != own)].tolist() for i, own in zip(inside, ids)], pa.list_(pa.int64()))})

    return dealt.groupBy("region", "part").cogroup(centres.groupBy("region", "part")).applyInArrow(measure, schema)


def _voronoi(rows: DataFrame, sizes: DataFrame, cap: int, salt: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(smaller regions, regions that distances do not cut, links to pivots) of (region, id, tokens, alone)."""
    radius = 1 - NEAR[0] / NEAR[1]
    placed = materialize(_nearest(rows, sizes, cap, salt), "voronoi")
    links = placed.select(F.col("id").alias("a"), F.explode("linked").alias("b"))
    copies = (placed.select("region", "id", "home", "ball", F.explode(F.arrays_zip("places", "distances")).alias("at"))
              .select("region", "id", F.col("at.places").alias("place"), F.col("at.distances").alias("d"), (F.col("home") == F.col("at.places")).alias("resident"), "ball"))
    copies = copies.withColumn("done", F.col("resident") & F.col("ball"))
    # The ball is linked by its pivot; it stays only for others that the triangle inequality lets link with it. Guests stay for residents.
    limits = copies.groupBy("region", "place").agg(F.min(F.when(~F.col("done"), F.col("d"))).alias("nearest"), F.max(F.when(F.col("resident"), F.col("d"))).alias("furthest"))
    copies = (copies.join(limits, ["region", "place"])
              .where(F.when(F.col("done"), F.col("d") >= F.col("nearest") - radius - 1e-9)
                     .otherwise(F.col("resident") | (F.col("d") <= F.col("furthest") + radius + 1e-9))).select("region", "id", "place"))
    copies = materialize(copies, "places")
    # A cut is taken if it leaves PAIRS of the pairs to compare; with eight pivots a member then has at most 2.4 copies on average.
    pairs = copies.groupBy("region", "place").agg(F.pow(F.count("*"), F.lit(2.0)).alias("pairs")).groupBy("region").agg(F.sum("pairs").alias("pairs"))
    stuck = sizes.join(pairs, "region").where(F.col("pairs") > PAIRS * F.pow("count", F.lit(2.0))).select("region")
    stuck = materialize(stuck, "stuck")
    smaller = (copies.join(stuck, "region", "left_anti").join(placed.select("region", "id", "tokens", "alone"), ["region", "id"])
               .select(F.xxhash64("region", F.lit(salt), "place").alias("region"), "id", "tokens", "alone"))
    return smaller, rows.join(stuck, "region", "left_semi"), links


def _join_large(rows: DataFrame, cap: int, block_bytes: int) -> DataFrame:
    """Links inside regions of (region, id, tokens) that are too large for a task: Voronoi regions, cut again until they fit; tiles for the rest."""
    rows = materialize(_lonely(rows), "large")
    links, tiled = [], []

    def join_fitting(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
        sizes = materialize(_sizes(rows), "sizes")
        fitting = rows.join(sizes.where(_fits(cap)), "region", "left_semi").select(F.col("region").alias("unit"), "id", "tokens")
        links.append(_join_units(fitting, block_bytes))
        return rows.join(sizes.where(~_fits(cap)), "region", "left_semi"), sizes.where(~_fits(cap))

    rows, sizes = join_fitting(rows)
    for salt in range(ROUNDS):
        if sizes.isEmpty():
            break
        smaller, stuck, to_pivots = _voronoi(rows, sizes, cap, salt)
        links.append(to_pivots)
        tiled.append(stuck)
        rows, sizes = join_fitting(materialize(smaller, "smaller"))
    tiled.append(rows)  # nothing, unless the rounds were used up
    for rest in tiled:
        if not rest.isEmpty():
            units, balls = _tiles(rest, cap)
            links += [balls, _join_units(materialize(units, "tiles"), block_bytes)]
    out = links[0]
    for more in links[1:]:
        out = out.unionByName(more)
    return out


def _tiles(rows: DataFrame, cap: int) -> tuple[DataFrame, DataFrame]:
    """(units, links) of regions that distances do not cut: bands around the member with the fewest lonely shingles, joined where bands are near.

    Two members with over a seventh of lonely shingles each never link, so bands of such members are not joined with each other.
    """
    lightest = F.struct(F.col("alone") / F.octet_length("tokens"), -F.octet_length("tokens"), "id")
    pivots = rows.groupBy("region").agg(F.min_by(F.struct(F.col("id").alias("pivot"), F.col("tokens").alias("centre")), lightest).alias("p"))

    def measure(batches):
        for batch in batches:
            both = pa.Table.from_batches([batch])
            own, first = _sets(both)
            centre, begin = _sets(both.select(["centre"]).rename_columns(["tokens"]))
            bins = []
            for i in range(batch.num_rows):
                x, p = own[first[i]:first[i + 1]], centre[begin[i]:begin[i + 1]]
                shared = len(np.intersect1d(x, p, assume_unique=True))
                union = len(x) + len(p) - shared
                # Band 0 is the ball; the others are distance ranges of 1 / BINS.
                bins.append(0 if NEAR[1] * shared >= NEAR[0] * union else 1 + min(BINS - 1, int((1 - shared / union) * BINS)))
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in ("region", "id", "tokens", "alone", "pivot")], pa.array(bins, pa.int32())],
                                             names=["region", "id", "tokens", "alone", "pivot", "bin"])

    banded = (rows.join(pivots, "region").select("region", "id", "tokens", "alone", F.col("p.pivot").alias("pivot"), F.col("p.centre").alias("centre"))
              .mapInArrow(measure, "region long, id long, tokens binary, alone long, pivot long, bin int"))
    # shared / (n + m - shared) >= a / b needs (a + b) * shared >= a * (n + m); for a pair of equals that leaves (b - a) / (a + b) lonely.
    heavy = F.col("alone") * (NEAR[0] + NEAR[1]) > F.octet_length("tokens") / 8 * (NEAR[1] - NEAR[0])
    banded = materialize(banded.withColumn("heavy", heavy), "bands")
    links = banded.where("bin = 0 and id <> pivot").select(F.col("id").alias("a"), F.col("pivot").alias("b"))
    chunks = banded.groupBy("region", "bin", "heavy").agg(
        F.ceil(F.greatest(F.count("*") / (cap / 2), F.sum(F.octet_length("tokens")) / (REGION_BYTES / 2))).cast("int").alias("chunks"))
    # A member of distance range [lo, hi) can link into ranges that come within the radius; ball with ball is done.
    reach = 1 + BINS * (NEAR[1] - NEAR[0]) // NEAR[1]
    lo = BINS * (NEAR[1] - NEAR[0]) // NEAR[1]  # band 1 + lo is the first beyond the ball
    other = chunks.select("region", F.col("bin").alias("bin2"), F.col("heavy").alias("heavy2"), F.col("chunks").alias("chunks2"))
    near = ~(F.col("heavy") & F.col("heavy2")) & ((F.col("bin") != 0) | (F.col("bin2") != 0)) & (
        F.when(F.col("bin") == 0, F.col("bin2") <= lo + 1 + reach).when(F.col("bin2") == 0, F.col("bin") <= lo + 1 + reach)
        .otherwise(F.abs(F.col("bin") - F.col("bin2")) <= reach))
    plan = chunks.join(other, "region").where(near)  # at most (2 * BINS + 2) ** 2 rows for a region
    own = F.pmod(F.xxhash64("id"), F.col("chunks"))
    units = (banded.join(plan, ["region", "bin", "heavy"])
             .withColumns({"own": own, "theirs": F.explode(F.sequence(F.lit(0), F.col("chunks2") - 1))})
             .withColumns({"x": F.struct("bin", "heavy", "own"), "y": F.struct(F.col("bin2").alias("bin"), F.col("heavy2").alias("heavy"), F.col("theirs").cast("bigint").alias("own"))})
             .select(F.xxhash64("region", F.least("x", "y"), F.greatest("x", "y")).alias("unit"), "id", "tokens").distinct())
    return units, links


def components(links: DataFrame) -> DataFrame:
    """(node, root): the smallest node of each node's component, by alternating large-star and small-star steps."""
    edges = materialize(links.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "edges")
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        large = materialize(large, "large-star")
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = (large.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
                 .unionByName(low.select("u", F.col("m").alias("v"))).where("u <> v")
                 .select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
        small = materialize(small, "small-star")
        changed = small.join(edges, ["u", "v"], "left_anti").limit(1).count() or edges.join(small, ["u", "v"], "left_anti").limit(1).count()
        edges = small
        if not changed:
            return edges.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("root"))


def join_components(docs: DataFrame, key_col: str = "doc_id", text_col: str = "text", words: int = WORDS,
                    region_cap: int = REGION_CAP, block_bytes: int = BLOCK_BYTES[0]) -> DataFrame:
    """(key, n_shingles, component_id) of every document."""
    found = materialize(_shingled(docs, key_col, text_col, words), "shingles")
    members = materialize(_regions(found.where("tokens is not null"), block_bytes), "regions")
    sizes = _sizes(members).where("count > 1")
    small = members.join(sizes.where(_fits(region_cap)), "region", "left_semi").select(F.col("region").alias("unit"), "id", "tokens")
    links = _join_units(small, block_bytes)
    large = members.join(sizes.where(~_fits(region_cap)), "region", "left_semi")
    if not large.isEmpty():
        links = links.unionByName(_join_large(large, region_cap, block_bytes))
    roots = components(links)
    classes = found.where("n > 0 and key is not null").groupBy("d1", "d2", "n").agg(F.min("key").alias("class"))
    classes = classes.join(roots, F.col("class") == F.col("node"), "left").select("d1", "d2", "n", F.coalesce("root", "class").alias("component"))
    own = found.select(F.col("key").alias(key_col), F.col("n").alias("n_shingles"), "d1", "d2", "n")
    return (own.join(classes, ["d1", "d2", "n"], "left")
            .select(f"`{key_col}`", "n_shingles", F.when(F.col(f"`{key_col}`").isNotNull(), F.coalesce("component", F.col(f"`{key_col}`"))).alias("component_id")))


def keep_first(docs: DataFrame, key_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """One row of each component stays: the one with the smallest key, null keys last, of equal keys the first row.

    Rows are numbered in a written copy and joined and kept by that number, so repeated or null keys neither save a copy nor drop another row.
    """
    numbered = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc"), F.monotonically_increasing_id().alias("row"))
    path = scratch_path(docs.sparkSession, "numbered")
    numbered.write.option("compression", "zstd").parquet(path)  # the one copy of the texts; a quarter smaller than by the default codec
    numbered = docs.sparkSession.read.schema(numbered.schema).parquet(path)
    texts = numbered.select("row", F.col("doc").getField(text_col).alias("text"))
    groups = join_components(texts, "row", "text", **options).select("row", "component_id")
    place = F.struct(F.col("key").isNull(), "key", "row")
    first = (groups.join(numbered.select("row", F.col("doc").getField(key_col).alias("key")), "row").groupBy("component_id").agg(F.min(place).alias("first"))
             .select(F.col("first.row").alias("row")))
    return numbered.join(first, "row", "left_semi").select("doc.*")
