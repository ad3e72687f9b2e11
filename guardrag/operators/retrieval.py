"""Exact cosine top-k retrieval.

Single query (R5): a projection scoring every chunk with the R1 expression and an
ordered ``limit`` — Spark plans it as ``TakeOrderedAndProject``.

Batch of queries (R6): every (query, chunk) pair must be scored, but no pair is
ever materialised as a row. Chunks and queries meet in bounded *cells*; inside a
cell NumPy scores a tile of chunks against a tile of queries, keeps a candidate
superset of each query's top-k (``TopK``), rescores those candidates with the exact R1
arithmetic (float32 products summed left to right in double) and emits at most
``k`` rows per query. A final ``row_number`` window over ``query_id`` (with a
partial ``WindowGroupLimit`` before its shuffle) merges the cells. Results equal
the R5 expression bit for bit, with ties broken by ``chunk_id`` and NaN last.

Two physical strategies share the cell kernel:

* ``broadcast`` — when the query block's size is proven small (count × dim,
  checked against ``broadcast_query_bytes``) it is broadcast and the chunk table
  is scanned in place with ``mapInArrow``: chunks are never shuffled.
* ``rounds`` — a larger query set is hash-split into blocks under the bound that
  are broadcast one after another, each round scanning the store in place and
  writing its candidates; the store is re-read per round but never shuffled.
* ``blocked`` — queries are hashed into ``nqb`` blocks and chunks into ``ncb``
  blocks; each side is replicated to the cells it takes part in and
  ``cogroup(...).applyInArrow`` scores one cell per task. Cell size is bounded by
  ``chunk_block_rows`` × ``query_block_rows`` whatever the table sizes. Chosen
  over ``rounds`` when its estimated shuffle bytes are lower (small stores).

For large stores both run after a probe pass over a sample of the store that
gives every query a lower bound on its final k-th score (see ``topk_batch``),
so scan tasks emit only rows that can still be in the answer.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import cached_property

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from guardrag.config import RetrievalOptions
from guardrag.functions.similarity import DOUBLE_EPSILON, cosine
from guardrag.session import materialize, track, write_scratch

# Candidate slack for the approximate pass: for regular vectors (``_regular``) the exact and
# approximate cosine differ by at most ~2**-23; anything within this distance of the k-th best is kept.
APPROX_TOLERANCE = 1e-5
# Upper bound on float32 entries in one score tile (1 MiB, about a core's share of the cache while all cores are busy).
MAX_TILE_ENTRIES = 1 << 18
# Largest query block that may be broadcast (bytes of vectors and ids).
DEFAULT_BROADCAST_QUERY_BYTES = 64 << 20


# ---------------------------------------------------------------------------
# Single query
# ---------------------------------------------------------------------------


def rank_order(score: str = "score", chunk_id: str = "chunk_id") -> list[Column]:
    """Score descending with NaN last (R8), then chunk id ascending."""
    return [F.isnan(F.col(score)).asc(), F.col(score).desc(), F.col(chunk_id).asc()]


def search(chunks: DataFrame, query_vector: list[float], k: int, vector_col: str = "embedding",
           chunk_id: str = "chunk_id") -> DataFrame:
    """Top-k chunks for one query vector, as ``chunks`` columns plus ``score`` and ``rank``.

    An empty/null query vector is an error (R3); so is a store whose dimension
    differs from the query's, checked row-wise so that an empty store returns
    nothing instead of failing.
    """
    if query_vector is None or len(query_vector) == 0:
        raise ValueError("a question vector is missing or has no entries")
    dim = len(query_vector)
    q = F.array(*[F.lit(float(x)) for x in query_vector]).cast("array<float>")
    checked = F.when(
        F.size(F.col(vector_col)) == F.lit(dim), F.col(vector_col)
    ).otherwise(
        F.raise_error(F.concat(F.lit("stored vectors have "), F.size(F.col(vector_col)).cast("string"),
                               F.lit(f" entries, the question vector {dim}")))
    )
    scored = chunks.withColumn("score", cosine(checked, q))
    if k <= 0:  # R4
        return scored.withColumn("rank", F.lit(1)).limit(0)
    top = scored.orderBy(*rank_order("score", chunk_id)).limit(k)
    return top.withColumn("rank", F.row_number().over(Window.orderBy(*rank_order("score", chunk_id))))


def split_questions(queries: DataFrame, dim: int | None, query_vector: str = "embedding") -> tuple[DataFrame, DataFrame]:
    """R3 without an error: the questions that fit a store of ``dim`` entries a vector, and the others with a ``reason``.

    A missing vector, or one without entries, is ``empty_vector``; another length is ``dimension_mismatch``. Of an empty
    store (``dim`` is None) any length will do. One row-local pass; no row is lost.
    """
    size = F.coalesce(F.size(query_vector), F.lit(0))
    reason = F.when(size <= 0, F.lit("empty_vector"))
    if dim is not None:
        reason = reason.when(size != F.lit(dim), F.lit("dimension_mismatch"))
    return queries.where(reason.isNull()), queries.withColumn("reason", reason).where("reason is not null")


# ---------------------------------------------------------------------------
# Cell kernel (NumPy, runs inside tasks)
# ---------------------------------------------------------------------------


def _matrix(list_col: pa.ChunkedArray | pa.Array, n: int) -> np.ndarray:
    """Fixed-width list<float> column → (n, d) float32 matrix without per-row Python."""
    if isinstance(list_col, pa.ChunkedArray):
        list_col = list_col.combine_chunks()
    if n == 0:
        return np.zeros((0, 0), dtype=np.float32)
    offsets = list_col.offsets.to_numpy()
    widths = np.diff(offsets)
    d = int(widths[0])
    if not np.all(widths == d):
        raise ValueError("vectors of one block differ in length")
    flat = list_col.values.slice(offsets[0], offsets[-1] - offsets[0])
    vals = pc.fill_null(flat, float("nan")).to_numpy(zero_copy_only=False).astype(np.float32, copy=False)
    return vals.reshape(n, d)


def _squared_norms(m: np.ndarray) -> np.ndarray:
    if m.shape[1] == 0:
        return np.zeros(m.shape[0])
    return np.cumsum(m * m, axis=1, dtype=np.float64)[:, -1]


def exact_cosine(a: np.ndarray, b: np.ndarray, a2: np.ndarray, b2: np.ndarray) -> np.ndarray:
    """Row-wise cosine with the R1 arithmetic: float32 products, left-to-right double sum."""
    if a.shape[0] == 0:
        return np.zeros(0, dtype=np.float32)
    dot = np.cumsum(a * b, axis=1, dtype=np.float64)[:, -1]
    zero = (a2 <= DOUBLE_EPSILON) | (b2 <= DOUBLE_EPSILON)
    with np.errstate(divide="ignore", invalid="ignore"):
        s = dot / (np.sqrt(a2) * np.sqrt(b2))
    return np.where(zero, 0.0, s).astype(np.float32)


def _select_topk(q_idx: np.ndarray, scores: np.ndarray, chunk_ids: np.ndarray, k: int) -> np.ndarray:
    """Positions of each query's top-k under (NaN last, score desc, chunk id asc)."""
    if len(q_idx) == 0:
        return np.zeros(0, dtype=np.int64)
    # Python str order is code-point order, the same as Spark's UTF-8 binary order.
    _, id_rank = np.unique(np.asarray(chunk_ids), return_inverse=True)
    order = np.lexsort((id_rank.ravel(), -np.nan_to_num(scores.astype(np.float64), nan=0.0), np.isnan(scores), q_idx))
    q_sorted = q_idx[order]
    starts = np.r_[0, np.flatnonzero(q_sorted[1:] != q_sorted[:-1]) + 1]
    group_start = np.repeat(starts, np.diff(np.r_[starts, len(q_sorted)]))
    rank = np.arange(len(q_sorted)) - group_start
    return order[rank < k]


def _regular(norms: np.ndarray, dim: int) -> np.ndarray:
    """Rows whose float32 products with other such rows can neither underflow nor overflow.

    Rows of norm 0 by the exact rule score exactly 0 in the approximate pass too.
    """
    return ((norms > dim * 2.0**-100) & (norms < 2.0**120)) | (norms <= DOUBLE_EPSILON)


class QueryBlock:
    """A block of question vectors with what every batch of chunks needs of it, computed once.

    Kinds of rows, on both sides: zero ones score 0 with all; strange ones (with NaN or infinity) score NaN with all but zero ones; plain and tiny
    ones are compared by their unit vectors first; pairs with a huge row, or of two tiny ones, by the exact rule alone.
    """

    def __init__(self, matrix: np.ndarray, bounds: np.ndarray | None = None):
        self.matrix, self.bounds = matrix, bounds
        self.norms = _squared_norms(matrix)
        self.kind, self.scale = _kinds(matrix, self.norms)
        self.unit = np.empty(matrix.shape, np.float32)
        for s in range(0, len(matrix), 4096):  # the scaling is done in double precision
            self.unit[s:s + 4096] = _unit(matrix[s:s + 4096], self.scale[s:s + 4096])

    @cached_property
    def counts(self) -> np.ndarray:
        return _counts(self.matrix)


_ZERO, _PLAIN, _TINY, _HUGE, _STRANGE = range(5)
# Chunks of a tile, and pairs found in tiles that wait for their exact score. Both are small, so that floors rise early.
TILE_ROWS, MAX_PENDING = 512, 1 << 14
# Ids kept by a task beyond those of its candidates.
MAX_IDS = 1 << 20

# Whole products of five chunks with a question fit the 52 bits of a double: a lane of 10 bits a chunk (``_meet_counts``).
LANES, LANE_BITS = 5, 10
# What a lane holds of a pair at its floor, so that the lane's highest bit is set from there on; that bit in all lanes.
LANE_HALF = 1 << LANE_BITS - 1
LANE_FLAGS = sum(LANE_HALF << LANE_BITS * lane for lane in range(LANES))
# Tiles of packed products: rows of ``LANES`` chunks, questions. Entries up to ``MAX_COUNT`` have exact float32 products.
PACKED_ROWS, PACKED_QUESTIONS, MAX_COUNT = 128, 1024, 1 << 12
# Rows of a batch that are ranked first while most questions have no floor yet.
FIRST_ROWS = 1024


def _kinds(m: np.ndarray, norms: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(kind of every row, factor to a unit vector)."""
    kind = np.full(len(m), _HUGE, np.int8)
    kind[norms <= m.shape[1] * 2.0**-100] = _TINY
    kind[_regular(norms, m.shape[1])] = _PLAIN
    kind[norms <= DOUBLE_EPSILON] = _ZERO
    odd = np.flatnonzero(kind == _HUGE)
    kind[odd[~np.isfinite(m[odd]).all(axis=1)]] = _STRANGE
    with np.errstate(divide="ignore", invalid="ignore"):
        scale = np.where((kind == _PLAIN) | (kind == _TINY), 1.0 / np.sqrt(norms), 0.0)
    return kind, scale


def _unit(m: np.ndarray, scale: np.ndarray) -> np.ndarray:
    return (np.where(scale[:, None] > 0, m, 0) * scale[:, None]).astype(np.float32)


def _counts(m: np.ndarray) -> np.ndarray:
    """Rows of whole numbers from 0 to ``MAX_COUNT``, such as token counts: their products and sums are exact."""
    with np.errstate(invalid="ignore"):
        return ((m >= 0) & (m <= MAX_COUNT) & (m == np.rint(m))).all(axis=1)


def _id_ranks(ids: pa.Array) -> np.ndarray:
    """Place of every id in the order of the ranking (nulls first, strings by UTF-8 bytes as in Spark)."""
    ranks = np.empty(len(ids), np.int64)
    ranks[pc.sort_indices(ids, null_placement="at_start").to_numpy()] = np.arange(len(ids))
    return ranks


def _descending(score: np.ndarray) -> np.ndarray:
    """Unsigned 32-bit keys that sort as scores from the highest to the lowest, NaN last."""
    bits = (score + np.float32(0)).view(np.uint32)  # -0 counts as 0
    up = np.where(bits >> 31 != 0, ~bits, bits | np.uint32(1 << 31))
    return np.where(np.isnan(score), np.uint32(0xFFFFFFFF), ~up).astype(np.uint64)


class TopK:
    """The exact top-k of every question of a block over batches of chunks, in memory bounded by the block.

    Every question has a floor: its k-th best exact score so far, or its bound if that is higher. A tile of float32 dot products of unit vectors
    leaves the pairs that may reach the floor (its rounding is bounded by the vectors' length); those alone get their exact score. Of chunks
    with equal vectors, which score alike for every question, the k smallest ids of a batch are enough. No more than k pairs are held a question.
    """

    def __init__(self, block: QueryBlock, k: int, tile_entries: int = MAX_TILE_ENTRIES):
        self.block, self.k, self.tile = block, k, tile_entries
        n, dim = block.matrix.shape
        self.floor = np.full(n, -np.inf, np.float32) if block.bounds is None else block.bounds.astype(np.float32)
        self.scores, self.at = np.full((n, k), -np.inf, np.float32), np.full((n, k), -1, np.int64)
        self.ids: pa.Array | None = None
        # Rounding of a float32 dot product of unit vectors; a tiny vector's norm by the rule leaves out squares that underflow.
        self.slack = max(APPROX_TOLERANCE, 2 * (dim + 16) * 2.0**-24)
        self.tiny_slack = self.slack * (2 + math.sqrt(dim))

    def add(self, c_mat: np.ndarray, ids: pa.Array, only: np.ndarray | None = None) -> None:
        """Rank a batch of chunks for all questions, or for some (``only``: their positions, ascending)."""
        asked = np.arange(len(self.block.matrix)) if only is None else only
        if not len(asked) or not len(c_mat) or self.k <= 0:
            return
        if self.block.matrix.shape[1] != c_mat.shape[1]:
            raise ValueError(f"stored vectors have {c_mat.shape[1]} entries, question vectors {self.block.matrix.shape[1]}")
        if len(c_mat) > FIRST_ROWS and (np.isneginf(self.floor[asked]) & (self.block.kind[asked] == _PLAIN)).mean() > 0.5:
            self.add(c_mat[:FIRST_ROWS], ids[:FIRST_ROWS], only)
            c_mat, ids = c_mat[FIRST_ROWS:], ids[FIRST_ROWS:]
        norms = _squared_norms(c_mat)
        kind, scale = _kinds(c_mat, norms)
        ranks = _id_ranks(ids)
        rows = self._enough(c_mat, kind, ranks)
        rows = rows[np.argsort(ranks[rows])]  # by id, so that the first k of a kind are the smallest
        start = 0 if self.ids is None else len(self.ids)
        taken = ids.take(pa.array(rows))
        self.ids = taken if self.ids is None else pa.concat_arrays([self.ids, taken])
        c_mat, norms, kind, scale = c_mat[rows], norms[rows], kind[rows], scale[rows]
        asks, of = {x: asked[self.block.kind[asked] == x] for x in range(5)}, {x: np.flatnonzero(kind == x) for x in range(5)}
        fast = np.concatenate([asks[_PLAIN], asks[_TINY]])

        def constant(questions: np.ndarray, chunks: np.ndarray, score: float) -> None:
            chunks = chunks[:self.k]
            self._offer(np.repeat(questions, len(chunks)), start + np.tile(chunks, len(questions)), np.full(len(questions) * len(chunks), score, np.float32))

        pairs = max(1, min(self.tile, MAX_TILE_ENTRIES) // (8 * c_mat.shape[1]))

        def exact(q: np.ndarray, c: np.ndarray) -> None:
            slices = [slice(s, s + pairs) for s in range(0, len(q), pairs)]
            score = [exact_cosine(c_mat[c[x]], self.block.matrix[q[x]], norms[c[x]], self.block.norms[q[x]]) for x in slices]
            self._offer(q, start + c, np.concatenate(score))

        common = np.flatnonzero((kind == _PLAIN) | (kind == _ZERO))
        met = self._meet_counts(asks[_PLAIN], common, c_mat, norms, scale, exact, start)
        self._meet(np.setdiff1d(fast, met) if len(met) else fast, common, c_mat, scale, exact, self.tiny_slack if len(asks[_TINY]) else self.slack)
        self._meet(asks[_PLAIN], of[_TINY], c_mat, scale, exact, self.tiny_slack)
        for q, c in ((asks[_TINY], of[_TINY]), (fast, of[_HUGE]), (asks[_HUGE], np.flatnonzero(kind != _STRANGE))):
            for s in range(0, len(q) * len(c), pairs):
                at = np.arange(s, min(s + pairs, len(q) * len(c)))
                exact(q[at // len(c)], c[at % len(c)])
        constant(asks[_ZERO], np.arange(len(c_mat)), 0.0)
        constant(asks[_STRANGE], of[_ZERO], 0.0)
        constant(asks[_STRANGE], np.flatnonzero(kind != _ZERO), np.nan)
        open_ = np.concatenate([fast, asks[_HUGE]])
        constant(open_[np.isneginf(self.floor[open_])], of[_STRANGE], np.nan)
        if len(self.ids) > MAX_IDS:
            self._forget()

    def _enough(self, c_mat: np.ndarray, kind: np.ndarray, ranks: np.ndarray) -> np.ndarray:
        """Rows without those that have k equal vectors of smaller ids (all zero ones are equal, and all strange ones)."""
        bits = np.ascontiguousarray(c_mat).view(np.uint32).copy()
        bits[kind == _ZERO], bits[kind == _STRANGE] = 0, 0xFFFFFFFF
        with np.errstate(over="ignore"):
            key = (bits * np.random.default_rng(1).integers(1, 1 << 62, bits.shape[1], dtype=np.uint64)).sum(axis=1)
        order = np.lexsort((ranks, key))
        starts = np.flatnonzero(np.r_[True, key[order][1:] != key[order][:-1]])
        group = np.repeat(np.arange(len(starts)), np.diff(np.r_[starts, len(order)]))
        place = np.arange(len(order)) - starts[group]
        if place.max() < self.k:
            return order
        equal = (bits[order] == bits[order[starts]][group]).all(axis=1)
        alike = np.logical_and.reduceat(equal, starts)  # a key that different vectors share tells nothing
        return order[(place < self.k) | ~alike[group]]

    def _meet_counts(self, q: np.ndarray, c: np.ndarray, c_mat: np.ndarray, norms: np.ndarray, scale: np.ndarray, exact, start: int) -> np.ndarray:
        """``_meet`` for vectors of whole numbers with a fifth of the multiplications; returns the questions it settled, the others are left to ``_meet``.

        A dot product of such vectors is a whole number, and a pair reaches its floor from a whole number on: the floor times both lengths, rounded up. A lane
        holds the product less a ``least`` below that, plus ``LANE_HALF``. It is never negative and below 2 ** LANE_BITS, so lanes do not touch, all sums on
        the way are whole numbers below 2 ** 53, exact in any order, and a lane's highest bit tells whether its pair may reach the floor; the lane then
        holds the exact product. ``least`` is a part for the question (at the tile's shortest chunk) and one for the chunk (at the least of the
        questions of a slice), so questions and chunks are sorted by what they bring. Tiles whose products need more bits go to ``_meet``.
        """
        dim = c_mat.shape[1]
        q = q[self.block.counts[q] & (self.floor[q] > self.slack)]
        plus = c[_counts(c_mat[c])]
        if len(q) < 64 or len(plus) < LANES * 16:
            return q[:0]
        others = np.setdiff1d(c, plus)
        self._meet(q, others, c_mat, scale, exact, self.slack)
        plus = plus[norms[plus] > 0]  # zero vectors score 0, below these floors
        plus = plus[np.argsort(norms[plus], kind="stable")]
        length = np.sqrt(norms[plus])
        rows = -(-len(plus) // (8 * LANES)) * 8
        packed, skips = np.zeros((rows, dim + 2)), np.zeros((rows, LANES))
        for lane in range(LANES):
            of = plus[lane::LANES]
            packed[:len(of), :dim] += c_mat[of] * float(1 << LANE_BITS * lane)
            packed[:, dim + 1] += float(1 << LANE_BITS * lane)
        tiles = [slice(at, min(at + PACKED_ROWS, rows)) for at in range(0, rows, PACKED_ROWS)]
        tiles = [x for x in tiles if x.start * LANES < len(plus)]
        shortest = np.array([length[x.start * LANES] for x in tiles])
        longest = np.array([length[min(x.stop * LANES, len(plus)) - 1] for x in tiles])
        over = np.zeros(rows * LANES)  # by how much a chunk is longer than the shortest of its tile
        over[:len(plus)] = length - np.repeat(shortest, [min(x.stop * LANES, len(plus)) - x.start * LANES for x in tiles])
        over = over.reshape(rows, LANES)
        weights = 2.0 ** (LANE_BITS * np.arange(LANES))

        reach = (self.floor[q].astype(np.float64) - self.slack) * np.sqrt(self.block.norms[q])
        order = np.argsort(reach, kind="stable")
        q, reach = q[order], reach[order]
        room = np.empty(PACKED_ROWS * PACKED_QUESTIONS)
        left: dict[tuple[int, ...], list[np.ndarray]] = {}
        pending: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []

        def flush() -> None:
            if pending:
                self._offer(*map(np.concatenate, zip(*pending)))
                pending.clear()

        for s in range(0, len(q), PACKED_QUESTIONS):
            own, need = q[s:s + PACKED_QUESTIONS], reach[s:s + PACKED_QUESTIONS]
            most = math.sqrt(self.block.norms[own].max())
            fits = (np.ceil(need[-1] * longest) + 1 <= LANE_HALF) & (most * longest - need[0] * shortest + 1 < LANE_HALF)
            if not fits.all():
                left.setdefault(tuple(np.flatnonzero(~fits)), []).append(own)
            skips[:] = np.floor(need[0] * over)
            packed[:, dim] = 2.0**52 - skips @ weights  # the bits of the double below its exponent are then those of the sum
            asked = np.empty((len(own), dim + 2))
            asked[:, :dim], asked[:, dim] = self.block.matrix[own], 1
            near: list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]] = []
            for t in np.flatnonzero(fits):
                part = packed[tiles[t]]
                least = np.ceil(need * shortest[t])
                asked[:, dim + 1] = LANE_HALF - least
                sums = room[:len(part) * len(own)].reshape(len(part), len(own))
                np.matmul(part, asked.T, out=sums)
                # The flags of eight rows in one: few cells are left, and only these are looked at row by row.
                bits = sums.view(np.int64).reshape(8, -1)
                cells = np.flatnonzero((np.bitwise_or.reduce(bits, axis=0) & LANE_FLAGS) != 0)
                if len(cells):
                    held = bits.take(cells, axis=1).ravel()
                    hit = np.flatnonzero((held & LANE_FLAGS) != 0)
                    line, x = np.divmod(hit, len(cells))
                    row, col = np.divmod(cells[x], len(own))
                    near.append((held[hit], row + line * (len(part) // 8) + tiles[t].start, col, least[col]))
            if near:
                held, row, col, least = map(np.concatenate, zip(*near))
                for lane in range(LANES):
                    value = (held >> LANE_BITS * lane) & ((1 << LANE_BITS) - 1)
                    x = np.flatnonzero(value >= LANE_HALF)
                    of, asks = plus[row[x] * LANES + lane], own[col[x]]
                    dot = value[x] - LANE_HALF + least[x] + skips[row[x], lane]
                    pending.append((asks, start + of, (dot / (np.sqrt(norms[of]) * np.sqrt(self.block.norms[asks]))).astype(np.float32)))
                if sum(len(x[0]) for x in pending) >= MAX_PENDING:
                    flush()
        flush()
        for some, asks in left.items():
            rest = np.concatenate([plus[tiles[t].start * LANES:tiles[t].stop * LANES] for t in some])
            self._meet(np.sort(np.concatenate(asks)), np.sort(rest), c_mat, scale, exact, self.slack)
        return q

    def _meet(self, q: np.ndarray, c: np.ndarray, c_mat: np.ndarray, scale: np.ndarray, exact, slack: float) -> None:
        """Offer the pairs whose approximate score may reach the floor, found in tiles and scored some thousands at a time."""
        if not len(q):
            return
        pending: list[tuple[np.ndarray, np.ndarray]] = []
        waiting = 0
        every = np.array_equal(q, np.arange(len(self.block.unit)))
        room = np.empty(min(TILE_ROWS * len(q), max(TILE_ROWS, self.tile)), np.float32)  # one tile's memory for all

        def flush() -> None:
            if pending:
                exact(*map(np.concatenate, zip(*pending)))
                pending.clear()

        for at in range(0, len(c), TILE_ROWS):
            part = c[at:at + TILE_ROWS]
            unit = _unit(c_mat[part], scale[part])
            step = max(1, self.tile // len(part))
            for s in range(0, len(q), step):
                own = q[s:s + step]
                # A column a question: the greatest of every column is then found row by row, in long runs.
                sc = room[:len(part) * len(own)].reshape(len(part), len(own))
                np.matmul(unit, (self.block.unit[s:s + step] if every else self.block.unit[own]).T, out=sc)
                low = self.floor[own] - np.float32(slack)
                free = np.flatnonzero(np.isneginf(low))
                if len(free) and len(part) > self.k:
                    low[free] = np.partition(sc[:, free], len(part) - self.k, axis=0)[len(part) - self.k] - np.float32(slack)
                some = np.flatnonzero(sc.max(axis=0) >= low)
                most = max(1, MAX_TILE_ENTRIES // (4 * len(part)))
                for x in range(0, len(some), most):
                    near = some[x:x + most]
                    qi, ci = np.divmod(np.flatnonzero(sc.T[near] >= low[near, None]), len(part))
                    for y in range(0, len(qi), MAX_PENDING):
                        pending.append((own[near[qi[y:y + MAX_PENDING]]], part[ci[y:y + MAX_PENDING]]))
                        waiting += len(pending[-1][0])
                        if waiting >= MAX_PENDING:
                            flush()
                            waiting = 0
        flush()

    def _offer(self, q: np.ndarray, at: np.ndarray, score: np.ndarray) -> None:
        """Merge pairs into the held ones and raise the floors."""
        ok = np.isneginf(self.floor[q]) | (score >= self.floor[q])
        q, at, score = q[ok], at[ok], score[ok]
        if not len(q):
            return
        met = np.unique(q)
        old = self.at[met] >= 0
        q = np.concatenate([np.repeat(met, old.sum(axis=1)), q])
        at, score = np.concatenate([self.at[met][old], at]), np.concatenate([self.scores[met][old], score])
        key = q.astype(np.uint64) << np.uint64(32) | _descending(score)
        order = np.argsort(key)
        tied = key[order][1:] == key[order][:-1]
        if tied.any():  # ids are compared only for them
            tied = np.unique(np.r_[np.flatnonzero(tied), np.flatnonzero(tied) + 1])
            seen, place = np.unique(at[order[tied]], return_inverse=True)
            rank = _id_ranks(self.ids.take(pa.array(seen)))[place.ravel()]
            order[tied] = order[tied][np.lexsort((rank, key[order[tied]]))]
        q, at, score = q[order], at[order], score[order]
        starts = np.flatnonzero(np.r_[True, q[1:] != q[:-1]])
        column = np.arange(len(q)) - np.repeat(starts, np.diff(np.r_[starts, len(q)]))
        top = column < self.k
        self.scores[q[top], column[top]], self.at[q[top], column[top]] = score[top], at[top]
        last = self.scores[met, -1]
        full = (self.at[met, -1] >= 0) & ~np.isnan(last)
        self.floor[met[full]] = np.maximum(self.floor[met[full]], last[full])

    def _forget(self) -> None:
        """Keep the ids of held pairs alone."""
        used = np.unique(self.at[self.at >= 0])
        self.ids = self.ids.take(pa.array(used))
        self.at[self.at >= 0] = np.searchsorted(used, self.at[self.at >= 0])

    def result(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(question, position in ``ids``, score) of the held pairs."""
        q, column = np.nonzero(self.at >= 0)
        return q, self.at[q, column], self.scores[q, column]

    def batches(self, schema: pa.Schema, q_ids: pa.Table, query_id: str, rows: int = 1 << 16) -> Iterator[pa.RecordBatch]:
        """The held pairs as rows (question, chunk id, score)."""
        qi, at, score = self.result()
        for s in range(0, len(qi), rows):
            found = q_ids.column(query_id).take(pa.array(qi[s:s + rows])).combine_chunks()
            yield pa.RecordBatch.from_arrays([found, self.ids.take(pa.array(at[s:s + rows])), pa.array(score[s:s + rows], pa.float32())], schema=schema)


def score_cell(q_mat: np.ndarray | QueryBlock, c_mat: np.ndarray, chunk_ids: np.ndarray, k: int,
               tile_entries: int = MAX_TILE_ENTRIES,
               bounds: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Exact top-k of every query against the chunks of one cell.

    Returns (query index, chunk index, exact float32 score), at most k rows per query.
    ``bounds`` (one float per query, ``-inf`` for none) is a proven lower bound on
    each query's final k-th score: rows scoring below it can never be in the
    answer and are not emitted.
    """
    if not len(c_mat) or k <= 0:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.float32)
    block = q_mat if isinstance(q_mat, QueryBlock) else QueryBlock(q_mat, bounds)
    ids = pa.array(chunk_ids)
    ranks = _id_ranks(ids)
    top = TopK(block, k, tile_entries)
    top.add(c_mat, pa.array(ranks))
    if top.ids is None:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.float32)
    qi, at, score = top.result()
    return qi, np.argsort(ranks)[top.ids.to_numpy()[at]], score


# ---------------------------------------------------------------------------
# Batch top-k
# ---------------------------------------------------------------------------


def _empty_like(schema: T.StructType, spark) -> DataFrame:
    return spark.createDataFrame([], schema)


def _out_schema(chunks: DataFrame, queries: DataFrame, query_id: str, chunk_id: str,
                carry: list[str]) -> T.StructType:
    cf = {f.name: f for f in chunks.schema.fields}
    qf = {f.name: f for f in queries.schema.fields}
    fields = [T.StructField(query_id, qf[query_id].dataType, True),
              T.StructField(chunk_id, cf[chunk_id].dataType, True),
              T.StructField("score", T.FloatType(), True)]
    fields += [T.StructField(c, cf[c].dataType, True) for c in carry]
    return T.StructType(fields)


def _emit(schema: pa.Schema, q_tbl: pa.Table, c_tbl: pa.Table, qi, ci, sc, query_id, chunk_id, carry) -> pa.RecordBatch:
    cols = [q_tbl.column(query_id).take(pa.array(qi)), c_tbl.column(chunk_id).take(pa.array(ci)),
            pa.array(sc, type=pa.float32())]
    cols += [c_tbl.column(c).take(pa.array(ci)) for c in carry]
    cols = [c.combine_chunks() if isinstance(c, pa.ChunkedArray) else c for c in cols]
    return pa.RecordBatch.from_arrays(cols, schema=schema)


_ROW = "_question"


def topk_batch(chunks: DataFrame, queries: DataFrame, k: int, *, query_id: str = "query_id",
               query_vector: str = "embedding", chunk_id: str = "chunk_id", chunk_vector: str = "embedding",
               carry: list[str] | None = None, opts: RetrievalOptions = RetrievalOptions(),
               strategy: str = "auto", broadcast_query_bytes: int | None = None,
               probe_fraction: float | None = None, unique_ids: bool = False) -> DataFrame:
    """``(query_id, rank, chunk_id, score, *carry)`` — each query's exact top-k chunks.

    Every row of ``queries`` is ranked on its own: rows are keyed by an internal number, and
    the caller's id, null or repeated as it may be, is only carried along. With ``unique_ids``
    the caller vouches for unique, non-null long ids, which then serve as that number.

    Only ids and vectors take part in the scan; the ``carry`` columns are joined to the winning
    chunk ids afterwards. Chunk ids are the key of a store; should one repeat, its smallest row counts.

    Queries with an empty vector, or one whose dimension differs from the store's,
    raise (R3); ``k <= 0`` yields no rows (R4). Queries with no chunks get no rows;
    callers left-join to keep them.

    ``probe_fraction``: first rank every query against a Bernoulli sample of the
    store; each query's k-th score there is a lower bound on its final k-th score
    (a subset cannot beat the whole), so the full scan scores exactly, and emits, only rows at or above
    it. Results are unchanged; the merge shuffle shrinks from (tasks × queries × k)
    rows to about k / fraction rows per query. ``None`` turns it on for stores of
    ``PROBE_MIN_ROWS`` rows or more; ``0`` turns it off.
    """
    carry = [c for c in (carry or []) if c not in (chunk_id,)]
    if probe_fraction is None:
        probe_fraction = opts.probe_fraction
    if broadcast_query_bytes is None:
        broadcast_query_bytes = opts.broadcast_query_bytes
    spark = chunks.sparkSession
    final_schema = T.StructType([queries.schema[query_id], T.StructField("rank", T.IntegerType(), True),
                                 T.StructField(chunk_id, chunks.schema[chunk_id].dataType, True), T.StructField("score", T.FloatType(), True)]
                                + [T.StructField(c, chunks.schema[c].dataType, True) for c in carry])
    if k <= 0:
        return _empty_like(final_schema, spark)
    if unique_ids:
        q = queries.select(F.col(query_id).alias(_ROW), query_vector)
    else:
        # Written once: the numbers stay the same however often the block is read or a task retried.
        numbered = materialize(queries.select(query_id, query_vector).withColumn(_ROW, F.monotonically_increasing_id()), "topk-questions")
        q = numbered.select(_ROW, query_vector)
    out = _out_schema(chunks, q, _ROW, chunk_id, [])

    stats = q.agg(F.count(F.lit(1)).alias("n"), F.min(F.coalesce(F.size(query_vector), F.lit(-1))).alias("dmin"),
                  F.max(F.size(query_vector)).alias("dmax")).first()
    n_q, dmin, dmax = stats["n"], stats["dmin"], stats["dmax"]
    if n_q == 0:
        return _empty_like(final_schema, spark)
    if dmin is None or dmin <= 0:
        raise ValueError("a question vector is missing or has no entries")
    if dmin != dmax:
        raise ValueError(f"question vectors differ in length: {dmin} and {dmax}")
    c = chunks.select(chunk_id, chunk_vector)
    if probe_fraction is None:
        n_c = c.count()
        probe_fraction = math.sqrt(PROBE_COST * k / n_c) if n_c >= PROBE_MIN_ROWS else 0.0
    if probe_fraction and probe_fraction < 1.0:
        # Written once: every round reads the bounds, none ranks the probe again.
        q = materialize(_with_bounds(c, q, k, probe_fraction, _ROW, query_vector, chunk_id, chunk_vector, opts, strategy,
                                     broadcast_query_bytes), "topk-bounds")
    query_bytes = n_q * (dmax * 4 + 16)  # vectors, the 8-byte row number and the bound
    rounds = max(1, math.ceil(query_bytes / broadcast_query_bytes))
    if strategy == "auto":
        strategy = "broadcast" if rounds == 1 else _rounds_or_blocked(c, n_q, dmax, [], rounds, opts)
    if strategy == "broadcast":
        if rounds > 1:
            raise ValueError("query block exceeds the broadcast bound; use strategy='rounds' or 'blocked'")
        cand = _broadcast_cells(c, q, k, _ROW, query_vector, chunk_id, chunk_vector, [], out)
    elif strategy == "rounds":
        cand = _rounds_cells(c, q, k, rounds, _ROW, query_vector, chunk_id, chunk_vector, [], out)
    elif strategy == "blocked":
        cand = _blocked_cells(c, q, k, n_q, _ROW, query_vector, chunk_id, chunk_vector, [], out, opts)
    else:
        raise ValueError(f"unknown strategy {strategy!r}")
    w = Window.partitionBy(_ROW).orderBy(*rank_order("score", chunk_id))
    ranked = cand.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)
    if carry:
        # Winners are at most k rows per question; the store's other columns are read for them alone.
        ranked = materialize(ranked, "topk-ranked")
        size = ranked.agg(F.sum(F.octet_length(F.col(chunk_id).cast("string")) + 40)).first()[0] or 0
        if size <= BROADCAST_WINNERS_BYTES:
            won = F.broadcast(ranked.withColumnRenamed(chunk_id, "_won"))
            met = chunks.select(chunk_id, *carry).join(won, F.col(chunk_id).eqNullSafe(F.col("_won")))
            ranked = met.groupBy(_ROW, "rank", chunk_id, "score").agg(F.min(F.struct(*carry)).alias("_late"))
        else:
            late = (chunks.select(chunk_id, *carry).join(ranked.select(chunk_id).distinct(), chunk_id, "left_semi")
                    .groupBy(chunk_id).agg(F.min(F.struct(*carry)).alias("_late")))
            ranked = ranked.join(late, chunk_id, "left")
        ranked = ranked.select(_ROW, "rank", chunk_id, "score", *[F.col(f"_late.{x}").alias(x) for x in carry])
    if unique_ids:
        return ranked.select(F.col(_ROW).alias(query_id), "rank", chunk_id, "score", *carry)
    return ranked.join(numbered.select(_ROW, query_id), _ROW).select(query_id, "rank", chunk_id, "score", *carry)


# Largest table of winners (measured) that is broadcast to fetch the carried columns.
BROADCAST_WINNERS_BYTES = 32 << 20
PROBE_MIN_ROWS = 500_000
# Cost of a pair's exact score (about 1.5 µs) in pairs scored in a tile (about 2 ns each). A sample of share f saves k / f exact
# scores of a question at most and costs f * n tile scores, so the two are equal, and their sum is least, at sqrt(cost * k / n).
PROBE_COST = 750
PROBE_SEED = 20_241_202


def _with_bounds(c: DataFrame, q: DataFrame, k: int, fraction: float, query_id, query_vector, chunk_id, chunk_vector,
                 opts: RetrievalOptions, strategy: str, broadcast_query_bytes: int) -> DataFrame:
    """Adds ``_bound``: the query's exact k-th score over a sample of the store, or
    -inf when the sample holds fewer than k finite scores for it."""
    probe = c.select(chunk_id, chunk_vector).sample(withReplacement=False, fraction=fraction, seed=PROBE_SEED)
    # A task gives k rows a question, however few chunks it has: no more tasks than run at once.
    probe = probe.coalesce(max(1, c.sparkSession.sparkContext.defaultParallelism))
    ranked = topk_batch(probe, q, k, query_id=query_id, query_vector=query_vector, chunk_id=chunk_id,
                        chunk_vector=chunk_vector, opts=opts, strategy=strategy,
                        broadcast_query_bytes=broadcast_query_bytes, probe_fraction=0.0, unique_ids=True)
    kth = ranked.groupBy(query_id).agg(
        F.count(F.lit(1)).alias("_n"), F.max_by("score", "rank").alias("_kth"),
        F.max(F.isnan("score").cast("int")).alias("_nan"))
    bound = F.when((F.col("_n") == k) & (F.col("_nan") == 0), F.col("_kth")).otherwise(F.lit(float("-inf")))
    return q.join(kth.select(query_id, bound.cast("float").alias("_bound")), query_id, "left").withColumn(
        "_bound", F.coalesce(F.col("_bound"), F.lit(float("-inf")).cast("float")))


def _bounds_of(tbl: pa.Table) -> np.ndarray | None:
    if "_bound" not in tbl.column_names:
        return None
    return tbl.column("_bound").to_numpy(zero_copy_only=False).astype(np.float32)


def _broadcast_cells(c: DataFrame, q: DataFrame, k, query_id, query_vector, chunk_id, chunk_vector, carry,
                     out: T.StructType, return_broadcast: bool = False):
    spark = c.sparkSession
    q_tbl = q.toArrow()  # size-checked by the caller
    q_mat = _matrix(q_tbl.column(query_vector), q_tbl.num_rows)
    bq = spark.sparkContext.broadcast((q_tbl.select([query_id]), q_mat, _bounds_of(q_tbl)))
    if not return_broadcast:  # a caller that gets it destroys it; a broadcast cannot be destroyed twice
        track(bq)
    arrow_schema = pa.schema([pa.field(f.name, _arrow_type(f.dataType)) for f in out.fields])

    def scan(batches):
        q_ids, q_vectors, bounds = bq.value
        top = None
        for batch in batches:
            if batch.num_rows:
                top = top or TopK(QueryBlock(q_vectors, bounds), k)
                top.add(_matrix(batch.column(1), batch.num_rows), batch.column(0))
        if top is not None:
            yield from top.batches(arrow_schema, q_ids, query_id)

    result = c.select(chunk_id, chunk_vector).mapInArrow(scan, out)
    return (result, bq) if return_broadcast else result


def _rounds_or_blocked(c: DataFrame, n_q: int, dim: int, carry: list[str], rounds: int,
                       opts: RetrievalOptions) -> str:
    """Pick the cheaper path for a question set above the broadcast bound.

    rounds: the store is read once per round, in place (no shuffle);
    blocked: store and questions are shuffled, the store once per question block.
    Estimated bytes decide; a shuffle byte is counted as three read bytes
    (write, transfer, read).
    """
    n_c = c.count()
    chunk_bytes = dim * 4 + 64 + (512 if carry else 0)
    query_row = dim * 4 + 64
    store_bytes = n_c * chunk_bytes
    nqb = max(1, math.ceil(n_q / opts.query_block_rows))
    ncb = max(1, math.ceil(n_c / opts.chunk_block_rows))
    blocked_bytes = 3 * (store_bytes * nqb + n_q * query_row * ncb)
    return "rounds" if rounds * store_bytes <= blocked_bytes else "blocked"


def _rounds_cells(c: DataFrame, q: DataFrame, k, rounds: int, query_id, query_vector, chunk_id, chunk_vector, carry,
                  out: T.StructType) -> DataFrame:
    """Questions above the broadcast bound, in ``rounds`` hash-split blocks.

    Each block is broadcast and the store scanned in place, as in the single
    broadcast path; the round's candidates are written to the shared checkpoint
    folder and its broadcast destroyed before the next round, so the driver holds
    one bounded block at a time and the store is never shuffled.
    """
    paths = []
    for r in range(rounds):
        block = q.filter(F.pmod(F.xxhash64(F.col(query_id)), F.lit(rounds)) == F.lit(r))
        cand, bq = _broadcast_cells(c, block, k, query_id, query_vector, chunk_id, chunk_vector, carry, out,
                                    return_broadcast=True)
        try:
            paths.append(write_scratch(cand, f"topk-round{r}"))
        finally:
            bq.destroy()
    return c.sparkSession.read.schema(out).parquet(*paths)


def _blocked_cells(c: DataFrame, q: DataFrame, k, n_q, query_id, query_vector, chunk_id, chunk_vector, carry,
                   out: T.StructType, opts: RetrievalOptions) -> DataFrame:
    n_c = c.count()
    if n_c == 0:
        return c.sparkSession.createDataFrame([], out)
    nqb = max(1, math.ceil(n_q / opts.query_block_rows))
    ncb = max(1, math.ceil(n_c / opts.chunk_block_rows))
    # Each chunk goes to one chunk block and to every query block; each query to
    # one query block and every chunk block. Block ids hash the unique row ids,
    # so no key value can make one cell larger than the others.
    cq = c.withColumn("cb", F.pmod(F.xxhash64(F.col(chunk_id)), F.lit(ncb))) \
          .withColumn("qb", F.explode(F.sequence(F.lit(0), F.lit(nqb - 1))))
    qq = q.withColumn("qb", F.pmod(F.xxhash64(F.col(query_id)), F.lit(nqb))) \
          .withColumn("cb", F.explode(F.sequence(F.lit(0), F.lit(ncb - 1))))
    arrow_schema = pa.schema([pa.field(f.name, _arrow_type(f.dataType)) for f in out.fields])

    def cell(c_tbl: pa.Table, q_tbl: pa.Table) -> pa.Table:
        if c_tbl.num_rows == 0 or q_tbl.num_rows == 0:
            return arrow_schema.empty_table()
        cm = _matrix(c_tbl.column(chunk_vector), c_tbl.num_rows)
        qm = _matrix(q_tbl.column(query_vector), q_tbl.num_rows)
        ids = np.asarray(c_tbl.column(chunk_id).to_numpy(zero_copy_only=False))
        qi, ci, sc = score_cell(qm, cm, ids, k, bounds=_bounds_of(q_tbl))
        return pa.Table.from_batches([_emit(arrow_schema, q_tbl, c_tbl, qi, ci, sc, query_id, chunk_id, carry)])

    return cq.groupBy("qb", "cb").cogroup(qq.groupBy("qb", "cb")).applyInArrow(cell, out)


def _arrow_type(dt: T.DataType) -> pa.DataType:
    from pyspark.sql.pandas.types import to_arrow_type

    return to_arrow_type(dt)

