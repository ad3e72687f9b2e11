"""Near-duplicate vectors by a pivot-permutation index: ordered nearest reference points, inverted pivot lists, exact verification.

1. **Nodes.** Equal vectors of a label are one node with a weight, so a vector that fills a third of the table is compared once.
2. **Reference points.** About one for 128 nodes (64 to 4,096), drawn from the nodes with the smallest hashes (at most four times as
   many are looked at) and kept apart (cosine under 0.8), as several inside one group of near copies would tell its members apart.
3. **Description.** A node is described by its ``described`` nearest reference points, nearest first.
4. **Inverted lists.** A node is posted to the lists of its points. Two nodes with ``shared`` points in common meet in the list of
   their smallest common point even if each leaves out its ``shared`` - 1 largest ones, so ``described`` - ``shared`` + 1 postings do.
5. **Counts, then verification.** Inside a list the numbers of shared points of all members come from one product of
   membership matrices; pairs with ``shared`` or more whose smallest common point is the list's own are candidates, once over all lists.
   Their cosine is computed in double precision.
6. **Long lists** (over ``chunk`` members) are cut into chunks by hash; a task holds two chunks. No member is left out.
7. A task returns, per node, its weighted number of links and the root of its local component; components by star contraction.

The index is approximate (pairs with few shared points are not found); links reported are exact. Recall is measured in the tests and
in the README. Scale: six postings with the vector travel per distinct vector; no pair becomes a row. A list's work
grows with the square of its length, which is kept near 800 by the number of reference points up to half a million distinct vectors
a label; beyond that and in groups of near copies larger than ``chunk`` each member travels once per chunk of its list.

Edge cases: null, empty, zero or non-finite vectors, vectors with null components and rows with a null label link with nothing;
vectors of different lengths are not compared. Rows with equal keys are separate rows. A null key takes part; the component is the
smallest non-null key in it (null if there is none). An empty table gives no rows. Other columns are ignored.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from guardrag.llm.jaccard_join import components
from guardrag.session import materialize

NEAR = 0.98
DESCRIBED, SHARED = 8, 3
NODES_PER_POINT, POINTS, APART = 128, (64, 4096), 0.8
CHUNK, PART_ROWS = 4096, 16384
_POSTING = "grp string, point int, node long, weight long, points array<int>, vector binary"


def usable(vector: Column, label: Column) -> Column:
    fine = F.forall(vector, lambda c: c.isNotNull() & ~F.isnan(c.cast("double")) & (F.abs(c.cast("double")) < float("inf")))
    return F.coalesce(label.isNotNull() & (F.size(vector) > 0) & fine & F.exists(vector, lambda c: c != 0), F.lit(False))


def _unit(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def reference_points(sample: np.ndarray, count: int, dims: int) -> np.ndarray:
    """Unit vectors from the sample, in its order, each with a cosine under 0.8 to those before; random directions fill up to 2 * described."""
    chosen = np.zeros((0, dims))
    for x in _unit(sample) if len(sample) else ():
        if len(chosen) == count:
            break
        if not len(chosen) or (chosen @ x).max() < APART:
            chosen = np.vstack((chosen, x))
    if len(chosen) < 2 * DESCRIBED:
        rng = np.random.default_rng(dims)
        chosen = np.vstack((chosen, _unit(rng.normal(size=(2 * DESCRIBED - len(chosen), dims)))))
    return chosen


def describe(x: np.ndarray, points: np.ndarray, described: int) -> np.ndarray:
    """Numbers of the nearest reference points of every row, nearest first."""
    near = _unit(x) @ points.T
    return np.argsort(-near, axis=1, kind="stable")[:, :described].astype(np.int32)


def _rows(column: pa.Array) -> list[np.ndarray]:
    flat, at = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64), np.concatenate(([0], np.cumsum(pc.list_value_length(column).to_numpy())))
    return [flat[a:b] for a, b in zip(at[:-1], at[1:])]


def _lists(values: np.ndarray) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.arange(0, values.size + 1, values.shape[1]), pa.int32()), pa.array(values.ravel(), pa.int32()))


def postings(nodes: DataFrame, points_of: dict[int, np.ndarray], described: int, shared: int) -> DataFrame:
    """(grp, point, node, weight, points, vector) rows of the inverted lists."""
    def run(batches):
        for b in batches:
            vectors = _rows(b.column("vector"))
            sizes = np.array([len(v) for v in vectors])
            for dims in np.unique(sizes).tolist():
                own = np.flatnonzero(sizes == dims)
                x = np.stack([vectors[i] for i in own])
                points = points_of.get(dims)
                order = describe(x, reference_points(x[:0], 0, dims) if points is None else points, described)
                lists = np.sort(order, axis=1)[:, :described - shared + 1]
                at = np.repeat(own, lists.shape[1])
                bodies = [v.tobytes() for v in x]
                picked = pa.array(at)
                yield pa.RecordBatch.from_arrays(
                    [b.column("grp").take(picked), pa.array(lists.ravel(), pa.int32()), b.column("node").take(picked), b.column("weight").take(picked),
                     _lists(np.repeat(order, lists.shape[1], axis=0)), pa.array([bodies[i] for i in np.repeat(np.arange(len(own)), lists.shape[1])], pa.binary())],
                    names=["grp", "point", "node", "weight", "points", "vector"])

    return nodes.select("grp", "node", "weight", "vector").mapInArrow(run, _POSTING)


class ListJoin:
    """Links among the members of one inverted list (or of two chunks of it)."""

    def __init__(self, point: int, points: np.ndarray, vectors: np.ndarray, weights: np.ndarray, sides: np.ndarray, shared: int, near: float):
        _, columns = np.unique(points, return_inverse=True)
        member = np.zeros((len(points), int(columns.max()) + 1), np.float32)
        member[np.arange(len(points))[:, None], columns.reshape(points.shape)] = 1
        numbers = np.unique(points)
        self.member, self.before = member, np.ascontiguousarray(member[:, numbers < point])
        self.vectors, self.norms = vectors, np.sqrt((vectors * vectors).sum(axis=1))
        self.weights, self.sides, self.shared, self.near = weights, sides, shared, near

    def candidates(self, lo: int, hi: int) -> tuple[np.ndarray, np.ndarray]:
        both = self.member[lo:hi] @ self.member.T
        good = (both >= self.shared) & (np.arange(lo, hi)[:, None] < np.arange(len(self.member)))
        if self.before.shape[1]:
            good &= self.before[lo:hi] @ self.before.T == 0
        if self.sides[0] != self.sides[-1]:
            good &= self.sides[lo:hi, None] != self.sides
        x, y = np.nonzero(good)
        return x + lo, y

    def run(self, rows: int = 256, pairs: int = 1 << 16) -> tuple[np.ndarray, np.ndarray]:
        """(weighted links of each member, smallest member number of its local component)."""
        count, root = np.zeros(len(self.weights), np.int64), np.arange(len(self.weights))
        for lo in range(0, len(root), rows):
            xs, ys = self.candidates(lo, min(lo + rows, len(root)))
            for s in range(0, len(xs), pairs):
                x, y = xs[s:s + pairs], ys[s:s + pairs]
                dots = np.einsum("ij,ij->i", self.vectors[x], self.vectors[y])
                linked = dots / (self.norms[x] * self.norms[y]) >= self.near
                x, y = x[linked], y[linked]
                np.add.at(count, x, self.weights[y])
                np.add.at(count, y, self.weights[x])
                while len(x):  # hook the larger root to the smaller one until both ends agree
                    a, b = root[x], root[y]
                    np.minimum.at(root, np.maximum(a, b), np.minimum(a, b))
                    while (step := root[root] != root).any():
                        root = np.where(step, root[root], root)
                    apart = root[x] != root[y]
                    x, y = x[apart], y[apart]
        return count, root


def list_links(lists: DataFrame, shared: int, near: float, chunk: int) -> DataFrame:
    """(node, links, root) of every node with links inside a list; small lists share a task."""
    sizes = lists.groupBy("grp", "point").count().where("count > 1").withColumn("chunks", F.ceil(F.col("count") / chunk).cast("int"))
    total = sizes.agg(F.sum(F.col("count") * F.col("chunks"))).first()[0] or 0
    parts = max(1, math.ceil(total / PART_ROWS))
    short = lists.join(sizes.where("chunks = 1").drop("count"), ["grp", "point"]).withColumns({"own": F.lit(0), "unit": F.lit("")})
    long = lists.join(sizes.where("chunks > 1").drop("count"), ["grp", "point"]).withColumn("own", F.pmod(F.xxhash64("node"), F.col("chunks")).cast("int"))
    other = F.explode(F.sequence(F.lit(0), F.col("chunks") - 1))
    long = (long.withColumn("other", other).withColumn("unit", F.concat_ws("-", F.least("own", "other"), F.greatest("own", "other"))).drop("other"))
    units = short.unionByName(long).withColumn("part", F.pmod(F.xxhash64("grp", "point", "unit"), F.lit(parts)))

    def join(table: pa.Table) -> pa.Table:
        table = table.sort_by([("grp", "ascending"), ("point", "ascending"), ("unit", "ascending"), ("own", "ascending"), ("node", "ascending")])
        names = list(zip(*(table.column(c).to_pylist() for c in ("grp", "point", "unit"))))
        cut = [i for i in range(len(names)) if not i or names[i] != names[i - 1]]
        node, weight, own = (table.column(c).to_numpy() for c in ("node", "weight", "own"))
        bodies, points = table.column("vector").to_pylist(), table.column("points").to_pylist()
        out: list[tuple] = []
        for lo, hi in zip(cut, [*cut[1:], len(names)]):
            if hi - lo > 1:
                vectors = np.frombuffer(b"".join(bodies[lo:hi]), np.float64).reshape(hi - lo, -1)
                count, root = ListJoin(names[lo][1], np.array(points[lo:hi]), vectors, weight[lo:hi], own[lo:hi], shared, near).run()
                found = np.flatnonzero(count)
                out.append((node[lo:hi][found], count[found], node[lo:hi][root[found]]))
        joined = [np.concatenate(x) if x else np.zeros(0, np.int64) for x in (zip(*out) if out else ((), (), ()))]
        return pa.table([pa.array(x, pa.int64()) for x in joined], names=["node", "links", "root"])

    return units.repartition("part").groupBy("part").applyInArrow(join, "node long, links long, root long")


def near_vectors(vectors: DataFrame, key_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", near: float = NEAR,
                 described: int = DESCRIBED, shared: int = SHARED, chunk: int = CHUNK) -> DataFrame:
    """(key, n_links, component_id, kept) of every row."""
    rows = vectors.select(F.col(f"`{key_col}`").alias("key"), F.col(f"`{label_col}`").cast("string").alias("label"), F.col(f"`{vector_col}`").alias("vector"))
    fit = usable(F.col("vector"), F.col("label"))
    digests = [F.when(fit, F.xxhash64(F.lit(salt), F.col("label"), F.col("vector"))).alias(f"d{salt}") for salt in (1, 2)]
    nodes = (rows.select("*", *digests).where(F.col("d1").isNotNull()).groupBy("d1", "d2")
             .agg(F.first(F.concat_ws("/", F.size("vector").cast("string"), F.col("label"))).alias("grp"), F.first("vector").alias("vector"), F.count("*").alias("weight"), F.min("key").alias("least")))
    nodes = materialize(nodes.withColumn("node", F.monotonically_increasing_id()), "vector-nodes")
    per_dims = nodes.groupBy(F.size("vector").alias("dims")).count().orderBy(F.desc("count")).limit(8).collect()  # others use random directions
    points_of = {}
    for r in per_dims:
        wanted = min(max(r["count"] // NODES_PER_POINT, POINTS[0]), POINTS[1])
        sample = nodes.where(F.size("vector") == r["dims"]).select("vector", F.xxhash64("d1", "d2").alias("h")).orderBy("h").limit(4 * wanted).collect()
        points_of[r["dims"]] = reference_points(np.array([x["vector"] for x in sample], dtype=np.float64), wanted, r["dims"])
    lists = materialize(postings(nodes, points_of, described, shared), "pivot-lists")
    links = materialize(list_links(lists, shared, near, chunk), "vector-links")
    counts = links.groupBy("node").agg(F.sum("links").alias("links"))
    roots = components(links.select(F.col("node").alias("a"), F.col("root").alias("b"))).withColumnRenamed("root", "component")
    placed = (nodes.select("d1", "d2", "node", "weight", "least").join(counts, "node", "left").join(roots, "node", "left")
              .select("d1", "d2", "least", (F.coalesce("links", F.lit(0)) + F.col("weight") - 1).alias("n_links"), F.coalesce("component", "node").alias("component")))
    placed = materialize(placed, "vector-components")
    least = placed.groupBy("component").agg(F.min("least").alias("component_id"))
    placed = placed.join(least, "component").select("d1", "d2", "n_links", "component_id")
    own = rows.select("key", *digests).join(placed, ["d1", "d2"], "left")
    component = F.when(F.col("d1").isNull(), F.col("key")).otherwise(F.col("component_id"))
    return own.select(F.col("key").alias(key_col), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.col("key").eqNullSafe(component).alias("kept"))
