"""Exact integer k-means whose lower bounds are loosened by planar geometry instead of by the full drift.

Vectors become integers (``floor(scale * x)``); k centroids start as the kept vectors with the smallest SHA-256 of
``seed:key``. Each of ``rounds`` rounds assigns every vector to its nearest centroid (squared Euclidean distance, ties to the
smaller number) and replaces each non-empty centroid by the componentwise floor of its mean; then vectors are assigned once more.

Every vector carries an upper bound of the distance to its own centroid and a lower bound for each other one. When centroid
j moves from a to b by a drift d, a lower bound need not fall by d: all members of cluster i lie in a sphere around its centroid c
with the cluster's radius r, and |x - a| - |x - b| over that sphere is largest in the plane of a, b and c. The points with
|x - a| - |x - b| >= 2t lie inside a branch of a hyperbola with foci a and b, hence inside the wedge of its asymptotes, whose
angle phi has cos(phi) = 2t / d. The disc (c, r) misses the wedge as long as phi <= psi - asin(r / D), where D is the distance of
c from the middle of a and b and psi the angle between c - middle and b - a. So the bound falls by d * cos(psi - asin(r / D)),
by nothing if that angle is obtuse, and by d only if the sphere holds the middle or lies ahead of b.

A vector whose upper bound stays under all lower bounds keeps its cluster; the others first measure their own centroid and, if
that does not decide, are scanned against all centroids in integers. Bounds carry a slack for rounding, so results are exact.

Scale: one narrow Arrow pass per round over a written state table (vector, cluster, bounds); k x dims sums, k counts and k radii
come back to the driver, whatever the table's size. Nothing is shuffled by cluster: sums are formed inside tasks first, so a cluster
with most of the rows is no hot key.

Edge cases: vectors that are null, have another number of components, or hold a null or non-finite component are not kept and
give no row. Fewer kept vectors than k give as many centroids as there are. Repeated rows are separate vectors; equal or null keys
(hashed as ``null``) are ordered by their components. An empty table gives no rows. Extra columns are ignored, whatever their
names. A scaled component beyond 2**27 raises an error, as squared distances would no longer fit a long.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from guardrag.session import materialize

CLUSTERS, ROUNDS, DIMS, SCALE, SEED = 16, 3, 64, 64, 1
LARGEST = 1 << 27
_STATE = "row long, key string, v array<int>, cluster int, upper double, lower array<float>, scans int"
#: Rows whose distances to all centroids are formed at once.
_STEP = 2048


def squared_distances(x: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """Exact squared distances of all rows to all centroids, in 64-bit integers."""
    return np.stack([((x - c) ** 2).sum(axis=1) for c in centroids], axis=1)


def loosening(old: np.ndarray, new: np.ndarray, radii: np.ndarray) -> np.ndarray:
    """How far the bound of a member of cluster i (within radii[i] of old[i]) to centroid j falls at most when j moves: [i, j]."""
    old, new = old.astype(np.float64), new.astype(np.float64)
    move = new - old
    drift = np.sqrt((move ** 2).sum(axis=1))
    arm = old[:, None, :] - (old + new)[None, :, :] / 2
    reach = np.sqrt((arm ** 2).sum(axis=2))
    with np.errstate(divide="ignore", invalid="ignore"):
        cos_psi = (arm * move[None]).sum(axis=2) / (reach * drift[None])
        angle = np.arccos(np.clip(cos_psi, -1, 1)) - np.arcsin(np.minimum(1, radii[:, None] / reach))
    part = np.cos(np.clip(angle, 0, np.pi / 2))
    part[~np.isfinite(part) | (reach <= radii[:, None])] = 1
    return np.where(drift[None] > 0, drift[None] * np.minimum(1, part), 0) + _slack(old, new)


def _slack(*points: np.ndarray) -> float:
    return 1e-9 * (1 + max(float(np.abs(p).max(initial=0)) for p in points) * np.sqrt(points[0].shape[-1]))


def _scan(x: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(cluster, upper bound, lower bounds) by exact distances."""
    cluster, upper = np.empty(len(x), np.int32), np.empty(len(x))
    lower = np.empty((len(x), len(centroids)), np.float32)
    for s in range(0, len(x), _STEP):
        d = squared_distances(x[s:s + _STEP], centroids)
        own = d.argmin(axis=1)
        root = np.sqrt(d)
        cluster[s:s + _STEP] = own
        upper[s:s + _STEP] = root[np.arange(len(d)), own] * (1 + 1e-12)
        lower[s:s + _STEP] = _rounded_down(root)
    return cluster, upper, lower


def _rounded_down(values: np.ndarray) -> np.ndarray:
    near = values.astype(np.float32)
    return np.where(near > values, np.nextafter(near, np.float32(0)), near)


def move_bounds(x: np.ndarray, cluster: np.ndarray, upper: np.ndarray, lower: np.ndarray, old: np.ndarray, new: np.ndarray,
                radii: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Assign rows to moved centroids: (cluster, upper, lower, exact distances computed per row)."""
    slack = _slack(old, new)
    drift = np.sqrt(((new - old).astype(np.float64) ** 2).sum(axis=1))
    upper = upper + drift[cluster] + slack
    lower = np.maximum(0, lower.astype(np.float64) - loosening(old, new, radii)[cluster])
    others = lower.copy()
    others[np.arange(len(x)), cluster] = np.inf
    nearest = others.min(axis=1, initial=np.inf)
    scans = np.zeros(len(x), np.int32)
    open_ = np.flatnonzero(upper >= nearest - slack)
    if len(open_):
        upper[open_] = np.sqrt(((x[open_] - new[cluster[open_]]) ** 2).sum(axis=1)) * (1 + 1e-12) + slack
        scans[open_] = 1
        open_ = open_[upper[open_] >= nearest[open_] - slack]
    cluster, lower = cluster.copy(), _rounded_down(lower)
    if len(open_):
        cluster[open_], upper[open_], lower[open_] = _scan(x[open_], new)
        scans[open_] += len(new)
    return cluster, upper, lower, scans


def _matrix(column: pa.Array, width: int, kind) -> np.ndarray:
    return np.asarray(column.flatten().to_numpy(zero_copy_only=False)).astype(kind).reshape(-1, width)


def _lists(values: np.ndarray, kind: pa.DataType) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.arange(0, values.size + 1, values.shape[1]), pa.int32()), pa.array(values.ravel(), kind))


def _batch(row, key, v, cluster, upper, lower, scans) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([row, key, v, pa.array(cluster, pa.int32()), pa.array(upper, pa.float64()), _lists(lower, pa.float32()),
                                       pa.array(scans, pa.int32())], names=["row", "key", "v", "cluster", "upper", "lower", "scans"])


def first_assignment(kept: DataFrame, centroids: np.ndarray, dims: int) -> DataFrame:
    def run(batches):
        for b in batches:
            if b.num_rows:
                x = _matrix(b.column("v"), dims, np.int64)
                yield _batch(b.column("row"), b.column("key"), b.column("v"), *_scan(x, centroids), np.full(len(x), len(centroids)))

    return kept.mapInArrow(run, _STATE)


def next_assignment(state: DataFrame, old: np.ndarray, new: np.ndarray, radii: np.ndarray, dims: int) -> DataFrame:
    def run(batches):
        for b in batches:
            if b.num_rows:
                x = _matrix(b.column("v"), dims, np.int64)
                cluster, upper, lower, scans = move_bounds(x, b.column("cluster").to_numpy(), b.column("upper").to_numpy(),
                                                           _matrix(b.column("lower"), len(old), np.float32), old, new, radii)
                yield _batch(b.column("row"), b.column("key"), b.column("v"), cluster, upper, lower, scans + b.column("scans").to_numpy())

    return state.mapInArrow(run, _STATE)


def centroid_sums(state: DataFrame, k: int, dims: int) -> tuple[dict[int, list[int]], np.ndarray]:
    """(cluster -> [count, component sums], radii): formed per batch inside tasks, then added up exactly."""
    def run(batches):
        for b in batches:
            cluster, upper, x = b.column("cluster").to_numpy(), b.column("upper").to_numpy(), _matrix(b.column("v"), dims, np.int64)
            for c in np.unique(cluster).tolist():
                own = cluster == c
                parts = np.concatenate(([own.sum()], x[own].sum(axis=0)))
                yield pa.RecordBatch.from_arrays([pa.array([c] * (dims + 1), pa.int32()), pa.array(range(dims + 1), pa.int32()), pa.array(parts, pa.int64()),
                                                  pa.array([upper[own].max()] * (dims + 1), pa.float64())], names=["cluster", "at", "part", "radius"])

    found = (state.select("cluster", "upper", "v").mapInArrow(run, "cluster int, at int, part long, radius double")
             .groupBy("cluster", "at").agg(F.sum(F.col("part").cast("decimal(38,0)")).alias("total"), F.max("radius").alias("radius")).collect())
    sums: dict[int, list[int]] = {}
    radii = np.zeros(k)
    for r in found:
        sums.setdefault(r["cluster"], [0] * (dims + 1))[r["at"]] = int(r["total"])
        radii[r["cluster"]] = r["radius"]
    return sums, radii


def kept_vectors(vectors: DataFrame, key_col: str, vector_col: str, dims: int, scale: int) -> DataFrame:
    """(row, key, v): the kept vectors as integers, with a number for each row."""
    x = F.col("x")
    fine = F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c.cast("double")) & (F.abs(c.cast("double")) < float("inf")))
    v = F.transform(x, lambda c: F.floor(F.lit(float(scale)) * c.cast("double")))
    large = F.exists(v, lambda c: F.abs(c) > LARGEST)
    message = F.lit(f"a scaled component is beyond {LARGEST}: squared distances would not fit a long")
    return (vectors.select(F.col(f"`{key_col}`").cast("string").alias("key"), F.col(f"`{vector_col}`").alias("x"))
            .where(F.coalesce((F.size(x) == dims) & fine, F.lit(False)))
            .select(F.monotonically_increasing_id().alias("row"), "key", F.when(large, F.raise_error(message).cast("array<int>")).otherwise(v.cast("array<int>")).alias("v")))


def cluster_vectors(vectors: DataFrame, key_col: str = "vec_id", vector_col: str = "embedding", k: int = CLUSTERS, rounds: int = ROUNDS,
                    dims: int = DIMS, scale: int = SCALE, seed: int = SEED) -> tuple[DataFrame, np.ndarray]:
    """(state of every kept vector after the last assignment, final centroids): row, key (as text), v, cluster, scans (exact
    distances computed for the vector over all assignments; k * (rounds + 1) without bounds) and the bounds."""
    kept = materialize(kept_vectors(vectors, key_col, vector_col, dims, scale), "cluster-vectors")
    first = kept.orderBy(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce("key", F.lit("null"))), 256), "v").limit(k).collect()
    centroids = np.array([r["v"] for r in first], dtype=np.int64).reshape(-1, dims)
    if not len(centroids):
        return kept.selectExpr("*", "0 cluster", "0D upper", "cast(array() as array<float>) lower", "0 scans"), centroids
    state = materialize(first_assignment(kept, centroids, dims), "cluster-state")
    for _ in range(rounds):
        sums, radii = centroid_sums(state, len(centroids), dims)
        moved = centroids.copy()
        for c, (count, *totals) in sums.items():
            moved[c] = [t // count for t in totals]
        state = materialize(next_assignment(state, centroids, moved, radii, dims), "cluster-state")
        centroids = moved
    return state, centroids


def clusters_with_inertia(vectors: DataFrame, key_col: str = "vec_id", vector_col: str = "embedding", dims: int = DIMS, **options) -> DataFrame:
    """(key, cluster, distance, cluster_inertia, inertia, centroid_sha256) of every kept vector."""
    kind = vectors.schema[key_col].dataType
    state, centroids = cluster_vectors(vectors, key_col, vector_col, dims=dims, **options)
    centre = F.element_at(F.array(*[F.array(*[F.lit(int(x)) for x in c]) for c in centroids]) if len(centroids) else F.lit(None).cast("array<array<bigint>>"),
                          F.col("cluster") + 1)
    apart = F.zip_with("v", centre, lambda a, b: (a.cast("long") - b) * (a.cast("long") - b))
    found = state.select(F.col("key").cast(kind).alias(key_col), "cluster", F.aggregate(apart, F.lit(0).cast("long"), lambda s, x: s + x).alias("distance"))
    found = materialize(found, "cluster-distances")
    digests = [hashlib.sha256(",".join(str(int(x)) for x in c).encode()).hexdigest() for c in centroids]
    inertia = {r["cluster"]: int(r["total"]) for r in found.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("total")).collect()}
    by_cluster = lambda values, kind: F.element_at(F.array(*[F.lit(x).cast(kind) for x in values]), F.col("cluster") + 1) if values else F.lit(None).cast(kind)
    return found.select(f"`{key_col}`", "cluster", "distance", by_cluster([inertia.get(c, 0) for c in range(len(centroids))], "long").alias("cluster_inertia"),
                        F.lit(sum(inertia.values())).cast("long").alias("inertia"), by_cluster(digests, "string").alias("centroid_sha256"))
