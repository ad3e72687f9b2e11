"""Exact top-k that skips whole clusters of a store (R6): a clustered layout on disk and an angular triangle bound.

**Layout.** ``write_clustered`` writes the store partitioned by ``cluster`` together with one row per cluster: its centroid (a unit vector),
its radius (the largest angle between a member and the centroid) and its size. Centroids are fitted on a bounded sample of vectors (16 for
each centroid, by smallest hash, so the same store gives the same layout); every vector is assigned. Vectors outside the range where the
angle is exact enough (zero, non-finite, extreme scales) go to cluster -1, which every question reads. A cluster that holds much of the store
is written by several tasks (rebalanced), as several files of one partition.

**Bound.** For a question at angle a from a centroid of radius r, every member is at least a - r away, so its cosine is at most
cos(max(0, a - r)). Angles are a metric on the sphere, so nothing is approximate but rounding, for which there is a slack.

**Search.** First each question is ranked in its nearest clusters that hold ``k`` vectors or more; its k-th score there is a lower bound of the
final one. Then it needs only clusters whose bound reaches that score. The scan is filtered on the partition column, so clusters that no
question of the block needs are not read at all; in the others a batch of rows meets only the questions that need its cluster.
Scores are those of ``topk_batch`` bit for bit, ties by chunk id and NaN last; a question that is irregular itself reads everything.

**Scale.** Questions are dealt to blocks of bounded bytes by nearest cluster, so that a block needs few clusters; a block is broadcast with
its needed pairs (bits), and a task ranks all clusters it reads into one list of k a question; angles are taken ``ANGLE_ENTRIES`` at a time. Centroids and radii are at most ``MAX_CLUSTERS`` rows. The store is never shuffled.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from guardrag.operators.retrieval import QueryBlock, TopK, _arrow_type, _matrix, _regular, _squared_norms, rank_order
from guardrag.session import materialize, track

MAX_CLUSTERS, SAMPLE_PER_CLUSTER, ROUNDS = 4096, 16, 4
BLOCK_BYTES = 64 << 20
#: Slack of angles (radians) and of scores; both are far above the rounding of double angles and float scores.
ANGLE_SLACK, SCORE_SLACK = 1e-6, 1e-5
#: Angles held at once, on the driver and in tasks (8 MB).
ANGLE_ENTRIES = 1 << 20


def unit_rows(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(unit vectors in double, which rows are regular and not zero)."""
    n2 = _squared_norms(x)
    with np.errstate(invalid="ignore"):
        good = _regular(n2, x.shape[1]) & (n2 > x.shape[1] * 2.0**-100)
    out = np.zeros(x.shape)
    out[good] = x[good].astype(np.float64) / np.sqrt(n2[good])[:, None]
    return out, good


def _angles(units: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    return np.arccos(np.clip(units @ centroids.T, -1, 1))


def _slices(rows: int, width: int) -> Iterator[slice]:
    """Slices of rows whose angles to ``width`` centroids are at most ``ANGLE_ENTRIES``."""
    step = max(1, ANGLE_ENTRIES // max(1, width))
    return (slice(s, min(s + step, rows)) for s in range(0, rows, step))


def fit_centroids(sample: np.ndarray, clusters: int) -> np.ndarray:
    """Unit centroids of a sample by a few rounds of spherical k-means; starts are spread by farthest-first over the sample."""
    units, good = unit_rows(sample)
    units = units[good]
    if not len(units):
        return np.zeros((0, sample.shape[1]))
    chosen, nearest = [0], units @ units[0]
    for _ in range(min(clusters, len(units)) - 1):
        chosen.append(int(nearest.argmin()))
        nearest = np.maximum(nearest, units @ units[chosen[-1]])
    centroids = units[chosen]
    for _ in range(ROUNDS):
        own = np.concatenate([(units[part] @ centroids.T).argmax(axis=1) for part in _slices(len(units), len(centroids))])
        sums = np.zeros_like(centroids)
        np.add.at(sums, own, units)
        norms = np.sqrt((sums * sums).sum(axis=1))
        centroids = np.where(norms[:, None] > 1e-9, sums / np.maximum(norms, 1e-9)[:, None], centroids)
    return centroids


def write_clustered(chunks: DataFrame, path: str, clusters: int | None = None, chunk_id: str = "chunk_id", vector_col: str = "embedding") -> None:
    """Write ``chunks`` in the clustered layout under ``path`` (``rows`` and ``clusters``). Vectors must be of one length."""
    stats = chunks.agg(F.count("*").alias("n"), F.min(F.size(vector_col)).alias("lo"), F.max(F.size(vector_col)).alias("hi")).first()
    if stats["n"] and (stats["lo"] is None or stats["lo"] != stats["hi"] or stats["lo"] <= 0):
        raise ValueError(f"stored vectors differ in length: {stats['lo']} and {stats['hi']}")
    wanted = clusters or min(MAX_CLUSTERS, max(1, math.isqrt(stats["n"])))
    h = F.xxhash64(F.col(chunk_id), F.col(vector_col))
    sample = chunks.select(vector_col, h.alias("h")).orderBy("h").limit(SAMPLE_PER_CLUSTER * wanted).collect()
    dim = stats["hi"] or 0
    vectors = np.array([[math.nan if x is None else x for x in r[0]] for r in sample], dtype=np.float32).reshape(len(sample), dim)
    centroids = fit_centroids(vectors, wanted)

    schema = T.StructType([*chunks.schema.fields, T.StructField("angle", T.DoubleType()), T.StructField("cluster", T.IntegerType())])

    def assign(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            units, good = unit_rows(_matrix(batch.column(batch.schema.get_field_index(vector_col)), batch.num_rows))
            cluster, angle = np.full(batch.num_rows, -1, np.int32), np.zeros(batch.num_rows)
            of = np.flatnonzero(good)
            for part in _slices(len(of), len(centroids)) if len(centroids) else ():
                near = _angles(units[of[part]], centroids)
                cluster[of[part]], angle[of[part]] = near.argmin(axis=1), near.min(axis=1)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(angle), pa.array(cluster)], names=[*batch.schema.names, "angle", "cluster"])

    placed = materialize(chunks.mapInArrow(assign, schema), "clustered-assign")
    chunks.limit(0).withColumn("cluster", F.lit(0)).write.parquet(f"{path.rstrip('/')}/shape")  # an empty store has no partition to read a schema from
    placed.drop("angle").hint("rebalance", "cluster").write.partitionBy("cluster").parquet(f"{path.rstrip('/')}/rows")
    sizes = placed.groupBy("cluster").agg(F.count("*").alias("n"), F.max("angle").alias("radius"))
    table = chunks.sparkSession.createDataFrame([(k, c.tolist()) for k, c in enumerate(centroids)] + [(-1, [])], "cluster int, centroid array<double>")
    sizes.join(F.broadcast(table), "cluster").write.parquet(f"{path.rstrip('/')}/clusters")


class Clusters:
    """The cluster table, on the driver and in tasks: at most ``MAX_CLUSTERS`` centroids with radius and size."""

    def __init__(self, spark: SparkSession, path: str):
        rows = sorted(spark.read.parquet(f"{path.rstrip('/')}/clusters").collect(), key=lambda r: r["cluster"])
        self.loose = sum(r["n"] for r in rows if r["cluster"] < 0)
        rows = [r for r in rows if r["cluster"] >= 0]
        self.numbers = np.array([r["cluster"] for r in rows], dtype=np.int64)
        self.centroids = np.array([r["centroid"] for r in rows], dtype=np.float64).reshape(len(rows), len(rows[0]["centroid"]) if rows else 0)
        self.radii, self.sizes = np.array([r["radius"] for r in rows]), np.array([r["n"] for r in rows], dtype=np.int64)

    def nearest(self, vectors: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """(nearest cluster's position of every question, the pairs of its first pass as packed bits): nearest clusters until they hold ``k`` vectors."""
        near, bits = np.zeros(len(vectors), np.int64), np.zeros((len(vectors), -(-len(self.numbers) // 8)), np.uint8)
        for part in _slices(len(vectors), len(self.numbers)) if len(self.numbers) else ():
            units, good = unit_rows(vectors[part])
            needs = np.zeros((len(units), len(self.numbers)), dtype=bool)
            order = np.argsort(_angles(units, self.centroids), axis=1, kind="stable")
            held = np.cumsum(self.sizes[order], axis=1)
            np.put_along_axis(needs, order, held - self.sizes[order] < k, axis=1)
            needs[~good] = True
            near[part], bits[part] = order[:, 0], np.packbits(needs, axis=1)
        return near, bits

    def reachable(self, vectors: np.ndarray, bounds: np.ndarray) -> np.ndarray:
        """Pairs of questions and clusters that may hold a score of at least the question's bound, as packed bits."""
        bits = np.zeros((len(vectors), -(-len(self.numbers) // 8)), np.uint8)
        for part in _slices(len(vectors), len(self.numbers)) if len(self.numbers) else ():
            units, good = unit_rows(vectors[part])
            best = np.cos(np.clip(_angles(units, self.centroids) - self.radii - ANGLE_SLACK, 0, np.pi))
            bits[part] = np.packbits((best + SCORE_SLACK >= bounds[part, None]) | ~good[:, None], axis=1)
        return bits

    def held(self, bits: np.ndarray) -> np.ndarray:
        """Vectors in the clusters of each question's pairs."""
        out = np.zeros(len(bits), np.int64)
        for part in _slices(len(bits), len(self.numbers)) if len(self.numbers) else ():
            out[part] = np.unpackbits(bits[part], axis=1, count=len(self.numbers)) @ self.sizes
        return out

    def any_of(self, bits: np.ndarray) -> list[int]:
        """Numbers of the clusters that some question needs."""
        return self.numbers[np.unpackbits(np.bitwise_or.reduce(bits, axis=0), count=len(self.numbers)).astype(bool)].tolist() if len(self.numbers) else []


def _scan(spark, path, block: pa.Table, needs: np.ndarray, clusters: Clusters, k, bounds, chunk_id, chunk_vector, out: T.StructType, loose: bool) -> DataFrame:
    """Candidates of one pass: the needed clusters are read in place, each for the questions that need it (``needs``: packed bits). A task holds no more than the block and its questions' best k."""
    wanted = clusters.any_of(needs) + [-1] * loose
    rows = clusters_read(spark, path, wanted).select(chunk_id, chunk_vector, "cluster")
    position = {int(c): i for i, c in enumerate(clusters.numbers)}
    shared = track(spark.sparkContext.broadcast((block.select(["_question"]), _matrix(block.column("vector"), block.num_rows), needs, bounds)))
    arrow_schema = pa.schema([pa.field(f.name, _arrow_type(f.dataType)) for f in out.fields])

    def scan(batches):
        ids, vectors, bits, low = shared.value
        top = None
        for batch in batches:
            if not batch.num_rows:
                continue
            top = top or TopK(QueryBlock(vectors, low), k)
            found, cluster = _matrix(batch.column(1), batch.num_rows), batch.column(2).to_numpy()
            for c in np.unique(cluster).tolist():
                at = None if c < 0 else position[c]
                asking = None if c < 0 else np.flatnonzero(bits[:, at >> 3] & (128 >> (at & 7)))  # a column of the packed pairs
                own = np.flatnonzero(cluster == c)
                top.add(found[own], batch.column(0).take(pa.array(own)), asking)
        if top is not None and top.ids is not None:
            yield from top.batches(arrow_schema, ids, "_question")

    return rows.mapInArrow(scan, out)


def _ranked(candidates: DataFrame, k: int, chunk_id: str) -> DataFrame:
    w = Window.partitionBy("_question").orderBy(*rank_order("score", chunk_id))
    return candidates.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def _blocks(numbered: DataFrame, clusters: Clusters, k: int, row_bytes: int, block_bytes: int) -> list[DataFrame]:
    """Questions in blocks of about ``block_bytes``, near ones together: whole groups by nearest cluster, large groups cut by hash."""
    def near(batches):
        for b in batches:
            if b.num_rows:
                found, _ = clusters.nearest(_matrix(b.column(1), b.num_rows), k)
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(found, pa.int32())], names=["_question", "vector", "near"])

    placed = materialize(numbered.select("_question", "vector").mapInArrow(near, "_question long, vector array<float>, near int"), "clustered-questions")
    most, blocks, size = max(1, block_bytes // row_bytes), [[]], 0
    order = np.argsort(clusters.centroids[:, 0]).tolist() if len(clusters.numbers) else []
    for r in sorted(placed.groupBy("near").count().collect(), key=lambda r: order.index(r["near"]) if r["near"] in order else -1):  # a row per cluster
        cuts = math.ceil(r["count"] / most)
        for cut in range(cuts):
            if size and size + r["count"] / cuts > most:
                blocks, size = [*blocks, []], 0
            blocks[-1].append((r["near"], cuts, cut))
            size += r["count"] / cuts
    frames = []
    for block in blocks:
        pick = F.lit(False)
        whole = [near for near, cuts, _ in block if cuts == 1]
        pick = F.col("near").isin(whole) if whole else pick
        for near, cuts, cut in block:
            if cuts > 1:
                pick = pick | ((F.col("near") == near) & (F.pmod(F.xxhash64("_question"), F.lit(cuts)) == cut))
        frames.append(placed.where(pick).select("_question", "vector"))
    return frames


def topk_clustered(spark: SparkSession, path: str, queries: DataFrame, k: int, *, query_id: str = "query_id", query_vector: str = "embedding",
                   chunk_id: str = "chunk_id", chunk_vector: str = "embedding", block_bytes: int = BLOCK_BYTES) -> tuple[DataFrame, DataFrame]:
    """(query_id, rank, chunk_id, score) and the work done per question: (query_id, vectors_scored, vectors_skipped).

    Every row of ``queries`` is one question; ids may be null or repeat. A vector that is missing or of another length is an error; with ``k`` <= 0 or an empty
    store no question has a row in the ranking.
    """
    clusters = Clusters(spark, path)
    stored = spark.read.parquet(f"{path.rstrip('/')}/shape").schema
    out = T.StructType([T.StructField("_question", T.LongType()), T.StructField(chunk_id, stored[chunk_id].dataType), T.StructField("score", T.FloatType())])
    numbered = materialize(queries.select(F.monotonically_increasing_id().alias("_question"), F.col(query_id).alias("id"), F.col(query_vector).cast("array<float>").alias("vector")), "clustered-asked")
    stats = numbered.agg(F.count("*").alias("n"), F.min(F.coalesce(F.size("vector"), F.lit(-1))).alias("lo"), F.max(F.size("vector")).alias("hi")).first()
    if stats["n"] and (stats["lo"] <= 0 or stats["lo"] != stats["hi"]):
        raise ValueError("question vectors are missing or differ in length")
    dim = clusters.centroids.shape[1] if len(clusters.numbers) else stats["hi"]
    if stats["n"] and dim != stats["hi"]:
        raise ValueError(f"stored vectors have {dim} entries, question vectors {stats['hi']}")
    total = int(clusters.sizes.sum()) + clusters.loose
    ranks, work = [], []
    for frame in _blocks(numbered, clusters, k, (stats["hi"] or 0) * 4 + 16 + len(clusters.numbers) // 4, block_bytes) if stats["n"] and k > 0 and total else []:
        block = frame.toArrow()  # at most ``block_bytes``
        if not block.num_rows:
            continue
        vectors = _matrix(block.column("vector"), block.num_rows)
        _, first = clusters.nearest(vectors, k)
        probe = materialize(_ranked(_scan(spark, path, block, first, clusters, k, None, chunk_id, chunk_vector, out, True), k, chunk_id), "clustered-probe")
        kth = {r["_question"]: r["kth"] for r in probe.where("not isnan(score)").groupBy("_question").agg(F.min("score").alias("kth"), F.count("*").alias("n")).where(F.col("n") >= k).collect()}
        bounds = np.array([kth.get(q, -math.inf) for q in block.column("_question").to_pylist()], dtype=np.float32)
        more = clusters.reachable(vectors, bounds) & ~first
        rest = _scan(spark, path, block, more, clusters, k, bounds, chunk_id, chunk_vector, out, False)
        ranks.append(materialize(_ranked(probe.drop("rank").unionByName(rest), k, chunk_id), "clustered-ranked"))
        scored = clusters.held(first | more) + clusters.loose
        work.append(materialize(spark.createDataFrame(pa.table({"_question": block.column("_question"), "vectors_scored": pa.array(scored, pa.int64())})), "clustered-work"))
    empty = spark.createDataFrame([], T.StructType([*out.fields, T.StructField("rank", T.IntegerType())]))
    ranking, done = empty, spark.createDataFrame([], "_question long, vectors_scored long")
    for frame in ranks:
        ranking = ranking.unionByName(frame)
    for frame in work:
        done = done.unionByName(frame)
    ids = numbered.select("_question", F.col("id").alias(query_id))
    report = ids.join(done, "_question", "left").select(query_id, F.coalesce("vectors_scored", F.lit(0)).alias("vectors_scored"))
    return (ranking.join(ids, "_question").select(query_id, "rank", chunk_id, "score"),
            report.withColumn("vectors_skipped", F.lit(total).cast("long") - F.col("vectors_scored")))


def clusters_read(spark: SparkSession, path: str, clusters: list[int]) -> DataFrame:
    """The rows of some clusters; the filter on the partition column leaves the files of all others unread."""
    path = path.rstrip("/")
    return spark.read.schema(spark.read.parquet(f"{path}/shape").schema).parquet(f"{path}/rows").where(F.col("cluster").isin(clusters))
