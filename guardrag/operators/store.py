"""Chunk store: validation (T4), upsert (S5) and immutable snapshots.

The store is append-only Parquet written by DataFrame writers: ``rows/version=N`` holds the rows of batch N,
``base/version=N`` all rows as they were at version N (a compaction), ``rejects/version=N`` what batch N refused, and
``commits`` one row per finished batch. A batch writes its own rows and nothing else; the read resolves the latest row of a key.
A batch whose commit row is missing is not there, so a failed write leaves the previous version current.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

REJECT_EMPTY_EMBEDDING = "empty_embedding"
REJECT_EMPTY_ID = "empty_id"
REJECT_DIMENSION = "dimension_mismatch"


def _empty_embedding(vector_col: str):
    return F.col(vector_col).isNull() | (F.size(F.col(vector_col)) == 0)


def _empty_id(id_col: str):
    return F.col(id_col).isNull() | (F.col(id_col).cast("string") == F.lit(""))


def store_dimension(store: DataFrame | None, vector_col: str = "embedding") -> int | None:
    """Dimension of a validated store (all rows share it); None for an empty store."""
    if store is None:
        return None
    row = store.select(F.size(vector_col).alias("d")).limit(1).first()
    return None if row is None else int(row["d"])


def first_dimension(chunks: DataFrame, order_cols: list[str], vector_col: str = "embedding",
                    id_col: str = "chunk_id") -> int | None:
    """Dimension of the first chunk, in ``order_cols`` order, that passes the id and
    emptiness checks — the chunk that would latch the dimension of an empty store.
    One aggregate with map-side partials: nothing but a single row reaches the driver."""
    ok = chunks.filter(~_empty_embedding(vector_col) & ~_empty_id(id_col))
    row = ok.agg(F.min_by(F.size(vector_col), F.struct(*[F.col(c) for c in order_cols])).alias("d")).first()
    return None if row is None or row["d"] is None else int(row["d"])


def rejection_reason(expected_dim: int | None, vector_col: str = "embedding", id_col: str = "chunk_id"):
    reason = F.when(_empty_embedding(vector_col), F.lit(REJECT_EMPTY_EMBEDDING)).when(
        _empty_id(id_col), F.lit(REJECT_EMPTY_ID))
    if expected_dim is not None:
        reason = reason.when(F.size(F.col(vector_col)) != F.lit(expected_dim), F.lit(REJECT_DIMENSION))
    return reason.otherwise(F.lit(None).cast("string"))


def validate_chunks(chunks: DataFrame, expected_dim: int | None = None, *, store: DataFrame | None = None,
                    order_cols: list[str] | None = None, vector_col: str = "embedding", id_col: str = "chunk_id",
                    mode: str = "quarantine") -> tuple[DataFrame, DataFrame]:
    """T4. Returns ``(valid, rejects)``; ``rejects`` carries a ``reason`` column.

    Expected dimension: the parameter, else the store's, else that of the first
    chunk by ``order_cols``. ``mode='strict'`` fails the job on the first bad row
    (``raise_error`` inside the projection) instead of quarantining.
    """
    if expected_dim is None:
        expected_dim = store_dimension(store, vector_col)
    if expected_dim is None:
        expected_dim = first_dimension(chunks, order_cols or [id_col], vector_col, id_col)
    reason = rejection_reason(expected_dim, vector_col, id_col)
    if mode == "strict":
        checked = chunks.withColumn("_reason", reason)
        valid = checked.withColumn(
            "_ok", F.when(F.col("_reason").isNull(), F.lit(True)).otherwise(
                F.raise_error(F.concat(F.lit("invalid chunk: "), F.col("_reason"))))
        ).filter(F.col("_ok")).drop("_reason", "_ok")
        return valid, chunks.limit(0).withColumn("reason", F.lit(None).cast("string"))
    if mode != "quarantine":
        raise ValueError(f"unknown mode {mode!r}")
    # ``_part`` is always true. A projection with a non-deterministic column keeps the filter above it: pushed below, it would
    # hold the embedding's expression again, and every chunk would be embedded twice.
    tagged = chunks.withColumns({"reason": reason, "_part": F.spark_partition_id() >= 0})
    return (tagged.filter(F.col("reason").isNull() & F.col("_part")).drop("reason", "_part"),
            tagged.filter(F.col("reason").isNotNull() & F.col("_part")).drop("_part"))


def _latest(rows: DataFrame, key: str, seq_col: str) -> DataFrame:
    others = [c for c in rows.columns if c not in (key, seq_col, "_src")]
    w = Window.partitionBy(key).orderBy(F.col(seq_col).desc_nulls_last(), F.col("_src").desc(), F.xxhash64(*others) if others else F.lit(0))
    return rows.withColumn("_rn", F.row_number().over(w)).filter(F.col("_rn") == 1).drop("_rn", "_src")


def upsert(existing: DataFrame | None, updates: DataFrame, key: str = "chunk_id",
           seq_col: str = "ingest_seq") -> DataFrame:
    """Insert-or-replace by ``key``; the highest ``seq_col`` wins, and on equal
    sequence an update beats the stored row.

    The result holds one row per key whatever the batch size: repeated keys on either
    side collapse, and a null key is one key like any other. ``read_store`` applies the same rule to
    what was appended.
    """
    upd = updates.withColumn("_src", F.lit(1))
    if existing is None:
        return _latest(upd, key, seq_col)
    return _latest(existing.withColumn("_src", F.lit(0)).unionByName(upd), key, seq_col)


# ---------------------------------------------------------------------------
# Versions: appended batches, resolved when they are read
# ---------------------------------------------------------------------------

_COMMIT = "version long, kind string, rejects boolean"


def _table(spark: SparkSession, root: str, name: str) -> DataFrame | None:
    """A part of the store; None if it was never written. Any other failure is raised."""
    try:
        return spark.read.parquet(f"{root.rstrip('/')}/{name}")
    except AnalysisException as e:
        if e.getCondition() == "PATH_NOT_FOUND":
            return None
        raise


def latest_version(spark: SparkSession, root: str) -> int:
    """The highest committed version; 0 for a store that was never written."""
    commits = _table(spark, root, "commits")
    return 0 if commits is None else commits.agg(F.max("version")).first()[0]


def _commit(spark: SparkSession, root: str, version: int, kind: str, rejects: bool = False) -> int:
    spark.createDataFrame([(version, kind, rejects)], _COMMIT).coalesce(1).write.mode("append").parquet(f"{root}/commits")
    return version


def upsert_store(updates: DataFrame, root: str, *, key: str = "chunk_id", seq_col: str = "ingest_seq", rejects: DataFrame | None = None) -> int:
    """Append ``updates`` (and ``rejects``) as the next version of the store and return that version.

    Nothing that is stored is read or written again. Without ``seq_col`` in the updates the version is the sequence, so later
    batches win even when a stream starts over with a new checkpoint. A batch that is replayed appends equal rows, of which the
    read keeps one. Two writers at once lose nothing: their files stand side by side, under one version or two.
    """
    spark, root = updates.sparkSession, root.rstrip("/")
    version = latest_version(spark, root) + 1
    if seq_col not in updates.columns:
        updates = updates.withColumn(seq_col, F.lit(version).cast("bigint"))
    updates.write.mode("append").parquet(f"{root}/rows/version={version}")
    if rejects is not None:
        rejects.write.mode("append").parquet(f"{root}/rejects/version={version}")
    return _commit(spark, root, version, "rows", rejects is not None)


def write_snapshot(df: DataFrame, root: str) -> int:
    """Write ``df`` (one row per key) as the whole content of the next version."""
    spark, root = df.sparkSession, root.rstrip("/")
    version = latest_version(spark, root) + 1
    df.write.mode("errorifexists").parquet(f"{root}/base/version={version}")
    return _commit(spark, root, version, "base")


def compact_store(spark: SparkSession, root: str, key: str = "chunk_id", seq_col: str = "ingest_seq") -> int:
    """Write the resolved rows once, so that later reads resolve only what was appended since. Older versions stay readable."""
    resolved = read_store(spark, root, key=key, seq_col=seq_col)
    if resolved is None:
        raise ValueError(f"there is no store under {root!r}")
    return write_snapshot(resolved, root)


def read_store(spark: SparkSession, root: str, version: int | None = None, key: str = "chunk_id", seq_col: str = "ingest_seq") -> DataFrame | None:
    """A version of the store (the latest by default), one row per key; None for a store that was never written.

    Only rows appended since the last compaction are shuffled to find the latest of each key. The compacted rows are scanned in place
    where the appended keys are few enough for Spark to broadcast them.
    """
    commits = _table(spark, root, "commits")
    if commits is None:
        return None
    known = commits if version is None else commits.where(F.col("version") <= version)
    start = known.where("kind = 'base'").agg(F.max("version")).first()[0]
    done = known.where(F.col("kind") == "rows").where(F.col("version") > (start or 0)).select("version").distinct()
    rows = _table(spark, root, "rows")
    fresh = None
    if rows is not None:
        appended = rows.where(F.col("version") > (start or 0)).join(F.broadcast(done), "version", "left_semi")
        fresh = _latest(appended.withColumnRenamed("version", "_src"), key, seq_col)
    if start is None:
        return fresh
    base = spark.read.parquet(f"{root.rstrip('/')}/base/version={start}")
    if fresh is None or known.where(F.col("version") > start).isEmpty():
        return base
    if seq_col not in base.columns:
        base = base.withColumn(seq_col, F.lit(start).cast("bigint"))
    newer = fresh.select(F.col(key).alias("_key"), F.col(seq_col).alias("_seq"))
    later = F.coalesce(F.col(seq_col) > F.col("_seq"), F.col(seq_col).isNotNull())  # a stored row loses on equal sequences; no sequence is the lowest
    met = F.col(key).eqNullSafe(F.col("_key"))
    winners = base.join(newer, met & later, "left_semi").select(F.col(key).alias("_key"))
    kept = base.join(newer, met & ~later, "left_anti")
    return kept.unionByName(fresh.join(winners, met, "left_anti").select(*base.columns))


def read_rejects(spark: SparkSession, root: str, version: int | None = None) -> DataFrame | None:
    """The rows that a batch (the latest by default) refused, with their reason; None if it kept no rejects."""
    commits = _table(spark, root, "commits")
    if commits is None:
        return None
    version = latest_version(spark, root) if version is None else version
    kept = commits.where((F.col("version") == version) & F.col("rejects"))
    return None if kept.isEmpty() else spark.read.parquet(f"{root.rstrip('/')}/rejects/version={version}")
