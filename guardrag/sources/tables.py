"""Table sources: parquet tables with a parallelism floor (S4 and driver tables)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

MAX_SPREAD = 32


def spread(df: DataFrame, key_cols: list[str], min_partitions: int | None = None) -> DataFrame:
    """Hash-repartition a plain scan on ``key_cols`` when it has fewer splits than cores, up to ``MAX_SPREAD``.

    A small file with one row group is one split, so CPU-heavy row work (regex
    scrub, chunk folding) would run in a single task. Inputs of ``MAX_SPREAD`` splits or more
    pass through untouched, with no shuffle, however large the cluster (lower
    ``spark.sql.files.maxPartitionBytes`` there). Keys are row
    keys, so no value can gather a large share of the rows in one partition.
    """
    spark = df.sparkSession
    target = min(min_partitions or spark.sparkContext.defaultParallelism, MAX_SPREAD)
    if df.rdd.getNumPartitions() >= target:
        return df
    return df.repartition(target, *key_cols)


def read_table(spark: SparkSession, path: str, key_cols: list[str] | None = None,
               min_partitions: int | None = None) -> DataFrame:
    df = spark.read.parquet(path)
    return spread(df, key_cols, min_partitions) if key_cols else df
