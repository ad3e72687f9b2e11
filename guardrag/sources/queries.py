"""Question source (S4): ``{query_id, query}`` records from JSON lines or parquet."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

QUERY_SCHEMA = T.StructType([T.StructField("query_id", T.StringType()), T.StructField("query", T.StringType())])


def normalise(df: DataFrame) -> DataFrame:
    """Fixed schema; a missing query text is the empty string (the request default). A record without an
    id stays without one here: ``ask_batch`` gives it a fresh id, written once before anything uses it."""
    return df.select(F.col("query_id").cast("string"), F.coalesce(F.col("query").cast("string"), F.lit("")).alias("query"))


def read_queries(spark: SparkSession, path: str, fmt: str = "json") -> DataFrame:
    return normalise(spark.read.schema(QUERY_SCHEMA).format(fmt).load(path))


def stream_queries(spark: SparkSession, path: str, fmt: str = "json") -> DataFrame:
    return normalise(spark.readStream.schema(QUERY_SCHEMA).format(fmt).load(path))
