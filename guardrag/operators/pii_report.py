"""PII type report (P12): redactions by direction and type."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from guardrag.functions.pii import PII_TYPES


def pii_type_report(df: DataFrame, counts_col: str, direction: str) -> DataFrame:
    """``(direction, pii_type, redactions, items)`` from a per-row counts array
    (``with_scrub``'s ``{prefix}_counts``, pattern order).

    ``items`` is the number of rows with at least one redaction of the type.
    One row per (row, type present) is unpivoted and summed with map-side
    partial aggregation: at most 8 rows per task cross the shuffle, whatever the skew.
    """
    types = F.array(*[F.lit(t) for t in PII_TYPES])
    # The _outer generator keeps Spark from inferring a size(counts) > 0 filter, which it
    # would push below any repartition and so evaluate the whole scrub twice.
    unpivoted = df.select(F.posexplode_outer(counts_col).alias("i", "n")).filter(F.col("n") > 0)
    return unpivoted.groupBy("i").agg(F.sum("n").alias("redactions"), F.count(F.lit(1)).alias("items")).select(
        F.lit(direction).alias("direction"), F.element_at(types, F.col("i") + 1).alias("pii_type"),
        "redactions", "items")


def pii_type_report_from_findings(findings: DataFrame, id_col: str, findings_col: str, direction: str) -> DataFrame:
    """The same report from a findings array column (one struct per redaction)."""
    exploded = findings.select(F.col(id_col).alias("_id"), F.explode_outer(findings_col).alias("f")).filter(
        F.col("f").isNotNull())
    return exploded.groupBy(F.col("f.pii_type").alias("pii_type")).agg(
        F.count(F.lit(1)).alias("redactions"), F.count_distinct("_id").alias("items")
    ).select(F.lit(direction).alias("direction"), "pii_type", "redactions", "items")
