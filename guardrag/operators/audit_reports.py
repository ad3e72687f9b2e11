"""Reports over the audit table: redactions by grouping sets (P12), observed counts of a write (S6) and mergeable distinct counts."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from guardrag.functions.pii import PII_TYPES

OUTCOMES = ("too_long", "off_topic", "low_confidence", "answered")
DIRECTIONS = {"input": "input_pii_type_counts", "output": "output_pii_type_counts"}


def _redactions(audit: DataFrame) -> DataFrame:
    """(day, outcome, direction, pii_type, n) per audit row, direction and type with redactions."""
    types = F.array(*[F.lit(t) for t in PII_TYPES])

    def named(direction: str, column: str):
        return F.transform(F.coalesce(F.col(column), F.array().cast("array<int>")), lambda n, i: F.struct(F.lit(direction).alias("direction"), i.alias("i"), n.cast("long").alias("n")))

    rows = audit.select(F.to_date("event_ts").alias("day"), "outcome", F.explode_outer(F.concat(*[named(d, c) for d, c in DIRECTIONS.items()])).alias("c")).where("c.n > 0")
    return rows.select("day", "outcome", F.col("c.direction").alias("direction"), F.element_at(types, F.col("c.i") + 1).alias("pii_type"), F.col("c.n").alias("n"))


def redaction_cube(audit: DataFrame) -> DataFrame:
    """Redactions and rows by outcome x direction x type x day, by outcome x direction, by direction x type, by day, and in all.

    ``level`` is Spark's ``grouping_id`` over (outcome, direction, pii_type, day): bits of the columns that are summed over, which are null there.
    One expansion of narrow rows with map-side partial sums; a group is a handful of values, so no key is hot.
    """
    columns = ("outcome", "direction", "pii_type", "day")
    sets = [columns, ("outcome", "direction"), ("direction", "pii_type"), ("day",), ()]
    grouped = _redactions(audit).groupingSets([[F.col(c) for c in s] for s in sets], *[F.col(c) for c in columns])
    return grouped.agg(F.grouping_id(*columns).cast("int").alias("level"), F.sum("n").alias("redactions"), F.count("*").alias("items")).select(*columns, "level", "redactions", "items")


class AuditMismatch(RuntimeError):
    """The audit table does not have one record for each question."""


def observed(audit: DataFrame, name: str = "audit") -> tuple[DataFrame, Observation]:
    """``audit`` with metrics that its one write collects on the way: records in all, by outcome, and without a correlation id."""
    watch = Observation(name)
    by = [F.count(F.when(F.col("outcome") == o, 1)).alias(o) for o in OUTCOMES]
    return audit.observe(watch, F.count(F.lit(1)).alias("records"), *by, F.count(F.when(F.col("correlation_id").isNull(), 1)).alias("without_id")), watch


def check_observed(watch: Observation, questions: int) -> dict[str, int]:
    """The counts of a finished write; raises ``AuditMismatch`` unless there is one record with an id and a known outcome per question."""
    counts = dict(watch.get)
    if counts["records"] != questions or sum(counts[o] for o in OUTCOMES) != questions or counts["without_id"]:
        raise AuditMismatch(f"{questions} questions, records: {counts}")
    return counts


def question_sketches(audit: DataFrame, lg_k: int = 12) -> DataFrame:
    """(day, direction, pii_type, sketch): a HyperLogLog sketch of the distinct scrubbed questions with a redaction of the type, per day."""
    rows = audit.select("scrubbed_query", "event_ts", "outcome", *DIRECTIONS.values())
    types = F.array(*[F.lit(t) for t in PII_TYPES])
    parts = []
    for direction, column in DIRECTIONS.items():
        parts.append(rows.select(F.to_date("event_ts").alias("day"), F.lit(direction).alias("direction"), "scrubbed_query", F.posexplode_outer(column).alias("i", "n"))
                     .where("n > 0").select("day", "direction", F.element_at(types, F.col("i") + 1).alias("pii_type"), "scrubbed_query"))
    every = parts[0]
    for p in parts[1:]:
        every = every.unionByName(p)
    return every.groupBy("day", "direction", "pii_type").agg(F.hll_sketch_agg("scrubbed_query", lg_k).alias("sketch"))


def distinct_questions(sketches: DataFrame) -> DataFrame:
    """(direction, pii_type, questions): the stored days' sketches merged, no question read again. The standard error is 1.04 / sqrt(2**lg_k)."""
    return sketches.groupBy("direction", "pii_type").agg(F.hll_sketch_estimate(F.hll_union_agg("sketch")).alias("questions"))
