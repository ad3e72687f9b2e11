"""As-of join: for each row the latest row of another table that is not later, by key and time.

The two tables are unioned and every left row takes the last right row before it in a window. A window over a whole key would put a hot key
(or a join without keys) into one task, so time is cut into slices: a window over (key, slice) finds what lies in the same slice, and what
comes from before is the last right row of any earlier slice, found on one summary row per (key, slice) and joined back. Slices are cut at
quantiles of the left times, so they hold about equal numbers of rows however the times are spread; equal times stay in one slice.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

SLICES = 64


def asof_join(left: DataFrame, right: DataFrame, keys: list[str], left_time: str, right_time: str, values: list[str], tie: str | None = None,
              slices: int = SLICES) -> DataFrame:
    """``left`` with the ``values`` of the latest right row with equal ``keys`` and ``right_time`` <= ``left_time`` (null if there is none).

    Of right rows with equal times the one with the largest ``tie`` column (default: the largest ``values``) counts. Null keys match null keys;
    a row without a time matches nothing and is not matched. Every left row stays, repeated ones too; clashing names of ``values`` replace left columns.
    """
    cuts = [c for c in (left.agg(F.percentile_approx(F.col(left_time).cast("timestamp").cast("double"), [i / slices for i in range(1, slices)])).first()[0] or [])]
    cuts = sorted(set(cuts))

    def part(time):
        at = time.cast("timestamp").cast("double")
        return F.size(F.filter(F.array(*[F.lit(c) for c in cuts]).cast("array<double>"), lambda c: c <= at)) if cuts else F.lit(0)

    carried = [c for c in left.columns if c not in values]
    key_columns = [F.col(f"`{k}`").alias(f"_k{i}") for i, k in enumerate(keys)]
    names = [f"_k{i}" for i in range(len(keys))]
    payload = F.struct(*[F.col(f"`{v}`") for v in values])
    order = F.col(f"`{tie}`") if tie else payload
    lefts = left.select(*key_columns, F.col(f"`{left_time}`").cast("timestamp").alias("_t"), F.struct(*[F.col(f"`{c}`") for c in carried]).alias("_left"))
    rights = right.where(F.col(f"`{right_time}`").isNotNull()).select(*key_columns, F.col(f"`{right_time}`").cast("timestamp").alias("_t"), order.alias("_tie"), payload.alias("_right"))
    both = lefts.unionByName(rights, allowMissingColumns=True).withColumn("_slice", F.when(F.col("_t").isNull(), -1).otherwise(part(F.col("_t"))))
    # At equal times right rows come first (they are not later), the largest tie last among them.
    near = Window.partitionBy(*names, "_slice").orderBy("_t", F.col("_left").isNotNull(), "_tie").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    found = both.withColumn("_near", F.last("_right", ignorenulls=True).over(near)).where("_left is not null")
    summary = rights.withColumn("_slice", part(F.col("_t"))).groupBy(*names, "_slice").agg(F.max_by("_right", F.struct("_t", "_tie")).alias("_last"))
    # Every slice of a key, from its last right row in an earlier slice: one row per (key, slice that has right rows) and the slices up to the next one.
    ahead = F.lead("_slice", 1, len(cuts) + 1).over(Window.partitionBy(*names).orderBy("_slice"))
    before = summary.withColumn("_to", ahead).withColumn("_slice", F.explode(F.sequence(F.col("_slice") + 1, F.greatest(F.col("_to"), F.col("_slice") + 1)))).where(
        (F.col("_slice") <= F.col("_to")) & (F.col("_slice") <= len(cuts)))
    before = before.select(*[F.col(n).alias(f"{n}b") for n in names], F.col("_slice").alias("_sliceb"), "_last")
    met = F.col("_slice") == F.col("_sliceb")
    for n in names:
        met = met & F.col(n).eqNullSafe(F.col(f"{n}b"))
    joined = found.join(before, met, "left").withColumn("_value", F.when(F.col("_slice") >= 0, F.coalesce("_near", "_last")))
    return joined.select("_left.*", *[F.col("_value").getField(v).alias(v) for v in values])
