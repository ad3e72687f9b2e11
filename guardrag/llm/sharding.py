"""Byte-limited shards by extendible hashing. DataFrame operations only.

A directory is indexed by the leading bits of a hash of the document key. A bucket whose
documents fit the byte limit (or that holds one document) is a shard; only oversized buckets
split on one more bit, until every shard fits. The hash is the first 60 bits of MD5 over the
key, so the same table always gives the same directory.

Scale: documents reduce to byte counts per hash prefix (partial aggregation before the
shuffle); all directory depths of a round come from those counts, never from the rows. Rows
then join their cell on a hash prefix, which spreads evenly for distinct keys and which AQE can
split for repeated ones. Only the columns in ``keep``, size and hash travel. A second round
sees the rows of still oversized cells only.

What bits cannot split (rows with equal hashes: repeated keys) is cut into overflow shards by
an exact running byte count: within each input partition, plus the sums of the partitions
before it. Rows of up to half the limit fill runs, each at least half full but the last; a larger row is a shard
of its own. Such shards append ``+k`` (a run) or ``+=k`` (one row) to the bits. A single document above the
limit is flagged ``oversize``.

Edge cases: null text counts 0 bytes; a null key hashes like the text "null"; an
empty table gives no rows. Columns named like a result are replaced; any other name may clash with nothing.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window
from pyspark.sql import functions as F

from guardrag.llm.columns import put_back, set_aside
from guardrag.session import materialize

HASH_BITS = 60
ROUND_BITS = 16
SHARD_LIMIT = 1 << 20
_RESULTS = ("n_bytes", "depth", "shard_id", "oversize")
_INNER = ("__bits", "__leaf", "__depth", "__prefix", "__fits", "__b", "__n", "__shard", "__part", "__row", "__alone", "__sum", "__max", "__big", "__before", "__big_before", "__run")


def key_bits(key: Column) -> Column:
    """The first 60 bits of MD5 of the key as a long."""
    return F.conv(F.substring(F.md5(F.coalesce(key.cast("string"), F.lit("null"))), 1, 15), 16, 10).cast("long")


def _right(value: str, by: Column) -> Column:
    return F.call_function("shiftright", F.col(value), by.cast("int"))


def _cells(rows: DataFrame, base: int, deep: int, limit: int) -> DataFrame:
    """(leaf, depth): the shallowest depth in base..deep at which the bucket of a leaf fits; null if none does."""
    leaves = materialize(rows.groupBy("__leaf").agg(F.sum("n_bytes").alias("__b"), F.count("*").alias("__n")), "leaves")
    paths = (leaves.withColumn("__depth", F.explode(F.sequence(F.lit(base), F.lit(deep))))
             .withColumn("__prefix", _right("__leaf", F.lit(deep) - F.col("__depth"))))
    fits = (paths.groupBy("__depth", "__prefix").agg(F.sum("__b").alias("__b"), F.sum("__n").alias("__n"))
            .where((F.col("__b") <= limit) | (F.col("__n") == 1)).select("__depth", "__prefix", F.lit(True).alias("__fits")))
    return (paths.join(fits, ["__depth", "__prefix"], "left")
            .groupBy("__leaf").agg(F.min(F.when(F.col("__fits"), F.col("__depth"))).alias("__depth")))


def assign_shards(docs: DataFrame, key_col: str = "doc_id", text_col: str = "text", limit: int = SHARD_LIMIT,
                  keep: list[str] | None = None) -> DataFrame:
    """The ``keep`` columns (all by default) with n_bytes, depth, shard_id (prefix bits; ``*`` for the whole table) and oversize."""
    given = [c for c in (docs.columns if keep is None else keep) if c.lower() not in _RESULTS]
    docs, names = set_aside(docs, _INNER + _RESULTS)
    kept = [names.get(c, c) for c in given]
    key_col, text_col = names.get(key_col, key_col), names.get(text_col, text_col)
    rows = docs.select(*[f"`{c}`" for c in kept],
                       F.coalesce(F.octet_length(F.col(f"`{text_col}`")).cast("long"), F.lit(0).cast("long")).alias("n_bytes"),
                       key_bits(F.col(f"`{key_col}`")).alias("__bits"))
    rows = materialize(rows, "sizes")
    total = rows.agg(F.sum("n_bytes")).first()[0] or 0
    base, deep = 0, min(HASH_BITS, 4 + math.ceil(math.log2(max(2, total / limit))))
    shards = []
    while True:
        rows = rows.withColumn("__leaf", _right("__bits", F.lit(HASH_BITS - deep)))
        placed = rows.join(_cells(rows, base, deep, limit), "__leaf")
        placed = materialize(placed, "placed")
        prefix = _right("__bits", F.lit(HASH_BITS) - F.col("__depth"))
        bits = F.when(F.col("__depth") == 0, F.lit("*")).otherwise(F.lpad(F.bin(prefix), F.col("__depth").cast("int"), F.lit("0")))
        shards.append(placed.where("__depth is not null").withColumn("__shard", bits))
        rows = placed.where("__depth is null").drop("__leaf", "__depth")
        if rows.isEmpty():
            break
        if deep == HASH_BITS:
            shards.append(_overflow(rows, limit))
            break
        base, deep = deep + 1, min(HASH_BITS, deep + ROUND_BITS)
    out = None
    for s in shards:
        s = s.select(*put_back(given, names), "n_bytes", F.col("__depth").cast("int").alias("depth"), F.col("__shard").alias("shard_id"),
                     (F.col("n_bytes") > limit).alias("oversize"))
        out = s if out is None else out.unionByName(s)
    return out


def _overflow(rows: DataFrame, limit: int) -> DataFrame:
    """Cut rows with equal hashes into runs of at most ``limit`` bytes; rows above half of it stand alone."""
    rows = materialize(rows.withColumns({"__part": F.spark_partition_id(), "__row": F.monotonically_increasing_id(), "__alone": F.col("n_bytes") * 2 > limit}), "overflow")
    small = F.when(F.col("__alone"), F.lit(0)).otherwise(F.col("n_bytes"))
    own = Window.partitionBy("__bits", "__part").orderBy("__row").rowsBetween(Window.unboundedPreceding, -1)
    before = Window.partitionBy("__bits").orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    parts = rows.groupBy("__bits", "__part").agg(F.sum(small).alias("__sum"), F.max(small).alias("__max"), F.count_if("__alone").alias("__big"))
    parts = parts.select("__bits", "__part", F.coalesce(F.sum("__sum").over(before), F.lit(0)).alias("__before"),
                         F.coalesce(F.sum("__big").over(before), F.lit(0)).alias("__big_before"), F.max("__max").over(Window.partitionBy("__bits")).alias("__max"))
    # A run of width limit - (largest row in runs) holds its rows' starts; with the last row it still fits the limit.
    start = F.col("__before") + F.coalesce(F.sum(small).over(own), F.lit(0))
    place = F.col("__big_before") + F.coalesce(F.sum(F.col("__alone").cast("long")).over(own), F.lit(0))
    run = F.floor(start / F.greatest(F.lit(limit) - F.col("__max"), F.lit(1)))
    return (rows.join(parts, ["__bits", "__part"])
            .withColumn("__run", F.when(F.col("__alone"), F.concat(F.lit("+="), place.cast("string"))).otherwise(F.concat(F.lit("+"), run.cast("string"))))
            .withColumn("__depth", F.lit(HASH_BITS))
            .withColumn("__shard", F.concat(F.lpad(F.bin("__bits"), HASH_BITS, "0"), F.col("__run"))))
