"""Streams that count every thing once: copies of documents (S2), repeated audit records (A9, A13) and late rows.

All state lives in the query's checkpoint and is bounded by a watermark: what is older than the horizon is forgotten, and a row that
comes later than that counts as new (copies, audit records) or is left to the batch report over the audit table (windows).
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from guardrag.functions.pii import PII_TYPES

_JSON = {"timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX", "ignoreNullFields": "false"}


def without_copies(docs: DataFrame, horizon: str, content_col: str = "content", time_col: str = "modified_at") -> DataFrame:
    """A document stream without the documents whose content came before, whatever their file name or id.

    The first arrival of a content within ``horizon`` (event time) stays; a null content is a content like any other. Each task drops
    repeats among its own rows before the shuffle, so a content that fills a third of a micro-batch sends one row per task to its state.
    """
    digest = F.sha2(F.coalesce(F.concat(F.lit("c"), F.col(f"`{content_col}`")), F.lit("")), 256)
    hashed = docs.withColumn("content_hash", digest)

    def first_in_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[str] = set()
        for batch in batches:
            keep = []
            for h in batch.column(batch.schema.get_field_index("content_hash")).to_pylist():
                keep.append(h not in seen)
                seen.add(h)
            yield batch.filter(pa.array(keep, pa.bool_()))

    fewer = hashed.mapInArrow(first_in_task, hashed.schema)
    return fewer.withWatermark(time_col, horizon).dropDuplicatesWithinWatermark(["content_hash"]).drop("content_hash")


def once_per_key(records: DataFrame, key_col: str = "correlation_id", time_col: str = "event_ts", delay: str = "10 minutes",
                 horizon_ms: int = 24 * 3600 * 1000) -> DataFrame:
    """A stream of audit records with each key once, however often and in whatever micro-batch it is replayed.

    Keyed state remembers that a key was emitted; of several records of a micro-batch the earliest by time, then by
    content, is the one. State times out ``horizon_ms`` after the record's time (event time): a replay after that is a new record.
    Rows without a key or time stay as they are, as nothing says that they are the same. Records travel as JSON, so that no value is changed on the way
    (64-bit numbers with nulls among them would lose digits as pandas floats).
    """
    schema = records.schema
    keyed = records.select(F.col(f"`{key_col}`").cast("string").alias("key"), F.col(f"`{time_col}`").cast("timestamp").alias("at"),
                           F.to_json(F.struct(*[F.col(f"`{c}`") for c in records.columns]), _JSON).alias("body"))
    # A row that cannot be matched is its own key, by a fresh number.
    keyed = keyed.withColumn("key", F.when(F.col("key").isNull() | F.col("at").isNull(), F.concat(F.lit("row:"), F.uuid())).otherwise(F.concat(F.lit("key:"), F.col("key"))))
    keyed = keyed.withColumn("at", F.coalesce("at", F.current_timestamp()))

    def emit(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        best = None
        for frame in frames:
            for at, body in zip(frame["at"], frame["body"]):
                if best is None or (at, body) < best:
                    best = (at, body)
        if state.exists or best is None:
            return
        millis = int(best[0].value // 1_000_000) if hasattr(best[0], "value") else int(best[0].timestamp() * 1000)
        state.update((millis,))
        state.setTimeoutTimestamp(max(millis + horizon_ms, state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame({"body": [best[1]]})

    single = keyed.withWatermark("at", delay).groupBy("key").applyInPandasWithState(
        emit, "body string", "at_ms long", "append", GroupStateTimeout.EventTimeTimeout)
    return single.select(F.from_json("body", T.StructType.fromJson(schema.jsonValue()), {"timestampFormat": _JSON["timestampFormat"]}).alias("r")).select("r.*")


def live_pii_report(audit: DataFrame, window: str = "1 hour", delay: str = "10 minutes", counts: dict[str, str] | None = None,
                    time_col: str = "event_ts") -> DataFrame:
    """P12 as a stream: ``(window_start, window_end, direction, pii_type, redactions, items)``, a row once its window is closed (append mode).

    ``counts`` names the counts column of each direction (by default those of the audit table). A window closes when the watermark, the latest time
    seen less ``delay``, has reached its end; it is given out once, by the micro-batch that begins with that watermark. A row that comes in a later
    micro-batch is late: it enters no window and counts in the batch report over the audit table only.
    Sums are formed per task first, so a type that is everywhere is no hot key. A null time belongs to no window.
    """
    counts = counts or {"input": "input_pii_type_counts", "output": "output_pii_type_counts"}
    types = F.array(*[F.lit(t) for t in PII_TYPES])

    def named(direction: str, column: str):
        return F.transform(F.coalesce(F.col(f"`{column}`"), F.array().cast("array<int>")),
                           lambda n, i: F.struct(F.lit(direction).alias("direction"), i.alias("i"), n.cast("long").alias("n")))

    zipped = [named(d, c) for d, c in counts.items()]
    rows = (audit.withWatermark(time_col, delay).select(F.window(time_col, window).alias("w"), F.explode_outer(F.concat(*zipped)).alias("c"))
            .where("c.n > 0"))
    found = rows.groupBy("w", F.col("c.direction").alias("direction"), F.col("c.i").alias("i")).agg(F.sum("c.n").alias("redactions"), F.count("*").alias("items"))
    return found.select(F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), "direction",
                        F.element_at(types, F.col("i") + 1).alias("pii_type"), "redactions", "items")
