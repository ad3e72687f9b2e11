"""As-of join, grouping sets, observed writes and sketches over audit rows."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from conftest import rows
from guardrag.functions.pii import PII_TYPES
from guardrag.operators.asof import asof_join
from guardrag.operators.audit_reports import AuditMismatch, check_observed, distinct_questions, observed, question_sketches, redaction_cube

T0 = dt.datetime(2026, 1, 1)


@pytest.mark.parametrize("slices", [1, 2, 7, 64])
def test_asof_join_equals_brute_force(spark, slices):
    rng = random.Random(slices)
    time = lambda: None if rng.random() < 0.05 else T0 + dt.timedelta(seconds=rng.randrange(400))
    key = lambda: rng.choice(["hot"] * 6 + ["b", "c", None, "left"])
    left = [(i % 200, key(), time(), "x") for i in range(260)]
    right = [(None if (k := key()) is None else k.replace("left", "right"), time(), n) for n in range(90)]
    frame = asof_join(spark.createDataFrame(left, "id long, k string, at timestamp, version string").repartition(3),
                      spark.createDataFrame(right, "k string, at2 timestamp, version long"), ["k"], "at", "at2", ["version"], slices=slices)

    def best(k, t):
        fit = [(t2, v) for k2, t2, v in right if k2 == k and t2 is not None and t is not None and t2 <= t]
        return max(fit)[1] if fit else None

    want = sorted((i, k or "", str(t), -1 if best(k, t) is None else best(k, t)) for i, k, t, _ in left)
    assert sorted((r["id"], r["k"] or "", str(r["at"]), -1 if r["version"] is None else r["version"]) for r in rows(frame)) == want


def test_asof_join_without_keys_or_rows(spark):
    left = spark.createDataFrame([(1, T0), (2, T0 + dt.timedelta(hours=1))], "id long, at timestamp")
    right = spark.createDataFrame([(T0 + dt.timedelta(minutes=1), 7)], "at timestamp, v int")
    assert sorted((r["id"], r["v"]) for r in rows(asof_join(left, right, [], "at", "at", ["v"])) if r["v"]) == [(2, 7)]
    assert {r["v"] for r in rows(asof_join(left, right.limit(0), [], "at", "at", ["v"]))} == {None}
    assert asof_join(left.limit(0), right, [], "at", "at", ["v"]).count() == 0


def audit(spark, n=300):
    rng = random.Random(4)
    some = lambda: [rng.choice([0, 0, 0, 1, 2]) for _ in PII_TYPES]
    data = [(f"c{i}", ["answered", "low_confidence", "off_topic"][i % 3], T0 + dt.timedelta(hours=i), f"question {i % 120}", some(), some()) for i in range(n)]
    return data, spark.createDataFrame(data, "correlation_id string, outcome string, event_ts timestamp, scrubbed_query string, input_pii_type_counts array<int>, output_pii_type_counts array<int>")


def test_grouping_sets_add_up(spark):
    data, frame = audit(spark)
    got = {(r["outcome"], r["direction"], r["pii_type"], str(r["day"]) if r["day"] else None, r["level"]): (r["redactions"], r["items"]) for r in rows(redaction_cube(frame))}
    facts = [(o, d, t, str(ts.date()), n) for _, o, ts, _, i, out in data for d, c in (("input", i), ("output", out)) for t, n in zip(PII_TYPES, c) if n]
    want: dict = {}
    for o, d, t, day, n in facts:
        for k in ((o, d, t, day, 0), (o, d, None, None, 3), (None, d, t, None, 9), (None, None, None, day, 14), (None, None, None, None, 15)):
            a, b = want.get(k, (0, 0))
            want[k] = (a + n, b + 1)
    assert got == want


def test_a_write_with_missing_or_doubled_records_fails(spark, tmp_path):
    _, frame = audit(spark, 30)
    for n, (rows_, asked) in enumerate(((frame, 30), (frame, 31), (frame.unionByName(frame.limit(1)), 30), (frame.withColumn("outcome", F.lit("other")), 30),
                                        (frame.withColumn("correlation_id", F.lit(None).cast("string")), 30))):
        watched, watch = observed(rows_, f"w{n}")
        watched.write.parquet(str(tmp_path / str(n)))
        if n == 0:
            assert check_observed(watch, asked) == {"records": 30, "too_long": 0, "off_topic": 10, "low_confidence": 10, "answered": 10, "without_id": 0}
        else:
            with pytest.raises(AuditMismatch):
                check_observed(watch, asked)


def test_merged_sketches_stay_within_their_error(spark, tmp_path):
    data, frame = audit(spark, 900)
    question_sketches(frame).write.parquet(str(tmp_path / "s"))
    exact: dict = {}
    for _, _, _, q, i, out in data:
        for d, c in (("input", i), ("output", out)):
            for t, n in zip(PII_TYPES, c):
                if n:
                    exact.setdefault((d, t), set()).add(q)
    got = {(r["direction"], r["pii_type"]): r["questions"] for r in rows(distinct_questions(spark.read.parquet(str(tmp_path / "s"))))}
    assert set(got) == set(exact)
    assert all(abs(got[k] - len(v)) <= max(1, 3 * 1.04 / 64 * len(v)) for k, v in exact.items())
