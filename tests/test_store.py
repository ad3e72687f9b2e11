"""Validation, upsert, snapshots."""

import pytest

from conftest import rows
from guardrag.operators.store import (
    compact_store,
    read_rejects,
    read_store,
    upsert,
    upsert_store,
    validate_chunks,
    write_snapshot,
)

SCHEMA = "chunk_id string, document_id string, pos int, embedding array<float>"


def test_validation_reasons(spark):
    df = spark.createDataFrame([("a", "d", 0, [1.0, 2.0]), ("b", "d", 1, []), ("", "d", 2, [1.0, 2.0]),
                                ("c", "d", 3, [1.0]), ("e", "d", 4, None)], SCHEMA)
    valid, rejects = validate_chunks(df, expected_dim=2)
    assert [r["chunk_id"] for r in rows(valid)] == ["a"]
    assert {r["chunk_id"]: r["reason"] for r in rows(rejects)} == {
        "b": "empty_embedding", "": "empty_id", "c": "dimension_mismatch", "e": "empty_embedding"}


def test_dimension_latched_by_first_valid_chunk(spark):
    df = spark.createDataFrame([("x", "d", 0, []), ("a", "d", 1, [1.0, 2.0, 3.0]), ("b", "d", 2, [1.0, 2.0])], SCHEMA)
    valid, rejects = validate_chunks(df, order_cols=["document_id", "pos"])
    assert [r["chunk_id"] for r in rows(valid)] == ["a"]
    assert {r["chunk_id"] for r in rows(rejects)} == {"x", "b"}


def test_dimension_from_store(spark):
    st = spark.createDataFrame([("s", "d", 0, [1.0, 1.0])], SCHEMA)
    df = spark.createDataFrame([("a", "d", 0, [1.0, 2.0, 3.0])], SCHEMA)
    valid, _ = validate_chunks(df, store=st)
    assert valid.count() == 0


def test_strict_mode_raises(spark):
    df = spark.createDataFrame([("a", "d", 0, [])], SCHEMA)
    valid, _ = validate_chunks(df, expected_dim=2, mode="strict")
    with pytest.raises(Exception):
        valid.collect()


def test_upsert_last_write_wins(spark):
    old = spark.createDataFrame([("a", 1, "old-a"), ("b", 1, "old-b")], "chunk_id string, ingest_seq long, v string")
    new = spark.createDataFrame([("a", 2, "new-a"), ("c", 2, "new-c"), ("c", 3, "newer-c"), ("b", 0, "stale-b")],
                                "chunk_id string, ingest_seq long, v string")
    got = {r["chunk_id"]: r["v"] for r in rows(upsert(old, new))}
    assert got == {"a": "new-a", "b": "old-b", "c": "newer-c"}


def test_snapshot_versions(spark, tmp_path):
    root = str(tmp_path / "store")
    assert read_store(spark, root) is None
    df1 = spark.createDataFrame([("a", 1)], "chunk_id string, ingest_seq long")
    v1 = write_snapshot(df1, root)
    assert read_store(spark, root).count() == 1
    v2 = upsert_store(spark.createDataFrame([("b", 2)], "chunk_id string, ingest_seq long"), root)
    assert (v1, v2) == (1, 2) and read_store(spark, root).count() == 2
    assert read_store(spark, root, v1).count() == 1  # the old version is untouched


def test_upsert_collapses_null_and_repeated_keys(spark):
    old = spark.createDataFrame([("a", 1, "x"), ("a", 2, "y"), (None, 1, "n1"), ("b", 1, "b1")], "chunk_id string, ingest_seq long, v string")
    new = spark.createDataFrame([("b", 2, "b2"), (None, 2, "n2"), (None, 0, "n0")], "chunk_id string, ingest_seq long, v string")
    got = sorted(((r["chunk_id"] or "", r["v"]) for r in rows(upsert(old, new))))
    assert got == [("", "n2"), ("a", "y"), ("b", "b2")]


def test_stored_upsert_equals_the_frame_upsert(spark, tmp_path):
    old = spark.range(0, 50).selectExpr("cast(id as string) AS chunk_id", "1L AS ingest_seq", "'old' AS v")
    new = spark.range(40, 60).selectExpr("cast(id as string) AS chunk_id",
                                         "CASE WHEN id % 2 = 0 THEN 2L ELSE 0L END AS ingest_seq", "'new' AS v")
    root = str(tmp_path / "store")
    upsert_store(old, root)
    upsert_store(new, root)
    stored, framed = ({r["chunk_id"]: r["v"] for r in rows(df)} for df in (read_store(spark, root), upsert(old, new)))
    assert stored == framed and len(stored) == 60
    assert all(stored[str(i)] == ("new" if i >= 50 or i >= 40 and i % 2 == 0 else "old") for i in range(60))


def test_a_batch_writes_its_own_rows_only(spark, tmp_path):
    root = str(tmp_path / "store")
    upsert_store(spark.range(500).selectExpr("cast(id as string) AS chunk_id", "id AS v"), root)
    before = sorted(p.name for p in (tmp_path / "store" / "rows" / "version=1").iterdir())
    upsert_store(spark.createDataFrame([("7", -7)], "chunk_id string, v long"), root)
    assert spark.read.parquet(f"{root}/rows/version=2").count() == 1
    assert sorted(p.name for p in (tmp_path / "store" / "rows" / "version=1").iterdir()) == before
    assert read_store(spark, root).count() == 500 and read_store(spark, root).filter("chunk_id = '7'").first()["v"] == -7


@pytest.mark.parametrize("at", [1, 2, 3])
def test_compaction_changes_no_row(spark, tmp_path, at):
    """Stale, equal, newer, repeated and null keys, with and without sequences, around a compaction after each batch."""
    batches = [[("a", 5, "a5"), ("b", 1, "b1"), (None, 1, "n1"), ("s", None, "s0")], [("a", 4, "stale"), ("b", 1, "b1-again"), ("c", 2, "c2"), ("s", None, "s1")],
               [(None, 2, "n2"), ("c", None, "none"), ("d", 1, "d1"), ("d", 0, "d0"), ("s", 0, "s2")]]
    root, merged = str(tmp_path / "store"), None
    for n, batch in enumerate(batches, 1):
        frame = spark.createDataFrame(batch, "chunk_id string, ingest_seq long, v string")
        upsert_store(frame, root)
        merged = upsert(merged, frame)
        if n == at:
            compact_store(spark, root)
        key = lambda r: (r["chunk_id"] or "", r["ingest_seq"], r["v"])
        assert {key(r) for r in rows(read_store(spark, root))} == {key(r) for r in rows(merged)}
    assert read_store(spark, root).count() == 6


def test_a_compacted_store_is_scanned_in_place(spark, tmp_path):
    root = str(tmp_path / "store")
    upsert_store(spark.range(2000).selectExpr("cast(id as string) AS chunk_id", "id AS v"), root)
    compact_store(spark, root)
    upsert_store(spark.createDataFrame([("7", -7), ("x", 1)], "chunk_id string, v long"), root)
    resolved = read_store(spark, root)
    assert resolved.count() == 2001 and resolved.filter("chunk_id = '7'").first()["v"] == -7
    plan = resolved._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" not in plan and "BroadcastHashJoin" in plan


def test_an_unfinished_batch_is_not_there(spark, tmp_path):
    root = str(tmp_path / "store")
    upsert_store(spark.createDataFrame([("a", 1)], "chunk_id string, v long"), root)
    spark.createDataFrame([("b", 2, 2)], "chunk_id string, v long, ingest_seq long").write.parquet(f"{root}/rows/version=2")
    assert [r["chunk_id"] for r in rows(read_store(spark, root))] == ["a"]
    assert upsert_store(spark.createDataFrame([("c", 3)], "chunk_id string, v long"), root) == 2  # the batch comes again


def test_the_version_is_the_sequence(spark, tmp_path):
    root = str(tmp_path / "store")
    for v in (1, 2, 3):
        assert upsert_store(spark.createDataFrame([("a", f"v{v}")], "chunk_id string, t string"), root) == v
    assert [(r["t"], r["ingest_seq"]) for r in rows(read_store(spark, root))] == [("v3", 3)]


def test_two_writers_lose_nothing(spark, tmp_path, monkeypatch):
    from guardrag.operators import store

    root = str(tmp_path / "store")
    upsert_store(spark.createDataFrame([("a", 1)], "chunk_id string, v long"), root)
    monkeypatch.setattr(store, "latest_version", lambda *_: 1)  # both saw version 1
    upsert_store(spark.createDataFrame([("b", 2)], "chunk_id string, v long"), root)
    upsert_store(spark.createDataFrame([("c", 3)], "chunk_id string, v long"), root)
    assert sorted(r["chunk_id"] for r in rows(read_store(spark, root))) == ["a", "b", "c"]


def test_a_torn_commit_is_an_error_not_an_empty_store(spark, tmp_path):
    root = tmp_path / "store"
    upsert_store(spark.createDataFrame([("a", 1)], "chunk_id string, v long"), str(root))
    entry = next(p for p in (root / "commits").iterdir() if p.name.endswith(".parquet"))
    for text in ("", "PAR1 torn"):
        entry.write_text(text)
        (root / "commits" / f".{entry.name}.crc").unlink(missing_ok=True)
        with pytest.raises(Exception):
            read_store(spark, str(root)).collect()
        with pytest.raises(Exception):
            upsert_store(spark.createDataFrame([("b", 1)], "chunk_id string, v long"), str(root))


def test_empty_batches_and_rejects(spark, tmp_path):
    root = str(tmp_path / "store")
    none = spark.createDataFrame([], "chunk_id string, v long")
    assert upsert_store(none, root) == 1 and read_store(spark, root).count() == 0 and read_rejects(spark, root) is None
    bad = spark.createDataFrame([("x", "empty_id")], "chunk_id string, reason string")
    upsert_store(spark.createDataFrame([("a", 1)], "chunk_id string, v long"), root, rejects=bad)
    assert [r["reason"] for r in rows(read_rejects(spark, root))] == ["empty_id"] and read_store(spark, root).count() == 1


def test_validation_embeds_every_chunk_once(spark):
    """The test of the vectors stays above the embedding; pushed below, its expression would hold the embedder again."""
    from pyspark.sql import functions as F

    from guardrag.functions.embedding import hashing_embedder

    df = spark.range(20).select(F.col("id").cast("string").alias("chunk_id"), F.concat(F.lit("tok "), F.col("id").cast("string")).alias("content"))
    valid, rejects = validate_chunks(df.withColumn("embedding", hashing_embedder(8)("content")), expected_dim=8)
    for part, n in ((valid, 20), (rejects, 0)):
        assert part._jdf.queryExecution().executedPlan().toString().count("ArrowEvalPython [") == 1
        assert part.count() == n
    assert valid.columns == ["chunk_id", "content", "embedding"] and rejects.columns == [*valid.columns, "reason"]
