"""Clustered retrieval, streams that count once, the chunk table, request bodies and VARIANT records."""

import json
import random
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from conftest import rows
from guardrag.config import ChunkingOptions, IngestionOptions
from guardrag.functions.chunk_table import chunk_documents_lateral, chunks_of, paragraphs_of, register_chunk_table
from guardrag.functions.chunking import pack_paragraphs
from guardrag.functions.pii import PII_TYPES
from guardrag.operators.audit import read_audit_records, write_audit_records
from guardrag.operators.chunking import chunk_documents
from guardrag.operators.clustered import Clusters, clusters_read, topk_clustered, write_clustered
from guardrag.operators.retrieval import topk_batch
from guardrag.operators.store import read_store
from guardrag.sources.requests import Span, _files, parse_requests, read_requests, read_span, record_property, stream_requests
from guardrag.streaming.ingest import start_chunk_stream, start_ingest_stream
from guardrag.streaming.once import live_pii_report, once_per_key

VECTORS = "chunk_id string, embedding array<float>"


# --- clustered retrieval -----------------------------------------------------------------------------------


def grouped(rng, groups, size, dim=16, spread=0.05):
    centres = rng.normal(size=(groups, dim))
    return np.concatenate([c / np.linalg.norm(c) + spread * rng.normal(size=(size, dim)) for c in centres]).astype(np.float32)


def ranking(df):
    return sorted((r["query_id"], r["rank"], r["chunk_id"], repr(r["score"])) for r in rows(df))


def test_pruned_equals_unpruned_and_skips_most_of_a_grouped_store(spark, tmp_path):
    rng = np.random.default_rng(1)
    stored, asked = grouped(rng, 20, 60), grouped(np.random.default_rng(1), 20, 2)
    chunks = spark.createDataFrame([(f"c{i}", x.tolist()) for i, x in enumerate(stored)], VECTORS).repartition(4)
    questions = spark.createDataFrame([(f"q{i}", x.tolist()) for i, x in enumerate(asked)], "query_id string, embedding array<float>")
    path = str(tmp_path / "s")
    write_clustered(chunks, path)
    want = ranking(topk_batch(chunks, questions, 5).select("query_id", "rank", "chunk_id", "score"))
    for block_bytes in (64 << 20, 600):  # one block, and several with near questions together
        found, work = topk_clustered(spark, path, questions, 5, block_bytes=block_bytes)
        assert ranking(found) == want
        done = rows(work)
        assert {r["vectors_scored"] + r["vectors_skipped"] for r in done} == {len(stored)} and len(done) == len(asked)
        assert sum(r["vectors_skipped"] for r in done) > 0.7 * len(stored) * len(asked)


def test_pruned_with_irregular_vectors_ties_and_repeated_ids(spark, tmp_path):
    rng = np.random.default_rng(2)
    stored = [x.tolist() for x in grouped(rng, 4, 12, dim=4)]
    odd = [[0.0] * 4, [float("nan"), 1.0, 0.0, 0.0], [1e-21] * 4, [float("inf"), 0.0, 0.0, 1.0], [3e20] * 4]
    stored += odd + [stored[0]] * 7
    chunks = spark.createDataFrame([(f"c{i:03d}", x) for i, x in enumerate(stored)], VECTORS)
    asked = [(None if i % 5 == 0 else f"q{i % 7}", [-x for x in v] if i % 2 else v) for i, v in enumerate(stored)]
    questions = spark.createDataFrame(asked, "query_id string, embedding array<float>")
    path = str(tmp_path / "s")
    write_clustered(chunks, path, clusters=6)
    found, _ = topk_clustered(spark, path, questions, 3)
    key = lambda df: sorted((r["query_id"] or "", r["rank"], r["chunk_id"], repr(r["score"])) for r in rows(df))
    assert key(found) == key(topk_batch(chunks, questions, 3).select("query_id", "rank", "chunk_id", "score"))


def test_radii_cover_all_members_and_unneeded_clusters_are_not_read(spark, tmp_path):
    chunks = spark.createDataFrame([(f"c{i}", x.tolist()) for i, x in enumerate(grouped(np.random.default_rng(3), 6, 50))], VECTORS)
    path = str(tmp_path / "s")
    write_clustered(chunks, path, clusters=6)
    table = Clusters(spark, path)
    assert table.sizes.sum() + table.loose == 300
    for r in rows(spark.read.parquet(f"{path}/rows")):
        x = np.array(r["embedding"], dtype=np.float64)
        at = table.numbers.tolist().index(r["cluster"])
        assert np.arccos(min(1.0, x @ table.centroids[at] / np.linalg.norm(x))) <= table.radii[at] + 1e-7
    two = clusters_read(spark, path, [0, 3])
    plan = two._jdf.queryExecution().executedPlan().toString()
    assert "cluster" in plan.split("PartitionFilters: [", 1)[1].split("]", 1)[0]
    assert all("cluster=0" in f or "cluster=3" in f for f in {r[0] for r in two.select(F.input_file_name()).distinct().collect()})


def test_clustered_edge_cases(spark, tmp_path):
    none = spark.createDataFrame([], VECTORS)
    one = spark.createDataFrame([("q", [1.0, 0.0])], "query_id string, embedding array<float>")
    write_clustered(none, str(tmp_path / "none"))
    found, work = topk_clustered(spark, str(tmp_path / "none"), one, 3)
    assert found.count() == 0 and [r["vectors_skipped"] for r in rows(work)] == [0]
    write_clustered(spark.createDataFrame([("a", [1.0, 0.0])], VECTORS), str(tmp_path / "one"))
    found, _ = topk_clustered(spark, str(tmp_path / "one"), one, 3)
    assert [r["chunk_id"] for r in rows(found)] == ["a"]
    assert topk_clustered(spark, str(tmp_path / "one"), one, 0)[0].count() == 0
    with pytest.raises(ValueError):
        topk_clustered(spark, str(tmp_path / "one"), spark.createDataFrame([("q", [1.0])], "query_id string, embedding array<float>"), 3)
    with pytest.raises(ValueError):
        write_clustered(spark.createDataFrame([("a", [1.0]), ("b", [1.0, 2.0])], VECTORS), str(tmp_path / "bad"))


# --- streams that count once -------------------------------------------------------------------------------


def test_a_renamed_copy_adds_no_chunk(spark, tmp_path):
    folder, store, ckpt = tmp_path / "docs", str(tmp_path / "store"), str(tmp_path / "ckpt")
    folder.mkdir()
    run = lambda: start_ingest_stream(spark, store, ckpt, IngestionOptions(source_path=str(folder)), available_now=True, skip_copies="3650 days").awaitTermination()
    (folder / "a.txt").write_text("First paragraph.\n\nSecond.")
    (folder / "b.txt").write_text("Another text.")
    (folder / "b2.txt").write_text("Another text.")  # a copy in the same micro-batch
    run()
    before = {r["content"] for r in rows(read_store(spark, store))}
    assert read_store(spark, store).count() == 2 == len(before)
    (folder / "renamed.txt").write_text("First paragraph.\n\nSecond.")
    run()
    assert read_store(spark, store).count() == 2
    (folder / "new.txt").write_text("First paragraph.\n\nSecond!")
    run()
    assert read_store(spark, store).count() == 3


def arriving(spark, tmp_path, batches, schema):
    """Micro-batches of a file stream, one file each, in order."""
    path = tmp_path / "in"
    path.mkdir()
    for n, batch in enumerate(batches):
        spark.createDataFrame(batch, schema).coalesce(1).write.mode("append").parquet(str(path))
        time.sleep(1.1)  # files are taken by modification time
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(path))


def test_replayed_records_are_emitted_once_and_values_survive(spark, tmp_path):
    big = 2**62 + 1
    schema = "correlation_id string, event_ts timestamp, n long, score float, tags array<string>"
    at = "2026-01-01 10:00:00.123456"
    row = lambda k, n, ts=at: (k, ts, n, 0.1, ["x", None])
    make = lambda batch: [(k, __import__("datetime").datetime.fromisoformat(ts), n, s, t) for k, ts, n, s, t in batch]
    batches = [make([row("a", big), row("b", None), row("a", big)]), make([row("a", big), row("c", 3), row(None, 4), row(None, 4)]), make([row("b", None), row("c", 3, "2026-01-01 09:59:00")])]
    stream = arriving(spark, tmp_path, batches, schema)
    sink = str(tmp_path / "sink")
    start_chunk_stream(once_per_key(stream), lambda df: df, sink, str(tmp_path / "ckpt")).awaitTermination()
    got = rows(spark.read.parquet(sink))
    assert sorted((r["correlation_id"] or "", r["n"]) for r in got if r["correlation_id"] != "b") == [("", 4), ("", 4), ("a", big), ("c", 3)]
    assert [r["n"] for r in got if r["correlation_id"] == "b"] == [None]
    assert all(r["event_ts"].microsecond == 123456 and r["tags"] == ["x", None] and abs(r["score"] - 0.1) < 1e-7 for r in got)


def test_windows_close_once_and_late_rows_stay_out(spark, tmp_path):
    import datetime as dt

    counts = lambda *pairs: [dict(pairs).get(i, 0) for i in range(len(PII_TYPES))]
    t = lambda h, m=0: dt.datetime(2026, 1, 1, h, m)
    batches = [[(t(9, 5), counts((0, 2), (7, 1))), (t(9, 59), counts((0, 1))), (t(10, 5), counts((1, 1))), (None, counts((0, 9)))],
               [(t(9, 58), counts((0, 1))), (t(12), None)],  # 9:58 is within the delay of 10:05
               [(t(12, 1), counts())],  # this micro-batch begins with the watermark of 12:00 and closes the first window
               [(t(9, 30), counts((0, 50))), (t(12, 30), counts((2, 1)))]]  # 9:30 is late
    stream = arriving(spark, tmp_path, batches, "event_ts timestamp, c array<int>")
    sink = str(tmp_path / "sink")
    start_chunk_stream(live_pii_report(stream, "1 hour", "10 minutes", {"input": "c"}), lambda df: df, sink, str(tmp_path / "ckpt")).awaitTermination()
    got = sorted((r["window_start"].hour, r["direction"], r["pii_type"], r["redactions"], r["items"]) for r in rows(spark.read.parquet(sink)))
    assert got == sorted([(9, "input", PII_TYPES[0], 4, 3), (9, "input", PII_TYPES[7], 1, 1), (10, "input", PII_TYPES[1], 1, 1)])


# --- the chunk table ---------------------------------------------------------------------------------------


def test_chunks_one_by_one_equal_the_fold():
    rng = random.Random(3)
    for _ in range(300):
        separator = rng.choice(["\n", "\n\n", "ab", ""])
        text = "".join(rng.choice(["\n", "\n\n", "a", "b", "word ", "🙂", "é"]) for _ in range(rng.randrange(60)))
        size, overlap = rng.randrange(1, 40), rng.randrange(0, 12)
        pieces = [p for p in (text.split(separator) if separator else [text]) if p]
        assert list(paragraphs_of(text, separator)) == pieces
        assert list(chunks_of(text, separator, size, overlap)) == pack_paragraphs(pieces, size, overlap)


def test_lateral_chunks_equal_chunk_documents(spark):
    texts = [None, "", "\n\n", "one", "a\n\nb" * 400, "🙂" * 700 + "\n\nend"]
    docs = spark.createDataFrame([(str(i), t, "t") for i, t in enumerate(texts)], "id string, content string, title string")
    opts = ChunkingOptions()
    want = sorted(map(str, rows(chunk_documents(docs, id_col="id", opts=opts))))
    assert sorted(map(str, rows(chunk_documents_lateral(docs, id_col="id", opts=opts)))) == want
    register_chunk_table(spark)
    docs.createOrReplaceTempView("chunk_docs")
    sql = spark.sql("SELECT d.id, c.pos, c.content FROM chunk_docs d, LATERAL chunk_table(d.content, '\\n\\n', 500, 50) c")
    assert sql.count() == len(want)


# --- request bodies ----------------------------------------------------------------------------------------

BODIES = ['{"query_id": "a", "query": "x"}', '{"query": "x", "more": {"k": [1, null]}}', '{"query_id": null, "query": null}', "{}", '{"query": 5}', '{"query": ["x"]}', "[1]", '"text"', "12",
          "null", "not json", '{"query": "unclosed', '{"query_id": 7, "query": "né 🙂"}', '{"query_id": true, "query": ""}', '{"query": {"a": 1}}']


def test_variant_and_source_agree_on_every_kind_of_body(spark, tmp_path):
    (tmp_path / "r.json").write_text("\n".join(BODIES) + "\n")
    source = {(r["query_id"], r["query"], r["error"]) for r in rows(read_requests(spark, str(tmp_path)))}
    variant = parse_requests(spark.createDataFrame([(b,) for b in BODIES], "body string"))
    assert source == {(r["query_id"], r["query"], r["error"]) for r in rows(variant)}
    assert {r["error"] for r in rows(variant)} == {None, "not_json", "not_an_object", "query_not_text"}
    assert [r["error"] for r in rows(parse_requests(spark.createDataFrame([(None,)], "body string")))] == ["not_json"]


@pytest.mark.parametrize("split", [1, 7, 64, 10**6])
def test_splits_cover_every_line_once(tmp_path, split):
    lines = [json.dumps({"query_id": str(i), "query": "x" * (i * 7 % 40)}) for i in range(50)]
    for end in ("\n", ""):
        path = tmp_path / f"r{split}{len(end)}.json"
        path.write_text("\n".join(lines) + "\n\n" * len(end) + end)
        size = path.stat().st_size
        got = [r[0] for at in range(0, size, split) for r in read_span(str(tmp_path), Span(str(path), at, min(at + split, size)), step=16)]
        assert got == [str(i) for i in range(50)]


def test_the_request_stream_takes_whole_lines_once(spark, tmp_path):
    folder, sink, ckpt = tmp_path / "in", str(tmp_path / "sink"), str(tmp_path / "ckpt")
    folder.mkdir()
    run = lambda: start_chunk_stream(stream_requests(spark, str(folder), 40), lambda df: df, sink, ckpt).awaitTermination()
    seen = lambda: sorted(r["query"] for r in rows(spark.read.parquet(sink)))
    (folder / "1.json").write_text('{"query": "a"}\n{"query": "b"}\n{"query": "c')
    run()
    assert seen() == ["a", "b"]
    (folder / "1.json").write_text('{"query": "a"}\n{"query": "b"}\n{"query": "cd"}\n')
    (folder / "2.json").write_text('{"query": "e"}\nbad\n')
    (folder / "_hidden.json").write_text('{"query": "no"}\n')
    run()
    assert sorted(r["query"] or r["error"] for r in rows(spark.read.parquet(sink))) == ["a", "b", "cd", "e", "not_json"]
    assert [p.rsplit("/", 1)[1] for p, _ in _files(str(folder))] == ["1.json", "2.json"]


# --- VARIANT records ---------------------------------------------------------------------------------------


def test_audit_records_are_queryable_property_by_property(spark, tmp_path):
    audit = spark.createDataFrame([("a", "2026-01-01 00:00:00", ["s1", "s2"], 0.25, 3, True), ("b", "2026-01-02 00:00:00", [], None, 0, False)],
                                  "correlation_id string, event_ts string, sources array<string>, score float, n int, low boolean").withColumn("event_ts", F.to_timestamp("event_ts"))
    path = str(tmp_path / "audit")
    write_audit_records(audit, path, "r1")
    write_audit_records(audit.select("correlation_id", "event_ts", F.lit("extra").alias("note")), path, "r2")  # another shape, same table
    found = read_audit_records(spark, path)
    p = lambda name, kind: record_property("record", name, kind)
    got = sorted((r[0], r[1] or [], r[2], r[3]) for r in found.where("run_id = 'r1'").select(p("correlation_id", "string"), p("sources", "array<string>"), p("n", "int"), p("score", "float")).collect())
    assert got == [("a", ["s1", "s2"], 3, 0.25), ("b", [], 0, None)]
    assert [r[0] for r in found.where(p("note", "string") == "extra").select(p("correlation_id", "string").alias("c")).orderBy("c").collect()] == ["a", "b"]
    assert found.where(p("n", "string").isNotNull() & (p("low", "boolean"))).count() == 1


def test_cluster_pairs_stay_packed_and_are_found_slice_by_slice(spark, tmp_path, monkeypatch):
    """Questions x clusters are held as bits; angles are taken for a bounded slice of questions."""
    from guardrag.operators import clustered

    chunks = spark.createDataFrame([(f"c{i}", x.tolist()) for i, x in enumerate(grouped(np.random.default_rng(5), 6, 50))], VECTORS)
    path = str(tmp_path / "s")
    write_clustered(chunks, path, clusters=6)
    table = Clusters(spark, path)
    vectors = grouped(np.random.default_rng(6), 6, 10).astype(np.float32)
    seen, angles = [], clustered._angles
    monkeypatch.setattr(clustered, "_angles", lambda u, c: (seen.append(len(u)), angles(u, c))[1])
    whole = table.nearest(vectors, 5), table.reachable(vectors, np.full(60, 0.9, np.float32))
    assert max(seen) == 60
    monkeypatch.setattr(clustered, "ANGLE_ENTRIES", 42)
    seen.clear()
    near, bits = table.nearest(vectors, 5)
    assert max(seen) == 42 // len(table.numbers) and bits.dtype == np.uint8 and bits.shape == (60, 1)
    assert near.tolist() == whole[0][0].tolist() and bits.tolist() == whole[0][1].tolist()
    assert table.reachable(vectors, np.full(60, 0.9, np.float32)).tolist() == whole[1].tolist()
    assert table.held(np.full((60, 1), 0xFF, np.uint8)).tolist() == [int(table.sizes.sum())] * 60


def test_arrivals_are_written_where_the_rows_are(spark, tmp_path):
    from guardrag.plans import mechanism_queries as queries

    rows_ = spark.range(0, 600, 1, 6).select(F.when(F.col("id") % 100 != 50, F.col("id")).alias("key"), F.col("id").alias("row"))
    stream = queries._arrivals(spark, rows_, "key", "arrivals-test")
    seen = []
    stream.writeStream.foreachBatch(lambda df, n: seen.append([tuple(r) for r in df.select("row", "arrival").collect()])).option(
        "checkpointLocation", str(tmp_path / "ckpt")).trigger(availableNow=True).start().awaitTermination()
    third = lambda i: 2 if i % 100 == 50 else i % 3
    want = [(i, a) for i in range(600) for a, part in enumerate((0, 1, 2, 0)) if third(i) == part]
    assert sorted(x for batch in seen for x in batch) == sorted(want) and len(seen) >= 2
    files = {r[0].rsplit("/", 1)[0][-1:] + r[0][-60:] for r in spark.read.parquet(str(_stream_path(stream))).select(F.input_file_name()).distinct().collect()}
    assert len(files) == 4 * 6  # a file for each partition and arrival


def _stream_path(stream):
    return stream._jdf.queryExecution().analyzed().toString().split("FileSource[", 1)[1].split("]", 1)[0]
