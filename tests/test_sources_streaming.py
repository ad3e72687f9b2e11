"""File and JSON sources, folder ingestion stream, question stream."""

import json
import os

from pyspark.sql import functions as F

from conftest import SF_SMALL, rows
from guardrag.config import AskOptions, IngestionOptions, RetrievalOptions
from guardrag.functions.embedding import hashing_embedder
from guardrag.operators.store import read_rejects, read_store
from guardrag.plans import fixtures as fx
from guardrag.plans.ask import ask_batch
from guardrag.plans.catalog import AS_OF, document_store
from guardrag.session import ensure_checkpoint_dir
from guardrag.sources.files import read_documents
from guardrag.sources.queries import read_queries, stream_queries
from guardrag.streaming.ask import start_ask_stream
from guardrag.streaming.ingest import ingest_folder, start_chunk_stream, start_ingest_stream


def write_files(folder, files):
    folder.mkdir(parents=True, exist_ok=True)
    for name, text in files.items():
        (folder / name).write_text(text)


def test_read_documents_filters_extensions(spark, tmp_path):
    write_files(tmp_path / "docs", {"a.txt": "alpha\n\nbeta", "b.md": "gamma", "c.csv": "x,y"})
    got = {r["title"]: r["content"] for r in rows(read_documents(spark, str(tmp_path / "docs")))}
    assert got == {"a.txt": "alpha\n\nbeta", "b.md": "gamma"}


def test_read_queries_json_null_query_is_empty(spark, tmp_path):
    p = tmp_path / "q.json"
    p.write_text("\n".join(json.dumps(x) for x in [{"query_id": "1", "query": "fund?"}, {"query_id": "2"}]))
    got = {r["query_id"]: r["query"] for r in rows(read_queries(spark, str(p)))}
    assert got == {"1": "fund?", "2": ""}


def test_ingest_stream_skips_already_ingested(spark, tmp_path):
    src, store_root, ckpt = tmp_path / "src", str(tmp_path / "store"), str(tmp_path / "ckpt")
    write_files(src, {"a.txt": "The fund yield rose.\n\nBonds fell.", "b.md": "Equity markets " * 50})
    opts = IngestionOptions(source_path=str(src))
    start_ingest_stream(spark, store_root, ckpt, opts, available_now=True).awaitTermination()
    first = read_store(spark, store_root)
    n1 = first.count()
    assert n1 > 0 and set(r["title"] for r in rows(first.select("title").distinct())) == {"a.txt", "b.md"}
    start_ingest_stream(spark, store_root, ckpt, opts, available_now=True).awaitTermination()
    assert read_store(spark, store_root).count() == n1  # nothing new: nothing re-ingested
    write_files(src, {"c.txt": "Pension annuity risk."})
    start_ingest_stream(spark, store_root, ckpt, opts, available_now=True).awaitTermination()
    assert read_store(spark, store_root).count() == n1 + 1


def test_folder_reingest_is_idempotent(spark, tmp_path):
    src, store_root = tmp_path / "src", str(tmp_path / "store")
    write_files(src, {"a.txt": "One.\n\nTwo."})
    opts = IngestionOptions(source_path=str(src), skip_already_ingested=False)
    ingest_folder(spark, store_root, opts=opts)
    ingest_folder(spark, store_root, opts=opts)
    st = read_store(spark, store_root)
    assert st.count() == 1 and st.first()["ingest_seq"] == 2


def test_ask_stream_equals_batch(spark, tmp_path):
    st = document_store(spark, SF_SMALL)
    conv_schema = spark.read.parquet(f"{SF_SMALL}/conversations.parquet").schema
    stream = spark.readStream.schema(conv_schema).option("pathGlobFilter", "conversations.parquet").parquet(SF_SMALL)
    as_of = F.to_timestamp(F.lit(AS_OF))
    start_ask_stream(stream, st, str(tmp_path / "audit"), str(tmp_path / "ckpt"), available_now=True, as_of=as_of,
                     prepare=fx.questions_from).awaitTermination()
    streamed = spark.read.parquet(str(tmp_path / "audit")).drop("batch_id")
    batch = ask_batch(fx.user_questions(spark, SF_SMALL), st, as_of=as_of)
    cols = ["query_id", "outcome", "scrubbed_query", "scrubbed_response", "top_confidence_score"]
    assert sorted(map(tuple, streamed.select(cols).collect())) == sorted(map(tuple, batch.select(cols).collect()))


def test_json_query_stream(spark, tmp_path):
    d = tmp_path / "qin"
    d.mkdir()
    (d / "1.json").write_text(json.dumps({"query_id": "a", "query": "fund yield?"}))
    st = spark.createDataFrame([("c0", "alpha", "A", [1.0] * 64)],
                               "chunk_id string, content string, title string, embedding array<float>")
    start_ask_stream(stream_queries(spark, str(d)), st, str(tmp_path / "audit"), str(tmp_path / "ck"),
                     available_now=True, embedder=hashing_embedder(64)).awaitTermination()
    out = rows(spark.read.parquet(str(tmp_path / "audit")))
    assert [r["query_id"] for r in out] == ["a"]


def test_stream_reads_nested_folders_and_a_new_checkpoint_wins(spark, tmp_path):
    src, store_root = tmp_path / "src", str(tmp_path / "store")
    write_files(src / "deep" / "er", {"a.txt": "Old text."})
    opts = IngestionOptions(source_path=str(src))
    start_ingest_stream(spark, store_root, str(tmp_path / "ck1"), opts, available_now=True).awaitTermination()
    assert [r["content"] for r in rows(read_store(spark, store_root))] == ["Old text.\n"]
    assert read_rejects(spark, store_root).count() == 0
    first = read_store(spark, store_root).first()["ingest_seq"]
    start_ingest_stream(spark, store_root, str(tmp_path / "ck2"), opts, available_now=True).awaitTermination()
    assert read_store(spark, store_root).first()["ingest_seq"] > first


def test_micro_batches_leave_no_scratch_tables(spark, tmp_path):
    scratch = os.path.join(ensure_checkpoint_dir(spark).removeprefix("file:"), "")
    d = tmp_path / "qin"
    d.mkdir()
    for i in range(3):
        (d / f"{i}.json").write_text(json.dumps({"query_id": f"q{i}", "query": "fund yield?"}))
    st = spark.createDataFrame([("c0", "alpha", "A", [1.0] * 64)],
                               "chunk_id string, content string, title string, embedding array<float>")
    before = set(os.listdir(scratch))
    stream = spark.readStream.schema("query_id string, query string").option("maxFilesPerTrigger", 1).json(str(d))
    start_ask_stream(stream, st, str(tmp_path / "audit"), str(tmp_path / "ck"), available_now=True).awaitTermination()
    assert spark.read.parquet(str(tmp_path / "audit")).count() == 3
    assert {n for n in set(os.listdir(scratch)) - before if "ask" in n or "topk" in n} == set()


def test_micro_batch_with_more_questions_than_one_broadcast_holds(spark, tmp_path):
    scratch = os.path.join(ensure_checkpoint_dir(spark).removeprefix("file:"), "")
    st = spark.createDataFrame([(f"c{i}", f"text {i}", "A", [float((i * j) % 7) for j in range(64)]) for i in range(30)],
                               "chunk_id string, content string, title string, embedding array<float>")
    asked = spark.createDataFrame([(f"q{i}", f"fund yield number {i}?") for i in range(20)], "query_id string, query string")
    asked.write.json(str(tmp_path / "qin"))
    opts = AskOptions(retrieval=RetrievalOptions(broadcast_query_bytes=2000, probe_fraction=0.5))
    before = set(os.listdir(scratch))
    stream = spark.readStream.schema("query_id string, query string").json(str(tmp_path / "qin"))
    as_of = F.to_timestamp(F.lit(AS_OF))
    start_ask_stream(stream, st, str(tmp_path / "audit"), str(tmp_path / "ck"), opts, available_now=True, as_of=as_of, strategy="rounds").awaitTermination()
    assert {n for n in set(os.listdir(scratch)) - before if "ask" in n or "topk" in n} == set()
    cols = ["query_id", "outcome", "scrubbed_query", "scrubbed_response", "top_confidence_score"]
    got, want = spark.read.parquet(str(tmp_path / "audit")), ask_batch(asked, st, as_of=as_of)
    assert got.count() == 20 and sorted(map(tuple, got.select(cols).collect())) == sorted(map(tuple, want.select(cols).collect()))


def test_table_streams_read_one_file_and_folders_of_files(spark, tmp_path):
    from guardrag.plans.catalog import _parquet_stream

    for kind, parts in (("file", 1), ("folder", 3)):
        spark.range(20).repartition(parts).write.parquet(str(tmp_path / kind / "rows.parquet"))
        spark.range(5).write.parquet(str(tmp_path / kind / "other.parquet"))
    part = next((tmp_path / "file" / "rows.parquet").glob("part-*.parquet"))
    (tmp_path / "one").mkdir()
    (tmp_path / "one" / "rows.parquet").write_bytes(part.read_bytes())
    for kind in ("one", "folder"):
        sink, ckpt = str(tmp_path / f"sink-{kind}"), str(tmp_path / f"ckpt-{kind}")
        start_chunk_stream(_parquet_stream(spark, str(tmp_path / kind), "rows"), lambda df: df, sink, ckpt).awaitTermination()
        assert sorted(r["id"] for r in spark.read.parquet(sink).collect()) == list(range(20))
