"""The packing fold, ids and embedding."""

from pyspark.sql import functions as F

from conftest import evaluate, rows
from guardrag.config import ChunkingOptions
from guardrag.functions.chunking import chunk_text
from guardrag.functions.embedding import constant_embedder, hashing_embedder
from guardrag.operators.chunking import chunk_documents


def chunks_of(spark, text, opts=ChunkingOptions()):
    df = spark.createDataFrame([(text,)], "t string")
    return df.select(chunk_text("t", opts).alias("c")).first()["c"]


def test_short_document_one_chunk(spark):
    assert len(chunks_of(spark, "First paragraph.\n\nSecond paragraph.\n\nThird.")) == 1


def test_three_long_paragraphs_overlap(spark):
    paras = ["a" * 299 + "1", "b" * 299 + "2", "c" * 299 + "3"]
    out = chunks_of(spark, "\n\n".join(paras))
    assert [len(c) for c in out] == [301, 351, 351]
    for prev, nxt in zip(out, out[1:]):
        assert prev[-50:] == nxt[:50]


def test_blank_paragraphs_dropped_no_whitespace_chunk(spark):
    out = chunks_of(spark, "Para one.\n\n\n\nPara two.\n\n\n\n")
    assert out == ["Para one.\nPara two.\n"]


def test_crlf_blank_line_does_not_split(spark):
    out = chunks_of(spark, "one\r\n\r\ntwo")
    assert out == ["one\r\n\r\ntwo\n"]


def test_paragraph_longer_than_max_is_kept_whole(spark):
    out = chunks_of(spark, "x" * 3000 + "\n\nshort")
    assert len(out) == 2 and len(out[0]) == 3001 and out[1] == "x" * 49 + "\nshort\n"


def test_buffer_not_longer_than_overlap_has_no_carry(spark):
    out = chunks_of(spark, "tiny\n\n" + "y" * 600)
    assert out == ["tiny\n", "y" * 600 + "\n"]


def test_empty_content_gives_no_chunks(spark):
    assert chunks_of(spark, "") == []
    assert chunks_of(spark, None) == []


def test_whitespace_paragraph_survives(spark):
    assert chunks_of(spark, "\n") == ["\n\n"]


def test_ids_title_and_order(spark):
    docs = spark.createDataFrame([("T1", "p1 " * 200 + "\n\n" + "p2 " * 200), ("T2", "only")], "title string, content string")
    ch = rows(chunk_documents(docs).orderBy("title", "pos"))
    by_doc = {}
    for r in ch:
        by_doc.setdefault(r["title"], []).append(r)
    assert len({r["document_id"] for r in by_doc["T1"]}) == 1
    assert len({r["chunk_id"] for r in ch}) == len(ch)
    assert [r["pos"] for r in by_doc["T1"]] == list(range(len(by_doc["T1"])))
    again = rows(chunk_documents(docs).orderBy("title", "pos"))
    assert [r["chunk_id"] for r in again] == [r["chunk_id"] for r in ch]  # idempotent ids


def test_constant_embedder(spark):
    df = spark.createDataFrame([("a",), ("b",)], "t string")
    vals = [r[0] for r in df.select(constant_embedder("t")).collect()]
    assert all(len(v) == 3 for v in vals) and vals[0] == vals[1]


def test_hashing_embedder_counts_tokens(spark):
    df = spark.createDataFrame([("Fund fund FUND yield",), ("",), (None,)], "t string")
    vecs = [r[0] for r in df.select(hashing_embedder(16)(F.col("t"))).collect()]
    assert sum(vecs[0]) == 4.0 and max(vecs[0]) >= 3.0 and len(vecs[0]) == 16
    assert vecs[1] == [0.0] * 16 and vecs[2] == [0.0] * 16


def test_random_ids_opt_in(spark):
    docs = spark.createDataFrame([("T", "a\n\nb " * 300)], "title string, content string")
    ch = rows(chunk_documents(docs, random_ids=True))
    assert len({r["document_id"] for r in ch}) == 1 and len({r["chunk_id"] for r in ch}) == len(ch)
    assert all(len(r["chunk_id"]) == 32 and "-" not in r["chunk_id"] for r in ch)


def test_lengths_count_utf16_units(spark):
    text = "🙂" * 260 + "\n\n" + "x" * 10
    assert len(evaluate(spark, lambda t: chunk_text(t), text)[0]) == 2  # 520 + 10 units are over 500


def test_a_carry_that_cuts_a_character_in_two(spark):
    chunks = evaluate(spark, lambda t: chunk_text(t), "🙂" * 225 + "ab\n\n" + "y" * 100)[0]
    # "ab\n" and 47 units of emoji: 23 characters and the second half of one more.
    assert chunks[1] == "�" + "🙂" * 23 + "ab\n" + "y" * 100 + "\n"


def test_a_batch_is_chunked_slice_by_slice(monkeypatch):
    import pyarrow as pa

    from guardrag.functions import chunking

    texts = [None, ""] + [f"{'🙂' * (i % 90)}\n{'a' * (i % 70)}\nend {i}" for i in range(500)]
    whole = [chunking.pack_paragraphs([p for p in t.split("\n") if p], 100, 10) if t else [] for t in texts]
    longest, fold = [], lambda t: chunking.pack_paragraphs([p for p in t.split("\n") if p], 100, 10) if t else []
    real = pa.array
    monkeypatch.setattr(chunking, "SLICE_BYTES", 2000)
    monkeypatch.setattr(chunking.pa, "array", lambda v, *a: (longest.append(len(v)), real(v, *a))[1])
    values = real(texts)
    got = chunking._by_slices(values, fold)
    assert got.to_pylist() == whole and max(longest) < 50
    assert chunking._by_slices(values.slice(500), fold).to_pylist() == whole[500:] and chunking._by_slices(values.slice(0, 0), fold).to_pylist() == []


def test_hashing_embedder_takes_spaced_texts(spark):
    """Tokens cross to Python as one text a row; its vectors are those of the token arrays, also for odd texts."""
    import pyarrow as pa

    from guardrag.functions.embedding import bucket_histogram, spaced_tokens, tokens

    texts = [None, "", "  ", "...", " a b", "a--b a\n", "\u0130x É1 ١٢\u00a0漢字", "e\u0301 ²½ Ⅷ", "🙂𝒳𝟙🙂 z", "_a_b\t"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    rows = df.select("i", tokens("t").alias("l"), spaced_tokens("t").alias("s")).orderBy("i").collect()
    assert all((r.s or "").split(" ") == r.l or [x for x in (r.s or "").split(" ") if x] == r.l for r in rows)
    hist = bucket_histogram.__wrapped__(16).func
    assert hist(pa.array([r.s for r in rows], pa.string())).equals(hist(pa.array([r.l for r in rows], pa.list_(pa.string()))))
    assert hist(pa.array([], pa.string())).to_pylist() == []
