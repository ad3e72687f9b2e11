"""Language ID, sharding, WARC, URL filter, toxicity, the registered queries and the pipeline."""

import hashlib
import importlib
import random
import zlib
from pathlib import Path

import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from guardrag.llm import language_id, queries, sharding, toxicity, url_filter, warc
from guardrag.session import scratch_path

from test_text_operators import brute_components, brute_hits, brute_repeats

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
SF = "/root/testdata/sf0.01"


# --- language ID -------------------------------------------------------------------------------------------

SAMPLES = {
    "en": "the and of to in is that with for was as on are this from they which have were their",
    "de": "der die und das nicht ein ist mit sich auf für dem den von zu auch werden über schön",
    "fr": "le la les des est une dans que pour qui sur avec plus être été cette sont mais nous",
    "es": "el los las una que por con para está como más pero sus este también fue había desde",
}


def labelled(spark, langs=tuple(SAMPLES), n=30):
    rng = random.Random(1)
    rows = [(k, " ".join(rng.choices(SAMPLES[lang].split(), k=60)), lang, "s", 0) for k, lang in enumerate(list(langs) * n)]
    return spark.createDataFrame(rows, DOCS).repartition(3)


def test_language_model_predicts_and_ignores_unlabelled(spark):
    train = labelled(spark).unionByName(spark.createDataFrame([(900, "zzz zzz", None, "s", 0), (901, None, "en", "s", 0)], DOCS))
    model = language_id.train(train)
    assert model.langs == ["de", "en", "es", "fr"] and model.families == ["germanic", "romance"]
    texts = ["die und das nicht über der", "the which have were", None, "", "123 ...", "日本語", "la cette sont mais été", "también había desde está", "THE WHICH HAVE"]
    found = {r.doc_id: r for r in language_id.identify(spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string"), model).collect()}
    assert [found[i]["__lang"] for i in range(5)] == ["de", "en", "und", "und", "und"]
    assert found[5]["__lang"] != "und" and found[6]["__lang"] == "fr" and found[7]["__lang"] == "es" and found[8]["__lang"] == "en"
    assert all(0 <= r["__lang_score"] <= 1 for r in found.values()) and found[2]["__lang_score"] == 0


def test_language_without_labels_or_with_one(spark):
    docs = labelled(spark, ["en"])
    assert {r["__lang"] for r in language_id.identify(docs, language_id.train(docs)).collect()} == {"en"}
    none = docs.withColumn("lang", F.lit(None).cast("string"))
    assert {r["__lang"] for r in language_id.identify(docs, language_id.train(none)).collect()} == {"und"}
    assert language_id.identify(docs.limit(0), language_id.train(docs.limit(0))).count() == 0


def test_accepted_drops_undetermined_and_keeps_the_rest_unchanged(spark):
    docs = labelled(spark).unionByName(spark.createDataFrame([(900, None, "en", "s", 1), (901, "12 34", "en", "s", 1)], DOCS))
    kept = language_id.accepted(docs, docs)
    assert kept.columns == docs.columns and kept.exceptAll(docs).count() == 0 and docs.count() - kept.count() == 2


def test_language_held_out_accuracy(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    got = queries.op1_language_id(spark, SF).join(docs.select("doc_id", "lang"), "doc_id")
    assert got.count() == docs.count()
    assert got.where("held_out and lang_pred = lang").count() >= 0.97 * got.where("held_out").count()
    held = {r.doc_id for r in got.where("held_out").collect()}
    assert held == {r.doc_id for r in docs.select("doc_id").collect() if zlib.crc32(str(r.doc_id).encode()) % 3 == 1}


# --- sharding ----------------------------------------------------------------------------------------------


def check_shards(found, limit):
    size, members = {}, {}
    for r in found:
        size[r.shard_id] = size.get(r.shard_id, 0) + r.n_bytes
        members[r.shard_id] = members.get(r.shard_id, 0) + 1
        assert r.oversize == (r.n_bytes > limit)
    assert all(size[s] <= limit or members[s] == 1 for s in size)
    # Prefixes of bits never contain each other: the shards partition the hash space.
    bits = sorted({s.split("+")[0] for s in size})
    assert all(not b.startswith(a) or a == b for a, b in zip(bits, bits[1:])) or bits == ["*"]


def test_sharding_limits_sizes(spark):
    rng = random.Random(3)
    rows = [(i, "x" * rng.randrange(400), None, "s", 0) for i in range(300)] + [(1000, "y" * 5000, None, "s", 0), (1001, None, None, "s", 0), (None, "abc", None, "s", 0)]
    docs = spark.createDataFrame(rows, DOCS).repartition(4)
    found = sharding.assign_shards(docs, limit=2000).collect()
    assert len(found) == len(rows)
    check_shards(found, 2000)
    by = {r.doc_id: r for r in found}
    assert by[1000].oversize and by[1001].n_bytes == 0


def test_sharding_cuts_repeated_keys_exactly(spark):
    rng = random.Random(4)
    rows = [(7, "z" * rng.randrange(50, 300), None, "s", 0) for _ in range(200)] + [(i, "q" * 100, None, "s", 0) for i in range(100)]
    found = sharding.assign_shards(spark.createDataFrame(rows, DOCS).repartition(5), limit=1500).collect()
    assert len(found) == 300 and sum(r.n_bytes for r in found) == sum(len(r[1]) for r in rows)
    check_shards(found, 1500)
    assert any("+" in r.shard_id for r in found)


def test_sharding_one_huge_row_among_repeated_keys(spark):
    rows = [(7, "z" * 100, None, "s", 0) for _ in range(20)] + [(7, "y" * 9000, None, "s", 0), (7, "x" * 700, None, "s", 0), (7, "", None, "s", 0)]
    found = sharding.assign_shards(spark.createDataFrame(rows, DOCS).repartition(3), limit=1000).collect()
    check_shards(found, 1000)
    assert len(found) == 23 and sum(r.oversize for r in found) == 1
    assert len({r.shard_id for r in found}) <= 5  # two rows alone, 2,000 bytes in runs of up to 1,000


def test_sharding_empty_and_clashing_columns(spark):
    docs = spark.createDataFrame([(1, "ab", 9)], "doc_id long, text string, depth int")
    assert sharding.assign_shards(docs).collect()[0].asDict() == {"doc_id": 1, "text": "ab", "n_bytes": 2, "depth": 0, "shard_id": "*", "oversize": False}
    assert sharding.assign_shards(docs.limit(0)).count() == 0
    rows = [(i % 3, "ab" * i, i, -i, "p") for i in range(40)]
    docs = spark.createDataFrame(rows, "__bits long, __shard string, __depth int, __LEAF long, __run string")
    found = sharding.assign_shards(docs, "__bits", "__shard", limit=100).collect()
    check_shards(found, 100)
    assert sorted((r["__bits"], r["__shard"], r["__depth"], r["__LEAF"], r["__run"]) for r in found) == sorted(rows)


# --- WARC --------------------------------------------------------------------------------------------------


def hostile_pages(spark):
    big = "<p>" + "payload \r\n\r\nWARC/1.1\r\n" * 80 + "é</p>"
    rows = [(1, "http://www.Example.com/a?x=1", big), (2, "http://example.org/b", "small"), (3, "http://example.org/b", big), (4, None, None), (5, "no scheme", ""),
            (6, "http://example.org/b", big), (7, "http://a.b/\r\nX: y", "small"), (None, "http://n.n/", big), (8, "http://e.x/", "ü" * 500), (9, "http://e.x/", "ü" * 500), (10, "u", "v" * 999), (11, "u", "v" * 999)]
    return rows, spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3)


def test_archives_round_trip(spark):
    rows, pages = hostile_pages(spark)
    path = scratch_path(spark, "warc-test")
    warc.write_archives(pages, path, file_bytes=3000)
    index = warc.read_archives(spark, path).collect()
    assert len(index) == len(rows)
    by = {r.page_id: r for r in index}
    for page_id, _, html in rows:
        data = (html or "").encode()
        r = by[page_id]
        assert (r.payload_bytes, r.payload_digest) == (len(data), hashlib.sha1(data).hexdigest())
        same = [i for i, _, h in rows if i is not None and (h or "") == (html or "")]
        revisit = len(data) >= 1000 and max(same) != page_id
        assert (r.record_type, r.refers_to) == (("revisit", max(same)) if revisit else ("response", None))
    # What a reader of the files gets: payloads of responses, and of revisits through the response they refer to.
    import gzip

    payload = {}
    for f in Path(path.removeprefix("file:")).glob("part-*"):
        for _, h, body in warc.parse_archive(gzip.decompress(f.read_bytes())):
            payload[h[b"WARC-Record-ID"]] = (h.get(b"WARC-Refers-To"), body)
    for page_id, _, html in rows:
        refers, body = payload[f"<urn:page:{'null' if page_id is None else page_id}>".encode()]
        assert (payload[refers][1] if refers else body) == (html or "").encode()


def test_loser_tree_merges_any_runs():
    rng = random.Random(9)
    for k in range(1, 9):
        runs = [sorted(rng.randrange(20) for _ in range(rng.randrange(12))) for _ in range(k)]
        got = [runs[r][i] for r, i in warc.LoserTree(runs)]
        assert got == sorted(x for r in runs for x in r)


def test_merged_index_is_globally_ordered(spark):
    _, pages = hostile_pages(spark)
    path = scratch_path(spark, "warc-test")
    warc.write_archives(pages, path, file_bytes=3000)
    merged = warc.merge_index(warc.read_archives(spark, path), range_rows=4).orderBy("merge_range", "merge_pos").collect()
    keys = [(r.url_key, r.captured, r.page_id is not None, r.page_id or 0) for r in merged]
    assert len(keys) == 12 and keys == sorted(keys) and merged[0].merge_range != merged[-1].merge_range


def test_archives_of_an_empty_table(spark):
    _, pages = hostile_pages(spark)
    assert warc.archive_pages(pages.limit(0)).count() == 0


# --- URL filter --------------------------------------------------------------------------------------------


def brute_verdict(url, rules):
    host = path = ""
    if url and "://" in url:
        rest = url.split("://", 1)[1]
        cut = min([rest.find(c) for c in "/?#" if c in rest], default=len(rest))
        host, rest = "".join(c.lower() if c.isascii() else c for c in rest[:cut]), rest[cut:]
        path = rest[:min([rest.find(c) for c in "?#" if c in rest], default=len(rest))]
    fits = [(len(h + p), a, h + p) for a, h, p in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
    best = max(fits, default=None)
    return host, path, best and best[2], best[1] if best else "allow"


def test_url_filter_matches_brute_force(spark):
    rng = random.Random(12)
    hosts = ["example.com", "www.example.com", "WWW.Example.COM", "a.www.example.com", "notexample.com", "x.net", "net", "com", "example.org", "com.example", "é.net", ""]
    paths = ["", "/", "/en/", "/en", "/en/x", "/es/1?page=/fr/", "/fr/#top", "/EN/", "//en/", "?q=/es/", "#a", "/é/en/", "/en/\n/x"]
    urls = [f"{s}{h}{p}" for s in ("http://", "https://", "", "x://y://") for h in hosts for p in paths] + [None, "", "://", "http://"]
    urls += rng.choices(urls, k=200)
    frame = spark.createDataFrame([(i, u, "clash") for i, u in enumerate(urls)], "page_id long, url string, rule string").repartition(3)
    for rules in (url_filter.SITE_RULES, [("block", "example.com", "/e"), ("allow", "a-b.com", "/"), ("block", "com", "/en/x")], []):
        found = url_filter.judge_urls(frame, url_filter.rules_frame(spark, rules)).collect()
        assert len(found) == len(urls)
        for r in found:
            assert (r.host, r.path, r.rule, r.verdict) == brute_verdict(urls[r.page_id], rules), urls[r.page_id]
    assert url_filter.judge_urls(frame.limit(0), url_filter.rules_frame(spark, url_filter.SITE_RULES)).count() == 0


def test_rules_without_a_literal_token_are_candidates_everywhere(spark):
    rules = url_filter.rules_frame(spark, [("block", "пример.рф", "/"), ("block", "example.com", "/en/")])
    urls = spark.createDataFrame([("http://пример.рф/a",), ("http://x.пример.рф/",), ("http://example.com/en/1",), ("http://example.com/1",), (None,)], "url string")
    got = {r.url: (r.rule, r.verdict) for r in url_filter.judge_urls(urls, rules).collect()}
    assert got == {"http://пример.рф/a": ("пример.рф/", "block"), "http://x.пример.рф/": ("пример.рф/", "block"), "http://example.com/en/1": ("example.com/en/", "block"),
                   "http://example.com/1": (None, "allow"), None: (None, "allow")}


def test_archives_of_any_page_id(spark):
    ids = [0, 5, 10**12, 2**62, -(2**62), -1, 2**63 - 1]
    found = warc.archive_pages(spark.createDataFrame([(i, "http://a.b/", "x" * 1200) for i in ids], "page_id long, url string, html string")).collect()
    assert sorted(r.page_id for r in found) == sorted(ids) and {r.refers_to for r in found} == {None, 2**63 - 1}
    assert all(len(r.captured) == 20 and "1970" <= r.captured[:4] <= "9999" for r in found)
    order = sorted(found, key=lambda r: r.capture_pos)
    assert [r.capture_pos for r in order] == list(range(len(ids))) and [(r.url_key, r.captured, r.page_id) for r in order] == sorted((r.url_key, r.captured, r.page_id) for r in order)


def test_url_filter_is_the_same_without_broadcast(spark, monkeypatch):
    frame = spark.createDataFrame([(i, f"http://www.example.com/{p}/") for i, p in enumerate(["en", "fr", "de"])], "page_id long, url string")
    rules = url_filter.rules_frame(spark, url_filter.SITE_RULES)
    small = sorted(map(tuple, url_filter.judge_urls(frame, rules).collect()))
    monkeypatch.setattr(url_filter, "BROADCAST_RULES", 0)
    assert sorted(map(tuple, url_filter.judge_urls(frame, rules).collect())) == small


def test_rules_are_filed_under_their_rarest_token():
    assert url_filter.site_rule("block", "example.com", "/en/")[4] == ["com", "en", "example"]
    assert url_filter.site_rule("block", "example.com", "/e")[4] == ["com", "example"]


# --- toxicity ----------------------------------------------------------------------------------------------


def toxic_corpus(n=240):
    rng = random.Random(17)
    words = ["".join(rng.choices("abdeghilmnorstu", k=rng.randrange(2, 9))) for _ in range(600)]
    bad = ["grumblefex", "snarvolt", "wexitude"]
    rows = []
    for i in range(n):
        text = rng.choices(words, k=rng.randrange(20, 200))
        toxic = i % 4 == 0
        for _ in range(rng.randrange(1, 4) if toxic else 0):
            text[rng.randrange(len(text))] = rng.choice(bad)
        rows.append((i, " ".join(text), int(toxic)))
    return rows


def test_toxicity_separates_held_out_documents(spark):
    rows = toxic_corpus()
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows] + [(1000, None), (1001, ""), (1002, "  . \n"), (1003, "word")], "doc_id long, text string").repartition(3)
    labels = spark.createDataFrame([(i, y) for i, _, y in rows if i % 3] + [(5000, 1), (1, None), (None, 1)], "doc_id long, toxic int")
    model = toxicity.train(docs, labels)
    found = {r.doc_id: r["__toxicity"] for r in toxicity.score_toxicity(docs, model).collect()}
    held = [(found[i], y) for i, _, y in rows if i % 3 == 0]
    assert sum(s >= 0.3 for s, y in held if y) >= 0.9 * sum(y for _, y in held)
    assert sum(s >= 0.3 for s, y in held if not y) <= 0.05 * len(held)
    assert all(0 <= s <= 1 for s in found.values()) and found[1000] == found[1001] == found[1002] < 0.3


def test_toxicity_without_usable_labels(spark):
    docs = spark.createDataFrame([(1, "a b c"), (2, None)], "doc_id long, text string")
    for labels in ([], [(1, 1)], [(1, 0)], [(1, None)]):
        model = toxicity.train(docs, spark.createDataFrame(labels, "doc_id long, toxic int"))
        assert {r["__toxicity"] for r in toxicity.score_toxicity(docs, model).collect()} == {0.0}
    assert toxicity.score_toxicity(docs.limit(0), model).count() == 0


def test_language_training_takes_distinct_texts(spark, monkeypatch):
    rows = [("en", "the same page again")] * 900 + [("en", f"page number {i} of many") for i in range(300)] + [("de", "eine Seite")] * 40 + [("de", "noch eine")]
    monkeypatch.setattr(language_id, "Model", lambda langs, x, y: (langs, x, y))
    for most in (250, 301, 400):
        langs, x, y = language_id.train(spark.createDataFrame(rows, "lang string, text string").repartition(4), max_per_lang=most)
        assert langs == ["de", "en"] and len(x) == len(y) and (y == "de").sum() == 2 and (y == "en").sum() == min(most, 301)


def test_toxicity_training_skips_a_text_that_does_not_fit(spark, monkeypatch):
    rows = toxic_corpus()
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows] + [(9000 + i, "é" * 60_000) for i in range(6)], "doc_id long, text string").repartition(3)
    labels = spark.createDataFrame([(i, y) for i, _, y in rows] + [(9000 + i, 0) for i in range(6)], "doc_id long, toxic int")
    monkeypatch.setattr(toxicity, "fit", lambda toxic, ordinary: (sorted(toxic), sorted(ordinary)))
    small = min(100_000, toxicity.MAX_TRAIN_BYTES)
    monkeypatch.setattr(toxicity, "MAX_TRAIN_BYTES", small)
    toxic, ordinary = toxicity.train(docs, labels)
    assert toxic and ordinary and sum(map(len, toxic + ordinary)) <= small and not any("é".encode() * 60_000 == t for t in ordinary)
    only = labels.where("doc_id >= 9000 or toxic > 0")
    with pytest.raises(ValueError, match="no labelled text"):
        toxicity.train(docs, only)


def test_windows_cover_the_whole_text():
    folded = toxicity.fold("One, two\nTHREE " .encode() * 40 + "é".encode())
    parts = toxicity.windows(folded)
    assert b" ".join(p.strip() for p in parts) == folded.strip() and all(len(p) >= toxicity.WINDOW for p in parts[:-1])


# --- queries and pipeline ----------------------------------------------------------------------------------


def test_entry_registers_one_query_per_operator():
    import __spark_entry__ as entry

    names = list(entry.queries())
    assert all(sum(n.startswith(f"op{k}_") for n in names) == 1 for k in range(1, 11)) and "pipeline" in names
    assert set(entry.oracle_sql()) <= set(names)


def test_entry_imports_without_this_package(monkeypatch):
    import builtins
    import __spark_entry__ as entry

    real = builtins.__import__

    def without(name, *args, **kw):
        if name == "corpus_pipeline" or name.startswith("guardrag.llm"):
            raise ModuleNotFoundError(name=name)
        return real(name, *args, **kw)

    monkeypatch.setattr(builtins, "__import__", without)
    again = importlib.reload(entry)
    assert not any(n.startswith("op1") or n == "pipeline" for n in again.queries())
    monkeypatch.undo()
    assert "pipeline" in importlib.reload(entry).queries()


def test_pipeline_matches_brute_force(spark):
    """Each stage on the rows its predecessor kept, against plain Python over sf0.001."""
    sf = "/root/testdata/sf0.001"
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "jaccard_join", "suffix_dedup", "decontaminate", "packing"]
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    items = [(r["item_id"], r["text"]) for r in pq.read_table(f"{sf}/benchmark.parquet").to_pylist()]
    columns = docs.columns
    junk = spark.createDataFrame([(9000, "123 456", "en", "s", 7), (9001, None, "en", "s", 0)], docs.schema)
    docs = docs.unionByName(junk)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before = [(r.doc_id, r.text) for r in docs.collect()]
        path = scratch_path(spark, name)
        stage(spark, docs, sf).write.parquet(path)
        docs = spark.read.parquet(path)
        assert docs.columns == columns
        after = {r.doc_id: r for r in docs.collect()}
        if name == "language_id":
            assert set(after) == {k for k, _ in before if k < 9000}
        elif name == "jaccard_join":
            assert set(after) == {k for k, _, c in brute_components(before) if c == k}
        elif name == "suffix_dedup":
            sizes = {k: (n, gone) for k, n, gone, _, _ in brute_repeats(before)}
            assert set(after) == set(sizes)
            for k, r in after.items():
                n, gone = sizes[k]
                assert n - gone <= len(r.text.encode()) <= n - gone + 6 * (gone > 0) * 20 and r.n_chars == len(r.text)
        else:
            clean = {k for k, t in before if (b := brute_hits(t, items))[1] == 0 or 20 * b[1] < b[0]}
            assert set(after) == clean and all(after[k].text == t for k, t in before if k in clean)
    left = {r.doc_id for r in docs.collect()}
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, sf)
    assert {r.doc_id for r in packed.select("doc_id").distinct().collect()} == left
    assert packed.columns == ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]


@pytest.mark.parametrize("name", ["op2_extendible_sharding", "op5_url_filter"])
def test_native_operators_run_no_python(spark, name, capsys):
    queries.QUERIES[name](spark, "/root/testdata/sf0.001").explain("formatted")
    plan = capsys.readouterr().out
    assert not any(x in plan for x in ("ArrowEval", "BatchEvalPython", "MapInArrow", "MapInPandas", "FlatMapGroups"))
