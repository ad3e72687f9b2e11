"""Decontamination, suffix-array dedup, Jaccard join, fingerprints and packing against brute force."""

import hashlib
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from guardrag.llm import decontaminate, fingerprint, jaccard_join, language_id, packing, queries, suffix_dedup
from guardrag.llm.arrowtext import text_bytes

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def words_text(rng, n, vocabulary=400):
    return " ".join(f"w{rng.randrange(vocabulary)}" for _ in range(n))


def documents(spark, texts, ids=None):
    ids = list(range(len(texts))) if ids is None else ids
    rows = [(i, t, None, "src0", None if t is None else len(t)) for i, t in zip(ids, texts)]
    return spark.createDataFrame(rows, DOCS).repartition(3)


def hostile_texts(rng):
    """Nulls, empties, separators only, repeats, near copies, shared passages, one very long text."""
    base = [words_text(rng, rng.randrange(1, 120)) for _ in range(25)]
    passage = words_text(rng, 60)
    near = []
    for t in base[:8]:
        w = t.split()
        for _ in range(3):
            v = list(w)
            v[rng.randrange(len(v))] = "changed"
            near.append(" ".join(v))
    shared = [f"{words_text(rng, 40)} {passage} {words_text(rng, 40)}" for _ in range(6)]
    odd = [None, "", " \n\t ", "é", "日本語 テキスト 🙂🙂", "a", "A B", base[3], base[3], base[3].upper(), "x" * 70, "x" * 70, "\x00\x01" * 40]
    return base + near + shared + odd + [words_text(rng, 60_000, 5000)]


# --- decontamination ---------------------------------------------------------------------------------------

WORD = re.compile("[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def lowered(text):
    return re.sub("[A-Z]", lambda m: m.group().lower(), text or "")


def brute_hits(text, items, window=13):
    words, hit, found = WORD.findall(lowered(text)), set(), set()
    for item_id, item in items:
        iw = WORD.findall(lowered(item))
        size = min(window, len(iw))
        for s in range(len(iw) - size + 1 if size else 0):
            for p in range(len(words) - size + 1):
                if words[p:p + size] == iw[s:s + size]:
                    hit.update(range(p, p + size))
                    found.add("null" if item_id is None else str(item_id))
    return len(words), len(hit), sorted(found)


@pytest.fixture(scope="module")
def benchmark_case():
    rng = random.Random(5)
    items = [(i, words_text(rng, rng.choice([0, 1, 3, 12, 13, 14, 40]), 60)) for i in range(14)] + [(None, words_text(rng, 20, 60)), (3, words_text(rng, 15, 60)), (99, None)]
    texts = [None, "", "...", *(words_text(rng, 30, 60) for _ in range(15))]
    texts += [f"{words_text(rng, 10)} {items[k % 14][1].upper()}, {items[(k + 3) % 14][1]} {words_text(rng, 10)}" for k in range(20)]
    return texts, items


@pytest.mark.parametrize("shard_bytes", [1 << 20, 400])
def test_decontaminate_matches_brute_force(spark, benchmark_case, shard_bytes):
    texts, items = benchmark_case
    items = [(i, t) for i, t in items if t is None or len(t.split()) != 1]
    table = spark.createDataFrame(items, "item_id long, text string")
    found = decontaminate.match_items(documents(spark, texts), table, shard_bytes=shard_bytes).collect()
    assert len(found) == len(texts)
    for r in found:
        want = brute_hits(texts[r.doc_id], items)
        assert (r[decontaminate.N_WORDS], r[decontaminate.N_HIT], list(r[decontaminate.ITEMS])) == want


def test_decontaminate_one_word_items_and_empty_tables(spark):
    items = spark.createDataFrame([(1, "Alpha"), (2, "beta gamma")], "item_id long, text string")
    found = {r.doc_id: r for r in decontaminate.match_items(documents(spark, ["x alpha y", "beta", "beta gamma alpha"]), items).collect()}
    assert [found[i][decontaminate.N_HIT] for i in range(3)] == [1, 0, 3]
    assert found[2][decontaminate.ITEMS] == ["1", "2"]
    assert decontaminate.match_items(documents(spark, ["a b"]), items.limit(0)).first()[decontaminate.N_HIT] == 0
    assert decontaminate.match_items(documents(spark, ["a"]).limit(0), items).count() == 0


def test_remove_spans_cuts_long_spans_and_high_coverage(spark):
    item = " ".join(f"item{i}" for i in range(20))
    items = spark.createDataFrame([("a", item), ("b", "Short é Answer"), (None, None)], "item_id string, text string")
    filler = " ".join(f"w{i}" for i in range(300))
    rows = [(1, f"{filler}, {item.upper()}! {filler}"), (2, f"{filler} short é answer."), (3, "x short-é answer!"), (4, None), (5, ""), (6, filler), (6, filler),
            (7, " ".join(item.split()[3:18])), (8, "é" * 70_000 + " " + item)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(2).withColumn("n_chars", F.length("text")).withColumn("__spans", F.lit("own"))
    for shard_bytes in (1 << 20, 40):
        got = {(r.doc_id, r.text, r.n_chars) for r in decontaminate.remove_spans(docs, items, chars_col="n_chars", shard_bytes=shard_bytes).collect() if r["__spans"] == "own"}
        kept = {1: f"{filler}, ! {filler}", 2: rows[1][1], 3: "x !", 4: None, 5: "", 6: filler, 7: "", 8: "é" * 70_000 + " "}
        assert got == {(i, t, None if t is None else len(t)) for i, t in kept.items()}
    everything = decontaminate.remove_spans(docs, items, max_words=0).where("doc_id = 2").first()
    assert everything.text == f"{filler} ." and everything.n_chars == len(rows[1][1])
    assert decontaminate.remove_spans(docs, items.limit(0)).count() == 9 and decontaminate.remove_spans(docs.limit(0), items).count() == 0


def test_clashing_columns_come_back_as_they_were(spark):
    passage = words_text(random.Random(11), 60)
    rows = [(1, f"the first {passage} end", "en"), (2, f"ein zweiter {passage} Ende", "de"), (3, None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    for name in ("__lang", "__lang_score", "__bytes", "__key", "__had", "__kept", "__text", "__BLOCK", "__spans", "__items"):
        docs = docs.withColumn(name, F.concat(F.lit(name), F.col("doc_id")))
    own = {r.doc_id: r.asDict() for r in docs.collect()}

    def check(found, changed=()):
        assert found.columns == docs.columns
        for r in found.collect():
            assert {k: v for k, v in r.asDict().items() if k not in changed} == {k: v for k, v in own[r.doc_id].items() if k not in changed}
        return found.count()

    items = spark.createDataFrame([("a", "nothing of the kind")], "item_id string, text string")
    assert check(decontaminate.drop_contaminated(docs, items)) == 3
    assert check(suffix_dedup.deduplicate(docs), ["text"]) == 3
    assert check(language_id.accepted(docs, docs, min_score=0.0)) == 2
    found = suffix_dedup.remove_repeats(docs)
    assert found.count() == 3 and set(found.columns) == set(docs.columns) - {"text"} | {"__removed"}
    renamed = docs.select(F.col("doc_id").alias("__key"), F.col("text").alias("__kept"), F.lit(1).alias("__block"))
    assert {len(r["__kept"] or "") < 200 for r in suffix_dedup.deduplicate(renamed, "__key", "__kept").where("__key = 2").collect()} == {True}


def test_drop_contaminated_keeps_clean_rows_unchanged(spark, benchmark_case):
    texts, items = benchmark_case
    docs = documents(spark, texts)
    kept = decontaminate.drop_contaminated(docs, spark.createDataFrame(items, "item_id long, text string"))
    assert kept.columns == docs.columns
    clean = {i for i, t in enumerate(texts) if (b := brute_hits(t, items))[1] == 0 or 20 * b[1] < b[0]}
    assert {r.doc_id: r.text for r in kept.collect()} == {i: texts[i] for i in clean}


# --- suffix arrays -----------------------------------------------------------------------------------------


def brute_repeats(rows, length=50):
    first = {}
    data = [(t or "").encode() for _, t in rows]
    for (k, _), d in zip(rows, data):
        for p in range(len(d) - length + 1):
            w = d[p:p + length]
            first[w] = min(first.get(w, k), k)
    out = []
    for (k, _), d in zip(rows, data):
        gone = bytearray(len(d))
        for p in range(len(d) - length + 1):
            if first[d[p:p + length]] < k:
                gone[p:p + length] = b"\x01" * length
        kept = bytes(b for b, g in zip(d, gone) if not g)
        out.append((k, len(d), sum(gone), len(re.findall(b"\x01+", bytes(gone))), hashlib.sha256(kept).hexdigest()))
    return sorted(out)


def test_two_stage_sorting_orders_suffixes():
    rng = np.random.default_rng(2)
    for _ in range(40):
        raw = rng.integers(97, 97 + rng.integers(1, 5), rng.integers(1, 300), dtype=np.uint8)
        text = np.concatenate((raw, np.zeros(136, np.uint8)))
        order = suffix_dedup.suffix_array(text, np.arange(len(text)) < len(raw) + 1, 56)
        order = order[order < len(raw)]
        b = text.tobytes()
        keys = [b[p:p + 56] for p in order.tolist()]
        assert sorted(order.tolist()) == list(range(len(raw))) and keys == sorted(keys)


def test_window_minima_on_small_alphabets():
    rng = np.random.default_rng(3)
    for _ in range(25):
        segments = list({bytes(rng.integers(97, 97 + int(rng.integers(1, 4)), int(rng.integers(50, 85)), dtype=np.uint8)) for _ in range(40)})
        keys = rng.integers(0, 99, len(segments))
        got, _ = suffix_dedup.window_minima(segments, keys.astype(np.int64), 50)
        best = {}
        for s, k in zip(segments, keys):
            for i in range(len(s) - 49):
                best[s[i:i + 50]] = min(best.get(s[i:i + 50], 99), k)
        assert got.tolist() == [best[s[i:i + 50]] for s in segments for i in range(len(s) - 49)]


@pytest.mark.parametrize("block", [(4 << 20, 256 << 20), (4000, 4000)])
def test_remove_repeats_matches_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(suffix_dedup, "BLOCK_BYTES", block)
    rng = random.Random(11)
    texts = hostile_texts(rng)[:-1] + ["abc" * 60, "bca" * 50, "ab" * 45 + "é" * 30, "é" * 60]
    ids = list(range(len(texts)))
    ids[5] = ids[4]  # two rows with one id
    rng.shuffle(ids)
    docs = documents(spark, texts, ids)
    found = suffix_dedup.remove_repeats(docs.select("doc_id", "text")).withColumn("sha", F.sha2("__kept", 256)).collect()
    got = sorted((r.doc_id, r["__bytes"], r["__removed"], r["__spans"], r.sha) for r in found)
    assert got == brute_repeats([(r.doc_id, r.text) for r in docs.collect()])


def test_remove_repeats_null_keys_are_smallest_and_empty_table(spark):
    long = words_text(random.Random(1), 40)
    docs = spark.createDataFrame([(None, long, 1), (1, long, 2), (1, long, 3)], "doc_id long, text string, __kept_ int")
    found = {r["__kept_"]: r["__removed"] for r in suffix_dedup.remove_repeats(docs).collect()}
    assert found == {1: 0, 2: len(long), 3: len(long)}
    assert suffix_dedup.remove_repeats(docs.limit(0)).count() == 0


def test_deduplicate_keeps_columns_and_valid_text(spark):
    rng = random.Random(4)
    shared = "".join(rng.choice("éüñaß ") for _ in range(90))
    texts = ["aa" + shared, "b" + shared[1:], None, "", "plain"]
    docs = documents(spark, texts)
    kept = {r.doc_id: r for r in suffix_dedup.deduplicate(docs).collect()}
    assert suffix_dedup.deduplicate(docs).columns == docs.columns
    assert kept[0].text == texts[0] and kept[2].text is None and kept[3].text == "" and kept[4].n_chars == 5
    assert len(kept[1].text) < 10 and kept[1].n_chars == len(kept[1].text)


# --- Jaccard join ------------------------------------------------------------------------------------------

SPACED = re.compile("[^\x20\x09-\x0D]+")


def brute_set(text):
    w = SPACED.findall(lowered(text))
    return {tuple(w[i:i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def brute_components(rows):
    sets = [brute_set(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and 4 * both >= 3 * len(sets[i] | sets[j]):
                root[find(i)] = find(j)
    least = {}
    for i, (k, _) in enumerate(rows):
        least[find(i)] = min(least.get(find(i), k), k)
    return sorted((k, len(sets[i]), least[find(i)]) for i, (k, _) in enumerate(rows))


def chain(rng, n=150, steps=60):
    """A chain of near copies: neighbours link, the ends do not."""
    w = [f"c{rng.randrange(10**6)}" for _ in range(n)]
    out = []
    for i in range(steps):
        w = list(w)
        w[(7 * i) % n] = f"c{rng.randrange(10**6)}"
        out.append(" ".join(w))
    return out


@pytest.mark.parametrize("cap,block", [(4000, (4 << 20, 256 << 20)), (12, (9000, 9000))])
def test_jaccard_join_matches_brute_force(spark, monkeypatch, cap, block):
    monkeypatch.setattr(jaccard_join, "BLOCK_BYTES", block)
    rng = random.Random(8)
    texts = hostile_texts(rng)[:-1] + chain(rng) + ["same words in here today"] * 30
    ids = list(range(100, 100 + len(texts)))
    rng.shuffle(ids)
    docs = documents(spark, texts, ids)
    got = sorted((r.doc_id, r.n_shingles, r.component_id) for r in jaccard_join.join_components(docs, region_cap=cap, block_bytes=block[0]).collect())
    assert got == brute_components([(r.doc_id, r.text) for r in docs.collect()])


def test_link_finder_is_exact_on_random_sets():
    rng = random.Random(13)
    for _ in range(30):
        base = [set(rng.sample(range(60), rng.randrange(4, 30))) for _ in range(4)]
        sets = []
        for _ in range(40):
            s = set(rng.choice(base))
            for _ in range(rng.randrange(5)):
                s ^= {rng.randrange(60)}
            sets.append(sorted(s or {1}))
        finder = jaccard_join.LinkFinder(np.array([x for s in sets for x in s], dtype=np.uint64), np.concatenate(([0], np.cumsum([len(s) for s in sets]))))
        got = finder.run()
        root = list(range(len(sets)))
        for i in range(len(sets)):
            for j in range(i):
                a, b = set(sets[i]), set(sets[j])
                if 4 * len(a & b) >= 3 * len(a | b):
                    x, y = root[i], root[j]
                    root = [min(x, y) if r in (x, y) else r for r in root]
        assert got.tolist() == root


def brute_roots(sets):
    root = list(range(len(sets)))
    for i in range(len(sets)):
        for j in range(i):
            if 4 * len(sets[i] & sets[j]) >= 3 * len(sets[i] | sets[j]):
                x, y = root[i], root[j]
                root = [min(x, y) if r in (x, y) else r for r in root]
    return root


def clustered_sets(rng):
    """Groups around far templates, chains between them, and near copies of one text."""
    sets = []
    for g in range(12):
        base = set(range(1000 * g, 1000 * g + 60))
        for k in range(14):
            sets.append(base - set(rng.sample(sorted(base), rng.randrange(22))) | set(rng.sample(range(1000 * g, 1000 * g + 120), rng.randrange(12))))
    walk = set(range(80))
    for step in range(40):
        walk = walk - set(rng.sample(sorted(walk), 8)) | {90_000 + 8 * step + i for i in range(8)}
        sets.append(set(walk))
    return sets


def template_sets(rng):
    """One template with tails of their own, the case that distances do not cut."""
    return [set(range(100)) | {10_000 + 100 * k + i for i in range(rng.randrange(33))} for k in range(120)] + [set(range(100, 160))]


@pytest.mark.parametrize("make", [clustered_sets, template_sets])
@pytest.mark.parametrize("cap,rounds", [(30, 6), (30, 1), (7, 6)])
def test_large_regions_lose_no_link(spark, monkeypatch, make, cap, rounds):
    monkeypatch.setattr(jaccard_join, "ROUNDS", rounds)
    sets = make(random.Random(cap))
    rows = [(1, i, np.array(sorted(s), dtype=np.uint64).tobytes()) for i, s in enumerate(sets)]
    frame = spark.createDataFrame(rows, "region long, id long, tokens binary").repartition(3)
    found = {r.node: r.root for r in jaccard_join.components(jaccard_join._join_large(frame, cap, 20_000)).collect()}
    assert [found.get(i, i) for i in range(len(sets))] == brute_roots(sets)


def test_voronoi_regions_shrink_what_has_to_meet(spark):
    sets = clustered_sets(random.Random(4))
    rows = [(1, i, np.array(sorted(s), dtype=np.uint64).tobytes(), 0) for i, s in enumerate(sets)]
    frame = spark.createDataFrame(rows, "region long, id long, tokens binary, alone long")
    smaller, stuck, _ = jaccard_join._voronoi(frame, jaccard_join._sizes(frame), 30, 0)
    counts = [r["count"] for r in smaller.groupBy("region").count().collect()]
    assert stuck.count() == 0 and len(counts) > 2 and sum(c * c for c in counts) <= jaccard_join.PAIRS * len(sets) ** 2
    # Near copies lie in the ball of any of them: nothing is left to be joined.
    same = frame.withColumn("tokens", F.lit(rows[0][2]))
    smaller, stuck, links = jaccard_join._voronoi(same, jaccard_join._sizes(same), 30, 0)
    assert smaller.count() == stuck.count() == 0 and links.select("a").distinct().count() == len(sets)


def test_jaccard_join_nulls_empty_and_repeated_rows(spark):
    docs = documents(spark, ["one two three four five six", "one two three four five six", None, "", "x"], [7, 7, 3, 4, None])
    got = sorted(((r.doc_id is None, r.doc_id), r.n_shingles, r.component_id) for r in jaccard_join.join_components(docs).collect())
    assert got == [((False, 3), 0, 3), ((False, 4), 0, 4), ((False, 7), 2, 7), ((False, 7), 2, 7), ((True, None), 1, None)]
    assert jaccard_join.join_components(docs.limit(0)).count() == 0
    kept = jaccard_join.keep_first(docs)
    # Of the two equal rows of id 7 one stays.
    assert kept.columns == docs.columns and kept.count() == 4


def test_keep_first_goes_by_row(spark):
    t, u, v = ("one text of some words here " * 3, "another unrelated text with words " * 3, "null ids share this text too " * 3)
    rows = [(3, t, "a"), (5, t, "b"), (5, u, "c"), (7, t, "d"), (None, v, "e"), (None, v, "f"), (4, v, "g"), (4, v, "h"), (8, None, "i"), (8, None, "j")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, row string").repartition(3)
    kept = jaccard_join.keep_first(docs)
    assert kept.columns == docs.columns
    got = sorted((r.doc_id, (r.text or "")[:7]) for r in kept.collect())
    assert got == [(3, t[:7]), (4, v[:7]), (5, u[:7]), (8, ""), (8, "")]


def test_components_of_long_paths(spark):
    links = [(i, i + 1) for i in range(0, 40)] + [(100, 90), (95, 100)]
    got = {r.node: r.root for r in jaccard_join.components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(1, 41)}, 100: 90, 95: 90}


# --- fingerprints ------------------------------------------------------------------------------------------


def test_prefix_hashes_answer_spans_and_extensions():
    rng = random.Random(3)
    for _ in range(30):
        a = bytes(rng.choice(b"ab") for _ in range(80))
        b = a[rng.randrange(10):] + bytes(rng.choice(b"ab") for _ in range(20))
        x, y = (fingerprint.PrefixHash(np.frombuffer(t, dtype=np.uint8)) for t in (a, b))
        for _ in range(20):
            i, j = rng.randrange(len(a)), rng.randrange(len(b))
            want = 0
            while i + want < len(a) and j + want < len(b) and a[i + want] == b[j + want]:
                want += 1
            assert x.common_extension(i, y, j) == want
            n = rng.randrange(1, 6)
            if i + n <= len(a) and j + n <= len(b):
                assert x.equal(i, y, j, n) == (a[i:i + n] == b[j:j + n])


@pytest.mark.parametrize("range_bytes", [2 << 20, 2000])
def test_edited_pairs_match_direct_computation(spark, range_bytes):
    texts = hostile_texts(random.Random(21))
    ids = [3 * i for i in range(len(texts))]
    found = {r.doc_id: r for r in fingerprint.edited_pairs(documents(spark, texts, ids), range_bytes=range_bytes).collect()}
    order = sorted(zip(ids, texts), reverse=True)
    assert len(found) == len(order)
    for (k, t), (_, nxt) in zip(order, order[1:] + order[:1]):
        t, nxt = t or "", nxt or ""
        changed = fingerprint.edit(t, nxt)
        mine, new, other = (fingerprint.sketch(x.encode())[0] for x in (t, changed, nxt))
        r = found[k]
        assert (r.n_chars, r.edited_sha256, r.fingerprint, r.edited_fingerprint) == (len(t), hashlib.sha256(changed.encode()).hexdigest(), mine, new)
        assert r.near_edited == pytest.approx(fingerprint.likeness(mine, new)) and r.near_next == pytest.approx(fingerprint.likeness(mine, other))


def test_edited_pairs_lose_no_row_with_large_null_and_hot_keys(spark):
    rng = random.Random(12)
    big = 1 << 60
    rows = [(big + i, "".join(rng.choice("abc ") for _ in range(60))) for i in range(300)] + [(None, f"null {i} " * 6) for i in range(90)]
    rows += [(7, f"hot {i} " * rng.randrange(9)) for i in range(200)] + [(None, "null 1 " * 6)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    order = sorted(rows, key=lambda r: (r[0] is None, -(r[0] or 0), hashlib.md5(r[1].encode()).digest()))
    want = Counter()
    for (key, text), (_, after) in zip(order, order[1:] + order[:1]):
        want[key, len(text), hashlib.sha256(fingerprint.edit(text, after).encode()).hexdigest()] += 1
    for range_bytes in (1500, 1 << 20):
        got = fingerprint.edited_pairs(docs, range_bytes=range_bytes).collect()
        assert Counter((r.doc_id, r.n_chars, r.edited_sha256) for r in got) == want
    by = {r.doc_id: r for r in got if r.doc_id and r.doc_id >= big}
    for (key, text), (_, after) in zip(order[:20], order[1:21]):
        changed, n = fingerprint.edit(text, after), 0
        while n < min(len(text), len(changed)) and text[n] == changed[n]:
            n += 1
        assert by[key].common_bytes == n


def test_fingerprint_edge_cases(spark):
    docs = documents(spark, ["same text", "same text", None, ""], [5, 5, None, None])
    found = fingerprint.edited_pairs(docs).collect()
    assert len(found) == 4 and all(0 <= r.near_next <= 1 and 0 <= r.near_edited <= 1 for r in found)
    assert len({r.fingerprint for r in found}) == 2
    assert fingerprint.edited_pairs(docs.limit(0)).count() == 0
    assert fingerprint.edited_pairs(docs.limit(1)).first().near_next == 1.0
    assert {r.fingerprint for r in fingerprint.fingerprints(docs).collect()} == {r.fingerprint for r in found}


def test_short_texts_are_like_their_edits():
    def near(a, b):
        return fingerprint.likeness(fingerprint.sketch(a.encode())[0], fingerprint.sketch(b.encode())[0])

    rng = random.Random(5)
    for n in (12, 18, 40, 47, 48, 60, 100, 190, 192, 260, 400):
        a, b = ("".join(rng.choice("abcdefghijklmnopqrstuvwxyz ") for _ in range(n)) for _ in range(2))
        assert near(a, fingerprint.edit(a, b)) > 0.2 and near(a, b) < 0.1 and near(a, a) == 1
        # An edit by a shorter text may leave the next smaller class of lengths.
        assert near(a, fingerprint.edit(a, "")) > 0.25
    assert near("", "abcdefgh") == near("short text", "x" * 3 + "long text " * 60) == 0


def test_likeness_follows_span_overlap():
    rng = random.Random(2)
    a = words_text(rng, 400, 10**6)
    half = a[:len(a) // 2] + words_text(rng, 200, 10**6)
    near, far, same = (fingerprint.likeness(fingerprint.sketch(a.encode())[0], fingerprint.sketch(x.encode())[0]) for x in (half, words_text(rng, 400, 10**6), a))
    assert same == 1.0 and far < 0.05 and 0.1 < near < 0.6


# --- packing -----------------------------------------------------------------------------------------------


@pytest.fixture(scope="module")
def tokenizer():
    from tokenizers import Tokenizer

    made = Tokenizer.from_file(queries.tokenizer_path())
    made.encode_special_tokens = True
    return made


def test_encoder_equals_the_library(tokenizer):
    rng = random.Random(6)
    alphabet = ["a", "Z", " ", "  ", "\n", "\t", "'s", "'", ".", ",", "é", "ß", "日", "🙂", "7", "½", " ", "​", "<|endoftext|>", "\x00"]
    texts = ["", " ", *("".join(rng.choice(alphabet) for _ in range(rng.randrange(60))) for _ in range(400))]
    data, offsets = text_bytes(pa.array(texts))
    ids, first = packing.Encoder(queries.tokenizer_path()).encode(data, offsets)
    for i, t in enumerate(texts):
        assert ids[first[i]:first[i + 1]].tolist() == tokenizer.encode(t, add_special_tokens=False).ids


@pytest.mark.parametrize("length,shard", [(1024, 1 << 21), (64, 3000)])
def test_packing_is_whole_gapless_and_tight(spark, tokenizer, length, shard):
    texts = [t for t in hostile_texts(random.Random(31))]
    docs = documents(spark, texts)
    want = {i: tokenizer.encode(t or "", add_special_tokens=False).ids + [0] for i, t in enumerate(texts)}
    pieces, sequences = {}, {}
    for r in packing.pack(docs, queries.tokenizer_path(), length=length, shard_tokens=shard).collect():
        own = want[r.doc_id][r.start:r.start + r.length]
        assert r.doc_tokens == len(want[r.doc_id]) and r.ids_crc32 == zlib.crc32(np.array(own, dtype="<u4").tobytes())
        pieces.setdefault(r.doc_id, []).append((r.start, r.length))
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for groups, size_of in ((pieces, lambda k: len(want[k])), (sequences, None)):
        for k, spans in groups.items():
            at = 0
            for start, n in sorted(spans):
                assert start == at and n > 0
                at += n
            assert at == size_of(k) if size_of else at == length or at & (at - 1) == 0
    assert set(pieces) == set(want)


def test_neighbours_rank_lexical_likeness():
    rests = [np.array(x, dtype=np.uint16) for x in ([1, 2, 3, 4], [9, 9, 8], [1, 2, 3, 7], [5, 6], [1, 6])]
    frequency = np.zeros(1 << 16, dtype=np.int64)
    for r in rests:
        frequency[np.unique(r)] += 1
    index = packing.Bm25Index(rests, frequency, 5, 3.0)
    assert index.neighbours(0).tolist()[:2] == [0, 2] and 1 not in index.neighbours(0)


def test_packing_edge_cases(spark):
    docs = documents(spark, [None, None, "a b c"], [None, 4, 4])
    got = packing.pack(docs, queries.tokenizer_path())
    assert sorted(((r.doc_id is None, r.doc_id), r.doc_tokens) for r in got.select("doc_id", "doc_tokens").distinct().collect()) == [((False, 4), 1), ((False, 4), 4), ((True, None), 1)]
    assert packing.pack(docs.limit(0), queries.tokenizer_path()).count() == 0


def test_added_tokens_get_their_own_ids(spark):
    from tokenizers import Tokenizer

    loaded, end = Tokenizer.from_file(queries.tokenizer_path()), "<|endoftext|>"
    rng = random.Random(9)
    parts = [end, end, "<|endof", "text|>", " ", "  ", "a", "word", "\n", "é", "日", "'s"]
    texts = [f"a {end} b", end, "", end + end, "<|endof", "text|>", f" {end} ", *("".join(rng.choice(parts) for _ in range(rng.randrange(12))) for _ in range(300))]
    want = [loaded.encode(t, add_special_tokens=False).ids for t in texts]
    assert want[0] == [64, 220, 50256, 275]
    data, offsets = text_bytes(pa.array(texts))
    ids, first = packing.Encoder(queries.tokenizer_path()).encode_texts(data, offsets)
    assert [ids[first[i]:first[i + 1]].tolist() for i in range(len(texts))] == want
    rows = packing.tokenise(documents(spark, texts), queries.tokenizer_path()).collect()
    assert {r.key: np.frombuffer(r.ids, dtype=np.uint16).tolist() for r in rows} == {i: w + [0] for i, w in enumerate(want)}


@pytest.mark.parametrize("shard", [1 << 21, 300])
def test_packing_retrieves_from_all_shards(spark, shard):
    rng = random.Random(17)
    topics = [[f"{chr(97 + t)}{rng.randrange(10**4)}" for _ in range(30)] for t in range(8)]
    texts = [" ".join(rng.choice(topics[i % 8]) for _ in range(rng.randrange(4, 18))) for i in range(120)]
    docs = documents(spark, texts).repartition(5, "doc_id")
    length = 256
    got = packing.pack(docs, queries.tokenizer_path(), length=length, shard_tokens=shard).collect()
    together = {}
    for r in got:
        together.setdefault(r.sequence_id, set()).add(r.doc_id % 8)
    # Documents of a topic meet whatever shard they are in: a sequence of unrelated documents holds most topics.
    assert np.mean([len(t) for t in together.values()]) < 2.5


def test_rankings_cover_all_shards_and_rounds_lose_nothing(spark, monkeypatch):
    rng = np.random.default_rng(4)
    rests = [rng.choice(np.arange(40 * (i % 5), 40 * (i % 5) + 60), rng.integers(1, 60)).astype(np.uint16) for i in range(150)]
    tokens = spark.createDataFrame([(bytearray(r.tobytes()), (i // 40 << 33) + i % 40) for i, r in enumerate(rests)], "ids binary, row long").repartition(3)
    frequency, total, mean = packing.term_statistics(tokens, 64)
    starts, used = np.array([0, 40, 80, 120]), np.arange(150) % 7 == 3
    index = packing.Bm25Index(rests, frequency, total, mean)
    seeds = [0, 149, 20, 77]
    asked = packing.seed_terms(spark, tokens, starts, seeds, 150, 64)
    for entries, shard in ((9, 100), (150, 1 << 21), (40, 700)):
        found = packing.rank(spark, tokens, starts, (frequency, total, mean), asked, used, entries, 64, shard)
        for seed, ranked in zip(seeds, found):
            want = [i for i in index.neighbours(seed).tolist() if not used[i]]
            assert ranked.tolist() == want[:entries]
    monkeypatch.setattr(packing, "MIN_SEEDS", 8)
    monkeypatch.setattr(packing, "LIST_ENTRIES", 16)
    packer = packing.Packer(np.array([len(r) for r in rests]), 64)
    while (now := packer.seeds())[0]:
        free = ~packer.used
        packer.fill({s: np.array([i for i in index.neighbours(s) if free[i]][:now[1]], dtype=np.int64) for s in now[0]}, now[1])
    packer.finish()
    pieces = packer.pieces()
    for column, size_of in ((0, {i: len(r) for i, r in enumerate(rests)}), (3, None)):
        spans = {}
        for p in pieces.tolist():
            spans.setdefault(p[column], []).append((p[1] if column == 0 else p[4], p[2]))
        for k, own in spans.items():
            ends = np.cumsum([n for _, n in sorted(own)])
            assert [s for s, _ in sorted(own)] == [0, *ends[:-1].tolist()]
            assert ends[-1] == size_of[k] if size_of else ends[-1] == 64 or ends[-1] & (ends[-1] - 1) == 0


def test_packing_keeps_copies_together_and_shards_lose_no_neighbour(spark):
    rng = random.Random(23)
    texts = [" ".join(f"w{rng.randrange(3000)}" for _ in range(rng.randrange(5, 25))) for _ in range(90)]
    texts = [t for t in texts for _ in range(3)]
    docs = documents(spark, texts).repartition(4, "doc_id")
    got = packing.pack(docs, queries.tokenizer_path(), length=128, shard_tokens=1500).collect()
    places = {}
    for r in got:
        places.setdefault(r.doc_id // 3, set()).add(r.sequence_id)
    # Three copies cut into a few pieces lie in neighbouring sequences; dealt at random they would lie in twice as many.
    assert np.mean([len(p) for p in places.values()]) < 3.5
    assert len({(r.sequence_id, r.offset) for r in got}) == len(got)


def test_shard_packing_follows_the_ranking():
    rng = np.random.default_rng(8)
    rests = [rng.choice(np.arange(30 * (i % 4), 30 * (i % 4) + 45), rng.integers(1, 40)).astype(np.uint16) for i in range(160)]
    frequency = np.zeros(1 << 16, dtype=np.int64)
    for r in rests:
        frequency[np.unique(r)] += 1
    statistics = (frequency, len(rests), float(np.mean([len(r) for r in rests])))
    index = packing.Bm25Index(rests, *statistics)
    left, start, out, line, seed = [len(r) for r in rests], [0] * len(rests), [], [], -1

    def take(i):
        n = min(left[i], 64 - sum(x[2] for x in line))
        line.append((i, start[i], n))
        start[i] += n
        left[i] -= n
        if sum(x[2] for x in line) == 64:
            out.append(list(line))
            line.clear()
            return True
        return False

    while any(left):
        seed = seed if seed >= 0 and left[seed] else next(i for i, n in enumerate(left) if n)
        if take(seed):
            continue
        cut = next((i for i in index.neighbours(seed).tolist() if left[i] and take(i)), -1)
        seed = cut
    for look in (2, 64):
        got = {}
        for d, s, n, q, o in packing.pack_shard(rests, statistics, 64, look):
            got.setdefault(q, []).append((o, (d, s, n)))
        assert [[x for _, x in sorted(got[q])] for q in range(len(out))] == out
    assert (index.score_of(3) == index.scores(np.unique(rests[3]), np.array([0, len(np.unique(rests[3]))]))[0]).all()


def test_neighbours_score_every_term_of_the_seed():
    rests = [np.arange(60, dtype=np.uint16), np.array([59], dtype=np.uint16), *(np.array([59, 70 + i], dtype=np.uint16) for i in range(3)), np.array([99], dtype=np.uint16)]
    frequency = np.zeros(1 << 16, dtype=np.int64)
    for r in rests:
        frequency[np.unique(r)] += 1
    assert set(packing.Bm25Index(rests, frequency, len(rests), 12.0).neighbours(0).tolist()) == {0, 1, 2, 3, 4}
