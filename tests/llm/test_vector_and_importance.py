"""Importance resampling, embedding near-dedup and centroid clustering against brute force."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from guardrag.llm import centroid_cluster, importance, pivot_index

VECTORS = "vec_id long, embedding array<float>, label int"


# --- importance resampling ---------------------------------------------------------------------------------

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words_of(text):
    return WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def buckets_of(text):
    w = words_of(text)
    return Counter(zlib.crc32(" ".join(w[i:i + n]).encode()) % 10000 for n in (1, 2, 3) for i in range(len(w) - n + 1))


def brute_scores(docs, items):
    s, t = Counter(), Counter()
    for _, text in docs:
        s.update(buckets_of(text))
    for text in items:
        t.update(buckets_of(text))
    total_s, total_t = sum(s.values()), sum(t.values())
    out = []
    for key, text in docs:
        found = buckets_of(text)
        weight = sum(n * math.floor(1000 * math.log((t[b] + 1) * (total_s + 10000.0) / ((s[b] + 1) * (total_t + 10000.0)))) for b, n in found.items())
        h = int(hashlib.sha256(f"42:{'null' if key is None else key}".encode()).hexdigest()[:8], 16)
        out.append([key, sum(found.values()), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), len(words_of(text)) >= 20])
    fit = sorted((r for r in out if r[4]), key=lambda r: (-r[3], r[0] is None, r[0] or 0))
    for place, r in enumerate(fit):
        r[4] = place + 1 if place < 5 * len(fit) // 100 else None
    return [tuple(r[:4]) + (r[4] or None,) for r in out]


def sample_texts(n=120):
    rng = random.Random(5)
    vocabulary = ["alpha", "Beta", "gamma", "ÉTÉ", "été", "日本語", "x1", "0", "über", "delta", "ka b", "w" * 300, "z" * 700]
    texts = [" ".join(rng.choices(vocabulary, k=rng.randrange(0, 60))) for _ in range(n)]
    return texts + [None, "", " \t-- ", "one", "a-b_c", "tail.", ",lead"] + ["the very same text " * 8] * 3


def test_scores_and_ranks_equal_brute_force(spark):
    docs = [(k, t) for k, t in enumerate(sample_texts())] + [(3, "repeated id " * 10), (None, "no id " * 12)]
    items = ["alpha beta gamma x1", None, "", "日本語 été über delta"]
    found = importance.score_documents(spark.createDataFrame(docs, "doc_id long, text string").repartition(5), spark.createDataFrame([(t,) for t in items], "text string"))
    assert Counter((r.doc_id, r.n_features, r.weight, r.score, r["rank"]) for r in found.collect()) == Counter(brute_scores(docs, items))


def test_payloads_compose_into_the_crc_of_the_joined_words():
    a, b = b"word" * 200, b" " + b"tail" * 90
    composed = importance.shifted(np.array([zlib.crc32(a)], np.uint32), np.array([len(b)])) ^ np.uint32(zlib.crc32(b))
    assert composed[0] == zlib.crc32(a + b)


def test_rows_stay_apart_in_the_scan():
    texts = ["ab cd", "", "ef", "Gh", " ij-kl "]
    data = np.frombuffer("".join(texts).encode(), np.uint8)
    offsets = np.cumsum([0, *map(len, texts)])
    found, first, n = importance.feature_buckets(data, offsets)
    assert n.tolist() == [2, 0, 1, 1, 2] and np.diff(first).tolist() == [3, 0, 1, 1, 3]
    assert Counter(found[first[0]:first[1]].tolist()) == buckets_of(texts[0]) and Counter(found[first[4]:].tolist()) == buckets_of(texts[4])


def test_empty_corpus_and_empty_target(spark):
    docs = spark.createDataFrame([(k, t) for k, t in enumerate(sample_texts(60))], "doc_id long, text string")
    none = spark.createDataFrame([], "text string")
    assert importance.score_documents(docs.limit(0), none).count() == 0
    assert [r.score is not None for r in importance.score_documents(docs, none).collect()].count(False) == 0


def test_resample_returns_whole_rows_and_takes_clashing_columns(spark):
    docs = [(k, t, f"r{k}", k, "x") for k, t in enumerate(sample_texts())] * 2
    frame = spark.createDataFrame(docs, "doc_id long, text string, row string, score int, part string").repartition(4)
    target = spark.createDataFrame([("alpha beta gamma x1",)], "text string")
    kept = importance.resample(frame, target)
    ranks = importance.score_documents(frame, target)
    assert kept.columns == frame.columns
    assert Counter(r.doc_id for r in kept.collect()) == Counter(r.doc_id for r in ranks.where("rank is not null").collect())
    assert sorted(r["rank"] for r in ranks.where("rank is not null").collect()) == list(range(1, ranks.where("rank is not null").count() + 1))


def test_ranks_cross_partitions(spark):
    n = 4000
    docs = spark.range(n).selectExpr("id as doc_id", "repeat(concat('w', id % 7, ' '), 25) as text").repartition(6)
    found = importance.score_documents(docs, spark.createDataFrame([("w1 w1 w1",)], "text string")).collect()
    order = sorted(found, key=lambda r: (-r.score, r.doc_id))
    assert [r["rank"] for r in order] == [k + 1 if k < n * 5 // 100 else None for k in range(n)]


# --- embedding near-dedup ----------------------------------------------------------------------------------

def near_group(rng, centre, n, cosine):
    noise = rng.normal(size=(n, len(centre)))
    noise -= (noise @ centre)[:, None] * centre
    noise /= np.linalg.norm(noise, axis=1, keepdims=True)
    return cosine * centre + math.sqrt(1 - cosine ** 2) * noise


def planted(seed, groups, alone, dims=64):
    rng = np.random.default_rng(seed)
    rows = []
    for size, cosine, label in groups:
        centre = rng.normal(size=dims)
        rows += [(x, label) for x in near_group(rng, centre / np.linalg.norm(centre), size, cosine)]
    rows += [(x, int(rng.integers(0, 3))) for x in rng.normal(size=(alone, dims))]
    rng.shuffle(keys := np.arange(len(rows)))
    return [(int(k), [float(np.float32(c)) for c in x], label) for k, (x, label) in zip(keys, rows)]


def brute_links(rows, near=0.98):
    def vector(r):
        if r[1] is None or r[2] is None or not r[1] or any(x is None or not math.isfinite(x) for x in r[1]) or not any(r[1]):
            return None
        return np.array(r[1], dtype=np.float64) / np.abs(r[1]).max()

    vectors = [vector(r) for r in rows]
    pairs = set()
    by: dict = {}
    for i, v in enumerate(vectors):
        if v is not None:
            by.setdefault((rows[i][2], len(v)), []).append(i)
    for own in by.values():
        x = np.stack([vectors[i] / np.linalg.norm(vectors[i]) for i in own])
        a, b = np.nonzero(np.triu(x @ x.T >= near, 1))
        pairs |= {(own[i], own[j]) for i, j in zip(a.tolist(), b.tolist())}
    return pairs


def expected(rows, pairs):
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    degree = Counter()
    for a, b in pairs:
        degree[a] += 1
        degree[b] += 1
        root[find(a)] = find(b)
    least: dict = {}
    for i, r in enumerate(rows):
        if r[0] is not None:
            least[find(i)] = min(least.get(find(i), r[0]), r[0])
    return Counter((r[0], degree[i], least.get(find(i)), r[0] == least.get(find(i))) for i, r in enumerate(rows))


def result(found):
    return Counter((r.vec_id, r.n_links, r.component_id, r.kept) for r in found.collect())


def test_near_vectors_equal_brute_force(spark):
    rows = planted(1, [(2, 0.9952, 0), (40, 0.995, 1), (5, 0.9999, 2), (12, 0.9948, 0)], 300)
    rows += [(900 + k, rows[0][1], rows[0][2]) for k in range(30)] + [(950, rows[0][1], 2), (951, [2 * x for x in rows[0][1]], rows[0][2])]
    pairs = brute_links(rows)
    assert len(pairs) > 500
    assert result(pivot_index.near_vectors(spark.createDataFrame(rows, VECTORS).repartition(4))) == expected(rows, pairs)


def test_long_lists_are_joined_in_chunks(spark):
    rows = planted(2, [(150, 0.995, 0), (60, 0.9949, 1)], 100)
    assert result(pivot_index.near_vectors(spark.createDataFrame(rows, VECTORS), chunk=16)) == expected(rows, brute_links(rows))


def test_recall_of_links_at_the_threshold(spark):
    """Pairs planted at cosines from 0.98 to 0.985, the hardest to retrieve, among vectors of their own label."""
    rng = np.random.default_rng(7)
    rows = []
    for k in range(600):
        centre = rng.normal(size=64)
        centre /= np.linalg.norm(centre)
        rows += [(2 * k, centre.tolist(), 0), (2 * k + 1, near_group(rng, centre, 1, rng.uniform(0.9801, 0.985))[0].tolist(), 0)]
    pairs = brute_links(rows)
    found = sum(r.n_links for r in pivot_index.near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")).collect()) / 2
    assert found / len(pairs) >= 0.98


def test_irregular_vectors_and_keys(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, None, 0), (2, [], 0), (3, [0.0, 0.0], 0), (4, [nan, 1.0], 0), (5, [inf, 1.0], 0), (6, [None, 1.0], 0), (7, [1.0, 1.0], None), (8, [1.0, 1.0], 0),
            (9, [2.0, 2.0], 0), (9, [2.0, 2.0], 0), (None, [3.0, 3.0], 0), (10, [1.0, 1.0, 0.0], 0), (11, [1e-30, 1e-30], 0), (12, [1e30, 1e30], 0), (None, [5.0, -5.0], 1), (13, [-1.0, -1.0], 0)]
    want = expected(rows, brute_links(rows))
    got = result(pivot_index.near_vectors(spark.createDataFrame(rows, VECTORS)))
    assert {k: v for k, v in got.items() if k[0] is not None} == {k: v for k, v in want.items() if k[0] is not None}
    assert got[(None, 5, 8, False)] == 1 and got[(None, 0, None, True)] == 1
    frame = spark.createDataFrame(rows, VECTORS)
    assert pivot_index.near_vectors(frame.limit(0)).count() == 0
    assert result(pivot_index.near_vectors(frame.selectExpr("*", "'x' as d1", "1 as node", "2 as key"))) == got


# --- centroid clustering -----------------------------------------------------------------------------------

def brute_clusters(rows, k=16, rounds=3, dims=64):
    kept = [(key, [math.floor(64 * float(np.float32(x))) for x in v]) for key, v in rows
            if v is not None and len(v) == dims and all(x is not None and math.isfinite(x) for x in v)]
    centroids = [v for _, v in sorted(kept, key=lambda r: (hashlib.sha256(f"1:{'null' if r[0] is None else r[0]}".encode()).hexdigest(), r[1]))[:k]]

    def assign():
        out = []
        for _, v in kept:
            d = [sum((a - b) ** 2 for a, b in zip(v, c)) for c in centroids]
            out.append((d.index(min(d)), min(d)))
        return out

    for _ in range(rounds):
        own = assign()
        for c in range(len(centroids)):
            members = [v for (_, v), (at, _) in zip(kept, own) if at == c]
            if members:
                centroids[c] = [sum(col) // len(members) for col in zip(*members)]
    own = assign()
    inertia = Counter()
    for c, d in own:
        inertia[c] += d
    digest = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids]
    return Counter((key, c, d, inertia[c], sum(inertia.values()), digest[c]) for (key, _), (c, d) in zip(kept, own))


def clusters(found):
    return Counter((r.vec_id, r.cluster, r.distance, r.cluster_inertia, r.inertia, r.centroid_sha256) for r in found.collect())


def cluster_rows(n=400, seed=3):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(9, 64))
    return [(k, [float(np.float32(x)) for x in centres[rng.integers(0, 9)] * 2 + rng.normal(size=64) * rng.choice([0.1, 1.0])]) for k in range(n)]


def test_clusters_equal_brute_force(spark):
    rows = cluster_rows() + [(3, [0.5] * 64), (3, [0.5] * 64), (None, [0.25] * 64), (500, None), (501, [1.0] * 63), (502, [float("nan")] + [1.0] * 63), (503, [None] + [1.0] * 63),
                             (504, [float("inf")] + [1.0] * 63), (505, [])]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<float>").repartition(3)
    assert clusters(centroid_cluster.clusters_with_inertia(frame)) == brute_clusters(rows)
    assert clusters(centroid_cluster.clusters_with_inertia(frame.selectExpr("*", "1 as row", "2 as cluster", "'k' as key"))) == brute_clusters(rows)


def test_ties_go_to_the_smaller_number_and_few_vectors_to_few_centroids(spark):
    rows = [(k, [float(k % 2)] * 64) for k in range(40)]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    assert clusters(centroid_cluster.clusters_with_inertia(frame)) == brute_clusters(rows)
    few = rows[:5]
    assert clusters(centroid_cluster.clusters_with_inertia(frame.where("vec_id < 5"))) == brute_clusters(few)
    assert centroid_cluster.clusters_with_inertia(frame.limit(0)).count() == 0


def test_bounds_hold_and_spare_distances(spark):
    rows = cluster_rows(3000, seed=8)
    state, centroids = centroid_cluster.cluster_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<float>"), rounds=6)
    found = state.collect()
    x = np.array([r.v for r in found], dtype=np.int64)
    d = np.sqrt(centroid_cluster.squared_distances(x, centroids))
    cluster, lower = np.array([r.cluster for r in found]), np.array([r.lower for r in found])
    assert (d.argmin(axis=1) == cluster).all()
    assert (np.array([r.upper for r in found]) >= d[np.arange(len(x)), cluster]).all()
    others = np.arange(len(centroids)) != cluster[:, None]
    assert (lower[others] <= d[others] + 1e-9).all()
    assert np.mean([r.scans for r in found]) < 0.8 * len(centroids) * 7


@pytest.mark.parametrize("seed", range(4))
def test_loosening_is_safe_and_less_than_the_drift(seed):
    rng = np.random.default_rng(seed)
    old = rng.integers(-100, 100, (5, 64))
    new = old + rng.integers(-8, 9, (5, 64))
    radii = rng.uniform(1, 300, 5)
    fall = centroid_cluster.loosening(old, new, radii)
    drift = np.sqrt(((new - old) ** 2).sum(axis=1))
    assert (fall <= drift + 1e-4).all() and (fall < 0.9 * drift).any()
    for i in range(5):
        x = rng.normal(size=(3000, 64))
        x = old[i] + radii[i] * rng.uniform(0, 1, (3000, 1)) ** 0.2 * x / np.linalg.norm(x, axis=1, keepdims=True)
        for j in range(5):
            towards = old[i] + radii[i] * np.stack([(new[j] - old[j]) / drift[j], (new[j] - old[i]) / np.linalg.norm(new[j] - old[i] + 1e-9)])
            for p in (x, towards):
                assert (np.linalg.norm(p - old[j], axis=1) - np.linalg.norm(p - new[j], axis=1) <= fall[i, j] + 1e-6).all()


def test_components_that_do_not_fit_are_an_error(spark):
    with pytest.raises(Exception, match="would not fit a long"):
        centroid_cluster.clusters_with_inertia(spark.createDataFrame([(1, [1e12] * 64)], "vec_id long, embedding array<double>")).collect()
