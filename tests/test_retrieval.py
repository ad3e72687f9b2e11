"""Cosine arithmetic, single and batch top-k, edge rules, both physical strategies."""

import math

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from conftest import SF_CHECK, rows
from guardrag.functions.similarity import cosine
from guardrag.operators.retrieval import QueryBlock, TopK, exact_cosine, search, topk_batch
from guardrag.plans import fixtures as fx

VEC = "chunk_id string, embedding array<float>, content string, title string"


def store(spark, vecs):
    return spark.createDataFrame([(str(i), v, f"c{i}", f"t{i}") for i, v in enumerate(vecs)], VEC)


def reference_cosine(a, b):
    """Plain-Python statement of the rule: float32 products summed in double."""
    if a is None or b is None or len(a) != len(b):
        return 0.0
    f = np.float32
    dot = ma = mb = 0.0
    for x, y in zip(a, b):
        dot += float(f(x) * f(y))
        ma += float(f(x) * f(x))
        mb += float(f(y) * f(y))
    if ma <= 5e-324 or mb <= 5e-324:
        return 0.0
    return float(np.float32(dot / (math.sqrt(ma) * math.sqrt(mb))))


def test_identical_vectors_score_one(spark):
    r = rows(search(store(spark, [[1.0, 0.0, 0.0]]), [1.0, 0.0, 0.0], 1))
    assert abs(r[0]["score"] - 1.0) < 1e-3


def test_parallel_first_orthogonal_last(spark):
    r = rows(search(store(spark, [[0.0, 1.0, 0.0], [1.0, 0.0, 0.0]]), [1.0, 0.0, 0.0], 2))
    assert [x["chunk_id"] for x in r] == ["1", "0"] and [x["rank"] for x in r] == [1, 2]


@pytest.mark.parametrize("n,k,expect", [(10, 3, 3), (2, 100, 2), (0, 5, 0)])
def test_k_bounds(spark, n, k, expect):
    rng = np.random.default_rng(1)
    vecs = [rng.standard_normal(3).astype(np.float32).tolist() for _ in range(n)]
    df = store(spark, vecs) if n else spark.createDataFrame([], VEC)
    assert search(df, [1.0, 0.5, 0.0], k).count() == expect


def test_k_zero_or_negative_is_empty(spark):
    s = store(spark, [[1.0, 0.0]])
    assert search(s, [1.0, 0.0], 0).count() == 0
    q = spark.createDataFrame([("q", [1.0, 0.0])], "query_id string, embedding array<float>")
    assert topk_batch(s, q, -1).count() == 0


def test_empty_query_vector_is_an_error(spark):
    with pytest.raises(ValueError):
        search(store(spark, [[1.0]]), [], 1)


def test_dimension_mismatch_is_an_error(spark):
    with pytest.raises(Exception):
        search(store(spark, [[1.0, 0.0, 0.0]]), [1.0, 0.0], 1).collect()


def test_zero_vector_and_unequal_lengths_score_zero(spark):
    df = spark.createDataFrame([([0.0, 0.0], [1.0, 2.0]), ([1.0, 2.0], [1.0, 2.0, 3.0]), (None, [1.0])],
                               "a array<float>, b array<float>")
    assert [r[0] for r in df.select(cosine("a", "b")).collect()] == [0.0, 0.0, 0.0]


def test_nan_scores_sort_last_and_ties_by_id(spark):
    s = spark.createDataFrame([("b", [1.0, 0.0]), ("a", [1.0, 0.0]), ("n", [float("nan"), 1.0]), ("z", [0.0, 1.0])],
                              "chunk_id string, embedding array<float>")
    r = rows(search(s, [1.0, 0.0], 4))
    assert [x["chunk_id"] for x in r] == ["a", "b", "z", "n"]
    q = spark.createDataFrame([("q", [1.0, 0.0])], "query_id string, embedding array<float>")
    for strategy in ("broadcast", "blocked"):
        rb = rows(topk_batch(s, q, 4, strategy=strategy).orderBy("rank"))
        assert [x["chunk_id"] for x in rb] == ["a", "b", "z", "n"]


def test_cosine_matches_plain_python(spark):
    rng = np.random.default_rng(7)
    pairs = [(rng.standard_normal(64).astype(np.float32).tolist(), rng.standard_normal(64).astype(np.float32).tolist())
             for _ in range(50)]
    df = spark.createDataFrame(pairs, "a array<float>, b array<float>")
    got = [r[0] for r in df.select(cosine("a", "b")).collect()]
    assert got == [reference_cosine(a, b) for a, b in pairs]
    a = np.array([p[0] for p in pairs], np.float32)
    b = np.array([p[1] for p in pairs], np.float32)
    a2 = np.cumsum(a * a, axis=1, dtype=np.float64)[:, -1]
    b2 = np.cumsum(b * b, axis=1, dtype=np.float64)[:, -1]
    assert exact_cosine(a, b, a2, b2).tolist() == got


@pytest.mark.parametrize("strategy", ["broadcast", "blocked", "rounds"])
def test_batch_equals_single_search(spark, strategy):
    s = fx.vector_store(spark, SF_CHECK)
    q = fx.vector_queries(spark, SF_CHECK)
    from guardrag.config import RetrievalOptions
    opts = RetrievalOptions(chunk_block_rows=120, query_block_rows=90)  # force many cells
    bound = 20_000 if strategy == "rounds" else 64 << 20  # 500 questions × 320 B → 8 rounds
    batch = rows(topk_batch(s, q, 5, opts=opts, strategy=strategy, broadcast_query_bytes=bound))
    got = {}
    for r in batch:
        got.setdefault(r["query_id"], []).append((r["rank"], r["chunk_id"], r["score"]))
    assert len(got) == q.count()
    for qid in ["1", "17", "256"]:
        vec = q.filter(F.col("query_id") == qid).first()["embedding"]
        single = [(r["rank"], r["chunk_id"], r["score"]) for r in rows(search(s, vec, 5))]
        assert sorted(got[qid]) == single


def test_batch_equals_brute_force(spark):
    rng = np.random.default_rng(3)
    cv = rng.standard_normal((300, 8)).astype(np.float32)
    cv[5] = cv[6]  # exact tie
    qv = rng.standard_normal((40, 8)).astype(np.float32)
    s = spark.createDataFrame([(f"c{i:03d}", cv[i].tolist()) for i in range(300)], "chunk_id string, embedding array<float>")
    q = spark.createDataFrame([(f"q{j}", qv[j].tolist()) for j in range(40)], "query_id string, embedding array<float>")
    expect = {}
    for j in range(40):
        sc = [(reference_cosine(cv[i].tolist(), qv[j].tolist()), f"c{i:03d}") for i in range(300)]
        sc.sort(key=lambda t: (-t[0], t[1]))
        expect[f"q{j}"] = [(r + 1, cid, sc_) for r, (sc_, cid) in enumerate(sc[:4])]
    for strategy, bound in (("broadcast", 64 << 20), ("blocked", 64 << 20), ("rounds", 3000), ("auto", 3000)):
        got = {}
        for r in rows(topk_batch(s, q, 4, strategy=strategy, broadcast_query_bytes=bound)):
            got.setdefault(r["query_id"], []).append((r["rank"], r["chunk_id"], r["score"]))
        assert {k: sorted(v) for k, v in got.items()} == expect


def test_batch_plan_has_no_cartesian_product(spark):
    s = fx.vector_store(spark, SF_CHECK)
    q = fx.vector_queries(spark, SF_CHECK)
    for strategy in ("broadcast", "blocked"):
        plan = topk_batch(s, q, 5, strategy=strategy)._jdf.queryExecution().executedPlan().toString()
        assert "CartesianProduct" not in plan and "NestedLoopJoin" not in plan
        assert "Window" in plan


@pytest.mark.parametrize("strategy", ["broadcast", "blocked"])
@pytest.mark.parametrize("fraction", [0.3, 0.01])
def test_probe_bound_pruning_keeps_results_exact(spark, strategy, fraction):
    rng = np.random.default_rng(11)
    cv = rng.integers(-2, 3, size=(400, 6)).astype(np.float32)  # many exact ties
    qv = rng.integers(-2, 3, size=(30, 6)).astype(np.float32)
    s = spark.createDataFrame([(f"c{i:03d}", cv[i].tolist()) for i in range(400)], "chunk_id string, embedding array<float>")
    q = spark.createDataFrame([(f"q{j}", qv[j].tolist()) for j in range(30)], "query_id string, embedding array<float>")
    plain = sorted(map(tuple, topk_batch(s, q, 5, strategy=strategy, probe_fraction=0.0).collect()))
    pruned = sorted(map(tuple, topk_batch(s, q, 5, strategy=strategy, probe_fraction=fraction).collect()))
    assert pruned == plain and len(plain) == 150


def test_score_cell_bounds_drop_only_losers():
    from guardrag.operators.retrieval import score_cell
    rng = np.random.default_rng(5)
    c = rng.standard_normal((200, 4)).astype(np.float32)
    qm = rng.standard_normal((3, 4)).astype(np.float32)
    ids = np.array([f"c{i:03d}" for i in range(200)], dtype=object)
    qi, ci, sc = score_cell(qm, c, ids, 5)
    kth = np.array([sc[qi == j].min() for j in range(3)], dtype=np.float32)
    qb, cb, sb = score_cell(qm, c, ids, 5, bounds=kth)
    assert sorted(zip(qi, ci)) == sorted(zip(qb, cb))
    qn, cn, _ = score_cell(qm, c, ids, 5, bounds=kth + np.float32(1.0))
    assert len(qn) == 0


def test_rounds_with_probe_bound(spark):
    rng = np.random.default_rng(21)
    cv = rng.integers(-3, 4, size=(300, 5)).astype(np.float32)
    qv = rng.integers(-3, 4, size=(60, 5)).astype(np.float32)
    s = spark.createDataFrame([(f"c{i:03d}", cv[i].tolist()) for i in range(300)], "chunk_id string, embedding array<float>")
    q = spark.createDataFrame([(f"q{j:02d}", qv[j].tolist()) for j in range(60)], "query_id string, embedding array<float>")
    plain = sorted(map(tuple, topk_batch(s, q, 3, strategy="broadcast", probe_fraction=0.0).collect()))
    both = sorted(map(tuple, topk_batch(s, q, 3, strategy="rounds", probe_fraction=0.25,
                                        broadcast_query_bytes=2000).collect()))
    assert both == plain and len(plain) == 180


STRATEGIES = [dict(strategy="broadcast"), dict(strategy="rounds", broadcast_query_bytes=64), dict(strategy="blocked"), dict(strategy="broadcast", probe_fraction=0.5)]


@pytest.mark.parametrize("how", STRATEGIES, ids=lambda h: "-".join(map(str, h.values())))
def test_null_and_repeated_question_ids_are_separate_questions(spark, how):
    rng = np.random.default_rng(4)
    s = store(spark, rng.standard_normal((30, 4)).astype(np.float32).tolist())
    vectors = rng.standard_normal((5, 4)).astype(np.float32).tolist()
    q = spark.createDataFrame(list(zip([None, None, "1", "1", "2"], vectors)), "query_id string, embedding array<float>")
    got = rows(topk_batch(s, q, 3, carry=["content", "title"], **how))
    want = [(i, r["rank"], r["chunk_id"], r["score"], r["content"], r["title"]) for i, v in zip([None, None, "1", "1", "2"], vectors) for r in rows(search(s, v, 3))]
    key = lambda r: (r[0] or "", *r[1:])
    assert sorted((tuple(r[c] for c in ("query_id", "rank", "chunk_id", "score", "content", "title")) for r in got), key=key) == sorted(want, key=key)


def test_irregular_vectors_follow_the_exact_rule(spark):
    """Subnormal products, overflow, NaN and zero vectors, on both sides, in random mixtures."""
    from guardrag.operators.retrieval import _select_topk, _squared_norms, score_cell

    rng = np.random.default_rng(6)
    for _ in range(40):
        scale = rng.choice([1.0, 1e-22, 1e-20, 1e-15, 1e19, 0.0], size=(60, 1), p=[0.5, 0.2, 0.1, 0.1, 0.05, 0.05])
        v = (rng.standard_normal((60, 16)) * scale).astype(np.float32)
        v[rng.integers(60)][0] = np.nan
        c, q = v[:45], v[45:]
        ids = np.array([f"{i:03d}" for i in range(45)])
        qi, ci, score = score_cell(q, c, ids, 5, tile_entries=int(rng.choice([16, 200, 1 << 24])))
        qa, ca = np.repeat(np.arange(15), 45), np.tile(np.arange(45), 15)
        exact = exact_cosine(c[ca], q[qa], _squared_norms(c)[ca], _squared_norms(q)[qa])
        top = _select_topk(qa, exact, ids[ca], 5)
        want = sorted(zip(qa[top].tolist(), ca[top].tolist(), np.nan_to_num(exact[top], nan=9.0).tolist()))
        assert sorted(zip(qi.tolist(), ci.tolist(), np.nan_to_num(score, nan=9.0).tolist())) == want


def test_only_ids_and_vectors_enter_the_scan(spark):
    s = store(spark, [[1.0, 0.0], [0.0, 1.0]])
    q = spark.createDataFrame([("q", [1.0, 0.0])], "query_id string, embedding array<float>")
    plan = topk_batch(s, q, 1)._jdf.queryExecution().executedPlan().toString()
    scan = next(line for line in plan.splitlines() if "MapInArrow" in line)
    assert "content" not in scan and "title" not in scan


def test_questions_that_do_not_fit_are_told_apart(spark):
    from guardrag.operators.retrieval import split_questions

    rows = [("a", [1.0, 2.0]), ("b", None), ("c", []), ("d", [1.0]), ("d", [1.0]), (None, [1.0, 2.0])]
    queries = spark.createDataFrame(rows, "query_id string, embedding array<float>")
    good, bad = split_questions(queries, 2)
    assert sorted(r.query_id or "" for r in good.collect()) == ["", "a"] and good.columns == queries.columns
    assert sorted((r.query_id, r.reason) for r in bad.collect()) == [("b", "empty_vector"), ("c", "empty_vector"), ("d", "dimension_mismatch"), ("d", "dimension_mismatch")]
    good, bad = split_questions(queries, None)
    assert good.count() == 4 and bad.count() == 2


def test_kernel_memory_is_bounded_and_equal_chunks_flood_nothing():
    """Zero questions, and stores of copies, tie with every chunk: no more than k pairs a question are held, and the smallest ids win over all batches."""
    import pyarrow as pa

    from guardrag.operators.retrieval import QueryBlock, TopK, _select_topk, _squared_norms

    rng = np.random.default_rng(8)
    q = np.concatenate([np.zeros((20, 8)), rng.standard_normal((20, 8)), np.full((3, 8), np.nan), np.full((2, 8), 1e-21)]).astype(np.float32)
    c = rng.standard_normal((6, 8)).astype(np.float32)[rng.integers(0, 6, 3000)]
    c[::7], c[3::11], c[5::13] = 0, np.nan, c[5::13] * np.float32(1e-20)
    ids = np.array([f"{i:05d}" for i in rng.permutation(3000)])
    top, offered = TopK(QueryBlock(q), 4), []
    merge = top._offer
    top._offer = lambda a, b, s: (offered.append(len(a)), merge(a, b, s))
    for s in range(0, 3000, 1000):
        top.add(c[s:s + 1000], pa.array(ids[s:s + 1000]))
    qi, at, score = top.result()
    got = sorted(zip(qi.tolist(), np.array(top.ids)[at].tolist(), np.nan_to_num(score, nan=9.0).tolist()))
    qa, ca = np.repeat(np.arange(45), 3000), np.tile(np.arange(3000), 45)
    exact = exact_cosine(c[ca], q[qa], _squared_norms(c)[ca], _squared_norms(q)[qa])
    best = _select_topk(qa, exact, ids[ca], 4)
    assert got == sorted(zip(qa[best].tolist(), ids[ca[best]].tolist(), np.nan_to_num(exact[best], nan=9.0).tolist()))
    assert sum(offered) < 45 * 4 * 3 * 20  # of 135,000 pairs, nearly all of them ties


def test_ids_of_lost_pairs_are_forgotten(monkeypatch):
    import pyarrow as pa

    from guardrag.operators import retrieval

    monkeypatch.setattr(retrieval, "MAX_IDS", 50)
    rng = np.random.default_rng(9)
    c, q = rng.standard_normal((600, 4)).astype(np.float32), rng.standard_normal((5, 4)).astype(np.float32)
    ids = np.array([f"{i:03d}" for i in range(600)])
    top = retrieval.TopK(retrieval.QueryBlock(q), 3)
    for s in range(0, 600, 40):
        top.add(c[s:s + 40], pa.array(ids[s:s + 40]))
        assert len(top.ids) <= 50 + 40
    qi, at, _ = top.result()
    qn, cn, _ = retrieval.score_cell(q, c, ids, 3)
    assert sorted(zip(qi.tolist(), np.array(top.ids)[at].tolist())) == sorted(zip(qn.tolist(), ids[cn].tolist()))


def test_pairs_of_many_tiles_are_scored_together():
    """A question's pairs from one tile of chunks are few: they wait for those of other tiles, and the ranking stays exact."""
    import pyarrow as pa

    from guardrag.operators.retrieval import QueryBlock, TopK, _squared_norms

    rng = np.random.default_rng(12)
    c, q = rng.standard_normal((8000, 16)).astype(np.float32), rng.standard_normal((300, 16)).astype(np.float32)
    exact = np.stack([exact_cosine(c, np.broadcast_to(v, c.shape), _squared_norms(c), np.full(len(c), n)) for v, n in zip(q, _squared_norms(q))])
    best = np.argsort(-exact, axis=1, kind="stable")[:, :5]
    kth = np.take_along_axis(exact, best[:, -1:], axis=1)[:, 0]
    top, merges = TopK(QueryBlock(q, kth), 5, tile_entries=1 << 12), []
    merge = top._offer
    top._offer = lambda a, b, s: (merges.append(len(a)), merge(a, b, s))
    top.add(c, pa.array([f"{i:05d}" for i in range(8000)]))
    qi, at, _ = top.result()
    ids = np.array(top.ids)[at].astype(int)
    assert sorted(zip(qi.tolist(), ids.tolist())) == sorted((i, int(x)) for i in range(300) for x in best[i])
    assert len([n for n in merges if n]) <= 2 and sum(merges) < 300 * 5 * 2  # once per tile before: some hundreds


def test_probe_runs_in_few_tasks_and_grows_slower_than_the_store(spark, monkeypatch):
    from guardrag.operators import retrieval

    rng = np.random.default_rng(13)
    s = spark.createDataFrame([(f"{i:04d}", v.tolist()) for i, v in enumerate(rng.standard_normal((2000, 8)).astype(np.float32))], "chunk_id string, embedding array<float>").repartition(64)
    q = spark.createDataFrame([(f"q{i}", v.tolist()) for i, v in enumerate(rng.standard_normal((20, 8)).astype(np.float32))], "query_id string, embedding array<float>")
    plain = sorted(map(tuple, topk_batch(s, q, 3, probe_fraction=0.0).collect()))
    seen, bounds = [], retrieval._with_bounds
    monkeypatch.setattr(retrieval, "_with_bounds", lambda c, q, k, f, *rest: (seen.append(f), bounds(c, q, k, f, *rest))[1])
    monkeypatch.setattr(retrieval, "PROBE_MIN_ROWS", 1000)
    monkeypatch.setattr(retrieval, "PROBE_COST", 20)
    cells, parts = retrieval._broadcast_cells, []
    monkeypatch.setattr(retrieval, "_broadcast_cells", lambda c, *rest, **how: (parts.append(c.rdd.getNumPartitions()), cells(c, *rest, **how))[1])
    assert sorted(map(tuple, topk_batch(s, q, 3).collect())) == plain
    assert seen == [pytest.approx((20 * 3 / 2000) ** 0.5)]
    assert parts == [min(64, spark.sparkContext.defaultParallelism), 64]


def test_score_tiles_share_one_small_buffer(monkeypatch):
    """All tiles of a batch use the same memory of 1 MiB at most, a column a question; the ranking is that of the exact rule, also for some questions only."""
    import pyarrow as pa

    from guardrag.operators.retrieval import QueryBlock, TopK

    rng = np.random.default_rng(5)
    q, c = rng.random((1500, 8), np.float32), rng.random((1100, 8), np.float32)
    tiles, own = [], np.matmul
    monkeypatch.setattr(np, "matmul", lambda a, b, out: (tiles.append((out.__array_interface__["data"][0], out.shape)), own(a, b, out=out))[1])
    top = TopK(QueryBlock(q), 3)
    some = np.r_[0:700, 900:1500]
    top.add(c, pa.array(np.arange(1100)), some)
    qi, at, score = top.result()
    assert len({address for address, _ in tiles}) == 1
    assert max(rows * columns for _, (rows, columns) in tiles) <= 1 << 18 and {rows for _, (rows, _) in tiles} == {512, 76}
    n2 = lambda m: np.cumsum(m * m, axis=1, dtype=np.float64)[:, -1]
    for x in (0, 699, 900, 1499):
        exact = exact_cosine(c, np.repeat(q[x:x + 1], 1100, axis=0), n2(c), np.repeat(n2(q[x:x + 1]), 1100))
        want = np.lexsort((np.arange(1100), -exact))[:3]
        assert list(top.ids.take(pa.array(at[qi == x])).to_pylist()) == list(want) and (score[qi == x] == exact[want]).all()
    assert set(qi) == set(some)


def ranked_by_kernel(chunks, ids, questions, k, bounds=None, batch=3000):
    """Question → [(score, id)] of the cell kernel, fed batch by batch."""
    top = TopK(QueryBlock(questions, bounds), k)
    for s in range(0, len(chunks), batch):
        top.add(chunks[s:s + batch], pa.array(ids[s:s + batch]))
    out = {}
    for q, at, score in zip(*top.result()):
        out.setdefault(int(q), []).append((float(score), top.ids[int(at)].as_py()))
    return {q: sorted(x, key=lambda t: (-t[0], t[1])) for q, x in out.items()}


def ranked_by_rule(chunks, ids, questions, k):
    c2, out = np.cumsum(chunks * chunks, axis=1, dtype=np.float64)[:, -1], {}
    for q, v in enumerate(questions):
        many = np.broadcast_to(v, chunks.shape)
        score = exact_cosine(chunks, many, c2, np.full(len(chunks), np.cumsum(v * v, dtype=np.float64)[-1]))
        out[q] = sorted(((float(x), i) for x, i in zip(score, ids)), key=lambda t: (-t[0], t[1]))[:k]
    return out


def token_counts(n, seed, dim=64, longest=None):
    """Vectors as the hashing embedder gives them: counts of tokens, some common and most rare, in texts of all lengths."""
    rng = np.random.default_rng(seed)
    weight = rng.dirichlet(np.full(dim, 0.3), 5)
    length = rng.integers(1, longest, n) if longest else rng.geometric(1 / 60, n)
    return np.stack([rng.multinomial(x, weight[i % 5]) for i, x in enumerate(length)]).astype(np.float32)


@pytest.mark.parametrize("bounded", [False, True])
def test_kernel_on_token_counts_equals_the_rule(bounded):
    chunks, questions, k = token_counts(9000, 1), token_counts(300, 2), 5
    chunks[::50] = chunks[7]  # ties, also beyond k
    chunks[3::500] = 0
    chunks[11::400] *= 90  # lengths whose products need more bits than a lane has
    chunks[13::300] += 0.25  # no counts
    chunks[17::700, :4] -= 3  # negative entries
    chunks[19::900] *= 2000  # counts beyond those with exact float32 products
    questions[::20] *= 40
    questions[5::30] += 0.5
    questions[9], questions[10] = 0, chunks[11]
    ids = [f"c{i * 7919 % 9000:05d}" for i in range(9000)]
    want = ranked_by_rule(chunks, ids, questions, k)
    bounds = np.array([want[q][-1][0] for q in want], np.float32) if bounded else None
    got = ranked_by_kernel(chunks, ids, questions, k, bounds)
    assert got == want


def test_kernel_on_token_counts_saves_multiplications(monkeypatch):
    chunks, questions, done = token_counts(8000, 3, longest=90), token_counts(400, 4, longest=60), [0]
    multiply = np.matmul

    def counted(a, b, **kwargs):
        done[0] += a.shape[0] * a.shape[1] * b.shape[1]
        return multiply(a, b, **kwargs)

    ids = [f"c{i:05d}" for i in range(8000)]
    want = ranked_by_rule(chunks, ids, questions, 5)
    monkeypatch.setattr(np, "matmul", counted)
    got = ranked_by_kernel(chunks, ids, questions, 5, np.array([want[q][-1][0] for q in want], np.float32), batch=8000)
    assert got == want
    assert done[0] < 0.4 * chunks.shape[0] * questions.size
