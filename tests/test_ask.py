"""The ask pipeline end to end on small stores."""

import pytest
from pyspark.sql import functions as F

from conftest import rows
from guardrag.config import AskOptions, LOW_CONFIDENCE_RESPONSE, OFF_TOPIC_RESPONSE, QueryOptions
from guardrag.operators.audit import audit_line, score_3dp
from guardrag.plans.ask import answers_of, ask_batch


def const_embedder(vec):
    return lambda c: F.array(*[F.lit(float(x)) for x in vec]).cast("array<float>")


def store(spark, items):
    return spark.createDataFrame([(f"c{i}", content, title, vec) for i, (content, title, vec) in enumerate(items)],
                                 "chunk_id string, content string, title string, embedding array<float>")


def run(spark, queries, st, qvec, threshold=0.6, **kw):
    q = spark.createDataFrame(queries, "query_id string, query string")
    opts = AskOptions(query=QueryOptions(confidence_threshold=threshold), **kw)
    return {r["query_id"]: r for r in rows(ask_batch(q, st, opts, embedder=const_embedder(qvec)))}


def test_answered_with_sources_in_rank_order(spark):
    st = store(spark, [("alpha", "Doc A", [1.0, 0.0]), ("beta", "Doc B", [0.8, 0.6]), ("gamma", "Doc A", [0.0, 1.0])])
    out = run(spark, [("q1", "What is the fund yield?")], st, [1.0, 0.0])
    r = out["q1"]
    assert r["outcome"] == "answered" and r["sources"] == ["Doc A", "Doc B", "Doc A"]  # duplicates kept
    assert r["scrubbed_response"].startswith("Your question: What is the fund yield? matches those answers: alpha,beta,gamma")
    assert abs(r["top_confidence_score"] - 1.0) < 1e-6 and r["disclaimer_appended"]
    assert not (r["was_low_confidence"] or r["was_rejected_for_length"] or r["was_rejected_for_relevance"])


@pytest.mark.parametrize("vec", [[0.3, 0.954], None])
def test_low_confidence_or_no_chunks(spark, vec):
    st = store(spark, [("alpha", "A", vec)]) if vec else spark.createDataFrame(
        [], "chunk_id string, content string, title string, embedding array<float>")
    r = run(spark, [("q", "fund yield?")], st, [1.0, 0.0])["q"]
    assert r["outcome"] == "low_confidence" and r["was_low_confidence"]
    assert r["scrubbed_response"] == LOW_CONFIDENCE_RESPONSE and r["sources"] == []
    assert r["top_confidence_score"] == pytest.approx(0.3, abs=1e-3) if vec else r["top_confidence_score"] == 0.0


def test_threshold_zero_answers(spark):
    st = store(spark, [("alpha", "A", [0.01, 1.0])])
    assert run(spark, [("q", "fund")], st, [1.0, 0.0], threshold=0.0)["q"]["outcome"] == "answered"


def test_meets_threshold_exactly(spark):
    st = store(spark, [("alpha", "A", [1.0, 0.0])])
    assert run(spark, [("q", "fund")], st, [1.0, 0.0], threshold=1.0)["q"]["outcome"] == "answered"


def test_each_query_one_row_and_one_flag(spark):
    st = store(spark, [("alpha", "A", [1.0, 0.0])])
    qs = [("long", "fund " + "x" * 1000), ("off", "cats and dogs"), ("ok", "bond market"), ("blank", "  "),
          ("null", None)]
    out = run(spark, qs, st, [1.0, 0.0])
    assert set(out) == {q for q, _ in qs}
    for r in out.values():
        assert sum([r["was_rejected_for_length"], r["was_rejected_for_relevance"], r["was_low_confidence"]]) <= 1
    assert out["long"]["scrubbed_query"] == "[QUERY TRUNCATED — 1005 chars]" and out["long"]["outcome"] == "too_long"
    assert out["off"]["scrubbed_response"] == OFF_TOPIC_RESPONSE and out["blank"]["outcome"] == "off_topic"
    assert out["null"]["outcome"] == "off_topic"
    assert out["ok"]["outcome"] == "answered"


def test_input_pii_scrubbed_before_embedding_and_answer(spark):
    st = store(spark, [("alpha", "A", [1.0, 0.0])])
    out = run(spark, [("q", "What accounts does user@test.com have in the fund?")], st, [1.0, 0.0])["q"]
    assert "user@test.com" not in out["scrubbed_query"] and "user@test.com" not in out["scrubbed_response"]
    assert out["input_pii_redaction_count"] == 1


def test_output_pii_redacted(spark):
    st = store(spark, [("reach the CEO at ceo@company.com", "A", [1.0, 0.0])])
    out = run(spark, [("q", "Who manages this fund?")], st, [1.0, 0.0])["q"]
    assert "ceo@company.com" not in out["scrubbed_response"] and "[EMAIL REDACTED]" in out["scrubbed_response"]
    assert out["output_pii_redaction_count"] == 1


@pytest.mark.parametrize("scrub_rejected,expect", [(True, "[EMAIL REDACTED]"), (False, "a@b.com")])
def test_off_topic_pii_under_both_settings(spark, scrub_rejected, expect):
    st = store(spark, [("alpha", "A", [1.0, 0.0])])
    out = run(spark, [("q", "mail a@b.com about cats")], st, [1.0, 0.0], scrub_rejected=scrub_rejected)["q"]
    assert expect in out["scrubbed_query"] and out["input_pii_redaction_count"] == 0


def test_answers_projection_and_audit_line(spark):
    st = store(spark, [("alpha", "Doc A", [1.0, 0.0])])
    q = spark.createDataFrame([("q", "fund?"), ("o", "cats")], "query_id string, query string")
    audit = ask_batch(q, st, embedder=const_embedder([1.0, 0.0]), as_of=F.to_timestamp(F.lit("2026-01-01 00:00:00")))
    ans = {r["query_id"]: r for r in rows(answers_of(audit))}
    assert ans["o"]["answer"] == OFF_TOPIC_RESPONSE and ans["o"]["sources"] == []
    line = {r["query_id"]: r["l"] for r in rows(audit.select("query_id", audit_line().alias("l")))}["q"]
    assert line.startswith("AUDIT | CorrelationId=") and "Timestamp=2026-01-01 00:00:00 TopScore=1.000" in line
    assert "SourceCount=1" in line and line.endswith("Sources=Doc A")


def test_score_rounding_half_away_from_zero(spark):
    df = spark.createDataFrame([(0.0625,), (0.3125,), (-0.0625,), (0.1234,)], "s float")
    assert [r[0] for r in df.select(score_3dp(F.col("s"))).collect()] == ["0.063", "0.313", "-0.063", "0.123"]


def test_pii_report_by_direction(spark):
    from guardrag.plans.ask import ask_pii_report
    st = store(spark, [("reach the CEO at ceo@company.com or 07700 900123", "A", [1.0, 0.0])])
    q = spark.createDataFrame([("q", "fund question from a@b.com"), ("o", "cats x@y.com")], "query_id string, query string")
    rep = {(r["direction"], r["pii_type"]): (r["redactions"], r["items"])
           for r in rows(ask_pii_report(ask_batch(q, st, embedder=const_embedder([1.0, 0.0]))))}
    # input: the answered question only (off-topic rows are rejected before the scrub);
    # output: the answer repeats the scrubbed question plus the chunk's email and phone.
    assert rep[("input", "EmailAddress")] == (1, 1)
    assert rep[("output", "EmailAddress")] == (1, 1) and rep[("output", "UkPhoneNumber")] == (1, 1)


def test_audit_sink_appends_by_date_and_random_ids(spark, tmp_path):
    from guardrag.operators.audit import write_answers, write_audit
    st = store(spark, [("alpha", "A", [1.0, 0.0])])
    q = spark.createDataFrame([("q", "fund?"), ("o", "cats")], "query_id string, query string")
    audit = ask_batch(q, st, AskOptions(random_correlation_ids=True), embedder=const_embedder([1.0, 0.0]),
                      as_of=F.to_timestamp(F.lit("2026-01-01 00:00:00")))
    path = str(tmp_path / "audit")
    write_audit(audit, path)
    write_audit(audit, path)
    back = spark.read.parquet(path)
    assert back.count() == 4 and [r[0] for r in back.select("event_date").distinct().collect()] == [
        __import__("datetime").date(2026, 1, 1)]
    ids = [r["correlation_id"] for r in rows(back)]
    assert all(len(i) == 32 for i in ids) and len(set(ids)) >= 2
    write_answers(answers_of(audit), str(tmp_path / "answers"))
    assert spark.read.parquet(str(tmp_path / "answers")).count() == 2


def test_run_ask_writes_both_outputs_once(spark, tmp_path):
    from guardrag.plans.ask import run_ask
    st = store(spark, [("alpha", "A", [1.0, 0.0])])
    q = spark.createDataFrame([("q", "fund?"), ("o", "cats")], "query_id string, query string")
    audit, answers = run_ask(q, st, str(tmp_path / "audit"), str(tmp_path / "answers"),
                             embedder=const_embedder([1.0, 0.0]))
    assert audit.count() == 2 and answers.count() == 2
    a = {r["query_id"]: r for r in rows(audit)}
    b = {r["query_id"]: r for r in rows(answers)}
    assert all(a[k]["scrubbed_response"] == b[k]["answer"] for k in a)
    run_ask(q, st, str(tmp_path / "audit"), str(tmp_path / "answers"), embedder=const_embedder([1.0, 0.0]))
    assert spark.read.parquet(str(tmp_path / "audit")).count() == 4  # append-only


def test_ask_same_under_every_retrieval_plan(spark):
    from conftest import SF_SMALL
    from guardrag.config import RetrievalOptions
    from guardrag.plans import fixtures as fx
    from guardrag.plans.catalog import AS_OF, document_store
    st = document_store(spark, SF_SMALL)
    qs = fx.user_questions(spark, SF_SMALL)
    as_of = F.to_timestamp(F.lit(AS_OF))
    cols = ["query_id", "outcome", "scrubbed_response", "sources", "top_confidence_score"]

    def run_with(strategy, retrieval=RetrievalOptions()):
        a = ask_batch(qs, st, AskOptions(retrieval=retrieval), as_of=as_of, strategy=strategy)
        return sorted(tuple(r[c] if c != "sources" else tuple(r[c]) for c in cols) for r in a.collect())

    base = run_with("broadcast")
    assert run_with("blocked", RetrievalOptions(chunk_block_rows=300, query_block_rows=10)) == base
    assert run_with("broadcast", RetrievalOptions(probe_fraction=0.2)) == base


def test_model_slots(spark):
    from guardrag.functions.embedding import model_embedder
    from guardrag.functions.safety import model_answerer

    # Defined inside the test so they are pickled by value (workers cannot import test modules).
    def char_model():
        def embed(texts):
            return [[float(t.count("a")), float(t.count("e")) + 1.0] for t in texts]
        return embed

    def strict_answerer():
        def answer(questions, contexts):
            for q in questions:
                if "LOWCONF" in q:
                    raise AssertionError("answer slot called for a low-confidence question")
            return [f"model says {q} [{len(c)}]" for q, c in zip(questions, contexts)]
        return answer

    st = store(spark, [("alpha", "A", [0.0, 1.0]), ("beta", "B", [1.0, 0.0])])
    q = spark.createDataFrame([("hi", "fund eee"), ("lo", "LOWCONF fund ae")], "query_id string, query string")
    out = {r["query_id"]: r for r in rows(ask_batch(q, st, AskOptions(query=QueryOptions(confidence_threshold=0.99)),
                                                     embedder=model_embedder(char_model),
                                                     answerer=model_answerer(strict_answerer)))}
    assert out["hi"]["outcome"] == "answered" and out["hi"]["scrubbed_response"].startswith("model says fund eee [2]")
    assert out["lo"]["outcome"] == "low_confidence"


def test_questions_without_or_with_repeated_ids(spark, tmp_path):
    """The request of the original holds a text only; every question gets one record with an id of its own."""
    import json

    from guardrag.sources.queries import read_queries

    path = tmp_path / "q.json"
    path.write_text("\n".join(json.dumps(x) for x in [{"query": "fund yield"}, {"query": "stock risk"}, {"query_id": "1", "query": "fund T1"}, {"query_id": "1", "query": "bond T2"}]))
    st = spark.createDataFrame([(f"c{i}", f"text {i}", f"T{i}", [float(i == j) for j in range(3)]) for i in range(3)],
                               "chunk_id string, content string, title string, embedding array<float>")
    one_hot = lambda c: F.when(F.contains(c, F.lit("T2")), F.array(*[F.lit(x) for x in (0.0, 0.0, 1.0)])).otherwise(
        F.array(*[F.lit(x) for x in (0.0, 1.0, 0.0)])).cast("array<float>")
    got = rows(ask_batch(read_queries(spark, str(path)), st, embedder=one_hot))
    assert len(got) == 4 and all(r["correlation_id"] and r["outcome"] == "answered" for r in got)
    assert len({r["query_id"] for r in got}) == 3 and sum(r["query_id"] == "1" for r in got) == 2
    assert all(len(r["sources"]) == 3 for r in got)
    first = {r["scrubbed_query"]: r["sources"][0] for r in got}
    assert first == {"fund yield": "T1", "stock risk": "T1", "fund T1": "T1", "bond T2": "T2"}


def test_run_ask_reads_its_own_partition_only(spark, tmp_path):
    from guardrag.plans.ask import run_ask

    st = spark.createDataFrame([("c0", "alpha", "A", [1.0, 0.0])], "chunk_id string, content string, title string, embedding array<float>")
    q = spark.createDataFrame([("a", "fund yield")], "query_id string, query string")
    for _ in range(2):
        audit, answers = run_ask(q, st, str(tmp_path / "audit"), str(tmp_path / "answers"), embedder=const_embedder([1.0, 0.0]))
    assert audit.count() == answers.count() == 1 and spark.read.parquet(str(tmp_path / "audit")).count() == 2
    plan = audit._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(run_id" in plan
