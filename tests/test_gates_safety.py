"""Gates, disclaimer and output safety."""

import pytest

from conftest import evaluate
from guardrag.config import DISCLAIMER_TEXT, DisclaimerOptions, RelevanceOptions
from guardrag.functions import gates, keywords
from guardrag.functions.safety import disclaimer_triggered, output_safety, template_answer


def test_length_gate_at_and_above_limit(spark):
    got = evaluate(spark, lambda c: gates.is_too_long(c, 1000), "a" * 1000, "a" * 1001, "")
    assert got == [False, True, False]


def test_length_counts_utf16_units(spark):
    got = evaluate(spark, lambda c: gates.is_too_long(c, 3), "ab\U0001F600", "abc")
    assert got == [True, False]  # the emoji is two UTF-16 units


def test_truncation_marker_and_message(spark):
    assert evaluate(spark, gates.truncation_marker, "x" * 1200) == ["[QUERY TRUNCATED — 1200 chars]"]
    df = spark.range(1).select(gates.too_long_message())
    assert df.first()[0] == "Your query is too long. Please shorten your question to under 1000 characters and try again."


@pytest.mark.parametrize("text,n", [("hello there", 0), ("bond prices", 1), ("Stocks and BONDS", 4), ("a second", 1)])
def test_keyword_count_substring_case_insensitive(spark, text, n):
    assert evaluate(spark, lambda c: gates.keyword_count(c, RelevanceOptions().keywords), text) == [n]


def test_relevance_rules(spark):
    r = evaluate(spark, lambda c: gates.relevance(c), "what is the fund yield", "hello", "   ", None)
    assert r[0]["is_relevant"] and r[0]["rejection_reason"] is None
    assert not r[1]["is_relevant"]
    assert r[1]["rejection_reason"] == "Query did not match any financial domain keywords (required: 1, found: 0)."
    assert r[2]["rejection_reason"] == "Query was empty." and r[3]["rejection_reason"] == "Query was empty."


def test_relevance_min_two_and_disabled(spark):
    two = RelevanceOptions(min_keyword_matches=2)
    r = evaluate(spark, lambda c: gates.relevance(c, two), "fund", "fund yield")
    assert [x["is_relevant"] for x in r] == [False, True]
    assert "found: 1" in r[0]["rejection_reason"]
    off = RelevanceOptions(enabled=False)
    assert all(x["is_relevant"] for x in evaluate(spark, lambda c: gates.relevance(c, off), "", None, "cats"))


def test_confidence_gate(spark):
    got = evaluate(spark, lambda c: gates.is_low_confidence(c, 0.6), 0.3, 0.6, 0.8, None, schema="s float")
    assert got == [True, False, False, True]
    assert evaluate(spark, lambda c: gates.is_low_confidence(c, 0.0), 0.01, schema="s float") == [False]


def test_template_answer(spark):
    df = spark.createDataFrame([("q?", ["a", "b"])], "q string, c array<string>")
    assert df.select(template_answer("q", "c")).first()[0] == "Your question: q? matches those answers: a,b"


def test_disclaimer_cases(spark):
    custom = DisclaimerOptions(trigger_keywords=("invest",), text=" [DISCLAIMER]")
    r = evaluate(spark, lambda c: output_safety(c, custom), "You should INVEST now", "The sky is blue")
    assert r[0]["filtered_response"] == "You should INVEST now [DISCLAIMER]" and r[0]["disclaimer_appended"]
    assert r[1]["filtered_response"] == "The sky is blue" and not r[1]["disclaimer_appended"]
    off = DisclaimerOptions(enabled=False)
    assert not evaluate(spark, lambda c: output_safety(c, off), "invest")[0]["disclaimer_appended"]
    assert evaluate(spark, lambda c: disclaimer_triggered(c, DisclaimerOptions(trigger_keywords=None)), "invest") == [False]
    assert evaluate(spark, lambda c: disclaimer_triggered(c, DisclaimerOptions(trigger_keywords=("",))), "x") == [True]


def test_output_safety_scrubs_then_disclaims(spark):
    r = evaluate(spark, output_safety, "The client email is jane.doe@wealth.com and NI AB123456C; a good fund.")[0]
    assert "jane.doe@wealth.com" not in r["filtered_response"] and "AB123456C" not in r["filtered_response"]
    assert r["pii_was_redacted"] and r["redaction_count"] == 2
    assert [x["pii_type"] for x in r["redacted_items"]] == ["UkNationalInsuranceNumber", "EmailAddress"]
    assert r["disclaimer_appended"] and r["filtered_response"].endswith(DISCLAIMER_TEXT)


def test_output_safety_blank_and_null(spark):
    r = evaluate(spark, output_safety, "", None, "  ")
    assert [x["filtered_response"] for x in r] == ["", "", "  "]
    assert not any(x["pii_was_redacted"] or x["disclaimer_appended"] for x in r)


def test_clean_response_unchanged(spark):
    r = evaluate(spark, output_safety, "Revenue increased by 15% year on year.")[0]
    assert r["filtered_response"] == "Revenue increased by 15% year on year." and r["redaction_count"] == 0


def test_many_words_in_one_pass(spark):
    words = ["sec", "second", "securities", "on", "a.b", "a|b", "(x", "c d", "é", "", "aaaa", "aaa", "\U0001F600", "x" * 1500, "[", "^", "\\q"]
    texts = ["", "second", "securities on", "axb a.b", "a|b (x", "c  d c d", "É é", "aaaaa", "\U0001F600x", "x" * 1600, "[^]", "\\q", "no", None]
    got = evaluate(spark, lambda c: gates.keyword_count(c, tuple(words)), *texts)
    distinct = {w.lower() for w in words}
    assert got == [0 if t is None else sum(w in t.lower() for w in distinct) for t in texts]
    assert set(evaluate(spark, lambda c: gates.keyword_count(c, ("",)), "x", None)) == {0, 1}
    assert keywords.least_words(["sec", "second", "on", "con", "aa", "a"]) == ["sec", "on", "a"]
