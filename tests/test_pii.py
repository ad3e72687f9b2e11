"""The detector's cases, plus the ones it lacks (cards, spaced IBAN, Unicode)."""

import pytest
from pyspark.sql import functions as F

from conftest import SF_CHECK, evaluate, rows
from guardrag.functions import pii
from guardrag.operators.pii_report import pii_type_report, pii_type_report_from_findings
from guardrag.plans import fixtures as fx


def scrub_one(spark, text):
    df = spark.createDataFrame([(text,)], "t string")
    out = pii.with_scrub(df, "t", "p").select("p_text", "p_count", "p_findings").first()
    return out["p_text"], out["p_count"], [f["pii_type"] for f in out["p_findings"]]


@pytest.mark.parametrize("text,placeholder,original", [
    ("Contact me at john.smith@example.com for details.", "[EMAIL REDACTED]", "john.smith@example.com"),
    ("user@bank.co.uk", "[EMAIL REDACTED]", "user@bank.co.uk"),
    ("My NI is AB 12 34 56 C.", "[NI-NUMBER REDACTED]", "AB 12 34 56 C"),
    ("NI: AB123456C", "[NI-NUMBER REDACTED]", "AB123456C"),
    ("Sort code is 12-34-56", "[SORT-CODE REDACTED]", "12-34-56"),
    ("Sort code: 12 34 56", "[SORT-CODE REDACTED]", "12 34 56"),
    ("Account number: 12345678", "[ACCOUNT-NUMBER REDACTED]", "12345678"),
    ("I live in CF10 1EP.", "[POSTCODE REDACTED]", "CF10 1EP"),
    ("Postcode: SW1A 1AA", "[POSTCODE REDACTED]", "SW1A 1AA"),
    ("Call me on 07700 900000", "[PHONE-NUMBER REDACTED]", "07700 900000"),
    ("Phone: +44 7700 900000", "[PHONE-NUMBER REDACTED]", "7700 900000"),
    ("My IBAN is GB29NWBK60161331926819.", "[UK-IBAN REDACTED]", "GB29NWBK60161331926819"),
    ("pay with 4111111111111111 today", "[CARD-NUMBER REDACTED]", "4111111111111111"),
])
def test_each_type_is_redacted(spark, text, placeholder, original):
    out, n, types = scrub_one(spark, text)
    assert placeholder in out
    assert original not in out
    assert n >= 1 and len(types) == n


def test_bare_eight_digits_is_not_an_account(spark):
    out, _, types = scrub_one(spark, "The year was 19831234 and sales were strong.")
    assert "UkBankAccountNumber" not in types
    assert "[ACCOUNT-NUMBER REDACTED]" not in out


def test_three_types_in_one_string(spark):
    out, n, types = scrub_one(spark, "Email user@test.com, NI AB123456C, sort code 12-34-56.")
    assert n >= 3
    for orig in ("user@test.com", "AB123456C", "12-34-56"):
        assert orig not in out
    # findings are in pattern order
    order = [t for t in ("UkNationalInsuranceNumber", "UkSortCode", "EmailAddress") if t in types]
    assert [t for t in types if t in order] == order


@pytest.mark.parametrize("text", ["Apple reported strong Q3 earnings with revenue up 8%.", ""])
def test_clean_and_empty_text_unchanged(spark, text):
    out, n, types = scrub_one(spark, text)
    assert out == text and n == 0 and types == []


def test_null_text(spark):
    out, n, types = scrub_one(spark, None)
    assert out is None and n == 0 and types == []


def test_spaced_card_not_matched(spark):
    out, _, types = scrub_one(spark, "card 4111 1111 1111 1111 ok")
    assert "CreditCardNumber" not in types


def test_spaced_iban_partly_taken_by_phone_rule(spark):
    out, _, types = scrub_one(spark, "GB29 NWBK 6016 1331 9268 19")
    assert out == "GB29 NWBK 6[PHONE-NUMBER REDACTED] 19"
    assert types == ["UkPhoneNumber"]


def test_no_break_space_sort_code_unicode(spark):
    out, _, types = scrub_one(spark, "sort 12 34 56 here")
    assert "UkSortCode" in types


def test_contains_pii(spark):
    got = evaluate(spark, pii.contains_pii, "user@example.com", "Quarterly revenue was up 12%.", "   ", None)
    assert got == [True, False, False, False]


def test_placeholder_counts_equal_staged_counts(spark):
    """The linear counting form equals the stage-by-stage regex counts on whole documents."""
    docs = fx.documents_with_pii(spark, SF_CHECK)
    staged = pii.staged_counts(F.col("text"))
    _, fast = pii.scrub_stages(F.col("text"))
    cmp = docs.select(*[(a == b).alias(f"eq{i}") for i, (a, b) in enumerate(zip(staged, fast))])
    bad = cmp.filter(~F.expr(" AND ".join(f"eq{i}" for i in range(8)))).count()
    assert bad == 0


def test_has_pii_equals_contains_pii_and_scrub_is_idempotent(spark):
    docs = pii.with_scrub(fx.documents_with_pii(spark, SF_CHECK), "text", "p")
    docs = docs.withColumn("c", pii.contains_pii("text"))
    assert docs.filter((F.col("p_count") > 0) != F.col("c")).count() == 0
    again = pii.with_scrub(docs.select("doc_id", F.col("p_text").alias("t")), "t", "q")
    assert again.filter((F.col("q_count") != 0) | (F.col("q_text") != F.col("t"))).count() == 0


def test_report_counts_by_type(spark):
    df = spark.createDataFrame([(1, "a@b.com and c@d.org"), (2, "NI AB123456C"), (3, "none")], "id long, t string")
    scrubbed = pii.with_scrub(df, "t", "p")
    rep = {r["pii_type"]: r for r in rows(pii_type_report(scrubbed, "p_counts", "in"))}
    assert rep["EmailAddress"]["redactions"] == 2 and rep["EmailAddress"]["items"] == 1
    assert rep["UkNationalInsuranceNumber"]["redactions"] == 1
    assert set(rep) == {"EmailAddress", "UkNationalInsuranceNumber"}
    alt = {r["pii_type"]: r for r in rows(pii_type_report_from_findings(scrubbed, "id", "p_findings", "in"))}
    assert alt == rep


def test_patterns_for_the_jvm_replace_what_the_rules_do(spark):
    """IBAN, card and phone patterns look for their first character before its surroundings, and match as the rules do."""
    import random

    from pyspark.sql import functions as F

    from guardrag.config import PII_PATTERNS
    from guardrag.functions import pii

    rules = {t: (ph, pii._java_regex(rx, ci)) for t, ph, ci, rx in PII_PATTERNS}
    for t in ("UkIban", "CreditCardNumber", "UkPhoneNumber"):
        assert pii.PATTERN_BY_TYPE[t].java_regex != rules[t][1]  # a word boundary or a choice at every character
    rng = random.Random(5)
    odd = ["4", "411111111111", "4111111111111", "4111111111111111", "55" + "0" * 14, "34" + "1" * 13, "300" + "2" * 11, "6011" + "3" * 12, "65" + "9" * 14, "0", "+", "44", "+44 ", "7700",
           "900", "123", "0207", "-", " ", " ", " ", "_", "a", "é", "́", "٣", "\U0001d7d2", "🙂", "‍", "GB29NWBK60161331926819", "gb29nwbk", "60161331926819",
           "١" * 14, "AB123456C", "12-34-56", "account number: ", "12345678", "SW1A 1AA", "u@x.org", ",", "\n", "[CARD-NUMBER REDACTED]"]
    texts = [None, "", *("".join(rng.choice(odd) for _ in range(rng.randint(1, 9))) for _ in range(6000))]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "id int, text string")
    plain = F.col("text")
    for ph, rx in rules.values():
        plain = F.regexp_replace(plain, rx, ph)
    one = [F.regexp_replace("text", pii.PATTERN_BY_TYPE[t].java_regex, "#").eqNullSafe(F.regexp_replace("text", rx, "#")).alias(t) for t, (_, rx) in rules.items()]
    out = df.select("text", plain.alias("plain"), pii.scrub_text("text").alias("scrubbed"), *one).collect()
    assert [r["text"] for r in out if r["plain"] != r["scrubbed"] or not all(r[t] for t in rules)] == []
    assert sum("[CARD" in (r["plain"] or "") for r in out) > 500 and sum("[PHONE" in (r["plain"] or "") for r in out) > 100
