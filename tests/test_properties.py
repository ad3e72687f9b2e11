"""Randomised checks against plain-Python statements of the rules (one Spark job per check)."""

import random
import re

from pyspark.sql import functions as F

from guardrag.config import FINANCIAL_KEYWORDS, PII_PATTERNS
from guardrag.functions import gates, pii
from guardrag.functions.chunking import chunk_text


def pack_reference(text, sep="\n\n", max_len=500, overlap=50):
    """The packing rules, written out directly."""
    if text is None:
        return []
    out, cur = [], ""
    for p in [x for x in text.split(sep) if len(x) > 0]:
        if len(cur) + len(p) > max_len and len(cur) > 0:
            out.append(cur)
            cur = cur[-overlap:] if len(cur) > overlap else ""
        cur += p + "\n"
    if cur:
        out.append(cur)
    return out


def random_document(rng):
    paras = []
    for _ in range(rng.randint(0, 12)):
        kind = rng.random()
        if kind < 0.1:
            paras.append("")
        elif kind < 0.15:
            paras.append(" \n ")
        else:
            n = rng.choice([1, 5, 30, 49, 50, 51, 120, 300, 499, 500, 501, 700])
            paras.append("".join(rng.choice("abc d\n") for _ in range(n)))
    return "\n\n".join(paras)


def test_chunk_fold_matches_reference(spark):
    rng = random.Random(7)
    docs = [random_document(rng) for _ in range(400)] + ["", "\n\n\n\n", "x"]
    df = spark.createDataFrame([(i, d) for i, d in enumerate(docs)], "i int, t string")
    got = {r["i"]: r["c"] for r in df.select("i", chunk_text("t").alias("c")).collect()}
    for i, d in enumerate(docs):
        assert got[i] == pack_reference(d), i


FRAGMENTS = [
    "GB29NWBK60161331926819", "gb12abcd12345678901234", "4111111111111111", "5500000000000004",
    "371449635398431", "4111 1111 1111 1111", "AB123456C", "ab 12 34 56 c", "12-34-56", "12 34 56",
    "account number: 12345678", "Account no. 87654321", "acct 12345678", "SW1A 1AA", "CF10 1EP",
    "07700 900123", "+44 7700 900123", "020 7946 0958", "a.b@c.co.uk", "x@y", "[EMAIL REDACTED]",
    "[PHONE-NUMBER REDACTED]", "0", "12", "123456", "-", " ", "  ", "@", ".", "x", "Q3", "2024",
]


def random_pii_text(rng):
    return "".join(rng.choice(FRAGMENTS) + rng.choice(["", " ", ", ", "\n", "-", "x"])
                   for _ in range(rng.randint(0, 10)))


def scrub_reference(text):
    """Ordered fold with Python's re (ASCII input: same classes as the JVM in Unicode mode)."""
    counts = []
    for _t, ph, ci, rx in PII_PATTERNS:
        text, n = re.subn(rx, ph, text, flags=re.IGNORECASE if ci else 0)
        counts.append(n)
    return text, counts


def test_scrub_and_counts_match_reference(spark):
    rng = random.Random(11)
    texts = [random_pii_text(rng) for _ in range(600)]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    got = {r["i"]: r for r in pii.with_scrub(df, "t", "p").select("i", "p_text", "p_counts").collect()}
    for i, t in enumerate(texts):
        ref_text, ref_counts = scrub_reference(t)
        assert got[i]["p_text"] == ref_text, (i, t)
        assert list(got[i]["p_counts"]) == ref_counts, (i, t)


def test_keyword_count_matches_reference(spark):
    rng = random.Random(3)
    words = list(FINANCIAL_KEYWORDS) + ["cat", "dog", "Seconds", "SHAREHOLDER", "p/e", " ", "Bank Of England"]
    texts = [" ".join(rng.choice(words) for _ in range(rng.randint(0, 8))) for _ in range(300)]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    got = {r["i"]: r["n"] for r in df.select("i", gates.keyword_count(F.col("t"), FINANCIAL_KEYWORDS).alias("n")).collect()}
    for i, t in enumerate(texts):
        assert got[i] == sum(1 for k in set(FINANCIAL_KEYWORDS) if k in t.lower()), t


def test_hashing_embedder_hashes_each_token_of_a_batch_once(spark, monkeypatch):
    """The histogram gets tokens, not buckets: a token that repeats in a batch is hashed once; odd texts count as by the rule."""
    import hashlib
    import re

    import pyarrow as pa

    from guardrag.functions import embedding

    texts = ["a b a", "", None, "   ", "Ünï ünï x1 ١٢ 漢字 漢字", "🙂 é é", "b" * 500]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "id int, text string")
    got = {r[0]: r[1] for r in df.select("id", embedding.hashing_embedder(16)("text")).collect()}
    for i, t in enumerate(texts):
        want = [0.0] * 16
        for w in re.findall(r"[^\W_]+", (t or "").lower()):
            want[int(hashlib.md5(w.encode()).hexdigest()[:8], 16) % 16] += 1
        assert got[i] == want, t
    calls = []
    own = embedding.hashlib.md5
    monkeypatch.setattr(embedding.hashlib, "md5", lambda w, **how: (calls.append(w), own(w, **how))[1])
    hist = embedding.bucket_histogram.__wrapped__(16).func
    assert hist(pa.array([["a", "b"], None, ["a"] * 5, []])).to_pylist()[2].count(5.0) == 1
    assert sorted(calls) == [b"a", b"b"]
