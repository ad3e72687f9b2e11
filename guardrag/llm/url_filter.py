"""URL filter: pattern rules indexed by their rarest literal token. DataFrame operations only.

A rule has a pattern (regular expression over ``host + path``), an action, a rank and
its literal tokens. Each rule is filed under the one of its tokens that the fewest URLs
of the corpus carry. A URL's tokens fetch the rules filed under them; only those
candidates run their regular expression, and the highest-ranked fit wins.

Tokens are the maximal runs of ``[0-9a-z]`` of the lower-cased host and path. A rule token must be
delimited in every URL the pattern fits (a host label, a path segment), so fetching by
token loses no fit. A rule without a literal token (a host of other letters) is a candidate for every URL.

Scale: token counts are one aggregate over the rules' own tokens; candidates are a join of
exploded URL tokens with the index, a broadcast only while the rules fit a checked size and a
shuffle join beyond it. Work runs per distinct URL, so one URL that
fills a third of the table is judged once; the verdict returns by an equi-join that AQE can split.

Edge cases: a URL that is null or lacks ``://`` has empty host and path and gets the
default verdict; repeated rows get equal verdicts; an empty table gives an empty result; columns
of the input named like a result (host, path, rule, verdict) are replaced.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: FIXED VALUES: (action, host, path prefix) of the production rules.
SITE_RULES = [
    ("allow", "com", "/"),
    ("block", "example.com", "/en/"),
    ("allow", "www.example.com", "/en/"),
    ("block", "net", "/es/"),
    ("block", "net", "/fr/"),
]
DEFAULT_VERDICT = "allow"
BROADCAST_RULES = 20_000
RULE_SCHEMA = "rule string, action string, pattern string, rank int, tokens array<string>"


def site_rule(action: str, host: str, path: str) -> tuple[str, str, str, int, list[str]]:
    """(name, action, pattern, rank, literal tokens) of a rule for a host, its subdomains and a path prefix.

    The path must end at a delimiter for its last token to count as delimited; otherwise that token is left out.
    """
    tokens = re.findall("[0-9a-z]+", host)
    segments = re.findall("[0-9a-z]+|[^0-9a-z]+", path.lower())
    if segments and re.fullmatch("[0-9a-z]+", segments[-1]):
        segments = segments[:-1]
    tokens += [s for s in segments if re.fullmatch("[0-9a-z]+", s)]
    return host + path, action, r"^(?:[^/]*\.)?" + _quote(host) + r"(?=/)" + _quote(path), len(host + path), sorted(set(tokens))


def _quote(text: str) -> str:
    return re.sub(r"([^0-9A-Za-z/_-])", r"\\\1", text)


def rules_frame(spark: SparkSession, rules: list[tuple[str, str, str]]) -> DataFrame:
    if not rules:
        return spark.createDataFrame([], RULE_SCHEMA)
    rows = [F.struct(F.lit(rule).alias("rule"), F.lit(action).alias("action"), F.lit(pattern).alias("pattern"), F.lit(rank).alias("rank"),
                     F.array(*[F.lit(t) for t in tokens]).cast("array<string>").alias("tokens"))
            for rule, action, pattern, rank, tokens in (site_rule(*r) for r in rules)]
    return spark.range(1).select(F.inline(F.array(*rows)))


def url_host(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; else empty."""
    raw = F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)
    return F.coalesce(F.translate(raw, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), F.lit(""))


def url_path(url: Column) -> Column:
    """What follows the host, up to ``?``, ``#`` or the end; else empty."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def url_tokens(host: Column, path: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(F.lower(F.concat(host, F.lit(" "), path)), F.lit("([0-9a-z]+)"), F.lit(1)))


def judge_urls(urls: DataFrame, rules: DataFrame, url_col: str = "url", default: str = DEFAULT_VERDICT) -> DataFrame:
    """``urls`` with host, path, rule (null if none fits) and verdict added."""
    u = F.col(f"`{url_col}`")
    distinct = urls.select(url_host(u).alias("__host"), url_path(u).alias("__path")).distinct()
    # Every URL carries the empty token too, under which rules without a literal token are filed.
    words = distinct.select("__host", "__path", F.explode(F.array_append(url_tokens(F.col("__host"), F.col("__path")), F.lit(""))).alias("__token"))
    tokens = F.when(F.size("tokens") > 0, F.col("tokens")).otherwise(F.array(F.lit("")))
    literal = rules.select("rule", "action", "pattern", "rank", F.explode(tokens).alias("__token"))
    small = literal.count() <= BROADCAST_RULES

    def side(frame: DataFrame) -> DataFrame:
        return F.broadcast(frame) if small else frame

    counts = words.join(side(literal.select("__token").distinct()), "__token", "left_semi").groupBy("__token").agg(F.count("*").alias("__urls"))
    index = (literal.join(counts, "__token", "left")
             .groupBy("rule", "action", "pattern", "rank")
             .agg(F.min_by("__token", F.struct(F.coalesce("__urls", F.lit(0)), "__token")).alias("__token")))
    fits = (words.join(side(index), "__token")
            .where(F.expr("concat(__host, __path) rlike pattern"))
            .groupBy("__host", "__path")
            .agg(F.max(F.struct("rank", "action", "rule")).alias("__best"))
            .select("__host", "__path", F.col("__best.rule").alias("__rule"), F.col("__best.action").alias("__action")))
    kept = [F.col(f"`{c}`") for c in urls.columns if c not in ("host", "path", "rule", "verdict")]
    return (urls.select(*kept, url_host(u).alias("__host"), url_path(u).alias("__path"))
            .join(fits, ["__host", "__path"], "left")
            .select(*kept, F.col("__host").alias("host"), F.col("__path").alias("path"), F.col("__rule").alias("rule"),
                    F.coalesce("__action", F.lit(default)).alias("verdict")))
