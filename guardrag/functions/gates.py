"""Query gates as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from guardrag.config import (
    EMPTY_QUERY_REASON,
    NO_KEYWORD_REASON,
    TRUNCATED_QUERY_MARKER,
    QueryOptions,
    RelevanceOptions,
)
from guardrag.functions.keywords import distinct_words
from guardrag.functions.text import col_, is_blank, utf16_length


def is_too_long(query: Column | str, max_len: int) -> Column:
    """G1: reject when the UTF-16 length exceeds ``max_len`` (the limit itself passes)."""
    return utf16_length(query) > F.lit(max_len)


def too_long_message(opts: QueryOptions = QueryOptions()) -> Column:
    """The template with ``{0}`` filled at plan time."""
    return F.lit(opts.query_too_long_response.replace("{0}", str(opts.max_query_length)))


def truncation_marker(query: Column | str) -> Column:
    """The audit text that stands in for an over-long query."""
    head, tail = TRUNCATED_QUERY_MARKER.split("{n}")
    return F.concat(F.lit(head), utf16_length(query).cast("string"), F.lit(tail))


def keyword_count(query: Column | str, keywords: tuple[str, ...]) -> Column:
    """Number of distinct keywords occurring as case-insensitive substrings."""
    if not keywords:
        return F.lit(0)
    return distinct_words(F.lower(col_(query)), list(dict.fromkeys(k.lower() for k in keywords)))


def relevance(query: Column | str, opts: RelevanceOptions = RelevanceOptions()) -> Column:
    """struct(is_relevant, rejection_reason, keyword_matches)."""
    q = col_(query)
    if not opts.enabled:
        return F.struct(
            F.lit(True).alias("is_relevant"),
            F.lit(None).cast("string").alias("rejection_reason"),
            F.lit(None).cast("int").alias("keyword_matches"),
        )
    n = keyword_count(q, opts.keywords)
    blank = is_blank(q)
    ok = ~blank & (n >= F.lit(opts.min_keyword_matches))
    head, rest = NO_KEYWORD_REASON.split("{required}")
    mid, tail = rest.split("{found}")
    reason = (
        F.when(blank, F.lit(EMPTY_QUERY_REASON))
        .when(~ok, F.concat(F.lit(head), F.lit(str(opts.min_keyword_matches)), F.lit(mid), n.cast("string"), F.lit(tail)))
        .otherwise(F.lit(None).cast("string"))
    )
    return F.struct(
        ok.alias("is_relevant"),
        reason.alias("rejection_reason"),
        F.when(blank, F.lit(0)).otherwise(n).alias("keyword_matches"),
    )


def is_low_confidence(top_score: Column | str, threshold: float) -> Column:
    """Top score (0 when nothing was retrieved) below the float threshold."""
    return F.coalesce(col_(top_score), F.lit(0.0).cast("float")) < F.lit(threshold).cast("float")
