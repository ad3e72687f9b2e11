"""PII detection and scrubbing as Spark column expressions.

Every pattern is a JVM regex evaluated by ``regexp_replace`` / ``regexp_count``,
so scrubbing stays inside whole-stage codegen. Patterns are applied in order,
each one on the output of the previous, and the count of pattern *i* is taken
on the text pattern *i* actually sees, which is what makes findings exact.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from guardrag.config import PII_PATTERNS

PII_TYPES: tuple[str, ...] = tuple(p[0] for p in PII_PATTERNS)


@dataclass(frozen=True)
class PiiPattern:
    pii_type: str
    placeholder: str
    java_regex: str


def _java_regex(regex: str, ignore_case: bool) -> str:
    # (?U): \d \w \s \b are Unicode-aware, as in the original dialect;
    # it also turns on Unicode case folding for (?i).
    return ("(?iU)" if ignore_case else "(?U)") + regex


#: The same rules for the JVM, by the rule's text: a character that starts a match is looked for first, as a word boundary or a choice tried at every
#: character takes several times as long. What came before the character is then asked by looking back at it.
_EQUAL = {
    r"\bGB\d{2}[A-Z]{4}\d{14}\b": r"G(?<=\bG)B\d{2}[A-Z]{4}\d{14}\b",
    r"\b(?:4[0-9]{12}(?:[0-9]{3})?|5[1-5][0-9]{14}|3[47][0-9]{13}|3(?:0[0-5]|[68][0-9])[0-9]{11}|6(?:011|5[0-9]{2})[0-9]{12})(?:[-\s]?[0-9]{4}){0,2}\b":
        r"[3-6](?<=\b[3-6])(?:(?<=4)[0-9]{12}(?:[0-9]{3})?|(?<=5)[1-5][0-9]{14}|(?<=3)[47][0-9]{13}|(?<=3)(?:0[0-5]|[68][0-9])[0-9]{11}"
        r"|(?<=6)(?:011|5[0-9]{2})[0-9]{12})(?:[-\s]?[0-9]{4}){0,2}\b",
    r"(?:(?:\+44\s?|0)(?:7\d{3}|\d{2,4})[\s-]?\d{3,4}[\s-]?\d{3,4})\b":
        r"(?:[+0](?:(?<=\+)44\s?|(?<=0))(?:7\d{3}|\d{2,4})[\s-]?\d{3,4}[\s-]?\d{3,4})\b",
}

PATTERNS: tuple[PiiPattern, ...] = tuple(
    PiiPattern(t, ph, _java_regex(_EQUAL.get(rx, rx), ci)) for t, ph, ci, rx in PII_PATTERNS
)
PATTERN_BY_TYPE = {p.pii_type: p for p in PATTERNS}


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def match_count(text: Column | str, pii_type: str) -> Column:
    """Number of matches of one pattern on ``text`` as given (P1–P8 alone)."""
    p = PATTERN_BY_TYPE[pii_type]
    return F.coalesce(F.regexp_count(_col(text), F.lit(p.java_regex)), F.lit(0))


def redact(text: Column | str, pii_type: str) -> Column:
    """Replace every match of one pattern with its placeholder."""
    p = PATTERN_BY_TYPE[pii_type]
    return F.regexp_replace(_col(text), p.java_regex, p.placeholder)


# Every placeholder is "[TAG REDACTED]"; one regex finds all of them in one pass.
_SUFFIX = " REDACTED]"
assert all(p.placeholder.startswith("[") and p.placeholder.endswith(_SUFFIX) for p in PATTERNS)
PLACEHOLDER_TAGS: tuple[str, ...] = tuple(p.placeholder[1:-len(_SUFFIX)] for p in PATTERNS)
PLACEHOLDER_REGEX = r"\[(" + "|".join(re.escape(t) for t in PLACEHOLDER_TAGS) + r") REDACTED\]"


def placeholder_tags(text: Column | str) -> Column:
    """array<string>: the tag of every placeholder in ``text``, in order (one regex pass)."""
    return F.coalesce(F.regexp_extract_all(_col(text), F.lit(PLACEHOLDER_REGEX), 1), F.array().cast("array<string>"))


def counts_from_tags(tags: Column) -> Column:
    """array<int> per pattern: ``size(tags) - size(tags without that tag)`` — plain functions, no lambdas."""
    return F.array(*[(F.size(tags) - F.size(F.array_remove(tags, F.lit(tag)))).cast("int") for tag in PLACEHOLDER_TAGS])


def placeholder_counts(text: Column | str) -> Column:
    """array<int>: occurrences of each placeholder in ``text``, pattern order."""
    return counts_from_tags(placeholder_tags(text))


def replacement_counts(original: Column | str, scrubbed: Column | str) -> Column:
    """array<int>: replacements made per pattern = placeholders added by the scrub."""
    # Both tag arrays are bound once by the outer lambda; the counts read the bound values.
    pair = F.struct(placeholder_tags(scrubbed).alias("o"), placeholder_tags(original).alias("i"))
    return F.transform(F.array(pair), lambda t: F.zip_with(counts_from_tags(t["o"]), counts_from_tags(t["i"]),
                                                           lambda a, b: a - b))[0]


def scrub_stages(text: Column | str) -> tuple[Column, list[Column]]:
    """The ordered fold: final scrubbed text and the per-pattern replacement counts.

    Placeholders hold no digit, no ``@`` and their only brackets at both ends,
    so no pattern can match inside or across one: every placeholder found in the
    output but not in the input was put there by its own pattern. Counting
    placeholders keeps the expression linear in the number of patterns (the
    staged form, counting each pattern on its own input, doubles in size with
    every stage). Null text stays null with zero counts.
    """
    original = _col(text)
    cur = scrub_text(original)
    diff = replacement_counts(original, cur)
    return cur, [diff[i] for i in range(len(PATTERNS))]


def _has_digit(text: Column) -> Column:
    return text.rlike(r"(?U)\d")


def _has_at(text: Column) -> Column:
    return F.contains(text, F.lit("@"))


#: Every pattern but the last needs a digit, the last an ``@``. Placeholders hold neither, so the original text tells for all stages.
_DIGIT_PATTERNS, _AT_PATTERN = PATTERNS[:-1], PATTERNS[-1]
assert all(r"\d" in p.java_regex or "[0-9]" in p.java_regex for p in _DIGIT_PATTERNS) and "]+@[" in _AT_PATTERN.java_regex


def scrub_text(text: Column | str) -> Column:
    """P9 text only: the eight replacements in order; a text without a digit or without ``@`` skips the patterns that need one."""
    original = cur = _col(text)
    for p in _DIGIT_PATTERNS:
        cur = F.regexp_replace(cur, p.java_regex, p.placeholder)
    cur = F.when(_has_digit(original), cur).otherwise(original)
    return F.when(_has_at(original), F.regexp_replace(cur, _AT_PATTERN.java_regex, _AT_PATTERN.placeholder)).otherwise(cur)


def staged_counts(text: Column | str) -> list[Column]:
    """Reference form of the counts: pattern i counted on the stage-i text.
    Exponential expression size — for tests on small inputs only."""
    cur = _col(text)
    counts = []
    for p in PATTERNS:
        counts.append(F.coalesce(F.regexp_count(cur, F.lit(p.java_regex)), F.lit(0)))
        cur = F.regexp_replace(cur, p.java_regex, p.placeholder)
    return counts


def findings_from_counts(counts: list[Column]) -> Column:
    """One (pii_type, placeholder) struct per replacement, pattern order first (P10)."""
    parts = [
        F.array_repeat(F.struct(F.lit(p.pii_type).alias("pii_type"), F.lit(p.placeholder).alias("placeholder")), n)
        for p, n in zip(PATTERNS, counts)
    ]
    return F.flatten(F.array(*parts))


def total_from_counts(counts: list[Column]) -> Column:
    total = counts[0]
    for n in counts[1:]:
        total = total + n
    return total


def scrub(text: Column | str) -> Column:
    """P9/P10 as one struct column: scrubbed_text, findings, has_pii."""
    scrubbed, counts = scrub_stages(text)
    return F.struct(
        scrubbed.alias("scrubbed_text"),
        findings_from_counts(counts).alias("findings"),
        (total_from_counts(counts) > 0).alias("has_pii"),
    )


def contains_pii(text: Column | str) -> Column:
    """Any pattern matches the original text; null or blank is False."""
    t = _col(text)
    hit = t.rlike(_DIGIT_PATTERNS[0].java_regex)
    for p in _DIGIT_PATTERNS[1:]:
        hit = hit | t.rlike(p.java_regex)
    return F.coalesce((_has_digit(t) & hit) | (_has_at(t) & t.rlike(_AT_PATTERN.java_regex)), F.lit(False))


def with_scrub(df, text_col: str, prefix: str = "pii"):
    """DataFrame form of P9/P10: adds ``{prefix}_text``, ``{prefix}_counts`` (one per
    pattern, in order), ``{prefix}_count`` and ``{prefix}_findings``. The scrubbed text is projected first and the counts
    read it from the column, so the regex chain is evaluated once per row."""
    out = df.withColumn(f"{prefix}_text", scrub_text(F.col(text_col)))
    # The tag arrays are projected once each; the counts then read them as columns.
    out = out.withColumns({f"_{prefix}_tags_in": placeholder_tags(F.col(text_col)),
                           f"_{prefix}_tags_out": placeholder_tags(F.col(f"{prefix}_text"))})
    out = out.withColumn(f"{prefix}_counts", F.zip_with(
        counts_from_tags(F.col(f"_{prefix}_tags_out")), counts_from_tags(F.col(f"_{prefix}_tags_in")),
        lambda a, b: a - b)).drop(f"_{prefix}_tags_in", f"_{prefix}_tags_out")
    per_type = [F.col(f"{prefix}_counts")[i] for i in range(len(PATTERNS))]
    return out.withColumns(
        {
            f"{prefix}_count": total_from_counts(per_type),
            f"{prefix}_findings": findings_from_counts(per_type),
        }
    )
