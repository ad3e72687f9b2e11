"""Many fixed words looked for in one pass over a text.

The words become one prefix tree, written as a regular expression that matches the longest word
starting at a position. Every word that starts there is a prefix of that longest one, so the
distinct words of a text follow from the distinct longest matches, each with the words it begins with.
The expression stays in the JVM; its size grows with the words, never with the data.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

GROUP = 5

def _tree(words: list[str]) -> dict:
    root: dict = {}
    for word in words:
        node = root
        for ch in word:
            node = node.setdefault(ch, {})
        node[""] = {}
    return root


def _escaped(ch: str) -> str:
    return ch if ch.isalnum() else "\\" + ch if ch.isascii() and not ch.isspace() else f"\\x{{{ord(ch):x}}}"


def _pattern(node: dict) -> str:
    """The rest of a word from ``node`` on, the longest first."""
    chain = ""
    while len(node) == 1 and "" not in node:
        ch, node = next(iter(node.items()))
        chain += _escaped(ch)
    letters = sorted(ch for ch in node if ch)
    if not letters:
        return chain
    branches = [_escaped(ch) + _pattern(node[ch]) for ch in letters]
    if len(branches) > GROUP:  # a position is tried against classes of first letters, then against the words of one class
        branches = [f"(?=[{''.join(map(_escaped, letters[i:i + GROUP]))}])(?:{'|'.join(branches[i:i + GROUP])})" for i in range(0, len(letters), GROUP)]
    return chain + "(?:" + "|".join(branches) + ")" + ("?" if "" in node else "")


def tree_pattern(words: list[str]) -> str:
    """A regular expression for the longest of ``words`` (not empty) at a position."""
    return _pattern(_tree(words))


def distinct_words(lowered: Column, words: list[str]) -> Column:
    """How many of the distinct lower-cased ``words`` occur in ``lowered`` as substrings; 0 for null. The empty word occurs in every text."""
    named = [w for w in words if w]
    always = F.when(lowered.isNotNull(), F.lit(len(words) - len(named))).otherwise(F.lit(0))
    if not named:
        return always
    longest = F.array_distinct(F.regexp_extract_all(F.coalesce(lowered, F.lit("")), F.lit(f"(?=({tree_pattern(named)}))"), F.lit(1)))
    begins = {w: [v for v in named if w.startswith(v)] for w in named}
    shared = [x for w, own in begins.items() if len(own) > 1 for x in (F.lit(w), F.array(*[F.lit(v) for v in own]))]
    if shared:
        known = F.create_map(*shared)
        longest = F.array_distinct(F.flatten(F.transform(longest, lambda w: F.coalesce(known[w], F.array(w)))))
    return F.size(longest) + always


def least_words(words: list[str]) -> list[str]:
    """The words that hold no other of them: a text that holds one of ``words`` holds one of these."""
    return [w for w in words if not any(v != w and v in w for v in words)]
