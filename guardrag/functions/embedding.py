"""Embedding slot (T3a) and the two built-in embedders as column expressions.

An embedder is any ``Callable[[Column], Column]`` returning ``array<float>``.
A model-backed embedder is an iterator ``pandas_udf`` with that signature.

* ``constant_embedder`` — the stub: the same 3-vector for every text (T3b).
* ``hashing_embedder(dim)`` — token counts hashed into ``dim`` buckets (T3c).
  A token is a maximal run of letters/digits of the lower-cased text; its bucket
  is the first 8 hex digits of its MD5, read as an integer, modulo ``dim``.
  The JVM finds the tokens and hands them over as one spaced text a row (an array a row
  costs more); an Arrow function hashes each different token of a batch once and
  counts the buckets of all rows (one ``bincount`` per batch).
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from guardrag.config import CONSTANT_EMBEDDING
from guardrag.functions.text import col_

Embedder = Callable[[Column], Column]

TOKEN_REGEX = r"[\p{L}\p{N}]+"
BETWEEN_TOKENS_REGEX = r"[^\p{L}\p{N}]+"


def tokens(text: Column | str) -> Column:
    return F.coalesce(F.regexp_extract_all(F.lower(col_(text)), F.lit(TOKEN_REGEX), 0), F.array().cast("array<string>"))


def spaced_tokens(text: Column | str) -> Column:
    """The tokens of ``tokens``, as one text: every run of other characters, also at the ends, is one space."""
    return F.regexp_replace(F.lower(col_(text)), F.lit(BETWEEN_TOKENS_REGEX), F.lit(" "))


def token_buckets(distinct: pa.Array, dim: int) -> np.ndarray:
    """The bucket of every token of a string array (without nulls)."""
    words = distinct.cast(pa.binary()).to_numpy(zero_copy_only=False)
    heads = b"".join(hashlib.md5(w, usedforsecurity=False).digest()[:4] for w in words)
    return np.frombuffer(heads, ">u4").astype(np.int64) % dim


def constant_embedder(text: Column | str) -> Column:
    return F.array(*[F.lit(v) for v in CONSTANT_EMBEDDING]).cast("array<float>")


@lru_cache(maxsize=None)
def bucket_histogram(dim: int):
    """Arrow function: tokens, as array<string> or spaced text → array<float> of ``dim`` counts, from list offsets and flat values."""

    @F.arrow_udf(T.ArrayType(T.FloatType()))
    def hist(texts: pa.Array) -> pa.Array:
        n = len(texts)
        lists = texts if pa.types.is_list(texts.type) else pc.split_pattern(texts, " ")
        lengths = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        flat = lists.flatten()
        at = np.repeat(np.arange(n, dtype=np.int64) * dim, lengths)
        if lists is not texts:  # beside a space at an end there is an empty piece
            word = pc.not_equal(flat, "")
            flat, at = flat.filter(word), at[word.to_numpy(zero_copy_only=False)]
        flat = flat.dictionary_encode()
        at += token_buckets(flat.dictionary, dim)[flat.indices.to_numpy()]
        counts = np.bincount(at, minlength=n * dim).astype(np.float32)
        return pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * np.int32(dim)), pa.array(counts))

    return hist


def hashing_embedder(dim: int = 64) -> Embedder:
    def embed(text: Column | str) -> Column:
        return bucket_histogram(dim)(spaced_tokens(text))

    return embed


def model_embedder(load: Callable[[], Callable[[list[str]], object]]) -> Embedder:
    """T3a slot for a real model, as an iterator pandas UDF.

    ``load()`` runs once per task (load weights, open a session) and returns
    ``embed(texts) -> vectors`` (one vector per text), called once per Arrow batch.
    Null texts are passed as "".
    """
    @F.pandas_udf(T.ArrayType(T.FloatType()))
    def embed(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model = load()
        for texts in batches:
            vectors = model(texts.fillna("").tolist())
            yield pd.Series([np.asarray(v, dtype=np.float32) for v in vectors])

    return lambda text: embed(col_(text))
