"""Cosine similarity as a column expression.

Arithmetic follows the original exactly: each element product is a float32
product, accumulated left to right in double; the quotient of the dot product
by the product of the square-rooted magnitudes is cast back to float. Null
inputs, unequal lengths and zero-magnitude vectors score 0.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from guardrag.functions.text import col_

# Smallest positive double: magnitudes at or below it count as zero.
DOUBLE_EPSILON = 5e-324


def _dsum(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0).cast("double"), lambda acc, v: acc + v.cast("double"))


def dot_product(a: Column | str, b: Column | str) -> Column:
    return _dsum(F.zip_with(col_(a), col_(b), lambda x, y: x * y))


def squared_norm(a: Column | str) -> Column:
    """Sum of float32 squares accumulated in double; store it once per row."""
    return _dsum(F.transform(col_(a), lambda x: x * x))


def cosine_from_parts(dot: Column, mag_a: Column, mag_b: Column) -> Column:
    zero = (mag_a <= F.lit(DOUBLE_EPSILON)) | (mag_b <= F.lit(DOUBLE_EPSILON))
    return F.when(zero, F.lit(0.0).cast("float")).otherwise(
        (dot / (F.sqrt(mag_a) * F.sqrt(mag_b))).cast("float")
    )


def cosine(a: Column | str, b: Column | str, mag_a: Column | None = None, mag_b: Column | None = None) -> Column:
    """Safe cosine of two float arrays → float. Pass precomputed squared norms when available."""
    a, b = col_(a), col_(b)
    mag_a = squared_norm(a) if mag_a is None else mag_a
    mag_b = squared_norm(b) if mag_b is None else mag_b
    invalid = a.isNull() | b.isNull() | (F.size(a) != F.size(b))
    return F.when(invalid, F.lit(0.0).cast("float")).otherwise(cosine_from_parts(dot_product(a, b), mag_a, mag_b))
