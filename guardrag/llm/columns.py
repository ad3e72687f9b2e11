"""Column names of a caller's table beside an operator's own."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def set_aside(docs: DataFrame, reserved: Iterable[str]) -> tuple[DataFrame, dict[str, str]]:
    """``docs`` with columns named like a reserved name (in any case) renamed, and the map of old to new names.

    New names are free: they clash neither with a reserved name nor with another column.
    """
    held = {r.lower() for r in reserved}
    taken = {c.lower() for c in docs.columns} | held
    names: dict[str, str] = {}
    for c in docs.columns:
        if c.lower() in held:
            new = f"own_{c}"
            while new.lower() in taken:
                new += "_"
            taken.add(new.lower())
            names[c] = new
    return (docs.withColumnsRenamed(names) if names else docs), names


def put_back(columns: Iterable[str], names: dict[str, str]) -> list[Column]:
    """The select list that gives ``columns`` their own names again."""
    return [F.col(f"`{names.get(c, c)}`").alias(c) for c in columns]
