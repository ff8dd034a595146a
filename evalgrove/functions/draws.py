"""Deterministic draws: the same number in every engine and every run."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def draw(key: Column) -> Column:
    """A number in [0, 1) from the first 32 bits of md5."""
    return F.conv(F.substring(F.md5(key.cast("string")), 1, 8), 16, 10).cast("double") / F.lit(4294967296.0)


def by_bounds(value: Column, bounds: list[tuple[str, float]]) -> Column:
    """The first name whose bound is at or above the value."""
    out = F.lit(bounds[-1][0])
    for name, bound in reversed(bounds[:-1]):
        out = F.when(value <= bound, name).otherwise(out)
    return out
