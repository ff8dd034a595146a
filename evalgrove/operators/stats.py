"""Distributions (A13-A16, A20): order statistics by index, value counts, distinct counts, slices."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def index_percentiles(df: DataFrame, value: str, shares: tuple[float, ...] = (0.1, 0.5, 0.9), by: list[str] | None = None) -> DataFrame:
    """(by..., share, value): element floor(n * share) of the sorted values, from a histogram and its running sum.

    The window runs over distinct values, not rows, so a hot group shrinks before the shuffle.
    """
    by = by or []
    counted = df.filter(F.col(value).isNotNull()).groupBy(*by, value).agg(F.count(F.lit(1)).alias("c"))
    order = W.partitionBy(*by).orderBy(value)
    run = counted.withColumn("upto", F.sum("c").over(order)).withColumn("n", F.sum("c").over(W.partitionBy(*by)))
    wanted = run.withColumn("share", F.explode(F.array(*[F.lit(s) for s in shares])))
    at = F.floor(F.col("n") * F.col("share"))
    return wanted.filter((at < F.col("upto")) & (at >= F.col("upto") - F.col("c"))).select(*by, "share", F.col(value).alias("value"))


def value_counts(df: DataFrame, column: str) -> DataFrame:
    """(value, cnt, rank), the most frequent first, ties by value."""
    counted = df.groupBy(F.col(column).cast("string").alias("value")).agg(F.count(F.lit(1)).alias("cnt"))
    return counted.withColumn("rank", F.row_number().over(W.orderBy(F.col("cnt").desc(), F.col("value").asc_nulls_last())))


def distinct_counts(df: DataFrame, columns: list[str]) -> DataFrame:
    """(column, n_distinct), exact, null not counted."""
    long = df.select(F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast("string").alias("v")) for c in columns])).alias("x")).select("x.*")
    return long.distinct().groupBy("column").agg(F.count("v").alias("n_distinct"))


def slice_counts(df: DataFrame, dimensions: list[str]) -> DataFrame:
    """(dimension, slice, cnt) for each dimension by itself, in one scan."""
    long = df.select(F.explode(F.array(*[F.struct(F.lit(c).alias("dimension"), F.col(c).cast("string").alias("slice")) for c in dimensions])).alias("x")).select("x.*")
    return long.groupBy("dimension", "slice").agg(F.count(F.lit(1)).alias("cnt"))


def validated_labels(cases: DataFrame) -> DataFrame:
    """A20."""
    return cases.agg(F.count_if(F.coalesce(F.col("label_status") == "human_validated", F.lit(False))).alias("human_validated"), F.count(F.lit(1)).alias("total"))
