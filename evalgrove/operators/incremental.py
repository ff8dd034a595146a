"""Resumable work and keyed merges (J2-J5, U1-U4, IO6)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def todo(work: DataFrame, done: DataFrame, keys: list[str], retry: Column | None = None) -> DataFrame:
    """Rows of ``work`` not yet in ``done``; rows of ``done`` for which ``retry`` holds do not count."""
    settled = done if retry is None else done.filter(~F.coalesce(retry, F.lit(False)))
    return work.join(settled.select(*keys), keys, "left_anti")


def in_sample(rows: DataFrame, sample: DataFrame, key: str = "case_id") -> DataFrame:
    """Rows of the sample."""
    return rows.join(sample.select(key), key, "left_semi")


def secondary_judge_set(cases: DataFrame, sample: DataFrame, key: str = "case_id") -> DataFrame:
    """Escalated cases, and those of the sample."""
    flagged = cases.join(sample.select(key).distinct().withColumn("__in", F.lit(True)), key, "left")
    return flagged.filter((F.col("expected_action") == "escalate") | F.col("__in")).drop("__in")


def union_all(*frames: DataFrame) -> DataFrame:
    """U1, IO5: by name; columns that one lacks are null."""
    out = frames[0]
    for df in frames[1:]:
        out = out.unionByName(df, allowMissingColumns=True)
    return out


def first_wins(frames: list[DataFrame], key: str, order: str, where: Column | None = None) -> DataFrame:
    """IO6, U2: the first row of each key across the frames in their order; rows are filtered before they count as seen."""
    tagged = [f.withColumn("__f", F.lit(k)) for k, f in enumerate(frames)]
    rows = union_all(*tagged)
    rows = rows if where is None else rows.filter(where)
    first = W.partitionBy(key).orderBy("__f", order)
    return rows.withColumn("__n", F.row_number().over(first)).filter("__n = 1").drop("__n", "__f")


def latest(rows: DataFrame, key: str, order: list[Column]) -> DataFrame:
    """U4: the last row of each key. ``order`` lists columns, the most significant first."""
    last = W.partitionBy(key).orderBy(*[c.desc() for c in order])
    return rows.withColumn("__n", F.row_number().over(last)).filter("__n = 1").drop("__n")


def set_difference(a: DataFrame, b: DataFrame) -> DataFrame:
    """U3."""
    return a.subtract(b)


def set_intersection(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.intersect(b)
