"""Two runs against each other (C8) and thresholds on metrics (C9); planned in the survey, built here as extensions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def paired(before: DataFrame, after: DataFrame, passed: str = "passed", key: str = "case_id", by: list[str] | None = None) -> DataFrame:
    """(by..., fixed, regressed, both, neither) over cases that both runs judged."""
    by = by or []
    pairs = before.select(key, *by, F.col(passed).alias("b")).join(after.select(key, F.col(passed).alias("a")), key).filter("a IS NOT NULL AND b IS NOT NULL")
    return pairs.groupBy(*by).agg(F.count_if(~F.col("b") & F.col("a")).alias("fixed"), F.count_if(F.col("b") & ~F.col("a")).alias("regressed"), F.count_if(F.col("b") & F.col("a")).alias("both"), F.count_if(~F.col("b") & ~F.col("a")).alias("neither"))


def guardrails(metrics: DataFrame, bounds: DataFrame) -> DataFrame:
    """metrics (metric, value) against bounds (metric, low, high): (metric, value, ok); a null value is not ok."""
    ok = F.coalesce((F.col("low").isNull() | (F.col("value") >= F.col("low"))) & (F.col("high").isNull() | (F.col("value") <= F.col("high"))), F.lit(False))
    return bounds.join(metrics, "metric", "left").select("metric", "value", (ok & F.col("value").isNotNull()).alias("ok"))
