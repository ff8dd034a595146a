"""Realism comparison of two corpora (C3): seven features, percentiles of length, rates in percent, and a verdict each."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evalgrove.functions import text as fn
from evalgrove.operators.stats import index_percentiles

RATES = ("question", "exclamation", "shout", "typo", "greeting", "polite")


def compare(synthetic: DataFrame, real: DataFrame, text: str = "text", within: float = 10.0) -> DataFrame:
    """(feature, synthetic, real, verdict). Lengths are p10/p50/p90 and have no verdict; rates are rounded to one place before they are compared."""
    tagged = synthetic.select(F.lit("synthetic").alias("corpus"), F.col(text).alias("t")).unionByName(real.select(F.lit("real").alias("corpus"), F.col(text).alias("t")))
    f = fn.features(F.coalesce("t", F.lit("")))
    rows = tagged.select("corpus", *[c.cast("double").alias(k) for k, c in f.items()])
    rates = rows.groupBy("corpus").agg(*[F.round(F.avg(r) * 100, 1).alias(r) for r in RATES])
    long = rates.select("corpus", F.explode(F.array(*[F.struct(F.lit(r).alias("feature"), F.col(r).alias("v")) for r in RATES])).alias("x")).select("corpus", "x.*")
    lengths = index_percentiles(rows, "n_words", by=["corpus"]).select("corpus", F.concat(F.lit("length_p"), (F.col("share") * 100).cast("int").cast("string")).alias("feature"), F.col("value").alias("v"))
    wide = long.unionByName(lengths).groupBy("feature").pivot("corpus", ["synthetic", "real"]).agg(F.first("v"))
    verdict = F.when(F.col("feature").startswith("length"), None).when(F.abs(F.col("synthetic") - F.col("real")) < within, "Comparable").otherwise("Different")
    return wide.select("feature", "synthetic", "real", verdict.alias("verdict"))
