"""Splits, samples and generation (G1-G7, J1, J7, J8, W2, W3, V5): draws come from md5, never from a generator's state."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from evalgrove.functions import text as fn
from evalgrove.functions.draws import by_bounds, draw

SPLITS = [("optimization", 0.5), ("development", 0.7), ("holdout_candidate", 1.0)]
FAMILIES = ("short_mobile", "typo_noisy", "non_native", "emotional")


def split_of(seed_id: Column) -> Column:
    """G1: all rows of a seed get one split."""
    return by_bounds(draw(seed_id), SPLITS)


def assign_splits(df: DataFrame, seed: str = "seed_id") -> DataFrame:
    return df.withColumn("split", split_of(F.col(seed)))


def stratified_sample(df: DataFrame, key: str, stratum: str, share: float = 0.2) -> DataFrame:
    """max(1, round(n * share)) rows of each stratum, in md5 order; a null stratum is 'unknown'."""
    named = df.withColumn("__s", F.coalesce(F.col(stratum).cast("string"), F.lit("unknown")))
    sizes = named.groupBy("__s").agg(F.greatest(F.lit(1), F.round(F.count(F.lit(1)) * share)).cast("long").alias("__most"))
    order = W.partitionBy("__s").orderBy(F.md5(F.col(key).cast("string")), key)
    return named.join(sizes, "__s").withColumn("__n", F.row_number().over(order)).filter("__n <= __most").drop("__s", "__most", "__n")


def random_sample(df: DataFrame, key: str, n: int, salt: str = "") -> DataFrame:
    """N rows in md5 order."""
    return df.orderBy(F.md5(F.concat(F.lit(salt), F.col(key).cast("string"))), key).limit(n)


def blind_sheet(real: DataFrame, synthetic: DataFrame, n: int = 10, salt: str = "blind") -> DataFrame:
    """(place, text, label) of n texts of each corpus (key, text), shuffled."""
    both = random_sample(real, "key", n, "real").withColumn("label", F.lit("real")).unionByName(random_sample(synthetic, "key", n, "synthetic").withColumn("label", F.lit("synthetic")))
    return both.withColumn("place", F.row_number().over(W.orderBy(F.md5(F.concat(F.lit(salt), F.col("label"), F.col("key").cast("string"))))))


def spot_check(cases: DataFrame, n: int = 10) -> DataFrame:
    """Critical cases first, then n // 3 others at random, n in all."""
    extra = random_sample(cases, "case_id", n // 3).withColumn("__p", F.lit(1))
    both = cases.filter("risk_level = 'critical'").withColumn("__p", F.lit(0)).unionByName(extra)
    once = both.withColumn("__n", F.row_number().over(W.partitionBy("case_id").orderBy("__p"))).filter("__n = 1")
    return once.orderBy("__p", "case_id").limit(n).drop("__p", "__n")


def families(seed_id: Column, risk: Column, difficulty: Column) -> Column:
    """Array of the families that apply; one draw serves both of its bounds."""
    r = draw(F.concat(F.lit("family:"), seed_id))
    risk, difficulty = F.coalesce(risk, F.lit("low")), F.coalesce(difficulty, F.lit("direct"))
    low, direct, critical = risk == "low", difficulty == "direct", risk == "critical"
    name = lambda p, f: F.when(p, F.lit(f))
    return F.array_compact(F.array(F.lit("short_mobile"), name(low & direct & (r < 0.5), "typo_noisy"), name(low & ~direct & (r < 0.3), "typo_noisy"), name(critical, "emotional"), name((low & direct & (r < 0.3)) | critical, "non_native")))


#: The families' names, descriptions, and what a generator is told (own words).
FAMILY_ROWS = (
    ("short_mobile", "Short message", "typed in a hurry on a phone", "Say the same in at most eight words, without greeting."),
    ("typo_noisy", "Typing errors", "letters swapped or left out", "Keep the meaning and put in three to five typing errors."),
    ("non_native", "Second language", "simple words and small grammar errors", "Write as someone who still learns the language."),
    ("emotional", "Upset", "worried or angry", "Let it be felt how upset the writer is; change no facts."),
    ("missing_context", "Context left out", "details are taken for granted", "Leave out what a reader would need to know first."),
)


def family_table(spark: SparkSession) -> DataFrame:
    """The families as a table."""
    return spark.createDataFrame(FAMILY_ROWS, "family_id string, family_name string, family_description string, instruction string")


def with_family(rows: DataFrame, families_: DataFrame | None = None) -> DataFrame:
    """Each row with its family's columns, null for an unknown id."""
    families_ = family_table(rows.sparkSession) if families_ is None else families_
    return rows.join(F.broadcast(families_), "family_id", "left")  # a handful of rows


def variant_families(seeds: DataFrame) -> DataFrame:
    """(seed_id, family_id), a row for each family."""
    return seeds.select("seed_id", F.explode(families(F.col("seed_id"), F.col("risk_level"), F.col("difficulty"))).alias("family_id"))


def variants(seeds: DataFrame, existing: DataFrame | None = None) -> DataFrame:
    """Rows of variants still to be made, with their seed's labels and split; numbered on from the existing ones (seed_id, family_id, n)."""
    todo = variant_families(seeds)
    if existing is not None:
        todo = todo.join(existing, ["seed_id", "family_id"], "left_anti")
    rows = todo.join(seeds, "seed_id").withColumn("n", F.row_number().over(W.partitionBy("seed_id", "family_id").orderBy("query")))
    return rows.withColumns({"case_id": fn.variant_id(F.col("seed_id"), F.col("family_id"), F.col("n")), "source": F.concat(F.lit("synthetic_variant_"), F.col("family_id")), "label_status": F.lit("unreviewed")}).drop("n")


def product(personas: DataFrame, scenarios: DataFrame, modifiers: DataFrame, limit: int | None = None) -> DataFrame:
    """All combinations of three small lists (each with a column ``ord``), or the first ``limit`` of them in order."""
    prefix = lambda df, p: df.select([F.col(c).alias(f"{p}_{c}") for c in df.columns])
    out = prefix(personas, "persona").crossJoin(prefix(scenarios, "scenario")).crossJoin(prefix(modifiers, "modifier"))
    return out if limit is None else out.orderBy("persona_ord", "scenario_ord", "modifier_ord").limit(limit)
