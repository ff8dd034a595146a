"""Mixing sources to target weights with DataFrame functions only.

Words are added up per source (partial sums before the shuffle, so a source with a third of all rows
costs one row per task). Sources are ordered by code point with null last and take the weights in
turn; together they share ``share`` of all words. A source's target stops at ``most`` times its own
size and the excess goes to the others by weight: with sources ordered by the level at which they
fill up, the final level is a ratio of running sums. The repetition rate is target / size; a document
is taken floor(rate) times plus once more if its seeded hash falls below the fraction.

Defined results: null or empty texts have size 0 and are emitted with taken 0 words; null sources form
one source; repeated rows are decided alike (the hash is of doc_id, null as an empty string); an empty
table gives an empty result. Extra columns are carried through ``mix``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from evalgrove.llm.common import durable, word_count

WEIGHTS = (5, 2, 1)
SHARE = 1.5
MOST = 2.0
SEED = "mix-1"
#: Above this many sources the targets are joined by shuffle instead of broadcast (about 60 bytes a row).
BROADCAST_SOURCES = 50_000


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, most: float = MOST) -> DataFrame:
    """(source, source_size, target) from (source, size). The windows run over one row per source."""
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    place = F.row_number().over(W.orderBy(F.col("source").asc_nulls_last())) - 1
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (place % len(weights) + 1).cast("int"))
    per = per.withColumn("place", place).withColumn("weight", weight)
    per = per.withColumn("cap", F.col("source_size") * F.lit(float(most)))
    filling = W.orderBy(F.col("cap") / F.col("weight"), "place")
    every = W.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    per = per.withColumn("total", F.sum("source_size").over(every) * F.lit(float(share)))
    per = per.withColumn("cap_before", F.coalesce(F.sum("cap").over(filling.rowsBetween(W.unboundedPreceding, -1)), F.lit(0.0)))
    per = per.withColumn("weight_left", F.sum("weight").over(filling.rowsBetween(0, W.unboundedFollowing)))
    per = per.withColumn("level", (F.col("total") - F.col("cap_before")) / F.col("weight_left"))
    # the first source that does not fill up sets the level of all that follow
    open_level = F.when(F.col("level") * F.col("weight") < F.col("cap"), F.col("level"))
    per = per.withColumn("open_level", F.first(open_level, ignorenulls=True).over(filling.rowsBetween(W.unboundedPreceding, 0)))
    target = F.coalesce(F.least(F.col("open_level") * F.col("weight"), F.col("cap")), F.col("cap"))
    return per.select("source", "source_size", target.alias("target"))


def mix(df: DataFrame, key: str = "doc_id", source: str = "source", text: str = "text", weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, most: float = MOST, seed: str = SEED) -> DataFrame:
    """Every row with ``mix``: struct(size, source_size, target, rate, copies). Explode ``copies`` to emit the repetitions."""
    size = word_count(F.col(text))
    per = durable(targets(df.select(F.col(source).alias("source"), size.alias("size")), weights, share, most))
    rate = F.coalesce(F.least(F.try_divide(F.col("target"), F.col("source_size").cast("double")), F.lit(float(most))), F.lit(0.0))
    per = per.select(F.coalesce("source", F.lit("")).alias("__s"), F.col("source").isNull().alias("__n"), "source_size", "target", rate.alias("rate"))
    per = per.select("__s", "__n", F.struct("source_size", "target", "rate").alias("__per"))
    if per.count() <= BROADCAST_SOURCES:
        per = F.broadcast(per)
    whole = df.withColumn("__s", F.coalesce(F.col(source), F.lit(""))).withColumn("__n", F.col(source).isNull())
    whole = whole.join(per, ["__s", "__n"], "left").drop("__s", "__n")
    draw = F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(key).cast("string"), F.lit("")))), 1, 13), 16, 10).cast("double") / F.lit(float(1 << 52))
    floor = F.floor("__per.rate")
    copies = (floor + F.when(draw < F.col("__per.rate") - floor, 1).otherwise(0)).cast("long")
    return whole.withColumn("mix", F.struct(size.alias("size"), F.col("__per.source_size").alias("source_size"), F.col("__per.target").alias("target"), F.col("__per.rate").alias("rate"), copies.alias("copies"))).drop("__per")


def emit(mixed: DataFrame) -> DataFrame:
    """Each document ``copies`` times, without the decision column."""
    return mixed.withColumn("__copy", F.explode(F.array_repeat(F.lit(1), F.col("mix.copies").cast("int")))).drop("__copy", "mix")


#: The same in DuckDB SQL, over a relation ``documents``.
ORACLE_SQL = r"""
WITH sized AS (
  SELECT doc_id, source, CAST(CASE WHEN text IS NULL THEN 0 ELSE len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')) END AS BIGINT) AS size
  FROM documents
), per AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size,
         CAST(CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS DOUBLE) AS weight,
         row_number() OVER (ORDER BY source NULLS LAST) AS place
  FROM sized GROUP BY source
), run AS (
  SELECT *, 2.0::DOUBLE * source_size AS cap, sum(source_size) OVER () * 1.5::DOUBLE AS total,
         coalesce(sum(2.0::DOUBLE * source_size) OVER (ORDER BY 2.0::DOUBLE * source_size / weight, place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS cap_before,
         sum(weight) OVER (ORDER BY 2.0::DOUBLE * source_size / weight, place ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS weight_left
  FROM per
), levels AS (
  SELECT *, (total - cap_before) / weight_left AS level FROM run
), target AS (
  SELECT source, source_size,
         first_value(CASE WHEN level * weight < cap THEN level END IGNORE NULLS) OVER (ORDER BY cap / weight, place ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS open_level,
         weight, cap
  FROM levels
), rated AS (
  SELECT source, source_size, coalesce(least(open_level * weight, cap), cap) AS target FROM target
), drawn AS (
  SELECT s.doc_id, s.size, r.source_size, r.target,
         coalesce(least(r.target / nullif(CAST(r.source_size AS DOUBLE), 0), 2.0::DOUBLE), 0) AS rate,
         CAST(('0x' || substr(md5('mix-1:' || coalesce(CAST(s.doc_id AS VARCHAR), '')), 1, 13)) AS BIGINT) / 4503599627370496.0::DOUBLE AS draw
  FROM sized s JOIN rated r ON s.source IS NOT DISTINCT FROM r.source
)
SELECT doc_id, size, source_size, target,
       size * CAST(floor(rate) + CASE WHEN draw < rate - floor(rate) THEN 1 ELSE 0 END AS BIGINT) AS taken
FROM drawn
"""
