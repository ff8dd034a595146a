"""Cases, results and responses derived from the driver's tables, and the same views in DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evalgrove.functions import text as fn
from evalgrove.functions.draws import draw
from evalgrove.operators.sampling import split_of


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = table(spark, sf_dir, "labels")
    d = table(spark, sf_dir, "documents").join(labels, "doc_id", "left")
    seed = F.md5(F.lower(F.trim("text")))
    return d.select(
        F.col("doc_id").alias("case_id"),
        seed.alias("seed_id"),
        F.col("text").alias("query"),
        F.col("source").alias("topic"),
        F.col("lang").alias("difficulty"),
        F.when(F.col("toxic") == 1, "escalate").when(F.col("toxic") == 0, "answer").alias("expected_action"),
        F.when(F.col("toxic") == 1, "critical").otherwise("low").alias("risk_level"),
        F.col("source").alias("expected_article"),
        split_of(seed).alias("split"),
        "quality",
    )


def results(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = cases(spark, sf_dir)
    id_ = F.col("case_id")
    g, s = draw(F.concat(F.lit("g"), id_.cast("string"))), draw(F.concat(F.lit("s"), id_.cast("string")))
    return c.withColumns(
        {
            "action": F.when(fn.sensitive(F.col("query")), "escalate").otherwise("answer"),
            "correct": F.col("quality") == 1,
            "grounded": F.when(g >= 0.1, g < 0.8),
            "safe": F.when(s >= 0.3, s < 0.95),
            "titles": F.transform(F.array(*[F.lit(k) for k in range(5)]), lambda k: F.concat(F.lit("src"), ((id_ * 7 + k * 3) % 20).cast("string"))),
        }
    )


def responses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Assistant turns with first lines of five shapes."""
    t = table(spark, sf_dir, "conversations").filter("role = 'assistant'")
    kind = (F.col("conv_id") + F.col("turn")) % 5
    first = F.when(kind == 0, "ACTION: answer\n").when(kind == 1, "action: ESCALATE  \n").when(kind == 2, "ACTION: maybe\n").when(kind == 3, "").otherwise("\nACTION: answer\n")
    difficulty = F.when(F.col("conv_id") % 3 == 0, "unknown").otherwise("direct")
    risk = F.when(F.col("conv_id") % 4 == 0, "critical").otherwise("low")
    return t.select("conv_id", "turn", F.concat(first, "text").alias("bot_response"), difficulty.alias("difficulty"), risk.alias("risk_level"))


def sensitive_sql(x: str) -> str:
    patterns = "|".join(("(?:" + p + ")").replace(r"(?<!\d)\d{3,4}(?!\d)", "(?:^|[^0-9])[0-9]{3,4}(?:[^0-9]|$)") for p in fn.SENSITIVE)
    harmless = " OR ".join(f"contains(lower(coalesce({x}, '')), '{p}')" for p in fn.HARMLESS)
    return f"(NOT ({harmless}) AND regexp_matches(lower(coalesce({x}, '')), '{patterns}'))"


def draw_sql(x: str) -> str:
    return f"(('0x' || substr(md5({x}), 1, 8))::BIGINT / 4294967296.0::DOUBLE)"


_SPLIT = "CASE WHEN {0} <= 0.5 THEN 'optimization' WHEN {0} <= 0.7 THEN 'development' ELSE 'holdout_candidate' END".format(draw_sql("seed_id"))

SQL = rf"""
WITH v_base AS (
  SELECT d.doc_id AS case_id, md5(lower(trim(d.text))) AS seed_id, d.text AS query, d.source AS topic, d.lang AS difficulty,
         CASE WHEN l.toxic = 1 THEN 'escalate' WHEN l.toxic = 0 THEN 'answer' END AS expected_action,
         CASE WHEN l.toxic = 1 THEN 'critical' ELSE 'low' END AS risk_level, d.source AS expected_article, l.quality
  FROM documents d LEFT JOIN labels l USING (doc_id)
), v_cases AS (
  SELECT *, {_SPLIT} AS split FROM v_base
), v_results AS (
  SELECT *, CASE WHEN {sensitive_sql("query")} THEN 'escalate' ELSE 'answer' END AS action, quality = 1 AS correct,
         CASE WHEN {draw_sql("'g' || case_id")} >= 0.1 THEN {draw_sql("'g' || case_id")} < 0.8 END AS grounded,
         CASE WHEN {draw_sql("'s' || case_id")} >= 0.3 THEN {draw_sql("'s' || case_id")} < 0.95 END AS safe,
         list_transform([0, 1, 2, 3, 4], lambda k: 'src' || ((case_id * 7 + k * 3) % 20)) AS titles
  FROM v_cases
), v_responses AS (
  SELECT conv_id, turn, CASE (conv_id + turn) % 5 WHEN 0 THEN 'ACTION: answer' || chr(10) WHEN 1 THEN 'action: ESCALATE  ' || chr(10)
           WHEN 2 THEN 'ACTION: maybe' || chr(10) WHEN 3 THEN '' ELSE chr(10) || 'ACTION: answer' || chr(10) END || text AS bot_response,
         CASE WHEN conv_id % 3 = 0 THEN 'unknown' ELSE 'direct' END AS difficulty, CASE WHEN conv_id % 4 = 0 THEN 'critical' ELSE 'low' END AS risk_level
  FROM conversations WHERE role = 'assistant'
), v_parsed AS (
  SELECT *, CASE WHEN found = '' THEN 'format_violation' ELSE found END AS action FROM (
    SELECT *, lower(regexp_extract(trim(split_part(bot_response, chr(10), 1), ' ' || chr(9) || chr(13)), '(?i)^ACTION:\s*(answer|escalate)\s*$', 1)) AS found FROM v_responses)
)
"""
