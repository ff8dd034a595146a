"""The evaluation run: what is left to do, retrieval, generation, parsing, judging, and an appended checkpoint."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from evalgrove.functions import text as fn
from evalgrove.functions import vector as fv
from evalgrove.operators import incremental, metrics, retrieval, sampling
from evalgrove.plans import backends
from evalgrove.sources import files

CASE_COLUMNS = ("case_id", "seed_id", "query", "expected_action", "expected_article", "risk_level", "difficulty", "topic", "source", "split")
RESULT = ", ".join(f"{c} string" for c in CASE_COLUMNS) + """, timestamp string, titles array<string>,
    retrieved_articles array<struct<article_id: string, title: string, score: double>>, bot_response string, bot_success boolean, bot_error string,
    action string, sensitive_data_detected boolean, correct boolean, grounded boolean, safe boolean,
    correctness struct<correct: boolean, reason: string>, correctness_error string, groundedness struct<grounded: boolean, reason: string>,
    groundedness_error string, safety struct<safe: boolean, reason: string>, legal struct<compliant: boolean, reason: string>,
    redirects_when_unknown struct<correct_redirect: boolean, reason: string>, primary_judges_error string, secondary_judges_error string"""
#: What each judge's verdict is called in a result.
VERDICTS = {"correctness": "correct", "groundedness": "grounded", "safety": "safe", "legal": "compliant", "redirects_when_unknown": "correct_redirect"}
#: Cases of a batch; a run that is stopped loses one batch at most.
BATCH = 1_000


def knowledge(articles: DataFrame, backend: backends.Backend) -> DataFrame:
    """Articles with their text and unit vectors."""
    kb = articles.withColumn("text", fn.article_text(F.col("title"), F.col("content_text"), F.col("content")))
    return backends.embed(kb, backend, "text").withColumn("vec_id", F.col("article_idx")).withColumn("embedding", fv.normalised(F.col("embedding")))


def secondary_sample(cases: DataFrame) -> DataFrame:
    """Cases to be answered that the secondary judges see."""
    return sampling.stratified_sample(cases.filter("expected_action = 'answer'"), "case_id", "topic").select("case_id")


def results(cases: DataFrame, kb: DataFrame, backend: backends.Backend, sample: DataFrame, top_k: int = 4) -> DataFrame:
    """One row of RESULT for each case; columns that the cases lack are null. kb: from ``knowledge``; sample: case_id, from ``secondary_sample``."""
    cases = cases.withColumns({c: F.lit(None).cast("string") for c in CASE_COLUMNS if c not in cases.columns})
    keyed = files.numbered(cases, ["case_id"], "vec_id")
    asked = backends.embed(keyed.select("vec_id", "query"), backend)
    hits = retrieval.top_k(asked, kb.select("vec_id", "embedding"), top_k, exclude_self=False)
    named = kb.select(F.col("article_idx").alias("idx"), "article_id", F.coalesce("title", F.lit("")).alias("title"), F.coalesce("content_text", "content", F.lit("")).alias("content"))
    found = hits.join(named, "idx").groupBy(F.col("query_id").alias("vec_id")).agg(F.sort_array(F.collect_list(F.struct("rank", "title", "content", "article_id", "score"))).alias("h"))
    rows = keyed.join(found, "vec_id", "left")
    context = F.transform("h", lambda x: F.struct(x["rank"].alias("rank"), x["title"].alias("title"), x["content"].alias("content")))
    rows = rows.withColumns({
        "context": fn.context(F.coalesce(context, F.array().cast("array<struct<rank:int,title:string,content:string>>"))),
        "titles": F.transform("h", lambda x: x["title"]),
        "retrieved_articles": F.transform("h", lambda x: F.struct(x["article_id"].alias("article_id"), x["title"].alias("title"), x["score"].alias("score"))),
    })
    rows = backends.generate(rows.drop("h", "vec_id"), backend)
    rows = rows.withColumn("action", F.when(F.col("bot_success"), fn.parse_action(F.col("bot_response")))).withColumn("sensitive_data_detected", F.when(F.col("bot_success"), fn.sensitive(F.col("bot_response"))))
    rows = backends.judge(rows, backend, backends.PRIMARY, F.col("bot_success"))
    rows = rows.join(sample.withColumn("__sampled", F.lit(True)), "case_id", "left")
    rows = backends.judge(rows, backend, backends.SECONDARY, F.col("bot_success") & ((F.col("expected_action") == "escalate") | F.coalesce("__sampled", F.lit(False))))
    errors = lambda judges: F.nullif(F.array_join(F.array_compact(F.array(*[F.col(f"{j}.error") for j in judges])), "; "), F.lit(""))
    verdict = lambda j: F.when(F.col(f"{j}.passed").isNotNull(), F.struct(F.col(f"{j}.passed").alias(VERDICTS[j]), F.col(f"{j}.reason").alias("reason")))
    told = {"correct": F.col("correctness.passed"), "grounded": F.col("groundedness.passed"), "safe": F.col("safety.passed"), "timestamp": F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss")}
    told |= {"primary_judges_error": errors(backends.PRIMARY), "secondary_judges_error": errors(backends.SECONDARY), "correctness_error": F.col("correctness.error"), "groundedness_error": F.col("groundedness.error")}
    rows = rows.withColumns(told | {j: verdict(j) for j in VERDICTS})
    return rows.select(*T.StructType.fromDDL(RESULT).names)


def run(spark: SparkSession, cases: DataFrame, articles: DataFrame, backend: backends.Backend, checkpoint: str, resume: bool = True, retry_failed: bool = False, subset: bool = False, batch: int = BATCH) -> DataFrame:
    """Evaluate what the checkpoint does not hold, append it batch by batch, and return all results. ``subset``: cases to be escalated only."""
    wanted = cases.filter("expected_action = 'escalate'") if subset else cases
    done = files.read_checkpoint(spark, checkpoint, RESULT)
    retry = ~F.col("bot_success") if retry_failed else None
    left = incremental.todo(wanted, done, ["case_id"], retry) if resume else wanted
    parts = -(-left.count() // batch)
    kb, sample = knowledge(articles, backend).persist(), secondary_sample(wanted)
    for k in range(parts):
        own = left.filter(F.pmod(F.xxhash64("case_id"), F.lit(parts)) == k)
        files.append_checkpoint(results(own, kb, backend, sample).withColumn("at", F.current_timestamp()), checkpoint)
    kb.unpersist()
    every = files.read_checkpoint(spark, checkpoint, f"{RESULT}, at timestamp")
    return incremental.latest(every, "case_id", [F.col("at")]).drop("at")


def report(found: DataFrame, by: list[str] | None = None) -> DataFrame:
    """The metrics of a run."""
    return metrics.compute(found, by)
