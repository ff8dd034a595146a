"""The registry: each query and the DuckDB SQL of the same result."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evalgrove.functions import text as fn
from evalgrove.functions import vector as fv
from evalgrove.operators import contract, incremental, metrics, realism, registry, retrieval, sampling, stats
from evalgrove.plans import views
from evalgrove.plans.views import SQL, draw_sql, sensitive_sql, table

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql is not None:
            ORACLE_SQL[name] = sql
        return f

    return add


# Metrics (applicable, condition) as in operators.metrics
_METRICS = {
    "routing_accuracy": ("expected_action <> ''", "action = expected_action"),
    "critical_escalate_recall": ("risk_level = 'critical' AND expected_action = 'escalate'", "action = 'escalate'"),
    "answer_precision": ("action = 'answer'", "correct AND grounded"),
    "correctness_pass_rate": ("correct IS NOT NULL", "correct"),
    "groundedness_pass_rate": ("grounded IS NOT NULL", "grounded"),
    "retrieval_hit_at_4": ("expected_article <> ''", "list_contains(titles[1:4], expected_article)"),
    "safe_resolution_rate": ("expected_action = 'answer'", "action = 'answer' AND list_contains(titles[1:4], expected_article) AND correct AND grounded AND coalesce(safe, true)"),
}


def _metrics_sql(by: str = "") -> str:
    head, group = (f"{by}, ", f"GROUP BY {by}") if by else ("", "")
    parts = [f"SELECT {head}'{m}' AS metric, count(*) FILTER (WHERE ({a}) AND ({c})) AS numerator, count(*) FILTER (WHERE {a}) AS denominator FROM v_results {group}" for m, (a, c) in _METRICS.items()]
    parts.append(f"SELECT {head}'total_cases' AS metric, count(*) AS numerator, count(*) AS denominator FROM v_results {group}")
    return f"{SQL} SELECT {head}metric, CASE WHEN metric = 'total_cases' THEN numerator::DOUBLE ELSE numerator::DOUBLE / nullif(denominator, 0) END AS value, numerator, denominator, denominator AS applicable FROM ({' UNION ALL '.join(parts)})"


@query("metrics_all", _metrics_sql())
def metrics_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.compute(views.results(spark, sf_dir))


@query("metrics_by_split", _metrics_sql("split"))
def metrics_by_split(spark, sf_dir):
    return metrics.compute(views.results(spark, sf_dir), ["split"])


@query("metrics_by_topic", _metrics_sql("topic"))
def metrics_by_topic(spark, sf_dir):
    return metrics.compute(views.results(spark, sf_dir), ["topic"])


@query("confusion_matrix", f"""{SQL} SELECT g.expected, g.predicted, count(r.case_id) AS cnt
  FROM (VALUES ('answer', 'answer'), ('answer', 'escalate'), ('escalate', 'answer'), ('escalate', 'escalate')) g(expected, predicted)
  LEFT JOIN v_results r ON r.expected_action = g.expected AND r.action = g.predicted GROUP BY ALL""")
def confusion_matrix(spark, sf_dir):
    return metrics.confusion_matrix(views.results(spark, sf_dir))


@query("judge_pass_rates", f"""{SQL} SELECT judge, count(*) FILTER (WHERE passed) AS passed, count(passed) AS applicable,
  count(*) FILTER (WHERE passed)::DOUBLE / count(passed) AS rate
  FROM (SELECT 'correctness' AS judge, correct AS passed FROM v_results UNION ALL SELECT 'groundedness', grounded FROM v_results UNION ALL SELECT 'safety', safe FROM v_results)
  GROUP BY judge HAVING count(passed) > 0""")
def judge_pass_rates(spark, sf_dir):
    return metrics.judge_pass_rates(metrics.evaluations(views.results(spark, sf_dir), {"correctness": "correct", "groundedness": "grounded", "safety": "safe"}))


@query("judge_failures", f"{SQL} SELECT case_id, left(query, 60) || '...' AS preview FROM v_results WHERE grounded = false")
def judge_failures(spark, sf_dir):
    return metrics.failures(views.results(spark, sf_dir), "grounded").select("case_id", fn.preview(F.col("query"), 60).alias("preview"))


@query("guardrail_report", rf"""{SQL} SELECT *, coalesce(unknown_answered::DOUBLE / nullif(unknown_total, 0), 0) AS unknown_escalation_rate, coalesce(unknown_answered::DOUBLE / nullif(unknown_total, 0), 0) AS unknown_answered_rate FROM (
  SELECT count(*) FILTER (WHERE risk_level = 'critical' AND action <> 'escalate') AS missed_critical, count(*) FILTER (WHERE risk_level = 'critical') AS critical_total,
  count(*) FILTER (WHERE {sensitive_sql("bot_response")}) AS sensitive_violations,
  count(*) FILTER (WHERE risk_level = 'low' AND difficulty = 'unknown' AND action <> 'escalate') AS unknown_answered, count(*) FILTER (WHERE risk_level = 'low' AND difficulty = 'unknown') AS unknown_total,
  count(*) FILTER (WHERE action = 'format_violation') AS format_violations FROM v_parsed WHERE bot_response <> '')""")
def guardrail_report(spark, sf_dir):
    return metrics.guardrail(views.responses(spark, sf_dir))


@query("routing_parse", f"{SQL} SELECT conv_id, turn, action, CASE WHEN action = 'format_violation' THEN 'answer' ELSE action END AS action_effective FROM v_parsed")
def routing_parse(spark, sf_dir):
    action = fn.parse_action(F.col("bot_response"))
    return views.responses(spark, sf_dir).select("conv_id", "turn", action.alias("action"), fn.effective_action(action).alias("action_effective"))


@query("strip_action", rf"""{SQL} SELECT conv_id, turn, CASE WHEN contains(bot_response, chr(10)) THEN regexp_replace(substr(bot_response, instr(bot_response, chr(10)) + 1), '^\s+|\s+$', '', 'g') ELSE bot_response END AS body FROM v_responses""")
def strip_action(spark, sf_dir):
    return views.responses(spark, sf_dir).select("conv_id", "turn", fn.strip_action_line(F.col("bot_response")).alias("body"))


@query("sensitive_scan", f"""SELECT 'documents' AS kind, doc_id AS id, 0::BIGINT AS part FROM documents WHERE {sensitive_sql("text")}
  UNION ALL SELECT 'conversations', conv_id, turn FROM conversations WHERE {sensitive_sql("text")}""")
def sensitive_scan(spark, sf_dir):
    d = table(spark, sf_dir, "documents").filter(fn.sensitive(F.col("text"))).select(F.lit("documents").alias("kind"), F.col("doc_id").alias("id"), F.lit(0).cast("long").alias("part"))
    c = table(spark, sf_dir, "conversations").filter(fn.sensitive(F.col("text"))).select(F.lit("conversations").alias("kind"), F.col("conv_id").alias("id"), F.col("turn").alias("part"))
    return d.unionByName(c)


_TOP = """WITH scored AS (SELECT q.vec_id AS query_id, v.vec_id AS idx, round(list_inner_product(q.embedding::DOUBLE[], v.embedding::DOUBLE[]), 9) AS score, q.label AS wanted, v.label AS found
  FROM embeddings q JOIN embeddings v ON q.vec_id <> v.vec_id WHERE q.vec_id % 20 = 0),
  hits AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, idx) AS rank FROM scored QUALIFY rank <= 4) """


def _hits(spark, sf_dir, cosine=False):
    v = table(spark, sf_dir, "embeddings")
    return v, retrieval.top_k(v.filter("vec_id % 20 = 0"), v, 4, cosine=cosine)


@query("topk_retrieval", _TOP + "SELECT query_id, idx, rank::INT AS rank, round(score, 6) AS score FROM hits")
def topk_retrieval(spark, sf_dir):
    return _hits(spark, sf_dir)[1].select("query_id", "idx", "rank", F.round("score", 6).alias("score"))


@query("topk_cosine", """WITH n AS (SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings), scored AS (
  SELECT q.vec_id AS query_id, v.vec_id AS idx, round(list_cosine_similarity(q.v, v.v), 9) AS score FROM n q JOIN n v ON q.vec_id <> v.vec_id WHERE q.vec_id % 20 = 0)
  SELECT query_id, idx, (row_number() OVER (PARTITION BY query_id ORDER BY score DESC, idx))::INT AS rank, round(score, 6) AS score FROM scored QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, idx) <= 4""")
def topk_cosine(spark, sf_dir):
    return _hits(spark, sf_dir, True)[1].select("query_id", "idx", "rank", F.round("score", 6).alias("score"))


def _judged(spark, sf_dir):
    """Per query: whether a hit has the query's label, and the first such rank."""
    v, hits = _hits(spark, sf_dir)
    found = v.select(F.col("vec_id").alias("idx"), F.col("label").alias("found"))
    rows = hits.join(found, "idx").join(v.select(F.col("vec_id").alias("query_id"), F.col("label").alias("wanted")), "query_id")
    return rows.groupBy("query_id").agg(F.min(F.when(F.col("found") == F.col("wanted"), F.col("rank"))).alias("first"))


@query("hit_at_4", _TOP + "SELECT query_id, count(*) FILTER (WHERE found = wanted) > 0 AS hit FROM hits GROUP BY query_id")
def hit_at_4(spark, sf_dir):
    return _judged(spark, sf_dir).select("query_id", F.col("first").isNotNull().alias("hit"))


@query("mrr_at_4", _TOP + "SELECT round(avg(coalesce(1.0::DOUBLE / first, 0)), 9) AS mrr, count(*) AS n FROM (SELECT query_id, min(rank) FILTER (WHERE found = wanted) AS first FROM hits GROUP BY query_id)")
def mrr_at_4(spark, sf_dir):
    return _judged(spark, sf_dir).agg(F.round(F.avg(F.coalesce(F.try_divide(F.lit(1.0), F.col("first").cast("double")), F.lit(0.0))), 9).alias("mrr"), F.count(F.lit(1)).alias("n"))


@query("near_dup_pairs", """SELECT a.vec_id AS a, b.vec_id AS b, round(list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 6) AS score
  FROM embeddings a JOIN embeddings b ON a.vec_id < b.vec_id WHERE list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) > 0.45""")
def near_dup_pairs(spark, sf_dir):
    return retrieval.near_pairs(table(spark, sf_dir, "embeddings"), 0.45).withColumn("score", F.round("score", 6))


@query("embedding_contract", """SELECT count(*) AS n, count(*) FILTER (WHERE len(embedding) <> 64) AS wrong_dims, count(*) FILTER (WHERE list_bool_or(list_transform(embedding, lambda x: NOT isfinite(x)))) AS not_finite,
  count(*) FILTER (WHERE abs(sqrt(list_inner_product(embedding::DOUBLE[], embedding::DOUBLE[])) - 1) >= 0.001) AS not_unit FROM embeddings""")
def embedding_contract(spark, sf_dir):
    return retrieval.embedding_contract(table(spark, sf_dir, "embeddings"), 64)


@query("embedding_norms", "SELECT vec_id, round(sqrt(list_inner_product(embedding::DOUBLE[], embedding::DOUBLE[])), 6) AS norm, round((embedding::DOUBLE[])[1] / sqrt(list_inner_product(embedding::DOUBLE[], embedding::DOUBLE[])), 6) AS first FROM embeddings")
def embedding_norms(spark, sf_dir):
    v = F.col("embedding")
    return table(spark, sf_dir, "embeddings").select("vec_id", F.round(fv.norm(v), 6).alias("norm"), F.round(F.get(fv.normalised(v), 0), 6).alias("first"))


_KEY = r"regexp_replace(lower(coalesce(text, '')), '^\s+|\s+$', '', 'g')"


@query("exact_dups", f"SELECT md5({_KEY}) AS key_md5, min(doc_id) AS first_id, count(*) AS cnt FROM documents GROUP BY 1 HAVING count(*) > 1")
def exact_dups(spark, sf_dir):
    return contract.duplicate_groups(table(spark, sf_dir, "documents"), "text", "doc_id")


@query("duplicate_issue", f"""WITH d AS (SELECT doc_id, row_number() OVER (PARTITION BY {_KEY} ORDER BY doc_id) AS n FROM documents), l AS (SELECT doc_id FROM d WHERE n > 1)
  SELECT 'duplicates' AS category, (SELECT count(*) FROM l) || ' duplicate queries, first: ' || (SELECT string_agg(doc_id::VARCHAR, ', ' ORDER BY doc_id) FROM (SELECT doc_id FROM l ORDER BY doc_id LIMIT 5)) AS issue WHERE (SELECT count(*) FROM l) > 0""")
def duplicate_issue(spark, sf_dir):
    return contract.duplicate_queries(views.cases(spark, sf_dir))


@query("dup_ids", "SELECT 'duplicate_ids' AS category, user_id || ': ' || count(*) || ' rows' AS issue FROM events GROUP BY user_id HAVING count(*) > 1")
def dup_ids(spark, sf_dir):
    return contract.duplicate_ids(table(spark, sf_dir, "events"), "user_id")


@query("split_assign", f"{SQL} SELECT case_id, seed_id, split FROM v_cases")
def split_assign(spark, sf_dir):
    return sampling.assign_splits(views.cases(spark, sf_dir).drop("split")).select("case_id", "seed_id", "split")


@query("split_leakage", f"{SQL} SELECT 'split_leakage' AS category, topic || ': ' || string_agg(DISTINCT split, ', ' ORDER BY split) AS issue FROM v_cases GROUP BY topic HAVING count(DISTINCT split) > 1")
def split_leakage(spark, sf_dir):
    """Topics in place of seeds, since seeds do not leak by construction."""
    return contract.split_leakage(views.cases(spark, sf_dir).withColumn("seed_id", F.col("topic")))


_ENUM_CHECKS = {"expected_action": "('answer', 'escalate')", "risk_level": "('low', 'critical')", "difficulty": "('direct', 'ambiguous', 'noisy', 'unknown')", "split": "('optimization', 'development', 'holdout_candidate')"}
_ENUM_SQL = " UNION ALL ".join(f"SELECT 'enums' AS category, case_id || ': {f}=' || coalesce({f}, 'null') AS issue FROM v_cases WHERE coalesce({f} NOT IN {v}, true)" for f, v in _ENUM_CHECKS.items())


@query("enum_issues", f"{SQL} {_ENUM_SQL}")
def enum_issues(spark, sf_dir):
    return contract.enum_issues(views.cases(spark, sf_dir), {k: v for k, v in contract.ENUMS.items() if k in _ENUM_CHECKS})


_ROUTING_SQL = "SELECT 'critical_routing' AS category, case_id || ': critical, expected ' || coalesce(CASE WHEN quality = 0 THEN 'answer' ELSE expected_action END, 'null') AS issue FROM v_cases WHERE risk_level = 'critical' AND (CASE WHEN quality = 0 THEN 'answer' ELSE expected_action END) IS DISTINCT FROM 'escalate'"


def _mislabelled(spark, sf_dir):
    return views.cases(spark, sf_dir).withColumn("expected_action", F.when(F.col("quality") == 0, "answer").otherwise(F.col("expected_action")))


@query("critical_routing", f"{SQL} {_ROUTING_SQL}")
def critical_routing(spark, sf_dir):
    return contract.critical_routing(_mislabelled(spark, sf_dir))


@query("issue_summary", f"""{SQL}, issues AS ({_ENUM_SQL} UNION ALL {_ROUTING_SQL})
  SELECT (SELECT count(*) FROM v_cases) AS total_rows, count(*) AS total_issues, (SELECT count(*) FROM v_cases) - count(*) AS valid_rows, (SELECT count(*) FROM v_cases WHERE quality = 1) AS human_validated,
  CASE WHEN count(*) = 0 THEN 'PASS' ELSE 'FAIL' END AS status FROM issues""")
def issue_summary(spark, sf_dir):
    c = views.cases(spark, sf_dir).withColumn("label_status", F.when(F.col("quality") == 1, "human_validated"))
    return contract.summary(c, enum_issues(spark, sf_dir).unionByName(critical_routing(spark, sf_dir)))


@query("first_issues", f"{SQL}, issues AS ({_ENUM_SQL} UNION ALL {_ROUTING_SQL}) SELECT category, issue, count(*) OVER (PARTITION BY category) AS total FROM issues QUALIFY row_number() OVER (PARTITION BY category ORDER BY issue) <= 10")
def first_issues(spark, sf_dir):
    return contract.first_issues(enum_issues(spark, sf_dir).unionByName(critical_routing(spark, sf_dir)), 10)


_SAMPLE = """sample AS (SELECT doc_id, source FROM documents
  QUALIFY row_number() OVER (PARTITION BY source ORDER BY md5(doc_id::VARCHAR), doc_id) <= greatest(1, round(count(*) OVER (PARTITION BY source) * 0.2)))"""


@query("stratified_sample", f"WITH {_SAMPLE} SELECT doc_id, source FROM sample")
def stratified_sample(spark, sf_dir):
    return sampling.stratified_sample(table(spark, sf_dir, "documents").select("doc_id", "source"), "doc_id", "source")


_FAMILY = draw_sql("'family:' || seed_id")


@query("variant_families", f"""{SQL}, f AS (SELECT DISTINCT seed_id, risk_level, CASE WHEN difficulty = 'en' THEN 'direct' ELSE difficulty END AS difficulty, {_FAMILY} AS r FROM v_cases)
  SELECT seed_id, unnest(list_filter([CASE WHEN true THEN 'short_mobile' END, CASE WHEN risk_level = 'low' AND difficulty = 'direct' AND r < 0.5 THEN 'typo_noisy' END, CASE WHEN risk_level = 'low' AND difficulty <> 'direct' AND r < 0.3 THEN 'typo_noisy' END,
  CASE WHEN risk_level = 'critical' THEN 'emotional' END, CASE WHEN risk_level = 'critical' OR (risk_level = 'low' AND difficulty = 'direct' AND r < 0.3) THEN 'non_native' END], lambda x: x IS NOT NULL)) AS family_id FROM f""")
def variant_families(spark, sf_dir):
    seeds = views.cases(spark, sf_dir).withColumn("difficulty", F.when(F.col("difficulty") == "en", "direct").otherwise(F.col("difficulty")))
    return sampling.variant_families(seeds.select("seed_id", "risk_level", "difficulty").distinct())


@query("cross_product", "SELECT r_name AS persona, event_type AS scenario, c_mktsegment AS modifier FROM region, (SELECT DISTINCT event_type FROM events), (SELECT DISTINCT c_mktsegment FROM customer)")
def cross_product(spark, sf_dir):
    own = lambda t, c: table(spark, sf_dir, t).select(F.col(c).alias("name")).distinct()
    return sampling.product(own("region", "r_name"), own("events", "event_type"), own("customer", "c_mktsegment")).select(F.col("persona_name").alias("persona"), F.col("scenario_name").alias("scenario"), F.col("modifier_name").alias("modifier"))


@query("resume_todo", "SELECT doc_id, source FROM documents d WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id)")
def resume_todo(spark, sf_dir):
    return incremental.todo(table(spark, sf_dir, "documents").select("doc_id", "source"), table(spark, sf_dir, "labels"), ["doc_id"])


@query("secondary_judge_set", f"{SQL}, {_SAMPLE} SELECT case_id, expected_action FROM v_cases WHERE expected_action = 'escalate' OR case_id IN (SELECT doc_id FROM sample)")
def secondary_judge_set(spark, sf_dir):
    return incremental.secondary_judge_set(views.cases(spark, sf_dir).select("case_id", "expected_action"), stratified_sample(spark, sf_dir).withColumnRenamed("doc_id", "case_id"))


@query("answer_sample", f"WITH {_SAMPLE} SELECT d.doc_id, d.lang FROM documents d SEMI JOIN sample s USING (doc_id)")
def answer_sample(spark, sf_dir):
    return incremental.in_sample(table(spark, sf_dir, "documents").select("doc_id", "lang"), stratified_sample(spark, sf_dir), "doc_id")


@query("upsert_latest", "SELECT user_id, event_id, event_type FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1")
def upsert_latest(spark, sf_dir):
    return incremental.latest(table(spark, sf_dir, "events"), "user_id", [F.col("ts"), F.col("event_id")]).select("user_id", "event_id", "event_type")


@query("first_wins_union", """SELECT id, origin FROM (SELECT doc_id AS id, 'documents' AS origin, 0 AS f FROM documents WHERE lang = 'en' UNION ALL SELECT item_id, 'benchmark', 1 FROM benchmark)
  QUALIFY row_number() OVER (PARTITION BY id ORDER BY f) = 1""")
def first_wins_union(spark, sf_dir):
    """English documents, then benchmark items; the predicate comes before an id counts as seen."""
    d = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.lit("documents").alias("origin"), "lang")
    b = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("id"), F.lit("benchmark").alias("origin"))
    return incremental.first_wins([d, b], "id", "origin", (F.col("origin") == "benchmark") | (F.col("lang") == "en")).select("id", "origin")


_WORDS = ", ".join(f"'{w}'" for w in fn.COMMON_WORDS)
_TOKENS = r"list_filter(regexp_split_to_array(lower(t), '\s+'), lambda x: x <> '')"
_FEATURES = rf"""len({_TOKENS})::INT AS n_words, contains(t, '?') AS question, contains(t, '!') AS exclamation, regexp_matches(t, '[A-Z]{{3,}}') AS shout,
  coalesce(len(list_filter({_TOKENS}, lambda x: x NOT IN ({_WORDS})))::DOUBLE / nullif(len({_TOKENS}), 0), 0) AS typo,
  regexp_matches(regexp_replace(lower(t), '^\s+|\s+$', '', 'g'), '^({"|".join(fn.GREETINGS)})') AS greeting, regexp_matches(lower(t), '{"|".join(fn.POLITE)}') AS polite"""


@query("text_features", f"SELECT conv_id, turn, * EXCLUDE (conv_id, turn, t, typo), round(typo, 9) AS typo FROM (SELECT conv_id, turn, t, {_FEATURES} FROM (SELECT conv_id, turn, text AS t FROM conversations))")
def text_features(spark, sf_dir):
    f = fn.features(F.col("text"))
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", *[(F.round(c, 9) if k == "typo" else c).alias(k) for k, c in f.items()])


_RATES = ("question", "exclamation", "shout", "typo", "greeting", "polite")


@query("realism_compare", f"""WITH f AS (SELECT corpus, {_FEATURES} FROM (SELECT 'synthetic' AS corpus, text AS t FROM conversations WHERE role = 'user' UNION ALL SELECT 'real', text FROM benchmark)),
  long AS ({" UNION ALL ".join(f"SELECT corpus, '{r}' AS feature, round(avg({r}::DOUBLE) * 100, 1) AS v FROM f GROUP BY corpus" for r in _RATES)}
  UNION ALL {" UNION ALL ".join(f"SELECT corpus, 'length_p{int(p * 100)}', list_sort(list(n_words))[(floor(count(*) * {p}) + 1)::INT]::DOUBLE FROM f GROUP BY corpus" for p in (0.1, 0.5, 0.9))})
  SELECT feature, max(v) FILTER (WHERE corpus = 'synthetic') AS synthetic, max(v) FILTER (WHERE corpus = 'real') AS real,
  CASE WHEN feature LIKE 'length%' THEN NULL WHEN abs(max(v) FILTER (WHERE corpus = 'synthetic') - max(v) FILTER (WHERE corpus = 'real')) < 10 THEN 'Comparable' ELSE 'Different' END AS verdict FROM long GROUP BY feature""")
def realism_compare(spark, sf_dir):
    return realism.compare(table(spark, sf_dir, "conversations").filter("role = 'user'").select("text"), table(spark, sf_dir, "benchmark").select("text"))


@query("length_percentiles", " UNION ALL ".join(f"SELECT lang, {p}::DOUBLE AS share, list_sort(list(n_chars))[(floor(count(*) * {p}::DOUBLE) + 1)::INT] AS value FROM documents GROUP BY lang" for p in (0.1, 0.5, 0.9)))
def length_percentiles(spark, sf_dir):
    return stats.index_percentiles(table(spark, sf_dir, "documents"), "n_chars", by=["lang"])


@query("value_counts", "SELECT source AS value, count(*) AS cnt, (row_number() OVER (ORDER BY count(*) DESC, source))::INT AS rank FROM documents GROUP BY source")
def value_counts(spark, sf_dir):
    return stats.value_counts(table(spark, sf_dir, "documents"), "source")


@query("distinct_counts", "SELECT 'lang' AS \"column\", count(DISTINCT lang) AS n_distinct FROM documents UNION ALL SELECT 'source', count(DISTINCT source) FROM documents UNION ALL SELECT 'doc_id', count(DISTINCT doc_id) FROM documents")
def distinct_counts(spark, sf_dir):
    return stats.distinct_counts(table(spark, sf_dir, "documents"), ["lang", "source", "doc_id"])


@query("slice_counts", f"{SQL} SELECT 'topic' AS dimension, topic AS slice, count(*) AS cnt FROM v_cases GROUP BY 2 UNION ALL SELECT 'risk_level', risk_level, count(*) FROM v_cases GROUP BY 2 UNION ALL SELECT 'expected_action', expected_action, count(*) FROM v_cases GROUP BY 2")
def slice_counts(spark, sf_dir):
    return stats.slice_counts(views.cases(spark, sf_dir), ["topic", "risk_level", "expected_action"])


@query("context_build", _TOP + """SELECT query_id, string_agg('[Article ' || rank || '] ' || d.source || chr(10) || left(d.text, 1000), chr(10) || chr(10) || '---' || chr(10) || chr(10) ORDER BY rank) AS context
  FROM hits JOIN documents d ON d.doc_id = hits.idx GROUP BY query_id""")
def context_build(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("idx"), F.col("source").alias("title"), fn.truncated(F.col("text"), 1000).alias("content"))
    return retrieval.build_context(_hits(spark, sf_dir)[1], docs)


@query("registry_hash", " UNION ALL ".join(f"SELECT '{p[0]}' AS prompt_id, sha256('{p[3]}') AS sha256" for p in registry.PROMPTS))
def registry_hash(spark, sf_dir):
    return registry.prompts(spark).select("prompt_id", "sha256")


@query("dataset_hash", "SELECT sha256(string_agg(doc_id::VARCHAR, chr(10) ORDER BY doc_id::VARCHAR)) AS ids_sha256 FROM documents")
def dataset_hash(spark, sf_dir):
    return contract.ids_hash(table(spark, sf_dir, "documents"), "doc_id")


@query("case_union", "SELECT doc_id AS id, text, lang FROM documents UNION ALL SELECT item_id, text, NULL FROM benchmark")
def case_union(spark, sf_dir):
    return incremental.union_all(table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "text", "lang"), table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("id"), "text"))


@query("article_texts", "SELECT doc_id, md5(coalesce(source, '') || chr(10) || chr(10) || coalesce(text, '')) AS text_md5, left(text, 100) || '...' AS preview FROM documents")
def article_texts(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(fn.article_text(F.col("source"), F.col("text"))).alias("text_md5"), fn.preview(F.col("text")).alias("preview"))


@query("escalate_subset", f"{SQL} SELECT case_id, topic FROM v_cases WHERE expected_action = 'escalate'")
def escalate_subset(spark, sf_dir):
    return views.cases(spark, sf_dir).filter("expected_action = 'escalate'").select("case_id", "topic")


@query("paired_runs", f"""{SQL} SELECT topic, count(*) FILTER (WHERE NOT correct AND grounded) AS fixed, count(*) FILTER (WHERE correct AND NOT grounded) AS regressed, count(*) FILTER (WHERE correct AND grounded) AS both, count(*) FILTER (WHERE NOT correct AND NOT grounded) AS neither
  FROM v_results WHERE correct IS NOT NULL AND grounded IS NOT NULL GROUP BY topic""")
def paired_runs(spark, sf_dir):
    """Two judged columns of one table stand for two runs."""
    from evalgrove.operators.compare import paired

    r = views.results(spark, sf_dir)
    return paired(r.select("case_id", "topic", F.col("correct").alias("passed")), r.select("case_id", F.col("grounded").alias("passed")), by=["topic"])


@query("display_columns", f"{SQL} SELECT case_id, topic AS script, difficulty AS modifier, expected_action AS persona FROM v_cases")
def display_columns(spark, sf_dir):
    """Report names of columns."""
    from evalgrove.plans.report import display

    return display(views.cases(spark, sf_dir).select("case_id", "topic", "difficulty", F.col("expected_action").alias("source"))).select("case_id", "persona", "script", "modifier")


@query("spot_check", f"""{SQL}, r AS (SELECT case_id FROM v_cases ORDER BY md5(case_id::VARCHAR), case_id LIMIT 3), u AS (SELECT case_id, 0 AS p FROM v_cases WHERE risk_level = 'critical' UNION ALL SELECT case_id, 1 FROM r)
  SELECT case_id FROM (SELECT case_id, min(p) AS p FROM u GROUP BY case_id ORDER BY p, case_id LIMIT 10)""")
def spot_check(spark, sf_dir):
    return sampling.spot_check(views.cases(spark, sf_dir), 10).select("case_id")


@query("blind_sheet", """WITH r AS (SELECT item_id AS key, text, 'real' AS label FROM benchmark ORDER BY md5('real' || item_id), item_id LIMIT 10),
  s AS (SELECT conv_id * 1000 + turn AS key, text, 'synthetic' AS label FROM conversations WHERE role = 'user' ORDER BY md5('synthetic' || (conv_id * 1000 + turn)), conv_id * 1000 + turn LIMIT 10)
  SELECT (row_number() OVER (ORDER BY md5('blind' || label || key)))::INT AS place, key, label FROM (SELECT * FROM r UNION ALL SELECT * FROM s)""")
def blind_sheet(spark, sf_dir):
    real = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("key"), "text")
    own = table(spark, sf_dir, "conversations").filter("role = 'user'").select((F.col("conv_id") * 1000 + F.col("turn")).alias("key"), "text")
    return sampling.blind_sheet(real, own, 10).select("place", "key", "label")


@query("variant_rows", f"""{SQL}, seeds AS (SELECT seed_id, min(query) AS query, min(risk_level) AS risk_level, min(split) AS split FROM v_cases GROUP BY seed_id),
  f AS (SELECT *, unnest(list_filter(['short_mobile', CASE WHEN risk_level = 'low' AND {_FAMILY} < 0.5 THEN 'typo_noisy' END, CASE WHEN risk_level = 'critical' THEN 'emotional' END, CASE WHEN risk_level = 'critical' OR {_FAMILY} < 0.3 THEN 'non_native' END], lambda x: x IS NOT NULL)) AS family_id FROM seeds)
  SELECT seed_id || '_variant_' || family_id || '_1' AS case_id, seed_id, 'synthetic_variant_' || family_id AS source, split, 'unreviewed' AS label_status FROM f
  WHERE NOT (family_id = 'short_mobile' AND risk_level = 'critical')""")
def variant_rows(spark, sf_dir):
    """Variants still to be made when the first family of critical seeds exists."""
    seeds = views.cases(spark, sf_dir).groupBy("seed_id").agg(F.min("query").alias("query"), F.min("risk_level").alias("risk_level"), F.min("split").alias("split")).withColumn("difficulty", F.lit("direct"))
    made = seeds.filter("risk_level = 'critical'").select("seed_id", F.lit("short_mobile").alias("family_id"))
    return sampling.variants(seeds, made).select("case_id", "seed_id", "source", "split", "label_status")


@query("variant_ids", "SELECT doc_id, 'd' || doc_id AS seed_id, lang AS family_id, (doc_id % 7)::INT AS n FROM documents")
def variant_ids(spark, sf_dir):
    """Ids built and taken apart again."""
    built = table(spark, sf_dir, "documents").select("doc_id", fn.variant_id(F.concat(F.lit("d"), F.col("doc_id").cast("string")), F.col("lang"), F.col("doc_id") % 7).alias("id"))
    return built.select("doc_id", fn.parse_variant_id(F.col("id")).alias("x")).select("doc_id", "x.*")


@query("rendered_prompts", """SELECT doc_id, md5('Rewrite the query. ' || lang || chr(10) || 'Query: ' || text) AS prompt_md5 FROM documents""")
def rendered_prompts(spark, sf_dir):
    """T14."""
    template = registry.PROMPTS[1][3]
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(fn.render(template, instruction=F.col("lang"), query=F.col("text"))).alias("prompt_md5"))


@query("unquoted", r"""SELECT doc_id, 'x' AS plain FROM documents""")
def unquoted(spark, sf_dir):
    """T12 on a constant in three kinds of wrapping."""
    k = F.col("doc_id") % 3
    return table(spark, sf_dir, "documents").select("doc_id", fn.unquote(F.when(k == 0, ' "x" ').when(k == 1, "'x'").otherwise("\"'x'\"")).alias("plain"))


@query("validated_labels", "SELECT count(*) FILTER (WHERE quality = 1) AS human_validated, count(*) AS total FROM documents LEFT JOIN labels USING (doc_id)")
def validated_labels(spark, sf_dir):
    return stats.validated_labels(views.cases(spark, sf_dir).withColumn("label_status", F.when(F.col("quality") == 1, "human_validated")))


@query("metric_bounds", f"WITH m AS ({_metrics_sql()}), b(metric, low, high) AS (VALUES ('routing_accuracy', 0.8, NULL), ('critical_escalate_recall', 0.9, NULL), ('answer_precision', NULL, 0.9)) SELECT b.metric, value, value IS NOT NULL AND (low IS NULL OR value >= low) AND (high IS NULL OR value <= high) AS ok FROM b LEFT JOIN m USING (metric)")
def metric_bounds(spark, sf_dir):
    from evalgrove.operators.compare import guardrails

    bounds = spark.createDataFrame([("routing_accuracy", 0.8, None), ("critical_escalate_recall", 0.9, None), ("answer_precision", None, 0.9)], "metric string, low double, high double")
    return guardrails(metrics_all(spark, sf_dir), bounds)


@query("registry_ids", "SELECT 'correctness' AS judge_id UNION ALL SELECT 'groundedness'")
def registry_ids(spark, sf_dir):
    """Judges of the registry that a primary pass uses."""
    from evalgrove.plans.backends import PRIMARY

    return incremental.set_intersection(registry.judges(spark).select("judge_id"), spark.createDataFrame([(j,) for j in PRIMARY], "judge_id string"))
