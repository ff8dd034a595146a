import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from evalgrove import schemas
from evalgrove.functions import text as fn
from evalgrove.functions import vector as fv
from evalgrove.operators import compare, contract, incremental, metrics, registry, retrieval, sampling, stats

ROWS = "case_id string, expected_action string, risk_level string, predicted_action string, expected_article string, retrieved_articles array<string>, correctness struct<correct boolean, reason string>, groundedness struct<grounded boolean, reason string>, safety struct<safe boolean, reason string>"


def eight(spark):
    """Eight results: passes, failures, nulls, an empty retrieval."""
    def row(i, e, risk, p, article, titles, c, g, s):
        one = lambda v: None if v is None else (v, "r")
        return (str(i), e, risk, p, article, titles, one(c), one(g), one(s))

    t = ["A", "B"]
    return spark.createDataFrame(
        [
            row(1, "answer", "low", "answer", "A", t, True, True, True),
            row(2, "escalate", "critical", "escalate", None, None, None, None, None),
            row(3, "escalate", "critical", "answer", None, None, None, None, None),
            row(4, "answer", "low", "escalate", "A", t, None, None, None),
            row(5, "answer", "low", "answer", "A", t, False, True, True),
            row(6, "answer", "low", "answer", "Z", t, True, False, True),
            row(7, "answer", "low", "answer", "Z", [], True, None, True),
            row(8, "answer", "low", "answer", '{"no": 1}', ['{"title": "x"}'], None, True, True),
        ],
        ROWS,
    ).withColumn("expected_article", F.when(F.col("case_id") == "8", "x").otherwise(F.col("expected_article")))


def test_golden_metrics(spark):
    got = {r["metric"]: (r["numerator"], r["denominator"]) for r in metrics.compute(eight(spark)).collect()}
    assert got == {"routing_accuracy": (6, 8), "critical_escalate_recall": (1, 2), "answer_precision": (1, 6), "correctness_pass_rate": (3, 4), "groundedness_pass_rate": (3, 4), "retrieval_hit_at_4": (4, 6), "safe_resolution_rate": (1, 6), "total_cases": (8, 8)}
    cells = {(r[0], r[1]): r[2] for r in metrics.confusion_matrix(eight(spark)).collect()}
    assert cells == {("answer", "answer"): 5, ("answer", "escalate"): 1, ("escalate", "answer"): 1, ("escalate", "escalate"): 1}


def test_zero_denominator_is_null(spark):
    got = {r["metric"]: (r["value"], r["denominator"]) for r in metrics.compute(eight(spark).limit(0)).collect()}
    assert all(v == (None, 0) for k, v in got.items() if k != "total_cases")


def test_guardrail_counters(spark):
    rows = spark.createDataFrame([("critical", None, "you can do it"), ("critical", "direct", "sure"), ("low", None, "fine"), ("low", "unknown", None)], "risk_level string, difficulty string, bot_response string")
    r = metrics.guardrail(rows).first()
    assert (r.missed_critical, r.critical_total, r.sensitive_violations, r.unknown_answered, r.unknown_total, r.format_violations, r.unknown_escalation_rate) == (2, 2, 0, 0, 0, 3, 0.0)


ACTIONS = [("ACTION: answer\nx", "answer"), ("action: ESCALATE  \nx", "escalate"), ("ACTION: maybe", "format_violation"), ("hello", "format_violation"), ("\nACTION: answer", "format_violation"), ("ACTION: answer\r\nx", "answer"), (" ACTION: answer", "answer"), ("ACTION:\tanswer", "answer"), ("ACTION: answer now", "format_violation"), ("", "format_violation"), (None, "format_violation")]


def test_actions(spark):
    df = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(ACTIONS)], "i int, t string").select("i", fn.parse_action(F.col("t")).alias("a"))
    assert [r.a for r in df.orderBy("i").collect()] == [a for _, a in ACTIONS]


def test_text_functions(spark):
    one = lambda c, t: spark.createDataFrame([(t,)], "t string").select(c(F.col("t")).alias("x")).first().x
    assert one(fn.strip_action_line, "first\n  second ") == "second"
    assert one(fn.strip_action_line, "only") == "only"
    assert [one(fn.sensitive, t) for t in ("my pin", "pinned", "card 12345", "year 2024", "Never share your PIN", None, "one-time code", "٤٤٤")] == [True, False, False, True, False, False, True, True]
    assert [one(fn.word_count, t) for t in ("", "a b c", None)] == [0, 3, 0]
    assert one(fn.typo_share, "hello zzxq") in (0.5, 1.0) and one(fn.typo_share, "") == 0.0
    assert one(fn.has_greeting, " History") is True
    assert one(fn.unquote, ' "\'hi\'" ') == "hi"
    assert one(lambda t: fn.render("{{x}} is {a}{b}", a=t, b=F.lit("{a}")), "v") == "{x} is v{a}"
    assert one(lambda t: fn.parse_variant_id(t)["n"], "s_1_variant_typo_noisy_12") == 12
    assert one(lambda t: fn.parse_variant_id(t)["seed_id"], "plain") is None


def test_vectors(spark):
    df = spark.createDataFrame([(1, [3.0, 4.0]), (2, [0.0, 0.0]), (3, [float("nan"), 1.0])], "id int, v array<float>")
    r = {x.id: x for x in df.select("id", fv.normalised(F.col("v")).alias("n"), fv.is_finite(F.col("v")).alias("f")).collect()}
    assert r[1].n == pytest.approx([0.6, 0.8]) and r[2].n == [0.0, 0.0] and not r[3].f


def test_top_k_breaks_ties_by_id(spark):
    v = spark.createDataFrame([(i, [1.0, 0.0]) for i in range(6)] + [(9, [0.0, 1.0])], "vec_id bigint, embedding array<float>")
    got = retrieval.top_k(v.filter("vec_id = 3"), v, 3).orderBy("rank").collect()
    assert [(r.idx, r["rank"]) for r in got] == [(0, 1), (1, 2), (2, 3)]
    assert retrieval.top_k(v.limit(0), v, 3).count() == 0


def test_near_pairs_equal_brute_force(spark):
    rng = np.random.default_rng(1)
    m = rng.normal(size=(60, 8))
    m[50:] = m[:10] + rng.normal(size=(10, 8)) * 0.01
    df = spark.createDataFrame([(i, [float(x) for x in r]) for i, r in enumerate(m)], "vec_id bigint, embedding array<float>")
    u = m.astype(np.float32).astype(float)
    u /= np.linalg.norm(u, axis=1, keepdims=True)
    want = {(i, j) for i in range(60) for j in range(i + 1, 60) if u[i] @ u[j] > 0.9}
    for blocks in (1, 3):
        assert {(r.a, r.b) for r in retrieval.near_pairs(df, 0.9, blocks=blocks).collect()} == want


def case(i, **other):
    base = {"case_id": f"c{i}", "seed_id": f"s{i}", "query": f"q {i}", "topic": "t", "expected_action": "answer", "risk_level": "low", "expected_article": None, "required_facts": [], "difficulty": "direct", "source": "human_seed", "split": "development", "dataset_version": "v", "label_status": "human_validated"}
    return base | other


def test_contract(spark, tmp_path):
    rows = [case(1), case(2, risk_level="critical"), case(2), case(4, difficulty=None), case(5, seed_id="s1", split="optimization"), case(6, query=" Q 1 ")]
    bare = case(7)
    del bare["topic"]
    path = tmp_path / "cases.jsonl"
    path.write_text("\n".join(json.dumps(r) for r in [*rows, bare]) + "\n\n{broken\n")
    from evalgrove.sources import files

    good, bad = files.good_and_bad(spark, str(path), schemas.CASE)
    assert (good.count(), bad.count()) == (7, 1)
    assert len(files.jsonl(spark, str(path), schemas.CASE, "drop").collect()) == 7
    with pytest.raises(Exception):
        files.jsonl(spark, str(path), schemas.CASE).collect()
    issues = contract.validate(good, files.json_lines(spark, str(path)))
    assert {r.category: r["count"] for r in issues.groupBy("category").count().collect()} == {"enums": 1, "duplicate_ids": 1, "split_leakage": 1, "critical_routing": 1, "duplicates": 1, "missing_fields": 1}
    s = contract.summary(good, issues).first()
    assert (s.total_rows, s.total_issues, s.valid_rows, s.status) == (7, 6, 1, "FAIL")
    assert contract.missing_lineage(good).count() == 7


def test_splits_do_not_leak_and_samples_have_their_size(spark):
    df = spark.range(2000).select(F.col("id"), (F.col("id") % 300).cast("string").alias("seed_id"), F.when(F.col("id") % 7 > 0, (F.col("id") % 7).cast("string")).alias("topic"))
    assert sampling.assign_splits(df).groupBy("seed_id").agg(F.count_distinct("split").alias("n")).filter("n > 1").count() == 0
    sizes = {r.topic: r["count"] for r in df.groupBy("topic").count().collect()}
    got = {r.topic: r["count"] for r in sampling.stratified_sample(df, "id", "topic").groupBy("topic").count().collect()}
    assert got == {k: max(1, round(n * 0.2)) for k, n in sizes.items()}


@pytest.mark.parametrize("n", [5, 10, 119, 355])
def test_index_percentiles(spark, n):
    values = sorted((i * 37) % 101 for i in range(n))
    got = {r.share: r.value for r in stats.index_percentiles(spark.createDataFrame([(v,) for v in values], "v int"), "v").collect()}
    assert got == {p: values[int(n * p)] for p in (0.1, 0.5, 0.9)}


def test_variants_resume(spark):
    seeds = spark.createDataFrame([("a", "q", "critical", "direct", "answer", "development"), ("b", "r", "low", "noisy", "answer", "development")], "seed_id string, query string, risk_level string, difficulty string, expected_action string, split string")
    first = sampling.variants(seeds)
    assert {r.family_id for r in first.filter("seed_id = 'a'").collect()} == {"short_mobile", "emotional", "non_native"}
    assert sampling.variants(seeds, first.select("seed_id", "family_id")).count() == 0


def test_merges(spark):
    a = spark.createDataFrame([("1", "x"), ("2", "y")], "id string, v string")
    b = spark.createDataFrame([("2", "z"), ("3", "w")], "id string, v string")
    assert {(r.id, r.v) for r in incremental.first_wins([a, b], "id", "v").collect()} == {("1", "x"), ("2", "y"), ("3", "w")}
    assert {(r.id, r.v) for r in incremental.first_wins([a, b], "id", "v", F.col("v") != "y").collect()} == {("1", "x"), ("2", "z"), ("3", "w")}
    assert incremental.set_difference(a.select("id"), b.select("id")).collect()[0].id == "1"


def test_registry(spark):
    assert registry.judges(spark).filter(F.length("sha256") == 64).count() == 5
    assert registry.get_prompt(spark, "answer")["version"] == "1"
    with pytest.raises(ValueError):
        registry.get_prompt(spark, "none")
    assert contract.secret_words(registry.prompts(spark)).count() == 0
    assert sampling.product(*[registry.listed(spark, x) for x in (registry.PERSONAS, registry.SCENARIOS, registry.MODIFIERS)]).count() == 150


def test_runs_compared(spark):
    a = spark.createDataFrame([("1", True), ("2", False), ("3", None)], "case_id string, passed boolean")
    b = spark.createDataFrame([("1", False), ("2", True), ("3", True)], "case_id string, passed boolean")
    r = compare.paired(a, b).first()
    assert (r.fixed, r.regressed, r.both, r.neither) == (1, 1, 0, 0)
    m = spark.createDataFrame([("x", 0.5), ("y", None)], "metric string, value double")
    bounds = spark.createDataFrame([("x", 0.4, None), ("y", 0.1, None)], "metric string, low double, high double")
    assert {r.metric: r.ok for r in compare.guardrails(m, bounds).collect()} == {"x": True, "y": False}
