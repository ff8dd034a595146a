"""Columns of a run's results, batches, errors of judges, and the registry's judges."""

import pytest
from pyspark.sql import functions as F

from evalgrove import schemas
from evalgrove.operators import metrics
from evalgrove.operators.registry import JUDGES
from evalgrove.plans import backends, pipeline
from tests.test_operators import case
from tests.test_runs import kb


def cases(spark, n=7):
    rows = [case(k, query=f"lost card number {k}", split=("optimization", "development")[k % 2], seed_id=f"s{k}", source="human_seed", difficulty="direct", topic="cards", expected_article="Lost card", required_facts=["card"]) for k in range(n)]
    return spark.createDataFrame([tuple(r.get(f.name) for f in spark.createDataFrame([], schemas.CASE).schema) for r in rows], schemas.CASE)


def test_results_have_all_columns_and_split_metrics(spark, tmp_path):
    found = pipeline.run(spark, cases(spark), kb(spark), backends.RuleBackend(), str(tmp_path / "c"), batch=3)
    assert set(pipeline.CASE_COLUMNS) | {"timestamp", "retrieved_articles", "legal", "redirects_when_unknown", "primary_judges_error", "secondary_judges_error"} <= set(found.columns)
    r = found.first()
    assert (r.seed_id, r.source, r.split is not None, r.correctness.correct, r.primary_judges_error) == (r.case_id.replace("c", "s"), "human_seed", True, True, None)
    assert r.retrieved_articles[0].article_id == "a0" and r.retrieved_articles[0].score >= r.retrieved_articles[1].score
    by_split = {(m.split, m.metric): m.denominator for m in metrics.compute(found, by=["split"]).collect()}
    assert by_split["optimization", "retrieval_hit_at_4"] == 4 and by_split["development", "retrieval_hit_at_4"] == 3


def test_a_run_that_is_stopped_goes_on_from_its_last_batch(spark, tmp_path, monkeypatch):
    to, append, n = str(tmp_path / "c"), pipeline.files.append_checkpoint, []

    def stops(df, path):
        if len(n) == 2:
            raise KeyboardInterrupt
        n.append(df.count())
        append(df, path)

    monkeypatch.setattr(pipeline.files, "append_checkpoint", stops)
    with pytest.raises(KeyboardInterrupt):
        pipeline.run(spark, cases(spark), kb(spark), backends.RuleBackend(), to, batch=2)
    monkeypatch.setattr(pipeline.files, "append_checkpoint", append)
    assert 0 < spark.read.parquet(to).count() == sum(n) < 7
    assert pipeline.run(spark, cases(spark), kb(spark), backends.RuleBackend(), to, batch=2).count() == 7
    assert spark.read.parquet(to).count() == 7


def test_errors_of_judges_stay_in_the_results(spark, tmp_path):
    class Broken(backends.RuleBackend):
        def judge(self, judge, row):
            raise RuntimeError(f"no {judge}")

    r = pipeline.run(spark, cases(spark, 1), kb(spark), Broken(), str(tmp_path / "c")).first()
    assert r.primary_judges_error == "no correctness; no groundedness" and r.correctness is None and r.correctness_error == "no correctness"


def test_registry_judges_apply_where_they_should(spark):
    rows = spark.createDataFrame([("1", "answer", "text", "ACTION: answer\nfreeze the card now"), ("2", "escalate", "text", "ACTION: escalate\nok"), ("3", "answer", "", "ACTION: answer\nyes"), ("4", None, None, None)], "case_id string, action string, context string, bot_response string").withColumn("required_facts", F.array())
    got = {r.case_id: r for r in backends.judge_registry(rows, backends.RuleBackend()).collect()}
    names = [j[0] for j in JUDGES]
    assert [got["1"][n].applicable for n in names] == [True] * 5 and got["1"].actionability.passed and got["1"].conciseness.passed
    assert [got["2"][n].applicable for n in names] == [False] * 4 + [True]
    assert [got["3"][n].applicable for n in names] == [True, False, True, True, True] and not got["3"].actionability.passed
    assert not any(got["4"][n].applicable for n in names)
