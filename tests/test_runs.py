import json

import numpy as np
from pyspark.sql import functions as F

from evalgrove import schemas
from evalgrove.operators import sampling
from evalgrove.plans import backends, pipeline
from evalgrove.sources import files
from evalgrove.streaming import files as streaming
from tests.test_operators import case


def kb(spark):
    return spark.createDataFrame([(0, "a0", "Lost card", "Freeze the card in the app and order a new one.", None), (1, "a1", "Transfer time", None, "A transfer takes two days."), (2, None, "Fees", None, None)], schemas.ARTICLE)


def test_run_resumes(spark, tmp_path):
    rows = [case(1, query="my card is lost freeze card", expected_article="Lost card", required_facts=["freeze"]), case(2, query="my card was stolen", expected_action="escalate", risk_level="critical"), case(3, query="transfer days")]
    cases = spark.createDataFrame([{k: r.get(k) for k in ("case_id", "query", "topic", "expected_action", "risk_level", "expected_article", "required_facts", "difficulty")} for r in rows], "case_id string, query string, topic string, expected_action string, risk_level string, expected_article string, required_facts array<string>, difficulty string")
    to = str(tmp_path / "checkpoint")
    first = pipeline.run(spark, cases.filter("case_id < 'c3'"), kb(spark), backends.RuleBackend(), to)
    got = {r.case_id: r for r in first.collect()}
    assert got["c1"].action == "answer" and got["c1"].titles[0] == "Lost card" and got["c1"].correct
    assert got["c2"].action == "escalate"
    every = pipeline.run(spark, cases, kb(spark), backends.RuleBackend(), to)
    assert every.count() == 3
    assert spark.read.parquet(to).count() == 3
    assert {r.metric for r in pipeline.report(every).collect()} >= {"routing_accuracy", "safe_resolution_rate"}


def test_errors_are_values(spark):
    class Broken(backends.RuleBackend):
        def answer(self, question, context):
            raise RuntimeError("no model")

        def judge(self, judge, row):
            raise RuntimeError("no judge")

    df = spark.createDataFrame([("1", "q", "c", True), ("2", "q", "c", None)], "case_id string, query string, context string, ok boolean")
    r = backends.generate(df, Broken()).first()
    assert (r.bot_response, r.bot_success, r.bot_error) == (None, False, "no model")
    j = {r.case_id: r.correctness for r in backends.judge(df, Broken(), ("correctness",), F.col("ok")).collect()}
    assert (j["1"].applicable, j["1"].passed, j["1"].error) == (True, None, "no judge")
    assert (j["2"].applicable, j["2"].passed) == (False, None)


def test_sources_and_sinks(spark, tmp_path):
    np.save(tmp_path / "m.npy", np.eye(3, dtype=np.float32))
    m = files.npy(spark, str(tmp_path / "m.npy"))
    files.save_npy(m, str(tmp_path / "n.npy"))
    assert np.array_equal(np.load(tmp_path / "n.npy"), np.eye(3))
    (tmp_path / "lines.txt").write_text(" one \n\n \ntwo\n")
    assert [r.value for r in files.text_lines(spark, str(tmp_path / "lines.txt")).collect()] == ["one", "two"]
    (tmp_path / "q.csv").write_text('text,category\n"a, b",x\n')
    assert files.csv_column(spark, str(tmp_path / "q.csv"), "text string, category string", "text").first().text == "a, b"
    df = spark.createDataFrame([("b", None), ("a", "é")], "case_id string, v string")
    files.write_jsonl(df, str(tmp_path / "out"), one_file=True)
    lines = [x for p in sorted((tmp_path / "out").glob("part-*")) for x in p.read_text().splitlines()]
    assert lines == ['{"case_id":"a","v":"é"}', '{"case_id":"b","v":null}']
    files.append_csv(df, str(tmp_path / "csv"))
    files.append_csv(df, str(tmp_path / "csv"))
    assert spark.read.schema("case_id string, v string").csv(str(tmp_path / "csv"), header=True).count() == 4
    files.append_jsonl(df, str(tmp_path / "app"))
    assert spark.read.schema("case_id string, v string").json(str(tmp_path / "app")).count() == 2
    files.write_metadata(spark, {"run_id": "r", "top_k": 4}, str(tmp_path / "meta"), "run_id string, top_k int, git_commit string")
    assert spark.read.json(str(tmp_path / "meta")).first().top_k == 4
    assert [(r.case_id, r.article_idx) for r in files.numbered(df, ["case_id"]).orderBy("article_idx").collect()] == [("a", 0), ("b", 1)]
    sheet = sampling.blind_sheet(df.select(F.col("case_id").alias("key"), F.lit("x").alias("text")), df.select(F.col("case_id").alias("key"), F.lit("y").alias("text")), 2)
    files.write_markdown(sheet, str(tmp_path / "sheet.md"))
    assert (tmp_path / "sheet.md").read_text().count(": real") == 2


def test_files_that_arrive_are_taken_once(spark, tmp_path):
    source = tmp_path / "in"
    source.mkdir()
    schema = "case_id string, query string"
    go = lambda: streaming.evaluate(spark, str(source), schema, lambda df: df.withColumn("n", F.length("query")), str(tmp_path / "sink"), str(tmp_path / "state")).awaitTermination()
    (source / "a.json").write_text(json.dumps({"case_id": "1", "query": "abc"}) + "\n")
    go()
    (source / "b.json").write_text(json.dumps({"case_id": "2", "query": "de"}) + "\n")
    go()
    go()
    assert {(r.case_id, r.n) for r in spark.read.parquet(str(tmp_path / "sink")).collect()} == {("1", 3), ("2", 2)}


def test_queries_are_written_for_combinations(spark):
    from evalgrove.operators import registry
    from evalgrove.plans.report import written_queries

    lists = [registry.listed(spark, x) for x in (registry.PERSONAS, registry.SCENARIOS, registry.MODIFIERS)]
    rows = written_queries(sampling.product(*lists, limit=7), backends.RuleBackend()).collect()
    assert len(rows) == 7 and all(r.bot_success and r.scenario_name in r.query for r in rows)
