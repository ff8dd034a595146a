"""A worker holds a slice of a batch as Python objects, however many rows the batch has."""

import tracemalloc

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from evalgrove.plans import backends

ROWS, CHARS = 4_000, 4_000


def peak(spark, monkeypatch, call):
    """Most bytes of Python objects, and the rows, of the task that ``call`` gives to Spark over one batch."""
    tasks = []
    for name in ("mapInArrow", "mapInPandas"):
        monkeypatch.setattr(type(spark.range(1)), name, lambda self, f, schema, name=name: tasks.append((f, name)) or spark.createDataFrame([], schema))
    names = ("case_id", "query", "context", "bot_response")
    call(spark.createDataFrame([], ", ".join(f"{n} string" for n in names)))
    (task, name), = tasks
    batch = pa.RecordBatch.from_arrays([pa.array([str(k) for k in range(ROWS)]), *[pa.array([f"{k:09} " * (CHARS // 10) for k in range(ROWS)]) for _ in names[1:]]], names)
    rows = 0
    tracemalloc.start()
    for out in task(iter([batch] if name == "mapInArrow" else [batch.to_pandas()])):
        rows += len(out) if name == "mapInPandas" else out.num_rows
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    return most, rows


def test_generate_holds_a_slice(spark, monkeypatch):
    """F7."""
    most, rows = peak(spark, monkeypatch, lambda df: backends.generate(df, backends.RuleBackend()))
    assert rows == ROWS and most < 12e6


def test_judge_holds_a_slice(spark, monkeypatch):
    """F6."""
    most, rows = peak(spark, monkeypatch, lambda df: backends.judge(df, backends.RuleBackend(), ("correctness", "safety")))
    assert rows == ROWS and most < 12e6


@pytest.mark.parametrize("size", [(1, 1_000), (1 << 30, 3)])
def test_slices_give_every_row_once(spark, monkeypatch, size):
    monkeypatch.setattr(backends, "SLICE_BYTES", size[0])
    monkeypatch.setattr(backends, "SLICE_ROWS", size[1])
    df = spark.createDataFrame([(k, None if k % 5 == 0 else f"text {k} stolen" if k % 3 == 0 else f"text {k}", [k]) for k in range(40)], "case_id bigint, query string, more array<int>").coalesce(1)
    rows = backends.generate(backends.embed(df, backends.RuleBackend(), batch=2), backends.RuleBackend(), context="query")
    got = {r.case_id: r for r in backends.judge(rows, backends.RuleBackend(), ("correctness", "safety"), F.col("case_id") % 2 == 0).collect()}
    assert sorted(got) == list(range(40))
    for k, r in got.items():
        assert r.more == [k] and len(r.embedding) == 64 and r.bot_success
        assert r.bot_response == backends.RuleBackend().answer(r.query, r.query)
        assert r.correctness.applicable == r.safety.applicable == (k % 2 == 0)
