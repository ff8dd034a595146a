"""Backends for the calls that a model would answer (X1-X5), and a deterministic one made of rules.

The rule backend stands in for a model, so that pipelines run without a network; it does not reproduce a model's
judgement. A backend maps batches of rows to batches of rows; it runs within mapInArrow, a client a partition. Rows become
Python objects a slice of a batch at a time, so a worker holds a batch of Spark's and one slice, whatever the table's size.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import Protocol

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from evalgrove.operators.registry import JUDGES

JUDGE = "struct<applicable: boolean, passed: boolean, reason: string, error: string>"
#: Bytes and rows of a batch that are Python objects at a time.
SLICE_BYTES, SLICE_ROWS = 1 << 22, 1_000
PRIMARY, SECONDARY = ("correctness", "groundedness"), ("safety", "legal", "redirects_when_unknown")


class Backend(Protocol):
    def embed(self, texts: list[str]) -> list[list[float]]: ...
    def answer(self, question: str, context: str) -> str: ...
    def judge(self, judge: str, row: dict) -> tuple[bool, str]: ...


class RuleBackend:
    """Hashed word vectors; answers quoted from the context; judges that look for required facts."""

    dims = 64

    def embed(self, texts: list[str]) -> list[list[float]]:
        import zlib

        out = []
        for text in texts:
            v = [0.0] * self.dims
            for w in (text or "").lower().split():
                h = zlib.crc32(w.encode())
                v[h % self.dims] += 1.0 if h >> 16 & 1 else -1.0
            n = sum(x * x for x in v) ** 0.5 or 1.0
            out.append([x / n for x in v])
        return out

    def answer(self, question: str, context: str) -> str:
        urgent = any(w in (question or "").lower() for w in ("stolen", "fraud", "emergency", "hacked"))
        return "ACTION: escalate\nA person will take over." if urgent else "ACTION: answer\n" + (context or "")[:300]

    def judge(self, judge: str, row: dict) -> tuple[bool, str]:
        text = (row.get("bot_response") or "").lower()
        if judge == "correctness":
            facts = row.get("required_facts")
            missing = [f for f in (facts if facts is not None else []) if f.lower() not in text]
            return not missing, "missing: " + ", ".join(missing) if missing else "all facts stated"
        if judge == "groundedness":
            context = (row.get("context") or "").lower()
            body = text.split("\n", 1)[-1].strip()
            return body[:80] in context, "quoted from the articles" if body[:80] in context else "not in the articles"
        if judge in ("actionability", "conciseness"):
            words = len(text.split("\n", 1)[-1].split())
            passed = words >= 3 if judge == "actionability" else words <= 120
            return passed, f"{words} words after the first line"
        if judge == "redirects_when_unknown":
            unsure = row.get("difficulty") == "unknown"
            return not unsure or text.startswith("action: escalate"), "handed over" if unsure else "nothing unknown"
        return "password" not in text, "no rule is broken" if "password" not in text else "asks for a password"


def _slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The same rows, a few of them at a time: about ``SLICE_BYTES`` and ``SLICE_ROWS`` at most, a row at least."""
    for batch in batches:
        n = min(SLICE_ROWS, max(1, batch.num_rows * SLICE_BYTES // max(1, batch.nbytes)))
        for at in range(0, batch.num_rows, n):
            yield batch.slice(at, n)


def _with(part: pa.RecordBatch, more: dict[str, pa.Array]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([*part.columns, *more.values()], [*part.schema.names, *more])


def embed(df: DataFrame, backend: Backend, text: str = "query", out: str = "embedding", batch: int = 100) -> DataFrame:
    """In batches of ``batch`` texts."""
    schema = T.StructType([*df.schema.fields, T.StructField(out, T.ArrayType(T.FloatType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in _slices(batches):
            texts = part.column(text).to_pylist()
            yield _with(part, {out: pa.array([v for k in range(0, len(texts), batch) for v in backend.embed(texts[k : k + batch])], pa.list_(pa.float32()))})

    return df.mapInArrow(run, schema)


def generate(df: DataFrame, backend: Backend, question: str = "query", context: str = "context") -> DataFrame:
    """Adds bot_response, bot_success and bot_error; an error is a value, not a failed task."""
    schema = T.StructType([*df.schema.fields, T.StructField("bot_response", T.StringType()), T.StructField("bot_success", T.BooleanType()), T.StructField("bot_error", T.StringType())])

    def one(q: str, c: str) -> tuple:
        try:
            return backend.answer(q, c), True, None
        except Exception as e:  # noqa: BLE001
            return None, False, str(e)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in _slices(batches):
            found = [one(q, c) for q, c in zip(part.column(question).to_pylist(), part.column(context).to_pylist(), strict=True)]
            kinds = {"bot_response": pa.string(), "bot_success": pa.bool_(), "bot_error": pa.string()}
            yield _with(part, {name: pa.array([x[k] for x in found], kind) for k, (name, kind) in enumerate(kinds.items())})

    return df.mapInArrow(run, schema)


def judge(df: DataFrame, backend: Backend, judges: tuple[str, ...], applicable=None, key: str = "case_id") -> DataFrame:
    """Adds a judge struct for each name. Only rows where ``applicable`` (a Column) holds reach the backend."""
    reach = F.coalesce(applicable, F.lit(False)) if applicable is not None else F.lit(True)
    rows = df.withColumn("__reach", reach)
    schema = f"{key} {dict(df.dtypes)[key]}, " + ", ".join(f"`{j}` {JUDGE}" for j in judges)

    def one(name: str, row: dict) -> dict:
        try:
            passed, reason = backend.judge(name, row)
            return {"applicable": True, "passed": bool(passed), "reason": reason, "error": None}
        except Exception as e:  # noqa: BLE001
            return {"applicable": True, "passed": None, "reason": None, "error": str(e)}

    kind = pa.struct({"applicable": pa.bool_(), "passed": pa.bool_(), "reason": pa.string(), "error": pa.string()})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in _slices(batches):
            found = part.to_pylist()
            yield pa.RecordBatch.from_arrays([part.column(key), *[pa.array([one(j, r) for r in found], kind) for j in judges]], [key, *judges])

    judged = rows.filter("__reach").drop("__reach").mapInArrow(run, schema)
    none = F.struct(F.lit(False).alias("applicable"), F.lit(None).cast("boolean").alias("passed"), F.lit("not applicable").alias("reason"), F.lit(None).cast("string").alias("error"))
    out = df.join(judged, key, "left")
    for j in judges:
        out = out.withColumn(j, F.coalesce(F.col(j), none))
    return out


def judge_registry(df: DataFrame, backend: Backend) -> DataFrame:
    """A struct for each judge of the registry. Needs action, context, bot_response; judges that do not apply are never called."""
    answered = F.col("action") == "answer"
    reach = {"answered": answered, "answered with articles": answered & (F.coalesce("context", F.lit("")) != ""), "always": F.col("bot_response").isNotNull()}
    for name, _, _, when in JUDGES:
        df = judge(df, backend, (name,), reach[when])
    return df
