"""Cases that arrive as files: each micro-batch is evaluated and appended once. Beyond what the surveyed system does."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery


def evaluate(spark: SparkSession, source: str, schema: str, work: Callable[[DataFrame], DataFrame], sink: str, state: str, key: str = "case_id") -> StreamingQuery:
    """Process all JSONL files of ``source`` that are new since the last call. ``state`` keeps what was read.

    A batch that is repeated after a failure replaces its own part of the sink, so its rows are there once.
    """

    def batch(df: DataFrame, number: int) -> None:
        work(df.dropDuplicates([key])).write.mode("overwrite").parquet(f"{sink}/batch={number}")

    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1_000).json(source)
    return stream.writeStream.foreachBatch(batch).option("checkpointLocation", state).trigger(availableNow=True).start()
