"""Shared pieces of the training-data operators: words, row identity, durable intermediate tables."""

from __future__ import annotations

import atexit
import gc
import re
import shutil
import tempfile
import time
import uuid
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word is a maximal run of code points other than space and U+0009..U+000D.
WORD = r"[^\x20\x09-\x0D]+"

#: Rows of text that a Python function takes up at once (bytes of text, at least one row).
SLICE_BYTES = 1 << 22


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def word_array(text: Column) -> Column:
    """All words of a text; an empty array for null."""
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(WORD), F.lit(0))


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share, as ``spark.checkpoint.dir`` of the session names it.

    Where none is set, a session of one process (``local[...]``) gets a folder of its own; a cluster must name one.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = tempfile.mkdtemp(prefix="evalgrove-")
        atexit.register(shutil.rmtree, folder, ignore_errors=True)
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


def durable(df: DataFrame) -> DataFrame:
    """Cut the lineage with a reliable checkpoint in the shared folder."""
    context = df.sparkSession.sparkContext
    if context._jsc.sc().getCheckpointDir().isEmpty():
        context.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint(eager=True)


def _remove(spark: SparkSession, path: str, at_exit: bool = False) -> None:
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    files = place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    files.deleteOnExit(place) if at_exit else files.delete(place, True)


def written(df: DataFrame) -> DataFrame:
    """Write a table into the shared folder and read it back, for tables that are read several times by column.

    The table goes with the application, or earlier by ``settled``.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/evalgrove-{spark.sparkContext.applicationId}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _remove(spark, path, at_exit=True)
    out = spark.read.schema(df.schema).parquet(path)
    out.written_path = path
    return out


def settled(df: DataFrame, *spent: DataFrame) -> DataFrame:
    """``written``, after which what is behind the table is given back: the shuffles, and the written tables ``spent``.

    Spark removes a shuffle's files once the driver's heap has lost its last reference, which without a collection may
    be long after. One collection leaves what the write has just let go of; a second one, a moment later, finds it.
    A lost executor costs nothing that is given back, as later stages read the new table.
    """
    out = written(df)
    for table_ in spent:
        _remove(df.sparkSession, table_.written_path)
    gc.collect()
    df.sparkSession.sparkContext._jvm.System.gc()
    time.sleep(0.3)
    df.sparkSession.sparkContext._jvm.System.gc()
    return out


def text_slices(batches: Iterator[pa.RecordBatch], column: str, most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut incoming batches so that each holds at most ``most`` bytes of text, or one row."""
    import numpy as np

    for batch in batches:
        if not batch.num_rows:
            continue
        column_at = batch.schema.get_field_index(column)
        ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column_at)), 0).to_numpy(zero_copy_only=False).astype(np.int64) + 64)
        start = 0
        while start < batch.num_rows:
            base = ends[start - 1] if start else 0
            stop = max(start + 1, int(np.searchsorted(ends, base + most, "right")))
            yield batch.slice(start, stop - start)
            start = stop
    pa.default_memory_pool().release_unused()  # workers are kept for later tasks
