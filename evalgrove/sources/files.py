"""Reading and writing (IO1-IO15). Every reader takes a schema or reads raw lines."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from evalgrove.functions.text import strip


def jsonl(spark: SparkSession, path: str | list[str], schema: str, on_bad: str = "fail") -> DataFrame:
    """IO1-IO3, IO5: blank lines are skipped; bad lines ``fail`` the read, are ``drop``ped, or are ``report``ed as _corrupt_record."""
    if on_bad == "report":
        return spark.read.schema(f"{schema}, _corrupt_record string").option("mode", "PERMISSIVE").json(path)
    return spark.read.schema(schema).option("mode", {"fail": "FAILFAST", "drop": "DROPMALFORMED"}[on_bad]).json(path)


def good_and_bad(spark: SparkSession, path: str, schema: str) -> tuple[DataFrame, DataFrame]:
    """IO2: the parsed rows, and the lines that are no JSON."""
    lines = json_lines(spark, path).withColumn("__json", F.json_object_keys("value").isNotNull())
    good = lines.filter("__json").select(F.from_json("value", schema).alias("x")).select("x.*")
    return good, lines.filter(~F.col("__json")).select("value")


def json_lines(spark: SparkSession, path: str) -> DataFrame:
    """Raw lines that are not blank, for checks of key presence."""
    return spark.read.text(path).filter(strip(F.col("value")) != "")


def text_lines(spark: SparkSession, path: str) -> DataFrame:
    """IO8: stripped lines, blank ones dropped."""
    return spark.read.text(path).select(strip(F.col("value")).alias("value")).filter("value <> ''")


def csv_column(spark: SparkSession, path: str, schema: str, column: str) -> DataFrame:
    """IO9: a column of a CSV file with a header; quoted values may hold line ends, and quotes are doubled in them."""
    return spark.read.schema(schema).csv(path, header=True, multiLine=True, escape='"').select(column)


def shared_folder(spark: SparkSession) -> str:
    """A new folder below ``spark.checkpoint.dir``, which driver and executors share; a session of one process may do without the setting."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = tempfile.mkdtemp(prefix="evalgrove-")
    path = f"{base.rstrip('/')}/evalgrove-files-{uuid.uuid4().hex}"
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(place)
    return path


def numbered(df: DataFrame, order: list[str], index: str = "article_idx") -> DataFrame:
    """IO4: a dense index in the order of the given columns, without one task for all rows: ranges are sorted and counted, and each range starts where the one before it ends.

    The ranges are written once, as two runs of a range partitioning need not agree.
    """
    path = shared_folder(df.sparkSession)
    df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("__m", F.monotonically_increasing_id()).write.parquet(path)
    rows = df.sparkSession.read.parquet(path).withColumn("__p", F.shiftright("__m", 33)).withColumn("__k", F.col("__m").bitwiseAND((1 << 33) - 1))
    sizes = rows.groupBy("__p").agg(F.count(F.lit(1)).alias("__n"))  # a row for each range
    base = F.coalesce(F.sum("__n").over(W.orderBy("__p").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    placed = rows.join(F.broadcast(sizes.select("__p", base.alias("__base"))), "__p")
    return placed.select(*df.columns, (F.col("__base") + F.col("__k")).cast("long").alias(index))


def npy(spark: SparkSession, path: str, index: str = "article_idx") -> DataFrame:
    """IO7: a matrix file of one machine as (index, embedding); keep it as Parquet from there on."""
    import numpy as np

    matrix = np.load(path, mmap_mode="r")
    return spark.createDataFrame(((i, [float(x) for x in row]) for i, row in enumerate(matrix)), f"{index} bigint, embedding array<float>")


def save_npy(df: DataFrame, path: str, index: str = "article_idx", vector: str = "embedding") -> None:
    """IO7: the reverse, for matrices that fit the driver."""
    import numpy as np

    np.save(path, np.array([r[0] for r in df.orderBy(index).select(vector).toLocalIterator()], np.float32))


def append_csv(df: DataFrame, path: str) -> None:
    """IO10."""
    df.write.mode("append").csv(path, header=True, escape='"')


def write_jsonl(df: DataFrame, path: str, order: str | None = "case_id", keep_nulls: bool = True, one_file: bool = False) -> None:
    """IO11: sorted by id over the part files, or in one file."""
    rows = df.orderBy(order) if order else df
    (rows.coalesce(1) if one_file else rows).write.mode("overwrite").option("ignoreNullFields", str(not keep_nulls).lower()).json(path)


def append_jsonl(df: DataFrame, path: str) -> None:
    """IO12."""
    df.write.mode("append").json(path)


def write_metadata(spark: SparkSession, values: dict, path: str, schema: str) -> None:
    """IO13: one row."""
    names = [c.strip().split()[0] for c in schema.replace("\n", " ").split(",")]
    spark.createDataFrame([tuple(values.get(n) for n in names)], schema).coalesce(1).write.mode("overwrite").json(path)


def append_checkpoint(df: DataFrame, path: str) -> None:
    """IO14: results of a batch; earlier batches stay as they are."""
    df.write.mode("append").parquet(path)


def read_checkpoint(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """IO14: all batches so far; an empty table before the first."""
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    if not where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(where):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(path)


def write_markdown(sheet: DataFrame, path: str, title: str = "Spot check") -> None:
    """IO15: a numbered sheet of at most a page, its key at the end."""
    rows = sheet.orderBy("place").limit(200).collect()
    lines = [f"# {title}", "", *[f"{r['place']}. {r['text']}" for r in rows], "", "## Key", "", *[f"{r['place']}: {r['label']}" for r in rows]]
    with open(path, "w", encoding="utf-8") as f:
        f.write("\n".join(lines) + "\n")
