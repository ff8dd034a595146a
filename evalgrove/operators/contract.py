"""Dataset contract (F4-F6, A17-A19, C1, C2, C4, C5, C7): each check gives rows (category, issue)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from evalgrove.functions import text as fn
from evalgrove.schemas import ENUMS, REQUIRED


def _issues(df: DataFrame, category: str, message) -> DataFrame:
    return df.select(F.lit(category).alias("category"), message.alias("issue"))


def missing_fields(lines: DataFrame, required: tuple[str, ...] = REQUIRED, line: str = "value") -> DataFrame:
    """F4 on raw JSON lines: a key that is absent; a null value is present. Broken lines are left to the reader."""
    keys = F.json_object_keys(F.col(line))
    absent = lines.filter(keys.isNotNull()).select(F.get_json_object(line, "$.case_id").alias("case_id"), F.explode(F.array_except(F.array(*[F.lit(r) for r in required]), keys)).alias("field"))
    return _issues(absent, "missing_fields", F.concat(F.coalesce("case_id", F.lit("?")), F.lit(": missing "), F.col("field")))


def missing_columns(df: DataFrame, required: tuple[str, ...] = REQUIRED) -> list[str]:
    """F4 on tables, where a key is a column."""
    return [c for c in required if c not in df.columns]


def enum_issues(cases: DataFrame, enums: dict[str, tuple[str, ...]] = ENUMS) -> DataFrame:
    """values outside their enumeration; null is outside."""
    checks = [F.when(~F.coalesce(F.col(c).isin(*values), F.lit(False)), F.struct(F.lit(c).alias("field"), F.col(c).cast("string").alias("v"))) for c, values in enums.items()]
    bad = cases.select("case_id", F.explode(F.array_compact(F.array(*checks))).alias("x"))
    return _issues(bad, "enums", F.concat(F.col("case_id").cast("string"), F.lit(": "), F.col("x.field"), F.lit("="), F.coalesce("x.v", F.lit("null"))))


def critical_routing(cases: DataFrame) -> DataFrame:
    """a critical case is to be escalated."""
    bad = cases.filter((F.col("risk_level") == "critical") & ~F.col("expected_action").eqNullSafe("escalate"))
    return _issues(bad, "critical_routing", F.concat(F.col("case_id").cast("string"), F.lit(": critical, expected "), F.coalesce("expected_action", F.lit("null"))))


def duplicate_ids(cases: DataFrame, key: str = "case_id") -> DataFrame:
    """A17."""
    bad = cases.groupBy(key).agg(F.count(F.lit(1)).alias("c")).filter("c > 1")
    return _issues(bad, "duplicate_ids", F.concat(F.coalesce(F.col(key).cast("string"), F.lit("null")), F.lit(": "), F.col("c").cast("string"), F.lit(" rows")))


def split_leakage(cases: DataFrame) -> DataFrame:
    """Seeds with more than one split; null is a split."""
    named = F.coalesce("split", F.lit("null"))
    bad = cases.groupBy("seed_id").agg(F.sort_array(F.collect_set(named)).alias("splits")).filter(F.size("splits") > 1)
    return _issues(bad, "split_leakage", F.concat(F.coalesce("seed_id", F.lit("null")), F.lit(": "), F.array_join("splits", ", ")))


def duplicate_queries(cases: DataFrame, order: str = "case_id", first: int = 5) -> DataFrame:
    """One issue in all, with the first rows whose normalised query occurred before."""
    key = fn.duplicate_key(F.coalesce("query", F.lit("")))
    groups = cases.groupBy(F.md5(key).alias("k")).agg(F.min(order).alias("o"), F.count(F.lit(1)).alias("n")).filter("n > 1")
    total = groups.agg(F.sum(F.col("n") - 1).alias("c"))
    # the first row of each group is no duplicate; of the others only the first few are wanted
    later = cases.select(F.md5(key).alias("k"), F.col(order).alias("id")).join(groups, "k").filter("id <> o").select(F.col("id").alias("o"))
    shown = later.orderBy("o").limit(first).agg(F.array_join(F.sort_array(F.collect_list("o")).cast("array<string>"), ", ").alias("l"))
    return _issues(total.filter("c > 0").crossJoin(shown), "duplicates", F.concat(F.col("c").cast("string"), F.lit(" duplicate queries, first: "), F.col("l")))


def duplicate_groups(cases: DataFrame, text: str = "query", order: str = "case_id") -> DataFrame:
    """Groups of equal normalised texts: (key_md5, first_id, cnt)."""
    key = F.md5(fn.duplicate_key(F.coalesce(F.col(text), F.lit(""))))
    return cases.groupBy(key.alias("key_md5")).agg(F.min(order).alias("first_id"), F.count(F.lit(1)).alias("cnt")).filter("cnt > 1")


def missing_lineage(cases: DataFrame) -> DataFrame:
    """C5."""
    empty = lambda c: F.coalesce(F.col(c), F.lit("")) == ""
    return _issues(cases.filter(empty("source_collection") | empty("source_case_id")), "lineage", F.col("case_id").cast("string"))


def secret_words(registry: DataFrame, template: str = "template", words: tuple[str, ...] = ("api_key", "secret", "password", "bearer")) -> DataFrame:
    """Templates that hold words of credentials."""
    return _issues(registry.filter(F.lower(template).rlike("|".join(words))), "secret_words", F.col(registry.columns[0]).cast("string"))


def validate(cases: DataFrame, lines: DataFrame | None = None) -> DataFrame:
    """All issues of the structural checks."""
    found = [enum_issues(cases), duplicate_ids(cases), split_leakage(cases), critical_routing(cases), duplicate_queries(cases)]
    if lines is not None:
        found.append(missing_fields(lines))
    out = found[0]
    for df in found[1:]:
        out = out.unionByName(df)
    return out


def summary(cases: DataFrame, issues: DataFrame) -> DataFrame:
    """Totals; ``valid`` is rows less issues, and can be negative."""
    n = cases.agg(F.count(F.lit(1)).alias("total_rows"), F.count_if(F.coalesce(F.col("label_status") == "human_validated", F.lit(False))).alias("human_validated"))
    m = issues.agg(F.count(F.lit(1)).alias("total_issues"))
    both = n.crossJoin(m)
    return both.select("total_rows", "total_issues", (F.col("total_rows") - F.col("total_issues")).alias("valid_rows"), "human_validated", F.when(F.col("total_issues") == 0, "PASS").otherwise("FAIL").alias("status"))


def first_issues(issues: DataFrame, n: int = 10) -> DataFrame:
    """K4: the first n issues of each category, with the category's total."""
    own = W.partitionBy("category").orderBy("issue")
    total = issues.groupBy("category").agg(F.count(F.lit(1)).alias("total"))
    return issues.withColumn("n", F.row_number().over(own)).filter(F.col("n") <= n).join(total, "category").drop("n")


def ids_hash(df: DataFrame, key: str = "case_id") -> DataFrame:
    """SHA-256 of the sorted ids, one a line. The ids of a data set are gathered, as the hash is of their whole list."""
    return df.agg(F.sha2(F.array_join(F.sort_array(F.collect_list(F.col(key).cast("string"))), "\n"), 256).alias("ids_sha256"))


def file_hash(spark, path: str) -> DataFrame:
    """SHA-256 of a file's text."""
    return spark.read.text(path, wholetext=True).select(F.sha2("value", 256).alias("file_sha256"))
