"""Queries over files, contract checks on raw lines, and backends: each over its whole table, with the DuckDB SQL of the same result.

Files go to a new folder of the shared one and are read back.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evalgrove import schemas
from evalgrove.functions import text as fn
from evalgrove.operators import contract, incremental, sampling
from evalgrove.plans import backends, report, views
from evalgrove.plans.views import SQL, table
from evalgrove.sources import files

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql is not None:
            ORACLE_SQL[name] = sql
        return f

    return add


_DOC = "doc_id bigint, text string, lang string"
_DIGEST = "SELECT doc_id, md5(text) AS text_md5, lang FROM documents"


def _digest(df: DataFrame) -> DataFrame:
    return df.select("doc_id", F.md5("text").alias("text_md5"), "lang")


def _documents(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", "text", "lang")


@query("jsonl_round_trip", _DIGEST)
def jsonl_round_trip(spark, sf_dir):
    """IO1, IO11."""
    path = files.shared_folder(spark)
    files.write_jsonl(_documents(spark, sf_dir), path, order="doc_id")
    return _digest(files.jsonl(spark, path, _DOC))


def _broken(spark, sf_dir) -> str:
    """Documents as JSON lines between blank ones; every seventh line breaks off."""
    line = F.to_json(F.struct("doc_id", "text", "lang"), {"ignoreNullFields": "false"})
    cut = F.when(F.col("doc_id") % 7 == 0, F.concat(F.lit('{"doc_id": '), F.col("doc_id").cast("string"))).otherwise(line)
    path = files.shared_folder(spark)
    _documents(spark, sf_dir).select(F.explode(F.array(cut, F.lit(""))).alias("value")).write.text(path)
    return path


@query("jsonl_good_and_bad", "SELECT doc_id, CASE WHEN doc_id % 7 <> 0 THEN md5(text) END AS text_md5, doc_id % 7 = 0 AS bad FROM documents")
def jsonl_good_and_bad(spark, sf_dir):
    """IO2: rows, and the lines that are none."""
    good, bad = files.good_and_bad(spark, _broken(spark, sf_dir), _DOC)
    told = bad.select(F.regexp_extract("value", "([0-9]+)$", 1).cast("bigint").alias("doc_id"), F.lit(None).cast("string").alias("text_md5"), F.lit(True).alias("bad"))
    return good.select("doc_id", F.md5("text").alias("text_md5"), F.lit(False).alias("bad")).unionByName(told)


@query("jsonl_dropped", f"{_DIGEST} WHERE doc_id % 7 <> 0")
def jsonl_dropped(spark, sf_dir):
    """IO3."""
    return _digest(files.jsonl(spark, _broken(spark, sf_dir), _DOC, "drop"))


@query("numbered_rows", "SELECT doc_id, row_number() OVER (ORDER BY md5(doc_id::VARCHAR)) - 1 AS article_idx FROM documents")
def numbered_rows(spark, sf_dir):
    """IO4: a dense index, in the order of a digest."""
    return files.numbered(_documents(spark, sf_dir).select("doc_id", F.md5(F.col("doc_id").cast("string")).alias("m")), ["m"]).select("doc_id", "article_idx")


@query("text_lines", r"""SELECT md5(x) AS line_md5, count(*) AS cnt FROM (SELECT regexp_replace(unnest(string_split(replace(text, chr(13), chr(10)), chr(10))), '^\s+|\s+$', '', 'g') AS x FROM documents) WHERE x <> '' GROUP BY 1""")
def text_lines(spark, sf_dir):
    """IO8: stripped lines of the texts, blank ones dropped."""
    path = files.shared_folder(spark)
    _documents(spark, sf_dir).select(F.coalesce("text", F.lit("")).alias("value")).write.text(path)
    return files.text_lines(spark, path).groupBy(F.md5("value").alias("line_md5")).agg(F.count(F.lit(1)).alias("cnt"))


@query("csv_texts", "SELECT md5(text) AS text_md5, count(*) AS cnt FROM benchmark GROUP BY 1")
def csv_texts(spark, sf_dir):
    """IO9, IO10: one file's texts appended to another's, and one column read back."""
    path = files.shared_folder(spark)
    rows = table(spark, sf_dir, "benchmark").select("text", "item_id")
    files.append_csv(rows.filter("item_id % 2 = 0"), path)
    files.append_csv(rows.filter("item_id % 2 = 1"), path)
    return files.csv_column(spark, path, "text string, item_id bigint", "text").groupBy(F.md5("text").alias("text_md5")).agg(F.count(F.lit(1)).alias("cnt"))


@query("sorted_lines", "SELECT doc_id, row_number() OVER (ORDER BY doc_id) AS place FROM documents")
def sorted_lines(spark, sf_dir):
    """K3: place of each row in the sorted part files."""
    path = files.shared_folder(spark)
    files.write_jsonl(table(spark, sf_dir, "documents").select("doc_id"), path, order="doc_id")
    rows = spark.read.schema("doc_id bigint").json(path).select("doc_id", F.col("_metadata.file_name").alias("file"), F.monotonically_increasing_id().alias("m"))
    per = rows.groupBy("file").agg(F.count(F.lit(1)).alias("n"), F.min("m").alias("first"))
    before = F.coalesce(F.sum("n").over(files.W.orderBy("file").rowsBetween(files.W.unboundedPreceding, -1)), F.lit(0))  # a row for each file
    return rows.join(F.broadcast(per.select("file", "first", before.alias("base"))), "file").select("doc_id", (F.col("base") + F.col("m") - F.col("first") + 1).alias("place"))


@query("jsonl_appended", _DIGEST)
def jsonl_appended(spark, sf_dir):
    """IO12: two appended batches."""
    path = files.shared_folder(spark)
    for part in (0, 1):
        files.append_jsonl(_documents(spark, sf_dir).filter(f"doc_id % 2 = {part}"), path)
    return _digest(files.jsonl(spark, path, _DOC))


@query("run_metadata", "SELECT 'of ' || min(lang) AS run_id, count(*) AS total_cases, 4 AS top_k, NULL::VARCHAR AS git_commit FROM documents")
def run_metadata(spark, sf_dir):
    """IO13: one row, written and read back."""
    found = _documents(spark, sf_dir).agg(F.count(F.lit(1)).alias("n"), F.min("lang").alias("l")).first()
    path = files.shared_folder(spark)
    files.write_metadata(spark, {"run_id": f"of {found.l}", "total_cases": found.n, "top_k": 4}, path, schemas.RUN_METADATA)
    return files.jsonl(spark, path, schemas.RUN_METADATA).select("run_id", "total_cases", "top_k", "git_commit")


@query("checkpoint_batches", _DIGEST)
def checkpoint_batches(spark, sf_dir):
    """IO14: batches appended to a checkpoint, each of what is not there yet."""
    path = files.shared_folder(spark)
    for part in (1, 2, 3):
        left = incremental.todo(_documents(spark, sf_dir), files.read_checkpoint(spark, path, _DOC), ["doc_id"])
        files.append_checkpoint(left.filter(F.col("doc_id") % 3 < part), path)
    return _digest(files.read_checkpoint(spark, path, _DOC))


@query("missing_fields", f"""{SQL} SELECT 'missing_fields' AS category, case_id || ': missing ' || field AS issue
  FROM (SELECT case_id, unnest(list_filter([CASE WHEN topic IS NULL THEN 'topic' END, CASE WHEN expected_action IS NULL THEN 'expected_action' END], lambda x: x IS NOT NULL)) AS field FROM v_cases)""")
def missing_fields(spark, sf_dir):
    """fields absent from JSON lines; what is null in the cases is left out of their lines."""
    lines = views.cases(spark, sf_dir).select(F.to_json(F.struct("case_id", "topic", "expected_action")).alias("value"))
    return contract.missing_fields(lines, ("case_id", "topic", "expected_action"))


@query("combinations_left", """WITH every AS (SELECT DISTINCT l_returnflag, l_linestatus, l_linenumber FROM lineitem), done AS (SELECT l_returnflag, l_linestatus, l_linenumber FROM lineitem WHERE l_quantity > 49 AND l_tax > 0.07)
  SELECT * FROM every e WHERE NOT EXISTS (SELECT 1 FROM done d WHERE d.l_returnflag = e.l_returnflag AND d.l_linestatus = e.l_linestatus AND d.l_linenumber = e.l_linenumber)""")
def combinations_left(spark, sf_dir):
    """An anti-join on three keys."""
    rows, keys = table(spark, sf_dir, "lineitem"), ["l_returnflag", "l_linestatus", "l_linenumber"]
    return incremental.todo(rows.select(keys).distinct(), rows.filter("l_quantity > 49 AND l_tax > 0.07"), keys)


@query("family_lookup", "SELECT doc_id, f.family_name, f.instruction FROM documents LEFT JOIN (VALUES " + ", ".join("('{0}', '{1}', '{3}')".format(*r) for r in sampling.FAMILY_ROWS) + ") f(family_id, family_name, instruction) ON f.family_id = CASE WHEN lang = 'en' THEN 'short_mobile' WHEN lang = 'de' THEN 'non_native' ELSE lang END")
def family_lookup(spark, sf_dir):
    """A family by its id, null for ids that are unknown."""
    known = F.when(F.col("lang") == "en", "short_mobile").when(F.col("lang") == "de", "non_native").otherwise(F.col("lang"))
    return sampling.with_family(_documents(spark, sf_dir).withColumn("family_id", known)).select("doc_id", "family_name", "instruction")


@query("missing_lineage", f"{SQL} SELECT 'lineage' AS category, case_id::VARCHAR AS issue FROM v_cases WHERE coalesce(difficulty, '') = '' OR coalesce(expected_action, '') = ''")
def missing_lineage(spark, sf_dir):
    """Language and label stand for a case's origin."""
    return contract.missing_lineage(views.cases(spark, sf_dir).withColumns({"source_collection": F.col("difficulty"), "source_case_id": F.col("expected_action")}))


@query("secret_words", "SELECT 'secret_words' AS category, doc_id::VARCHAR AS issue FROM documents WHERE regexp_matches(lower(text), 'api_key|secret|password|bearer')")
def secret_words(spark, sf_dir):
    """C7, over texts in place of templates."""
    return contract.secret_words(table(spark, sf_dir, "documents").select("doc_id", "text"), "text")


@query("file_hash", "SELECT sha256(string_agg(doc_id::VARCHAR || chr(10), '' ORDER BY doc_id)) AS file_sha256 FROM documents")
def file_hash(spark, sf_dir):
    """The text of one file, made of the sorted ids."""
    path = files.shared_folder(spark)
    table(spark, sf_dir, "documents").select("doc_id").orderBy("doc_id").select(F.col("doc_id").cast("string")).coalesce(1).write.text(path)
    return contract.file_hash(spark, path)


@query("embedded_texts")
def embedded_texts(spark, sf_dir):
    """Vectors of the benchmark's texts by the rule backend, in batches of 100."""
    return backends.embed(table(spark, sf_dir, "benchmark"), backends.RuleBackend(), "text")


_URGENT = " OR ".join(f"contains(lower({{0}}), '{w}')" for w in ("stolen", "fraud", "emergency", "hacked"))
_ANSWER = f"CASE WHEN {_URGENT.format('text')} THEN 'ACTION: escalate' || chr(10) || 'A person will take over.' ELSE 'ACTION: answer' || chr(10) || left(lang || ': ' || text, 300) END"


def _answers(spark, sf_dir) -> DataFrame:
    return backends.generate(_documents(spark, sf_dir).withColumn("context", F.concat("lang", F.lit(": "), "text")), backends.RuleBackend(), "text", "context")


@query("generated_answers", f"SELECT doc_id, md5({_ANSWER}) AS response_md5, true AS bot_success FROM documents")
def generated_answers(spark, sf_dir):
    """The rule backend's answers."""
    return _answers(spark, sf_dir).select("doc_id", F.md5("bot_response").alias("response_md5"), "bot_success")


@query("judged_answers", f"""WITH a AS (SELECT doc_id, lang, lower({_ANSWER}) AS r FROM documents)
  SELECT doc_id, CASE WHEN lang <> 'de' THEN contains(r, lang || ':') END AS correct, CASE WHEN lang <> 'de' THEN NOT contains(r, 'password') END AS safe, lang <> 'de' AS applicable FROM a""")
def judged_answers(spark, sf_dir):
    """Judges of the rule backend, which rows that do not apply never reach."""
    rows = _answers(spark, sf_dir).withColumns({"case_id": F.col("doc_id").cast("string"), "required_facts": F.array(F.concat("lang", F.lit(":")))})
    judged = backends.judge(rows, backends.RuleBackend(), ("correctness", "safety"), F.col("lang") != "de")
    return judged.select("doc_id", F.col("correctness.passed").alias("correct"), F.col("safety.passed").alias("safe"), F.col("safety.applicable").alias("applicable"))


@query("written_queries")
def written_queries(spark, sf_dir):
    """A query for each combination of region, event type and market segment, by the rule backend."""
    from evalgrove.plans.queries import cross_product

    renamed = cross_product(spark, sf_dir).toDF("persona_name", "scenario_name", "modifier_name")
    return report.written_queries(renamed, backends.RuleBackend()).select("persona_name", "scenario_name", "modifier_name", "query")


@query("unquoted_texts", "SELECT item_id, md5(text) AS plain_md5 FROM (SELECT item_id, regexp_replace(text, '^[\\s\"'']+|[\\s\"'']+$', '', 'g') AS text FROM benchmark)")
def unquoted_texts(spark, sf_dir):
    """T12 on texts in three kinds of wrapping."""
    k = F.col("item_id") % 3
    wrapped = F.when(k == 0, F.concat(F.lit(' "'), "text", F.lit('" '))).when(k == 1, F.concat(F.lit("'"), "text", F.lit("'"))).otherwise(F.concat(F.lit("\"'"), "text", F.lit("'\"")))
    return table(spark, sf_dir, "benchmark").select("item_id", F.md5(fn.unquote(wrapped)).alias("plain_md5"))
