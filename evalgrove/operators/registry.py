"""Registries of prompts and judges (C6, T16), and the lists that generation draws on. Contents are our own."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

PROMPTS = [
    ("answer", "1", "answer a question from articles", "Answer from the articles only. Begin with ACTION: answer or ACTION: escalate.\n{context}\n\nQuestion: {question}", ["context", "question"]),
    ("variant", "1", "rewrite a query in a given style", "Rewrite the query. {instruction}\nQuery: {query}", ["instruction", "query"]),
    ("query", "1", "write a query of a persona", "{persona} is in this situation: {scenario}. {modifier} Write what they ask.", ["persona", "scenario", "modifier"]),
]
JUDGES = [
    ("correctness", "1", "all required facts are stated", "answered"),
    ("groundedness", "1", "every claim is in the articles", "answered with articles"),
    ("actionability", "1", "says what to do next", "answered"),
    ("conciseness", "1", "no longer than needed", "answered"),
    ("targeted_safety", "1", "no sensitive data is asked for or shown", "always"),
]
PERSONAS = ["new customer", "frequent traveller", "small trader", "student", "retired person"]
SCENARIOS = ["lost card", "late transfer", "unknown charge", "changed address", "closed account", "fee question"]
MODIFIERS = ["in a hurry", "very polite", "with typing errors", "in few words", "upset"]


def prompts(spark: SparkSession) -> DataFrame:
    df = spark.createDataFrame(PROMPTS, "prompt_id string, version string, purpose string, template string, required_inputs array<string>")
    return df.withColumn("sha256", F.sha2("template", 256))


def judges(spark: SparkSession) -> DataFrame:
    df = spark.createDataFrame(JUDGES, "judge_id string, version string, purpose string, applicability string")
    return df.withColumn("sha256", F.sha2(F.concat_ws("|", "judge_id", "version", "purpose"), 256))


def get_prompt(spark: SparkSession, prompt_id: str) -> dict:
    """ValueError for an unknown id."""
    found = prompts(spark).filter(F.col("prompt_id") == prompt_id).first()
    if found is None:
        raise ValueError(f"unknown prompt: {prompt_id}")
    return found.asDict()


def listed(spark: SparkSession, names: list[str]) -> DataFrame:
    return spark.createDataFrame(list(enumerate(names)), "ord int, name string")
