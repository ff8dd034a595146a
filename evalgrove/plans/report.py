"""Report columns (P3) and queries written for combinations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evalgrove.functions import text as fn
from evalgrove.operators.registry import PROMPTS
from evalgrove.plans import backends

#: Report name of each column.
NAMES = {"source": "persona", "topic": "script", "difficulty": "modifier"}


def display(results: DataFrame) -> DataFrame:
    """The columns of a report beside those of the results."""
    return results.withColumns({new: F.col(old) for old, new in NAMES.items()})


def written_queries(combinations: DataFrame, backend: backends.Backend) -> DataFrame:
    """A query for each (persona_name, scenario_name, modifier_name), unquoted; errors stay as values."""
    template = next(p[3] for p in PROMPTS if p[0] == "query")
    asked = combinations.withColumn("prompt", fn.render(template, persona=F.col("persona_name"), scenario=F.col("scenario_name"), modifier=F.col("modifier_name")))
    made = backends.generate(asked.withColumn("context", F.col("prompt")), backend, "prompt", "context")
    return made.withColumn("query", fn.unquote(fn.strip_action_line(F.col("bot_response")))).drop("context", "bot_response")
