r"""Chat formatting of reply trees with DataFrame functions only.

Paths: every node has a jump to the ancestor 1, 2, 4, ... steps up; in each round a self-join doubles
the jumps and another one extends, from each leaf, the known ancestors by as many again. A tree of
depth D takes log2(D) rounds, and the rows are those of the paths asked for; no array of a
path grows until its texts are put together. Texts stay out of the rounds.

Branches of a tree are ranked by the sum of their nodes' scores, ties by the leaf's id; the best
``branches`` are formatted (None: all).

Template: each turn is ``### <role>: <text></turn>`` and a line end. A backslash is doubled, ``###`` is
written ``#\\#\\#`` (a backslash between), ``</turn>`` is ``<\\/turn>``, and ``: `` within a role is ``:\\ ``; a
backslash before any character stands for that character, so the text comes back whole.

Defined results: null texts and roles are empty; a null tree id is a tree of its own; a node whose
parent is missing is a root; nodes repeated under one (tree, node) id are reduced to the one with the
smallest (parent, role, text); nodes that only lead into a cycle have no root and raise ValueError.
Scores that are null count 0. An empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from evalgrove.llm.common import durable

END = "</turn>\n"
#: The role whose texts are under the loss mask.
LEARNT = "assistant"


def escape(text: Column) -> Column:
    t = F.replace(F.coalesce(text, F.lit("")), F.lit("\\"), F.lit("\\\\"))
    t = F.regexp_replace(t, r"#(?=##)", r"#\\")
    return F.replace(t, F.lit("</turn>"), F.lit("<\\/turn>"))


def escape_role(role: Column) -> Column:
    return F.regexp_replace(escape(role), r":(?= )", r":\\")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"(?s)\\(.)", "$1")


def turn(role: Column, text: Column) -> Column:
    return F.concat(F.lit("### "), escape_role(role), F.lit(": "), escape(text), F.lit(END))


def read_turns(formatted: Column) -> Column:
    """array of struct(role, text), read back from a formatted conversation."""
    parts = F.filter(F.split(formatted, "</turn>\n"), lambda p: p != "")

    def one(p: Column) -> Column:
        at = F.instr(p, ": ")
        return F.struct(unescape(F.substring(p, F.lit(5), at - 5)).alias("role"), unescape(F.substring(p, at + 2, F.length(p))).alias("text"))

    return F.transform(parts, one)


def paths(nodes: DataFrame, branches: int | None = 1) -> DataFrame:
    """(tree, leaf, node, up, branch) of the chosen root-to-leaf paths; up counts steps from the leaf. nodes: tree, node, parent, score; tree not null, nodes distinct."""
    ids = durable(nodes.select("tree", "node", "parent", F.coalesce("score", F.lit(0.0)).cast("double").alias("score")))
    known = ids.select("tree", F.col("node").alias("parent"))
    jumps = durable(ids.select("tree", "node", "parent").join(known, ["tree", "parent"], "left_semi").select("tree", "node", F.col("parent").alias("to")))
    parents = jumps.select("tree", F.col("to").alias("node")).distinct()
    found = ids.join(parents, ["tree", "node"], "left_anti").select("tree", F.col("node").alias("leaf"), "node", F.lit(0).cast("long").alias("up"))
    step, n = 1, ids.count()
    if n and found.isEmpty():
        raise ValueError("every node has a reply: the replies run in a circle")
    while not jumps.isEmpty():
        if step > n:
            raise ValueError("replies run in a circle")
        further = found.join(jumps, ["tree", "node"]).select("tree", "leaf", F.col("to").alias("node"), (F.col("up") + step).alias("up"))
        found = durable(found.unionByName(further))
        on = jumps.select("tree", F.col("node").alias("to"), F.col("to").alias("far"))
        jumps = durable(jumps.join(on, ["tree", "to"]).select("tree", "node", F.col("far").alias("to")))
        step *= 2
    if branches is None:
        rank = found.select("tree", "leaf").distinct().withColumn("branch", F.lit(None).cast("int"))
    else:
        sums = found.join(ids.select("tree", "node", "score"), ["tree", "node"]).groupBy("tree", "leaf").agg(F.sum("score").alias("score"))
        best = W.partitionBy("tree").orderBy(F.col("score").desc(), "leaf")
        rank = sums.withColumn("branch", F.row_number().over(best)).filter(F.col("branch") <= branches).select("tree", "leaf", "branch")
    return found.join(rank, ["tree", "leaf"])


def format_trees(nodes: DataFrame, branches: int | None = 1) -> DataFrame:
    """(tree, leaf, branch, formatted, loss_mask) from nodes: tree, node, parent, role, text, score.

    loss_mask has a span for each turn, in code points of ``formatted``: the turn begins at ``at``, and what is to be
    learnt of it is [start, stop), the escaped text of the role LEARNT and nothing (start = stop) of others.
    """
    # a null tree id joins like any other
    keyed = nodes.withColumn("tree", F.struct(F.col("tree").isNull().alias("none"), F.col("tree").alias("id")))
    keyed = keyed.withColumn("tree", F.to_json("tree"))
    once = keyed.groupBy("tree", "node").agg(F.min(F.struct("parent", "role", "text", "score")).alias("x")).select("tree", "node", "x.*")
    chosen = paths(once, branches)
    body = escape(F.col("text"))
    turns = chosen.join(once.select("tree", "node", turn(F.col("role"), F.col("text")).alias("turn"), F.length(body).cast("long").alias("body"), (F.coalesce("role", F.lit("")) == LEARNT).alias("learnt")), ["tree", "node"])
    # where each turn begins in the conversation, and where its text ends
    before = W.partitionBy("tree", "leaf").orderBy(F.col("up").desc()).rowsBetween(W.unboundedPreceding, W.currentRow)
    stop = F.sum(F.length("turn")).over(before)
    turns = turns.withColumn("stop", stop - len(END)).withColumn("at", F.col("stop") + len(END) - F.length("turn"))
    span = F.struct((-F.col("up")).alias("k"), "turn", F.struct("at", F.when(F.col("learnt"), F.col("stop") - F.col("body")).otherwise(F.col("stop")).alias("start"), "stop").alias("span"))
    lines = F.sort_array(F.collect_list(span))
    done = turns.groupBy("tree", "leaf", "branch").agg(lines.alias("lines"))
    done = done.select("tree", "leaf", "branch", F.array_join(F.transform("lines", lambda x: x["turn"]), "").alias("formatted"), F.transform("lines", lambda x: x["span"]).alias("loss_mask"))
    kind = nodes.schema["tree"].dataType.simpleString()
    return done.withColumn("tree", F.from_json("tree", f"none boolean, id {kind}")["id"])


def conversation_nodes(turns: DataFrame) -> DataFrame:
    """The ``conversations`` table as reply trees: each row answers the one before it by turn (ties by role and text)."""
    order = W.partitionBy("conv_id").orderBy("turn", "role", "text")
    rows = turns.select("conv_id", "turn", "role", "text").withColumn("node", F.row_number().over(order).cast("long"))
    parent = F.when(F.col("node") > 1, F.col("node") - 1)
    return rows.select(F.col("conv_id").alias("tree"), "node", parent.alias("parent"), "role", "text", F.lit(0.0).alias("score"))


def masked(formatted: Column, loss_mask: Column) -> Column:
    """The unescaped text under the loss mask, span by span: cut from the formatted conversation at the spans' places (within its turn's segment, so that a long conversation is read once)."""
    segments = F.filter(F.split(formatted, END), lambda p: p != "")
    cut = F.zip_with(segments, loss_mask, lambda p, m: unescape(F.substring(p, (m["start"] - m["at"] + 1).cast("int"), (m["stop"] - m["start"]).cast("int"))))
    return F.array_join(cut, "")


def read_back(formatted: DataFrame) -> DataFrame:
    """Counts and digests of what a formatted conversation holds; the loss is what its mask covers."""
    turns = F.col("turns")
    df = formatted.withColumn("turns", read_turns(F.col("formatted")))
    df = df.withColumn("loss", masked(F.col("formatted"), F.col("loss_mask")))
    spoken = F.array_join(F.transform(turns, lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return df.select(
        F.col("tree").alias("conv_id"),
        F.size(turns).cast("long").alias("n_turns"),
        F.sha2(spoken, 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"),
        F.sha2(F.col("loss"), 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )


# A text's escaped length: one more for each backslash, for each '#' that two more follow, and for each '</turn>'.
_LENGTH = r"""(length({0}) + (length({0}) - length(replace({0}, '\', '')))
  + coalesce(list_sum(list_transform(regexp_extract_all({0}, '#{{3,}}'), lambda x: length(x) - 2)), 0)
  + (length({0}) - length(replace({0}, '</turn>', ''))) // 7)"""

#: The query over ``conversations`` in DuckDB SQL (roles there hold no control strings).
ORACLE_SQL = rf"""
WITH turns AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok' UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'
)
SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
       coalesce(sum(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END), 0)::BIGINT AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
       sum(4 + length(role) + 2 + {_LENGTH.format("text")} + 8)::BIGINT AS formatted_chars
FROM turns GROUP BY conv_id
"""
