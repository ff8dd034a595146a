"""The loss mask covers each assistant text once, in place, in very long conversations too."""

from pyspark.sql import functions as F

from evalgrove.llm import chat


def test_mask_spans_are_the_escaped_texts(spark):
    texts = ["\\### Assistant: </turn> ok", "a: b", "", None, "日本 🙂 ###", "x" * 500_000]
    rows = [(c, t, ("user", "assistant", "sys: tem")[(c + t) % 3], texts[(c + t) % 6]) for c in range(4) for t in range(9)]
    df = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string")
    made = chat.format_trees(chat.conversation_nodes(df))
    for r in made.collect():
        own = [x for x in rows if x[0] == r.tree]
        assert len(r.loss_mask) == 9
        for (_, _, role, text), m in zip(own, r.loss_mask, strict=True):
            body = r.formatted[m.start : m.stop]
            assert r.formatted[m.at : m.at + 4] == "### " and r.formatted[m.stop :].startswith("</turn>\n")
            plain = spark.range(1).select(chat.escape(F.lit(text)).alias("e")).first().e if len(text or "") < 100 else text
            assert body == (plain if role == "assistant" else "")
    loss = {r.conv_id: r.loss_chars for r in chat.read_back(made).collect()}
    assert loss == {c: sum(len(x[3] or "") for x in rows if x[0] == c and x[2] == "assistant") for c in range(4)}


def test_a_conversation_of_many_turns(spark):
    df = spark.range(3_000).select(F.lit(1).cast("bigint").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") % 2 == 0, "user").otherwise("assistant").alias("role"), F.col("id").cast("string").alias("text"))
    r = chat.read_back(chat.format_trees(chat.conversation_nodes(df))).first()
    assert r.n_turns == 3_000 and r.loss_chars == sum(len(str(k)) for k in range(1, 3_000, 2))
