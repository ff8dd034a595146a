"""A clean document of over a million words stays in the pipeline."""

import corpus_pipeline
from tests.llm.test_small import SCHEMA


def test_length_alone_drops_nothing(spark):
    text = "the " + " ".join(f"word{k}" for k in range(1_000_000))
    df = spark.createDataFrame([(1, text, "xx", "s", len(text)), (2, "too short", "xx", "s", 9)], SCHEMA)
    assert [r.doc_id for r in corpus_pipeline.quality(spark, df, "").select("doc_id").collect()] == [1]
