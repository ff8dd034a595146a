import pytest
from pyspark.sql import functions as F

from evalgrove.plans.file_queries import ORACLE_SQL, QUERIES
from evalgrove.sources import files
from tests.oracle import assert_same

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query_equals_duckdb(spark, name):
    assert_same(spark, QUERIES[name], ORACLE_SQL[name], SF)


def test_embedded_texts_are_the_backends(spark):
    from evalgrove.plans.backends import RuleBackend

    for r in QUERIES["embedded_texts"](spark, SF).collect():
        assert r.embedding == pytest.approx(RuleBackend().embed([r.text])[0])


def test_written_queries_cover_all_combinations(spark):
    rows = QUERIES["written_queries"](spark, SF)
    assert rows.count() == QUERIES_PLAIN(spark) and rows.filter("query = '' OR query IS NULL").count() == 0


def QUERIES_PLAIN(spark):
    from evalgrove.plans.queries import QUERIES as plain

    return plain["cross_product"](spark, SF).count()


def test_numbers_are_dense_over_many_ranges(spark):
    df = spark.range(0, 1_000, 1, 7).select((F.col("id") * 37 % 1_000).alias("k"))
    assert sorted((r.k, r.article_idx) for r in files.numbered(df, ["k"]).collect()) == [(k, k) for k in range(1_000)]
    assert files.numbered(df.limit(0), ["k"]).count() == 0


def test_a_cluster_must_name_its_folder():
    class Session:
        class conf:
            get = staticmethod(lambda *_: None)

        class sparkContext:
            master = "spark://host:7077"

    with pytest.raises(ValueError):
        files.shared_folder(Session)
