"""Every query against its SQL; those without SQL must give rows."""

import pytest

from evspark.plans.queries import ORACLE_SQL, QUERIES

from .oracle import SF, assert_same, database


@pytest.fixture(scope="module")
def db():
    return database()


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_against_sql(spark, db, name):
    assert_same(QUERIES[name](spark, SF).toPandas(), db.sql(ORACLE_SQL[name]).df())


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLE_SQL)))
def test_has_rows(spark, name):
    assert QUERIES[name](spark, SF).count() > 0


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.parametrize("name", ["bm25_global_topk", "rrf_fusion", "budget_pack", "route_score_topk"])
def test_partitions_do_not_matter(spark, name):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    first = QUERIES[name](spark, SF).toPandas()
    try:
        spark.conf.set("spark.sql.shuffle.partitions", "13")
        again = QUERIES[name](spark, SF).toPandas()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert_same(first, again)
