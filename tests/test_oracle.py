"""Every query of the core beside its SQL in DuckDB, on whole tables."""

import pytest
from compare import spark_bag, sql_bag, views

from stemma import plans

QUERIES, SQL = plans.queries(), plans.oracle_sql()


@pytest.fixture(scope="module")
def con(sf_dir):
    return views(sf_dir)


def test_sql_has_queries():
    assert set(SQL) <= set(QUERIES)


@pytest.mark.parametrize("name", sorted(SQL))
def test_same_rows(spark, sf_dir, con, name):
    columns, rows = spark_bag(QUERIES[name](spark, sf_dir))
    want_columns, want = sql_bag(con, SQL[name])
    assert columns == want_columns
    assert rows == want


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_runs(spark, sf_dir, name):
    df = QUERIES[name](spark, sf_dir)
    assert len(set(df.columns)) == len(df.columns)
    df.count()


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())


def test_partitions_do_not_matter(spark, sf_dir):
    """The same rows with one shuffle partition and with many."""
    old = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        for name in ("dedupe_first_wins", "p2_found", "place_match", "conflict_latest"):
            bags = []
            for n in ("1", "16"):
                spark.conf.set("spark.sql.shuffle.partitions", n)
                bags.append(spark_bag(QUERIES[name](spark, sf_dir)))
            assert bags[0] == bags[1], name
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", old)
