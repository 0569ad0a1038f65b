"""Every registered query against its SQL on the smallest tables."""

import pytest
from compare import connect, differences

import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"
QUERIES, ORACLES = entry.queries(), entry.oracle_sql()


@pytest.fixture(scope="module")
def duck():
    return connect(SF)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_agrees_with_sql(spark, duck, name):
    problem, _ = differences(spark, duck, name, QUERIES[name], ORACLES.get(name), SF)
    assert problem is None


def test_entry(spark):
    frame = entry.entry(spark)
    assert {"query_id", "rank", "chunk_id", "score"} <= set(frame.columns)
    assert frame.count() > 0


def test_times_do_not_depend_on_the_zone(spark):
    from quillrank.registry.chats import chats

    utc = sorted(map(tuple, chats(spark, SF).collect()))
    spark.conf.set("spark.sql.session.timeZone", "America/New_York")
    try:
        assert sorted(map(tuple, chats(spark, SF).collect())) == utc
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")
