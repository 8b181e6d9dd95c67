"""Every query with an SQL twin returns the same rows as DuckDB."""

import pytest

import __spark_entry__ as entry_points
from compare import connect, difference
from conftest import SMALL

QUERIES, ORACLES = entry_points.queries(), entry_points.oracle_sql()


@pytest.fixture(scope="module")
def duck():
    return connect(SMALL)


def test_every_oracle_has_a_query():
    assert set(ORACLES) <= set(QUERIES)


@pytest.mark.parametrize("name", sorted(n for n in ORACLES if not n.startswith("op")))
def test_query_matches_sql(spark, duck, name):
    ours = QUERIES[name](spark, SMALL).toPandas()
    theirs = duck.execute(ORACLES[name]).df()
    assert len(ours) > 0
    assert difference(ours, theirs) is None


def test_entry(spark):
    assert entry_points.entry(spark).count() == 1719


LARGE = [
    "a11_target_report", "a4_charger_stats", "c15_clip_upper", "clean_all_steps", "congestion_features",
    "congestion_features_unbroken", "energy_features", "legacy_energy_features", "w2_rolling_means",
]


@pytest.mark.parametrize("name", LARGE)
def test_ways_taken_for_large_inputs(spark, duck, name):
    """The same rows when Spark may not broadcast."""
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        ours = QUERIES[name](spark, SMALL).toPandas()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert difference(ours, duck.execute(ORACLES[name]).df()) is None
