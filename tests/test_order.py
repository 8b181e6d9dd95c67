"""Order statistics, quantiles and splits against plain windows and numpy."""

import numpy as np
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import Window
from pyspark.sql import functions as F

from chargeweave.operators import order_stats, splits
from conftest import at

COMMON = dict(deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])


@given(st.lists(st.floats(-1e9, 1e9, allow_nan=False), min_size=1, max_size=60), st.sampled_from([0.0, 0.5, 0.99, 1.0]))
@settings(max_examples=6, **COMMON)
def test_narrowed_quantile_equals_numpy(spark, values, q):
    df = spark.createDataFrame([(v,) for v in values], "v double")
    got = order_stats.quantiles(df, ["v"], q)["v"]
    assert got == pytest.approx(float(np.quantile(values, q)), rel=1e-12, abs=1e-12)


def test_quantile_of_nothing(spark):
    df = spark.createDataFrame([(None,)], "v double")
    assert order_stats.quantiles(df, ["v"], 0.5) == {"v": None}


def test_log_buckets_never_decrease(spark):
    values = [-1e300, -2.5, -1.0, -1e-300, 0.0, 1e-300, 0.1, 0.1000001, 1.0, 1.0000001, 7.0, 1e300]
    df = spark.createDataFrame([(v,) for v in values], "v double")
    for steps in order_stats.LOG_STEPS:
        got = [r[0] for r in df.select(order_stats.log_bucket(F.col("v"), steps)).collect()]
        assert got == sorted(got)


@pytest.fixture
def scans(monkeypatch):
    """How often a table is scanned for order statistics, and the plans of these scans."""
    plans, narrow = [], order_stats._narrow

    def counted(df, ranges, slots):
        test = [r.holds(F.col(r.column)) for r in ranges]
        plans.append(df.where(test[0])._jdf.queryExecution().toString())
        return narrow(df, ranges, slots)

    monkeypatch.setattr(order_stats, "_narrow", counted)
    return plans


def test_several_quantiles_of_several_columns_in_two_scans(spark, tmp_path, scans):
    rng = np.random.default_rng(3)
    a, b = rng.lognormal(3, 4, 4000), rng.normal(0, 1e-3, 4000)
    rows = [(float(x), None if i % 9 == 0 else float(y), None) for i, (x, y) in enumerate(zip(a, b))]
    spark.createDataFrame(rows, "a double, b double, none double").write.parquet(str(tmp_path / "t"))
    df = spark.read.parquet(str(tmp_path / "t"))
    qs = [0.0, 0.25, 0.5, 0.99, 0.995, 1.0]
    got = order_stats.order_statistics(df, {"a": qs, "b": qs, "none": [0.5]})
    known = b[np.arange(4000) % 9 != 0]
    for q in qs:
        assert got["a", q] == pytest.approx(float(np.quantile(a, q)), rel=1e-12)
        assert got["b", q] == pytest.approx(float(np.quantile(known, q)), rel=1e-12)
    assert got["none", 0.5] is None
    assert len(scans) == 2
    assert "PushedFilters: [IsNotNull(a), GreaterThanOrEqual(a" in scans[1]


def test_values_closer_than_a_cell_take_another_scan(spark, scans):
    near = [1.0 + k * 2.0**-52 for k in range(200)] + [1.005]
    df = spark.createDataFrame([(v,) for v in near], "v double")
    for q in (0.5, 0.99):
        assert order_stats.quantiles(df, ["v"], q)["v"] == float(np.quantile(near, q))
    assert len(scans) > 4


def test_equal_values_take_one_scan(spark, scans):
    df = spark.createDataFrame([(7.5,)] * 50, "v double")
    assert order_stats.quantiles(df, ["v"], 0.37) == {"v": 7.5} and len(scans) == 1


def test_grouped_quantile_with_a_hot_group(spark):
    rng = np.random.default_rng(7)
    rows = [("hot", float(v)) for v in rng.normal(0, 100, 600).round(1)]
    rows += [(f"g{i % 40}", float(i * 37 % 101)) for i in range(400)] + [("one", 3.0), ("two", 1.0), ("two", 2.0)]
    df = spark.createDataFrame(rows + [("none", None)], "g string, v double")
    for q in (0.5, 0.99):
        slow = order_stats.grouped_quantile(df, ["g"], "v", q, "m")
        fast = df.where("v is not null").groupBy("g").agg(F.percentile("v", q).alias("m"))
        a = {r.g: r.m for r in slow.collect()}
        b = {r.g: r.m for r in fast.collect()}
        assert a == pytest.approx(b)


@pytest.fixture
def timed(readings):
    """A third of the rows share one timestamp; many ties elsewhere."""
    rows = [(f"S{i % 7}", f"C{i}", at(5), 1.0, 1.0, 1.0, None) for i in range(40)]
    rows += [(f"S{i % 5}", f"C{i}", at(i % 24, day=1 + i % 9), 1.0, 1.0, 1.0, None) for i in range(40, 123)]
    return readings(rows)


def expected_split(df, first, second):
    order = Window.orderBy("timestamp", "charging_station_id", "charger_id")
    n = df.count()
    return df.withColumn("nth", F.row_number().over(order)).withColumn(
        "want", F.when(F.col("nth") <= int(n * first), "train").when(F.col("nth") <= int(n * second), "val").otherwise("test")
    )


def test_time_split_equals_global_rank(timed):
    got = splits.time_split(timed)
    want = expected_split(timed, 0.8, 0.9).select("charger_id", "want")
    assert got.join(want, "charger_id").where("split <> want").count() == 0
    assert {r.split: r.rows for r in splits.split_sizes(got).collect()} == {"train": 98, "val": 12, "test": 13}


def test_cuts_are_read_by_ranges_of_time(spark, timed, tmp_path, monkeypatch):
    """After the histogram every scan for a cut names a range of timestamps the files can skip by."""
    timed.write.parquet(str(tmp_path / "t"))
    table, plans, inside = spark.read.parquet(str(tmp_path / "t")), [], order_stats._inside

    def seen(*args):
        plans.append(inside(*args)._jdf.queryExecution().toString())
        return inside(*args)

    monkeypatch.setattr(order_stats, "_inside", seen)
    labelled = splits.time_split(table)
    assert len(plans) == 3
    pushed = [p[p.rindex("PushedFilters: ") :] for p in plans]
    assert all("GreaterThanOrEqual(timestamp" in p and "LessThanOrEqual(timestamp" in p for p in pushed)
    want = expected_split(table, 0.8, 0.9).select("charger_id", "want")
    assert labelled.join(want, "charger_id").where("split <> want").count() == 0


def test_period_split_drops_or_trains_other_periods(timed):
    df = timed.withColumn("collection_period", (F.substring("charger_id", 2, 9).cast("int") % 4 + 1))
    dropped = splits.period_time_split(df)
    kept = splits.period_time_split(df, other_periods="train")
    assert dropped.where("collection_period = 4").count() == 0
    assert [r[0] for r in kept.where("collection_period = 4").select("split").distinct().collect()] == ["train"]
    p3 = dropped.where("collection_period = 3")
    latest_train = p3.where("split = 'train'").agg(F.max("timestamp")).first()[0]
    assert p3.where("split <> 'train'").agg(F.min("timestamp")).first()[0] >= latest_train
    n = df.where("collection_period = 3").count()
    sizes = {r.split: r.rows for r in splits.split_sizes(p3).collect()}
    assert sizes["train"] == int(n * 0.8) and sizes["val"] == int(n * 0.9) - int(n * 0.8)


def test_third_period_split_with_few_periods(timed):
    two = timed.withColumn("collection_period", F.lit(1))
    got = splits.third_period_split(two, 0.7)
    want = expected_split(timed, 0.8, 0.9).select("charger_id", "want")
    assert got.join(want, "charger_id").where("split <> want").count() == 0


def test_split_of_an_empty_table(timed):
    empty = timed.where("charger_id = 'nobody'").withColumn("collection_period", F.lit(3))
    assert splits.period_time_split(empty).count() == 0


def test_random_split_is_seeded_and_exact(timed):
    keys = ["charging_station_id", "charger_id", "timestamp"]
    a, b, c = (splits.random_split(timed, keys, s) for s in (1, 1, 2))
    assert a.exceptAll(b).count() == 0
    assert a.exceptAll(c).count() > 0
    sizes = {r.split: r.rows for r in splits.split_sizes(a).collect()}
    assert sizes == {"train": int(123 * 0.8), "val": int(123 * 0.1), "test": 123 - int(123 * 0.8) - int(123 * 0.1)}


def test_seeded_sample(timed):
    keys = ["charger_id"]
    assert splits.seeded_sample(timed, keys, 50).count() == 50
    assert splits.seeded_sample(timed, keys, 500).count() == 123
    one, two = (splits.seeded_sample(timed, keys, 20) for _ in range(2))
    assert one.exceptAll(two).count() == 0


def test_quantiles_with_infinities(spark):
    rows = [(0, float(x)) for x in range(9)] + [(0, float("inf")), (1, float("-inf")), (1, 2.0)]
    df = spark.createDataFrame(rows, "g int, v double")
    assert order_stats.quantiles(df, ["v"], 1.0) == {"v": float("inf")}
    assert order_stats.quantiles(df, ["v"], 0.0) == {"v": float("-inf")}
    got = {r["g"]: r["m"] for r in order_stats.grouped_quantile(df, ["g"], "v", 0.5, "m").collect()}
    assert got == {0: 4.5, 1: float("-inf")}


def test_hash_order_is_counted_without_a_sort(spark):
    df = spark.range(500).selectExpr("cast(id AS string) AS a")
    levels = splits.hash_levels(["a"], 7)
    counts = df.groupBy(levels[0][1].alias("k")).agg(F.min(levels[1][1]), F.max(levels[1][1]))
    assert "SortAggregate" not in counts._jdf.queryExecution().executedPlan().toString()
    order = [splits.hash_order(["a"], 7), "a"]
    coarse = df.orderBy(*order).select(*[e.alias(n) for n, e in levels[:2]]).collect()
    assert coarse == sorted(coarse)
