"""Lags, snapshots, train-only statistics and feature tables."""

import pytest
from pyspark.sql import functions as F

from chargeweave.functions import measures
from chargeweave.operators import aggregates as agg
from chargeweave.operators import lags, quality
from chargeweave.plans import features
from chargeweave.schemas import PRODUCTS
from conftest import at


@pytest.fixture
def snapshots(spark):
    """Irregular series: a long station with gaps, one with two snapshots, one with one."""
    rows = [("A", at(h, day=d, minute=m), (h * m + d) % 5, float(h)) for d in (1, 2, 5) for h in (0, 1, 7) for m in (0, 1, 5, 30, 31, 58, 59)]
    rows += [("B", at(1), 7, 1.0), ("B", at(2), 9, 2.0), ("C", at(3), 4, 3.0), ("D", at(1), 1, 1.0), ("D", at(5), 2, 1.0), ("D", at(6), 3, 1.0), ("D", at(6, minute=1), 5, 1.0)]
    return spark.createDataFrame(
        [(*r, 3) for r in rows],
        "charging_station_id string, timestamp timestamp_ntz, active_chargers bigint, total_power_kw double, collection_period int",
    )


@pytest.mark.parametrize("build", [lags.lag_features, lags.lag_features_unbroken])
def test_chunked_window_equals_plain_window(snapshots, build, monkeypatch):
    chunked = build(snapshots)
    monkeypatch.setattr(lags, "_with_halo", lambda df, keys: df.withColumns({"_chunk": F.lit(0), "_is_halo": F.lit(False)}))
    plain = build(snapshots)
    assert plain.count() == snapshots.count()
    assert plain.exceptAll(chunked).count() == 0 and chunked.exceptAll(plain).count() == 0


@pytest.mark.parametrize("parts", [1, 2, 5, 40])
def test_unbroken_rolling_does_not_depend_on_the_ranges(spark, snapshots, parts):
    """Ranges of one station, empty ranges, and stations with one snapshot in a row."""
    rows = [(f"E{i:02d}", at(1 + k), i % 7, 1.0, 3) for i in range(30) for k in range(1 + i % 3)]
    more = snapshots.unionByName(spark.createDataFrame(rows, snapshots.schema))
    pdf = more.toPandas().sort_values(["charging_station_id", "timestamp"])
    shifted = pdf.groupby("charging_station_id")["active_chargers"].shift(1)
    want = shifted.rolling(6, min_periods=1).mean()
    got = lags.lag_features_unbroken(more, parts).toPandas().sort_values(["charging_station_id", "timestamp"])
    assert got["roll_6_active"].fillna(-1).tolist() == pytest.approx(want.fillna(-1).tolist())


def test_no_window_spans_all_stations(snapshots):
    plan = lags.lag_features_unbroken(snapshots)._jdf.queryExecution().toString()
    assert "SinglePartition" not in plan


def test_unbroken_rolling_matches_pandas(snapshots):
    pdf = snapshots.toPandas().sort_values(["charging_station_id", "timestamp"])
    shifted = pdf.groupby("charging_station_id")["active_chargers"].shift(1)
    pdf["roll_3"] = shifted.rolling(3, min_periods=1).mean()
    pdf["roll_6"] = shifted.rolling(6, min_periods=1).mean()
    pdf["lag_2"] = pdf.groupby("charging_station_id")["active_chargers"].shift(2)
    pdf = pdf.dropna(subset=["lag_2"])
    got = lags.lag_features_unbroken(snapshots).na.drop(subset=["lag_2_active"]).toPandas()
    got = got.sort_values(["charging_station_id", "timestamp"])
    assert got["roll_6_active"].tolist() == pytest.approx(pdf["roll_6"].tolist())
    assert got["roll_3_active"].tolist() == pytest.approx(pdf["roll_3"].tolist())


def test_lags_within_period_do_not_cross(snapshots):
    two = snapshots.withColumn("collection_period", F.when(F.dayofmonth("timestamp") < 5, 1).otherwise(3))
    got = lags.lag_features(two, partition_by_period=True)
    firsts = got.where("charging_station_id = 'A' and lag_1_active is null").count()
    assert firsts == 2


def test_snapshot_counts_rows_and_treats_missing_power(readings):
    df = readings(
        [
            ("S1", "C1", at(1), 5.0, 10.0, 1.0, None),
            ("S1", "C1", at(1), 0.0, 20.0, 1.0, None),
            ("S1", "C2", at(1), None, None, 1.0, None),
            ("S2", "C3", at(1), None, None, 1.0, None),
            (None, "C3", at(1), 1.0, 1.0, 1.0, None),
        ]
    )
    from chargeweave.functions.timefeat import time_columns

    timed = df.withColumns(time_columns(F.col("timestamp"))).withColumn("collection_period", F.lit(3))
    one, two = agg.station_snapshots(timed).orderBy("charging_station_id").collect()
    assert (one.active_chargers, one.total_chargers, one.total_power_kw) == (1, 3, 5.0)
    assert (two.active_chargers, two.total_chargers, two.total_power_kw) == (0, 1, 0.0)
    demand = agg.demand_snapshots(timed).orderBy("charging_station_id").collect()
    assert (demand[0].total_energy_wh, demand[0].avg_energy_per_charger) == (30.0, 15.0)
    assert (demand[1].total_energy_wh, demand[1].avg_energy_per_charger) == (0.0, None)


def test_sample_deviation_of_one_row_is_missing(readings):
    df = readings([("S1", "C1", at(1), 5.0, 10.0, 1.0, None)])
    assert agg.legacy_station_stats(df).first().station_std_energy_wh is None


def test_train_statistics_ignore_later_rows(lake):
    """Changing the validation and test rows leaves the joined statistics as they were."""
    table = lake.features("leftover")
    cut = table.where("split <> 'train'").agg(F.min("timestamp")).first()[0]
    changed = lake.cleaned.withColumn(
        "max_energy_wh", F.when((F.col("timestamp") > F.lit(cut).cast("timestamp_ntz")) & (F.col("collection_period") == 3), 1e9).otherwise(F.col("max_energy_wh"))
    )
    later = features.leftover_features(changed)
    stats = ["charger_id", "charger_max_energy_wh"]
    assert table.select(*stats).distinct().exceptAll(later.select(*stats).distinct()).count() == 0


@pytest.mark.parametrize("name", list(PRODUCTS))
def test_contract_and_split_partition(lake, name):
    table = lake.features(name)
    assert table.columns == PRODUCTS[name].contract
    assert table.where("split not in ('train', 'val', 'test') or split is null").count() == 0


def test_staged_and_lazy_builders_agree(lake):
    for build in (features.demand_features, features.leftover_features):
        a, b = build(lake.cleaned), build(lake.cleaned, staged=False)
        keys = ["charging_station_id", "timestamp", "split"]
        assert a.select(*keys).exceptAll(b.select(*keys)).count() == 0


def test_measures_keep_missing(spark):
    df = spark.createDataFrame([(None, 5.0), (3.0, None), (3.0, 5.0), (9.0, 5.0)], "cap double, e double")
    got = [r[0] for r in df.select(measures.leftover(F.col("cap"), F.col("e"))).collect()]
    assert got == [None, None, 0.0, 4.0]
    got = [r[0] for r in df.select(measures.at_most(F.col("cap"), 4.0)).collect()]
    assert got == [None, 3.0, 3.0, 4.0]
    got = [r[0] for r in df.select(measures.idle_flag(F.col("cap") - 3)).collect()]
    assert got == [0, 1, 1, 0]


def test_zero_totals(spark):
    df = spark.createDataFrame([(5.0, 0.0), (5.0, 10.0)], "a double, b double")
    a, b = F.col("a"), F.col("b")
    got = df.select(measures.percent_of(a, b), measures.per_unit(a, b), measures.ratio_to_history(a, b), measures.utilization_rate(a, b))
    assert [tuple(r) for r in got.collect()] == [(0.0, 0.0, None, None), (50.0, 0.5, 0.5, 0.5)]


def test_bands(spark):
    df = spark.createDataFrame([(x,) for x in (0.0, 30.0, 50.1, 80.0, 80.1, 90.0, 90.1)], "x double")
    got = df.select(measures.occupancy_band(F.col("x")), measures.session_band(F.col("x"))).collect()
    assert [r[0] for r in got] == ["open", None, None, None, "high", "high", "high"]
    assert [r[1] for r in got] == ["early", "early", "in progress", "in progress", "in progress", "in progress", "nearly complete"]


def test_negative_report_ignores_the_sentinel(spark):
    df = spark.createDataFrame([(-1.0, -0.5), (-999.0, 0.5), (2.0, 0.1)], "x double, hour_sin double")
    assert [tuple(r) for r in quality.negative_report(df).collect()] == [("x", 1)]


def test_duplicate_count_of_distinct_rows(spark):
    assert quality.duplicate_count(spark.range(5)).first()[0] == 0
    assert quality.duplicate_count(spark.range(5).union(spark.range(3))).first()[0] == 3
