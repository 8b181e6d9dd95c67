"""Cleaning semantics on hand-made frames."""

import pytest
from pyspark.sql import functions as F

from chargeweave.operators import cleaning
from chargeweave.plans.jobs import clean_to_table
from chargeweave.session import new_folder
from conftest import SMALL, at
from querybook.fixture import readings as fixture_readings

NAN = float("nan")


def rows(df, *columns):
    return sorted(tuple(r) for r in df.select(*columns).collect())


def test_exact_dedup_treats_missing_as_equal(readings):
    row = ("S1", "C1", at(1), 5.0, 10.0, 1.0, None)
    other = ("S1", "C1", at(1), 5.0, 10.0, 1.0, 50.0)
    nan = ("S1", "C1", at(1), 5.0, 10.0, 1.0, NAN)
    df = cleaning.prepare_readings(readings([row, row, other, nan]))
    assert cleaning.exact_dedup(df).count() == 2


def test_mean_resolution_drops_null_keys_and_keeps_fractions(readings):
    df = readings(
        [
            ("S1", "C1", at(1), 4.0, 10.0, 0.0, None),
            ("S1", "C1", at(1), 6.0, 20.0, 1.0, 80.0),
            (None, "C1", at(1), 1.0, 1.0, 1.0, None),
            ("S1", None, at(1), 1.0, 1.0, 1.0, None),
            ("S1", "C2", None, 1.0, 1.0, 1.0, None),
        ]
    )
    got = rows(cleaning.resolve_by_mean(df), "charger_id", "avg_pwr_kw", "max_energy_wh", "active_session_count", "soc_pct")
    assert got == [("C1", 5.0, 15.0, 0.5, 80.0)]


def test_fractional_sessions_pass_and_truncate_to_zero(readings):
    df = readings([("S1", "C1", at(1), 5.0, 10.0, 0.5, None), ("S1", "C2", at(1), 5.0, 10.0, 0.0, None)])
    typed = cleaning.fix_types(cleaning.drop_sessionless(df))
    assert rows(typed, "charger_id", "active_session_count") == [("C1", 0)]


def test_unknown_session_count_is_quarantined(readings):
    df = readings([("S1", "C1", at(1), 5.0, 10.0, None, None), ("S1", "C2", at(1), 5.0, 10.0, 1.0, None)])
    kept = cleaning.drop_sessionless(df)
    assert kept.count() == 2
    good, bad = cleaning.castable(kept)
    assert rows(good, "charger_id") == [("C2",)] and rows(bad, "charger_id") == [("C1",)]
    assert rows(cleaning.fix_types(kept), "charger_id") == [("C2",)]


def test_keep_max_prefers_known_energy(readings):
    df = readings(
        [
            ("S1", "C1", at(1), 4.0, None, 1.0, None),
            ("S1", "C1", at(1), 6.0, 20.0, 1.0, None),
            ("S1", "C1", at(1), 9.0, 20.0, 1.0, None),
        ]
    )
    assert rows(cleaning.resolve_by_max_energy(df), "avg_pwr_kw", "max_energy_wh") == [(9.0, 20.0)]


def test_invalid_and_dead_rows(readings):
    df = readings(
        [
            ("S1", "C1", at(1), -1.0, 10.0, 1.0, None),
            ("S1", "C2", at(1), None, 10.0, 1.0, None),
            ("S1", "C3", at(1), 0.0, 0.0, 1.0, None),
            ("S1", "C4", at(1), 0.0, 5.0, 1.0, None),
        ]
    )
    valid = cleaning.drop_invalid(df)
    assert rows(valid, "charger_id") == [("C3",), ("C4",)]
    assert rows(cleaning.drop_dead(valid), "charger_id") == [("C4",)]


def test_outlier_limit_keeps_ties(readings):
    df = readings([("S1", f"C{i}", at(1), min(float(i), 90.0), float(i), 1.0, None) for i in range(101)])
    limits = cleaning.outlier_limits(df, 0.99)
    assert limits == {"max_energy_wh": 99.0, "avg_pwr_kw": 90.0}
    assert cleaning.drop_outliers(df, 0.99).count() == 100


def test_clip_keeps_rows_and_nulls(readings):
    df = readings([("S1", f"C{i}", at(1), float(i), float(i), 1.0, None) for i in range(11)]).union(
        readings([("S1", "CN", at(1), None, None, 1.0, None)])
    )
    clipped = cleaning.clip_upper(df, 0.5)
    assert clipped.count() == 12
    assert clipped.agg(F.max("avg_pwr_kw")).first()[0] == 5.0
    assert rows(clipped.where("charger_id = 'CN'"), "avg_pwr_kw") == [(None,)]


def test_station_cap_keeps_the_newest(readings):
    df = readings(
        [("S1", f"C{i}", at(h), 1.0, 1.0, 1.0, None) for h in range(4) for i in range(3)]
        + [("S2", "C9", at(0), 1.0, 1.0, 1.0, None)]
    )
    capped = cleaning.cap_stations(df, cap=4)
    assert rows(capped.where("charging_station_id = 'S1'"), "timestamp", "charger_id") == [
        (at(2), "C2"), (at(3), "C0"), (at(3), "C1"), (at(3), "C2"),
    ]
    assert capped.where("charging_station_id = 'S2'").count() == 1


def test_high_cap_in_salted_parts(lake):
    typed = cleaning.fix_types(lake.in_session)
    biggest = typed.groupBy("charging_station_id").count().agg(F.max("count")).first()[0]
    assert cleaning.cap_stations(typed, cap=1001).count() == typed.count() and biggest < 1001
    twice = typed.withColumn("charger_id", F.explode(F.array(*[F.concat("charger_id", F.lit(x)) for x in "abcd"])))
    high = cleaning.cap_stations(twice, cap=1001)
    assert high.count() == sum(min(r["count"], 1001) for r in twice.groupBy("charging_station_id").count().collect())
    plain = cleaning._newest(twice, ["charging_station_id"], 1001)
    assert high.exceptAll(plain).count() == 0


@pytest.mark.parametrize("zone", ["UTC", "America/New_York"])
def test_timestamps_are_utc_in_any_session(spark, zone):
    from chargeweave.functions.timefeat import utc_timestamp

    texts = ["2025-11-01T10:30:00Z", "2025-11-01T12:30:00+02:00", "2025-11-01 10:30:00", "2025-11-01T10:30:00.000", "x"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    before = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", zone)
    try:
        got = [r[0] and str(r[0]) for r in df.select(utc_timestamp(F.col("t"))).collect()]
    finally:
        spark.conf.set("spark.sql.session.timeZone", before)
    assert got == ["2025-11-01 10:30:00"] * 4 + [None]


def test_periods_of_all_months(spark):
    from chargeweave.functions.timefeat import collection_period

    df = spark.range(1, 13).select("id", collection_period(F.col("id")).alias("p"))
    assert {r.id: r.p for r in df.collect()} == {m: {11: 1, 12: 2}.get(m, 3) for m in range(1, 13)}


def test_audit_agrees_with_the_golden_counts(spark):
    raw = fixture_readings(spark, SMALL)
    valid = cleaning.drop_invalid(cleaning.resolve_by_mean(cleaning.exact_dedup(raw)))
    report = cleaning.audit(raw, cleaning.outlier_limits(valid)).orderBy("step").collect()
    assert report[0].rows_in == 6752
    assert [r.rows_left for r in report] == [6000, 5297, 5285, 5232, 4472, 4257, 4257, 3000]


@pytest.mark.parametrize("cap", [400, 700])
def test_audit_counts_other_caps(spark, cap):
    raw = fixture_readings(spark, SMALL)
    valid = cleaning.drop_invalid(cleaning.resolve_by_mean(cleaning.exact_dedup(raw)))
    last = cleaning.audit(raw, cleaning.outlier_limits(valid), cap).orderBy("step").collect()[-1]
    assert last.rows_left == cleaning.clean(raw, cap=cap).count()


def test_cleaning_twice_changes_nothing_in_the_row_steps(lake):
    once = lake.cleaned
    again = cleaning.drop_invalid(cleaning.resolve_by_mean(cleaning.exact_dedup(once)))
    assert again.count() == once.count()


def test_own_time_columns_are_averaged_and_truncated(spark):
    df = spark.createDataFrame(
        [("S1", "C1", at(1), 5.0, 10.0, 1.0, None, 3.0, 2.0, 12.0, 0.0, 0.5, 0.5),
         ("S1", "C1", at(1), 7.0, 10.0, 1.0, None, 4.0, 2.0, 12.0, 0.0, 0.5, 0.5)],
        "charging_station_id string, charger_id string, timestamp timestamp_ntz, avg_pwr_kw double, "
        "max_energy_wh double, active_session_count double, soc_pct double, hour double, "
        "day_of_week double, month double, is_weekend double, hour_sin double, hour_cos double",
    )
    kept = cleaning.clean(df, recompute_time=False).first()
    assert (kept.hour, kept.month, kept.collection_period) == (3, 12, 2)
    recomputed = cleaning.clean(df).first()
    assert (recomputed.hour, recomputed.month, recomputed.collection_period) == (1, 4, 3)


def test_clean_to_table(spark):
    raw = fixture_readings(spark, SMALL)
    table = clean_to_table(raw, new_folder(spark, "cleaned_table"))
    assert table.count() == 3000
    assert len(table.columns) == 14


def test_hot_key_and_copies(spark):
    """A third of all rows are copies of one reading, another third share one key."""
    copies = spark.range(3000).selectExpr(
        "'S1' charging_station_id", "'C1' charger_id", "TIMESTAMP_NTZ '2026-04-01' timestamp",
        "5.0D avg_pwr_kw", "9.0D max_energy_wh", "1.0D active_session_count", "cast(null as double) soc_pct",
    )
    near = spark.range(3000).selectExpr(
        "'S1' charging_station_id", "'C2' charger_id", "TIMESTAMP_NTZ '2026-04-01' timestamp",
        "cast(id as double) avg_pwr_kw", "9.0D max_energy_wh", "1.0D active_session_count", "cast(null as double) soc_pct",
    )
    resolved = cleaning.resolve_by_mean(cleaning.exact_dedup(copies.union(near)))
    assert rows(resolved, "charger_id", "avg_pwr_kw") == [("C1", 5.0), ("C2", 1499.5)]


def test_cap_none_keeps_all_rows(readings):
    df = readings([("s", f"c{i}", at(1), 1.0, 1.0, 1.0, None) for i in range(400)])
    assert cleaning.cap_stations(df, None).count() == 400
    assert cleaning.cap_stations(df, 300).count() == 300


def test_uncapped_table_keeps_every_reading_of_a_station(spark, readings):
    rows = [("s1", f"c{i % 7}", at(i % 24, 1 + i // 24, minute=i % 60), 5.0, 50.0, 2.0, 40.0) for i in range(320)]
    raw = readings(rows)
    sizes = {c: clean_to_table(raw, new_folder(spark, "cleaned"), cap=c).count() for c in (300, None)}
    assert sizes == {300: 300, None: 320}


@pytest.mark.parametrize("name", ["a3_station_stats", "w4_period_time_split", "leftover_features"])
def test_queries_over_uncapped_tables(spark, name):
    """On a table with stations above the cap, each equals its twin over all typed readings."""
    import __spark_entry__ as entry_points
    from compare import connect, difference
    from querybook.lake import lake

    folder = "/root/testdata/sf0.01"
    capped = lake(spark, folder)
    assert capped.uncapped.cleaned.count() > capped.cleaned.count()
    ours = entry_points.queries()[f"{name}_uncapped"](spark, folder).toPandas()
    theirs = connect(folder).execute(entry_points.oracle_sql()[f"{name}_uncapped"]).df()
    assert len(ours) and difference(ours, theirs) is None


def test_the_station_cap_shuffles_once(spark, readings):
    rows = [("S", f"C{i % 7}", at(i % 24, day=1 + i // 24), 1.0, 1.0, 1.0, None) for i in range(400)]
    df = readings(rows).repartition(3)
    capped = cleaning.cap_stations(df, 50)
    plan = capped._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[-1]
    assert plan.count("Exchange hashpartitioning") == 1 and "50, Partial" in plan
    spark.conf.set("spark.sql.optimizer.windowGroupLimitThreshold", "10")
    try:
        salted = cleaning.cap_stations(df, 50)
        assert salted.exceptAll(capped).isEmpty() and salted.count() == capped.count() == 50
    finally:
        spark.conf.unset("spark.sql.optimizer.windowGroupLimitThreshold")
