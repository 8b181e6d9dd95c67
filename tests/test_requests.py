"""Request validation, lookups with fallbacks, responses and sources."""

import json

import pytest
from pyspark.sql import functions as F

from chargeweave.plans import requests as rq
from chargeweave.session import new_folder
from chargeweave.sources import telemetry


def one(df):
    got = df.collect()
    assert len(got) == 1
    return got[0]


@pytest.mark.parametrize(
    "station, date, hour, reason",
    [
        ("S1", "2026-04-03", 5, None),
        ("S1", "2026-04-03", None, None),
        (None, "2026-04-03", 5, "station_id is required"),
        ("S1", "2026-02-30", 5, "target_date is not an ISO date"),
        ("S1", "2026", 5, "target_date is not an ISO date"),
        ("S1", "2026-04-03", 24, "hour is not in 0-23"),
        ("S1", "2026-04-03", -1, "hour is not in 0-23"),
    ],
)
def test_validation(spark, station, date, hour, reason):
    df = spark.createDataFrame([(station, date, hour)], "station_id string, target_date string, hour int")
    row = one(rq.check_requests(df, "demand"))
    assert row.reject_reason == reason
    if hour is None:
        assert row.hour == 17
    assert row.total_chargers == 1.0


ENERGY = "charging_station_id string, charger_id string, station_mean_energy_wh double, station_median_energy_wh double, station_mean_power_kw double, station_max_power_kw double, station_charger_count bigint, charger_mean_energy_wh double, charger_median_energy_wh double"


@pytest.fixture
def energy_table(spark):
    known = ("S1", "C1", 10.0, 11.0, 12.0, 13.0, 2, 20.0, 21.0)
    unseen_charger = ("S1", "C2", 10.0, 11.0, 12.0, 13.0, 2, None, None)
    unseen_station = ("S2", "C3", None, None, None, None, None, None, None)
    other = ("S3", "C4", 40.0, 41.0, 42.0, 43.0, 1, 44.0, 45.0)
    return spark.createDataFrame([known, unseen_charger, unseen_station, other], ENERGY)


@pytest.mark.parametrize(
    "station, charger, expected",
    [
        ("S1", "C1", (10.0, 11.0, 12.0, 13.0, 2.0, 20.0, 21.0)),
        # known charger without statistics: the sentinel, not the station's values
        ("S1", "C2", (10.0, 11.0, 12.0, 13.0, 2.0, -999.0, -999.0)),
        ("S1", "C9", (10.0, 11.0, 12.0, 13.0, 2.0, 10.0, 11.0)),
        ("S2", "C9", (-999.0,) * 7),
        # unknown station: row-weighted means, one charger
        ("S9", "C9", (20.0, 21.0, 22.0, 23.0, 1.0, 20.0, 21.0)),
        ("S9", "C4", (20.0, 21.0, 22.0, 23.0, 1.0, 44.0, 45.0)),
    ],
)
def test_energy_history(spark, energy_table, station, charger, expected):
    asked = spark.createDataFrame([(station, charger)], "station_id string, charger_id string")
    row = one(rq.with_energy_history(asked, rq.energy_history(energy_table)))
    got = [row[c] for c in [*rq.STATION_AGGREGATES, *rq.CHARGER_AGGREGATES]]
    assert got == pytest.approx(list(expected))


def test_charger_history(spark):
    table = spark.createDataFrame(
        [("S2", "C1", "2026-04-02", 50.0, 30.0), ("S1", "C1", "2026-04-01", 50.0, 30.0)],
        "charging_station_id string, charger_id string, timestamp string, charger_max_energy_wh double, charger_mean_energy_wh double",
    )
    asked = spark.createDataFrame([("C1", 10.0), ("C9", 10.0)], "charger_id string, energy_consumed_wh double")
    asked = asked.withColumn("station_id", F.lit("sent"))
    known, unknown = rq.with_charger_history(asked, rq.charger_history(table)).orderBy("charger_id").collect()
    assert (known.station_id, known.charger_max_energy_wh, known.charger_mean_energy_wh) == ("S1", 50.0, 30.0)
    assert (unknown.station_id, unknown.charger_max_energy_wh, unknown.charger_mean_energy_wh) == ("unknown", 15.0, 10.0)


def test_leftover_rows_without_history(spark):
    df = spark.createDataFrame([("C1", "", "2026-04-04", 100.0)], "charger_id string, station_id string, target_date string, energy_consumed_wh double")
    row = one(rq.feature_rows(rq.valid_requests(df, "leftover"), "leftover"))
    assert row.charging_station_id == "unknown"
    assert row.estimated_capacity_wh == pytest.approx(165.0)
    assert (row.is_weekend, row.day_of_week, row.month, row.is_idle_charger, row.active_session_count) == (1, 5, 4, 1, 0)


@pytest.mark.parametrize("total, prediction, active, pct", [(4, 9.0, 4.0, 100.0), (4, -1.0, 0.0, 0.0), (0, 3.0, 0.0, 0.0)])
def test_congestion_response(spark, total, prediction, active, pct):
    df = spark.createDataFrame([(total, prediction)], "total_chargers int, prediction double")
    zero = {c: F.lit(0.0) for c in rq.LAG_COLUMNS}
    row = one(rq.responses(df.withColumns(zero), "congestion"))
    assert (row.predicted_active_chargers, row.predicted_occupancy_pct) == (active, pct)
    assert row.note is not None
    given = df.withColumns({**zero, "roll_6_active": F.lit(0.5)})
    assert one(rq.responses(given, "congestion")).note is None


def test_multi_line_search_hits(spark, tmp_path):
    source = {"station_id": "a", "charger_id": "c", "timestamp": "2025-11-01T10:30:00Z", "power_kw": 22.5, "energy_wh": 15000}
    shifted = {**source, "timestamp": "2025-11-01T12:30:00+02:00"}
    doc = {"hits": {"hits": [{"_source": source}, {"_source": shifted}]}}
    (tmp_path / "period1.json").write_text(json.dumps(doc, indent=2))
    rows = telemetry.read_search_hits(spark, str(tmp_path)).collect()
    assert [str(r.timestamp) for r in rows] == ["2025-11-01 10:30:00"] * 2
    assert (rows[0].charging_station_id, rows[0].avg_pwr_kw, rows[0].max_energy_wh) == ("a", 22.5, 15000.0)


def test_missing_csv_path(spark, tmp_path):
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        telemetry.read_csv(spark, str(tmp_path / "nowhere.csv"))


def test_csv_of_all_thirteen_columns(spark, tmp_path):
    header = "charging_station_id,charger_id,timestamp,avg_pwr_kw,max_energy_wh,active_session_count,soc_pct,hour,day_of_week,month,is_weekend,hour_sin,hour_cos"
    (tmp_path / "raw.csv").write_text(header + "\nS1,C1,2025-11-01T10:30:00Z,5.5,100,1,,10,5,11,1,0.5,-0.8\n")
    from chargeweave.operators.cleaning import clean

    row = one(clean(telemetry.read_csv(spark, str(tmp_path / "raw.csv"))))
    assert (str(row.timestamp), row.hour, row.collection_period, row.soc_pct) == ("2025-11-01 10:30:00", 10, 1, None)


def test_partitioned_table_is_pruned(spark, lake):
    path = new_folder(spark, "pruned")
    telemetry.write_table(lake.cleaned, path, partition_by=["collection_period"])
    plan = telemetry.read_table(spark, path).where("collection_period = 1")
    text = plan._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(collection_period" in text


def test_malformed_values_are_rejected(spark):
    from chargeweave.plans.requests import check_requests

    rows = [("s", "c", "2026-04-01", h, p) for h, p in [("abc", "1"), ("17.6", "1"), ("5", "oops"), ("5", "2.5"), (None, None)]]
    df = spark.createDataFrame(rows, "station_id string, charger_id string, target_date string, hour string, avg_pwr_kw string")
    got = [r["reject_reason"] for r in check_requests(df, "energy").collect()]
    assert got == ["hour is not of type int"] * 2 + ["avg_pwr_kw is not of type double", None, None]


def test_known_charger_without_statistics_stays_missing(spark):
    from chargeweave.plans.requests import charger_history, feature_rows, with_charger_history

    history = spark.sql(
        "SELECT 'c' AS charger_id, 'st' AS charging_station_id, TIMESTAMP_NTZ '2026-04-01 00:00:00' AS timestamp,"
        " CAST(NULL AS double) AS charger_max_energy_wh, CAST(NULL AS double) AS charger_mean_energy_wh"
    )
    asked = spark.sql(
        "SELECT id AS charger_id, DATE '2026-04-02' AS target_date, 5 AS hour, 100.0D AS energy_consumed_wh,"
        " 1.0D AS current_power_kw FROM VALUES ('c'), ('new') AS t(id)"
    )
    rows = feature_rows(with_charger_history(asked, charger_history(history)), "leftover").collect()
    assert {r["charger_id"]: r["charger_max_energy_wh"] for r in rows} == {"c": None, "new": 150.0}


def test_charger_history_collapses_in_a_hash_table(spark):
    rows = [("S2", "C1", 2, 5.0, 1.0), ("S3", "C1", 1, 9.0, 2.0), ("S1", "C1", 1, 7.0, None), (None, "C2", 3, None, None), ("S9", "C2", 4, 1.0, 4.0)]
    schema = "charging_station_id string, charger_id string, timestamp int, charger_max_energy_wh double, charger_mean_energy_wh double"
    history = rq.charger_history(spark.createDataFrame(rows, schema))
    plan = history._jdf.queryExecution().executedPlan().toString()
    assert "HashAggregate(keys=[charger_id" in plan and plan.count("partial_min_by") == 1
    assert plan.index("partial_min_by") < plan.rindex("HashAggregate(keys=[charger_id")
    got = {r.charger_id: (r._charger_max_energy_wh, r._charger_mean_energy_wh, r._station_id) for r in history.collect()}
    assert got == {"C1": (9.0, 1.5, "S1"), "C2": (1.0, 4.0, None)}
