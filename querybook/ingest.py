"""Sources, sinks, projections and field mapping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from chargeweave.operators.evaluation import regression_metrics
from chargeweave.schemas import HIT_FIELD_NAMES, PERIOD, RAW_SCHEMA, STATION, TS
from chargeweave.session import new_folder, stage
from chargeweave.sources import telemetry
from querybook.lake import Lake
from querybook.registry import query

READING = (
    "charging_station_id charger_id timestamp avg_pwr_kw:f max_energy_wh:f "
    "active_session_count:i soc_pct:f"
)
TIME = "hour:i day_of_week:i month:i is_weekend:i hour_sin:r4 hour_cos:r4"
CLEANED = f"{READING} {TIME} collection_period:i"


@query("s1_read_csv", READING, "SELECT * FROM raw")
def s1(lake: Lake) -> DataFrame:
    path = new_folder(lake.spark, "csv")
    telemetry.write_table(lake.raw, path, format="csv")
    columns = lake.raw.columns
    schema = T.StructType([RAW_SCHEMA[c] for c in columns])
    from chargeweave.operators.cleaning import prepare_readings

    return prepare_readings(telemetry.read_csv(lake.spark, path, schema))


@query("s2_read_table", CLEANED, "SELECT * FROM cleaned")
def s2(lake: Lake) -> DataFrame:
    path = new_folder(lake.spark, "table")
    telemetry.write_table(lake.cleaned, path)
    return telemetry.read_table(lake.spark, path)


@query(
    "s3_extract_range",
    READING,
    """SELECT * FROM raw WHERE "timestamp" >= TIMESTAMP '1997-02-01' AND "timestamp" < TIMESTAMP '1998-05-01'""",
)
def s3(lake: Lake) -> DataFrame:
    return telemetry.extract(lake.raw, "1997-02-01", "1998-05-01")


@query(
    "s4_search_hits",
    "charging_station_id charger_id timestamp avg_pwr_kw:f max_energy_wh:f",
    "SELECT * FROM raw",
)
def s4(lake: Lake) -> DataFrame:
    """Readings exported as search responses, one per line, then flattened again."""
    back = {new: old for old, new in HIT_FIELD_NAMES.items()}
    at = F.date_format("timestamp", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("timestamp")
    source = F.struct("station_id", "charger_id", at, "power_kw", "energy_wh")
    hit = F.struct(source.alias("_source"))
    document = F.struct(F.struct(F.array(hit).alias("hits")).alias("hits"))
    path = new_folder(lake.spark, "hits")
    lake.raw.withColumnsRenamed(back).select(F.to_json(document).alias("value")).write.text(path)
    return telemetry.read_search_hits(lake.spark, path, multi_line=False)


@query(
    "s5_field_names",
    "charging_station_id charger_id timestamp avg_pwr_kw:f max_energy_wh:f",
    "SELECT * FROM raw",
)
def s5(lake: Lake) -> DataFrame:
    exported = lake.raw.selectExpr(
        "charging_station_id AS station_id", "charger_id", "timestamp",
        "avg_pwr_kw AS power_kw", "max_energy_wh AS energy_wh",
    )
    return telemetry.map_field_names(exported)


@query(
    "s6_merge_periods",
    READING,
    """SELECT * REPLACE (CASE WHEN month("timestamp") = 12 THEN NULL ELSE soc_pct END AS soc_pct) FROM raw""",
)
def s6(lake: Lake) -> DataFrame:
    """Three period extracts, the second of them without the state of charge."""
    month = F.month(TS)
    first, second = (lake.raw.where(month == m) for m in (11, 12))
    third = lake.raw.where(F.coalesce(~month.isin(11, 12), F.lit(True)))
    return telemetry.merge_periods([first, second.drop("soc_pct"), third])


@query("s7_write_by_period", CLEANED, "SELECT * FROM cleaned WHERE collection_period = 2")
def s7(lake: Lake) -> DataFrame:
    path = new_folder(lake.spark, "by_period")
    telemetry.write_table(lake.cleaned, path, partition_by=[PERIOD])
    return telemetry.read_table(lake.spark, path).where(F.col(PERIOD) == 2)


METRICS = "model rmse:f mae:f r2:f mape:f test_rows:i"
METRICS_SQL = """SELECT '{model}' AS model, sqrt(avg((y - p) * (y - p))) AS rmse, avg(abs(y - p)) AS mae,
    1 - sum((y - p) * (y - p)) / sum((y - m) * (y - m)) AS r2,
    avg(CASE WHEN y > 0 THEN abs((y - p) / y) END) * 100 AS mape, count(*) AS test_rows
    FROM {table}, (SELECT avg(y) AS m FROM {table})"""


@query(
    "s8_metrics_sink",
    METRICS,
    METRICS_SQL.format(model="station mean", table="predicted")
    + " UNION ALL "
    + METRICS_SQL.format(model="station mean again", table="predicted"),
)
def s8(lake: Lake) -> DataFrame:
    test = lake.features("energy").where("split = 'test'")
    path = new_folder(lake.spark, "metrics")
    for name in ("station mean", "station mean again"):
        report = regression_metrics(test, "max_energy_wh", "station_mean_energy_wh", name)
        telemetry.append_metrics(report, path)
    return telemetry.read_metrics(lake.spark, path)


@query("f7_drop_columns", "charging_station_id charger_id timestamp avg_pwr_kw:f max_energy_wh:f hour:i is_late_night:i", "SELECT * FROM charger_base")
def f7(lake: Lake) -> DataFrame:
    from chargeweave.plans.features import FULL_TABLE_STATS, LEAKED

    return lake.charger_base.drop(*LEAKED, "soc_pct", *FULL_TABLE_STATS, "no_such_column")


@query("f8_select_contract", f"charging_station_id charger_id timestamp collection_period:i {TIME}", "SELECT * FROM cleaned")
def f8(lake: Lake) -> DataFrame:
    return lake.cleaned.select(STATION, "charger_id", TS, PERIOD, *[c.partition(":")[0] for c in TIME.split()])


@query("f10_period_membership", CLEANED, "SELECT * FROM cleaned WHERE collection_period IN (1, 2)")
def f10(lake: Lake) -> DataFrame:
    return lake.cleaned.where(F.col(PERIOD).isin(1, 2))


@query(
    "f11_point_lookup",
    "request_id:i station_id is_known:i total_chargers:f",
    """SELECT r.request_id, r.station_id, CAST(s.station_id IS NOT NULL AS INT) AS is_known,
      s.size AS total_chargers FROM congestion_requests AS r LEFT JOIN station_sizes AS s USING (station_id)""",
)
def f11(lake: Lake) -> DataFrame:
    from chargeweave.plans.requests import station_sizes, valid_requests

    asked = valid_requests(lake.requests, "congestion").drop("total_chargers")
    found = asked.join(station_sizes(lake.features("congestion")), "station_id", "left")
    known = F.col("_total_chargers").isNotNull().cast("int")
    return found.withColumns({"is_known": known, "total_chargers": F.col("_total_chargers")})


@query("u1_concat_splits", f"charging_station_id charger_id timestamp {TIME} split", "SELECT * FROM labelled")
def u1(lake: Lake) -> DataFrame:
    rows = lake.features("leftover")
    parts = [rows.where(F.col("split") == s) for s in ("train", "val", "test")]
    return telemetry.merge_periods(parts)


@query("o1_sort_station_time", CLEANED, "SELECT * FROM cleaned ORDER BY charging_station_id, \"timestamp\"")
def o1(lake: Lake) -> DataFrame:
    return lake.cleaned.orderBy(STATION, TS)


@query("o2_sort_by_energy", READING, "SELECT * FROM legacy_unique ORDER BY max_energy_wh DESC NULLS LAST")
def o2(lake: Lake) -> DataFrame:
    from chargeweave.operators.cleaning import resolve_by_max_energy

    return resolve_by_max_energy(lake.unique).orderBy(
        F.desc_nulls_last("max_energy_wh"), STATION, TS, "charger_id"
    )
