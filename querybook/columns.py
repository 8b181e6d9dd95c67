"""Scalar expressions over the cleaned readings, the snapshots and the requests."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chargeweave.functions import measures, timefeat
from chargeweave.operators.aggregates import attach, charger_peak_stats
from chargeweave.plans.features import add_capacity
from chargeweave.plans.models import fill_missing
from chargeweave.schemas import CHARGER
from querybook.lake import Lake
from querybook.registry import query

KEY = "charging_station_id charger_id timestamp"
EVENT = "event_id:i"


@query(
    "c4_calendar_fields",
    f"{EVENT} hour:i day_of_week:i month:i is_weekend:i",
    """SELECT event_id, hour(ts) AS hour, isodow(ts) - 1 AS day_of_week, month(ts) AS month,
    CAST(isodow(ts) >= 6 AS INT) AS is_weekend FROM events""",
)
def c4(lake: Lake) -> DataFrame:
    return lake.table("events").withColumns(timefeat.time_columns(F.col("ts")))


@query("c5_late_night", f"{EVENT} is_late_night:i", "SELECT event_id, CAST(hour(ts) >= 2 AS INT) AS is_late_night FROM events")
def c5(lake: Lake) -> DataFrame:
    return lake.table("events").withColumn("is_late_night", timefeat.is_late_night(F.hour("ts")))


@query(
    "c6_cyclic_hour",
    f"{EVENT} hour_sin:r9 hour_cos:r9",
    "SELECT event_id, sin(2 * pi() * hour(ts) / 24) AS hour_sin, cos(2 * pi() * hour(ts) / 24) AS hour_cos FROM events",
)
def c6(lake: Lake) -> DataFrame:
    hour = F.hour("ts")
    return lake.table("events").withColumns(
        {"hour_sin": timefeat.hour_sin(hour), "hour_cos": timefeat.hour_cos(hour)}
    )


@query(
    "c7_cyclic_hour_rounded",
    f"{EVENT} hour_sin:r4 hour_cos:r4",
    "SELECT event_id, sin(2 * pi() * hour(ts) / 24) AS hour_sin, cos(2 * pi() * hour(ts) / 24) AS hour_cos FROM events",
)
def c7(lake: Lake) -> DataFrame:
    hour = F.hour("ts")
    return lake.table("events").withColumns(
        {"hour_sin": timefeat.hour_sin(hour, 4), "hour_cos": timefeat.hour_cos(hour, 4)}
    )


@query("c8_idle_flag", f"{KEY} is_idle_charger:i", "SELECT * FROM flagged")
def c8(lake: Lake) -> DataFrame:
    return lake.cleaned.withColumn("is_idle_charger", measures.idle_flag(F.col("avg_pwr_kw")))


@query(
    "c9_idle_by_sessions",
    f"{KEY} is_idle_charger:i",
    """SELECT *, CAST(coalesce(active_session_count = 0, false) OR coalesce(soc_pct = 0, false) AS INT)
    AS is_idle_charger FROM raw""",
)
def c9(lake: Lake) -> DataFrame:
    flag = measures.idle_by_sessions(F.col("active_session_count"), F.col("soc_pct"))
    return lake.raw.withColumn("is_idle_charger", flag)


@query("c10_utilization_rate", "charging_station_id timestamp utilization_rate:f", "SELECT * FROM demand")
def c10(lake: Lake) -> DataFrame:
    rows = lake.features("demand")
    rate = measures.utilization_rate(F.col("active_chargers"), F.col("total_chargers"))
    return rows.withColumn("utilization_rate", rate)


@query("c11_estimated_capacity", f"{KEY} estimated_capacity_wh:f", "SELECT * FROM charger_base")
def c11(lake: Lake) -> DataFrame:
    return add_capacity(attach(lake.cleaned, charger_peak_stats(lake.cleaned), CHARGER))


@query("c12_leftover_clip", f"{KEY} leftover_energy_wh:f", "SELECT * FROM leftover_features")
def c12(lake: Lake) -> DataFrame:
    rows = lake.features("leftover")
    left = measures.leftover(F.col("estimated_capacity_wh"), F.col("max_energy_wh"))
    return rows.withColumn("leftover_energy_wh", left)


@query(
    "c13_power_to_energy",
    f"{KEY} power_to_energy_ratio:f",
    "SELECT *, CASE WHEN max_energy_wh > 0 THEN avg_pwr_kw / (max_energy_wh / 1000) END AS power_to_energy_ratio FROM cleaned",
)
def c13(lake: Lake) -> DataFrame:
    ratio = measures.power_to_energy(F.col("avg_pwr_kw"), F.col("max_energy_wh"))
    return lake.cleaned.withColumn("power_to_energy_ratio", ratio)


@query(
    "c14_period_hour",
    f"{KEY} period_hour_interaction:i",
    "SELECT *, collection_period * 10 + hour AS period_hour_interaction FROM cleaned",
)
def c14(lake: Lake) -> DataFrame:
    value = measures.period_hour(F.col("collection_period"), F.col("hour"))
    return lake.cleaned.withColumn("period_hour_interaction", value)


@query(
    "c16_missing_sentinel",
    f"{KEY} charger_max_energy_wh:f charger_mean_energy_wh:f estimated_capacity_wh:f",
    f"""SELECT {KEY.replace(' ', ', ').replace('timestamp', '"timestamp"')},
    coalesce(charger_max_energy_wh, -999) AS charger_max_energy_wh,
    coalesce(charger_mean_energy_wh, -999) AS charger_mean_energy_wh,
    coalesce(estimated_capacity_wh, -999) AS estimated_capacity_wh FROM leftover_features""",
)
def c16(lake: Lake) -> DataFrame:
    rows = lake.features("leftover")
    return fill_missing(rows, [c for c in rows.columns if c != "leftover_energy_wh"])


@query(
    "c17_log_target",
    f"{KEY} log_energy:f energy_back:f",
    "SELECT *, ln(1 + max_energy_wh) AS log_energy, max_energy_wh AS energy_back FROM cleaned",
)
def c17(lake: Lake) -> DataFrame:
    log = measures.log_target(F.col("max_energy_wh"))
    return lake.cleaned.withColumn("log_energy", log).withColumn(
        "energy_back", F.round(measures.from_log_target(F.col("log_energy")), 6)
    )


@query(
    "c18_clamp",
    f"{EVENT} unbounded:f percent:f up_to_total:f",
    """SELECT event_id, CASE WHEN value - 50 < 0 THEN 0 ELSE value - 50 END AS unbounded,
    CASE WHEN value * 2 - 50 < 0 THEN 0 WHEN value * 2 - 50 > 100 THEN 100 ELSE value * 2 - 50 END AS percent,
    CASE WHEN value / 10 - 2 < 0 THEN 0 WHEN value / 10 - 2 > event_id % 5 THEN event_id % 5
      ELSE value / 10 - 2 END AS up_to_total FROM events""",
)
def c18(lake: Lake) -> DataFrame:
    value = F.col("value")
    total = (F.col("event_id") % 5).cast("double")
    return lake.table("events").select(
        "event_id",
        measures.clamp(value - 50, 0.0, None).alias("unbounded"),
        measures.clamp(value * 2 - 50, 0.0, 100.0).alias("percent"),
        measures.clamp(value / 10 - 2, 0.0, total).alias("up_to_total"),
    )


@query("c19_wh_to_kwh", f"{KEY} energy_kwh:f", "SELECT *, max_energy_wh / 1000 AS energy_kwh FROM cleaned")
def c19(lake: Lake) -> DataFrame:
    return lake.cleaned.withColumn("energy_kwh", measures.to_kilo(F.col("max_energy_wh")))


@query(
    "c20_occupancy_pct",
    "charging_station_id timestamp occupancy_pct:f occupancy_band",
    """SELECT *, CASE WHEN occupancy_pct > 80 THEN 'high' WHEN occupancy_pct < 30 THEN 'open' END AS occupancy_band
    FROM (SELECT *, CASE WHEN total_chargers > 0 THEN active_chargers / CAST(total_chargers AS DOUBLE) * 100
      ELSE 0 END AS occupancy_pct FROM snapshots)""",
)
def c20(lake: Lake) -> DataFrame:
    from chargeweave.operators.aggregates import station_snapshots

    pct = measures.percent_of(F.col("active_chargers"), F.col("total_chargers"))
    rows = station_snapshots(lake.cleaned).withColumn("occupancy_pct", pct)
    return rows.withColumn("occupancy_band", measures.occupancy_band(F.col("occupancy_pct")))


@query(
    "c21_utilization_pct",
    f"{KEY} utilization_pct:f session_band",
    """SELECT *, CASE WHEN utilization_pct > 90 THEN 'nearly complete' WHEN utilization_pct > 50 THEN 'in progress'
      ELSE 'early' END AS session_band
    FROM (SELECT *, CASE WHEN estimated_capacity_wh > 0 THEN max_energy_wh / estimated_capacity_wh * 100
      ELSE 0 END AS utilization_pct FROM leftover_features)""",
)
def c21(lake: Lake) -> DataFrame:
    pct = measures.percent_of(F.col("max_energy_wh"), F.col("estimated_capacity_wh"))
    rows = lake.features("leftover").withColumn("utilization_pct", pct)
    return rows.withColumn("session_band", measures.session_band(F.col("utilization_pct")))


@query(
    "c22_demand_per_charger",
    "charging_station_id timestamp avg_per_charger_wh:f ratio_to_history:f",
    """SELECT *, CASE WHEN total_chargers > 0 THEN total_energy_wh / total_chargers ELSE 0 END AS avg_per_charger_wh,
    CASE WHEN station_avg_hourly_demand > 0 THEN total_energy_wh / station_avg_hourly_demand END AS ratio_to_history
    FROM demand_features""",
)
def c22(lake: Lake) -> DataFrame:
    total, mean = F.col("total_energy_wh"), F.col("station_avg_hourly_demand")
    return lake.features("demand").withColumns(
        {
            "avg_per_charger_wh": measures.per_unit(total, F.col("total_chargers")),
            "ratio_to_history": measures.ratio_to_history(total, mean),
        }
    )


@query(
    "c23_ratio_to_history",
    "charging_station_id timestamp ratio_to_history:f",
    """SELECT *, CASE WHEN station_avg_hourly_demand > 0 THEN total_energy_wh / station_avg_hourly_demand END
    AS ratio_to_history FROM demand_features""",
)
def c23(lake: Lake) -> DataFrame:
    return c22(lake)


@query(
    "c24_occupancy_band",
    "charging_station_id timestamp occupancy_band",
    """SELECT *, CASE WHEN 100.0 * active_chargers / total_chargers > 80 THEN 'high'
      WHEN 100.0 * active_chargers / total_chargers < 30 THEN 'open' END AS occupancy_band FROM snapshots""",
)
def c24(lake: Lake) -> DataFrame:
    return c20(lake)


@query(
    "c25_session_band",
    f"{KEY} session_band",
    """SELECT *, CASE WHEN estimated_capacity_wh > 0 AND max_energy_wh / estimated_capacity_wh * 100 > 90 THEN 'nearly complete'
      WHEN estimated_capacity_wh > 0 AND max_energy_wh / estimated_capacity_wh * 100 > 50 THEN 'in progress'
      ELSE 'early' END AS session_band FROM leftover_features""",
)
def c25(lake: Lake) -> DataFrame:
    return c21(lake)


@query(
    "c26_provisional_note",
    "charging_station_id timestamp note",
    f"""SELECT *, CASE WHEN lag_1_active = 0 AND lag_2_active = 0 AND lag_1_power_kw = 0 AND roll_3_active = 0
      AND roll_6_active = 0 THEN '{measures.PROVISIONAL_NOTE}' END AS note FROM complete""",
)
def c26(lake: Lake) -> DataFrame:
    from chargeweave.schemas import LAG_COLUMNS

    note = measures.provisional_note([F.col(c) for c in LAG_COLUMNS])
    return lake.features("congestion").withColumn("note", note)


@query(
    "c27_sessions_at_scoring",
    "request_id:i active_session_count:i collection_period:i",
    """SELECT request_id, CAST(coalesce(power_kw > 0, false) AS INT) AS active_session_count,
    3 AS collection_period FROM requests""",
)
def c27(lake: Lake) -> DataFrame:
    return lake.requests.select(
        "request_id",
        measures.sessions_from_power(F.col("power_kw")).alias("active_session_count"),
        F.lit(timefeat.SCORING_PERIOD).alias("collection_period"),
    )


@query("c28_scoring_period", "request_id:i collection_period:i", "SELECT request_id, 3 AS collection_period FROM requests")
def c28(lake: Lake) -> DataFrame:
    return lake.requests.select("request_id", F.lit(timefeat.SCORING_PERIOD).alias("collection_period"))
