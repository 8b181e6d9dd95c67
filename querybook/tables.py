"""Feature tables, splits, aggregates, joins and windows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chargeweave.operators import aggregates as agg
from chargeweave.operators import lags, splits
from chargeweave.plans import features
from chargeweave.schemas import CHARGER, ENERGY, STATION, TS
from chargeweave.session import stage
from querybook.ingest import TIME
from querybook.lake import Lake
from querybook.registry import query

KEY = "charging_station_id charger_id timestamp"
STATION_STATS = (
    "station_mean_energy_wh:f station_median_energy_wh:f station_mean_power_kw:f "
    "station_max_power_kw:f station_charger_count:i"
)
CHARGER_STATS = "charger_mean_energy_wh:f charger_median_energy_wh:f"
LAGS = "lag_1_active:f lag_2_active:f lag_1_power_kw:f roll_3_active:f roll_6_active:f"
ENERGY_TABLE = (
    f"{KEY} split collection_period:i {TIME} is_late_night:i avg_pwr_kw:f active_session_count:i "
    f"is_idle_charger:i {STATION_STATS} {CHARGER_STATS} max_energy_wh:f"
)
SOC_TABLE = (
    f"{KEY} split collection_period:i {TIME} avg_pwr_kw:f is_idle_charger:i max_energy_wh:f soc_pct:f"
)
CONGESTION_TABLE = (
    f"charging_station_id timestamp active_chargers:i total_chargers:i total_power_kw:f {TIME} "
    f"collection_period:i {LAGS} split"
)
DEMAND_TABLE = (
    "charging_station_id total_chargers:i active_chargers:i utilization_rate:f "
    "avg_energy_per_charger:f peak_power_kw:f station_avg_hourly_demand:f "
    f"station_peak_hourly_demand:f {TIME} collection_period:i split timestamp total_energy_wh:f"
)
LEFTOVER_TABLE = (
    f"charging_station_id charger_id {TIME} collection_period:i avg_pwr_kw:f active_session_count:i "
    "is_idle_charger:i max_energy_wh:f charger_max_energy_wh:f charger_mean_energy_wh:f "
    "estimated_capacity_wh:f split timestamp leftover_energy_wh:f"
)


@query("energy_features", ENERGY_TABLE, "SELECT * FROM energy_features", uncapped=True)
def energy(lake: Lake) -> DataFrame:
    return features.energy_features(lake.charger_base)


@query("soc_features", SOC_TABLE, "SELECT * FROM soc_features", uncapped=True)
def soc(lake: Lake) -> DataFrame:
    return features.soc_features(lake.cleaned)


@query("congestion_features", CONGESTION_TABLE, "SELECT * FROM congestion_features", uncapped=True)
def congestion(lake: Lake) -> DataFrame:
    return features.congestion_features(lake.cleaned)


@query("congestion_features_unbroken", CONGESTION_TABLE, "SELECT * FROM congestion_unbroken")
def congestion_unbroken(lake: Lake) -> DataFrame:
    return features.congestion_features(lake.cleaned, unbroken_rolling=True)


@query("demand_features", DEMAND_TABLE, "SELECT * FROM demand_features", uncapped=True)
def demand(lake: Lake) -> DataFrame:
    return features.demand_features(lake.cleaned)


@query("leftover_features", LEFTOVER_TABLE, "SELECT * FROM leftover_features", uncapped=True)
def leftover(lake: Lake) -> DataFrame:
    return features.leftover_features(lake.cleaned)


@query(
    "charger_base",
    f"{KEY} avg_pwr_kw:f max_energy_wh:f active_session_count:i soc_pct:f {TIME} collection_period:i "
    "is_late_night:i estimated_capacity_wh:f leftover_energy_wh:f power_to_energy_ratio:f "
    "station_mean_energy_wh:f station_mean_power_kw:f",
    "SELECT * FROM charger_base",
    uncapped=True,
)
def base(lake: Lake) -> DataFrame:
    return features.charger_base(lake.cleaned)


@query(
    "legacy_energy_features",
    f"{KEY} split collection_period:i {TIME} is_late_night:i period_hour_interaction:i avg_pwr_kw:f "
    f"active_session_count:i power_to_energy_ratio:f {STATION_STATS} station_std_energy_wh:f "
    "charger_mean_energy_wh:f charger_max_energy_wh:f charger_mean_power_kw:f "
    "estimated_capacity_wh:f leftover_energy_wh:f max_energy_wh:f",
    "SELECT * FROM legacy_features",
)
def legacy(lake: Lake) -> DataFrame:
    return features.legacy_features(lake.legacy_cleaned)


# -- aggregates --------------------------------------------------------------------------------

SNAPSHOT = "charging_station_id timestamp active_chargers:i total_chargers:i total_power_kw:f"


@query("a1_station_snapshots", f"{SNAPSHOT} {TIME} collection_period:i", "SELECT * FROM snapshots", uncapped=True)
def a1(lake: Lake) -> DataFrame:
    return agg.station_snapshots(lake.cleaned)


@query(
    "a1_station_snapshots_daily",
    SNAPSHOT,
    """SELECT charging_station_id, date_trunc('day', "timestamp") AS "timestamp",
      count(*) FILTER (WHERE avg_pwr_kw > 0) AS active_chargers, count(charger_id) AS total_chargers,
      sum(avg_pwr_kw) AS total_power_kw FROM cleaned GROUP BY 1, 2""",
    uncapped=True,
)
def a1_daily(lake: Lake) -> DataFrame:
    return agg.station_snapshots(lake.cleaned, every="day")


@query(
    "a2_demand_snapshots",
    "charging_station_id timestamp total_energy_wh:f total_chargers:i active_chargers:i "
    f"avg_energy_per_charger:f peak_power_kw:f {TIME} collection_period:i utilization_rate:f",
    "SELECT * FROM demand",
    uncapped=True,
)
def a2(lake: Lake) -> DataFrame:
    return agg.demand_snapshots(lake.cleaned)


def _train(lake: Lake) -> DataFrame:
    return agg.train_rows(splits.period_time_split(lake.cleaned))


@query("a3_station_stats", f"charging_station_id {STATION_STATS}", "SELECT * FROM station_stats", uncapped=True)
def a3(lake: Lake) -> DataFrame:
    return agg.station_stats(_train(lake))


@query("a3_station_stats_narrowed", f"charging_station_id {STATION_STATS}", "SELECT * FROM station_stats")
def a3_narrowed(lake: Lake) -> DataFrame:
    """The medians as found beyond small inputs."""
    return agg.station_stats(_train(lake))


@query("a4_charger_stats", f"charger_id {CHARGER_STATS}", "SELECT * FROM charger_stats", uncapped=True)
def a4(lake: Lake) -> DataFrame:
    return agg.charger_stats(_train(lake))


@query("a5_station_demand", "charging_station_id station_avg_hourly_demand:f station_peak_hourly_demand:f", "SELECT * FROM demand_stats", uncapped=True)
def a5(lake: Lake) -> DataFrame:
    labelled = splits.period_time_split(agg.demand_snapshots(lake.cleaned), [STATION])
    return agg.station_demand_stats(agg.train_rows(labelled))


@query("a6_charger_peaks", "charger_id charger_max_energy_wh:f charger_mean_energy_wh:f", "SELECT * FROM charger_peaks", uncapped=True)
def a6(lake: Lake) -> DataFrame:
    return agg.charger_peak_stats(_train(lake))


@query("a7_legacy_station_stats", f"charging_station_id {STATION_STATS} station_std_energy_wh:f", "SELECT * FROM legacy_stations")
def a7(lake: Lake) -> DataFrame:
    return agg.legacy_station_stats(lake.legacy_cleaned)


@query("a7_legacy_charger_stats", "charger_id charger_mean_energy_wh:f charger_max_energy_wh:f charger_mean_power_kw:f", "SELECT * FROM legacy_chargers")
def a7_chargers(lake: Lake) -> DataFrame:
    return agg.legacy_charger_stats(lake.legacy_cleaned)


@query(
    "a8_train_aggregates",
    "charging_station_id mean_energy:f peak_power:f readings:i",
    """SELECT charging_station_id, avg(max_energy_wh) AS mean_energy, max(avg_pwr_kw) AS peak_power,
      count(*) AS readings FROM labelled WHERE split = 'train' GROUP BY 1""",
)
def a8(lake: Lake) -> DataFrame:
    wanted = {
        "mean_energy": F.avg(ENERGY),
        "peak_power": F.max("avg_pwr_kw"),
        "readings": F.count(F.lit(1)),
    }
    return agg.train_aggregates(_train(lake), STATION, wanted)


# -- joins -------------------------------------------------------------------------------------


@query(
    "j1_attach_station_stats",
    f"{KEY} split {STATION_STATS}",
    "SELECT * FROM labelled LEFT JOIN station_stats USING (charging_station_id)",
)
def j1(lake: Lake) -> DataFrame:
    labelled = splits.period_time_split(lake.cleaned)
    return agg.attach(labelled, agg.station_stats(agg.train_rows(labelled)), STATION)


@query(
    "j2_attach_charger_stats",
    f"{KEY} split {CHARGER_STATS}",
    "SELECT * FROM labelled LEFT JOIN charger_stats USING (charger_id)",
)
def j2(lake: Lake) -> DataFrame:
    labelled = splits.period_time_split(lake.cleaned)
    return agg.attach(labelled, agg.charger_stats(agg.train_rows(labelled)), CHARGER)


@query(
    "j3_attach_full_table_stats",
    f"{KEY} station_std_energy_wh:f charger_max_energy_wh:f",
    """SELECT * FROM legacy_cleaned LEFT JOIN legacy_stations USING (charging_station_id)
    LEFT JOIN legacy_chargers USING (charger_id)""",
)
def j3(lake: Lake) -> DataFrame:
    rows = agg.attach(lake.legacy_cleaned, agg.legacy_station_stats(lake.legacy_cleaned), STATION)
    return agg.attach(rows, agg.legacy_charger_stats(lake.legacy_cleaned), CHARGER)


@query(
    "j4_unseen_keys",
    "split unseen_rows:i rows:i",
    """SELECT split, count(*) FILTER (WHERE charger_max_energy_wh IS NULL) AS unseen_rows,
      count(*) AS rows FROM leftover_features GROUP BY 1""",
)
def j4(lake: Lake) -> DataFrame:
    return agg.unseen_keys(lake.features("leftover"), "charger_max_energy_wh")


# -- windows and splits ------------------------------------------------------------------------


@query("w1_lags", "charging_station_id timestamp lag_1_active:f lag_2_active:f lag_1_power_kw:f", "SELECT * FROM lagged", uncapped=True)
def w1(lake: Lake) -> DataFrame:
    return lags.lag_features(agg.station_snapshots(lake.cleaned))


@query("w1_lags_in_chunks", f"charging_station_id timestamp {LAGS}", "SELECT * FROM lagged")
def w1_chunks(lake: Lake) -> DataFrame:
    """The way taken beyond small inputs: the window runs per station and hour."""
    return lags.lag_features(agg.station_snapshots(lake.cleaned))


@query(
    "w1_lags_within_period",
    f"charging_station_id timestamp {LAGS}",
    """SELECT charging_station_id, "timestamp", lag(active_chargers, 1) OVER w AS lag_1_active,
      lag(active_chargers, 2) OVER w AS lag_2_active, lag(total_power_kw, 1) OVER w AS lag_1_power_kw,
      avg(active_chargers) OVER (w ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING) AS roll_3_active,
      avg(active_chargers) OVER (w ROWS BETWEEN 6 PRECEDING AND 1 PRECEDING) AS roll_6_active
    FROM snapshots WINDOW w AS (PARTITION BY charging_station_id, collection_period ORDER BY "timestamp")""",
    uncapped=True,
)
def w1_period(lake: Lake) -> DataFrame:
    return lags.lag_features(agg.station_snapshots(lake.cleaned), partition_by_period=True)


@query("w2_rolling_means", "charging_station_id timestamp roll_3_active:f roll_6_active:f", "SELECT * FROM lagged", uncapped=True)
def w2(lake: Lake) -> DataFrame:
    return lags.lag_features(agg.station_snapshots(lake.cleaned))


@query("w2_rolling_means_unbroken", "charging_station_id timestamp roll_6_active:f", "SELECT * FROM lagged_unbroken", uncapped=True)
def w2_unbroken(lake: Lake) -> DataFrame:
    return lags.lag_features_unbroken(agg.station_snapshots(lake.cleaned))


@query("w4_period_time_split", f"{KEY} collection_period:i split", "SELECT * FROM labelled", uncapped=True)
def w4(lake: Lake) -> DataFrame:
    return splits.period_time_split(lake.cleaned)


@query("w5_station_split", "charging_station_id timestamp collection_period:i split", "SELECT * FROM congestion_features", uncapped=True)
def w5(lake: Lake) -> DataFrame:
    rows = stage(lags.drop_incomplete(lags.lag_features(agg.station_snapshots(lake.cleaned))), "complete")
    return splits.period_time_split(rows, [STATION], other_periods="train")


@query("w6_time_split", f"{KEY} split", "SELECT * FROM soc_features", uncapped=True)
def w6(lake: Lake) -> DataFrame:
    return splits.time_split(lake.cleaned.na.drop(subset=["soc_pct"]))


@query(
    "w7_third_period_split",
    f"{KEY} collection_period:i split",
    """SELECT *, CASE WHEN _p < 3 OR _nth <= floor(_n * CAST(0.7 AS DOUBLE)) THEN 'train'
      WHEN _nth <= floor(_n * (CAST(0.7 AS DOUBLE) + (1 - CAST(0.7 AS DOUBLE)) / 2)) THEN 'val'
      ELSE 'test' END AS split
    FROM (SELECT *, row_number() OVER (PARTITION BY _p ORDER BY "timestamp", charging_station_id, charger_id) AS _nth,
      count(*) OVER (PARTITION BY _p) AS _n
      FROM (SELECT *, dense_rank() OVER (ORDER BY collection_period) AS _p FROM cleaned)) WHERE _p <= 3""",
)
def w7(lake: Lake) -> DataFrame:
    return splits.third_period_split(lake.cleaned, train_share=0.7)


@query(
    "w8_random_split_sizes",
    "split rows:i",
    """SELECT s.split, CASE s.split WHEN 'train' THEN a WHEN 'val' THEN b ELSE n - a - b END AS rows
    FROM (SELECT count(*) AS n, floor(count(*) * CAST(0.8 AS DOUBLE)) AS a,
      floor(count(*) * CAST(0.1 AS DOUBLE)) AS b FROM energy_features),
      (VALUES ('train'), ('val'), ('test')) AS s(split)""",
)
def w8(lake: Lake) -> DataFrame:
    return splits.split_sizes(splits.random_split(lake.features("energy"), [STATION, CHARGER, TS]))


_HASHED = """md5(concat_ws('|', '42', charging_station_id, charger_id, CAST("timestamp" AS VARCHAR)))"""


@query(
    "w8_random_split_labels",
    f"{KEY} split",
    f"""SELECT charging_station_id, charger_id, "timestamp",
      CASE WHEN nth <= a THEN 'train' WHEN nth <= a + b THEN 'val' ELSE 'test' END AS split
    FROM (SELECT *, row_number() OVER (ORDER BY {_HASHED}, charging_station_id, charger_id, "timestamp") AS nth,
      floor(count(*) OVER () * CAST(0.8 AS DOUBLE)) AS a, floor(count(*) OVER () * CAST(0.1 AS DOUBLE)) AS b
      FROM energy_features)""",
)
def w8_labels(lake: Lake) -> DataFrame:
    return splits.random_split(lake.features("energy"), [STATION, CHARGER, TS])


@query(
    "w9_first_per_key",
    "charger_id first_station first_timestamp",
    """SELECT charger_id, st AS first_station, t AS first_timestamp FROM charger_history
    JOIN (SELECT charger_id, min("timestamp") AS t FROM leftover_features GROUP BY 1) USING (charger_id)""",
)
def w9(lake: Lake) -> DataFrame:
    rows = lake.features("leftover")
    return rows.groupBy(CHARGER).agg(
        F.min_by(STATION, F.struct(TS, STATION)).alias("first_station"),
        F.min(TS).alias("first_timestamp"),
    )


@query(
    "w10_seeded_sample",
    f"{KEY} max_energy_wh:f",
    f"""SELECT * FROM energy_features
    ORDER BY {_HASHED}, charging_station_id, charger_id, "timestamp" LIMIT 500""",
)
def w10(lake: Lake) -> DataFrame:
    return splits.seeded_sample(lake.features("energy"), [STATION, CHARGER, TS], n=500)
