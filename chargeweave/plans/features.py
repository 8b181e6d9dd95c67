"""The feature tables of the five products, the charger base table and the legacy variant.

Each builder takes the cleaned table (best a written one: finding split cuts reads it a few times)
and returns a plan with the product's column contract. With ``staged`` (the default) statistics per
station and charger are written first, so Spark knows their true size when it plans the join: it
broadcasts them if they are small and otherwise shuffles, with AQE splitting hot keys.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chargeweave.functions import measures
from chargeweave.functions.timefeat import is_late_night
from chargeweave.operators import aggregates as agg
from chargeweave.operators.lags import drop_incomplete, lag_features, lag_features_unbroken
from chargeweave.operators.splits import period_time_split, time_split
from chargeweave.schemas import (
    CHARGER,
    CHARGER_BASE,
    CONGESTION_FEATURES,
    DEMAND_FEATURES,
    ENERGY,
    ENERGY_FEATURES,
    LEFTOVER_FEATURES,
    LEGACY_INPUTS,
    PERIOD,
    POWER,
    SOC,
    SOC_FEATURES,
    SPLIT,
    STATION,
    TS,
)
from chargeweave.session import stage

# Columns derived from the energy target, and statistics over future rows.
LEAKED = ["estimated_capacity_wh", "leftover_energy_wh", "power_to_energy_ratio"]
FULL_TABLE_STATS = ["station_mean_energy_wh", "station_mean_power_kw"]


def add_idle_flag(df: DataFrame) -> DataFrame:
    return df.withColumn("is_idle_charger", measures.idle_flag(F.col(POWER)))


def add_capacity(df: DataFrame) -> DataFrame:
    df = df.withColumn("estimated_capacity_wh", measures.capacity(F.col("charger_max_energy_wh")))
    left = measures.leftover(F.col("estimated_capacity_wh"), F.col(ENERGY))
    return df.withColumn("leftover_energy_wh", left)


def add_row_features(df: DataFrame) -> DataFrame:
    return df.withColumns(
        {
            "is_late_night": is_late_night(F.col("hour")),
            "power_to_energy_ratio": measures.power_to_energy(F.col(POWER), F.col(ENERGY)),
            "period_hour_interaction": measures.period_hour(F.col(PERIOD), F.col("hour")),
        }
    )


def _stats(table: DataFrame, label: str, staged: bool) -> DataFrame:
    return stage(table, label) if staged else table


def charger_base(cleaned: DataFrame, staged: bool = True) -> DataFrame:
    """Cleaned readings with capacity, leftover and full-table station means."""
    stations = cleaned.groupBy(STATION).agg(
        F.avg(ENERGY).alias("station_mean_energy_wh"), F.avg(POWER).alias("station_mean_power_kw")
    )
    peaks = agg.charger_peak_stats(cleaned).drop("charger_mean_energy_wh")
    base = agg.attach(cleaned, _stats(stations, "station_means", staged), STATION)
    base = agg.attach(base, _stats(peaks, "charger_peaks", staged), CHARGER)
    return add_capacity(add_row_features(base)).select(*CHARGER_BASE)


def energy_features(base: DataFrame, staged: bool = True) -> DataFrame:
    """Readings with leaked columns removed, idle flag, split and train-only statistics."""
    safe = base.drop(*LEAKED, SOC, *FULL_TABLE_STATS)
    safe = add_idle_flag(safe).withColumn("is_late_night", is_late_night(F.col("hour")))
    labelled = period_time_split(safe)
    train = agg.train_rows(labelled)
    stations = _stats(agg.station_stats(train), "station_stats", staged)
    chargers = _stats(agg.charger_stats(train), "charger_stats", staged)
    with_station = agg.attach(labelled, stations, STATION)
    return agg.attach(with_station, chargers, CHARGER).select(*ENERGY_FEATURES)


def soc_features(cleaned: DataFrame) -> DataFrame:
    """Readings with a known state of charge, cut by time over the whole table."""
    known = add_idle_flag(cleaned.na.drop(subset=[SOC]))
    return time_split(known).select(*SOC_FEATURES)


def congestion_features(
    cleaned: DataFrame,
    unbroken_rolling: bool = False,
    partition_by_period: bool = False,
    every: str | None = None,
    staged: bool = True,
) -> DataFrame:
    """Station snapshots with lags; incomplete rows dropped; periods other than 3 stay in train.

    The lagged snapshots are staged: finding the cuts and labelling then only scan them.
    """
    snapshots = agg.station_snapshots(cleaned, every)
    if staged:
        # the chunked lags read the snapshots twice
        snapshots = stage(snapshots, "station_snapshots")
    if unbroken_rolling:
        lagged = lag_features_unbroken(snapshots)
    else:
        lagged = lag_features(snapshots, partition_by_period)
    complete = drop_incomplete(lagged)
    if staged:
        complete = stage(complete, "complete_snapshots")
    return period_time_split(complete, [STATION], other_periods="train").select(*CONGESTION_FEATURES)


def demand_features(
    cleaned: DataFrame, every: str | None = None, staged: bool = True
) -> DataFrame:
    """Station demand snapshots with train-only mean and peak demand."""
    snapshots = agg.demand_snapshots(cleaned, every)
    if staged:
        snapshots = stage(snapshots, "demand_snapshots")
    labelled = period_time_split(snapshots, [STATION])
    stats = _stats(agg.station_demand_stats(agg.train_rows(labelled)), "demand_stats", staged)
    return agg.attach(labelled, stats, STATION).select(*DEMAND_FEATURES)


def leftover_features(cleaned: DataFrame, staged: bool = True) -> DataFrame:
    """Readings with train-only charger peaks and the unused capacity as target."""
    labelled = period_time_split(add_idle_flag(cleaned.drop(SOC)))
    stats = _stats(agg.charger_peak_stats(agg.train_rows(labelled)), "charger_peaks", staged)
    return add_capacity(agg.attach(labelled, stats, CHARGER)).select(*LEFTOVER_FEATURES)


def legacy_features(legacy_cleaned: DataFrame, staged: bool = True) -> DataFrame:
    """Legacy variant: row features plus statistics over all rows, including future ones."""
    rows = add_row_features(legacy_cleaned)
    stations = _stats(agg.legacy_station_stats(legacy_cleaned), "legacy_stations", staged)
    chargers = _stats(agg.legacy_charger_stats(legacy_cleaned), "legacy_chargers", staged)
    rows = agg.attach(agg.attach(rows, stations, STATION), chargers, CHARGER)
    return period_time_split(add_capacity(rows)).select(
        *LEGACY_INPUTS, SPLIT, TS, ENERGY, "leftover_energy_wh"
    )


BUILDERS = {
    "energy": energy_features,
    "soc": soc_features,
    "congestion": congestion_features,
    "demand": demand_features,
    "leftover": leftover_features,
}
