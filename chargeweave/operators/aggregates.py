"""Station snapshots, per-key statistics and their joins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chargeweave.functions import measures
from chargeweave.operators.order_stats import grouped_quantile
from chargeweave.operators.splits import only
from chargeweave.schemas import CHARGER, ENERGY, PERIOD, POWER, SPLIT, STATION, TIME_COLUMNS, TS


def active_count(power: Column) -> Column:
    """How many rows draw power."""
    return F.count_if(power > 0)


def _snapshot(df: DataFrame, every: str | None) -> tuple[DataFrame, list[Column]]:
    if every is not None:
        df = df.withColumn(TS, F.date_trunc(every, TS).cast("timestamp_ntz"))
    # constant within a snapshot
    carried = [F.min(c).alias(c) for c in [*TIME_COLUMNS, PERIOD]]
    return df.na.drop(subset=[STATION, TS]), carried


def station_snapshots(df: DataFrame, every: str | None = None) -> DataFrame:
    """Active chargers, charger rows and power of a station at one timestamp (or per ``every``)."""
    rows, carried = _snapshot(df, every)
    return rows.groupBy(STATION, TS).agg(
        active_count(F.col(POWER)).alias("active_chargers"),
        F.count(CHARGER).alias("total_chargers"),
        F.coalesce(F.sum(POWER), F.lit(0.0)).alias("total_power_kw"),
        *carried,
    )


def demand_snapshots(df: DataFrame, every: str | None = None) -> DataFrame:
    """Energy demand of a station at one timestamp (or per ``every``)."""
    rows, carried = _snapshot(df, every)
    snapshots = rows.groupBy(STATION, TS).agg(
        F.coalesce(F.sum(ENERGY), F.lit(0.0)).alias("total_energy_wh"),
        F.count(CHARGER).alias("total_chargers"),
        active_count(F.col(POWER)).alias("active_chargers"),
        F.avg(ENERGY).alias("avg_energy_per_charger"),
        F.max(POWER).alias("peak_power_kw"),
        *carried,
    )
    rate = measures.utilization_rate(F.col("active_chargers"), F.col("total_chargers"))
    return snapshots.withColumn("utilization_rate", rate)


def _with_median(df: DataFrame, key: str, alias: str, aggregates: list[Column]) -> DataFrame:
    """Group by ``key`` with the exact median of the energy among the aggregates."""
    rows = df.where(F.col(key).isNotNull())
    basic = rows.groupBy(key).agg(*aggregates)
    return basic.join(grouped_quantile(rows, [key], ENERGY, 0.5, alias), key, "left")


def station_stats(df: DataFrame) -> DataFrame:
    """Mean, median, power and distinct chargers per station; pass the train rows only."""
    aggregates = [
        F.avg(ENERGY).alias("station_mean_energy_wh"),
        F.avg(POWER).alias("station_mean_power_kw"),
        F.max(POWER).alias("station_max_power_kw"),
        F.countDistinct(CHARGER).alias("station_charger_count"),
    ]
    return _with_median(df, STATION, "station_median_energy_wh", aggregates)


def charger_stats(df: DataFrame) -> DataFrame:
    """Mean and median energy per charger; pass the train rows only."""
    aggregates = [F.avg(ENERGY).alias("charger_mean_energy_wh")]
    return _with_median(df, CHARGER, "charger_median_energy_wh", aggregates)


def station_demand_stats(snapshots: DataFrame) -> DataFrame:
    return snapshots.groupBy(STATION).agg(
        F.avg("total_energy_wh").alias("station_avg_hourly_demand"),
        F.max("total_energy_wh").alias("station_peak_hourly_demand"),
    )


def charger_peak_stats(df: DataFrame) -> DataFrame:
    return df.groupBy(CHARGER).agg(
        F.max(ENERGY).alias("charger_max_energy_wh"),
        F.avg(ENERGY).alias("charger_mean_energy_wh"),
    )


def legacy_station_stats(df: DataFrame) -> DataFrame:
    """Full-table station statistics of the legacy variant, with the sample standard deviation."""
    aggregates = [
        F.avg(ENERGY).alias("station_mean_energy_wh"),
        F.stddev_samp(ENERGY).alias("station_std_energy_wh"),
        F.avg(POWER).alias("station_mean_power_kw"),
        F.max(POWER).alias("station_max_power_kw"),
        F.countDistinct(CHARGER).alias("station_charger_count"),
    ]
    return _with_median(df, STATION, "station_median_energy_wh", aggregates)


def legacy_charger_stats(df: DataFrame) -> DataFrame:
    return df.groupBy(CHARGER).agg(
        F.avg(ENERGY).alias("charger_mean_energy_wh"),
        F.max(ENERGY).alias("charger_max_energy_wh"),
        F.avg(POWER).alias("charger_mean_power_kw"),
    )


def train_aggregates(train: DataFrame, key: str, aggregates: dict[str, Column]) -> DataFrame:
    """Named aggregates of the train rows per ``key``."""
    rows = train.where(F.col(key).isNotNull())
    return rows.groupBy(key).agg(*[expr.alias(name) for name, expr in aggregates.items()])


def attach(df: DataFrame, stats: DataFrame, key: str) -> DataFrame:
    """Left join of per-key statistics, replacing columns of the same name.

    No broadcast hint: Spark broadcasts ``stats`` when its measured size allows, and otherwise
    AQE splits the partitions of hot keys.
    """
    new = [c for c in stats.columns if c != key]
    return df.drop(*new).join(stats, key, "left")


def unseen_keys(df: DataFrame, indicator: str) -> DataFrame:
    """Rows per split whose key has no train statistics."""
    return df.groupBy(SPLIT).agg(
        F.count_if(F.col(indicator).isNull()).alias("unseen_rows"),
        F.count(F.lit(1)).alias("rows"),
    )


def train_rows(df: DataFrame) -> DataFrame:
    return only(df, "train")
