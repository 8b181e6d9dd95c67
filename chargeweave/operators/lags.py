"""Lagged and rolling station features.

A plain window per station would put a hot station into one task. The window therefore runs per (station, hour); each such chunk first receives the up to six snapshots that
precede it, taken from the tails of the station's earlier chunks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chargeweave.functions.timefeat import minute_number
from chargeweave.schemas import PERIOD, STATION, TS
from chargeweave.session import stage

HALO = 6
SHORT, LONG = 3, 6
_CARRIED = ["active_chargers", "total_power_kw"]


def _lag_columns(keys: list[str]) -> dict[str, Column]:
    by_time = Window.partitionBy(*keys).orderBy(TS)

    def mean_of_previous(n: int) -> Column:
        # the mean of the lagged series over n rows ending here = the mean of the n rows before
        return F.avg("active_chargers").over(by_time.rowsBetween(-n, -1))

    before = by_time.rowsBetween(-LONG, -1)
    return {
        "lag_1_active": F.lag("active_chargers", 1).over(by_time),
        "lag_2_active": F.lag("active_chargers", 2).over(by_time),
        "lag_1_power_kw": F.lag("total_power_kw", 1).over(by_time),
        "roll_3_active": mean_of_previous(SHORT),
        "roll_6_active": mean_of_previous(LONG),
        "_own_sum": F.sum("active_chargers").over(before),
        "_own_count": F.count("active_chargers").over(before),
        "_own_rows": F.least(F.row_number().over(by_time), F.lit(LONG)),
    }


def _with_halo(df: DataFrame, keys: list[str]) -> DataFrame:
    """Cut every series into hours and add to each hour the snapshots just before it."""
    chunked = df.withColumn("_chunk", F.floor(minute_number(F.col(TS)) / 60))
    row = F.struct(TS, *_CARRIED)
    newest = Window.partitionBy(*keys, "_chunk").orderBy(F.desc(TS))
    tails = (
        chunked.select(*keys, "_chunk", TS, row.alias("_row"))
        .withColumn("_nth", F.row_number().over(newest))
        .where(F.col("_nth") <= HALO)
    )
    by_time = Window.partitionBy(*keys).orderBy(TS)
    starts = tails.select(
        *keys,
        "_chunk",
        F.lag("_chunk").over(by_time).alias("_chunk_before"),
        F.collect_list("_row").over(by_time.rowsBetween(-HALO, -1)).alias("_rows"),
    ).where("_chunk_before < _chunk")
    halo = starts.select(*keys, "_chunk", F.explode("_rows").alias("_row")).select(
        *keys, "_chunk", "_row.*", F.lit(True).alias("_is_halo")
    )
    return chunked.withColumn("_is_halo", F.lit(False)).unionByName(halo, allowMissingColumns=True)


def _lagged(df: DataFrame, keys: list[str]) -> DataFrame:
    chunks = _with_halo(df, keys).withColumns(_lag_columns([*keys, "_chunk"]))
    return chunks.where(~F.col("_is_halo")).drop("_is_halo", "_chunk")


def lag_features(
    snapshots: DataFrame, partition_by_period: bool = False
) -> DataFrame:
    """Lags 1 and 2 of active chargers, lag 1 of power, and rolling means over 3 and 6 snapshots.

    Lags cross the gaps between collection windows unless ``partition_by_period``.
    """
    keys = [STATION, PERIOD] if partition_by_period else [STATION]
    lagged = _lagged(snapshots, keys)
    return lagged.drop("_own_sum", "_own_count", "_own_rows")


def _carried(tails: DataFrame, parts: int | None) -> DataFrame:
    """charging_station_id, _previous: the last values before each station, over all stations before it.

    Stations are dealt to ranges of ids. Inside a range a window looks back; what comes from the
    ranges before is the last ``LONG - 1`` values of each range, which the driver chains: one short
    list per range, however many stations there are.
    """
    reach = LONG - 1
    ranged = tails.repartitionByRange(STATION) if parts is None else tails.repartitionByRange(parts, STATION)
    placed = stage(ranged.withColumn("_part", F.spark_partition_id()), "tails")
    by_station = Window.partitionBy("_part").orderBy(STATION)
    upto = F.flatten(F.collect_list("_tail").over(by_station.rowsBetween(-reach, 0)))
    last = placed.select(STATION, "_part", upto.alias("_upto")).groupBy("_part")
    chained, lists = [], []
    for row in last.agg(F.max_by("_upto", STATION).alias("_upto")).orderBy("_part").collect():
        lists.append((row["_part"], chained))
        chained = [*chained, *row["_upto"]][-reach:]
    spark = tails.sparkSession
    carry = spark.createDataFrame(lists, "_part int, _carry array<bigint>")
    before = F.flatten(F.collect_list("_tail").over(by_station.rowsBetween(-reach, -1)))
    return (
        placed.withColumn("_before", before)
        .join(carry, "_part")
        .select(STATION, F.concat("_carry", "_before").alias("_previous"))
    )


def lag_features_unbroken(snapshots: DataFrame, parts: int | None = None) -> DataFrame:
    """Variant whose six-row mean runs on over the previous stations, in order of their ids.

    Only the first rows of a station reach back, so the lagged series' last five values of every
    station, one small row each, are enough to complete them. ``parts`` ranges of stations are
    worked apart; the figures do not depend on it.
    """
    lagged = stage(_lagged(snapshots, [STATION]), "lagged")
    newest = Window.partitionBy(STATION).orderBy(F.desc(TS))
    reach = LONG - 1
    tails = (
        lagged.select(STATION, TS, "lag_1_active")
        .withColumn("_nth", F.row_number().over(newest))
        .where(F.col("_nth") <= reach)
        .groupBy(STATION)
        .agg(F.array_sort(F.collect_list(F.struct(TS, "lag_1_active"))).alias("_tail"))
        .select(STATION, F.col("_tail.lag_1_active").cast("array<bigint>").alias("_tail"))
    )
    previous = _carried(tails, parts)
    missing = F.lit(LONG) - F.col("_own_rows")
    size = F.size("_previous")
    reached = F.when(
        (missing > 0) & (size > 0),
        F.slice("_previous", size - F.least(missing, size) + 1, F.least(missing, size)),
    ).otherwise(F.array().cast("array<bigint>"))
    known = F.filter(reached, lambda x: x.isNotNull())
    extra = F.aggregate(known, F.lit(0).cast("bigint"), lambda acc, x: acc + x)
    total = F.coalesce(F.col("_own_sum"), F.lit(0)) + extra
    return (
        lagged.join(previous, STATION, "left")
        .withColumn("roll_6_active", F.try_divide(total, F.col("_own_count") + F.size(known)))
        .drop("_own_sum", "_own_count", "_own_rows", "_previous")
    )


def drop_incomplete(df: DataFrame) -> DataFrame:
    """Drop rows with any NULL, i.e. the first snapshots of every station."""
    return df.na.drop("any")
