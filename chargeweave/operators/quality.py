"""Data-quality reports, each from one aggregation over the table."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from chargeweave.functions.measures import MISSING_SENTINEL
from chargeweave.operators.order_stats import quantiles
from chargeweave.schemas import CHARGER, SPLIT, STATION

SIGNED_COLUMNS = ("hour_sin", "hour_cos")


def numeric_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, T.NumericType)]


def _per_column(df: DataFrame, columns: list[str], facts: dict[str, Column | None]) -> DataFrame:
    """Turn a one-row frame with ``<fact>_<i>`` columns into one row per column."""
    rows = [
        F.struct(
            F.lit(c).alias("column"),
            *[F.col(f"{fact}_{i}").alias(fact) for fact in facts],
            F.col("_total").alias("rows"),
        )
        for i, c in enumerate(columns)
    ]
    return df.select(F.inline(F.array(*rows)))


def null_report(df: DataFrame) -> DataFrame:
    """Nulls and their percentage per column."""
    columns = df.columns
    counts = df.agg(
        F.count(F.lit(1)).alias("_total"),
        *[F.count_if(F.col(c).isNull()).alias(f"nulls_{i}") for i, c in enumerate(columns)],
    )
    report = _per_column(counts, columns, {"nulls": None})
    share = F.try_divide(F.col("nulls") * F.lit(100.0), F.col("rows"))
    return report.select("column", "nulls", share.alias("null_pct"))


def describe(df: DataFrame, columns: list[str]) -> DataFrame:
    """Count, mean, minimum and maximum per column."""
    measures = {"values": F.count, "mean": F.avg, "min": F.min, "max": F.max}
    wide = df.agg(
        F.count(F.lit(1)).alias("_total"),
        *[
            fn(F.col(c).cast("double")).alias(f"{fact}_{i}")
            for i, c in enumerate(columns)
            for fact, fn in measures.items()
        ],
    )
    return _per_column(wide, columns, dict.fromkeys(measures)).drop("rows")


def value_counts(df: DataFrame, column: str) -> DataFrame:
    """Rows and percentage per value."""
    counts = df.groupBy(column).agg(F.count(F.lit(1)).alias("rows"))
    total = counts.agg(F.sum("rows").alias("_total"))
    share = F.col("rows") * F.lit(100.0) / F.col("_total")
    return counts.crossJoin(F.broadcast(total)).withColumn("pct", share).drop("_total")


def negative_report(df: DataFrame) -> DataFrame:
    """Unexpected negatives per numeric column: below zero but not the missing sentinel."""
    columns = [c for c in numeric_columns(df) if c not in SIGNED_COLUMNS]
    wide = df.agg(
        F.count(F.lit(1)).alias("_total"),
        *[
            (F.count_if(F.col(c) < 0) - F.count_if(F.col(c) == MISSING_SENTINEL)).alias(f"negatives_{i}")
            for i, c in enumerate(columns)
        ],
    )
    return _per_column(wide, columns, {"negatives": None}).drop("rows")


def duplicate_count(df: DataFrame) -> DataFrame:
    """Repeats after the first of every identical row; copies collapse before the shuffle."""
    groups = df.groupBy(*df.columns).agg(F.count(F.lit(1)).alias("_copies"))
    return groups.agg(F.coalesce(F.sum(F.col("_copies") - 1), F.lit(0)).alias("duplicates"))


def diversity(df: DataFrame, approximate: bool = False) -> DataFrame:
    """Distinct stations and chargers."""
    count = F.approx_count_distinct if approximate else F.countDistinct
    return df.agg(count(STATION).alias("stations"), count(CHARGER).alias("chargers"))


def shape(df: DataFrame) -> DataFrame:
    return df.agg(F.count(F.lit(1)).alias("rows")).withColumn("columns", F.lit(len(df.columns)))


def idle_share(df: DataFrame) -> DataFrame:
    return df.agg(
        F.sum("is_idle_charger").alias("idle_rows"),
        F.count(F.lit(1)).alias("rows"),
        (F.avg("is_idle_charger") * F.lit(100.0)).alias("idle_pct"),
    )


def target_by_split(df: DataFrame, target: str) -> DataFrame:
    return df.groupBy(SPLIT).agg(F.avg(target).alias("mean_target"))


def target_report(df: DataFrame, target: str) -> DataFrame:
    """Description of a target column with its exact median."""
    median = quantiles(df, [target], 0.5)[target]
    return describe(df, [target]).withColumn("median", F.lit(median))


def inspect(df: DataFrame, name: str) -> DataFrame:
    """Whole quality report of a table as (table, check, item, value) rows."""

    def part(report: DataFrame, check: str, item: Column, value: str) -> DataFrame:
        return report.select(
            F.lit(name).alias("table"),
            F.lit(check).alias("check"),
            item.alias("item"),
            F.col(value).cast("bigint").alias("value"),
        )

    counts = shape(df)
    parts = [
        part(counts, "shape", F.lit("rows"), "rows"),
        part(counts, "shape", F.lit("columns"), "columns"),
        part(null_report(df), "nulls", F.col("column"), "nulls"),
        part(negative_report(df), "negatives", F.col("column"), "negatives"),
        part(duplicate_count(df), "duplicates", F.lit("rows"), "duplicates"),
    ]
    if SPLIT in df.columns:
        parts.append(part(value_counts(df, SPLIT), "split", F.col(SPLIT), "rows"))
    return reduce(DataFrame.unionByName, parts)
