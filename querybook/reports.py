"""Quality reports, metrics and chart data."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chargeweave.operators import evaluation, quality
from chargeweave.schemas import CLEANED, ENERGY_FEATURES, PRODUCTS
from querybook.ingest import METRICS, METRICS_SQL
from querybook.lake import Lake
from querybook.registry import query

_ENERGY_COLUMNS = ENERGY_FEATURES
_TEXT = {"charging_station_id", "charger_id", "timestamp", "split"}


def _null_sql(table: str, columns: list[str]) -> str:
    return " UNION ALL ".join(
        f"""SELECT '{c}' AS "column", count(*) FILTER (WHERE "{c}" IS NULL) AS nulls,
        count(*) FILTER (WHERE "{c}" IS NULL) * CAST(100 AS DOUBLE) / count(*) AS null_pct FROM {table}"""
        for c in columns
    )


_CLEANED_COLUMNS = CLEANED


@query("a10_null_report", "column nulls:i null_pct:r6", _null_sql("cleaned", _CLEANED_COLUMNS))
def a10(lake: Lake) -> DataFrame:
    return quality.null_report(lake.cleaned)


@query("a10_null_report_energy", "column nulls:i null_pct:r6", _null_sql("energy_features", _ENERGY_COLUMNS))
def a10_energy(lake: Lake) -> DataFrame:
    return quality.null_report(lake.features("energy"))


@query(
    "a11_describe",
    "column values:i mean:f min:f max:f",
    " UNION ALL ".join(
        f"""SELECT '{c}' AS "column", count({c}) AS "values", avg({c}) AS mean, min({c}) AS min,
        max({c}) AS max FROM cleaned"""
        for c in ("avg_pwr_kw", "max_energy_wh")
    ),
)
def a11(lake: Lake) -> DataFrame:
    return quality.describe(lake.cleaned, ["avg_pwr_kw", "max_energy_wh"])


@query(
    "a11_target_report",
    "column values:i mean:f median:f min:f max:f",
    """SELECT 'total_energy_wh' AS "column", count(total_energy_wh) AS "values", avg(total_energy_wh) AS mean,
    median(total_energy_wh) AS median, min(total_energy_wh) AS min, max(total_energy_wh) AS max FROM demand_features""",
)
def a11_target(lake: Lake) -> DataFrame:
    return quality.target_report(lake.features("demand"), "total_energy_wh")


@query(
    "a12_period_counts",
    "collection_period:i rows:i pct:r6",
    """SELECT collection_period, count(*) AS rows,
    count(*) * CAST(100 AS DOUBLE) / sum(count(*)) OVER () AS pct FROM cleaned GROUP BY 1""",
)
def a12(lake: Lake) -> DataFrame:
    return quality.value_counts(lake.cleaned, "collection_period")


@query(
    "a12_split_counts",
    "split rows:i pct:r6",
    """SELECT split, count(*) AS rows,
    count(*) * CAST(100 AS DOUBLE) / sum(count(*)) OVER () AS pct FROM congestion_features GROUP BY 1""",
)
def a12_split(lake: Lake) -> DataFrame:
    return quality.value_counts(lake.features("congestion"), "split")


@query(
    "a14_idle_share",
    "idle_rows:i rows:i idle_pct:r6",
    """SELECT sum(is_idle_charger) AS idle_rows, count(*) AS rows,
    avg(is_idle_charger) * 100 AS idle_pct FROM flagged""",
)
def a14(lake: Lake) -> DataFrame:
    return quality.idle_share(lake.features("leftover"))


@query(
    "a15_target_by_split",
    "split mean_target:f",
    "SELECT split, avg(leftover_energy_wh) AS mean_target FROM leftover_features GROUP BY 1",
)
def a15(lake: Lake) -> DataFrame:
    return quality.target_by_split(lake.features("leftover"), "leftover_energy_wh")


def _baseline(lake: Lake) -> DataFrame:
    return lake.features("energy").where("split = 'test'")


@query("a16_regression_metrics", "model rmse:f mae:f r2:f test_rows:i", METRICS_SQL.format(model="station mean", table="predicted"))
def a16(lake: Lake) -> DataFrame:
    return evaluation.regression_metrics(
        _baseline(lake), "max_energy_wh", "station_mean_energy_wh", "station mean"
    )


@query("a17_mape", "model mape:f", METRICS_SQL.format(model="station mean", table="predicted"))
def a17(lake: Lake) -> DataFrame:
    return a16(lake).select("model", "mape")


_BASELINES = {
    "energy": ("energy_features", "max_energy_wh", "station_mean_energy_wh"),
    "demand": ("demand_features", "total_energy_wh", "station_avg_hourly_demand"),
    "congestion": ("congestion_features", "active_chargers", "lag_1_active"),
}


@query(
    "a18_model_comparison",
    METRICS,
    " UNION ALL ".join(
        METRICS_SQL.format(
            model=name, table=f"(SELECT {y} AS y, {p} AS p FROM {table} WHERE split = 'test')"
        )
        for name, (table, y, p) in _BASELINES.items()
    ),
)
def a18(lake: Lake) -> DataFrame:
    return evaluation.compare_models(
        [
            evaluation.regression_metrics(lake.features(name).where("split = 'test'"), y, p, name)
            for name, (_, y, p) in _BASELINES.items()
        ]
    )


_SIGNED = {"hour_sin", "hour_cos"}
_RAW_NUMBERS = ["avg_pwr_kw", "max_energy_wh", "active_session_count", "soc_pct"]


def _negative_sql(table: str, columns: list[str]) -> str:
    return " UNION ALL ".join(
        f"""SELECT '{c}' AS "column", count(*) FILTER (WHERE "{c}" < 0) - count(*) FILTER (WHERE "{c}" = -999)
        AS negatives FROM {table}"""
        for c in columns
        if c not in _SIGNED and c not in _TEXT
    )


@query("a19_negatives", "column negatives:i", _negative_sql("raw", _RAW_NUMBERS))
def a19(lake: Lake) -> DataFrame:
    return quality.negative_report(lake.raw)


@query("a20_shape", "rows:i columns:i", "SELECT count(*) AS rows, 14 AS columns FROM cleaned")
def a20(lake: Lake) -> DataFrame:
    return quality.shape(lake.cleaned)


@query(
    "m8_actual_vs_predicted",
    "actual:f predicted:f axis_min:f axis_max:f",
    """SELECT y AS actual, p AS predicted, 0 AS axis_min, greatest(my, mp) AS axis_max
    FROM predicted, (SELECT max(y) AS my, max(p) AS mp FROM predicted)""",
)
def m8(lake: Lake) -> DataFrame:
    return evaluation.actual_vs_predicted(
        _baseline(lake), "max_energy_wh", "station_mean_energy_wh", None
    )


@query(
    "m9_residual_histogram",
    "bin:i rows:i",
    """SELECT least(floor((e - lo) / (hi - lo) * 80), 79) + 1 AS bin, count(*) AS rows
    FROM (SELECT y - p AS e FROM predicted),
      (SELECT min(y - p) AS lo, max(y - p) AS hi FROM predicted) WHERE e IS NOT NULL GROUP BY 1""",
)
def m9(lake: Lake) -> DataFrame:
    return evaluation.residual_histogram(_baseline(lake), "max_energy_wh", "station_mean_energy_wh")


def _inspect_sql(name: str, table: str, columns: list[str]) -> str:
    numbers = [c for c in columns if c not in _TEXT and c not in _SIGNED]
    listed = ", ".join(f'"{c}"' for c in columns)
    parts = [
        f"SELECT 'shape' AS \"check\", 'rows' AS item, count(*) AS value FROM {table}",
        f"SELECT 'shape', 'columns', {len(columns)}",
        f"SELECT 'nulls', \"column\", nulls FROM ({_null_sql(table, columns)})",
        f"SELECT 'negatives', \"column\", negatives FROM ({_negative_sql(table, numbers)})",
        f"""SELECT 'duplicates', 'rows', (SELECT count(*) FROM {table})
        - (SELECT count(*) FROM (SELECT DISTINCT {listed} FROM {table}))""",
    ]
    if "split" in columns:
        parts.append(f"SELECT 'split', split, count(*) FROM {table} GROUP BY split")
    return f"SELECT '{name}' AS \"table\", * FROM ({' UNION ALL '.join(parts)})"


_INSPECTED = {
    "raw": ("raw", _CLEANED_COLUMNS[:7]),
    "cleaned": ("cleaned", _CLEANED_COLUMNS),
    **{name: (f"{name}_features", product.contract) for name, product in PRODUCTS.items()},
}


@query(
    "m11_inspect_tables",
    "table check item value:i",
    " UNION ALL ".join(_inspect_sql(n, t, c) for n, (t, c) in _INSPECTED.items()),
)
def m11_inspect(lake: Lake) -> DataFrame:
    """All seven tables of the verification run."""
    tables = {"raw": lake.raw, "cleaned": lake.cleaned, **{name: lake.features(name) for name in PRODUCTS}}
    return reduce(DataFrame.unionByName, [quality.inspect(t, n) for n, t in tables.items()])
