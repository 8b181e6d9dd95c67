"""Cleaning steps, duplicates and their audit."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chargeweave.operators import cleaning, quality
from chargeweave.operators.lags import drop_incomplete, lag_features
from chargeweave.operators.aggregates import station_snapshots
from chargeweave.operators.order_stats import order_statistics
from chargeweave.operators.quarantine import VERDICTS
from chargeweave.schemas import PERIOD
from querybook.ingest import CLEANED, READING
from querybook.lake import Lake
from querybook.registry import query

# session counts are still fractional means here
MEANS = READING.replace("active_session_count:i", "active_session_count:f")


@query("d1_exact_dedup", READING, "SELECT * FROM uniq")
def d1(lake: Lake) -> DataFrame:
    return lake.unique


@query("d2_near_dup_mean", MEANS, "SELECT * FROM resolved")
def d2(lake: Lake) -> DataFrame:
    return lake.resolved


@query("d3_near_dup_keep_max", READING, "SELECT * FROM legacy_unique")
def d3(lake: Lake) -> DataFrame:
    return cleaning.resolve_by_max_energy(lake.unique)


@query("d4_duplicate_count", "duplicates:i", "SELECT (SELECT count(*) FROM raw) - (SELECT count(*) FROM uniq) AS duplicates")
def d4(lake: Lake) -> DataFrame:
    return quality.duplicate_count(lake.raw)


@query(
    "d5_distinct_ids",
    "stations:i chargers:i",
    "SELECT count(DISTINCT charging_station_id) AS stations, count(DISTINCT charger_id) AS chargers FROM cleaned",
)
def d5(lake: Lake) -> DataFrame:
    return quality.diversity(lake.cleaned)


@query("d6_period_list", "collection_period:i", "SELECT DISTINCT collection_period FROM cleaned")
def d6(lake: Lake) -> DataFrame:
    return lake.cleaned.select(PERIOD).distinct().orderBy(PERIOD)


@query("f1_drop_invalid", MEANS, "SELECT * FROM valid")
def f1(lake: Lake) -> DataFrame:
    return cleaning.drop_invalid(lake.resolved)


@query("f2_drop_outliers", MEANS, "SELECT * FROM inliers")
def f2(lake: Lake) -> DataFrame:
    return lake.inliers


@query("f3_drop_dead", MEANS, "SELECT * FROM alive")
def f3(lake: Lake) -> DataFrame:
    return cleaning.drop_dead(lake.inliers)


@query("f4_drop_sessionless", MEANS, "SELECT * FROM in_session")
def f4(lake: Lake) -> DataFrame:
    return lake.in_session


@query("f5_drop_null_target", CLEANED, "SELECT * FROM cleaned WHERE soc_pct IS NOT NULL")
def f5(lake: Lake) -> DataFrame:
    return lake.cleaned.na.drop(subset=["soc_pct"])


@query(
    "f6_drop_incomplete",
    "charging_station_id timestamp active_chargers:i lag_1_active:i lag_2_active:i roll_3_active:f",
    "SELECT * FROM complete",
)
def f6(lake: Lake) -> DataFrame:
    return drop_incomplete(lag_features(station_snapshots(lake.cleaned)))


@query("w3_station_cap", CLEANED, "SELECT * FROM cleaned")
def w3(lake: Lake) -> DataFrame:
    return cleaning.cap_stations(cleaning.fix_types(lake.in_session))


@query("clean_all_steps", CLEANED, "SELECT * FROM cleaned")
def clean_all(lake: Lake) -> DataFrame:
    return cleaning.clean(lake.raw)


@query("legacy_clean_all_steps", CLEANED, "SELECT * FROM legacy_cleaned")
def legacy_clean_all(lake: Lake) -> DataFrame:
    return cleaning.clean_legacy(lake.raw)


@query(
    "c15_clip_upper",
    READING,
    """SELECT * REPLACE (CASE WHEN avg_pwr_kw > p995 THEN p995 ELSE avg_pwr_kw END AS avg_pwr_kw,
      CASE WHEN max_energy_wh > e995 THEN e995 ELSE max_energy_wh END AS max_energy_wh)
    FROM legacy_kept, legacy_limits""",
)
def c15(lake: Lake) -> DataFrame:
    return cleaning.clip_upper(lake.legacy_kept)


@query(
    "a9_exact_quantiles",
    "metric q:r3 value:f",
    """SELECT 'max_energy_wh' AS metric, 0.99 AS q, e99 AS value FROM limits
    UNION ALL SELECT 'avg_pwr_kw', 0.99, p99 FROM limits
    UNION ALL SELECT 'max_energy_wh', 0.995, quantile_cont(max_energy_wh, 0.995) FROM valid
    UNION ALL SELECT 'avg_pwr_kw', 0.995, quantile_cont(avg_pwr_kw, 0.995) FROM valid""",
)
def a9(lake: Lake) -> DataFrame:
    """Both quantiles of both metrics from the same scans."""
    qs = [cleaning.OUTLIER_QUANTILE, cleaning.LEGACY_CLIP_QUANTILE]
    found = order_statistics(lake.valid, {"max_energy_wh": qs, "avg_pwr_kw": qs})
    rows = [(c, q, v) for (c, q), v in found.items()]
    return lake.spark.createDataFrame(rows, "metric string, q double, value double")


@query(
    "a9_exact_quantiles_narrowed",
    "metric value:f",
    """SELECT 'max_energy_wh' AS metric, e99 AS value FROM limits
    UNION ALL SELECT 'avg_pwr_kw', p99 FROM limits""",
)
def a9_narrowed(lake: Lake) -> DataFrame:
    limits = cleaning.outlier_limits(lake.valid)
    return lake.spark.createDataFrame(list(limits.items()), "metric string, value double")


_LEFT = {
    "exact duplicates": ("raw", "uniq"),
    "near duplicates": ("uniq", "resolved"),
    "invalid": ("resolved", "valid"),
    "outliers": ("valid", "inliers"),
    "dead rows": ("inliers", "alive"),
    "no session": ("alive", "in_session"),
    "types": ("in_session", "typed"),
    "station cap": ("typed", "cleaned"),
}
_AUDIT_SQL = " UNION ALL ".join(
    f"""SELECT {i} AS step, '{name}' AS name, (SELECT count(*) FROM {a}) AS rows_in,
      (SELECT count(*) FROM {b}) AS rows_left"""
    for i, (name, (a, b)) in enumerate(_LEFT.items(), start=1)
)


@query(
    "a13_step_audit",
    "step:i name rows_in:i removed:i rows_left:i removed_pct:r6",
    f"""SELECT *, rows_in - rows_left AS removed,
      (rows_in - rows_left) * CAST(100 AS DOUBLE) / rows_in AS removed_pct FROM ({_AUDIT_SQL})""",
)
def a13(lake: Lake) -> DataFrame:
    return cleaning.audit(lake.raw, cleaning.outlier_limits(lake.valid))


@query(
    "c1_parse_timestamp",
    "timestamp rows:i",
    'SELECT "timestamp", count(*) AS rows FROM raw GROUP BY 1',
)
def c1(lake: Lake) -> DataFrame:
    """ISO text with a zone, as delivered, to zone-free UTC."""
    text = lake.raw.select(F.date_format("timestamp", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("timestamp"))
    from chargeweave.functions.timefeat import utc_timestamp

    return text.groupBy(utc_timestamp(F.col("timestamp")).alias("timestamp")).agg(
        F.count(F.lit(1)).alias("rows")
    )


@query(
    "c2_truncate_to_int",
    "charging_station_id charger_id timestamp active_session_count:i hour:i month:i",
    "SELECT * FROM typed",
)
def c2(lake: Lake) -> DataFrame:
    return cleaning.fix_types(lake.in_session)


@query(
    "c3_period_label",
    "month:i collection_period:i rows:i",
    "SELECT month, collection_period, count(*) AS rows FROM typed GROUP BY 1, 2",
)
def c3(lake: Lake) -> DataFrame:
    typed = cleaning.fix_types(lake.in_session)
    return typed.groupBy("month", PERIOD).agg(F.count(F.lit(1)).alias("rows"))


@query("c2_quarantine", f"{MEANS} verdict", "SELECT * FROM faulty_verdicts WHERE verdict IS NOT NULL")
def c2_quarantine(lake: Lake) -> DataFrame:
    """Every reading that cleaning rejects, with the step that does."""
    return lake.clean_run.rejected


@query(
    "c2_kept",
    "charging_station_id charger_id timestamp avg_pwr_kw:f max_energy_wh:f active_session_count:i soc_pct:f",
    """SELECT * REPLACE (trunc(active_session_count) AS active_session_count)
    FROM faulty_verdicts WHERE verdict IS NULL""",
)
def c2_kept(lake: Lake) -> DataFrame:
    return lake.clean_run.kept


_REJECTED = {name: f"(SELECT count(*) FROM faulty_verdicts WHERE verdict = '{name}')" for name in VERDICTS}
_OBSERVED_SQL = " UNION ALL ".join(
    f"SELECT {i} AS step, '{name}' AS name, {removed} AS removed"
    for i, (name, removed) in enumerate(
        [
            ("exact duplicates", "(SELECT count(*) FROM faulty) - (SELECT count(*) FROM faulty_uniq)"),
            ("near duplicates", "(SELECT count(*) FROM faulty_uniq) - (SELECT count(*) FROM faulty_resolved)"),
            *((VERDICTS[v], n) for v, n in _REJECTED.items()),
        ],
        start=1,
    )
)


@query(
    "a13_observed_audit",
    "step:i name rows_in:i removed:i rows_left:i removed_pct:r6",
    f"""SELECT *, rows_left + removed AS rows_in, removed * CAST(100 AS DOUBLE) / (rows_left + removed) AS removed_pct
    FROM (SELECT *, (SELECT count(*) FROM faulty) - sum(removed) OVER (ORDER BY step) AS rows_left
      FROM ({_OBSERVED_SQL}))""",
)
def a13_observed(lake: Lake) -> DataFrame:
    """The audit the writing jobs counted."""
    return lake.clean_run.audit
