"""Cleaning that loses no row: kept rows, named rejects, and the audit, from the jobs that write them.

Readings are resolved and written once; every resolved row then gets a verdict, the first step that
rejects it, and is written again in two partitions, kept and rejected. The audit is counted by
``observe`` while these two tables are written, so it needs no pass of its own. After duplicates
have collapsed, rows resolved = rows kept + rows rejected.

Rows without a complete key cannot be resolved: different ones are rejected one by one, identical ones
once. The station cap is a comparison with the oldest reading a station may keep.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F
from pyspark.sql import types as T

from chargeweave.operators import cleaning
from chargeweave.schemas import CHARGER, READING_KEYS, SESSIONS, STATION, TS
from chargeweave.session import stage

VERDICT = "verdict"
_KEPT = "kept"
# Verdicts in the order of the steps, beside the audit's names of these steps.
VERDICTS = {
    "incomplete key": "incomplete keys",
    "invalid": "invalid",
    "outlier": "outliers",
    "dead": "dead rows",
    "no session": "no session",
    "unknown count": "types",
    "over the cap": "station cap",
}


@dataclass
class CleanRun:
    """``kept`` as ``clean`` returns it; ``rejected`` with reading columns and ``verdict``; ``audit``."""

    kept: DataFrame
    rejected: DataFrame
    audit: DataFrame


def has_key() -> Column:
    return F.col(STATION).isNotNull() & F.col(CHARGER).isNotNull() & F.col(TS).isNotNull()


def resolve_keyed(unique: DataFrame) -> DataFrame:
    """``resolve_by_mean`` that keeps rows without a complete key, each as it is."""
    others = [c for c in unique.columns if c not in READING_KEYS]
    numeric = [f.name for f in unique.schema.fields if isinstance(f.dataType, T.NumericType)]
    alone = F.when(~has_key(), F.struct(*others)).alias("_alone")
    means = [F.avg(c).alias(c) if c in numeric else F.min(c).alias(c) for c in others]
    return unique.groupBy(*READING_KEYS, alone).agg(*means).select(*unique.columns)


def verdict(limits: dict[str, float | None]) -> Column:
    """The first step that rejects a resolved row, null if none does; the cap is not among them."""

    def fails(test: Column) -> Column:
        return ~F.coalesce(test, F.lit(False))

    inlier = cleaning.within(limits) if all(v is not None for v in limits.values()) else F.lit(True)
    return (
        F.when(~has_key(), "incomplete key")
        .when(fails(F.expr(cleaning.VALID)), "invalid")
        .when(fails(inlier), "outlier")
        .when(F.expr(cleaning.DEAD), "dead")
        .when(F.col(SESSIONS).eqNullSafe(0), "no session")
        .when(F.col(SESSIONS).try_cast("bigint").isNull(), "unknown count")
    )


def oldest_kept(rows: DataFrame, cap: int) -> DataFrame:
    """Per station with more than ``cap`` rows, the (timestamp, charger) of its last kept one."""
    newest = cleaning.cap_stations(rows.select(*READING_KEYS), cap)
    cut = F.min(F.struct(TS, CHARGER)).alias("_cut")
    return newest.groupBy(STATION).agg(F.count(F.lit(1)).alias("_n"), cut).where(F.col("_n") == cap).drop("_n")


def _audit_rows(counts: dict[str, int]) -> list[tuple]:
    steps = [
        ("exact duplicates", counts["raw"] - counts["distinct"]),
        ("near duplicates", counts["distinct"] - counts["resolved"]),
        *((step, counts[name]) for name, step in VERDICTS.items()),
    ]
    rows, left = [], counts["raw"]
    for i, (name, removed) in enumerate(steps, start=1):
        share = removed * 100.0 / left if left else None
        rows.append((i, name, left, removed, left - removed, share))
        left -= removed
    return rows


def clean_with_quarantine(
    raw: DataFrame,
    cap: int | None = cleaning.STATION_ROW_CAP,
    q: float = cleaning.OUTLIER_QUANTILE,
    recompute_time: bool = True,
) -> CleanRun:
    """All eight steps of ``cleaning.clean`` with the rejected rows and the counts of every step."""
    spark = raw.sparkSession
    rows = F.count(F.lit(1)).alias("rows")
    seen = {name: Observation(name) for name in ("raw", "distinct", "resolved", "verdicts")}
    readings = cleaning.prepare_readings(raw).observe(seen["raw"], rows)
    unique = cleaning.exact_dedup(readings).observe(seen["distinct"], rows)
    resolved = stage(resolve_keyed(unique).observe(seen["resolved"], rows), "resolved")

    limits = cleaning.outlier_limits(cleaning.drop_invalid(resolved.where(has_key())), q)
    judged = resolved.withColumn(VERDICT, verdict(limits))
    if cap is not None:
        cuts = stage(oldest_kept(judged.where(F.col(VERDICT).isNull()), cap), "cuts")
        over = F.col(VERDICT).isNull() & (F.struct(TS, CHARGER) < F.col("_cut"))
        judged = judged.join(cuts, STATION, "left").withColumn(
            VERDICT, F.when(over, "over the cap").otherwise(F.col(VERDICT))
        )
    judged = judged.select(*resolved.columns, VERDICT, F.col(VERDICT).isNull().alias(_KEPT))
    per_verdict = [F.count_if(F.col(VERDICT) == name).alias(name) for name in VERDICTS]
    written = stage(judged.observe(seen["verdicts"], *per_verdict), "judged", partition_by=[_KEPT])

    if resolved.isEmpty():  # so was the input; Spark then plans neither the job nor its counters
        counts = dict.fromkeys(["raw", "distinct", "resolved", *VERDICTS], 0)
    else:
        counts = {name: seen[name].get["rows"] for name in ("raw", "distinct", "resolved")} | seen["verdicts"].get
    audit = spark.createDataFrame(
        _audit_rows(counts),
        "step int, name string, rows_in long, removed long, rows_left long, removed_pct double",
    )
    kept = written.where(_KEPT).drop(VERDICT, _KEPT)
    return CleanRun(
        cleaning.fix_types(kept, recompute_time), written.where(f"NOT {_KEPT}").drop(_KEPT), audit
    )
