"""The eight cleaning steps, the legacy variant, and their audit."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from chargeweave.functions import measures
from chargeweave.functions.timefeat import (
    collection_period,
    time_columns,
    utc_timestamp,
    utc_wall_clock,
)
from chargeweave.operators.order_stats import quantiles
from chargeweave.schemas import (
    CHARGER,
    CLEANED,
    ENERGY,
    PERIOD,
    POWER,
    READING_KEYS,
    SESSIONS,
    SOC,
    STATION,
    TIME_COLUMNS,
    TIME_INTS,
    TS,
)
from chargeweave.session import stage

STATION_ROW_CAP = 300
CAP_SALTS = 64
OUTLIER_QUANTILE = 0.99
LEGACY_CLIP_QUANTILE = 0.995

VALID = f"{POWER} >= 0 AND {ENERGY} >= 0"
DEAD = f"{POWER} = 0 AND {ENERGY} = 0"


def prepare_readings(df: DataFrame) -> DataFrame:
    """Entry point for raw readings: zone-free timestamps, NaN as NULL, float counts kept as is."""
    out = df
    if isinstance(df.schema[TS].dataType, T.StringType):
        out = out.withColumn(TS, utc_timestamp(F.col(TS)))
    elif isinstance(df.schema[TS].dataType, T.TimestampType):
        out = out.withColumn(TS, utc_wall_clock(F.col(TS)))
    doubles = [f.name for f in df.schema.fields if isinstance(f.dataType, T.DoubleType)]
    return out.withColumns({c: F.when(~F.isnan(c), F.col(c)) for c in doubles})


def exact_dedup(df: DataFrame) -> DataFrame:
    """Step 1: one copy of every identical row. Copies collapse before the shuffle."""
    return df.distinct()


def resolve_by_mean(df: DataFrame, keys: list[str] = READING_KEYS) -> DataFrame:
    """Step 2: one row per key; numbers become their mean, anything else its smallest value.

    Rows without a complete key are dropped.
    """
    numeric = [
        f.name for f in df.schema.fields if isinstance(f.dataType, T.NumericType) and f.name not in keys
    ]
    other = [c for c in df.columns if c not in numeric and c not in keys]
    means = [F.avg(c).alias(c) for c in numeric]
    rest = [F.min(c).alias(c) for c in other]
    return df.na.drop(subset=keys).groupBy(*keys).agg(*means, *rest).select(*df.columns)


def resolve_by_max_energy(df: DataFrame, keys: list[str] = READING_KEYS) -> DataFrame:
    """Legacy step 2: keep the row with the highest energy per key, ties by the other metrics.

    The limit of one row per key already applies before the shuffle.
    """
    ties = [c for c in (POWER, SESSIONS, SOC) if c in df.columns]
    order = [F.col(c).desc_nulls_last() for c in [ENERGY, *ties]]
    ranked = df.withColumn("_nth", F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))
    return ranked.where("_nth = 1").drop("_nth")


def drop_invalid(df: DataFrame) -> DataFrame:
    """Step 3: power and energy must be known and not negative."""
    return df.where(VALID)


def outlier_limits(
    df: DataFrame, q: float = OUTLIER_QUANTILE
) -> dict[str, float | None]:
    return quantiles(df, [ENERGY, POWER], q)


def within(limits: dict[str, float | None]) -> Column:
    tests = [F.col(c) <= F.lit(v) for c, v in limits.items()]
    return tests[0] & tests[1]


def drop_outliers(df: DataFrame, q: float = OUTLIER_QUANTILE) -> DataFrame:
    """Step 4: drop rows above the quantile of either metric; both limits come from ``df``."""
    return df.where(within(outlier_limits(df, q)))


def drop_dead(df: DataFrame) -> DataFrame:
    """Step 5: rows with neither power nor energy carry no signal."""
    return df.where(f"NOT ({DEAD})")


def drop_sessionless(df: DataFrame) -> DataFrame:
    """Step 6: no active session. An unknown count passes here and is quarantined in step 7."""
    return df.where(~F.col(SESSIONS).eqNullSafe(0))


def castable(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Split into rows whose integer columns can be cast, and the quarantined rest."""
    present = [c for c in [*TIME_INTS, SESSIONS] if c in df.columns]
    bad = F.lit(False)
    for c in present:
        bad = bad | F.col(c).try_cast("bigint").isNull()
    return df.where(~bad), df.where(bad)


def fix_types(df: DataFrame, recompute_time: bool = True) -> DataFrame:
    """Step 7: integer columns truncated toward zero, time columns, collection window.

    Time columns are derived from the timestamp unless ``recompute_time=False`` and the table
    brings its own, which then are truncated like the session count. Rows with an unknown count
    are left out; ``castable`` returns them.
    """
    own_time = not recompute_time and all(c in df.columns for c in TIME_COLUMNS)
    if not own_time:
        df = df.withColumns(time_columns(F.col(TS)))
    good, _ = castable(df)
    ints = {c: F.col(c).cast("bigint").cast("int") for c in [*TIME_INTS, SESSIONS]}
    typed = good.withColumns(ints).withColumn(PERIOD, collection_period(F.col("month")))
    return typed.select(*[c for c in CLEANED if c in typed.columns])


def _newest(df: DataFrame, keys: list[str], cap: int) -> DataFrame:
    order = Window.partitionBy(*keys).orderBy(F.desc(TS), F.desc(CHARGER))
    return df.withColumn("_nth", F.row_number().over(order)).where(F.col("_nth") <= cap).drop("_nth")


def cap_stations(df: DataFrame, cap: int | None = STATION_ROW_CAP) -> DataFrame:
    """Step 8: the most recent ``cap`` rows of every station, ties by charger; None keeps all.

    A hot station never arrives whole in one task: Spark cuts every task's rows of a station to ``cap``
    before the shuffle. It does so up to ``spark.sql.optimizer.windowGroupLimitThreshold`` rows; beyond, the
    rows of a station are first capped in salted parts, which cannot lose any of its newest rows.
    """
    if cap is None:
        return df
    if cap > int(df.sparkSession.conf.get("spark.sql.optimizer.windowGroupLimitThreshold", "1000")):
        salted = df.withColumn("_salt", F.pmod(F.xxhash64(CHARGER, TS), F.lit(CAP_SALTS)))
        df = _newest(salted, [STATION, "_salt"], cap).drop("_salt")
    return _newest(df, [STATION], cap)


def clean(
    raw: DataFrame,
    cap: int | None = STATION_ROW_CAP,
    q: float = OUTLIER_QUANTILE,
    recompute_time: bool = True,
    staged: bool = True,
) -> DataFrame:
    """All eight steps. The resolved table is staged once, as the limits and the filter share it."""
    valid = drop_invalid(resolve_by_mean(exact_dedup(prepare_readings(raw))))
    if staged:
        valid = stage(valid, "resolved")
    kept = drop_sessionless(drop_dead(drop_outliers(valid, q)))
    return cap_stations(fix_types(kept, recompute_time), cap)


def clip_upper(df: DataFrame, q: float = LEGACY_CLIP_QUANTILE) -> DataFrame:
    """Cap both metrics at their quantile without removing rows."""
    limits = quantiles(df, [ENERGY, POWER], q)
    return df.withColumns(
        {c: measures.at_most(F.col(c), v) for c, v in limits.items() if v is not None}
    )


def clean_legacy(raw: DataFrame, recompute_time: bool = True, staged: bool = True) -> DataFrame:
    """Legacy order: keep-max duplicates, validity, sessions, dead rows, then clip at P99.5."""
    unique = resolve_by_max_energy(exact_dedup(prepare_readings(raw)))
    kept = drop_dead(drop_sessionless(drop_invalid(unique)))
    if staged:
        kept = stage(kept, "legacy_kept")
    return fix_types(clip_upper(kept), recompute_time)


@dataclass(frozen=True)
class AuditStep:
    name: str
    counter: str


# Report order and the counter that holds the rows left after the step.
AUDIT_STEPS = [
    AuditStep("exact duplicates", "distinct_rows"),
    AuditStep("near duplicates", "resolved"),
    AuditStep("invalid", "valid"),
    AuditStep("outliers", "inliers"),
    AuditStep("dead rows", "alive"),
    AuditStep("no session", "in_session"),
    AuditStep("types", "typed"),
    AuditStep("station cap", "capped"),
]


def audit(
    raw: DataFrame, limits: dict[str, float | None], cap: int = STATION_ROW_CAP
) -> DataFrame:
    """Rows in, removed and left for every step, from one pass over the raw readings.

    Copies are counted while they collapse, row filters become conditional counts, and the station
    cap is ``min(rows, cap)`` per station.
    """
    readings = prepare_readings(raw)
    unique = readings.groupBy(*readings.columns).agg(F.count(F.lit(1)).alias("_copies"))
    numbers = [c for c in (POWER, ENERGY, SESSIONS) if c in raw.columns]
    resolved = unique.groupBy(*READING_KEYS).agg(
        *[F.avg(c).alias(c) for c in numbers],
        F.sum("_copies").alias("_raw_rows"),
        F.count(F.lit(1)).alias("_distinct_rows"),
    )
    has_key = F.col(STATION).isNotNull() & F.col(CHARGER).isNotNull() & F.col(TS).isNotNull()
    passed = {
        "resolved": has_key,
        "valid": F.expr(VALID),
        "inliers": within(limits),
        "alive": F.expr(f"NOT ({DEAD})"),
        "in_session": ~F.col(SESSIONS).eqNullSafe(0),
        "typed": F.col(SESSIONS).try_cast("bigint").isNotNull(),
    }
    counters, so_far = [], F.lit(True)
    for name, test in passed.items():
        so_far = so_far & F.coalesce(test, F.lit(False))
        counters.append(F.count_if(so_far).alias(name))
    per_station = resolved.groupBy(STATION).agg(
        F.sum("_raw_rows").alias("raw_rows"),
        F.sum("_distinct_rows").alias("distinct_rows"),
        *counters,
    )
    names = ["raw_rows", *[s.counter for s in AUDIT_STEPS]]
    totals = per_station.withColumn("capped", F.least("typed", F.lit(cap))).agg(
        *[F.sum(n).alias(n) for n in names]
    )
    rows = [
        F.struct(
            F.lit(i + 1).alias("step"),
            F.lit(step.name).alias("name"),
            F.col(names[i]).alias("rows_in"),
            (F.col(names[i]) - F.col(step.counter)).alias("removed"),
            F.col(step.counter).alias("rows_left"),
            F.try_divide((F.col(names[i]) - F.col(step.counter)) * F.lit(100.0), F.col(names[i])).alias(
                "removed_pct"
            ),
        )
        for i, step in enumerate(AUDIT_STEPS)
    ]
    return totals.select(F.inline(F.array(*rows)))
