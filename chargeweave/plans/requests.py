"""Prediction requests as tables: validation, history lookups, feature rows and responses.

Everything is stateless per request, so the same functions run on batch and streaming frames. The
history side of every lookup has one row per station or charger.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from chargeweave.functions import measures
from chargeweave.functions.timefeat import SCORING_PERIOD, is_late_night, request_time_columns
from chargeweave.schemas import (
    CHARGER,
    CHARGER_AGGREGATES,
    ENERGY,
    LAG_COLUMNS,
    PERIOD,
    POWER,
    PRODUCTS,
    SESSIONS,
    STATION,
    STATION_AGGREGATES,
    TS,
)
from chargeweave.session import stage

UNKNOWN_STATION = "unknown"
MISSING = measures.MISSING_SENTINEL


@dataclass(frozen=True)
class RequestSpec:
    """Required text fields, the default hour, and typed optional fields with their defaults."""

    required: list[str]
    hour: int
    optional: dict[str, tuple[str, object]] = field(default_factory=dict)


# Request fields and defaults of the five products.
REQUESTS: dict[str, RequestSpec] = {
    "energy": RequestSpec(
        ["station_id", "charger_id"],
        18,
        {
            POWER: ("double", 25.0),
            **{c: ("double", MISSING) for c in [*STATION_AGGREGATES, *CHARGER_AGGREGATES]},
        },
    ),
    "soc": RequestSpec(
        ["station_id", "charger_id"], 1, {POWER: ("double", 18.4), ENERGY: ("double", 52560.0)}
    ),
    "congestion": RequestSpec(
        ["station_id"],
        17,
        {"total_chargers": ("int", None), **{c: ("double", 0.0) for c in LAG_COLUMNS}},
    ),
    "demand": RequestSpec(
        ["station_id"],
        17,
        {
            "total_chargers": ("double", 1.0),
            "active_chargers": ("double", 0.0),
            "utilization_rate": ("double", 0.0),
            "avg_energy_per_charger": ("double", 0.0),
            "peak_power_kw": ("double", 0.0),
            "station_avg_hourly_demand": ("double", 0.0),
            "station_peak_hourly_demand": ("double", 0.0),
        },
    ),
    "leftover": RequestSpec(
        ["charger_id"],
        17,
        {
            "station_id": ("string", None),
            "current_power_kw": ("double", 0.0),
            "energy_consumed_wh": ("double", 0.0),
            "charger_max_energy_wh": ("double", None),
            "charger_mean_energy_wh": ("double", None),
        },
    ),
}


def _iso_date(df: DataFrame, name: str) -> Column:
    if isinstance(df.schema[name].dataType, T.DateType):
        return F.col(name)
    return F.when(F.col(name).rlike(r"^\d{4}-\d{2}-\d{2}$"), F.col(name).try_cast("date"))


def _malformed(df: DataFrame, name: str, kind: str) -> Column:
    """A value that is there but is not of its type; a fraction is no integer."""
    given = F.col(name)
    bad = given.try_cast(kind).isNull()
    if kind in ("int", "bigint", "long") and isinstance(df.schema[name].dataType, T.FractionalType):
        bad = bad | (given != F.floor(given))
    return given.isNotNull() & bad


def check_requests(requests: DataFrame, product: str) -> DataFrame:
    """Typed requests with defaults filled in and a ``reject_reason``, NULL for valid ones.

    Columns the product does not know are carried along.
    """
    spec = REQUESTS[product]
    values: dict[str, Column] = {}
    malformed = [
        F.when(_malformed(requests, name, kind), F.lit(f"{name} is not of type {kind}"))
        for name, kind in [*((n, k) for n, (k, _) in spec.optional.items()), ("hour", "int")]
        if name in requests.columns
    ]
    for name, (kind, default) in spec.optional.items():
        given = F.col(name).try_cast(kind) if name in requests.columns else F.lit(None).cast(kind)
        values[name] = given if default is None else F.coalesce(given, F.lit(default).cast(kind))
    hour = F.col("hour").try_cast("int") if "hour" in requests.columns else F.lit(None).cast("int")
    values["hour"] = F.coalesce(hour, F.lit(spec.hour))
    values["target_date"] = _iso_date(requests, "target_date")

    reason = F.coalesce(
        *[F.when(F.col(c).isNull(), F.lit(f"{c} is required")) for c in spec.required],
        F.when(F.col("target_date").isNull(), F.lit("target_date is not an ISO date")),
        F.when(~F.col("hour").between(0, 23), F.lit("hour is not in 0-23")),
        F.col("_malformed"),
    )
    marked = requests.withColumn("_malformed", F.coalesce(*malformed, F.lit(None).cast("string")))
    return marked.withColumns(values).withColumn("reject_reason", reason).drop("_malformed")


def valid_requests(requests: DataFrame, product: str) -> DataFrame:
    return check_requests(requests, product).where("reject_reason IS NULL").drop("reject_reason")


def rejected_requests(requests: DataFrame, product: str) -> DataFrame:
    return check_requests(requests, product).where("reject_reason IS NOT NULL")


# -- history lookups ---------------------------------------------------------------------------


def energy_history(features: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Per-station and per-charger statistics of the energy table, and their row-weighted means."""
    stations = features.groupBy(F.col(STATION).alias("station_id")).agg(
        F.lit(True).alias("_station_known"), *[F.max(c).alias(f"_{c}") for c in STATION_AGGREGATES]
    )
    chargers = features.groupBy(CHARGER).agg(
        F.lit(True).alias("_charger_known"), *[F.max(c).alias(f"_{c}") for c in CHARGER_AGGREGATES]
    )
    overall = features.agg(
        *[F.avg(c).alias(f"_all_{c}") for c in STATION_AGGREGATES if c != "station_charger_count"]
    )
    return stations, chargers, overall


def with_energy_history(
    requests: DataFrame, history: tuple[DataFrame, DataFrame, DataFrame]
) -> DataFrame:
    """Station statistics, else the overall means (and one charger); charger statistics, else the
    station's. A known key whose statistic is missing gives the sentinel, not the fallback."""
    stations, chargers, overall = history
    joined = (
        requests.drop(*STATION_AGGREGATES, *CHARGER_AGGREGATES)
        .join(stations, "station_id", "left")
        .join(chargers, CHARGER, "left")
        .crossJoin(F.broadcast(overall))
    )
    station_known = F.coalesce("_station_known", F.lit(False))
    charger_known = F.coalesce("_charger_known", F.lit(False))
    values: dict[str, Column] = {}
    for c in STATION_AGGREGATES:
        fallback = F.lit(1.0) if c == "station_charger_count" else F.col(f"_all_{c}")
        values[c] = F.when(station_known, F.col(f"_{c}").cast("double")).otherwise(fallback)
    twins = {
        "charger_mean_energy_wh": "station_mean_energy_wh",
        "charger_median_energy_wh": "station_median_energy_wh",
    }
    for c, twin in twins.items():
        values[c] = F.when(charger_known, F.col(f"_{c}")).otherwise(values[twin])
    filled = {c: F.coalesce(v, F.lit(MISSING)) for c, v in values.items()}
    helpers = [c for c in joined.columns if c.startswith("_")]
    return joined.withColumns(filled).drop(*helpers)


def station_sizes(features: DataFrame) -> DataFrame:
    """Largest number of chargers seen per station."""
    return features.groupBy(F.col(STATION).alias("station_id")).agg(
        F.max("total_chargers").alias("_total_chargers")
    )


def with_station_size(requests: DataFrame, sizes: DataFrame) -> DataFrame:
    joined = requests.join(sizes, "station_id", "left")
    total = F.coalesce("_total_chargers", F.lit(1)).cast("int")
    return joined.withColumn("total_chargers", total).drop("_total_chargers")


def demand_history(features: DataFrame) -> DataFrame:
    return features.groupBy(F.col(STATION).alias("station_id")).agg(
        F.lit(True).alias("_known"),
        F.max("total_chargers").alias("_total_chargers"),
        F.avg("station_avg_hourly_demand").alias("_station_avg_hourly_demand"),
        F.max("station_peak_hourly_demand").alias("_station_peak_hourly_demand"),
    )


def with_demand_history(requests: DataFrame, history: DataFrame) -> DataFrame:
    """Charger count and demand statistics of the station; 1, 0 and 0 for an unknown one."""
    joined = requests.join(history, "station_id", "left")
    known = F.coalesce("_known", F.lit(False))
    fallback = {
        "total_chargers": 1.0,
        "station_avg_hourly_demand": 0.0,
        "station_peak_hourly_demand": 0.0,
    }
    values = {
        c: F.when(known, F.col(f"_{c}").cast("double")).otherwise(F.lit(v)) for c, v in fallback.items()
    }
    return joined.withColumns(values).drop("_known", *[f"_{c}" for c in fallback])


def charger_history(features: DataFrame) -> DataFrame:
    """Peak and mean energy per charger, and the station of its earliest reading.

    Readings first collapse per charger and station, by figures that a hash table holds.
    """
    mean = "charger_mean_energy_wh"
    pairs = features.groupBy(CHARGER, STATION).agg(
        F.max("charger_max_energy_wh").alias("_peak"),
        F.sum(F.col(mean).cast("double")).alias("_sum"),
        F.count(mean).alias("_n"),
        F.when(F.count(TS) == F.count(F.lit(1)), F.min(TS)).alias("_first"),
    )
    return pairs.groupBy(CHARGER).agg(
        F.lit(True).alias("_known"),
        F.max("_peak").alias("_charger_max_energy_wh"),
        F.try_divide(F.sum("_sum"), F.sum("_n")).alias("_charger_mean_energy_wh"),
        F.min_by(STATION, F.struct("_first", STATION)).alias("_station_id"),
    )


def with_charger_history(requests: DataFrame, history: DataFrame) -> DataFrame:
    """History of the charger; 1.5 times and once the consumed energy for an unknown one."""
    joined = requests.join(history, CHARGER, "left")
    known = F.coalesce("_known", F.lit(False))
    used = F.col("energy_consumed_wh")
    values = {
        "charger_max_energy_wh": F.when(known, F.col("_charger_max_energy_wh")).otherwise(used * 1.5),
        "charger_mean_energy_wh": F.when(known, F.col("_charger_mean_energy_wh")).otherwise(used),
        "station_id": F.when(known, F.col("_station_id")).otherwise(F.lit(UNKNOWN_STATION)),
        "charger_looked_up": F.lit(True),
    }
    helpers = ["_known", "_charger_max_energy_wh", "_charger_mean_energy_wh", "_station_id"]
    return joined.withColumns(values).drop(*helpers)


# -- feature rows ------------------------------------------------------------------------------


def feature_rows(requests: DataFrame, product: str) -> DataFrame:
    """Model inputs of valid requests, in addition to the request's own columns."""
    values = dict(request_time_columns(F.col("target_date"), F.col("hour")))
    values[PERIOD] = F.lit(SCORING_PERIOD)
    if product == "leftover":
        used, power = F.col("energy_consumed_wh"), F.col("current_power_kw")
        named = F.when(F.col("station_id") != "", F.col("station_id"))
        peak, mean = F.col("charger_max_energy_wh"), F.col("charger_mean_energy_wh")
        if "charger_looked_up" not in requests.columns:  # a known charger's missing value stays missing
            peak, mean = F.coalesce(peak, used * 1.5), F.coalesce(mean, used)
        values |= {
            STATION: F.coalesce(named, F.lit(UNKNOWN_STATION)),
            POWER: power,
            SESSIONS: measures.sessions_from_power(power),
            "is_idle_charger": measures.idle_flag(power),
            ENERGY: used,
            "charger_max_energy_wh": peak,
            "charger_mean_energy_wh": mean,
            "estimated_capacity_wh": measures.capacity(peak),
        }
    else:
        values[STATION] = F.col("station_id")
    if product in ("energy", "soc"):
        values["is_idle_charger"] = measures.idle_flag(F.col(POWER))
    if product == "energy":
        values["is_late_night"] = is_late_night(F.col("hour"))
        values[SESSIONS] = F.lit(1)
    if product == "congestion":
        values["total_chargers"] = F.coalesce("total_chargers", F.lit(1))
    return requests.withColumns(values)


def model_inputs(rows: DataFrame, product: str, keep: list[str]) -> DataFrame:
    """Only the columns the product's model reads, after the ``keep`` columns."""
    inputs = PRODUCTS[product].feature_columns()
    return rows.select(*keep, *[c for c in inputs if c not in keep])


# -- responses ---------------------------------------------------------------------------------


def responses(scored: DataFrame, product: str, prediction: str = "prediction") -> DataFrame:
    """Bounded prediction and the derived figures of a product's response."""
    raw = F.col(prediction)
    if product == "energy":
        wh = measures.clamp(raw, 0.0, None)
        return scored.withColumns(
            {"predicted_energy_wh": wh, "predicted_energy_kwh": measures.to_kilo(wh)}
        )
    if product == "soc":
        return scored.withColumn("predicted_soc_pct", measures.clamp(raw, 0.0, 100.0))
    if product == "congestion":
        total = F.col("total_chargers").cast("double")
        active = measures.clamp(raw, 0.0, total)
        occupancy = measures.percent_of(active, total)
        return scored.withColumns(
            {
                "predicted_active_chargers": active,
                "predicted_occupancy_pct": occupancy,
                "occupancy_band": measures.occupancy_band(occupancy),
                "note": measures.provisional_note([F.col(c) for c in LAG_COLUMNS]),
            }
        )
    if product == "demand":
        wh = measures.clamp(raw, 0.0, None)
        return scored.withColumns(
            {
                "predicted_demand_wh": wh,
                "predicted_demand_kwh": measures.to_kilo(wh),
                "avg_per_charger_wh": measures.per_unit(wh, F.col("total_chargers")),
                "ratio_to_history": measures.ratio_to_history(
                    wh, F.col("station_avg_hourly_demand")
                ),
            }
        )
    wh = measures.clamp(raw, 0.0, None)
    used_pct = measures.percent_of(F.col(ENERGY), F.col("estimated_capacity_wh"))
    return scored.withColumns(
        {
            "predicted_leftover_wh": wh,
            "predicted_leftover_kwh": measures.to_kilo(wh),
            "utilization_pct": used_pct,
            "session_band": measures.session_band(used_pct),
        }
    )


# -- from requests to responses ----------------------------------------------------------------

_LOOKUPS = {
    "energy": (energy_history, with_energy_history),
    "congestion": (lambda features: (station_sizes(features),), lambda r, h: with_station_size(r, *h)),
    "demand": (lambda features: (demand_history(features),), lambda r, h: with_demand_history(r, *h)),
    "leftover": (lambda features: (charger_history(features),), lambda r, h: with_charger_history(r, *h)),
}


@dataclass(frozen=True)
class Scorer:
    """Requests of one product to responses: the same plan for a table and for a stream.

    ``predict`` adds ``prediction`` to model inputs, as ``FittedProduct.predict`` does. ``history``
    holds the staged tables requests are looked up in; none if all inputs come with the request.
    """

    product: str
    predict: Callable[[DataFrame], DataFrame]
    history: tuple[DataFrame, ...] | None = None

    @staticmethod
    def over(product: str, predict: Callable[[DataFrame], DataFrame], features: DataFrame) -> Scorer:
        """History from the product's feature table, aggregated once, not once per micro-batch."""
        if product not in _LOOKUPS:
            return Scorer(product, predict)
        tables = _LOOKUPS[product][0](features)
        return Scorer(product, predict, tuple(stage(t, f"history_{product}") for t in tables))

    def __call__(self, requests: DataFrame) -> DataFrame:
        known = valid_requests(requests, self.product)
        if self.history is not None:
            known = _LOOKUPS[self.product][1](known, self.history)
        rows = feature_rows(known, self.product)
        inputs = PRODUCTS[self.product].feature_columns()
        kept = [c for c in rows.columns if c not in inputs]
        return responses(self.predict(model_inputs(rows, self.product, kept)), self.product)
