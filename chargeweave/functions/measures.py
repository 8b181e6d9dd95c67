"""Derived measures of readings and the post-processing of predictions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values.
CAPACITY_BUFFER = 1.1
MISSING_SENTINEL = -999.0
OPEN_BELOW_PCT, CROWDED_ABOVE_PCT = 30.0, 80.0
MIDWAY_ABOVE_PCT, NEARLY_DONE_ABOVE_PCT = 50.0, 90.0
PROVISIONAL_NOTE = "no lag or rolling history was given (all 0); treat the prediction as provisional"


def idle_flag(power: Column) -> Column:
    """1 when no power is drawn; missing power is not idle."""
    return F.coalesce(power == 0, F.lit(False)).cast("int")


def idle_by_sessions(active_sessions: Column, sessions: Column) -> Column:
    """1 when either session count is zero."""
    none_active = F.coalesce(active_sessions == 0, F.lit(False))
    return (none_active | F.coalesce(sessions == 0, F.lit(False))).cast("int")


def utilization_rate(active: Column, total: Column) -> Column:
    return F.try_divide(active.cast("double"), total.cast("double"))


def capacity(charger_max: Column) -> Column:
    return charger_max * F.lit(CAPACITY_BUFFER)


def leftover(capacity_wh: Column, energy_wh: Column) -> Column:
    """Capacity not yet used, never below zero; unknown stays unknown."""
    return at_least(capacity_wh - energy_wh, 0.0)


def power_to_energy(power: Column, energy: Column) -> Column:
    return F.when(energy > 0, power / (energy / F.lit(1000.0)))


def period_hour(period: Column, hour: Column) -> Column:
    return period * 10 + hour


def at_least(value: Column, low: float) -> Column:
    return F.when(value < low, F.lit(low)).otherwise(value)


def at_most(value: Column, high: float | Column) -> Column:
    """Upper bound; ``least`` is avoided because it would replace NULL by the bound."""
    bound = high if isinstance(high, Column) else F.lit(high)
    return F.when(value > bound, bound).otherwise(value)


def clamp(value: Column, low: float | None, high: float | Column | None) -> Column:
    if high is not None:
        value = at_most(value, high)
    if low is not None:
        value = at_least(value, low)
    return value


def log_target(value: Column) -> Column:
    return F.log1p(value)


def from_log_target(value: Column) -> Column:
    return F.expm1(value)


def to_kilo(value: Column) -> Column:
    return value / F.lit(1000.0)


def percent_of(part: Column, whole: Column) -> Column:
    """part / whole * 100, and 0 when there is no positive whole."""
    return F.when(whole > 0, part / whole * F.lit(100.0)).otherwise(F.lit(0.0))


def per_unit(amount: Column, units: Column) -> Column:
    return F.when(units > 0, amount / units).otherwise(F.lit(0.0))


def ratio_to_history(predicted: Column, historical_mean: Column) -> Column:
    return F.when(historical_mean > 0, predicted / historical_mean)


def occupancy_band(pct: Column) -> Column:
    return F.when(pct > CROWDED_ABOVE_PCT, F.lit("high")).when(pct < OPEN_BELOW_PCT, F.lit("open"))


def session_band(pct: Column) -> Column:
    return (
        F.when(pct > NEARLY_DONE_ABOVE_PCT, F.lit("nearly complete"))
        .when(pct > MIDWAY_ABOVE_PCT, F.lit("in progress"))
        .otherwise(F.lit("early"))
    )


def provisional_note(lag_inputs: list[Column]) -> Column:
    all_zero = reduce(lambda a, b: a & b, [c == 0 for c in lag_inputs])
    return F.when(all_zero, F.lit(PROVISIONAL_NOTE))


def sessions_from_power(power: Column) -> Column:
    return F.coalesce(power > 0, F.lit(False)).cast("int")
