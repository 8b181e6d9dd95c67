"""Calendar features of a zone-free timestamp (UTC) or of a date plus an hour."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Month number -> collection window; every other month counts as window 3.
PERIOD_OF_MONTH = {11: 1, 12: 2, 4: 3}
OTHER_PERIOD = 3
SCORING_PERIOD = 3
LATE_NIGHT_FROM_HOUR = 2


def utc_wall_clock(instant: Column) -> Column:
    """Zone-free UTC time of an instant, whatever the session's time zone."""
    return F.to_utc_timestamp(instant, F.current_timezone()).cast("timestamp_ntz")


def utc_timestamp(text: Column) -> Column:
    """Parse ISO text as UTC and drop the zone; text without a zone is UTC already; NULL when
    unparsable."""
    parsed = F.try_to_timestamp(text)
    has_zone = text.rlike(r"(Z|[+-]\d{2}:?\d{2})$")
    return F.when(has_zone, utc_wall_clock(parsed)).otherwise(parsed.cast("timestamp_ntz"))


def collection_period(month: Column) -> Column:
    """Label of the collection window of a month."""
    labels = [F.when(month == number, period) for number, period in PERIOD_OF_MONTH.items()]
    return F.coalesce(*labels, F.lit(OTHER_PERIOD))


def day_of_week(day: Column) -> Column:
    """0 = Monday ... 6 = Sunday."""
    return F.weekday(day)


def is_weekend(day: Column) -> Column:
    return (F.weekday(day) >= 5).cast("int")


def is_late_night(hour: Column) -> Column:
    return (hour >= LATE_NIGHT_FROM_HOUR).cast("int")


def hour_angle(hour: Column) -> Column:
    return F.lit(2.0) * F.pi() * hour / F.lit(24.0)


def hour_sin(hour: Column, digits: int | None = None) -> Column:
    """Sine of the hour on the 24-hour circle; tables round to 4 digits, scoring does not round."""
    value = F.sin(hour_angle(hour))
    return value if digits is None else F.round(value, digits)


def hour_cos(hour: Column, digits: int | None = None) -> Column:
    value = F.cos(hour_angle(hour))
    return value if digits is None else F.round(value, digits)


def time_columns(ts: Column, digits: int | None = 4) -> dict[str, Column]:
    """The six time columns of the feature tables from one timestamp."""
    return {
        "hour": F.hour(ts),
        "day_of_week": day_of_week(ts),
        "month": F.month(ts),
        "is_weekend": is_weekend(ts),
        "hour_sin": hour_sin(F.hour(ts), digits),
        "hour_cos": hour_cos(F.hour(ts), digits),
    }


def request_time_columns(day: Column, hour: Column) -> dict[str, Column]:
    """The time columns of a request: calendar fields of its date, cyclic fields of its hour."""
    return {
        "hour": hour,
        "day_of_week": day_of_week(day),
        "month": F.month(day),
        "is_weekend": is_weekend(day),
        "hour_sin": hour_sin(hour),
        "hour_cos": hour_cos(hour),
    }


def minute_number(ts: Column) -> Column:
    """Minutes since 1970 of a zone-free timestamp; grows with the timestamp."""
    return F.unix_date(F.to_date(ts)).cast("bigint") * 1440 + F.hour(ts) * 60 + F.minute(ts)
