"""Charger readings and prediction requests derived from the test tables.

Readings are a view over ``lineitem`` (every row of it, some of them twice), requests a view over
``events``. The SQL twins live in ``querybook.sql``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def readings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw readings with exact and near duplicates, negatives, idle, dead and session-less rows."""
    base = table(spark, sf_dir, "lineitem").selectExpr(
        "'S' || cast(l_suppkey AS string) AS charging_station_id",
        """'C' || cast(l_suppkey AS string) || '-' ||
           CASE WHEN l_shipdate >= TIMESTAMP_NTZ '2001-01-01' AND l_partkey % 10 = 0 THEN 'N'
                ELSE cast(l_partkey % 8 AS string) END AS charger_id""",
        """cast(date_trunc('month', l_shipdate) AS timestamp_ntz)
           + make_dt_interval(0, cast(l_linenumber % 4 AS int)) AS timestamp""",
        """CASE WHEN l_returnflag = 'R' THEN 0.0D
                WHEN l_discount = 0 AND l_tax = 0 THEN -l_quantity
                ELSE l_quantity END AS avg_pwr_kw""",
        """CASE WHEN l_returnflag = 'R' AND l_linestatus = 'F' THEN 0.0D
                ELSE l_extendedprice END AS max_energy_wh""",
        "cast(round(l_tax * 100) AS int) AS active_session_count",
        "CASE WHEN l_linenumber = 7 THEN round(l_discount * 1000) END AS soc_pct",
    )
    copies = base.where("charger_id LIKE '%-0'")
    return base.unionByName(copies)


def requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Prediction requests as text and numbers as a client sends them: some lack a station, some
    have an impossible hour or date, some name stations and chargers without history."""
    return table(spark, sf_dir, "events").selectExpr(
        "event_id AS request_id",
        "CASE WHEN event_id % 50 <> 0 THEN 'S' || cast(user_id % 120 AS string) END AS station_id",
        """'C' || cast(user_id % 120 AS string) || '-' || cast(event_id % 9 AS string)
           AS charger_id""",
        """CASE WHEN event_id % 97 = 0 THEN 'soon'
                ELSE date_format(ts, 'yyyy-MM-dd') END AS target_date""",
        "CASE WHEN event_id % 7 <> 0 THEN cast(event_id % 26 AS int) END AS hour",
        "CASE WHEN event_id % 5 = 0 THEN 0.0D WHEN event_id % 11 <> 0 THEN value END AS power_kw",
        "CASE WHEN event_id % 13 <> 0 THEN value * 1000 END AS energy_wh",
        "CASE WHEN event_id % 3 = 0 THEN cast(event_id % 4 AS int) END AS total_chargers",
        "CASE WHEN event_id % 4 = 0 THEN cast(event_id % 3 AS double) END AS lag_1_active",
    )
