"""Named SQL tables the oracle queries build on (DuckDB dialect, over the driver's views)."""

from __future__ import annotations

import re

_READING = '"charging_station_id", "charger_id", "timestamp"'
_TIME = "hour, day_of_week, month, is_weekend, hour_sin, hour_cos"
_TIME_MIN = ", ".join(f"min({c}) AS {c}" for c in [*_TIME.split(", "), "collection_period"])


def _split(table: str, keys: str, others: str) -> str:
    """Periods 1 and 2 train, period 3 by time at int(.8 n) and int(.9 n)."""
    keep = "WHERE collection_period IN (1, 2, 3)" if others == "drop" else ""
    return f"""
    SELECT t.* EXCLUDE (_nth, _n), CASE
        WHEN collection_period <> 3 THEN 'train'
        WHEN _nth <= floor(_n * CAST(0.8 AS DOUBLE)) THEN 'train'
        WHEN _nth <= floor(_n * CAST(0.9 AS DOUBLE)) THEN 'val' ELSE 'test' END AS split
    FROM (SELECT *, row_number() OVER (PARTITION BY collection_period = 3 ORDER BY "timestamp", {keys}) AS _nth,
                 count(*) OVER (PARTITION BY collection_period = 3) AS _n FROM {table} {keep}) AS t"""


def request_time(hour_default: int) -> str:
    return f"""coalesce(hour, {hour_default}) AS hour,
        CASE WHEN regexp_matches(target_date, '^\\d{{4}}-\\d{{2}}-\\d{{2}}$')
             THEN TRY_CAST(target_date AS DATE) END AS target_date"""


_REQUEST_TIME = """isodow(target_date) - 1 AS day_of_week, month(target_date) AS month,
    CAST(isodow(target_date) >= 6 AS INT) AS is_weekend, 3 AS collection_period,
    sin(2 * pi() * hour / 24) AS hour_sin, cos(2 * pi() * hour / 24) AS hour_cos"""


def _valid(required: str) -> str:
    tests = " AND ".join(f"{c} IS NOT NULL" for c in required.split())
    return f"{tests} AND target_date IS NOT NULL AND hour BETWEEN 0 AND 23"


TABLES: dict[str, str] = {
    "base": """
    SELECT 'S' || CAST(l_suppkey AS varchar) AS charging_station_id,
      'C' || CAST(l_suppkey AS varchar) || '-' ||
        CASE WHEN l_shipdate >= TIMESTAMP '2001-01-01' AND l_partkey % 10 = 0 THEN 'N'
             ELSE CAST(l_partkey % 8 AS varchar) END AS charger_id,
      date_trunc('month', l_shipdate) + to_hours(CAST(l_linenumber % 4 AS int)) AS "timestamp",
      CASE WHEN l_returnflag = 'R' THEN CAST(0 AS DOUBLE)
           WHEN l_discount = 0 AND l_tax = 0 THEN -l_quantity ELSE l_quantity END AS avg_pwr_kw,
      CASE WHEN l_returnflag = 'R' AND l_linestatus = 'F' THEN CAST(0 AS DOUBLE)
           ELSE l_extendedprice END AS max_energy_wh,
      CAST(round(l_tax * 100) AS int) AS active_session_count,
      CASE WHEN l_linenumber = 7 THEN round(l_discount * 1000) END AS soc_pct
    FROM lineitem""",
    "raw": "SELECT * FROM base UNION ALL SELECT * FROM base WHERE charger_id LIKE '%-0'",
    "uniq": "SELECT DISTINCT * FROM raw",
    "resolved": f"""
    SELECT {_READING}, avg(avg_pwr_kw) AS avg_pwr_kw, avg(max_energy_wh) AS max_energy_wh,
      avg(active_session_count) AS active_session_count, avg(soc_pct) AS soc_pct
    FROM uniq GROUP BY {_READING}""",
    "valid": "SELECT * FROM resolved WHERE avg_pwr_kw >= 0 AND max_energy_wh >= 0",
    "limits": """SELECT quantile_cont(max_energy_wh, 0.99) AS e99, quantile_cont(avg_pwr_kw, 0.99) AS p99
    FROM valid""",
    "inliers": "SELECT v.* FROM valid AS v, limits WHERE max_energy_wh <= e99 AND avg_pwr_kw <= p99",
    "alive": "SELECT * FROM inliers WHERE NOT (avg_pwr_kw = 0 AND max_energy_wh = 0)",
    "in_session": "SELECT * FROM alive WHERE active_session_count <> 0",
    "timed": """
    SELECT *, hour("timestamp") AS hour, isodow("timestamp") - 1 AS day_of_week,
      month("timestamp") AS month, CAST(isodow("timestamp") >= 6 AS INT) AS is_weekend,
      round(sin(2 * pi() * hour("timestamp") / 24), 4) AS hour_sin,
      round(cos(2 * pi() * hour("timestamp") / 24), 4) AS hour_cos FROM in_session""",
    "typed": f"""
    SELECT {_READING}, avg_pwr_kw, max_energy_wh,
      CAST(trunc(active_session_count) AS BIGINT) AS active_session_count, soc_pct, {_TIME},
      CASE month WHEN 11 THEN 1 WHEN 12 THEN 2 WHEN 4 THEN 3 ELSE 3 END AS collection_period
    FROM timed""",
    "cleaned": """
    SELECT * EXCLUDE (_nth) FROM (SELECT *, row_number() OVER (
      PARTITION BY charging_station_id ORDER BY "timestamp" DESC, charger_id DESC) AS _nth FROM typed)
    WHERE _nth <= 300""",
    # cleaning with quarantine
    "faulty": """SELECT * REPLACE (CASE WHEN avg_pwr_kw <> 13 THEN active_session_count END AS active_session_count,
      CASE WHEN NOT (avg_pwr_kw = 17 AND active_session_count = 3) THEN charging_station_id END AS charging_station_id)
    FROM raw""",
    "faulty_uniq": "SELECT DISTINCT * FROM faulty",
    "faulty_resolved": f"""
    SELECT {_READING}, avg(avg_pwr_kw) AS avg_pwr_kw, avg(max_energy_wh) AS max_energy_wh,
      avg(active_session_count) AS active_session_count, avg(soc_pct) AS soc_pct
    FROM faulty_uniq WHERE charging_station_id IS NOT NULL GROUP BY {_READING}
    UNION ALL SELECT * FROM faulty_uniq WHERE charging_station_id IS NULL""",
    "faulty_limits": """SELECT quantile_cont(max_energy_wh, 0.99) AS e99, quantile_cont(avg_pwr_kw, 0.99) AS p99
    FROM faulty_resolved WHERE charging_station_id IS NOT NULL AND avg_pwr_kw >= 0 AND max_energy_wh >= 0""",
    "faulty_judged": """
    SELECT r.*, CASE WHEN charging_station_id IS NULL THEN 'incomplete key'
      WHEN avg_pwr_kw < 0 OR max_energy_wh < 0 THEN 'invalid'
      WHEN max_energy_wh > e99 OR avg_pwr_kw > p99 THEN 'outlier'
      WHEN avg_pwr_kw = 0 AND max_energy_wh = 0 THEN 'dead'
      WHEN active_session_count = 0 THEN 'no session'
      WHEN active_session_count IS NULL THEN 'unknown count' END AS so_far
    FROM faulty_resolved AS r, faulty_limits""",
    "faulty_verdicts": """
    SELECT * EXCLUDE (so_far), coalesce(so_far, CASE WHEN row_number() OVER (
      PARTITION BY charging_station_id, so_far IS NULL ORDER BY "timestamp" DESC, charger_id DESC) > 300
      THEN 'over the cap' END) AS verdict FROM faulty_judged""",
    # legacy cleaning
    "legacy_unique": f"""
    SELECT * EXCLUDE (_nth) FROM (SELECT *, row_number() OVER (PARTITION BY {_READING}
      ORDER BY max_energy_wh DESC NULLS LAST, avg_pwr_kw DESC NULLS LAST,
        active_session_count DESC NULLS LAST, soc_pct DESC NULLS LAST) AS _nth FROM uniq)
    WHERE _nth = 1""",
    "legacy_kept": """
    SELECT * FROM legacy_unique WHERE avg_pwr_kw >= 0 AND max_energy_wh >= 0
      AND active_session_count <> 0 AND NOT (avg_pwr_kw = 0 AND max_energy_wh = 0)""",
    "legacy_limits": """SELECT quantile_cont(max_energy_wh, 0.995) AS e995,
      quantile_cont(avg_pwr_kw, 0.995) AS p995 FROM legacy_kept""",
    "legacy_cleaned": f"""
    SELECT {_READING},
      CASE WHEN avg_pwr_kw > p995 THEN p995 ELSE avg_pwr_kw END AS avg_pwr_kw,
      CASE WHEN max_energy_wh > e995 THEN e995 ELSE max_energy_wh END AS max_energy_wh,
      active_session_count, soc_pct,
      hour("timestamp") AS hour, isodow("timestamp") - 1 AS day_of_week,
      month("timestamp") AS month, CAST(isodow("timestamp") >= 6 AS INT) AS is_weekend,
      round(sin(2 * pi() * hour("timestamp") / 24), 4) AS hour_sin,
      round(cos(2 * pi() * hour("timestamp") / 24), 4) AS hour_cos,
      CASE month("timestamp") WHEN 11 THEN 1 WHEN 12 THEN 2 ELSE 3 END AS collection_period
    FROM legacy_kept, legacy_limits""",
    # charger-level features
    "flagged": "SELECT *, CAST(coalesce(avg_pwr_kw = 0, false) AS INT) AS is_idle_charger FROM cleaned",
    "labelled": _split("flagged", "charging_station_id, charger_id", "drop"),
    "station_stats": """
    SELECT charging_station_id, avg(max_energy_wh) AS station_mean_energy_wh,
      median(max_energy_wh) AS station_median_energy_wh, avg(avg_pwr_kw) AS station_mean_power_kw,
      max(avg_pwr_kw) AS station_max_power_kw, count(DISTINCT charger_id) AS station_charger_count
    FROM labelled WHERE split = 'train' GROUP BY 1""",
    "charger_stats": """
    SELECT charger_id, avg(max_energy_wh) AS charger_mean_energy_wh,
      median(max_energy_wh) AS charger_median_energy_wh
    FROM labelled WHERE split = 'train' GROUP BY 1""",
    "charger_peaks": """
    SELECT charger_id, max(max_energy_wh) AS charger_max_energy_wh,
      avg(max_energy_wh) AS charger_mean_energy_wh
    FROM labelled WHERE split = 'train' GROUP BY 1""",
    "energy_features": """
    SELECT *, CAST(hour >= 2 AS INT) AS is_late_night FROM labelled
    LEFT JOIN station_stats USING (charging_station_id) LEFT JOIN charger_stats USING (charger_id)""",
    "soc_features": """
    SELECT * EXCLUDE (_nth, _n), CASE WHEN _nth <= floor(_n * CAST(0.8 AS DOUBLE)) THEN 'train'
      WHEN _nth <= floor(_n * CAST(0.9 AS DOUBLE)) THEN 'val' ELSE 'test' END AS split
    FROM (SELECT *, row_number() OVER (ORDER BY "timestamp", charging_station_id, charger_id) AS _nth,
      count(*) OVER () AS _n FROM flagged WHERE soc_pct IS NOT NULL)""",
    "leftover_features": """
    SELECT *, charger_max_energy_wh * 1.1 AS estimated_capacity_wh,
      CASE WHEN charger_max_energy_wh * 1.1 - max_energy_wh < 0 THEN 0
           ELSE charger_max_energy_wh * 1.1 - max_energy_wh END AS leftover_energy_wh
    FROM labelled LEFT JOIN charger_peaks USING (charger_id)""",
    "base_stats": """
    SELECT charging_station_id, avg(max_energy_wh) AS station_mean_energy_wh,
      avg(avg_pwr_kw) AS station_mean_power_kw FROM cleaned GROUP BY 1""",
    "base_peaks": "SELECT charger_id, max(max_energy_wh) AS charger_max_energy_wh FROM cleaned GROUP BY 1",
    "charger_base": """
    SELECT *, CAST(hour >= 2 AS INT) AS is_late_night,
      charger_max_energy_wh * 1.1 AS estimated_capacity_wh,
      CASE WHEN charger_max_energy_wh * 1.1 - max_energy_wh < 0 THEN 0
           ELSE charger_max_energy_wh * 1.1 - max_energy_wh END AS leftover_energy_wh,
      CASE WHEN max_energy_wh > 0 THEN avg_pwr_kw / (max_energy_wh / 1000) END AS power_to_energy_ratio
    FROM cleaned LEFT JOIN base_stats USING (charging_station_id) LEFT JOIN base_peaks USING (charger_id)""",
    "legacy_stations": """
    SELECT charging_station_id, avg(max_energy_wh) AS station_mean_energy_wh,
      median(max_energy_wh) AS station_median_energy_wh,
      stddev_samp(max_energy_wh) AS station_std_energy_wh,
      avg(avg_pwr_kw) AS station_mean_power_kw, max(avg_pwr_kw) AS station_max_power_kw,
      count(DISTINCT charger_id) AS station_charger_count FROM legacy_cleaned GROUP BY 1""",
    "legacy_chargers": """
    SELECT charger_id, avg(max_energy_wh) AS charger_mean_energy_wh,
      max(max_energy_wh) AS charger_max_energy_wh, avg(avg_pwr_kw) AS charger_mean_power_kw
    FROM legacy_cleaned GROUP BY 1""",
    "legacy_labelled": _split("legacy_cleaned", "charging_station_id, charger_id", "drop"),
    "legacy_features": """
    SELECT *, CAST(hour >= 2 AS INT) AS is_late_night,
      collection_period * 10 + hour AS period_hour_interaction,
      CASE WHEN max_energy_wh > 0 THEN avg_pwr_kw / (max_energy_wh / 1000) END AS power_to_energy_ratio,
      charger_max_energy_wh * 1.1 AS estimated_capacity_wh,
      CASE WHEN charger_max_energy_wh * 1.1 - max_energy_wh < 0 THEN 0
           ELSE charger_max_energy_wh * 1.1 - max_energy_wh END AS leftover_energy_wh
    FROM legacy_labelled LEFT JOIN legacy_stations USING (charging_station_id)
      LEFT JOIN legacy_chargers USING (charger_id)""",
    # station-level features
    "snapshots": f"""
    SELECT charging_station_id, "timestamp", count(*) FILTER (WHERE avg_pwr_kw > 0) AS active_chargers,
      count(charger_id) AS total_chargers, coalesce(sum(avg_pwr_kw), 0) AS total_power_kw, {_TIME_MIN}
    FROM cleaned GROUP BY 1, 2""",
    "lagged": """
    SELECT *, lag(active_chargers, 1) OVER w AS lag_1_active, lag(active_chargers, 2) OVER w AS lag_2_active,
      lag(total_power_kw, 1) OVER w AS lag_1_power_kw,
      avg(active_chargers) OVER (w ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING) AS roll_3_active,
      avg(active_chargers) OVER (w ROWS BETWEEN 6 PRECEDING AND 1 PRECEDING) AS roll_6_active
    FROM snapshots WINDOW w AS (PARTITION BY charging_station_id ORDER BY "timestamp")""",
    "lagged_unbroken": """
    SELECT * EXCLUDE (roll_6_active), avg(lag_1_active) OVER (
      ORDER BY charging_station_id, "timestamp" ROWS BETWEEN 5 PRECEDING AND CURRENT ROW) AS roll_6_active
    FROM lagged""",
    "complete": "SELECT * FROM lagged WHERE lag_1_active IS NOT NULL AND lag_2_active IS NOT NULL",
    "congestion_features": _split("complete", "charging_station_id", "train"),
    "complete_unbroken": """
    SELECT * FROM lagged_unbroken WHERE lag_1_active IS NOT NULL AND lag_2_active IS NOT NULL""",
    "congestion_unbroken": _split("complete_unbroken", "charging_station_id", "train"),
    "demand": f"""
    SELECT charging_station_id, "timestamp", coalesce(sum(max_energy_wh), 0) AS total_energy_wh,
      count(charger_id) AS total_chargers, count(*) FILTER (WHERE avg_pwr_kw > 0) AS active_chargers,
      avg(max_energy_wh) AS avg_energy_per_charger, max(avg_pwr_kw) AS peak_power_kw, {_TIME_MIN},
      count(*) FILTER (WHERE avg_pwr_kw > 0) / CAST(count(charger_id) AS DOUBLE) AS utilization_rate
    FROM cleaned GROUP BY 1, 2""",
    "demand_labelled": _split("demand", "charging_station_id", "drop"),
    "demand_stats": """
    SELECT charging_station_id, avg(total_energy_wh) AS station_avg_hourly_demand,
      max(total_energy_wh) AS station_peak_hourly_demand
    FROM demand_labelled WHERE split = 'train' GROUP BY 1""",
    "demand_features": "SELECT * FROM demand_labelled LEFT JOIN demand_stats USING (charging_station_id)",
    # baseline predictions on the test rows
    "predicted": """
    SELECT max_energy_wh AS y, station_mean_energy_wh AS p FROM energy_features WHERE split = 'test'""",
    # requests
    "requests": """
    SELECT event_id AS request_id,
      CASE WHEN event_id % 50 <> 0 THEN 'S' || CAST(user_id % 120 AS varchar) END AS station_id,
      'C' || CAST(user_id % 120 AS varchar) || '-' || CAST(event_id % 9 AS varchar) AS charger_id,
      CASE WHEN event_id % 97 = 0 THEN 'soon' ELSE strftime(ts, '%Y-%m-%d') END AS target_date,
      CASE WHEN event_id % 7 <> 0 THEN CAST(event_id % 26 AS int) END AS hour,
      CASE WHEN event_id % 5 = 0 THEN CAST(0 AS DOUBLE) WHEN event_id % 11 <> 0 THEN value END AS power_kw,
      CASE WHEN event_id % 13 <> 0 THEN value * 1000 END AS energy_wh,
      CASE WHEN event_id % 3 = 0 THEN CAST(event_id % 4 AS int) END AS total_chargers,
      CASE WHEN event_id % 4 = 0 THEN CAST(event_id % 3 AS DOUBLE) END AS lag_1_active
    FROM events""",
    "energy_typed": f"""
    SELECT request_id, station_id, charger_id, {request_time(18)},
      coalesce(power_kw, 25) AS avg_pwr_kw FROM requests""",
    "energy_requests": f"SELECT *, {_REQUEST_TIME} FROM energy_typed WHERE {_valid('station_id charger_id')}",
    "soc_typed": f"""
    SELECT request_id, station_id, charger_id, {request_time(1)},
      coalesce(power_kw, 18.4) AS avg_pwr_kw, coalesce(energy_wh, 52560) AS max_energy_wh FROM requests""",
    "soc_requests": f"SELECT *, {_REQUEST_TIME} FROM soc_typed WHERE {_valid('station_id charger_id')}",
    "congestion_typed": f"""
    SELECT request_id, station_id, {request_time(17)}, total_chargers,
      coalesce(lag_1_active, 0) AS lag_1_active FROM requests""",
    "congestion_requests": f"SELECT *, {_REQUEST_TIME} FROM congestion_typed WHERE {_valid('station_id')}",
    "demand_typed": f"""
    SELECT request_id, station_id, {request_time(17)},
      coalesce(CAST(total_chargers AS DOUBLE), 1) AS total_chargers,
      coalesce(power_kw, 0) AS peak_power_kw FROM requests""",
    "demand_requests": f"SELECT *, {_REQUEST_TIME} FROM demand_typed WHERE {_valid('station_id')}",
    "leftover_typed": f"""
    SELECT request_id, charger_id, station_id, {request_time(17)},
      coalesce(power_kw, 0) AS current_power_kw, coalesce(energy_wh, 0) AS energy_consumed_wh
    FROM requests""",
    "leftover_requests": f"SELECT *, {_REQUEST_TIME} FROM leftover_typed WHERE {_valid('charger_id')}",
    # history
    "energy_stations": """
    SELECT charging_station_id AS station_id, max(station_mean_energy_wh) AS s1,
      max(station_median_energy_wh) AS s2, max(station_mean_power_kw) AS s3,
      max(station_max_power_kw) AS s4, max(station_charger_count) AS s5
    FROM energy_features GROUP BY 1""",
    "energy_chargers": """
    SELECT charger_id, max(charger_mean_energy_wh) AS c1, max(charger_median_energy_wh) AS c2
    FROM energy_features GROUP BY 1""",
    "energy_overall": """
    SELECT avg(station_mean_energy_wh) AS g1, avg(station_median_energy_wh) AS g2,
      avg(station_mean_power_kw) AS g3, avg(station_max_power_kw) AS g4 FROM energy_features""",
    "energy_looked_up": """
    SELECT r.*, s.station_id IS NOT NULL AS sk, c.charger_id IS NOT NULL AS ck,
      CASE WHEN sk THEN s1 ELSE g1 END AS a1, CASE WHEN sk THEN s2 ELSE g2 END AS a2,
      CASE WHEN sk THEN s3 ELSE g3 END AS a3, CASE WHEN sk THEN s4 ELSE g4 END AS a4,
      CASE WHEN sk THEN s5 ELSE 1 END AS a5,
      coalesce(a1, -999) AS station_mean_energy_wh, coalesce(a2, -999) AS station_median_energy_wh,
      coalesce(a3, -999) AS station_mean_power_kw, coalesce(a4, -999) AS station_max_power_kw,
      coalesce(a5, -999) AS station_charger_count,
      coalesce(CASE WHEN ck THEN c1 ELSE a1 END, -999) AS charger_mean_energy_wh,
      coalesce(CASE WHEN ck THEN c2 ELSE a2 END, -999) AS charger_median_energy_wh
    FROM energy_requests AS r LEFT JOIN energy_stations AS s ON r.station_id = s.station_id
      LEFT JOIN energy_chargers AS c ON r.charger_id = c.charger_id, energy_overall""",
    "station_sizes": """
    SELECT charging_station_id AS station_id, max(total_chargers) AS size
    FROM congestion_features GROUP BY 1""",
    "demand_history": """
    SELECT charging_station_id AS station_id, max(total_chargers) AS h1,
      avg(station_avg_hourly_demand) AS h2, max(station_peak_hourly_demand) AS h3
    FROM demand_features GROUP BY 1""",
    "charger_history": """
    SELECT charger_id, max(charger_max_energy_wh) AS m1, avg(charger_mean_energy_wh) AS m2,
      arg_min(charging_station_id, {'t': "timestamp", 's': charging_station_id}) AS st
    FROM leftover_features GROUP BY 1""",
    "leftover_looked_up": """
    SELECT r.* EXCLUDE (station_id), h.charger_id IS NOT NULL AS known,
      CASE WHEN known THEN st ELSE 'unknown' END AS station_id,
      CASE WHEN known THEN m1 ELSE energy_consumed_wh * 1.5 END AS charger_max_energy_wh,
      CASE WHEN known THEN m2 ELSE energy_consumed_wh END AS charger_mean_energy_wh
    FROM leftover_requests AS r LEFT JOIN charger_history AS h ON r.charger_id = h.charger_id""",
}


def with_tables(sql: str, capped: bool = True) -> str:
    """Prefix ``sql`` with the named tables it needs, each after the ones it reads.

    Without ``capped``, ``cleaned`` holds all typed readings.
    """
    tables = TABLES if capped else TABLES | {"cleaned": "SELECT * FROM typed"}
    needed: list[str] = []

    def need(text: str) -> None:
        for name in tables:
            if name not in needed and re.search(rf"(?:FROM|JOIN|,)\s+{name}\b", text):
                need(tables[name])
                if name not in needed:
                    needed.append(name)

    need(sql)
    if not needed:
        return sql
    ctes = ",\n".join(f"{name} AS ({tables[name]})" for name in needed)
    return f"WITH {ctes}\n{sql}"
