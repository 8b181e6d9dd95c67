"""Request validation, history lookups, feature rows, responses and stream scoring."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chargeweave.plans import models
from chargeweave.plans import requests as rq
from chargeweave.schemas import LAG_COLUMNS, PRODUCTS
from chargeweave.session import new_folder, stage
from chargeweave.streaming.scoring import read_request_stream, write_predictions
from querybook.lake import Lake
from querybook.registry import query

# The fixture's request columns under each product's field names.
FIELDS = {
    "energy": {"power_kw": "avg_pwr_kw"},
    "soc": {"power_kw": "avg_pwr_kw", "energy_wh": "max_energy_wh"},
    "congestion": {},
    "demand": {"power_kw": "peak_power_kw"},
    "leftover": {"power_kw": "current_power_kw", "energy_wh": "energy_consumed_wh"},
}
TIME = (
    "hour:i day_of_week:i month:i is_weekend:i hour_sin:r9 hour_cos:r9 collection_period:i"
)
STATION_STATS = (
    "station_mean_energy_wh:f station_median_energy_wh:f station_mean_power_kw:f "
    "station_max_power_kw:f station_charger_count:f charger_mean_energy_wh:f charger_median_energy_wh:f"
)


def asked(lake: Lake, product: str) -> DataFrame:
    return lake.requests.withColumnsRenamed(FIELDS[product])


def valid(lake: Lake, product: str) -> DataFrame:
    return rq.valid_requests(asked(lake, product), product)


def _check_sql(product: str, required: str) -> str:
    missing = " ".join(f"WHEN {c} IS NULL THEN '{c} is required'" for c in required.split())
    return f"""SELECT *, CASE {missing}
      WHEN target_date IS NULL THEN 'target_date is not an ISO date'
      WHEN hour NOT BETWEEN 0 AND 23 THEN 'hour is not in 0-23' END AS reject_reason
    FROM {product}_typed"""


_REQUIRED = {
    "energy": "station_id charger_id",
    "soc": "station_id charger_id",
    "congestion": "station_id",
    "demand": "station_id",
    "leftover": "charger_id",
}
_CHECKED = {
    "energy": "request_id:i station_id charger_id hour:i avg_pwr_kw:f reject_reason",
    "soc": "request_id:i station_id charger_id hour:i avg_pwr_kw:f max_energy_wh:f reject_reason",
    "congestion": "request_id:i station_id hour:i total_chargers:f lag_1_active:f reject_reason",
    "demand": "request_id:i station_id hour:i total_chargers:f peak_power_kw:f reject_reason",
    "leftover": "request_id:i charger_id hour:i current_power_kw:f energy_consumed_wh:f reject_reason",
}


def _register_checks() -> None:
    for product, spec in _CHECKED.items():
        @query(f"r1_check_{product}_requests", spec, _check_sql(product, _REQUIRED[product]))
        def check(lake: Lake, product: str = product) -> DataFrame:
            return rq.check_requests(asked(lake, product), product)


_register_checks()


@query(
    "r1_rejected_requests",
    "request_id:i reject_reason",
    f"SELECT * FROM ({_check_sql('energy', _REQUIRED['energy'])}) WHERE reject_reason IS NOT NULL",
)
def r1_rejected(lake: Lake) -> DataFrame:
    return rq.rejected_requests(asked(lake, "energy"), "energy")


# -- lookups -----------------------------------------------------------------------------------


def energy_rows(lake: Lake) -> DataFrame:
    history = rq.energy_history(lake.features("energy"))
    return rq.feature_rows(rq.with_energy_history(valid(lake, "energy"), history), "energy")


def congestion_rows(lake: Lake) -> DataFrame:
    sizes = rq.station_sizes(lake.features("congestion"))
    return rq.feature_rows(rq.with_station_size(valid(lake, "congestion"), sizes), "congestion")


def demand_rows(lake: Lake) -> DataFrame:
    history = rq.demand_history(lake.features("demand"))
    return rq.feature_rows(rq.with_demand_history(valid(lake, "demand"), history), "demand")


def leftover_rows(lake: Lake) -> DataFrame:
    history = rq.charger_history(lake.features("leftover"))
    return rq.feature_rows(rq.with_charger_history(valid(lake, "leftover"), history), "leftover")


@query("j5_energy_history", f"request_id:i station_id charger_id {STATION_STATS}", "SELECT * FROM energy_looked_up")
def j5(lake: Lake) -> DataFrame:
    return energy_rows(lake)


@query(
    "j6_station_size",
    "request_id:i station_id total_chargers:i",
    """SELECT request_id, r.station_id, coalesce(size, 1) AS total_chargers
    FROM congestion_requests AS r LEFT JOIN station_sizes AS s USING (station_id)""",
)
def j6(lake: Lake) -> DataFrame:
    return congestion_rows(lake)


_DEMAND_SQL = """SELECT r.* EXCLUDE (total_chargers), CASE WHEN h.station_id IS NULL THEN 1 ELSE h1 END AS total_chargers,
    CASE WHEN h.station_id IS NULL THEN 0 ELSE h2 END AS station_avg_hourly_demand,
    CASE WHEN h.station_id IS NULL THEN 0 ELSE h3 END AS station_peak_hourly_demand
    FROM demand_requests AS r LEFT JOIN demand_history AS h ON r.station_id = h.station_id"""


@query("j7_demand_history", "request_id:i station_id total_chargers:f station_avg_hourly_demand:f station_peak_hourly_demand:f", _DEMAND_SQL)
def j7(lake: Lake) -> DataFrame:
    return demand_rows(lake)


@query("j8_charger_history", "request_id:i charger_id station_id charger_max_energy_wh:f charger_mean_energy_wh:f", "SELECT * FROM leftover_looked_up")
def j8(lake: Lake) -> DataFrame:
    return leftover_rows(lake)


# -- feature rows ------------------------------------------------------------------------------


@query(
    "r2_energy_inputs",
    f"request_id:i charging_station_id charger_id {TIME} is_late_night:i avg_pwr_kw:f "
    f"active_session_count:i is_idle_charger:i {STATION_STATS}",
    """SELECT *, station_id AS charging_station_id, CAST(hour >= 2 AS INT) AS is_late_night,
    1 AS active_session_count, CAST(avg_pwr_kw = 0 AS INT) AS is_idle_charger FROM energy_looked_up""",
)
def r2(lake: Lake) -> DataFrame:
    return rq.model_inputs(energy_rows(lake), "energy", ["request_id"])


@query(
    "r2_energy_inputs_without_history",
    f"request_id:i charging_station_id charger_id avg_pwr_kw:f {STATION_STATS}",
    """SELECT *, station_id AS charging_station_id, -999 AS station_mean_energy_wh,
    -999 AS station_median_energy_wh, -999 AS station_mean_power_kw, -999 AS station_max_power_kw,
    -999 AS station_charger_count, -999 AS charger_mean_energy_wh, -999 AS charger_median_energy_wh
    FROM energy_requests""",
)
def r2_plain(lake: Lake) -> DataFrame:
    return rq.model_inputs(rq.feature_rows(valid(lake, "energy"), "energy"), "energy", ["request_id"])


@query(
    "r3_soc_inputs",
    f"request_id:i charging_station_id charger_id {TIME} avg_pwr_kw:f is_idle_charger:i max_energy_wh:f",
    """SELECT *, station_id AS charging_station_id, CAST(avg_pwr_kw = 0 AS INT) AS is_idle_charger
    FROM soc_requests""",
)
def r3(lake: Lake) -> DataFrame:
    return rq.model_inputs(rq.feature_rows(valid(lake, "soc"), "soc"), "soc", ["request_id"])


_CONGESTION_SQL = """SELECT r.* EXCLUDE (total_chargers), r.station_id AS charging_station_id,
    coalesce(size, 1) AS total_chargers, 0 AS lag_2_active, 0 AS lag_1_power_kw, 0 AS roll_3_active,
    0 AS roll_6_active FROM congestion_requests AS r LEFT JOIN station_sizes AS s ON r.station_id = s.station_id"""
_LAGS = " ".join(f"{c}:f" for c in LAG_COLUMNS)


@query("r4_congestion_inputs", f"request_id:i charging_station_id total_chargers:i {TIME} {_LAGS}", _CONGESTION_SQL)
def r4(lake: Lake) -> DataFrame:
    return rq.model_inputs(congestion_rows(lake), "congestion", ["request_id"])


@query(
    "r4_congestion_inputs_as_sent",
    f"request_id:i charging_station_id total_chargers:i {TIME} lag_1_active:f",
    """SELECT * REPLACE (coalesce(total_chargers, 1) AS total_chargers), station_id AS charging_station_id
    FROM congestion_requests""",
)
def r4_plain(lake: Lake) -> DataFrame:
    rows = rq.feature_rows(valid(lake, "congestion"), "congestion")
    return rq.model_inputs(rows, "congestion", ["request_id"])


@query(
    "r5_demand_inputs",
    f"request_id:i charging_station_id total_chargers:f active_chargers:f utilization_rate:f "
    f"avg_energy_per_charger:f peak_power_kw:f station_avg_hourly_demand:f station_peak_hourly_demand:f {TIME}",
    f"""SELECT *, station_id AS charging_station_id, 0 AS active_chargers, 0 AS utilization_rate,
    0 AS avg_energy_per_charger FROM ({_DEMAND_SQL})""",
)
def r5(lake: Lake) -> DataFrame:
    return rq.model_inputs(demand_rows(lake), "demand", ["request_id"])


_LEFTOVER_SQL = """SELECT *, station_id AS charging_station_id, current_power_kw AS avg_pwr_kw,
    CAST(current_power_kw > 0 AS INT) AS active_session_count,
    CAST(current_power_kw = 0 AS INT) AS is_idle_charger, energy_consumed_wh AS max_energy_wh,
    charger_max_energy_wh * 1.1 AS estimated_capacity_wh
    FROM (SELECT * REPLACE (coalesce(charger_max_energy_wh, energy_consumed_wh * 1.5) AS charger_max_energy_wh,
      coalesce(charger_mean_energy_wh, energy_consumed_wh) AS charger_mean_energy_wh) FROM leftover_looked_up)"""


@query(
    "r6_leftover_inputs",
    f"request_id:i charging_station_id charger_id {TIME} avg_pwr_kw:f active_session_count:i is_idle_charger:i "
    "max_energy_wh:f charger_max_energy_wh:f charger_mean_energy_wh:f estimated_capacity_wh:f",
    _LEFTOVER_SQL,
)
def r6(lake: Lake) -> DataFrame:
    return rq.model_inputs(leftover_rows(lake), "leftover", ["request_id"])


# -- responses to a given prediction -----------------------------------------------------------


@query(
    "r7_energy_response",
    "request_id:i predicted_energy_wh:f predicted_energy_kwh:f",
    """SELECT request_id, CASE WHEN x < 0 THEN 0 ELSE x END AS predicted_energy_wh,
    CASE WHEN x < 0 THEN 0 ELSE x END / 1000 AS predicted_energy_kwh
    FROM (SELECT request_id, avg_pwr_kw * 1000 - 20000 AS x FROM energy_requests)""",
)
def r7_energy(lake: Lake) -> DataFrame:
    guess = F.col("avg_pwr_kw") * 1000 - 20000
    return rq.responses(valid(lake, "energy").withColumn("prediction", guess), "energy")


@query(
    "r7_soc_response",
    "request_id:i predicted_soc_pct:f",
    """SELECT request_id, CASE WHEN x < 0 THEN 0 WHEN x > 100 THEN 100 ELSE x END AS predicted_soc_pct
    FROM (SELECT request_id, max_energy_wh / 400 - 20 AS x FROM soc_requests)""",
)
def r7_soc(lake: Lake) -> DataFrame:
    guess = F.col("max_energy_wh") / 400 - 20
    return rq.responses(valid(lake, "soc").withColumn("prediction", guess), "soc")


@query(
    "r7_congestion_response",
    "request_id:i predicted_active_chargers:f total_chargers:i predicted_occupancy_pct:f occupancy_band note",
    f"""SELECT *, CASE WHEN predicted_occupancy_pct > 80 THEN 'high' WHEN predicted_occupancy_pct < 30 THEN 'open' END
      AS occupancy_band, CASE WHEN lag_1_active = 0 THEN '{rq.measures.PROVISIONAL_NOTE}' END AS note
    FROM (SELECT *, CASE WHEN t > 0 THEN predicted_active_chargers / t * 100 ELSE 0 END AS predicted_occupancy_pct
      FROM (SELECT *, t AS total_chargers,
        CASE WHEN CASE WHEN x > t THEN t ELSE x END < 0 THEN 0 WHEN x > t THEN t ELSE x END AS predicted_active_chargers
        FROM (SELECT request_id, lag_1_active, coalesce(CAST(total_chargers AS DOUBLE), 1) AS t,
          hour / CAST(6 AS DOUBLE) - 0.5 AS x FROM congestion_requests)))""",
)
def r7_congestion(lake: Lake) -> DataFrame:
    rows = rq.feature_rows(valid(lake, "congestion"), "congestion")
    return rq.responses(rows.withColumn("prediction", F.col("hour") / 6.0 - 0.5), "congestion")


@query(
    "r7_demand_response",
    "request_id:i predicted_demand_wh:f predicted_demand_kwh:f avg_per_charger_wh:f ratio_to_history:f",
    f"""SELECT *, wh AS predicted_demand_wh, wh / 1000 AS predicted_demand_kwh,
      CASE WHEN total_chargers > 0 THEN wh / total_chargers ELSE 0 END AS avg_per_charger_wh,
      CASE WHEN station_avg_hourly_demand > 0 THEN wh / station_avg_hourly_demand END AS ratio_to_history
    FROM (SELECT *, CASE WHEN peak_power_kw * 2000 - 10000 < 0 THEN 0 ELSE peak_power_kw * 2000 - 10000 END AS wh
      FROM ({_DEMAND_SQL}))""",
)
def r7_demand(lake: Lake) -> DataFrame:
    guess = F.col("peak_power_kw") * 2000 - 10000
    return rq.responses(demand_rows(lake).withColumn("prediction", guess), "demand")


@query(
    "r7_leftover_response",
    "request_id:i predicted_leftover_wh:f predicted_leftover_kwh:f estimated_capacity_wh:f utilization_pct:f session_band",
    f"""SELECT *, wh AS predicted_leftover_wh, wh / 1000 AS predicted_leftover_kwh,
      CASE WHEN utilization_pct > 90 THEN 'nearly complete' WHEN utilization_pct > 50 THEN 'in progress'
        ELSE 'early' END AS session_band
    FROM (SELECT *, CASE WHEN estimated_capacity_wh - max_energy_wh < 0 THEN 0
        ELSE estimated_capacity_wh - max_energy_wh END AS wh,
      CASE WHEN estimated_capacity_wh > 0 THEN max_energy_wh / estimated_capacity_wh * 100 ELSE 0 END AS utilization_pct
      FROM ({_LEFTOVER_SQL}))""",
)
def r7_leftover(lake: Lake) -> DataFrame:
    guess = F.col("estimated_capacity_wh") - F.col("max_energy_wh")
    return rq.responses(leftover_rows(lake).withColumn("prediction", guess), "leftover")


# -- responses of fitted models ----------------------------------------------------------------

_ROWS = {
    "energy": energy_rows,
    "soc": lambda lake: rq.feature_rows(valid(lake, "soc"), "soc"),
    "congestion": congestion_rows,
    "demand": demand_rows,
    "leftover": leftover_rows,
}
_RESPONSE = {
    "energy": "predicted_energy_wh:f predicted_energy_kwh:f",
    "soc": "predicted_soc_pct:f",
    "congestion": "predicted_active_chargers:f total_chargers:i predicted_occupancy_pct:f note",
    "demand": "predicted_demand_wh:f predicted_demand_kwh:f avg_per_charger_wh:f",
    "leftover": "predicted_leftover_wh:f predicted_leftover_kwh:f estimated_capacity_wh:f utilization_pct:f",
}


def _register_scores() -> None:
    for product, spec in _RESPONSE.items():
        @query(f"r7_score_{product}", f"request_id:i {spec}")
        def score(lake: Lake, product: str = product) -> DataFrame:
            rows = _ROWS[product](lake)
            kept = [c for c in rows.columns if c not in PRODUCTS[product].feature_columns()]
            inputs = rq.model_inputs(rows, product, kept)
            return rq.responses(lake.model(product).predict(inputs), product)


_register_scores()


@query("r8_stream_scoring", f"request_id:i charging_station_id charger_id {TIME} avg_pwr_kw:f {STATION_STATS}", "SELECT *, station_id AS charging_station_id FROM energy_looked_up")
def r8(lake: Lake) -> DataFrame:
    """The energy inputs of r2, but the requests arrive as a stream of files."""
    # staged, or every micro-batch would aggregate the history again
    history = tuple(stage(t, "history") for t in rq.energy_history(lake.features("energy")))

    def score(requests: DataFrame) -> DataFrame:
        known = rq.valid_requests(requests, "energy")
        rows = rq.feature_rows(rq.with_energy_history(known, history), "energy")
        return rq.model_inputs(rows, "energy", ["request_id"])

    return _streamed(lake, score)


def _streamed(lake: Lake, score: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """What a stream writes for all energy requests, which arrive in four files, two a micro-batch."""
    arrived = new_folder(lake.spark, "requests")
    asked(lake, "energy").repartition(4, "request_id").write.parquet(arrived)
    path, checkpoint = new_folder(lake.spark, "scored"), new_folder(lake.spark, "stream_checkpoint")
    schema = asked(lake, "energy").schema
    stream = read_request_stream(lake.spark, arrived, schema, files_per_batch=2)
    write_predictions(stream, score, path, checkpoint).awaitTermination()
    return lake.spark.read.parquet(path)


@query(
    "r8_stream_line",
    "request_id:i predicted_energy_wh:f predicted_energy_kwh:f",
    """SELECT request_id, greatest(slope * avg_pwr_kw + base, 0) AS predicted_energy_wh,
      greatest(slope * avg_pwr_kw + base, 0) / 1000 AS predicted_energy_kwh
    FROM energy_requests, (SELECT regr_slope(max_energy_wh, avg_pwr_kw) AS slope,
      regr_intercept(max_energy_wh, avg_pwr_kw) AS base FROM energy_features WHERE split = 'train')""",
)
def r8_line(lake: Lake) -> DataFrame:
    """Predictions on a stream, of the least-squares line of energy on power."""
    line = models.Line.fit(lake.features("energy"), PRODUCTS["energy"], "avg_pwr_kw")
    return _streamed(lake, rq.Scorer.over("energy", line.predict, lake.features("energy")))


@query("r8_stream_predictions", "request_id:i predicted_energy_wh:f predicted_energy_kwh:f")
def r8_predictions(lake: Lake) -> DataFrame:
    """Predictions on a stream, of the boosted trees."""
    fitted = lake.model("energy")
    return _streamed(lake, rq.Scorer.over("energy", fitted.predict, lake.features("energy")))
