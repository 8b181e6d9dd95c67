"""Fixed schemas, column contracts and the registry of the five prediction products."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import types as T

STATION = "charging_station_id"
CHARGER = "charger_id"
TS = "timestamp"
POWER = "avg_pwr_kw"
ENERGY = "max_energy_wh"
SESSIONS = "active_session_count"
SOC = "soc_pct"
PERIOD = "collection_period"
SPLIT = "split"

READING_KEYS = [STATION, CHARGER, TS]
METRICS = [POWER, ENERGY, SESSIONS, SOC]
TIME_INTS = ["hour", "day_of_week", "month", "is_weekend"]
TIME_COLUMNS = [*TIME_INTS, "hour_sin", "hour_cos"]

# Telemetry as delivered: the timestamp is still text, counts may be fractional after merging.
RAW_SCHEMA = T.StructType(
    [
        T.StructField(STATION, T.StringType()),
        T.StructField(CHARGER, T.StringType()),
        T.StructField(TS, T.StringType()),
        T.StructField(POWER, T.DoubleType()),
        T.StructField(ENERGY, T.DoubleType()),
        T.StructField(SESSIONS, T.DoubleType()),
        T.StructField(SOC, T.DoubleType()),
        T.StructField("hour", T.DoubleType()),
        T.StructField("day_of_week", T.DoubleType()),
        T.StructField("month", T.DoubleType()),
        T.StructField("is_weekend", T.DoubleType()),
        T.StructField("hour_sin", T.DoubleType()),
        T.StructField("hour_cos", T.DoubleType()),
    ]
)

# Search-hit export: {"hits": {"hits": [{"_source": {...}}]}}
HIT_SOURCE_SCHEMA = T.StructType(
    [
        T.StructField("station_id", T.StringType()),
        T.StructField("charger_id", T.StringType()),
        T.StructField("timestamp", T.StringType()),
        T.StructField("power_kw", T.DoubleType()),
        T.StructField("energy_wh", T.DoubleType()),
        T.StructField("active_session_count", T.DoubleType()),
        T.StructField("soc_pct", T.DoubleType()),
    ]
)
SEARCH_HITS_SCHEMA = T.StructType(
    [
        T.StructField(
            "hits",
            T.StructType(
                [
                    T.StructField(
                        "hits",
                        T.ArrayType(T.StructType([T.StructField("_source", HIT_SOURCE_SCHEMA)])),
                    )
                ]
            ),
        )
    ]
)
HIT_FIELD_NAMES = {"station_id": STATION, "power_kw": POWER, "energy_wh": ENERGY}

METRICS_SCHEMA = T.StructType(
    [
        T.StructField("model", T.StringType()),
        T.StructField("rmse", T.DoubleType()),
        T.StructField("mae", T.DoubleType()),
        T.StructField("r2", T.DoubleType()),
        T.StructField("mape", T.DoubleType()),
        T.StructField("test_rows", T.LongType()),
    ]
)

CLEANED = [*READING_KEYS, POWER, ENERGY, SESSIONS, SOC, *TIME_COLUMNS, PERIOD]

CHARGER_BASE = [
    *CLEANED,
    "is_late_night",
    "estimated_capacity_wh",
    "leftover_energy_wh",
    "power_to_energy_ratio",
    "station_mean_energy_wh",
    "station_mean_power_kw",
]

STATION_AGGREGATES = [
    "station_mean_energy_wh",
    "station_median_energy_wh",
    "station_mean_power_kw",
    "station_max_power_kw",
    "station_charger_count",
]
CHARGER_AGGREGATES = ["charger_mean_energy_wh", "charger_median_energy_wh"]

ENERGY_FEATURES = [
    *READING_KEYS, SPLIT, PERIOD, *TIME_INTS, "is_late_night", "hour_sin", "hour_cos",
    POWER, SESSIONS, "is_idle_charger", *STATION_AGGREGATES, *CHARGER_AGGREGATES, ENERGY,
]

SOC_FEATURES = [*READING_KEYS, SPLIT, PERIOD, *TIME_COLUMNS, POWER, "is_idle_charger", ENERGY, SOC]

LAG_COLUMNS = ["lag_1_active", "lag_2_active", "lag_1_power_kw", "roll_3_active", "roll_6_active"]
CONGESTION_FEATURES = [
    STATION, TS, "active_chargers", "total_chargers", "total_power_kw",
    *TIME_COLUMNS, PERIOD, *LAG_COLUMNS, SPLIT,
]

DEMAND_FEATURES = [
    STATION, "total_chargers", "active_chargers", "utilization_rate", "avg_energy_per_charger",
    "peak_power_kw", "station_avg_hourly_demand", "station_peak_hourly_demand",
    *TIME_COLUMNS, PERIOD, SPLIT, TS, "total_energy_wh",
]

LEFTOVER_FEATURES = [
    STATION, CHARGER, *TIME_COLUMNS, PERIOD, POWER, SESSIONS, "is_idle_charger", ENERGY,
    "charger_max_energy_wh", "charger_mean_energy_wh", "estimated_capacity_wh",
    SPLIT, TS, "leftover_energy_wh",
]

LEGACY_INPUTS = [
    STATION, CHARGER, PERIOD, *TIME_INTS, "is_late_night", "hour_sin", "hour_cos",
    "period_hour_interaction", POWER, SESSIONS, "power_to_energy_ratio",
    "station_mean_energy_wh", "station_median_energy_wh", "station_std_energy_wh",
    "station_mean_power_kw", "station_max_power_kw", "station_charger_count",
    "charger_mean_energy_wh", "charger_max_energy_wh", "charger_mean_power_kw",
    "estimated_capacity_wh",
]


@dataclass(frozen=True)
class Boosting:
    """Tree-boosting settings of one product."""

    iterations: int = 1000
    learning_rate: float = 0.05
    depth: int = 8
    patience: int = 50
    seed: int = 42
    row_fraction: float = 1.0
    feature_fraction: str = "all"
    min_rows_per_leaf: int = 1


@dataclass(frozen=True)
class Product:
    """What one prediction product predicts, from which columns, and how its output is bounded."""

    name: str
    target: str
    contract: list[str]
    categoricals: list[str]
    exclude: list[str] = field(default_factory=lambda: [SPLIT, TS])
    clip: tuple[float | None, float | None] = (0.0, None)
    units: str = "Wh"
    mape: bool = False
    drop_null_target: bool = False
    log_target: bool = False
    leaky: list[str] = field(default_factory=list)
    boosting: Boosting = Boosting()

    def feature_columns(self, exclude_leaky: bool = False) -> list[str]:
        """Contract columns that feed the model: all but the excluded ones and the target."""
        out = {*self.exclude, self.target, *(self.leaky if exclude_leaky else [])}
        return [c for c in self.contract if c not in out]


IDS = [STATION, CHARGER]
PRODUCTS: dict[str, Product] = {
    p.name: p
    for p in [
        Product("energy", ENERGY, ENERGY_FEATURES, IDS, mape=True),
        Product(
            "soc", SOC, SOC_FEATURES, IDS, clip=(0.0, 100.0), units="%",
            boosting=Boosting(iterations=500, depth=6),
        ),
        Product(
            "congestion", "active_chargers", CONGESTION_FEATURES, [STATION],
            exclude=[SPLIT, TS, "total_power_kw"], units="chargers",
            boosting=Boosting(iterations=1500, patience=100),
        ),
        # avg_energy_per_charger * total_chargers is the demand target itself.
        Product(
            "demand", "total_energy_wh", DEMAND_FEATURES, [STATION], mape=True,
            leaky=["avg_energy_per_charger"],
        ),
        # the capacity minus max_energy_wh is the leftover target itself.
        Product(
            "leftover", "leftover_energy_wh", LEFTOVER_FEATURES, IDS, drop_null_target=True,
            leaky=[ENERGY],
        ),
    ]
}

LEGACY_PRODUCT = Product(
    "legacy_energy", ENERGY, [*LEGACY_INPUTS, SPLIT, TS, ENERGY], IDS, mape=True,
    leaky=["power_to_energy_ratio"],
    boosting=Boosting(row_fraction=0.8, feature_fraction="0.8", min_rows_per_leaf=20, depth=6),
)
