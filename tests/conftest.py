import sys
from datetime import datetime
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parent.parent
sys.path[:0] = [str(ROOT), str(ROOT / "tests")]

from chargeweave.session import build_session, ensure_folder  # noqa: E402

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    session = build_session(
        "local[8]",
        **{
            "spark.sql.shuffle.partitions": "4",
            "spark.ui.enabled": "false",
            "spark.ui.showConsoleProgress": "false",
            "spark.driver.memory": "6g",
        },
    )
    session.sparkContext.setLogLevel("ERROR")
    ensure_folder(session)
    yield session
    session.stop()


@pytest.fixture(scope="session")
def lake(spark):
    from querybook.lake import lake

    return lake(spark, SMALL)


READING = (
    "charging_station_id string, charger_id string, timestamp timestamp_ntz, avg_pwr_kw double, "
    "max_energy_wh double, active_session_count double, soc_pct double"
)


def at(hour: int, day: int = 1, month: int = 4, minute: int = 0) -> datetime:
    return datetime(2026, month, day, hour, minute)


@pytest.fixture
def readings(spark):
    """Builds a readings frame from short tuples."""
    return lambda rows: spark.createDataFrame(rows, READING)
