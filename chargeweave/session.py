"""Session set-up and staged tables.

A stage is a Parquet table written once and read back: it cuts the lineage, survives the loss of
executors, gives later jobs column pruning and filter pushdown, and makes results that depend on
non-associative double sums read the same bits every time.
"""

from __future__ import annotations

import atexit
import shutil
import uuid

from pyspark.sql import DataFrame, SparkSession


def build_session(master: str | None = None, **conf: str) -> SparkSession:
    """Session with UTC time, AQE (coalescing, skew joins) and the caller's own settings on top."""
    builder = SparkSession.builder.appName("chargeweave")
    if master:
        builder = builder.master(master)
    defaults = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
    }
    for key, value in {**defaults, **conf}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_folder(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``, which the caller names."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        raise ValueError("set spark.checkpoint.dir to a folder all executors share")
    return root.rstrip("/")


def ensure_folder(spark: SparkSession) -> None:
    """For tests, benches and notebooks: name a folder where none is named, in local mode only.

    It lies below the warehouse and is deleted when the process ends.
    """
    if spark.conf.get("spark.checkpoint.dir", None):
        return
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder all executors share")
    warehouse = spark.conf.get("spark.sql.warehouse.dir").removeprefix("file:")
    folder = f"{warehouse}/stages-{uuid.uuid4().hex[:12]}"
    spark.conf.set("spark.checkpoint.dir", folder)
    atexit.register(shutil.rmtree, folder, ignore_errors=True)


def new_folder(spark: SparkSession, label: str) -> str:
    """A path below the shared folder that no other run uses."""
    app = spark.sparkContext.applicationId
    return f"{shared_folder(spark)}/chargeweave/{app}/{label}-{uuid.uuid4().hex[:12]}"


def stage(df: DataFrame, label: str, partition_by: list[str] | None = None) -> DataFrame:
    """Write ``df`` once and return a scan of the written table."""
    spark = df.sparkSession
    path = new_folder(spark, label)
    writer = df.write.mode("error")
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(path)
    back = spark.read.schema(df.schema).parquet(path)
    return back.select(*df.columns)
