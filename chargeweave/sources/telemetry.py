"""Reading and writing telemetry, feature tables and metrics."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from chargeweave.functions.timefeat import utc_timestamp
from chargeweave.schemas import (
    CHARGER,
    ENERGY,
    HIT_FIELD_NAMES,
    METRICS_SCHEMA,
    POWER,
    RAW_SCHEMA,
    SEARCH_HITS_SCHEMA,
    SESSIONS,
    SOC,
    STATION,
    TS,
)

EXTRACT_COLUMNS = [STATION, CHARGER, TS, POWER, ENERGY, SESSIONS, SOC]


def read_csv(spark: SparkSession, path: str | list[str], schema: T.StructType = RAW_SCHEMA) -> DataFrame:
    """Delimited telemetry with a header and a fixed schema; a missing path is an error."""
    return spark.read.schema(schema).option("header", True).option("enforceSchema", False).csv(path)


def read_table(
    spark: SparkSession, path: str, format: str = "parquet", schema: T.StructType | None = None
) -> DataFrame:
    """A table of ``write_table``. CSV has no types, so its schema must be given."""
    reader = spark.read.format(format)
    if format == "csv":
        if schema is None:
            raise ValueError("CSV tables are read with a schema")
        reader = reader.option("header", True).option("enforceSchema", False)
    return (reader.schema(schema) if schema is not None else reader).load(path)


def extract(df: DataFrame, start: str, end: str) -> DataFrame:
    """The seven telemetry columns of ``start <= timestamp < end``, ordered by time."""
    lo, hi = (F.lit(x).cast("timestamp_ntz") for x in (start, end))
    return df.where((F.col(TS) >= lo) & (F.col(TS) < hi)).select(*EXTRACT_COLUMNS).orderBy(TS, STATION, CHARGER)


def read_search_hits(spark: SparkSession, path: str | list[str], multi_line: bool = True) -> DataFrame:
    """Flat readings from exported search responses (``hits.hits[]._source``).

    A pretty-printed response is one task per file; line-delimited responses are splittable.
    """
    docs = spark.read.schema(SEARCH_HITS_SCHEMA).option("multiLine", multi_line).json(path)
    return flatten_hits(docs)


def flatten_hits(docs: DataFrame) -> DataFrame:
    flat = docs.select(F.explode("hits.hits").alias("hit")).select("hit._source.*")
    return map_field_names(flat).withColumn(TS, utc_timestamp(F.col(TS)))


def map_field_names(df: DataFrame, names: dict[str, str] = HIT_FIELD_NAMES) -> DataFrame:
    return df.withColumnsRenamed(names)


def merge_periods(parts: list[DataFrame]) -> DataFrame:
    """All period files as one table; columns a part lacks become NULL."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)


def write_table(df: DataFrame, path: str, partition_by: list[str] | None = None, format: str = "parquet") -> None:
    """Replace the table at ``path``. Rows are grouped by partition value first, to avoid a file per
    task and value; AQE splits the groups that are too big."""
    if partition_by:
        df = df.hint("rebalance", *[F.col(c) for c in partition_by])
    writer = df.write.mode("overwrite").format(format)
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    if format == "csv":
        writer = writer.option("header", True)
    writer.save(path)


def append_metrics(metrics: DataFrame, path: str) -> None:
    """Append one row per model run to the metrics table."""
    metrics.select(*METRICS_SCHEMA.fieldNames()).write.mode("append").parquet(path)


def read_metrics(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(METRICS_SCHEMA).parquet(path)
