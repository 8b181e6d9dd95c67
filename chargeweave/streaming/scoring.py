"""The batch scoring functions on a stream of requests.

Scoring is stateless per row and the history tables are static, so neither watermarks nor state are
involved. Request files are logged in the checkpoint before a micro-batch runs and the sink lists the
files of finished micro-batches only, so a run that is stopped or fails anywhere can be started
again with the same folders: every request is answered once. The model is a part of the stream's plan
(``plans.requests.Scorer``), the same one that scores tables.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery


def read_request_stream(
    spark: SparkSession,
    folder: str,
    schema: T.StructType,
    name_pattern: str | None = None,
    files_per_batch: int = 1000,
) -> DataFrame:
    """Request files as they arrive in ``folder``."""
    reader = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch)
    if name_pattern:
        reader = reader.option("pathGlobFilter", name_pattern)
    return reader.parquet(folder)


def write_predictions(
    requests: DataFrame,
    score: Callable[[DataFrame], DataFrame],
    path: str,
    checkpoint: str,
) -> StreamingQuery:
    """Score all requests available now and append the predictions to a Parquet table."""
    return (
        score(requests)
        .writeStream.format("parquet")
        .option("path", path)
        .option("checkpointLocation", checkpoint)
        .outputMode("append")
        .trigger(availableNow=True)
        .start()
    )
