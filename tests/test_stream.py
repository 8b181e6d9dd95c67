"""Predictions on a stream: equal to a table's, through failures and restarts."""

import pytest
from pyspark.sql import functions as F

from chargeweave.plans import models
from chargeweave.plans import requests as rq
from chargeweave.schemas import PRODUCTS, Boosting
from chargeweave.session import new_folder
from chargeweave.streaming.scoring import read_request_stream, write_predictions
from querybook.scoring import FIELDS

PRODUCT_NAMES = ["energy", "soc", "congestion", "demand", "leftover"]


def asked(lake, product):
    return lake.requests.withColumnsRenamed(FIELDS[product])


def arrive(spark, requests, parts):
    folder = new_folder(spark, "requests")
    requests.repartition(parts, "request_id").write.parquet(folder)
    return folder


@pytest.fixture(scope="module")
def fitted(lake):
    settings = Boosting(iterations=3, depth=3, learning_rate=0.4, patience=2)
    return models.fit(lake.features("energy"), PRODUCTS["energy"], settings)


def same(a, b):
    return a.exceptAll(b).count() == b.exceptAll(a).count() == 0


def test_stream_equals_table(spark, lake, fitted):
    requests = asked(lake, "energy")
    score = rq.Scorer.over("energy", fitted.predict, lake.features("energy"))
    path = new_folder(spark, "scored")
    stream = read_request_stream(spark, arrive(spark, requests, 3), requests.schema, files_per_batch=1)
    write_predictions(stream, score, path, new_folder(spark, "check")).awaitTermination()
    written = spark.read.parquet(path)
    assert written.count() > 0 and "prediction" in written.columns
    assert same(score(requests).select(written.columns), written)


def test_restart_after_a_failure_inside_a_micro_batch(spark, lake, fitted):
    """The second micro-batch fails while its rows are written; the run started again finishes it."""
    requests = asked(lake, "energy")
    score = rq.Scorer.over("energy", fitted.predict, lake.features("energy"))
    folder, path, check = arrive(spark, requests, 4), new_folder(spark, "scored"), new_folder(spark, "check")
    files = sorted(r[0] for r in spark.read.parquet(folder).select("_metadata.file_name").distinct().collect())
    stream = read_request_stream(spark, folder, requests.schema, files_per_batch=2)

    def failing(rows):
        seen = F.lit(0).cast("long")
        bad = F.when(F.col("_file").isin(files[2:]) & (F.col("request_id") % 40 == 7), F.raise_error(F.lit("lost")).cast("long"))
        marked = rows.withColumn("_file", F.col("_metadata.file_name"))
        return score(marked.withColumn("request_id", F.col("request_id") + F.coalesce(bad, seen)).drop("_file"))

    running = write_predictions(stream, failing, path, check)
    with pytest.raises(Exception, match="lost"):
        running.awaitTermination()
    half = spark.read.parquet(path).count()

    stream = read_request_stream(spark, folder, requests.schema, files_per_batch=2)
    write_predictions(stream, score, path, check).awaitTermination()
    written = spark.read.parquet(path)
    assert half < written.count() and same(score(requests).select(written.columns), written)

    stream = read_request_stream(spark, folder, requests.schema, files_per_batch=2)
    write_predictions(stream, score, path, check).awaitTermination()
    assert spark.read.parquet(path).count() == written.count()  # nothing is answered twice


@pytest.mark.parametrize("product", PRODUCT_NAMES)
def test_every_product_scores_tables_and_streams(spark, lake, product):
    """With a line in place of the trees."""
    column = {"energy": "avg_pwr_kw", "soc": "avg_pwr_kw", "congestion": "hour", "demand": "peak_power_kw", "leftover": "max_energy_wh"}
    line = models.Line.fit(lake.features(product), PRODUCTS[product], column[product])
    requests = asked(lake, product)
    score = rq.Scorer.over(product, line.predict, lake.features(product))
    path = new_folder(spark, "scored")
    stream = read_request_stream(spark, arrive(spark, requests, 2), requests.schema)
    write_predictions(stream, score, path, new_folder(spark, "check")).awaitTermination()
    written = spark.read.parquet(path)
    assert written.count() == rq.valid_requests(requests, product).count()
    assert same(score(requests).select(written.columns), written)


def test_a_line_needs_train_rows_that_vary(lake):
    with pytest.raises(ValueError, match="no line"):
        models.Line.fit(lake.features("energy").where("split = 'test'"), PRODUCTS["energy"], "avg_pwr_kw")
