"""Whole jobs: clean to a table, build all feature tables, train and verify products."""

from __future__ import annotations

from dataclasses import replace
from functools import reduce

from pyspark.sql import DataFrame, SparkSession

from chargeweave.operators.cleaning import STATION_ROW_CAP, clean
from chargeweave.operators.evaluation import compare_models
from chargeweave.operators.quality import inspect
from chargeweave.operators.quarantine import VERDICT, CleanRun, clean_with_quarantine
from chargeweave.operators.splits import random_split
from chargeweave.plans.features import BUILDERS, charger_base
from chargeweave.plans.models import FittedProduct, evaluate, fit
from chargeweave.schemas import CHARGER, PERIOD, PRODUCTS, STATION, TS, Boosting
from chargeweave.session import stage
from chargeweave.sources.telemetry import append_metrics, read_table, write_table


def clean_to_table(raw: DataFrame, path: str, cap: int | None = STATION_ROW_CAP) -> DataFrame:
    """Run the cleaning steps and write the cleaned table, partitioned by collection window.

    ``cap`` readings of every station at most, the newest; None keeps all.
    """
    write_table(clean(raw, cap=cap), path, partition_by=[PERIOD])
    return read_table(raw.sparkSession, path)


def clean_to_tables(raw: DataFrame, folder: str, cap: int | None = STATION_ROW_CAP) -> CleanRun:
    """As ``clean_to_table``, with the rejected rows (by verdict) and the audit as tables beside it.

    The tables are ``cleaned``, ``rejected`` and ``audit`` below ``folder``.
    """
    run = clean_with_quarantine(raw, cap=cap)
    write_table(run.kept, f"{folder}/cleaned", partition_by=[PERIOD])
    write_table(run.rejected, f"{folder}/rejected", partition_by=[VERDICT])
    write_table(run.audit, f"{folder}/audit")
    tables = {"cleaned": run.kept, "rejected": run.rejected, "audit": run.audit}
    return CleanRun(*(read_table(raw.sparkSession, f"{folder}/{n}", schema=t.schema) for n, t in tables.items()))


def build_feature_tables(cleaned: DataFrame, folder: str) -> dict[str, DataFrame]:
    """Write the feature table of every product below ``folder``."""
    spark = cleaned.sparkSession
    write_table(charger_base(cleaned), f"{folder}/charger_base")
    base = read_table(spark, f"{folder}/charger_base")
    tables = {}
    for name, build in BUILDERS.items():
        write_table(build(base if name == "energy" else cleaned), f"{folder}/{name}")
        tables[name] = read_table(spark, f"{folder}/{name}")
    return tables


def train_product(
    name: str, features: DataFrame, folder: str, boosting: Boosting | None = None
) -> tuple[FittedProduct, DataFrame]:
    """Fit, evaluate, append the metrics and save the model of one product."""
    fitted = fit(features, PRODUCTS[name], boosting)
    _, metrics = evaluate(fitted, features)
    metrics = stage(metrics, f"metrics_{name}")
    append_metrics(metrics, f"{folder}/metrics")
    fitted.save(f"{folder}/models/{name}")
    return fitted, metrics


def train_all(
    spark: SparkSession, tables: dict[str, DataFrame], folder: str, boosting: Boosting | None = None
) -> DataFrame:
    """One row of test metrics per product. Products run one after another, each one distributed."""
    return compare_models([train_product(n, t, folder, boosting)[1] for n, t in tables.items()])


def verify_tables(tables: dict[str, DataFrame]) -> DataFrame:
    """Quality report over all tables."""
    return reduce(DataFrame.unionByName, [inspect(t, n) for n, t in tables.items()])


# Products and booster settings of the verification run.
VERIFIED = ["energy", "soc", "congestion"]
VERIFY_BOOSTING = Boosting(iterations=3000, learning_rate=0.08, depth=10, patience=100)


def verify_models(
    tables: dict[str, DataFrame], boosting: Boosting = VERIFY_BOOSTING, names: list[str] | None = None
) -> DataFrame:
    """Retrain on a seeded random 80/10/10 split and compare the test metrics."""
    reports = []
    for name in names or VERIFIED:
        product = replace(PRODUCTS[name], boosting=boosting)
        keys = [c for c in (STATION, CHARGER, TS) if c in tables[name].columns]
        rows = stage(random_split(tables[name], keys), f"random_{name}")
        _, metrics = evaluate(fit(rows, product), rows)
        reports.append(metrics)
    return compare_models(reports)
