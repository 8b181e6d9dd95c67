"""Distributed boosted trees for the five products: encode, fit, evaluate, explain."""

from __future__ import annotations

import json
from dataclasses import asdict, dataclass, replace
from itertools import zip_longest

from pyspark.ml import PipelineModel
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import GBTRegressionModel
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from chargeweave.functions import measures
from chargeweave.operators.evaluation import regression_metrics
from chargeweave.operators.splits import only
from chargeweave.plans.boosting import FEATURES, LABEL, best_iteration, boost  # noqa: F401
from chargeweave.schemas import LEGACY_PRODUCT, PRODUCTS, SPLIT, Boosting, Product
from chargeweave.session import shared_folder, stage

SMOOTHING = 10.0
FOLD = "_fold"
FOLDS = 5
SHUFFLE_GROUPS = 256


@dataclass
class FittedProduct:
    """A fitted model with all that scoring needs: encodings of the ids and the column order."""

    product: Product
    stages: PipelineModel
    encodings: dict[str, DataFrame]
    prior: float
    inputs: list[str]
    validation_losses: list[float]
    best_iteration: int

    @property
    def trees(self) -> GBTRegressionModel:
        return self.stages.stages[-1]

    def best_validation_rmse(self) -> float:
        return self.validation_losses[self.best_iteration - 1] ** 0.5

    def predict(self, rows: DataFrame) -> DataFrame:
        """``prediction`` for feature rows: back-transformed and bounded by the product's range."""
        encoded = encode_ids(rows, self.encodings, self.prior, own_fold=None)
        filled = fill_missing(encoded, self.inputs)
        scored = self.stages.transform(filled)
        value = F.col("prediction")
        if self.product.log_target:
            value = measures.from_log_target(value)
        bounded = measures.clamp(value, *self.product.clip)
        return scored.withColumn("prediction", bounded).select(*rows.columns, "prediction")

    def save(self, path: str) -> None:
        self.stages.write().overwrite().save(f"{path}/stages")
        for name, table in self.encodings.items():
            table.write.mode("overwrite").parquet(f"{path}/encodings/{name}")
        facts = {
            "product": self.product.name,
            "boosting": asdict(self.product.boosting),
            "log_target": self.product.log_target,
            "encodings": list(self.encodings),
            "prior": self.prior,
            "inputs": self.inputs,
            "validation_losses": self.validation_losses,
            "best_iteration": self.best_iteration,
        }
        spark = SparkSession.active()
        row = spark.createDataFrame([(json.dumps(facts),)], "facts string")
        row.coalesce(1).write.mode("overwrite").text(f"{path}/facts")

    @staticmethod
    def load(spark: SparkSession, path: str) -> FittedProduct:
        facts = json.loads(spark.read.text(f"{path}/facts").first()[0])
        known = {**PRODUCTS, LEGACY_PRODUCT.name: LEGACY_PRODUCT}[facts["product"]]
        product = replace(
            known, boosting=Boosting(**facts["boosting"]), log_target=facts["log_target"]
        )
        encodings = {n: spark.read.parquet(f"{path}/encodings/{n}") for n in facts["encodings"]}
        return FittedProduct(
            product, PipelineModel.load(f"{path}/stages"), encodings, facts["prior"],
            facts["inputs"], facts["validation_losses"], facts["best_iteration"],
        )


def fill_missing(df: DataFrame, columns: list[str]) -> DataFrame:
    """The missing sentinel in floating-point features only; integer features have no gaps."""
    doubles = {f.name for f in df.schema.fields if isinstance(f.dataType, (T.DoubleType, T.FloatType))}
    return df.na.fill(measures.MISSING_SENTINEL, subset=[c for c in columns if c in doubles])


def encoding_name(column: str) -> str:
    return f"{column}_encoded"


def with_folds(df: DataFrame) -> DataFrame:
    """A fold number per row that only depends on the row's values."""
    return df.withColumn(FOLD, F.pmod(F.xxhash64(*df.columns), F.lit(FOLDS)).cast("int"))


def fit_id_encodings(train: DataFrame, ids: list[str]) -> tuple[dict[str, DataFrame], float]:
    """Label sums and row counts per id, in total and per fold. One small table per id column,
    staged since fitting, validation and scoring all join it."""
    prior = train.agg(F.avg(LABEL)).first()[0]
    if prior is None:
        raise ValueError("no train rows with a label: ids cannot be encoded")
    in_fold = [F.when(F.col(FOLD) == k, F.col(LABEL)) for k in range(FOLDS)]
    tables = {}
    for c in ids:
        sums = train.groupBy(c).agg(
            F.sum(LABEL).alias(f"_{c}_sum"),
            F.count(LABEL).alias(f"_{c}_rows"),
            F.array(*[F.coalesce(F.sum(x), F.lit(0.0)) for x in in_fold]).alias(f"_{c}_fold_sums"),
            F.array(*[F.count(x) for x in in_fold]).alias(f"_{c}_fold_rows"),
        )
        tables[c] = stage(sums, f"encoding_{c}")
    return tables, float(prior)


def encode_ids(
    df: DataFrame, tables: dict[str, DataFrame], prior: float, own_fold: Column | None
) -> DataFrame:
    """Smoothed mean label per id. Train rows, which have an ``own_fold``, get the mean of the other
    folds: neither their own label nor its complement can be read off the code."""
    for c, table in tables.items():
        joined = df.join(table, c, "left")
        total, count = F.col(f"_{c}_sum"), F.col(f"_{c}_rows")
        if own_fold is not None:
            total = total - F.coalesce(F.get(f"_{c}_fold_sums", own_fold), F.lit(0.0))
            count = count - F.coalesce(F.get(f"_{c}_fold_rows", own_fold), F.lit(0))
        total, count = F.coalesce(total, F.lit(0.0)), F.coalesce(count, F.lit(0))
        code = (total + F.lit(prior * SMOOTHING)) / (count + F.lit(SMOOTHING))
        helpers = [x for x in table.columns if x != c]
        df = joined.withColumn(encoding_name(c), code).drop(*helpers)
    return df


def labelled_rows(features: DataFrame, product: Product) -> DataFrame:
    """Rows with their training label beside the raw target, so both always stay aligned."""
    if product.drop_null_target:
        features = features.na.drop(subset=[product.target])
    target = F.col(product.target).cast("double")
    return features.withColumn(LABEL, measures.log_target(target) if product.log_target else target)


def fit(
    features: DataFrame,
    product: Product,
    boosting: Boosting | None = None,
    exclude_leaky: bool = False,
) -> FittedProduct:
    """Fit on the train rows, stopping on the validation rows; the product's settings unless told."""
    shared_folder(features.sparkSession)
    if boosting is not None:
        product = replace(product, boosting=boosting)
    rows = with_folds(labelled_rows(features, product).where(F.col(LABEL).isNotNull()))
    tables, prior = fit_id_encodings(only(rows, "train"), product.categoricals)
    plain = [c for c in product.feature_columns(exclude_leaky) if c not in product.categoricals]
    inputs = [*[encoding_name(c) for c in product.categoricals], *plain]

    own = F.when(F.col(SPLIT) == "train", F.col(FOLD))
    encoded = fill_missing(encode_ids(only(rows, "train", "val"), tables, prior, own), inputs)
    assembler = VectorAssembler(inputCols=inputs, outputCol=FEATURES)
    matrix = stage(encoded.select(*inputs, LABEL, SPLIT), f"matrix_{product.name}")
    found = boost(assembler.transform(matrix), product.boosting)
    return FittedProduct(
        product, PipelineModel([assembler, found.model]), tables, prior, inputs, found.losses, found.best
    )


@dataclass(frozen=True)
class Line:
    """Least squares of a product's target on one input: what a model has to beat."""

    product: Product
    column: str
    slope: float
    intercept: float

    @staticmethod
    def fit(features: DataFrame, product: Product, column: str) -> Line:
        x, y = F.col(column).cast("double"), F.col(product.target).cast("double")
        slope = F.regr_slope(y, x)
        found = only(features, "train").agg(slope.alias("slope"), F.regr_intercept(y, x).alias("intercept")).first()
        if found["slope"] is None:
            raise ValueError(f"no line: {column} or {product.target} does not vary over the train rows")
        return Line(product, column, found["slope"], found["intercept"])

    def predict(self, rows: DataFrame) -> DataFrame:
        value = F.col(self.column) * F.lit(self.slope) + F.lit(self.intercept)
        return rows.withColumn("prediction", measures.clamp(value, *self.product.clip))


def evaluate(fitted: FittedProduct, features: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Predictions of the test rows, scored and written once, and their one-row metrics."""
    product = fitted.product
    test = only(labelled_rows(features, product), "test").drop(LABEL)
    predicted = stage(fitted.predict(test), f"predicted_{product.name}")
    metrics = regression_metrics(predicted, product.target, "prediction", product.name)
    if not product.mape:
        metrics = metrics.withColumn("mape", F.lit(None).cast("double"))
    return predicted, metrics


def feature_importance(fitted: FittedProduct, top: int = 20) -> DataFrame:
    """The ``top`` most important inputs; the model itself holds the values."""
    values = fitted.trees.featureImportances.toArray()  # ends with the last input any tree uses
    rows = [(name, float(v)) for name, v in zip_longest(fitted.inputs, values, fillvalue=0.0)]
    frame = SparkSession.active().createDataFrame(rows, "feature string, importance double")
    return frame.orderBy(F.desc("importance"), "feature").limit(top)


def permutation_importance(
    fitted: FittedProduct, features: DataFrame, keys: list[str], seed: int = 42, groups: int = SHUFFLE_GROUPS
) -> DataFrame:
    """Rise of the test RMSE when one feature's values are exchanged between rows.

    Every feature takes the value of the next row in hash order, the last row that of the first.
    ``groups`` hash ranges are worked apart, the last row of each taking the first one of the next, so
    their number does not change the figures. All features are scored in one pass over the exploded variants.
    """
    product = fitted.product
    test = only(labelled_rows(features, product), "test").drop(LABEL)
    names = product.feature_columns()
    h = F.xxhash64(F.lit(seed), *[F.col(k) for k in keys])
    group = F.shiftright((F.shiftright(h, 32) + F.lit(2**31)) * F.lit(groups), 32)
    test = test.withColumn("_group", group)
    order = Window.partitionBy("_group").orderBy(h, *keys)
    firsts = test.groupBy("_group").agg(F.min_by(F.struct(*names), F.struct(h, *keys)).alias("_first"))
    along = Window.orderBy("_group")  # at most ``groups`` rows
    whole = along.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    nexts = firsts.select(
        "_group", F.coalesce(F.lead("_first").over(along), F.first("_first").over(whole)).alias("_next")
    )
    wrapped = {
        f"_other_{c}": F.when(F.lead(F.lit(1)).over(order).isNull(), F.col("_next")[c]).otherwise(
            F.lead(c).over(order)
        )
        for c in names
    }
    exchanged = test.join(F.broadcast(nexts), "_group").withColumns(wrapped)
    variants = exchanged.withColumn("_variant", F.explode(F.array(*[F.lit(c) for c in ["", *names]])))
    swapped = {c: F.when(F.col("_variant") == c, F.col(f"_other_{c}")).otherwise(F.col(c)) for c in names}
    rows = variants.withColumns(swapped).select(
        F.col(product.target).cast("double").alias("_actual"), "_variant", *[c for c in names]
    )
    error = F.col("_actual") - F.col("prediction")
    rmse = fitted.predict(rows).groupBy("_variant").agg(F.sqrt(F.avg(error * error)).alias("rmse"))
    base = rmse.where("_variant = ''").select(F.col("rmse").alias("_base"))
    return (
        rmse.where("_variant <> ''")
        .crossJoin(F.broadcast(base))
        .select(F.col("_variant").alias("feature"), (F.col("rmse") - F.col("_base")).alias("rmse_rise"))
    )


def loss_curve(fitted: FittedProduct) -> DataFrame:
    """Validation RMSE per iteration, marking the chosen one."""
    rows = [
        (i + 1, loss**0.5, i + 1 == fitted.best_iteration)
        for i, loss in enumerate(fitted.validation_losses)
    ]
    return SparkSession.active().createDataFrame(
        rows, "iteration int, validation_rmse double, is_best boolean"
    )
