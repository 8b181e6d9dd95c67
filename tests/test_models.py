"""Model jobs on the smallest tables: repeatable, better than the mean, and persistent."""

import numpy as np
import pytest
from py4j.clientserver import ClientServerConnection
from pyspark.ml.linalg import Vectors
from pyspark.sql import functions as F

from chargeweave.operators.evaluation import regression_metrics
from chargeweave.plans import boosting, models
from chargeweave.schemas import PRODUCTS, Boosting, Product
from chargeweave.session import new_folder

QUICK = Boosting(iterations=4, depth=3, learning_rate=0.4, patience=2)


@pytest.fixture(scope="module")
def fitted(lake):
    return models.fit(lake.features("demand"), PRODUCTS["demand"], QUICK)


def test_beats_the_train_mean(lake, fitted):
    table = lake.features("demand")
    _, report = models.evaluate(fitted, table)
    mean = table.where("split = 'train'").agg(F.avg("total_energy_wh")).first()[0]
    guess = table.where("split = 'test'").withColumn("p", F.lit(mean))
    naive = regression_metrics(guess, "total_energy_wh", "p", "mean").first()
    row = report.first()
    assert row.rmse < naive.rmse and row.mape is not None


def test_fit_is_repeatable(lake, fitted):
    again = models.fit(lake.features("demand"), PRODUCTS["demand"], QUICK)
    assert again.validation_losses == pytest.approx(fitted.validation_losses)
    assert again.best_iteration == fitted.best_iteration


def test_save_and_load(spark, lake, fitted):
    path = new_folder(spark, "saved")
    fitted.save(path)
    loaded = models.FittedProduct.load(spark, path)
    rows = lake.features("demand").where("split = 'val'")
    assert loaded.predict(rows).exceptAll(fitted.predict(rows)).count() == 0


def test_own_fold_is_left_out_of_the_encoding(spark):
    rows = [("a", 10.0, "train", 0), ("a", 20.0, "train", 1), ("a", 30.0, "train", 1), ("b", 20.0, "train", 4), ("a", 99.0, "test", 0), ("z", 1.0, "test", 2)]
    df = spark.createDataFrame(rows, f"id string, {models.LABEL} double, split string, {models.FOLD} int")
    tables, prior = models.fit_id_encodings(df.where("split = 'train'"), ["id"])
    own = F.when(F.col("split") == "train", F.col(models.FOLD))
    got = models.encode_ids(df, tables, prior, own).collect()
    codes = {(r.id, r[models.LABEL]): r.id_encoded for r in got}
    assert prior == 20.0
    assert codes["a", 10.0] == pytest.approx((50 + 200) / 12)
    assert codes["a", 20.0] == codes["a", 30.0] == pytest.approx((10 + 200) / 11)
    assert codes["b", 20.0] == pytest.approx(20.0)
    assert codes["a", 99.0] == pytest.approx((60 + 200) / 13)
    assert codes["z", 1.0] == pytest.approx(20.0)


def test_best_iteration_respects_patience():
    assert models.best_iteration([5.0, 4.0, 4.5, 4.6, 1.0], patience=2) == 2
    assert models.best_iteration([5.0, 4.0, 4.5, 4.6, 1.0], patience=3) == 5
    assert models.best_iteration([3.0], patience=1) == 1


def _noisy(spark):
    """x decides the train labels; validation labels follow it only roughly, so more trees overfit."""
    rows = [(i, "a", float(i % 10), float(i * 7919 % 101), s, float(i % 10) * 3 + (i * 31 % 17)) for i in range(300) for s in ("train", "val", "test")]
    rows = [(k, a, x, n, s, y if s == "train" else float(k % 10) * 3 + (k * 57 % 23)) for k, a, x, n, s, y in rows]
    return spark.createDataFrame(rows, "k int, id string, x double, noise double, split string, y double")


NOISY = Product("p", "y", ["id", "x", "noise", "k", "split", "y"], ["id"], exclude=["split", "k"])


@pytest.fixture(scope="module")
def stopped(spark):
    settings = Boosting(iterations=60, depth=4, learning_rate=0.4, patience=3)
    return models.fit(_noisy(spark), NOISY, settings)


def test_boosting_stops_patience_rounds_after_the_best(stopped):
    losses, best = stopped.validation_losses, stopped.best_iteration
    assert len(losses) == best + 3 < 60
    assert losses[best - 1] == min(losses) and losses[best - 1] < losses[0] or best == 1
    assert stopped.trees.getNumTrees == best + 1  # and the mean


def test_the_model_is_the_best_prefix_of_the_rounds(spark, stopped):
    """Nothing is fitted twice: as many rounds without a stop give the same model."""
    plain = Boosting(iterations=stopped.best_iteration, depth=4, learning_rate=0.4, patience=100)
    again = models.fit(_noisy(spark), NOISY, plain)
    assert again.validation_losses == pytest.approx(stopped.validation_losses[: stopped.best_iteration])
    rows = _noisy(spark)
    same = again.predict(rows).select("k", "split", F.col("prediction").alias("p")).join(stopped.predict(rows), ["k", "split"])
    assert same.where("abs(p - prediction) > 1e-9").count() == 0


def test_losses_are_those_of_the_model(spark, stopped):
    val = _noisy(spark).where("split = 'val'")
    error = stopped.predict(val).agg(F.avg((F.col("y") - F.col("prediction")) ** 2)).first()[0]
    assert error == pytest.approx(stopped.validation_losses[stopped.best_iteration - 1])


@pytest.mark.parametrize("missing", ["train", "val"])
def test_empty_splits_are_named(spark, missing):
    with pytest.raises(ValueError, match=missing):
        models.fit(_noisy(spark).where(F.col("split") != missing), NOISY, QUICK)


def test_rows_and_features_can_be_drawn(spark):
    drawn = Boosting(iterations=3, depth=3, learning_rate=0.3, row_fraction=0.5, feature_fraction="0.5", min_rows_per_leaf=5)
    fit = models.fit(_noisy(spark), NOISY, drawn)
    assert len(fit.validation_losses) == 3
    assert {r.feature for r in models.feature_importance(fit).collect()} == {"id_encoded", "x", "noise"}


def test_stop_rule():
    assert not boosting.is_over([], 1) and not boosting.is_over([2.0], 1)
    assert boosting.is_over([2.0, 2.0], 1) and not boosting.is_over([2.0, 1.0], 1)
    assert boosting.is_over([5.0, 4.0, 4.5, 4.6], 2) and not boosting.is_over([5.0, 4.0, 4.5], 2)


def test_log_target_and_null_targets_stay_aligned(spark):
    product = Product("p", "y", ["id", "x", "split", "y"], ["id"], log_target=True, drop_null_target=True, boosting=QUICK)
    rows = [("a" if i % 2 else "b", float(i % 10), s, None if i % 7 == 0 else float(i % 10) ** 2) for i in range(200) for s in ("train", "val", "test")]
    df = spark.createDataFrame(rows, "id string, x double, split string, y double")
    fit = models.fit(df, product)
    predicted, report = models.evaluate(fit, df)
    assert predicted.where("y is null").count() == 0
    assert report.first().r2 > 0.5


def test_permutation_finds_the_driver(spark):
    product = Product("p", "y", ["id", "x", "noise", "k", "split", "y"], ["id"], exclude=["split", "k"], boosting=QUICK)
    rows = [(i, "a", float(i % 10), float(i * 7919 % 13), s, float(i % 10) * 3) for i in range(150) for s in ("train", "val", "test")]
    df = spark.createDataFrame(rows, "k int, id string, x double, noise double, split string, y double")
    rise = {r.feature: r.rmse_rise for r in models.permutation_importance(models.fit(df, product), df, ["k"]).collect()}
    assert rise["x"] > 5 * abs(rise["noise"]) and rise["id"] == pytest.approx(0.0)


def test_leaky_columns_can_be_left_out():
    assert "avg_energy_per_charger" not in PRODUCTS["demand"].feature_columns(exclude_leaky=True)
    assert "total_power_kw" not in PRODUCTS["congestion"].feature_columns()


def test_legacy_metrics_without_positive_actuals(spark):
    df = spark.createDataFrame([(0.0, 1.0), (0.0, 2.0)], "y double, p double")
    row = regression_metrics(df, "y", "p", "m").first()
    assert row.mape is None and row.mae == 1.5


def test_permutation_does_not_depend_on_the_groups(spark):
    product = Product("p", "y", ["id", "x", "k", "split", "y"], ["id"], exclude=["split", "k"], boosting=QUICK)
    rows = [(i, "a", float(i % 10), s, float(i % 10) * 3) for i in range(90) for s in ("train", "val", "test")]
    df = spark.createDataFrame(rows, "k int, id string, x double, split string, y double")
    fit = models.fit(df, product)
    one, many = (
        {r.feature: r.rmse_rise for r in models.permutation_importance(fit, df, ["k"], groups=n).collect()} for n in (1, 256)
    )
    assert one == pytest.approx(many) and one["x"] > 1


def _jobs(spark, rounds, depth):
    group = f"boosting-{rounds}"
    spark.sparkContext.setJobGroup(group, group)
    try:
        fit = models.fit(_noisy(spark), NOISY, Boosting(iterations=rounds, depth=depth, learning_rate=0.1, patience=100))
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert len(fit.validation_losses) == rounds
    return len(spark.sparkContext.statusTracker().getJobIdsForGroup(group))


def test_a_round_costs_one_job_a_level(spark):
    assert 0 < _jobs(spark, 9, 3) - _jobs(spark, 3, 3) <= 6 * 3


def test_draws_do_not_depend_on_partitions(spark):
    drawn = Boosting(iterations=3, depth=3, learning_rate=0.3, row_fraction=0.5, feature_fraction="0.5")
    one, many = (models.fit(_noisy(spark).repartition(n), NOISY, drawn).validation_losses for n in (1, 7))
    assert one == pytest.approx(many)


def test_cuts_between_bins():
    assert boosting.cuts_between(np.array([1.0, 3.0, 3.0])).tolist() == [2.0]
    assert boosting.cuts_between(np.array([5.0, 5.0])).tolist() == []
    assert boosting.cuts_between(np.arange(8.0), 4).tolist() == [1.5, 3.5, 5.5]


def test_blocks_written_between_rounds_give_the_same_model(spark, stopped, monkeypatch):
    monkeypatch.setattr(boosting, "CUT_EVERY", 2)
    again = models.fit(_noisy(spark), NOISY, stopped.product.boosting)
    assert again.validation_losses == pytest.approx(stopped.validation_losses)


def test_a_level_is_one_stage(spark):
    tracker, stages = spark.sparkContext.statusTracker(), []
    for rounds in (2, 6):
        _jobs(spark, rounds, 4)
        jobs = [tracker.getJobInfo(i) for i in tracker.getJobIdsForGroup(f"boosting-{rounds}")]
        ran = [tracker.getStageInfo(i) for j in jobs for i in j.stageIds]
        stages.append(sum(x is not None and x.numCompletedTasks > 0 for x in ran))  # without skipped ones
    assert 0 < stages[1] - stages[0] <= 4 * 4


def test_what_a_sibling_leaves_is_the_other_childs_mean(spark):
    rows = [(Vectors.dense(i % 10, i * 7919 % 101), float(i % 10) * 3 + (i * 31 % 17), s) for i in range(300) for s in ("train", "val")]
    df = spark.createDataFrame(rows, [boosting.FEATURES, boosting.LABEL, "split"])
    model = boosting.boost(df, Boosting(iterations=1, depth=4, learning_rate=1.0)).model
    train = model.transform(df.where("split = 'train'")).groupBy(F.round("prediction", 9).alias("p"))
    leaves = train.agg(F.avg(boosting.LABEL).alias("mean")).collect()
    assert len(leaves) > 4 and all(r["p"] == pytest.approx(r["mean"]) for r in leaves)


def test_rows_reach_their_leaves_at_any_depth():
    """Leaves above the last level, and only the first rows of a block."""
    tree = boosting.Tree(
        np.array([1, -1, 0, -1, -1]), np.array([5, 0, 62, 0, 0]), np.array([1, 0, 3, 0, 0]),
        np.zeros(5), np.ones(5), np.zeros(5), 2,
    )
    bins = np.array([[63, 63, 0, 62, 63], [5, 6, 6, 6, 63]], np.uint8)
    assert tree.places(bins, 4).tolist() == [1, 4, 3, 3]
    assert tree.places(bins, 5).tolist() == [1, 4, 3, 3, 4]


def test_small_tables_make_few_blocks():
    """Below some 100,000 rows a block costs more to start than to count."""
    assert [boosting.blocks_for(n, 12) for n in (1, 25_000, 100_000, 400_000, 2_500_000)] == [1, 1, 2, 4, 10]
    assert boosting.blocks_for(18_000_000, 12) == 36


def test_a_model_is_made_with_few_calls(spark, monkeypatch):
    n = 255
    inner = np.arange(n) < n // 2
    tree = boosting.Tree(
        np.where(inner, 0, -1), np.where(inner, np.arange(n) % 3, 0), np.where(inner, 2 * np.arange(n) + 1, 0),
        np.arange(n) * 1.5, np.full(n, 10.0), np.where(inner, 2.0, 0.0), 7,
    )
    calls, send = [], ClientServerConnection.send_command
    monkeypatch.setattr(ClientServerConnection, "send_command", lambda self, x: calls.append(x) or send(self, x))
    model = boosting._ensemble([tree], [1.0], [np.array([0.5, 1.5, 2.5])], spark.range(1))
    assert len(calls) < 12 * n
    assert model.trees[0].numNodes == n and model.trees[0].depth == 7
    assert model.predict(Vectors.dense([0.0])) == 1.5 * (n // 2)  # always left
    assert model.featureImportances.toArray().tolist() == [1.0]


def test_small_tables_take_few_jobs(spark):
    """One task does the rounds, in slices of 1, 2, 4 ... of them."""
    assert 0 < _jobs(spark, 31, 3) - _jobs(spark, 1, 3) <= 6


@pytest.mark.parametrize("share", [1.0, 0.5])
def test_one_task_fits_what_many_blocks_do(spark, monkeypatch, share):
    settings = Boosting(iterations=5, depth=4, learning_rate=0.3, row_fraction=share, feature_fraction="0.7", patience=100)
    one = models.fit(_noisy(spark), NOISY, settings)
    monkeypatch.setattr(boosting, "ONE_BLOCK", 0)
    monkeypatch.setattr(boosting, "TASK_ROWS", 25)
    monkeypatch.setattr(boosting, "CUT_EVERY", 2)
    many = models.fit(_noisy(spark).repartition(7), NOISY, settings)
    assert one.validation_losses == pytest.approx(many.validation_losses)
    assert [t.numNodes for t in one.trees.trees] == [t.numNodes for t in many.trees.trees]


@pytest.mark.parametrize("width", [1, 6, 12])
def test_words_hold_the_bins_of_several_features(width):
    """Counts and places are those of a word for each feature."""
    draw, sizes = np.random.default_rng(3), [64, 2, 1, 7, 64, 12, 3, 5]
    bins = np.stack([draw.integers(0, n, 400) for n in sizes]).astype(np.uint8)
    fields = boosting.Fields.of(sizes, width)
    assert len(fields.pack(bins)) < len(sizes)
    tree = boosting.Tree(
        np.array([4, -1, 5, -1, -1]), np.array([30, 0, 6, 0, 0]), np.array([1, 0, 3, 0, 0]),
        np.zeros(5), np.ones(5), np.zeros(5), 2,
    )
    places = tree.places(bins, 400)
    assert set(places) == {1, 3, 4}
    assert tree.places(fields.pack(bins), 400, fields).tolist() == places.tolist()
    rest, none = draw.normal(size=400), np.zeros(400, np.int8)
    block = boosting.Block(400, fields.pack(bins), rest, none, fields)
    (counted,) = boosting._count(block, tree, np.array([-1, -1, -1, 0, 1]), 1.0, 0)
    for slot, node in enumerate((3, 4)):
        at = places == node
        for f, column in enumerate(bins):
            assert counted[0, slot, f].tolist() == np.bincount(column[at], minlength=64).tolist()
            assert counted[1, slot, f] == pytest.approx(np.bincount(column[at], rest[at], 64))


def test_a_large_model_is_read_from_a_table_of_its_nodes(spark, monkeypatch):
    """The calls do not grow with the nodes, and the model is that of calls."""
    n = 511
    inner = np.arange(n) < n // 2
    full = boosting.Tree(
        np.where(inner, np.arange(n) % 2, -1), np.where(inner, np.arange(n) % 3, 0), np.where(inner, 2 * np.arange(n) + 1, 0),
        np.arange(n) * 1.5, np.full(n, 10.0), np.where(inner, 2.0 + np.arange(n), 0.0), 8,
    )
    mean = boosting.Tree(*(np.array([x]) for x in (-1, 0, 0, 7.0, 20.0, 0.0)))
    cuts, calls, send = [np.array([0.5, 1.5, 2.5]), np.array([1.0, 2.0, 3.0])], [], ClientServerConnection.send_command
    monkeypatch.setattr(ClientServerConnection, "send_command", lambda self, x: calls.append(x) or send(self, x))
    trees, weights = [mean, full, full, full, full], [1.0, 0.1, 0.2, 0.3, 0.4]
    large = boosting._ensemble(trees, weights, cuts, spark.range(1))
    assert sum(not x.startswith("m") for x in calls) < 4 * n  # without releases of older objects; by calls some 12 a node
    calls.clear()
    called = boosting._called(trees, weights, cuts, spark.range(1))
    for x in np.random.default_rng(0).uniform(0, 4, (50, 2)):
        assert large.predict(Vectors.dense(x)) == called.predict(Vectors.dense(x))
    assert large.treeWeights == called.treeWeights and large.toDebugString.split("\n")[1:] == called.toDebugString.split("\n")[1:]
    assert large.featureImportances == called.featureImportances and large.getFeaturesCol() == boosting.FEATURES


def test_tasks_go_through_several_blocks(spark, monkeypatch):
    """A task takes longer to start than a block to count; and no round of tasks leaves cores idle."""
    assert [boosting.tasks_for(n, 12) for n in (1, 4, 12, 13, 36, 48, 49, 216)] == [1, 4, 12, 12, 12, 12, 24, 60]
    one = models.fit(_noisy(spark), NOISY, Boosting(iterations=3, depth=3, patience=100))
    monkeypatch.setattr(boosting, "ONE_BLOCK", 0)
    monkeypatch.setattr(boosting, "BLOCK_ROWS", 30)
    seen = []
    across = boosting._boost_across
    monkeypatch.setattr(boosting, "_boost_across", lambda state, b: seen.append(state.glom().map(len).collect()) or across(state, b))
    many = models.fit(_noisy(spark), NOISY, Boosting(iterations=3, depth=3, patience=100))
    assert len(seen[0]) == 8 and max(seen[0]) > 1
    assert one.validation_losses == pytest.approx(many.validation_losses)
