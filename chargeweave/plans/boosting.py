"""Gradient boosting that stops on the validation rows while it runs.

A round fits one tree to the residuals and measures the validation loss; the loop ends ``patience``
rounds after the best one, and the model is the first ``best`` trees. Features are cut into ``BINS`` bins
once, and features of few bins share a word. The binned rows stay in memory in blocks, up to ``TASK_BLOCKS``
a partition, with their residuals. Each level of a tree is one job of one stage: every block counts rows
and sums residuals per node, feature and bin, for the smaller child of each split only, as the other child
has what is left of the parent. The blocks' counts are added up and the driver picks the cuts; what it gets does
not grow with the rows. The loss and the new residuals come with the next round's first level.

Up to ``ONE_BLOCK`` rows are one block, whose task does the same for up to ``CUT_EVERY`` rounds a job: waiting for
a job a level takes longer there than counting on one core.

Blocks are written every ``CUT_EVERY`` rounds, so the lineage holds at most that many trees, and what an
executor loses is computed again from the last written blocks.
"""

from __future__ import annotations

import math
import pickle
import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark import RDD, StorageLevel
from pyspark.ml.common import _py2java
from pyspark.ml.functions import vector_to_array
from pyspark.ml.linalg import DenseVector
from pyspark.ml.regression import GBTRegressionModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chargeweave.schemas import SPLIT, Boosting
from chargeweave.session import new_folder

CUT_EVERY = 25
BINS = 64
#: Train rows the cuts between bins are taken from; all of a smaller table.
CUT_ROWS = 100_000
#: Rows of a block at most. Up to one block a core, so many rows make one, four times as many two, nine times
#: as many three: each has its own counts to send, and below some 100,000 rows a task takes longer to start
#: than to count.
BLOCK_ROWS, TASK_ROWS = 500_000, 25_000
#: Blocks a task goes through, one after the other, before more tasks are made than run beside each other.
TASK_BLOCKS = 4
#: So many rows are fitted by one task, in some 130 bytes a row.
ONE_BLOCK = 2_000_000
#: Bits of a word at most, and a word has no more values than there are rows for so many nodes.
WORD_BITS, WORD_NODES = 12, 64
#: The driver adds up the counts of so many blocks; those of more meet in tasks first.
GATHERED = 32
LEVEL = StorageLevel.MEMORY_AND_DISK_DESER
#: A model of so many nodes is made by calls, a millisecond a node; a larger one is read from a table.
CALLED_NODES = 2_000
LABEL = "_label"
FEATURES = "_features"


@dataclass
class Boosted:
    """The trees up to the best round, and the validation loss (mean squared error) of every round."""

    model: GBTRegressionModel
    losses: list[float]
    best: int


def best_iteration(losses: list[float], patience: int) -> int:
    """1-based iteration with the lowest loss before ``patience`` rounds pass without a new low."""
    best = 0
    for i, loss in enumerate(losses):
        if loss < losses[best]:
            best = i
        elif i - best >= patience:
            break
    return best + 1


def is_over(losses: list[float], patience: int) -> bool:
    """True once ``patience`` rounds have passed since the lowest loss."""
    return bool(losses) and len(losses) - 1 - losses.index(min(losses)) >= patience


@dataclass(frozen=True)
class Fields:
    """The word that holds the bins of each feature, and which bits of it."""

    word: np.ndarray
    shift: np.ndarray
    bits: np.ndarray

    @staticmethod
    def of(bins: list[int], width: int) -> Fields:
        """Features with so many ``bins`` in words of ``width`` bits, the wide ones first."""
        bits = np.array([(n - 1).bit_length() for n in bins])
        word, shift, used = np.zeros_like(bits), np.zeros_like(bits), []
        for f in np.argsort(-bits, kind="stable"):
            at = next((w for w, x in enumerate(used) if x + bits[f] <= max(width, bits[f])), len(used))
            used += [0] * (at == len(used))
            word[f], shift[f] = at, used[at]
            used[at] += bits[f]
        return Fields(word, shift, bits)

    @staticmethod
    def plain(features: int) -> Fields:
        """A word of its own for each feature."""
        return Fields(np.arange(features), np.zeros(features, int), np.full(features, 8))

    def pack(self, bins: np.ndarray) -> np.ndarray:
        """The words of rows with these bins by feature."""
        words = np.zeros((self.word.max() + 1, bins.shape[1]), np.uint16)
        for f, column in enumerate(bins):
            words[self.word[f]] |= column.astype(np.uint16) << np.uint16(self.shift[f])
        return words

    def within(self, word: int) -> list[tuple[int, int]]:
        """Feature and bits of a word's fields, the highest first."""
        held = np.flatnonzero(self.word == word)
        return [(int(f), int(self.bits[f])) for f in held[np.argsort(-self.shift[held], kind="stable")]]


@dataclass(frozen=True)
class Block:
    """Some of the rows, the train rows first: words of bins, residual, a hash if rows are drawn."""

    train: int
    words: np.ndarray
    rest: np.ndarray
    drawn_by: np.ndarray
    fields: Fields

    @staticmethod
    def of(parts: list[tuple[np.ndarray, ...]], fields: Fields) -> Block:
        train, words, rest, drawn_by = (np.concatenate(x, axis=-1) for x in zip(*parts))
        order = np.argsort(~train, kind="stable")
        return Block(int(train.sum()), words.take(order, axis=1), rest[order], drawn_by[order], fields)


@dataclass(frozen=True)
class Tree:
    """Nodes level by level. A leaf has feature -1; the right child stands behind the left one."""

    feature: np.ndarray
    cut: np.ndarray  # last bin that goes left
    left: np.ndarray
    value: np.ndarray
    rows: np.ndarray
    gain: np.ndarray
    depth: int = 0

    def places(
        self, words: np.ndarray, n: int, fields: Fields | None = None, node: np.ndarray | None = None, above: int = 0
    ) -> np.ndarray:
        """The node each of the first ``n`` rows ends in. ``node`` is where they are after ``above`` levels."""
        if self.depth == above:
            return np.zeros(n, np.int64) if node is None else node
        fields = fields or Fields.plain(len(words))
        flat, every = words.reshape(-1), np.arange(n)
        # A leaf leads to itself: nothing of its word is above its cut.
        leaf = self.feature < 0
        feature = np.where(leaf, 0, self.feature)
        first = fields.word[feature] * words.shape[1]
        shift = fields.shift[feature]
        mask = np.where(leaf, 0, ((1 << fields.bits[feature]) - 1) << shift).astype(words.dtype)
        cut = np.where(leaf, 0, self.cut << shift).astype(words.dtype)
        left = np.where(leaf, np.arange(len(leaf)), self.left).astype(np.int64)
        if node is None:
            node, above = left[0] + ((words[fields.word[feature[0]], :n] & mask[0]) > cut[0]), above + 1
        for _ in range(above, self.depth):
            at = first.take(node)
            at += every
            held = flat.take(at)
            held &= mask.take(node)
            right = held > cut.take(node)
            node = left.take(node)
            node += right
        return node


def cuts_between(values: np.ndarray, bins: int = BINS) -> np.ndarray:
    """Cuts of one feature, as Spark's trees place them: all midpoints, or about equal counts per bin."""
    found, counts = np.unique(values, return_counts=True)
    middles = (found[:-1] + found[1:]) / 2
    if len(middles) < bins:
        return middles
    stride = len(values) / bins
    cuts, so_far, target = [], float(counts[0]), stride
    for middle, count in zip(middles, counts[1:]):
        before, so_far = so_far, so_far + float(count)
        if abs(before - target) < abs(so_far - target):
            cuts.append(middle)
            target += stride
    return np.array(cuts[: bins - 1])


def _cuts(train: DataFrame, n: int, seed: int) -> list[np.ndarray]:
    """The cuts of every feature from ``CUT_ROWS`` train rows, or all if there are no more."""
    if n > CUT_ROWS:
        train = train.sample(CUT_ROWS / n, seed)
    values = train.select(vector_to_array(FEATURES).alias("x")).toArrow()["x"].combine_chunks()
    table = values.flatten().to_numpy().reshape(len(values), -1)
    return [cuts_between(column, min(BINS, n)) for column in table.T]


def blocks_for(n: int, parallel: int) -> int:
    """In how many blocks ``n`` rows are held where ``parallel`` tasks run beside each other."""
    return max(math.ceil(n / BLOCK_ROWS), min(parallel, math.ceil((n / TASK_ROWS) ** 0.5)))


def tasks_for(blocks: int, parallel: int) -> int:
    """In how many partitions so many blocks are: no more than ``parallel`` tasks, or about a multiple of it."""
    return min(blocks, parallel * math.ceil(blocks / (parallel * TASK_BLOCKS)))


def _blocks(rows: DataFrame, n: int, cuts: list[np.ndarray], start: float, drawn: bool) -> RDD:
    """The rows in about equal partitions, in blocks; predictions start with ``start``.

    Rows are packed before they are dealt out, a batch a piece.
    """
    columns = rows.select(
        vector_to_array(FEATURES).alias("x"), F.col(LABEL).alias("y"), (F.col(SPLIT) == "train").alias("train")
    )
    columns = columns.withColumn("h", F.xxhash64("x", "y") if drawn else F.lit(0).cast("tinyint"))
    parallel = rows.sparkSession.sparkContext.defaultParallelism
    blocks = 1 if n <= ONE_BLOCK else blocks_for(n, parallel)
    parts, most = tasks_for(blocks, parallel), math.ceil(n / blocks)
    width = min(WORD_BITS, max(1, most // WORD_NODES).bit_length())
    fields = Fields.of([len(c) + 1 for c in cuts], width)

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                x = batch["x"].flatten().to_numpy().reshape(batch.num_rows, -1)
                bins = np.stack([np.searchsorted(c, x[:, f]) for f, c in enumerate(cuts)])
                train = batch["train"].to_numpy(zero_copy_only=False)
                piece = train, fields.pack(bins), batch["y"].to_numpy() - start, batch["h"].to_numpy()
                yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(piece)], pa.binary())], ["piece"])

    def join(pieces: Iterator) -> Iterator[Block]:
        found, held = [], 0
        for row in pieces:
            found.append(pickle.loads(row[0]))
            held += len(found[-1][0])
            if held >= most:
                yield Block.of(found, fields)
                found, held = [], 0
        if found:
            yield Block.of(found, fields)

    return columns.mapInArrow(pack, "piece binary").repartition(parts).rdd.mapPartitions(join)


def _drawn(h: np.ndarray, seed: int, share: float) -> np.ndarray:
    """A seeded draw of rows by their hash, whatever their order and partition."""
    x = h.view(np.uint64) + np.uint64((seed * 0x9E3779B97F4A7C15) % 2**64)
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        x = (x ^ (x >> np.uint64(shift))) * np.uint64(factor)
    return (x ^ (x >> np.uint64(31))) < np.uint64(int(share * (2**64 - 1)))


def _measures(block: Block) -> np.ndarray:
    """The validation rows' squared error and number, and the train rows' residuals without their signs."""
    held = block.rest[block.train :]
    return np.array([held @ held, len(held), np.abs(block.rest[: block.train]).sum()])


def _unfold(cells: np.ndarray, held: list[tuple[int, int]], out: np.ndarray) -> None:
    """What the cells of a word, by node and value, come to by feature and bin."""
    if len(held) == 1:
        out[:, held[0][0], : cells.shape[1]] = cells
        return
    bits = np.array([b for _, b in held])
    below = bits.sum() - bits.cumsum()[:-1]
    k = int(np.abs(2 * below - bits.sum()).argmin())  # about half of the bits each
    square = cells.reshape(len(cells), -1, 1 << int(below[k]))
    _unfold(square.sum(axis=2), held[: k + 1], out)
    _unfold(square.sum(axis=1), held[k + 1 :], out)


def _count(block: Block, tree: Tree, slots: np.ndarray, share: float, seed: int, node: np.ndarray | None = None) -> list[np.ndarray]:
    """Train rows and residual sums of the nodes to count (``slots``, else -1) by node, feature and bin;
    before the first level also the measures of all rows. ``node`` is where the rows are, if that is known."""
    if node is None:
        node = tree.places(block.words, block.train, block.fields)
    words, rest, slot = block.words[:, : block.train], block.rest[: block.train], slots.take(node[: block.train])
    used = slot >= 0
    if share < 1:
        used &= _drawn(block.drawn_by[: block.train], seed, share)
    rows = None if used.all() else np.flatnonzero(used)
    if rows is not None:
        rest, slot = rest.take(rows), slot.take(rows)
    n, fields = slots.max() + 1, block.fields
    both = np.zeros((2, n, len(fields.word), BINS))
    for w, column in enumerate(words):
        held = fields.within(w)
        size = 1 << sum(bits for _, bits in held)
        cell = slot * size
        cell += column if rows is None else column.take(rows)
        _unfold(np.bincount(cell, minlength=n * size).reshape(n, size), held, both[0])
        _unfold(np.bincount(cell, rest, n * size).reshape(n, size), held, both[1])
    return [both] if tree.depth else [both, _measures(block)]


def _added(a: list[np.ndarray], b: list[np.ndarray]) -> list[np.ndarray]:
    return [x + y for x, y in zip(a, b)]


def _noise(gain: np.ndarray, n: np.ndarray, s: np.ndarray, floor: float) -> np.ndarray:
    """What the order of additions, and differences of sums, may change of the best gains."""
    return 1e-9 * np.maximum(gain.max(axis=0), 0) + 1e-12 * s**2 / np.maximum(n, 1) + floor


def _first_best(gain: np.ndarray, noise: np.ndarray) -> np.ndarray:
    """The first choice (row) of every node (column) whose gain is the greatest but for rounding."""
    return (gain >= gain.max(axis=0) - noise).argmax(axis=0)


def _best(both: np.ndarray, least: int, floor: float) -> tuple[np.ndarray, ...]:
    """Every feature's best cut of every node: gain, cut, rows and sum on the left and in all."""
    left_n, left_s = both.cumsum(axis=3)
    n, s = left_n[:, :, -1], left_s[:, :, -1]
    left_n, left_s = left_n[:, :, :-1], left_s[:, :, :-1]
    right_n, right_s = n[:, :, None] - left_n, s[:, :, None] - left_s
    open_ = (left_n >= least) & (right_n >= least)
    parts = left_s**2 / np.maximum(left_n, 1) + right_s**2 / np.maximum(right_n, 1)
    gain = np.where(open_, parts - (s**2 / np.maximum(n, 1))[:, :, None], -np.inf)
    by_cut = np.moveaxis(gain, 2, 0)
    cut = _first_best(by_cut, _noise(by_cut, n, s, floor))
    gain, left_n, left_s = (np.take_along_axis(x, cut[:, :, None], 2)[:, :, 0] for x in (gain, left_n, left_s))
    return tuple(x.T for x in (gain, cut, left_n, left_s, n, s))


def _features_per_node(fraction: str, n: int) -> int:
    """``featureSubsetStrategy`` of Spark's forests for one tree."""
    named = {"all": n, "auto": n, "sqrt": math.ceil(n**0.5), "onethird": math.ceil(n / 3), "log2": max(1, math.ceil(math.log2(n)))}
    if fraction in named:
        return named[fraction]
    return min(n, int(fraction)) if fraction.isdigit() and int(fraction) > 0 and fraction != "1" else math.ceil(float(fraction) * n)


def _grow(count: Callable[[Tree, np.ndarray], list[np.ndarray]], boosting: Boosting, seed: int) -> tuple[Tree, np.ndarray]:
    """A tree on the residuals, from the counts of one level after the other, and the measures before it."""
    tree = Tree(*(np.array([x]) for x in (-1, 0, 0, 0.0, 0.0, 0.0)))
    level = counted = np.array([0])
    measures, parent, floor = np.zeros(3), np.zeros(0), 0.0
    least = max(1, boosting.min_rows_per_leaf)
    for depth in range(boosting.depth):
        if depth:
            smaller = np.arange(0, len(level), 2) + (tree.rows[level[::2]] > tree.rows[level[1::2]])
            counted = level[smaller]
        slots = np.full(len(tree.feature), -1)
        slots[counted] = np.arange(len(counted))
        both, *more = count(tree, slots)
        if depth:
            whole = np.empty((2, len(level), *both.shape[2:]))
            whole[:, smaller], whole[:, smaller ^ 1] = both, parent - both
            both = whole
        else:
            measures = more[0]
            floor = (1e-14 * measures[2]) ** 2
        gain, cut, left_n, left_s, n, s = _best(both, least, floor)
        gain = gain.copy()
        kept = _features_per_node(boosting.feature_fraction, len(gain))
        if kept < len(gain):
            order = np.random.default_rng([seed % 2**32, depth]).random((len(level), len(gain))).argsort(axis=1)
            np.put_along_axis(gain.T, order[:, kept:], -np.inf, axis=1)
        n, s = n[0], s[0]
        if depth == 0:
            tree.value[0], tree.rows[0] = s[0] / max(n[0], 1), n[0]
        least_gain = _noise(gain, n, s, floor)
        best, at = _first_best(gain, least_gain), np.arange(len(level))
        gain, cut, left_n, left_s = (x[best, at] for x in (gain, cut, left_n, left_s))
        splits = gain > least_gain
        if not splits.any():
            break
        parent = both[:, splits]
        best, cut, left_n, left_s, gain, n, s, parents = (x[splits] for x in (best, cut, left_n, left_s, gain, n, s, level))
        known = len(tree.feature)
        tree.feature[parents], tree.cut[parents], tree.gain[parents] = best, cut, gain / n
        tree.left[parents] = known + 2 * np.arange(len(parents))
        rows = np.stack([left_n, n - left_n], axis=1).ravel()
        value = np.stack([left_s, s - left_s], axis=1).ravel() / rows
        none = np.zeros(len(rows))
        level = known + np.arange(len(rows))
        grown = (none - 1, none, none, value, rows, none)
        old = (tree.feature, tree.cut, tree.left, tree.value, tree.rows, tree.gain)
        tree = Tree(*(np.concatenate([a, b.astype(a.dtype)]) for a, b in zip(old, grown)), depth + 1)
    return tree, measures


def _grow_across(state: RDD, boosting: Boosting, seed: int) -> tuple[Tree, np.ndarray]:
    """A tree on the residuals of all blocks, one job a level, and the measures before it."""
    share, depth = boosting.row_fraction, 1 if state.getNumPartitions() <= GATHERED else 2

    def count(tree: Tree, slots: np.ndarray) -> list[np.ndarray]:
        return state.map(lambda b: _count(b, tree, slots, share, seed)).treeReduce(_added, depth)

    return _grow(count, boosting, seed)


def _step(block: Block, tree: Tree, weight: float, node: np.ndarray | None = None, above: int = 0) -> Block:
    node = tree.places(block.words, len(block.rest), block.fields, node, above)
    return replace(block, rest=block.rest - weight * tree.value[node])


def _grow_within(block: Block, boosting: Boosting, seed: int) -> tuple[Tree, Block]:
    """A tree on the residuals of one block, and the block after it."""
    node, above = np.zeros(len(block.rest), np.int64), 0

    def count(tree: Tree, slots: np.ndarray) -> list[np.ndarray]:
        nonlocal node, above
        node, above = tree.places(block.words, len(node), block.fields, node if above else None, above), tree.depth
        return _count(block, tree, slots, boosting.row_fraction, seed, node)

    tree, _ = _grow(count, boosting, seed)
    return tree, _step(block, tree, boosting.learning_rate, node if above else None, above)


def _rounds(block: Block, boosting: Boosting, losses: list[float], until: int) -> tuple[Block, list[Tree], list[float]]:
    """Rounds on one block after those with these losses, ``until`` as many are done or the patience is at its end."""
    trees, losses = [], list(losses)
    while len(losses) < until and not is_over(losses, boosting.patience):
        tree, block = _grow_within(block, boosting, boosting.seed + len(losses) + 1)
        found = _measures(block)
        trees.append(tree)
        losses.append(float(found[0] / found[1]))
    return block, trees, losses


def _ensemble(trees: list[Tree], weights: list[float], cuts: list[np.ndarray], like: DataFrame) -> GBTRegressionModel:
    """Trees and their weights as one of Spark's models, which scores, explains, saves and loads them.

    Neither uses the nodes' impurity, which is not measured (NaN). A model of many nodes is saved without them, as
    Spark writes it, and loaded with the table of its nodes.
    """
    if sum(len(t.feature) for t in trees) <= CALLED_NODES:
        return _called(trees, weights, cuts, like)
    roots = [replace(t, **{x: getattr(t, x)[:1] for x in ("cut", "left", "value", "rows", "gain")}, feature=np.array([-1])) for t in trees]
    path = new_folder(like.sparkSession, "trees")
    _called(roots, weights, cuts, like).write().save(path)
    nodes = like.sparkSession.createDataFrame(_nodes(trees, cuts))
    nodes.coalesce(1).write.mode("overwrite").parquet(f"{path}/data")
    return GBTRegressionModel.load(path)


def _nodes(trees: list[Tree], cuts: list[np.ndarray]) -> pa.Table:
    """All nodes of all trees as Spark's tree models are saved."""
    feature, cut, left, value, rows, gain = (
        np.concatenate([getattr(t, x) for t in trees]) for x in ("feature", "cut", "left", "value", "rows", "gain")
    )
    sizes, inner = [len(t.feature) for t in trees], feature >= 0
    below = np.where(inner, left, -1).astype(np.int32)
    threshold = np.array([cuts[f][c] for f, c in zip(feature[inner], cut[inner])], float)
    starts = np.concatenate([[0], inner.cumsum()]).astype(np.int32)
    figures = np.stack([rows, value * rows, np.full(len(rows), np.nan)], axis=1)
    split = {
        "featureIndex": pa.array(feature.astype(np.int32)),
        "leftCategoriesOrThreshold": pa.ListArray.from_arrays(starts, threshold),
        "numCategories": pa.array(np.full(len(rows), -1, np.int32)),
    }
    node = {
        "id": pa.array(np.concatenate([np.arange(n, dtype=np.int32) for n in sizes])),
        "prediction": pa.array(value.astype(float)),
        "impurity": pa.array(np.full(len(rows), np.nan)),
        "impurityStats": pa.ListArray.from_arrays(np.arange(0, figures.size + 1, 3, dtype=np.int32), figures.ravel()),
        "rawCount": pa.array(rows.astype(np.int64)),
        "gain": pa.array(np.where(inner, gain, -1.0)),
        "leftChild": pa.array(below),
        "rightChild": pa.array(np.where(inner, below + 1, -1).astype(np.int32)),
        "split": pa.StructArray.from_arrays(list(split.values()), list(split)),
    }
    tree = pa.array(np.repeat(np.arange(len(trees), dtype=np.int32), sizes))
    return pa.table({"treeID": tree, "nodeData": pa.StructArray.from_arrays(list(node.values()), list(node))})


def _called(trees: list[Tree], weights: list[float], cuts: list[np.ndarray], like: DataFrame) -> GBTRegressionModel:
    """The model node by node. Every call takes its way to the JVM and back, so names are looked up once and a
    tree's figures go there in one piece."""
    spark = like.sparkSession.sparkContext
    jvm, gateway = spark._jvm, spark._gateway
    parts, cut_out = jvm.org.apache.spark.ml.tree, jvm.java.util.Arrays.copyOfRange
    leaf_of, inner_of, split_at = parts.LeafNode, parts.InternalNode, parts.ContinuousSplit
    variance = jvm.org.apache.spark.mllib.tree.impurity.VarianceCalculator
    unknown = float("nan")

    def figures(tree: Tree):
        each = np.stack([tree.rows, tree.value * tree.rows, np.full(len(tree.rows), unknown)], axis=1)
        return _py2java(spark, DenseVector(each.ravel())).values()

    def node(tree: Tree, i: int, below: dict, stats):
        held = variance(cut_out(stats, 3 * i, 3 * i + 3), int(tree.rows[i]))
        value, feature, left = float(tree.value[i]), int(tree.feature[i]), int(tree.left[i])
        if feature < 0:
            return leaf_of(value, unknown, held)
        split = split_at(feature, float(cuts[feature][tree.cut[i]]))
        return inner_of(value, unknown, float(tree.gain[i]), below.pop(left), below.pop(left + 1), split, held)

    java_trees = gateway.new_array(jvm.org.apache.spark.ml.regression.DecisionTreeRegressionModel, len(trees))
    java_weights = gateway.new_array(jvm.double, len(trees))
    for k, (tree, weight) in enumerate(zip(trees, weights)):
        nodes, stats = {}, figures(tree)
        for i in reversed(range(len(tree.feature))):
            nodes[i] = node(tree, i, nodes, stats)
        java_trees[k] = jvm.org.apache.spark.ml.regression.DecisionTreeRegressionModel(nodes[0], len(cuts))
        java_weights[k] = weight
    uid = f"GBTRegressor_{uuid.uuid4().hex[:12]}"
    model = GBTRegressionModel(jvm.org.apache.spark.ml.regression.GBTRegressionModel(uid, java_trees, java_weights))
    model._resetUid(uid)
    return model.setFeaturesCol(FEATURES)


def boost(rows: DataFrame, boosting: Boosting) -> Boosted:
    """Fit to the train rows of ``rows`` (features, label, split), watching the validation rows.

    The first tree is the mean label; every further one counts ``learning_rate``. ``losses`` starts
    with the first round that fits a tree to residuals.
    """
    spark = rows.sparkSession
    found = {r[SPLIT]: r for r in rows.groupBy(SPLIT).agg(F.count(F.lit(1)).alias("n"), F.avg(LABEL).alias("mean")).collect()}
    for name in ("train", "val"):
        if name not in found:
            raise ValueError(f"no {name} rows with a label: boosting needs train and val")
    start, n = float(found["train"]["mean"]), found["train"]["n"]
    rows = rows.where(F.col(SPLIT).isin("train", "val"))
    cuts = _cuts(rows.where(F.col(SPLIT) == "train"), n, boosting.seed)
    total = n + found["val"]["n"]
    state = _blocks(rows, total, cuts, start, boosting.row_fraction < 1).persist(LEVEL)
    trees, losses = (_boost_within if total <= ONE_BLOCK else _boost_across)(state, boosting)
    best = best_iteration(losses, boosting.patience)
    mean = Tree(*(np.array([x]) for x in (-1, 0, 0, start, float(n), 0.0)))
    weights = [1.0] + [boosting.learning_rate] * best
    return Boosted(_ensemble([mean, *trees[:best]], weights, cuts, rows), losses, best)


def _written(state: RDD) -> RDD:
    """The blocks written once and read back, so that nothing before is needed any more."""
    spark = SparkSession.active()
    path = new_folder(spark, "boosting")
    state.saveAsPickleFile(path, 1)
    written = spark.sparkContext.pickleFile(path).persist(LEVEL)
    state.unpersist()
    return written


def _boost_within(state: RDD, boosting: Boosting) -> tuple[list[Tree], list[float]]:
    """Trees and losses of all rounds on one block, in jobs of 1, 2, 4 ... rounds, ``CUT_EVERY`` at most."""
    trees, losses, some, unwritten, before = [], [], 1, 0, state
    while len(losses) < boosting.iterations and not is_over(losses, boosting.patience):
        if unwritten + some > CUT_EVERY and unwritten:
            state, unwritten = _written(state), 0
            before.unpersist()
            before = state
        until = min(len(losses) + some, boosting.iterations)
        ran = state.map(lambda b, x=losses, u=until: _rounds(b, boosting, x, u)).persist(LEVEL)
        more, losses = ran.map(lambda x: x[1:]).first()
        trees += more
        unwritten += some
        some = min(2 * some, CUT_EVERY)
        before.unpersist()
        before, state = ran, ran.map(lambda x: x[0])
    before.unpersist()
    return trees, losses


def _boost_across(state: RDD, boosting: Boosting) -> tuple[list[Tree], list[float]]:
    """Trees and losses of all rounds on many blocks."""
    trees, losses, before = [], [], None
    for k in range(boosting.iterations):
        if k and k % CUT_EVERY == 0:
            state = _written(state)
        tree, found = _grow_across(state, boosting, boosting.seed + k + 1)
        if before is not None:
            before.unpersist()
        if k:
            losses.append(float(found[0] / found[1]))
            if is_over(losses, boosting.patience):
                break
        trees.append(tree)
        before, state = state, state.map(lambda b, t=tree: _step(b, t, boosting.learning_rate)).persist(LEVEL)
    else:
        found = state.map(_measures).reduce(np.add)
        losses.append(float(found[0] / found[1]))
    for held in (before, state):
        if held is not None:
            held.unpersist()
    return trees, losses
