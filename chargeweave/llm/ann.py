"""Nearest neighbours by an adaptive dimension scan of inverted lists.

Lists are the nearest of ``LISTS`` centroids, fitted to ``SAMPLE`` vectors (those with the smallest
hashes of vec_id); every vector is indexed. Vectors are rotated at random and scanned in blocks of
columns. After each block a hypothesis test drops the candidates whose partial distance shows that
the full one exceeds the distance of the k-th best so far; survivors are measured exactly, in double
precision, on the original vectors. The first bound of a query comes from the sample. A query that
then has fewer than k rows, because others lie in lists it did not probe, reads all lists, without the
test: every query gets k rows, or all candidates if there are fewer. Without usable rows the result
is empty.

Equal vectors: of each group only the k + 1 smallest ids can be among the nearest k, so only these
are indexed, and equal queries are searched once. Lists and the queries that probe them are dealt in
chunks. Rows whose vector is null, zero, holds null or non-finite components or has another length
than most (ties: the shorter), and rows without vec_id, take no part. Rows that repeat a vec_id are
candidates of their own. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chargeweave.session import stage

K = 10
SAMPLE = 8192
LISTS = 64
PROBES = 44
COLUMNS = 16
#: The test's width: larger keeps more candidates.
EPSILON = 2.1
CHUNK_ROWS = 20_000
CHUNK_QUERIES = 2_000
_ROUNDS = 12
_BLOCK_ROWS = 2048


class Index:
    """Centroids, rotation and sample: SAMPLE and LISTS vectors at most, whatever the input."""

    def __init__(self, sample: np.ndarray):
        random = np.random.default_rng(7)
        self.sample = sample
        self.rotation = np.linalg.qr(random.standard_normal((sample.shape[1],) * 2))[0]
        chosen = random.permutation(len(sample))[:LISTS]
        self.centroids = sample[np.sort(chosen)]
        for _ in range(_ROUNDS):
            nearest = self.nearest(sample, 1)[:, 0]
            for i in range(len(self.centroids)):
                if (mine := nearest == i).any():
                    self.centroids[i] = sample[mine].mean(axis=0)

    def _squares(self, x: np.ndarray, to: np.ndarray) -> np.ndarray:
        return (x**2).sum(1)[:, None] - 2 * x @ to.T + (to**2).sum(1)[None, :]

    def nearest(self, x: np.ndarray, n: int) -> np.ndarray:
        return np.argsort(self._squares(x, self.centroids), axis=1, kind="stable")[:, :n]

    def bound(self, x: np.ndarray, k: int) -> np.ndarray:
        """An upper bound of the distance of the k-th nearest."""
        if len(self.sample) < k:
            return np.full(len(x), np.inf)
        squares = np.partition(self._squares(x, self.sample), k - 1, axis=1)[:, k - 1]
        return np.sqrt(np.maximum(squares, 0)) * (1 + 1e-6) + 1e-6


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    return np.asarray(column.values[column.offsets[0].as_py() : column.offsets[-1].as_py()], np.float64).reshape(-1, dim)


def _rows(x: np.ndarray) -> pa.Array:
    return pa.array([r.tobytes() for r in x], pa.binary())


def valid(vectors: DataFrame, id_: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """vec_id and vec (array<double>) of the rows that take part."""
    v = F.col("vec")

    def good(x: Column) -> Column:
        return x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))

    usable = (
        vectors.select(F.col(id_).cast("long").alias("vec_id"), F.col(vector).cast("array<double>").alias("vec"))
        .where(F.col("vec_id").isNotNull() & v.isNotNull() & F.forall(v, lambda x: good(x)) & F.exists(v, lambda x: x != 0))
    )
    usable = stage(usable, "vectors")
    common = usable.groupBy(F.size("vec").alias("n")).count().orderBy(F.desc("count"), "n").first()
    return usable.where(F.size("vec") == (common["n"] if common else 0))


def _first_of_equal(vectors: DataFrame, n: int) -> DataFrame:
    """The ``n`` smallest ids of each vector; salted first, so a common vector is no single task."""
    for key in (["vec", F.pmod(F.xxhash64("vec_id"), F.lit(64))], ["vec"]):
        order = Window.partitionBy(*key).orderBy("vec_id")
        vectors = vectors.withColumn("at", F.row_number().over(order)).where(F.col("at") <= n).drop("at")
    return vectors


def scan(
    x: np.ndarray, ids: np.ndarray, queries: np.ndarray, bounds: np.ndarray, rotation: np.ndarray, k: int,
    test: bool = True,
):
    """For each query the k nearest rows (order by distance and id): yields query, ids, distances.

    Without ``test`` a row is left only when its partial distance already exceeds the bound.
    """
    dim = x.shape[1]
    turned, turned_q = x @ rotation, queries @ rotation
    blocks = [slice(a, min(a + COLUMNS, dim)) for a in range(0, dim, COLUMNS)]
    columns = [np.ascontiguousarray(turned[:, b]) for b in blocks]
    for q in range(len(queries)):
        best_d, best_i, bound = np.empty(0), np.empty(0, np.int64), bounds[q]
        for at in range(0, len(x), _BLOCK_ROWS):
            alive = np.arange(at, min(at + _BLOCK_ROWS, len(x)))
            partial = np.zeros(len(alive))
            for b, block in zip(blocks, columns, strict=True):
                partial += ((block[alive] - turned_q[q, b]) ** 2).sum(axis=1)
                if b.stop < dim:
                    limit = bound**2 * (1 + 1e-9) + 1e-12
                    if test:
                        limit = bound**2 * b.stop / dim * (1 + EPSILON / np.sqrt(b.stop)) ** 2
                    near = partial <= limit
                    alive, partial = alive[near], partial[near]
            near = partial <= bound**2 * (1 + 1e-9) + 1e-12
            alive = alive[near]
            if not len(alive):
                continue
            exact = np.sqrt(((x[alive] - queries[q]) ** 2).sum(axis=1))
            best_d, best_i = np.concatenate([best_d, exact]), np.concatenate([best_i, ids[alive]])
            order = np.lexsort((best_i, best_d))[:k]
            best_d, best_i = best_d[order], best_i[order]
            if len(best_d) == k:
                bound = min(bound, best_d[-1])
        yield q, best_i, best_d


def search(vectors: DataFrame, queries: Column, k: int = K) -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest found of every row for which ``queries`` holds."""
    spark = vectors.sparkSession
    rows = valid(vectors)
    sample = rows.orderBy(F.xxhash64("vec_id"), "vec_id").limit(SAMPLE).collect()  # SAMPLE rows
    schema = "query_id long, rank int, vec_id long, score double"
    if not sample:
        return spark.createDataFrame([], schema)
    index = spark.sparkContext.broadcast(Index(np.array([r["vec"] for r in sample])))
    dim = len(sample[0]["vec"])

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = _matrix(batch.column("vec"), dim)
            yield pa.RecordBatch.from_arrays(
                [batch.column("vec_id"), _rows(x), pa.array(index.value.nearest(x, 1)[:, 0].astype(np.int32))],
                ["vec_id", "vec", "list"],
            )

    def probe(most: int | None) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                x = _matrix(batch.column("vec"), dim)
                lists = index.value.nearest(x, most or len(index.value.centroids))
                yield asks(batch, x, lists)

        return run

    def asks(batch: pa.RecordBatch, x: np.ndarray, lists: np.ndarray) -> pa.RecordBatch:
        n = lists.shape[1]
        return pa.RecordBatch.from_arrays(
            [
                pa.array(np.repeat(batch.column("query").to_numpy(), n)),
                _rows(np.repeat(x, n, axis=0)),
                pa.array(np.repeat(index.value.bound(x, k + 1), n)),
                pa.array(lists.ravel().astype(np.int32)),
            ],
            ["query", "vec", "bound", "list"],
        )

    indexed = stage(
        _first_of_equal(rows, k + 1).select("vec_id", "vec").mapInArrow(assign, "vec_id long, vec binary, list int"),
        "lists",
    )
    asked = rows.where(queries)
    distinct = stage(_first_of_equal(asked, 1).select(F.col("vec_id").alias("query"), "vec"), "queries")
    best = Window.partitionBy("query").orderBy("score", "vec_id")

    def scanned(asking: DataFrame, most: int | None, test: bool) -> DataFrame:
        probes = stage(
            asking.mapInArrow(probe(most), "query long, vec binary, bound double, list int"), "probes"
        )
        # Chunks per list: at most LISTS rows.
        sizes = indexed.groupBy("list").agg(F.ceil(F.count(F.lit(1)) / CHUNK_ROWS).cast("int").alias("chunks"))
        asked_of = probes.groupBy("list").agg(F.ceil(F.count(F.lit(1)) / CHUNK_QUERIES).cast("int").alias("parts"))
        grid = F.broadcast(stage(sizes.join(asked_of, "list"), "grid"))
        right = (
            indexed.join(grid, "list")
            .withColumn("chunk", F.pmod(F.xxhash64("vec_id"), F.col("chunks")).cast("int"))
            .withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
            .select("list", "chunk", "part", "vec_id", "vec")
        )
        left = (
            probes.join(grid, "list")
            .withColumn("part", F.pmod(F.xxhash64("query"), F.col("parts")).cast("int"))
            .withColumn("chunk", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
            .select("list", "chunk", "part", "query", "vec", "bound")
        )

        def scan_chunk(ask: pd.DataFrame, rows: pd.DataFrame) -> pd.DataFrame:
            out = {"query": [], "vec_id": [], "score": []}
            if len(ask) and len(rows):
                q = np.frombuffer(b"".join(ask["vec"])).reshape(-1, dim)
                x = np.frombuffer(b"".join(rows["vec"])).reshape(-1, dim)
                ids, names = rows["vec_id"].to_numpy(), ask["query"].to_numpy()
                bounds = ask["bound"].to_numpy()
                for i, found, scores in scan(x, ids, q, bounds, index.value.rotation, k + 1, test):
                    out["query"] += [names[i]] * len(found)
                    out["vec_id"] += found.tolist()
                    out["score"] += scores.tolist()
            return pd.DataFrame(out).astype({"query": "int64", "vec_id": "int64", "score": "float64"})

        keys = ["list", "chunk", "part"]
        met = (
            left.groupBy(*keys)
            .cogroup(right.groupBy(*keys))
            .applyInPandas(scan_chunk, "query long, vec_id long, score double")
        )
        return stage(met.withColumn("at", F.row_number().over(best)).where(F.col("at") <= k + 1).drop("at"), "found")

    found = scanned(distinct, PROBES, True)
    # The first bound may come from vectors in lists that were not probed; a query left with fewer rows
    # than it asked for reads all lists, and none of its rows is abandoned by the test.
    n_found = found.groupBy("query").agg(F.count(F.lit(1)).alias("n"))
    short = distinct.join(n_found, "query", "left").where(F.coalesce("n", F.lit(0)) < k + 1)
    short = stage(short.select("query", "vec"), "short")
    if not short.isEmpty():
        rest = found.join(short.select("query"), "query", "left_anti")
        found = rest.unionAll(scanned(short, None, False).select(rest.columns))
    names = asked.select(F.col("vec_id").alias("query_id"), "vec").distinct().join(distinct, "vec")
    rank = Window.partitionBy("query_id").orderBy("score", "vec_id")
    return (
        names.select("query_id", "query")
        .join(found, "query")
        .where("vec_id <> query_id")
        .withColumn("rank", F.row_number().over(rank))
        .where(F.col("rank") <= k)
        .select("query_id", "rank", "vec_id", "score")
    )
