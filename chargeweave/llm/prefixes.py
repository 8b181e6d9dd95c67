"""The trie of conversation prefixes with totals per subtree.

A node is a distinct sequence of the first turns (role, text) of some conversations, its members; the
root is the empty sequence, of which all are members. Nodes are told by two sums over digests of
(position, role, text), 120 bits, so that prefixes are running sums and a conversation of any
length is dealt out in chunks of ``CHUNK`` turns.

Subtree totals come by time-forward processing (``timeforward.py``). Nodes with over ``HEAVY`` members
form the upper part of the trie; the subtrees that hang below it are shards with at most ``HEAVY``
members each. Spark deals whole shards to partitions and sorts each partition by reverse level order
(spilling); totals go to parents through a spilling queue. The totals of the shards' roots are summed
per heavy parent, and the upper part, at most depth x conversations / HEAVY nodes, is processed the
same way. Below a node with one member there is one path and nothing to save, so such nodes need no
messages and only count as children of their parent.

Conversations are ordered by turn (null first), then role and text; repeated rows are repeated
turns. Null role or text is empty. Rows without conv_id belong to no conversation and are left out. A
text of any length is read once for its digest and length. Without rows there is no conversation and no
node, not even the root. Other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chargeweave.llm.timeforward import HELD, subtree_totals
from chargeweave.session import stage

CHUNK = 1024
HEAVY = 4096
FAMILY = 5
MOST_SHARED = 8
ROOT = "0:0"
_BATCH = 8192


def number(turns: DataFrame) -> DataFrame:
    """conv_id, at (from 1 in each conversation), role, text, written as a stage.

    Rows are sorted in ranges of the whole order, so a long conversation is spread over several; a
    row's number is its place in its range plus the counts of the ranges before.
    """
    rows = turns.where("conv_id IS NOT NULL").select(
        F.col("conv_id").cast("long").alias("conv_id"),
        F.col("turn").cast("long").alias("turn"),
        F.coalesce("role", F.lit("")).alias("role"),
        F.coalesce("text", F.lit("")).alias("text"),
    )
    order = [F.col("conv_id"), F.col("turn").asc_nulls_first(), F.col("role"), F.col("text")]
    placed = stage(
        rows.repartitionByRange(*order)
        .sortWithinPartitions(*order)
        .select("conv_id", "role", "text", F.monotonically_increasing_id().alias("place")),
        "placed",
    )
    part = F.shiftright("place", 33).alias("part")
    earlier = Window.partitionBy("conv_id").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    ranges = (
        placed.groupBy("conv_id", part)
        .agg(F.min("place").alias("first"), F.count(F.lit(1)).alias("n"))
        .withColumn("before", F.coalesce(F.sum("n").over(earlier), F.lit(0)))
    )
    at = F.col("place") - F.col("first") + F.col("before") + 1
    numbered = placed.withColumn("part", part).join(ranges, ["conv_id", "part"])
    return stage(numbered.select("conv_id", at.alias("at"), "role", "text"), "numbered")


def rebuild(numbered: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Conversations that share openings: their ids, and their turns (conv_id, at, role, text).

    Conversation c starts with the first h turns of conversation c - c % FAMILY, h being
    crc32(c) % (MOST_SHARED + 1), and goes on with its own turns after its first h.
    """
    opened_by = F.col("conv_id") - F.col("conv_id") % FAMILY
    h = F.crc32(F.col("conv_id").cast("string")) % (MOST_SHARED + 1)
    convs = stage(
        numbered.groupBy("conv_id").agg(F.count(F.lit(1)).alias("n")).select(
            "conv_id", "n", opened_by.alias("opener"), h.alias("h")
        ),
        "conversations",
    )
    openings = numbered.where((F.col("conv_id") == opened_by) & (F.col("at") <= MOST_SHARED))
    lengths = convs.where("conv_id = opener").select(F.col("conv_id").alias("opener"), F.col("n").alias("given"))
    plans = convs.join(lengths, "opener", "left").select(
        "conv_id", "opener", "h", F.least("h", F.coalesce("given", F.lit(0))).alias("shared")
    )
    head = (
        openings.select(F.col("conv_id").alias("opener"), "at", "role", "text")
        .join(plans.where("shared > 0"), "opener")
        .where("at <= h")
    )
    tail = numbered.join(plans.select("conv_id", "h", "shared"), "conv_id").where("at > h")
    turns = head.select("conv_id", "at", "role", "text").unionAll(
        tail.select("conv_id", (F.col("at") - F.col("h") + F.col("shared")).alias("at"), "role", "text")
    )
    return convs.select("conv_id"), turns


def _digits(digest: Column, first: int) -> Column:
    """60 bits of a hex digest."""
    return F.conv(F.substring(digest, first, 15), 16, 10).cast("decimal(20,0)")


def prefixes(turns: DataFrame) -> DataFrame:
    """conv_id, depth, key, parent, bytes: the prefix each turn ends, written as a stage."""
    told = F.concat_ws(":", F.col("at").cast("string"), F.length("role").cast("string"), F.concat("role", "text"))
    terms = turns.select(
        "conv_id",
        F.col("at").alias("depth"),
        F.floor((F.col("at") - 1) / CHUNK).alias("chunk"),
        F.octet_length("text").cast("long").alias("bytes"),
        F.md5(told).alias("digest"),
    ).select(
        "conv_id", "depth", "chunk", "bytes", _digits(F.col("digest"), 1).alias("a"), _digits(F.col("digest"), 17).alias("b")
    )
    terms = stage(terms, "terms")
    whole = terms.groupBy("conv_id", "chunk").agg(F.sum("a").alias("a"), F.sum("b").alias("b"))
    earlier = Window.partitionBy("conv_id").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    carried = whole.select(
        "conv_id",
        "chunk",
        *(F.coalesce(F.sum(c).over(earlier), F.lit(0)).cast("decimal(30,0)").alias(f"{c}_before") for c in "ab"),
    )
    inside = Window.partitionBy("conv_id", "chunk").orderBy("depth").rowsBetween(Window.unboundedPreceding, 0)
    sums = terms.select(
        "conv_id", "depth", "chunk", "bytes", "a", "b", *(F.sum(c).over(inside).cast("decimal(30,0)").alias(f"{c}_here") for c in "ab")
    ).join(carried, ["conv_id", "chunk"])
    upto = {c: F.col(f"{c}_before") + F.col(f"{c}_here") for c in "ab"}

    def key(*parts: Column) -> Column:
        return F.concat_ws(":", *(p.cast("decimal(30,0)").cast("string") for p in parts))

    return stage(
        sums.select(
            "conv_id",
            "depth",
            key(upto["a"], upto["b"]).alias("key"),
            key(upto["a"] - F.col("a"), upto["b"] - F.col("b")).alias("parent"),
            "bytes",
        ),
        "prefixes",
    )


_TOTALS = "key string, n_children long, n_leaves long, saved_tokens long"


def _batches(rows: Iterator[tuple], names: list[str]) -> Iterator[pa.RecordBatch]:
    types = [pa.string()] + [pa.int64()] * (len(names) - 1)
    held: list = []
    for row in rows:
        held.append(row)
        if len(held) == _BATCH:
            yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*held), types)], names)
            held = []
    if held:
        yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*held), types)], names)


def _process(nodes: DataFrame, held: int) -> DataFrame:
    """Totals of nodes whose partitions hold whole subtrees. up: parent, null at a shard's root."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def read() -> Iterator[tuple]:
            for batch in batches:
                for r in zip(*(batch.column(k).to_pylist() for k in range(6))):
                    yield r[0], r[1], r[2], (r[3], r[4]), r[5]

        rows = ((key, n, *totals) for _, key, n, totals in subtree_totals(read(), held))
        yield from _batches(rows, ["key", "n_children", "n_leaves", "saved_tokens"])

    ordered = nodes.sortWithinPartitions(F.col("depth").desc(), "key")
    fields = ("depth", "key", "up", "leaves", "saved", "children")
    return ordered.select(*fields).mapInArrow(run, _TOTALS)


def _with_below(nodes: DataFrame, below: DataFrame) -> DataFrame:
    """Own values of nodes, with what is known of children that send no message."""
    joined = nodes.join(below, nodes["key"] == below["of"], "left")
    return joined.select(
        *nodes.columns,
        F.coalesce("n", F.lit(0)).alias("children"),
        F.coalesce("below_leaves", F.lit(0)).alias("leaves"),
        ((F.col("n_convs") - 1) * F.col("bytes") + F.coalesce("below_saved", F.lit(0))).alias("saved"),
    )


def _totals(nodes: DataFrame, rows: DataFrame, heavy: int, held: int) -> DataFrame:
    """n_children, n_leaves and saved_tokens of every node with two members or more, and the root."""
    upper = nodes.where((F.col("n_convs") > heavy) | F.col("parent").isNull())
    lower = nodes.where((F.col("n_convs") <= heavy) & (F.col("n_convs") > 1) & F.col("parent").isNotNull())
    single = nodes.where((F.col("n_convs") == 1) & F.col("parent").isNotNull())
    paths = single.groupBy(F.col("parent").alias("of")).agg(
        F.count(F.lit(1)).alias("n"), F.count(F.lit(1)).alias("below_leaves"), F.lit(0).cast("long").alias("below_saved")
    )
    paths = stage(paths, "paths")

    tops = stage(lower.join(upper.select(F.col("key").alias("parent")), "parent", "left_semi"), "tops")
    shards = rows.select("conv_id", "key").join(tops.select("key"), "key")
    shards = shards.select("conv_id", F.col("key").alias("top"))
    sharded = _with_below(lower, paths).join(shards, "conv_id").repartition("top")
    up = F.when(F.col("key") != F.col("top"), F.col("parent")).alias("up")
    light = stage(_process(sharded.withColumn("up", up), held), "light_totals")

    roots = tops.select("key", F.col("parent").alias("of")).join(light, "key")
    hung = roots.select("of", F.lit(1).alias("n"), F.col("n_leaves").alias("below_leaves"), F.col("saved_tokens").alias("below_saved"))
    below = hung.unionAll(paths).groupBy("of").agg(
        *(F.sum(c).cast("long").alias(c) for c in ("n", "below_leaves", "below_saved"))
    )
    one = _with_below(upper, below).withColumn("up", F.col("parent")).repartition(1)
    return light.unionAll(stage(_process(one, held), "heavy_totals"))


def _ends(convs: DataFrame, rows: DataFrame) -> DataFrame:
    """key, ends_sha256 of the nodes at which conversations end.

    Ids are joined in blocks first, so what one node's digest reads in order is few rows.
    """
    last = rows.groupBy("conv_id").agg(F.max_by("key", "depth").alias("key"))
    ends = convs.join(last, "conv_id", "left").select("conv_id", F.coalesce("key", F.lit(ROOT)).alias("key"))
    blocks = ends.groupBy("key", F.floor(F.col("conv_id") / 4096).alias("block")).agg(
        F.array_join(F.sort_array(F.collect_list("conv_id")).cast("array<string>"), ",").alias("ids")
    )

    def digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def found() -> Iterator[tuple[str, str]]:
            now, of = None, None
            for batch in batches:
                for key, ids in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                    if key != now:
                        if of is not None:
                            yield now, of.hexdigest()
                        now, of = key, hashlib.sha256(ids.encode())
                    else:
                        of.update(b"," + ids.encode())
            if of is not None:
                yield now, of.hexdigest()

        held = []
        for row in found():
            held.append(row)
            if len(held) == _BATCH:
                yield pa.record_batch([pa.array(c, pa.string()) for c in zip(*held)], ["key", "ends_sha256"])
                held = []
        if held:
            yield pa.record_batch([pa.array(c, pa.string()) for c in zip(*held)], ["key", "ends_sha256"])

    ordered = blocks.repartition("key").sortWithinPartitions("key", "block").select("key", "ids")
    return ordered.mapInArrow(digests, "key string, ends_sha256 string")


def trie(convs: DataFrame, turns: DataFrame, heavy: int = HEAVY, held: int = HELD) -> DataFrame:
    """One row per node. Its last turn is turn ``depth`` of conversation ``conv_id``.

    ``convs`` holds every conv_id, also of conversations without turns; ``turns`` conv_id, at (from 1),
    role and text, no nulls.
    """
    rows = prefixes(turns)
    grouped = rows.groupBy("depth", "key", "parent").agg(
        F.count(F.lit(1)).alias("n_convs"), F.min("conv_id").alias("conv_id"), F.max("bytes").alias("bytes")
    )
    root = convs.agg(F.count(F.lit(1)).alias("n_convs"), F.min("conv_id").alias("conv_id")).select(
        F.lit(0).cast("long").alias("depth"), F.lit(ROOT).alias("key"), F.lit(None).cast("string").alias("parent"),
        "n_convs", "conv_id", F.lit(0).cast("long").alias("bytes"),
    ).where("n_convs > 0")
    nodes = stage(grouped.unionAll(root), "nodes")
    totals = _totals(nodes, rows, heavy, held)
    ends = stage(_ends(convs, rows), "ends")

    known = nodes.join(totals, "key", "left").join(ends, "key", "left")
    parents = nodes.select(F.col("key").alias("parent"), F.col("conv_id").alias("parent_conv_id"))
    single_children = F.when(F.col("ends_sha256").isNull(), 1).otherwise(0)
    return known.join(parents, "parent", "left").select(
        "conv_id",
        "depth",
        "parent_conv_id",
        "n_convs",
        F.coalesce("n_children", single_children).cast("long").alias("n_children"),
        F.coalesce("n_leaves", F.lit(1)).cast("long").alias("n_leaves"),
        F.coalesce("saved_tokens", F.lit(0)).cast("long").alias("saved_tokens"),
        F.coalesce("ends_sha256", F.sha2(F.lit(""), 256)).alias("ends_sha256"),
    )


def report(turns: DataFrame) -> DataFrame:
    """The trie of the rebuilt conversations."""
    return trie(*rebuild(number(turns)))
