"""MinHash near-dedup: universal hash minima, banding, verification, connected components.

Texts are lower-cased (A-Z) and cut into words; a document's set holds its distinct shingles of five
words as 64-bit hashes. Documents with equal sets are one class, whose least doc_id stands for it;
only these representatives are compared. A document is a candidate for another one where a band of
its signature is equal, the sizes allow the similarity and the signatures agree well enough; links
are confirmed on the full sets.

Each member of a bucket first tries one partner, the earliest of the first members of its buckets.
In buckets that then still hold several components, the members outside the largest one meet
``CENTERS`` members inside and outside it, which are all pairs that matter in buckets up to
``CENTERS`` + 1. For the members of larger buckets that still hold several components, the shingles
that no other such member has are counted: they bound every similarity from above, and the members
with the fewest are the next ones to meet those outside. What is left across components is found by
its rarest shingles: in one order of all shingles, the rarest first, two linked sets have the first
common one so early in both that enough can follow, so pairs meet by these shingles instead of by
bucket. A link that would change a component is missed only where a pair shares no band or its
signatures err by more than the slack allows, see ``MISS`` and ``SLACK``; groups of copies stay linear.

Null and empty texts, and rows without doc_id, are linked with nothing. Rows that share a doc_id are
one document, linked through any of their texts. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chargeweave.llm.components import components
from chargeweave.llm.words import free_name
from chargeweave.session import stage

WORDS = 5
#: The least similarity of a link where the caller names none.
PERCENT = 85
MINIMA = 120
#: A pair at the least similarity shares no band with at most this probability.
MISS = 1e-6
CENTERS = 8
#: Shingles counted in one task.
SLICE = 4_000_000
#: Signatures may agree this much less than the sets, or six standard deviations if that is more.
SLACK = 0.2

_CHUNK = 4096


def _constants(seed: int, n: int) -> np.ndarray:
    """Odd 64-bit multipliers from the splitmix sequence."""
    with np.errstate(over="ignore"):
        x = np.uint64(seed) + np.arange(1, n + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    return _mixed(x) | np.uint64(1)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_PLACES = _constants(1, WORDS + 1)
_FACTORS = _constants(2, MINIMA)[:, None]
_SHIFTS = _constants(3, MINIMA)[:, None]


def shingles(text: bytes) -> np.ndarray:
    """The sorted distinct shingle hashes of a text."""
    found = text.lower().split()  # on bytes: A-Z only, and exactly \\x20 and \\x09-\\x0D
    w = np.fromiter(map(xxhash.xxh3_64_intdigest, found), np.uint64, len(found))
    if not len(w):
        return w
    k = min(WORDS, len(w))
    n = len(w) - k + 1
    h = np.full(n, k, np.uint64) * _PLACES[WORDS]
    for i in range(k):
        h += w[i : i + n] * _PLACES[i]
    return np.unique(_mixed(h))


def signature(of: np.ndarray) -> bytes:
    """The minima of ``MINIMA`` universal hashes, 32 bits each."""
    least = np.full(MINIMA, np.iinfo(np.uint64).max)
    for at in range(0, len(of), _CHUNK):
        np.minimum(least, (of[None, at : at + _CHUNK] * _FACTORS + _SHIFTS).min(axis=1), out=least)
    return (least >> np.uint64(32)).astype("<u4").tobytes()


def _sketches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        n, prints, signatures = [], [], []
        for text in batch.column("text"):
            found = shingles(text.as_py() or b"")
            n.append(len(found))
            prints.append(xxhash.xxh3_128_digest(found.tobytes()))
            signatures.append(signature(found) if len(found) else None)
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), pa.array(n, pa.int64()), pa.array(prints, pa.binary()), pa.array(signatures, pa.binary())],
            ["doc_id", "n_shingles", "print", "signature"],
        )


def sketch(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, a print of the whole set, and the signature."""
    raw = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text"))
    return raw.mapInArrow(
        _sketches, "doc_id long, n_shingles long, print binary, signature binary"
    )


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = [shingles(x.as_py() or b"").tobytes() for x in batch.column("text")]
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), pa.array(found, pa.binary())], ["id", "set"]
        )


def _full_sets(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """id, set of the documents named in ``ids`` (id)."""
    raw = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text"))
    return raw.join(ids, raw.doc_id == ids.id, "left_semi").mapInArrow(_sets, "id long, set binary")


def _agree(percent: int):
    p = percent / 100
    least = p - max(SLACK, 6 * (p * (1 - p) / MINIMA) ** 0.5)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            a, b = (
                np.frombuffer(b"".join(batch.column(c).to_pylist()), "<u4").reshape(-1, MINIMA)
                for c in ("su", "sv")
            )
            good = (a == b).mean(axis=1) >= least
            yield batch.select(["u", "v"]).filter(pa.array(good))

    return run


def _linked(percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            good = []
            for a, b in zip(batch.column("su"), batch.column("sv"), strict=True):
                x, y = np.frombuffer(a.as_py(), np.uint64), np.frombuffer(b.as_py(), np.uint64)
                both = len(np.intersect1d(x, y, assume_unique=True))
                good.append(len(x) > 0 and 100 * both >= percent * (len(x) + len(y) - both))
            yield batch.select(["u", "v"]).filter(pa.array(good, pa.bool_()))

    return run


def _with_both(pairs: DataFrame, of: DataFrame, column: str) -> DataFrame:
    left = of.select(F.col("id").alias("u"), F.col(column).alias("su"))
    right = of.select(F.col("id").alias("v"), F.col(column).alias("sv"))
    return pairs.join(left, "u").join(right, "v").select("u", "v", "su", "sv")


def _sizes_allow(percent: int, a: Column, b: Column) -> Column:
    return 100 * F.least(a, b) >= percent * F.greatest(a, b)


def _ordered_pairs(joined: DataFrame) -> DataFrame:
    return joined.select(
        F.least("a.id", "b.id").alias("u"), F.greatest("a.id", "b.id").alias("v")
    ).distinct()


def banding(percent: int) -> tuple[int, int]:
    """Bands and minima in each: the widest bands that miss a pair at ``percent`` with less than
    ``MISS``, as 24 bands of 5 at 85 and 30 bands of 4 at 80."""
    for rows in range(MINIMA, 0, -1):
        bands = MINIMA // rows
        if MINIMA % rows == 0 and (1 - (percent / 100) ** rows) ** bands < MISS:
            return bands, rows
    return MINIMA, 1


def _keys(percent: int) -> Column:
    """The band values of a signature; the number of the band is part of each."""
    bands, rows = banding(percent)
    width = 4 * rows
    return F.array(
        *(F.xxhash64(F.lit(b), F.substring("signature", b * width + 1, width)) for b in range(bands))
    )


def buckets(heads: DataFrame, percent: int) -> DataFrame:
    """band, key, id, n, members, place for every band value that two or more representatives share.

    Places are one order for all buckets: those who share the most band values come first, as a text
    does that many others are edits of."""
    bands = heads.select("id", "n", F.posexplode(_keys(percent)).alias("band", "key"))
    shared = bands.groupBy("key").agg(F.count(F.lit(1)).alias("members")).where("members > 1")
    total = F.sum("members").over(Window.partitionBy("id"))  # one row a band at most
    return bands.join(shared, "key").withColumn("place", -total)


def first_candidates(shared: DataFrame, percent: int) -> DataFrame:
    """One pair for each member: with the earliest one of the first members of its buckets, sizes
    allowing, so that the edits of a text agree on few partners."""
    first = shared.groupBy("key").agg(F.min(F.struct("place", "id", "n")).alias("f")).select("key", "f.*")
    a, b = shared.alias("a"), first.alias("b")
    allowed = _sizes_allow(percent, F.col("a.n"), F.col("b.n"))
    met = a.join(b, (F.col("a.key") == F.col("b.key")) & (F.col("a.id") != F.col("b.id")) & allowed)
    return (
        met.groupBy(F.col("a.id").alias("id"))
        .agg(F.min(F.struct("b.place", "b.id")).alias("f"))
        .select(F.least("id", "f.id").alias("u"), F.greatest("id", "f.id").alias("v"))
        .distinct()
    )


def _outside(members: DataFrame) -> DataFrame:
    """``members`` with ``outside``: whether a member is out of its bucket's largest component."""
    sizes = members.groupBy("key", "component").agg(F.count(F.lit(1)).alias("size"))
    largest = sizes.groupBy("key").agg(F.max(F.struct("size", "component")).alias("most"))
    return members.join(largest.select("key", F.col("most.component").alias("largest")), "key").withColumn(
        "outside", F.col("component") != F.col("largest")
    )


def _partners(members: DataFrame, order: Column, allowed: Callable[[Column], Column]) -> DataFrame:
    """id, others: for each member outside its bucket's largest component those of other components
    among the first ``CENTERS`` inside and the first ``CENTERS`` outside, as far as ``allowed`` (of
    one of them). In buckets of up to ``CENTERS`` + 1 members these are all such pairs.

    Each bucket has one list of centers, so a member and a center that share many buckets meet once."""
    marked = _outside(members)
    rank = F.row_number().over(Window.partitionBy("key", "outside").orderBy(order, "id"))
    centers = marked.withColumn("rank", rank).where(F.col("rank") <= CENTERS)
    compared = [c for c in ("id", "component", "n", "alone") if c in members.columns]
    lists = centers.groupBy("key").agg(F.collect_list(F.struct(*compared)).alias("centers"))
    apart = F.filter("centers", lambda c: (c["component"] != F.col("component")) & allowed(c))
    met = marked.where("outside").join(lists, "key").select("id", F.transform(apart, lambda c: c["id"]).alias("others"))
    return met.groupBy("id").agg(F.array_distinct(F.flatten(F.collect_list("others"))).alias("others"))


def _met(members: DataFrame, order: Column, allowed: Callable[[Column], Column]) -> DataFrame:
    """The pairs of ``_partners``, the lesser id first."""
    pairs = _partners(members, order, allowed).select("id", F.explode("others").alias("other"))
    return pairs.select(F.least("id", "other").alias("u"), F.greatest("id", "other").alias("v")).distinct()


def candidates(members: DataFrame, percent: int) -> DataFrame:
    """Pairs of members of open buckets with the first members of other components, sizes allowing."""
    return _met(members, F.col("place"), lambda c: _sizes_allow(percent, F.col("n"), c["n"]))


def _dealt(slices: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: dict[str, list] = {x: [] for x in _PARTS.names}
            for id_, text, data in zip(*(batch.column(c).to_pylist() for c in ("id", "text")), batch.column("set"), strict=True):
                h = np.frombuffer(data.as_py(), np.uint64)
                at = ((h >> np.uint64(32)) * np.uint64(slices)) >> np.uint64(32)
                for first, last in zip(*_runs(at), strict=True):
                    out["slice"].append(int(at[first]))
                    out["id"].append(id_)
                    out["text"].append(text)
                    out["n"].append(len(h))
                    out["part"].append(h[first:last].tobytes())
            yield pa.RecordBatch.from_pydict(out, _PARTS)

    return run


_PARTS = pa.schema([(x, pa.int64()) for x in ("slice", "id", "text", "n")] + [("part", pa.binary())])


def _runs(x: np.ndarray) -> tuple[list[int], list[int]]:
    """First and last + 1 of the runs of equal values."""
    cuts = (np.flatnonzero(x[1:] != x[:-1]) + 1).tolist()
    return ([0, *cuts], [*cuts, len(x)]) if len(x) else ([], [])


def _counted(percent: int):
    def run(parts: pd.DataFrame) -> pd.DataFrame:
        lengths = np.array([len(x) // 8 for x in parts["part"]])
        h = np.frombuffer(b"".join(parts["part"]), np.int64)
        _, at, counts = np.unique(h, return_inverse=True, return_counts=True)
        times, owner = counts[at], np.repeat(np.arange(len(lengths)), lengths)
        alone = np.bincount(owner, weights=times == 1, minlength=len(lengths))
        order = np.lexsort((h, times, owner))
        ends = lengths.cumsum()
        kept = np.minimum(lengths, parts["n"].to_numpy() * (100 - percent) // 100 + 1)
        rare = [order[end - n : end - n + k] for end, n, k in zip(ends, lengths, kept, strict=True)]
        return pd.DataFrame(
            {
                "id": parts["id"],
                "text": parts["text"],
                "n": parts["n"],
                "alone": alone.astype(np.int64),
                "times": [times[x] for x in rare],
                "shingle": [h[x] for x in rare],
            }
        )

    return run


def shingle_counts(sets: DataFrame, total: int, percent: int) -> DataFrame:
    """id, text, n, alone, rare of every different set: its size, how many of its shingles are in no
    other one of ``sets``, and as many of its rarest ones, with their times, as may come before the
    first that it shares with a linked set. Hash ranges of about ``SLICE`` shingles are counted in a
    task each."""
    slices = max(1, -(-total // SLICE))
    columns = "id long, text long, n long, alone long, times array<long>, shingle array<long>"
    rare = F.array_sort(F.flatten(F.collect_list(F.arrays_zip("times", "shingle"))))
    most = F.floor(F.col("n") * (100 - percent) / 100).cast("int") + 1
    return (
        sets.dropDuplicates(["id", "set"])
        .select("id", F.xxhash64("set").alias("text"), "set")
        .mapInArrow(_dealt(slices), "slice long, id long, text long, n long, part binary")
        .groupBy("slice")
        .applyInPandas(_counted(percent), columns)
        .groupBy("id", "text", "n")
        .agg(F.sum("alone").alias("alone"), rare.alias("rare"))
        .withColumn("rare", F.slice("rare", F.lit(1), most))
    )


def alone_counts(counted: DataFrame) -> DataFrame:
    """id, alone: how many shingles of a document no other one has."""
    # No bound for a document whose rows have different texts.
    alone = F.when(F.count(F.lit(1)) == 1, F.max("alone")).otherwise(0)
    return counted.groupBy("id").agg(alone.alias("alone"))


def _large(shared: DataFrame) -> DataFrame:
    """The members of buckets that ``candidates`` has not compared in full."""
    return shared.where(F.col("members") > CENTERS + 1)


def _now(rows: DataFrame, found: DataFrame) -> DataFrame:
    """``rows`` with the component of each id."""
    return rows.join(found.withColumnRenamed("node", "id"), "id", "left").withColumn(
        "component", F.coalesce("component", "id")
    )


def open_members(shared: DataFrame, found: DataFrame) -> DataFrame:
    """The members of buckets that hold several components, with their components."""
    members = _now(shared, found)
    several = (
        members.groupBy("key")
        .agg(F.min("component").alias("x"), F.max("component").alias("y"))
        .where("x < y")
        .select("key")
    )
    return members.join(several, "key", "left_semi").select(
        "key", "band", "id", "n", "place", "members", "component"
    )


def _common_allows(percent: int, c: Column) -> Column:
    common = F.least(F.col("n") - F.col("alone"), c["n"] - c["alone"])
    return 100 * common >= percent * (F.col("n") + c["n"] - common)


def nearest_across(members: DataFrame, percent: int) -> DataFrame:
    """As ``candidates``, but with the members that have the smallest share alone, as far as the
    common shingles allow a link."""
    return _met(members, F.col("alone") / F.col("n"), lambda c: _common_allows(percent, c))


def all_across(rare: DataFrame, percent: int) -> DataFrame:
    """All pairs of different components that have one of their ``rare`` shingles (id, component, n,
    place, shingle; rarest first) in common, with enough shingles from there on for a link.

    The smaller set of a linked pair has a common one among its first (100 - p) / (100 + p) n + 1, the
    larger one among its first (100 - p) / 100 n + 1."""
    a = rare.where(F.col("place") * (100 + percent) <= F.col("n") * (100 - percent)).alias("a")
    b = rare.alias("b")
    apart = F.col("a.component") != F.col("b.component")
    larger = F.struct("a.n", "a.id") < F.struct("b.n", "b.id")
    rest = F.least(F.col("a.n") - F.col("a.place"), F.col("b.n") - F.col("b.place"))
    enough = (100 + percent) * rest >= percent * (F.col("a.n") + F.col("b.n"))
    return _ordered_pairs(a.join(b, (F.col("a.shingle") == F.col("b.shingle")) & apart & larger & enough))


def _agreeing(pairs: DataFrame, heads: DataFrame, percent: int) -> DataFrame:
    both = _with_both(pairs, heads, "signature")
    return both.mapInArrow(_agree(percent), "u long, v long").distinct()


def _confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    return _with_both(pairs, sets, "set").mapInArrow(_linked(percent), "u long, v long").distinct()


def _joined(found: DataFrame, links: DataFrame) -> DataFrame:
    """The components after more links: those of the stars found so far and the new links."""
    if links.isEmpty():
        return found
    stars = found.select(F.col("node").alias("u"), F.col("component").alias("v"))
    return components(stars.union(links))


def cluster(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """doc_id, n_shingles, component_id, kept of every document; links have ``percent`` or more of
    their shingles in common."""
    rows = stage(sketch(docs), "sketches")
    named = rows.where("doc_id is not null and n_shingles > 0")
    classes = stage(named.groupBy("print").agg(F.min("doc_id").alias("id")), "classes")
    heads = stage(
        named.join(classes, "print")
        .where("doc_id = id")
        .dropDuplicates(["print"])
        .select("id", F.col("n_shingles").alias("n"), "signature"),
        "heads",
    )
    shared = stage(buckets(heads, percent), "buckets")
    # Written, so that its size is known when the texts are joined with it.
    wanted = stage(shared.select("id").distinct(), "wanted")
    sets = stage(_full_sets(docs, wanted), "sets")
    # A document whose rows have different texts is in several classes.
    several = (
        named.groupBy("doc_id").agg(F.min("print").alias("x"), F.max("print").alias("y")).where("x < y")
    )
    same = (
        named.join(several, "doc_id", "left_semi")
        .join(classes, "print")
        .select(F.col("doc_id").alias("u"), F.col("id").alias("v"))
    )
    first = stage(_agreeing(first_candidates(shared, percent), heads, percent), "pairs")
    found = components(stage(_confirmed(first, sets, percent).union(same), "links"))
    left = stage(open_members(shared, found), "open_buckets")
    more = candidates(left, percent).join(first, ["u", "v"], "left_anti")
    more = stage(_agreeing(more, heads, percent), "pairs")
    found = _joined(found, stage(_confirmed(more, sets, percent), "links"))
    left = stage(open_members(_large(shared), found), "open_buckets")
    ids = left.select("id", "n").distinct()
    total = ids.agg(F.sum("n")).first()[0]
    if total:
        these = sets.join(ids.select("id").distinct(), "id", "left_semi")
        counted = stage(shingle_counts(these, total, percent), "shingle_counts")
        members = _now(left.drop("component").join(alone_counts(counted), "id"), found)
        done = first.union(more)
        open_ = nearest_across(members, percent).join(done, ["u", "v"], "left_anti")
        found = _joined(found, stage(_confirmed(open_, sets, percent), "links"))
        rare = counted.select("id", "n", F.posexplode("rare").alias("place", "r")).select("id", "n", "place", "r.*")
        rare = stage(_now(rare.where("times > 1"), found), "rare")
        open_ = all_across(rare, percent).join(done, ["u", "v"], "left_anti")
        found = _joined(found, stage(_confirmed(open_, sets, percent), "links"))
    component = F.when(
        F.col("n_shingles") > 0, F.coalesce("component", "id", "doc_id")
    ).otherwise(F.col("doc_id"))
    return (
        rows.select("doc_id", "n_shingles", "print")
        .join(classes, "print", "left")
        .join(found.withColumnRenamed("node", "id"), "id", "left")
        .select("doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull(), component).alias("component_id"))
        .withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))
    )


def keep_one(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """One row of each component, in full: the least by doc_id, then by the digests of its text and
    of its values. Rows that share a doc_id are compared by their texts like any others; rows without
    doc_id all stay. Without rows the result is empty."""
    names = docs.columns
    row = free_name(names, "_row")
    rows = stage(docs.withColumn(row, F.monotonically_increasing_id()), "rows")
    named = rows.where("doc_id is not null")
    linked = cluster(named.select(F.col(row).alias("doc_id"), "text"), percent).select(
        F.col("doc_id").alias("row"), "component_id"
    )
    order = F.struct(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.sha2(F.col("text").cast("binary"), 256).alias("digest"),
        F.xxhash64(*names).alias("values"),
        F.col(row).alias("row"),
    )
    first = (
        named.select(F.col(row).alias("row"), order.alias("order"))
        .join(linked, "row")
        .groupBy("component_id")
        .agg(F.min("order").alias("first"))
        .select(F.col("first.row").alias(row))
    )
    # Written, so that its size is known when the texts are joined with it.
    kept = named.join(stage(first, "first"), row, "left_semi")
    return kept.select(*names).unionByName(rows.where("doc_id is null").select(*names))
