"""Benchmark passages in documents, found by winnowed fingerprints.

Words are compared after A-Z is lowered. An item's windows are its runs of ``WINDOW`` words; an item
with fewer words, but not none, is one shorter window. For windows of ``span`` words every run of
``gram`` words is hashed and the least hash of ``span - gram + 1`` neighbouring grams is kept, in
items and documents alike, so that each shared window holds a shared fingerprint. Fingerprints are
joined by hash and each hit is extended to the windows around it, which are compared word by word.

Before the join a document's fingerprints are tested against a bit table of the items'
fingerprints. Its size is fixed (``BITS``, 32 KB), so it travels with every row; it is half full at
180,000 different fingerprints (some 600,000 words of items). Above that it lets more through to
the join and nothing else changes; a larger table can be asked for.

Null and empty texts have no words and no hits. Rows of ``docs`` are answered one by one, whatever
their ids; rows with one text share the work. Items with one ``item_id`` are one item, those without
id one item named ''. Without items nothing is hit; without documents the result is empty. A very
long text is one row from scan to fingerprints; its hits are rows of their own. Other columns are
ignored.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chargeweave.llm.words import let, whole_text
from chargeweave.session import stage

WINDOW = 10
BITS = 1 << 18
BREAKS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"

_HIT = "array<struct<span:int,hash:bigint,first:int,near:array<string>>>"


def words(text: Column) -> Column:
    lowered = F.translate(text, string.ascii_uppercase, string.ascii_lowercase)
    return F.array_remove(F.split(lowered, BREAKS, -1), "")


def gram_size(span: int) -> int:
    return (span + 1) // 2


def _grams(w: Column, span: int) -> Column:
    """Hash of every run of ``gram_size(span)`` words."""
    gram = gram_size(span)

    def hashed(v: Column) -> Column:
        return F.transform(
            F.sequence(F.lit(0), F.size(v) - gram),
            lambda i: F.xxhash64(F.lit(span), *(F.get(v, i + k) for k in range(gram))),
        )

    return let(F.transform(w, lambda x: F.xxhash64(x)), hashed)


def _minima(hashes: Column, span: int) -> Column:
    """The distinct least hashes of ``span - gram + 1`` neighbouring grams."""
    width = span - gram_size(span) + 1
    near = F.transform(
        F.sequence(F.lit(0), F.size(hashes) - width),
        lambda i: F.least(*(F.get(hashes, i + k) for k in range(width))) if width > 1 else F.get(hashes, i),
    )
    return F.array_distinct(near)


def winnow(w: Column, span: int) -> Column:
    """Fingerprints of the words ``w``: every window of ``span`` words holds at least one.

    Fewer words than ``span`` have none (null).
    """
    return F.when(F.size(w) >= span, _minima(_grams(w, span), span))


def windows(w: Column, span: int | Column) -> Column:
    """The texts of all runs of ``span`` words."""
    return F.transform(
        F.sequence(F.lit(1), F.size(w) - span + 1),
        lambda i: F.array_join(F.slice(w, i, span if isinstance(span, Column) else F.lit(span)), " "),
    )


class Items:
    """What is looked for: staged fingerprints, windows and which items hold them.

    Windows that lie in the same set of items share a class, so that a passage of many items is
    not multiplied by them. A set is told by its size and two sums of hashes of its members.
    """

    def __init__(self, items: DataFrame, bits: int = BITS):
        self.bits = bits
        split = items.select(
            F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item"),
            words(whole_text()).alias("w"),
        ).where("size(w) > 0")
        sized = stage(split.select("item", "w", F.least(F.size("w"), F.lit(WINDOW)).alias("span")), "items")
        #: Lengths of windows, 1 to WINDOW.
        self.spans = sorted(r["span"] for r in sized.select("span").distinct().collect())
        prints = sized.select(F.lit(0).alias("span"), F.lit(0).cast("long").alias("hash")).limit(0)
        for span in self.spans:
            of = sized.where(F.col("span") == span)
            found = of.select("span", F.explode(winnow(F.col("w"), span)).alias("hash"))
            prints = prints.union(found)
        self.prints = stage(prints.distinct(), "prints")
        held = stage(
            sized.select("item", "span", F.explode(windows(F.col("w"), F.col("span"))).alias("window")).distinct(),
            "held",
        )
        classes = held.groupBy("span", "window").agg(
            F.sha2(
                F.concat_ws(
                    ":",
                    F.count(F.lit(1)),
                    F.sum(F.xxhash64("item").cast("decimal(20,0)")),
                    F.sum(F.xxhash64("item", F.lit(1)).cast("decimal(20,0)")),
                ),
                256,
            ).alias("held_by")
        )
        self.windows = stage(classes, "windows")
        shown = self.windows.groupBy("held_by").agg(
            F.min_by(F.struct("span", "window"), F.struct("span", "window")).alias("one")
        )
        self.members = stage(
            shown.select("held_by", "one.*").join(held, ["span", "window"]).select("held_by", "item"),
            "members",
        )

    def bit_table(self) -> Column:
        """The bits as an array of long values, as a scalar."""
        spark = self.prints.sparkSession
        at = F.pmod(F.col("hash"), F.lit(self.bits))
        cells = self.prints.select(
            F.floor(at / 64).cast("long").alias("cell"), F.expr("1L << cast(hash & 63 AS int)").alias("bit")
        )
        filled = cells.groupBy("cell").agg(F.bit_or("bit").alias("bits"))
        every = spark.range(self.bits // 64).withColumnRenamed("id", "cell").join(filled, "cell", "left")
        packed = F.sort_array(F.collect_list(F.struct("cell", F.coalesce("bits", F.lit(0)).alias("bits"))))
        one = stage(every.agg(packed["bits"].alias("bits")), "bit_table")
        return one.scalar()


def _hits(w: Column, spans: list[int], bits: Column) -> Column:
    """Fingerprints the bit table lets through, with the words that windows around them cover."""

    def of(span: int) -> Column:
        reach = span - gram_size(span)

        def passing(table: Column, prints: Column) -> Column:
            def known(h: Column) -> Column:
                cell = (F.pmod(h, 64 * F.size(table)) / 64).cast("int")
                return F.getbit(F.get(table, cell), h.bitwiseAND(F.lit(63)).cast("int")) == 1

            return F.filter(prints, known)

        def opened(g: Column) -> Column:
            first = F.greatest(g["at"] - reach, F.lit(0))
            return F.struct(
                F.lit(span).alias("span"),
                g["hash"].alias("hash"),
                first.alias("first"),
                F.slice(w, first + 1, g["at"] + span - first).alias("near"),
            )

        def places(hashes: Column, known: Column) -> Column:
            grams = F.transform(hashes, lambda h, i: F.struct(i.alias("at"), h.alias("hash")))
            met = F.filter(grams, lambda g: F.array_contains(known, g["hash"]))
            return F.when(F.size(known) > 0, F.transform(met, opened))

        def found(hashes: Column) -> Column:
            known = let(bits, lambda table: passing(table, _minima(hashes, span)))
            return let(known, lambda k: places(hashes, k))

        hits = F.when(F.size(w) >= span, let(_grams(w, span), found))
        return F.coalesce(hits, F.array().cast(_HIT))

    return F.concat(*(of(span) for span in spans)) if spans else F.array().cast(_HIT)


def find(docs: DataFrame, items: DataFrame, bits: int = BITS) -> DataFrame:
    """doc_id, n_words, spans (maximal runs of hit words: start, end exclusive), items (sorted ids)."""
    sought = Items(items, bits)
    text = whole_text()

    def measured(x: Column) -> Column:
        hits = _hits(x["words"], sought.spans, x["bits"])
        return F.struct(F.size(x["words"]).cast("long").alias("n_words"), hits.alias("hits"))

    read = docs.select("doc_id", text.alias("text"), sought.bit_table().alias("bits"))
    split = F.struct(words(F.col("text")).alias("words"), F.col("bits"))
    read = read.withColumn("of", let(split, measured))
    scanned = stage(
        read.select(
            "doc_id",
            "of.n_words",
            F.when(F.size("of.hits") > 0, F.sha2("text", 256)).alias("key"),
            "of.hits",
        ),
        "scanned",
    )

    texts = scanned.where("key IS NOT NULL").select("key", "hits").dropDuplicates(["key"])
    hits = texts.select("key", F.inline("hits")).join(sought.prints, ["span", "hash"], "left_semi")
    around = hits.select(
        "key", "span", "first", F.posexplode(windows(F.col("near"), F.col("span"))).alias("i", "window")
    )
    starts = around.select("key", "span", "window", (F.col("first") + F.col("i")).alias("start"))
    found = stage(starts.distinct().join(sought.windows, ["span", "window"]), "found")

    runs = found.select("key", "start", (F.col("start") + F.col("span")).alias("end"))
    before = "max(end) OVER (PARTITION BY key ORDER BY start, end ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"
    islands = runs.withColumn("new", F.expr(f"int(start > coalesce({before}, -1))")).withColumn(
        "island", F.expr("sum(new) OVER (PARTITION BY key ORDER BY start, end ROWS UNBOUNDED PRECEDING)")
    )
    spans = (
        islands.groupBy("key", "island")
        .agg(F.min("start").alias("start"), F.max("end").alias("end"))
        .groupBy("key")
        .agg(F.sort_array(F.collect_list(F.struct("start", "end"))).alias("spans"))
    )
    named = found.select("key", "held_by").distinct().join(sought.members, "held_by")
    of_text = named.groupBy("key").agg(F.sort_array(F.collect_set("item")).alias("items"))
    results = stage(spans.join(of_text, "key"), "results")

    hit = scanned.where("key IS NOT NULL").select("doc_id", "n_words", "key").join(results, "key", "left")
    rest = scanned.where("key IS NULL").select(
        "doc_id", "n_words", F.lit(None).cast(results.schema["spans"].dataType).alias("spans"),
        F.lit(None).cast("array<string>").alias("items"),
    )
    every = hit.select(rest.columns).unionAll(rest)
    return every.withColumns(
        {c: F.coalesce(c, F.array().cast(results.schema[c].dataType)) for c in ("spans", "items")}
    )


def report(docs: DataFrame, items: DataFrame) -> DataFrame:
    """Per document the counts and the digest of its items."""
    n_hit = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"])
    return find(docs, items).select(
        "doc_id",
        "n_words",
        n_hit.alias("n_hit"),
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        (n_hit > 0).alias("contaminated"),
    )
