"""Mixing sources to target weights by entropy balancing.

Each source has a target of words. Among all document rates between 0 and ``CEILING`` that meet the
targets, the ones closest to rate 1 in (bounded) relative entropy have odds rate / (CEILING - rate)
that are an exponential tilt of the document's size, with one coefficient per source. The
coefficients solve a convex dual; Newton steps, kept inside a bracket, run as Spark jobs over the
counts by source and size, which are all the dual depends on. The rates are then rounded to copies
per (source, size) so that errors cancel along the sizes, and within such a cell the documents with
the smallest hashes of doc_id and text get the odd copies.

Null and empty texts have size 0 and rate 1, or ``CEILING`` where their source is cut at its size; a
text counts as its number of words however long it is. Null sources form one source, the last.
Repeated rows, and rows without doc_id, count one by one: among equal ones the first by row number
get the odd copies, so that the copies of a cell are exact. Other columns, whatever their names, pass
through ``apply_copies``; without rows there are none in the result. Sums are decimals, so reruns
agree.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chargeweave.llm.words import free_name, source_key, whole_text, word_count
from chargeweave.session import stage

WEIGHTS = (5, 2, 1)
SHARE = 1.5
CEILING = 2
TOLERANCE = 1e-9
MAX_STEPS = 80
REPAIRS = 4

_EXACT = "decimal(38,12)"


def targets(cells: DataFrame, weights: Sequence[float] = WEIGHTS, share: float = SHARE) -> DataFrame:
    """Per source: size and target. ``cells`` has key, source, size, n.

    Targets are weights times one level, cut at CEILING times the size: sources are taken in order of
    the level at which they are cut, until the level that the rest would share is below it.
    """
    sizes = cells.groupBy("key").agg(
        F.first("source").alias("source"),
        F.sum(F.col("size") * F.col("n")).alias("source_size"),
        F.sum("n").alias("docs"),
    )
    order = Window.orderBy(F.col("source").asc_nulls_last())
    everything = Window.partitionBy()
    w = F.array(*(F.lit(float(x)) for x in weights))
    ranked = sizes.withColumn(
        "weight", F.get(w, (F.row_number().over(order) - 1) % len(weights))
    ).withColumn("cap", F.lit(float(CEILING)) * F.col("source_size"))
    before = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last())
    before = before.rowsBetween(Window.unboundedPreceding, -1)
    total = share * F.sum("source_size").over(everything)
    level = (total - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / (
        F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0.0))
    )
    cut = ranked.withColumn("level", level).withColumn(
        "free", F.col("cap") > F.col("weight") * F.col("level")
    )
    common = F.min(F.when(F.col("free"), F.struct(F.col("cap") / F.col("weight"), "level"))).over(
        everything
    )["level"]
    return cut.withColumn("common", common).select(
        "key",
        "source",
        "source_size",
        "docs",
        F.when(F.col("free"), F.col("weight") * F.col("common")).otherwise(F.col("cap")).alias("target"),
    )


def _rate(tilt: Column, size: Column) -> Column:
    return CEILING / (1 + F.exp(-tilt * size))


def solve(cells: DataFrame, aims: DataFrame) -> DataFrame:
    """``aims`` with the tilt per source: Newton on the dual, one job over ``cells`` per step."""
    unit = F.greatest(F.col("source_size") / F.col("docs"), F.lit(1.0))
    state = stage(
        aims.withColumns(
            {
                "unit": unit,
                "full": F.col("target") >= CEILING * F.col("source_size"),
                "tilt": F.lit(0.0),
                "lo": F.lit(None).cast("double"),
                "hi": F.lit(None).cast("double"),
            }
        ),
        "tilts",
    )
    names = state.columns
    for _ in range(MAX_STEPS):
        x = F.col("size") / F.col("unit")
        rate = _rate(F.col("tilt"), x)
        sums = (
            cells.select("key", "size", "n")
            .join(state.where("not full").select("key", "unit", "tilt"), "key")
            .groupBy("key")
            .agg(
                F.sum((F.col("n") * x * rate).cast(_EXACT)).cast("double").alias("reached"),
                F.sum((F.col("n") * x * x * rate * (1 - rate / CEILING)).cast(_EXACT))
                .cast("double")
                .alias("slope"),
            )
        )
        gap = F.col("reached") - F.col("target") / F.col("unit")
        done = F.abs(F.col("gap")) <= TOLERANCE * F.col("target") / F.col("unit")
        lo = F.when(F.col("gap") < 0, F.col("tilt")).otherwise(F.col("lo"))
        hi = F.when(F.col("gap") > 0, F.col("tilt")).otherwise(F.col("hi"))
        newton = F.when(F.col("slope") > 0, F.col("tilt") - F.col("gap") / F.col("slope"))
        inside = (newton > F.coalesce("lo", F.lit(-1e300))) & (newton < F.coalesce("hi", F.lit(1e300)))
        halved = F.coalesce(
            (F.col("lo") + F.col("hi")) / 2, 2 * F.col("lo") + 1, 2 * F.col("hi") - 1
        )
        far = F.abs(newton) > 4 * F.abs(F.col("tilt")) + 4
        state = stage(
            state.join(sums, "key", "left")
            .withColumn("gap", F.coalesce(gap, F.lit(0.0)))
            .withColumn("done", done)
            .withColumns({"lo": lo, "hi": hi})
            .withColumn(
                "tilt",
                F.when(F.col("done"), F.col("tilt"))
                .when(inside & ~far, newton)
                .otherwise(F.coalesce(halved, F.col("tilt"))),
            )
            .select(*names, "done"),
            "tilts",
        )
        if state.where("not done").isEmpty():
            break
    return state.drop("lo", "hi", "done")


def _repair(cells: DataFrame, tilts: DataFrame) -> DataFrame:
    """One copy more or less in one cell per source, where that brings its words nearer."""
    missing = (
        cells.groupBy("key")
        .agg(F.sum(F.col("copies") * F.col("size")).alias("taken"))
        .join(tilts.select("key", "target"), "key")
        .select("key", (F.col("target") - F.col("taken")).alias("missing"))
    )
    joined = cells.join(missing, "key")
    room = F.when(F.col("missing") > 0, F.col("copies") < CEILING * F.col("n")).otherwise(
        F.col("copies") > 0
    )
    distance = F.abs(F.col("size") - F.abs(F.col("missing")))
    best = (
        joined.where(room & (distance < F.abs(F.col("missing"))))
        .groupBy("key")
        .agg(
            F.min(F.struct(distance.alias("d"), "size")).alias("best"),
            F.first(F.signum("missing").cast("long")).alias("step"),
        )
        .select("key", F.col("best.size").alias("size"), "step")
    )
    return cells.join(best, ["key", "size"], "left").select(
        "key", "size", "n", (F.col("copies") + F.coalesce("step", F.lit(0))).alias("copies")
    )


def copies_by_cell(cells: DataFrame, tilts: DataFrame) -> DataFrame:
    """key, size, n, copies: whole copies, between 0 and CEILING for each document of a cell."""
    rate = F.when(F.col("full"), F.lit(float(CEILING))).otherwise(
        _rate(F.col("tilt"), F.col("size") / F.col("unit"))
    )
    along = Window.partitionBy("key").orderBy(F.desc("size"))
    upto = F.floor(F.sum("expected").over(along) + 0.5)
    rounded = (
        cells.join(tilts.select("key", "unit", "full", "tilt"), "key")
        .withColumn("expected", F.col("n") * rate)
        .withColumn("upto", upto)
        .withColumn("copies", F.col("upto") - F.lag("upto", 1, 0).over(along))
        .select("key", "size", "n", "copies")
    )
    cells = stage(rounded, "copies")
    for _ in range(REPAIRS):
        cells = stage(_repair(cells, tilts), "copies")
    return cells


def _odd_copies(sized: DataFrame, cells: DataFrame) -> DataFrame:
    """key, size, plan: copies for each document, one more for the first ones by hash and then row
    number, up to ``last_h`` and ``last_row``.

    The wanted rank is found through counts per 1/4096 of the hash range, per hash inside the one
    range that holds it, then per writing task and row among the rows of one hash: a cell or a group
    of equal rows with a large part of all rows is no single task.
    """
    plan = cells.select(
        "key",
        "size",
        F.floor(F.col("copies") / F.col("n")).cast("int").alias("each"),
        (F.col("copies") % F.col("n")).alias("odd"),
    )
    rows = sized.select(
        "key", "size", F.shiftright("h", 52).alias("bucket"), "h", F.shiftright("row", 33).alias("task"), "row"
    )
    at = ["key", "size"]
    left = plan.where("odd > 0").drop("each")
    for part in ("bucket", "h", "task", "row"):
        along = Window.partitionBy(*at).orderBy(part)
        left = stage(
            rows.join(left, at)
            .groupBy(*at, part)
            .agg(F.count(F.lit(1)).alias("c"), F.first("odd").alias("odd"))
            .withColumn("upto", F.sum("c").over(along))
            .where("upto >= odd and upto - c < odd")
            .select(*at, part, (F.col("odd") - F.col("upto") + F.col("c")).alias("odd")),
            "ranks",
        )
        at.append(part)
    last = left.select("key", "size", F.col("h").alias("last_h"), F.col("row").alias("last_row"))
    return plan.join(last, ["key", "size"], "left").select(
        "key", "size", F.struct("each", "last_h", "last_row").alias("plan")
    )


def _sized(docs: DataFrame, text: str, source: str) -> dict[str, Column]:
    return {
        "key": source_key(F.col(source)),
        "size": word_count(whole_text(text)),
        "h": F.xxhash64(F.col("doc_id"), F.col(text)),
        "row": F.monotonically_increasing_id(),
    }


def plan_copies(sized: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The sources (size, target, tilt), and the copies per source and size, of the written table
    ``sized`` (source, key, size, h, row)."""
    cells = stage(
        sized.groupBy("key", "size").agg(F.first("source").alias("source"), F.count(F.lit(1)).alias("n")),
        "cells",
    )
    tilts = solve(cells, targets(cells))
    return tilts, stage(_odd_copies(sized, copies_by_cell(cells, tilts)), "odd_copies")


def _copies(plan: str, h: str, row: str) -> Column:
    """Copies of a row under the plan of its cell, a struct."""
    p = F.col(plan)
    first = (F.col(h) < p["last_h"]) | ((F.col(h) == p["last_h"]) & (F.col(row) <= p["last_row"]))
    return p["each"] + F.coalesce(first.cast("int"), F.lit(0))


def mix(docs: DataFrame, text: str = "text", source: str = "source") -> DataFrame:
    """doc_id, size, source_size, target, copies and taken words of every document."""
    made = _sized(docs, text, source)
    sized = docs.select("doc_id", F.col(source).alias("source"), *(c.alias(k) for k, c in made.items()))
    sized = stage(sized, "sized")
    tilts, cells = plan_copies(sized)
    return (
        sized.join(cells, ["key", "size"])
        .join(tilts.select("key", "source_size", "target"), "key")
        .withColumn("copies", _copies("plan", "h", "row"))
        .select("doc_id", "size", "source_size", "target", "copies", (F.col("copies") * F.col("size")).alias("taken"))
    )


def apply_copies(docs: DataFrame, text: str = "text", source: str = "source") -> DataFrame:
    """The rows of ``docs``, each as often as the mix takes it; they are written once with their size
    and number."""
    names = docs.columns
    own = {c: free_name(names, f"_mix_{c}") for c in ("key", "size", "h", "row")}
    rows = stage(docs.select("*", *(c.alias(own[k]) for k, c in _sized(docs, text, source).items())), "rows")
    _, cells = plan_copies(rows.select(F.col(source).alias("source"), *(F.col(v).alias(k) for k, v in own.items())))
    times = free_name(names, "_mix_copies")
    cells = cells.select(F.col("key").alias(own["key"]), F.col("size").alias(own["size"]), F.col("plan").alias(times))
    return (
        rows.join(cells, [own["key"], own["size"]])
        .withColumn(times, _copies(times, own["h"], own["row"]))
        .where(F.col(times) > 0)
        .withColumn(times, F.explode(F.sequence(F.lit(1), F.col(times))))
        .select(*names)
    )
