"""Exact order statistics without sorting the table in one task.

``rows_at_ranks`` finds the rows that stand at given global ranks. It narrows level by level: count
rows per value of a coarse key, keep the value that holds the rank, count the next finer key inside
it, and so on. Each count is a partially aggregated ``groupBy``; the running sum that follows sees
one row per distinct key value, never one per input row. So neither a hot key nor a hot timestamp
ends up in one task, and the driver only receives the rows it asked for. ``order_statistics`` does the
same for values of several columns at once.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from datetime import date, datetime
from functools import reduce
from math import isfinite
from typing import Any

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chargeweave.session import stage

Level = tuple[str, Column]

LOG_STEPS = (64, 2**20)
_MAX_EXPONENT = 1100


def literal(value: Any) -> Column:
    """Literal that keeps zone-free timestamps zone-free, so comparisons can be pushed down."""
    if isinstance(value, datetime):
        return F.expr(f"TIMESTAMP_NTZ '{value.isoformat(sep=' ')}'")
    if isinstance(value, date):
        return F.expr(f"DATE '{value.isoformat()}'")
    return F.lit(value)


def _matches(levels: list[Level], values: dict[str, Any]) -> Column:
    tests = [expr.eqNullSafe(literal(values[name])) for name, expr in levels if name in values]
    return reduce(lambda a, b: a & b, tests)


def _inside(
    df: DataFrame, outer: list[Level], found: list[dict[str, Any]], inner: Column, ends: list[tuple[Any, Any]]
) -> DataFrame:
    """Rows under the found prefixes of keys. The ends of the next key's values under each prefix are tested
    first: unlike a test of a coarse expression, a range of a column reaches the files."""
    within = [
        (inner >= literal(low)) & (inner <= literal(high)) if low is not None else F.lit(True)
        for low, high in ends
    ]
    exact = [_matches(outer, values) for values in found]
    return df.where(reduce(lambda a, b: a | b, within)).where(reduce(lambda a, b: a | b, exact))


def rows_at_ranks(
    df: DataFrame, levels: list[Level], ranks: Callable[[Column], list[Column]]
) -> list[dict[str, Any] | None]:
    """Key values at 0-based global ranks of ``df`` ordered by ``levels``.

    ``levels`` run from coarse to fine and every level must be non-decreasing in the order wanted.
    ``ranks`` gets the row count as a column and returns the rank columns; a rank outside the table
    gives None. The row count is returned as ``_n``.
    """
    name, expr = levels[0]
    inner = levels[1][1] if len(levels) > 1 else F.lit(None)
    counts = df.groupBy(expr.alias(name)).agg(
        F.count(F.lit(1)).alias("_rows"), F.min(inner).alias("_low"), F.max(inner).alias("_high")
    )
    running = F.sum("_rows").over(Window.orderBy(name))
    placed = counts.select(
        name,
        "_rows",
        "_low",
        "_high",
        (running - F.col("_rows")).alias("_before"),
        F.sum("_rows").over(Window.partitionBy()).alias("_n"),
    )
    wanted = F.posexplode(F.array(*[r.cast("bigint") for r in ranks(F.col("_n"))]))
    hits = (
        placed.select("*", wanted.alias("_slot", "_rank"))
        .where("_before <= _rank AND _rank < _before + _rows")
        .select("_slot", name, "_n", "_low", "_high", (F.col("_rank") - F.col("_before")).alias("_rest"))
        .collect()
    )
    found: dict[int, tuple[dict[str, Any], int]] = {
        h["_slot"]: ({name: h[name], "_n": h["_n"]}, h["_rest"]) for h in hits
    }
    ends = {h[name]: (h["_low"], h["_high"]) for h in hits}
    coarse = name
    slots = len(ranks(F.lit(0)))

    for depth in range(1, len(levels)):
        if not found:
            break
        name, expr = levels[depth]
        outer = levels[:depth]
        prefixes = list({tuple(v.items()): v for v, _ in found.values()}.values())
        inside = _inside(df, outer, prefixes, inner, [ends[p[coarse]] for p in prefixes])
        keys = [e.alias(n) for n, e in outer]
        counts = inside.groupBy(*keys, expr.alias(name)).agg(F.count(F.lit(1)).alias("_rows"))
        outer_names = [n for n, _ in outer]
        running = F.sum("_rows").over(Window.partitionBy(*outer_names).orderBy(name))
        placed = counts.withColumn("_before", running - F.col("_rows"))
        named = [(n, F.col(n)) for n in outer_names]
        in_slot = [
            _matches(named, values)
            & (F.col("_before") <= rest)
            & (F.lit(rest) < F.col("_before") + F.col("_rows"))
            for values, rest in found.values()
        ]
        rows = placed.where(reduce(lambda a, b: a | b, in_slot)).collect()
        narrowed = {}
        for slot, (values, rest) in found.items():
            for row in rows:
                same = all(row[n] == values[n] for n in outer_names)
                if same and row["_before"] <= rest < row["_before"] + row["_rows"]:
                    narrowed[slot] = ({**values, name: row[name]}, rest - row["_before"])
        found = narrowed
    return [found[s][0] if s in found else None for s in range(slots)]


def log_bucket(value: Column, steps: int) -> Column:
    """Integer that never decreases as ``value`` grows: sign and ``steps`` buckets per octave."""
    offset = _MAX_EXPONENT * steps
    octave = F.least(F.log2(F.abs(value)), F.lit(float(_MAX_EXPONENT - 1)))  # infinities come last
    size = F.floor(octave * steps) + F.lit(offset)
    return F.when(value == 0, F.lit(0)).when(value > 0, size).otherwise(-size).cast("bigint")


#: Equal cells a range is cut into at each further narrowing.
CELLS = 1 << 16


@dataclass(frozen=True)
class _Range:
    """Values of a column between two of them, both included; None for all."""

    column: str
    low: float | None = None
    high: float | None = None

    def holds(self, value: Column) -> Column:
        if self.low is None:
            return value.isNotNull()
        return (value >= F.lit(self.low)) & (value <= F.lit(self.high))

    def cell(self, value: Column) -> Column:
        if self.low is None:
            return log_bucket(value, LOG_STEPS[0])
        return F.floor((value - F.lit(self.low)) / F.lit(self.high - self.low) * CELLS)


def _narrow(
    df: DataFrame, ranges: list[_Range], slots: list[tuple[int, Callable[[Column], Column]]]
) -> dict[int, dict[str, Any]]:
    """One scan: the cell that holds each slot's rank within its range.

    All columns and ranges go through one aggregation, which sends at most one row per range and cell
    to the shuffle. A slot is the number of its range and its rank, given the range's count.
    """
    values = [F.col(r.column).cast("double") for r in ranges]
    inside = df.where(reduce(lambda a, b: a | b, [r.holds(v) for r, v in zip(ranges, values)]))
    each = [
        F.when(r.holds(v), F.struct(F.lit(t).alias("t"), r.cell(v).alias("cell"), v.alias("v")))
        for t, (r, v) in enumerate(zip(ranges, values))
    ]
    cells = (
        inside.select(F.explode(F.array_compact(F.array(*each))).alias("x"))
        .groupBy("x.t", "x.cell")
        .agg(F.count(F.lit(1)).alias("rows"), F.min("x.v").alias("low"), F.max("x.v").alias("high"))
    )
    in_range = Window.partitionBy("t")
    placed = cells.withColumns(
        {
            "before": F.sum("rows").over(in_range.orderBy("cell")) - F.col("rows"),
            "n": F.sum("rows").over(in_range),
        }
    )
    asked = [
        F.when(F.col("t") == t, F.struct(F.lit(i).alias("slot"), rank(F.col("n")).cast("bigint").alias("rank")))
        for i, (t, rank) in enumerate(slots)
    ]
    hits = placed.select("*", F.explode(F.array_compact(F.array(*asked))).alias("ask"))
    found = hits.where("before <= ask.rank AND ask.rank < before + rows").select(
        "ask.slot", "low", "high", "n", (F.col("ask.rank") - F.col("before")).alias("rest")
    )
    return {r["slot"]: r.asDict() for r in found.collect()}


def order_statistics(
    df: DataFrame, wanted: dict[str, list[float]]
) -> dict[tuple[str, float], float | None]:
    """Exact linearly interpolated quantiles of several columns, all of them in the same scans.

    The first scan counts every column's values per logarithmic bucket and keeps each bucket's least and
    greatest value. The buckets that hold the two neighbours of a quantile become ranges of values, which
    the next scan pushes down to the files and cuts into equal cells, until a cell holds one value:
    two scans unless values lie closer than the bucket's width / CELLS.
    """
    columns = list(wanted)
    asks = [(c, q, end) for c in columns for q in wanted[c] for end in (F.floor, F.ceil)]
    ranges = [_Range(c) for c in columns]
    slots: dict[int, tuple[int, Callable[[Column], Column]]] = {
        i: (columns.index(c), lambda n, q=q, end=end: end((n - 1) * F.lit(q)))
        for i, (c, q, end) in enumerate(asks)
    }
    counts: dict[str, int] = {}
    values: dict[int, float] = {}
    while slots:
        numbers = list(slots)
        found = _narrow(df, ranges, [slots[i] for i in numbers])
        following: list[_Range] = []
        slots = {}
        for place, hit in found.items():
            i = numbers[place]
            counts.setdefault(asks[i][0], hit["n"])
            if hit["low"] == hit["high"]:
                values[i] = hit["low"]
                continue
            narrowed = _Range(asks[i][0], hit["low"], hit["high"])
            if narrowed not in following:
                following.append(narrowed)
            slots[i] = (following.index(narrowed), lambda n, rest=hit["rest"]: F.lit(rest))
        ranges = following
    result: dict[tuple[str, float], float | None] = {}
    for i in range(0, len(asks), 2):
        c, q, _ = asks[i]
        position = (counts.get(c, 0) - 1) * q
        result[c, q] = _between(values[i], values[i + 1], position - int(position)) if i in values else None
    return result


def _between(low: float, high: float, fraction: float) -> float:
    if low == high or fraction == 0:
        return low
    span = high - low
    return low + span * fraction if isfinite(span) else low * (1 - fraction) + high * fraction


def quantiles(df: DataFrame, columns: list[str], q: float) -> dict[str, float | None]:
    """The same quantile of several columns over the whole table."""
    found = order_statistics(df, {c: [q] for c in columns})
    return {c: found[c, q] for c in columns}


def grouped_quantile(
    df: DataFrame, keys: list[str], column: str, q: float, alias: str
) -> DataFrame:
    """Exact interpolated quantile per group; a group may be larger than one task can hold.

    Values are first counted per (group, value), which spreads a hot group over all tasks. Two
    histograms then leave only the few values around the wanted rank of each group.
    """
    value = F.col(column)
    counted = (
        df.where(value.isNotNull())
        .groupBy(*keys, value.alias("_v"))
        .agg(F.count(F.lit(1)).alias("_rows"))
    )
    coarse, fine = LOG_STEPS
    counted = stage(  # read three times below
        counted.withColumns({"_b0": log_bucket(F.col("_v"), coarse), "_b1": log_bucket(F.col("_v"), fine)}),
        "counted",
    )
    first = F.floor((F.col("_n") - 1) * F.lit(q))
    second = F.ceil((F.col("_n") - 1) * F.lit(q))

    def around_rank(placed: DataFrame) -> DataFrame:
        holds_low = (F.col("_before") <= first) & (first < F.col("_before") + F.col("_rows"))
        holds_high = (F.col("_before") <= second) & (second < F.col("_before") + F.col("_rows"))
        return placed.where(holds_low | holds_high)

    by_group = Window.partitionBy(*keys)
    running = F.sum("_rows").over(by_group.orderBy("_b0"))
    buckets = around_rank(
        counted.groupBy(*keys, "_b0")
        .agg(F.sum("_rows").alias("_rows"))
        .withColumn("_before", running - F.col("_rows"))
        .withColumn("_n", F.sum("_rows").over(by_group))
    ).select(*keys, "_b0", "_n", F.min("_before").over(by_group).alias("_base"))

    running = F.col("_base") + F.sum("_rows").over(by_group.orderBy("_b0", "_b1"))
    cells = around_rank(
        counted.join(buckets, [*keys, "_b0"])
        .groupBy(*keys, "_b0", "_b1", "_n", "_base")
        .agg(F.sum("_rows").alias("_rows"))
        .withColumn("_before", running - F.col("_rows"))
    ).select(*keys, "_b0", "_b1", "_n", F.min("_before").over(by_group).alias("_base"))

    running = F.col("_base") + F.sum("_rows").over(by_group.orderBy("_v"))
    values = around_rank(
        counted.join(cells, [*keys, "_b0", "_b1"]).withColumn("_before", running - F.col("_rows"))
    )
    # at most two values per group are left here
    fraction = (F.max("_n") - 1) * F.lit(q) - F.floor((F.max("_n") - 1) * F.lit(q))
    low, high = F.min("_v"), F.max("_v")
    infinite = F.abs(high - low) == float("inf")
    between = (
        F.when((low == high) | (fraction == 0), low)
        .when(infinite, low * (1 - fraction) + high * fraction)
        .otherwise(low + (high - low) * fraction)
    )
    return values.groupBy(*keys).agg(between.alias(alias))
