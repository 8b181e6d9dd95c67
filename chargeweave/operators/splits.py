"""Train / validation / test labels.

Every strategy labels rows by comparing their key with one or two cut rows, so the table itself is
neither sorted nor shuffled: finding the cuts is a handful of counts, labelling is a projection.
Keys must identify a row (they do after near-duplicates are resolved); rows that share a whole key
share a label.
"""

from __future__ import annotations

from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chargeweave.functions.timefeat import minute_number
from chargeweave.operators.order_stats import Level, literal, rows_at_ranks
from chargeweave.schemas import CHARGER, PERIOD, SPLIT, STATION, TS

TRAIN_SHARE, VAL_SHARE_END = 0.8, 0.9
COARSE = {"_minute", "_hash_top", "_hash_upper"}


def time_levels(keys: list[str]) -> list[Level]:
    """Order by timestamp with ``keys`` as the tie-break, coarse minute counts first."""
    levels = [("_minute", minute_number(F.col(TS))), (TS, F.col(TS))]
    return levels + [(k, F.col(k)) for k in keys]


def hash_order(keys: list[str], seed: int) -> Column:
    """MD5 of the seed and the row's key: a pseudo-random order any engine can repeat."""
    parts = [F.coalesce(F.col(k).cast("string"), F.lit("")) for k in keys]
    return F.md5(F.concat_ws("|", F.lit(str(seed)), *parts))


def hash_levels(keys: list[str], seed: int) -> list[Level]:
    """Seeded pseudo-random order, reproducible because it only depends on the row's key."""
    h = hash_order(keys, seed)
    # as numbers, in the same order: their least and greatest are then kept in a hash table, without a sort
    coarse = [(n, F.conv(F.substring(h, 1, d), 16, 10).cast("bigint")) for n, d in (("_hash_top", 4), ("_hash_upper", 8))]
    levels = [*coarse, ("_hash", h)]
    return levels + [(k, F.col(k)) for k in keys]


def comes_before(levels: list[Level], cut: dict[str, Any] | None) -> Column:
    """True for rows ordered before the cut row; all rows when there is no cut row.

    Coarse levels only serve the search for the cut and are implied by the finer ones.
    """
    if cut is None:
        return F.lit(True)
    result = F.lit(False)
    for name, expr in reversed([level for level in levels if level[0] not in COARSE]):
        bound = literal(cut[name])
        result = (expr < bound) | ((expr == bound) & result)
    return result


def label_by_cuts(
    levels: list[Level], val_from: dict[str, Any] | None, test_from: dict[str, Any] | None
) -> Column:
    return (
        F.when(comes_before(levels, val_from), F.lit("train"))
        .when(comes_before(levels, test_from), F.lit("val"))
        .otherwise(F.lit("test"))
    )


def _share_ranks(val_from: float, test_from: float):
    """Ranks int(n * share), in double arithmetic."""
    return lambda n: [
        F.floor(n.cast("double") * F.lit(val_from)),
        F.floor(n.cast("double") * F.lit(test_from)),
    ]


def time_split(df: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Label the whole table 80/10/10 by time."""
    levels = time_levels(keys or [STATION, CHARGER])
    cuts = rows_at_ranks(df, levels, _share_ranks(TRAIN_SHARE, VAL_SHARE_END))
    return df.withColumn(SPLIT, label_by_cuts(levels, *cuts))


def period_time_split(
    df: DataFrame, keys: list[str] | None = None, other_periods: str = "drop"
) -> DataFrame:
    """Periods 1 and 2 train; period 3 is cut 80/10/10 by time.

    Rows of any other period are dropped, or stay in train with ``other_periods='train'``.
    """
    levels = time_levels(keys or [STATION, CHARGER])
    last = F.col(PERIOD) == 3
    cuts = rows_at_ranks(df.where(last), levels, _share_ranks(TRAIN_SHARE, VAL_SHARE_END))
    label = F.when(last, label_by_cuts(levels, *cuts)).otherwise(F.lit("train"))
    if other_periods == "drop":
        df = df.where(F.col(PERIOD).isin(1, 2, 3))
    return df.withColumn(SPLIT, label)


def third_period_split(
    df: DataFrame, train_share: float = TRAIN_SHARE, keys: list[str] | None = None
) -> DataFrame:
    """The two lowest periods train, the third is cut at ``train_share`` and halfway to its end.

    Periods after the third and rows without one are dropped. With fewer than three periods the whole table is cut
    80/10/10 in the given order.
    """
    levels = time_levels(keys or [STATION, CHARGER])
    lowest = [r[0] for r in df.where(F.col(PERIOD).isNotNull()).select(PERIOD).distinct().orderBy(PERIOD).limit(3).collect()]
    if len(lowest) < 3:
        cuts = rows_at_ranks(df, levels, _share_ranks(TRAIN_SHARE, VAL_SHARE_END))
        return df.withColumn(SPLIT, label_by_cuts(levels, *cuts))
    third = F.col(PERIOD) == lowest[2]
    shares = _share_ranks(train_share, train_share + (1 - train_share) / 2)
    cuts = rows_at_ranks(df.where(third), levels, shares)
    label = F.when(third, label_by_cuts(levels, *cuts)).otherwise(F.lit("train"))
    return df.where(F.col(PERIOD).isin(*lowest)).withColumn(SPLIT, label)


def random_split(df: DataFrame, keys: list[str], seed: int = 42) -> DataFrame:
    """Seeded random 80/10/rest with exact sizes int(.8 n) and int(.1 n)."""
    levels = hash_levels(keys, seed)

    def ranks(n: Column) -> list[Column]:
        train = F.floor(n.cast("double") * F.lit(0.8))
        return [train, train + F.floor(n.cast("double") * F.lit(0.1))]

    cuts = rows_at_ranks(df, levels, ranks)
    return df.withColumn(SPLIT, label_by_cuts(levels, *cuts))


def seeded_sample(df: DataFrame, keys: list[str], n: int = 500, seed: int = 42) -> DataFrame:
    """``min(n, rows)`` rows in a seeded pseudo-random order (a distributed top-n)."""
    order = [hash_order(keys, seed), *keys]
    return df.orderBy(*order).limit(n)


def split_sizes(df: DataFrame) -> DataFrame:
    return df.groupBy(SPLIT).agg(F.count(F.lit(1)).alias("rows"))


def only(df: DataFrame, *names: str) -> DataFrame:
    """Rows of the named splits."""
    return df.where(F.col(SPLIT).isin(*names))
