"""Registry of queries and the column formats both engines share.

Engines add doubles in different orders, so figures that come out of sums are compared in single
precision (kind ``f``), as are integers that may be missing; other integers as 64-bit numbers.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from querybook.lake import Lake, lake
from querybook.sql import with_tables

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def _columns(spec: str) -> list[tuple[str, str]]:
    pairs = [item.partition(":") for item in spec.split()]
    return [(name, kind or "s") for name, _, kind in pairs]


def emit(df: DataFrame, spec: str) -> DataFrame:
    """Select the columns of ``spec``: ``name`` or ``name:kind``.

    Kinds: i integer, f single-precision figure, r<digits> rounded figure, none as it is.
    """
    out = []
    for name, kind in _columns(spec):
        c = F.col(name)
        if kind == "i":
            c = c.cast("bigint")
        elif kind == "f":
            c = c.cast("float").cast("double")
        elif kind.startswith("r"):
            c = F.round(c.cast("double"), int(kind[1:])) + F.lit(0.0)
        out.append(c.alias(name))
    return df.select(*out)


def emit_sql(body: str, spec: str) -> str:
    out = []
    for name, kind in _columns(spec):
        c = f'"{name}"'
        if kind == "i":
            c = f"CAST({c} AS BIGINT)"
        elif kind == "f":
            c = f"CAST(CAST({c} AS FLOAT) AS DOUBLE)"
        elif kind.startswith("r"):
            c = f"round(CAST({c} AS DOUBLE), {kind[1:]}) + CAST(0 AS DOUBLE)"
        out.append(f'{c} AS "{name}"')
    return f"SELECT {', '.join(out)} FROM ({body}) AS q"


def query(name: str, spec: str, sql: str | None = None, uncapped: bool = False):
    """Register ``fn(lake) -> DataFrame`` under ``name``, with its SQL twin where there is one.

    With ``uncapped``, also as ``<name>_uncapped`` over the tables without the station cap.
    """

    def register(fn: Callable[[Lake], DataFrame]):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return emit(fn(lake(spark, sf_dir)), spec)

        if name in QUERIES:
            raise ValueError(f"query {name} is registered twice")
        QUERIES[name] = run
        if sql is not None:
            ORACLES[name] = with_tables(emit_sql(sql, spec))
        if uncapped:
            QUERIES[f"{name}_uncapped"] = lambda spark, sf_dir: emit(fn(lake(spark, sf_dir).uncapped), spec)
            if sql is not None:
                ORACLES[f"{name}_uncapped"] = with_tables(emit_sql(sql, spec), capped=False)
        return fn

    return register
