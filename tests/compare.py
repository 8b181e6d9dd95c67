"""Compare a Spark frame with DuckDB SQL over the same Parquet tables, row by row."""

from __future__ import annotations

from pathlib import Path

import duckdb
import pandas as pd


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for path in Path(sf_dir).glob("*.parquet"):
        con.execute(f"CREATE VIEW {path.stem} AS SELECT * FROM '{path}'")
    return con


def _normal(frame: pd.DataFrame) -> pd.DataFrame:
    frame = frame[sorted(frame.columns)].copy()
    for c in frame.columns:
        if str(frame[c].dtype).startswith("datetime"):
            frame[c] = frame[c].astype("datetime64[us]").astype(str)
        elif frame[c].dtype.kind in "iuf":
            frame[c] = frame[c].astype("float64").map(lambda x: "null" if pd.isna(x) else repr(x))
        else:
            frame[c] = frame[c].map(lambda x: "null" if pd.isna(x) else str(x))
    return frame.sort_values(list(frame.columns)).reset_index(drop=True)


def difference(ours: pd.DataFrame, theirs: pd.DataFrame) -> str | None:
    """A short description of how two frames differ, None when all rows are equal."""
    if sorted(ours.columns) != sorted(theirs.columns):
        return f"columns {sorted(ours.columns)} vs {sorted(theirs.columns)}"
    kinds = {c: (ours[c].dtype.kind, theirs[c].dtype.kind) for c in ours.columns}
    a, b = _normal(ours), _normal(theirs)
    if len(a) != len(b):
        return f"rows {len(a)} vs {len(b)}"
    wrong = (a != b).any(axis=1)
    if wrong.any():
        cols = [c for c in a.columns if (a[c] != b[c]).any()]
        return f"{wrong.sum()} rows differ in {cols}: {a[wrong].head(2).to_dict('records')} vs {b[wrong].head(2).to_dict('records')}"
    for c, (x, y) in kinds.items():
        if {x, y} == {"i", "f"} and ours[c].isna().any():
            continue  # pandas has whole numbers with nulls as doubles in one frame, as Int64 in the other
        if x != y and {x, y} != {"O", "f"}:
            return f"type of {c}: {x} vs {y}"
    return None
