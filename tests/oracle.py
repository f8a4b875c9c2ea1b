"""Run a registered query on Spark and its SQL on DuckDB and compare the rows."""

from __future__ import annotations

import duckdb
import pandas as pd

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def duck(sf_dir: str):
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return con


def canonical(frame: pd.DataFrame) -> pd.DataFrame:
    frame = frame[sorted(frame.columns)]
    shown = frame.map(lambda v: "" if v is pd.NA or v is None or v != v else repr(float(v)) if isinstance(v, (int, float)) else str(v))
    return shown.sort_values(list(shown.columns)).reset_index(drop=True)


def difference(spark_frame: pd.DataFrame, duck_frame: pd.DataFrame) -> str | None:
    if sorted(spark_frame.columns) != sorted(duck_frame.columns):
        return f"columns {sorted(spark_frame.columns)} != {sorted(duck_frame.columns)}"
    if len(spark_frame) != len(duck_frame):
        return f"rows {len(spark_frame)} != {len(duck_frame)}"
    left, right = canonical(spark_frame.astype(object)), canonical(duck_frame.astype(object))
    wrong = (left != right).any(axis=1)
    if wrong.any():
        at = wrong.idxmax()
        cells = [(c, left.at[at, c], right.at[at, c]) for c in left if left.at[at, c] != right.at[at, c]]
        return f"{int(wrong.sum())} rows differ, first: {cells}"
    return None
