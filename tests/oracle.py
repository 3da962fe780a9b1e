"""Compares a registered query with its oracle as the driver does: row count, columns and values, order aside."""

import duckdb
import numpy as np
import pandas as pd

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def _plain(x):
    if isinstance(x, (list, tuple, np.ndarray)):
        return "[" + ", ".join(_plain(v) for v in x) + "]"
    if x is None or x is pd.NA or x is pd.NaT or (isinstance(x, (float, np.floating)) and np.isnan(x)):
        return "∅"
    if isinstance(x, (bool, np.bool_)):
        return str(bool(x))
    if isinstance(x, (float, np.floating)):
        return f"{x:.9g}" if x != int(x) or abs(x) > 1e15 else str(int(x))
    if isinstance(x, dict):
        return "{" + ", ".join(f"{k}: {_plain(v)}" for k, v in sorted(x.items())) + "}"
    return str(x)


def rows_of(df: pd.DataFrame) -> list[tuple]:
    df = df[sorted(df.columns)]
    return sorted(tuple(_plain(v) for v in r) for r in df.itertuples(index=False, name=None))


def compare(spark, name: str, query, sql: str, sf_dir: str) -> None:
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    got, want = query(spark, sf_dir).toPandas(), con.execute(sql).fetchdf()
    assert sorted(got.columns) == sorted(want.columns), (name, sorted(got.columns), sorted(want.columns))
    a, b = rows_of(got), rows_of(want)
    assert len(a) == len(b), (name, len(a), len(b))
    assert a == b, (name, [(x, y) for x, y in zip(a, b, strict=True) if x != y][:3])
