"""Compare every registered query with its SQL: python tests/check_oracle.py <sf dir> [name ...]"""

import sys
import time
from pathlib import Path

import duckdb
import pandas as pd

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

import __spark_entry__ as entry  # noqa: E402
from tests.conftest import make_session  # noqa: E402

TABLES = (
    "region nation customer supplier part orders lineitem events "
    "documents embeddings pages benchmark labels conversations"
).split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def plain(value):
    """Missing values as None and every number as a float, for comparing."""
    if pd.isna(value):
        return None
    if isinstance(value, (bool, str)):
        return value
    if hasattr(value, "timestamp"):
        return pd.Timestamp(value).isoformat()
    return float(value)


def rows_of(frame: pd.DataFrame) -> list[tuple]:
    frame = frame[sorted(frame.columns)]
    rows = [tuple(plain(v) for v in r) for r in frame.astype(object).itertuples(index=False)]
    return sorted(rows, key=repr)


def main(sf_dir: str, names: list[str]) -> int:
    spark = make_session()
    con = connect(sf_dir)
    oracle = entry.oracle_sql()
    failed = 0
    for name, query in entry.queries().items():
        if names and name not in names:
            continue
        start = time.time()
        got = query(spark, sf_dir).toPandas()
        took = time.time() - start
        want = con.execute(oracle[name]).df()
        same_columns = sorted(got.columns) == sorted(want.columns)
        ok = same_columns and rows_of(got) == rows_of(want)
        failed += not ok
        print(f"{'ok ' if ok else 'BAD'} {name:28s} {len(got):7d} rows {took:6.2f} s", flush=True)
        if not ok:
            print("  columns", sorted(got.columns), sorted(want.columns))
            if same_columns:
                g, w = rows_of(got), rows_of(want)
                print("  rows", len(g), len(w))
                print("  ", [x for x in zip(g, w) if x[0] != x[1]][:3])
    return failed


if __name__ == "__main__":
    sys.exit(1 if main(sys.argv[1], sys.argv[2:]) else 0)
