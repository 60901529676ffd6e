"""Run registered queries beside their SQL in DuckDB and compare all values.

    python -m checks.compare [sf_dir] [query ...]
"""

from __future__ import annotations

import glob
import math
import os
import sys
import time

import duckdb
import pandas as pd


def _rows(df: pd.DataFrame) -> list[tuple]:
    def norm(v):
        if v is None or (isinstance(v, float) and math.isnan(v)) or v is pd.NaT:
            return None
        if hasattr(v, "item") and not isinstance(v, (list, str)):
            v = v.item() if getattr(v, "ndim", 0) == 0 else tuple(v.tolist())
        return v + 0.0 if isinstance(v, float) else v

    df = df[sorted(df.columns)]
    return sorted((tuple(norm(v) for v in r) for r in df.itertuples(index=False, name=None)), key=repr)


def connect(sf_dir: str):
    con = duckdb.connect()
    for path in glob.glob(f"{sf_dir}/*.parquet"):
        name = os.path.basename(path).removesuffix(".parquet")
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{path}'")
    return con


def compare(spark, con, query, sql, sf_dir) -> str:
    """Empty if equal, else what differs."""
    got = query(spark, sf_dir)
    if sql is None:
        return "" if got.count() else "no rows"
    want = con.execute(sql).df()
    got = got.toPandas()
    if sorted(got.columns) != sorted(want.columns):
        return f"columns {sorted(got.columns)} != {sorted(want.columns)}"
    kinds = [(c, got[c].dtype.kind, want[c].dtype.kind) for c in got.columns]
    a, b = _rows(got), _rows(want)
    if len(a) != len(b):
        return f"rows {len(a)} != {len(b)}"
    bad = [(x, y) for x, y in zip(a, b) if x != y]
    return f"{len(bad)} of {len(a)} differ, first {bad[0]} {kinds}"[:600] if bad else ""


def main(argv: list[str]) -> int:
    from checks.oracle import ORACLE
    from checks.queries import QUERIES
    from topicflow.session import get_session

    sf_dir = argv[0] if argv else "/root/testdata/sf0.01"
    names = argv[1:] or list(QUERIES)
    spark = get_session(
        "compare", "local[8]", spark__sql__shuffle__partitions="8", spark__ui__enabled="false",
        spark__ui__showConsoleProgress="false", spark__driver__memory="8g",
    )
    spark.sparkContext.setLogLevel("ERROR")
    con, failed = connect(sf_dir), 0
    for name in names:
        start = time.time()
        try:
            problem = compare(spark, con, QUERIES[name], ORACLE.get(name), sf_dir)
        except Exception as e:  # report and go on with the next query
            problem = f"{type(e).__name__}: {e}"[:700]
        failed += bool(problem)
        kind = "sql " if name in ORACLE else "rows"
        print(f"{'FAIL' if problem else 'ok  '} {kind} {name:24s} {time.time() - start:6.1f}s {problem}", flush=True)
    return failed


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
