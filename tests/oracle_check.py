"""Compare queries with their SQL: `python tests/oracle_check.py [sf_dir] [name ...]`."""

from __future__ import annotations

import glob
import os
import sys
import time

import duckdb
import pandas as pd

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)


def duck(sf_dir: str):
    con = duckdb.connect()
    for path in glob.glob(f"{sf_dir}/*.parquet"):
        name = os.path.basename(path)[: -len(".parquet")]
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{path}'")
    return con


def canonical(df: pd.DataFrame) -> list[tuple]:
    df = df[sorted(df.columns)]

    def cell(v):
        if v is None or v is pd.NaT or v is pd.NA or (isinstance(v, float) and v != v):
            return "~"
        if isinstance(v, pd.Timestamp):
            return v.isoformat()
        if hasattr(v, "isoformat"):
            return pd.Timestamp(v).isoformat()
        if isinstance(v, bool) or type(v).__name__ == "bool_":
            return str(bool(v))
        if isinstance(v, (int, float)) or hasattr(v, "dtype"):
            return repr(float(v))
        return str(v)

    return sorted(tuple(cell(v) for v in row) for row in df.itertuples(index=False))


def compare(spark_df, con, sql) -> str | None:
    """None if equal, else the first difference."""
    left, right = spark_df.toPandas(), con.execute(sql).df()
    if sorted(left.columns) != sorted(right.columns):
        return f"columns {sorted(left.columns)} vs {sorted(right.columns)}"
    if len(left) != len(right):
        return f"rows {len(left)} vs {len(right)}"
    a, b = canonical(left), canonical(right)
    diff = [(x, y) for x, y in zip(a, b) if x != y]
    types = {
        c: (str(left[c].dtype), str(right[c].dtype))
        for c in left.columns
        # pandas shows dates as objects on one side and as datetimes on the other
        if str(left[c].dtype)[:5] != str(right[c].dtype)[:5]
        and {str(left[c].dtype)[:8], str(right[c].dtype)[:8]} != {"object", "datetime"}
        # and whole numbers with nulls as floats on one side
        and {str(left[c].dtype), str(right[c].dtype)} != {"float64", "Int64"}
    }
    if diff:
        return f"{len(diff)}/{len(a)} rows differ, e.g.\n   {diff[0][0]}\n   {diff[0][1]}"
    return f"TYPES {types}" if types else None


def main() -> int:
    from __spark_entry__ import oracle_sql, queries
    from hourloom import build_session

    args = sys.argv[1:]
    sf_dir = args[0] if args else "/root/testdata/sf0.01"
    spark = build_session(master="local[8]", **{
        "spark.sql.shuffle.partitions": "8", "spark.ui.enabled": "false",
        "spark.driver.memory": "8g", "spark.ui.showConsoleProgress": "false",
    })
    spark.sparkContext.setLogLevel("ERROR")
    con, sqls, bad = duck(sf_dir), oracle_sql(), 0
    for name, fn in queries().items():
        if args[1:] and name not in args[1:]:
            continue
        t = time.time()
        try:
            if name in sqls:
                said = compare(fn(spark, sf_dir), con, sqls[name])
            else:
                said = None if fn(spark, sf_dir).count() else "no rows"
        except Exception as e:  # report and go on with the next query
            said = f"{type(e).__name__}: {str(e)[:250]}"
        bad += bool(said)
        mark = "ok" if not said else "BAD " + said
        print(f"{name:28s} {time.time() - t:6.1f}s {'' if name in sqls else '(rows) '}{mark}", flush=True)
    print("bad:", bad)
    return bad


if __name__ == "__main__":
    sys.exit(main())
