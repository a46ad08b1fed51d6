"""Compares queries with their DuckDB twins: ``python -m tests.compare SF_DIR [NAME ...]``."""

from __future__ import annotations

import os
import sys
import time
from collections import Counter

import duckdb
from pyspark.sql import SparkSession

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def session() -> SparkSession:
    builder = SparkSession.builder.master("local[8]").config("spark.sql.shuffle.partitions", "8").config("spark.sql.session.timeZone", "UTC")
    return builder.config("spark.ui.enabled", "false").config("spark.driver.memory", "8g").config("spark.ui.showConsoleProgress", "false").getOrCreate()


def duck(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        path = f"{sf_dir}/{t}.parquet"
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{path}{'/*.parquet' if os.path.isdir(path) else ''}')")
    return con


def plain(v):
    """Values of both engines alike: floats to 9 digits, rows and structs as tuples."""
    if isinstance(v, float):
        return float(f"{v:.9g}")
    if isinstance(v, dict):
        return tuple(sorted((k, plain(x)) for k, x in v.items()))
    if hasattr(v, "asDict"):
        return tuple(sorted((k, plain(x)) for k, x in v.asDict().items()))
    if isinstance(v, (list, tuple)):
        return tuple(plain(x) for x in v)
    if hasattr(v, "as_tuple"):
        return float(v)
    if hasattr(v, "tzinfo") and getattr(v, "tzinfo", None):
        return v.replace(tzinfo=None)
    return v


def rows(columns: list[str], found) -> Counter:
    order = sorted(range(len(columns)), key=columns.__getitem__)
    return Counter(tuple(plain(r[i]) for i in order) for r in found)


def differences(df, con: duckdb.DuckDBPyConnection, sql: str) -> str:
    """Empty if both give the same names, types that compare, and rows."""
    result = con.execute(sql)
    names = [d[0] for d in result.description]
    if sorted(names) != sorted(df.columns):
        return f"columns {sorted(df.columns)} and {sorted(names)}"
    ours, theirs = rows(df.columns, df.collect()), rows(names, result.fetchall())
    if ours == theirs:
        return ""
    return f"{sum(ours.values())} and {sum(theirs.values())} rows; only ours {list((ours - theirs).items())[:2]}; only twin {list((theirs - ours).items())[:2]}"


if __name__ == "__main__":
    import __spark_entry__ as e

    spark, con = session(), duck(sys.argv[1])
    spark.sparkContext.setLogLevel("ERROR")
    queries, twins = e.queries(), e.oracle_sql()
    failed = 0
    for name in sys.argv[2:] or queries:
        began = time.time()
        try:
            said = differences(queries[name](spark, sys.argv[1]), con, twins[name]) if name in twins else f"(no twin; {queries[name](spark, sys.argv[1]).count()} rows)"
        except Exception as err:  # reported, not hidden: the exit code counts it
            said = f"{type(err).__name__}: {str(err)[:600]}"
        failed += bool(said) and not said.startswith("(no twin")
        print(f"{time.time() - began:6.1f} s  {name}: {said or 'equal'}", flush=True)
    sys.exit(failed > 0)
