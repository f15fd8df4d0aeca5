"""Compare registered queries with their SQL in DuckDB: python tests/check.py [sf_dir] [name ...]"""

import math
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

import duckdb
from pyspark.sql import SparkSession

import __spark_entry__ as entry

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels "
          "conversations").split()


def session(cores=8):
    spark = (SparkSession.builder.master(f"local[{cores}]").config("spark.ui.enabled", "false")
             .config("spark.sql.shuffle.partitions", str(cores)).config("spark.driver.memory", "8g")
             .config("spark.sql.session.timeZone", "UTC").config("spark.ui.showConsoleProgress", "false").getOrCreate())
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def duck(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def normal(v):
    if isinstance(v, float):
        return None if math.isnan(v) else v + 0.0
    if isinstance(v, (list, tuple)):
        return tuple(normal(x) for x in v)
    if isinstance(v, dict):
        return tuple(sorted((k, normal(x)) for k, x in v.items()))
    return v


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(normal(r[i]) for i in order) for r in rows), key=lambda t: tuple((x is None, str(x)) for x in t))


def compare(spark, con, name, sf_dir):
    """Number of rows, and None when equal, else a description of the difference."""
    df = entry.queries()[name](spark, sf_dir)
    got = rows_of(df.columns, df.collect())
    text = entry.oracle_sql().get(name)
    if text is None:
        return len(got), None if got else "no rows"
    result = con.execute(text)
    columns = [d[0] for d in result.description]
    want = rows_of(columns, result.fetchall())
    if sorted(columns) != sorted(df.columns):
        return len(got), f"columns {sorted(df.columns)} != {sorted(columns)}"
    if len(got) != len(want):
        return len(got), f"{len(got)} rows != {len(want)}: {got[:2]} / {want[:2]}"
    bad = [(g, w) for g, w in zip(got, want) if g != w or [type(x) for x in g] != [type(x) for x in w]]
    return len(got), f"{len(bad)} of {len(got)} rows differ, e.g. {bad[:2]}" if bad else None


def main():
    sf_dir = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    names = sys.argv[2:] or list(entry.queries())
    spark, con, failed = session(), duck(sf_dir), 0
    for name in names:
        start = time.time()
        try:
            n, problem = compare(spark, con, name, sf_dir)
        except Exception as e:
            n, problem = 0, f"{type(e).__name__}: {str(e)[:1500]}"
        failed += problem is not None
        kind = "sql " if name in entry.oracle_sql() else "rows"
        state = "FAIL" if problem else "ok  "
        print(f"{state} {kind} {name} {n} rows {time.time() - start:.1f}s {problem or ''}", flush=True)
    print(f"{len(names) - failed} of {len(names)} ok")


if __name__ == "__main__":
    main()
