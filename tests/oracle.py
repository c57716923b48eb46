"""Run queries with Spark and their SQL with DuckDB on the same tables and compare the rows.

``python tests/oracle.py [sf] [name ...]`` prints one line per query.
"""

import os
import sys
import time
import traceback
from collections import Counter

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


TIMES = {}


def session():
    from pyspark.sql import SparkSession

    spark = (
        SparkSession.builder.master("local[8]").appName("riskgraph")
        .config("spark.ui.enabled", "false").config("spark.sql.shuffle.partitions", "8")
        .config("spark.driver.memory", "16g").config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.showConsoleProgress", "false").getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def duck(sf_dir):
    import duckdb

    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def normalize(frame):
    import pandas as pd

    frame = frame[sorted(frame.columns)]
    rows = []
    for row in frame.itertuples(index=False, name=None):
        out = []
        for v in row:
            if v is None or v is pd.NaT or v is pd.NA or (isinstance(v, float) and v != v):
                out.append("NULL")
            elif isinstance(v, bool) or type(v).__name__ == "bool_":
                out.append(str(bool(v)))
            elif hasattr(v, "item") or isinstance(v, (int, float)):
                out.append(repr(float(v)))
            else:
                out.append(str(v))
        rows.append(tuple(out))
    return list(frame.columns), sorted(rows)


def compare(spark, con, name, sf_dir):
    """Empty text when equal, else what differs; None without SQL."""
    from __spark_entry__ import oracle_sql, queries

    t0 = time.time()
    got = queries()[name](spark, sf_dir).toPandas()
    TIMES[name] = time.time() - t0
    sql = oracle_sql().get(name)
    if sql is None:
        return None, len(got)
    want = con.execute(sql).df()
    gc, gr = normalize(got)
    wc, wr = normalize(want)
    if gc != wc:
        return f"columns {gc} != {wc}", len(got)
    same = lambda c, a, b: a.lower().rstrip("0123456789") == b.lower().rstrip("0123456789") or got[c].isna().any()
    kinds = [(c, str(got[c].dtype), str(want[c].dtype)) for c in gc if not same(c, str(got[c].dtype), str(want[c].dtype))]
    if gr != wr:
        extra = list((Counter(gr) - Counter(wr)).elements())[:3]
        missing = list((Counter(wr) - Counter(gr)).elements())[:3]
        return f"rows {len(gr)} / {len(wr)}; only spark {extra}; only sql {missing} ({gc}) {kinds}", len(got)
    return (f"TYPES {kinds}" if kinds and len(gr) else ""), len(got)


def main():
    from __spark_entry__ import queries

    sf = sys.argv[1] if len(sys.argv) > 1 else "sf0.01"
    names = sys.argv[2:] or list(queries())
    spark, con = session(), duck(f"/root/testdata/{sf}")
    bad = 0
    for name in names:
        t0 = time.time()
        try:
            problem, n = compare(spark, con, name, f"/root/testdata/{sf}")
        except Exception as e:  # noqa: BLE001
            problem, n = f"ERROR {type(e).__name__}: {str(e)[:1500]}", -1
            if os.environ.get("TRACE"):
                traceback.print_exc()
        flag = "ok" if not problem else "BAD"
        if problem is None:
            flag = "rows-only"
        bad += flag == "BAD"
        print(f"{flag:9s} {name:36s} rows={n:<7d} {TIMES.get(name, 0):6.2f}s / {time.time() - t0:6.2f}s {problem or ''}", flush=True)
    print("bad:", bad)


if __name__ == "__main__":
    main()
