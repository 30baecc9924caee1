"""Run queries against their SQL in DuckDB: ``python tests/compare.py [name ...]``."""

import math
import os
import sys
import time

import duckdb

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()
TYPES = {"BIGINT": "bigint", "INTEGER": "int", "DOUBLE": "double", "VARCHAR": "string", "BOOLEAN": "boolean"}


def connect(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def _value(v):
    if isinstance(v, float) and v == 0:
        return "0.0"
    return "NULL" if v is None or (isinstance(v, float) and math.isnan(v)) else repr(v)


def difference(df, con, sql):
    """None when equal, else a short account of the difference."""
    cols = sorted(df.columns)
    got = sorted(tuple(_value(r[c]) for c in cols) for r in df.collect())
    res = con.execute(sql)
    names = [d[0] for d in res.description]
    types = {d[0]: str(d[1]) for d in res.description}
    rows = res.fetchall()
    if sorted(names) != cols:
        return f"columns {cols} / {sorted(names)}"
    for c, t in df.dtypes:
        if TYPES.get(types[c]) != t:
            return f"type of {c}: {t} / {types[c]}"
    at = [names.index(c) for c in cols]
    want = sorted(tuple(_value(r[i]) for i in at) for r in rows)
    if got != want:
        a, b = set(got), set(want)
        return f"rows {len(got)} / {len(want)}; only here {sorted(a - b)[:2]}; only there {sorted(b - a)[:2]}"
    return None


def main(names):
    from pyspark.sql import SparkSession

    import __spark_entry__ as entry

    sf_dir = os.environ.get("SF_DIR", "/root/testdata/sf0.01")
    spark = (
        SparkSession.builder.master("local[8]").config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false").config("spark.driver.memory", "8g")
        .config("spark.sql.shuffle.partitions", "8").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    con, queries, sql = connect(sf_dir), entry.queries(), entry.oracle_sql()
    bad = []
    for name in names or queries:
        at = time.time()
        try:
            df = queries[name](spark, sf_dir)
            if name in sql:
                verdict = difference(df, con, sql[name])
            else:
                verdict = None if df.count() >= 0 else "?"
        except Exception as e:  # noqa: BLE001 - report and go on
            verdict = f"{type(e).__name__}: {str(e)[:1500]}"
        if verdict:
            bad.append(name)
        print(f"{name:22s} {time.time() - at:6.1f}s {'' if name in sql else '(no SQL) '}{verdict or 'ok'}", flush=True)
    print("FAILED" if bad else "ALL OK", bad)


if __name__ == "__main__":
    main(sys.argv[1:])
