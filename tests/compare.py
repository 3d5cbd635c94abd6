"""Run catalog queries and compare them with their DuckDB form.

    python tests/compare.py /root/testdata/sf0.001 [name ...]

With PLAIN_SESSION=<time zone> the session has Spark's default settings and that time zone.
"""

import os
import sys
import tempfile
import time

import duckdb
import pandas as pd
from pyspark.sql import SparkSession

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def duck(sf):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf}/{t}.parquet')")
    return con


def normal(df: pd.DataFrame) -> pd.DataFrame:
    df = df[sorted(df.columns)].copy()
    for c in df.columns:
        if str(df[c].dtype).startswith("datetime"):
            df[c] = df[c].astype("datetime64[us]").astype(str)
        else:
            df[c] = df[c].map(lambda v: "<null>" if v is None or v is pd.NaT or (isinstance(v, float) and v != v) or v is pd.NA
                              else repr(round(float(v), 9)) if isinstance(v, float) and not isinstance(v, bool) else str(v))
    return df.sort_values(list(df.columns)).reset_index(drop=True)


def compare(spark, con, fn, sql, sf):
    got = fn(spark, sf).toPandas()
    if sql is None:
        return len(got), "rows only" if len(got) else "EMPTY"
    want = con.execute(sql).fetchdf()
    if sorted(got.columns) != sorted(want.columns):
        return len(got), f"COLUMNS {sorted(set(got.columns) ^ set(want.columns))}"
    if len(got) != len(want):
        return len(got), f"ROWS {len(got)} != {len(want)}"
    a, b = normal(got), normal(want)
    bad = [c for c in a.columns if not (a[c] == b[c]).all()]
    if bad:
        i = (a[bad[0]] != b[bad[0]]).idxmax()
        return len(got), f"VALUES {bad} e.g. {a.loc[i].to_dict()} != {b.loc[i].to_dict()}"
    kinds = [c for c in got.columns if got[c].dtype.kind != want[c].dtype.kind and {got[c].dtype.kind, want[c].dtype.kind} != {"O"}]
    zero = [c for c in got.columns if got[c].dtype.kind == "f" and
            ((got[c] == 0) & (1 / got[c].where(got[c] == 0) < 0)).any() != ((want[c] == 0) & (1 / want[c].where(want[c] == 0) < 0)).any()]
    note = (f" KINDS {[(c, got[c].dtype, want[c].dtype) for c in kinds]}" if kinds else "") + (f" NEGZERO {zero}" if zero else "")
    return len(got), ("ok" if len(got) else "EMPTY") + note


if __name__ == "__main__":
    from barspark.catalog import load
    from barspark.session import local_session

    sf, names = sys.argv[1], sys.argv[2:]
    reg, con, zone = load(), duck(sf), os.environ.get("PLAIN_SESSION")
    if zone:
        spark = SparkSession.builder.master("local[8]").config("spark.ui.enabled", "false").config("spark.sql.session.timeZone", zone).config(
            "spark.sql.shuffle.partitions", "8").config("spark.driver.memory", "8g").config("spark.checkpoint.dir", tempfile.mkdtemp(prefix="spark-")).config("spark.ui.showConsoleProgress", "false").getOrCreate()
    else:
        spark = local_session("compare")
    failures = 0
    for name, fn in reg.QUERIES.items():
        if names and not any(name == n or (n.endswith("*") and name.startswith(n[:-1])) for n in names):
            continue
        start = time.time()
        try:
            rows, verdict = compare(spark, con, fn, reg.SQL.get(name), sf)
        except Exception as e:  # report and go on
            rows, verdict = -1, "ERROR " + str(e)[:700].replace("\n", " ")
        failures += verdict not in ("ok", "rows only")
        print(f"{name:42s} {rows:8d} {time.time() - start:6.1f}s {verdict}"[:900], flush=True)
    print("failures:", failures)
