"""Run every registered query on Spark and its SQL on DuckDB; compare.

Usage: python tests/oracle_check.py [sf_dir] [key-substring ...]
Compares column names, column types, row counts and the multiset of rows
(floats rounded to 6 significant digits).
"""

from __future__ import annotations

import math
import sys
import time

import duckdb
import pandas as pd

sys.path.insert(0, __file__.rsplit("/tests/", 1)[0])

import os as _os

STRICT = _os.environ.get("ORACLE_STRICT") == "1"  # compare floats bit for bit

TABLES = ("region nation customer supplier part orders lineitem events documents "
          "embeddings pages benchmark labels conversations").split()

SPARK_TO_DUCK = {
    "IntegerType": "INTEGER", "LongType": "BIGINT", "DoubleType": "DOUBLE", "FloatType": "FLOAT",
    "StringType": "VARCHAR", "BooleanType": "BOOLEAN", "TimestampNTZType": "TIMESTAMP",
    "DateType": "DATE", "ShortType": "SMALLINT", "ByteType": "TINYINT",
    "TimestampType": "TIMESTAMP WITH TIME ZONE",
}


def duck(sf_dir: str):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def norm(v):
    if v is None or v is pd.NA or v is pd.NaT:
        return None
    if isinstance(v, float):
        if math.isnan(v):
            return None
        r = v if STRICT else float(f"{v:.6g}")
        return int(r) if r.is_integer() else r
    if hasattr(v, "item") and not isinstance(v, (str, bytes)):
        try:
            return norm(v.item())
        except (ValueError, AttributeError):
            pass
    if isinstance(v, pd.Timestamp):
        return str(v.to_pydatetime())
    if isinstance(v, (list, tuple)):
        return tuple(norm(x) for x in v)
    if hasattr(v, "tolist"):
        return tuple(norm(x) for x in v.tolist())
    if v is pd.NaT:
        return None
    return v if not isinstance(v, (int,)) or isinstance(v, bool) else int(v)


def rows_of(pdf: pd.DataFrame, cols):
    out = []
    for rec in pdf[cols].itertuples(index=False, name=None):
        out.append(tuple(norm(x) for x in rec))
    return sorted(out, key=repr)


def check(spark, con, key, fn, sql, sf_dir):
    t0 = time.time()
    sdf = fn(spark, sf_dir)
    s_types = {f.name: type(f.dataType).__name__ for f in sdf.schema.fields}
    spdf = sdf.toPandas()
    t1 = time.time()
    if sql is None:
        return {"key": key, "status": "rows-only", "rows": len(spdf), "sec": round(t1 - t0, 2)}
    rel = con.execute(sql)
    d_types = {d[0]: str(d[1]) for d in rel.description}
    dpdf = rel.df()
    problems = []
    if sorted(spdf.columns) != sorted(dpdf.columns):
        problems.append(f"columns spark={sorted(spdf.columns)} duck={sorted(dpdf.columns)}")
    else:
        for c in spdf.columns:
            st = SPARK_TO_DUCK.get(s_types[c], s_types[c])
            if st != d_types.get(c) and not (s_types[c] == "DecimalType"):
                problems.append(f"type {c}: spark={s_types[c]} duck={d_types.get(c)}")
        if len(spdf) != len(dpdf):
            problems.append(f"rows spark={len(spdf)} duck={len(dpdf)}")
        else:
            cols = sorted(spdf.columns)
            a, b = rows_of(spdf, cols), rows_of(dpdf, cols)
            if a != b:
                diff = [(x, y) for x, y in zip(a, b) if x != y][:3]
                problems.append(f"values differ, e.g. {diff}")
    return {"key": key, "status": "ok" if not problems else "FAIL", "problems": problems,
            "rows": len(spdf), "sec": round(t1 - t0, 2)}


def main(argv):
    sf_dir = argv[1] if len(argv) > 1 and argv[1].startswith("/") else "/root/testdata/sf0.01"
    pats = [a for a in argv[1:] if not a.startswith("/")]
    from gridspark.session import get_spark
    import __spark_entry__ as E
    import os
    if os.environ.get("PLAIN_SESSION"):
        from pyspark.sql import SparkSession
        spark = SparkSession.builder.master("local[8]").config("spark.ui.enabled", "false").getOrCreate()
        spark.sparkContext.setLogLevel("ERROR")
    else:
        spark = get_spark("local[8]", shuffle_partitions=8)
    if os.environ.get("ORACLE_TZ"):
        spark.conf.set("spark.sql.session.timeZone", os.environ["ORACLE_TZ"])
    con = duck(sf_dir)
    qs, sqls = E.queries(), E.oracle_sql()
    bad = 0
    for key, fn in qs.items():
        if pats and not any(p in key for p in pats):
            continue
        try:
            r = check(spark, con, key, fn, sqls.get(key), sf_dir)
        except Exception as e:  # noqa: BLE001
            r = {"key": key, "status": "ERROR", "problems": [repr(e)[:400]]}
        if r["status"] in ("FAIL", "ERROR"):
            bad += 1
        print(r, flush=True)
    print(f"DONE bad={bad}")
    return bad


if __name__ == "__main__":
    sys.exit(1 if main(sys.argv) else 0)
