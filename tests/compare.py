"""Compares a registered query with its SQL twin on one scale folder."""

from __future__ import annotations

import os
import sys
import time

import duckdb
import pandas as pd

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
from flowtables.fixtures import TABLES  # noqa: E402


def duck(folder: str):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{folder}/{t}.parquet')")
    return con


def canonical(pdf: pd.DataFrame) -> pd.DataFrame:
    pdf = pdf[sorted(pdf.columns)].copy()
    for c in pdf.columns:
        pdf[c] = [
            "∅" if v is None or v is pd.NaT or v is pd.NA or (isinstance(v, float) and v != v)
            else pd.Timestamp(v).isoformat() if hasattr(v, "isoformat")
            else (str(int(v)) if float(v).is_integer() and abs(v) < 1e15 else repr(float(v))) if isinstance(v, float)
            else str(v)
            for v in pdf[c].tolist()
        ]
    return pdf.sort_values(list(pdf.columns)).reset_index(drop=True) if len(pdf.columns) else pdf


def mismatch(spark_pdf: pd.DataFrame, duck_pdf: pd.DataFrame) -> str | None:
    if sorted(spark_pdf.columns) != sorted(duck_pdf.columns):
        return f"columns {sorted(spark_pdf.columns)} != {sorted(duck_pdf.columns)}"
    if len(spark_pdf) != len(duck_pdf):
        return f"rows {len(spark_pdf)} != {len(duck_pdf)}"
    for c in spark_pdf.columns:
        a, b = spark_pdf[c].dtype, duck_pdf[c].dtype
        if a.kind != b.kind and not spark_pdf[c].isna().any():
            return f"type of {c}: {a} != {b}"
    left, right = canonical(spark_pdf), canonical(duck_pdf)
    if not left.equals(right):
        bad = (left != right).any(axis=1)
        i = bad[bad].index[0]
        return f"{int(bad.sum())} rows differ, first\n  spark {left.loc[i].to_dict()}\n  sql   {right.loc[i].to_dict()}"
    return None


if __name__ == "__main__":
    from pyspark.sql import SparkSession

    import __spark_entry__ as e

    folder = f"/root/testdata/{sys.argv[1]}"
    wanted = sys.argv[2:]
    spark = (
        SparkSession.builder.master("local[8]")
        .config("spark.sql.shuffle.partitions", "8").config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    con = duck(folder)
    bad = 0
    for name, fn in e.queries().items():
        if wanted and not any(name == w or (w.endswith("*") and name.startswith(w[:-1])) for w in wanted):
            continue
        t0 = time.time()
        try:
            got = fn(spark, folder)
            nested = "NestedLoop" in got._jdf.queryExecution().toString() or "CartesianProduct" in got._jdf.queryExecution().toString()
            pdf = got.toPandas()
            t1 = time.time()
            sql = e.oracle_sql().get(name)
            why = mismatch(pdf, con.execute(sql).df()) if sql else None
            note = ("NESTED LOOP " if nested else "") + ("" if sql else "(no sql) ")
            if why or nested:
                bad += 1
            print(f"{'BAD' if why else 'ok '} {name:28s} rows={len(pdf):7d} {t1 - t0:6.2f}s sql {time.time() - t1:5.2f}s {note}{why or ''}", flush=True)
        except Exception as ex:  # noqa: BLE001
            bad += 1
            print(f"ERR {name}: {str(ex)[:1500]}", flush=True)
    print("bad:", bad)
