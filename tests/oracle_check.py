"""Runs registered queries and their SQL twins side by side. `python tests/oracle_check.py [sf_dir] [name ...]`."""

from __future__ import annotations

import math
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels "
          "conversations").split()


def connect(sf: str):
    import duckdb

    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return con


def _plain(v):
    import datetime

    if v is None or (isinstance(v, float) and math.isnan(v)):
        return None
    if isinstance(v, datetime.datetime):
        return v.date() if v.time() == datetime.time() else v
    if hasattr(v, "item"):
        v = v.item()
    if isinstance(v, bool):
        return v
    return v


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in order], sorted((tuple(_plain(r[i]) for i in order) for r in rows), key=repr)


def compare(spark, con, name, query, sql, sf) -> tuple[bool, str]:
    start = time.time()
    df = query(spark, sf)
    got_cols, got = rows_of(df.columns, df.collect())
    took = time.time() - start
    if sql is None:
        return bool(got), f"rows only: {len(got)} rows, {took:.1f}s"
    res = con.execute(sql)
    want_cols, want = rows_of([d[0] for d in res.description], res.fetchall())
    if got_cols != want_cols:
        return False, f"columns {got_cols} != {want_cols}"
    if len(got) != len(want):
        return False, f"{len(got)} rows != {len(want)}"
    bad = [(g, w) for g, w in zip(got, want) if g != w]
    if bad:
        return False, f"{len(bad)} of {len(got)} rows differ, e.g. {bad[0][0]} != {bad[0][1]}"
    kinds = {type(a) for r in got[:50] for a in r if a is not None}
    return True, f"{len(got)} rows, {took:.1f}s, {sorted(k.__name__ for k in kinds)}"


def main() -> int:
    from pyspark.sql import SparkSession

    import __spark_entry__ as entry

    args = sys.argv[1:]
    sf = args.pop(0) if args and args[0].startswith("/") else "/root/testdata/sf0.01"
    spark = (
        SparkSession.builder.master("local[8]").config("spark.sql.shuffle.partitions", "8")
        .config("spark.ui.enabled", "false").config("spark.driver.memory", "8g").getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    con, oracles, failed = connect(sf), entry.oracle_sql(), []
    for name, query in entry.queries().items():
        if args and name not in args:
            continue
        try:
            ok, note = compare(spark, con, name, query, oracles.get(name), sf)
        except Exception as e:  # report and go on with the next query
            ok, note = False, f"{type(e).__name__}: {str(e)[:300]}"
        print("ok  " if ok else "FAIL", name, note, flush=True)
        if not ok:
            failed.append(name)
    print("failed:", failed)
    return len(failed)


if __name__ == "__main__":
    sys.exit(main())
