"""Compare every query with its SQL: python tests/check_oracle.py [sf_dir] [name ...]"""

import os
import sys
import time
from decimal import Decimal

import duckdb

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
from __spark_entry__ import oracle_sql, queries  # noqa: E402
from veilsight.session import local_session  # noqa: E402

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages benchmark "
          "labels conversations").split()


def plain(value):
    return str(round(float(value), 6)) if isinstance(value, (float, Decimal)) else str(value)


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(plain(r[i]) for i in order) for r in rows)


def compare(spark, con, name, sf_dir):
    start = time.time()
    df = queries()[name](spark, sf_dir)
    got = rows_of(df.columns, df.collect())
    took = time.time() - start
    sql = oracle_sql().get(name)
    if sql is None:
        return f"rows only {len(got)}", took, 0.0
    start = time.time()
    result = con.execute(sql)
    columns = [d[0] for d in result.description]
    want = rows_of(columns, result.fetchall())
    if sorted(columns) != sorted(df.columns):
        return f"COLUMNS {sorted(columns)} {sorted(df.columns)}", took, time.time() - start
    if got != want:
        extra = [r for r in got if r not in set(want)][:2]
        missing = [r for r in want if r not in set(got)][:2]
        return f"DIFF {len(got)} {len(want)} extra={extra} missing={missing}", took, time.time() - start
    return f"ok {len(got)}", took, time.time() - start


def main():
    sf_dir = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    names = sys.argv[2:] or list(queries())
    spark = local_session("check", 8)
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    for name in names:
        try:
            outcome, a, b = compare(spark, con, name, sf_dir)
        except Exception as e:  # noqa: BLE001
            outcome, a, b = "ERROR " + str(e).replace("\n", " ")[:600], 0, 0
        print(f"{name:28s} {a:6.1f}s {b:6.1f}s {outcome[:900]}", flush=True)


if __name__ == "__main__":
    main()
