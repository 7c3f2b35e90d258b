"""Compare queries with their SQL in DuckDB; also: python -m tests.oracle SF_DIR NAME..."""

from __future__ import annotations

import datetime
import decimal
import math
import sys
import time
from pathlib import Path

import duckdb


def _plain(v):
    if isinstance(v, decimal.Decimal):
        return float(v)
    if isinstance(v, float):
        return "nan" if math.isnan(v) else float(f"{v:.9g}")
    if isinstance(v, datetime.datetime) and v.tzinfo:
        return v.astimezone(datetime.UTC).replace(tzinfo=None)
    return v


def _rows(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in order], sorted((tuple(_plain(r[i]) for i in order) for r in rows), key=repr)


def compare(spark, sf_dir, name, query, sql):
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for p in Path(sf_dir).glob("*.parquet"):
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    cursor = con.execute(sql)
    want = _rows([c[0] for c in cursor.description], cursor.fetchall())
    df = query(spark, str(sf_dir))
    got = _rows(df.columns, [tuple(r) for r in df.collect()])
    return got, want


def main():
    from pyspark.sql import SparkSession

    sys.path.insert(0, str(Path(__file__).parent.parent))
    import __spark_entry__ as entry

    spark = (
        SparkSession.builder.master("local[8]").config("spark.sql.session.timeZone", "UTC").config("spark.sql.shuffle.partitions", "8")
        .config("spark.ui.enabled", "false").config("spark.driver.memory", "8g").getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    sf_dir, names = sys.argv[1], sys.argv[2:]
    sqls = entry.oracle_sql()
    for name, query in entry.queries().items():
        if names and not any(name.startswith(n) for n in names):
            continue
        began = time.time()
        try:
            if name not in sqls:
                print(f"{name}: {query(spark, sf_dir).count()} rows, no SQL, {time.time() - began:.1f} s", flush=True)
                continue
            got, want = compare(spark, sf_dir, name, query, sqls[name])
            if got == want:
                print(f"{name}: ok, {len(want[1])} rows, {time.time() - began:.1f} s", flush=True)
            else:
                print(f"{name}: DIFFERS {len(got[1])} rows, want {len(want[1])}", flush=True)
                if got[0] != want[0]:
                    print("  columns", got[0], want[0])
                g, w = set(got[1]), set(want[1])
                print("  only here:", sorted(g - w, key=repr)[:3], "\n  only SQL:", sorted(w - g, key=repr)[:3], flush=True)
        except Exception as e:
            print(f"{name}: ERROR {str(e)[:1500]}", flush=True)


if __name__ == "__main__":
    main()
