"""Run catalogue queries on Spark and their SQL on DuckDB, and compare the rows.

    python tests/check_oracle.py [--sf 0.01] [name-part ...]
"""

from __future__ import annotations

import math
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages benchmark "
          "labels conversations").split()


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 9)
    if hasattr(v, "isoformat"):
        return v.isoformat()
    if isinstance(v, (list, tuple)):
        return tuple(plain(x) for x in v)
    if type(v).__name__ == "Decimal":
        return float(v)
    return v


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(((tuple(plain(r[i]) for i in order)) for r in rows), key=lambda t: tuple(map(str, t)))


def compare(spark, con, q, sf):
    df = q.run(spark, sf)
    got = rows_of(df.columns, [tuple(r) for r in df.collect()])
    if not q.sql:
        return len(got), None
    cur = con.execute(q.sql)
    names = [d[0] for d in cur.description]
    want = rows_of(names, cur.fetchall())
    if sorted(names) != sorted(df.columns):
        return len(got), f"columns {sorted(df.columns)} != {sorted(names)}"
    types = {d[0]: str(d[1]) for d in cur.description}
    for f in df.schema.fields:
        simple = f.dataType.simpleString()
        fits = {"bigint": ("BIGINT",), "double": ("DOUBLE",), "string": ("VARCHAR",), "boolean": ("BOOLEAN", "BOOL")}
        if simple in fits and not any(x in types[f.name].upper() for x in (*fits[simple], "NUMBER", "STRING", "BOOL")):
            return len(got), f"type of {f.name}: {simple} != {types[f.name]}"
    if got != want:
        a, b = set(got), set(want)
        return len(got), f"rows {len(got)} vs {len(want)}; only spark {list(a - b)[:3]}; only sql {list(b - a)[:3]}"
    return len(got), None


def main():
    import duckdb
    from pyspark.sql import SparkSession

    from linkloom.plans.catalog import load
    args = sys.argv[1:]
    sf = "0.01"
    if args[:1] == ["--sf"]:
        sf, args = args[1], args[2:]
    path = f"/root/testdata/sf{sf}"
    spark = (SparkSession.builder.master("local[8]").config("spark.sql.shuffle.partitions", "8")
             .config("spark.ui.enabled", "false").config("spark.driver.memory", "16g")
             .config("spark.ui.showConsoleProgress", "false")
             .config("spark.sql.session.timeZone", "UTC").getOrCreate())
    spark.sparkContext.setLogLevel("ERROR")
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{path}/{t}.parquet'")
    bad = 0
    for name, q in load().items():
        if args and not any(a in name for a in args):
            continue
        t = time.time()
        try:
            n, err = compare(spark, con, q, path)
        except Exception as exc:  # noqa: BLE001
            n, err = -1, f"{type(exc).__name__}: {str(exc)[:600]}"
        bad += bool(err)
        print(f"{'FAIL' if err else ('ok  ' if q.sql else 'rows')} {name:38s} {n:7d} {time.time() - t:6.2f}s {err or ''}", flush=True)
    print("failures:", bad)
    return 1 if bad else 0


if __name__ == "__main__":
    sys.exit(main())
