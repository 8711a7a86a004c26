"""Run a registered query and its SQL side by side: python -m tests.oracle NAME... [--sf DIR]"""

from __future__ import annotations

import math
import sys
import time
from pathlib import Path

import duckdb


def plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 6) + 0.0
    if isinstance(v, (list, tuple)):
        return tuple(plain(x) for x in v)
    if isinstance(v, dict):
        return tuple((k, plain(x)) for k, x in v.items())
    if hasattr(v, "asDict"):
        return tuple((k, plain(x)) for k, x in v.asDict().items())
    return v


def rows(names: list[str], data) -> list[tuple]:
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted((tuple(plain(r[i]) for i in order) for r in data), key=repr)


def duck(sf_dir: str, sql: str, tables: dict[str, str] | None = None) -> tuple[list[str], list[tuple]]:
    con = duckdb.connect()
    for p in Path(sf_dir).glob("*.parquet"):
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM read_parquet('{p}{'/*.parquet' if p.is_dir() else ''}')")
    for name, path in (tables or {}).items():
        con.execute(f"CREATE OR REPLACE VIEW {name} AS SELECT * FROM read_parquet('{path}/*.parquet')")
    cur = con.execute(sql)
    return [d[0] for d in cur.description], cur.fetchall()


def compare(df, sf_dir: str, sql: str, tables: dict[str, str] | None = None) -> tuple[int, int, list]:
    """Rows of either side, and the first few that only one has."""
    mine = rows(df.columns, df.collect())
    names, data = duck(sf_dir, sql, tables)
    assert sorted(names) == sorted(df.columns), (sorted(names), sorted(df.columns))
    other = rows(names, data)
    if mine == other:
        return len(mine), len(other), []
    a, b = set(mine), set(other)
    return len(mine), len(other), [*[("spark", r) for r in sorted(a - b, key=repr)[:3]], *[("sql", r) for r in sorted(b - a, key=repr)[:3]], ("counts",)]


def main() -> None:
    from pyspark.sql import SparkSession

    import __spark_entry__ as entry

    args = sys.argv[1:]
    sf = args.pop(args.index("--sf") + 1) if "--sf" in args else "/root/testdata/sf0.01"
    names = [a for a in args if a != "--sf"]
    spark = SparkSession.builder.master("local[2]").config("spark.sql.shuffle.partitions", "8").config("spark.ui.enabled", "false").config("spark.driver.memory", "6g").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    queries, sql = entry.queries(), entry.oracle_sql()
    names = [q for n in names for q in queries if q.startswith(n)] or list(queries)
    for name in names:
        t = time.time()
        try:
            if name in sql:
                n, m, off = compare(queries[name](spark, sf), sf, sql[name])
                print("ok " if not off else "OFF", name, n, m, f"{time.time() - t:.1f}s", *off, flush=True)
            else:
                print("-- ", name, queries[name](spark, sf).count(), f"{time.time() - t:.1f}s", flush=True)
        except Exception as e:
            print("ERR", name, str(e)[:1500], flush=True)


if __name__ == "__main__":
    main()
