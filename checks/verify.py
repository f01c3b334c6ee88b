"""Run queries in Spark and DuckDB and compare: python -m checks.verify SF_DIR [name prefix ...]"""

from __future__ import annotations

import glob
import os
import sys
import time

import duckdb
from pyspark.sql import SparkSession

from .queries import ORACLE, QUERIES


def session(cores: str = "8") -> SparkSession:
    spark = (SparkSession.builder.master(f"local[{cores}]").config("spark.sql.shuffle.partitions", "8")
             .config("spark.driver.memory", "12g").config("spark.ui.enabled", "false")
             .config("spark.sql.session.timeZone", "UTC")
             .config("spark.ui.showConsoleProgress", "false").getOrCreate())
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def main(sf: str, prefixes: list[str]) -> int:
    spark = session()
    connection = duckdb.connect()
    for path in glob.glob(f"{sf}/*.parquet"):
        name = os.path.basename(path).removesuffix(".parquet")
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM '{path}'")
    bad = 0
    for name, query in QUERIES.items():
        if prefixes and not any(name.startswith(p) for p in prefixes):
            continue
        try:
            start = time.time()
            frame = query(spark, sf)
            columns = sorted(frame.columns)
            left = sorted(map(repr, (tuple(r) for r in frame.select(*[f"`{c}`" for c in columns]).collect())))
            spent = time.time() - start
            if name not in ORACLE:
                print(f"{name}: rows {len(left)} ({spent:.1f}s) no SQL", flush=True)
                continue
            start = time.time()
            result = connection.execute(ORACLE[name])
            names = [d[0] for d in result.description]
            order = sorted(range(len(names)), key=lambda i: names[i])
            right = sorted(repr(tuple(r[i] for i in order)) for r in result.fetchall())
            same = left == right and columns == sorted(names)
            print(f"{'ok  ' if same else 'DIFF'} {name}: {len(left)}/{len(right)} spark {spent:.1f}s "
                  f"duckdb {time.time() - start:.1f}s", flush=True)
            if not same:
                bad += 1
                if columns != sorted(names):
                    print("   columns", set(columns) ^ set(names))
                a, b = set(left) - set(right), set(right) - set(left)
                print("   only spark", len(a), [v[:700] for v in sorted(a)[:1]])
                print("   only sql  ", len(b), [v[:700] for v in sorted(b)[:1]])
        except Exception as error:  # noqa: BLE001 - a report, not a program
            bad += 1
            print(f"FAIL {name}: {str(error)[:500]}", flush=True)
    print("bad:", bad)
    return bad


if __name__ == "__main__":
    sys.exit(1 if main(sys.argv[1], sys.argv[2:]) else 0)
