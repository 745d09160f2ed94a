"""Run registered queries against their SQL twins: python -m aerolattice.catalog.compare [names...]."""

from __future__ import annotations

import math
import os
import sys
import time

import duckdb

from aerolattice.catalog import load_all
from aerolattice.runtime import local_session

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def open_oracle(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{sf_dir}/{name}.parquet')")
    return con


def _plain(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else repr(value + 0.0)
    return str(value)


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(_plain(row[i]) for i in order) for row in rows), [columns[i] for i in order]


def main(names: list[str]) -> int:
    queries, oracles = load_all()
    sf_dir = os.environ.get("SF_DIR", "/root/testdata/sf0.01")
    spark = local_session()
    spark.sparkContext.setLogLevel("ERROR")
    con = open_oracle(sf_dir)
    failed = 0
    for name in names or list(queries):
        started = time.time()
        try:
            got = queries[name](spark, sf_dir)
            have, columns = rows_of(got.columns, got.collect())
        except Exception as error:  # report and go on to the next query
            failed += 1
            print(f"ERROR {name}: {str(error)[:1500]}")
            continue
        took = time.time() - started
        if name not in oracles:
            print(f"rows  {name}: {len(have)} rows, {took:.1f}s")
            continue
        try:
            started = time.time()
            result = con.execute(oracles[name])
            want, expected = rows_of([d[0] for d in result.description], result.fetchall())
        except Exception as error:
            failed += 1
            print(f"SQLERR {name}: {str(error)[:1500]}")
            continue
        kinds = dict(got.dtypes)
        if have == want and columns == expected and have:
            print(f"ok    {name}: {len(have)} rows, {took:.1f}s, sql {time.time() - started:.1f}s")
        else:
            failed += 1
            print(f"DIFF  {name}: {len(have)} vs {len(want)} rows; {columns} vs {expected}; {kinds}")
            extra = [row for row in have if row not in set(want)][:3]
            missing = [row for row in want if row not in set(have)][:3]
            print("   spark only:", extra, "\n   sql only:  ", missing)
    print("failed:", failed)
    return failed


if __name__ == "__main__":
    sys.exit(1 if main(sys.argv[1:]) else 0)
