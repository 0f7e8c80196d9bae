"""Run every query beside its SQL twin and compare names, counts and values.

    python -m checks.compare [sf_dir] [query ...]
"""

from __future__ import annotations

import importlib
import sys
import time

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def connect(sf_dir: str):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def rows_of(records, columns) -> tuple[list[str], list[tuple]]:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    rows = [tuple(r[i] for i in order) for r in records]
    return [columns[i] for i in order], sorted(rows, key=repr)


def compare(spark, con, sf_dir: str, name: str, query, sql: str | None) -> str:
    df = query(spark, sf_dir)
    names, mine = rows_of([tuple(r) for r in df.collect()], df.columns)
    if sql is None:
        return f"rows only: {len(mine)}"
    cur = con.execute(sql)
    columns = [d[0] for d in cur.description]
    twin_names, twin = rows_of(cur.fetchall(), columns)
    if names != twin_names:
        return f"NAMES {names} / {twin_names}"
    if len(mine) != len(twin):
        return f"COUNT {len(mine)} / {len(twin)}"
    different = [(a, b) for a, b in zip(mine, twin) if a != b]
    if different:
        a, b = different[0]
        parts = [(n, str(x)[-200:], str(y)[-200:]) for n, x, y in zip(names, a, b) if x != y]
        return f"VALUES {len(different)} of {len(mine)} rows, first: {parts}"
    kinds = [
        (n, type(x).__name__, type(y).__name__)
        for n, x, y in zip(names, *(mine[0], twin[0]))
        if type(x) is not type(y)
    ] if mine else []
    return f"ok {len(mine)}" + (f" TYPES {kinds}" if kinds else "")


def main() -> None:
    from veilwork.session import local_session

    sf_dir = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    wanted = sys.argv[2:]
    entry = importlib.import_module("__spark_entry__")
    spark = local_session(8)
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(sf_dir)
    sqls = entry.oracle_sql()
    for name, query in entry.queries().items():
        if wanted and name not in wanted:
            continue
        started = time.time()
        try:
            verdict = compare(spark, con, sf_dir, name, query, sqls.get(name))
        except Exception as error:
            verdict = f"ERROR {type(error).__name__} {str(error)[:600]}"
        print(f"{name:22s} {time.time() - started:6.2f}s  {verdict}", flush=True)
    spark.stop()


if __name__ == "__main__":
    main()
