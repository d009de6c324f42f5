"""Run queries and their oracle SQL side by side and compare the rows."""

from __future__ import annotations

import math
import sys
import time

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(folder: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"create view {name} as select * from read_parquet('{folder}/{name}.parquet')")
    return con


def cell(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else repr(value)
    if isinstance(value, bool):
        return str(value)
    return str(value) if value is not None else "~null"


def canonical(columns: list[str], rows) -> tuple[list[str], list[tuple]]:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in order], sorted(tuple(cell(r[i]) for i in order) for r in rows)


def differences(spark, folder: str, run, sql: str) -> list[str]:
    df = run(spark, folder)
    mine = canonical(df.columns, [tuple(r) for r in df.collect()])
    cursor = connect(folder).execute(sql)
    theirs = canonical([d[0] for d in cursor.description], cursor.fetchall())
    found = []
    if mine[0] != theirs[0]:
        return [f"columns {mine[0]} vs {theirs[0]}"]
    if len(mine[1]) != len(theirs[1]):
        found.append(f"rows {len(mine[1])} vs {len(theirs[1])}")
    for a, b in zip(mine[1], theirs[1]):
        if a != b:
            found.append(f"{a} vs {b}")
            if len(found) > 4:
                break
    kinds = {n: t for n, t in df.dtypes}
    loose = {"bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR", "boolean": "BOOLEAN"}
    for d in cursor.description:
        wanted = loose.get(kinds[d[0]])
        if wanted and str(d[1]) not in (wanted, "NUMBER", "STRING", "bool"):
            found.append(f"type of {d[0]}: {kinds[d[0]]} vs {d[1]}")
    return found


def main() -> None:
    from checks import all_entries
    from netweave.session import build_session

    folder, names = sys.argv[1], sys.argv[2:]
    entries = all_entries()
    spark = build_session("compare", "local[8]", **{"spark.sql.shuffle.partitions": "8", "spark.ui.enabled": "false", "spark.driver.memory": "8g"})
    spark.sparkContext.setLogLevel("ERROR")
    bad = 0
    for name, entry in entries.items():
        if names and name not in names and not any(n.endswith("*") and name.startswith(n[:-1]) for n in names):
            continue
        began = time.time()
        try:
            if entry.sql is None:
                found, rows = [], entry.run(spark, folder).count()
                print(f"rows {name}: {rows} ({time.time() - began:.1f}s)", flush=True)
                continue
            found = differences(spark, folder, entry.run, entry.sql)
        except Exception as problem:  # noqa: BLE001
            found = [f"{type(problem).__name__}: {str(problem)[:600]}"]
        bad += bool(found)
        print(f"{'BAD ' if found else 'ok  '} {name} ({time.time() - began:.1f}s)", flush=True)
        for line in found:
            print("     ", line[:700], flush=True)
    print("bad:", bad)
    spark.stop()


if __name__ == "__main__":
    main()
