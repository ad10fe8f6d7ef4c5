"""Run registered queries next to their DuckDB twins: `python tests/compare.py [sf] [name ...]`."""

from __future__ import annotations

import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


def connect(folder: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for table in TABLES:
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{folder}/{table}.parquet'")
    return con


def _norm(value):
    if isinstance(value, float):
        return round(value, 9)
    if isinstance(value, (list, tuple)):
        return tuple(_norm(v) for v in value)
    return value


def differences(spark, con, folder: str, run, oracle: str) -> list[str]:
    """What differs between the two results; empty if they agree on names and on rows as a bag."""
    df = run(spark, folder)
    cols = sorted(df.columns)
    mine = sorted((tuple(_norm(v) for v in row) for row in df.select(*cols).collect()), key=repr)
    cursor = con.execute(oracle)
    names = [d[0] for d in cursor.description]
    if sorted(names) != cols:
        return [f"columns {cols} != {sorted(names)}"]
    places = [names.index(c) for c in cols]
    theirs = sorted((tuple(_norm(row[i]) for i in places) for row in cursor.fetchall()), key=repr)
    if len(mine) != len(theirs):
        return [f"rows {len(mine)} != {len(theirs)}", str(mine[:3]), str(theirs[:3])]
    if not mine:
        return ["no rows at all"]
    return [f"{a} != {b}" for a, b in zip(mine, theirs) if a != b][:5]


def main() -> None:
    from codeskein.plans import suite_sources, suite_store  # noqa: F401
    from codeskein.plans.suite import SUITE
    from codeskein.session import local_session

    sf = sys.argv[1] if len(sys.argv) > 1 else "0.01"
    folder = f"/root/testdata/sf{sf}"
    spark, con = local_session("8"), connect(folder)
    names = sys.argv[2:] or list(SUITE)
    for name in names:
        item = SUITE[name]
        began = time.time()
        try:
            if item.oracle:
                bad = differences(spark, con, folder, item.run, item.oracle)
            else:
                bad = [] if item.run(spark, folder).count() else ["no rows"]
        except Exception as error:  # keep going: the point is the list of failures
            bad = [repr(error)[:1500]]
        print(f"{'ok  ' if not bad else 'FAIL'} {name} {time.time() - began:.2f}s", flush=True)
        for line in bad:
            print("     ", line, flush=True)


if __name__ == "__main__":
    main()
