"""Side-by-side comparison of registered queries and their DuckDB oracles.

Run as a script: python tests/compare.py SF_DIR [query ...]
"""

from __future__ import annotations

import datetime as dt
import math
import sys
import time
from collections import Counter
from pathlib import Path

import duckdb

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def duck(sf_dir: str):
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return con


def plain(value):
    if isinstance(value, float) and math.isnan(value):
        return "NaN"
    if isinstance(value, dt.datetime):
        return value.isoformat()
    return value


def compare(spark, con, sf_dir: str, query, sql: str) -> tuple[bool, str]:
    df = query(spark, sf_dir)
    names = sorted(df.columns)
    ours = Counter(tuple(plain(v) for v in r) for r in df.select(*names).collect())
    result = con.execute(sql)
    theirs_names = [d[0] for d in result.description]
    types = {d[0]: str(d[1]) for d in result.description}
    if sorted(theirs_names) != names:
        return False, f"columns {names} != {sorted(theirs_names)}"
    at = [theirs_names.index(n) for n in names]
    theirs = Counter(tuple(plain(row[i]) for i in at) for row in result.fetchall())
    kinds = {"bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR",
             "boolean": "BOOLEAN"}
    odd = [
        f"{n}: {t} vs {types[n]}" for n, t in df.dtypes
        if kinds.get(t, t) != types[n] and not (types[n] == "NULL")
    ]
    only_ours, only_theirs = ours - theirs, theirs - ours
    note = f"rows {sum(ours.values())} {odd or ''}"
    if only_ours or only_theirs:
        return False, (
            f"{note} names {names}; ours only {sum(only_ours.values())}: {list(only_ours)[:2]}; "
            f"oracle only {sum(only_theirs.values())}: {list(only_theirs)[:2]}"
        )
    return not odd, note


def main() -> None:
    from boxlake.plans.queries import ORACLES, QUERIES
    from boxlake.session import local_session

    sf_dir, wanted = sys.argv[1], sys.argv[2:] or list(QUERIES)
    spark = local_session("8")
    con = duck(sf_dir)
    failed = []
    for name in wanted:
        start = time.time()
        try:
            if name in ORACLES:
                ok, note = compare(spark, con, sf_dir, QUERIES[name], ORACLES[name])
            else:
                ok, note = True, f"rows {QUERIES[name](spark, sf_dir).count()} (no oracle)"
        except Exception as error:  # noqa: BLE001 - report and go on
            ok, note = False, f"{type(error).__name__}: {str(error)[:600]}"
        print(f"{'ok  ' if ok else 'FAIL'} {name} {time.time() - start:.1f}s {note}", flush=True)
        if not ok:
            failed.append(name)
    print("failed:", failed)


if __name__ == "__main__":
    main()
