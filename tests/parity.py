"""Compare a registered query with its SQL on the same tables.

    python tests/parity.py [sf dir] [query name or prefix ...]
"""

from __future__ import annotations

import datetime
import math
import sys
import time
from collections import Counter
from pathlib import Path

import duckdb

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings "
    "pages benchmark labels conversations"
).split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def cell(v):
    if isinstance(v, bool) or v is None or isinstance(v, str):
        return v
    if isinstance(v, float):
        return "nan" if math.isnan(v) else (int(v) if v.is_integer() else round(v, 9))
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None).isoformat()
    return v


def rows_of(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return Counter(tuple(cell(r[i]) for i in order) for r in rows), [names[i] for i in order]


def kind(t: str) -> str:
    t = t.lower()
    for k, words in {
        "int": ("int", "long", "short", "hugeint"), "str": ("string", "varchar"), "float": ("double", "float", "decimal"),
        "bool": ("bool",), "time": ("timestamp",), "date": ("date",),
    }.items():
        if any(w in t for w in words):
            return k
    return t


def compare(spark, con, sf_dir, name, fn, sql):
    """None when equal, else a message."""
    df = fn(spark, sf_dir)
    got, names = rows_of(df.columns, [tuple(r) for r in df.collect()])
    if sql is None:
        return None if got else "no rows"
    res = con.execute(sql)
    cols = [d[0] for d in res.description]
    want, want_names = rows_of(cols, res.fetchall())
    if names != want_names:
        return f"columns {names} vs {want_names}"
    types = {f.name: kind(f.dataType.simpleString()) for f in df.schema}
    sql_types = {d[0]: kind(str(d[1])) for d in res.description}
    bad = {c: (types[c], sql_types[c]) for c in types if types[c] != sql_types[c]}
    if bad:
        return f"types {bad}"
    if got != want:
        extra, missing = list((got - want).items())[:3], list((want - got).items())[:3]
        return f"{sum(got.values())} vs {sum(want.values())} rows\n   spark only {str(extra)[:700]}\n   sql only   {str(missing)[:700]}"
    return None if want else "both empty"


def main():
    from __spark_entry__ import oracle_sql, queries
    from patchloom.session import local_session

    args = sys.argv[1:]
    sf_dir = args[0] if args else "/root/testdata/sf0.001"
    picks = args[1:]
    spark = local_session()
    con = connect(sf_dir)
    oracle = oracle_sql()
    failed = 0
    chosen = {n: f for n, f in queries().items() if not picks or any(n == p or n.startswith(p + "*") or (p.endswith("*") and n.startswith(p[:-1])) for p in picks)}
    for name, fn in chosen.items():
        start = time.time()
        try:
            msg = compare(spark, con, sf_dir, name, fn, oracle.get(name))
        except Exception as e:  # noqa: BLE001
            msg = f"{type(e).__name__}: {str(e)[:1200]}"
        if msg:
            failed += 1
        print(f"{chr(70)+chr(65)+chr(73)+chr(76) if msg else 'ok  '} {name:28s} {time.time() - start:6.2f}s {'' if name in oracle else '(rows only)'} {msg or ''}", flush=True)
    print(f"{len(chosen) - failed} of {len(chosen)} ok")


if __name__ == "__main__":
    main()
