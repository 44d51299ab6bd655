"""Compare registered queries with their SQL: ``python -m trialscape.mart.check [-s DIR] [name ...]``."""

from __future__ import annotations

import argparse
import logging
import math
import time
from collections import Counter

import duckdb

from trialscape.mart import all_queries
from trialscape.session import local_session

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def plain(value):
    if value is None or (isinstance(value, float) and math.isnan(value)):
        return None
    if hasattr(value, "isoformat"):
        return value.isoformat()
    if isinstance(value, (list, tuple)):
        return tuple(plain(v) for v in value)
    return value


def duck(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def compare(spark, con, name: str, sf_dir: str) -> tuple[str, str]:
    queries, sql = all_queries()
    started = time.time()
    df = queries[name](spark, sf_dir)
    columns = sorted(df.columns)
    got = [tuple(plain(r[c]) for c in columns) for r in df.collect()]
    took = f"{time.time() - started:.1f}s {len(got)} rows"
    if name not in sql:
        return "rows", took
    cur = con.execute(sql[name])
    names = [d[0] for d in cur.description]
    if sorted(names) != columns:
        return "COLUMNS", f"{took} spark-only {set(columns) - set(names)} sql-only {set(names) - set(columns)}"
    order = [names.index(c) for c in columns]
    want = [tuple(plain(r[i]) for i in order) for r in cur.fetchall()]
    kinds = {c: f.dataType.simpleString() for c, f in zip(df.columns, df.schema.fields)}
    odd = {c: (kinds[c], str(cur.description[names.index(c)][1])) for c in columns}
    wrong = {
        c: v for c, v in odd.items()
        if ("INT" in v[1].upper() or "NUMBER" in v[1].upper()) and v[0] not in ("bigint", "int", "double", "smallint", "tinyint")
    }
    a, b = Counter(got), Counter(want)
    if a == b:
        types = [(set(map(type, c)) - {type(None)}) for c in zip(*got)] if got else []
        wtypes = [(set(map(type, c)) - {type(None)}) for c in zip(*want)] if want else []
        clash = [(columns[i], t, w) for i, (t, w) in enumerate(zip(types, wtypes)) if t != w]
        if clash:
            return "TYPES", f"{took} {clash[:3]}"
        return ("EMPTY" if not got else "ok"), took + (f" {wrong}" if wrong else "")
    lines = [f"{took} spark {len(got)} sql {len(want)}"]
    only, other = list((a - b).elements()), list((b - a).elements())
    key = lambda r: [str(x) for x in r]
    for x, y in list(zip(sorted(only, key=key), sorted(other, key=key)))[:2]:
        lines.append("   " + str({c: (p, q) for c, p, q in zip(columns, x, y) if p != q})[:700])
    if len(only) != len(other):
        lines.append(f"   only spark {only[:1]}\n   only sql {other[:1]}")
    return "DIFF", "\n".join(lines)


def main() -> int:
    parser = argparse.ArgumentParser()
    parser.add_argument("-s", "--sf-dir", default="/root/testdata/sf0.01")
    parser.add_argument("names", nargs="*")
    args = parser.parse_args()
    spark = local_session("8")
    logging.disable(logging.CRITICAL)
    spark.sparkContext.setLogLevel("OFF")
    con = duck(args.sf_dir)
    queries, _ = all_queries()
    bad = 0
    for name in queries:
        if args.names and not any(name == n or (n.endswith("*") and name.startswith(n[:-1])) for n in args.names):
            continue
        try:
            state, detail = compare(spark, con, name, args.sf_dir)
        except Exception as problem:  # noqa: BLE001 - the report goes on with the next query
            state, detail = "ERROR", f"{type(problem).__name__}: {str(problem)[:900]}"
        bad += state not in ("ok", "rows")
        print(f"{state:8}{name:34}{detail}", flush=True)
    print("not ok:", bad)
    return bad


if __name__ == "__main__":
    raise SystemExit(main())
