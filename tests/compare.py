"""Run registered queries against their DuckDB SQL: python -m tests.compare [prefix] [sf_dir]."""

import datetime
import decimal
import math
import sys
import time

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


def connect(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from read_parquet('{sf_dir}/{t}.parquet')")
    return con


def plain(v):
    if isinstance(v, float):
        if math.isnan(v):
            return "nan"
        return 0.0 if v == 0 else v
    if isinstance(v, decimal.Decimal):
        return ("dec", str(v))
    if isinstance(v, datetime.datetime):
        return ("ts", v.isoformat())
    if isinstance(v, (list, tuple)):
        return tuple(plain(i) for i in v)
    return v


def normalise(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(plain(row[i]) for i in order) for row in rows), key=repr), [columns[i] for i in order]


def kinds(rows):
    out = []
    for column in zip(*rows):
        out.append({type(v).__name__ for v in column if v is not None})
    return out


def close_enough(a, b):
    """Used for tests only: equal up to the last rounded digit."""
    if isinstance(a, float) and isinstance(b, float):
        return math.isclose(a, b, rel_tol=1e-9, abs_tol=2e-6)
    return a == b


def compare(df, con, sql):
    """Empty string when equal, else what differs."""
    got, names = normalise(df.columns, [tuple(x) for x in df.collect()])
    cur = con.execute(sql)
    want, want_names = normalise([c[0] for c in cur.description], cur.fetchall())
    if names != want_names:
        return f"columns {names} != {want_names}"
    if len(got) != len(want):
        return f"rows {len(got)} != {len(want)}"
    for name, a, b in zip(names, kinds(got), kinds(want)):
        if a != b:
            return f"type of {name}: {a} != {b}"
    bad = [(a, b) for a, b in zip(got, want) if a != b]
    if not bad:
        return ""
    per_column = [n for i, n in enumerate(names) if any(a[i] != b[i] for a, b in bad)]
    near = all(all(close_enough(u, v) for u, v in zip(a, b)) for a, b in bad)
    return f"{'NEAR ' if near else ''}{len(bad)}/{len(got)} rows differ in {per_column}: {bad[0]}"


def main(prefix="", sf_dir="/root/testdata/sf0.01"):
    from __spark_entry__ import oracle_sql, queries
    from tessera.session import local_session

    spark = local_session()
    spark.sparkContext.setLogLevel("OFF")
    con, sql, failed = connect(sf_dir), oracle_sql(), 0
    names = [n for n in queries() if any(n.lower().startswith(p) for p in prefix.lower().split(","))]
    for name in names:
        start = time.time()
        try:
            df = queries()[name](spark, sf_dir)
            if name in sql:
                message = compare(df, con, sql[name])
            else:
                count = df.count()
                message = "" if count else "no rows"
                print(f"rows-only {name}: {count}")
        except Exception as e:  # noqa: BLE001
            message = f"{type(e).__name__}: {str(e)[:600]}"
        took = time.time() - start
        if message:
            failed += 1
        if message or took > 4:
            print(f"{'FAIL' if message else 'slow'} {name} {took:.1f}s {message[:700]}", flush=True)
    print(f"{len(names) - failed}/{len(names)} ok")
    return failed


if __name__ == "__main__":
    sys.exit(bool(main(*sys.argv[1:])))
