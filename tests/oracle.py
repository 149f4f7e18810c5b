"""Run registered queries and their checking SQL side by side."""

from __future__ import annotations

import math
import sys
import time

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents "
    "embeddings pages benchmark labels conversations"
).split()

SAME_TYPE = {
    "bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR",
    "boolean": "BOOLEAN", "timestamp_ntz": "TIMESTAMP", "date": "DATE",
}


def duck(sf_dir: str):
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def cell(v):
    if v is None:
        return None
    if isinstance(v, float):
        return "nan" if math.isnan(v) else repr(v + 0.0)
    return str(v)


def rows(names, data):
    order = sorted(range(len(names)), key=lambda i: names[i])
    out = [tuple(cell(r[i]) for i in order) for r in data]
    return sorted(out, key=lambda r: tuple((x is None, x or "") for x in r))


def compare(name, spark, sf_dir, con, queries, oracle):
    start = time.time()
    df = queries[name](spark, sf_dir)
    got = [tuple(r) for r in df.collect()]
    spent = time.time() - start
    if name not in oracle:
        return f"rows {len(got)}", spent, len(got) >= 0
    rel = con.execute(oracle[name])
    want_types = {d[0]: str(d[1]) for d in rel.description}
    want = rel.fetchall()
    types = {n: SAME_TYPE.get(t, t) for n, t in df.dtypes}
    problems = []
    if set(types) != set(want_types):
        problems.append(f"columns {sorted(types)} vs {sorted(want_types)}")
    else:
        real = {r[0]: r[1] for r in con.execute(f"DESCRIBE {oracle[name]}").fetchall()}
        odd = {c: (types[c], real[c]) for c in types if types[c] != real[c]}
        if odd:
            problems.append(f"types {odd}")
        a, b = rows(list(df.columns), got), rows(list(want_types), want)
        if len(a) != len(b):
            problems.append(f"row count {len(a)} vs {len(b)}")
        elif a != b:
            diff = [(x, y) for x, y in zip(a, b) if x != y]
            problems.append(f"{len(diff)} of {len(a)} rows differ, first {diff[0]}")
    if not got:
        problems.append("no rows")
    return (f"ok {len(got)}" if not problems else "; ".join(problems)), spent, not problems


def main(argv):
    import os

    sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    import __spark_entry__ as e
    from pipewatch.session import local_session

    sf = argv[1] if len(argv) > 1 else "0.01"
    wanted = argv[2:]
    sf_dir = f"/root/testdata/sf{sf}"
    spark = local_session("oracle")
    queries, oracle = e.queries(), e.oracle_sql()
    con = duck(sf_dir)
    bad = 0
    for name in queries:
        if wanted and not any(name.startswith(w) for w in wanted):
            continue
        try:
            note, spent, ok = compare(name, spark, sf_dir, con, queries, oracle)
        except Exception as err:  # report and go on
            note, spent, ok = f"ERROR {type(err).__name__}: {str(err)[:1500]}", 0.0, False
        bad += not ok
        print(f"{'   ' if ok else '!! '}{name:38s} {spent:6.2f}s {note[:1800]}", flush=True)
    print(f"{len(queries)} queries, {len(oracle)} with SQL, {bad} bad")
    return bad


if __name__ == "__main__":
    sys.exit(1 if main(sys.argv) else 0)
