"""Compare registered queries with their SQL in DuckDB.

    python -m tests.oracle [sf_dir] [name-part ...]
"""

from __future__ import annotations

import glob
import hashlib
import math
import os
import sys
import time

TESTDATA = os.environ.get("TESTDATA", "/root/testdata")


def cell(v) -> str:
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return "~"
    if isinstance(v, bool):
        return str(v)
    if isinstance(v, float):
        return repr(v)
    return str(v)


def digest(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    lines = sorted("\x1f".join(cell(row[i]) for i in order) for row in rows)
    return hashlib.sha256("\n".join(lines).encode()).hexdigest(), lines


def duck(sf_dir):
    import duckdb

    con = duckdb.connect()
    for f in glob.glob(f"{sf_dir}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    return con


def spark_rows(df):
    table = df.toArrow()
    return table.column_names, list(zip(*[c.to_pylist() for c in table.columns])) if table.num_columns else []


def duck_rows(con, sql):
    cursor = con.execute(sql)
    return [c[0] for c in cursor.description], [tuple(float(v) if type(v).__name__ == "Decimal" else v for v in t)
                                               for t in cursor.fetchall()]


def compare(spark, con, sf_dir, fn, sql):
    columns, rows = spark_rows(fn(spark, sf_dir))
    if sql is None:
        return ("rows" if rows else "EMPTY"), f"{len(rows)} rows"
    want_columns, want = duck_rows(con, sql)
    if sorted(columns) != sorted(want_columns):
        return "SCHEMA", f"{sorted(columns)} vs {sorted(want_columns)}"
    a, la = digest(columns, rows)
    b, lb = digest(want_columns, want)
    if a == b:
        return "ok", f"{len(rows)} rows"
    only = [x for x in la if x not in set(lb)][:2], [x for x in lb if x not in set(la)][:2]
    return "VALUES", f"{len(la)} vs {len(lb)} rows; {only}"


def main():
    from __spark_entry__ import oracle_sql, queries
    from cohortloom.runtime import local_session

    args = sys.argv[1:]
    sf_dir = args.pop(0) if args and os.path.isdir(args[0]) else f"{TESTDATA}/sf0.01"
    spark = local_session(8)
    spark.sparkContext.setLogLevel("ERROR")
    con, sqls, bad, spent = duck(sf_dir), oracle_sql(), [], {}
    for name, fn in queries().items():
        if args and not any(a in name for a in args):
            continue
        start = time.time()
        try:
            state, note = compare(spark, con, sf_dir, fn, sqls.get(name))
        except Exception as error:  # report and go on with the next query
            state, note = "ERROR", " ".join(str(error).split())[:300]
        spent[name] = time.time() - start
        if state not in ("ok", "rows"):
            bad.append(name)
            print(f"{state:7s} {spent[name]:6.2f}s {name}: {note}", flush=True)
        elif args:
            print(f"{state:7s} {spent[name]:6.2f}s {name}: {note}", flush=True)
    slow = sorted(spent.items(), key=lambda t: -t[1])[:12]
    print(f"{len(spent)} queries, {len(bad)} bad {bad}; {sum(spent.values()):.0f}s; slowest "
          + ", ".join(f"{n} {s:.1f}" for n, s in slow))


if __name__ == "__main__":
    main()
