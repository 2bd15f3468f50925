"""Run registered queries in Spark and their SQL oracle in DuckDB and compare
row count, column names and an order-insensitive multiset of values."""

from __future__ import annotations

import math
import sys
import time

import duckdb

TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
          "documents", "embeddings", "pages", "benchmark", "labels", "conversations"]


def duck(sf_dir: str):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def _norm(v):
    if v is None:
        return None
    if isinstance(v, float):
        if math.isnan(v):
            return None
        if math.isinf(v):
            return v
        return round(v, 6)
    if hasattr(v, "item"):
        return _norm(v.item())
    if isinstance(v, (list, tuple)):
        return tuple(_norm(x) for x in v)
    return v


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    out = [tuple(_norm(r[i]) for i in order) for r in rows]
    return [columns[i] for i in order], sorted(out, key=repr)


SPARK_TYPES = {"int": "INTEGER", "bigint": "BIGINT", "double": "DOUBLE", "string": "VARCHAR",
               "boolean": "BOOLEAN", "smallint": "SMALLINT", "float": "FLOAT"}


def type_mismatches(sdf, description):
    """Columns whose Spark type and DuckDB type differ (by name)."""
    s = {c: SPARK_TYPES.get(t, t.upper()) for c, t in sdf.dtypes}
    d = {x[0]: str(x[1]).upper() for x in description}
    return sorted((c, s[c], d.get(c)) for c in s if c in d and s[c] != d[c])


def compare(spark, name, fn, sql, sf_dir, con=None):
    con = con or duck(sf_dir)
    t0 = time.time()
    sdf = fn(spark, sf_dir)
    s_rows = [tuple(r) for r in sdf.collect()]
    t1 = time.time()
    cur = con.execute(sql)
    d_cols = [d[0] for d in cur.description]
    d_rows = cur.fetchall()
    sc, sr = rows_of(sdf.columns, s_rows)
    dc, dr = rows_of(d_cols, d_rows)
    types = type_mismatches(sdf, cur.description)
    ok = sc == dc and len(sr) == len(dr) and sr == dr and not types
    detail = f"types {types}" if types else ""
    if not ok and not types:
        if sc != dc:
            detail = f"columns {sc} vs {dc}"
        elif len(sr) != len(dr):
            detail = f"rows {len(sr)} vs {len(dr)}"
        else:
            diff = [(a, b) for a, b in zip(sr, dr) if a != b][:3]
            detail = f"values differ, e.g. {diff}"
    return ok, len(sr), t1 - t0, detail


def main(argv):
    sys.path.insert(0, ".")
    import __spark_entry__ as E
    from corpusflow.session import get_spark
    sf_dir = "/root/testdata/sf0.01"
    spark = get_spark()
    qs, sql = E.queries(), E.oracle_sql()
    names = argv or list(qs)
    con = duck(sf_dir)
    bad = 0
    for n in names:
        if n not in sql:
            df = qs[n](spark, sf_dir)
            print(f"{n:32s} rows-only {df.count()}")
            continue
        try:
            ok, nrows, secs, detail = compare(spark, n, qs[n], sql[n], sf_dir, con)
        except Exception as e:  # report and continue
            ok, nrows, secs, detail = False, -1, 0.0, f"ERROR {type(e).__name__}: {str(e)[:300]}"
        bad += not ok
        print(f"{n:32s} {'OK ' if ok else 'BAD'} rows={nrows} {secs:.2f}s {detail}")
    print("mismatches:", bad)


if __name__ == "__main__":
    main(sys.argv[1:])
