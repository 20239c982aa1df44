"""Compare registered queries with their SQL counterparts."""

from __future__ import annotations

import math
import sys
import time

import duckdb

from larkspur.plans.views import TABLES


def connect(sf_dir: str):
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{sf_dir}/{name}.parquet')")
    return con


def plain(value):
    if value is None:
        return None
    if isinstance(value, bool):
        return value
    if isinstance(value, float):
        return "NaN" if math.isnan(value) else round(value, 6)
    if isinstance(value, int):
        return value
    if type(value).__name__ == "Decimal":
        return round(float(value), 6)
    return str(value)


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    made = [tuple(plain(r[i]) for i in order) for r in rows]
    return sorted(columns), sorted(made, key=repr)


# The type the other engine should report for a Spark type.
SAME_TYPES = {
    "bigint": "BIGINT", "int": "INTEGER", "string": "VARCHAR", "double": "DOUBLE", "boolean": "BOOLEAN",
    "date": "DATE", "timestamp_ntz": "TIMESTAMP",
}


def other_types(df, cur):
    """Columns whose types differ between the two sides."""
    theirs = {d[0]: str(d[1]) for d in cur.description}
    return {c: (t, theirs.get(c)) for c, t in df.dtypes if SAME_TYPES.get(t, t) != theirs.get(c)}


def compare(spark, con, name, fn, sql, sf_dir):
    """None when equal, else a short text."""
    df = fn(spark, sf_dir)
    got_cols, got = rows_of(df.columns, [tuple(r) for r in df.collect()])
    cur = con.execute(sql)
    want_cols, want = rows_of([d[0] for d in cur.description], cur.fetchall())
    types = other_types(df, cur)
    if got_cols != want_cols:
        return f"columns {got_cols} != {want_cols}"
    if types:
        return f"types {types}"
    if len(got) != len(want):
        return f"rows {len(got)} != {len(want)}"
    bad = [(g, w) for g, w in zip(got, want) if g != w]
    return f"{len(bad)} rows differ, first: {bad[0]}" if bad else None


if __name__ == "__main__":
    sys.path.insert(0, ".")
    import __spark_entry__ as entry
    from larkspur.session import build_session

    sf = sys.argv[1] if len(sys.argv) > 1 else "0.01"
    only = sys.argv[2:]
    sf_dir = f"/root/testdata/sf{sf}"
    spark = build_session("local[8]", **{"spark.sql.shuffle.partitions": "8", "spark.driver.memory": "8g"})
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(sf_dir)
    sqls = entry.oracle_sql()
    for name, fn in entry.queries().items():
        if only and not any(name.startswith(o) for o in only):
            continue
        start = time.time()
        try:
            if name in sqls:
                out = compare(spark, con, name, fn, sqls[name], sf_dir) or "ok"
            else:
                out = f"rows only: {fn(spark, sf_dir).count()}"
        except Exception as err:  # noqa: BLE001 - a report tool
            out = "ERROR " + str(err)[:700].replace("\n", " | ")
        print(f"{name:34s} {time.time() - start:6.2f}s {out}", flush=True)
