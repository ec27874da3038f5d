"""Run registered queries and their check SQL side by side."""

from __future__ import annotations

import math
import time


def duck(sf_dir: str):
    import duckdb

    from mailglass.plans.bindings import TABLES

    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return con


KINDS = {"bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR", "boolean": "BOOLEAN",
         "date": "DATE", "timestamp": "TIMESTAMP", "timestamp_ntz": "TIMESTAMP", "float": "FLOAT"}


def _canon(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else repr(round(value, 6) + 0.0)
    return repr(value)


def check(spark, con, name, function, sql, sf_dir):
    """None when equal, else a message."""
    start = time.time()
    df = function(spark, sf_dir)
    rows = df.collect()
    took = time.time() - start
    if sql is None:
        return None if rows else "no rows", took, len(rows)
    result = con.execute(sql)
    names = [c[0] for c in result.description]
    kinds = [str(c[1]) for c in result.description]
    expected = result.fetchall()
    if sorted(names) != sorted(df.columns):
        return f"columns {sorted(df.columns)} != {sorted(names)}", took, len(rows)
    spark_kinds = {f.name: KINDS.get(f.dataType.simpleString(), f.dataType.simpleString()) for f in df.schema}
    wrong = [(n, spark_kinds[n], k) for n, k in zip(names, kinds) if spark_kinds[n] != k]
    order = sorted(names)
    a = sorted(tuple(_canon(r[c]) for c in order) for r in rows)
    index = [names.index(c) for c in order]
    b = sorted(tuple(_canon(r[i]) for i in index) for r in expected)
    if len(a) != len(b):
        only_a, only_b = set(a) - set(b), set(b) - set(a)
        return f"rows {len(a)} != {len(b)} {str(sorted(only_a)[:1])[:700]} / {str(sorted(only_b)[:1])[:700]}", took, len(rows)
    for x, y in zip(a, b):
        if x != y:
            diffs = [(c, p, q) for c, p, q in zip(order, x, y) if p != q]
            bad = sum(1 for p, q in zip(a, b) if p != q)
            return f"{bad} rows differ, e.g. {str(diffs)[:900]} in {str(x)[:300]}", took, len(rows)
    if wrong:
        return f"types {wrong}", took, len(rows)
    return None, took, len(rows)


if __name__ == "__main__":
    import os
    import sys

    sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    import __spark_entry__ as entry

    from mailglass.session import get_session

    sf = sys.argv[1]
    wanted = sys.argv[2:]
    session = get_session(master="local[8]", **{
        "spark.sql.shuffle.partitions": "8", "spark.ui.enabled": "false", "spark.driver.memory": "12g",
        "spark.ui.showConsoleProgress": "false",
        # -1 sends every lookup down the salted path
        "spark.sql.autoBroadcastJoinThreshold": os.environ.get("BROADCAST", "10485760")})
    session.sparkContext.setLogLevel("ERROR")
    queries, oracles = entry.queries(), entry.oracle_sql()
    engine = duck(sf)
    failed = 0
    for key, fn in queries.items():
        if wanted and not any(key.startswith(w) for w in wanted):
            continue
        try:
            message, took, n = check(session, engine, key, fn, oracles.get(key), sf)
        except Exception as error:  # keep going, this is a report
            message, took, n = f"{type(error).__name__}: {str(error)[:900]}", 0.0, -1
        failed += message is not None
        print(f"{'ok  ' if message is None else 'FAIL'} {key:32s} rows={n} {took:.2f}s {'' if key in oracles else '(rows only)'} {message or ''}", flush=True)
    print("failed:", failed)
