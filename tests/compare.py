"""Runs a registered query in Spark and its SQL in DuckDB and compares the rows."""

from __future__ import annotations

import math
import os
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings "
          "pages benchmark labels conversations").split()


def duck(sf_dir: str):
    import duckdb

    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return con


def _norm(value):
    if value is None:
        return None
    if isinstance(value, float):
        return "nan" if math.isnan(value) else repr(value)
    if isinstance(value, bool):
        return str(value)
    if isinstance(value, int):
        return str(value)
    if isinstance(value, (list, tuple)):
        return str([_norm(v) for v in value])
    return str(value)


def normalise(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return (sorted(columns),
            sorted((tuple(_norm(r[i]) for i in order) for r in rows), key=lambda t: tuple(map(str, t))))


def compare(spark, con, sf_dir, query, sql):
    """(ok, message); values must match exactly, no tolerance."""
    t0 = time.time()
    df = query(spark, sf_dir)
    got_cols, got = normalise(df.columns, df.collect())
    t1 = time.time()
    rel = con.execute(sql)
    exp_cols, exp = normalise([d[0] for d in rel.description], rel.fetchall())
    t2 = time.time()
    took = f"{len(got)} rows, spark {t1 - t0:.1f}s, duckdb {t2 - t1:.1f}s"
    if got_cols != exp_cols:
        return False, f"columns {got_cols} != {exp_cols}"
    if len(got) != len(exp):
        return False, f"rows {len(got)} != {len(exp)}"
    bad = [(g, e) for g, e in zip(got, exp) if g != e]
    if bad:
        diff = [(c, g, e) for c, g, e in zip(got_cols, *bad[0]) if g != e]
        return False, f"{len(bad)} rows differ; first {bad[0][0][:3]} {diff}"
    return True, took


def main():
    import __spark_entry__ as entry
    from riskloom.session import build_session

    sf_dir = sys.argv[1]
    names = sys.argv[2:]
    spark = build_session("compare", f"local[{os.environ.get('COMPARE_CPUS', '8')}]", **{
        "spark.sql.shuffle.partitions": "8", "spark.driver.memory": "16g",
        "spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false"})
    spark.sparkContext.setLogLevel("ERROR")
    con = duck(sf_dir)
    queries, sqls = entry.queries(), entry.oracle_sql()
    failed = 0
    for name in names or queries:
        try:
            if name in sqls:
                ok, text = compare(spark, con, sf_dir, queries[name], sqls[name])
            else:
                t0 = time.time()
                n = queries[name](spark, sf_dir).count()
                ok, text = True, f"no oracle, {n} rows, {time.time() - t0:.1f}s"
        except Exception as exc:  # noqa: BLE001
            ok, text = False, f"{type(exc).__name__}: {str(exc)[:1500]}"
        failed += not ok
        print(("ok   " if ok else "FAIL "), name, "-", text, flush=True)
    print("failed:", failed)


if __name__ == "__main__":
    main()
