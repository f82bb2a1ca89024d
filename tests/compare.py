"""Runs a query and its oracle on the same tables and compares the rows."""

from __future__ import annotations

import math
import os
import sys
import time
from collections import Counter

import duckdb

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def connect(sf_dir: str):
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{sf_dir}/{name}.parquet')")
    return con


def _plain(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else value
    if isinstance(value, bool) or value is None:
        return value
    if isinstance(value, int):
        return float(value) if abs(value) < 2**53 else value
    if isinstance(value, (list, tuple)):
        return tuple(_plain(v) for v in value)
    return str(value)


def compare(spark, con, fn, sql: str, sf_dir: str) -> str | None:
    """None when the rows agree, otherwise what differs."""
    df = fn(spark, sf_dir)
    cols = sorted(df.columns)
    ours = Counter(tuple(_plain(r[c]) for c in cols) for r in df.collect())
    cur = con.execute(sql)
    names = [d[0] for d in cur.description]
    if sorted(names) != cols:
        return f"columns {cols} against {sorted(names)}"
    at = [names.index(c) for c in cols]
    theirs = Counter(tuple(_plain(r[i]) for i in at) for r in cur.fetchall())
    if ours == theirs:
        return None
    return (
        f"{sum(ours.values())} against {sum(theirs.values())} rows; columns {cols}\n"
        f"  only here: {list((ours - theirs).items())[:4]}\n  only oracle: {list((theirs - ours).items())[:4]}"
    )


def main(argv: list[str]) -> int:
    import __spark_entry__ as e
    from assay.session import build_session

    sf_dir = argv[1]
    wanted = argv[2:]
    spark = build_session("local[8]", **{"spark.sql.shuffle.partitions": "8", "spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false"})
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(sf_dir)
    queries, oracles = e.queries(), e.oracle_sql()
    bad = 0
    for name, fn in queries.items():
        if wanted and not any(w in name for w in wanted):
            continue
        start = time.time()
        try:
            if name in oracles:
                problem = compare(spark, con, fn, oracles[name], sf_dir)
                note = "ok" if problem is None else "DIFF " + problem
            else:
                note, problem = f"rows {fn(spark, sf_dir).count()}", None
        except Exception as ex:  # report and go on with the next query
            note, problem = f"FAIL {type(ex).__name__}: {str(ex)[:600]}", "error"
        bad += problem is not None
        print(f"{time.time() - start:6.2f}s {name}: {note}", flush=True)
    print("problems:", bad)
    return bad


if __name__ == "__main__":
    sys.exit(1 if main(sys.argv) else 0)
