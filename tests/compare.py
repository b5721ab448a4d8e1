"""Run registered queries next to their SQL counterparts and compare.

    python tests/compare.py [--sf 0.01] [--cores 8] [name-substring ...]
"""

from __future__ import annotations

import argparse
import math
import os
import sys
import time
import traceback

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

import duckdb  # noqa: E402

TABLES = (
    "region nation customer supplier part orders lineitem events documents "
    "embeddings pages benchmark labels conversations"
).split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def _cell(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else repr(v + 0.0 if v else 0.0)
    return v if v is None else str(v)


def _canonical(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in order], sorted(
        (tuple(_cell(r[i]) for i in order) for r in rows), key=lambda r: tuple((c is None, str(c)) for c in r)
    )


SPARK_TO_DUCK = {"bigint": "BIGINT", "string": "VARCHAR", "double": "DOUBLE", "int": "INTEGER", "boolean": "BOOLEAN", "timestamp": "TIMESTAMP"}


def compare(spark, con, name, fn, sql, sf_dir) -> str | None:
    """None when equal, else a description of the difference."""
    df = fn(spark, sf_dir)
    got_cols, got = _canonical(df.columns, df.collect())
    if sql is None:
        return None if got else "no rows"
    res = con.execute(sql)
    cols = [d[0] for d in res.description]
    want_types = {d[0]: str(d[1]) for d in res.description}
    want_cols, want = _canonical(cols, res.fetchall())
    if got_cols != want_cols:
        return f"columns {got_cols} vs {want_cols}"
    for c, t in df.dtypes:
        if SPARK_TO_DUCK.get(t, t) != want_types[c]:
            return f"type of {c}: {t} vs {want_types[c]}"
    if len(got) != len(want):
        return f"rows {len(got)} vs {len(want)}"
    bad = [(g, w) for g, w in zip(got, want) if g != w]
    if bad:
        return f"{len(bad)} of {len(got)} rows differ; first: {bad[0][0]} vs {bad[0][1]}"
    return None if got else "no rows on either side"


def main() -> int:
    ap = argparse.ArgumentParser()
    ap.add_argument("--sf", default="0.01")
    ap.add_argument("--cores", default="8")
    ap.add_argument("names", nargs="*")
    args = ap.parse_args()
    import __spark_entry__ as entry
    from bitextspark.session import local_session

    spark = local_session(args.cores)
    sf_dir = f"/root/testdata/sf{args.sf}"
    con = connect(sf_dir)
    oracles = entry.oracle_sql()
    failed = 0
    for name, fn in entry.queries().items():
        if args.names and not any(n in name for n in args.names):
            continue
        t0 = time.time()
        try:
            problem = compare(spark, con, name, fn, oracles.get(name), sf_dir)
        except Exception as e:  # noqa: BLE001 - report and go on
            problem = "".join(traceback.format_exception_only(type(e), e))[:1500]
        failed += problem is not None
        kind = "" if name in oracles else " (no SQL)"
        print(f"{'FAIL' if problem else 'ok  '} {name}{kind} {time.time() - t0:.1f}s {problem or ''}", flush=True)
    print("failed:", failed)
    return failed


if __name__ == "__main__":
    sys.exit(1 if main() else 0)
