"""Run registered queries beside their checking SQL: ``python tests/compare.py 0.01 [name ...]``."""

from __future__ import annotations

import math
import os
import sys
import time

import duckdb

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def sf_dir(sf: str) -> str:
    return f"/root/testdata/sf{sf}"


def norm(v):
    if isinstance(v, bool) or v is None:
        return v
    if isinstance(v, (int, float)) or type(v).__name__ == "Decimal":
        f = float(v)
        return None if math.isnan(f) else round(f, 9)
    return str(v)


def table(rows, cols):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    return [cols[i] for i in order], sorted((tuple(norm(r[i]) for i in order) for r in rows), key=repr)


def run_oracle(sql: str, sf: str):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir(sf)}/{t}.parquet'")
    cur = con.execute(sql)
    cols = [d[0] for d in cur.description]
    return table(cur.fetchall(), cols)


def run_spark(plan, spark, sf: str):
    df = plan(spark, sf_dir(sf))
    return table([tuple(r) for r in df.collect()], df.columns)


def differences(name, plan, sql, spark, sf):
    """'' when equal, else a short description."""
    got_cols, got = run_spark(plan, spark, sf)
    if sql is None:
        return ""
    want_cols, want = run_oracle(sql, sf)
    if got_cols != want_cols:
        return f"columns {got_cols} vs {want_cols}"
    if len(got) != len(want):
        a, b = set(map(repr, got)), set(map(repr, want))
        return f"{len(got)} rows vs {len(want)}; only spark {sorted(a - b)[:2]}; only sql {sorted(b - a)[:2]}"
    bad = [(g, w) for g, w in zip(got, want) if g != w]
    return f"{len(bad)} of {len(got)} rows differ, e.g. spark {bad[0][0]} sql {bad[0][1]}" if bad else ""


def main():
    from catalogspark import plans
    from catalogspark.session import build_session

    sf, names = sys.argv[1], sys.argv[2:]
    reg = plans.load_all()
    spark = build_session("local[8]", spark__ui__enabled="false", spark__sql__shuffle__partitions="8", spark__driver__memory="8g")
    spark.sparkContext.setLogLevel("OFF")
    bad = 0
    for name, plan in reg.QUERIES.items():
        if names and not any(name == n or (n.endswith("*") and name.startswith(n[:-1])) for n in names):
            continue
        t = time.time()
        try:
            msg = differences(name, plan, reg.ORACLES.get(name), spark, sf)
        except Exception as e:  # noqa: BLE001
            msg = f"{type(e).__name__}: {str(e)[:700]}"
        bad += bool(msg)
        print(f"{'FAIL' if msg else ('ok  ' if name in reg.ORACLES else 'ran ')} {name} {time.time() - t:.1f}s {msg}", flush=True)
    print(f"failures: {bad}")


if __name__ == "__main__":
    main()
