"""Local stand-in for the driver's correctness gate: run each registered
Spark query and its DuckDB oracle on the same parquet tables and compare
row count, column names/types and an order-insensitive value hash.

    python -m tests.oracle_check /root/testdata/sf0.01 [name ...]
"""

from __future__ import annotations

import datetime as dt
import hashlib
import math
import sys
import time

import duckdb
import pyarrow as pa


def _norm_type(t: pa.DataType) -> str:
    if pa.types.is_large_string(t) or pa.types.is_string(t):
        return "string"
    if pa.types.is_timestamp(t):
        return "timestamp"
    if pa.types.is_large_list(t) or pa.types.is_list(t):
        return f"list<{_norm_type(t.value_type)}>"
    return str(t)


def _cell(v):
    if v is None:
        return "<null>"
    if isinstance(v, float):
        if math.isnan(v):
            return "<nan>"
        return repr(round(v, 6) + 0.0)
    if isinstance(v, (dt.datetime, dt.date)):
        return v.isoformat()
    if isinstance(v, (list, tuple)):
        return "[" + ",".join(_cell(x) for x in v) + "]"
    if isinstance(v, dict):
        return "{" + ",".join(f"{k}:{_cell(x)}" for k, x in sorted(v.items())) + "}"
    return str(v)


def digest(tbl: pa.Table):
    cols = sorted(tbl.column_names)
    rows = list(zip(*[tbl.column(c).to_pylist() for c in cols])) if cols else []
    lines = sorted("\x1f".join(_cell(v) for v in r) for r in rows)
    h = hashlib.sha256("\n".join(lines).encode()).hexdigest()
    return cols, [_norm_type(tbl.schema.field(c).type) for c in cols], len(rows), h, lines


def duck(sf_dir: str) -> duckdb.DuckDBPyConnection:
    from filings_engine.sources.adapters import TABLES
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def main(argv):
    sf_dir = argv[1] if len(argv) > 1 else "/root/testdata/sf0.01"
    names = argv[2:]
    sys.path.insert(0, ".")
    import __spark_entry__ as E
    from filings_engine import build_session
    spark = build_session("local[8]", 8)
    qs, sql = E.queries(), E.oracle_sql()
    con = duck(sf_dir)
    bad = 0
    for name in (names or list(qs)):
        t0 = time.time()
        try:
            got = qs[name](spark, sf_dir).toArrow()
        except Exception as e:  # noqa: BLE001
            print(f"FAIL {name}: spark error {type(e).__name__}: {str(e)[:400]}")
            bad += 1
            continue
        t1 = time.time()
        if name not in sql:
            print(f"ROWS {name}: {got.num_rows} rows (no oracle) {t1 - t0:.1f}s")
            continue
        try:
            exp = con.sql(sql[name]).to_arrow_table()
        except Exception as e:  # noqa: BLE001
            print(f"FAIL {name}: oracle error {str(e)[:400]}")
            bad += 1
            continue
        g, o = digest(got), digest(exp)
        ok = g[0] == o[0] and g[2] == o[2] and g[3] == o[3]
        tmsg = "" if g[1] == o[1] else f" TYPES spark={g[1]} oracle={o[1]}"
        print(f"{'OK  ' if ok else 'FAIL'} {name}: rows {g[2]}/{o[2]} {t1 - t0:.1f}s{tmsg}")
        if not ok:
            bad += 1
            if g[0] != o[0]:
                print("   columns", g[0], o[0])
            else:
                sg, so = set(g[4]), set(o[4])
                for x in sorted(sg - so)[:3]:
                    print("   spark only :", x[:300])
                for x in sorted(so - sg)[:3]:
                    print("   oracle only:", x[:300])
    spark.stop()
    return bad


if __name__ == "__main__":
    sys.exit(1 if main(sys.argv) else 0)
