"""Compare registered queries with their SQL twins: python check_queries.py SF_DIR [name ...]"""

from __future__ import annotations

import sys
import time

import duckdb
import pandas as pd

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels "
          "conversations").split()  # fmt: skip


def connect(sf_dir: str):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def normal(df: pd.DataFrame) -> list[tuple]:
    columns = sorted(df.columns)

    def value(x):
        if x is None or x is pd.NA or (isinstance(x, float) and x != x) or x is pd.NaT:
            return "null"
        if isinstance(x, bool) or type(x).__name__ == "bool_":
            return str(bool(x))
        if isinstance(x, (int, float)) or hasattr(x, "dtype"):
            return repr(float(x) + 0.0)
        return str(x)

    return sorted(tuple(value(x) for x in row) for row in df[columns].astype(object).itertuples(index=False))


def compare(spark, con, name: str, query, sql: str | None, sf_dir: str) -> tuple[bool, str]:
    start = time.time()
    got = query(spark, sf_dir).toPandas()
    took = time.time() - start
    if sql is None:
        return True, f"rows only, {len(got)} rows, {took:.1f}s"
    want = con.execute(sql).df()
    if sorted(got.columns) != sorted(want.columns):
        return False, f"columns {sorted(got.columns)} != {sorted(want.columns)}"
    a, b = normal(got), normal(want)
    if a != b:
        diff = [(x, y) for x, y in zip(a, b) if x != y][:3]
        only = sorted(set(a) - set(b))[:3], sorted(set(b) - set(a))[:3]
        return False, f"{len(a)} vs {len(b)} rows; first differences {diff or only}"
    kinds = [f"{c}: {got[c].dtype}/{want[c].dtype}" for c in got.columns if got[c].dtype.kind != want[c].dtype.kind]
    return True, f"{len(a)} rows, {took:.1f}s{' kinds differ ' + str(kinds) if kinds else ''}"


def main() -> int:
    from fareloom import build_session, catalog

    sf_dir, chosen = sys.argv[1], sys.argv[2:]
    spark = build_session("check", "local[8]", **{
        "spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false", "spark.driver.memory": "12g", "spark.sql.shuffle.partitions": "8",
    })
    spark.sparkContext.setLogLevel("ERROR")
    con, sqls, bad = connect(sf_dir), catalog.oracle_sql(), 0
    for name, query in catalog.queries().items():
        if chosen and not any(name.startswith(c) for c in chosen):
            continue
        try:
            ok, note = compare(spark, con, name, query, sqls.get(name), sf_dir)
        except Exception as error:  # one broken query must not hide the others
            ok, note = False, f"{type(error).__name__}: {str(error)[:600]}"
        bad += not ok
        print(f"{'ok  ' if ok else 'FAIL'} {name}: {note}", flush=True)
    return bad


if __name__ == "__main__":
    sys.exit(main())
