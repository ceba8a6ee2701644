"""Run registered queries and their SQL side by side and compare the rows."""

from __future__ import annotations

import sys
import time

import duckdb
import numpy as np
import pandas as pd

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


def connect(sf_dir: str):
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{sf_dir}/{name}.parquet')")
    return con


def rows_of(df: pd.DataFrame) -> list[tuple]:
    ordered = df[sorted(df.columns)]
    clean = ordered.astype(object).where(ordered.notna(), None)
    values = [tuple(_plain(v) for v in row) for row in clean.itertuples(index=False, name=None)]
    return sorted(values, key=lambda r: tuple((v is None, str(type(v)), v if v is not None else 0) for v in r))


def _plain(v):
    if v is None or (isinstance(v, float) and np.isnan(v)):
        return None
    if isinstance(v, (bool, np.bool_)):
        return bool(v)
    if isinstance(v, (int, np.integer)):
        return int(v)
    if isinstance(v, (float, np.floating)):
        return float(v) + 0.0
    return v


def differences(spark_df, sql: str, con) -> str | None:
    ours = spark_df.toPandas()
    theirs = con.execute(sql).df()
    if sorted(ours.columns) != sorted(theirs.columns):
        return f"columns {sorted(ours.columns)} != {sorted(theirs.columns)}"
    a, b = rows_of(ours), rows_of(theirs)
    if len(a) != len(b):
        return f"{len(a)} rows != {len(b)}"
    wrong = [(x, y) for x, y in zip(a, b) if x != y]
    return f"{len(wrong)} of {len(a)} rows differ, first: {wrong[0]}" if wrong else None


def types_of(spark_df, sql: str, con) -> list[str]:
    names = {"int": "INTEGER", "bigint": "BIGINT", "double": "DOUBLE", "string": "VARCHAR", "boolean": "BOOLEAN", "float": "FLOAT"}
    ours = {c: names.get(t, t) for c, t in spark_df.dtypes}
    theirs = {r[0]: str(r[1]) for r in con.execute(f"DESCRIBE {sql}").fetchall()}
    return [f"{c}: {t} != {theirs.get(c)}" for c, t in ours.items() if t != theirs.get(c)]


def main() -> None:
    import __spark_entry__ as entry
    from statloom.session import local_session

    sf_dir = sys.argv[1]
    chosen = sys.argv[2:]
    spark, con = local_session(), connect(sf_dir)
    spark.sparkContext.setLogLevel("ERROR")
    sqls = entry.oracle_sql()
    for name, query in entry.queries().items():
        if chosen and name not in chosen:
            continue
        started = time.time()
        try:
            df = query(spark, sf_dir)
            n = df.count()
            problem = differences(df, sqls[name], con) if name in sqls else "(no SQL)"
            types = types_of(df, sqls[name], con) if name in sqls else []
        except Exception as error:  # report and go on with the next query
            problem, n, types = f"{type(error).__name__}: {str(error)[:900]}", -1, []
        print(f"{'ok  ' if problem is None else 'FAIL'} {name:30s} {n:8d} rows {time.time() - started:6.1f}s {problem or ''} {types or ''}", flush=True)


if __name__ == "__main__":
    main()
