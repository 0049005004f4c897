"""Run every query against its checking SQL: python -m tests.compare [sf_dir] [id ...]"""

from __future__ import annotations

import sys
import time

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents "
    "embeddings pages benchmark labels conversations"
).split()


def duck(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def rows_of(names: list[str], rows: list) -> list[tuple]:
    """Rows with columns by name, in an order of their own."""
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted((tuple(r[i] for i in order) for r in rows), key=repr)


def differences(spark_rows, spark_names, duck_rows, duck_names) -> str:
    if sorted(spark_names) != sorted(duck_names):
        return f"columns {sorted(spark_names)} / {sorted(duck_names)}"
    mine, other = rows_of(spark_names, spark_rows), rows_of(duck_names, duck_rows)
    if len(mine) != len(other):
        return f"{len(mine)} / {len(other)} rows"
    for a, b in zip(mine, other):
        if a != b:
            return f"{a} / {b}"
    return ""


# DuckDB's names of Spark's result types.
TYPES = {"bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR", "boolean": "BOOLEAN"}


def check(spark, con, sf_dir: str, name: str, query, sql: str) -> str:
    df = query(spark, sf_dir)
    mine = [tuple(r) for r in df.collect()]
    found = con.execute(sql)
    names = [d[0] for d in found.description]
    kinds = {d[0]: str(d[1]) for d in found.description}
    wrong = [f"{c} {k} / {kinds.get(c)}" for c, k in df.dtypes if TYPES.get(k) != kinds.get(c)]
    if wrong:
        return f"types {wrong}"
    return differences(mine, df.columns, found.fetchall(), names)


def main(sf_dir: str, only: list[str]) -> int:
    import __spark_entry__ as entry
    from larder.session import build_session

    spark = build_session("local[8]", **{"spark.sql.shuffle.partitions": "8", "spark.driver.memory": "8g"})
    spark.sparkContext.setLogLevel("ERROR")
    con, sql, bad = duck(sf_dir), entry.oracle_sql(), 0
    for name, query in entry.queries().items():
        if only and name not in only:
            continue
        start = time.time()
        try:
            if name in sql:
                wrong = check(spark, con, sf_dir, name, query, sql[name])
                state = f"DIFFERS {wrong}" if wrong else "equal"
            else:
                state = f"{len(query(spark, sf_dir).collect())} rows"
        except Exception as e:  # noqa: BLE001
            state = f"FAILS {type(e).__name__} {str(e)[:600]}"
        bad += state.startswith(("DIFFERS", "FAILS"))
        print(f"{name:32} {time.time() - start:6.2f}s  {state}", flush=True)
    print("unmatched SQL:", sorted(set(sql) - set(entry.queries())))
    return bad


if __name__ == "__main__":
    sys.exit(main(sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01", sys.argv[2:]))
