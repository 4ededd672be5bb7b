"""Run registered queries next to their checking SQL in DuckDB."""

from __future__ import annotations

import glob
import os
import sys
import time

import duckdb


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for path in glob.glob(f"{sf_dir}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM read_parquet('{path}')")
    return con


def rows_of(columns: list[str], rows: list) -> list:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(r[i] for i in order) for r in rows), key=repr)


def oracle_rows(con, sql: str) -> tuple[list[str], list]:
    cur = con.execute(sql)
    columns = [d[0] for d in cur.description]
    return sorted(columns), rows_of(columns, cur.fetchall())


def spark_rows(df) -> tuple[list[str], list]:
    return sorted(df.columns), rows_of(df.columns, df.collect())


def main() -> None:
    sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    import __spark_entry__ as entry
    from feedloom.session import build_session

    sf_dir = os.environ.get("SF_DIR", "/root/testdata/sf0.01")
    spark = build_session(master="local[8]", spark__ui__enabled="false", spark__sql__shuffle__partitions="8",
                          spark__driver__memory="8g", spark__ui__showConsoleProgress="false")
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(sf_dir)
    oracles = entry.oracle_sql()
    wanted = sys.argv[1:]
    for name, plan in entry.queries().items():
        if wanted and name not in wanted:
            continue
        try:
            start = time.time()
            df = plan(spark, sf_dir)
            columns, got = spark_rows(df)
            spent = time.time() - start
            if name not in oracles:
                print(f"rows {name}: {len(got)} rows, {spent:.1f}s, {got[:3]}")
                continue
            start = time.time()
            want_columns, want = oracle_rows(con, oracles[name])
            oracle_spent = time.time() - start
            same = columns == want_columns and got == want
            types = [t for _, t in sorted(df.dtypes)]
            print(f"{'ok  ' if same else 'BAD '} {name}: {len(got)} rows, spark {spent:.1f}s, sql {oracle_spent:.1f}s {types if same else ''}")
            if not same:
                print("   columns", columns, want_columns, "rows", len(got), len(want))
                extra, lacking = [r for r in got if r not in want][:4], [r for r in want if r not in got][:4]
                print("   only spark:", str(extra)[:900])
                print("   only sql:  ", str(lacking)[:900])
        except Exception as error:  # noqa: BLE001
            print(f"FAIL {name}: {str(error)[:1500]}")


if __name__ == "__main__":
    main()
