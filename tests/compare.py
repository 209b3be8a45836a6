"""Run registered queries and their SQL side by side.

    python -m tests.compare <folder> [query ...]
"""

from __future__ import annotations

import sys
import time

import duckdb
import pyarrow as pa

TABLES = [
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
    "documents", "embeddings", "pages", "benchmark", "labels", "conversations",
]


def connect(folder: str) -> duckdb.DuckDBPyConnection:
    connection = duckdb.connect()
    for name in TABLES:
        connection.execute(f"create view {name} as select * from '{folder}/{name}.parquet'")
    return connection


def rows_of(table: pa.Table) -> list[tuple]:
    names = sorted(table.column_names)
    columns = [table.column(name).to_pylist() for name in names]
    return sorted(zip(*columns), key=repr)


def types_of(table: pa.Table) -> dict[str, str]:
    return {
        field.name: str(field.type).replace("large_", "").replace("[ns]", "[us]")
        for field in table.schema
    }


def difference(spark_table: pa.Table, sql_table: pa.Table) -> str:
    """Empty when both hold the same columns, types and rows in any order."""
    if types_of(spark_table) != types_of(sql_table):
        left, right = types_of(spark_table), types_of(sql_table)
        unequal = {n: (left.get(n), right.get(n)) for n in {*left, *right} if left.get(n) != right.get(n)}
        return f"types {unequal}"
    left, right = rows_of(spark_table), rows_of(sql_table)
    if len(left) != len(right):
        return f"rows {len(left)} against {len(right)}"
    unequal = [(a, b) for a, b in zip(left, right) if a != b]
    if unequal:
        return f"{len(unequal)} of {len(left)} rows, such as\n  {unequal[0][0]}\n  {unequal[0][1]}\n  {sorted(spark_table.column_names)}"
    return ""


def main() -> None:
    from vitrine.plans.oracle import statements
    from vitrine.plans.queries import QUERIES
    from vitrine.session import local_session

    folder, names = sys.argv[1], sys.argv[2:]
    spark = local_session()
    connection = connect(folder)
    sql = statements()
    for name in names or QUERIES:
        started = time.time()
        try:
            mine = QUERIES[name](spark, folder).toArrow()
            spark_time = time.time() - started
            if name not in sql:
                print(f"{name}: {mine.num_rows} rows, no SQL ({spark_time:.1f}s)", flush=True)
                continue
            started = time.time()
            theirs = connection.execute(sql[name]).to_arrow_table()
            problem = difference(mine, theirs)
            print(
                f"{name}: {'DIFFERS ' + problem if problem else 'ok'} {mine.num_rows} rows"
                f" ({spark_time:.1f}s, SQL {time.time() - started:.1f}s)",
                flush=True,
            )
        except Exception as error:  # report and go on with the next query
            print(f"{name}: FAILED {type(error).__name__} {str(error)[:700]}", flush=True)


if __name__ == "__main__":
    main()
