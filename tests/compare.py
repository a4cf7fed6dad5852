"""Run registered queries beside their DuckDB SQL and compare whole results."""

from __future__ import annotations

import math
import sys
import time
from pathlib import Path

import duckdb

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    connection = duckdb.connect()
    for file in sorted(Path(sf_dir).glob("*.parquet")):
        connection.execute(f"create view {file.stem} as select * from read_parquet('{file}')")
    return connection


def _cell(value):
    if value is None or (isinstance(value, float) and math.isnan(value)):
        return None
    if isinstance(value, (int, float)):
        return round(float(value), 6) + 0.0
    return str(value)


def rows(columns: list[str], data) -> list[tuple]:
    order = sorted(range(len(columns)), key=columns.__getitem__)
    return sorted((tuple(_cell(row[i]) for i in order) for row in data), key=repr)


def difference(frame, connection, sql: str) -> str | None:
    """None where equal, otherwise what differs first."""
    ours = rows(frame.columns, frame.collect())
    cursor = connection.execute(sql)
    names = [d[0] for d in cursor.description]
    theirs = rows(names, cursor.fetchall())
    if sorted(frame.columns) != sorted(names):
        return f"columns {sorted(frame.columns)} / {sorted(names)}"
    if len(ours) != len(theirs):
        return f"{len(ours)} rows / {len(theirs)} rows"
    bad = [(a, b) for a, b in zip(ours, theirs) if a != b]
    return f"{len(bad)} of {len(ours)} rows differ, first {bad[0]}" if bad else None


if __name__ == "__main__":
    import __spark_entry__ as entry
    from pairloom.session import get_session

    sf_dir, only = sys.argv[1], sys.argv[2:]
    spark = get_session("compare", "local[8]", spark__sql__shuffle__partitions="8", spark__ui__enabled="false",
                        spark__driver__memory="16g")
    spark.sparkContext.setLogLevel("ERROR")
    connection, sql = connect(sf_dir), entry.oracle_sql()
    for name, run in entry.queries().items():
        if only and name not in only:
            continue
        start = time.time()
        try:
            frame = run(spark, sf_dir)
            if name in sql:
                result = difference(frame, connection, sql[name]) or "equal"
            else:
                result = f"{len(frame.collect())} rows, no SQL"
        except Exception as error:  # a broken query must not hide the others
            result = f"FAILED {str(error)[:600]}"
        print(f"{name:24s} {time.time() - start:6.1f}s  {result}", flush=True)
