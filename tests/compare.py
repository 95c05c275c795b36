"""Run a registered query in Spark and its SQL in DuckDB and compare the rows."""

from __future__ import annotations

import math
import sys
import time
from collections import Counter
from decimal import Decimal
from pathlib import Path

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages"
    " benchmark labels conversations"
).split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    connection = duckdb.connect()
    for table in TABLES:
        path = Path(sf_dir) / f"{table}.parquet"
        connection.execute(f"CREATE VIEW {table} AS SELECT * FROM read_parquet('{path}')")
    return connection


def _plain(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else round(value, 9)
    if isinstance(value, Decimal):
        return value.normalize()
    return value


def rows_of(columns, rows) -> Counter:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return Counter(tuple(_plain(row[i]) for i in order) for row in rows)


def kinds(frame) -> dict[str, str]:
    return {f.name: f.dataType.simpleString() for f in frame.schema.fields}


_SAME_KIND = {
    "bigint": "BIGINT", "int": "INTEGER", "string": "VARCHAR", "boolean": "BOOLEAN",
    "double": "DOUBLE",
}


def difference(frame, connection, sql: str) -> str | None:
    """What differs between a DataFrame and the result of ``sql``, or None."""
    result = connection.execute(sql)
    names = [d[0] for d in result.description]
    expected_rows = result.fetchall()
    types = dict(
        (r[0], r[1]) for r in connection.execute(f"DESCRIBE {sql}").fetchall()
    )
    if sorted(names) != sorted(frame.columns):
        return f"columns {sorted(frame.columns)} != {sorted(names)}"
    for name, kind in kinds(frame).items():
        if kind in _SAME_KIND and types[name] != _SAME_KIND[kind]:
            return f"type of {name}: {kind} != {types[name]}"
    got = rows_of(frame.columns, [tuple(r) for r in frame.collect()])
    expected = rows_of(names, expected_rows)
    if got == expected:
        return None
    extra, missing = list((got - expected).items()), list((expected - got).items())
    return f"rows {sum(got.values())} vs {sum(expected.values())}: +{extra[:3]} -{missing[:3]}"


def main(sf_dir: str, only: list[str]) -> int:
    sys.path.insert(0, str(Path(__file__).resolve().parent.parent))
    import __spark_entry__ as entry
    from pagoscope.session import local_session

    spark, connection, bad = local_session(), connect(sf_dir), 0
    oracle = entry.oracle_sql()
    for name, build in entry.queries().items():
        if name not in oracle or (only and name not in only):
            continue
        start = time.time()
        try:
            problem = difference(build(spark, sf_dir), connection, oracle[name])
        except Exception as error:  # a report for people: show and go on
            problem = f"{type(error).__name__}: {str(error)[:600]}"
        bad += problem is not None
        print(f"{'ok ' if problem is None else 'BAD'} {name} {time.time() - start:.2f}s"
              f" {problem or ''}", flush=True)
    print(f"{bad} differ")
    return bad


if __name__ == "__main__":
    sys.exit(min(1, main(sys.argv[1], sys.argv[2:])))
