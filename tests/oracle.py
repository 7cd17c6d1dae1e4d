"""Compare a Spark result with a DuckDB result: names, types, row multiset."""

from __future__ import annotations

import datetime
import decimal
from collections import Counter

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()

SPARK_KIND = {
    "string": "text", "int": "int32", "bigint": "int64", "double": "double", "date": "date", "boolean": "bool",
    "float": "float",
}
DUCK_KIND = {
    "VARCHAR": "text", "INTEGER": "int32", "BIGINT": "int64", "DOUBLE": "double", "DATE": "date", "BOOLEAN": "bool",
    "FLOAT": "float",
}


def connect(folder: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{folder}/{t}.parquet')")
    return con


def _plain(value):
    if isinstance(value, decimal.Decimal):
        return float(value)
    if isinstance(value, float):
        return value + 0.0
    if isinstance(value, datetime.datetime):
        return value.isoformat()
    return value


def _rows(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return Counter(tuple(_plain(r[i]) for i in order) for r in rows)


def mismatch(spark_df, con: duckdb.DuckDBPyConnection, sql: str) -> str | None:
    """None when equal, else a short description."""
    con.execute(sql)
    duck_types = {c[0]: str(c[1]) for c in con.description}
    duck = _rows(list(duck_types), con.fetchall())
    spark_types = dict(spark_df.dtypes)
    if sorted(duck_types) != sorted(spark_types):
        return f"columns: spark {sorted(spark_types)} duck {sorted(duck_types)}"
    for name, kind in spark_types.items():
        if SPARK_KIND.get(kind, kind) != DUCK_KIND.get(duck_types[name], duck_types[name]):
            return f"type of {name}: spark {kind} duck {duck_types[name]}"
    got = _rows(spark_df.columns, [tuple(r) for r in spark_df.collect()])
    if got == duck:
        return None
    only_spark, only_duck = got - duck, duck - got
    return (
        f"rows spark {sum(got.values())} duck {sum(duck.values())}; differing {sum(only_spark.values())}/"
        f"{sum(only_duck.values())}\n  names {sorted(spark_types)}\n  spark {sorted(only_spark, key=str)[:3]}"
        f"\n  duck  {sorted(only_duck, key=str)[:3]}"
    )
