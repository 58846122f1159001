"""Compare a Spark result with DuckDB: same columns, types by family, and values."""

from __future__ import annotations

import datetime as dt
import math
from decimal import Decimal

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def connect(folder: str) -> duckdb.DuckDBPyConnection:
    db = duckdb.connect()
    for table in TABLES:
        db.execute(f"CREATE VIEW {table} AS SELECT * FROM '{folder}/{table}.parquet'")
    return db


def family(type_name: str) -> str:
    name = type_name.lower()
    if name.startswith("decimal"):
        return "decimal"
    families = {
        "int": "int32", "integer": "int32", "bigint": "int64", "long": "int64", "double": "double",
        "string": "text", "varchar": "text", "date": "date",
    }
    return families.get(name, name)


def normal(value):
    if isinstance(value, dt.datetime):
        return value.date().isoformat()
    if isinstance(value, dt.date):
        return value.isoformat()
    if isinstance(value, Decimal):
        return float(value)
    if isinstance(value, float) and math.isnan(value):
        return None
    return value


def rows_of(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    out = [tuple(normal(row[i]) for i in order) for row in rows]
    return sorted(out, key=lambda r: tuple((v is not None, str(type(v)), v if v is not None else 0) for v in r))


def compare(spark_df, db, sql: str) -> list[str]:
    """Differences as text; empty when equal."""
    result = db.execute(sql)
    names = [d[0] for d in result.description]
    types = {d[0]: family(str(d[1])) for d in result.description}
    theirs = rows_of(names, result.fetchall())
    schema = {f.name: family(f.dataType.simpleString()) for f in spark_df.schema.fields}
    problems = []
    if schema != types:
        problems.append(f"schema {sorted(schema.items() ^ types.items())}")
        if set(schema) != set(types):
            return problems
    ours = rows_of(spark_df.columns, [tuple(r) for r in spark_df.collect()])
    if len(ours) != len(theirs):
        problems.append(f"rows {len(ours)} != {len(theirs)}")
    bad = [(a, b) for a, b in zip(ours, theirs) if a != b]
    if bad:
        problems.append(f"{len(bad)} rows differ, first {bad[0]}")
    return problems
