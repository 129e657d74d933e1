"""Run a registered query on Spark and its SQL on DuckDB and compare them."""

from __future__ import annotations

import math
import os
from collections import Counter

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents "
    "embeddings pages benchmark labels conversations"
).split()

SAME_TYPE = {
    "bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR",
    "boolean": "BOOLEAN", "timestamp": "TIMESTAMP", "timestamp_ntz": "TIMESTAMP", "date": "DATE",
}


def duck(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{os.path.join(sf_dir, name)}.parquet')")
    return con


def canon(value):
    if value is None:
        return "NULL"
    if isinstance(value, bool):
        return str(value)
    if isinstance(value, float):
        if math.isnan(value):
            return "nan"
        return f"{value:.6f}" if value else "0.000000"
    return str(value)


def compare(df, con, sql: str) -> list[str]:
    """Empty when equal, else what differs."""
    rel = con.sql(sql)
    duck_types = dict(zip(rel.columns, [str(t) for t in rel.types]))
    spark_types = {f.name: f.dataType.simpleString() for f in df.schema.fields}
    notes = []
    if set(duck_types) != set(spark_types):
        return [f"columns differ: spark {sorted(spark_types)} duck {sorted(duck_types)}"]
    for name, kind in spark_types.items():
        if SAME_TYPE.get(kind, kind) != duck_types[name]:
            notes.append(f"type of {name}: spark {kind} duck {duck_types[name]}")
    names = sorted(spark_types)
    got = Counter(tuple(canon(r[n]) for n in names) for r in df.collect())
    order = [rel.columns.index(n) for n in names]
    want = Counter(tuple(canon(r[i]) for i in order) for r in rel.fetchall())
    if sum(want.values()) == 0:
        notes.append("EMPTY")
    if got != want:
        extra, missing = got - want, want - got
        notes.append(
            f"rows: spark {sum(got.values())} duck {sum(want.values())} cols {names}\n   only spark "
            f"{list(extra.items())[:2]}\n   only duck {list(missing.items())[:2]}"
        )
    return notes
