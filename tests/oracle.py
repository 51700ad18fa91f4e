"""Hold a query's rows against its SQL's, as multisets of values by column name."""

from __future__ import annotations

import math
from collections import Counter
from pathlib import Path

import duckdb

SMALL = "/root/testdata/sf0.001"


def connection(sf_dir: str = SMALL) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for file in Path(sf_dir).glob("*.parquet"):
        con.execute(f"CREATE VIEW {file.stem} AS SELECT * FROM read_parquet('{file}')")
    return con


def plain(value):
    if isinstance(value, float):
        return None if math.isnan(value) else f"{value:.9g}"
    if isinstance(value, (list, tuple)):
        return tuple(map(plain, value))
    return value


def rows_of(names, rows) -> Counter:
    order = sorted(range(len(names)), key=lambda i: names[i])
    return Counter(tuple(plain(row[i]) for i in order) for row in rows)


def differences(frame, con, sql: str) -> str:
    result = con.execute(sql)
    names, expected = [c[0] for c in result.description], result.fetchall()
    if sorted(names) != sorted(frame.columns):
        return f"columns {sorted(frame.columns)} for {sorted(names)}"
    got, wanted = rows_of(frame.columns, frame.collect()), rows_of(names, expected)
    if got == wanted:
        return "" if got else "no rows"
    return f"{sum(got.values())} rows for {sum(wanted.values())}; only here {list((got - wanted).items())[:2]}; only there {list((wanted - got).items())[:2]}"


def streamed(spark, frame, name: str, seconds: int = 120) -> list[tuple]:
    """The rows of a stream over what is there now; it has so many seconds to end."""
    query = frame.writeStream.format("memory").queryName(name).outputMode("append").trigger(availableNow=True).start()
    try:
        assert query.awaitTermination(seconds), "the stream doesn't end"
    finally:
        query.stop()
    return [tuple(r) for r in spark.table(name).collect()]
