"""Folds of state as streams: equal to their batch forms, in any number of micro-batches, and forgetting keys that have gone quiet."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from bidlake import catalog
from bidlake.plans import content
from bidlake.streaming import breaker
from tests.oracle import SMALL, connection, differences, streamed


@pytest.mark.parametrize("name", ["circuit_breaker", "rate_limit", "domain_limit"])
def test_folds_match_their_sql(spark, name):
    assert not differences(catalog.queries()[name](spark, SMALL), connection(), catalog.oracle_sql()[name])


def files_in_order(frame, folder, n: int) -> None:
    """Several files, each with the next events, so that a stream takes them one after another."""
    rows = frame.orderBy("at").toPandas()
    size = -(-len(rows) // n)
    for i in range(n):
        frame.sparkSession.createDataFrame(rows.iloc[i * size : (i + 1) * size], frame.schema).coalesce(1).write.mode("append").parquet(str(folder))


def stream(spark, frame, folder, n: int):
    files_in_order(frame, folder, n)
    return spark.readStream.schema(frame.schema).option("maxFilesPerTrigger", 1).parquet(str(folder))


def test_limiter_stream_equals_batch(spark, tmp_path):
    events = content.limiter_events(spark, SMALL).limit(400)
    expected = sorted(map(tuple, breaker.replay_limiter(events, 3, 86400.0).collect()))
    assert {x[3] for x in expected} == {True, False}
    assert sorted(streamed(spark, breaker.stream_limiter(stream(spark, events, tmp_path / "e", 3), 3, 86400.0), "limited")) == expected


def test_limit_stream_equals_batch(spark, tmp_path):
    events = content.breaker_events(spark, SMALL).select(F.col("domain").alias("key"), "at").limit(400)
    expected = sorted(map(tuple, breaker.replay_limit(events, 2, 86400.0).collect()))
    assert {x[2] for x in expected} == {True, False}
    assert sorted(streamed(spark, breaker.stream_limit(stream(spark, events, tmp_path / "e", 3), 2, 86400.0), "hits")) == expected


def test_slots_by_plain_code(spark):
    """One busy key, many partitions: a slot's time begins with the first slot and is over for all at once."""
    draw = random.Random(4)
    rows, at = [], 0.0
    for _ in range(1500):
        at += draw.choice([0.0, 0.5, 2.0, 9.0, 10.0, 40.0])
        rows.append(("k" if draw.random() < 0.8 else f"q{draw.randrange(4)}", at, draw.choice(["acquire", "acquire", "release"])))
    expected, held = [], {}
    for key, at, op in sorted(rows):
        taken, begun = held.get(key, (0, None))
        if begun is not None and at >= begun + 10:
            taken, begun = 0, None
        allowed = op == "release" or taken < 2
        if op == "release":
            taken, begun = (taken - 1, begun) if taken else (0, None)
        elif allowed:
            taken, begun = taken + 1, begun if taken else at
        held[key] = (taken, begun)
        expected.append((key, at, op, allowed, taken))
    frame = spark.createDataFrame([*rows, (None, 1.0, "acquire"), ("n", None, "acquire")], "key string, at double, op string").repartition(6)
    assert sorted(map(tuple, breaker.replay_limiter(frame, 2, 10.0).collect())) == sorted(expected)
    assert breaker.replay_limiter(frame.filter("false")).count() == 0


def test_quiet_keys_are_forgotten(spark, tmp_path):
    """When time has gone on, only the last key has state, and the stream has ended by itself."""
    events = spark.createDataFrame([(f"k{i}", float(i * 1000), "acquire") for i in range(20)], "key string, at double, op string")
    frame = breaker.stream_limiter(stream(spark, events, tmp_path / "e", 20), 1, 30.0)
    query = frame.writeStream.format("noop").outputMode("append").trigger(availableNow=True).start()
    assert query.awaitTermination(120)
    assert query.lastProgress["stateOperators"][0]["numRowsTotal"] <= 2
