"""Exchanges and broadcasts start threads of the driver's that hold memory for a minute; loops of small rounds aren't to pile them up."""

from __future__ import annotations

import re

import pytest
from pyspark.sql import functions as F

from bidlake.llm.mixing import mix_sources
from bidlake.operators import components
from bidlake.operators.components import connected_components, list_components
from bidlake.session import let_go, only_hinted_broadcasts


def newest(spark, kind: str) -> int:
    """Number of the newest thread of a pool whose threads are numbered as they start."""
    names = [str(thread.getName()) for thread in spark.sparkContext._jvm.java.lang.Thread.getAllStackTraces().keySet()]
    return max([int(name.rpartition("-")[2]) for name in names if re.fullmatch(rf"{kind}-[0-9]+", name)], default=-1)


def test_let_go_starts_no_exchange(spark):
    spark.range(10).repartition(2).count()
    before = newest(spark, "shuffle-exchange")
    assert before >= 0
    let_go(spark)
    assert newest(spark, "shuffle-exchange") == before


def test_components_broadcast_nothing(spark):
    spark.range(9).join(spark.range(9).hint("broadcast"), "id").count()
    edges = spark.createDataFrame([(i, i + 1) for i in range(40)], "a long, b long")
    before = newest(spark, "broadcast-exchange")
    assert before >= 0
    assert {row["root"] for row in connected_components(edges).collect()} == {0}
    assert newest(spark, "broadcast-exchange") == before


def test_few_links_go_on_without_exchanges(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(40)], "a long, b long")
    spark.range(10).repartition(2).count()
    before = newest(spark, "shuffle-exchange")
    assert {row["root"] for row in connected_components(edges).collect()} == {0}
    assert newest(spark, "shuffle-exchange") - before <= 2  # the edges' own distinct


def test_many_links_are_dealt(spark, monkeypatch):
    monkeypatch.setattr(components, "FEW_LINKS", 5)
    edges = spark.createDataFrame([(i, i + 1) for i in range(40)], "a long, b long")
    found = connected_components(edges)
    assert {row["root"] for row in found.collect()} == {0}
    assert found.count() == 41


def test_small_joins_of_lists_broadcast_nothing(spark):
    spark.range(9).join(spark.range(9).hint("broadcast"), "id").count()
    postings = spark.createDataFrame([(key, key + i, i) for key in range(0, 40, 2) for i in range(4)], "key long, id long, rank int")
    before = newest(spark, "broadcast-exchange")
    assert before >= 0
    found = list_components(postings, lambda pairs: pairs.filter(F.col("b") - F.col("a") == 1))
    assert newest(spark, "broadcast-exchange") == before
    assert {row["root"] for row in found.collect()} == {0}


def test_broadcasts_are_as_before_after_an_error(spark):
    keys = "spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.autoBroadcastJoinThreshold"
    before = [spark.conf.get(key, None) for key in keys]
    with pytest.raises(KeyError), only_hinted_broadcasts(spark):
        assert [spark.conf.get(key) for key in keys] == ["-1", "-1"]
        raise KeyError
    assert [spark.conf.get(key, None) for key in keys] == before


def test_the_mix_works_out_no_running_total_twice(spark):
    docs = spark.createDataFrame([(i, "a b c", "s") for i in range(9)], "doc_id long, text string, source string")
    found = mix_sources(docs)
    assert "Window" not in found._jdf.queryExecution().executedPlan().toString()
    assert [(row["size"], row["taken"]) for row in found.collect()] == [(3, 3)] * 9
