"""Odd rows of publications, metrics and benchmark grids."""

from __future__ import annotations

from pyspark.sql import functions as F

from bidlake.operators import operations


def test_publications_with_nulls(spark):
    rows = [(1, " https://a.example/x ", "Failed "), (2, None, "FAILED"), (3, "https://a.example/y", None), (4, "https://b.example", "unsupported"), (5, "nohost", ""), (6, "https://c.example/", "x")]
    frame = spark.createDataFrame(rows, "id int, url string, state string")
    assert [r["url"] for r in operations.publications(frame, failed_only=True).collect()] == ["https://a.example/x"]
    assert sorted(r["id"] for r in operations.supported(frame).collect()) == [1, 3, 5, 6]
    assert [r["id"] for r in operations.diverse(frame, 5).collect()] == [1, 6] and [r["id"] for r in operations.diverse(frame, 1).collect()] == [1]


def test_metrics_of_nothing(spark):
    frame = spark.createDataFrame([("load", None, 150), ("load", None, None), ("save", "x", 1)], "name string, site string, units long")
    assert {tuple(r) for r in operations.metrics_snapshot(frame, "name", ["site"], "units", 100).collect()} == {("load{site=}", 2, 1.5, 0.75), ("save{site=x}", 1, 0.01, 0.01)}
    assert operations.metrics_snapshot(frame.filter("false"), "name", [], "units", 100).count() == 0


def test_grid_and_files(spark):
    runs = spark.createDataFrame([(2, "m", "u", 900, True, 3, 1), (1, "m", "u", 100, False, 2, 2), (3, "m", "v", 200, True, 4, 1)], "id int, model string, url string, runtime_units long, success boolean, downloaded int, iterations int")
    targets, models = spark.createDataFrame([("u",), ("v",), ("w",)], "url string"), spark.createDataFrame([("m",), ("n",)], "model string")
    found = {(r["model"], r["url"]): (r["success"], r["downloaded"], r["notes"]) for r in operations.benchmark_grid(models, targets, runs, 150).collect()}
    assert found[("m", "u")] == (False, 2, "") and found[("m", "v")] == (False, 0, "hard timeout >1s") and found[("n", "w")] == (False, 0, "not run") and len(found) == 6
    files = spark.createDataFrame([(1, 7, "a"), (1, 8, "b"), (None, None, "c")], "job_id int, item_id int, name string")
    items = spark.createDataFrame([(1, 7, "d"), (2, 8, "e")], "job_id int, id int, domain string")
    assert sorted((r["name"], r["domain"]) for r in operations.stored_files(files, items).collect()) == [("a", "d"), ("b", ""), ("c", "")]
    assert operations.errors_of(items.withColumn("status", F.lit("failed")), "all", F.lit("x")).count() == 2
