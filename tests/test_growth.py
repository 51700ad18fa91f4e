"""Plans and results of queries that had grown faster than their tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from bidlake import catalog
from bidlake.functions import candidates, classify, literals, rules
from tests.oracle import SMALL, connection, differences


def plan(frame) -> str:
    return frame._jdf.queryExecution().optimizedPlan().toString()


def test_important_documents_are_aggregated(spark):
    """Candidates of one address aren't sorted in one group; nulls of the order stay first and other columns come along."""
    query = catalog.queries()["important_documents"](spark, SMALL)
    assert plan(query).count("Window") == 1  # the items' own numbers within their jobs
    assert "keyword:boq" not in plan(query)[plan(query).rindex("Aggregate") :]  # scored after the candidates are grouped
    assert not differences(query, connection(), catalog.oracle_sql()["important_documents"])
    url = "https://x.example/boq.pdf"
    rows = [(3, "boq", url, "c"), (2, "boq", url, "b"), (1, "annex", url + "#1", "a"), (None, "boq", url, "n"), (5, "boq", url + "?2", "e"), (6, "boq", url + "?2", "f")]
    frame = spark.createDataFrame(rows, "id int, name string, url string, more string").withColumn("page", F.lit(None).cast("int")).withColumn("text", F.lit(None).cast("string"))
    found = candidates.important_documents(frame, "page", "id", "name", "text", "url")
    assert found.columns == [*frame.columns, "score", "reason", "priority"]
    assert sorted((r["more"], r["id"]) for r in found.collect()) == [("e", 5), ("n", None)]


def test_sheet_records_of_odd_cells(spark, tmp_path):
    """Cells that begin or end in digits keep them; wide blanks are cut off, other signs aren't, and a number has no sign behind it."""
    texts = ["a, 1e3, 0\nb, 10", "0a, 1\n 　,  \nz, 2", "5\r\nx, 1", "k,  1x \n, 1 \nk:, 01", "a, b, a\n1, 2, 10\n0, 1　, 2", " \n　h, 1, 2\n0, 1, 3\n\nrest, 1"]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    con = connection()
    con.execute(f"CREATE OR REPLACE VIEW documents AS SELECT * FROM read_parquet('{tmp_path}/documents.parquet/*.parquet')")
    assert not differences(catalog.queries()["sheet_records"](spark, str(tmp_path)), con, catalog.oracle_sql()["sheet_records"])


def test_rules_by_their_letters(spark):
    """Each rule's letters in odd cases, plain and as parts of longer patterns, against one search for each pattern."""
    odd = str.maketrans({"s": "ſ", "k": "K", "i": "ı"})
    said = [a.replace("\\.", ".").replace("\\?", "?").replace(".*", "-x-") for tables in (rules.PLATFORMS.values(), [v[1] for v in rules.URL_TYPES.values()], [[p] for p in rules.ERROR_CATEGORIES.values()]) for some in tables for p in some for a in literals.alternatives(p)]
    texts = [None, "", "etender.gov.in", "etenders.gov.in", "irlgov\netender", "ghana-tender", "eprocure.gov.pk", "eprocure.gov.xx", "javascript", "exit code 0", "exit code 1", "TİMEOUT", *said, *map(str.upper, said), *[t.translate(odd) for t in said]]
    frame = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    for table in (rules.PLATFORMS, {k: v[1] for k, v in rules.URL_TYPES.items()}, rules.ERROR_CATEGORIES):
        whole = {label: p if isinstance(p, str) else "|".join(f"(?:{x})" for x in p) for label, p in table.items()}
        searched = F.coalesce(*[F.when(F.col("t").rlike(f"(?iu){p}"), label) for label, p in whole.items()], F.lit("unknown"))
        wrong = frame.select("t", classify.first_rule(F.col("t"), table, "unknown").alias("a"), searched.alias("b")).filter("a <> b").collect()
        assert not wrong
    assert literals.required(r"etenders?\.gov\.in") == ("etender", False) and literals.required(r"sam\.gov") == ("sam.gov", True) and literals.required(r"a+b*cd") == ("cd", False)
    assert literals.may_have(F.lit(""), r"\d+|abc") is None
    assert "rlike" not in plan(frame.select(classify.first_rule(F.col("t"), {"x": [r"sam\.gov", "a/b"]}, ""))).lower()


def test_few_bytes_are_many_tasks(spark):
    """Queries that make much of narrow rows deal them first, and don't name a search more often than there are patterns."""
    for name in ("iso_dates", "extract_fields", "extract_more_fields", "summaries"):
        assert "RepartitionByExpression" in plan(catalog.queries()[name](spark, SMALL)), name
    for name, pattern in (("portal_alternatives", "54321-Tender-[a-f0-9-]+"), ("netserver_urls", "TenderOID=([^&]*)")):
        found = catalog.queries()[name](spark, SMALL)
        assert plan(found).count(pattern) <= 2, name
        assert not differences(found, connection(), catalog.oracle_sql()[name])
