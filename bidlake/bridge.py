"""Procurement tables derived from the star-schema test tables, and the same derivation as SQL for the oracle.

Only arithmetic, CASE and concatenation are used, so both engines get the same rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: The moment that "now" means in every query.
NOW = "1998-09-02 00:00:00"
CASCADE = ["existing", "deterministic", "adaptive", "llm_generated", "learned_route", "cua", "manual"]

#: One message for each category, and the category that it stands for.
MESSAGES: list[tuple[str, str]] = [
    ("read timed out after 30 s", "timeout"),
    ("connection refused by peer", "network"),
    ("getaddrinfo failed", "dns"),
    ("handshake failure", "ssl"),
    ("too many redirects", "redirect_loop"),
    ("charmap problem in page", "encoding_error"),
    ("missing required function scrape", "code_validation"),
    ("injection detected in page", "prompt_injection"),
    ("private network blocked: 10.0.0.1", "blocked_url"),
    ("memory limit reached", "sandbox"),
    ("bitte anmelden", "login_required"),
    ("konto erstellen", "registration_required"),
    ("access denied", "auth"),
    ("recaptcha shown", "captcha"),
    ("page not found", "not_found"),
    ("too many requests", "rate_limit"),
    ("bad gateway", "server_error"),
    ("Unterlagen nicht mehr verfügbar", "expired"),
    ("wartung bis morgen", "maintenance"),
    ("javascript required", "js_required"),
    ("blank page", "empty_page"),
    ("traceback most recent call", "scraper_crash"),
    ("no documents on page", "no_documents"),
    ("persist failed", "storage"),
    ("no runner for item", "no_strategy"),
    ("max iterations", "loop_exhausted"),
    ("something odd", "unknown"),
]
#: URL stems and their types and platforms: every type, and some that only look like one.
URLS: list[tuple[str, str, str]] = [
    ("https://www.dtvp.de/Satellite/notice/", "satellite", "dtvp"),
    ("https://kfw.de/evergabe.bieter/api/supplier/external/deeplink/subproject/", "evergabe_deep", "evergabe_cosinex"),
    ("https://dfg.e-va.eu/bundde?data=", "eva_portal", "e_va"),
    ("https://x.example.de/NetServer/TenderingProcedureDetails?function=_Details&id=", "netserver_auth", "netserver"),
    ("https://x.example.de/NetServer/PublicationControllerServlet?function=Detail&id=", "netserver_pub", "netserver"),
    ("https://www.subreport.de/E", "subreport", "subreport"),
    ("https://www.evergabe-online.de/tenderdetails.html?id=", "evergabe_web", "evergabe_online"),
    ("https://ted.europa.eu/udl?uri=", "ted_europa", "ted_eu"),
    ("https://www.find-tender.service.gov.uk/Notice/", "uk_tender", "unknown"),
    ("https://www.boamp.fr/avis/", "fr_place", "unknown"),
    ("https://www.tenderned.nl/aankondigingen/", "nl_tenderned", "unknown"),
    ("https://www.mercell.com/tender/", "nordic", "mercell"),
    ("https://sam.gov/opp/", "us_sam", "unknown"),
    ("https://www.gets.govt.nz/tender/", "nz_gets", "unknown"),
    ("https://random-company.example.com/page/", "unknown", "unknown"),
    ("https://www.miniportal.uzp.gov.pl/t/", "pl_miniportal", "unknown"),
    ("https://www.contrataciondelestado.es/t/", "es_place", "unknown"),
    ("https://www.base.gov.pt/t/", "pt_base", "unknown"),
    ("https://www.eten.be/t/", "be_eprocure", "unknown"),
    ("https://www.ausschreibungen.at/t/", "at_ausschreib", "unknown"),
    ("https://www.simap.ch/t/", "ch_simap", "unknown"),
    ("https://www.acquistinretepa.it/t/", "it_proc", "unknown"),
    ("https://www.etenders.gov.ie/t/", "ie_etenders", "unknown"),
    ("https://www.promitheus.gov.gr/t/", "eu_east", "unknown"),
    ("https://www.canadabuys.canada.ca/t/", "ca_tenders", "unknown"),
    ("https://www.comprasnet/t/", "latam", "unknown"),
    ("https://www.gem.gov.in/t/", "in_gem", "unknown"),
    ("https://www.gebiz.gov.sg/t/", "asia_other", "unknown"),
    ("https://www.etenders.gov.za/t/", "africa", "unknown"),
    ("https://www.tenders.gov.au/t/", "au_austender", "unknown"),
    ("https://www.notsam.gov.example.com/a/", "us_sam", "unknown"),
    ("https://example.org/Satellite/notices/", "unknown", "unknown"),
    ("https://subreport.example.com/", "unknown", "unknown"),
    ("https://x.example.de/NetServer/TenderingProcedureDetails?function=Other&id=", "unknown", "netserver"),
]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def dealt(rows: DataFrame, key: str) -> DataFrame:
    """Narrow rows dealt evenly by key before much is made of each: files of few bytes are few tasks, and Spark joins few bytes in few tasks."""
    return rows.repartition(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), key)


def _pick(index: str, values: list[str]) -> str:
    quoted = [v.replace("'", "''") for v in values]
    return f"CASE {index} " + " ".join(f"WHEN {i} THEN '{v}'" for i, v in enumerate(quoted)) + " END"


_FAILED = "l_returnflag = 'R'"
#: Column -> SQL that both engines read; numbers that are summed stay whole.
ITEM_COLUMNS: dict[str, str] = {
    "id": "l_orderkey * 100 + rn",
    "job_id": "l_orderkey",
    "domain": "concat('s', cast(l_suppkey AS {text}), '.example.org')",
    "url": "concat(" + _pick(f"cast(l_suppkey % {len(URLS)} AS int)", [u[0] for u in URLS]) + ", cast(l_partkey AS {text}))",
    "known_type": _pick(f"cast(l_suppkey % {len(URLS)} AS int)", [u[1] for u in URLS]),
    "known_platform": _pick(f"cast(l_suppkey % {len(URLS)} AS int)", [u[2] for u in URLS]),
    "strategy": _pick("cast((l_linenumber - 1) % 7 AS int)", CASCADE),
    "status": f"CASE WHEN {_FAILED} THEN 'failed' WHEN l_returnflag = 'A' THEN 'success' WHEN l_linestatus = 'O' THEN 'pending' ELSE 'success' END",
    "iterations": "l_linenumber",
    "runtime_seconds": "cast(l_quantity AS bigint)",
    "error_message": f"CASE WHEN {_FAILED} THEN " + _pick(f"cast(l_partkey % {len(MESSAGES)} AS int)", [m[0] for m in MESSAGES]) + " END",
    "failure_category": f"CASE WHEN {_FAILED} THEN " + _pick(f"cast(l_partkey % {len(MESSAGES)} AS int)", [m[1] for m in MESSAGES]) + " END",
    "deadline": "CASE WHEN l_partkey % 10 <> 0 THEN l_shipdate END",
    "tender_title": "concat('Tender ', cast(l_partkey AS {text}))",
    "tender_reference": "concat('R', cast(l_orderkey AS {text}), '-', cast(rn AS {text}))",
}
_ORDER = ["l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_shipdate"]


def job_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").withColumn("rn", F.row_number().over(W.partitionBy("l_orderkey").orderBy(*_ORDER)))
    return rows.selectExpr(*[f"{sql.format(text='string')} AS {name}" for name, sql in ITEM_COLUMNS.items()])


def jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cost in whole cents of a cent, so that sums don't hang on their order."""
    return table(spark, sf_dir, "orders").selectExpr("o_orderkey AS id", "o_orderdate AS created_at", "cast(floor(o_totalprice * 100 + 0.5D) AS bigint) AS cost_units", "o_custkey AS submitted_by")


def runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Evaluation runs: one an event."""
    return table(spark, sf_dir, "events").selectExpr(
        "event_id AS id", "event_type AS model", "cast(user_id AS string) AS url", "value > 50D AS success", "cast(floor(value * 100 + 0.5D) AS bigint) AS runtime_units",
        "cast(event_id % 5 AS int) AS downloaded", "cast(event_id % 4 AS int) AS expected", "ts AS created_at", "concat('s', cast(user_id % 10 AS string), '.example.org') AS domain",
    )


def audit_logs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").selectExpr(
        "event_id AS id", "ts AS created_at", "event_type", "user_id AS job_id", "CASE WHEN event_type = 'error' THEN 'error' WHEN event_id % 7 = 0 THEN 'warning' ELSE 'info' END AS level",
        "substring(props, 1, 4000) AS message",
    )


def seed_portals(spark: SparkSession, sf_dir: str) -> DataFrame:
    suppliers = table(spark, sf_dir, "supplier").filter("s_suppkey % 10 <> 0").selectExpr("concat('s', cast(s_suppkey AS string), '.example.org') AS domain")
    return suppliers.unionByName(table(spark, sf_dir, "nation").selectExpr("concat('n', cast(n_nationkey AS string), '.example.net') AS domain"))


def snapshots(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Two states of the document store: (filename, checksum)."""
    docs = table(spark, sf_dir, "documents").select("doc_id", F.sha2(F.coalesce("text", F.lit("")), 256).alias("checksum"), F.concat(F.lit("d"), F.col("doc_id").cast("string"), F.lit(".pdf")).alias("filename"))
    old = docs.filter("doc_id % 13 <> 0").select("filename", "checksum")
    new = docs.filter("doc_id % 11 <> 0").select("filename", F.when(F.col("doc_id") % 7 == 0, F.concat(F.lit("x"), "checksum")).otherwise(F.col("checksum")).alias("checksum"))
    return old, new


def tender_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rendered tender notices whose fields are known columns."""
    joined = table(spark, sf_dir, "orders").join(table(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    joined = dealt(joined.select("o_orderkey", "o_custkey", "o_orderdate", "c_name"), "o_orderkey")
    date = F.date_format("o_orderdate", "dd.MM.yyyy")
    text = F.concat(
        F.lit("Vergabenummer: V-"), F.col("o_orderkey").cast("string"), F.lit("\nAuftraggeber: "), F.col("c_name"), F.lit("\nAuftragsbezeichnung: Los "), F.col("o_orderkey").cast("string"),
        F.lit("\nVerfahrensart: Offenes Verfahren\nAngebotsfrist: "), date, F.lit(" 10:00 Uhr\nCPV "), F.lpad(F.col("o_custkey").cast("string"), 8, "7"), F.lit("\nE-Mail: k"), F.col("o_custkey").cast("string"),
        F.lit("@example.org\nAuftragswert: EUR "), F.col("o_custkey").cast("string"), F.lit(",00\nBauleistung\n"),
    )
    return joined.select(F.col("o_orderkey").alias("id"), text.alias("text"))


def oracle(sql: str) -> str:
    """DuckDB SQL with the derived tables in front; only those that are named are used."""
    columns = ", ".join(f"{c.format(text='varchar')} AS {name}" for name, c in ITEM_COLUMNS.items())
    return f"""WITH numbered AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY {', '.join(_ORDER)}) AS rn FROM lineitem),
items AS (SELECT {columns} FROM numbered),
jobs AS (SELECT o_orderkey AS id, o_orderdate AS created_at, cast(floor(o_totalprice * 100 + 0.5) AS bigint) AS cost_units, o_custkey AS submitted_by FROM orders),
runs AS (SELECT event_id AS id, event_type AS model, cast(user_id AS varchar) AS url, value > 50 AS success, cast(floor(value * 100 + 0.5) AS bigint) AS runtime_units,
  cast(event_id % 5 AS int) AS downloaded, cast(event_id % 4 AS int) AS expected, ts AS created_at, concat('s', cast(user_id % 10 AS varchar), '.example.org') AS domain FROM events),
audit AS (SELECT event_id AS id, ts AS created_at, event_type, user_id AS job_id,
  CASE WHEN event_type = 'error' THEN 'error' WHEN event_id % 7 = 0 THEN 'warning' ELSE 'info' END AS level, substring(props, 1, 4000) AS message FROM events),
seeds AS (SELECT concat('s', cast(s_suppkey AS varchar), '.example.org') AS domain FROM supplier WHERE s_suppkey % 10 <> 0
  UNION ALL SELECT concat('n', cast(n_nationkey AS varchar), '.example.net') FROM nation)
{sql}"""
