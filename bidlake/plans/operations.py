"""Named queries over publications, metrics, benchmark grids and stored files."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from bidlake import bridge
from bidlake.bridge import oracle
from bidlake.functions import classify, pages, rules, urls
from bidlake.operators import harvest, operations
from bidlake.plans.content import _has, _times
from bidlake.plans.procurement import _case, query

_STATE = "CASE cast(id % 4 AS int) WHEN 0 THEN 'failed' WHEN 1 THEN ' Unsupported' WHEN 2 THEN 'COMPLETED' END"


def _publications(spark, d):
    url = F.when(F.col("id") % 5 == 0, F.lit(" ")).otherwise(F.concat(F.lit(" "), "url"))
    return bridge.job_items(spark, d).select("id", url.alias("url"), F.expr(_STATE).alias("state"))


@query("failed_publications", oracle("SELECT id, url FROM items WHERE id % 4 = 0 AND id % 5 <> 0"))
def _(spark, d):
    return operations.publications(_publications(spark, d), failed_only=True).select("id", "url")


@query("supported_publications", oracle("SELECT id, url FROM items WHERE id % 4 <> 1 AND id % 5 <> 0"))
def _(spark, d):
    return operations.supported(_publications(spark, d))


@query("diverse_urls", oracle("SELECT min(id) AS id, arg_min(url, id) AS url FROM items WHERE id % 4 <> 1 AND id % 5 <> 0 GROUP BY regexp_extract(url, '^https?://([^/?#]*)', 1) ORDER BY 1 LIMIT 20"))
def _(spark, d):
    return operations.diverse(_publications(spark, d), 20)


@query("metrics_snapshot", oracle("SELECT concat(model, '{domain=', domain, ',success=', success, '}') AS key, count(*) AS \"count\", round(sum(runtime_units) / 100.0, 4) AS total_s, round(sum(runtime_units) / 100.0 / count(*), 4) AS avg_s FROM runs GROUP BY 1"))
def _(spark, d):
    return operations.metrics_snapshot(bridge.runs(spark, d), "model", ["success", "domain"], "runtime_units", 100)


@query("benchmark_grid", oracle("""SELECT m.model, u.url, coalesce(success AND runtime_units <= 8000, false) AS success, CASE WHEN runtime_units <= 8000 THEN downloaded ELSE 0 END AS downloaded, CASE WHEN runtime_units <= 8000 THEN iterations ELSE 0 END AS iterations,
CASE WHEN id IS NULL THEN 'not run' WHEN runtime_units > 8000 THEN 'hard timeout >80s' ELSE '' END AS notes FROM (SELECT DISTINCT model FROM runs) m CROSS JOIN (SELECT DISTINCT url FROM runs) u
LEFT JOIN (SELECT *, id % 3 AS iterations FROM (SELECT *, row_number() OVER (PARTITION BY model, url ORDER BY id) AS k FROM runs WHERE id % 10 > 6) WHERE k = 1) r ON r.model = m.model AND r.url = u.url"""))
def _(spark, d):
    runs = bridge.runs(spark, d)
    recorded = runs.filter("id % 10 > 6").withColumn("iterations", (F.col("id") % 3).cast("int"))
    return operations.benchmark_grid(runs, runs, recorded, 8000)


@query("stored_files", oracle("SELECT d.doc_id % 2000 AS job_id, (d.doc_id % 2000) * 100 + d.doc_id % 5 AS item_id, concat('d', d.doc_id, '.pdf') AS name, coalesce(i.domain, '') AS domain FROM documents d LEFT JOIN items i ON i.job_id = d.doc_id % 2000 AND i.id = (d.doc_id % 2000) * 100 + d.doc_id % 5"))
def _(spark, d):
    files = bridge.table(spark, d, "documents").selectExpr("doc_id % 2000 AS job_id", "(doc_id % 2000) * 100 + doc_id % 5 AS item_id", "concat('d', doc_id, '.pdf') AS name")
    return operations.stored_files(files, bridge.job_items(spark, d))


@query("errors_in_category", oracle("SELECT id, error_message FROM items WHERE status = 'failed' AND failure_category = 'captcha'"))
def _(spark, d):
    found = classify.with_classes(bridge.job_items(spark, d), "error_message", {"_category": classify.error_category(F.col("_value"))})
    return operations.errors_of(found, "captcha", F.col("_category")).select("id", "error_message")


# Cascades
_RISKY = {risk: ", ".join(f"'{c}'" for c in some) for risk, some in rules.RISKS.items()}


@query("cascade_replay", oracle(f"""SELECT * FROM (WITH tries AS (SELECT job_id AS item, row_number() OVER (PARTITION BY job_id ORDER BY id) AS place, strategy, status = 'success' AS won, failure_category AS category, id % 3 = 0 AS again FROM items WHERE status <> 'pending'),
told AS (SELECT item, place, strategy, won OR (category IN ({_RISKY['moderate']}) AND again) IS TRUE AS success, (category IN ({_RISKY['moderate']}) AND again) IS TRUE AS healed, (category IN ({_RISKY['high']})) IS TRUE AS stops, category FROM tries)
SELECT item, place, strategy, success, healed, category, CASE WHEN stops THEN '{harvest.ABORTED}' WHEN category IS NULL THEN '' ELSE {_case('category', rules.REASONS, "'something odd'")} END AS reason
FROM (SELECT *, min(CASE WHEN success OR stops THEN place END) OVER (PARTITION BY item) AS last FROM told) WHERE last IS NULL OR place <= last)"""))
def _(spark, d):
    items = bridge.job_items(spark, d).filter("status <> 'pending'")
    place = F.row_number().over(W.partitionBy("job_id").orderBy("id"))  # a job has few items
    return harvest.cascade_replay(items.select(F.col("job_id").alias("item"), place.alias("place"), "strategy", (F.col("status") == "success").alias("success"), F.col("error_message").alias("error"), (F.col("id") % 3 == 0).alias("retry_success")))


_KEY = "concat('54321-Tender-', lpad(id::VARCHAR, 12, 'a'))"


@query("portal_alternatives", oracle(f"""SELECT id, CASE WHEN contains(url, '/NetServer/') THEN concat_ws(' ', concat(b, '/NetServer/PublicationControllerServlet?function=Detail&TWOID=', k, '&PublicationType=0'), concat(b, '/NetServer/PublicationControllerServlet?function=Detail&TWOID=', k, '&PublicationType=4'),
concat(b, '/NetServer/TenderingProcedureDetails?function=_Details&TenderOID=', k), concat(b, '/NetServer/TenderingProcedureDetails?function=_Details&TenderOID=', k, '&view=documents')) ELSE '' END AS others FROM (SELECT id, url, {_KEY} AS k, regexp_extract(url, '^(https?://[^/?#]*)', 1) AS b FROM items)"""))
def _(spark, d):
    named = F.concat("url", F.lit("&TenderOID="), F.lit("54321-Tender-"), F.lpad(F.col("id").cast("string"), 12, "a"))
    return bridge.job_items(spark, d).select("id", F.array_join(urls.alternatives(named), " ").alias("others"))


_SIGNS = ", ".join(
    [f"CASE WHEN {_has(p)} THEN '{said}' END" for p, said in ((pages.PASSWORD, "password input field present"), (pages.LOGIN_FORM, "form posts to a login/auth endpoint"))]
    + [f"CASE WHEN {_times(pages.LOGIN_WORDS)} >= 2 THEN concat({_times(pages.LOGIN_WORDS)}, ' login-vocabulary matches') END"]
    + [f"CASE WHEN {_has(p)} THEN '{said}' END" for p, said in ((pages.REGISTER_WORDS, "registration prompt present"), (pages.GATED, "page text states documents require login/registration"), (pages.CAPTCHA, "CAPTCHA / bot-challenge markers"))]
    + [f"CASE WHEN {_times(pages.DOCUMENT_LINK)} > 0 THEN concat({_times(pages.DOCUMENT_LINK)}, ' public document link(s) present — not a hard wall') END"]
)


@query("wall_evidence", f"""SELECT page_id, CASE WHEN {_has(pages.EXPIRED)} THEN concat('expiry notice on page: "', substring(regexp_extract(t, '{pages.EXPIRED}', 0, 'i'), 1, 100), '"') ELSE concat_ws('; ', {_SIGNS}) END AS evidence FROM (SELECT page_id, substring(coalesce(html, ''), 1, {pages.SAMPLE}) AS t FROM pages)""")
def _(spark, d):
    return bridge.table(spark, d, "pages").select("page_id", F.array_join(pages.wall_evidence(F.col("html")), "; ").alias("evidence"))


def _running_hits() -> str:
    inner = "SELECT doc_id, coalesce(text, '') AS t, 0 AS hits FROM documents"
    for p in rules.INJECTIONS:
        quoted = p.replace("'", "''")
        inner = f"SELECT doc_id, regexp_replace(t, '{quoted}', '[REDACTED:injection]', 'gi') AS t, hits + regexp_matches(t, '{quoted}', 'i')::INT AS hits FROM ({inner})"
    return f"SELECT doc_id, sha256(t) AS redacted_sha256, hits FROM ({inner})"


@query("running_redaction", _running_hits())
def _(spark, d):
    rows = bridge.table(spark, d, "documents").select("doc_id", classify.redacted_with_hits(F.coalesce("text", F.lit(""))).alias("r"))
    return rows.select("doc_id", F.sha2(F.col("r.text"), 256).alias("redacted_sha256"), F.size("r.hits").alias("hits"))
