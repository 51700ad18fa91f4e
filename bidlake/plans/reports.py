"""Named queries: reports, life cycle, URL functions, replays and evaluation sets, each with the SQL that must give the same rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from bidlake import bridge
from bidlake.bridge import NOW, oracle
from bidlake.functions import classify, notices, rules, urls
from bidlake.operators import analytics, ordered, reports
from bidlake.plans.procurement import _case, query
from bidlake.sources import datasets

S, FAIL = "status = 'success'", "status = 'failed'"


def _items(spark, d):
    return bridge.job_items(spark, d)


# URLs
@query("page_urls", r"""SELECT page_id, regexp_extract(url, '^([A-Za-z][\w+.\-]*://[^/?#]*)', 1) AS origin, lower(regexp_extract(regexp_extract(url, '^([^?#]*)', 1), '\.([A-Za-z0-9]{1,5})$', 1)) AS extension,
substring(regexp_replace(regexp_replace(lower(regexp_extract(url, '^[A-Za-z][\w+.\-]*://([^/?#]*)', 1)), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g'), 1, 60) || '-' || substring(sha1(url), 1, 8) AS slug,
nullif(lower(regexp_extract(url, '(?i)^\s*https?://(?:www\.)?([^/?#:\s]+)', 1)), '') AS domain FROM pages""")
def _(spark, d):
    u = F.col("url")
    return bridge.table(spark, d, "pages").select("page_id", urls.part(u, 1).alias("origin"), urls.extension(u).alias("extension"), urls.site_slug(u).alias("slug"), urls.cell_domain(u).alias("domain"))


_HREFS = r"""SELECT DISTINCT page_id, url, unnest(list_filter(regexp_extract_all(html, '(?is)<a\b[^>]*?href\s*=\s*["'']([^"''>]*)["''][^>]*>(.*?)</a\s*>', 1), lambda h: h <> '' AND NOT regexp_matches(h, '(?i)^(#|javascript:|mailto:)'))) AS href FROM pages"""


def _hrefs(spark, d):
    from bidlake.functions import pages

    return bridge.table(spark, d, "pages").select("page_id", "url", F.explode(pages.links(F.col("html"))).alias("l")).select("page_id", "url", F.col("l.href").alias("href")).distinct()


_ORIGIN = r"regexp_extract(url, '^([A-Za-z][\w+.\-]*://[^/?#]*)', 1)"
_PATH = r"regexp_extract(url, '^[A-Za-z][\w+.\-]*://[^/?#]*([^?#]*)', 1)"


@query(
    "absolute_links",
    rf"""SELECT page_id, href, CASE WHEN regexp_matches(href, '^[A-Za-z][\w+.\-]*:') THEN href WHEN starts_with(href, '//') THEN regexp_extract(url, '^([A-Za-z][\w+.\-]*:)', 1) || href WHEN starts_with(href, '/') THEN {_ORIGIN} || href
WHEN starts_with(href, '?') THEN {_ORIGIN} || {_PATH} || href ELSE {_ORIGIN} || CASE WHEN regexp_extract({_PATH}, '^(.*/)', 1) = '' THEN '/' ELSE regexp_extract({_PATH}, '^(.*/)', 1) END || href END AS link,
regexp_extract(href, '^(?:[A-Za-z][\w+.\-]*:)?//([^/?#]*)', 1) NOT IN ('', regexp_extract(url, '^[A-Za-z][\w+.\-]*://([^/?#]*)', 1)) AS external FROM ({_HREFS})""",
)
def _(spark, d):
    h, u = F.col("href"), F.col("url")
    return _hrefs(spark, d).select("page_id", "href", urls.absolute(h, u).alias("link"), urls.is_external(h, u).alias("external"))


_ENDS = " OR ".join(f"ends_with(b, '{x}')" for x in urls.DOCUMENTS)
_SKIPS = " OR ".join(f"contains(lower(href), '{x}')" for x in urls.NO_TENDER)


@query("link_kinds", f"SELECT page_id, href, {_ENDS} OR regexp_matches(href, '{urls.DOWNLOADISH}', 'i') AS downloadish, {_SKIPS} AS no_tender FROM (SELECT *, lower(regexp_extract(href, '^([^?]*)', 1)) AS b FROM ({_HREFS}))")
def _(spark, d):
    return _hrefs(spark, d).select("page_id", "href", urls.downloadish(F.col("href")).alias("downloadish"), urls.no_tender(F.col("href")).alias("no_tender"))


_SHAPES = ["/NetServer/TenderingProcedureDetails?function=_DownloadTenderDocuments&x=", "/files/notice.HTML?v=", "/files/notice", "/DownloadTenderFiles.ashx?id=", "/page.htm#"]


@query("document_urls", oracle("SELECT id, cast(id % 5 AS int) NOT IN (1, 4) AS is_document FROM items"))
def _(spark, d):
    shaped = F.concat(F.lit("https://h.example.org"), F.element_at(F.array(*map(F.lit, _SHAPES)), (F.col("id") % 5 + 1).cast("int")), F.col("id").cast("string"))
    return _items(spark, d).select("id", urls.is_document_url(shaped).alias("is_document"))


@query(
    "netserver_urls",
    oracle(r"""SELECT id, b || 'TenderingProcedureDetails?function=_DownloadTenderDocuments&TenderOID=' || k AS first_url, b || 'PublicationControllerServlet?function=GetDocumentFile&TWOID=' || k AS third_url, k AS tender_id FROM
(SELECT id, regexp_extract(url, '^(https?://[^/?#]*)', 1) || '/NetServer/' AS b, CASE WHEN id % 3 < 2 THEN '54321-Tender-ab' || id END AS k FROM items)"""),
)
def _(spark, d):
    more = F.when(F.col("id") % 3 == 0, "&TenderOID=54321-Tender-ab").when(F.col("id") % 3 == 1, "#54321-Tender-ab").otherwise("#none-")
    rows = _items(spark, d).select("id", F.concat("url", more, F.col("id").cast("string")).alias("url"))
    found = rows.select("id", urls.netserver_urls(F.col("url")).alias("u"), urls.tender_id(F.col("url")).alias("tender_id"))
    return found.select("id", F.element_at("u", 1).alias("first_url"), F.element_at("u", 3).alias("third_url"), "tender_id")


_URL_PLATFORM = "CASE " + " ".join("WHEN " + " OR ".join("regexp_matches(url, '{}', 'i')".format(p.replace("'", "''")) for p in ([v] if isinstance(v, str) else v)) + f" THEN '{k}'" for k, v in rules.PLATFORMS.items()) + " ELSE 'unknown' END"
_MARKED = "CASE WHEN p <> 'unknown' THEN p " + " ".join("WHEN " + " OR ".join(f"contains(h, '{m.lower()}')" for m in v) + f" THEN '{k}'" for k, v in urls.PLATFORM_MARKS.items()) + " ELSE 'unknown' END"


@query("platform_of_pages", f"SELECT page_id, {_MARKED} AS platform FROM (SELECT page_id, {_URL_PLATFORM} AS p, lower(html) || CASE cast(page_id % 9 AS int) WHEN 1 THEN 'vmpsatellite' WHEN 2 THEN 'x cosinex' WHEN 3 THEN 'wicket' WHEN 4 THEN 'bundde' ELSE '' END AS h FROM pages)")
def _(spark, d):
    html = F.concat("html", F.expr("CASE cast(page_id % 9 AS int) WHEN 1 THEN 'VMPSatellite' WHEN 2 THEN 'x Cosinex' WHEN 3 THEN 'Wicket' WHEN 4 THEN 'bundde' ELSE '' END"))
    return bridge.table(spark, d, "pages").select("page_id", urls.page_platform(html, classify.platform(F.col("url"))).alias("platform"))


_WALLS = "CASE " + " ".join(f"WHEN regexp_matches(t, '{p}', 'i') THEN '{k}'" for k, p in urls.WALLS.items()) + " END"
_SIGNS = "CASE cast({id} % 8 AS int) WHEN 1 THEN ' Bitte melden Sie sich an ' WHEN 2 THEN ' hCaptcha ' WHEN 3 THEN ' Registration is required ' WHEN 4 THEN ' Nicht mehr VERFÜGBAR ' ELSE '' END"


@query("wall_reasons", f"SELECT page_id, {_WALLS} AS reason FROM (SELECT page_id, html || {_SIGNS.format(id='page_id')} AS t FROM pages)")
def _(spark, d):
    return bridge.table(spark, d, "pages").select("page_id", urls.wall(F.concat("html", F.expr(_SIGNS.format(id="page_id")))).alias("reason"))


@query("persisted_documents", "SELECT doc_id, sha256(coalesce(text, '')) AS checksum, strlen(coalesce(text, '')) AS size, CASE cast(doc_id % 3 AS int) WHEN 0 THEN 'application/pdf' WHEN 1 THEN 'text/plain' ELSE 'application/octet-stream' END AS mime, 1 AS version FROM documents")
def _(spark, d):
    name = F.concat(F.lit("d."), F.element_at(F.array(*map(F.lit, ["pdf", "TXT", "xyz"])), (F.col("doc_id") % 3 + 1).cast("int")))
    text = F.coalesce("text", F.lit(""))
    return bridge.table(spark, d, "documents").select("doc_id", F.sha2(text, 256).alias("checksum"), F.octet_length(text).cast("long").alias("size"), urls.mime(urls.extension(name)).alias("mime"), F.lit(1).alias("version"))


@query("text_heads", r"""SELECT doc_id, CASE WHEN length(t) > 80 THEN rtrim(substring(t, 1, 79)) || '…' ELSE t END AS short, trim(regexp_replace(lower(substring(t, 1, 60)), '[^a-z0-9äöüß]+', ' ', 'g')) AS label,
CASE WHEN strlen(t) < 1024 THEN strlen(t) || ' B' WHEN strlen(t) < 1048576 THEN regexp_replace(cast(round(strlen(t) / 1024.0, 1) AS varchar), '\.0$', '') || ' KB' ELSE regexp_replace(cast(round(strlen(t) / 1048576.0, 1) AS varchar), '\.0$', '') || ' MB' END AS size FROM (SELECT doc_id, coalesce(text, '') AS t FROM documents)""")
def _(spark, d):
    t = F.coalesce("text", F.lit(""))
    return bridge.table(spark, d, "documents").select("doc_id", urls.shortened(t, 80).alias("short"), urls.label(F.substring(t, 1, 60)).alias("label"), urls.human_bytes(F.octet_length(t)).alias("size"))


@query("client_ips", oracle("SELECT id, CASE cast(id % 3 AS int) WHEN 0 THEN '10.1.' || id % 200 || '.1' ELSE '192.0.2.7' END AS ip, least(8.0, pow(2.0, iterations - 1)) AS wait FROM items"))
def _(spark, d):
    passed = F.expr("CASE cast(id % 3 AS int) WHEN 0 THEN concat(' 10.1.', cast(id % 200 AS string), '.1, 198.51.100.2') WHEN 1 THEN '' END")
    return _items(spark, d).select("id", urls.client_ip(passed, F.lit("192.0.2.7")).alias("ip"), urls.backoff(F.col("iterations")).alias("wait"))


@query("error_reasons", oracle(f"SELECT id, {_case('failure_category', rules.REASONS, 'NULL')} AS reason FROM items WHERE {FAIL}"))
def _(spark, d):
    category = classify.error_category(F.col("error_message"))
    return _items(spark, d).filter(FAIL).select("id", classify.looked_up(category, rules.REASONS, None).alias("reason"))


# Jobs and items
@query("resumed_chunk", oracle(f"SELECT id FROM items WHERE job_id IN (SELECT id FROM jobs WHERE cost_units % 2 = 0) AND NOT {S}"))
def _(spark, d):
    chunk = bridge.jobs(spark, d).filter("cost_units % 2 = 0").select(F.col("id").alias("job_id"))
    return _items(spark, d).join(chunk, "job_id", "left_semi").filter(F.col("status") != "success").select("id")


@query("job_tabs", oracle(f"""SELECT job_id, CASE WHEN bool_or(status = 'pending') THEN 'active' WHEN bool_or({S}) THEN 'completed' ELSE 'failed' END AS tab, bool_or(contains(domain, 's7.')) AS found FROM items GROUP BY 1"""))
def _(spark, d):
    some = lambda c: F.bool_or(c)  # noqa: E731
    tab = F.when(some(F.col("status") == "pending"), "active").when(some(F.expr(S)), "completed").otherwise("failed")
    return _items(spark, d).groupBy("job_id").agg(tab.alias("tab"), some(F.col("domain").contains("s7.")).alias("found"))


@query("job_metrics", oracle(f"""SELECT tab, count(*) AS jobs, cast(sum(s) AS bigint) AS successes, cast(sum(coalesce(cost_units, 0)) AS bigint) AS cost_units FROM
(SELECT job_id, CASE WHEN bool_or(status = 'pending') THEN 'active' WHEN bool_or({S}) THEN 'completed' ELSE 'failed' END AS tab, count(*) FILTER ({S}) AS s FROM items GROUP BY 1) LEFT JOIN jobs ON jobs.id = job_id GROUP BY 1"""))
def _(spark, d):
    tab = F.when(F.bool_or(F.col("status") == "pending"), "active").when(F.bool_or(F.expr(S)), "completed").otherwise("failed")
    each = _items(spark, d).groupBy("job_id").agg(tab.alias("tab"), F.count_if(F.expr(S)).alias("s"))
    cost = bridge.jobs(spark, d).select(F.col("id").alias("job_id"), "cost_units")
    return each.join(cost, "job_id", "left").groupBy("tab").agg(F.count(F.lit(1)).alias("jobs"), F.sum("s").alias("successes"), F.sum(F.coalesce("cost_units", F.lit(0))).alias("cost_units"))


@query("audit_search", oracle("SELECT id FROM audit WHERE contains(lower(event_type), 'purch') OR contains(lower(level), 'purch') OR contains(lower(message), 'purch') OR contains(cast(job_id AS varchar), 'purch')"))
def _(spark, d):
    cells = ["event_type", "level", "message", "job_id"]
    hit = F.lit(False)
    for c in cells:
        hit = hit | F.coalesce(F.lower(F.col(c).cast("string")).contains("purch"), F.lit(False))
    return bridge.audit_logs(spark, d).filter(hit).select("id")


@query("cell_domains", oracle("SELECT DISTINCT regexp_extract(url, '^https?://(?:www\\.)?([^/?#:]+)', 1) AS domain FROM items"))
def _(spark, d):
    cells = _items(spark, d).select(F.explode(F.array("url", "tender_title", "status")).alias("cell"))
    return cells.select(urls.cell_domain(F.col("cell")).alias("domain")).filter("domain is not null").distinct()


@query("rows_of_domain", oracle("SELECT id FROM items WHERE contains(url, '://www.dtvp.de/')"))
def _(spark, d):
    domain = F.coalesce(*[urls.cell_domain(F.col(c)) for c in ("tender_title", "url")])
    return _items(spark, d).filter(domain == "dtvp.de").select("id")


@query("job_item_documents", oracle(f"SELECT j.id AS job_id, i.id AS item_id, e.doc_id FROM jobs j JOIN items i ON i.job_id = j.id JOIN documents e ON e.doc_id = i.id % 1000 WHERE i.{S}"))
def _(spark, d):
    docs = bridge.table(spark, d, "documents").select("doc_id")
    joined = bridge.jobs(spark, d).select(F.col("id").alias("job_id")).join(_items(spark, d).filter(S).select(F.col("id").alias("item_id"), "job_id"), "job_id")
    return joined.join(docs, F.col("item_id") % 1000 == F.col("doc_id"))


@query("item_titles", oracle("SELECT job_id, string_agg(tender_title, chr(10) || chr(10) ORDER BY id) AS text FROM items GROUP BY 1"))
def _(spark, d):
    rows = _items(spark, d).groupBy("job_id").agg(F.sort_array(F.collect_list(F.struct("id", "tender_title"))).alias("r"))  # a job has few items
    return rows.select("job_id", F.array_join("r.tender_title", "\n\n").alias("text"))


@query("extractions", oracle("""SELECT id, tender_title AS title, CASE WHEN id % 4 = 0 THEN NULL ELSE tender_reference END AS reference, deadline, 1 + cast(id % 4 <> 0 AS int) + cast(deadline IS NOT NULL AS int) AS filled FROM items"""))
def _(spark, d):
    reference = F.when(F.col("id") % 4 != 0, F.col("tender_reference"))
    said = _items(spark, d).select("id", F.to_json(F.struct(F.col("tender_title").alias("title"), reference.alias("reference"), F.date_format("deadline", "yyyy-MM-dd HH:mm:ss").alias("deadline")), {"ignoreNullFields": "false"}).alias("json"))
    read = said.select("id", F.from_json("json", "title string, reference string, deadline string").alias("f")).select("id", "f.*")
    filled = sum(F.when(F.coalesce(F.col(c), F.lit("")) != "", 1).otherwise(0) for c in ("title", "reference", "deadline"))
    return read.select("id", "title", "reference", F.to_timestamp_ntz("deadline", F.lit("yyyy-MM-dd HH:mm:ss")).alias("deadline"), filled.alias("filled"))


@query("latest_extractions", oracle("SELECT id, tender_title FROM items ORDER BY deadline DESC NULLS LAST, id LIMIT 50"))
def _(spark, d):
    return _items(spark, d).orderBy(F.col("deadline").desc_nulls_last(), "id").limit(50).select("id", "tender_title")


@query("created_items", oracle("SELECT job_id, cast(row_number() OVER (PARTITION BY job_id ORDER BY id) AS int) AS item, url, 'pending' AS status FROM items WHERE id % 7 <> 0"))
def _(spark, d):
    blank = F.when(F.col("id") % 7 == 0, "  ").otherwise(F.concat(F.lit(" "), "url"))
    return reports.created(_items(spark, d).select("job_id", F.col("id").alias("position"), blank.alias("url")))


_STOP = "job_id IN (SELECT id FROM jobs WHERE cost_units % 3 = 0)"


def _chosen(spark, d):
    return bridge.jobs(spark, d).filter("cost_units % 3 = 0").select(F.col("id").alias("job_id"))


@query("stopped_items", oracle(f"SELECT id, job_id, CASE WHEN status = 'pending' AND {_STOP} THEN 'failed' ELSE status END AS status, CASE WHEN status = 'pending' AND {_STOP} THEN 'Stopped by user' ELSE error_message END AS error_message FROM items"))
def _(spark, d):
    return reports.stopped(_items(spark, d), _chosen(spark, d))


@query("deleted_jobs", oracle(f"SELECT id FROM items WHERE NOT {_STOP}"))
def _(spark, d):
    return reports.without_jobs(_items(spark, d), _chosen(spark, d)).select("id")


@query("reset_jobs", oracle(f"SELECT id, CASE WHEN p AND created_at < TIMESTAMP '{NOW}' - INTERVAL 24 HOURS THEN 'failed' WHEN p THEN 'running' ELSE 'done' END AS status FROM jobs JOIN (SELECT job_id, bool_or(status = 'pending') AS p FROM items GROUP BY 1) ON id = job_id"))
def _(spark, d):
    running = _items(spark, d).groupBy(F.col("job_id").alias("id")).agg(F.bool_or(F.col("status") == "pending").alias("p"))
    stale = F.col("created_at") < F.lit(NOW).cast("timestamp_ntz") - F.expr("INTERVAL 24 HOURS")
    status = F.when(F.col("p") & stale, "failed").when(F.col("p"), "running").otherwise("done")
    return bridge.jobs(spark, d).join(running, "id").select("id", status.alias("status"))


# Templates
def _templates(spark, d):
    source = F.element_at(F.array(*map(F.lit, ["disk", "cua", "manual", "llm"])), (F.col("s_suppkey") % 4 + 1).cast("int"))
    rows = bridge.table(spark, d, "supplier").filter("s_suppkey % 5 <> 0")
    return rows.select(F.concat(F.lit("s"), F.col("s_suppkey").cast("string"), F.lit(".example.org")).alias("domain"), source.alias("source"), (F.col("s_suppkey") % 11 == 0).alias("retired"), F.concat(F.lit("c"), F.col("s_suppkey").cast("string")).alias("code"))


_TEMPLATES = "(SELECT 's' || s_suppkey || '.example.org' AS domain, CASE cast(s_suppkey % 4 AS int) WHEN 0 THEN 'disk' WHEN 1 THEN 'cua' WHEN 2 THEN 'manual' ELSE 'llm' END AS source, s_suppkey % 11 = 0 AS retired, 'c' || s_suppkey AS code FROM supplier WHERE s_suppkey % 5 <> 0)"


@query("template_guards", oracle(f"SELECT id, CASE WHEN source IS NULL THEN 'no_template' WHEN source = 'cua' THEN 'agent_template' WHEN retired THEN 'retired' ELSE 'hit' END AS guard FROM items LEFT JOIN {_TEMPLATES} t ON t.domain = items.domain"))
def _(spark, d):
    return reports.guarded(_items(spark, d), _templates(spark, d))


@query("manual_templates", f"SELECT domain, source, code FROM {_TEMPLATES} WHERE source = 'manual' OR retired = false UNION ALL SELECT domain, 'manual', 'new' FROM {_TEMPLATES} WHERE retired AND source <> 'manual'")
def _(spark, d):
    t = _templates(spark, d)
    return reports.registered(t, t.filter("retired").select("domain", F.lit("new").alias("code")))


# Replays
def _replay_sql(most: str, stops: list[str]) -> str:
    inside = ", ".join(f"'{s}'" for s in stops) or "''"
    return f"""SELECT job_id, attempt, id, status FROM (SELECT *, cast(row_number() OVER w AS int) AS attempt, coalesce(bool_or({S} OR coalesce(failure_category IN ({inside}), false)) OVER (PARTITION BY job_id ORDER BY id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), false) AS done
FROM items WINDOW w AS (PARTITION BY job_id ORDER BY id)) WHERE NOT done AND {most}"""


@query("cascade_attempts", oracle(_replay_sql("true", reports.ABORTING)))
def _(spark, d):
    return reports.replayed(_items(spark, d), None, reports.ABORTING)


@query("agent_attempts", oracle(_replay_sql("attempt <= 2", reports.FINAL)))
def _(spark, d):
    return reports.replayed(_items(spark, d), 2, reports.FINAL)


@query("feedback_loops", oracle(f"SELECT job_id, count(*) AS attempts, bool_or({S}) AS success FROM ({_replay_sql('attempt <= 3', reports.HARD_WALLS)}) GROUP BY 1"))
def _(spark, d):
    return reports.outcomes(reports.replayed(_items(spark, d), 3, reports.HARD_WALLS))


@query("attempt_report", oracle(f"""SELECT job_id, cast(row_number() OVER (PARTITION BY job_id ORDER BY iterations, id) AS int) AS attempt, id, strategy, {S} AS success, cast(runtime_seconds AS double) AS duration_s FROM items WHERE job_id IN (SELECT job_id FROM items WHERE {FAIL})"""))
def _(spark, d):
    items = _items(spark, d)
    return analytics.attempt_report(items, analytics.attempts_of(items))


# Reports
@query("cascade_wins", oracle(f"SELECT domain, strategy, count(*) AS wins FROM (SELECT *, row_number() OVER (PARTITION BY job_id ORDER BY id) AS k FROM items WHERE {S}) WHERE k = 1 GROUP BY 1, 2"))
def _(spark, d):
    return reports.cascade_wins(_items(spark, d))


@query("cascade_matrix", oracle("SELECT domain, " + ", ".join(f"count(*) FILTER (strategy = '{s}') AS {s}" for s in bridge.CASCADE) + f" FROM (SELECT *, row_number() OVER (PARTITION BY job_id ORDER BY id) AS k FROM items WHERE {S}) WHERE k = 1 GROUP BY 1"))
def _(spark, d):
    return reports.cascade_wins(_items(spark, d)).groupBy("domain").pivot("strategy", bridge.CASCADE).agg(F.sum("wins")).na.fill(0)


_TIER = "CASE cast(user_id % 3 AS int) WHEN 0 THEN 'public' WHEN 1 THEN 'login' ELSE 'gone' END"


@query("solved_by_tier", oracle(f"SELECT {_TIER.replace('user_id', 'cast(url AS bigint)')} AS tier, count(*) AS urls, count(*) FILTER (solved) AS solved FROM (SELECT url, bool_or(success) AS solved FROM runs GROUP BY 1) GROUP BY 1"))
def _(spark, d):
    tiers = bridge.table(spark, d, "events").select("user_id").distinct().select(F.col("user_id").cast("string").alias("url"), F.expr(_TIER).alias("tier"))
    each = bridge.runs(spark, d).groupBy("url").agg(F.bool_or("success").alias("solved"))
    return each.join(tiers, "url").groupBy("tier").agg(F.count(F.lit(1)).alias("urls"), F.count_if("solved").alias("solved"))


@query("ground_truth", oracle("""SELECT t.url, t.expected, coalesce(got, 0) AS got, CASE WHEN got IS NULL THEN 'Missing' WHEN got = 0 THEN 'Failed' WHEN got < t.expected THEN 'Under' WHEN got > t.expected THEN 'Over' ELSE 'Exact' END AS flag,
CASE WHEN t.expected > 0 THEN least(1.0, coalesce(got, 0) / cast(t.expected AS double)) WHEN coalesce(got, 0) > 0 THEN 1.0 ELSE 0.0 END AS recall FROM (SELECT url, max(expected) AS expected FROM runs GROUP BY 1) t LEFT JOIN (SELECT url, max(downloaded) AS got FROM runs WHERE model = 'view' GROUP BY 1) r ON r.url = t.url"""))
def _(spark, d):
    runs = bridge.runs(spark, d)
    return reports.ground_truth(runs.filter("model = 'view'").groupBy("url").agg(F.max("downloaded").alias("got")), runs.groupBy("url").agg(F.max("expected").alias("expected")))


@query("report_mismatches", oracle("""SELECT coalesce(x.model, y.model) AS model, coalesce(x.url, y.url) AS url, a, b, CASE WHEN y.url IS NULL THEN 'only_left' WHEN x.url IS NULL THEN 'only_right' ELSE 'differs' END AS kind FROM
(SELECT model, url, sum(downloaded)::BIGINT AS a FROM runs WHERE expected <> 0 GROUP BY 1, 2) x FULL JOIN (SELECT model, url, sum(downloaded)::BIGINT AS b FROM runs WHERE expected <> 1 GROUP BY 1, 2) y ON x.model = y.model AND x.url = y.url WHERE a IS DISTINCT FROM b"""))
def _(spark, d):
    side = lambda c: bridge.runs(spark, d).filter(c).groupBy("model", "url").agg(F.sum("downloaded").alias("got"))  # noqa: E731
    return reports.mismatches(side("expected <> 0"), side("expected <> 1"), ["model", "url"], "got")


_PRICES = [("view", 3, 15), ("click", 1, 5), ("purchase", 2, 8)]


@query("run_costs", oracle("SELECT id, (runtime_units * CASE model WHEN 'view' THEN 3 WHEN 'click' THEN 1 WHEN 'purchase' THEN 2 ELSE 0 END + downloaded * CASE model WHEN 'view' THEN 15 WHEN 'click' THEN 5 WHEN 'purchase' THEN 8 ELSE 0 END) / 1e6 AS cost FROM runs"))
def _(spark, d):
    prices = spark.createDataFrame(_PRICES, "model string, price_in int, price_out int")
    runs = bridge.runs(spark, d).select("id", "model", F.col("runtime_units").alias("tokens_in"), F.col("downloaded").alias("tokens_out"))
    return reports.costs(runs, prices)


@query("model_report", oracle("""SELECT model, count(*) AS runs, count(*) FILTER (success) AS solved, min(runtime_units) AS shortest, max(runtime_units) AS longest, sum(downloaded)::BIGINT AS documents, sum(runtime_units)::DOUBLE / nullif(count(*) FILTER (success), 0) AS per_success,
sum(runtime_units)::DOUBLE / nullif(sum(downloaded), 0) AS per_document, list_sort(list(runtime_units))[count(*) // 2 + 1] AS upper_median FROM runs GROUP BY 1"""))
def _(spark, d):
    return reports.model_report(bridge.runs(spark, d))


@query("failure_causes", oracle(f"SELECT strategy, cause, n, n / cast(sum(n) OVER (PARTITION BY strategy) AS double) AS share FROM (SELECT strategy, substring(error_message, 1, 120) AS cause, count(*) AS n FROM items WHERE {FAIL} GROUP BY 1, 2)"))
def _(spark, d):
    return reports.causes(_items(spark, d), "strategy")


@query("pipeline_totals", oracle(f"SELECT count(*) AS total, count(*) FILTER ({S}) AS success, count(*) FILTER ({S}) / cast(count(*) AS double) AS rate, count(DISTINCT strategy) AS strategies, count(DISTINCT domain) AS domains FROM items WHERE status IN ('success', 'failed')"))
def _(spark, d):
    done = _items(spark, d).filter(F.col("status").isin("success", "failed"))
    won = F.count_if(F.expr(S))
    return done.agg(F.count(F.lit(1)).alias("total"), won.alias("success"), (won / F.count(F.lit(1))).alias("rate"), F.countDistinct("strategy").alias("strategies"), F.countDistinct("domain").alias("domains"))


@query("domain_summary", oracle(f"SELECT domain, count(*) AS total, count(*) FILTER ({S}) AS success, count(*) FILTER ({FAIL}) AS failed, round(100.0 * count(*) FILTER ({S}) / count(*), 1) AS percent FROM items GROUP BY 1"))
def _(spark, d):
    won = F.count_if(F.expr(S))
    each = _items(spark, d).groupBy("domain").agg(F.count(F.lit(1)).alias("total"), won.alias("success"), F.count_if(F.expr(FAIL)).alias("failed"), F.round(100.0 * won / F.count(F.lit(1)), 1).alias("percent"))
    return each.orderBy(F.desc("total"), "domain")


@query("status_by_platform", oracle("SELECT known_platform AS platform, status, count(*) AS n, count(*) FILTER (strategy = 'llm_generated') AS fresh, count(*) FILTER (strategy = 'existing') AS cached FROM items GROUP BY 1, 2"))
def _(spark, d):
    rows = _items(spark, d).groupBy("url", "status", "strategy").agg(F.count(F.lit(1)).alias("n"))  # each different URL is classified once
    counted = lambda s: F.coalesce(F.sum(F.when(F.col("strategy") == s, F.col("n"))), F.lit(0))  # noqa: E731
    return rows.groupBy(classify.platform(F.col("url")).alias("platform"), "status").agg(F.sum("n").alias("n"), counted("llm_generated").alias("fresh"), counted("existing").alias("cached"))


@query("failure_breakdown", oracle(f"SELECT job_id, failure_category, count(*) AS n FROM items WHERE {FAIL} GROUP BY 1, 2"))
def _(spark, d):
    return _items(spark, d).filter(FAIL).groupBy("job_id", "failure_category").agg(F.count(F.lit(1)).alias("n"))


@query("extraction_totals", oracle("SELECT count(*) FILTER (deadline IS NOT NULL) AS extracted, count(*) FILTER (deadline IS NULL) AS failed, count(*) FILTER (url LIKE 'https://www.%') AS live FROM items"))
def _(spark, d):
    return _items(spark, d).agg(F.count("deadline").alias("extracted"), F.count_if(F.col("deadline").isNull()).alias("failed"), F.count_if(F.col("url").startswith("https://www.")).alias("live"))


@query("agents_mean", oracle(f"SELECT count(*) AS agents, cast(sum(n) AS bigint) AS items, avg(r) AS mean_rate FROM (SELECT domain, count(*) AS n, count(*) FILTER ({S}) / cast(count(*) AS double) AS r FROM items GROUP BY 1)"))
def _(spark, d):
    each = _items(spark, d).groupBy("domain").agg(F.count(F.lit(1)).alias("n"), (F.count_if(F.expr(S)) / F.count(F.lit(1))).alias("r"))
    return each.agg(F.count(F.lit(1)).alias("agents"), F.sum("n").alias("items"), F.avg("r").alias("mean_rate"))


@query("extension_overlap", oracle("SELECT job_id, list_sort(list_intersect(list(DISTINCT model) FILTER (success), list(DISTINCT model) FILTER (NOT success))) AS both FROM (SELECT url AS job_id, model, success FROM runs) GROUP BY 1 HAVING count(*) FILTER (success) > 0 AND count(*) FILTER (NOT success) > 0"))
def _(spark, d):
    sets = bridge.runs(spark, d).groupBy(F.col("url").alias("job_id")).agg(F.collect_set(F.when(F.col("success"), F.col("model"))).alias("a"), F.collect_set(F.when(~F.col("success"), F.col("model"))).alias("b"))  # few models
    return sets.filter("size(a) > 0 and size(b) > 0").select("job_id", F.sort_array(F.array_intersect("a", "b")).alias("both"))


@query("progress_rates", oracle(f"SELECT job_id, count(*) FILTER (status <> 'pending') AS done, 60.0 * count(*) FILTER (status <> 'pending') / sum(runtime_seconds) AS per_minute, count(*) FILTER (status = 'pending') * sum(runtime_seconds) / 60.0 / nullif(count(*) FILTER (status <> 'pending'), 0) AS minutes_left FROM items GROUP BY 1"))
def _(spark, d):
    done, left, spent = F.count_if(F.col("status") != "pending"), F.count_if(F.col("status") == "pending"), F.sum("runtime_seconds")
    return _items(spark, d).groupBy("job_id").agg(done.alias("done"), (60.0 * done / spent).alias("per_minute"), (left * spent / 60.0 / F.when(done > 0, done)).alias("minutes_left"))


# Evaluation sets
@query("dataset_lines", "SELECT 'https://c' || c_custkey || '.example.org/' AS url, CASE WHEN c_custkey % 5 = 1 THEN 1 ELSE c_custkey % 7 END AS expected, 'c' || c_custkey AS domain FROM customer WHERE c_custkey % 5 NOT IN (0, 2)")
def _(spark, d):
    line = F.expr("""CASE cast(c_custkey % 5 AS int) WHEN 0 THEN concat('# ', c_name) WHEN 2 THEN '   ' WHEN 1 THEN concat('{"url": "https://c', c_custkey, '.example.org/", "domain": "c', c_custkey, '"}')
ELSE concat(' {"url": "https://c', c_custkey, '.example.org/", "expected": ', c_custkey % 7, ', "domain": "c', c_custkey, '"}') END""")
    return datasets.json_lines(bridge.table(spark, d, "customer").select(line.alias("value")))


@query("dataset_table", oracle(f"SELECT domain, url, 1 AS expected, 'zip' AS kind FROM (SELECT *, row_number() OVER (PARTITION BY domain ORDER BY id) AS k FROM items WHERE {S} AND domain NOT IN (SELECT domain FROM seeds)) WHERE k = 1"))
def _(spark, d):
    rows = _items(spark, d).select("id", "domain", "url", F.when(F.expr(S), "COMPLETED").otherwise("OTHER").alias("state"))
    return datasets.completed_first(rows, bridge.seed_portals(spark, d))


@query("url_pairs", oracle("SELECT domain, max(CASE WHEN k = 1 THEN url END) AS url, max(CASE WHEN k = 2 THEN url END) AS backup FROM (SELECT domain, url, row_number() OVER (PARTITION BY domain ORDER BY min(id)) AS k FROM items GROUP BY 1, 2) WHERE k <= 2 GROUP BY 1"))
def _(spark, d):
    return datasets.url_pairs(_items(spark, d))


@query("smart_batch", oracle("SELECT count(*) AS domains, count(*) FILTER (n > 1) AS with_backup FROM (SELECT domain, count(DISTINCT url) AS n FROM items GROUP BY 1)"))
def _(spark, d):
    return datasets.url_pairs(_items(spark, d)).agg(F.count(F.lit(1)).alias("domains"), F.count("backup").alias("with_backup"))


@query("newest_runs", oracle("SELECT id, model FROM runs ORDER BY created_at DESC, id DESC LIMIT 100"))
def _(spark, d):
    return bridge.runs(spark, d).orderBy(F.desc("created_at"), F.desc("id")).limit(100).select("id", "model")


@query("scrapers_by_success", oracle(f"SELECT domain, count(*) FILTER ({S}) AS success_count FROM items GROUP BY 1"))
def _(spark, d):
    return _items(spark, d).groupBy("domain").agg(F.count_if(F.expr(S)).alias("success_count")).orderBy(F.desc("success_count"), "domain")


@query("batch_rows", oracle(f"SELECT url, n, {_case('known_type', {k: str(round(v[0] * 100)) for k, v in rules.URL_TYPES.items()}, str(round(rules.UNKNOWN_SUCCESS * 100)))}::BIGINT AS percent, known_type AS url_type FROM (SELECT url, any_value(known_type) AS known_type, count(*) AS n FROM items GROUP BY 1)"))
def _(spark, d):
    each = _items(spark, d).groupBy("url").agg(F.count(F.lit(1)).alias("n")).withColumn("url_type", classify.url_type(F.col("url")))
    return each.select("url", "n", F.round(classify.expected_success(F.col("url_type")) * 100).cast("long").alias("percent"), "url_type")


@query("type_histogram", oracle("SELECT known_type AS url_type, count(*) AS urls, cast(sum(n) AS bigint) AS items FROM (SELECT url, any_value(known_type) AS known_type, count(*) AS n FROM items GROUP BY 1) GROUP BY 1"))
def _(spark, d):
    each = _items(spark, d).groupBy("url").agg(F.count(F.lit(1)).alias("n"))
    return each.groupBy(classify.url_type(F.col("url")).alias("url_type")).agg(F.count(F.lit(1)).alias("urls"), F.sum("n").alias("items"))


@query("snapshot_names", "SELECT change, filename, row_number() OVER (PARTITION BY change ORDER BY filename) AS nth FROM (SELECT coalesce(a.f, b.f) AS filename, CASE WHEN a.f IS NULL THEN 'added' WHEN b.f IS NULL THEN 'removed' END AS change FROM (SELECT concat('d', doc_id, '.pdf') AS f FROM documents WHERE doc_id % 13 <> 0) a FULL JOIN (SELECT concat('d', doc_id, '.pdf') AS f FROM documents WHERE doc_id % 11 <> 0) b ON a.f = b.f) WHERE change IS NOT NULL")
def _(spark, d):
    delta = ordered.snapshot_delta(*bridge.snapshots(spark, d)).filter("change <> 'modified'")
    return ordered.numbered(delta, "change", ["filename"]).select("change", "filename", "nth")


# Notices
_FORMS = ["yyyy-MM-dd", "dd/MM/yyyy", "d.M.yyyy", "dd.MM.yy", "d-MMM-yy", "d MMMM yyyy", "MMMM d, yyyy"]


@query("iso_dates", """SELECT o_orderkey AS id, CASE cast(o_orderkey % 9 AS int) WHEN 7 THEN 'soon ' || o_orderkey WHEN 8 THEN NULL ELSE strftime(o_orderdate, '%Y-%m-%d') END AS value, CASE WHEN o_orderkey % 9 <> 8 THEN o_orderkey % 9 = 7 END AS low_confidence FROM orders""")
def _(spark, d):
    raw = F.when(F.col("o_orderkey") % 9 == 7, F.concat(F.lit("soon "), F.col("o_orderkey").cast("string"))).when(F.col("o_orderkey") % 9 == 8, "  ")
    for i, form in enumerate(_FORMS):
        raw = raw.when(F.col("o_orderkey") % 9 == i, F.concat(F.lit("" if i == 3 else " bis "), F.date_format("o_orderdate", form)))
    return bridge.dealt(bridge.table(spark, d, "orders").select("o_orderkey", "o_orderdate"), "o_orderkey").select(F.col("o_orderkey").alias("id"), notices.iso_date(raw).alias("f")).select("id", "f.value", "f.low_confidence")


@query("tender_kinds", "SELECT doc_id, CASE cast(doc_id % 4 AS int) WHEN 0 THEN 'Restricted' WHEN 1 THEN 'RFQ' WHEN 2 THEN 'Open' END AS value, CASE cast(doc_id % 4 AS int) WHEN 0 THEN 0.9 WHEN 1 THEN 0.7 WHEN 2 THEN 0.9 ELSE 0.0 END::DOUBLE AS confidence FROM documents")
def _(spark, d):
    text = F.element_at(F.array(*map(F.lit, ["A Selective Tender and RFQ", "this rfq", "Öffentliche Ausschreibung, RFQ", "a notice"])), (F.col("doc_id") % 4 + 1).cast("int"))
    return bridge.table(spark, d, "documents").select("doc_id", notices.tender_kind(text).alias("k")).select("doc_id", "k.value", "k.confidence")


@query("labelled_values", """SELECT c_custkey AS id, CASE WHEN c_custkey % 3 = 0 THEN NULL ELSE c_name END AS value, CASE WHEN c_custkey % 2 = 0 THEN 'one' || chr(10) || 'TWO WORDS' || chr(10) || 'three' ELSE 'one' || chr(10) || 'TWO WORDS' || chr(10) || 'three' || chr(10) || 'four of ' || c_custkey END AS body FROM customer""")
def _(spark, d):
    lit, c = F.lit, F.col
    lines = F.array(lit("Notice"), lit("Name of Buyer:"), lit(""), F.when(c("c_custkey") % 3 == 0, "Address:").otherwise(F.concat(lit("  "), "c_name")), lit("Scope of work"), lit("one"), lit("TWO WORDS"), lit(" three"), F.when(c("c_custkey") % 2 == 0, "THE NEXT PART").otherwise(F.concat(lit("four of "), c("c_custkey").cast("string"))))
    return bridge.table(spark, d, "customer").select(c("c_custkey").alias("id"), notices.value_below(lines, "name of buyer").alias("value"), notices.section_body(lines, ["scope of work"]).alias("body"))


@query("table_values", """SELECT c_custkey AS id, CASE WHEN c_custkey % 2 = 0 THEN 'key_value' ELSE 'data_table' END AS layout, CASE WHEN c_custkey % 2 = 0 THEN 2 ELSE 1 END AS n_labels, CASE WHEN c_custkey % 2 = 0 THEN c_name END AS buyer FROM customer""")
def _(spark, d):
    row = lambda *cells: F.array(*[F.lit(x) if isinstance(x, str) else x for x in cells])  # noqa: E731
    pairs = F.array(row("Reference:", "R1"), row("Name of the Buyer:", "old"), row("", "x"), row("Name of the Buyer", F.col("c_name")))
    data = F.array(row("a", "1", "x"), row("a", "2", "y"), row("a", "3", "z"), row(" A ", "4", ""))
    rows = F.when(F.col("c_custkey") % 2 == 0, pairs).otherwise(data)
    columns = F.when(F.col("c_custkey") % 2 == 0, 2).otherwise(3)
    read = bridge.table(spark, d, "customer").select(F.col("c_custkey").alias("id"), notices.layout(rows, columns).alias("layout"), notices.key_values(rows).alias("kv"))
    return read.select("id", "layout", F.when(F.col("layout") == "key_value", F.size("kv")).otherwise(1).alias("n_labels"), F.when(F.col("layout") == "key_value", notices.value_of(F.col("kv"), ["buyer", "contracting authority"])).alias("buyer"))


_BARE = "html"
for _tag in ("script", "style", "header", "footer", "nav"):
    _BARE = f"regexp_replace({_BARE}, '(?s)<{_tag}[^>]*>.*?</{_tag}>', ' ', 'g')"


@query("readable_pages", rf"SELECT page_id, trim(regexp_replace(regexp_replace({_BARE}, '<[^>]+>', ' ', 'g'), '\s+', ' ', 'g')) AS text FROM pages")
def _(spark, d):
    return bridge.table(spark, d, "pages").select("page_id", notices.readable(F.col("html")).alias("text"))


@query("link_points", f"""SELECT page_id, href, CASE WHEN {' OR '.join(f"contains(lower(href), '{x}')" for x in notices.NEVER)} THEN 0 WHEN {' OR '.join(f"contains(lower(href), '{x}')" for x in notices.ALL_AT_ONCE)} THEN 10
WHEN ends_with(lower(href), '.zip') OR contains(lower(href), '.zip?') THEN 9 WHEN '.' || lower(regexp_extract(regexp_extract(href, '^([^?#]*)', 1), '\\.([A-Za-z0-9]{{1,5}})$', 1)) IN ({', '.join(f"'{x}'" for x in urls.DOCUMENTS)}) THEN 3 ELSE 0 END AS points FROM ({_HREFS})""")
def _(spark, d):
    return _hrefs(spark, d).select("page_id", "href", notices.link_points(F.col("href"), urls.extension(F.col("href")), urls.DOCUMENTS).alias("points"))


@query("folder_names", r"""SELECT doc_id, coalesce(nullif(substring(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(trim(substring(coalesce(text, ''), 1, 120)), '[\/:"*?<>|]', '', 'g'), '[ 	

]+', '_', 'g'), '[^A-Za-z0-9_\-]', '_', 'g'), '_+', '_', 'g'), '^_+|_+$', '', 'g'), 1, 80), ''), 'unknown') AS name FROM documents""")
def _(spark, d):
    return bridge.table(spark, d, "documents").select("doc_id", notices.folder_name(F.substring(F.coalesce("text", F.lit("")), 1, 120)).alias("name"))


# Links and downloads of a page
#: Links of the test pages lead to pages only; these make documents of some.
_ENDED = "CASE cast(page_id % 4 AS int) WHEN 1 THEN '.pdf' WHEN 2 THEN '.zip' ELSE '' END"
_POINTED = f"""SELECT page_id, href, {' OR '.join(f"contains(lower(href), '{x}')" for x in notices.ALL_AT_ONCE + ['.zip?'])} OR ends_with(lower(href), '.zip') AS whole,
{' OR '.join(f"ends_with(lower(regexp_extract(href, '^([^?]*)', 1)), '{x}')" for x in urls.DOCUMENTS)} OR regexp_matches(href, '{urls.DOWNLOADISH}', 'i') AS useful, {' OR '.join(f"contains(lower(href), '{x}')" for x in urls.NO_TENDER)} AS noise FROM (SELECT DISTINCT page_id, href || {_ENDED} AS href FROM ({_HREFS}))"""


@query("harvested_links", f"SELECT page_id, min(href) AS href FROM ({_POINTED}) WHERE whole AND NOT noise GROUP BY 1 UNION ALL SELECT page_id, href FROM ({_POINTED}) WHERE useful AND NOT noise AND page_id NOT IN (SELECT page_id FROM ({_POINTED}) WHERE whole AND NOT noise)")
def _(spark, d):
    h = F.col("href")
    points = notices.link_points(h, urls.extension(h), urls.DOCUMENTS)
    ended = _hrefs(spark, d).select("page_id", F.concat("href", F.expr(_ENDED)).alias("href")).distinct()
    rows = ended.filter(~urls.no_tender(h)).select("page_id", "href", (F.when(leads_to_all(h), 1).otherwise(0)).alias("whole"), (urls.downloadish(h) | (points >= 9)).alias("useful"))
    whole = rows.filter("whole = 1").groupBy("page_id").agg(F.min("href").alias("href"))
    return whole.unionByName(rows.filter("useful").select("page_id", "href").join(whole.select("page_id"), "page_id", "left_anti"))


def leads_to_all(href):
    """Whether a link leads to all documents at once."""
    low = F.lower(href)
    found = low.endswith(".zip") | low.contains(".zip?")
    for part in notices.ALL_AT_ONCE:
        found = found | low.contains(part)
    return found


@query("validated_downloads", "SELECT doc_id, CASE WHEN text IS NULL OR text = '' THEN 'empty' WHEN doc_id % 5 = 0 THEN 'extension' WHEN row_number() OVER (PARTITION BY sha256(coalesce(text, '')), doc_id % 5 = 0 ORDER BY doc_id) > 1 THEN 'duplicate' ELSE 'ok' END AS verdict FROM documents")
def _(spark, d):
    name = F.when(F.col("doc_id") % 5 == 0, "page.html").otherwise("file.pdf")
    rows = bridge.table(spark, d, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"), F.concat(F.lit("."), urls.extension(name)).isin(urls.DOCUMENTS).alias("fits"))
    first = rows.filter("text <> '' and fits").groupBy(F.sha2("text", 256).alias("sha")).agg(F.min("doc_id").alias("first"))  # no group's rows are held
    held = rows.select("doc_id", "fits", (F.col("text") == "").alias("empty"), F.sha2("text", 256).alias("sha")).join(first, "sha", "left")
    verdict = F.when(F.col("empty"), "empty").when(~F.col("fits"), "extension").when(F.col("doc_id") > F.col("first"), "duplicate").otherwise("ok")
    return held.select("doc_id", verdict.alias("verdict"))


@query("extraction_rows", """SELECT c_custkey AS id, 2 + cast(c_custkey % 3 = 0 AS int) AS found, round((0.9 + 0.5 + CASE WHEN c_custkey % 3 = 0 THEN 0.2 ELSE 0 END) / (2 + cast(c_custkey % 3 = 0 AS int)), 2)::DOUBLE AS confidence, CASE WHEN c_custkey % 3 = 0 THEN 'buyer,deadline' ELSE 'buyer' END AS low FROM customer""")
def _(spark, d):
    field = lambda name, value, sure: F.struct(F.lit(name).alias("name"), value.alias("value"), F.lit(sure).alias("sure"))  # noqa: E731
    some = F.array(field("title", F.col("c_name"), 0.9), field("buyer", F.lit("b"), 0.5), field("deadline", F.when(F.col("c_custkey") % 3 == 0, F.lit("d")), 0.2), field("value", F.lit(None).cast("string"), 0.0))
    found = F.filter(some, lambda f: f["value"].isNotNull())
    rows = bridge.table(spark, d, "customer").select(F.col("c_custkey").alias("id"), found.alias("f"))
    total = F.aggregate("f", F.lit(0.0), lambda s, f: s + f["sure"])
    low = F.array_join(F.slice(F.transform(F.filter("f", lambda f: f["sure"] < 0.7), lambda f: f["name"]), 1, 3), ",")
    return rows.select("id", F.size("f").alias("found"), F.round(total / F.size("f"), 2).alias("confidence"), low.alias("low"))


@query("exported_results", oracle(f"SELECT job_id, string_agg(DISTINCT domain, ';' ORDER BY domain) AS domains, count(*) FILTER ({S}) AS documents FROM items GROUP BY 1"))
def _(spark, d):
    rows = _items(spark, d).groupBy("job_id").agg(F.sort_array(F.collect_set("domain")).alias("domains"), F.count_if(F.expr(S)).alias("documents"))  # a job has few items
    return rows.select("job_id", F.array_join("domains", ";").alias("domains"), "documents")
