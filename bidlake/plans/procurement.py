"""Named queries over the derived procurement tables, each with the SQL that must give the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from bidlake import bridge
from bidlake.bridge import NOW, oracle
from bidlake.functions import classify, rules
from bidlake.operators import analytics, directory, ordered

Query = Callable[[SparkSession, str], DataFrame]
FOUND: dict[str, tuple[Query, str | None]] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def keep(f: Query) -> Query:
        FOUND[name] = (f, sql)
        return f

    return keep


def _now() -> F.Column:
    return F.lit(NOW).cast("timestamp_ntz")


OPEN = f"status = 'success' AND (deadline IS NULL OR deadline >= TIMESTAMP '{NOW}')"
DONE = "status IN ('success', 'failed')"


@query(
    "directory_domains",
    oracle(f"""SELECT coalesce(o.domain, s.domain) AS domain, coalesce(open_count, 0) AS open_count, s.domain IS NOT NULL AS seeded, CASE WHEN s.domain IS NULL THEN sample_url END AS sample_url
FROM (SELECT domain, count(*) AS open_count, min(url) AS sample_url FROM items WHERE {OPEN} GROUP BY domain) o FULL JOIN seeds s ON o.domain = s.domain"""),
)
def _(spark, d):
    return directory.domains(bridge.job_items(spark, d), bridge.seed_portals(spark, d), _now())


@query(
    "directory_tenders",
    oracle(f"""SELECT id, tender_title, tender_reference, url, deadline,
CASE WHEN deadline IS NULL THEN 'deadline_unknown' WHEN floor(date_diff('second', TIMESTAMP '{NOW}', deadline) / 86400.0) < 7 THEN 'closing_soon' ELSE 'open' END AS tender_status
FROM items WHERE domain = 's7.example.org' AND {OPEN} ORDER BY deadline ASC NULLS LAST, id LIMIT 20 OFFSET 5"""),
)
def _(spark, d):
    return directory.tenders(bridge.job_items(spark, d), "s7.example.org", _now(), 20, 5)


@query(
    "admin_kpis",
    oracle("""SELECT *, CASE WHEN succeeded + failed > 0 THEN succeeded / cast(succeeded + failed AS double) ELSE 0.0 END AS success_rate FROM
(SELECT count(*) AS items, count(*) FILTER (status = 'success') AS succeeded, count(*) FILTER (status = 'failed') AS failed, count(*) FILTER (status = 'pending') AS pending FROM items),
(SELECT count(*) AS jobs, cast(sum(cost_units) AS bigint) AS cost_units FROM jobs)"""),
)
def _(spark, d):
    return analytics.kpis(bridge.job_items(spark, d), bridge.jobs(spark, d))


@query(
    "strategy_distribution",
    oracle(f"""SELECT s.strategy, coalesce(items, 0) AS items, coalesce(successes, 0) AS successes FROM (SELECT unnest({rules.STRATEGIES}) AS strategy) s
LEFT JOIN (SELECT strategy, count(*) AS items, count(*) FILTER (status = 'success') AS successes FROM items GROUP BY 1) i ON s.strategy = i.strategy"""),
)
def _(spark, d):
    return analytics.strategy_distribution(bridge.job_items(spark, d))


@query("error_categories", oracle("SELECT failure_category AS category, count(*) AS n FROM items WHERE status = 'failed' GROUP BY 1"))
def _(spark, d):
    return analytics.error_categories(bridge.job_items(spark, d))


def _case(column: str, table: dict[str, str], default: str) -> str:
    return f"CASE {column} " + " ".join("WHEN '{}' THEN '{}'".format(k, v.replace("'", "''")) for k, v in table.items()) + f" ELSE {default} END"


_BUCKET = _case("failure_category", {c: b for b, (_, _, some) in rules.BUCKETS.items() for c in some}, "'error'")
_LABEL = _case("bucket", {b: v[0] for b, v in rules.BUCKETS.items()}, "NULL")
_ACTION = _case("bucket", {b: v[1] for b, v in rules.BUCKETS.items() if v[1]}, "NULL")


@query(
    "outcome_buckets",
    oracle(f"""SELECT bucket, n, {_LABEL} AS label, bucket IN ('auth_gated', 'captcha') AS needs_manual FROM
(SELECT CASE WHEN status = 'success' THEN 'success' ELSE {_BUCKET} END AS bucket, count(*) AS n FROM items WHERE {DONE} GROUP BY 1)"""),
)
def _(spark, d):
    return analytics.outcome_buckets(bridge.job_items(spark, d))


@query(
    "needs_manual",
    oracle(f"""SELECT id, bucket, {_LABEL} AS label, error_message AS reason, {_ACTION} AS action, url AS retry_url FROM
(SELECT *, {_BUCKET} AS bucket FROM items WHERE failure_category IS NOT NULL) WHERE bucket IN ('auth_gated', 'captcha')"""),
)
def _(spark, d):
    return analytics.needs_manual(bridge.job_items(spark, d))


@query(
    "recent_errors",
    oracle(f"""SELECT id, domain, url, error_message, failure_category AS category, {_BUCKET} AS bucket,
CASE WHEN failure_category IN ('prompt_injection', 'blocked_url') THEN 'high' WHEN failure_category IN ('timeout', 'network', 'code_validation') THEN 'moderate' ELSE 'low' END AS risk
FROM items WHERE status = 'failed' ORDER BY id DESC LIMIT 50"""),
)
def _(spark, d):
    category = classify.error_category(F.col("error_message"))
    rows = bridge.job_items(spark, d).filter("status = 'failed'").orderBy(F.desc("id")).limit(50)
    return rows.select("id", "domain", "url", "error_message", category.alias("category"), classify.outcome_bucket(category).alias("bucket"), classify.error_risk(category).alias("risk"))


_BY_RUN = """count(*) AS runs, count(*) FILTER (success) / cast(count(*) AS double) AS success_rate, cast(sum(runtime_units) AS double) / count(*) AS avg_runtime_units,
cast(sum(downloaded) AS bigint) AS documents FROM runs GROUP BY"""


@query("model_summary", oracle(f"SELECT model, {_BY_RUN} model"))
def _(spark, d):
    return analytics.by_model(bridge.runs(spark, d))


@query("agent_summary", oracle(f"SELECT domain, {_BY_RUN} domain"))
def _(spark, d):
    return analytics.by_model(bridge.runs(spark, d), "domain")


@query(
    "pipeline_by_strategy",
    oracle(f"""SELECT strategy, cast(sum(n) AS bigint) AS total, cast(sum(s) AS bigint) AS success, cast(sum(s) AS double) / sum(n) AS success_rate, cast(sum(r) AS double) / sum(n) AS avg_runtime_s,
cast(sum(coalesce(cost_units, 0) * n // size) AS bigint) AS cost_units FROM (SELECT job_id, strategy, count(*) AS n, count(*) FILTER (status = 'success') AS s, sum(runtime_seconds) AS r FROM items WHERE {DONE} GROUP BY 1, 2) g
JOIN (SELECT job_id, count(*) AS size FROM items GROUP BY 1) z USING (job_id) LEFT JOIN (SELECT id AS job_id, cost_units FROM jobs WHERE cost_units > 0) j USING (job_id) GROUP BY 1"""),
)
def _(spark, d):
    return analytics.by_strategy(bridge.job_items(spark, d), bridge.jobs(spark, d))


@query(
    "pipeline_by_platform",
    oracle(f"""SELECT platform, cast(sum(n) AS bigint) AS total, cast(sum(s) AS bigint) AS success, max(CASE WHEN k = 1 THEN strategy END) AS dominant_strategy, cast(sum(s) AS double) / sum(n) AS success_rate FROM
(SELECT *, row_number() OVER (PARTITION BY platform ORDER BY n DESC, strategy) AS k FROM
(SELECT known_platform AS platform, strategy, count(*) AS n, count(*) FILTER (status = 'success') AS s FROM items WHERE {DONE} GROUP BY 1, 2)) GROUP BY 1"""),
)
def _(spark, d):
    return analytics.by_platform(bridge.job_items(spark, d))


@query(
    "pipeline_by_attempts",
    oracle("""SELECT strategy, count(*) AS attempts, count(*) FILTER (status = 'success') AS successes, count(*) FILTER (status = 'success') / cast(count(*) AS double) AS success_ratio,
cast(sum(runtime_seconds) AS double) / count(*) AS avg_duration_s FROM items GROUP BY 1"""),
)
def _(spark, d):
    return analytics.by_attempts(analytics.attempts_of(bridge.job_items(spark, d)))


@query("pipeline_failures_top", oracle("SELECT failure_category, count(*) AS n FROM items WHERE status = 'failed' AND failure_category IS NOT NULL GROUP BY 1 ORDER BY n DESC, failure_category LIMIT 15"))
def _(spark, d):
    return analytics.failures_top(bridge.job_items(spark, d))


def templates(spark, d):
    """Stored scrapers: one a domain, with the items that it has handled."""
    items = bridge.job_items(spark, d).groupBy("domain").agg(F.count(F.when(F.col("status") == "success", 1)).alias("success_count"), F.count(F.when(F.col("status") == "failed", 1)).alias("failure_count"))
    return items


@query(
    "scraper_health",
    oracle("""SELECT *, CASE WHEN success_count + failure_count = 0 THEN 'untested' WHEN success_rate >= 0.7 THEN 'healthy' WHEN success_rate >= 0.2 THEN 'degraded' ELSE 'retiring' END AS health,
success_count + failure_count >= 10 AND success_rate < 0.2 AS retire FROM (SELECT *, success_count / cast(nullif(success_count + failure_count, 0) AS double) AS success_rate FROM
(SELECT domain, count(*) FILTER (status = 'success') AS success_count, count(*) FILTER (status = 'failed') AS failure_count FROM items GROUP BY 1))"""),
)
def _(spark, d):
    return analytics.scraper_health(templates(spark, d))


@query("audit_list", oracle("SELECT id, created_at, event_type, job_id, level, message FROM audit WHERE level = 'warning' AND event_type ILIKE '%ic%' ORDER BY created_at DESC LIMIT 100 OFFSET 10"))
def _(spark, d):
    rows = bridge.audit_logs(spark, d).filter((F.col("level") == "warning") & F.col("event_type").ilike("%ic%"))
    return rows.orderBy(F.desc("created_at")).offset(10).limit(100).select("id", "created_at", "event_type", "job_id", "level", "message")


@query("audit_levels", oracle("SELECT level, count(*) AS n FROM audit GROUP BY 1"))
def _(spark, d):
    return bridge.audit_logs(spark, d).groupBy("level").agg(F.count(F.lit(1)).alias("n"))


@query("audit_top_events", oracle("SELECT event_type, count(*) AS n FROM audit GROUP BY 1 ORDER BY n DESC, event_type LIMIT 15"))
def _(spark, d):
    return bridge.audit_logs(spark, d).groupBy("event_type").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "event_type").limit(15)


@query(
    "job_diagnostics",
    oracle("""SELECT job_id, count(*) AS items, count(*) FILTER (status = 'success') AS success, count(*) FILTER (status = 'failed') AS failed, count(*) FILTER (status = 'pending') AS pending,
count(DISTINCT domain) AS domains, count(DISTINCT failure_category) AS categories FROM items GROUP BY 1"""),
)
def _(spark, d):
    return analytics.diagnostics(bridge.job_items(spark, d))


@query(
    "error_report",
    oracle("""SELECT job_id, id, domain, strategy, error_message, failure_category AS category,
CASE WHEN failure_category IN ('prompt_injection', 'blocked_url') THEN 'high' WHEN failure_category IN ('timeout', 'network', 'code_validation') THEN 'moderate' ELSE 'low' END AS risk FROM items WHERE status = 'failed'"""),
)
def _(spark, d):
    return analytics.error_report(bridge.job_items(spark, d))


@query(
    "job_rollup",
    oracle("""SELECT j.id, coalesce(total, 0) AS total, coalesce(successes, 0) AS successes, coalesce(completed, 0) AS completed,
CASE WHEN total > 0 AND successes = total THEN 'success' WHEN coalesce(successes, 0) = 0 THEN 'failed' ELSE 'partial' END AS status FROM jobs j LEFT JOIN
(SELECT job_id, count(*) AS total, count(*) FILTER (status = 'success') AS successes, count(*) FILTER (status IN ('success', 'failed')) AS completed FROM items GROUP BY 1) i ON j.id = i.job_id"""),
)
def _(spark, d):
    return analytics.job_rollup(bridge.jobs(spark, d), bridge.job_items(spark, d))


_RATES = _case("known_type", {k: str(round(v[0] * 100)) for k, v in rules.URL_TYPES.items()}, f"'{round(rules.UNKNOWN_SUCCESS * 100)}'")


@query(
    "batch_forecast",
    oracle(f"""SELECT count(*) AS total, count(*) FILTER (k = 1) AS "unique", count(*) FILTER (k > 1) AS duplicates, cast(sum(CASE WHEN k = 1 THEN cast({_RATES} AS bigint) END) AS bigint) AS expected_hundredths
FROM (SELECT *, row_number() OVER (PARTITION BY url ORDER BY id) AS k FROM items)"""),
)
def _(spark, d):
    return analytics.batch_forecast(bridge.job_items(spark, d).select(F.col("id").alias("position"), "url"))


@query("url_types", oracle("SELECT id, known_type AS url_type, known_platform AS platform FROM items"))
def _(spark, d):
    return bridge.job_items(spark, d).select("id", classify.url_type(F.col("url")).alias("url_type"), classify.platform(F.col("url")).alias("platform"))  # most URLs are different


def _orders_sql() -> str:
    listed = lambda order: ",".join(classify._injected(order))
    by_type = _case("known_type", {k: listed(v) for k, v in rules.STRATEGY_ORDERS.items()}, f"CASE WHEN known_platform IN ('dtvp', 'netserver') THEN '{listed(rules.FULL_ORDER_KNOWN_PLATFORM)}' ELSE '{listed(rules.FULL_ORDER)}' END")
    return f"SELECT id, strategy, {by_type} AS strategies FROM items"


@query("url_strategy_order", oracle(f"SELECT id, strategies FROM ({_orders_sql()})"))
def _(spark, d):
    order = classify.strategy_order(classify.url_type(F.col("url")), classify.platform(F.col("url")))
    return bridge.job_items(spark, d).select("id", F.array_join(order, ",").alias("strategies"))


@query(
    "next_strategy",
    oracle(f"""SELECT id, CASE WHEN list_position(o, strategy) > 0 THEN list_filter(list_slice(o, list_position(o, strategy) + 1, 99), lambda s: s <> 'cua')[1]
ELSE list_filter(o, lambda s: s <> 'cua')[1] END AS next_strategy FROM (SELECT id, strategy, string_split(strategies, ',') AS o FROM ({_orders_sql()}))"""),
)
def _(spark, d):
    order = classify.strategy_order(classify.url_type(F.col("url")), classify.platform(F.col("url")))
    rows = bridge.job_items(spark, d).select("id", "strategy", order.alias("o"))
    return rows.select("id", classify.next_strategy(F.col("o"), F.col("strategy"), enable_cua=False).alias("next_strategy"))


_SCHEMES = "CASE cast(id % 6 AS int) WHEN 0 THEN 'ftp://host/x' WHEN 1 THEN 'http://10.0.0.5/x' WHEN 2 THEN 'http://localhost:8080/' WHEN 3 THEN 'http://172.20.1.1/' ELSE url END"


@query(
    "url_guard",
    oracle("""SELECT id, id % 6 > 3 AS allowed, CASE cast(id % 6 AS int) WHEN 0 THEN 'scheme not allowed: ftp' WHEN 1 THEN 'private network blocked: 10.0.0.5' WHEN 2 THEN 'private network blocked: localhost'
WHEN 3 THEN 'private network blocked: 172.20.1.1' ELSE 'ok' END AS reason FROM items"""),
)
def _(spark, d):
    rows = bridge.job_items(spark, d).select("id", classify.url_guard(F.expr(_SCHEMES)).alias("g"))
    return rows.select("id", "g.allowed", "g.reason")


@query("first_per_domain", oracle("SELECT domain, id, url FROM (SELECT *, row_number() OVER (PARTITION BY domain ORDER BY id) AS k FROM items) WHERE k = 1"))
def _(spark, d):
    return ordered.top_per_group(bridge.job_items(spark, d), ["domain"], ["id"]).select("domain", "id", "url")


@query("top2_per_domain", oracle("SELECT domain, id, url FROM (SELECT *, row_number() OVER (PARTITION BY domain ORDER BY id) AS k FROM items) WHERE k <= 2"))
def _(spark, d):
    return ordered.top_per_group(bridge.job_items(spark, d), ["domain"], ["id"], 2).select("domain", "id", "url")


@query("newest_per_key", oracle("SELECT model, url, id, created_at FROM (SELECT *, row_number() OVER (PARTITION BY model, url ORDER BY created_at DESC, id DESC) AS k FROM runs) WHERE k = 1"))
def _(spark, d):
    return ordered.top_per_group(bridge.runs(spark, d), ["model", "url"], [F.desc("created_at"), F.desc("id")]).select("model", "url", "id", "created_at")


@query(
    "consensus_recall",
    oracle("""SELECT model, cast(sum(got) AS bigint) AS got, cast(sum(c) AS bigint) AS ceiling, cast(sum(got) AS double) / sum(c) AS recall FROM
(SELECT *, max(got) OVER (PARTITION BY url) AS c FROM (SELECT url, model, max(downloaded) AS got FROM runs GROUP BY 1, 2)) WHERE c > 0 GROUP BY 1"""),
)
def _(spark, d):
    return analytics.consensus_recall(bridge.runs(spark, d))


@query(
    "leaderboard",
    oracle("""SELECT *, cast(rank() OVER (ORDER BY solved DESC) AS int) AS place FROM (SELECT model, count(*) AS runs, count(*) FILTER (success) AS solved, cast(sum(runtime_units) AS double) / count(*) AS mean_runtime,
median(runtime_units) AS median_runtime, cast(sum(runtime_units) AS double) / nullif(count(*) FILTER (success), 0) AS runtime_per_success FROM runs GROUP BY 1)"""),
)
def _(spark, d):
    return analytics.leaderboard(bridge.runs(spark, d))


MODELS = ["click", "error", "purchase", "signup", "view"]


@query("model_matrix", oracle("SELECT domain, " + ", ".join(f"count(*) FILTER (model = '{m}') AS {m}" for m in MODELS) + " FROM runs WHERE success GROUP BY 1"))
def _(spark, d):
    return analytics.model_matrix(bridge.runs(spark, d), MODELS)


@query("best_model", oracle("SELECT url, model AS best_model, downloaded FROM (SELECT *, row_number() OVER (PARTITION BY url ORDER BY downloaded DESC, runtime_units, model, id) AS k FROM runs) WHERE k = 1"))
def _(spark, d):
    return analytics.best_model(bridge.runs(spark, d))


@query(
    "evaluate_runs",
    oracle("""SELECT id, recall, success AND downloaded > 0 AND recall >= 0.5 AS solved FROM
(SELECT *, CASE WHEN expected > 0 THEN least(1.0, downloaded / cast(expected AS double)) WHEN downloaded > 0 THEN 1.0 ELSE 0.0 END AS recall FROM runs)"""),
)
def _(spark, d):
    return analytics.evaluate(bridge.runs(spark, d))


@query("name_collisions", oracle("SELECT id, CASE WHEN k > 0 THEN concat(domain, '__', cast(k AS varchar)) ELSE domain END AS unique_name FROM (SELECT id, domain, row_number() OVER (PARTITION BY job_id, domain ORDER BY id) - 1 AS k FROM items)"))
def _(spark, d):
    return ordered.collision_names(bridge.job_items(spark, d), ["job_id"], "domain", ["id"]).select("id", "unique_name")


@query("chunks", oracle(f"SELECT id, cast((row_number() OVER (PARTITION BY job_id ORDER BY cast({_RATES} AS int) DESC, id) - 1) // 5 AS int) AS chunk FROM items"))
def _(spark, d):
    priority = classify.expected_success(classify.url_type(F.col("url")))
    return ordered.chunks(bridge.job_items(spark, d), priority, 5).select("id", "chunk")


@query("throughput_60s", oracle("SELECT id, count(*) OVER (PARTITION BY event_type ORDER BY created_at RANGE BETWEEN INTERVAL 60 SECONDS PRECEDING AND CURRENT ROW) AS recent FROM audit"))
def _(spark, d):
    return ordered.throughput(bridge.audit_logs(spark, d), "event_type", "created_at").select("id", "recent")


_SNAPS = """SELECT coalesce(a.f, b.f) AS filename, CASE WHEN a.f IS NULL THEN 'added' WHEN b.f IS NULL THEN 'removed' WHEN a.c <> b.c THEN 'modified' END AS change FROM
(SELECT concat('d', doc_id, '.pdf') AS f, sha256(coalesce(text, '')) AS c FROM documents WHERE doc_id % 13 <> 0) a FULL JOIN
(SELECT concat('d', doc_id, '.pdf') AS f, CASE WHEN doc_id % 7 = 0 THEN concat('x', sha256(coalesce(text, ''))) ELSE sha256(coalesce(text, '')) END AS c FROM documents WHERE doc_id % 11 <> 0) b ON a.f = b.f"""


@query("snapshot_delta", f"SELECT * FROM ({_SNAPS}) WHERE change IS NOT NULL")
def _(spark, d):
    return ordered.snapshot_delta(*bridge.snapshots(spark, d))


@query("content_dedup", "SELECT count(*) AS files, count(DISTINCT sha256(coalesce(text, ''))) AS unique_files, count(*) - count(DISTINCT sha256(coalesce(text, ''))) AS duplicates FROM documents")
def _(spark, d):
    docs = bridge.table(spark, d, "documents").select(F.sha2(F.coalesce("text", F.lit("")), 256).alias("c"))
    return ordered.content_dedup(docs, "c")


_BOUNDS = [1, 5, 10, 20, 30, 45]


@query("runtime_histogram", oracle(" UNION ALL ".join([f"SELECT 'le_{b}' AS bucket, count(*) FILTER (runtime_seconds <= {b}) AS n FROM items" for b in _BOUNDS] + ["SELECT 'le_inf', count(runtime_seconds) FROM items"])))
def _(spark, d):
    return analytics.histogram(bridge.job_items(spark, d), _BOUNDS, "runtime_seconds")


@query("stuck_jobs", oracle("SELECT id, submitted_by FROM jobs WHERE created_at < TIMESTAMP '1998-01-01 00:00:00' - INTERVAL 30 MINUTES AND id % 5 = 0"))
def _(spark, d):
    cutoff = F.lit("1998-01-01 00:00:00").cast("timestamp_ntz") - F.expr("INTERVAL 30 MINUTES")
    return bridge.jobs(spark, d).filter((F.col("id") % 5 == 0) & (F.col("created_at") < cutoff)).select("id", "submitted_by")


@query("stuck_running_jobs", oracle("SELECT id, submitted_by FROM jobs WHERE created_at < TIMESTAMP '1998-01-01 00:00:00' - INTERVAL 30 MINUTES AND id IN (SELECT job_id FROM items WHERE status = 'pending')"))
def _(spark, d):
    cutoff = F.lit("1998-01-01 00:00:00").cast("timestamp_ntz") - F.expr("INTERVAL 30 MINUTES")
    running = bridge.job_items(spark, d).groupBy(F.col("job_id").alias("id")).agg(F.bool_or(F.col("status") == "pending").alias("running")).filter("running")
    return bridge.jobs(spark, d).filter(F.col("created_at") < cutoff).join(running, "id", "left_semi").select("id", "submitted_by")


@query("backup_urls", oracle("SELECT i.id, b.url AS backup_url FROM items i JOIN (SELECT domain, max(url) AS url FROM items GROUP BY 1) b ON i.domain = b.domain WHERE i.status = 'failed'"))
def _(spark, d):
    items = bridge.job_items(spark, d)
    backups = items.groupBy("domain").agg(F.max("url").alias("backup_url"))
    return items.filter("status = 'failed'").join(backups, "domain").select("id", "backup_url")


@query("seeds_new", oracle("SELECT DISTINCT domain FROM items WHERE status = 'success' AND NOT EXISTS (SELECT 1 FROM seeds WHERE seeds.domain = items.domain)"))
def _(spark, d):
    return bridge.job_items(spark, d).filter("status = 'success'").select("domain").distinct().join(bridge.seed_portals(spark, d), "domain", "left_anti")


@query("job_documents", oracle("SELECT j.id, count(i.id) AS items, count(DISTINCT i.domain) AS domains, min(i.url) AS first_url FROM jobs j LEFT JOIN items i ON i.job_id = j.id GROUP BY 1"))
def _(spark, d):
    joined = bridge.jobs(spark, d).alias("j").join(bridge.job_items(spark, d).alias("i"), F.col("i.job_id") == F.col("j.id"), "left")
    return joined.groupBy(F.col("j.id").alias("id")).agg(F.count("i.id").alias("items"), F.countDistinct("i.domain").alias("domains"), F.min("i.url").alias("first_url"))


@query("retry_reset", oracle("SELECT id, CASE WHEN status IN ('failed', 'pending') THEN 'pending' ELSE status END AS status, CASE WHEN status IN ('failed', 'pending') THEN NULL ELSE error_message END AS error_message FROM items"))
def _(spark, d):
    again = F.col("status").isin("failed", "pending")
    return bridge.job_items(spark, d).select("id", F.when(again, "pending").otherwise(F.col("status")).alias("status"), F.when(~again, F.col("error_message")).alias("error_message"))


@query("template_upsert", oracle("SELECT domain, max(id) AS id FROM items WHERE status = 'success' GROUP BY 1 UNION ALL SELECT s.domain, 0 FROM seeds s WHERE s.domain NOT IN (SELECT domain FROM items WHERE status = 'success')"))
def _(spark, d):
    fresh = bridge.job_items(spark, d).filter("status = 'success'").select("domain", "id")
    old = bridge.seed_portals(spark, d).select("domain", F.lit(0).cast("long").alias("id"))
    return ordered.upsert(old, fresh, ["domain"], [F.desc("id")])


@query("attempt_history", oracle("SELECT id, coalesce(bool_or(status = 'failed') OVER (PARTITION BY job_id ORDER BY id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), false) AS failed_before FROM items"))
def _(spark, d):
    before = W.partitionBy("job_id").orderBy("id").rowsBetween(W.unboundedPreceding, -1)
    return bridge.job_items(spark, d).select("id", F.coalesce(F.bool_or(F.col("status") == "failed").over(before), F.lit(False)).alias("failed_before"))
