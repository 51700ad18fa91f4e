"""Named queries over documents as files: sheets, replies, summaries, traces."""

from __future__ import annotations

from pyspark.sql import functions as F

from bidlake import bridge
from bidlake.functions import candidates, codecheck, fields, replies, summaries, traces
from bidlake.operators import harvest, wide
from bidlake.plans import content  # noqa: F401  registers the circuit breaker
from bidlake.plans.procurement import _RATES, FOUND, _orders_sql, query
from bidlake.sources import documents, lists

_CELLS = "list_transform(string_split(l, ', '), lambda c: trim(c))"
_NUMBER = "regexp_full_match(replace(replace(c, ' ', ''), ',', ''), '[+-]?(([0-9]+([.][0-9]*)?|[.][0-9]+)(e[+-]?[0-9]+)?|inf|infinity|nan)', 'i')"
_SHEETS = f"""WITH lines AS (
SELECT doc_id, unnest(string_split(text, chr(10))) AS l, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM documents WHERE text IS NOT NULL
), cells AS (SELECT doc_id, i, {_CELLS} AS r, len(list_filter({_CELLS}, lambda c: c <> '')) = 0 AS blank FROM lines
), starts AS (SELECT doc_id, min(i) AS a FROM cells WHERE NOT blank GROUP BY 1
), stops AS (SELECT doc_id, a, min(i) AS b FROM starts LEFT JOIN cells c USING (doc_id) WHERE blank AND i > a GROUP BY ALL
), used AS MATERIALIZED (
SELECT c.doc_id, i - s.a AS n, r, CASE WHEN r[1] IS NULL THEN '' ELSE rtrim(r[1], ':') END AS label, coalesce(r[2], '') AS v FROM cells c JOIN starts s USING (doc_id) LEFT JOIN stops t USING (doc_id) WHERE i >= s.a AND (t.b IS NULL OR i < t.b)
), layouts AS MATERIALIZED (
SELECT doc_id, CASE WHEN len(h) < 2 THEN 'table' WHEN len(list_filter(h, lambda c: {_NUMBER})) > len(h) // 2 OR k > n * 0.5 THEN 'key_value' ELSE 'table' END AS layout, h FROM (
SELECT doc_id, arg_min(r, n) AS h, count(*) AS n, count(*) FILTER (len(r) >= 2 AND r[1] <> '' AND length(r[1]) < {documents.LABEL} AND r[2] <> '') AS k FROM used GROUP BY 1)
), opened AS (
SELECT doc_id, n, label, v, max(CASE WHEN label <> '' THEN n END) OVER (PARTITION BY doc_id ORDER BY n) AS o FROM used JOIN layouts USING (doc_id) WHERE layout = 'key_value'
), pairs AS (
SELECT doc_id, o, max(label) AS label, trim(string_agg(v, ' ' ORDER BY n) FILTER (v <> '' OR label <> '')) AS value FROM opened WHERE o IS NOT NULL GROUP BY 1, 2
), kept AS (
SELECT doc_id, label, arg_max(value, o) AS value, min(o) AS first FROM pairs GROUP BY 1, 2
), heads AS (
SELECT doc_id, max(c) AS c, label FROM (SELECT doc_id, unnest(h) AS label, generate_subscripts(h, 1) AS c FROM layouts WHERE layout = 'table') GROUP BY doc_id, label
)
SELECT doc_id, 'key_value' AS layout, row_number() OVER (PARTITION BY doc_id ORDER BY first) - 1 AS record, label, value FROM kept
UNION ALL SELECT u.doc_id, 'table', n, h.label, coalesce(r[c], '') FROM used u JOIN heads h USING (doc_id) WHERE n > 0"""


@query("sheet_records", _SHEETS)
def _(spark, d):
    rows = F.transform(F.split("text", "\n"), lambda line: F.split(line, ", "))  # the reader trims cells
    table = F.array(F.struct(F.lit("text").alias("name"), rows.alias("rows")))
    found = bridge.table(spark, d, "documents").filter("text is not null").select(F.col("doc_id").alias("path"), F.lit(None).cast("string").alias("member"), table.alias("tables"))
    return documents.sheet_records(found).select(F.col("path").alias("doc_id"), "layout", F.col("record").cast("long").alias("record"), "label", "value")


# URL lists: a file of each of 40 portals, with its own separator and header
_SEPARATOR = "CASE cast(f % 4 AS int) WHEN 0 THEN ',' WHEN 1 THEN ';' WHEN 2 THEN '{tab}' ELSE '|' END"
_LISTED = """SELECT concat('f', s_suppkey % 40) AS file, concat('https://s', s_suppkey, '.example.org/', CASE WHEN s_suppkey % 5 = 0 THEN 'a,b' ELSE 'x' END) AS url FROM supplier WHERE s_suppkey % 7 <> 0"""


@query("listed_urls", _LISTED)
def _(spark, d):
    rows = bridge.table(spark, d, "supplier").selectExpr("s_suppkey AS k", "s_suppkey % 40 AS f", "s_name")
    url = F.expr("concat(if(k % 7 = 0, 'ftp', 'https'), '://s', k, '.example.org/', if(k % 5 = 0, 'a,b', 'x'))")
    sep = F.expr(_SEPARATOR.format(tab="\\t"))
    quoted = F.when(F.col("k") % 5 == 0, F.concat(F.lit('"'), url, F.lit('"'))).otherwise(url)
    body = rows.select(F.concat(F.lit("f"), "f").alias("file"), F.col("k").alias("nth"), F.concat(F.col("k").cast("string"), sep, F.lit(" "), quoted, F.lit(" "), sep, "s_name").alias("line"))
    head = F.concat(F.lit("﻿no"), sep, F.element_at(F.array(*map(F.lit, ["Link", "URL", "tender_url", "Site"])), (F.col("f") % 4 + 1).cast("int")), sep, F.lit("name"))
    heads = rows.select("f").distinct().select(F.concat(F.lit("f"), "f").alias("file"), F.lit(-2).cast("long").alias("nth"), head.alias("line"))
    blank = heads.select("file", F.lit(-1).cast("long").alias("nth"), F.lit("  ").alias("line"))
    return lists.listed_urls(body.unionByName(heads).unionByName(blank)).select("file", "url")


# Replies of models: fenced, bare, broken, of wrong kinds; read by DuckDB's own JSON
_BODY = """concat('{"titel": ', CASE WHEN k % 5 = 0 THEN '"  "' WHEN k % 5 = 1 THEN '7' WHEN k % 5 = 2 THEN 'null' ELSE concat('" T ', name, ' "') END, ', "waehrung": "EUR", "cpv_codes": ', CASE cast(k % 4 AS int) WHEN 0 THEN '["1", " 2 ", "", null, 3]' WHEN 1 THEN '["9"]' WHEN 2 THEN '[]' ELSE '"none"' END, CASE WHEN k % 7 = 0 THEN '' ELSE '}' END)"""
_RAW = "CASE cast(k % 3 AS int) WHEN 0 THEN concat('```json', {nl}, {body}, {nl}, '```') WHEN 1 THEN {body} ELSE concat('```', {body}, '```') END"
_MERGED = f"""WITH replies AS (SELECT c_custkey AS k, c_name AS name FROM customer), raw AS (SELECT k, {_RAW.format(nl="chr(10)", body=_BODY)} AS reply FROM replies),
bare AS (SELECT k, TRY_CAST(trim(regexp_replace(reply, '```(?:json)?\\s*|\\s*```', '', 'g'), ' ' || chr(10)) AS JSON) AS j FROM raw)
SELECT k AS id, CASE WHEN json_type(j, '$.titel') = 'VARCHAR' AND trim(j ->> '$.titel') <> '' THEN trim(j ->> '$.titel') ELSE 'known' END AS titel, CASE WHEN json_type(j, '$.waehrung') = 'VARCHAR' THEN j ->> '$.waehrung' END AS waehrung,
CASE WHEN json_type(j, '$.cpv_codes') = 'ARRAY' AND json_array_length(j, '$.cpv_codes') >= 2 THEN array_to_string(list_transform(list_filter(CAST(j -> '$.cpv_codes' AS VARCHAR[]), lambda x: x IS NOT NULL AND x <> ''), lambda x: trim(x)), ',') ELSE 'a,b' END AS cpv_codes FROM bare"""


@query("reply_merge", _MERGED)
def _(spark, d):
    reply = F.expr(_RAW.format(nl="'\\n'", body=_BODY))
    rows = bridge.table(spark, d, "customer").selectExpr("c_custkey AS k", "c_name AS name").select("k", reply.alias("reply"))
    known = {"titel": F.lit("known"), "waehrung": F.lit(None).cast("string"), "cpv_codes": F.array(F.lit("a"), F.lit("b"))}
    return rows.select(F.col("k").alias("id"), replies.merged_fields(F.col("reply"), known).alias("f")).select("id", "f.titel", "f.waehrung", F.array_join("f.cpv_codes", ",").alias("cpv_codes"))


@query("dynamic_columns", """SELECT user_id, max(CASE WHEN event_type = 'click' THEN event_id END) AS click, max(CASE WHEN event_type = 'error' THEN event_id END) AS error, max(CASE WHEN event_type = 'purchase' THEN event_id END) AS purchase,
max(CASE WHEN event_type = 'signup' THEN event_id END) AS signup, max(CASE WHEN event_type = 'view' THEN event_id END) AS "view" FROM events GROUP BY 1""")
def _(spark, d):
    return wide.wide(bridge.table(spark, d, "events"), ["user_id"], "event_type", "event_id", ["event_id"])


# Summaries
@query("summaries", """SELECT o_orderkey AS id, concat(c_name, ' schreibt Los ', o_orderkey, ' (Bauauftrag) aus. Verfahrensart: Offenes Verfahren. Auftragswert: ', o_custkey, ',00 EUR. Angebotsfrist: ', strftime(o_orderdate, '%d.%m.%Y'), ' 10:00 Uhr.') AS paragraph,
concat('Vergabenummer: V-', o_orderkey, '|Auftraggeber: ', c_name, '|Vergabeverfahren: Offenes Verfahren|Auftragsart: Bauauftrag|Geschätzter Auftragswert: ', o_custkey, ',00 EUR|Einreichungsfrist: ', strftime(o_orderdate, '%d.%m.%Y'), ' 10:00 Uhr|CPV-Code(s): ', lpad(cast(o_custkey AS varchar), 8, '7'), '|Anzahl Lose: 1|Kontakt: k', o_custkey, '@example.org') AS bullets
FROM orders JOIN customer ON o_custkey = c_custkey""")
def _(spark, d):
    rows = bridge.tender_texts(spark, d).select("id", fields.extract_fields(F.col("text")).alias("f"))
    other = {"abgabefrist": "angebotsfrist", "veroeffentlichungsdatum": "veroeffentlichung", "ansprechpartner": "contact_person"}
    f = {n: F.col(f"f.{other.get(n, n)}") if n != "vergabestelle" else F.lit(None).cast("string") for n in [*replies.TEXTS, *replies.LISTS] if n not in ("telefon", "eignungskriterien")}
    return rows.select("id", summaries.german_paragraph(f).alias("paragraph"), F.array_join(summaries.german_bullets(f), "|").alias("bullets"))


@query("word_budget", f"""WITH words AS (SELECT doc_id, text, list_filter(regexp_split_to_array(text, '\\s+'), lambda w: w <> '') AS w FROM documents),
cuts AS (SELECT doc_id, text, len(w) AS n, array_to_string(w[1:{summaries.WORDS}], ' ') AS c FROM words), stops AS (SELECT *, length(c) - strpos(reverse(c), '.') AS s FROM cuts)
SELECT doc_id, CASE WHEN n <= {summaries.WORDS} THEN text WHEN contains(c, '.') AND s > length(c) * 0.5 THEN substring(c, 1, s + 1) ELSE c || '…' END AS text FROM stops""")
def _(spark, d):
    return bridge.table(spark, d, "documents").select("doc_id", summaries.within_words(F.col("text")).alias("text"))


_LINES = "list_transform(regexp_split_to_array(text, '\\r\\n|\\r|\\n'), lambda l: regexp_replace(l, '^\\s+|\\s+$', '', 'g'))"
_SENTENCES = "list_filter(list_transform(string_split(regexp_replace(regexp_replace(text, '^\\s+|\\s+$', '', 'g'), '([.!?])\\s+', '\\1' || chr(1), 'g'), chr(1)), lambda l: regexp_replace(l, '^\\s+|\\s+$', '', 'g')), lambda l: l <> '')"
_MARKED = f"list_filter(list_transform(list_filter({_LINES}, lambda l: regexp_matches(l, '^[-•*]|^\\d+[.)]\\s')), lambda l: regexp_replace(regexp_replace(l, '^[-•*\\d.)]+\\s*', ''), '^\\s+|\\s+$', '', 'g')), lambda l: l <> '')"


@query("key_sentences", f"SELECT doc_id, array_to_string(CASE WHEN len(m) > 0 THEN m[1:3] ELSE s[1:3] END, '; ') AS bullets, array_to_string(s[1:2], ' ') AS scope FROM (SELECT doc_id, {_MARKED} AS m, {_SENTENCES} AS s FROM documents)")
def _(spark, d):
    text = F.col("text")
    return bridge.table(spark, d, "documents").select("doc_id", F.array_join(summaries.bullet_sentences(text, 3), "; ").alias("bullets"), F.array_join(F.slice(summaries.sentences(text), 1, 2), " ").alias("scope"))


# Traces: each turn's text with what an agent says it has opened
_STEP = "concat(coalesce(text, ''), ' opened https://s', conv_id % 10, '.example.org/p', turn % 3, '. then <https://s', (conv_id + turn) % 10, '.example.org/q>, saved HTTPS://s1.example.org/files/', turn % 2, '.pdf')"
_VISITED = f"""WITH steps AS (SELECT conv_id, turn, 's' || conv_id % 10 || '.example.org' AS domain, {_STEP} AS t FROM conversations),
found AS (SELECT conv_id, turn, domain, unnest(u) AS url, generate_subscripts(u, 1) AS i FROM (SELECT *, regexp_extract_all(t, 'https?://[^\\s"''<>)\\]]+', 0, 'i') AS u FROM steps)),
kinds AS (SELECT conv_id, turn, i, CASE WHEN ends_with(lower(url), '.pdf') THEN 'document' WHEN lower(regexp_extract(rtrim(url, '.,;'), '^https?://([^/?#]*)', 1, 'i')) = domain THEN 'page' END AS kind, CASE WHEN ends_with(lower(url), '.pdf') THEN url ELSE rtrim(url, '.,;') END AS url FROM found)
SELECT conv_id AS trace, kind, row_number() OVER (PARTITION BY conv_id, kind ORDER BY min(turn * 1000 + i)) AS nth, url FROM kinds WHERE kind IS NOT NULL GROUP BY conv_id, kind, url"""


@query("visited_urls", _VISITED)
def _(spark, d):
    steps = bridge.table(spark, d, "conversations").select("conv_id", "turn", F.expr(_STEP).alias("text"), F.expr("concat('s', conv_id % 10, '.example.org')").alias("domain"))
    return traces.visited(steps, "conv_id", "turn", "text", "domain")


# Generated code: a function around each order's number, with what must not be there
@query("code_checks", """SELECT o_orderkey AS id, o_orderkey % 6 = 0 AS ok, CASE cast(o_orderkey % 6 AS int) WHEN 1 THEN 'forbidden import: subprocess|forbidden call: subprocess.run' WHEN 2 THEN 'forbidden call: eval' WHEN 3 THEN 'missing required function `scrape(url, output_dir)`'
WHEN 4 THEN 'forbidden import-from: socket' WHEN 5 THEN 'SyntaxError' ELSE '' END AS errors FROM orders""")
def _(spark, d):
    code = F.expr("""CASE cast(o_orderkey % 6 AS int) WHEN 3 THEN concat('def other(): return ', o_orderkey) WHEN 5 THEN concat('def scrape(url, output_dir) return ', o_orderkey)
ELSE concat(CASE cast(o_orderkey % 6 AS int) WHEN 1 THEN 'import subprocess as sp, os\\n' WHEN 4 THEN 'from socket import socket\\n' ELSE '' END, 'def scrape(url, output_dir):\\n    ', CASE cast(o_orderkey % 6 AS int) WHEN 1 THEN 'subprocess.run(url)' WHEN 2 THEN 'eval(url)' ELSE 'pass' END, '\\n    return ', o_orderkey) END""")
    found = codecheck.checked_code(bridge.table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), code.alias("code")))
    return found.select("id", "ok", F.array_join(F.transform("errors", lambda e: F.regexp_replace(e, "(?s)^SyntaxError.*", "SyntaxError")), "|").alias("errors"))


@query("navigation_candidates")
def _(spark, d):
    return harvest.navigation(bridge.table(spark, d, "pages"))


_GATED = ", ".join(f"'{t}'" for t in harvest.GATED_TYPES)


@query("batch_analysis", bridge.oracle(f"""SELECT id AS position, url, k > 1 AS duplicate, CASE WHEN k = 1 THEN known_type END AS url_type, CASE WHEN k = 1 THEN known_platform END AS platform, CASE WHEN k = 1 THEN cast({_RATES} AS bigint) END AS expected,
CASE WHEN k = 1 THEN strategies END AS strategies, CASE WHEN k = 1 THEN list_contains(string_split(strategies, ','), 'llm_generated') END AS will_use_llm, CASE WHEN k = 1 THEN list_contains(string_split(strategies, ','), 'cua') END AS will_use_cua,
CASE WHEN k = 1 AND known_type IN ({_GATED}) THEN concat('Auth-gated portal (', known_type, ') — expect ~5% success. Only CUA (visual login) has any chance; LLM generation is skipped.') END AS warning
FROM (SELECT *, row_number() OVER (PARTITION BY url ORDER BY id) AS k FROM items) JOIN ({_orders_sql()}) USING (id)"""))
def _(spark, d):
    found = harvest.batch_analysis(bridge.job_items(spark, d))
    return found.select("position", "url", "duplicate", "url_type", "platform", F.round(F.col("expected_success") * 100).cast("long").alias("expected"), F.array_join("strategy_order", ",").alias("strategies"), "will_use_llm", "will_use_cua", "warning")


@query("circuit_listing", f"""SELECT count(*) AS total_tracked, count(*) FILTER (state = 'open') AS "open", count(*) FILTER (state = 'half_open') AS half_open FROM (SELECT domain, arg_max(state, s) AS state FROM (SELECT domain, state, row_number() OVER (PARTITION BY domain ORDER BY "at", state) AS s FROM ({FOUND['circuit_breaker'][1]})) GROUP BY 1)""")
def _(spark, d):
    return harvest.circuits(FOUND["circuit_breaker"][0](spark, d))


@query("scored_links")
def _(spark, d):
    return candidates.document_links(bridge.table(spark, d, "pages"))


_NAMES = ["Tender notice", "Bill of Quantities", "Photo gallery", "", "Site archive"]
_PATHS = ["/files/a.pdf", "/download?file=", "/img/x.png?v=", "/about", "/pack.ZIP"]


def _candidates_sql() -> str:
    pick = lambda values, at: f"CASE cast({at} AS int) " + " ".join(f"WHEN {i} THEN '{v}'" for i, v in enumerate(values)) + " END"
    words = " + ".join(f"contains(heap, '{w}')::INT * {4 if w in candidates.WEIGHTY else 2}" for w in candidates.IMPORTANT) + "".join(f" - contains(heap, '{w}')::INT * 4" for w in candidates.UNIMPORTANT)
    listed = lambda values: ", ".join(f"'{v}'" for v in values)
    any_of = lambda text, values: "(" + " OR ".join(f"contains({text}, '{v}')" for v in values) + ")"
    return f"""WITH named AS (SELECT id, {pick(_NAMES, 'id % 5')} AS name, concat('HTTPS://D', job_id % 9, '.example.org', {pick(_PATHS, 'id % 7 % 5')}, CASE WHEN id % 3 = 0 THEN '#top' ELSE '' END) AS link FROM items),
heaps AS (SELECT *, lower(concat_ws(' ', nullif(name, ''), link)) AS heap, lower(regexp_extract(regexp_extract(link, '^[A-Za-z]+://[^/?#]*([^?#]*)', 1), '[^/.]([.][^./]+)$', 1)) AS ending FROM named),
scored AS (SELECT *, (ending IN ({listed(candidates.ENDINGS)}))::INT * 3 + (ending IN ({listed(candidates.ENDINGS)}) OR {any_of('lower(link)', candidates.DOWNLOAD_HINTS)})::INT * 2 + {any_of('lower(name)', [*candidates.IMPORTANT, *candidates.SECTIONS])}::INT * 2 + {words}
- (ending IN ({listed(candidates.BLOCKED)}))::INT * 8 + (contains(heap, 'archive') OR ending IN ('.zip', '.rar', '.7z'))::INT AS score FROM heaps)
SELECT id, link, score, CASE WHEN score >= 7 THEN 'high' ELSE 'medium' END AS priority FROM (SELECT *, row_number() OVER (PARTITION BY lower(regexp_extract(link, '^([A-Za-z]+://[^/?#]*)', 1)) || regexp_extract(link, '^[A-Za-z]+://[^/?#]*([^#]*)', 1) ORDER BY id) AS k FROM scored WHERE score >= 4) WHERE k = 1"""


@query("important_documents", bridge.oracle("SELECT * FROM (" + _candidates_sql() + ")"))
def _(spark, d):
    pick = lambda values, at: F.element_at(F.array(*map(F.lit, values)), (at + 1).cast("int"))
    link = F.concat(F.lit("HTTPS://D"), (F.col("job_id") % 9).cast("string"), F.lit(".example.org"), pick(_PATHS, F.col("id") % 7 % 5), F.when(F.col("id") % 3 == 0, "#top").otherwise(""))
    rows = bridge.job_items(spark, d).select("id", pick(_NAMES, F.col("id") % 5).alias("name"), F.lit(None).cast("string").alias("text"), link.alias("link"), F.lit(1).alias("page"))
    host = F.regexp_extract(F.lower("link"), "^([a-z]+://[^/]*)", 1)
    found = candidates.important_documents(rows.withColumn("page", host), "page", "id", "name", "text", "link")
    return found.select("id", "link", "score", "priority")
