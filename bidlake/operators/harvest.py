"""What a page offers: navigation candidates, document candidates with reasons, and URL batches with what to expect of them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bidlake.functions import classify, pages, rules, urls

# Letters of a shown label, candidates of a page, and what a button counts more than a link.
SHOWN, TOP, BUTTON = 80, 4, 2
# Types of URLs that ask for a vendor's login.
GATED_TYPES = ["netserver_auth", "evergabe_deep", "eva_portal"]


def _tags(html: Column, name: str) -> Column:
    """(head, body) of the elements of this name, in order."""
    element = rf"(?is)<{name}\b([^>]*)>(.*?)</{name}\s*>"
    return F.zip_with(F.regexp_extract_all(html, F.lit(element), F.lit(1)), F.regexp_extract_all(html, F.lit(element), F.lit(2)), lambda h, b: F.struct(h.alias("head"), b.alias("body")))


def _attribute(head: Column, name: str) -> Column:
    return F.regexp_extract(head, rf"(?i)(?:^|\s){name}\s*=\s*[\"']([^\"'>]*)[\"']", 1)


def _label(body: Column) -> Column:
    return F.trim(F.regexp_replace(F.regexp_replace(body, r"<[^>]*>", " "), r"\s+", " "))


def navigation(rows: DataFrame, page: str = "page_id", url: str = "url", html: str = "html", top: int = TOP) -> DataFrame:
    """(page, place, kind, text, href, score): up to ``top`` links and buttons that may lead to documents, the best first.

    A link counts its text's keyword, or half of its address's; links to other sites and noise are left out. A button counts its label's
    keyword and BUTTON more. Of candidates with the same text in any case the best stays; equal scores stand as on the page, links first. Texts without
    a letter are left out. Null pages have none. A page's candidates are ranked within its row, so that nothing is shuffled.
    """
    link = lambda t, i: F.struct(i.alias("at"), F.lit("link").alias("kind"), F.substring(_label(t["body"]), 1, SHOWN).alias("text"), urls.absolute(_attribute(t["head"], "href"), F.col(url)).alias("href"), _label(t["body"]).alias("whole"))
    named = lambda t: F.coalesce(F.nullif(_label(t["body"]), F.lit("")), F.nullif(_attribute(t["head"], "aria-label"), F.lit("")), _attribute(t["head"], "name"))
    button = lambda t, i: F.struct((i + 1_000_000).alias("at"), F.lit("button").alias("kind"), F.substring(named(t), 1, SHOWN).alias("text"), F.lit("").alias("href"), named(t).alias("whole"))
    anchors = F.filter(_tags(F.col(html), "a"), lambda t: t["head"].rlike(r"(?i)(?:^|\s)href\s*="))
    found = F.concat(F.transform(anchors, link), F.transform(_tags(F.col(html), "button"), button))
    wanted = F.filter(found, lambda c: (c["kind"] == "button") | ~urls.is_external(c["href"], F.col(url)) & ~c["href"].rlike(f"(?i)({pages.SKIPPED})"))
    points = lambda c: F.when(c["kind"] == "link", pages.link_score(c["href"], c["whole"])).otherwise(F.when(pages.keyword_score(c["whole"]) > 0, pages.keyword_score(c["whole"]) + BUTTON).otherwise(0))
    scored = F.filter(F.transform(wanted, lambda c: F.struct((-points(c)).alias("minus"), c["at"].alias("at"), c["kind"].alias("kind"), c["text"].alias("text"), c["href"].alias("href"))), lambda c: (c["minus"] < 0) & (c["text"] != ""))
    ranked = rows.select(F.col(page).alias("page"), F.array_sort(scored).alias("_all"))
    names = F.transform("_all", lambda c: F.lower(c["text"]))
    first = ranked.withColumn("_names", names).withColumn("_best", F.slice(F.filter("_all", lambda c, i: F.array_position(F.col("_names"), F.lower(c["text"])) == i + 1), 1, top))
    each = first.select("page", F.posexplode("_best").alias("_at", "_c"))
    return each.select("page", (F.col("_at") + 1).alias("place"), "_c.kind", "_c.text", "_c.href", (-F.col("_c.minus")).alias("score"))


def batch_analysis(listed: DataFrame, position: str = "id", url: str = "url") -> DataFrame:
    """(position, url, duplicate, url_type, platform, expected_success, strategy_order, will_use_llm, will_use_cua, warning) of a list of URLs.

    The first place of a URL has its analysis; later ones are marked as duplicates and have none. Each different URL is classified
    once. Types that ask for a login carry a warning.
    """
    firsts = listed.groupBy(url).agg(F.min(position).alias("_first")).withColumnRenamed(url, "_url")
    kinds = firsts.select("_url", "_first", classify.url_type(F.col("_url")).alias("url_type"), classify.platform(F.col("_url")).alias("platform"))
    order = classify.strategy_order(F.col("url_type"), F.col("platform"))
    warned = F.concat(F.lit("Auth-gated portal ("), F.col("url_type"), F.lit(") — expect ~5% success. Only CUA (visual login) has any chance; LLM generation is skipped."))
    known = kinds.select(
        "_url", "_first", "url_type", "platform", classify.expected_success(F.col("url_type")).alias("expected_success"), order.alias("strategy_order"),
        F.array_contains(order, "llm_generated").alias("will_use_llm"), F.array_contains(order, "cua").alias("will_use_cua"), F.when(F.col("url_type").isin(GATED_TYPES), warned).alias("warning"),
    )
    met = listed.select(F.col(position).alias("position"), F.col(url).alias("url")).join(known, F.col("url").eqNullSafe(F.col("_url")))
    fresh = F.col("position") == F.col("_first")
    shown = [c for c in known.columns if not c.startswith("_")]
    return met.select("position", "url", (~fresh).alias("duplicate"), *[F.when(fresh, F.col(c)).alias(c) for c in shown])


def circuits(decisions: DataFrame) -> DataFrame:
    """One row: domains that are tracked, open and half open, by the last state of (domain, at, state)."""
    last = decisions.groupBy("domain").agg(F.max_by("state", F.struct("at", "state")).alias("state"))
    return last.agg(F.count(F.lit(1)).alias("total_tracked"), F.count_if(F.col("state") == "open").alias("open"), F.count_if(F.col("state") == "half_open").alias("half_open"))


# Fixed value: what an attempt says that ended its item for safety.
ABORTED = "Security block — pipeline aborted"


def cascade_replay(attempts: DataFrame) -> DataFrame:
    """The attempts that an item's cascade makes of recorded ones (item, place, strategy, success, error, retry_success), with what they come to.

    An attempt with an error of moderate risk is made once more, and counts as a success, healed, if that was one. The first success ends the item; so
    does an error of high risk. What an attempt does hangs on itself alone, so an item's end is the least place of one that ends it. Each different error
    is classified once. Returns item, place, strategy, success, healed, category, reason.
    """
    known = classify.with_classes(attempts, "error", {"_category": classify.error_category(F.col("_value"))})
    failed = ~F.col("success") & F.col("error").isNotNull() & (F.col("error") != "")
    risk = F.when(failed, classify.error_risk(F.col("_category")))
    healed = F.coalesce((risk == "moderate") & F.col("retry_success"), F.lit(False))
    stops = F.coalesce(risk == "high", F.lit(False))
    told = known.select("item", "place", "strategy", (F.col("success") | healed).alias("success"), healed.alias("healed"), stops.alias("_stops"), F.when(failed, F.col("_category")).alias("category"), F.col("error").alias("_error"))
    ends = told.filter("success or _stops").groupBy("item").agg(F.min("place").alias("_end"))
    reason = F.when(F.col("_stops"), ABORTED).when(F.col("category").isNotNull(), F.coalesce(classify.looked_up(F.col("category"), rules.REASONS, None), F.col("_error"))).otherwise("")
    return told.join(ends, "item", "left").filter("_end is null or place <= _end").select("item", "place", "strategy", "success", "healed", "category", reason.alias("reason"))
