"""Classifiers as column expressions: ordered rules become one CASE, so they stay inside code generation."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bidlake.functions import literals, rules
from bidlake.functions.once import once


def found(text: Column, pattern: str) -> Column:
    """Case-insensitive search, also for letters outside of ASCII."""
    return text.rlike(f"(?iu){pattern}")


def first_rule(text: Column, table: dict[str, list[str] | str], default: str) -> Column:
    """The label of the first rule that is found; null texts get the default.

    Plain letters are looked for in the text in lower case, which is made once; a pattern is searched only where the text has letters that it requires.
    """
    joined = {label: p if isinstance(p, str) else "|".join(p) for label, p in table.items()}

    def case(t: Column) -> Column:
        (label, pattern), *rest = joined.items()
        whole = F.when(literals.held(t["text"], t["low"], pattern), label)
        for label, pattern in rest:
            whole = whole.when(literals.held(t["text"], t["low"], pattern), label)
        return whole.otherwise(default)

    return once(F.struct(text.alias("text"), literals.folded(text).alias("low")), case)


def looked_up(key: Column, table: dict[str, object], default: object) -> Column:
    """A small dimension as a map literal, so that the key, which may be a chain of patterns, is worked out once."""
    entries = [F.lit(x) for pair in table.items() for x in pair]
    return F.coalesce(F.try_element_at(F.create_map(*entries), key), F.lit(default))


def with_classes(rows: DataFrame, column: str, classes: dict[str, Column]) -> DataFrame:
    """``rows`` with ``classes`` of ``column``, chains of patterns that are worked out once for each different value.

    The different values are dealt evenly to as many tasks as a shuffle has, as Spark would gather so few bytes in one or two. Spark broadcasts
    them back if they are few, else joins and splits frequent ones.
    """
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    known = rows.select(F.col(column).alias("_value")).distinct().repartition(parts).select("_value", *[c.alias(n) for n, c in classes.items()])
    return rows.join(known, F.col(column).eqNullSafe(F.col("_value")), "left").drop("_value")


def url_type(url: Column) -> Column:
    return first_rule(url, {k: v[1] for k, v in rules.URL_TYPES.items()}, "unknown")


def expected_success(kind: Column) -> Column:
    return looked_up(kind, {k: v[0] for k, v in rules.URL_TYPES.items()}, rules.UNKNOWN_SUCCESS)


def platform(url: Column) -> Column:
    return first_rule(url, rules.PLATFORMS, "unknown")


def _injected(order: list[str]) -> list[str]:
    """Adaptive before the paid step, a learned route before the agent, unless they are there."""
    for new, before in (("adaptive", "llm_generated"), ("learned_route", "cua")):
        if new not in order and before in order:
            order = [*order[: order.index(before)], new, *order[order.index(before) :]]
    return order


def strategy_order(kind: Column, portal: Column) -> Column:
    """Strategies in the order in which they are tried."""
    literal = lambda order: F.array(*map(F.lit, _injected(order)))
    entries = [x for name, order in rules.STRATEGY_ORDERS.items() for x in (F.lit(name), literal(order))]
    known = F.when(portal.isin(rules.KNOWN_PLATFORMS), literal(rules.FULL_ORDER_KNOWN_PLATFORM)).otherwise(literal(rules.FULL_ORDER))
    return F.coalesce(F.try_element_at(F.create_map(*entries), kind), known)


def next_strategy(order: Column, current: Column, enable_cua: bool = True) -> Column:
    """The strategy after ``current`` in its order, without the agent where that is off; null at the end."""

    def after(o: Column) -> Column:
        rest = F.slice(o, F.array_position(o, current).cast("int") + 1, F.lit(99))
        return F.try_element_at(rest if enable_cua else F.filter(rest, lambda s: s != "cua"), F.lit(1))

    return F.transform(F.array(order), after)[0]  # so that the order is worked out once


def error_category(message: Column) -> Column:
    return F.when(message.isNull() | (message == ""), "unknown").otherwise(first_rule(message, rules.ERROR_CATEGORIES, "unknown"))


def error_risk(category: Column) -> Column:
    return looked_up(category, {c: risk for risk, some in rules.RISKS.items() for c in some}, "low")


def outcome_bucket(category: Column, success: Column | None = None) -> Column:
    bucket = looked_up(category, {c: b for b, (_, _, some) in rules.BUCKETS.items() for c in some}, "error")
    return bucket if success is None else F.when(success, "success").otherwise(bucket)


def bucket_label(bucket: Column) -> Column:
    return looked_up(bucket, {b: v[0] for b, v in rules.BUCKETS.items()}, None)


def suggested_action(bucket: Column) -> Column:
    return looked_up(bucket, {b: v[1] for b, v in rules.BUCKETS.items() if v[1]}, None)


def needs_manual(bucket: Column) -> Column:
    return bucket.isin(rules.MANUAL_BUCKETS)


def injection_hits(text: Column) -> Column:
    """The patterns that are found, in their order."""
    return F.array_compact(F.array(*[F.when(found(text, p), F.lit(p)) for p in rules.INJECTIONS]))


def redacted(text: Column) -> Column:
    """Each pattern's finds are replaced in the text that the patterns before it have left."""
    return reduce(lambda t, p: F.regexp_replace(t, f"(?iu){p}", "[REDACTED:injection]"), rules.INJECTIONS, text)


def without_noise(html: Column) -> Column:
    """HTML without scripts, styles, noscript blocks and comments."""
    blocks = "|".join(rf"<{tag}\b[^>]*>.*?</{tag}\s*>" for tag in ("script", "style", "noscript"))
    return F.regexp_replace(html, f"(?ius){blocks}|<!--.*?-->", " ")


def wrapped(text: Column, most: int = 8000) -> Column:
    return F.concat(F.lit("<untrusted_web_content>\n"), F.substring(text, 1, most), F.lit("\n</untrusted_web_content>"))


def url_guard(url: Column) -> Column:
    """(allowed, reason): http and https only, and no private networks; a null URL, or one without a host, isn't allowed."""
    url = F.coalesce(url, F.lit(""))
    scheme = F.lower(F.regexp_extract(url, r"^([A-Za-z][A-Za-z0-9+.\-]*):", 1))
    host = F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.\-]*://(?:[^/?#@]*@)?(\[[^\]]*\]|[^/?#:]*)", 1))
    host = F.regexp_replace(host, r"[\[\]]", "")
    private = reduce(lambda a, b: a | b, [host.rlike(p) for p in rules.PRIVATE_NETS])
    reason = F.when(~scheme.isin("http", "https"), F.concat(F.lit("scheme not allowed: "), scheme)).when(host == "", "no host").when(private, F.concat(F.lit("private network blocked: "), host)).otherwise("ok")
    return F.struct((reason == "ok").alias("allowed"), reason.alias("reason"))


def health(successes: Column, failures: Column) -> Column:
    """Of a stored scraper: untested, healthy from 0.7 on, degraded from 0.2 on, else retiring."""
    runs = successes + failures
    rate = successes / F.when(runs > 0, runs)
    return F.when(runs == 0, "untested").when(rate >= 0.7, "healthy").when(rate >= 0.2, "degraded").otherwise("retiring")


def should_retire(successes: Column, failures: Column) -> Column:
    """Below a fifth after 10 runs."""
    runs = successes + failures
    return (runs >= 10) & (successes / F.when(runs > 0, runs) < 0.2)


def tender_status(deadline: Column, now: Column) -> Column:
    """Whole days left, rounded down: fewer than 7 means closing soon."""
    days = F.floor(F.timestamp_diff("SECOND", now, deadline) / F.lit(86400.0))
    return F.when(deadline.isNull(), "deadline_unknown").when(days < 7, "closing_soon").otherwise("open")


def redacted_with_hits(text: Column) -> Column:
    """(text, hits): the redacted text, and the patterns that each were found in what the patterns before had left."""
    none = F.array().cast("array<string>")
    start = F.struct(text.alias("text"), none.alias("hits"))
    step = lambda s, p: F.struct(F.regexp_replace(s["text"], p, F.lit("[REDACTED:injection]")).alias("text"), F.when(F.regexp_like(s["text"], p), F.concat(s["hits"], F.array(F.substr(p, F.lit(6))))).otherwise(s["hits"]).alias("hits"))
    return F.aggregate(F.array(*[F.lit(f"(?iu){p}") for p in rules.INJECTIONS]), start, step)
