"""Dates, labelled values, sections and tables of plain notices, as column expressions over lines and rows."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from bidlake.functions.once import once

# Months by name, words of each kind of tender, parts of links that say what they lead to.
MONTHS: dict[str, int] = {
    "jan": 1, "feb": 2, "mar": 3, "apr": 4, "may": 5, "jun": 6, "jul": 7, "aug": 8, "sep": 9, "oct": 10, "nov": 11, "dec": 12, "mär": 3, "mai": 5, "okt": 10, "dez": 12,
    "januar": 1, "februar": 2, "märz": 3, "april": 4, "juni": 6, "juli": 7, "august": 8, "september": 9, "oktober": 10, "november": 11, "dezember": 12,
    "january": 1, "february": 2, "march": 3, "june": 6, "july": 7, "october": 10, "december": 12,
}
KINDS: dict[str, list[str]] = {
    "Open": ["open tender", "open bidding", "public tender", "international competitive bidding", "icb", "open competition", "offenes verfahren", "öffentliche ausschreibung", "national competitive bidding", "ncb"],
    "Restricted": ["restricted tender", "limited bidding", "selective tender", "beschränktes verfahren", "beschränkte ausschreibung", "nichtoffenes verfahren"],
    "RFP": ["request for proposal", "rfp", "proposals invited", "expression of interest"],
    "RFQ": ["request for quotation", "rfq", "quotation invited", "request for quote"],
    "Negotiated": ["negotiated procedure", "direct award", "verhandlungsverfahren", "freihändige vergabe", "direktauftrag"],
    "EOI": ["expression of interest", "eoi", "pre-qualification", "prequalification"],
}
ALL_AT_ONCE = ["downloadall", "alleherunterladen", "download-all", "zipdownloadbutton", "downloadallbutton", "archive", "alle-dokumente", "gesamtpaket"]
NEVER = ["/agb", "/login", "/register", "/datenschutz", "/impress"]


def _any(text: Column, parts: list[str]) -> Column:
    return reduce(lambda a, b: a | b, [text.contains(p) for p in parts])


def _day(year: Column, month: Column, day: Column) -> Column:
    """ISO form of numbers that can be a date; else null."""
    numbers = F.struct(*[c.try_cast("int").alias(n) for n, c in (("y", year), ("m", month), ("d", day))])
    shown = lambda n: F.when(n["y"].between(1900, 2100) & n["m"].between(1, 12) & n["d"].between(1, 31), F.format_string("%04d-%02d-%02d", n["y"], n["m"], n["d"]))
    return once(numbers, shown)


def _pivoted(year: Column) -> Column:
    """Years of two digits: below 50 in this century."""
    return once(year.try_cast("int"), lambda n: F.when(n < 50, n + 2000).when(n < 100, n + 1900).otherwise(n).cast("string"))


def iso_date(raw: Column) -> Column:
    """(value, low_confidence): the first form that is found and can be a date, in ISO form, else the text itself; blank: null.

    A form's parts are taken out only of texts that have it, and each is worked out once.
    """
    names = F.create_map(*[F.lit(x) for kv in MONTHS.items() for x in kv])
    month = lambda c: F.try_element_at(names, F.lower(c)).cast("string")
    forms = [
        (r"(\d{1,2})[/\-](\d{1,2})[/\-](\d{4})", lambda a, b, c: _day(c, b, a)), (r"(\d{1,2})\.(\d{1,2})\.(\d{4})", lambda a, b, c: _day(c, b, a)),
        (r"(\d{1,2})\.(\d{1,2})\.(\d{2})$", lambda a, b, c: _day(_pivoted(c), b, a)), (r"(\d{1,2})-([A-Za-z]{3})-(\d{2,4})", lambda a, b, c: _day(_pivoted(c), month(b), a)),
        (r"(\d{1,2})\s+([A-Za-z]+),?\s+(\d{4})", lambda a, b, c: _day(c, month(b), a)), (r"([A-Za-z]+)\s+(\d{1,2}),?\s+(\d{4})", lambda a, b, c: _day(c, month(a), b)),
    ]

    def found(text: Column) -> Column:
        iso = r"(\d{4}-\d{2}-\d{2})"
        dated = [F.when(text.rlike(p), day(*[F.regexp_extract(text, p, i) for i in (1, 2, 3)])) for p, day in forms]
        return F.struct(text.alias("text"), F.coalesce(F.when(text.rlike(iso), F.regexp_extract(text, iso, 1)), *dated).alias("found"))

    told = lambda k: F.when(F.coalesce(k["text"], F.lit("")) != "", F.struct(F.coalesce(k["found"], k["text"]).alias("value"), k["found"].isNull().alias("low_confidence")))
    return once(once(F.trim(raw), found), told)


def tender_kind(text: Column) -> Column:
    """(value, confidence) by the first phrase that the text has: 0.9 for several words, 0.7 for one, 0 for none."""
    low, case = F.lower(text), None
    for kind, phrases in KINDS.items():
        for phrase in phrases:
            found = F.struct(F.lit(kind).alias("value"), F.lit(0.9 if " " in phrase else 0.7).alias("confidence"))
            case = F.when(low.contains(phrase), found) if case is None else case.when(low.contains(phrase), found)
    return case.otherwise(F.struct(F.lit(None).cast("string").alias("value"), F.lit(0.0).alias("confidence")))


def is_label(line: Column) -> Column:
    """A line of under 60 signs that ends in a colon, or one of at least two words, all in capitals but for single letters."""
    words = F.filter(F.split(F.regexp_replace(line, r"[^a-zA-Z\s]", ""), r"\s+"), lambda w: w != "")
    capitals = (F.size(words) >= 2) & F.forall(words, lambda w: (F.length(w) <= 1) | w.rlike("^[A-Z]+$"))
    return line.endswith(":") & (F.length(line) < 60) | capitals


def value_below(lines: Column, label: str, window: int = 5) -> Column:
    """The first line with more than one sign among the ``window`` below the first line that has the label; null if that is a label itself."""
    at = F.array_position(F.transform(lines, lambda x: F.lower(x).contains(label.lower())), F.lit(True)).cast("int")
    below = F.filter(F.transform(F.slice(lines, at + 1, F.lit(window)), lambda x: F.trim(x)), lambda x: F.length(x) >= 2)
    first = F.transform(F.slice(below, 1, 1), lambda x: F.when(~is_label(x), F.substring(x, 1, 200)))
    return F.when(at > 0, F.try_element_at(first, F.lit(1)))


def section_body(lines: Column, keywords: list[str], most: int = 40) -> Column:
    """Up to ``most`` lines below the first that has a keyword, up to the next label once there are three; null without any."""
    has = lambda x: _any(F.lower(x), keywords)
    at = F.array_position(F.transform(lines, has), F.lit(True)).cast("int")
    after = F.slice(lines, F.greatest(at, F.lit(0)) + 1, F.lit(most))
    ends = F.array_position(F.transform(after, lambda x, i: (i > 2) & is_label(x) & ~has(x)), F.lit(True)).cast("int")
    body = F.slice(after, F.lit(1), F.when(ends > 0, ends - 1).otherwise(F.lit(most)))
    return F.when((at > 0) & (F.size(body) > 0), F.array_join(F.transform(body, lambda x: F.trim(x)), "\n"))


def label_form(text: Column) -> Column:
    """A label for comparison: lower case, other signs than letters and digits as single blanks."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.lower(F.trim(text)), r"[^a-z0-9\s]", " "), r"\s+", " "))


def layout(rows: Column, columns: Column) -> Column:
    """key_value for two columns, or where the first cells are mostly short and different; else data_table. Rows are arrays of cells."""
    first = F.transform(rows, lambda r: F.trim(F.coalesce(F.try_element_at(r, F.lit(1)), F.lit(""))))
    n = F.greatest(F.size(rows), F.lit(1))
    different = F.size(F.array_distinct(F.filter(F.transform(first, F.lower), lambda x: x != ""))) / n
    short = F.size(F.filter(first, lambda x: (x != "") & (F.length(x) < 80))) / n
    return F.when(F.coalesce(F.size(rows), F.lit(0)) <= 0, "data_table").when((columns == 2) | (different > 0.7) & (short > 0.6), "key_value").otherwise("data_table")


def key_values(rows: Column) -> Column:
    """Labels, without colons at their end, and values of rows with both; of a repeated label the last value."""
    pairs = F.transform(F.filter(rows, lambda r: F.size(r) >= 2), lambda r: F.struct(F.rtrim(F.trim(r[0]), F.lit(":")).alias("k"), F.trim(r[1]).alias("v")))
    whole = F.filter(pairs, lambda p: (p["k"] != "") & (p["v"] != ""))
    last = lambda k: F.element_at(F.filter(whole, lambda p: p["k"] == k), -1)["v"]
    return F.map_from_entries(F.transform(F.array_distinct(F.transform(whole, lambda p: p["k"])), lambda k: F.struct(k.alias("k"), last(k).alias("v"))))


def value_of(known: Column, labels: list[str]) -> Column:
    """The first value whose label has one of the labels in it or is in one, both in the form for comparison."""
    forms = F.transform(F.array(*map(F.lit, labels)), lambda x: label_form(x))
    met = F.filter(F.map_entries(known), lambda e: F.exists(forms, lambda f: label_form(e["key"]).contains(f) | f.contains(label_form(e["key"]))))
    return F.try_element_at(met, F.lit(1))["value"]


def readable(html: Column) -> Column:
    """Text of a page without scripts, styles, headers, footers and navigation, in single blanks."""
    bare = reduce(lambda h, tag: F.regexp_replace(h, rf"(?s)<{tag}[^>]*>.*?</{tag}>", " "), ["script", "style", "header", "footer", "nav"], html)
    return F.trim(F.regexp_replace(F.regexp_replace(bare, "<[^>]+>", " "), r"\s+", " "))


def folder_name(text: Column, most: int = 80) -> Column:
    """A text as a folder's name: letters, digits, hyphens and single underscores."""
    name = F.regexp_replace(F.regexp_replace(F.trim(text), r'[\\/:"*?<>|]', ""), r"\s+", "_")
    name = F.regexp_replace(F.regexp_replace(F.regexp_replace(name, r"[^\w\-]", "_"), "_+", "_"), "^_+|_+$", "")
    return F.when(name == "", "unknown").otherwise(F.substring(name, 1, most))


def link_points(href: Column, ending: Column, documents: list[str]) -> Column:
    """0 for pages that are never documents, 10 for all at once, 9 for archives, 3 for other documents by their ending, else 0."""
    low = F.lower(href)
    archive = low.endswith(".zip") | low.contains(".zip?")
    return F.when(_any(low, NEVER), 0).when(_any(low, ALL_AT_ONCE), 10).when(archive, 9).when(F.concat(F.lit("."), ending).isin(documents), 3).otherwise(0)
