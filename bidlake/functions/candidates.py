"""How likely links are to be tender documents: points from 0 to 3, and scores with their reasons."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bidlake.functions import pages, urls
from bidlake.functions.once import once

# The words of links that are documents and of those that never are, and hosts whose documents count on other sites.
DOCUMENT_ENDINGS = [".pdf", ".zip", ".doc", ".docx", ".xls", ".xlsx", ".rar", ".7z", ".odt", ".ods", ".p7s", ".gaeb", ".x81", ".x83", ".d83", ".d84"]
STRONG_TEXT = [
    "unterlag", "leistungsverzeichnis", "leistungsbeschreibung", "ausschreibung", "vergabeunterlag", "angebotsunterlag", "teilnahmeunterlag", "lv ", "gaeb", "formular", "bewerbungsbogen", "eignungsnachweis", "auftragsbekanntmachung",
    "bekanntmachung", "vertragsbedingung", "leistungsheft", "baubeschreibung", "planunterlag", "herunterladen", "download", "dokument", "zip herunterladen", "als zip", "unterlagen herunterladen", "alle dokumente", "bieterunterlagen",
]
SKIPPED_TEXT = [
    "agb", "datenschutz", "impressum", "nutzungsbedingung", "hilfe", "handbuch", "anleitung", "tutorial", "newsletter", "broschüre", "flyer", "logo", "registrierung", "anmelden", "login", "startseite", "home", "zurück", "weiter",
    "mehr erfahren", "read more", "alle ausschreibungen", "suche", "merkliste", "favoriten", "cookie", "sprachauswahl",
]
SKIPPED_URL = ["/agb", "/datenschutz", "/impressum", "/hilfe", "/help", "/login", "/register", "/auth", "/account", "/news/", "/blog/", "/presse/", "/aktuell", ".css", ".js", ".png", ".jpg", ".gif", ".svg", ".ico", ".woff", ".ttf", ".eot"]
HINTING_URL = ["unterlag", "leistung", "vergabe", "gaeb", "dokument", "formular", "ausschreibung", "download", "attachment", "file", "bieter", "angebot", "tender"]
KNOWN_HOSTS = ["evergabe", "vergabe", "subreport", "had.de", "tender24", "ausschreibungsblatt", "bi-medien"]
# The same for candidates of documents, and what each sign counts.
ENDINGS = [".pdf", ".doc", ".docx", ".xls", ".xlsx", ".xlsm", ".csv", ".zip", ".rar", ".7z", ".dwg", ".dxf", ".odt", ".ods", ".rtf", ".txt", ".ppt", ".pptx"]
BLOCKED = [".png", ".jpg", ".jpeg", ".gif", ".svg", ".webp", ".bmp", ".ico", ".tif", ".tiff", ".mp4", ".mov", ".avi", ".webm", ".css", ".js", ".xml", ".json"]
IMPORTANT = [
    "boq", "bill of quantity", "bill of quantities", "specification", "specifications", "technical", "terms", "conditions", "contract", "tender", "notice", "official notice", "requirements", "requirement", "scope", "drawing", "drawings",
    "schedule", "annex", "annexure", "addendum", "corrigendum", "rfp", "rft", "ifb", "bid document", "bekanntmachung", "vergabeunterlagen", "teilnahmeunterlagen", "ausschreibungsunterlagen", "leistungsverzeichnis", "leistungsbeschreibung",
    "vertragsunterlagen", "vertragsbedingungen", "preisblatt", "angebotsformular", "bewertungsmatrix", "zuschlagskriterien", "zeichnungsunterlagen", "anlagen", "anhang",
]
WEIGHTY = ["boq", "bill of quantity", "bill of quantities"]
UNIMPORTANT = ["image", "images", "advert", "advertisement", "gallery", "photo", "logo", "banner", "privacy", "cookie", "help", "navigation", "home", "contact", "sitemap", "brochure", "promo"]
SECTIONS = [
    "document", "documents", "attachment", "attachments", "download", "downloads", "notice", "tender", "bid", "corrigendum", "addendum", "detail", "details", "dokument", "dokumente", "unterlage", "unterlagen", "vergabeunterlagen",
    "teilnahmeunterlagen", "bekanntmachung", "ausschreibung", "anhang", "anhaenge", "anlage", "anlagen", "datei", "dateien", "leistungsverzeichnis",
]
DOWNLOAD_HINTS = [
    "/download", "download=", "download/", "attachment", "attachments", "file=", "docid=", "document", "documents", "dokument", "dokumente", "unterlage", "unterlagen", "bekanntmachung", "vergabeunterlagen", "teilnahmeunterlagen",
    "leistungsverzeichnis",
]
HIGH, MEDIUM = 7, 4


def _any(text: Column, words: list[str]) -> Column:
    return reduce(lambda a, b: a | b, [text.contains(w) for w in words])


def _ending(url: Column) -> Column:
    """The last suffix of a URL's path, in lower case; empty without one."""
    return F.regexp_extract(F.lower(urls.part(url, 3)), r"[^/.](\.[^./]+)$", 1)


def link_points(url: Column, text: Column, page_host: Column) -> Column:
    """0 to 3 for an absolute link: 1 for a document's ending, 2 for its text or else 1 for a hint in its address; 0 for noise, and for other sites that aren't known portals."""
    low, said, host = F.lower(url), F.lower(F.trim(F.coalesce(text, F.lit("")))), F.lower(urls.part(url, 2))
    strange = (host != "") & (host != page_host) & ~_any(host, KNOWN_HOSTS)
    points = F.when(_ending(url).isin(DOCUMENT_ENDINGS), 1).otherwise(0) + F.when(_any(said, STRONG_TEXT), 2).when(_any(low, HINTING_URL), 1).otherwise(0)
    return F.when(strange | _any(low, SKIPPED_URL) | _any(said, SKIPPED_TEXT), 0).otherwise(points)


def document_links(rows: DataFrame, page: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """(page, place, link, text, points) of a page's links with points, the best first, equal ones as on the page.

    The first link to an address counts. On portals named evergabe, addresses of documents and downloads that have no points get 2. Null pages have none.
    """
    host = F.lower(urls.part(F.col(url), 2))
    found = F.filter(pages.links(F.col(html)), lambda a: ~a["href"].rlike("(?i)^tel:"))
    whole = F.transform(found, lambda a: F.struct(urls.absolute(a["href"], F.col(url)).alias("link"), a["text"].alias("text")))
    hidden = lambda a: host.contains("evergabe") & (a["link"].contains("document") | a["link"].contains("/api/file/") | a["link"].contains("download"))
    points = lambda a: F.when(link_points(a["link"], a["text"], host) > 0, link_points(a["link"], a["text"], host)).when(hidden(a), 2).otherwise(0)
    named = rows.select(F.col(page).alias("page"), F.col(url), F.col(html), whole.alias("_all")).withColumn("_links", F.transform("_all", lambda a: a["link"]))
    firsts = F.filter("_all", lambda a, i: F.array_position(F.col("_links"), a["link"]) == i + 1)
    scored = F.filter(F.transform(firsts, lambda a, i: F.struct((-points(a)).alias("minus"), i.alias("at"), a["link"].alias("link"), a["text"].alias("text"))), lambda a: a["minus"] < 0)
    each = named.select("page", F.posexplode(F.array_sort(scored)).alias("_at", "_a"))
    return each.select("page", (F.col("_at") + 1).alias("place"), "_a.link", "_a.text", (-F.col("_a.minus")).alias("points"))


def candidate(name: Column, text: Column, url: Column, extension: Column | None = None) -> Column:
    """(score, reason, priority) of a document candidate by its name, its link's text and its address; its extension is the address's if none is given."""
    held = lambda c: F.nullif(c, F.lit(""))
    heap = F.lower(F.concat_ws(" ", held(name), held(text), held(url)))
    label = F.lower(F.trim(F.regexp_replace(F.coalesce(held(text), name, F.lit("")), r"\s+", " ")))
    of_url = _ending(url)
    given = F.coalesce(held(extension), of_url) if extension is not None else of_url
    known = F.struct(heap.alias("heap"), label.alias("label"), of_url.alias("of_url"), given.alias("ending"), F.lower(url).alias("low"))

    def signs(k: Column) -> Column:
        heap, ending = k["heap"], k["ending"]
        all_signs = [
            (ending.isin(ENDINGS), 3, F.concat(F.lit("document extension "), ending)),
            (k["of_url"].isin(ENDINGS) | _any(k["low"], DOWNLOAD_HINTS), 2, F.lit("download-style url")),
            (_any(k["label"], [*IMPORTANT, *SECTIONS]), 2, F.lit("document-style label")),
            *[(heap.contains(w), 4 if w in WEIGHTY else 2, F.lit(f"keyword:{w}")) for w in IMPORTANT],
            *[(heap.contains(w), -4, F.lit(f"unimportant:{w}")) for w in UNIMPORTANT],
            (ending.isin(BLOCKED), -8, F.concat(F.lit("blocked extension "), ending)),
            (heap.contains("archive") | ending.isin(".zip", ".rar", ".7z"), 1, F.lit("archive may contain tender pack")),
        ]
        return F.array_compact(F.array(*[F.when(sign, F.struct(F.lit(points).alias("points"), why.alias("why"))) for sign, points, why in all_signs]))

    reason = lambda f: F.coalesce(held(F.array_join(F.transform(f, lambda x: x["why"]), ", ")), F.lit("no strong signal"))
    scored = lambda f: F.struct(F.aggregate(f, F.lit(0), lambda s, x: s + x["points"]).alias("score"), reason(f).alias("reason"))
    ranked = lambda r: F.struct(r["score"].alias("score"), r["reason"].alias("reason"), F.when(r["score"] >= HIGH, "high").when(r["score"] >= MEDIUM, "medium").otherwise("low").alias("priority"))
    return once(once(once(known, signs), scored), ranked)


def important_documents(rows: DataFrame, group: str, order: str, name: str, text: str, url: str) -> DataFrame:
    """The candidates of medium or high priority with score, reason and priority; of each group's candidates with the same canonical address the first by ``order``, nulls first.

    Candidates with the same name, text and address in a group are one before they are scored, and the first of an address is an aggregate: no address's
    candidates are sorted or held together, however many there are.
    """
    said = list(dict.fromkeys([group, name, text, url]))
    others = [c for c in rows.columns if c not in (*said, order)]
    place = F.struct(F.col(order).isNotNull().alias("known"), F.col(order).alias("at"))
    first = F.when(F.count(order) == F.count(F.lit(1)), F.min(order)).alias(order)
    each = rows.groupBy(*said).agg(F.count(F.lit(1)).alias("_n"), first, *([F.min_by(F.struct(*others), place).alias("_others")] if others else []))
    each = each.select(*said, order, "_n", *(["_others.*"] if others else []))
    scored = each.withColumn("_c", candidate(F.col(name), F.col(text), F.col(url))).select(*rows.columns, "_n", "_c.*")
    scored = scored.filter(F.when(F.col("_n") > 0, F.col("score")) >= MEDIUM).drop("_n")  # by the count too, as Spark would score before it groups
    firsts = scored.groupBy(F.col(group).alias("_group"), pages.canonical_url(F.col(url)).alias("_canonical")).agg(F.min_by(F.struct(*scored.columns), place).alias("_first"))
    return firsts.select("_first.*")
