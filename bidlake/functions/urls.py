"""URLs, file names and small texts as column expressions."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from bidlake.functions.once import once

# URLs that are documents, pages that aren't tenders, marks of platforms in their pages, walls in their order.
DOWNLOADISH = "download|getdocument|documentfile|getfile|attachment|docid=|unterlagen"
DOWNLOADS = ["_DownloadTenderDocuments", "_DownloadDocument", "_DownloadAll", "function=.*[Dd]ownload", r"DownloadTenderFiles\.ashx", "DirectDocload", "zipDownloadButton", "downloadAllButton"]
DOCUMENTS = [".pdf", ".doc", ".docx", ".xls", ".xlsx", ".ppt", ".pptx", ".zip", ".rar", ".7z", ".txt", ".odt", ".ods", ".csv"]
PAGES = [".html", ".htm", ".xhtml"]
NO_TENDER = ["/login", "/register", "/auth", "/passwort", "/password", "/account", "/warenkorb", "/cart", "/impressum", "/datenschutz", "/agb", "/hilfe", "zustellweg"]
PLATFORM_MARKS: dict[str, list[str]] = {
    "dtvp": ["VMPSatellite", "DTVP"],
    "netserver": ["NetServer", "TenderingProcedureDetails"],
    "evergabe_cosinex": ["evergabe.bieter", "Alle herunterladen", "ng-version", "cosinex"],
    "e_va": ["e-va.eu", "bieterportal", "bundde"],
    "ted_eu": ["TED Tenders Electronic Daily", "Publications Office of the EU"],
    "subreport": ["subreport ELViS", "subreport-elvis"],
    "evergabe_online": ["Wicket", "evergabe-online"],
}
WALLS: dict[str, str] = {
    "captcha": "recaptcha|hcaptcha|h-captcha|cf-challenge|cf-ray|ddos-guard|checking your browser|verify you are human|are you a robot|attention required.*cloudflare",
    "login_required": "bitte.{0,3}(melden sie sich an|anmelden)|anmeldung erforderlich|please (log ?in|sign ?in) to (view|access|download)|you must (log ?in|be logged in)|veuillez vous connecter|inicie sesión para|debe iniciar sesión|login required to|sign in required",
    "registration_required": "registrierung (erforderlich|notwendig)|registration (is )?required|create an account to (view|access|download)|nur für (registrierte|angemeldete)|must register to",
    "expired": "verfahren.{0,5}(beendet|abgeschlossen)|ausschreibung.{0,5}(beendet|abgelaufen)|tender (has )?(expired|closed|ended)|frist (ist )?abgelaufen|no longer available|nicht mehr verfügbar",
}
MIME: dict[str, str] = {
    "pdf": "application/pdf", "zip": "application/zip", "docx": "application/vnd.openxmlformats-officedocument.wordprocessingml.document", "txt": "text/plain", "csv": "text/csv", "html": "text/html", "xml": "application/xml",
}
TENDER_ID = r"(54321-(?:Tender|PublishingProcess)-[a-f0-9][a-f0-9\-]+)"


def part(url: Column, i: int) -> Column:
    """1: scheme and authority, 2: authority, 3: path, 4: query with its mark."""
    return F.regexp_extract(url, r"^([A-Za-z][\w+.\-]*://([^/?#]*))([^?#]*)(\?[^#]*)?", i)


def tender_id(url: Column) -> Column:
    return F.nullif(F.regexp_extract(url, f"(?i){TENDER_ID}", 1), F.lit(""))


def _parameter(url: Column, name: str) -> Column:
    """The first value of a query parameter, decoded, empty if it has none; null if it isn't there."""
    raw = lambda query: F.when(query.rlike(f"[?&]{name}="), F.regexp_extract(query, f"[?&]{name}=([^&]*)", 1))
    decoded = lambda value: F.coalesce(F.try_url_decode(value), F.replace(value, F.lit("+"), F.lit(" ")))
    return F.when(url.contains(f"{name}="), once(once(F.coalesce(part(url, 4), F.lit("")), raw), decoded))


def netserver_urls(url: Column) -> Column:
    """Where a NetServer portal has a tender's documents: the address itself, then four others to try; null without the tender's key.

    The key is the parameter TenderOID, else TWOID; where that is missing or empty, what looks like one anywhere in the URL.
    """
    key = F.coalesce(F.nullif(F.coalesce(_parameter(url, "TenderOID"), _parameter(url, "TWOID")), F.lit("")), tender_id(url))
    folder = once(F.regexp_extract(part(url, 3), "(?i)^(/.*?/NetServer/)", 1), lambda f: F.when(f != "", f).otherwise("/NetServer/"))

    def found(k: Column) -> Column:
        details = lambda function, more="": F.concat(k["base"], F.lit(f"TenderingProcedureDetails?function={function}&TenderOID="), k["key"], F.lit(more))
        document = F.concat(k["base"], F.lit("PublicationControllerServlet?function=GetDocumentFile&TWOID="), k["key"])
        load = "_DownloadTenderDocuments"
        return F.array(details(load), details("_DownloadPublicationDocuments"), document, details(load, "&DocumentType=0"), details(load, "&DocumentType=1"))

    return once(key, lambda k: F.when(k.isNotNull(), once(F.struct(k.alias("key"), F.concat(part(url, 1), folder).alias("base")), found)))


def is_external(href: Column, page: Column) -> Column:
    """Whether a link has an authority, and another than the page."""
    authority = F.regexp_extract(href, r"^(?:[A-Za-z][\w+.\-]*:)?//([^/?#]*)", 1)
    return (authority != "") & (authority != part(page, 2))


def _resolved(path: Column, page_path: Column) -> Column:
    """A path as seen from another, without ``.`` and ``..``: each names the folder before or the same, and none leads above the root."""
    beside = F.split(F.regexp_extract(page_path, "^(.*/)", 1), "/", -1)
    steps = F.when(path.startswith("/"), F.split(path, "/", -1)).otherwise(F.concat(F.slice(beside, 1, F.greatest(F.size(beside) - 1, F.lit(0))), F.split(path, "/", -1)))
    inner = F.filter(F.slice(steps, 2, F.greatest(F.size(steps) - 2, F.lit(0))), lambda s: s != "")
    last = F.element_at(steps, -1)
    whole = F.when(F.size(steps) > 1, F.concat(F.slice(steps, 1, 1), inner, F.array(last))).otherwise(steps)
    step = lambda held, s: F.when(s == "..", F.slice(held, 1, F.greatest(F.size(held) - 1, F.lit(0)))).when(s == ".", held).otherwise(F.concat(held, F.array(s)))
    kept = F.aggregate(whole, F.array().cast("array<string>"), step)
    joined = F.array_join(F.when(last.isin(".", ".."), F.concat(kept, F.array(F.lit("")))).otherwise(kept), "/")
    return F.when(joined.startswith("/"), joined).otherwise(F.concat(F.lit("/"), joined))


def absolute(href: Column, page: Column) -> Column:
    """A link as seen from its page: whole addresses, //host, /path, ?query, #place, and names beside the page, with ``.`` and ``..`` resolved in paths."""
    path, rest = F.regexp_extract(href, "^([^?#]*)", 1), F.regexp_extract(href, "([?#](?s:.*))$", 1)
    return (
        F.when(href == "", page).when(href.rlike(r"^[A-Za-z][\w+.\-]*:"), href).when(href.startswith("//"), F.concat(F.regexp_extract(page, r"^([A-Za-z][\w+.\-]*:)", 1), href))
        .when(href.startswith("?"), F.concat(part(page, 1), part(page, 3), href)).when(href.startswith("#"), F.concat(F.regexp_extract(page, "^([^#]*)", 1), href))
        .otherwise(F.concat(part(page, 1), _resolved(path, part(page, 3)), rest))
    )


def extension(url: Column) -> Column:
    return F.lower(F.regexp_extract(F.regexp_extract(url, "^([^?#]*)", 1), r"\.([A-Za-z0-9]{1,5})$", 1))


def slug(text: Column, most: int = 60) -> Column:
    """Lower-case letters and digits between single hyphens."""
    return F.substring(F.regexp_replace(F.regexp_replace(F.lower(text), "[^a-z0-9]+", "-"), "^-+|-+$", ""), 1, most)


def site_slug(url: Column) -> Column:
    """The authority's slug and the first 8 digits of the URL's SHA-1."""
    return F.concat(slug(part(url, 2)), F.lit("-"), F.substring(F.sha1(url), 1, 8))


def cell_domain(cell: Column) -> Column:
    """The host of a cell that is a URL, without www.; null for other cells."""
    host = F.lower(F.regexp_extract(cell, r"(?i)^\s*https?://(?:www\.)?([^/?#:\s]+)", 1))
    return F.nullif(host, F.lit(""))


def is_document_url(url: Column) -> Column:
    """True for known download functions and file endings, false for those of pages; others can't be told without asking, and count as documents."""
    path = F.lower(part(url, 3))
    ends = lambda endings: reduce(lambda a, b: a | b, [path.endswith(x) for x in endings])
    return F.when(reduce(lambda a, b: a | b, [url.rlike(p) for p in DOWNLOADS]), True).when(ends(PAGES), False).otherwise(F.lit(True))


def downloadish(url: Column) -> Column:
    before = F.lower(F.regexp_extract(url, r"^([^?]*)", 1))
    return F.coalesce((url != "") & (reduce(lambda a, b: a | b, [before.endswith(x) for x in DOCUMENTS]) | url.rlike(f"(?i){DOWNLOADISH}")), F.lit(False))


def no_tender(url: Column) -> Column:
    return reduce(lambda a, b: a | b, [F.lower(url).contains(x) for x in NO_TENDER])


def page_platform(html: Column, by_url: Column) -> Column:
    """The platform of the URL, else of the first mark that the page has."""
    low = F.lower(html)
    case = F.when(by_url != "unknown", by_url)
    for name, marks in PLATFORM_MARKS.items():
        case = case.when(reduce(lambda a, b: a | b, [low.contains(m.lower()) for m in marks]), name)
    return case.otherwise("unknown")


def wall(text: Column) -> Column:
    """Why a page shows no documents: the first wall that is found, or null."""
    (name, pattern), *rest = WALLS.items()
    case = F.when(text.rlike(f"(?iu){pattern}"), name)
    for name, pattern in rest:
        case = case.when(text.rlike(f"(?iu){pattern}"), name)
    return case


def mime(ext: Column) -> Column:
    return F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in MIME.items() for x in kv]), ext), F.lit("application/octet-stream"))


def client_ip(forwarded: Column, peer: Column) -> Column:
    """The first address that a proxy has passed on, else the peer's."""
    first = F.trim(F.split(forwarded, ",")[0])
    return F.when(forwarded.isNotNull() & (first != ""), first).otherwise(peer)


def human_bytes(n: Column) -> Column:
    """Bytes, KB or MB with at most one digit after the point."""
    shown = lambda size, unit: F.concat(F.regexp_replace(F.round(n / size, 1).cast("string"), r"\.0$", ""), F.lit(unit))
    return F.when(n < 1024, F.concat(n.cast("string"), F.lit(" B"))).when(n < 1024 * 1024, shown(1024, " KB")).otherwise(shown(1024 * 1024, " MB"))


def first_sentences(text: Column, n: int) -> Column:
    """The first n sentences, which end at . ! or ? before a blank."""
    return F.array_join(F.slice(F.split(F.regexp_replace(text, r"([.!?])\s+", "$1\u0001"), "\u0001"), 1, n), " ")


def shortened(text: Column, most: int) -> Column:
    return F.when(F.length(text) > most, F.concat(F.rtrim(F.substring(text, 1, most - 1)), F.lit("…"))).otherwise(text)


def label(text: Column) -> Column:
    """A table label in normal form: lower case, runs of other signs as one blank."""
    return F.trim(F.regexp_replace(F.lower(text), r"[^a-z0-9äöüß]+", " "))


def backoff(attempt: Column, base: float = 1.0, most: float = 8.0) -> Column:
    """Seconds before the next attempt, without the random part."""
    return F.least(F.lit(most), base * F.pow(F.lit(2.0), attempt - 1))


def retry_after(header: Column) -> Column:
    """Seconds that a Retry-After header asks for, at most 10; null for dates, other texts and none."""
    seconds = F.nullif(F.trim(header), F.lit("")).try_cast("double")
    return F.when(seconds.isNotNull(), F.least(F.lit(10.0), seconds))


def single_encoded(url: Column) -> Column:
    """A URL whose percent signs were encoded twice, with one encoding less."""
    return F.regexp_replace(url, "%25([0-9A-Fa-f]{2})", "%$1")


def without_documents(url: Column) -> Column:
    """A notice's address without a trailing /documents; null where there is none."""
    return F.when(url.rlike("(?i)/documents/?$"), F.regexp_replace(url, "(?i)/documents/?$", ""))


# Other addresses of a notice by portal: what the host has, a pattern of its key in path or query, and the addresses with the key.
_UUID = "([0-9a-f-]{36})"
ALTERNATIVES: list[tuple[str, str, list[str]]] = [
    (
        "bieterzugang.deutsche-evergabe.de", f"/subproject/{_UUID}|[?&]subProjectId=([^&]+)",
        ["{key}", "https://www.deutsche-evergabe.de/dashboards/DetailsDashboard/{key}", "https://www.deutsche-evergabe.de/vergabe/detail/{key}", "https://bieterzugang.deutsche-evergabe.de/evergabe.bieter/DownloadTenderFiles.ashx?subProjectId={key}"],
    ),
    ("auftraege.bayern.de", f"^[^?]*?{_UUID}", ["https://www.auftraege.bayern.de/dashboards/dashboard_off/{key}", "https://www.auftraege.bayern.de/evergabe.bieter/DownloadTenderFiles.ashx?subProjectId={key}"]),
    ("evergabe.bayern.de", f"/deeplink/subproject/{_UUID}", ["https://www.evergabe.bayern.de/tenderdetails/{key}", "https://www.evergabe.bayern.de/vergabe/{key}"]),
    (
        "", r"^[^?]*(?:PublicationControllerServlet|TenderingProcedureDetails)[^?]*\?(?:(?=.*?TWOID=).*?TWOID=|.*?TenderOID=)([^&]+)",
        [
            "{base}/NetServer/PublicationControllerServlet?function=Detail&TWOID={key}&PublicationType=0", "{base}/NetServer/PublicationControllerServlet?function=Detail&TWOID={key}&PublicationType=4",
            "{base}/NetServer/TenderingProcedureDetails?function=_Details&TenderOID={key}", "{base}/NetServer/TenderingProcedureDetails?function=_Details&TenderOID={key}&view=documents",
        ],
    ),
    *[
        (
            host, "^[^?]*?(54321-Tender-[a-f0-9-]+)",
            [
                "{base}/NetServer/TenderingProcedureDetails?function=_Details&TenderOID={key}", "{base}/NetServer/PublicationControllerServlet?function=Detail&TWOID={key}&PublicationType=0",
                "https://europa.vergabe24.de/NetServer/TenderingProcedureDetails?function=_Details&TenderOID={key}", "https://europa.vergabe24.de/NetServer/PublicationControllerServlet?function=Detail&TWOID={key}&PublicationType=0",
            ],
        )
        for host in ("vergabe24.de", "tender24.de")
    ],
    ("subreport.de", r"^[^?]*/E(\d+)(?:\?|$)", ["https://www.subreport.de/E{key}"]),
]


def alternatives(url: Column) -> Column:
    """Other addresses under which a portal may have a notice, the likelier first, without repeats and without the address itself.

    The URL is taken apart once, a portal's key is looked for once, and addresses are made only where there is one.
    """
    none = F.array().cast("array<string>")

    def filled(base: Column, addresses: list[str]) -> Callable[[Column], Column]:
        made = lambda key: F.array(*[F.replace(F.replace(F.lit(a), F.lit("{base}"), base), F.lit("{key}"), key) for a in addresses])
        return lambda key: F.when(key.isNotNull(), made(key)).otherwise(none)

    def others(u: Column) -> Column:
        found = []
        for name, pattern, addresses in ALTERNATIVES:
            groups = [once(F.regexp_extract(u["rest"], pattern, i + 1), lambda g: F.when(g != "", g)) for i in range(2 if "|[?&]" in pattern else 1)]
            found.append(once(F.when(u["host"].contains(name), F.coalesce(*groups)), filled(u["base"], addresses)))
        return F.concat(*found)

    taken = F.struct(F.lower(part(url, 2)).alias("host"), part(url, 1).alias("base"), F.concat(part(url, 3), part(url, 4)).alias("rest"))
    return F.array_except(F.array_distinct(F.array_compact(once(taken, others))), F.array(url))
