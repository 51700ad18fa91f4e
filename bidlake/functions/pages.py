"""Harvested pages: walls, document keywords, links, portal URLs."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Words that lead to tender documents, most specific first.
KEYWORDS = [
    "vergabeunterlagen", "ausschreibungsunterlagen", "alle herunterladen", "alle dokumente", "alle als zip", "unterlagen herunterladen", "gesamtpaket", "zip-paket", "downloadbereich", "unterlagen", "dokumente", "anlagen", "herunterladen",
    "tender documents", "procurement documents", "bid documents", "download all", "download documents", "all documents", "attachments", "documents", "download", "files",
    "dossier de consultation", "règlement de consultation", "pièces jointes", "pièces du marché", "télécharger", "documents", "pièces", "dce",
    "documentación", "pliego de condiciones", "pliegos", "descargar", "anexos", "expediente", "documentos",
    "peças do procedimento", "descarregar", "baixar", "edital", "anexos", "documentos",
    "documenti di gara", "disciplinare", "scaricare", "allegati", "bando", "scarica", "documenti",
    "aanbestedingsstukken", "downloaden", "bijlagen", "documenten", "stukken",
    "dokumenty zamówienia", "specyfikacja", "załączniki", "pobierz", "dokumenty", "siwz",
    "förfrågningsunderlag", "ladda ner", "hämta", "bilagor", "last ned", "hent", "vedlegg", "dokumenter", "asiakirjat", "lataa", "liitteet", "dokument",
    "zip", "package", "paket",
]
SKIPPED = r"login|logout|signin|sign-in|register|registr|anmeld|datenschutz|impress|privacy|cookie|/agb|archivedProcedures"
# Signs of a wall on a page.
PASSWORD = r"<input[^>]+type\s*=\s*[\"']?password"
LOGIN_FORM = r"<form[^>]+action\s*=\s*[\"'][^\"']*(login|signin|sign-in|anmeld|logon|auth)[^\"']*[\"']"
LOGIN_WORDS = r"\b(anmelden|einloggen|login|log\s?in|sign\s?in|kennwort|passwort|se\s+connecter|connexion|mot\s+de\s+passe|iniciar\s+sesi[oó]n|contrase[nñ]a|accedi|accesso|inloggen|wachtwoord|zaloguj|has[lł]o|entrar|iniciar\s+sess[aã]o)\b"
REGISTER_WORDS = r"\b(registrieren|registrierung|konto\s+erstellen|register|create\s+(an\s+)?account|sign\s?up|s'inscrire|inscription|cr[eé]er\s+un\s+compte|registrarse|crear\s+cuenta|registrati|zarejestruj)\b"
CAPTCHA = r"recaptcha|hcaptcha|cf-turnstile|cf_chl|captcha"
GATED = r"(anmeldung|registrierung)\s+(ist\s+)?(erforderlich|notwendig|ben[oö]tigt)|nur\s+(f[uü]r\s+)?(registrierte|angemeldete)|(um|zum)\s+[^.<]{0,80}(herunterzuladen|einzusehen|teilzunehmen)[^.<]{0,60}(anmelden|registrieren)|m[uü]ssen\s+sie\s+sich\s+[^.<]{0,40}(anmelden|registrieren)|(please|must)\s+(log\s?in|sign\s?in|register)\s+to\s+(view|download|access)"
EXPIRED = r"sichtbarkeitszeitraum[^.<]{0,60}(abgelaufen|nicht\s+erreicht)|(vergabe|ausschreibung|verfahren|angebotsfrist|frist)[^.<]{0,40}(abgelaufen|beendet|abgeschlossen|geschlossen|archiviert)|nicht\s+(mehr\s+)?verf[uü]gbar|tender\s+(has\s+)?(expired|closed|ended|been\s+(deleted|removed))|no\s+longer\s+available|TENDERLITE\.DELETED"
DOCUMENT_LINK = r"href\s*=\s*[\"'][^\"']*(\.pdf|\.zip|\.docx?|\.xlsx?|\.gaeb|\.x8[13]|download|getdocument|documentfile|unterlagen|attachment)[^\"']*[\"']"
SAMPLE = 200_000


def keyword_score(text: Column) -> Column:
    """The number of keywords less the place of the first that the text has; 0 without any."""
    low, n = F.lower(text), len(KEYWORDS)
    case = F.when(text.isNull() | (text == ""), 0)
    return reduce(lambda c, ik: c.when(low.contains(ik[1]), n - ik[0]), enumerate(KEYWORDS), case).otherwise(0)


def login_wall(html: Column) -> Column:
    """(is_wall, kind, confidence): signs add up, links to documents take off, a notice of expiry decides at once. Only a page's first SAMPLE letters count."""
    sample = F.substring(F.coalesce(html, F.lit("")), 1, SAMPLE)
    has = lambda p: sample.rlike(f"(?iu){p}")
    many_words = F.regexp_count(sample, F.lit(f"(?iu){LOGIN_WORDS}")) >= 2
    links = F.regexp_count(sample, F.lit(f"(?iu){DOCUMENT_LINK}"))
    signs = [(has(PASSWORD), 55), (has(LOGIN_FORM), 25), (many_words, 20), (has(REGISTER_WORDS), 10), (has(GATED), 45), (has(CAPTCHA), 35)]
    score = reduce(lambda a, b: a + b, [F.when(sign, points).otherwise(0) for sign, points in signs])
    score = score - F.when(links > 0, 50 + F.least(links, F.lit(5)) * 10).otherwise(0)  # in hundredths
    confidence = F.greatest(F.lit(0), F.least(F.lit(100), score))
    kind = F.when(has(CAPTCHA), "captcha").when(has(PASSWORD) | has(LOGIN_FORM) | many_words, "login").when(has(REGISTER_WORDS), "registration").when(has(GATED), "login")
    verdict = F.struct(((confidence >= 60) & kind.isNotNull()).alias("is_wall"), kind.alias("kind"), (confidence / 100.0).alias("confidence"))
    return F.when(has(EXPIRED), F.struct(F.lit(True).alias("is_wall"), F.lit("expired").alias("kind"), F.lit(0.9).alias("confidence"))).otherwise(verdict)


def links(html: Column) -> Column:
    """Anchors as (href, text), without repeats and without those that lead nowhere."""
    anchor = r"(?is)<a\b[^>]*?href\s*=\s*[\"']([^\"'>]*)[\"'][^>]*>(.*?)</a\s*>"
    hrefs, texts = F.regexp_extract_all(html, F.lit(anchor), F.lit(1)), F.regexp_extract_all(html, F.lit(anchor), F.lit(2))
    clean = lambda t: F.trim(F.regexp_replace(F.regexp_replace(t, r"<[^>]*>", " "), r"\s+", " "))
    pairs = F.zip_with(hrefs, texts, lambda h, t: F.struct(h.alias("href"), clean(t).alias("text")))
    return F.array_distinct(F.filter(pairs, lambda x: (x["href"] != "") & ~x["href"].rlike("(?i)^(#|javascript:|mailto:)")))


def link_score(href: Column, text: Column) -> Column:
    """By the text's keyword, else half of the href's; noise scores 0."""
    by_text = keyword_score(text)
    return F.when(href.rlike(f"(?i)({SKIPPED})"), 0).when(by_text > 0, by_text).otherwise(F.floor(keyword_score(href) / 2).cast("int"))


def project_id(url: Column) -> Column:
    return F.nullif(F.regexp_extract(url, r"(?i)/(?:project|notice)/([A-Z0-9a-z]+)(?:/|$)", 1), F.lit(""))


def archive_url(url: Column) -> Column:
    """Where a portal of the Satellite family has all documents of a project as one archive; null without a project."""
    origin = F.regexp_extract(url, r"^([A-Za-z][\w+.\-]*://[^/?#]*)", 1)
    prefix = F.when(url.contains("/VMPSatellite/"), "VMPSatellite").when(url.contains("/Vergabe/"), "Vergabe").otherwise("Satellite")
    name = project_id(url)
    return F.concat(origin, F.lit("/"), prefix, F.lit("/public/company/project/"), name, F.lit("/de/documents/archive/Vergabeunterlagen_"), name, F.lit(".zip"))


def public_url(url: Column) -> Column:
    """A login entrance rewritten to the page that has the documents."""
    pid = F.regexp_extract(url, r"(?i)[?&]PID=(\d+)", 1)
    entrance = url.rlike(r"(?i)^[a-z]+://[^/?#]*eu-supply\.com[^/?#]*/[^?#]*rwlentrance") & (pid != "")
    origin = F.regexp_extract(url, r"^([A-Za-z][\w+.\-]*://[^/?#]*)", 1)
    return F.when(entrance, F.concat(origin, F.lit("/ctm/Supplier/PublicPurchase/"), pid, F.lit("/0/0"))).otherwise(url)


def canonical_url(url: Column) -> Column:
    """Scheme and host in lower case, / for an empty path, no fragment."""
    part = lambda i: F.regexp_extract(url, r"^([A-Za-z][\w+.\-]*)://([^/?#]*)([^?#]*)(\?[^#]*)?", i)
    path = F.when(part(3) == "", "/").otherwise(part(3))
    return F.concat(F.lower(part(1)), F.lit("://"), F.lower(part(2)), path, part(4))


def real_document(name: Column, content: Column) -> Column:
    """(ok, reason) by size, name and the first bytes; HTML isn't a document whatever it is called."""
    suffix = F.lower(F.regexp_extract(name, r"(\.[^./\\]*)$", 1))
    head = F.lower(F.decode(F.substring(content, 1, 1024), "ISO-8859-1"))
    title = F.regexp_extract(head, r"(?s)<title[^>]*>(.*?)</title>", 1)
    html = head.rlike("<!doctype html|<html|<head>|<script") | title.rlike("login|fehler|error")
    starts = lambda hexed: F.startswith(F.hex(F.substring(content, 1, 8)), F.lit(hexed))
    known = [".pdf", ".zip", ".doc", ".docx", ".xls", ".xlsx", ".ppt", ".pptx", ".rar", ".7z", ".txt", ".odt", ".ods", ".csv", ".gaeb", ".x81", ".x83"]
    reason = (
        F.when(content.isNull() | (F.octet_length(content) < 200), "too_small").when(suffix.isin(".html", ".htm", ".xhtml"), "html_extension").when(html, "html_content")
        .when(starts("255044462D"), "pdf").when(starts("504B0304"), "zip_or_ooxml").when(starts("D0CF11E0A1B11AE1"), "ms_office_ole").when(starts("377ABCAF271C"), "7z")
        .when(starts("526172211A07"), "rar").when(suffix.isin(known), "extension_text_ok").otherwise("unknown_content")
    )
    return F.struct((~reason.isin("too_small", "html_extension", "html_content", "unknown_content")).alias("ok"), reason.alias("reason"))


def wall_evidence(html: Column) -> Column:
    """What speaks for and against a wall, in words, in the order of the signs; a notice of expiry alone if there is one. Of the same first SAMPLE letters as ``login_wall``."""
    sample = F.substring(F.coalesce(html, F.lit("")), 1, SAMPLE)
    has = lambda p: sample.rlike(f"(?iu){p}")
    times = lambda p: F.regexp_count(sample, F.lit(f"(?iu){p}"))
    signs = [
        F.when(has(PASSWORD), F.lit("password input field present")),
        F.when(has(LOGIN_FORM), F.lit("form posts to a login/auth endpoint")),
        F.when(times(LOGIN_WORDS) >= 2, F.concat(times(LOGIN_WORDS).cast("string"), F.lit(" login-vocabulary matches"))),
        F.when(has(REGISTER_WORDS), F.lit("registration prompt present")),
        F.when(has(GATED), F.lit("page text states documents require login/registration")),
        F.when(has(CAPTCHA), F.lit("CAPTCHA / bot-challenge markers")),
        F.when(times(DOCUMENT_LINK) > 0, F.concat(times(DOCUMENT_LINK).cast("string"), F.lit(" public document link(s) present — not a hard wall"))),
    ]
    expired = F.concat(F.lit('expiry notice on page: "'), F.substring(F.regexp_extract(sample, f"(?iu)({EXPIRED})", 1), 1, 100), F.lit('"'))
    return F.when(has(EXPIRED), F.array(expired)).otherwise(F.array_compact(F.array(*signs)))
