"""Tender fields out of text: dates, money, references, contacts; all as column expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from bidlake.functions import literals
from bidlake.functions.once import once


def first_match(text: Column, patterns: list[str], flags: str = "ium", low: Column | None = None) -> Column:
    """Group 1 of the first pattern that is found, trimmed; null if none is. With the text folded (``literals.folded``), a pattern is searched only where it may be."""
    finds = []
    for p in patterns:
        search = text.rlike(f"(?{flags}){p}")
        may = literals.may_have(low, p) if low is not None else None
        finds.append(F.when(search if may is None else may & search, F.trim(F.regexp_extract(text, f"(?{flags}){p}", 1))))
    return F.coalesce(*finds)


def all_matches(text: Column, patterns: list[str], flags: str = "iu", group: int = 1) -> Column:
    """Group 1 of every find, pattern by pattern, without repeats and empties."""
    found = F.concat(*[F.regexp_extract_all(text, F.lit(f"(?{flags}){p}"), F.lit(group)) for p in patterns])
    return F.array_distinct(F.filter(F.transform(found, lambda x: F.trim(x)), lambda x: x != ""))


def cleaned(text: Column) -> Column:
    """Single blanks, no table or quote marks; empty: null."""
    return once(text, lambda t: F.when(t.isNotNull(), once(F.trim(F.regexp_replace(F.trim(F.regexp_replace(t, r"\s+", " ")), "[|»«]+", "")), lambda c: F.when(c != "", c))))


def _timestamp(year: Column, month: Column, day: Column, hour: Column, minute: Column, second: Column) -> Column:
    n = lambda c: c.try_cast("int")
    timed = F.try_make_timestamp_ntz(n(year), n(month), n(day), n(hour), n(minute), F.coalesce(n(second), F.lit(0)).cast("decimal(16,6)"))
    whole = F.try_make_timestamp_ntz(n(year), n(month), n(day), F.lit(23), F.lit(59), F.lit(59).cast("decimal(16,6)"))
    return F.when(hour == "", whole).otherwise(timed)


_CLOCK = r"(?:[,\sT]+(\d{1,2}):(\d{2})(?::(\d{2}))?)?"
ISO = rf"(?<!\d)(\d{{4}})-(\d{{1,2}})-(\d{{1,2}}){_CLOCK}"
DAY_FIRST = rf"(?<!\d)(\d{{1,2}})[.\-/](\d{{1,2}})[.\-/](\d{{2,4}}){_CLOCK}"


def parse_deadline(text: Column) -> Column:
    """ISO dates anywhere before day-first ones; without a time the day's last second; impossible dates: null."""
    iso = [F.regexp_extract(text, ISO, i) for i in range(1, 7)]
    dmy = [F.regexp_extract(text, DAY_FIRST, i) for i in range(1, 7)]
    year = F.when(F.length(dmy[2]) == 2, F.concat(F.lit("20"), dmy[2])).otherwise(dmy[2])
    return F.when(text.rlike(ISO), _timestamp(*iso)).when(text.rlike(DAY_FIRST), _timestamp(year, dmy[1], dmy[0], *dmy[3:]))


def parse_number(text: Column) -> Column:
    """Numbers with either mark for thousands or decimals: a single mark before three digits, and repeated ones, part thousands."""
    s = F.regexp_replace(F.regexp_replace(F.trim(text), r"[.,]+$", ""), r"\s", "")
    dots, commas = F.regexp_count(s, F.lit(r"\.")), F.regexp_count(s, F.lit(","))
    no_commas, no_dots = F.replace(s, F.lit(","), F.lit("")), F.replace(s, F.lit("."), F.lit(""))
    plain = (
        F.when((dots == 0) & (commas == 1) & ~s.rlike(r",\d{3}$"), F.replace(s, F.lit(","), F.lit(".")))
        .when(dots == 0, no_commas)
        .when((commas == 0) & ((dots > 1) | s.rlike(r"\.\d{3}$")), no_dots)
        .when(commas == 0, s)
        .when(F.instr(s, ".") < F.instr(s, ","), F.replace(no_dots, F.lit(","), F.lit(".")))
        .otherwise(no_commas)
    )
    return plain.try_cast("double")


# Currencies and multipliers.
SYMBOLS = {"€": "EUR", "$": "USD", "£": "GBP", "¥": "JPY", "₹": "INR"}
CODES = ["EUR", "USD", "GBP", "INR", "CHF", "AED", "SAR", "JPY", "CAD", "AUD"]
MULTIPLIERS = {1e9: ["billions", "billion", "bn"], 1e7: ["crores", "crore", "cr"], 1e6: ["millions", "million", "mn", "m"], 1e5: ["lakhs", "lakh", "lacs"], 1e3: ["k"]}


def currency(text: Column) -> Column:
    """By symbol, then by code, then by a word for rupees."""
    cases = [F.when(text.contains(s), c) for s, c in SYMBOLS.items()] + [F.when(text.rlike(rf"(?i)\b{c}\b"), c) for c in CODES]
    return F.coalesce(*cases, F.when(text.rlike(r"(?i)\b(rs|rupees?)\b"), "INR"))


def parse_money(text: Column) -> Column:
    """(amount, currency) of the first number; null without a currency."""
    words = [w for some in MULTIPLIERS.values() for w in some]
    pattern = rf"(?i)(\d[\d\s,.']*)\s*(?:({'|'.join(sorted(words, key=len, reverse=True))})\b)?"
    number, word = parse_number(F.regexp_extract(text, pattern, 1)), F.lower(F.regexp_extract(text, pattern, 2))
    factor = reduce(lambda c, kv: c.when(word.isin(kv[1]), kv[0]), MULTIPLIERS.items(), F.when(word == "", 1.0))
    money = F.struct((number * factor).alias("amount"), currency(text).alias("currency"))
    return F.when(number.isNotNull() & currency(text).isNotNull(), money)


# Labels and shapes of German tender notices, in the order in which they are tried.
SCALARS: dict[str, list[str]] = {
    "vergabenummer": [r"Vergabe(?:nr\.?|nummer|kennnummer)\s*[:\-]?\s*([A-Z0-9][A-Z0-9\-/_. ]{2,40})", r"Ausschreibungs(?:nr\.?|nummer)\s*[:\-]?\s*([A-Z0-9][A-Z0-9\-/_. ]{2,40})", r"Bekanntmachungs(?:nr\.?|nummer|kennnummer)\s*[:\-]?\s*([A-Z0-9][A-Z0-9\-/_. ]{2,40})", r"Referenz(?:nr\.?|nummer)\s*[:\-]?\s*([A-Z0-9][A-Z0-9\-/_. ]{2,40})", r"Auftrag(?:snummer|snr\.?)\s*[:\-]?\s*([A-Z0-9][A-Z0-9\-/_. ]{2,40})", r"\bVN\s*[:\-]\s*([A-Z0-9][A-Z0-9\-/_. ]{2,40})"],
    "ted_reference": [r"TED[:\s-]*(\d{4}/S[-\s]\d{3}[-\s]\d{6,})", r"Supplement(?:ary)?\s+(?:to\s+)?(?:the\s+)?Official Journal[,\s]*(\d{4}/S[^\s,]+)", r"S\s+(\d{3}[-–]\d{6,})"],
    "auftraggeber": [r"(?:Öffentlicher\s+)?Auftraggeber\s*[:\n]\s*(.+?)(?:\n|Anschrift|Postanschrift|Kontaktstelle|Tel\.?|Fax|$)", r"Vergabestelle\s*[:\n]\s*(.+?)(?:\n|Anschrift|Kontaktstelle|Tel\.?|Fax|$)", r"Beschaffungsstelle\s*[:\n]\s*(.+?)(?:\n|$)", r"Auftraggeber\s*:\s*\n?\s*([A-ZÄÖÜ][^\n]{5,80})"],
    "titel": [r"(?:Auftrags|Ausschreibungs|Vergabe)gegenstand\s*[:\n]\s*(.+?)(?:\n\n|\n[A-Z]|$)", r"Auftragsbezeichnung\s*[:\n]\s*(.+?)\n", r"Bezeichnung\s+des\s+Auftrags\s*[:\n]\s*(.+?)\n", r"Gegenstand\s+(?:der|des)\s+(?:Ausschreibung|Vergabe|Auftrags)\s*[:\n]\s*(.+?)\n", r"Kurzbezeichnung\s*[:\n]\s*(.+?)\n", r"Titel\s*[:\n]\s*(.{10,150}?)(?:\n|$)"],
    "veroeffentlichung": [r"Ver[öo]ffentlichungsdatum\s*[:\n]\s*(\d{1,2}[.\-/]\d{1,2}[.\-/]\d{2,4})", r"Datum\s+der\s+Ver[öo]ffentlichung\s*[:\n]\s*(\d{1,2}[.\-/]\d{1,2}[.\-/]\d{2,4})", r"Bekanntmachungsdatum\s*[:\n]\s*(\d{1,2}[.\-/]\d{1,2}[.\-/]\d{2,4})"],
    "angebotsfrist": [r"(?:Angebotsfrist|Abgabefrist|Einreichungsfrist|Schlusstermin|Bewerbungsfrist)\s*[:\n]\s*(\d{1,2}[.\-/]\d{1,2}[.\-/]\d{2,4}(?:[,\s]+\d{2}:\d{2}(?::\d{2})?(?:\s*Uhr)?)?)", r"Frist\s+(?:für\s+)?(?:die\s+)?(?:Einreichung|Eingang|Angebote?)\s*[:\n]\s*(\d{1,2}[.\-/]\d{1,2}[.\-/]\d{2,4})", r"Eingangsfrist\s*[:\n]\s*(\d{1,2}[.\-/]\d{1,2}[.\-/]\d{2,4})", r"Bis\s+(?:zum|spätestens)\s+(\d{1,2}[.\-/]\d{1,2}[.\-/]\d{2,4})"],
    "bindefrist": [r"Bindefrist\s*[:\n]\s*(.+?)(?:\n|$)", r"Zuschlagsfrist\s*[:\n]\s*(.+?)(?:\n|$)", r"Bindung(?:s(?:frist|dauer))?\s*[:\n]\s*(.+?)(?:\n|$)"],
    "leistungsort": [r"Erfüllungsort\s*[:\n]\s*(.+?)(?:\n|$)", r"Leistungsort\s*[:\n]\s*(.+?)(?:\n|$)", r"Ausführungsort\s*[:\n]\s*(.+?)(?:\n|$)", r"NUTS[:\s-]*[A-Z]{2}\d*[A-Z0-9]*\s+(.+?)(?:\n|$)", r"Ort\s+der\s+(?:Ausführung|Lieferung|Leistung)\s*[:\n]\s*(.+?)(?:\n|$)"],
    "laufzeit": [r"Laufzeit\s+(?:des\s+Auftrags|der\s+(?:Rahmenvereinbarung|Leistung))?\s*[:\n]\s*(.+?)(?:\n|$)", r"Vertragsdauer\s*[:\n]\s*(.+?)(?:\n|$)", r"Leistungszeitraum\s*[:\n]\s*(.+?)(?:\n|$)", r"Beginn\s*[:\n]\s*\d{1,2}[./]\d{1,2}[./]\d{4}\s*.*Ende\s*[:\n]?\s*(\d{1,2}[./]\d{1,2}[./]\d{4})", r"(?:Laufzeit|Ausführungszeitraum)\s*[:\n]\s*(\d+\s*(?:Monate?|Wochen?|Jahre?|Tage?))"],
    "contact_person": [r"Ansprechpartner\s*[:\n]\s*(.+?)(?:\n|Tel|Fax|E-Mail|$)", r"Kontaktperson\s*[:\n]\s*(.+?)(?:\n|Tel|Fax|E-Mail|$)", r"Bearbeiter(?:in)?\s*[:\n]\s*(.+?)(?:\n|Tel|Fax|E-Mail|$)", r"Zuständig(?:e[rn]?)?\s*[:\n]\s*(.+?)(?:\n|Tel|Fax|E-Mail|$)"],
    "phone": [r"Tel(?:efon|\.)\s*[:\-]?\s*(\+?[\d\s()/.\-]{7,25})", r"Phone\s*[:\-]?\s*(\+?[\d\s()/.\-]{7,25})", r"Tel\.\s*:\s*(\+?[\d\s()/.\-]{7,25})"],
    "fax": [r"Fax\s*[:\-]?\s*(\+?[\d\s()/.\-]{7,25})"],
}
DESCRIPTIONS = [r"leistungsbeschreibung\s*[:\n]\s*(.{20,500}?)(?:\n\n|\n[A-Z0-9]|$)", r"beschreibung\s+(?:der\s+)?leistung\s*[:\n]\s*(.{20,500}?)(?:\n\n|\n[A-Z0-9]|$)", r"gegenstand\s+(?:der|des)\s+(?:Auftrags?|Leistung)\s*[:\n]\s*(.{20,500}?)(?:\n\n|\n[A-Z0-9]|$)", r"kurzbeschreibung\s*[:\n]\s*(.{20,500}?)(?:\n\n|\n[A-Z0-9]|$)", r"information\s+(?:über\s+)?(?:den\s+)?Auftragsgegenstand\s*[:\n]\s*(.{20,500}?)(?:\n\n|$)"]
PROCEDURE_LABELS = [r"(?:Art\s+des\s+)?Vergabeverfahren\s*[:\n]\s*(.+?)\n", r"Verfahrensart\s*[:\n]\s*(.+?)\n", r"Auftragsart\s*[:\n]\s*(.+?)\n"]
PROCEDURES = {"Offenes Verfahren": r"offene[sn]?\s+(?:Verfahren|Ausschreibung)", "Nichtoffenes Verfahren": r"nichtoffene[sn]?\s+Verfahren", "Verhandlungsverfahren": "Verhandlungsverfahren", "Wettbewerblicher Dialog": r"wettbewerbliche[rn]?\s+Dialog", "Innovationspartnerschaft": "Innovationspartnerschaft", "Beschleunigtes Verfahren": r"beschleunigtes?\s+Verfahren", "Freihändige Vergabe": r"freihändige\s+Vergabe", "Beschränkte Ausschreibung": r"beschränkte\s+Ausschreibung", "Öffentliche Ausschreibung": r"öffentliche\s+Ausschreibung"}
KINDS = {"Bauauftrag": "Bauauftrag|Bauleistung", "Lieferauftrag": "Lieferauftrag|Lieferung", "Dienstleistungsauftrag": "Dienstleistungsauftrag|Dienstleistung"}
VALUES = [r"(?:Gesamtwert|Auftragswert|Schätzwert|Gesamtvolumen|Auftragsvolumen)\s*[:\n]?\s*(?:(?:ca|circa|rund|etwa)\.?\s*)?(?:EUR|€|CHF|USD)?\s*([\d.,]+(?:\s*(?:Mio\.?|T(?:aus(?:end)?)?\.?|k))?)\s*(?:EUR|€|CHF|USD)?", r"(?:EUR|€)\s*([\d.,]+(?:\s*(?:Mio\.?|Tsd\.?))?)", r"([\d.,]+(?:\s*(?:Mio\.?|Tsd\.?))?\s*(?:EUR|€|CHF|USD))"]
CRITERIA = [r"zuschlagskriterien?\s*[:\n](.*?)(?:\n[A-Z]|\z)", r"awarding\s+criteria?\s*[:\n](.*?)(?:\n[A-Z]|\z)"]


def _labelled(text: Column, low: Column, table: dict[str, str]) -> Column:
    return F.coalesce(*[F.when(literals.may_have(low, p) & text.rlike(f"(?iu){p}"), label) for label, p in table.items()])


def extract_fields(text: Column) -> Column:
    """All fields of a notice as one struct; what isn't found is null or an empty array.

    Each pattern is searched only in texts with the letters that it requires, and each field is worked out once.
    """
    return once(F.struct(text.alias("text"), literals.folded(text).alias("low")), lambda t: _fields(t["text"], t["low"]))


def _fields(text: Column, low: Column) -> Column:
    money = lambda v: F.struct(v.alias("value"), F.when(v.isNotNull(), F.when(F.upper(text).contains("EUR") | text.contains("€"), "EUR").when(F.upper(text).contains("CHF"), "CHF")).alias("currency"))
    cut = lambda x: F.regexp_replace(x, r"^[ \t\-•*·]+|[ \t\-•*·]+$", "")
    lines = F.transform(F.split(first_match(text, CRITERIA, "ius", low), "\n"), cut)
    criteria = F.slice(F.filter(lines, lambda x: (F.length(x) > 3) & (F.length(x) < 200)), 1, 10)
    description = F.substring(F.trim(F.regexp_replace(cleaned(first_match(text, DESCRIPTIONS, "ius", low)), r"\s+", " ")), 1, 400)
    mail = F.when(text.contains("@"), F.regexp_extract(text, r"[\w.+\-]+@[\w\-]+\.[\w.\-]{2,}", 0))
    lots = all_matches(text, [r"los\s+(\d+)\s*[:\-]?\s*(.{5,80})", r"teillos\s+(\d+)\s*[:\-]?\s*(.{5,80})"])
    none = F.when(text.isNotNull(), F.array().cast("array<string>"))
    first = [cleaned(first_match(text, patterns, low=low)).alias(name) for name, patterns in SCALARS.items()] + [
        description.alias("leistungsbeschreibung"),
        F.coalesce(cleaned(first_match(text, PROCEDURE_LABELS, low=low)), _labelled(text, low, PROCEDURES)).alias("vergabeverfahren"),
        _labelled(text, low, KINDS).alias("auftragsart"),
        F.slice(all_matches(text, [r"\b(\d{8}(?:-\d)?)\b"]), 1, 20).alias("cpv_codes"),
        F.when(low.contains("nuts"), F.array_distinct(F.transform(all_matches(text, [r"\bNUTS[:\s-]*([A-Z]{2}\d{0,3}[A-Z0-9]*)\b"]), F.upper))).otherwise(none).alias("nuts_codes"),
        once(cleaned(first_match(text, VALUES, "iu")), money).alias("_money"),
        once(mail, lambda m: F.when(m != "", m)).alias("email"),
        F.coalesce(criteria, F.array().cast("array<string>")).alias("zuschlagskriterien"),
        F.when(low.contains("los"), lots).otherwise(none).alias("lose"),
    ]
    names = [*SCALARS, "leistungsbeschreibung", "vergabeverfahren", "auftragsart", "cpv_codes", "nuts_codes", "auftragswert", "waehrung", "email", "zuschlagskriterien", "lose"]
    place = {"auftragswert": lambda f: f["_money"]["value"], "waehrung": lambda f: f["_money"]["currency"]}
    return once(F.struct(*first), lambda f: F.struct(*[(place[n](f) if n in place else f[n]).alias(n) for n in names]))
