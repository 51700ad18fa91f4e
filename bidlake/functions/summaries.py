"""Summaries of notices out of their fields: a paragraph, bullets, and texts under a word budget."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Words of a paragraph, letters of a title, and the wording of each sentence and bullet.
WORDS, TITLE = 180, 120
MONTHS = ["January", "February", "March", "April", "May", "June", "July", "August", "September", "October", "November", "December"]


def _said(text: Column) -> Column:
    """A field's text; null if it is empty."""
    return F.when(text != "", text)


def _with(before: str, value: Column, after: str = "") -> Column:
    """The value in its wording; null without one."""
    return F.concat(F.lit(before), value, F.lit(after))


def _joined(parts: list[Column], between: str) -> Column:
    """What there is of the parts; null if there is nothing."""
    return _said(F.concat_ws(between, *parts))


def german_paragraph(f: dict[str, Column]) -> Column:
    """Who buys what; how and for how much; until when, where and how long. What isn't known isn't said."""
    v = {k: _said(c) for k, c in f.items()}
    buyer = F.coalesce(v["auftraggeber"], v["vergabestelle"])
    what = F.concat(v["titel"], F.coalesce(_with(" (", v["auftragsart"], ")"), F.lit("")))
    first = F.coalesce(
        F.concat(buyer, _with(" schreibt ", what, " aus.")),
        _with("Ausgeschrieben wird: ", what, "."),
        F.concat(buyer, F.lit(" führt ein Vergabeverfahren durch.")),
        F.lit("Es handelt sich um ein öffentliches Vergabeverfahren."),
    )
    value = F.concat(F.lit("Auftragswert: "), v["auftragswert"], F.lit(" "), F.coalesce(v["waehrung"], F.lit("EUR")))
    second = _joined([_with("Verfahrensart: ", v["vergabeverfahren"]), value], ". ")
    third = _joined([_with("Angebotsfrist: ", v["abgabefrist"]), _with("Leistungsort: ", v["leistungsort"]), _with("Vertragslaufzeit: ", v["laufzeit"])], ". ")
    return F.concat_ws(" ", first, F.concat(second, F.lit(".")), F.concat(third, F.lit(".")))


def german_bullets(f: dict[str, Column]) -> Column:
    """At most 16 facts, in a fixed order."""
    v = {k: c if k in ("cpv_codes", "nuts_codes", "lose", "zuschlagskriterien") else _said(c) for k, c in f.items()}
    some = lambda name, n, between: F.when(F.size(v[name]) > 0, F.array_join(F.slice(v[name], 1, n), between))
    return F.array_compact(
        F.array(
            _with("Vergabenummer: ", v["vergabenummer"]),
            _with("Auftraggeber: ", F.coalesce(v["auftraggeber"], v["vergabestelle"])),
            _with("Vergabeverfahren: ", v["vergabeverfahren"]),
            _with("Auftragsart: ", v["auftragsart"]),
            F.concat(F.lit("Geschätzter Auftragswert: "), v["auftragswert"], F.lit(" "), F.coalesce(v["waehrung"], F.lit("EUR"))),
            _with("Einreichungsfrist: ", v["abgabefrist"]),
            _with("Bindefrist: ", v["bindefrist"]),
            _with("Veröffentlicht am: ", v["veroeffentlichungsdatum"]),
            _with("Leistungsort: ", v["leistungsort"]),
            _with("Vertragslaufzeit: ", v["laufzeit"]),
            _with("CPV-Code(s): ", some("cpv_codes", 5, ", ")),
            _with("NUTS-Region: ", some("nuts_codes", 3, ", ")),
            F.when(F.size(v["lose"]) > 0, _with("Anzahl Lose: ", F.size(v["lose"]).cast("string"))),
            _with("Zuschlagskriterien: ", some("zuschlagskriterien", 2, "; ")),
            F.coalesce(_with("Kontakt: ", v["email"]), _with("Ansprechpartner: ", v["ansprechpartner"])),
            _with("TED-Referenz: ", v["ted_reference"]),
        )
    )


def long_date(text: Column) -> Column:
    """2025-03-15 as 15 March 2025; anything else as it is."""
    part = lambda i: F.regexp_extract(text, r"^(\d{4})-(\d{2})-(\d{2})", i).try_cast("int")
    month = F.try_element_at(F.array(*map(F.lit, MONTHS)), F.nullif(part(2), F.lit(0)))
    return F.coalesce(F.concat(part(3).cast("string"), F.lit(" "), month, F.lit(" "), part(1).cast("string")), F.trim(text))


def sentences(text: Column) -> Column:
    """The sentences of a text, which end at . ! or ? before white space; blank ones are left out."""
    ends = F.split(F.regexp_replace(F.regexp_replace(text, r"^\s+|\s+$", ""), r"(?<=[.!?])\s+", "\u0001"), "\u0001")
    return F.filter(F.transform(ends, lambda s: F.regexp_replace(s, r"^\s+|\s+$", "")), lambda s: s != "")


def bullet_sentences(text: Column, n: int) -> Column:
    """The first n lines that begin with -, •, * or a number, without that; of a text without such lines its first n sentences."""
    lines = F.transform(F.split(text, r"\r\n|\r|\n"), lambda line: F.regexp_replace(line, r"^\s+|\s+$", ""))
    marked = F.filter(lines, lambda line: line.rlike(r"^[-•*]|^\d+[.)]\s"))
    bare = F.filter(F.transform(marked, lambda line: F.regexp_replace(F.regexp_replace(line, r"^[-•*\d.)]+\s*", ""), r"^\s+|\s+$", "")), lambda line: line != "")
    return F.slice(F.when(F.size(bare) > 0, bare).otherwise(sentences(text)), 1, n)


def within_words(text: Column, most: int = WORDS) -> Column:
    """A text of at most ``most`` words as it is, a longer one up to there: at its last full stop if that lies in the second half, else with an ellipsis."""
    words = F.filter(F.split(text, r"\s+"), lambda w: w != "")
    cut = F.array_join(F.slice(words, 1, most), " ")
    stop = F.length(cut) - F.instr(F.reverse(cut), ".")  # letters before the last full stop; all of them without one
    ended = cut.contains(".") & (stop > F.length(cut) * 0.5)
    return F.when(F.size(words) <= most, text).when(ended, F.substr(cut, F.lit(1), stop + 1)).otherwise(F.concat(cut, F.lit("…")))


def english_summary(f: dict[str, Column]) -> Column:
    """(paragraph, bullets) of the older notices' fields, all texts but ``cpv_codes``; the paragraph stays under WORDS words."""
    v = {k: F.when(F.size(c) > 0, F.array_join(F.slice(c, 1, 5), ", ")) if k == "cpv_codes" else _said(c) for k, c in f.items()}
    title = F.trim(v["tender_title"])
    title = F.when(F.length(title) > TITLE, F.concat(F.rtrim(F.substring(title, 1, TITLE - 1)), F.lit("…"))).otherwise(title)
    intro = F.concat_ws(" ", F.coalesce(F.concat(v["tender_type"], F.lit(" tender")), F.lit("Tender")), _with("issued by ", v["issuing_authority"]), _with("for ", title), _with("(Reference: ", v["tender_id"], ")"))
    published, closing = long_date(v["publication_date"]), long_date(v["submission_deadline"])
    scope = _said(F.array_join(F.slice(sentences(v["scope_of_work"]), 1, 2), " "))
    eligible = _said(F.array_join(bullet_sentences(v["eligibility"], 3), "; "))
    contact = _joined([v["contact_name"], v["contact_email"], _with("Tel: ", v["contact_phone"])], ", ")
    paragraph = F.concat_ws(
        " ",
        F.concat(intro, F.lit(".")),
        _with("This tender was published on ", published, "."),
        _with("The closing date for submissions is ", closing, "."),
        _with("The estimated contract value is ", v["tender_value"], "."),
        _with("CPV code(s): ", v["cpv_codes"], "."),
        scope,
        _with("Eligibility: ", eligible, "."),
        _with("Contact: ", contact, "."),
    )
    bullets = F.array_compact(
        F.array(
            _with("Issuing authority: ", v["issuing_authority"]), _with("Title: ", title), _with("Reference: ", v["tender_id"]), _with("Publication date: ", published), _with("Deadline: ", closing),
            _with("Estimated value: ", v["tender_value"]), _with("Type: ", v["tender_type"]), _with("CPV codes: ", v["cpv_codes"]), _with("Contact: ", v["contact_email"]),
        )
    )
    return F.struct(within_words(paragraph).alias("paragraph"), bullets.alias("bullets"))
