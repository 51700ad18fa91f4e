"""Replies of language models as values: fenced JSON, and its merge with fields that are known already."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The fields that a reply may fill, single texts and lists.
TEXTS = ["vergabenummer", "ted_reference", "auftraggeber", "vergabestelle", "titel", "leistungsbeschreibung", "vergabeverfahren", "auftragsart", "veroeffentlichungsdatum", "abgabefrist", "bindefrist", "auftragswert", "waehrung", "leistungsort", "laufzeit", "ansprechpartner", "email", "telefon", "fax"]
LISTS = ["cpv_codes", "nuts_codes", "zuschlagskriterien", "eignungskriterien", "lose"]
FENCE = r"```(?:json)?\s*|\s*```"


def reply_value(reply: Column, salvage: bool = False) -> Column:
    """The VARIANT of a reply without its fences; null where it isn't JSON or isn't an object.

    With ``salvage``, a reply that isn't JSON as a whole is read from its first brace to its last.
    """
    bare = F.trim(F.regexp_replace(reply, FENCE, ""))
    value = F.try_parse_json(bare)
    if salvage:
        value = F.coalesce(value, F.try_parse_json(F.regexp_extract(bare, r"(?s)(\{.*\})", 1)))
    return F.when(F.schema_of_variant(value).startswith("OBJECT"), value)


def _kind(value: Column) -> Column:
    return F.schema_of_variant(value)


def text_of(value: Column, name: str, known: Column) -> Column:
    """The trimmed text of a field, if it is a text that isn't blank; else what is known."""
    found = F.try_variant_get(value, f"$.{name}", "variant")
    text = F.trim(F.try_variant_get(value, f"$.{name}", "string"))
    return F.when((_kind(found) == "STRING") & (text != ""), text).otherwise(known)


def _shown(item: Column) -> Column:
    """An item as text: texts trimmed, numbers as written, True; null for what counts as nothing (null, empty, 0, False)."""
    kind, text = _kind(item), F.trim(item.cast("string"))
    number = F.when(item.try_cast("double") != 0, text)
    return F.when(kind == "STRING", F.when(item.cast("string") != "", text)).when(kind == "BOOLEAN", F.when(item.try_cast("boolean"), "True")).when(kind.rlike("^(BIGINT|DECIMAL|DOUBLE)"), number).when(kind.isin("VOID", "ARRAY<VOID>", "OBJECT<>"), None).otherwise(F.to_json(item))


def list_of(value: Column, name: str, known: Column) -> Column:
    """A field's items as texts, if it is a list that isn't empty and not shorter than the known one; else what is known, nothing being an empty list."""
    items = F.try_variant_get(value, f"$.{name}", "array<variant>")
    held = F.coalesce(known, F.array().cast("array<string>"))
    return F.when((F.size(items) > 0) & (F.size(items) >= F.size(held)), F.filter(F.transform(items, _shown), lambda x: x.isNotNull())).otherwise(held)


def merged_fields(reply: Column, known: dict[str, Column], salvage: bool = False) -> Column:
    """A struct of all fields of ``known`` with what the reply has for them; a reply that can't be read changes nothing."""
    value = reply_value(reply, salvage)
    return F.struct(*[(list_of if n in LISTS else text_of)(value, n, c).alias(n) for n, c in known.items()])
