"""Letters that a pattern's finds must have, so that most texts are passed by without a search."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

_SIGNS = re.compile(r"\\.|\[\^?\]?[^\]]*\]|\{[^}]*\}|.", re.S)


def folded(text: Column) -> Column:
    """A text in which a search without regard to case, also of Unicode's, for letters of ASCII is one for their lower case."""
    odd = reduce(lambda a, b: a | b, [text.contains(x) for x in "ſıİ"])  # seldom there, and translating is slow
    return F.lower(F.when(odd, F.translate(text, "ſıİ", "siI")).otherwise(text))


def alternatives(pattern: str) -> list[str]:
    """A pattern cut at the bars outside of its groups."""
    parts, depth = [""], 0
    for sign in _SIGNS.findall(pattern):
        depth += (sign == "(") - (sign == ")")
        if sign == "|" and depth == 0:
            parts.append("")
        else:
            parts[-1] += sign
    return parts


def required(alternative: str) -> tuple[str, bool]:
    """The longest run of ASCII signs that each find of an alternative has, in lower case, empty if none is known; and whether it is the whole alternative."""
    runs, depth, whole = [""], 0, True
    for sign in [*_SIGNS.findall(alternative), ""]:
        if sign in "?*+" and sign or sign.startswith("{"):  # the sign before it may be missing or repeated
            runs[-1] = runs[-1][:-1] if depth == 0 and sign != "+" else runs[-1]
            plain = ""
        else:
            plain = sign[1:] if len(sign) == 2 and not sign[1].isalnum() else sign if len(sign) == 1 and sign not in ".^$()[]|" else ""
        depth += (sign == "(") - (sign == ")")
        if plain and plain.isascii() and depth == 0:
            runs[-1] += plain.lower()
        elif sign:
            whole, runs = False, [*runs, ""]
    return max(runs, key=len), whole


def may_have(low: Column, pattern: str) -> Column | None:
    """Whether a folded text has what some alternative of the pattern requires; None where nothing is known."""
    needed = [required(a)[0] for a in alternatives(pattern)]
    return reduce(lambda a, b: a | b, [low.contains(n) for n in needed]) if all(needed) else None


def held(text: Column, low: Column, pattern: str) -> Column:
    """Whether a search without regard to case finds the pattern: plain letters in the folded text, others by a search where what they require is there."""
    hits = []
    for alternative in alternatives(pattern):
        needed, whole = required(alternative)
        search = text.rlike(f"(?iu){alternative}")
        hits.append(low.contains(needed) if whole and needed else low.contains(needed) & search if needed else search)
    return reduce(lambda a, b: a | b, hits)
