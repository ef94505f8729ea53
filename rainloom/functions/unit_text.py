"""Which unit a text names: Column expressions over unit columns and free remarks.

A unit text is folded (case, accents, signs, decimal commas) and matched against patterns that are
composed of a depth part and a time part, so that every spelling of a depth works in a rate as well.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Accents folded to their letter, and the signs that stand for others in units.
_ACCENTED = "àáâãäåçèéêëìíîïñòóôõöùúûüýÿµμ²³⁻¹−–·×"
_PLAIN = "aaaaaaceeeeiiiinooooouuuuyyuu23-1--.x"

_MILLI = r"(?:mm|millimet(?:re|er)s?|mill?imetros?|kg ?/? ?m\^?2|kg[ .]?m\^?-2|(?:l|litres?|liters?|litros?) ?(?:/|per|par|por) ?m\^?2|l[ .]m\^?-2)"
_INCH = r"(?:in|inch|inches|pouces?|polegadas?|pulgadas?|zoll|\"|'')"
_METRE = r"(?:m|met(?:re|er)s?|metros?)"
_OF = r"(?: ?of an?| ?of| de| ?x)? ?"
_TENTH = r"(?:1/10|0\.1|tenths?|dixiemes?|decimos?|zehntel)"
_HUNDREDTH = r"(?:1/100|0\.01|hundredths?|centiemes?|centesimos?|hundertstel)"

#: depth name -> pattern
DEPTHS = {
    "mm": _MILLI,
    "tenth_mm": rf"(?:{_TENTH}{_OF}{_MILLI}|mm ?/ ?10)",
    "cm": r"(?:cm|centimet(?:re|er)s?|centimetros?)",
    "inch": _INCH,
    "hundredth_inch": rf"(?:{_HUNDREDTH}{_OF}{_INCH}|{_INCH} ?/ ?100)",
    "um": r"(?:um|microns?|micra|micromet(?:re|er)s?|micrometros?|mikrometer)",
    "m": _METRE,
}
_PER = r"(?: ?/ ?| per | par | por | pro | a l'|[ .])"
#: time name -> pattern that follows a depth
TIMES = {
    "h": rf"{_PER}(?:1 ?)?(?:h|hr|hrs|hour|heure|hora|stunde)(?:\^?-1)?",
    "day": rf"{_PER}(?:d|day|jour|j|dia|tag|24 ?h)(?:\^?-1)?",
    "min": rf"{_PER}(?:min|minute|minuto)(?:\^?-1)?",
    "s": rf"{_PER}(?:s|sec|second|seconde|segundo|sekunde)(?:\^?-1)?",
}
#: unit code -> (depth, time or None)
CODES = {
    "mm": ("mm", None),
    "tenth_mm": ("tenth_mm", None),
    "cm": ("cm", None),
    "inch": ("inch", None),
    "hundredth_inch": ("hundredth_inch", None),
    "um": ("um", None),
    "mm_h": ("mm", "h"),
    "tenth_mm_h": ("tenth_mm", "h"),
    "inch_h": ("inch", "h"),
    "mm_day": ("mm", "day"),
    "mm_min": ("mm", "min"),
    "m_s": ("m", "s"),
    "mm_s": ("mm", "s"),
}
_SHORT = {"inch_h": r"iph|in ?ph", "mm_h": r"mmh|mmph|l/m2/h"}

#: Words that announce that a remark speaks of the recorded value, and what may stand before the unit.
_SUBJECT = r"(?:values?|readings?|valeurs?|lectures?|leituras?|valore?s?|mesures?|medidas?|outputs?|units?|unites?|unidades?|rates?|flux|fluxo|intensit(?:e|y|es)|taxas?|intensidades?)"
_LINK = r"(?:\b(?:in|en|em|as|counts?|compte)\b|[:,])"


def folded(text: Column) -> Column:
    """``text`` in lower case without accents, with plain signs, single blanks and decimal points."""
    low = F.translate(F.lower(text), _ACCENTED, _PLAIN)
    return F.trim(F.regexp_replace(F.regexp_replace(low, r"(\d),(\d)", "$1.$2"), r"[\s ]+", " "))


def _pattern(code: str) -> str:
    depth, time = CODES[code]
    body = DEPTHS[depth] + (TIMES[time] if time else "")
    return rf"^(?:{body}{'|' + _SHORT[code] if code in _SHORT else ''})\.?$"


def _match(text: Column, quantity: str) -> Column:
    out = F.lit(None).cast("string")
    for code in reversed([c for c, (_, t) in CODES.items() if (t is None) == (quantity == "depth")]):
        out = F.when(text.rlike(_pattern(code)), F.lit(code)).otherwise(out)
    return out


def unit_of(text: Column, quantity: str) -> Column:
    """The code of the unit that ``text`` is; NULL for NULL, blank and unknown texts.

    ``quantity`` is ``depth`` or ``rate``; a unit of the other quantity counts as unknown.
    """
    return _match(folded(text), quantity)


def unit_said(remark: Column, quantity: str) -> Column:
    """The code of the unit in which a free remark says the values are; NULL if it says none.

    Only a clause about the value counts, and only if all that follows is a unit: lengths, speeds and
    thresholds of other things are no unit of the value.  Of several clauses the first counts.
    """
    clauses = F.split(folded(remark), r" ?; ?|\.(?: |$)")
    named = F.transform(
        clauses,
        lambda c: _match(
            F.trim(F.regexp_replace(F.regexp_extract(c, rf"\b{_SUBJECT}\b.*?{_LINK} ?(.*)$", 1), r" ?\([^)]*\)\.?$", "")),
            quantity,
        ),
    )
    return F.when(remark.isNotNull() & folded(remark).rlike(rf"\b{_SUBJECT}\b"), F.get(F.filter(named, lambda u: u.isNotNull()), F.lit(0)))
