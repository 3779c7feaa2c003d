"""Extraction rules, the answer scorer, and the failure taxonomy as column expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from tierwright.functions import stats

# Patterns and lists of the rules.
MONTHS = ("January", "February", "March", "April", "May", "June", "July", "August", "September", "October", "November", "December")
COUNTRIES = ("France", "Greece", "Portugal", "Poland", "Italy", "Netherlands", "Spain", "Germany")
TYPOLOGIES = ("fractionnement", "mouvement rapide", "lien sanctions", "contrepartie inhabituelle", "intensite especes")
KEYWORDS = {
    "fractionnement": r"below the (?:declaration|reporting)|just under|sequence of|deposits of between|none individually",
    "mouvement rapide": r"same day|within two hours|nil balance|returned to zero|before close of business|forwarded",
    "lien sanctions": r"sanction|designated persons|restrictions|listed individual|partial match",
    "contrepartie inhabituelle": r"newly incorporated|counterpart(?:y|ies)|no trading history|registered address|first-time",
    "intensite especes": r"cash|notes|denomination|lodgements|takings",
}
DOCUMENT = r"[A-Z]{2}-\d{4}-[A-Z]"
LONG_DATE = rf"\d{{1,2}}\s+(?:{'|'.join(MONTHS)})\s+\d{{4}}"
SHORT_DATE = r"\d{2}/\d{2}/\d{4}"
NAME_AFTER = r"(?:Client|name|application from|The applicant,)\s*:?\s*([A-Z][a-zà-ÿ]+\s[A-Z][a-zà-ÿ]+)"
NAME_FIRST = r"^([A-Z][a-zà-ÿ]+\s[A-Z][a-zà-ÿ]+)\s*\("
ADDRESS = r"(?i)(?:residing at|address(?: on file)?:?|live at|declared address is)\s*([^.]+?)\."


def whole_word(pattern: str) -> str:
    """The pattern between ASCII word boundaries, whatever letters stand outside ASCII."""
    return rf"(?<![A-Za-z0-9_])(?:{pattern})(?![A-Za-z0-9_])"


def first_of(*found: Column) -> Column:
    return F.coalesce(*(F.nullif(c, F.lit("")) for c in found), F.lit(""))


def trimmed(c: Column) -> Column:
    return F.regexp_replace(c, r"^\s+|\s+$", "")


def last_contained(text: Column, values: tuple[str, ...]) -> Column:
    """The last value, in the list's order, that the text contains."""
    return F.coalesce(F.try_element_at(F.filter(F.array(*map(F.lit, values)), lambda v: F.contains(text, v)), F.lit(-1)), F.lit(""))


def rules(text: Column) -> dict[str, Column]:
    """Each field as the rules tier extracts it; an empty text where a rule finds nothing."""
    return {
        "name": first_of(F.regexp_extract(text, NAME_AFTER, 1), F.regexp_extract(text, NAME_FIRST, 1)),
        "birth": first_of(F.regexp_extract(text, whole_word(LONG_DATE), 0), F.regexp_extract(text, whole_word(SHORT_DATE), 0)),
        "document": F.regexp_extract(text, whole_word(DOCUMENT), 0),
        "country": last_contained(text, COUNTRIES),
        "address": trimmed(F.regexp_extract(text, ADDRESS, 1)),
    }


def normalised(c: Column) -> Column:
    """An answer without differences of case, of spaces around separators, and of separators at its end."""
    c = F.regexp_replace(F.lower(c), r"\s*([/\-.,;:])\s*", "$1")
    return trimmed(F.regexp_replace(F.regexp_replace(c, r"[.,;:]+$", ""), r"\s+", " "))


def correct(got: Column, expected: Column) -> Column:
    return (normalised(got) == normalised(expected)) & (F.length(normalised(got)) > 0)


def keyword_class(text: Column) -> Column:
    """The first typology, in order, one of whose keywords the text holds; else an empty text."""
    start = F.when(F.lit(False), F.lit(""))
    return reduce(lambda c, k: c.when(F.rlike(text, F.lit(f"(?i){whole_word(KEYWORDS[k])}")), k), TYPOLOGIES, start).otherwise("")


def failure_mode(got: Column, expected: Column) -> Column:
    """What kind of wrong an answer is: empty, fragment, over-long, wrong span or other."""
    g, e = F.lower(trimmed(got)), F.lower(trimmed(expected))
    foreign = F.exists(F.split(g, r"\s+"), lambda w: (F.length(w) > 3) & ~F.contains(e, w))
    return F.when(g == "", "empty").when(F.contains(e, g), "fragment").when(F.contains(g, e), "over-long").when(foreign, "wrong span").otherwise("other")


def displayed(text: Column) -> Column:
    """The text on one line, as far as a gallery shows it."""
    return F.substring(F.replace(text, F.lit("\n"), F.lit(" ⏎ ")), 1, 120)


def text_shape(text: Column) -> Column:
    """The text with its names and numbers blotted out."""
    return F.regexp_replace(text, r"[A-Z][a-zà-ÿ]+|\d+", "·")


def citation(cite: Column, says: Column) -> Column:
    """How a source is cited on screen: the reference, then what it says."""
    return F.concat_ws(" — ", cite, says)


def provenance(cite: Column, source: Column, retrieved: Column) -> Column:
    """The line that lets a reader go and check."""
    return F.concat_ws(" · ", cite, source, F.concat(F.lit("retrieved "), retrieved))


def parsed_number(text: Column) -> Column:
    """A typed number: spaces dropped, a comma as the point."""
    return F.try_to_number(F.translate(text, ", ", "."), F.lit("S999999999999D999999")).cast("double")


def escaped(c: Column) -> Column:
    """The text as HTML shows it; null as nothing."""
    c = F.coalesce(c, F.lit(""))
    for sign, name in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        c = F.replace(c, F.lit(sign), F.lit(name))
    return c


def grouped(x: Column) -> Column:
    """A number without decimals, the larger of two equally near, its thousands by commas."""
    return F.format_number(F.floor(x + 0.5), 0)


def dollars(x: Column) -> Column:
    return F.concat(F.lit("$"), grouped(x))


def percent(x: Column, digits: int = 1) -> Column:
    """A share in percent with so many digits, the larger of two equally near."""
    return F.concat(F.format_string(f"%.{digits}f", stats.fixed(x * 100, digits)), F.lit(" %"))
