"""Text rules of posting normalisation, as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# White space as web pages use it (wider than Java's \s), ASCII word letters.
WS = r"[\s\x{00A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{FEFF}]"
WS_CHARS = " \t\n\u000b\f\r\u00a0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000\ufeff"
WORD = "[0-9A-Za-z_]"

# Street words and their short forms, in the order they are applied.
STREET_WORDS = {
    "street": "st",
    "avenue": "ave",
    "boulevard": "blvd",
    "drive": "dr",
    "road": "rd",
    "place": "pl",
    "east": "e",
    "west": "w",
    "north": "n",
    "south": "s",
}
# Fixed value: the word that strict mode shortens to "e" instead of "east".
STRICT_EAST = "last"

# Words, and the sign, that name a unit behind an address.
UNIT_WORDS, UNIT_SIGN = ("apt", "apartment", "unit", "suite", "ste"), "#"

# Borough names.
BOROUGHS = ("Manhattan", "Brooklyn", "Queens", "Bronx", "Staten Island")

# Month abbreviations, January first.
MONTHS = ("jan", "feb", "mar", "apr", "may", "jun", "jul", "aug", "sep", "oct", "nov", "dec")


def blank_to_null(c: Column) -> Column:
    return F.nullif(c, F.lit(""))


def trim_ws(c: Column) -> Column:
    """Strip every kind of white space from both ends."""
    return F.btrim(c, F.lit(WS_CHARS))


def extract(c: Column, pattern: str, group: int = 1) -> Column:
    """First match of a group, null when there is none."""
    return F.try_element_at(F.regexp_extract_all(c, F.lit(pattern), F.lit(group)), F.lit(1))


def has(c: Column, text: str) -> Column:
    return F.contains(c, F.lit(text))


def street_words(strict: bool = True) -> dict[str, str]:
    """Street words and their short forms, in order."""
    return {STRICT_EAST if strict and k == "east" else k: v for k, v in STREET_WORDS.items()}


def normalize_address(c: Column, strict: bool = True) -> Column:
    """Comparable form of a street address.

    ``strict`` keeps the historic rules to the letter: "last" (not "east") becomes
    "e". The trailing unit designator also takes ordinary last words that begin
    with one of its prefixes, in both modes.
    """
    # One kind of blank from here on, so that the patterns stay cheap.
    plain = F.btrim(F.translate(F.lower(c), WS_CHARS, " " * len(WS_CHARS)))
    # The word is matched before the look-behind, which only runs where a word was found.
    words = "|".join(rf"{w}(?<!{WORD}{w})" for w in UNIT_WORDS)
    out = F.regexp_replace(plain, rf"(?:{words}|{UNIT_SIGN}(?<={WORD}{UNIT_SIGN})) *\.? *\w*\z", "")
    # Whole words and the text between them, so one pass replaces every street word.
    pieces = F.regexp_extract_all(out, F.lit(r"\w+|\W+"), F.lit(0))
    lookup = F.create_map(*[F.lit(x) for pair in street_words(strict).items() for x in pair])
    out = F.array_join(F.transform(pieces, lambda w: F.coalesce(F.try_element_at(lookup, w), w)), "")
    out = F.btrim(F.regexp_replace(out, " {2,}", " "))
    return F.btrim(F.rtrim(out, F.lit(".,")))


_UNIT_SUFFIX = (
    rf"(?i)(?:,|{WS})+(?:{'|'.join(UNIT_WORDS)}|{UNIT_SIGN}){WS}*\.?{WS}*({WORD}+){WS}*\z"
)


def split_unit(c: Column) -> Column:
    """Unit named at the end of a location text, original case; null when none."""
    return extract(c, _UNIT_SUFFIX)


def split_address(c: Column) -> Column:
    """Location text without its unit; null when nothing is left."""
    return blank_to_null(trim_ws(F.regexp_replace(c, _UNIT_SUFFIX, "")))


def parse_money(c: Column) -> Column:
    """First dollar amount, whole dollars."""
    digits = F.replace(F.regexp_extract(c, rf"\${WS}*([\d,]+)", 1), F.lit(","), F.lit(""))
    return digits.try_cast("int")


def parse_number(c: Column) -> Column:
    """Number at the start of a text ("2 beds" -> 2.0)."""
    return F.regexp_extract(
        c, rf"\A{WS}*([+-]?(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)?)", 1
    ).try_cast("double")


def parse_date(c: Column) -> Column:
    """Date written as "Feb 07, 2026" / "February 7, 2026" anywhere in a text, or as ISO.

    Days run past the end of a short month into the next one.
    """
    pattern = rf"([A-Za-z]+){WS}+(\d{{1,2}}),?{WS}+(\d{{4}})"
    month = F.array_position(
        F.array(*[F.lit(m) for m in MONTHS]), F.lower(F.left(F.regexp_extract(c, pattern, 1), F.lit(3)))
    ).cast("int")
    day = F.regexp_extract(c, pattern, 2).try_cast("int")
    year = F.regexp_extract(c, pattern, 3).try_cast("int")
    written = F.when(
        (month > 0) & day.between(1, 31), F.date_add(F.make_date(year, month, F.lit(1)), day - 1)
    )
    return F.coalesce(extract(trim_ws(c), r"\A(\d{4}-\d{2}-\d{2})").try_cast("date"), written)


def title_case(c: Column) -> Column:
    return F.initcap(F.lower(c))


def capitalize(c: Column) -> Column:
    """First character upper-cased, the rest untouched."""
    return F.concat(F.upper(F.left(c, F.lit(1))), F.substring(c, 2, 2147483647))


def _known_borough(c: Column) -> Column:
    entries = [part for name in BOROUGHS for part in (F.lit(name.lower()), F.lit(name))]
    return F.try_element_at(F.create_map(*entries), c)


def borough_or_same(c: Column) -> Column:
    """Known borough in its usual case, any other text unchanged."""
    return F.coalesce(_known_borough(F.lower(c)), c)


def borough_or_title(c: Column) -> Column:
    """Known borough in its usual case, any other text in title case."""
    return F.coalesce(_known_borough(trim_ws(F.lower(c))), title_case(c))


def parse_fee(c: Column) -> Column:
    """True when a broker fee is named, false for "no fee", null when unknown."""
    low = F.lower(c)
    return (
        F.when(has(low, "no fee"), F.lit(False))
        .when(has(low, "broker") | has(low, "fee"), F.lit(True))
    )


def parse_pets(c: Column) -> Column:
    low = F.lower(c)
    return blank_to_null(
        F.when(has(low, "no pet"), "no_pets")
        .when(has(low, "dogs") & has(low, "cats"), "pets_allowed")
        .when(has(low, "cats"), "cats_only")
        .when(has(low, "dogs"), "dogs_only")
        .otherwise(c)
    )


def parse_laundry(c: Column) -> Column:
    low = F.lower(c)
    return blank_to_null(
        F.when(has(low, "in unit"), "in_unit")
        .when(has(low, "in bldg") | has(low, "in building"), "in_building")
        .otherwise(c)
    )


def parse_lease_months(c: Column) -> Column:
    return F.regexp_extract(c, rf"(?i)(\d+){WS}*month", 1).try_cast("int")


def fingerprint(c: Column) -> Column:
    """SHA-256 of the UTF-8 text, lower-case hex."""
    return F.sha2(c, 256)


def stable_id(*parts: Column) -> Column:
    """Key that is the same on every run and task retry."""
    return F.sha2(F.concat_ws("\u0001", *parts), 256)
