"""Text, identifier and contact functions as column expressions."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F

from weldrow.functions import udf
from weldrow.functions.constants import (
    EIN_PREFIX_RANGES,
    GENERATIONAL_SUFFIXES,
    LEGAL_SUFFIXES,
    NICKNAMES,
    NPI_PREFIX,
    PO_BOX_PHRASES,
    STATE_CODES,
    STREET_ABBREVIATIONS,
    UNIT_TOKENS,
)


def lookup(table: Mapping[str, object]) -> Column:
    """A dictionary as a literal map; for tables of bounded size."""
    return F.create_map(*[F.lit(x) if not isinstance(x, list) else F.array(*map(F.lit, x)) for kv in table.items() for x in kv])


def blank_to_null(c: Column) -> Column:
    return F.when(c != "", c)


def is_missing(c: Column) -> Column:
    """Null, or white space only."""
    return c.isNull() | c.rlike(r"(?U)^\s*$")


def to_text(c: Column) -> Column:
    """Trimmed of white space of any kind; blank is null. Whole floats print as whole numbers."""
    return blank_to_null(F.regexp_replace(c.cast("string"), r"(?U)^\s+|\s+$", ""))


def number_to_text(c: Column) -> Column:
    """A floating-point column as text, whole values without a fraction."""
    return F.when(c.isNotNull() & ~F.isnan(c), F.when(c == F.floor(c), F.floor(c).cast("string")).otherwise(c.cast("string")))


def strip_accents(c: Column) -> Column:
    """Compatibility decomposition without combining marks; only non-ASCII values reach Python."""
    plain = c.rlike(r"^[\x00-\x7F]*$")
    return F.coalesce(udf.nfkd(F.when(~plain, c)), c)


def normalize_whitespace(c: Column) -> Column:
    return F.trim(F.regexp_replace(c, r"(?U)\s+", " "))


def strip_punctuation(c: Column) -> Column:
    return normalize_whitespace(F.regexp_replace(c, r"(?U)[^\w\s]", " "))


def basic_clean(c: Column) -> Column:
    """Accents folded, upper case, punctuation as spaces, single spaces."""
    return strip_punctuation(F.upper(strip_accents(c)))


def digits_only(c: Column) -> Column:
    """ASCII digits."""
    return F.regexp_replace(c, "[^0-9]", "")


def phonetic(c: Column) -> Column:
    """Primary Double Metaphone code of the cleaned value; null if it has none."""
    return udf.metaphone(c)


def jaro_winkler(a: Column, b: Column) -> Column:
    return udf.jaro_winkler_udf(a, b)


def token_sort_ratio(a: Column, b: Column) -> Column:
    return udf.token_sort_udf(a, b)


def name_variants(first: Column, nicknames: Mapping[str, list[str]] = NICKNAMES) -> Column:
    """Sorted first token and the formal names that it stands for."""
    token = F.split(first, " ")[0]
    formal = F.coalesce(F.try_element_at(lookup(nicknames), token), F.array().cast("array<string>"))
    return F.when(F.coalesce(first, F.lit("")) != "", F.array_sort(F.array_distinct(F.concat(F.array(token), formal))))


def split_suffixes(raw: Column) -> tuple[Column, Column]:
    """(generational suffixes, everything else) of a cleaned suffix text."""
    tokens = F.filter(F.split(basic_clean(raw), " "), lambda t: t != "")
    generation = F.filter(tokens, lambda t: t.isin(*GENERATIONAL_SUFFIXES))
    other = F.filter(tokens, lambda t: ~t.isin(*GENERATIONAL_SUFFIXES))
    return blank_to_null(F.array_join(generation, " ")), blank_to_null(F.array_join(other, " "))


_SUFFIX = r"(?:[\s,]+(?:" + "|".join(LEGAL_SUFFIXES) + r"))+\s*$"


def strip_legal_suffix(c: Column) -> tuple[Column, Column]:
    """(cleaned name without its trailing legal suffixes, those suffixes or null)."""
    padded = F.concat(F.lit(" "), c)
    removed = normalize_whitespace(F.regexp_replace(F.regexp_extract(padded, f"({_SUFFIX})", 1), ",", " "))
    return F.when(removed != "", normalize_whitespace(F.regexp_replace(padded, _SUFFIX, ""))).otherwise(c), blank_to_null(removed)


def map_tokens(c: Column, table: Mapping[str, str]) -> Column:
    """Each token replaced by its entry; tokens with an empty entry go."""
    known = lookup(table)
    return F.array_join(F.filter(F.transform(F.split(c, " "), lambda t: F.coalesce(F.try_element_at(known, t), t)), lambda t: t != ""), " ")


def apply_aliases(c: Column, aliases: Mapping[str, str]) -> Column:
    """Phrases, longest first, then single tokens."""
    out = F.concat(F.lit(" "), c, F.lit(" "))
    for phrase in sorted((k for k in aliases if " " in k), key=len, reverse=True):
        out = F.replace(out, F.lit(f" {phrase} "), F.lit(f" {aliases[phrase]} "))
    return map_tokens(normalize_whitespace(out), aliases) if aliases else normalize_whitespace(out)


def normalize_state(c: Column) -> Column:
    """Postal code of a state's name or code; other values cleaned."""
    clean = basic_clean(c)
    return F.when(F.coalesce(c, F.lit("")) != "", F.coalesce(F.try_element_at(lookup(STATE_CODES), clean), blank_to_null(clean)))


def normalize_street(c: Column) -> Column:
    """Cleaned and abbreviated, without the unit and what follows it."""
    clean = basic_clean(c)
    for phrase in PO_BOX_PHRASES:
        clean = F.replace(clean, F.lit(phrase), F.lit("PO BOX"))
    known = lookup(STREET_ABBREVIATIONS)
    tokens = F.transform(F.split(clean, " "), lambda t: F.coalesce(F.try_element_at(known, t), t))
    units = F.filter(F.transform(tokens, lambda t, i: F.when((i > 0) & t.isin(*UNIT_TOKENS), i)), lambda i: i.isNotNull())
    kept = F.slice(tokens, F.lit(1), F.coalesce(F.array_min(units), F.size(tokens)))
    return F.when(F.coalesce(c, F.lit("")) != "", blank_to_null(F.array_join(kept, " ")))


def normalize_phone(c: Column) -> Column:
    """Ten digits without a leading country code 1, else null."""
    d = digits_only(c)
    d = F.when((F.length(d) == 11) & d.startswith("1"), F.substring(d, 2, 10)).otherwise(d)
    return F.when(F.length(d) == 10, d)


def split_email(c: Column) -> tuple[Column, Column]:
    """(local part, domain) of an address; (null, domain) of a bare domain; nulls otherwise."""
    low = F.lower(F.trim(c))
    domain = F.regexp_extract(low, r"^[^@\s]+@([^@\s]+\.[^@\s]+)$", 1)
    local = F.regexp_extract(low, r"^([^@\s]+)@[^@\s]+\.[^@\s]+$", 1)
    bare = F.when(low.rlike(r"^[a-z0-9.-]+\.[a-z]{2,}$"), F.regexp_replace(low, r"^www\.", ""))
    return blank_to_null(local), F.coalesce(F.regexp_replace(blank_to_null(domain), r"^www\.", ""), bare)


def luhn_valid(c: Column) -> Column:
    return F.call_function("luhn_check", c)


def npi_check_digit(nine: Column) -> Column:
    """Check digit of nine NPI digits behind the issuer prefix."""
    digits = F.filter(F.split(F.reverse(F.concat(F.lit(NPI_PREFIX), nine)), ""), lambda d: d != "")
    doubled = F.transform(digits, lambda d, i: F.when(i % 2 == 0, d.cast("int") * 2 - F.when(d.cast("int") > 4, 9).otherwise(0)).otherwise(d.cast("int")))
    return (10 - F.aggregate(doubled, F.lit(0), lambda a, x: a + x) % 10) % 10


def npi_reason(c: Column) -> Column:
    """Why a value is no valid NPI; null if it is one."""
    d = digits_only(c)
    return (
        F.when(c.isNull() | (F.length(d) != 10), "not_10_digits")
        .when(~F.substring(d, 1, 1).isin("1", "2"), "bad_leading_digit")
        .when(~luhn_valid(F.concat(F.lit(NPI_PREFIX), d)), "luhn_failed")
    )


def ein_reason(c: Column) -> Column:
    """Why a value is no valid employer number; null if it is one."""
    d = digits_only(c)
    prefix = F.substring(d, 1, 2).cast("int")
    known = F.lit(False)
    for low, high in EIN_PREFIX_RANGES:
        known = known | prefix.between(low, high)
    return F.when(c.isNull() | (F.length(d) != 9), "not_9_digits").when(~known, "invalid_prefix")


def mask_value(c: Column) -> Column:
    """Digits as 9, capitals as A, small letters as a."""
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(c, "[0-9]", "9"), "[A-Z]", "A"), "[a-z]", "a")


def normalize_header(c: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.lower(c), "[^a-z0-9]+", "_"), "^_+|_+$", "")


def contains_identifier_like(c: Column) -> Column:
    """A run of seven digits or more."""
    return c.rlike("[0-9]{7,}")


def verify_identifier(value: Column, kind: str, source: Column) -> Column:
    """``ok``, or why an extracted identifier is refused: it must stand in the source and be valid."""
    reason = npi_reason(value) if kind == "npi" else ein_reason(value)
    return F.when(~F.contains(source, value), "not_in_source").otherwise(F.coalesce(reason, F.lit("ok")))


def filter_allowed(values: Column, allowed: Column) -> tuple[Column, Column]:
    """(values that are allowed, values that are not)."""
    return F.array_intersect(values, allowed), F.array_except(values, allowed)


def value_key(c: Column, kind: str) -> Column:
    """Cache key of a value: cleaned; of an organisation, without legal suffixes."""
    clean = basic_clean(c)
    return strip_legal_suffix(clean)[0] if kind == "org" else clean


def pair_key(a: Column, b: Column) -> Column:
    return F.concat_ws("||", F.least(a, b), F.greatest(a, b))


def haversine_km(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Great-circle distance on a sphere of radius 6371 km."""
    p1, p2 = F.radians(lat1), F.radians(lat2)
    h = F.pow(F.sin((p2 - p1) / 2), 2) + F.cos(p1) * F.cos(p2) * F.pow(F.sin(F.radians(lon2 - lon1) / 2), 2)
    return 2 * 6371.0 * F.asin(F.sqrt(F.least(F.lit(1.0), h)))
