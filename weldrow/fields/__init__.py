"""Field types: what a canonical field derives, when it is valid, and how two of it compare."""

from __future__ import annotations

import importlib.metadata
import inspect
from collections.abc import Callable, Mapping
from dataclasses import dataclass
from typing import Any, ClassVar

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weldrow.functions import text as T
from weldrow.functions import udf
from weldrow.functions.constants import ORG_ALIASES, STATE_CODES, TITLE_TAXONOMY
from weldrow.operators.compare import Comparison, both, exact, missing, overlapping, reversed_columns, similar, within_km

Parts = Mapping[str, Column]


@dataclass
class ComparisonOptions:
    term_frequency: bool = False
    include_phonetic: bool = True
    jaro_winkler_thresholds: tuple[float, ...] = (0.92, 0.85)
    geo: bool = False


class FieldType:
    """A field holds its whole value in ``<field>`` and components in ``<field>_<component>``; ``apply`` adds derived columns.

    Invalid values are flagged and never dropped; a field of which every part is missing derives nulls and the reason
    ``missing``.
    """

    name: ClassVar[str]
    components: ClassVar[tuple[str, ...]] = ()
    outputs: ClassVar[tuple[str, ...]] = ()

    def prepare(self, df: DataFrame, parts: Parts) -> tuple[DataFrame, Parts]:
        """Parsed parts, if a parser has to run first (as columns of the frame, so that it runs once)."""
        return df, parts

    def reason(self, parts: Parts) -> Column:
        raise NotImplementedError

    def standardize(self, parts: Parts) -> dict[str, Column]:
        raise NotImplementedError

    def comparisons(self, field: str, options: ComparisonOptions) -> list[Comparison]:
        raise NotImplementedError

    def input_columns(self, field: str) -> list[str]:
        return [field, *(f"{field}_{c}" for c in self.components)]

    def output_columns(self, field: str) -> list[str]:
        return [*(f"{field}_{s}" for s in self.outputs), f"{field}_valid", f"{field}_invalid_reason"]

    def apply(self, df: DataFrame, field: str) -> DataFrame:
        cols = [c for c in self.input_columns(field) if c in df.columns]
        if not cols:
            raise KeyError(f"none of {self.input_columns(field)} is there for field '{field}' ({self.name})")
        raw = {("value" if c == field else c[len(field) + 1 :]): T.to_text(F.col(c)) for c in cols}
        none = F.lit(None).cast("string")
        parts = {p: raw.get(p, none) for p in ("value", *self.components)}
        absent = F.lit(True)
        for c in raw.values():
            absent = absent & c.isNull()
        out, parsed = self.prepare(df.withColumn("_absent", absent), parts)
        reason = F.when(F.col("_absent"), "missing").otherwise(self.reason(parsed))
        out = out.withColumns({f"_o_{k}": v for k, v in self.standardize(parsed).items()} | {"_o_invalid_reason": reason})
        out = out.withColumn("_o_valid", F.col("_o_invalid_reason").isNull())
        made = [*self.outputs, "valid", "invalid_reason"]
        keep = [c for c in df.columns if c not in self.output_columns(field)]
        shown = [F.when(~F.col("_absent"), F.col(f"_o_{s}")).alias(f"{field}_{s}") if s in self.outputs else F.col(f"_o_{s}").alias(f"{field}_{s}") for s in made]
        return out.select(*keep, *shown)


_TYPES: dict[str, type[FieldType]] = {}
_LOADED = False


def register_field_type(cls: type[FieldType]) -> type[FieldType]:
    if cls.name in _TYPES:
        raise ValueError(f"field type '{cls.name}' is registered already")
    _TYPES[cls.name] = cls
    return cls


def _load_plugins() -> None:
    global _LOADED
    if not _LOADED:
        _LOADED = True
        for point in importlib.metadata.entry_points(group="weldrow.field_types"):
            point.load()


def field_type_class(name: str) -> type[FieldType]:
    _load_plugins()
    if name not in _TYPES:
        raise KeyError(f"unknown field type '{name}'; known: {', '.join(sorted(_TYPES))}")
    return _TYPES[name]


def get_field_type(name: str, **options: Any) -> FieldType:
    return field_type_class(name)(**options)


def field_type_factory(name: str) -> Callable[..., FieldType]:
    return lambda **options: get_field_type(name, **options)


def list_field_types() -> dict[str, str]:
    _load_plugins()
    return {n: (inspect.getdoc(c) or "").split("\n")[0] for n, c in sorted(_TYPES.items())}


@register_field_type
class PersonName(FieldType):
    """Personal name: parsed, cleaned, with formal variants and phonetic codes"""

    name = "person_name"
    components = ("first", "middle", "last", "suffix")
    outputs = ("first", "middle", "last", "suffix", "credential", "first_std", "middle_std", "middle_initial", "last_std", "full_std", "first_variants", "first_dm", "last_dm")

    def prepare(self, df, parts):
        # A last name that came as a component may carry a suffix or credentials: parsed behind a first name.
        alone = F.when(parts["value"].isNull() & parts["last"].isNotNull(), F.concat_ws(" ", F.coalesce(parts["first"], F.lit("X")), parts["last"]))
        df = df.withColumn("_parsed", udf.person_udf(F.coalesce(parts["value"], alone)))
        got = {k: F.col(f"_parsed.{k}") for k in ("first", "middle", "last", "suffix", "credential")}
        whole = parts["value"].isNotNull()
        out = {k: F.coalesce(parts[k], F.when(whole, got[k])) for k in ("first", "middle")}
        out["last"] = F.when(whole, F.coalesce(parts["last"], got["last"])).otherwise(F.when(parts["last"].isNotNull(), got["last"]))
        out["suffix"] = F.coalesce(parts["suffix"], got["suffix"])
        out["credential"] = got["credential"]
        df = df.withColumns({f"_p_{k}": v for k, v in out.items()}).drop("_parsed")
        for k in ("first", "middle", "last"):
            df = df.withColumn(f"_c_{k}", T.blank_to_null(T.basic_clean(F.col(f"_p_{k}"))))
        return df, {k: F.col(f"_p_{k}") for k in out} | {f"{k}_std": F.col(f"_c_{k}") for k in ("first", "middle", "last")}

    def reason(self, p):
        letters = F.coalesce(p["first"], F.lit("")).rlike("[A-Za-z]") | F.coalesce(p["last"], F.lit("")).rlike("[A-Za-z]")
        return F.when(p["first"].isNull() & p["last"].isNull(), "no_name_tokens").when(~letters, "no_letters")

    def standardize(self, p):
        return {k: p[k] for k in ("first", "middle", "last", "suffix", "credential", "first_std", "middle_std", "last_std")} | {
            "middle_initial": F.substring(p["middle_std"], 1, 1),
            "full_std": T.blank_to_null(F.concat_ws(" ", p["first_std"], p["middle_std"], p["last_std"])),
            "first_variants": T.name_variants(p["first_std"]),
            "first_dm": T.phonetic(p["first_std"]),
            "last_dm": T.phonetic(p["last_std"]),
        }

    def comparisons(self, f, o):
        first, last = f"{f}_first_std", f"{f}_last_std"
        jw = [similar(first, t) for t in o.jaro_winkler_thresholds], [similar(last, t) for t in o.jaro_winkler_thresholds]
        dm = [[exact(f"{f}_{p}_dm", "same phonetic code")] if o.include_phonetic else [] for p in ("first", "last")]
        return [
            Comparison(f"{f}_first", (first, f"{f}_first_variants", f"{f}_first_dm"), missing(first), (exact(first, tf=o.term_frequency), overlapping(f"{f}_first_variants", "nickname / formal-name equivalent"), *jw[0], *dm[0]), (first,)),
            Comparison(f"{f}_last", (last, first, f"{f}_last_dm"), missing(last), (exact(last, tf=o.term_frequency), reversed_columns(first, last), *jw[1], *dm[1]), (last,)),
        ]


@register_field_type
class OrgName(FieldType):
    """Organisation name: aliases expanded, legal suffix stripped"""

    name = "org_name"
    outputs = ("raw_std", "clean", "legal_suffix", "dm")

    def __init__(self, aliases: Mapping[str, str] | None = None, use_default_aliases: bool = True) -> None:
        self.aliases = {**(ORG_ALIASES if use_default_aliases else {}), **(aliases or {})}

    def prepare(self, df, parts):
        df = df.withColumn("_clean", T.basic_clean(parts["value"]))
        return df, {"clean": F.col("_clean")}

    def reason(self, p):
        return F.when(~F.coalesce(p["clean"], F.lit("")).rlike(r"(?U)\w"), "no_alphanumerics").when(F.length(p["clean"]) < 2, "too_short")

    def standardize(self, p):
        base, suffix = T.strip_legal_suffix(p["clean"])
        clean = T.blank_to_null(T.apply_aliases(base, self.aliases))
        return {"raw_std": T.blank_to_null(p["clean"]), "clean": clean, "legal_suffix": suffix, "dm": T.phonetic(clean)}

    def comparisons(self, f, o):
        c = f"{f}_clean"
        levels = [exact(f"{f}_raw_std"), exact(c, tf=o.term_frequency), *(similar(c, t) for t in o.jaro_winkler_thresholds)]
        if o.include_phonetic:
            levels.append(exact(f"{f}_dm", "same phonetic code"))
        return [Comparison(f, (c, f"{f}_raw_std", f"{f}_dm"), missing(c), tuple(levels), (c,))]


@register_field_type
class Address(FieldType):
    """US address: parsed, abbreviated, with ZIP centroid coordinates where a table is given"""

    name = "address"
    components = ("street", "city", "state", "zip")
    outputs = ("street", "unit", "city", "state", "zip5", "zip4", "street_std", "city_std", "full_std", "lat", "lon")

    def __init__(self, zip_centroids: DataFrame | None = None) -> None:
        self.centroids = zip_centroids

    def prepare(self, df, parts):
        df = df.withColumn("_parsed", udf.address_udf(parts["value"]))
        got = {k: F.coalesce(parts.get(k, F.lit(None)), F.col(f"_parsed.{k}")) for k in ("street", "city", "state", "zip")} | {"unit": F.col("_parsed.unit")}
        df = df.withColumns({f"_p_{k}": v for k, v in got.items()}).drop("_parsed")
        df = df.withColumn("_zip", T.digits_only(F.col("_p_zip"))).withColumn("_z5", F.when(F.length("_zip") >= 5, F.substring("_zip", 1, 5)))
        if self.centroids is not None:
            table = self.centroids.select(F.col("zip5").alias("_z5"), F.col("lat").alias("_lat"), F.col("lon").alias("_lon"))
            df = df.join(table, "_z5", "left")
        else:
            df = df.withColumns({"_lat": F.lit(None).cast("double"), "_lon": F.lit(None).cast("double")})
        return df, {k: F.col(f"_p_{k}") for k in got} | {"digits": F.col("_zip"), "zip5": F.col("_z5"), "lat": F.col("_lat"), "lon": F.col("_lon")}

    def reason(self, p):
        known = T.normalize_state(p["state"]).isin(*STATE_CODES.values())
        return (
            F.when(p["zip"].isNotNull() & ~F.length(p["digits"]).isin(5, 9), "zip_not_5_or_9_digits")
            .when(p["state"].isNotNull() & ~F.coalesce(known, F.lit(False)), "unknown_state")
            .when(p["street"].isNull() & p["city"].isNull() & p["zip"].isNull(), "no_address_parts")
        )

    def standardize(self, p):
        street, city = T.normalize_street(p["street"]), T.blank_to_null(T.basic_clean(p["city"]))
        full = T.blank_to_null(F.concat_ws(" ", street, city, T.normalize_state(p["state"]), p["zip5"]))
        return {
            "street": p["street"], "unit": p["unit"], "city": p["city"], "state": p["state"], "zip5": p["zip5"],
            "zip4": F.when(F.length(p["digits"]) == 9, F.substring(p["digits"], 6, 4)),
            "street_std": street, "city_std": city, "full_std": full, "lat": p["lat"], "lon": p["lon"],
        }

    def comparisons(self, f, o):
        street, zip5 = f"{f}_street_std", f"{f}_zip5"
        levels = [exact(f"{f}_full_std"), both("same street and ZIP", exact(street), exact(zip5)), both("similar street, same ZIP", similar(street, 0.9), exact(zip5)), exact(zip5, tf=o.term_frequency)]
        if o.geo:
            levels += [within_km(f"{f}_lat", f"{f}_lon", 10), within_km(f"{f}_lat", f"{f}_lon", 50)]
        levels.append(exact(f"{f}_state", "same state"))
        return [Comparison(f, (street, zip5, f"{f}_full_std", f"{f}_state", *((f"{f}_lat", f"{f}_lon") if o.geo else ())), missing(street, zip5), tuple(levels), (street,))]


class _Identifier(FieldType):
    outputs = ("std", "digits")
    check: ClassVar[Callable[[Column], Column]]

    def reason(self, p):
        return type(self).check(p["value"])

    def shown(self, digits: Column) -> Column:
        return digits

    def standardize(self, p):
        digits = T.digits_only(p["value"])
        return {"std": F.when(self.reason(p).isNull(), self.shown(digits)), "digits": T.blank_to_null(digits)}

    def comparisons(self, f, o):
        return [Comparison(f, (f"{f}_std",), missing(f"{f}_std"), (exact(f"{f}_std"),))]


@register_field_type
class NPI(_Identifier):
    """National Provider Identifier with its check digit"""

    name = "npi"
    check = staticmethod(T.npi_reason)


@register_field_type
class EIN(_Identifier):
    """Employer identification number, NN-NNNNNNN"""

    name = "ein"
    check = staticmethod(T.ein_reason)

    def shown(self, digits):
        return F.concat(F.substring(digits, 1, 2), F.lit("-"), F.substring(digits, 3, 7))


@register_field_type
class Phone(FieldType):
    """US phone number as ten digits"""

    name = "phone"
    outputs = ("std", "last7")

    def reason(self, p):
        d = T.normalize_phone(p["value"])
        return (
            F.when(d.isNull(), "not_10_digits")
            .when(F.substring(d, 1, 1).isin("0", "1") | F.substring(d, 4, 1).isin("0", "1"), "invalid_area_or_exchange")
            .when(d.rlike(r"^(\d)\1{9}$"), "repeated_digit")
        )

    def standardize(self, p):
        std = F.when(self.reason(p).isNull(), T.normalize_phone(p["value"]))
        return {"std": std, "last7": F.substring(std, 4, 7)}

    def comparisons(self, f, o):
        return [Comparison(f, (f"{f}_std", f"{f}_last7"), missing(f"{f}_std"), (exact(f"{f}_std"), exact(f"{f}_last7")))]


@register_field_type
class EmailDomain(FieldType):
    """Domain and local part of an e-mail address or bare domain"""

    name = "email_domain"
    outputs = ("domain", "local")

    def reason(self, p):
        return F.when(T.split_email(p["value"])[1].isNull(), "not_email_or_domain")

    def standardize(self, p):
        local, domain = T.split_email(p["value"])
        return {"domain": domain, "local": local}

    def comparisons(self, f, o):
        return [Comparison(f, (f"{f}_domain",), missing(f"{f}_domain"), (exact(f"{f}_domain", tf=o.term_frequency),))]


@register_field_type
class JobTitle(FieldType):
    """Job title with its canonical title"""

    name = "job_title"
    outputs = ("std", "canonical")

    def __init__(self, taxonomy: Mapping[str, str] | None = None, use_default_taxonomy: bool = True) -> None:
        self.taxonomy = {**(TITLE_TAXONOMY if use_default_taxonomy else {}), **(taxonomy or {})}

    def prepare(self, df, parts):
        return df.withColumn("_clean", T.blank_to_null(T.basic_clean(parts["value"]))), {"clean": F.col("_clean")}

    def reason(self, p):
        return F.when(p["clean"].isNull(), "empty_after_cleaning")

    def standardize(self, p):
        known = F.try_element_at(T.lookup(self.taxonomy), p["clean"]) if self.taxonomy else F.lit(None).cast("string")
        return {"std": p["clean"], "canonical": known}

    def comparisons(self, f, o):
        return [Comparison(f, (f"{f}_std", f"{f}_canonical"), missing(f"{f}_std"), (exact(f"{f}_std"), exact(f"{f}_canonical"), similar(f"{f}_std", 0.9)), (f"{f}_std",))]
