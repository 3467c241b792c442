"""Seeded synthetic data: entities, two noisy sources, truth, a registry sample and ZIP centroids, all from row hashes."""

from __future__ import annotations

from dataclasses import dataclass, field, fields
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from weldrow.functions.constants import NICKNAMES
from weldrow.functions.text import lookup, npi_check_digit
from weldrow.operators.evaluate import true_pairs
from weldrow.sources.reference import REGISTRY_COLUMNS

FIRST = sorted({f for formal in NICKNAMES.values() for f in formal})
LAST = ("SMITH", "JOHNSON", "WILLIAMS", "BROWN", "JONES", "GARCIA", "MILLER", "DAVIS", "RODRIGUEZ", "MARTINEZ", "HERNANDEZ", "LOPEZ", "WILSON", "ANDERSON", "THOMAS", "TAYLOR", "MOORE", "JACKSON", "MARTIN", "LEE", "PEREZ", "THOMPSON", "WHITE", "HARRIS", "CLARK", "LEWIS", "ROBINSON", "WALKER", "YOUNG", "ALLEN", "KING", "WRIGHT", "SCOTT", "NGUYEN", "HILL", "FLORES", "GREEN", "ADAMS", "NELSON", "BAKER")
STREETS = ("Main", "Oak", "Maple", "Cedar", "Lake", "Hill", "Park", "Elm", "Washington", "River")
CITIES = (("Chicago", "IL", "606"), ("Albany", "NY", "122"), ("Austin", "TX", "787"), ("Denver", "CO", "802"), ("Boston", "MA", "021"), ("Seattle", "WA", "981"))
TITLES = ("Physician", "NP", "PA-C", "RN", "Medical Director", "Surgeon")
KINDS = ("Family Clinic", "Medical Group", "Hospital", "Health Center", "Pediatrics")


@dataclass(frozen=True)
class NoiseConfig:
    """Chance of each change to a rendered record."""

    nickname: float = 0.12
    typo_last: float = 0.08
    typo_first: float = 0.06
    swap_name: float = 0.02
    drop_middle: float = 0.3
    vary_case: float = 0.2
    abbreviate_org: float = 0.3
    reformat_street: float = 0.3
    reformat_phone: float = 0.3
    drop_phone: float = 0.1
    drop_npi: float = 0.25
    wrong_npi: float = 0.02
    group_npi: float = 0.02
    drop_zip: float = 0.03
    move: float = 0.05
    change_org: float = 0.05
    drop_email: float = 0.2
    drop_title: float = 0.2

    @classmethod
    def none(cls) -> NoiseConfig:
        return cls(**{f.name: 0.0 for f in fields(cls)})


@dataclass(frozen=True)
class SyntheticConfig:
    n_entities: int = 1000
    n_orgs: int = 60
    inclusion_roster: float = 0.85
    inclusion_claims: float = 0.85
    n_distractors: int = 200
    seed: int = 20240901
    noise: NoiseConfig = field(default_factory=NoiseConfig)


@dataclass
class SyntheticDataset:
    entities: DataFrame
    roster: DataFrame
    claims: DataFrame
    truth: DataFrame
    registry: DataFrame
    centroids: DataFrame

    def write(self, out_dir: str | Path) -> dict[str, str]:
        """One CSV folder a table; the registry under the headers of its public file."""
        out = {}
        for n, df in {"entities": self.entities, "roster": self.roster, "claims": self.claims, "truth": self.truth, "nppes_sample": self.registry_file(), "zip_centroids": self.centroids}.items():
            out[n] = f"{out_dir}/{n}.csv"
            df.write.mode("overwrite").csv(out[n], header=True)
        return out

    def registry_file(self) -> DataFrame:
        return self.registry.select(*[F.col(c).alias(h) for h, c in REGISTRY_COLUMNS.items() if c in self.registry.columns])

    def true_pairs(self, cross_source_only: bool = False) -> DataFrame:
        pairs = true_pairs(self.truth)
        parts = F.split("key", r"\|\|")
        return pairs.where(F.split(parts[0], ":")[0] != F.split(parts[1], ":")[0]) if cross_source_only else pairs


class Dice:
    """Uniform draws from a hash of key, seed and name: the same for a row wherever it is computed."""

    def __init__(self, key: Column, seed: int, salt: str) -> None:
        self.key, self.seed, self.salt = key, seed, salt

    def whole(self, name: str, n: int) -> Column:
        return F.pmod(F.xxhash64(self.key, F.lit(self.seed), F.lit(f"{self.salt}:{name}")), F.lit(n))

    def hit(self, name: str, p: float) -> Column:
        return self.whole(name, 1_000_000) < int(p * 1_000_000)

    def of(self, name: str, values) -> Column:
        return F.element_at(F.array(*map(F.lit, values)), (self.whole(name, len(values)) + 1).cast("int"))


def typo(text: Column, dice: Dice, name: str) -> Column:
    """A letter dropped, doubled, swapped with its neighbour or replaced; texts under three letters stay."""
    at = (dice.whole(f"{name}:at", 1_000_003) % F.greatest(F.length(text) - 1, F.lit(1)) + 1).cast("int")
    kind = dice.whole(f"{name}:kind", 4)
    head, a, b, tail = F.substring(text, F.lit(1), at - 1), F.substring(text, at, F.lit(1)), F.substring(text, at + 1, F.lit(1)), F.substring(text, at + 2, F.length(text))
    changed = F.when(kind == 0, F.concat(head, b, tail)).when(kind == 1, F.concat(head, a, a, b, tail)).when(kind == 2, F.concat(head, b, a, tail)).otherwise(F.concat(head, F.lit("E"), b, tail))
    return F.when(F.length(text) < 3, text).otherwise(changed)


def npi(key: Column, kind: str) -> Column:
    nine = F.concat(F.lit(kind), F.lpad(F.pmod(F.xxhash64(key, F.lit("npi")), F.lit(90_000_000)).cast("string"), 8, "0"))
    return F.concat(nine, npi_check_digit(nine).cast("string"))


def _entities(spark: SparkSession, c: SyntheticConfig) -> DataFrame:
    k = spark.range(c.n_entities).select(F.col("id").alias("k"))
    d = Dice(F.col("k"), c.seed, "entity")
    e = k.select("k", d.of("first", FIRST).alias("first"), d.of("middle", "ABCDEFGHJKLMRST").alias("middle"), d.of("last", LAST).alias("last"), d.whole("org", c.n_orgs).alias("o"), d.of("title", TITLES).alias("title"), npi(F.concat(F.lit("p"), "k"), "1").alias("npi"))
    o = Dice(F.col("o"), c.seed, "org")
    town = o.of("town", [f"{a}|{b}|{z}" for a, b, z in CITIES])
    e = e.withColumns({"org": F.concat_ws(" ", F.initcap(o.of("name", LAST)), o.of("kind", KINDS), F.col("o").cast("string")), "_t": F.split(town, r"\|"), "group_npi": npi(F.concat(F.lit("o"), "o"), "2")})
    return e.withColumns({
        "street": F.concat_ws(" ", (o.whole("number", 900) + 100).cast("string"), o.of("street", STREETS), F.lit("Street")), "city": F.col("_t")[0], "state": F.col("_t")[1],
        "zip": F.concat(F.col("_t")[2], F.lpad(o.whole("zip", 100).cast("string"), 2, "0")), "phone": F.concat(F.lit("312"), F.lit("555"), F.lpad(o.whole("phone", 10_000).cast("string"), 4, "0")),
        "email": F.concat(F.lower("first"), F.lit("."), F.lower("last"), F.lit("@org"), F.col("o").cast("string"), F.lit(".example.org")),
        "ein": F.concat(F.lit("36"), F.lpad(o.whole("ein", 10_000_000).cast("string"), 7, "0")), "entity_id": F.format_string("E%06d", F.col("k")),
    }).drop("_t")


def _view(e: DataFrame, c: SyntheticConfig, source: str, share: float) -> DataFrame:
    """The source's records: included entities with noise applied, and the names of what was done in ``noise_ops``."""
    d, n = Dice(F.col("k"), c.seed, source), c.noise
    rows = e.where(d.hit("in", share))
    steps: list[tuple[str, dict[str, Column]]] = [
        ("nickname", {"first": F.coalesce(F.try_element_at(lookup({v[0]: k for k, v in NICKNAMES.items()}), F.col("first")), F.col("first"))}),
        ("typo_first", {"first": typo(F.col("first"), d, "first")}),
        ("typo_last", {"last": typo(F.col("last"), d, "last")}),
        ("swap_name", {"first": F.col("last"), "last": F.col("first")}),
        ("drop_middle", {"middle": F.lit(None).cast("string")}),
        ("abbreviate_org", {"org": F.replace(F.replace(F.col("org"), F.lit("Medical"), F.lit("Med")), F.lit("Center"), F.lit("Ctr"))}),
        ("change_org", {"org": F.concat(F.lit("Other "), "org")}),
        ("reformat_street", {"street": F.replace(F.col("street"), F.lit("Street"), F.lit("St."))}),
        ("move", {"street": F.concat(F.lit("9"), "street"), "zip": F.concat(F.substring("zip", 1, 3), F.lit("99"))}),
        ("drop_zip", {"zip": F.lit(None).cast("string")}),
        ("reformat_phone", {"phone": F.format_string("(%s) %s-%s", F.substring("phone", 1, 3), F.substring("phone", 4, 3), F.substring("phone", 7, 4))}),
        ("drop_phone", {"phone": F.lit(None).cast("string")}),
        ("group_npi", {"npi": F.col("group_npi")}),
        ("wrong_npi", {"npi": F.concat(F.substring("npi", 1, 9), F.pmod(F.substring("npi", 10, 1).cast("int") + 3, F.lit(10)).cast("string"))}),
        ("drop_npi", {"npi": F.lit(None).cast("string")}),
        ("drop_email", {"email": F.lit(None).cast("string")}),
        ("drop_title", {"title": F.lit(None).cast("string")}),
        ("vary_case", {"first": F.initcap("first"), "last": F.initcap("last")}),
    ]
    done = []
    for name, changes in steps:
        hit = d.hit(name, getattr(n, name))
        done.append(F.when(hit, F.lit(name)))
        rows = rows.withColumns({col: F.when(hit, v).otherwise(F.col(col)) for col, v in changes.items()})
    return rows.withColumn("noise_ops", F.concat_ws("|", *done)).withColumn("record_id", F.format_string(f"{source[0].upper()}%07d", F.col("k")))


def generate(spark: SparkSession, config: SyntheticConfig = SyntheticConfig()) -> SyntheticDataset:
    """All tables lazily; the same configuration gives the same rows."""
    e = _entities(spark, config)
    roster, claims = _view(e, config, "roster", config.inclusion_roster), _view(e, config, "claims", config.inclusion_claims)
    truth = [v.select(F.lit(s).alias("source"), F.col("record_id").alias("source_record_id"), "entity_id", "noise_ops") for s, v in (("roster", roster), ("claims", claims))]
    at = F.concat(F.col("street"), F.lit(", "), F.col("city"), F.lit(", "), F.col("state"), F.coalesce(F.concat(F.lit(" "), "zip"), F.lit("")))
    dashed = F.concat(F.substring("ein", 1, 2), F.lit("-"), F.substring("ein", 3, 7))
    shown = roster.select(
        F.col("record_id").alias("Provider ID"), F.concat_ws(" ", "first", "middle", "last").alias("Provider Name"), F.lit("MD").alias("Credentials"), F.col("npi").alias("NPI"),
        F.col("org").alias("Practice Name"), at.alias("Practice Address"), F.col("phone").alias("Phone"), F.col("email").alias("Email"), F.col("title").alias("Job Title"), dashed.alias("Tax ID"),
    )
    billed = claims.select(
        F.col("record_id").alias("rendering_prov_id"), F.col("last").alias("prov_last_name"), F.col("first").alias("prov_first_name"), F.col("middle").alias("prov_middle"), F.col("npi").alias("rendering_npi"),
        F.col("org").alias("billing_org"), F.col("ein").alias("billing_ein"), F.col("street").alias("addr_line1"), "city", "state", "zip", F.col("phone").alias("phone_number"), F.col("title").alias("specialty"),
    )
    extra = _entities(spark, SyntheticConfig(config.n_distractors, config.n_orgs, seed=config.seed + 1)).withColumn("npi", npi(F.concat(F.lit("x"), "k"), "1"))
    person = lambda x: x.select("npi", F.lit(1).alias("entity_type"), "first", "middle", "last", F.col("org").alias("org_name"), "street", "city", "state", "zip", "phone")
    groups = e.select(F.col("group_npi").alias("npi"), F.lit(2).alias("entity_type"), *[F.lit(None).cast("string").alias(x) for x in ("first", "middle", "last")], F.col("org").alias("org_name"), "street", "city", "state", "zip", "phone").dropDuplicates(["npi"])
    zips = e.select("zip").distinct().select(F.col("zip").alias("GEOID"), (F.pmod(F.xxhash64("zip"), F.lit(2000)) / 100 + 28).alias("INTPTLAT"), (-F.pmod(F.xxhash64("zip", F.lit(1)), F.lit(5000)) / 100 - 70).alias("INTPTLONG"))
    return SyntheticDataset(e, shown, billed, truth[0].unionByName(truth[1]), person(e).unionByName(person(extra)).unionByName(groups), zips)
