"""Queries over the driver tables by name, and the DuckDB SQL that gives the same results.

The tables hold no people, so two sources of person records are derived from ``customer`` by rules that SQL can repeat;
c_custkey is the true entity.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weldrow.config import ColumnMapping, SchemaMapping
from weldrow.functions import text as T
from weldrow.functions import udf
from weldrow.functions.constants import EIN_PREFIX_RANGES, GENERATIONAL_SUFFIXES, LEGAL_SUFFIXES, NICKNAMES, ORG_ALIASES, STATE_CODES, STREET_ABBREVIATIONS, TITLE_TAXONOMY
from weldrow.operators import cluster as C
from weldrow.operators import evaluate as E
from weldrow.operators import model as M
from weldrow.operators.blocking import PIECE, candidate_pairs, deterministic_pairs, rule_sql
from weldrow.operators.compare import Comparison, both, exact, gammas, missing, overlapping, reversed_columns, similar
from weldrow.profiles import PROVIDER, BlockingRule, DeterministicRule, Guard, HardConstraint, PairConstraint
from weldrow.session import cut, written
from weldrow.sources.reference import enrich, hub_frame
from weldrow.sources.tables import apply_mapping

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    """Register a query under its function's name, with its SQL if there is one."""

    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# ---------------------------------------------------------------- people

FIRST = ("JAMES", "MARY", "ROBERT", "PATRICIA", "JOHN", "JENNIFER", "MICHAEL", "LINDA", "DAVID", "ELIZABETH", "WILLIAM", "BARBARA")
NICK = ("JIM", "MARY", "BOB", "PAT", "JACK", "JEN", "MIKE", "LINDA", "DAVE", "LIZ", "BILL", "BARB")
LAST = ("SMITH", "JOHNSON", "WILLIAMS", "BROWN", "JONES", "GARCIA", "MILLER", "DAVIS", "MARTINEZ", "LOPEZ", "WILSON", "ANDERSON", "THOMAS", "TAYLOR", "MOORE")
ORGS = ("MERCY HOSPITAL", "LAKESIDE FAMILY CLINIC", "SAINT LUKE MEDICAL GROUP", "NORTH SHORE ORTHOPEDIC", "VALLEY PEDIATRICS", "UNIVERSITY HEALTH SYSTEM")


def pick(values, index: str):
    return F.element_at(F.array(*map(F.lit, values)), F.expr(f"cast({index} as int) + 1"))


def sql_list(values) -> str:
    return "[" + ", ".join("'" + v.replace("'", "''") + "'" for v in values) + "]"


def base_people(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("k"))
    nine = F.concat(F.lit("1"), F.lpad(F.col("k").cast("string"), 8, "0"))
    return k.select(
        "k", pick(FIRST, "k % 12").alias("f"), pick(NICK, "k % 12").alias("nick"), pick(LAST, "(k div 12) % 15").alias("l"), pick(ORGS, "(k div 7) % 6").alias("org"),
        F.lpad(F.expr("cast((k div 5) * 37 % 100000 as string)"), 5, "0").alias("zip"), F.concat(F.lit("312555"), F.lpad(F.expr("cast(k % 10000 as string)"), 4, "0")).alias("phone"),
        F.concat(nine, T.npi_check_digit(nine).cast("string")).alias("npi"),
    )


def people(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Roster and claims: the same people, the claims with noise by k."""
    b = base_people(spark, sf_dir)
    name = lambda s: [F.concat(F.lit(f"{s}:"), F.col("k").cast("string")).alias("unique_id"), F.lit(s).alias("source_dataset"), F.col("k").cast("string").alias("source_record_id")]
    tail = lambda *c: [x.alias(n) for x, n in zip(c, ("name_first_std", "name_last_std", "org_clean", "address_zip5", "phone_std", "npi_std", "noise_ops"), strict=True)]
    roster = b.select(*name("roster"), *tail(F.col("f"), F.col("l"), F.col("org"), F.col("zip"), F.col("phone"), F.expr("CASE WHEN k % 11 <> 0 THEN npi END"), F.lit("")), "k")
    claims = b.select(
        *name("claims"),
        *tail(
            F.expr("CASE k % 7 WHEN 1 THEN l WHEN 2 THEN nick ELSE f END"), F.expr("CASE k % 7 WHEN 0 THEN substr(l, 1, 1) || substr(l, 3) WHEN 1 THEN f ELSE l END"), F.col("org"), F.col("zip"),
            F.expr("CASE WHEN k % 7 <> 3 THEN phone END"), F.expr("CASE WHEN k % 5 <> 0 THEN npi END"),
            F.expr("CASE k % 7 WHEN 0 THEN 'typo' WHEN 1 THEN 'swap' WHEN 2 THEN 'nickname' WHEN 3 THEN 'drop_phone' ELSE '' END || CASE WHEN k % 5 = 0 THEN '|drop_npi' ELSE '' END"),
        ),
        "k",
    )
    return roster.unionAll(claims)


LUHN = "(10 - list_sum(list_transform(range(14), lambda i: CASE WHEN i % 2 = 0 THEN 2 * substr('80840' || nine, 14 - i, 1)::INT - CASE WHEN substr('80840' || nine, 14 - i, 1)::INT > 4 THEN 9 ELSE 0 END ELSE substr('80840' || nine, 14 - i, 1)::INT END)) % 10) % 10"
PEOPLE = f"""
b0 AS (SELECT c_custkey AS k, {sql_list(FIRST)}[k % 12 + 1] AS f, {sql_list(NICK)}[k % 12 + 1] AS nick, {sql_list(LAST)}[(k // 12) % 15 + 1] AS l, {sql_list(ORGS)}[(k // 7) % 6 + 1] AS org,
  lpad(((k // 5) * 37 % 100000)::VARCHAR, 5, '0') AS zip, '312555' || lpad((k % 10000)::VARCHAR, 4, '0') AS phone, '1' || lpad(k::VARCHAR, 8, '0') AS nine FROM customer),
b AS (SELECT *, nine || (({LUHN})::INT)::VARCHAR AS npi FROM b0),
people AS (
  SELECT 'roster:' || k AS unique_id, 'roster' AS source_dataset, k::VARCHAR AS source_record_id, f AS name_first_std, l AS name_last_std, org AS org_clean, zip AS address_zip5, phone AS phone_std,
    CASE WHEN k % 11 <> 0 THEN npi END AS npi_std, '' AS noise_ops, k FROM b
  UNION ALL SELECT 'claims:' || k, 'claims', k::VARCHAR, CASE k % 7 WHEN 1 THEN l WHEN 2 THEN nick ELSE f END, CASE k % 7 WHEN 0 THEN substr(l, 1, 1) || substr(l, 3) WHEN 1 THEN f ELSE l END, org, zip,
    CASE WHEN k % 7 <> 3 THEN phone END, CASE WHEN k % 5 <> 0 THEN npi END,
    CASE k % 7 WHEN 0 THEN 'typo' WHEN 1 THEN 'swap' WHEN 2 THEN 'nickname' WHEN 3 THEN 'drop_phone' ELSE '' END || CASE WHEN k % 5 = 0 THEN '|drop_npi' ELSE '' END, k FROM b)"""

RULES = [BlockingRule(("npi_std",)), BlockingRule(("name_last_std", "address_zip5")), BlockingRule(("phone_std",)), BlockingRule(sql="l.name_first_std = r.name_last_std AND l.name_last_std = r.name_first_std AND l.address_zip5 = r.address_zip5")]
CERTAIN = [DeterministicRule(("npi_std",), (Guard("name_last_std", 0.85, "name_first_std"),))]
COMPARED = ("name_first_std", "name_last_std", "address_zip5", "npi_std")


def union_sql(link: str = "TRUE", shown=COMPARED, rules=RULES) -> str:
    """Candidates as SQL: for every rule, pairs that no earlier rule has."""
    parts = []
    for i, r in enumerate(rules):
        earlier = "".join(f" AND NOT coalesce({rule_sql(x)}, FALSE)" for x in rules[:i])
        cols = "".join(f", l.{c} AS {c}_l, r.{c} AS {c}_r" for c in shown)
        parts.append(f"SELECT l.unique_id AS unique_id_l, r.unique_id AS unique_id_r, {i} AS match_key{cols} FROM people l JOIN people r ON {rule_sql(r)} AND l.unique_id < r.unique_id AND {link}{earlier}")
    return "cand AS (" + " UNION ALL ".join(parts) + ")"


def comparisons() -> list[Comparison]:
    jw = lambda c: (similar(c, 0.92), similar(c, 0.85))
    return [
        Comparison("name_first", ("name_first_std",), missing("name_first_std"), (exact("name_first_std", tf=True), *jw("name_first_std")), ("name_first_std",)),
        Comparison("name_last", ("name_last_std", "name_first_std"), missing("name_last_std"), (exact("name_last_std"), reversed_columns("name_first_std", "name_last_std"), *jw("name_last_std")), ("name_last_std",)),
        Comparison("zip", ("address_zip5",), missing("address_zip5"), (exact("address_zip5"),)),
        Comparison("npi", ("npi_std",), missing("npi_std"), (exact("npi_std"),)),
    ]


def fixed_model() -> M.Model:
    values = {"name_first": ((0.15, 0.05, 0.1, 0.7), (0.85, 0.03, 0.04, 0.08)), "name_last": ((0.03, 0.02, 0.05, 0.1, 0.8), (0.8, 0.05, 0.04, 0.03, 0.08)), "zip": ((0.1, 0.9), (0.99, 0.01)), "npi": ((0.02, 0.98), (0.999, 0.001))}
    out = M.Model(prior=0.001)
    for c in comparisons():
        labels = c.labels()
        out.m[c.name] = {labels[g]: values[c.name][0][g] for g in sorted(labels)}
        out.u[c.name] = {labels[g]: values[c.name][1][g] for g in sorted(labels)}
    return out


def _gamma_sql() -> str:
    jw = lambda c, t: f"jaro_winkler_similarity({c}_l, {c}_r) >= {t}"
    f, n = "name_first_std", "name_last_std"
    null = lambda c: f"WHEN {c}_l IS NULL OR {c}_r IS NULL THEN -1"
    return f"""gam AS (SELECT *,
  CASE {null(f)} WHEN {f}_l = {f}_r THEN 3 WHEN {jw(f, 0.92)} THEN 2 WHEN {jw(f, 0.85)} THEN 1 ELSE 0 END AS gamma_name_first,
  CASE {null(n)} WHEN {n}_l = {n}_r THEN 4 WHEN {f}_l = {n}_r THEN 3 WHEN {jw(n, 0.92)} THEN 2 WHEN {jw(n, 0.85)} THEN 1 ELSE 0 END AS gamma_name_last,
  CASE {null("address_zip5")} WHEN address_zip5_l = address_zip5_r THEN 1 ELSE 0 END AS gamma_zip,
  CASE {null("npi_std")} WHEN npi_std_l = npi_std_r THEN 1 ELSE 0 END AS gamma_npi FROM cand)"""


def _score_sql() -> str:
    m = fixed_model()
    terms = [f"log2({m.prior} / (1 - {m.prior}))"]
    for c in comparisons():
        whens = " ".join(f"WHEN {g} THEN log2({m.m[c.name][x]} / {m.u[c.name][x]})" for g, x in sorted(c.labels().items()))
        terms.append(f"CASE gamma_{c.name} WHEN -1 THEN 0 {whens} END")
    u = m.u["name_first"]["exact name_first_std"]
    terms.append(f"CASE WHEN gamma_name_first = 3 THEN log2({u} / tf) ELSE 0 END")
    return f"""tf AS (SELECT name_first_std AS v, count(*) / sum(count(*)) OVER () AS tf FROM people WHERE name_first_std IS NOT NULL GROUP BY 1),
scored AS (SELECT *, {" + ".join(terms)} AS match_weight, 1 / (1 + pow(2, -match_weight)) AS match_probability FROM gam LEFT JOIN tf ON name_first_std_l = v)"""


SCORED = f"WITH {PEOPLE}, {union_sql()}, {_gamma_sql()}, {_score_sql()}"
DET = "det AS (SELECT l.unique_id AS unique_id_l, r.unique_id AS unique_id_r FROM people l JOIN people r ON l.npi_std = r.npi_std AND l.unique_id < r.unique_id WHERE l.name_last_std IS NULL OR r.name_last_std IS NULL OR l.name_last_std = r.name_last_std OR l.name_last_std = r.name_first_std OR l.name_first_std = r.name_last_std OR jaro_winkler_similarity(l.name_last_std, r.name_last_std) >= 0.85)"
CONSTRAINT = PairConstraint(("name_first", "name_last"), "some part of the name must agree")
EDGES = f"""{SCORED}, {DET},
fine AS (SELECT * FROM scored WHERE match_probability >= 0.5 AND greatest(gamma_name_first, gamma_name_last) > 0),
rejected AS (SELECT * FROM scored WHERE match_probability >= 0.5 AND NOT greatest(gamma_name_first, gamma_name_last) > 0),
edges AS (SELECT unique_id_l, unique_id_r, max(p) AS match_probability, CASE WHEN count(DISTINCT s) > 1 THEN 'both' ELSE min(s) END AS link_source FROM (
  SELECT unique_id_l, unique_id_r, match_probability AS p, 'probabilistic' AS s FROM fine UNION ALL SELECT unique_id_l, unique_id_r, 1.0, 'deterministic' FROM det) GROUP BY ALL),
kept AS (SELECT e.* FROM edges e JOIN people a ON a.unique_id = unique_id_l JOIN people z ON z.unique_id = unique_id_r WHERE NOT coalesce(a.npi_std <> z.npi_std, FALSE))"""
HARD = [HardConstraint("npi_std", "different valid NPIs never share a cluster")]


def scored_people(spark, sf_dir):
    p = people(spark, sf_dir)
    return p, M.predict(p, RULES, comparisons(), fixed_model(), 0.0)


def people_edges(spark, sf_dir):
    p, scored = scored_people(spark, sf_dir)
    lower = cut(scored.where(F.col("match_probability") >= 0.5))
    edges, rejected = C.build_edges(lower, deterministic_pairs(p, CERTAIN), [CONSTRAINT])
    return p, lower, edges, rejected


CLUSTERED = f"""{EDGES.replace("WITH ", "WITH RECURSIVE ", 1)},
strong AS (SELECT * FROM kept WHERE match_probability >= 0.95),
ways AS (SELECT unique_id_l AS a, unique_id_r AS z FROM strong UNION SELECT unique_id_r, unique_id_l FROM strong),
reach(a, z) AS (SELECT unique_id, unique_id FROM people UNION SELECT r.a, w.z FROM reach r JOIN ways w ON w.a = r.z),
member AS (SELECT a AS unique_id, min(z) AS cluster_id FROM reach GROUP BY 1),
inside AS (SELECT s.*, m.cluster_id FROM strong s JOIN member m ON m.unique_id = s.unique_id_l),
own AS (SELECT unique_id, max(p) AS att FROM (SELECT unique_id_l AS unique_id, match_probability AS p FROM inside UNION ALL SELECT unique_id_r, match_probability FROM inside) GROUP BY 1),
metrics AS (SELECT m.unique_id, m.cluster_id, count(*) OVER w AS size, coalesce(n, 0) AS n_edges, att AS record_attachment, min(att) OVER w AS cluster_confidence
  FROM member m LEFT JOIN own USING (unique_id) LEFT JOIN (SELECT cluster_id, count(*) AS n FROM inside GROUP BY 1) USING (cluster_id) WINDOW w AS (PARTITION BY m.cluster_id)),
flagged AS (SELECT *, CASE WHEN size = 1 THEN 1.0 ELSE n_edges / (size * (size - 1) / 2) END AS edge_density FROM metrics),
entity AS (SELECT cluster_id, 'ENT' || lpad((row_number() OVER (ORDER BY min(unique_id)))::VARCHAR, 6, '0') AS entity_id FROM member GROUP BY 1),
crosswalk AS (SELECT split_part(unique_id, ':', 1) AS source, split_part(unique_id, ':', 2) AS source_record_id, entity_id, unique_id FROM member JOIN entity USING (cluster_id))"""
FLAGS = "concat_ws('|', CASE WHEN size = 1 THEN 'singleton' END, CASE WHEN size > 6 THEN 'oversized' END, CASE WHEN size > 1 AND edge_density < 0.5 THEN 'low_density' END)"


def clustered(spark, sf_dir):
    p, lower, edges, rejected = people_edges(spark, sf_dir)
    kept, conflicting = C.split_conflicts(edges, p, HARD)
    kept = cut(kept)
    member = C.cluster_edges(kept, p, 0.95)
    return p, lower, kept, cut(member)


def crosswalk_of(spark, sf_dir):
    p, lower, kept, member = clustered(spark, sf_dir)
    return p, lower, kept, C.build_crosswalk(C.cluster_metrics(member, kept.where("match_probability >= 0.95")), p)


def truth(p: DataFrame) -> DataFrame:
    return p.select(F.col("source_dataset").alias("source"), "source_record_id", F.col("k").alias("entity_id"), "noise_ops")


TRUE = "true_pairs AS (SELECT 'claims:' || k || '||roster:' || k AS key FROM b)"
KEYED = "keyed AS (SELECT least(unique_id_l, unique_id_r) || '||' || greatest(unique_id_l, unique_id_r) AS key, match_probability AS p, key IN (SELECT key FROM true_pairs) AS hit FROM kept)"


def prf_sql(tp: str, fp: str, fn: str) -> str:
    p, r = f"(CASE WHEN {tp} + {fp} > 0 THEN {tp} / ({tp} + {fp})::DOUBLE ELSE 0 END)", f"(CASE WHEN {tp} + {fn} > 0 THEN {tp} / ({tp} + {fn})::DOUBLE ELSE 0 END)"
    return f"round({p}, 4) AS precision, round({r}, 4) AS recall, round(CASE WHEN {p} + {r} > 0 THEN 2 * {p} * {r} / ({p} + {r}) ELSE 0 END, 4) AS f1"


# ---------------------------------------------------------------- text

CLEAN_SQL = "trim(regexp_replace(regexp_replace(upper(replace(strip_accents({}), 'ß', 'SS')), '[^\\p{{L}}\\p{{N}}_\\s]', ' ', 'g'), '\\s+', ' ', 'g'))"


@query(f"SELECT doc_id, {CLEAN_SQL.format('text')} AS cleaned FROM documents")
def clean_text(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", T.basic_clean(F.col("text")).alias("cleaned"))


@query(r"SELECT doc_id, trim(regexp_replace(text, '\s+', ' ', 'g')) AS spaced, trim(regexp_replace(regexp_replace(text, '[^\p{L}\p{N}_\s]', ' ', 'g'), '\s+', ' ', 'g')) AS bare FROM documents")
def whitespace_punctuation(spark, sf_dir):
    t = F.col("text")
    return table(spark, sf_dir, "documents").select("doc_id", T.normalize_whitespace(t).alias("spaced"), T.strip_punctuation(t).alias("bare"))


@query("SELECT doc_id, regexp_replace(text, '[^0-9]', '', 'g') AS digits, text IS NULL OR trim(text, ' \t\n\r') = '' AS missing, regexp_matches(text, '[0-9]{7,}') AS identifier_like, regexp_replace(regexp_replace(regexp_replace(text, '[0-9]', '9', 'g'), '[A-Z]', 'A', 'g'), '[a-z]', 'a', 'g') AS masked FROM documents")
def digits_and_masks(spark, sf_dir):
    t = F.col("text")
    return table(spark, sf_dir, "documents").select("doc_id", T.digits_only(t).alias("digits"), T.is_missing(t).alias("missing"), T.contains_identifier_like(t).alias("identifier_like"), T.mask_value(t).alias("masked"))


@query("SELECT page_id, trim(regexp_replace(lower(url), '[^a-z0-9]+', '_', 'g'), '_') AS header FROM pages")
def header_norm(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", T.normalize_header(F.col("url")).alias("header"))


@query(r"""
WITH e AS (SELECT doc_id, unnest(regexp_extract_all(text, '[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}')) AS email FROM documents)
SELECT doc_id, email, split_part(lower(email), '@', 1) AS local, regexp_replace(split_part(lower(email), '@', 2), '^www\.', '') AS domain FROM e""")
def email_domain_std(spark, sf_dir):
    e = table(spark, sf_dir, "documents").select("doc_id", F.explode(F.regexp_extract_all("text", F.lit(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}"), F.lit(0))).alias("email"))
    local, domain = T.split_email(F.col("email"))
    return e.select("doc_id", "email", local.alias("local"), domain.alias("domain"))


@query(r"""
WITH h AS (SELECT page_id, lower(regexp_extract(url, '://([^/?#]*)', 1)) AS host FROM pages)
SELECT page_id, CASE WHEN regexp_matches(host, '^[a-z0-9.-]+\.[a-z]{2,}$') THEN regexp_replace(host, '^www\.', '') END AS domain FROM h""")
def url_domain_std(spark, sf_dir):
    host = F.regexp_extract("url", "://([^/?#]*)", 1)
    return table(spark, sf_dir, "pages").select("page_id", T.split_email(host)[1].alias("domain"))


PHONES = ("(312) 555-", "1-312-555-", "312555", "012 555 ", "312.155.", "+1 312 555 ")
_PHONE_SQL = f"WITH p AS (SELECT c_custkey, {sql_list(PHONES)}[c_custkey % 6 + 1] || lpad((c_custkey % 10000)::VARCHAR, 4, '0') AS phone FROM customer), d0 AS (SELECT *, regexp_replace(phone, '[^0-9]', '', 'g') AS d FROM p), d AS (SELECT c_custkey, phone, CASE WHEN length(d) = 11 AND d[1] = '1' THEN d[2:] WHEN length(d) = 10 THEN d END AS d FROM d0)"


@query(f"""{_PHONE_SQL}, r AS (SELECT *, CASE WHEN d IS NULL THEN 'not_10_digits' WHEN d[1] IN ('0', '1') OR d[4] IN ('0', '1') THEN 'invalid_area_or_exchange' WHEN d = repeat(d[1], 10) THEN 'repeated_digit' END AS why FROM d)
SELECT c_custkey, CASE WHEN why IS NULL THEN d END AS phone_std, CASE WHEN why IS NULL THEN d[4:] END AS phone_last7, why IS NULL AS phone_valid, why AS phone_invalid_reason FROM r""")
def phone_std(spark, sf_dir):
    from weldrow.fields import get_field_type

    rows = table(spark, sf_dir, "customer").select("c_custkey", F.concat(pick(PHONES, "c_custkey % 6"), F.lpad(F.expr("cast(c_custkey % 10000 as string)"), 4, "0")).alias("phone"))
    return get_field_type("phone").apply(rows, "phone").drop("phone")


@query(f"WITH n AS (SELECT c_custkey, (c_custkey % 3 + 1)::VARCHAR || lpad(c_custkey::VARCHAR, 8, '0') AS nine FROM customer), v AS (SELECT c_custkey, nine || (c_custkey % 10)::VARCHAR AS npi, nine || (({LUHN})::INT)::VARCHAR AS good FROM n)\nSELECT c_custkey, npi, CASE WHEN npi[1] NOT IN ('1', '2') THEN 'bad_leading_digit' WHEN npi <> good THEN 'luhn_failed' END AS reason, right(good, 1)::INT AS check_digit FROM v")
def npi_validate(spark, sf_dir):
    nine = F.concat(F.expr("cast(c_custkey % 3 + 1 as string)"), F.lpad(F.col("c_custkey").cast("string"), 8, "0"))
    npi = F.concat(nine, F.expr("cast(c_custkey % 10 as string)"))
    return table(spark, sf_dir, "customer").select("c_custkey", npi.alias("npi"), T.npi_reason(npi).alias("reason"), T.npi_check_digit(nine).alias("check_digit"))


_EIN_OK = " OR ".join(f"left(d, 2)::INT BETWEEN {a} AND {z}" for a, z in EIN_PREFIX_RANGES)


@query(f"WITH e AS (SELECT c_custkey, lpad((c_custkey * 7919 % 1000000000)::VARCHAR, 9 - (c_custkey % 13 = 0)::INT, '0') AS d FROM customer)\nSELECT c_custkey, CASE WHEN length(d) <> 9 THEN 'not_9_digits' WHEN NOT ({_EIN_OK}) THEN 'invalid_prefix' END AS ein_invalid_reason, CASE WHEN length(d) = 9 AND ({_EIN_OK}) THEN left(d, 2) || '-' || d[3:] END AS ein_std, d AS ein_digits FROM e")
def ein_validate(spark, sf_dir):
    from weldrow.fields import get_field_type

    d = F.expr("lpad(cast(c_custkey * 7919 % 1000000000 as string), 9 - cast(c_custkey % 13 = 0 as int), '0')")
    return get_field_type("ein").apply(table(spark, sf_dir, "customer").select("c_custkey", d.alias("ein")), "ein").select("c_custkey", "ein_invalid_reason", "ein_std", "ein_digits")


ORG_RAW = ("The St. Mary's Hosp., Inc.", "Lakeside Health Care LLC", "Univ of the North, P.A., Inc", "PA", "OB GYN Assoc. P C", "Ortho & Surg Ctr", "Café Médical Grp", "CO-OP Family Prac Company")


def _tokens_sql(expr: str, mapping: dict) -> str:
    m = "MAP {" + ", ".join(f"'{k}': '{v}'" for k, v in mapping.items() if " " not in k) + "}"
    return f"array_to_string(list_filter(list_transform(string_split({expr}, ' '), lambda t: coalesce({m}[t], t)), lambda t: t <> ''), ' ')"


_SUFFIX_SQL = r"([\s,]+(" + "|".join(LEGAL_SUFFIXES) + r"))+\s*$"
_PHRASES = "' ' || base || ' '"
for _p in sorted((k for k in ORG_ALIASES if " " in k), key=len, reverse=True):
    _PHRASES = f"replace({_PHRASES}, ' {_p} ', ' {ORG_ALIASES[_p]} ')"


@query(f"WITH r AS (SELECT p_partkey, {sql_list(ORG_RAW)}[p_partkey % 8 + 1] AS org FROM part), c AS (SELECT p_partkey, {CLEAN_SQL.format('org')} AS raw FROM r), s AS (SELECT *, trim(regexp_extract(' ' || raw, '{_SUFFIX_SQL}')) AS removed, trim(regexp_replace(' ' || raw, '{_SUFFIX_SQL}', '')) AS base FROM c)\nSELECT p_partkey, raw AS org_raw_std, nullif(removed, '') AS org_legal_suffix, nullif({_tokens_sql(f'trim({_PHRASES})', ORG_ALIASES)}, '') AS org_clean FROM s")
def org_clean(spark, sf_dir):
    from weldrow.fields import get_field_type

    rows = table(spark, sf_dir, "part").select("p_partkey", pick(ORG_RAW, "p_partkey % 8").alias("org"))
    return get_field_type("org_name").apply(rows, "org").select("p_partkey", "org_raw_std", "org_legal_suffix", "org_clean")


JOBS = ("Staff R.N.", "Physician's Assistant", "hospitalist", "Chief Medical Officer", "Wizard", "PA-C", "  ", "Practice  Manager")
_TITLES = "MAP {" + ", ".join(f"'{k}': '{v}'" for k, v in TITLE_TAXONOMY.items()) + "}"


@query(f"WITH r AS (SELECT p_partkey, {sql_list(JOBS)}[p_partkey % 8 + 1] AS t FROM part), c AS (SELECT p_partkey, nullif({CLEAN_SQL.format('t')}, '') AS std FROM r)\nSELECT p_partkey, std AS title_std, {_TITLES}[std] AS title_canonical, std IS NOT NULL AS title_valid FROM c")
def title_canonical(spark, sf_dir):
    from weldrow.fields import get_field_type

    rows = table(spark, sf_dir, "part").select("p_partkey", pick(JOBS, "p_partkey % 8").alias("title"))
    return get_field_type("job_title").apply(rows, "title").select("p_partkey", "title_std", "title_canonical", "title_valid")


STREETS = ("100 North Main Street, Suite 4", "Post Office Box 17", "5 Fifth Avenue Apt 9", "12 O'Hare Blvd. # 3", "Unit 7 Lake Road", "77 West Elm Court Floor 2")
STATES = ("Illinois", "ny", "IL.", "New  Hampshire", "Atlantis", "puerto rico")
_ABBR = _tokens_sql(f"replace(replace({CLEAN_SQL.format('s')}, 'POST OFFICE BOX', 'PO BOX'), 'P O BOX', 'PO BOX')", STREET_ABBREVIATIONS)
_STATES = "MAP {" + ", ".join(f"'{k}': '{v}'" for k, v in STATE_CODES.items()) + "}"


@query(rf"WITH r AS (SELECT p_partkey, {sql_list(STREETS)}[p_partkey % 6 + 1] AS s, {sql_list(STATES)}[p_partkey % 6 + 1] AS st FROM part), t AS (SELECT p_partkey, st, {_ABBR} AS a FROM r)" + "\n" + rf"SELECT p_partkey, regexp_replace(a, '^(\S+(?: \S+)*?) (STE|APT|UNIT|FL|BLDG|RM|DEPT)( .*)?$', '\1') AS street_std, coalesce({_STATES}[{CLEAN_SQL.format('st')}], {CLEAN_SQL.format('st')}) AS state_std FROM t")
def street_state_std(spark, sf_dir):
    rows = table(spark, sf_dir, "part").select("p_partkey", pick(STREETS, "p_partkey % 6").alias("s"), pick(STATES, "p_partkey % 6").alias("st"))
    return rows.select("p_partkey", T.normalize_street(F.col("s")).alias("street_std"), T.normalize_state(F.col("st")).alias("state_std"))


# ---------------------------------------------------------------- sources, joins, scores


@query(f"WITH {PEOPLE} SELECT * FROM people")
def derive_two_sources(spark, sf_dir):
    return people(spark, sf_dir)


@query("SELECT 'crm:' || c_custkey AS unique_id, 'crm' AS source_dataset, c_custkey::VARCHAR AS source_record_id, c_name AS name, c_mktsegment AS org, CAST(NULL AS VARCHAR) AS npi FROM customer")
def apply_source_mapping(spark, sf_dir):
    raw = table(spark, sf_dir, "customer").select(*[F.col(c).cast("string") for c in ("c_custkey", "c_name", "c_mktsegment")])
    mapping = SchemaMapping(source="crm", profile="provider", status="approved", columns=[ColumnMapping(source_column="c_name", target="name"), ColumnMapping(source_column="c_mktsegment", target="org")])
    return apply_mapping(raw, mapping, "crm", "c_custkey", PROVIDER).select("unique_id", "source_dataset", "source_record_id", "name", "org", "npi")


@query(f"WITH {PEOPLE}, {union_sql(shown=())} SELECT * FROM cand")
def block_union(spark, sf_dir):
    return candidate_pairs(people(spark, sf_dir), RULES, columns=())


@query(f"WITH {PEOPLE}, {union_sql('l.source_dataset <> r.source_dataset', shown=())} SELECT * FROM cand")
def block_link_only(spark, sf_dir):
    return candidate_pairs(people(spark, sf_dir), RULES, "link_only", columns=())


@query(f"WITH {PEOPLE}, {union_sql(shown=(), rules=RULES[3:])} SELECT * FROM cand")
def block_swapped(spark, sf_dir):
    return candidate_pairs(people(spark, sf_dir), RULES[3:], columns=())


@query(f"WITH {PEOPLE}, {DET} SELECT *, 0 AS match_key FROM det")
def deterministic_guard(spark, sf_dir):
    return deterministic_pairs(people(spark, sf_dir), CERTAIN)


@query(f"WITH {PEOPLE}, {union_sql()}, {_gamma_sql()} SELECT unique_id_l, unique_id_r, gamma_name_first, gamma_name_last, gamma_zip, gamma_npi FROM gam")
def gamma_vector(spark, sf_dir):
    pairs = candidate_pairs(people(spark, sf_dir), RULES, columns=COMPARED)
    return gammas(pairs, comparisons()).select("unique_id_l", "unique_id_r", *[f"gamma_{c.name}" for c in comparisons()])


@query(f"{SCORED} SELECT unique_id_l, unique_id_r, round(match_weight, 6) AS match_weight, round(match_probability, 6) AS match_probability FROM scored")
def score_fixed_params(spark, sf_dir):
    _, scored = scored_people(spark, sf_dir)
    return scored.select("unique_id_l", "unique_id_r", F.round("match_weight", 6).alias("match_weight"), F.round("match_probability", 6).alias("match_probability"))


@query(f"WITH {PEOPLE} SELECT name_last_std AS value, round(count(*) / sum(count(*)) OVER (), 9) AS tf FROM people WHERE name_last_std IS NOT NULL GROUP BY 1")
def tf_table(spark, sf_dir):
    return M.term_frequencies(people(spark, sf_dir), "name_last_std").select("value", F.round("tf", 9).alias("tf"))


@query(f"WITH {PEOPLE}, {DET}, n AS (SELECT count(*) AS n FROM people) SELECT round(least(greatest((SELECT count(*) FROM det) / 0.6 / (n * (n - 1) / 2), 1e-12), 0.5), 12) AS prior FROM n")
def prior_estimate(spark, sf_dir):
    return spark.createDataFrame([(round(M.estimate_prior(people(spark, sf_dir), CERTAIN, 0.6, "link_and_dedupe"), 12),)], "prior double")


@query(f"WITH {PEOPLE}, {union_sql()}, {_gamma_sql()} SELECT gamma_name_first, gamma_name_last, gamma_zip, gamma_npi, count(*) AS n FROM gam GROUP BY ALL")
def gamma_patterns(spark, sf_dir):
    counted = M.patterns(candidate_pairs(people(spark, sf_dir), RULES, columns=COMPARED), comparisons())
    return spark.createDataFrame([(*p, n) for p, n in counted], "gamma_name_first int, gamma_name_last int, gamma_zip int, gamma_npi int, n long")


@query()
def trained_parameters(spark, sf_dir):
    """u from random pairs, m by expectation maximisation, as a row a level."""
    p = people(spark, sf_dir)
    model = M.estimate_u(p, comparisons(), M.start_model(comparisons()), 200_000)
    model, _ = M.estimate_m(p, [BlockingRule(("npi_std",)), BlockingRule(("name_last_std", "name_first_std"))], comparisons(), model).floored(1e-3)
    return spark.createDataFrame(M.parameter_rows(model), "comparison string, level string, m double, u double, weight_bits double")


@query(f"{SCORED} SELECT unique_id_l, unique_id_r, CASE WHEN greatest(gamma_name_first, gamma_name_last) > 0 THEN '' ELSE 'some part of the name must agree' END AS failed FROM scored")
def pair_constraints(spark, sf_dir):
    _, scored = scored_people(spark, sf_dir)
    return C.check_pairs(scored, [CONSTRAINT]).select("unique_id_l", "unique_id_r", F.array_join("failed_constraints", "|").alias("failed"))


@query(f"{EDGES} SELECT unique_id_l, unique_id_r, round(match_probability, 6) AS match_probability, link_source FROM edges")
def build_edges(spark, sf_dir):
    return people_edges(spark, sf_dir)[2].withColumn("match_probability", F.round("match_probability", 6))


@query(f"{EDGES} SELECT unique_id_l, unique_id_r, round(match_probability, 6) AS match_probability, link_source FROM kept")
def drop_conflicts(spark, sf_dir):
    p, _, edges, _ = people_edges(spark, sf_dir)
    return C.split_conflicts(edges, p, HARD)[0].withColumn("match_probability", F.round("match_probability", 6))


@query(f"{CLUSTERED} SELECT * FROM member")
def people_components(spark, sf_dir):
    return clustered(spark, sf_dir)[3]


@query(f"{CLUSTERED} SELECT unique_id, cluster_id, size AS cluster_size, n_edges, round(edge_density, 6) AS edge_density, round(record_attachment, 6) AS record_attachment, round(cluster_confidence, 6) AS cluster_confidence, {FLAGS} AS flags FROM flagged")
def cluster_metrics(spark, sf_dir):
    _, _, kept, member = clustered(spark, sf_dir)
    rounded = {c: F.round(c, 6) for c in ("edge_density", "record_attachment", "cluster_confidence")}
    return C.cluster_metrics(member, kept.where("match_probability >= 0.95")).withColumns(rounded)


@query(f"{CLUSTERED} SELECT * FROM crosswalk")
def crosswalk(spark, sf_dir):
    return crosswalk_of(spark, sf_dir)[3].select("source", "source_record_id", "entity_id", "unique_id")


@query(f"{CLUSTERED}, hub AS (SELECT entity_id, min(source_record_id) AS hub_npi FROM crosswalk WHERE source = 'roster' GROUP BY 1) SELECT unique_id, coalesce('NPI-' || hub_npi, entity_id) AS entity_id, hub_npi, source = 'roster' AS is_reference FROM crosswalk LEFT JOIN hub USING (entity_id)")
def hub_ids(spark, sf_dir):
    return C.hub_entity_ids(crosswalk_of(spark, sf_dir)[3], "roster").select("unique_id", "entity_id", "hub_npi", "is_reference")


@query()
def split_clusters(spark, sf_dir):
    """Clusters over all edges, conflicting ones included, split by identifier."""
    p, _, edges, _ = people_edges(spark, sf_dir)
    edges = cut(edges)
    return C.split_violating_clusters(cut(C.cluster_edges(edges, p, 0.5)), edges, p, HARD)[0]


@query(f"{EDGES} SELECT unique_id_l, unique_id_r, round(match_probability, 6) AS match_probability, 'score_band' AS review_reason FROM fine WHERE match_probability < 0.9 UNION ALL SELECT unique_id_l, unique_id_r, round(match_probability, 6), 'same_npi_name_conflict' FROM rejected WHERE npi_std_l = npi_std_r")
def review_queue(spark, sf_dir):
    _, lower, _, rejected = people_edges(spark, sf_dir)
    fine = C.check_pairs(lower, [CONSTRAINT]).where("size(failed_constraints) = 0")
    out = C.review_queue(fine, 0.5, 0.9, [], rejected, "npi_std")
    return out.select("unique_id_l", "unique_id_r", F.round("match_probability", 6).alias("match_probability"), "review_reason")


@query(f"{_PHONE_SQL}, r AS (SELECT CASE WHEN c_custkey % 2 = 0 THEN 'even' ELSE 'odd' END AS source, CASE WHEN c_custkey % 17 = 0 THEN 'missing' WHEN d IS NULL THEN 'not_10_digits' WHEN d[1] IN ('0', '1') OR d[4] IN ('0', '1') THEN 'invalid_area_or_exchange' END AS why FROM d)\nSELECT source, 'phone' AS field, count(*) AS n, count(*) FILTER (why IS NULL) AS valid, count(*) FILTER (why = 'missing') AS missing, count(*) FILTER (why <> 'missing') AS invalid, coalesce(string_agg(DISTINCT why, '|' ORDER BY why) FILTER (why <> 'missing'), '') AS reasons FROM r GROUP BY 1")
def validation_summary(spark, sf_dir):
    from weldrow.fields import get_field_type

    text = F.concat(pick(PHONES, "c_custkey % 6"), F.lpad(F.expr("cast(c_custkey % 10000 as string)"), 4, "0"))
    rows = table(spark, sf_dir, "customer").select(F.expr("CASE WHEN c_custkey % 2 = 0 THEN 'even' ELSE 'odd' END").alias("source_dataset"), F.when(F.expr("c_custkey % 17 <> 0"), text).alias("phone"))
    return C.validation_summary(get_field_type("phone").apply(rows, "phone"), ["phone"])


# ---------------------------------------------------------------- evaluation

GRID = (0.5, 0.6, 0.7, 0.8, 0.9, 0.95, 0.99)


@query(f"{EDGES}, {TRUE}, {KEYED}, g AS (SELECT unnest({list(GRID)})::DOUBLE AS threshold), t AS (SELECT threshold, count(*) FILTER (hit AND p >= threshold) AS tp, count(*) FILTER (NOT hit AND p >= threshold) AS fp, (SELECT count(*) FROM true_pairs) - tp AS fn FROM g LEFT JOIN keyed ON TRUE GROUP BY 1)\nSELECT *, {prf_sql('tp', 'fp', 'fn')} FROM t")
def pr_curve(spark, sf_dir):
    p, _, edges, _ = people_edges(spark, sf_dir)
    return E.pr_curve(C.split_conflicts(edges, p, HARD)[0], "match_probability", E.true_pairs(truth(p)), GRID)


@query(f"{EDGES}, {TRUE}, {KEYED}, g AS (SELECT unnest({list(GRID)})::DOUBLE AS threshold), t AS (SELECT threshold, count(*) FILTER (hit AND p >= threshold) AS tp, count(*) FILTER (NOT hit AND p >= threshold) AS fp, (SELECT count(*) FROM true_pairs) - tp AS fn, count(*) FILTER (p >= 0.5 AND p < threshold) AS queue_size, count(*) FILTER (hit AND p >= 0.5 AND p < threshold) AS queue_true_pairs, (SELECT count(*) FROM true_pairs) - count(*) FILTER (hit AND p >= 0.5) AS missed_below_review FROM g, keyed WHERE threshold > 0.5 GROUP BY 1)\nSELECT *, fp AS false_auto_links, {prf_sql('tp', 'fp', 'fn')}, round((fp * 30 + queue_size + missed_below_review * 10)::DOUBLE, 1) AS expected_cost_minutes FROM t")
def cost_sweep(spark, sf_dir):
    p, _, edges, _ = people_edges(spark, sf_dir)
    return E.auto_link_sweep(C.split_conflicts(edges, p, HARD)[0], E.true_pairs(truth(p)), 0.5, GRID)


@query(f"WITH {PEOPLE}, {union_sql(shown=())}, {TRUE}, c AS (SELECT DISTINCT least(unique_id_l, unique_id_r) || '||' || greatest(unique_id_l, unique_id_r) AS key FROM cand), n AS (SELECT (SELECT count(*) FROM true_pairs) AS true_pairs, (SELECT count(*) FROM c) AS candidates, (SELECT count(*) FROM c WHERE key IN (SELECT key FROM true_pairs)) AS found) SELECT *, round(found / true_pairs, 4) AS blocking_recall FROM n")
def blocking_recall(spark, sf_dir):
    p = people(spark, sf_dir)
    return E.blocking_recall(candidate_pairs(p, RULES, columns=()), E.true_pairs(truth(p)))


@query(f"""{CLUSTERED}, x AS (SELECT c.*, source_record_id AS e FROM crosswalk c),
pp AS (SELECT a.unique_id AS a, z.unique_id AS z, a.e = z.e AS hit FROM x a JOIN x z ON a.entity_id = z.entity_id AND a.unique_id < z.unique_id),
es AS (SELECT e, list(unique_id ORDER BY unique_id) AS s, count(DISTINCT entity_id) AS k FROM x GROUP BY 1), cs AS (SELECT entity_id, list(unique_id ORDER BY unique_id) AS s, count(DISTINCT e) AS k FROM x GROUP BY 1),
n AS (SELECT (SELECT count(*) FROM pp WHERE hit) AS tp, (SELECT count(*) FROM pp WHERE NOT hit) AS fp, (SELECT count(*) FROM b) - (SELECT count(*) FROM pp WHERE hit) AS fn, (SELECT count(*) FROM es) AS n_true_entities)
SELECT *, {prf_sql('tp', 'fp', 'fn')}, round((SELECT count(*) FROM es WHERE s IN (SELECT s FROM cs)) / n_true_entities, 4) AS entity_exact_match_rate, (SELECT count(*) FROM es WHERE k > 1) AS entities_split, (SELECT count(*) FROM cs WHERE k > 1) AS clusters_merging_entities FROM n""")
def cluster_prf(spark, sf_dir):
    p, _, _, cw = crosswalk_of(spark, sf_dir)
    return E.cluster_vs_truth(cw, truth(p))


@query(f"{CLUSTERED}, miss AS (SELECT a.source_record_id AS k FROM crosswalk a JOIN crosswalk z ON a.source_record_id = z.source_record_id AND a.source < z.source AND a.entity_id <> z.entity_id), ops AS (SELECT DISTINCT miss.k, unnest(string_split(noise_ops, '|')) AS op FROM miss JOIN people p ON p.source_record_id = miss.k)\nSELECT op AS noise_op, count(*) AS missed_pairs, (SELECT count(*) FROM miss) AS n_missed FROM ops WHERE op <> '' GROUP BY 1")
def misses_by_noise(spark, sf_dir):
    p, _, _, cw = crosswalk_of(spark, sf_dir)
    return E.misses_by_noise(E.missed_pairs(cw, truth(p)), truth(p))


@query(f"{EDGES}, {TRUE}, q AS (SELECT unique_id_l || '||' || unique_id_r AS key, 'score_band' AS review_reason FROM fine WHERE match_probability < 0.9 UNION ALL SELECT unique_id_l || '||' || unique_id_r, 'same_npi_name_conflict' FROM rejected WHERE npi_std_l = npi_std_r)\nSELECT review_reason, count(*) AS pairs, count(*) FILTER (key IN (SELECT key FROM true_pairs)) AS true_matches, round(true_matches / pairs, 4) AS true_share FROM q GROUP BY 1")
def review_truth(spark, sf_dir):
    return E.review_queue_truth(review_queue(spark, sf_dir), E.true_pairs(truth(people(spark, sf_dir))))


# ---------------------------------------------------------------- references and knowledge


def registry(spark, sf_dir):
    cols = [F.col("npi"), F.expr("cast(k % 4 = 0 as int) + 1").alias("entity_type"), F.col("f").alias("first"), F.lit(None).cast("string").alias("middle"), F.col("l").alias("last"), F.lit(None).cast("string").alias("suffix"), F.col("org").alias("org_name"), F.lit("1 MAIN ST").alias("street"), F.lit("CHICAGO").alias("city"), F.lit("IL").alias("state"), F.col("zip"), F.col("phone"), F.lit("207Q00000X").alias("taxonomy"), F.expr("CASE WHEN k % 9 = 0 THEN '2020-01-01' END").alias("deactivation_date")]
    return base_people(spark, sf_dir).where("k % 3 <> 0").select(*cols)


@query(f"WITH {PEOPLE} SELECT p.unique_id, CASE WHEN r.k % 4 = 0 THEN NULL ELSE p.npi_std END AS npi_std, (p.npi_std IS NOT NULL) AND NOT coalesce(r.k % 4 = 0, FALSE) AS npi_valid, r.k IS NOT NULL AS nppes_found, coalesce(r.k % 9 = 0, FALSE) AS nppes_deactivated, r.l AS nppes_last FROM people p LEFT JOIN b r ON r.npi = p.npi_std AND r.k % 3 <> 0")
def enrich_left_join(spark, sf_dir):
    p = people(spark, sf_dir).withColumns({"npi_valid": F.col("npi_std").isNotNull(), "npi_invalid_reason": F.lit(None).cast("string")})
    return enrich(p, registry(spark, sf_dir)).select("unique_id", "npi_std", "npi_valid", "nppes_found", "nppes_deactivated", "nppes_last")


@query(f"WITH {PEOPLE} SELECT 'nppes:' || npi AS unique_id, npi AS source_record_id, f AS name_first, l AS name_last, org, zip AS address_zip FROM b WHERE k % 3 <> 0 AND k % 4 <> 0")
def hub_source(spark, sf_dir):
    return hub_frame(registry(spark, sf_dir), PROVIDER.canonical_columns()).select("unique_id", "source_record_id", "name_first", "name_last", "org", "address_zip")


@query("WITH n AS (SELECT n_nationkey AS k, (k * 7 % 90)::DOUBLE AS lat, (k * 13 % 180)::DOUBLE AS lon FROM nation) SELECT a.k AS a, z.k AS z, round(2 * 6371.0 * asin(sqrt(least(1.0, pow(sin((radians(z.lat) - radians(a.lat)) / 2), 2) + cos(radians(a.lat)) * cos(radians(z.lat)) * pow(sin(radians(z.lon - a.lon) / 2), 2)))), 6) AS km FROM n a JOIN n z ON a.k < z.k")
def geo_distance(spark, sf_dir):
    n = table(spark, sf_dir, "nation").selectExpr("n_nationkey as k", "cast(n_nationkey * 7 % 90 as double) as lat", "cast(n_nationkey * 13 % 180 as double) as lon")
    a, z = n.selectExpr("k as a", "lat as la", "lon as oa"), n.selectExpr("k as z", "lat as lz", "lon as oz")
    return a.join(z, F.expr("a < z")).select("a", "z", F.round(T.haversine_km(F.col("la"), F.col("oa"), F.col("lz"), F.col("oz")), 6).alias("km"))


_KB = "kb AS (SELECT s_suppkey AS id, 'e' || (s_suppkey % 3) AS engagement, ['engagement_local', 'reviewed', 'promoted'][s_suppkey % 3 + 1] AS state, ['generic', 'client_scoped'][(s_suppkey // 3) % 2 + 1] AS reuse_scope, 'v' || (s_suppkey % 7) AS value, round((s_suppkey % 10) / 10.0, 3) AS confidence, 'c' || (s_suppkey % 2) AS comparison, 'l' || (s_suppkey % 4) AS level, s_suppkey % 100 / 100.0 AS m FROM supplier)"


def kb_rows(spark, sf_dir):
    return table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("id"), F.expr("concat('e', s_suppkey % 3)").alias("engagement"), pick(("engagement_local", "reviewed", "promoted"), "s_suppkey % 3").alias("state"), pick(("generic", "client_scoped"), "(s_suppkey div 3) % 2").alias("reuse_scope"), F.expr("concat('v', s_suppkey % 7)").alias("value"), F.expr("round((s_suppkey % 10) / 10D, 3)").alias("confidence"), F.expr("concat('c', s_suppkey % 2)").alias("comparison"), F.expr("concat('l', s_suppkey % 4)").alias("level"), F.expr("s_suppkey % 100 / 100D").alias("m"))


@query(f"WITH {_KB} SELECT id FROM kb WHERE engagement = 'e0' OR (state = 'promoted' AND reuse_scope = 'generic')")
def kb_usable(spark, sf_dir):
    from weldrow.sources.knowledge import usable_rows

    return usable_rows(kb_rows(spark, sf_dir), "e0").select("id")


@query(f"WITH {_KB} SELECT comparison, level, round(avg(m), 9) AS m FROM kb WHERE engagement = 'e0' OR (state = 'promoted' AND reuse_scope = 'generic') GROUP BY ALL")
def kb_m_average(spark, sf_dir):
    from weldrow.sources.knowledge import mean_m, usable_rows

    return mean_m(usable_rows(kb_rows(spark, sf_dir), "e0")).select("comparison", "level", F.round("m", 9).alias("m"))


@query(f"WITH {_KB} SELECT value, arg_max(id, (engagement = 'e0', confidence, id)) AS id FROM kb WHERE engagement = 'e0' OR (state = 'promoted' AND reuse_scope = 'generic') GROUP BY 1")
def lookup_resolve(spark, sf_dir):
    from weldrow.sources.knowledge import resolve_lookup, usable_rows

    return resolve_lookup(usable_rows(kb_rows(spark, sf_dir), "e0"), "value", "e0", "id").select("value", "id")


@query("SELECT 'c_name' AS column_name, count(DISTINCT c_name) AS n_distinct, round(avg((c_name IS NULL)::INT), 6) AS share_missing FROM customer UNION ALL SELECT 'c_mktsegment', count(DISTINCT c_mktsegment), round(avg((c_mktsegment IS NULL)::INT), 6) FROM customer")
def column_profile(spark, sf_dir):
    from weldrow.ingest import profile_columns

    return profile_columns(table(spark, sf_dir, "customer").select("c_name", "c_mktsegment")).withColumn("share_missing", F.round("share_missing", 6))


# ---------------------------------------------------------------- names, identifiers, levels, rules

_NICK = "MAP {" + ", ".join(f"'{k}': {sql_list(v)}" for k, v in NICKNAMES.items()) + "}"


@query(f"WITH n AS (SELECT c_custkey, {sql_list(NICK)}[c_custkey % 12 + 1] AS t FROM customer) SELECT c_custkey, array_to_string(list_sort(list_distinct(list_concat([t], coalesce({_NICK}[t], [])))), '|') AS variants FROM n")
def name_variants(spark, sf_dir):
    first = F.concat(pick(NICK, "c_custkey % 12"), F.lit(" X"))
    return table(spark, sf_dir, "customer").select("c_custkey", F.array_join(T.name_variants(first), "|").alias("variants"))


SUFFIXES = ("Jr., MD", "III", "Ph.D.", "sr  m.d. FACP", "", "iv-rn")
_TOKENS = f"list_filter(string_split({CLEAN_SQL.format('s')}, ' '), lambda t: t <> '')"


@query(f"WITH r AS (SELECT p_partkey, {sql_list(SUFFIXES)}[p_partkey % 6 + 1] AS s FROM part), t AS (SELECT p_partkey, {_TOKENS} AS w FROM r) SELECT p_partkey, nullif(array_to_string(list_filter(w, lambda t: list_contains({sql_list(sorted(GENERATIONAL_SUFFIXES))}, t)), ' '), '') AS generation, nullif(array_to_string(list_filter(w, lambda t: NOT list_contains({sql_list(sorted(GENERATIONAL_SUFFIXES))}, t)), ' '), '') AS other FROM t")
def suffixes_split(spark, sf_dir):
    generation, other = T.split_suffixes(pick(SUFFIXES, "p_partkey % 6"))
    return table(spark, sf_dir, "part").select("p_partkey", generation.alias("generation"), other.alias("other"))


@query(f"WITH n AS (SELECT c_custkey, '1' || lpad(c_custkey::VARCHAR, 8, '0') AS nine FROM customer), v AS (SELECT c_custkey, nine || (c_custkey % 10)::VARCHAR AS npi, nine || (({LUHN})::INT)::VARCHAR AS good FROM n) SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN 'not_in_source' WHEN npi <> good THEN 'luhn_failed' ELSE 'ok' END AS verdict FROM v")
def identifier_verdicts(spark, sf_dir):
    npi = F.concat(F.lit("1"), F.lpad(F.col("c_custkey").cast("string"), 8, "0"), F.expr("cast(c_custkey % 10 as string)"))
    source = F.when(F.expr("c_custkey % 3 <> 0"), F.concat(F.lit("see NPI "), npi, F.lit("."))).otherwise("nothing here")
    return table(spark, sf_dir, "customer").select("c_custkey", T.verify_identifier(npi, "npi", source).alias("verdict"))


@query("WITH v AS (SELECT s_suppkey, ['a' || (s_suppkey % 4), 'b' || (s_suppkey % 5)] AS w FROM supplier) SELECT s_suppkey, array_to_string(list_filter(w, lambda x: x IN ('a0', 'a1', 'b2')), '|') AS allowed, array_to_string(list_filter(w, lambda x: x NOT IN ('a0', 'a1', 'b2')), '|') AS refused FROM v")
def allowed_values(spark, sf_dir):
    w = F.array(F.expr("concat('a', s_suppkey % 4)"), F.expr("concat('b', s_suppkey % 5)"))
    allowed, refused = T.filter_allowed(w, F.array(*map(F.lit, ("a0", "a1", "b2"))))
    return table(spark, sf_dir, "supplier").select("s_suppkey", F.array_join(allowed, "|").alias("allowed"), F.array_join(refused, "|").alias("refused"))


@query(f"WITH r AS (SELECT p_partkey, {sql_list(ORG_RAW)}[p_partkey % 8 + 1] AS org FROM part), c AS (SELECT p_partkey, {CLEAN_SQL.format('org')} AS raw FROM r) SELECT p_partkey, raw AS title_key, trim(regexp_replace(' ' || raw, '{_SUFFIX_SQL}', '')) AS org_key FROM c")
def lookup_keys(spark, sf_dir):
    raw = pick(ORG_RAW, "p_partkey % 8")
    return table(spark, sf_dir, "part").select("p_partkey", T.value_key(raw, "title").alias("title_key"), T.value_key(raw, "org").alias("org_key"))


@query("WITH p AS (SELECT c_custkey, ['w' || (c_custkey % 5), 'w' || (c_custkey % 7)] AS l, ['w' || (c_custkey % 3), 'w' || (c_custkey % 4)] AS r, c_custkey % 4 = c_custkey % 6 AS zip FROM customer) SELECT c_custkey, CASE WHEN c_custkey % 11 = 0 THEN -1 WHEN zip AND list_has_any(l, r) THEN 3 WHEN len(list_intersect(l, r)) >= 2 THEN 2 WHEN list_has_any(l, r) THEN 1 ELSE 0 END AS gamma_words FROM p")
def overlap_levels(spark, sf_dir):
    pairs = table(spark, sf_dir, "customer").selectExpr("c_custkey", "array(concat('w', c_custkey % 5), concat('w', c_custkey % 7)) as words_l", "CASE WHEN c_custkey % 11 <> 0 THEN array(concat('w', c_custkey % 3), concat('w', c_custkey % 4)) END as words_r", "c_custkey % 4 as zip_l", "c_custkey % 6 as zip_r")
    levels = (both("same ZIP and a word", exact("zip"), overlapping("words", "a word")), overlapping("words", "two words", 2), overlapping("words", "a word"))
    return gammas(pairs, [Comparison("words", ("words", "zip"), missing("words"), levels)]).select("c_custkey", "gamma_words")


PROVIDER_RULES = [r for r in PROVIDER.blocking_rules if "dm" not in rule_sql(r)]


@query(f"WITH {PEOPLE}, {union_sql(shown=(), rules=PROVIDER_RULES)} SELECT * FROM cand")
def block_provider(spark, sf_dir):
    """The provider profile's rules, without the one on sounds, whose columns these people lack."""
    return candidate_pairs(people(spark, sf_dir), PROVIDER.blocking_rules, columns=(), piece=PIECE)


@query(f"WITH {PEOPLE}, {union_sql(shown=())} SELECT * FROM cand WHERE unique_id_l LIKE 'claims:%' AND unique_id_r LIKE 'claims:%'")
def pairs_of_one_source(spark, sf_dir):
    return E.restrict(candidate_pairs(people(spark, sf_dir), RULES, columns=()), ["claims"])


# ---------------------------------------------------------------- documents

DOCUMENT_SQL = f"""
WITH c AS (SELECT doc_id, {CLEAN_SQL.format('text')} AS t FROM documents),
k AS (SELECT doc_id, CASE WHEN t <> '' THEN array_to_string(list_sort(string_split(t, ' ')), ' ') END AS key FROM c),
m AS (SELECT doc_id, CASE WHEN key IS NULL THEN doc_id ELSE min(doc_id) OVER (PARTITION BY key) END AS cluster_id FROM k)
SELECT doc_id, cluster_id, 'ENT' || lpad((dense_rank() OVER (ORDER BY cluster_id))::VARCHAR, 6, '0') AS entity_id FROM m"""


def document_members(docs: DataFrame) -> DataFrame:
    """``doc_id, cluster_id``: documents whose whole cleaned texts have the same words, repeats included, in any order.

    The key is a digest of all sorted words, so no part of a text is left out and a block is one cluster: records link
    to the least identifier of their block and never to each other. Documents without words (null and empty texts, or
    punctuation only) stand alone.
    """
    words = F.array_sort(F.split(T.basic_clean(F.col("text")), " "))
    key = F.unhex(F.sha2(F.array_join(words, " "), 256))
    keyed = written(docs.select("doc_id", F.when(F.array_join(words, "") != "", key).alias("key")))
    blocks = keyed.where("key is not null").groupBy("key").agg(F.min("doc_id").alias("least"))
    return cut(keyed.join(blocks, "key", "left").select("doc_id", F.coalesce("least", "doc_id").alias("cluster_id")))


@query(DOCUMENT_SQL)
def crosswalk_documents(spark, sf_dir):
    """Documents of the same words: clean, block, link, number."""
    member = document_members(table(spark, sf_dir, "documents"))
    ranked = C._rank(member.select("cluster_id").distinct(), "cluster_id", "_k")
    return member.join(ranked, "cluster_id").select("doc_id", "cluster_id", F.concat(F.lit("ENT"), F.when(F.col("_k") < 1_000_000, F.lpad(F.col("_k").cast("string"), 6, "0")).otherwise(F.col("_k").cast("string"))).alias("entity_id"))


@query()
def phonetic_and_parsed(spark, sf_dir):
    """Names of the people parsed and coded, and addresses parsed: rule-based, without SQL."""
    b = base_people(spark, sf_dir).select("k", F.concat_ws(" ", F.lit("Dr."), F.initcap("f"), F.initcap("l"), F.lit("Jr., MD")).alias("name"), F.concat(F.col("k").cast("string"), F.lit(" N Main St Ste 5, Springfield, IL "), F.col("zip")).alias("address"))
    got = b.withColumns({"p": udf.person_udf("name"), "a": udf.address_udf("address")})
    return got.select("k", "p.first", "p.last", "p.suffix", "p.credential", T.phonetic(F.col("p.last")).alias("last_dm"), "a.street", "a.unit", "a.city", "a.state", "a.zip", F.round(T.token_sort_ratio(F.lower("name"), F.lower("address")), 4).alias("ratio"))


