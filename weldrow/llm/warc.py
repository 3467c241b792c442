"""WARC not-modified revisits: an as-of join to the latest earlier full response of the same canonical URL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from weldrow.session import cut

#: Query parameters that do not change a page (fixed values).
TRACKING = r"^(utm_[^=]*|ref|fbclid|gclid)(=|$)"
#: Header fields of a 304 that never replace stored ones: hop-by-hop fields, and those that describe the stored body (fixed values).
NOT_MERGED = (
    "connection", "proxy-connection", "keep-alive", "te", "trailer", "transfer-encoding", "upgrade",
    "proxy-authenticate", "proxy-authentication-info", "proxy-authorization",
    "content-length", "content-encoding", "content-type", "content-range",
)
#: Time slices that a URL's captures are searched in.
SLICES = 64


def canonical_url(url: Column) -> Column:
    """Host, path and sorted query: no scheme, fragment, ``www.``, default port, tracking parameters or slash at the end."""
    rest = F.regexp_replace(F.regexp_replace(F.coalesce(url, F.lit("")), "(?s)#.*$", ""), r"^[A-Za-z][A-Za-z0-9+.\-]*://", "")
    host = F.regexp_replace(F.regexp_replace(F.lower(F.regexp_extract(rest, "^[^/?]*", 0)), r"^www[0-9]*\.", ""), ":(80|443)$", "")
    path = F.regexp_replace(F.regexp_extract(rest, r"^[^/?]*([^?]*)", 1), "/+$", "")
    kept = F.array_sort(F.filter(F.split(F.regexp_extract(rest, r"(?s)\?(.*)$", 1), "&"), lambda p: (p != "") & ~p.rlike(TRACKING)))
    return F.concat(host, path, F.when(F.size(kept) > 0, F.concat(F.lit("?"), F.array_join(kept, "&"))).otherwise(""))


def folded(headers: Column) -> Column:
    """Header entries with lower-cased names, null as none; of names that then repeat, the last stays."""
    entries = F.transform(F.map_entries(F.coalesce(headers, F.create_map().cast("map<string,string>"))), lambda e: F.struct(F.lower(e["key"]).alias("key"), e["value"].alias("value")))
    names = F.transform(entries, lambda e: e["key"])
    later = lambda e, i: F.array_contains(F.slice(names, i + 2, F.size(names)), e["key"])
    return F.map_from_entries(F.filter(entries, lambda e, i: ~later(e, i)))


def merged(stored: Column, fresh: Column) -> Column:
    """Stored headers updated with the permitted ones of the 304: not those in NOT_MERGED, nor what its Connection field names."""
    named = F.transform(F.split(F.lower(F.coalesce(fresh["connection"], F.lit(""))), ","), lambda x: F.trim(x))
    allowed = F.map_filter(fresh, lambda k, v: ~k.isin(*NOT_MERGED) & ~F.array_contains(named, k))
    return F.map_concat(F.map_filter(stored, lambda k, v: ~F.map_contains_key(allowed, k)), allowed)


def resolve_revisits(records: DataFrame, slices: int = SLICES) -> DataFrame:
    """One row per revisit: ``record_id, url_key, refers_to, refers_to_date, status, headers``.

    ``records``: record_id, record_type (``response`` or ``revisit``; others are ignored), target_uri, warc_date
    (timestamp), headers (map). A revisit refers to the response of its canonical URL with the latest date before its
    own; of several at that date, the largest record_id. status: ``no_earlier`` (also where url or date is null),
    ``mismatch`` (an ETag, or without one a Last-Modified, that both have and that differs; weak ETags compare like
    strong ones), ``unverified`` (no validator in common) or ``resolved``. headers are the merged ones when resolved,
    else null. Repeated rows are resolved each; empty tables give an empty result; other columns are not read.

    Rows of a URL are first reduced to its points in time, and points are searched slice by slice of time with what
    earlier slices carry over. So neither a URL with very many captures nor one with many at the same time is one
    task's work.
    """
    rows = records.where("record_type in ('response', 'revisit')").select("record_id", "record_type", canonical_url(F.col("target_uri")).alias("url_key"), F.unix_micros("warc_date").alias("ts"), folded(F.col("headers")).alias("headers"))
    rows = rows.withColumn("url_key", F.when(F.col("url_key") != "", F.col("url_key")))
    known = "url_key is not null and ts is not null"
    bounds = rows.where(known).agg(F.percentile_approx("ts", [i / slices for i in range(1, slices)], 1000)).first()[0] or []
    part = F.size(F.filter(F.array(*[F.lit(int(b)) for b in sorted(set(bounds))]), lambda b: b < F.col("ts"))) if bounds else F.lit(0)
    found = F.when(F.col("record_type") == "response", F.struct("ts", F.col("record_id").alias("id")))
    points = cut(rows.where(known).groupBy("url_key", "ts").agg(F.max(found).alias("response")).withColumn("part", part))
    here = Window.partitionBy("url_key", "part").orderBy("ts").rowsBetween(Window.unboundedPreceding, -1)
    before = Window.partitionBy("url_key").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    carried = points.groupBy("url_key", "part").agg(F.max("response").alias("last")).select("url_key", "part", F.max("last").over(before).alias("carried"))
    latest = points.withColumn("near", F.max("response").over(here)).join(carried, ["url_key", "part"])
    latest = latest.select("url_key", "ts", F.coalesce("near", "carried").alias("base")).where("base is not null")
    revisits = rows.where("record_type = 'revisit'").join(latest, ["url_key", "ts"], "left")
    stored = rows.where("record_type = 'response'").select(F.col("record_id").alias("_id"), F.col("headers").alias("stored")).dropDuplicates(["_id"])
    out = revisits.join(stored, F.col("base.id") == F.col("_id"), "left")

    def validator(h: str, name: str) -> Column:
        return F.regexp_replace(F.col(h)[name], "^W/", "")

    tag, modified = (validator("stored", n) == validator("headers", n) for n in ("etag", "last-modified"))
    same = F.coalesce(tag, modified)
    status = F.when(F.col("base").isNull(), "no_earlier").when(same.isNull(), "unverified").when(same, "resolved").otherwise("mismatch")
    return out.select(
        "record_id",
        "url_key",
        F.col("base.id").alias("refers_to"),
        F.timestamp_micros(F.col("base.ts")).alias("refers_to_date"),
        status.alias("status"),
        F.when(status == "resolved", merged(F.col("stored"), F.col("headers"))).alias("headers"),
    )


def captures(pages: DataFrame) -> DataFrame:
    """Every page as two WARC records: a full response, and a 304 a week later.

    page_id counts minutes. The first letter of the url's MD5 says what the 304 tells: the response's ETag and changed
    fields, another ETag, only Last-Modified, or nothing to compare.
    """
    kind = F.substring(F.md5(F.coalesce("url", F.lit(""))), 1, 1)
    tag = F.concat(F.lit('"'), F.substring(F.md5(F.coalesce("html", F.lit(""))), 1, 16), F.lit('"'))
    at = F.lit(1_704_067_200) + F.col("page_id") * 60
    text = lambda s: F.date_format(F.timestamp_seconds(s), "yyyy-MM-dd HH:mm:ss")
    size = F.octet_length(F.coalesce("html", F.lit(""))).cast("string")
    first = F.create_map(*[F.lit("ETag"), tag, F.lit("Last-Modified"), text(at), F.lit("Content-Length"), size, F.lit("Cache-Control"), F.lit("max-age=60")])
    changed = F.create_map(*[F.lit("etag"), F.concat(F.lit("W/"), tag), F.lit("Cache-Control"), F.lit("no-cache"), F.lit("Content-Length"), F.lit("0"), F.lit("Connection"), F.lit("close, X-Hop"), F.lit("X-Hop"), F.lit("1"), F.lit("Expires"), text(at + 700_000)])
    again = (
        F.when(kind < "8", changed)
        .when(kind < "b", F.create_map(F.lit("ETag"), F.lit('"other"')))
        .when(kind < "e", F.create_map(F.lit("Last-Modified"), text(at)))
        .otherwise(F.create_map(F.lit("Server"), F.lit("edge")))
    )
    records = F.array(
        F.struct((F.col("page_id") * 2).alias("record_id"), F.lit("response").alias("record_type"), F.timestamp_seconds(at).alias("warc_date"), first.alias("headers")),
        F.struct((F.col("page_id") * 2 + 1).alias("record_id"), F.lit("revisit").alias("record_type"), F.timestamp_seconds(at + 604_800).alias("warc_date"), again.alias("headers")),
    )
    return pages.select(F.col("url").alias("target_uri"), F.inline(records))


def op1_revisit_asof(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = resolve_revisits(captures(spark.read.parquet(f"{sf_dir}/pages.parquet")))
    lines = F.array_sort(F.transform(F.map_entries("headers"), lambda e: F.concat(e["key"], F.lit(": "), e["value"])))
    return out.select("record_id", "url_key", "refers_to", F.unix_seconds("refers_to_date").alias("refers_to_s"), "status", F.array_join(lines, "\n").alias("headers"))


ORACLE = r"""
WITH p0 AS (SELECT page_id, url, html, regexp_replace(regexp_replace(coalesce(url, ''), '(?s)#.*$', ''), '^[A-Za-z][A-Za-z0-9+.\-]*://', '') AS rest FROM pages),
p1 AS (SELECT *, list_sort(list_filter(string_split(regexp_extract(rest, '(?s)\?(.*)$', 1), '&'), lambda x: x <> '' AND NOT regexp_matches(x, '^(utm_[^=]*|ref|fbclid|gclid)(=|$)'))) AS kept FROM p0),
p AS (SELECT page_id, 1704067200 + page_id * 60 AS at_s, substr(md5(coalesce(url, '')), 1, 1) AS kind, '"' || substr(md5(coalesce(html, '')), 1, 16) || '"' AS tag, strlen(coalesce(html, '')) AS size,
  nullif(regexp_replace(regexp_replace(lower(regexp_extract(rest, '^[^/?]*')), '^www[0-9]*\.', ''), ':(80|443)$', '') || regexp_replace(regexp_extract(rest, '^[^/?]*([^?]*)', 1), '/+$', '')
    || CASE WHEN len(kept) > 0 THEN '?' || array_to_string(kept, '&') ELSE '' END, '') AS key FROM p1),
r AS (SELECT key, at_s AS ts, max(page_id) AS base FROM p GROUP BY ALL),
v AS (SELECT p.page_id, p.key, p.kind, p.tag, p.at_s, r.base FROM p ASOF LEFT JOIN r ON p.key = r.key AND p.at_s + 604800 > r.ts),
j AS (SELECT v.*, b.at_s AS base_at, b.tag AS base_tag, b.size AS base_size,
  CASE WHEN base IS NULL THEN 'no_earlier' WHEN v.kind >= 'e' THEN 'unverified'
    WHEN v.kind < '8' THEN CASE WHEN v.tag = b.tag THEN 'resolved' ELSE 'mismatch' END WHEN v.kind < 'b' THEN 'mismatch'
    ELSE CASE WHEN v.at_s = b.at_s THEN 'resolved' ELSE 'mismatch' END END AS status
  FROM v LEFT JOIN p b ON v.base = b.page_id)
SELECT page_id * 2 + 1 AS record_id, key AS url_key, base * 2 AS refers_to, base_at AS refers_to_s, status,
  CASE WHEN status = 'resolved' THEN 'cache-control: ' || CASE WHEN kind < '8' THEN 'no-cache' ELSE 'max-age=60' END || chr(10) || 'content-length: ' || base_size || chr(10)
    || 'etag: ' || CASE WHEN kind < '8' THEN 'W/' || tag ELSE base_tag END
    || CASE WHEN kind < '8' THEN chr(10) || 'expires: ' || strftime(make_timestamp((at_s + 700000) * 1000000), '%Y-%m-%d %H:%M:%S') ELSE '' END
    || chr(10) || 'last-modified: ' || strftime(make_timestamp(base_at * 1000000), '%Y-%m-%d %H:%M:%S') END AS headers
FROM j
"""
