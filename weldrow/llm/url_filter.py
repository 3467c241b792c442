"""URL verdicts: host and path rules, and trust and distrust propagated over host edges, in built-in functions only."""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from weldrow.session import cut

#: (action, rule): host up to the first slash, path from there.
RULES = (("block", "com/en/"), ("allow", "example.com/en/7"), ("allow", "net/de/"), ("block", "example.net/de/8"), ("block", "org/es/"))
#: Whole numbers stand for shares of one, so that every engine and every order of summing gives the same ranks.
ONE = 1 << 50
#: Share of its rank, in percent, that a host passes on; rounds of the power iteration in the SQL, and in one job here.
DAMPING, ROUNDS = 85, 8
#: Ranks have settled when those of a kind change by less than this in all over ROUNDS rounds (a millionth of its seeds).
SETTLED = ONE >> 20
#: A round's sums are written by one task for each so many edges, and by LEAST_TASKS at least.
EDGES_A_TASK, LEAST_TASKS = 1 << 18, 8
#: A host is blocked when its distrust is at least this many percent of its trust, and not zero.
THRESHOLD = 100
HREF = r"""(?i)<a\s[^>]*?href\s*=\s*["']?([^"'\s>]+)"""


def host_of(url: Column) -> Column:
    """What stands between the first ``://`` and ``/``, ``?``, ``#`` or the end, A-Z lower-cased; else empty."""
    rest = F.when(F.instr(url, "://") > 0, F.substring(url, F.instr(url, "://") + 3, F.length(url))).otherwise("")
    host = F.regexp_extract(F.coalesce(rest, F.lit("")), r"^[^/?#]*", 0)
    return F.translate(host, string.ascii_uppercase, string.ascii_lowercase)


def path_of(url: Column) -> Column:
    """What follows the host up to ``?``, ``#`` or the end."""
    rest = F.when(F.instr(url, "://") > 0, F.substring(url, F.instr(url, "://") + 3, F.length(url))).otherwise("")
    return F.regexp_extract(F.coalesce(rest, F.lit("")), r"^[^/?#]*([^?#]*)", 1)


def split_rule(rule: str) -> tuple[str, str]:
    host, slash, path = rule.partition("/")
    return host, slash + path


def _by_length(rules) -> list[tuple[str, str]]:
    """Longest first; of equal ones the longer host, then block."""
    return sorted(rules, key=lambda r: (-len(r[1]), -len(split_rule(r[1])[0]), r[0] != "block", r[1]))


def ruling(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """(rule, action) of the longest rule that fits, else nulls."""
    rule = action = None
    for act, text in _by_length(rules):
        h, p = split_rule(text)
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        rule = F.when(fits, text) if rule is None else rule.when(fits, text)
        action = F.when(fits, act) if action is None else action.when(fits, act)
    none = F.lit(None).cast("string")
    return (none, none) if rule is None else (rule, action)


def host_edges(pages: DataFrame, html_col: str = "html") -> DataFrame:
    """Distinct ``src, dst`` of pages with a ``host``: hyperlinks to other hosts, and each host with its parent domain.

    A subdomain vouches for its parent and the parent for it, down to two labels; in a crawl of single sites these are
    often the only edges.
    """
    href = F.explode(F.regexp_extract_all(F.coalesce(F.col(html_col), F.lit("")), F.lit(HREF), F.lit(1)))
    there = pages.where("host <> ''").select(F.col("host").alias("src"), href.alias("href")).where("href like '%//%'")
    there = there.withColumn("href", F.when(F.col("href").startswith("//"), F.concat(F.lit("http:"), "href")).otherwise(F.col("href")))
    links = there.where(F.col("href").rlike("(?i)^https?://")).select("src", host_of(F.col("href")).alias("dst")).where("dst <> ''").distinct()
    known = pages.select("host").unionAll(links.select("dst")).distinct()
    labels = F.split("host", r"\.")
    chain = F.transform(F.sequence(F.lit(1), F.size(labels) - 1), lambda k: F.array_join(F.slice(labels, k, F.size(labels)), "."))
    steps = known.where(F.size(labels) >= 3).select(chain.alias("c")).select(F.explode(F.arrays_zip(F.slice("c", 1, F.size("c") - 1).alias("src"), F.slice("c", 2, F.size("c")).alias("dst"))).alias("e")).select("e.src", "e.dst")
    return links.unionAll(steps).unionAll(steps.select(F.col("dst").alias("src"), F.col("src").alias("dst"))).where("src <> dst").distinct()


def propagate(edges: DataFrame, seeds: DataFrame, rounds: int | None = None, damping: int = DAMPING) -> DataFrame:
    """``kind, host, rank``: personalised PageRank from trusted seeds along the edges, distrust from blocked seeds against them.

    ``seeds``: kind (``trust`` or ``distrust``), host, weight. Ranks are whole numbers out of ``ONE``. The rank of hosts
    without out-edges is not passed on. Each round is one equi-join with the edges and one sum per host; ranks enter
    a round's plan once and are cut after each ROUNDS. Tasks that write shuffle files are as many as the edges need, so
    that the many rounds over a small graph don't leave a file for every partition. Rounds go on until ranks have settled and reach no further host;
    what is passed on falls below one unit in the end, so they do stop. A number of ``rounds`` is kept to where given.
    """
    ways = edges.select(F.lit("trust").alias("kind"), "src", "dst").unionAll(edges.select(F.lit("distrust").alias("kind"), F.col("dst").alias("src"), F.col("src").alias("dst")))
    degree = ways.groupBy("kind", "src").agg(F.count(F.lit(1)).alias("degree"))
    ways = cut(ways.join(degree, ["kind", "src"]).withColumnRenamed("src", "host"))
    tasks = max(LEAST_TASKS, -(-ways.count() // EDGES_A_TASK))
    total = seeds.groupBy("kind").agg(F.sum("weight").alias("total"))
    start = cut(seeds.join(total, "kind").selectExpr("kind", "host", f"cast(floor(weight / total * {1 << 30}) as bigint) * {ONE >> 30} as mass"))
    kept = start.selectExpr("kind", "host", f"(mass div 100) * {100 - damping} as mass")

    def after(rank: DataFrame, rounds: int) -> DataFrame:
        for _ in range(rounds):
            passed = rank.join(ways, ["kind", "host"]).selectExpr("kind", "dst as host", f"((mass div 100) * {damping}) div degree as mass")
            rank = passed.unionAll(kept).coalesce(tasks).groupBy("kind", "host").agg(F.sum("mass").alias("mass"))
        return rank

    if rounds is not None:
        return after(start, rounds).withColumnRenamed("mass", "rank")
    rank, moving = start, True
    while moving:
        new = cut(after(rank, ROUNDS).coalesce(tasks))
        both = new.selectExpr("kind", "host", "mass", "0L as was").unionAll(rank.selectExpr("kind", "host", "0L as mass", "mass as was"))
        both = both.groupBy("kind", "host").agg(F.sum("mass").alias("mass"), F.sum("was").alias("was"))
        by_kind = both.groupBy("kind").agg(F.sum(F.abs(F.col("mass") - F.col("was"))).alias("change"), F.max((F.col("mass") > 0) & (F.col("was") == 0)).alias("further"))
        moving = not by_kind.where((F.col("change") >= SETTLED) | F.col("further")).isEmpty()
        rank = new
    return rank.withColumnRenamed("mass", "rank")


def judge(pages: DataFrame, rules=RULES, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """One row per input row: ``page_id, host, path, rule, verdict, trust, distrust``.

    The longest rule that fits decides. Where none fits, the host's ranks do: a page is blocked when distrust is not
    zero and at least THRESHOLD percent of trust, else allowed. Seeds are the hosts of pages that a rule allows
    (trusted) or blocks, weighted by those pages. Urls that are null or lack ``://`` have an empty host and path, fit
    no rule and are allowed. Null html has no links. Repeated rows are judged each; other columns are not read.
    """
    host, path = host_of(F.col(url_col)), path_of(F.col(url_col))
    slim = pages.select(F.col(id_col).alias("page_id"), host.alias("host"), path.alias("path"), F.col(html_col).alias("html"))
    rule, action = ruling(F.col("host"), F.col("path"), rules)
    ruled = slim.withColumns({"rule": rule, "action": action})
    seeds = ruled.where("action is not null and host <> ''").groupBy(F.when(F.col("action") == "allow", "trust").otherwise("distrust").alias("kind"), "host").agg(F.count(F.lit(1)).alias("weight"))
    ranks = propagate(host_edges(slim), seeds)
    by_host = ranks.groupBy("host").agg(
        F.max(F.when(F.col("kind") == "trust", F.col("rank"))).alias("trust"),
        F.max(F.when(F.col("kind") == "distrust", F.col("rank"))).alias("distrust"),
    )
    out = ruled.drop("html").join(by_host, "host", "left").fillna(0, ["trust", "distrust"])
    bad = (F.col("distrust") > 0) & (F.col("distrust") * 100 >= F.col("trust") * THRESHOLD)
    return out.select("page_id", "host", "path", "rule", F.coalesce("action", F.when(bad, "block").otherwise("allow")).alias("verdict"), "trust", "distrust")


def op7_link_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(spark.read.parquet(f"{sf_dir}/pages.parquet"))


def oracle(rules=RULES, most: int = 400, damping: int = DAMPING) -> str:
    """The same judgement as DuckDB SQL.

    A row with an empty host brings every round what seeds keep, so that a round is one join. All ``most`` rounds are
    made, and ranks are those of the first round, of each ROUNDS, after which they have settled as in
    :func:`propagate`. Ranks out of ONE settle after some 90 rounds, and none is passed on after some 220.
    """
    fits = {t: f"((host = '{split_rule(t)[0]}' OR ends_with(host, '.{split_rule(t)[0]}')) AND starts_with(path, '{split_rule(t)[1]}'))" for _, t in rules}
    case = lambda i: "CASE " + " ".join(f"WHEN {fits[r[1]]} THEN '{r[i]}'" for r in _by_length(rules)) + " END"
    rest = "CASE WHEN contains(url, '://') THEN substr(url, strpos(url, '://') + 3) ELSE '' END"
    href = HREF.replace("'", "''")
    return rf"""
WITH RECURSIVE p0 AS (SELECT page_id, html, coalesce({rest}, '') AS rest FROM pages),
p AS (SELECT page_id, html, translate(regexp_extract(rest, '^[^/?#]*'), '{string.ascii_uppercase}', '{string.ascii_lowercase}') AS host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM p0),
j AS (SELECT page_id, host, path, {case(1)} AS rule, {case(0)} AS action FROM p),
h AS (SELECT host AS src, unnest(regexp_extract_all(coalesce(html, ''), '{href}', 1)) AS href FROM p WHERE host <> ''),
l AS (SELECT DISTINCT src, translate(regexp_extract(regexp_replace(href, '(?i)^(https?:)?//', ''), '^[^/?#]*'), '{string.ascii_uppercase}', '{string.ascii_lowercase}') AS dst FROM h WHERE regexp_matches(href, '(?i)^(https?:)?//')),
known AS (SELECT host FROM p UNION SELECT dst FROM l WHERE dst <> ''),
up(src, dst) AS (
  SELECT host, regexp_replace(host, '^[^.]*\.', '') FROM known WHERE len(string_split(host, '.')) >= 3
  UNION SELECT dst, regexp_replace(dst, '^[^.]*\.', '') FROM up WHERE len(string_split(dst, '.')) >= 3),
edges AS (SELECT DISTINCT src, dst FROM (SELECT src, dst FROM l WHERE dst <> '' UNION ALL SELECT src, dst FROM up UNION ALL SELECT dst, src FROM up) WHERE src <> dst),
ways0 AS (SELECT 'trust' AS kind, src AS host, dst FROM edges UNION ALL SELECT 'distrust', dst, src FROM edges),
ways AS (SELECT *, count(*) OVER (PARTITION BY kind, host) AS degree FROM ways0),
seeds AS (SELECT CASE action WHEN 'allow' THEN 'trust' ELSE 'distrust' END AS kind, host, count(*) AS weight FROM j WHERE action IS NOT NULL AND host <> '' GROUP BY ALL),
start AS (SELECT kind, host, floor(weight / sum(weight) OVER (PARTITION BY kind) * {1 << 30})::BIGINT * {ONE >> 30} AS mass FROM seeds),
flows AS (
  SELECT kind, host, dst, degree, 0::BIGINT AS amount FROM ways
  UNION ALL SELECT kind, '', host, 0, (mass // 100) * {100 - damping} FROM start
  UNION ALL SELECT DISTINCT kind, '', '', 0, 1::BIGINT FROM start),
r(k, kind, host, mass) AS (
  SELECT 0, kind, host, mass FROM start UNION ALL SELECT DISTINCT 0, kind, '', 1::BIGINT FROM start
  UNION ALL SELECT r.k + 1, r.kind, f.dst, sum(CASE WHEN f.host = '' THEN f.amount ELSE ((r.mass // 100) * {damping}) // f.degree END)::BIGINT
    FROM r JOIN flows f ON f.kind = r.kind AND f.host = r.host WHERE r.k < {most} GROUP BY r.k, r.kind, f.dst),
every AS (SELECT k, kind, host, mass FROM r WHERE k % {ROUNDS} = 0 AND host <> ''),
moved AS (SELECT k, kind, sum(abs(mass - was)) AS change, max(CASE WHEN mass > 0 AND was = 0 THEN 1 ELSE 0 END) AS further FROM (
    SELECT k, kind, host, sum(mass) AS mass, sum(was) AS was FROM (
      SELECT k, kind, host, mass, 0::BIGINT AS was FROM every UNION ALL SELECT k + {ROUNDS}, kind, host, 0::BIGINT, mass FROM every WHERE k < {most}) GROUP BY ALL)
  WHERE k > 0 GROUP BY ALL),
settled AS (SELECT min(k) AS k FROM (SELECT k FROM moved GROUP BY k HAVING max(change) < {SETTLED} AND max(further) = 0)),
ranks AS (SELECT host, max(mass) FILTER (kind = 'trust') AS trust, max(mass) FILTER (kind = 'distrust') AS distrust FROM every WHERE k = (SELECT k FROM settled) GROUP BY host)
SELECT page_id, j.host, path, rule,
  coalesce(action, CASE WHEN coalesce(distrust, 0) > 0 AND coalesce(distrust, 0) * 100 >= coalesce(trust, 0) * {THRESHOLD} THEN 'block' ELSE 'allow' END) AS verdict,
  coalesce(trust, 0) AS trust, coalesce(distrust, 0) AS distrust
FROM j LEFT JOIN ranks USING (host)
"""
