"""Candidate pairs as a union of equi-joins, and deterministic links."""

from __future__ import annotations

import re
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weldrow.functions.text import jaro_winkler
from weldrow.profiles import BlockingRule, DeterministicRule, Guard
from weldrow.session import cut

LINK_TYPES = ("link_only", "dedupe_only", "link_and_dedupe")


def rule_sql(rule: BlockingRule | DeterministicRule) -> str:
    """The rule over the aliases l and r."""
    if isinstance(rule, BlockingRule) and rule.sql:
        return rule.sql
    columns = rule.columns if isinstance(rule, BlockingRule) else rule.match_columns
    return " AND ".join(f"l.{c} = r.{c}" for c in columns)


def rule_columns(rule: BlockingRule | DeterministicRule) -> set[str]:
    if isinstance(rule, DeterministicRule):
        return set(rule.match_columns)
    return set(rule.columns) or set(re.findall(r"\b[lr]\.(\w+)", rule.sql))


def by_columns(rule: BlockingRule | DeterministicRule) -> bool:
    """Whether the rule is that its columns are equal."""
    return not (isinstance(rule, BlockingRule) and rule.sql)


def usable_rules(rules: Sequence, columns: Sequence[str]) -> list:
    """Rules whose columns are all there (an excluded field takes its rules along)."""
    return [r for r in rules if rule_columns(r) <= set(columns)]


def _scope(link_type: str) -> str:
    if link_type not in LINK_TYPES:
        raise ValueError(f"link_type must be one of {LINK_TYPES}")
    return " AND l.source_dataset <> r.source_dataset" if link_type == "link_only" else ""


#: Records of a piece of a large block.
PIECE = 4096


def _equated(rule: BlockingRule | DeterministicRule, texts: set[str]) -> list[tuple[str, str]]:
    """The left and right columns, all of them among ``texts``, that the rule sets equal; none if it is more than that."""
    if by_columns(rule):
        pairs = [(c, c) for c in sorted(rule_columns(rule))]
    else:
        found = [re.fullmatch(r"\s*([lr])\.(\w+)\s*=\s*([lr])\.(\w+)\s*", x) for x in re.split(r"\bAND\b", rule.sql, flags=re.IGNORECASE)]
        pairs = [(m[2], m[4]) if m[1] == "l" else (m[4], m[2]) for m in found if m and m[1] != m[3]]
        pairs = pairs if len(pairs) == len(found) else []
    return pairs if {c for p in pairs for c in p} <= texts else []


def _pieces(slim: DataFrame, rule: int, pairs: Sequence[tuple[str, str]], earlier: Sequence[Sequence[str]], carried: dict[str, Column], piece: int) -> DataFrame:
    """``_key, _side, _own, _end`` and lists of what a pair needs: the pieces of every block, whose keys (``pairs``) are not null.

    ``_key`` is the ``rule`` and the block's keys. Where left and right columns differ, a block has a left and a right side (1 and 2),
    else it is both (0). A block is ranked by unique_id and each side cut into pieces of ``piece`` records or, where identifiers
    repeat, ranks: ``_own`` is the number of a piece, ``_end`` that of the last of the other side. Columns of an ``earlier`` rule become one
    number, equal in a block where they are, so that nothing is compared as text for every pair. Where there are none, and
    where one is null, it is a number that no other rank has.
    """
    keys = [f"_k{n}" for n in range(len(pairs))]
    rows = [slim.where(" AND ".join(f"{c} IS NOT NULL" for c in ("unique_id", *(p[at] for p in pairs)))).withColumns({k: F.col(p[at]) for k, p in zip(keys, pairs, strict=True)}) for at in (0, 1)]
    both = all(a == b for a, b in pairs)
    rows = rows[0].withColumn("_side", F.lit(0)) if both else rows[0].withColumn("_side", F.lit(1)).unionAll(rows[1].withColumn("_side", F.lit(2)))
    block = Window.partitionBy(*keys)
    rank = F.rank().over(block.orderBy("unique_id"))
    nth = rank if both else F.rank().over(Window.partitionBy(*keys, "_side").orderBy("unique_id"))
    of = lambda side: F.count(F.when(F.col("_side") == side, 1)).over(block)
    rows = rows.withColumns({"_rank": rank, "_nth": nth, "_others": of(0) if both else F.when(F.col("_side") == 1, of(2)).otherwise(of(1))}).where(F.col("_others") > int(both))
    for i, columns in enumerate(earlier):
        own, some_null = -F.col("_rank"), " OR ".join(f"{c} IS NULL" for c in columns)
        rows = rows.withColumn(f"_e{i}", F.when(F.expr(some_null), own).otherwise(F.dense_rank().over(block.orderBy(*columns))) if columns else own)
    names = ["unique_id", "_rank", *(f"_e{i}" for i in range(len(earlier)))]
    record = F.struct(*names, F.struct(*(v.alias(c) for c, v in carried.items())).alias("_more"))
    rows = rows.select(*keys, "_side", F.expr(f"cast((_nth - 1) div {piece} as int)").alias("_own"), F.expr(f"cast((_others - 1) div {piece} as int)").alias("_end"), record.alias("_row"))
    rows = rows.groupBy(*keys, "_side", "_own", "_end").agg(F.collect_list("_row").alias("_rows"))
    return rows.select(F.lit(rule).alias("match_key"), F.array(F.lit(str(rule)), *keys).alias("_key"), "_side", "_own", "_end", *(F.expr(f"_rows.{c}").alias(f"{c}s") for c in [*names, "_more"]))


def _pairs_in_pieces(slim: DataFrame, rules: Sequence[BlockingRule | DeterministicRule], equated: dict[int, list[tuple[str, str]]], link_type: str, wanted: Sequence[str], piece: int) -> DataFrame:
    """Pairs of the rules numbered in ``equated``, whose blocks may be of any size.

    Every two pieces of a block meet in a place of their own, so that a block is the work of many tasks. Where two pieces of one
    side meet, the left one has the lesser identifiers; elsewhere ranks are compared. The right piece stays one row of
    lists, walked beside each left record, and all rules share this last step: what follows (a count, a projection) is compiled
    with it, and no pair is made a row before. Pieces are written once, as both sides read them.
    """
    blocks = [i for i, pairs in equated.items() if all(a == b for a, b in pairs)]
    before = {i: [k for k in blocks if k < i] for i in equated}
    apart = {i: [rules[k] for k in range(i) if k not in blocks] for i in equated}
    slots, scope = max(map(len, before.values())), ["source_dataset"] if link_type == "link_only" else []
    texts = F.struct(F.lit(0).alias("_0"), *sorted(set().union(*(rule_columns(r) for x in apart.values() for r in x))))
    no_texts, shown = F.lit(None).cast(slim.select(texts.alias("t")).schema["t"].dataType), dict.fromkeys([*wanted, *scope])
    held, whens = [], ""
    for i, pairs in equated.items():
        earlier = [sorted(rule_columns(rules[k]) - (rule_columns(rules[i]) if i in blocks else set())) for k in before[i]]
        if not all(earlier):  # an earlier rule has all these pairs
            continue
        carried = {"_t": texts if apart[i] else no_texts, **{c: F.col(c) for c in shown}}
        held.append(_pieces(slim, i, pairs, earlier + [[]] * (slots - len(earlier)), carried, piece))
        if apart[i]:
            tests = " AND ".join(f"NOT coalesce({rule_sql(r)}, false)" for r in apart[i])
            whens += f" WHEN {i} THEN " + re.sub(r"\br\.(\w+)", r"_mores[_at]._t.\1", re.sub(r"\bl\.(\w+)", r"_l_more._t.\1", tests))
    spark, on = slim.sparkSession, ["_key", "_i", "_j"]
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 4 * spark.sparkContext.defaultParallelism)
    held, own = cut(reduce(DataFrame.unionAll, held)), F.col("_own")
    lists = [c for c in held.columns if c.endswith("s")]
    left = held.where("_side < 2").withColumns({"_i": own, "_j": F.explode(F.sequence(F.expr("if(_side = 0, _own, 0)"), "_end"))}).repartition(tasks, *on)
    left = left.select("*", F.posexplode("unique_ids").alias("_at", "unique_id_l"))
    left = left.select("match_key", *on, F.expr("_side = 0 AND _i < _j").alias("_sure"), "unique_id_l", *(F.expr(f"{c}[_at]").alias(f"_l{c[:-1]}") for c in lists if c != "unique_ids"))
    right = held.where("_side <> 1").select("_key", F.explode(F.sequence(F.lit(0), F.expr("if(_side = 0, _own, _end)"))).alias("_i"), own.alias("_j"), *lists).repartition(tasks, *on)
    both = left.join(right.hint("merge"), on).select("*", F.posexplode("unique_ids").alias("_at", "unique_id_r"))
    both = both.where(" AND ".join(["(_sure OR _l_rank < _ranks[_at])", *(f"_l_e{n} <> _e{n}s[_at]" for n in range(slots)), *(f"_l_more.{c} <> _mores[_at].{c}" for c in scope)]))
    both = both.where(f"CASE match_key{whens} ELSE true END") if whens else both
    return both.select("unique_id_l", "unique_id_r", "match_key", *[F.expr(f"{x}.{c}").alias(f"{c}_{s}") for c in wanted for s, x in (("l", "_l_more"), ("r", "_mores[_at]"))])


def candidate_pairs(records: DataFrame, rules: Sequence[BlockingRule | DeterministicRule], link_type: str = "link_and_dedupe", columns: Sequence[str] | None = None, piece: int | None = None) -> DataFrame:
    """``unique_id_l, unique_id_r, match_key`` and ``<c>_l, <c>_r`` of pairs that some rule brings together.

    Each rule is an equi-join of its own (an OR of rules would be a nested-loop join); a pair belongs to the first rule
    that holds, so no duplicate has to be removed. unique_id_l < unique_id_r. Only ``columns`` (default: all) travel.
    With ``piece``, for rules with very large blocks, those that only set texts equal share one join over pieces of their blocks
    (:func:`_pairs_in_pieces`); the pairs are the same.
    """
    usable = usable_rules(rules, records.columns)
    wanted = [c for c in (columns if columns is not None else [c for c in records.columns if c != "unique_id"]) if c in records.columns and c != "unique_id"]
    needed = {"unique_id", "source_dataset", *wanted, *(c for r in usable for c in rule_columns(r))} & set(records.columns)
    slim = records.select(*sorted(needed))
    texts = {f.name for f in slim.schema.fields if f.dataType.simpleString() == "string"}
    equated = {i: e for i, r in enumerate(usable) if (e := _equated(r, texts))} if piece else {}
    out = _pairs_in_pieces(slim, usable, equated, _scope(link_type) and link_type, wanted, piece) if equated else None
    for i, rule in enumerate(usable):
        if i in equated:
            continue
        earlier = "".join(f" AND NOT coalesce({rule_sql(r)}, false)" for r in usable[:i])
        side = slim.where(" AND ".join(f"{c} IS NOT NULL" for c in sorted(rule_columns(rule)))) if by_columns(rule) else slim
        pairs = side.alias("l").join(side.alias("r"), F.expr(f"{rule_sql(rule)} AND l.unique_id < r.unique_id{_scope(link_type)}{earlier}"))
        pairs = pairs.select(F.col("l.unique_id").alias("unique_id_l"), F.col("r.unique_id").alias("unique_id_r"), F.lit(i).alias("match_key"), *[F.col(f"{s}.{c}").alias(f"{c}_{s}") for c in wanted for s in "lr"])
        out = pairs if out is None else out.unionByName(pairs)
    if out is None:
        raise ValueError("no blocking rule applies to these columns")
    return out


def guard_passes(guard: Guard) -> Column:
    """Over columns ``<c>_l`` and ``<c>_r``."""
    a, b = F.col(f"{guard.column}_l"), F.col(f"{guard.column}_r")
    ok = a.isNull() | b.isNull() | (a == b)
    if guard.swap_with:
        ok = ok | F.coalesce(a == F.col(f"{guard.swap_with}_r"), F.lit(False)) | F.coalesce(F.col(f"{guard.swap_with}_l") == b, F.lit(False))
    if guard.jw_threshold is not None:
        ok = ok | F.coalesce(jaro_winkler(F.when(a != b, a), F.when(a != b, b)) >= guard.jw_threshold, F.lit(False))
    return ok


def deterministic_pairs(records: DataFrame, rules: Sequence[DeterministicRule], link_type: str = "link_and_dedupe") -> DataFrame:
    """``unique_id_l, unique_id_r, match_key``: equal match columns and all guards passed; the first such rule of a pair."""
    out = None
    for i, rule in enumerate(usable_rules(rules, records.columns)):
        shown = [c for g in rule.guards for c in (g.column, g.swap_with) if c]
        pairs = candidate_pairs(records, [rule], link_type, list(dict.fromkeys(shown)))
        for g in rule.guards:
            pairs = pairs.where(guard_passes(g))
        pairs = pairs.select("unique_id_l", "unique_id_r", F.lit(i).alias("match_key"))
        out = pairs if out is None else out.unionAll(pairs)
    if out is None:
        return records.sparkSession.createDataFrame([], "unique_id_l string, unique_id_r string, match_key int")
    return out.groupBy("unique_id_l", "unique_id_r").agg(F.min("match_key").alias("match_key"))


def block_sizes(records: DataFrame, rules: Sequence[BlockingRule], largest: int) -> DataFrame:
    """Blocks with more than ``largest`` records, to look at before joining: ``rule, block, records``."""
    out = None
    for r in (r for r in usable_rules(rules, records.columns) if r.columns):
        block = F.concat_ws("|", *r.columns)
        rows = records.dropna(subset=list(r.columns)).groupBy(block.alias("block")).agg(F.count(F.lit(1)).alias("records")).where(F.col("records") > largest)
        rows = rows.select(F.lit(" + ".join(r.columns)).alias("rule"), "block", "records")
        out = rows if out is None else out.unionAll(rows)
    return out
