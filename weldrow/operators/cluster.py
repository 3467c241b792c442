"""From scored pairs to clusters: constraints, edges, components, splits and quality."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce
from itertools import count

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from weldrow.operators.components import connected_components
from weldrow.profiles import HardConstraint, PairConstraint
from weldrow.session import cut, written

EDGE = ("unique_id_l", "unique_id_r", "match_probability", "link_source")


def constraint_columns(constraint: PairConstraint, columns: Sequence[str]) -> list[str]:
    return [g for c in constraint.comparisons if (g := f"gamma_{c}") in columns]


def check_pairs(predictions: DataFrame, constraints: Sequence[PairConstraint]) -> DataFrame:
    """``predictions`` with ``failed_constraints``: descriptions of those of which no comparison agrees.

    A constraint without any of its gamma columns does not apply.
    """
    failed = []
    for c in constraints:
        if cols := constraint_columns(c, predictions.columns):
            best = F.greatest(*map(F.col, cols)) if len(cols) > 1 else F.col(cols[0])
            failed.append(F.when(~F.coalesce(best > 0, F.lit(False)), F.lit(c.description)))
    listed = F.filter(F.array(*failed), lambda x: x.isNotNull()) if failed else F.array().cast("array<string>")
    return predictions.withColumn("failed_constraints", listed)


def build_edges(predictions: DataFrame, deterministic: DataFrame, constraints: Sequence[PairConstraint]) -> tuple[DataFrame, DataFrame]:
    """(edges, rejected predictions). Deterministic pairs have probability 1 and need no constraint; pairs found both ways are ``both``."""
    checked = check_pairs(predictions, constraints)
    fine = F.size("failed_constraints") == 0
    told = "pair_constraint: " + "; ".join(c.description for c in constraints)
    rejected = checked.where(~fine).withColumn("rejection_reason", F.lit(told))
    ends = [F.least("unique_id_l", "unique_id_r").alias("unique_id_l"), F.greatest("unique_id_l", "unique_id_r").alias("unique_id_r")]
    scored = checked.where(fine).select(*ends, "match_probability", F.lit("probabilistic").alias("link_source"))
    certain = deterministic.select(*ends, F.lit(1.0).alias("match_probability"), F.lit("deterministic").alias("link_source"))
    low, high = F.min("link_source"), F.max("link_source")
    edges = scored.unionAll(certain).groupBy("unique_id_l", "unique_id_r").agg(F.max("match_probability").alias("match_probability"), F.when(low == high, low).otherwise("both").alias("link_source"))
    return edges.select(*EDGE), rejected


def split_conflicts(edges: DataFrame, records: DataFrame, constraints: Sequence[HardConstraint]) -> tuple[DataFrame, DataFrame]:
    """(edges without conflict, edges whose ends hold different values of a constrained column)."""
    columns = [c.column for c in constraints if c.column in records.columns]
    if not columns:
        return edges, edges.limit(0)
    held = records.select("unique_id", *columns)
    out = edges
    for s in "lr":
        out = out.join(held.select(F.col("unique_id").alias(f"unique_id_{s}"), *[F.col(c).alias(f"_{c}_{s}") for c in columns]), f"unique_id_{s}", "left")
    clash = reduce(lambda a, b: a | b, [F.coalesce(F.col(f"_{c}_l") != F.col(f"_{c}_r"), F.lit(False)) for c in columns])
    return out.where(~clash).select(*edges.columns), out.where(clash).select(*edges.columns)


def cluster_edges(edges: DataFrame, records: DataFrame, threshold: float) -> DataFrame:
    """``unique_id, cluster_id`` of every record: components over edges at or above ``threshold``; alone, a record is its own cluster."""
    labels = connected_components(edges.where(F.col("match_probability") >= threshold), "unique_id_l", "unique_id_r")
    return records.select("unique_id").join(labels.withColumnRenamed("node", "unique_id"), "unique_id", "left").select("unique_id", F.coalesce("component", "unique_id").alias("cluster_id"))


#: Edge ends of a cluster that one task may hold.
IN_TASK = 200_000
_LOG = "constraint string, original_cluster string, n_records long, n_subclusters long, n_multi_hop_assignments long, n_ties long, n_singletons long, passes long"


def _spread(rows: pd.DataFrame, ends: pd.DataFrame) -> pd.DataFrame:
    """One cluster's passes: every free record beside an assigned one joins the part behind its strongest edge, the first of equals."""
    part = dict(zip(rows["unique_id"], rows["part"], strict=True))
    tie, when = dict.fromkeys(part, 0), dict.fromkeys(part, 0)
    near: dict[str, list[tuple[str, float]]] = {}
    for a, b, p in zip(ends["a"], ends["b"], ends["match_probability"], strict=True):
        near.setdefault(a, []).append((b, p))
    fresh = [x for x, at in part.items() if at is not None]
    for k in count(1):
        new = {}
        for x in {b for a in fresh for b, _ in near.get(a, ()) if part[b] is None}:
            seen = [(p, part[b]) for b, p in near[x] if part[b] is not None]
            best = {at for p, at in seen if p == max(seen)[0]}
            new[x], tie[x], when[x] = min(best), int(len(best) > 1), k
        if not new:
            break
        part |= new
        fresh = list(new)
    ids = list(part)
    return pd.DataFrame({"unique_id": ids, "cluster_id": rows["cluster_id"].iloc[0], "part": [part[x] for x in ids], "pass": [when[x] for x in ids], "tie": [tie[x] for x in ids]})


def _spread_by_joins(rows: DataFrame, ends: DataFrame) -> DataFrame:
    """The same for clusters of any size: a pass is a join over their edges, its outcome a table, so that lineage and size estimates start anew."""
    rows = written(rows)
    for k in count(1):  # each pass that goes on assigns a record at least
        placed = rows.where("part is not null").select(F.col("unique_id").alias("b"), F.col("part").alias("target"))
        free = rows.where("part is null").select(F.col("unique_id").alias("a"))
        best = ends.join(free, "a").join(placed, "b").groupBy("a", "match_probability").agg(F.min("target").alias("target"), (F.min("target") != F.max("target")).cast("int").alias("tied"))
        best = best.groupBy(F.col("a").alias("unique_id")).agg(F.max_by(F.struct("target", "tied"), "match_probability").alias("best"))
        found = F.col("part").isNull() & F.col("best").isNotNull()
        rows = written(rows.join(best, "unique_id", "left").select("unique_id", "cluster_id", F.coalesce("part", "best.target").alias("part"), F.when(found, k).otherwise(F.col("pass")).alias("pass"), F.when(found, F.col("best.tied")).otherwise(F.col("tie")).alias("tie")))
        if rows.where(F.col("pass") == k).isEmpty():
            return rows


def split_violating_clusters(membership: DataFrame, edges: DataFrame, records: DataFrame, constraints: Sequence[HardConstraint], most: int = IN_TASK) -> tuple[DataFrame, DataFrame]:
    """Clusters that hold several values of a constrained column are taken apart; returns (membership, log).

    Every record with a value seeds the part ``<cluster>#<value>``. In each pass the others join the part behind their
    strongest edge to a record that was assigned in an earlier pass; of equally strong ones, the part that sorts first.
    Those never reached stand alone as ``<cluster>#<record>``. A cluster of up to ``most`` edge ends is one task's work;
    of larger ones, a pass is a join over their edges, so that they are spread over tasks. Passes go on until one moves
    nothing. Constraints are applied in order, the second to the outcome of the first.
    """
    logs = []
    for c in (c for c in constraints if c.column in records.columns):
        held = membership.join(records.select("unique_id", F.col(c.column).alias("_v")), "unique_id", "left")
        bad = held.groupBy("cluster_id").agg(F.countDistinct("_v").alias("_n")).where("_n > 1").select("cluster_id")
        rows = cut(held.join(bad, "cluster_id").select("unique_id", "cluster_id", F.when(F.col("_v").isNotNull(), F.concat_ws("#", "cluster_id", "_v")).alias("part"), F.lit(0).alias("pass"), F.lit(0).alias("tie")))
        if rows.isEmpty():
            continue
        ends = edges.select(F.col("unique_id_l").alias("a"), F.col("unique_id_r").alias("b"), "match_probability")
        ends = ends.unionAll(ends.select(F.col("b").alias("a"), F.col("a").alias("b"), "match_probability"))
        near = rows.select(F.col("unique_id").alias("a"), F.col("cluster_id").alias("ca"))
        ends = cut(ends.join(near, "a").join(near.select(F.col("a").alias("b"), F.col("ca").alias("cb")), "b").where("ca = cb").select(F.col("ca").alias("cluster_id"), "a", "b", "match_probability"))
        big = ends.groupBy("cluster_id").agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > most).select("cluster_id")
        big = cut(big)
        small = rows.join(big, "cluster_id", "left_anti").groupBy("cluster_id").cogroup(ends.join(big, "cluster_id", "left_anti").groupBy("cluster_id"))
        done = small.applyInPandas(_spread, rows.schema)
        rows = written(done if big.isEmpty() else done.unionAll(_spread_by_joins(rows.join(big, "cluster_id", "left_semi"), ends.join(big, "cluster_id", "left_semi"))))
        parts = rows.withColumn("new", F.coalesce("part", F.concat_ws("#", "cluster_id", "unique_id")))
        logs.append(
            parts.groupBy(F.lit(c.column).alias("constraint"), F.col("cluster_id").alias("original_cluster")).agg(
                F.count(F.lit(1)).alias("n_records"), F.countDistinct("new").alias("n_subclusters"), F.sum((F.col("pass") > 1).cast("long")).alias("n_multi_hop_assignments"),
                F.sum(F.col("tie").cast("long")).alias("n_ties"), F.sum(F.col("part").isNull().cast("long")).alias("n_singletons"), F.max("pass").cast("long").alias("passes"),
            )
        )
        membership = cut(membership.join(parts.select("unique_id", "new"), "unique_id", "left").select("unique_id", F.coalesce("new", "cluster_id").alias("cluster_id")))
    log = reduce(DataFrame.unionByName, logs) if logs else membership.sparkSession.createDataFrame([], _LOG)
    return membership, log


@dataclass(frozen=True)
class ClusterQA:
    max_cluster_size: int = 6
    min_edge_density: float = 0.5


def cluster_metrics(membership: DataFrame, edges: DataFrame, qa: ClusterQA = ClusterQA()) -> DataFrame:
    """A row a record: size, edges and density of its cluster, its own strongest edge, the weakest such in the cluster, and flags."""
    side = membership.select(F.col("unique_id").alias("unique_id_l"), F.col("cluster_id").alias("_cl"))
    within = edges.join(side, "unique_id_l").join(side.select(F.col("unique_id_l").alias("unique_id_r"), F.col("_cl").alias("_cr")), "unique_id_r").where("_cl = _cr")
    sizes = membership.groupBy("cluster_id").agg(F.count(F.lit(1)).alias("cluster_size"))
    counts = within.groupBy(F.col("_cl").alias("cluster_id")).agg(F.count(F.lit(1)).alias("n_edges"))
    ends = within.select(F.col("unique_id_l").alias("unique_id"), "match_probability").unionAll(within.select("unique_id_r", "match_probability"))
    own = ends.groupBy("unique_id").agg(F.max("match_probability").alias("record_attachment"))
    rows = membership.join(own, "unique_id", "left")
    weakest = rows.groupBy("cluster_id").agg(F.min("record_attachment").alias("cluster_confidence"))
    table = sizes.join(counts, "cluster_id", "left").join(weakest, "cluster_id").fillna(0, ["n_edges"])
    n = F.col("cluster_size")
    density = F.when(n == 1, F.lit(1.0)).otherwise(F.col("n_edges") / (n * (n - 1) / 2))
    table = table.withColumn("edge_density", density)
    flags = F.concat_ws("|", F.when(n == 1, "singleton"), F.when(n > qa.max_cluster_size, "oversized"), F.when((n > 1) & (F.col("edge_density") < qa.min_edge_density), "low_density"))
    return rows.join(table.withColumn("flags", flags), "cluster_id").select("unique_id", "cluster_id", "cluster_size", "n_edges", "edge_density", "record_attachment", "cluster_confidence", "flags")


CROSSWALK = ("source", "source_record_id", "entity_id", "cluster_confidence", "cluster_size", "record_attachment", "edge_density", "flags", "unique_id")


def _rank(df: DataFrame, by: str, name: str, groups: int = 256) -> DataFrame:
    """Dense rank from 1 in the order of a unique column, without one task that sees all rows.

    Rows are dealt to ranges of ``by``; each range is numbered alone and shifted by the ranges before it.
    """
    ranged = cut(df.repartitionByRange(groups, by).withColumn("_range", F.spark_partition_id()))
    counts = ranged.groupBy("_range").agg(F.count(F.lit(1)).alias("_n"))
    starts = counts.select("_range", (F.sum("_n").over(Window.orderBy("_range")) - F.col("_n")).alias("_start"))
    inside = F.row_number().over(Window.partitionBy("_range").orderBy(by))
    return ranged.withColumn("_inside", inside).join(F.broadcast(starts), "_range").withColumn(name, F.col("_inside") + F.col("_start")).drop("_range", "_inside", "_start")


def build_crosswalk(metrics: DataFrame, records: DataFrame, prefix: str = "ENT") -> DataFrame:
    """A row a record with ``entity_id``: clusters are numbered in the order of their smallest member."""
    first = _rank(metrics.groupBy("cluster_id").agg(F.min("unique_id").alias("_first")), "_first", "_k")
    named = first.select("cluster_id", F.concat(F.lit(prefix), F.when(F.col("_k") < 1_000_000, F.lpad(F.col("_k").cast("string"), 6, "0")).otherwise(F.col("_k").cast("string"))).alias("entity_id"))
    keys = records.select("unique_id", F.col("source_dataset").alias("source"), "source_record_id")
    return metrics.join(keys, "unique_id", "left").join(named, "cluster_id").select(*CROSSWALK)


def hub_entity_ids(crosswalk: DataFrame, hub_source: str = "nppes", prefix: str = "NPI-") -> DataFrame:
    """Entities with a hub record are named after their smallest hub identifier; ``hub_npi`` and ``is_reference`` added."""
    hubs = crosswalk.where(F.col("source") == hub_source).groupBy("entity_id").agg(F.min("source_record_id").alias("hub_npi"))
    out = crosswalk.join(hubs, "entity_id", "left")
    return out.withColumn("is_reference", F.col("source") == hub_source).withColumn("entity_id", F.coalesce(F.concat(F.lit(prefix), "hub_npi"), "entity_id")).select(*crosswalk.columns, "hub_npi", "is_reference")


def display(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Identifiers, scores and the shown columns of both sides, as far as they are there."""
    wanted = ["unique_id_l", "unique_id_r", "match_probability", "match_weight", *(f"{c}_{s}" for c in columns for s in "lr")]
    return df.select(*[c for c in wanted if c in df.columns])


def review_queue(predictions: DataFrame, lower: float, upper: float, columns: Sequence[str], rejected: DataFrame | None = None, npi_column: str | None = None, audit_sample: int = 0, seed: int = 0) -> DataFrame:
    """Pairs for an analyst with a ``review_reason``: score_band, same_npi_name_conflict, rejected_audit_sample.

    ``predictions`` are those that passed the pair constraints. The sample is the ``audit_sample`` rejected pairs with the
    smallest seeded hash.
    """
    p = F.col("match_probability")
    parts = [display(predictions.where((p >= lower) & (p < upper)), columns).withColumn("review_reason", F.lit("score_band"))]
    if rejected is not None:
        same = F.lit(False)
        if npi_column and f"{npi_column}_l" in rejected.columns:
            same = F.coalesce(F.col(f"{npi_column}_l") == F.col(f"{npi_column}_r"), F.lit(False))
            parts.append(display(rejected.where(same), columns).withColumn("review_reason", F.lit("same_npi_name_conflict")))
        if audit_sample:
            order = F.xxhash64("unique_id_l", "unique_id_r", F.lit(seed))
            parts.append(display(rejected.where(~same).orderBy(order, "unique_id_l", "unique_id_r").limit(audit_sample), columns).withColumn("review_reason", F.lit("rejected_audit_sample")))
    return reduce(DataFrame.unionByName, parts)


def validation_summary(records: DataFrame, fields: Sequence[str]) -> DataFrame:
    """``source, field, n, valid, missing, invalid, reasons`` in one pass over the records."""
    entries = F.array(*[F.struct(F.lit(f).alias("field"), F.col(f"{f}_valid").alias("ok"), F.col(f"{f}_invalid_reason").alias("why")) for f in fields])
    rows = records.select(F.col("source_dataset").alias("source"), F.inline(entries))
    gone = F.col("why") == "missing"
    return rows.groupBy("source", "field").agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if("ok").alias("valid"),
        F.count_if(gone).alias("missing"),
        F.count_if(~F.col("ok") & ~gone).alias("invalid"),
        F.array_join(F.array_sort(F.collect_set(F.when(~gone, F.col("why")))), "|").alias("reasons"),
    )


