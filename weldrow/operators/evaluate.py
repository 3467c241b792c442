"""Evaluation against a known truth, and threshold sweeps; pair sets are joined, never collected."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weldrow.functions.text import pair_key, token_sort_ratio


def true_pairs(truth: DataFrame) -> DataFrame:
    """``key`` of every two records of an entity; truth has source, source_record_id, entity_id."""
    rows = truth.select(F.concat_ws(":", "source", "source_record_id").alias("r"), F.col("entity_id").alias("e"))
    return group_pairs(rows, "r", "e")


def group_pairs(rows: DataFrame, key: str, group: str) -> DataFrame:
    a, b = rows.select(F.col(group).alias("g"), F.col(key).alias("a")), rows.select(F.col(group).alias("g"), F.col(key).alias("b"))
    return a.join(b, "g").where("a < b").select(F.concat_ws("||", "a", "b").alias("key")).distinct()


def prf(tp: Column, fp: Column, fn: Column) -> dict[str, Column]:
    """Precision, recall and F1, 0 where undefined."""
    p = F.when(tp + fp > 0, tp / (tp + fp)).otherwise(F.lit(0.0))
    r = F.when(tp + fn > 0, tp / (tp + fn)).otherwise(F.lit(0.0))
    f = F.when(p + r > 0, 2 * p * r / (p + r)).otherwise(F.lit(0.0))
    return {"tp": tp, "fp": fp, "fn": fn, "precision": F.round(p, 4), "recall": F.round(r, 4), "f1": F.round(f, 4)}


def marked(scored: DataFrame, score: str, truth: DataFrame, exclude: DataFrame | None = None) -> DataFrame:
    """``score, hit`` of the scored pairs; ``exclude`` keys are taken out."""
    rows = scored.select(pair_key(F.col("unique_id_l"), F.col("unique_id_r")).alias("key"), F.col(score).cast("double").alias("score"))
    if exclude is not None:
        rows = rows.join(exclude.select("key").distinct(), "key", "left_anti")
    return rows.join(truth.select("key", F.lit(True).alias("hit")), "key", "left").select("key", "score", F.coalesce("hit", F.lit(False)).alias("hit"))


def pr_curve(scored: DataFrame, score: str, truth: DataFrame, grid: Sequence[float], exclude: DataFrame | None = None) -> DataFrame:
    """``threshold, tp, fp, fn, precision, recall, f1`` for each threshold of the grid, in one pass over the pairs.

    Pairs fall between two thresholds and are counted there; the counts of a grid's length are then summed from above.
    """
    grid = sorted(grid)
    truth = truth.select("key").distinct()
    left = truth if exclude is None else truth.join(exclude.select("key").distinct(), "key", "left_anti")
    bounds = F.array(*[F.lit(float(t)) for t in grid])
    step = F.size(F.filter(bounds, lambda b: b <= F.col("score")))
    counts = marked(scored, score, left, exclude).withColumn("step", step).groupBy("step").agg(F.count_if("hit").alias("hits"), F.count_if(~F.col("hit")).alias("others"))
    table = scored.sparkSession.createDataFrame([(float(t), i + 1) for i, t in enumerate(grid)], "threshold double, at int")
    above = table.join(F.broadcast(counts), F.col("step") >= F.col("at"), "left").groupBy("threshold").agg(F.coalesce(F.sum("hits"), F.lit(0)).alias("tp"), F.coalesce(F.sum("others"), F.lit(0)).alias("fp"))
    total = left.agg(F.count(F.lit(1)).alias("total"))
    return above.join(F.broadcast(total)).select("threshold", *[v.alias(k) for k, v in prf(F.col("tp"), F.col("fp"), F.col("total") - F.col("tp")).items()])


def pairwise_at_threshold(scored: DataFrame, score: str, threshold: float, truth: DataFrame, exclude: DataFrame | None = None) -> DataFrame:
    return pr_curve(scored, score, truth, [threshold], exclude)


def best_row(curve: DataFrame) -> DataFrame:
    """The highest F1; of equal ones the lowest threshold."""
    return curve.orderBy(F.desc("f1"), "threshold").limit(1)


def blocking_recall(candidates: DataFrame, truth: DataFrame) -> DataFrame:
    keys = candidates.select(pair_key(F.col("unique_id_l"), F.col("unique_id_r")).alias("key")).distinct()
    found = keys.join(truth, "key", "left_semi").agg(F.count(F.lit(1)).alias("found"))
    out = truth.agg(F.count(F.lit(1)).alias("true_pairs")).join(F.broadcast(keys.agg(F.count(F.lit(1)).alias("candidates")))).join(F.broadcast(found))
    return out.withColumn("blocking_recall", F.when(F.col("true_pairs") > 0, F.round(F.col("found") / F.col("true_pairs"), 4)).otherwise(0.0))


def cluster_vs_truth(crosswalk: DataFrame, truth: DataFrame) -> DataFrame:
    """One row: pairwise scores of the clusters' closure, entities found exactly, entities split, clusters that mix entities.

    Pairs are counted by the sizes of (entity, cluster) cells, so large clusters are not expanded.
    """
    found = crosswalk.select(F.concat_ws(":", "source", "source_record_id").alias("r"), F.col("entity_id").alias("c"))
    known = truth.select(F.concat_ws(":", "source", "source_record_id").alias("r"), F.col("entity_id").alias("e"))
    rows = known.join(found, "r", "full_outer")
    cells = rows.groupBy("e", "c").agg(F.count(F.lit(1)).alias("n"))
    pairs = lambda n: n * (n - 1) / 2
    both = cells.where("e is not null and c is not null").agg(F.coalesce(F.sum(pairs(F.col("n"))), F.lit(0)).cast("long").alias("tp"))
    ours = cells.where("c is not null").groupBy("c").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("cells"))
    theirs = cells.where("e is not null").groupBy("e").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("cells"), F.max("c").alias("c"))
    whole = theirs.where("cells = 1").join(ours.where("cells = 1").select("c", F.col("n").alias("m")), "c").where("n = m")
    out = both
    for part in (
        ours.agg(F.coalesce(F.sum(pairs(F.col("n"))), F.lit(0)).cast("long").alias("predicted"), F.count_if(F.col("cells") > 1).alias("clusters_merging_entities")),
        theirs.agg(F.coalesce(F.sum(pairs(F.col("n"))), F.lit(0)).cast("long").alias("actual"), F.count(F.lit(1)).alias("n_true_entities"), F.count_if(F.col("cells") > 1).alias("entities_split")),
        whole.agg(F.count(F.lit(1)).alias("exact")),
    ):
        out = out.join(F.broadcast(part))
    scores = prf(F.col("tp"), F.col("predicted") - F.col("tp"), F.col("actual") - F.col("tp"))
    rate = F.when(F.col("n_true_entities") > 0, F.round(F.col("exact") / F.col("n_true_entities"), 4)).otherwise(0.0)
    return out.select(*[v.alias(k) for k, v in scores.items()], "n_true_entities", rate.alias("entity_exact_match_rate"), "entities_split", "clusters_merging_entities")


def missed_pairs(crosswalk: DataFrame, truth: DataFrame) -> DataFrame:
    """``key`` of true pairs whose records are in different clusters."""
    found = crosswalk.select(F.concat_ws(":", "source", "source_record_id").alias("r"), F.col("entity_id").alias("c"))
    rows = truth.select(F.concat_ws(":", "source", "source_record_id").alias("r"), F.col("entity_id").alias("e")).join(found, "r", "left")
    a, b = rows.select("e", F.col("r").alias("a"), F.col("c").alias("ca")), rows.select("e", F.col("r").alias("b"), F.col("c").alias("cb"))
    return a.join(b, "e").where("a < b and not (ca <=> cb)").select(F.concat_ws("||", "a", "b").alias("key"))


def misses_by_noise(missed: DataFrame, truth: DataFrame) -> DataFrame:
    """``noise_op, missed_pairs, n_missed``: pairs with a record that the operation changed."""
    ops = truth.select(F.concat_ws(":", "source", "source_record_id").alias("r"), F.explode(F.filter(F.split(F.coalesce("noise_ops", F.lit("")), r"\|"), lambda x: x != "")).alias("noise_op"))
    ends = missed.select("key", F.explode(F.split("key", r"\|\|")).alias("r"))
    counts = ends.join(ops, "r").select("key", "noise_op").distinct().groupBy("noise_op").agg(F.count(F.lit(1)).alias("missed_pairs"))
    return counts.join(F.broadcast(missed.agg(F.count(F.lit(1)).alias("n_missed"))))


def review_queue_truth(queue: DataFrame, truth: DataFrame) -> DataFrame:
    keyed = queue.select("review_reason", pair_key(F.col("unique_id_l"), F.col("unique_id_r")).alias("key")).join(truth.select("key", F.lit(1).alias("hit")), "key", "left")
    return keyed.groupBy("review_reason").agg(F.count(F.lit(1)).alias("pairs"), F.coalesce(F.sum("hit"), F.lit(0)).alias("true_matches")).withColumn("true_share", F.round(F.col("true_matches") / F.col("pairs"), 4))


def restrict(pairs: DataFrame, sources: Sequence[str]) -> DataFrame:
    """Pairs of which both records come from ``sources``."""
    inside = lambda s: F.split_part(F.col(f"unique_id_{s}"), F.lit(":"), F.lit(1)).isin(*sources)
    return pairs.where(inside("l") & inside("r"))


@dataclass(frozen=True)
class CostModel:
    """Minutes that a wrong link, a pair to review and a missed link cost."""

    false_link: float = 30.0
    review: float = 1.0
    missed_link: float = 10.0


def auto_link_sweep(edges: DataFrame, truth: DataFrame, review_lower: float, grid: Sequence[float], cost: CostModel = CostModel()) -> DataFrame:
    """Scores, queue and expected minutes for each auto-link threshold above ``review_lower``."""
    curve = pr_curve(edges, "match_probability", truth, [t for t in grid if t > review_lower])
    base = marked(edges, "match_probability", truth.select("key").distinct()).where(F.col("score") >= review_lower).agg(F.count(F.lit(1)).alias("all_pairs"), F.count_if("hit").alias("all_hits"))
    out = curve.join(F.broadcast(base))
    queue, hits = F.col("all_pairs") - F.col("tp") - F.col("fp"), F.col("all_hits") - F.col("tp")
    missed = F.col("tp") + F.col("fn") - F.col("all_hits")
    minutes = F.col("fp") * cost.false_link + queue * cost.review + missed * cost.missed_link
    return out.select("threshold", "tp", "fp", "fn", "precision", "recall", "f1", queue.alias("queue_size"), hits.alias("queue_true_pairs"), F.col("fp").alias("false_auto_links"), missed.alias("missed_below_review"), F.round(minutes, 1).alias("expected_cost_minutes"))


def baseline_string(df: DataFrame) -> Column:
    """Lower-cased name and organisation; the name from its components where it is missing."""
    have = lambda c: F.col(c) if c in df.columns else F.lit(None).cast("string")
    parts = F.concat_ws(" ", have("name_first"), have("name_middle"), have("name_last"))
    name = F.coalesce(have("name"), F.when(parts != "", parts))
    return F.lower(F.trim(F.concat_ws(" ", name, have("org"))))


def baseline_scores(records: DataFrame, cross_source_only: bool = False, npi_column: str | None = None) -> DataFrame:
    """Fuzzy score of all pairs (0 to 100): of whole strings, or with ``npi_column`` of names, 100 where identifiers agree.

    A quadratic yardstick for small tables, kept apart from the pipeline.
    """
    text = baseline_string(records.drop("org") if npi_column else records)
    rows = records.select("unique_id", "source_dataset", text.alias("t"), (F.col(npi_column) if npi_column else F.lit(None).cast("string")).alias("n"))
    l, r = (rows.select(*[F.col(c).alias(f"{c}_{s}") for c in rows.columns]) for s in "lr")
    keep = "unique_id_l < unique_id_r" + (" and source_dataset_l <> source_dataset_r" if cross_source_only else "")
    fuzzy = token_sort_ratio(F.col("t_l"), F.col("t_r"))
    return l.join(r, F.expr(keep)).select("unique_id_l", "unique_id_r", F.when(F.col("n_l") == F.col("n_r"), 100.0).otherwise(fuzzy).alias("score"))
