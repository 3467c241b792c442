"""Fellegi-Sunter model: estimates on counted comparison patterns, scores as literal weights."""

from __future__ import annotations

import json
import math
from collections.abc import Mapping, Sequence
from dataclasses import asdict, dataclass, field
from functools import reduce
from itertools import combinations
from operator import and_
from pathlib import Path

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weldrow.operators.blocking import candidate_pairs, deterministic_pairs, rule_columns, usable_rules
from weldrow.operators.compare import Comparison, gammas

Table = dict[str, dict[str, float]]  # comparison -> level label -> probability


#: Hashes that a share of records is drawn from.
SPAN = 1 << 62


@dataclass
class Model:
    """m and u by comparison and level label, the prior, and how training went."""

    prior: float = 1e-4
    m: Table = field(default_factory=dict)
    u: Table = field(default_factory=dict)
    log: list[dict] = field(default_factory=list)

    def save(self, path: str | Path) -> Path:
        Path(path).write_text(json.dumps(asdict(self), indent=2, sort_keys=True))
        return Path(path)

    @classmethod
    def load(cls, path: str | Path) -> Model:
        return cls(**json.loads(Path(path).read_text()))

    def floored(self, floor: float) -> tuple[Model, int]:
        """All probabilities within [floor, 1 - floor], and how many that changed."""
        changed = 0

        def clamp(t: Table) -> Table:
            nonlocal changed
            out = {c: {k: min(max(p, floor), 1 - floor) for k, p in levels.items()} for c, levels in t.items()}
            changed += sum(out[c][k] != t[c][k] for c in t for k in t[c])
            return out

        return Model(self.prior, clamp(self.m), clamp(self.u), self.log), changed

    def seeded(self, m: Mapping[str, Mapping[str, float]]) -> tuple[Model, int]:
        """m replaced by known values of the same comparison and label, and how many; u is never taken over."""
        out = {c: {k: float(m.get(c, {}).get(k, p)) for k, p in levels.items()} for c, levels in self.m.items()}
        return Model(self.prior, out, self.u, self.log), sum(k in m.get(c, {}) for c in self.m for k in self.m[c])


def start_model(comparisons: Sequence[Comparison], prior: float = 1e-4) -> Model:
    """Agreement likely among matches, the stronger the likelier; the reverse among others."""
    m, u = {}, {}
    for c in comparisons:
        labels = c.labels()
        w = {g: 2.0 ** (g + 1) for g in labels}
        m[c.name] = {labels[g]: w[g] / sum(w.values()) for g in labels}
        v = {g: 2.0 ** -(3 * g) for g in labels}
        u[c.name] = {labels[g]: v[g] / sum(v.values()) for g in labels}
    return Model(prior, m, u)


def possible_pairs(records: DataFrame, link_type: str) -> int:
    sizes = [r["n"] for r in records.groupBy("source_dataset").agg(F.count(F.lit(1)).alias("n")).collect()]
    total = sum(sizes)
    return (total * total - sum(n * n for n in sizes)) // 2 if link_type == "link_only" else total * (total - 1) // 2


def estimate_prior(records: DataFrame, rules: Sequence, recall: float, link_type: str) -> float:
    """Share of all possible pairs that match: deterministic links, scaled up by the recall that they are assumed to have."""
    found = deterministic_pairs(records, rules, link_type).count()
    return min(max(found / recall / max(possible_pairs(records, link_type), 1), 1e-12), 0.5)


def patterns(pairs: DataFrame, comparisons: Sequence[Comparison]) -> list[tuple[tuple[int, ...], int]]:
    """Distinct gamma vectors and their counts, in order: their number depends on the comparisons, not on the data."""
    names = [f"gamma_{c.name}" for c in comparisons]
    rows = gammas(pairs, list(comparisons)).groupBy(*names).count().collect()
    return sorted((tuple(r[n] for n in names), r["count"]) for r in rows)


#: Comparisons that are counted without pairs at most: each doubles the aggregations.
COUNTED = 4


def block_patterns(records: DataFrame, rule, comparisons: Sequence[Comparison], link_type: str = "link_and_dedupe") -> list[tuple[tuple[int, ...], int]]:
    """:func:`patterns` of a rule's candidate pairs.

    Where the rule is equality of columns and every comparison is, too, no pair is made: records that agree on some of
    the columns are counted, and inclusion and exclusion gives how many pairs agree on just those. So a block of n records
    costs n and not n squared.
    """
    columns = [c.equality() for c in comparisons]
    if link_type == "link_only" or getattr(rule, "sql", None) or None in columns or not 0 < len(columns) <= COUNTED:
        return patterns(candidate_pairs(records, [rule], link_type, sorted({c for x in comparisons for c in x.columns})), comparisons)
    block = sorted(rule_columns(rule))
    rows = records.select(F.col("unique_id").alias("id"), *[F.col(c).alias(f"b{i}") for i, c in enumerate(block)], *[F.col(c).alias(f"c{i}") for i, c in enumerate(columns)])
    rows = rows.dropna(subset=["id", *(f"b{i}" for i in range(len(block)))])
    every = [frozenset(x) for n in range(len(columns) + 1) for x in combinations(range(len(columns)), n)]
    least = {}  # pairs with values on both sides in all of the first columns, equal ones in all of the second
    for same in every:
        known = [k for k in every if same <= k]
        by = [*(f"b{i}" for i in range(len(block))), *(f"c{i}" for i in sorted(same))]
        has = [reduce(and_, [F.col(f"c{i}").isNotNull() for i in sorted(k)], F.lit(True)) for k in known]
        of_id = rows.groupBy(*by, "id").agg(*[F.count_if(h).alias(f"n{j}") for j, h in enumerate(has)])
        sizes = of_id.groupBy(*by).agg(*[F.sum(f"n{j}").alias(f"n{j}") for j in range(len(known))], *[F.sum(F.col(f"n{j}") * F.col(f"n{j}")).alias(f"q{j}") for j in range(len(known))])
        got = sizes.agg(*[F.sum(F.col(f"n{j}") * F.col(f"n{j}") - F.col(f"q{j}")) for j in range(len(known))]).collect()[0]
        least |= {(k, same): (got[j] or 0) // 2 for j, k in enumerate(known)}
    out = []
    for known in every:
        for same in (s for s in every if s <= known):
            n = sum((-1) ** (len(k - known) + len(s - same)) * least[k, s] for k in every if known <= k for s in every if same <= s <= known)
            if n:
                out.append((tuple(-1 if i not in known else int(i in same) for i in range(len(columns))), n))
    return sorted(out)


def estimate_u(records: DataFrame, comparisons: Sequence[Comparison], model: Model, max_pairs: int = 1_000_000, seed: int = 42, link_type: str = "link_and_dedupe") -> Model:
    """Level frequencies among random pairs: records are drawn by a seeded hash so that about ``max_pairs`` pairs arise.

    Drawn records are dealt to buckets and paired within each: random pairs by an equi-join, not a cross join. Tables of
    no more than ``max_pairs`` pairs are one bucket, so that all of their pairs count.
    """
    n = records.count()
    bucket = 256
    every = n * (n - 1) // 2 <= max_pairs
    drawn = 1.0 if every else min(1.0, max_pairs * 2 / max(1, n * bucket))
    columns = sorted({c for x in comparisons for c in x.columns})
    share = F.pmod(F.xxhash64("unique_id", F.lit(seed)), F.lit(SPAN)) < int(drawn * SPAN)
    buckets = 1 if every else max(1, round(n * drawn / bucket))
    base = records.select("unique_id", "source_dataset", *columns).where(share if drawn < 1 else F.lit(True))
    base = base.withColumn("_b", F.pmod(F.xxhash64("unique_id", F.lit(seed + 1)), F.lit(buckets)))
    left, right = base.alias("l"), base.alias("r")
    scope = " AND l.source_dataset <> r.source_dataset" if link_type == "link_only" else ""
    pairs = left.join(right, F.expr(f"l._b = r._b AND l.unique_id < r.unique_id{scope}")).select(*[F.col(f"{s}.{c}").alias(f"{c}_{s}") for c in columns for s in "lr"])
    counted = patterns(pairs, comparisons)
    u = {}
    for k, c in enumerate(comparisons):
        labels = c.labels()
        seen = {g: sum(x for p, x in counted if p[k] == g) for g in labels}
        total = sum(seen.values())
        u[c.name] = {labels[g]: (seen[g] / total if total else model.u[c.name][labels[g]]) for g in labels}
    return Model(model.prior, model.m, u, model.log)


def expectation_maximisation(counted: Sequence[tuple[tuple[int, ...], int]], comparisons: Sequence[Comparison], held_out: set[str], model: Model, max_iterations: int = 25, tolerance: float = 1e-4) -> tuple[Table, float, int, bool]:
    """(m, share of matches, iterations, converged) on pattern counts, with u fixed; ``held_out`` comparisons take no part."""
    use = [(k, c) for k, c in enumerate(comparisons) if c.name not in held_out]
    weight = np.array([x for _, x in counted], dtype=float)
    gamma = np.array([p for p, _ in counted], dtype=int).reshape(len(counted), len(comparisons))
    m = {c.name: np.array([model.m[c.name][c.labels()[g]] for g in range(len(c.levels) + 1)]) for _, c in use}
    u = {c.name: np.array([max(model.u[c.name][c.labels()[g]], 1e-10) for g in range(len(c.levels) + 1)]) for _, c in use}
    share, steps, done = 0.3, 0, False
    while steps < max_iterations and not done and len(counted):
        steps += 1
        odds = np.full(len(counted), math.log(share / (1 - share)))
        for k, c in use:
            g = gamma[:, k]
            odds += np.where(g >= 0, np.log(np.maximum(m[c.name], 1e-10))[g] - np.log(u[c.name])[g], 0.0)
        match = weight / (1 + np.exp(-np.clip(odds, -500, 500)))
        new = min(max(match.sum() / weight.sum(), 1e-9), 1 - 1e-9)
        change = abs(new - share)
        share = new
        for k, c in use:
            g = gamma[:, k]
            got = np.bincount(g[g >= 0], weights=match[g >= 0], minlength=len(c.levels) + 1)
            if got.sum() > 0:
                got = got / got.sum()
                change = max(change, float(np.abs(got - m[c.name]).max()))
                m[c.name] = got
        done = change < tolerance
    return {c.name: {c.labels()[g]: float(m[c.name][g]) for g in range(len(c.levels) + 1)} for _, c in use}, share, steps, done


def estimate_m(records: DataFrame, rules: Sequence, comparisons: Sequence[Comparison], model: Model, link_type: str = "link_and_dedupe", max_iterations: int = 25) -> Model:
    """One round of EM a training rule; comparisons that use the rule's columns are held out. m is the mean over the rounds that trained it."""
    trained: dict[str, list[dict[str, float]]] = {}
    log = []
    for rule in usable_rules(rules, records.columns):
        held_out = {c.name for c in comparisons if set(c.columns) & rule_columns(rule)}
        used = [c for c in comparisons if c.name not in held_out] or comparisons
        counted = block_patterns(records, rule, used, link_type)
        m, share, steps, done = expectation_maximisation(counted, used, held_out, model, max_iterations)
        log.append({"rule": rule.description, "pairs": sum(x for _, x in counted), "iterations": steps, "converged": done, "match_share": share, "held_out": sorted(held_out)})
        if counted:
            for name, levels in m.items():
                trained.setdefault(name, []).append(levels)
    out = {c: {k: float(np.mean([t[k] for t in trained[c]])) if c in trained else p for k, p in levels.items()} for c, levels in model.m.items()}
    return Model(model.prior, out, model.u, [*model.log, *log])


def term_frequencies(records: DataFrame, column: str) -> DataFrame:
    """``value, tf``: share of the non-null rows that hold each value."""
    counts = records.where(F.col(column).isNotNull()).groupBy(F.col(column).alias("value")).agg(F.count(F.lit(1)).alias("n"))
    total = records.agg(F.count(column).alias("total"))
    return counts.join(F.broadcast(total)).select("value", (F.col("n") / F.col("total")).alias("tf"))


def weight(comparison: Comparison, model: Model) -> Column:
    """Bits of evidence of a gamma; null levels have none."""
    g = F.col(f"gamma_{comparison.name}")
    out = F.when(g == -1, F.lit(0.0))
    for k, label in comparison.labels().items():
        out = out.when(g == k, F.lit(math.log2(model.m[comparison.name][label] / model.u[comparison.name][label])))
    return out


def score(pairs: DataFrame, comparisons: Sequence[Comparison], model: Model, records: DataFrame | None = None) -> DataFrame:
    """``pairs`` with gamma and bf columns, ``match_weight`` and ``match_probability``.

    Frequency-adjusted levels gain log2(u / the value's own frequency), by a join on the value; both sides are equal
    there, so one lookup a column does.
    """
    out = gammas(pairs, list(comparisons))
    total = F.lit(math.log2(model.prior / (1 - model.prior)))
    for c in comparisons:
        out = out.withColumn(f"bf_{c.name}", F.pow(F.lit(2.0), weight(c, model)))
        total = total + weight(c, model)
        for i, level in enumerate(c.levels):
            if level.tf and records is not None:
                at = len(c.levels) - i
                table = term_frequencies(records, level.tf).select(F.col("value").alias(f"_v_{c.name}"), F.col("tf").alias(f"_tf_{c.name}"))
                hit = F.when(F.col(f"gamma_{c.name}") == at, F.col(f"{level.tf}_l"))
                # pairs without the level have keys of their own that are no value, so that they are spread over tasks
                hit = F.coalesce(hit, F.concat(F.lit("\0"), F.xxhash64("unique_id_l", "unique_id_r").cast("string")))
                out = out.withColumn(f"_k_{c.name}", hit).join(table, F.col(f"_k_{c.name}") == F.col(f"_v_{c.name}"), "left")
                gain = F.coalesce(F.log2(F.lit(model.u[c.name][level.label]) / F.col(f"_tf_{c.name}")), F.lit(0.0))
                out = out.withColumn(f"_a_{c.name}", gain).drop(f"_k_{c.name}", f"_v_{c.name}", f"_tf_{c.name}")
                total = total + F.col(f"_a_{c.name}")
    out = out.withColumn("match_weight", total).drop(*[f"_a_{c.name}" for c in comparisons])
    return out.withColumn("match_probability", 1 / (1 + F.pow(F.lit(2.0), -F.col("match_weight"))))


def predict(records: DataFrame, rules: Sequence, comparisons: Sequence[Comparison], model: Model, threshold: float, link_type: str = "link_and_dedupe", retain: Sequence[str] = ()) -> DataFrame:
    """Scored candidates from ``threshold`` up, with the compared and retained columns of both sides."""
    columns = list(dict.fromkeys([*(c for x in comparisons for c in x.columns), *retain]))
    scored = score(candidate_pairs(records, rules, link_type, columns), comparisons, model, records)
    return scored.where(F.col("match_probability") >= threshold)


def parameter_rows(model: Model) -> list[dict]:
    """A row a level: m, u and the weight in bits."""
    return [{"comparison": c, "level": k, "m": p, "u": model.u[c][k], "weight_bits": math.log2(p / model.u[c][k]) if p > 0 and model.u[c][k] > 0 else None} for c, levels in model.m.items() for k, p in levels.items()]
