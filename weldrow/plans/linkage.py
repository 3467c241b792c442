"""A linkage run: prepare, link for certain, train, score, constrain, cluster, publish."""

from __future__ import annotations

import hashlib
import json
import time
from collections.abc import Mapping
from dataclasses import dataclass, field, replace
from functools import reduce
from pathlib import Path
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weldrow.config import EngagementConfig
from weldrow.fields import FieldType, get_field_type
from weldrow.ingest import lookup_dependencies
from weldrow.operators import cluster as C
from weldrow.operators import model as M
from weldrow.operators.blocking import deterministic_pairs, usable_rules
from weldrow.operators.compare import Comparison
from weldrow.profiles import BlockingRule, EntityProfile, FieldSpec, get_profile
from weldrow.session import cut
from weldrow.sources.reference import Registry, ZipCentroids
from weldrow.sources.tables import load_source


def effective_fields(profile: EntityProfile, config: EngagementConfig) -> dict[str, FieldSpec]:
    """The profile's fields after the run's overrides; unknown names are refused."""
    if unknown := [n for n in config.matching.fields if n not in profile.fields]:
        raise ValueError(f"unknown fields in matching.fields: {', '.join(unknown)}")
    out = {}
    for n, spec in profile.fields.items():
        o = config.matching.fields.get(n)
        if o and o.exclude:
            continue
        changes = {k: v for k in ("role", "term_frequency", "include_phonetic") if o and (v := getattr(o, k)) is not None}
        out[n] = replace(spec, **changes)
    return out


def standardize(canonical: DataFrame, types: Mapping[str, FieldType]) -> DataFrame:
    return reduce(lambda df, nt: nt[1].apply(df, nt[0]), types.items(), canonical)


def build_comparisons(fields: Mapping[str, FieldSpec], types: Mapping[str, FieldType], geo: bool = False) -> list[Comparison]:
    return [c for n, s in fields.items() if s.role != "report_only" for c in types[n].comparisons(n, s.options(geo=geo))]


def has_coordinates(records: DataFrame) -> bool:
    columns = [c for c in records.columns if c.endswith("_lat")]
    return bool(columns) and not records.where(reduce(lambda a, b: a | b, [F.col(c).isNotNull() for c in columns])).isEmpty()


def _rules(given: list | None, default: list) -> list:
    return default if given is None else [BlockingRule(sql=r) if isinstance(r, str) else BlockingRule(tuple(r)) for r in given]


@dataclass
class LinkageResult:
    """Everything a run yields; the frames are cut from their lineage or cheap to recompute."""

    records: DataFrame
    predictions: DataFrame
    deterministic: DataFrame
    edges: DataFrame
    rejected: DataFrame
    conflicting: DataFrame
    membership: DataFrame
    split_log: DataFrame
    crosswalk: DataFrame
    review: DataFrame
    validation: DataFrame
    model: M.Model
    profile: EntityProfile
    comparisons: list[Comparison]
    stats: dict[str, Any] = field(default_factory=dict)

    def write(self, out_dir: str | Path) -> dict[str, Path]:
        """CSV for people, Parquet for programs, JSON for the model and the run's figures."""
        out = Path(out_dir)
        paths = {}
        for name in ("crosswalk", "review", "edges", "rejected", "conflicting", "split_log", "validation"):
            df: DataFrame = getattr(self, name)
            flat = [F.array_join(c, "|").alias(c) if t.startswith("array") else F.col(c) for c, t in df.dtypes]
            df.select(*flat).write.mode("overwrite").csv(str(out / f"{name}.csv"), header=True)
            paths[name] = out / f"{name}.csv"
        for name in ("predictions", "records"):
            getattr(self, name).write.mode("overwrite").parquet(str(out / f"{name}.parquet"))
            paths[name] = out / f"{name}.parquet"
        out.mkdir(parents=True, exist_ok=True)
        paths["model"] = self.model.save(out / "model.json")
        (out / "run_stats.json").write_text(json.dumps(self.stats, indent=2, sort_keys=True, default=str))
        return paths | {"stats": out / "run_stats.json"}


def cluster_at(edges: DataFrame, records: DataFrame, profile: EntityProfile, threshold: float, limits: C.ClusterQA) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(membership, split log, crosswalk) of the edges at or above ``threshold``."""
    strong = edges.where(F.col("match_probability") >= threshold)
    membership, log = C.split_violating_clusters(cut(C.cluster_edges(strong, records, threshold)), strong, records, profile.hard_constraints)
    return membership, log, cut(C.build_crosswalk(C.cluster_metrics(membership, strong, limits), records))


def lookup_effect(records: DataFrame, fields: Mapping[str, FieldSpec], deps: Mapping[str, Any]) -> dict[str, int]:
    """For each field that takes a lookup: its entries, and the records whose standard form they changed; one pass over the records."""
    takes = {"org_name": ("aliases", "clean"), "job_title": ("taxonomy", "canonical")}
    used = {n: takes[s.field_type] for n, s in fields.items() if s.field_type in takes and deps.get(takes[s.field_type][0])}
    if not used:
        return {}
    plain, counts = records.select(*used, *[F.col(f"{n}_{part}").alias(f"_held_{n}") for n, (_, part) in used.items()]), []
    for n, (_, part) in used.items():
        plain = get_field_type(fields[n].field_type).apply(plain, n)
        counts.append(F.count_if(~F.nullif(F.col(f"{n}_{part}"), F.lit("")).eqNullSafe(F.nullif(F.col(f"_held_{n}"), F.lit("")))).alias(f"{n}_{part}_changed_by_lookup"))
    return plain.agg(*counts).first().asDict() | {f"{n}_lookup_rows": len(deps[d]) for n, (d, _) in used.items()}


def link(records: DataFrame, profile: EntityProfile, fields: Mapping[str, FieldSpec], types: Mapping[str, FieldType], config: EngagementConfig, known_m: Mapping | None = None) -> LinkageResult:
    """From standardised records to the published tables."""
    began, mc, th = time.time(), config.matching, config.thresholds
    comparisons = build_comparisons(fields, types, has_coordinates(records))
    comparisons = [c for c in comparisons if set(c.columns) <= set(records.columns)]
    certain = cut(deterministic_pairs(records, profile.deterministic_rules, mc.link_type))
    model = M.start_model(comparisons)
    if known_m:
        model, _ = model.seeded(known_m)
    model.prior = mc.probability_two_random_records_match or M.estimate_prior(records, profile.deterministic_rules, mc.deterministic_rule_recall, mc.link_type)
    model = M.estimate_u(records, comparisons, model, int(mc.max_pairs_for_u), mc.random_seed, mc.link_type)
    model = M.estimate_m(records, _rules(mc.training_blocking_rules, profile.training_rules), comparisons, model, mc.link_type, mc.em_max_iterations)
    model, floored = model.floored(mc.probability_floor)
    shown = [f"{n}_{s}" for n, t in types.items() for s in t.outputs if not s.endswith("variants")]
    hard = [c.column for c in profile.hard_constraints]
    retain = [c for c in dict.fromkeys([*shown, *hard]) if c in records.columns]
    rules = _rules(mc.blocking_rules, profile.blocking_rules)
    predictions = cut(M.predict(records, rules, comparisons, model, th.review_lower, mc.link_type, retain))
    edges, rejected = C.build_edges(predictions, certain, profile.pair_constraints)
    edges, conflicting = C.split_conflicts(edges, records, profile.hard_constraints)
    edges = cut(edges)
    qa = config.cluster_qa
    limits = C.ClusterQA(profile.max_cluster_size if qa.max_cluster_size is None else qa.max_cluster_size, profile.min_edge_density if qa.min_edge_density is None else qa.min_edge_density)
    membership, log, crosswalk = cluster_at(edges, records, profile, th.cluster, limits)
    if config.reference.hub_link_via_nppes:
        crosswalk = C.hub_entity_ids(crosswalk)
    accepted = C.check_pairs(predictions, profile.pair_constraints).where(F.size("failed_constraints") == 0)
    review = C.review_queue(accepted, th.review_lower, th.auto_link, retain, rejected, "npi_std", config.output.rejected_audit_sample, mc.random_seed)
    validation = C.validation_summary(records, list(types))
    stats = {
        "records": records.count(), "candidates_scored": predictions.count(), "deterministic_pairs": certain.count(), "edges": edges.count(),
        "conflicting_edges": conflicting.count(), "rejected_pairs": rejected.count(), "entities": crosswalk.select("entity_id").distinct().count(),
        "edges_by_source": {r["link_source"]: r["count"] for r in edges.groupBy("link_source").count().collect()},
        "prior": model.prior, "probabilities_floored": floored, "rules_used": [r.description for r in usable_rules(rules, records.columns)],
        "config_hash": hashlib.sha256(config.model_dump_json().encode()).hexdigest()[:12], "runtime_seconds": round(time.time() - began, 2),
    }
    return LinkageResult(records, predictions, certain, edges, rejected, conflicting, membership, log, crosswalk, review, validation, model, profile, comparisons, stats)


def run_linkage(spark: SparkSession, config: EngagementConfig, dependencies: Mapping[str, Any] | None = None, knowledge_base=None, kb_write: bool = True) -> LinkageResult:
    """A whole run from configuration: sources, references, enrichment before any linking, linking, knowledge base."""
    profile = get_profile(config.profile)
    fields = effective_fields(profile, config)
    ref = config.reference
    deps = (lookup_dependencies(knowledge_base, config) if knowledge_base is not None else {}) | dict(dependencies or {})
    if ref.zip_centroids_path:
        deps["zip_centroids"] = ZipCentroids(spark, config.resolve(ref.zip_centroids_path)).frame
    narrowed = profile.with_fields(fields)
    types = narrowed.instantiate(deps)
    frames = [load_source(spark, s, config, profile) for s in config.sources]
    person = profile.entity_kind == "person"
    registry = Registry(spark, config.resolve(ref.nppes_path)) if ref.nppes_path else None
    if registry and ref.hub_link_via_nppes:
        frames.append(registry.hub_frame(profile.canonical_columns(), 1 if person else 2))
    records = standardize(reduce(DataFrame.unionByName, frames), types)
    if registry and ref.enrich_from_nppes and "npi" in fields:
        records = registry.enrich(records, "npi_std", person)
    records = cut(records)
    source_types = [s.source_type for s in config.sources if s.source_type]
    known = None
    if knowledge_base is not None and config.matching.load_m_from_knowledge_base:
        known = knowledge_base.m_probabilities(profile.name, narrowed.schema_hash(), config.engagement.id, source_types, config.knowledge_base.use_promoted_only)
    result = link(records, narrowed, fields, types, config, known)
    result.stats |= lookup_effect(records, fields, deps)
    if knowledge_base is not None and kb_write:
        if config.matching.save_m_to_knowledge_base:
            knowledge_base.save_model_params(result.model.m, profile.name, narrowed.schema_hash(), config.engagement.id, source_types, config.engagement.reuse_scope)
        vectors = result.deterministic.select("unique_id_l", "unique_id_r").join(result.predictions, ["unique_id_l", "unique_id_r"])
        knowledge_base.add_labeled_pairs(vectors, 1, "deterministic_rule", profile.name, narrowed.schema_hash(), config.engagement.id, config.engagement.reuse_scope)
        knowledge_base.record_run(result.stats, config.engagement.id)
        if registry:
            knowledge_base.register_snapshot(registry.snapshot().as_dict(), config.engagement.id)
    return result
