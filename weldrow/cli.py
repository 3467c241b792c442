"""Command line: ``python -m weldrow.cli <verb>``, or the same file for spark-submit."""

from __future__ import annotations

import argparse
import json
from pathlib import Path

from pyspark.sql import SparkSession

from weldrow import report
from weldrow.config import EngagementConfig
from weldrow.ingest import LookupCache, MockClient, propose_mapping, standardize_values
from weldrow.plans import evaluation as P
from weldrow.plans.linkage import run_linkage
from weldrow.profiles import get_profile
from weldrow.sources.knowledge import TABLES, KnowledgeBase
from weldrow.sources.tables import load_source, read_table
from weldrow.synth import SyntheticConfig, generate


def build_parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="weldrow")
    verbs = p.add_subparsers(dest="verb", required=True)
    s = verbs.add_parser("generate-synthetic")
    s.add_argument("--out", required=True)
    s.add_argument("--n-entities", type=int, default=1000)
    s.add_argument("--seed", type=int, default=SyntheticConfig.seed)
    for name in ("run", "evaluate", "tune"):
        s = verbs.add_parser(name)
        s.add_argument("--config", required=True)
        s.add_argument("--out")
        if name == "evaluate":
            s.add_argument("--truth", required=True)
            s.add_argument("--baseline-threshold", type=float, default=85.0)
            s.add_argument("--no-baselines", action="store_true", help="leave out the all-pairs yardsticks, which are quadratic")
            s.add_argument("--tune-seed", type=int, help="tune the thresholds on synthetic data of this seed first")
            s.add_argument("--tune-entities", type=int, default=1000)
            s.add_argument("--ablate-nppes", action="store_true", help="also run without the registry's columns")
            s.add_argument("--write-kb", action="store_true")
        if name == "tune":
            s.add_argument("--seed", type=int, required=True)
            s.add_argument("--n-entities", type=int, default=1000)
    s = verbs.add_parser("propose-mapping")
    for a in ("--source", "--path", "--profile", "--out"):
        s.add_argument(a, required=True)
    s.add_argument("--record-id")
    s.add_argument("--redact", nargs="*", default=[])
    s = verbs.add_parser("standardize-values")
    s.add_argument("--config", required=True)
    s.add_argument("--kind", choices=("title", "org"), required=True)
    s = verbs.add_parser("kb")
    s.add_argument("action", choices=("status", "list", "promote"))
    s.add_argument("--path", required=True)
    s.add_argument("--table", choices=TABLES)
    s.add_argument("--engagement")
    s.add_argument("--to", default="reviewed")
    s.add_argument("--reviewer", default="")
    return p


def _evaluate(spark: SparkSession, a: argparse.Namespace, config: EngagementConfig, kb: KnowledgeBase, out: Path) -> P.Evaluation:
    if a.tune_seed is not None:
        tuned = P.tune_thresholds(spark, config, a.tune_seed, a.tune_entities, out / "tuning", kb)
        config.thresholds = tuned.thresholds(config.thresholds.review_lower)
        tuned.save(out / "thresholds.json")
    truth = read_table(spark, a.truth)
    result = run_linkage(spark, config, knowledge_base=kb, kb_write=a.write_kb)
    done = P.evaluate(result, truth, config.thresholds, {} if a.no_baselines else P.fuzzy_baselines(result, truth, a.baseline_threshold))
    if a.ablate_nppes:
        bare = config.model_copy(deep=True)
        bare.reference.enrich_from_nppes = False
        other = P.evaluate(run_linkage(spark, bare, knowledge_base=kb, kb_write=False), truth, bare.thresholds)
        done.ablations = [{**r, "method": f"{r['method']}, no registry"} for r in other.summary()]
    return done


def main(argv: list[str] | None = None) -> int:
    a = build_parser().parse_args(argv)
    spark = SparkSession.builder.appName("weldrow").getOrCreate()
    if a.verb == "generate-synthetic":
        print(json.dumps(generate(spark, SyntheticConfig(n_entities=a.n_entities, seed=a.seed)).write(a.out)))
        return 0
    if a.verb == "propose-mapping":
        out = propose_mapping(read_table(spark, a.path), a.source, get_profile(a.profile), MockClient(), a.record_id, redact_columns=a.redact)
        print(out.save(a.out))
        return 0
    if a.verb == "kb":
        kb = KnowledgeBase(spark, a.path)
        if a.action == "status":
            kb.status().show(truncate=False)
        elif a.action == "list":
            rows = kb.read(a.table)
            print("empty" if rows is None else rows.limit(50).toPandas().to_string())
        else:
            print(kb.promote(a.table, a.to, a.reviewer, a.engagement))
        return 0
    config = EngagementConfig.load(a.config)
    kb = KnowledgeBase(spark, config.resolve(config.knowledge_base.path))
    if a.verb == "standardize-values":
        profile = get_profile(config.profile)
        wanted = "job_title" if a.kind == "title" else "org_name"
        names = [n for n, s in profile.fields.items() if s.field_type == wanted]
        cache = LookupCache(kb, "lookup_titles" if a.kind == "title" else "lookup_org_aliases", config.engagement.id, config.knowledge_base.use_promoted_only)
        for source in config.sources:
            frame = load_source(spark, source, config, profile)
            for n in names:
                print(source.name, n, standardize_values(frame.select(n), a.kind, MockClient(), cache, config.llm.max_distinct_values_per_call))
        cache.save()
        return 0
    out = Path(a.out or config.resolve(config.output.dir))
    out.mkdir(parents=True, exist_ok=True)
    if a.verb == "tune":
        tuned = P.tune_thresholds(spark, config, a.seed, a.n_entities, out / "tuning", kb)
        print(tuned.save(out / "thresholds.json"))
        return 0
    if a.verb == "evaluate":
        done = _evaluate(spark, a, config, kb, out)
        done.write(out)
        print(json.dumps({"methods": done.summary(), "cluster": done.cluster}, default=str))
        return 0
    result = run_linkage(spark, config, knowledge_base=kb)
    result.write(out)
    report.explanation(result, out / "explanation.html", config.output.explanation_sample_pairs)
    print(json.dumps(result.stats, default=str))
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
