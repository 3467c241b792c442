"""A whole run on synthetic tables: files, mappings, registry, knowledge base, evaluation and tuning."""

import json

import pytest
from pyspark.sql import functions as F

from weldrow.config import EngagementConfig, SchemaMapping
from weldrow.ingest import LookupCache
from weldrow.plans import evaluation as P
from weldrow.plans.linkage import lookup_effect, run_linkage
from weldrow.sources.knowledge import KnowledgeBase
from weldrow.sources.tables import read_table
from weldrow.synth import SyntheticConfig, generate

ROSTER = {"Provider Name": "name", "NPI": "npi", "Practice Name": "org", "Practice Address": "address", "Phone": "phone", "Email": "email", "Job Title": "title", "Tax ID": "ein"}
CLAIMS = {"prov_first_name": "name_first", "prov_middle": "name_middle", "prov_last_name": "name_last", "rendering_npi": "npi", "billing_org": "org", "billing_ein": "ein", "addr_line1": "address_street", "city": "address_city", "state": "address_state", "zip": "address_zip", "phone_number": "phone", "specialty": "title"}


@pytest.fixture(scope="module")
def engagement(spark, tmp_path_factory):
    """Files of 120 entities, a configuration for them, and a finished run that wrote its knowledge base."""
    home = tmp_path_factory.mktemp("engagement")
    paths = generate(spark, SyntheticConfig(n_entities=120, n_orgs=12, n_distractors=20, seed=7)).write(home / "data")
    sources = []
    for name, key, mapping in (("roster", "Provider ID", ROSTER), ("claims", "rendering_prov_id", CLAIMS)):
        SchemaMapping.model_validate({"source": name, "profile": "provider", "status": "approved", "columns": [{"source_column": c, "target": t} for c, t in mapping.items()]}).save(home / f"{name}.yaml")
        sources.append({"name": name, "path": paths[name], "record_id_column": key, "source_type": name, "mapping": f"{name}.yaml"})
    config = EngagementConfig.model_validate({
        "engagement": {"id": "small"}, "profile": "provider", "sources": sources, "matching": {"fields": {"title": {"role": "report_only"}}},
        "reference": {"nppes_path": paths["nppes_sample"], "zip_centroids_path": paths["zip_centroids"]}, "knowledge_base": {"path": "kb"}, "config_dir": str(home),
    })
    kb = KnowledgeBase(spark, home / "kb")
    cache = LookupCache(kb, "lookup_titles", "small")
    cache.add([("SURGEON", "OPERATING PHYSICIAN", 0.9)], "test", "someone")
    cache.save()
    return home, config, kb, paths, run_linkage(spark, config, knowledge_base=kb)


def test_run_reads_registry_and_lookups(engagement):
    _, _, kb, _, result = engagement
    assert result.stats["title_lookup_rows"] == 1 and result.stats["title_canonical_changed_by_lookup"] == result.records.where("title_canonical = 'OPERATING PHYSICIAN'").count() > 0
    assert result.records.where("nppes_found").count() > 0.5 * result.stats["records"]
    assert result.crosswalk.count() == result.stats["records"] and result.crosswalk.select("unique_id").distinct().count() == result.stats["records"]
    assert kb.read("reference_snapshots").count() == 1 and lookup_effect(result.records, {}, {}) == {}


def test_evaluation_against_baselines(spark, engagement, tmp_path):
    _, config, _, paths, result = engagement
    truth = read_table(spark, paths["truth"])
    got = P.evaluate(result, truth, config.thresholds, P.fuzzy_baselines(result, truth, 85.0))
    pipeline = got.methods[-1]
    assert pipeline.chosen["f1"] > 0.85 and got.cluster["precision"] > 0.95 and got.certain["precision"] == 1.0
    assert len(got.methods) == 3 and all(pipeline.best["f1"] > m.best["f1"] for m in got.methods[:-1] if m.name.startswith("fuzzy"))
    assert pipeline.best["f1"] == max(r["f1"] for r in pipeline.curve) and len(pipeline.curve) == len(P.PIPELINE_GRID)
    assert pipeline.residual_chosen["tp"] < pipeline.chosen["tp"] and 0 < got.blocking["blocking_recall"] <= 1
    files = got.write(tmp_path)
    assert "<svg" in files["html"].read_text() and "Missed pairs by noise" in files["markdown"].read_text() and len(got.summary()) == 7
    assert json.loads(files["json"].read_text())["certain"] == got.certain


def test_thresholds_tuned_on_other_data(spark, engagement, tmp_path):
    _, config, kb, _, _ = engagement
    before = kb.read("run_history").count()
    folder_config, truth = P.tuning_config(spark, config, 11, 60, tmp_path)
    result = run_linkage(spark, folder_config, knowledge_base=kb, kb_write=False)
    got = P.sweep(result, truth, config.thresholds.review_lower, grid=[0.5, 0.8, 0.9, 0.99])
    assert [r["threshold"] for r in got.auto_link_sweep] == [0.8, 0.9, 0.99] and kb.read("run_history").count() == before
    assert got.auto_link == min(got.auto_link_sweep, key=lambda r: (r["expected_cost_minutes"], r["threshold"]))["threshold"] <= got.cluster
    assert got.thresholds(0.5).cluster == got.cluster and got.save(tmp_path / "t.json").exists()
    assert truth.where(F.col("source").isin("roster", "claims")).count() == result.stats["records"]
    with pytest.raises(ValueError, match="review_lower"):
        P.sweep(result, truth, 0.95, grid=[0.5])
