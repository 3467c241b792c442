import pytest

from weldrow.config import ColumnMapping, SchemaMapping
from weldrow.ingest import CallLog, LookupCache, MockClient, ProposedColumn, Proposal, ValueBatch, default_redactor, detect_shapes, extract_identifiers, prematch, propose_mapping, standardize_values
from weldrow.profiles import PROVIDER
from weldrow.sources.knowledge import KnowledgeBase
from weldrow.sources.reference import Registry, ZipCentroids
from weldrow.sources.tables import apply_mapping, file_snapshot_id, read_table


def test_read_table_keeps_text(spark, tmp_path):
    (tmp_path / "a.csv").write_text("id,zip,state\n1,01234,NA\n2,,IL\n")
    rows = read_table(spark, tmp_path / "a.csv").orderBy("id").collect()
    assert rows[0].zip == "01234" and rows[0].state == "NA" and rows[1].zip is None
    assert len(file_snapshot_id(tmp_path / "a.csv")) == 16


def test_mapping_guards(spark):
    raw = spark.createDataFrame([("1", "x"), ("1", "y")], "id string, n string")
    ok = SchemaMapping(source="s", profile="provider", status="approved", columns=[ColumnMapping(source_column="n", target="name")])
    for mapping, why in ((ok, "repeat"), (ok.model_copy(update={"status": "proposed"}), "approved"), (ok.model_copy(update={"columns": [ColumnMapping(source_column="zz", target="name")]}), "missing"), (ok.model_copy(update={"columns": [ColumnMapping(source_column="n", target="zz")]}), "not in profile")):
        with pytest.raises(ValueError, match=why):
            apply_mapping(raw, mapping, "s", "id", PROVIDER)


def test_registry_and_centroids(spark, tmp_path):
    (tmp_path / "n.csv").write_text("NPI,Entity Type Code,Provider First Name,Provider Business Practice Location Address Postal Code\n1234567893,1,ANN,606011234\n1234567893,2,BOB,1\n1234567890,1,CY,2\n")
    rows = Registry(spark, tmp_path / "n.csv").load().collect()
    assert len(rows) == 1 and rows[0]["first"] == "ANN" and rows[0].zip == "60601" and rows[0].entity_type == 1
    (tmp_path / "z.txt").write_text("GEOID\tINTPTLAT\tINTPTLONG \n601\t1.5\t2.5\n00601\t3.5\t4.5\n7\tx\t1\n8\t\t1\n")
    got = {r.zip5: (r.lat, r.lon) for r in ZipCentroids(spark, tmp_path / "z.txt").load().collect()}
    assert got == {"00601": (3.5, 4.5), "00008": (None, 1.0)}
    assert Registry(spark, tmp_path / "n.csv").snapshot().n_rows == 1


def test_knowledge_base(spark, tmp_path):
    kb = KnowledgeBase(spark, f"file://{tmp_path}/kb")
    assert kb.read("model_params") is None and kb.m_probabilities("p", "h", "e") == {}
    kb.save_model_params({"c": {"exact": 0.8}}, "p", "h", "e1", ["roster"], "generic")
    kb.save_model_params({"c": {"exact": 0.6}}, "p", "h", "e2", ["claims"], "client_scoped")
    assert kb.m_probabilities("p", "h", "e1") == {"c": {"exact": 0.8}}
    assert kb.m_probabilities("p", "h", "e3") == {}
    assert kb.promote("model_params", "promoted", "ann", engagement="e1") == 1
    assert kb.promote("model_params", "reviewed", "ann", engagement="e1") == 0
    assert kb.m_probabilities("p", "h", "e3") == {"c": {"exact": 0.8}}
    before = kb.version()
    mapping = SchemaMapping(source="s", profile="p", status="approved")
    assert kb.register_mapping(mapping, "e1") and not kb.register_mapping(mapping, "e1")
    assert kb.version() != before and kb.approved_mappings("p", "e1")[0].source == "s"
    pairs = spark.createDataFrame([("secret", 1, -1)], "name_l string, gamma_a int, gamma_b int")
    assert kb.add_labeled_pairs(pairs, 1, "rule", "p", "h", "e1") == 1
    assert "name_l" not in kb.read("labeled_pairs").columns
    info = {"source": "nppes", "snapshot_id": "x", "n_rows": 1}
    assert kb.register_snapshot(info, "e1") and not kb.register_snapshot(info, "e2")
    assert kb.record_run({"edges": 1}, "e1") and kb.status().count() == 7
    with pytest.raises(ValueError):
        kb.promote("model_params", "promoted", "", engagement="e1")


def test_shapes_and_prematch(spark):
    rows = [("1234567893", "jo@x.org", "312-555-0100", "60601", str(i)) for i in range(6)]
    raw = spark.createDataFrame(rows, "a string, b string, c string, d string, npi string")
    assert {c: s for c, (s, _) in detect_shapes(raw).items()} == {"a": "npi", "b": "email", "c": "phone", "d": "zip"}
    found, left = prematch(raw, PROVIDER)
    assert found["npi"].target == "npi" and found["npi"].confidence == 0.99 and "a" in left and found["d"].target == "address_zip"


def test_propose_mapping_redacts_and_guards(spark, tmp_path):
    raw = spark.createDataFrame([("7", "Ann", "x")], "id string, given_nm string, mystery string")
    seen = {}

    def spy(payload):
        seen.update(payload)
        return {"columns": [{"source_column": "given_nm", "target": "name_first", "confidence": 0.8}, {"source_column": "mystery", "target": "no_such", "confidence": 0.9}]}

    log = CallLog(tmp_path)
    out = propose_mapping(raw, "s", PROVIDER, MockClient({"schema_mapping": spy}), "id", redact_columns=["given_nm"], log=log)
    assert out.status == "proposed" and out.as_dict() == {"given_nm": "name_first"} and out.unmapped == ["mystery"]
    assert seen["columns"][0]["sample"] == ["Aaa"] and log.read()[0]["task"] == "schema_mapping"
    scripted = MockClient(script=[Proposal(columns=[ProposedColumn(source_column="given_nm", target="name_last", confidence=1)])])
    assert propose_mapping(raw, "s", PROVIDER, scripted, "id").as_dict() == {"given_nm": "name_last"}
    assert default_redactor(["a"])("b", "X1") == "X1"


def test_standardize_values_and_identifiers(spark, tmp_path):
    cache = LookupCache(KnowledgeBase(spark, f"file://{tmp_path}/kb"), "lookup_titles", "e1")
    values = spark.createDataFrame([("Doctr",), ("RN",), ("doctr",), (None,)], "t string")
    answers = lambda p: {"mappings": [{"value": "DOCTR", "target": "PHYSICIAN", "confidence": 0.9}, {"value": "OTHER", "target": "PHYSICIAN"}]}
    out = standardize_values(values, "title", MockClient({"titles": answers}), cache)
    assert (out["distinct"], out["builtin"], out["added"]) == (2, 1, 1) and out["rejected"][0]["reason"] == "unknown_value"
    assert cache.save() == 1 and cache.lookup() == {"DOCTR": "PHYSICIAN"}
    again = standardize_values(values, "title", MockClient(), cache)
    assert again["cached"] == 1 and again["added"] == 0
    bad = lambda p: {"mappings": [{"value": v, "target": "1234567"} for v in p["values"]]}
    assert standardize_values(spark.createDataFrame([("Acme",)], "o string"), "org", MockClient({"org_aliases": bad}), cache)["rejected"][0]["reason"] == "identifier_like"
    assert [c["value"] for c in extract_identifiers("npi 1234567893 or 1234567890", MockClient())] == ["1234567893"]
    assert ValueBatch().mappings == []


def test_quoted_cells_hold_line_breaks(spark, tmp_path):
    from weldrow.sources.tables import read_table

    (tmp_path / "t.csv").write_text('id,name\n1,"Mercy\nHospital ""West"""\n2,NA\n', encoding="utf-8")
    assert [tuple(r) for r in read_table(spark, tmp_path / "t.csv").orderBy("id").collect()] == [("1", 'Mercy\nHospital "West"'), ("2", "NA")]


def test_entry_point_leaves_out_what_cannot_be_imported():
    import subprocess
    import sys
    from pathlib import Path

    code = "import sys; sys.modules['xxhash'] = None; import __spark_entry__ as e; q = e.queries(); assert 'pipeline' not in q and 'crosswalk' in q and not any(k.startswith('op') for k in q), q"
    said = subprocess.run([sys.executable, "-c", code], cwd=Path(__file__).parent.parent, capture_output=True, text=True, timeout=120, check=False)
    assert said.returncode == 0, said.stderr


def test_configuration_file_round_trip(tmp_path):
    import pytest

    from weldrow.config import EngagementConfig, LLMConfig, OutputConfig

    (tmp_path / "empty.yaml").write_text("")
    with pytest.raises(ValueError, match="engagement"):
        EngagementConfig.load(tmp_path / "empty.yaml")
    for bad in ({"sample_rows": 201}, {"max_distinct_values_per_call": 501}, {"provider": "other"}, {"unknown": 1}):
        with pytest.raises(ValueError):
            LLMConfig(**bad)
    (tmp_path / "run.yaml").write_text("engagement: {id: a-1}\nsources: [{name: s, path: s.csv, record_id_column: id}]\n")
    config = EngagementConfig.load(tmp_path / "run.yaml")
    assert config.profile == "provider" and config.llm.standardize_titles and config.llm.standardize_org_aliases
    assert config.resolve(config.sources[0].path) == tmp_path / "s.csv"
    saved = config.save(tmp_path / "other" / "run.yaml")
    assert "config_dir" not in saved.read_text() and EngagementConfig.load(saved).config_dir == saved.parent
    assert OutputConfig().dir is not None and LLMConfig().redact_columns is not LLMConfig().redact_columns
