import json

import pytest
from pyspark.sql import functions as F

from weldrow.catalog import document_members
from weldrow.config import ClusterQAConfig, EngagementConfig, SchemaMapping, SourceConfig, Thresholds
from weldrow.fields import FieldType, get_field_type, list_field_types, register_field_type
from weldrow.operators import cluster as C
from weldrow.operators import model as M
from weldrow.operators.blocking import candidate_pairs
from weldrow.operators.components import connected_components
from weldrow.profiles import ORGANIZATION, PROVIDER, BlockingRule, HardConstraint, PairConstraint, get_profile, list_profiles, register_profile

EDGES = "unique_id_l string, unique_id_r string, match_probability double"


def test_registries():
    assert set(list_field_types()) == {"person_name", "org_name", "address", "npi", "ein", "phone", "email_domain", "job_title"}
    assert set(list_profiles()) == {"provider", "organization"}
    with pytest.raises(ValueError, match="already"):
        register_profile(PROVIDER)
    with pytest.raises(ValueError, match="already"):

        @register_field_type
        class Again(FieldType):
            name = "phone"

    with pytest.raises(KeyError):
        get_profile("nobody")
    with pytest.raises(ValueError):
        BlockingRule()


def test_blocking_columns_exist():
    for p in (PROVIDER, ORGANIZATION):
        made = {f"{n}_{s}" for n, t in p.instantiate().items() for s in t.outputs}
        for r in [*p.blocking_rules, *p.training_rules]:
            from weldrow.operators.blocking import rule_columns

            assert rule_columns(r) <= made


def test_config_is_strict():
    with pytest.raises(ValueError):
        Thresholds(auto_link=0.4)
    with pytest.raises(ValueError):
        ClusterQAConfig(max_cluster_size=1)
    source = SourceConfig(name="a", path="a.csv", record_id_column="id")
    with pytest.raises(ValueError):
        EngagementConfig(engagement={"id": "x"}, profile="provider", sources=[source, source])
    with pytest.raises(ValueError):
        EngagementConfig(engagement={"id": "x"}, profile="provider", sources=[source], matching={"link_type": "link_only"})
    with pytest.raises(ValueError):
        SchemaMapping(source="a", profile="p", columns=[{"source_column": "x", "target": "npi"}, {"source_column": "y", "target": "npi"}])


def test_person_field(spark):
    df = spark.createDataFrame([("Bill O'Brien",), (None,), ("12345",)], "name string")
    got = get_field_type("person_name").apply(df, "name").collect()
    assert got[0].name_first_std == "BILL" and got[0].name_last_std == "O BRIEN" and "WILLIAM" in got[0].name_first_variants and got[0].name_valid
    assert got[1].name_invalid_reason == "missing" and got[1].name_first_std is None
    assert got[2].name_invalid_reason == "no_letters"
    parts = spark.createDataFrame([("Bob", "J", "Smith MD")], "name_first string, name_middle string, name_last string")
    row = get_field_type("person_name").apply(parts, "name").first()
    assert (row.name_first, row.name_last, row.name_credential, row.name_middle_initial) == ("Bob", "Smith", "MD", "J")
    with pytest.raises(KeyError):
        get_field_type("phone").apply(df, "phone")


def test_address_and_title_fields(spark):
    df = spark.createDataFrame([("5 Elm Street Apt 2, Albany, NY 12207",), ("1 Main St, Nowhere, ZZ 123",)], "address string")
    got = get_field_type("address").apply(df, "address").collect()
    assert got[0].address_full_std == "5 ELM ST ALBANY NY 12207" and got[0].address_valid
    title = get_field_type("job_title", taxonomy={"WIZARD": "MAGICIAN"}).apply(spark.createDataFrame([("Wizard",)], "title string"), "title").first()
    assert title.title_canonical == "MAGICIAN"
    centroids = spark.createDataFrame([("12207", 42.65, -73.75)], "zip5 string, lat double, lon double")
    row = get_field_type("address", zip_centroids=centroids).apply(df, "address").first()
    assert row.address_lat == 42.65


def test_components(spark):
    edges = [(f"n{i:03}", f"n{i + 1:03}") for i in range(0, 60)] + [("x", "y"), ("y", "x"), ("z", "z"), (None, "q")]
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(edges, "a string, b string"), "a", "b").collect()}
    assert {got[f"n{i:03}"] for i in range(61)} == {"n000"} and got["y"] == "x" and "z" not in got and "q" not in got
    assert connected_components(spark.createDataFrame([], "a long, b long"), "a", "b").count() == 0


def test_pair_constraint_and_edges(spark):
    preds = spark.createDataFrame([("b", "a", 0.9, 0, 0), ("a", "c", 0.8, 2, -1)], "unique_id_l string, unique_id_r string, match_probability double, gamma_first int, gamma_last int")
    det = spark.createDataFrame([("c", "a")], "unique_id_l string, unique_id_r string")
    edges, rejected = C.build_edges(preds, det, [PairConstraint(("first", "last"), "names")])
    assert [tuple(r) for r in edges.collect()] == [("a", "c", 1.0, "both")]
    row = rejected.first()
    assert row.rejection_reason == "pair_constraint: names" and row.failed_constraints == ["names"]
    assert C.check_pairs(preds, [PairConstraint(("other",))]).where("size(failed_constraints) > 0").isEmpty()


def test_conflicting_edges(spark):
    edges = spark.createDataFrame([("a", "b", 0.9), ("b", "c", 0.9)], EDGES)
    recs = spark.createDataFrame([("a", "1"), ("b", "2"), ("c", None)], "unique_id string, npi string")
    kept, dropped = C.split_conflicts(edges, recs, [HardConstraint("npi")])
    assert kept.count() == 1 and dropped.first().unique_id_r == "b"


@pytest.mark.parametrize("most", [C.IN_TASK, 0])
def test_split_reaches_over_hops_and_breaks_ties(spark, most):
    member = spark.createDataFrame([(x, "a") for x in "abcdefg"], "unique_id string, cluster_id string")
    edges = spark.createDataFrame([("a", "b", 0.9), ("b", "c", 0.8), ("d", "e", 0.7), ("a", "e", 0.7), ("d", "f", 0.99), ("a", "d", 0.5)], EDGES)
    recs = spark.createDataFrame([("a", "1"), ("d", "2"), *[(x, None) for x in "bcefg"]], "unique_id string, npi string")
    out, log = C.split_violating_clusters(member, edges, recs, [HardConstraint("npi")], most)
    got = {r.unique_id: r.cluster_id for r in out.collect()}
    assert got == {"a": "a#1", "b": "a#1", "c": "a#1", "d": "a#2", "e": "a#1", "f": "a#2", "g": "a#g"}
    row = log.first()
    assert (row.n_records, row.n_subclusters, row.n_multi_hop_assignments, row.n_ties, row.n_singletons) == (7, 3, 1, 1, 1)


def test_documents_are_linked_by_whole_texts(spark):
    words = [f"w{i}" for i in range(200)]
    body, other = " ".join(words), " ".join(f"v{i}" for i in range(200))
    head = "one opening that a hundred pages share word for word before anything of their own"
    rows = [(1, body), (2, f"{body} end"), (3, body.upper() + "!"), (4, f"{head} {other}"), (5, f"{head} {body}"), (6, None), (7, "..."), (8, " ".join(reversed(words))), (9, f"{body} w1"), (10, "")]
    got = {r.doc_id: r.cluster_id for r in document_members(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {1: 1, 2: 2, 3: 1, 4: 4, 5: 5, 6: 6, 7: 7, 8: 1, 9: 9, 10: 10}


@pytest.mark.parametrize(("hops", "most"), [(150, C.IN_TASK), (6, 0)])
def test_split_follows_chains_of_any_length(spark, hops, most):
    names = [f"r{i:03d}" for i in range(1, hops + 1)]
    chain = ["a", *names]
    member = spark.createDataFrame([(x, "a") for x in [*chain, "z"]], "unique_id string, cluster_id string")
    edges = spark.createDataFrame([*[(x, y, 0.9) for x, y in zip(chain, names, strict=False)], ("a", "z", 0.6)], EDGES)
    recs = spark.createDataFrame([("a", "1"), ("z", "2"), *[(x, None) for x in names]], "unique_id string, npi string")
    out, log = C.split_violating_clusters(member, edges, recs, [HardConstraint("npi")], most)
    got, row = out.collect(), log.first()
    assert {r.unique_id: r.cluster_id for r in got} == {**dict.fromkeys(chain, "a#1"), "z": "a#2"}
    assert row.n_singletons == 0 and row.passes == hops


def test_cluster_metrics_flags(spark):
    member = spark.createDataFrame([("a", "a"), ("b", "a"), ("c", "a"), ("z", "z")], "unique_id string, cluster_id string")
    edges = spark.createDataFrame([("a", "b", 0.99), ("b", "c", 0.96)], EDGES)
    got = {r.unique_id: r for r in C.cluster_metrics(member, edges, C.ClusterQA(2, 0.9)).collect()}
    assert got["a"].flags == "oversized|low_density" and got["z"].flags == "singleton" and got["z"].edge_density == 1.0
    assert got["c"].record_attachment == 0.96 and got["a"].cluster_confidence == 0.96 and got["z"].cluster_confidence is None


def test_model_round_trip(tmp_path):
    m = M.Model(0.1, {"c": {"exact": 1.0, "all other": 0.0}}, {"c": {"exact": 0.0, "all other": 1.0}})
    floored, n = m.floored(1e-3)
    assert n == 4 and floored.m["c"]["exact"] == 0.999
    assert M.Model.load(floored.save(tmp_path / "m.json")) == floored
    seeded, k = m.seeded({"c": {"exact": 0.7}})
    assert k == 1 and seeded.m["c"]["exact"] == 0.7 and seeded.u == m.u
    assert json.loads(json.dumps(M.parameter_rows(floored)))[0]["weight_bits"] > 0


def test_expectation_maximisation_finds_known_parameters():
    import numpy as np

    from weldrow.operators.compare import Comparison, Level

    rng = np.random.default_rng(1)
    comps = [Comparison(f"c{k}", (f"c{k}",), None, (Level("exact", None),)) for k in range(4)]
    match = rng.random(40_000) < 0.2
    g = np.where(match[:, None], rng.random((40_000, 4)) < 0.9, rng.random((40_000, 4)) < 0.1).astype(int)
    patterns, counts = np.unique(g, axis=0, return_counts=True)
    model = M.start_model(comps)
    for c in comps:
        model.u[c.name] = {"exact": 0.1, "all other": 0.9}
    m, share, steps, done = M.expectation_maximisation([(tuple(p), int(n)) for p, n in zip(patterns, counts)], comps, set(), model, 100)
    assert done and abs(share - 0.2) < 0.01 and all(abs(m[c.name]["exact"] - 0.9) < 0.02 for c in comps)


def test_review_queue_reasons(spark):
    schema = "unique_id_l string, unique_id_r string, match_probability double, match_weight double, npi_std_l string, npi_std_r string"
    preds = spark.createDataFrame([("a", "b", 0.6, 1.0, None, None), ("a", "c", 0.95, 5.0, None, None)], schema)
    rejected = spark.createDataFrame([("d", "e", 0.7, 2.0, "1", "1"), ("d", "f", 0.7, 2.0, "1", None)], schema)
    got = {(r.unique_id_l, r.unique_id_r): r.review_reason for r in C.review_queue(preds, 0.5, 0.9, ["npi_std"], rejected, "npi_std", 5, 1).collect()}
    assert got == {("a", "b"): "score_band", ("d", "e"): "same_npi_name_conflict", ("d", "f"): "rejected_audit_sample"}


def test_hub_ids(spark):
    cw = spark.createDataFrame([("nppes", "20", "ENT1"), ("nppes", "10", "ENT1"), ("a", "1", "ENT1"), ("a", "2", "ENT2")], "source string, source_record_id string, entity_id string")
    got = {(r.source, r.source_record_id): (r.entity_id, r.hub_npi, r.is_reference) for r in C.hub_entity_ids(cw).collect()}
    assert got[("a", "1")] == ("NPI-10", "10", False) and got[("a", "2")] == ("ENT2", None, False) and got[("nppes", "20")][2]


def test_rank_is_dense_and_in_order(spark):
    df = spark.range(1000).select(F.format_string("%05d", F.col("id") * 7 % 1000).alias("c"))
    got = [r.k for r in C._rank(df, "c", "k", 8).orderBy("c").collect()]
    assert got == list(range(1, 1001))


def test_equalities_are_counted_without_pairs(spark, monkeypatch):
    from weldrow.operators.blocking import candidate_pairs
    from weldrow.operators.compare import Comparison, exact, missing

    one = lambda c: Comparison(c, (c,), missing(c), (exact(c),))
    rows = [(f"r{i // 2 if i > 50 else i}", "s", "n" if i % 9 else None, f"z{i % 4}" if i % 5 else None, f"p{i % 7}" if i % 3 else None) for i in range(60)] + [(None, "s", "n", "z1", "p1")]
    df = spark.createDataFrame(rows, "unique_id string, source_dataset string, name string, zip string, npi string")
    rule, compared = BlockingRule(("name",)), [one("zip"), one("npi")]
    want = M.patterns(candidate_pairs(df, [rule], columns=("zip", "npi")), compared)
    with monkeypatch.context() as m:
        m.setattr(M, "candidate_pairs", lambda *a: pytest.fail("pairs were made"))
        assert M.block_patterns(df, rule, compared) == want and len(want) > 5
        model = M.estimate_m(df, [rule], [one("name"), *compared], M.start_model([one("name"), *compared]))
    assert model.log[0]["pairs"] == sum(n for _, n in want) and model.log[0]["held_out"] == ["name"]


def test_pieces_share_one_join_for_all_rules_swapped_columns_included(spark):
    """Pairs of several rules come from one join without a union above it, which would make each of them a row of its own."""
    swap = BlockingRule(sql="l.a = r.b AND r.a = l.b")
    rows = [(f"n{i * 7 % 60:02}", "xy"[i % 2], f"a{i % 2}" if i % 9 else None, f"a{(i // 2) % 3}", f"c{i % 5}" if i % 4 else None) for i in range(60)]
    records = spark.createDataFrame([*rows, *rows[:3], ("n00", "y", "a1", "a0", "c2"), (None, "x", "a1", "a0", "c2")], "unique_id string, source_dataset string, a string, b string, c string")
    for rules in ([BlockingRule(("c",)), swap], [swap, BlockingRule(("a", "b")), BlockingRule(("c",)), BlockingRule(("b",))], [BlockingRule(sql="l.a = r.a AND l.c <> r.c"), BlockingRule(("b",)), swap]):
        for link in ("link_and_dedupe", "link_only"):
            plain, cut_up = (candidate_pairs(records, rules, link, ["c", "source_dataset"], piece=p) for p in (None, 3))
            got = sorted(map(tuple, cut_up.collect()), key=str)
            assert got == sorted(map(tuple, plain.collect()), key=str) and len({x[2] for x in got}) > 1
        plan = cut_up._jdf.queryExecution().optimizedPlan().toString()
        assert (plan.count("Join "), "Union" in plan) == (1, False) if "<>" not in (rules[0].sql or "") else "Union" in plan


def test_pieces_of_large_blocks_give_the_same_pairs_from_many_tasks(spark):
    rules = [BlockingRule(("a",)), BlockingRule(("b", "c")), BlockingRule(("c",)), BlockingRule(("a", "b")), BlockingRule(sql="l.a = r.c AND l.c = r.a"), BlockingRule(("b",))]
    rows = [(f"n{i * 7 % 100:02}", "xy"[i % 2], f"a{i % 13}" if i % 5 else None, f"b{i % 2}" if i % 7 else None, f"{'ac'[i % 2]}{i % 3}") for i in range(90)]
    rows += [*rows[:4], (None, "x", "a1", "b1", "c1"), ("p1", "x", "a20", None, "a21"), ("p2", "y", "a21", None, "a20"), ("n00", "y", "a2", "b0", "a2")]
    records = spark.createDataFrame(rows, "unique_id string, source_dataset string, a string, b string, c string")
    for link in ("link_and_dedupe", "link_only"):
        plain, cut_up = (sorted(map(tuple, candidate_pairs(records, rules, link, ["b"], piece=p).collect()), key=str) for p in (None, 4))
        assert plain == cut_up and {x[2] for x in plain} == {0, 1, 2, 4, 5}
    one = spark.range(100).selectExpr("cast(id as string) as unique_id", "'x' as source_dataset", "concat('k', id div 1000) as a")
    got = candidate_pairs(one, rules[:1], columns=(), piece=8)
    assert got.count() == 100 * 99 // 2 and got.select(F.spark_partition_id()).distinct().count() > 1
