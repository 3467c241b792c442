"""Exact dedup, SimHash components, near-duplicate groups and vector links against brute force."""

import hashlib
import re

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from weldrow.llm import exact_dedup, simhash, vectors
from weldrow.llm.runs import Sets

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
TEXTS = [(1, "a  b\tc"), (2, "a b c"), (3, None), (4, ""), (5, "a b c "), (None, "a b c"), (7, "x " * 3000), (7, "x " * 3000), (8, "a b")]


def docs(spark, rows):
    return spark.createDataFrame([(i, t, None, None, None) for i, t in rows], DOCS)


def components(ids, near):
    sets = Sets(len(ids))
    for a in range(len(ids)):
        for b in range(a):
            if near(a, b):
                sets.union(a, b)
    return [sets.find(x) for x in range(len(ids))]


def test_exact_dedup_against_brute_force(spark):
    got = exact_dedup.exact_dedup(docs(spark, TEXTS).withColumns({"tag": F.lit(1), "digest": F.lit("x"), "leaf": F.lit(2)})).collect()
    assert len(got) == len(TEXTS)
    norm = lambda t: re.sub(r"[\x20\x09-\x0D]+", " ", t or "")
    for r in got:
        same = [i for i, t in TEXTS if hashlib.sha256(norm(t).encode()).hexdigest() == r.text_sha256]
        assert r.group_size == len(same) and r.keep_id == min((i for i in same if i is not None), default=None)
    assert sum(r.kept for r in got) == len({norm(t) for _, t in TEXTS})
    assert sorted(r.doc_id for r in got if r.kept) == [1, 3, 5, 7, 8]


def test_exact_dedup_of_many_runs_and_empty_tables(spark):
    rows = spark.range(0, 4000, 1, 37).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("t"), (F.col("id") % 100).cast("string"))).alias("text"))
    got = exact_dedup.exact_dedup(rows)
    want = rows.groupBy("text").agg(F.min("doc_id").alias("keep_id"), F.count("*").alias("n"))
    assert got.where("kept").count() == want.count()
    assert got.groupBy("keep_id").agg(F.max("group_size").alias("n")).exceptAll(want.select("keep_id", "n")).isEmpty()
    assert exact_dedup.exact_dedup(rows.limit(0)).count() == 0
    kept = exact_dedup.keep_first(docs(spark, TEXTS))
    assert sorted(r.doc_id for r in kept.collect()) == [1, 3, 5, 7, 8] and kept.columns == ["doc_id", "text", "lang", "source", "n_chars"]


def plain_fingerprint(text, words=3):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not w:
        return 0
    h = [xxhash.xxh64_intdigest(" ".join(w[i : i + words]).encode(), 42) for i in range(max(1, len(w) - words + 1))]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


@pytest.mark.parametrize("text", ["", None, "One", "one TWO", "a b c", "É b c d É b c d", "x " * 500, "a b\tc\nd"])
def test_fingerprint(text):
    assert simhash.fingerprint(text) == plain_fingerprint(text)


def test_bk_tree_finds_all_within_the_radius():
    rng = np.random.default_rng(3)
    base = [int(x) for x in rng.integers(0, 1 << 63, 30)]
    values = [b ^ int(rng.integers(0, 4)) ^ (1 << int(rng.integers(0, 60))) for b in base for _ in range(8)]
    tree = simhash.BKTree()
    home = [tree.add(v) for v in values]
    for v in values[:40]:
        assert {tree.values[k] for k in tree.within(v, 3)} == {x for x in values if (x ^ v).bit_count() <= 3}
    assert len(set(home)) == len(set(values))


@pytest.mark.parametrize("tree_size", [4096, 3])
def test_simhash_components_against_brute_force(spark, tree_size):
    rng = np.random.default_rng(5)
    words = [f"w{i}" for i in range(40)]
    rows = [(i, " ".join(rng.choice(words, 60))) for i in range(40)]
    rows += [(100 + i, t + " tail") for i, (_, t) in enumerate(rows[:20])] + [(200, None), (201, " "), (202, rows[0][1].upper()), (None, rows[1][1])]
    got = {(r.doc_id, r.fingerprint): r.component_id for r in simhash.simhash_components(docs(spark, rows), tree_size=tree_size).collect()}
    fps = [plain_fingerprint(t) for _, t in rows]
    top = components(rows, lambda a, b: (fps[a] ^ fps[b]).bit_count() <= 2)
    for k, (i, _) in enumerate(rows):
        least = min((rows[j][0] for j in range(len(rows)) if top[j] == top[k] and rows[j][0] is not None), default=None)
        assert got[(i, f"{fps[k]:016x}")] == least
    assert simhash.simhash_components(docs(spark, [])).count() == 0


def test_simhash_components_leave_as_many_files_as_their_rows_need(spark, tmp_path):
    folder, conf = spark.sparkContext.getCheckpointDir(), {"spark.sql.shuffle.partitions": "20", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    was = {k: spark.conf.get(k) for k in conf}
    try:
        spark.sparkContext.setCheckpointDir(str(tmp_path))
        for k, v in conf.items():
            spark.conf.set(k, v)
        rows = spark.createDataFrame([(i, t) for i, t in enumerate(["the same words in a text", *(f"text {i}" for i in range(8))] * 4)], "doc_id long, text string")
        simhash.simhash_components(rows).collect()
        got = {r.node: r.component for r in simhash.connected_components(spark.createDataFrame([(i, i + 1) for i in range(60)], "a long, b long"), "a", "b").collect()}
    finally:
        if folder:
            spark.sparkContext.setCheckpointDir(folder.rpartition("/")[0])
        for k, v in was.items():
            spark.conf.set(k, v)
    cuts = [len(list(x.glob("part-*"))) for x in tmp_path.glob("*/rdd-*")]
    assert set(got) == set(range(61)) and set(got.values()) == {0}
    assert len(cuts) > 8 and sum(n > 1 for n in cuts) <= 3  # the scan, and edges before they are counted


def test_near_groups_against_brute_force(spark):
    rng = np.random.default_rng(6)
    rows = []
    for g in range(12):
        w = [f"g{g}x{int(x)}" for x in rng.integers(0, 500, 120)]
        rows.append((g * 10, " ".join(w)))
        for k in range(1, 4):
            v = list(w)
            for p in rng.choice(120, k * 2, replace=False):
                v[p] = "changed"
            rows.append((g * 10 + k, " ".join(v)))
    rows += [(900, "short text"), (901, "short  TEXT"), (902, None), (None, rows[0][1])]
    sets = [{" ".join((t or "").lower().split()[i : i + 5]) for i in range(max(1, len((t or "").split()) - 4))} if (t or "").split() else set() for _, t in rows]
    near = lambda a, b: rows[a][0] is not None and rows[b][0] is not None and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])
    top = components(rows, near)
    want = {rows[k][0]: rows[top[k]][0] for k in range(len(rows)) if rows[k][0] is not None}
    got = {r.doc_id: r.component_id for r in simhash.near_groups(docs(spark, rows)).collect()}
    assert {i: got.get(i, i) for i in want} == want
    kept = simhash.keep_one(docs(spark, rows))
    assert sorted(r.doc_id for r in kept.collect() if r.doc_id is not None) == sorted(set(want.values())) and kept.columns == ["doc_id", "text", "lang", "source", "n_chars"]


def test_stages_take_any_columns_and_identifiers(spark):
    text = " ".join(f"w{i}" for i in range(60))
    rows = [("b", text, 1, "x"), ("a", text + " end", 2, "y"), ("c", "other words", 3, "z"), (None, text, 4, "n")]
    d = spark.createDataFrame(rows, "doc_id string, text string, _id long, _digest string").withColumn("id", F.lit(0))
    kept = simhash.keep_one(d)
    assert sorted((r.doc_id or "", r._id) for r in kept.collect()) == [("", 4), ("a", 2), ("c", 3)] and kept.columns == d.columns
    first = exact_dedup.keep_first(d)
    assert sorted((r.doc_id, r._digest) for r in first.collect()) == [("a", "y"), ("b", "x"), ("c", "z")] and first.columns == d.columns
    assert simhash.keep_one(d.limit(0)).count() == 0 and exact_dedup.keep_first(d.limit(0)).count() == 0


def test_near_groups_ignore_how_often_a_line_repeats(spark):
    rows = []
    for g in range(8):
        body, line = " ".join(f"g{g}w{i}" for i in range(1000)), " ".join(f"g{g}line{i}" for i in range(12))
        rows += [(10 * g, f"{body} {line}"), (10 * g + 1, f"{body} " + " ".join([line] * 50))]
    assert max((simhash.fingerprint(rows[2 * g][1], 5) ^ simhash.fingerprint(rows[2 * g + 1][1], 5)).bit_count() for g in range(8)) > 24
    got = {r.doc_id: r.component_id for r in simhash.near_groups(docs(spark, rows)).collect()}
    assert got == {i: i // 10 * 10 for i, _ in rows}


def test_near_groups_go_through_simhash(spark, monkeypatch):
    """Links of the BK-trees are confirmed and used: with no shared keys, they alone bring near copies together."""
    w = [f"w{i}" for i in range(2000)]
    rows = [(1, " ".join(w)), (2, " ".join(["new", *w])), (3, " ".join(w) + " "), (4, "other words"), (5, None), (6, " ")]
    got = [simhash.bits_of(simhash.shingle_set(t)) if (t or "").split() else 0 for _, t in rows]
    assert (got[0] ^ got[1]).bit_count() <= simhash.RADIUS
    called = []
    monkeypatch.setattr(simhash, "linked", lambda *a, f=simhash.linked, **k: called.append(1) or f(*a, **k))
    monkeypatch.setattr(simhash, "prefix", lambda *a: np.empty(0, np.uint64))
    groups = {r.doc_id: r.component_id for r in simhash.near_groups(docs(spark, rows)).collect()}
    assert called and groups == {1: 1, 2: 1, 3: 1, 5: 5, 6: 5}


def test_direct_links_are_within_the_radius(spark):
    rng = np.random.default_rng(8)
    fps = sorted({int(x) ^ (1 << int(p)) ^ (1 << int(q)) for x in rng.integers(0, 1 << 62, 20) for p, q in rng.integers(0, 62, (6, 2))})
    df = spark.createDataFrame([(x,) for x in fps], "fp long")
    got = [(r.a, r.b) for r in simhash.linked(df, tree_size=8, direct=True).collect()]
    assert got and all((a ^ b).bit_count() <= simhash.RADIUS for a, b in got)
    parts = lambda edges: {r.node: r.component for r in simhash.connected_components(edges, "a", "b").collect()}
    assert parts(simhash.linked(df, tree_size=8, direct=True)) == parts(simhash.linked(df, tree_size=8))


@pytest.mark.parametrize("block", [1024, 4])
def test_near_groups_miss_no_pair_at_the_threshold(spark, monkeypatch, block):
    monkeypatch.setattr(simhash, "NEAR_BLOCK", block)
    rows = []
    for g in range(1000):
        w = [f"g{g}w{i}" for i in range(94)]  # 90 shingles each, 80 of 100 in common
        rows += [(2 * g, " ".join(w)), (2 * g + 1, " ".join([*w[:20], "x", *w[21:60], "y", *w[61:]]))]
    got = {r.doc_id: r.component_id for r in simhash.near_groups(docs(spark, rows)).collect()}
    assert got == {i: i // 2 * 2 for i, _ in rows}


@pytest.mark.parametrize("block", [1024, 4])
def test_vectors_against_brute_force(spark, block):
    rng = np.random.default_rng(7)
    rows = []
    for g in range(30):
        base = rng.standard_normal(32)
        for k in range(4):
            rows.append((len(rows), [float(x) for x in base + (k > 0) * 0.08 * rng.standard_normal(32)], g % 2))
    rows += [(200 + i, rows[0][1], 0) for i in range(5)] + [(300, None, 0), (301, [0.0] * 32, 0), (302, [None] + [1.0] * 31, 0), (303, [float("nan")] * 32, 0), (304, rows[0][1], None), (305, [], 0), (306, [x * 3 for x in rows[0][1]], 0), (307, [1.0, 2.0], 0), (308, [2.0, 4.0], 0), (None, rows[0][1], 0)]
    df = spark.createDataFrame([(*r, "extra") for r in rows], "vec_id long, embedding array<float>, label int, dim string")
    got = {r.vec_id: r for r in vectors.near_vectors(df, block=block).collect() if r.vec_id is not None}
    fine = [(i, np.array(v, np.float32).astype(float), lab) for i, v, lab in rows if i is not None and lab is not None and v and None not in v and np.isfinite(v).all() and any(v)]
    cos = lambda a, b: a @ b / np.sqrt((a @ a) * (b @ b))
    near = lambda a, b: fine[a][2] == fine[b][2] and len(fine[a][1]) == len(fine[b][1]) and cos(fine[a][1], fine[b][1]) >= 0.98
    links = [sum(near(a, b) for b in range(len(fine)) if a != b) for a in range(len(fine))]
    found = sum(got[fine[a][0]].n_links for a in range(len(fine)))
    assert 0.9 * sum(links) <= found <= sum(links) and all(got[fine[a][0]].n_links <= links[a] for a in range(len(fine)))
    top = components(fine, near)
    same = sum(got[fine[k][0]].component_id == fine[top[k]][0] for k in range(len(fine)))
    assert same >= 0.95 * len(fine)
    for i in (300, 301, 302, 303, 304, 305):
        assert got[i].n_links == 0 and got[i].component_id == i and got[i].kept
    assert vectors.near_vectors(df.limit(0)).count() == 0


@pytest.mark.parametrize("mean", [0.0, 0.8, 0.9])
def test_vector_tables_keep_their_recall_off_centre(mean):
    rng = np.random.default_rng(9)
    x = rng.standard_normal((4000, 64))
    x = vectors.unit(mean * np.eye(64)[0] + np.sqrt(1 - mean**2) * x / np.linalg.norm(x, axis=1, keepdims=True))
    coder = vectors.learn(x[:2000], 100_000)
    a = x[2000:]
    off = rng.standard_normal(a.shape)
    off -= (off * a).sum(axis=1, keepdims=True) * a
    b = 0.98 * a + np.sqrt(1 - 0.98**2) * off / np.linalg.norm(off, axis=1, keepdims=True)
    assert (coder.keys(a) == coder.keys(b)).any(axis=1).mean() >= 0.975


@pytest.mark.parametrize("alone", [0, 40, 1000])
def test_components_joined_by_one_task_are_those_of_rounds(spark, alone):
    rng = np.random.default_rng(12)
    pairs = [(int(a), int(b)) for a, b in rng.integers(-150, 150, (120, 2))] + [(i, i + 1) for i in range(1000, 1080)] + [(5, 5), (None, 7)]
    nodes = sorted({x for a, b in pairs if a is not None and a != b for x in (a, b)})
    sets = Sets(len(nodes))
    for a, b in pairs:
        if a is not None and a != b:
            sets.union(nodes.index(a), nodes.index(b))
    want = {x: nodes[sets.find(i)] for i, x in enumerate(nodes)}
    got = simhash.connected_components(spark.createDataFrame(pairs, "a long, b long"), "a", "b", alone).collect()
    assert len(got) == len(want) and {r.node: r.component for r in got} == want
    text = spark.createDataFrame([("é", "z"), ("z", "\U0001f600"), ("\uffee", "\U0001f600"), ("b", "a")], "a string, b string")
    assert {r.node: r.component for r in simhash.connected_components(text, "a", "b", alone).collect()} == {"z": "z", "é": "z", "\uffee": "z", "\U0001f600": "z", "a": "a", "b": "a"}
    assert simhash.connected_components(spark.createDataFrame([], "a long, b long"), "a", "b", alone).count() == 0


def test_near_groups_leave_few_folders_and_no_marker_files(spark, tmp_path):
    """The driver starts a child process for every folder and file that it makes; such a child can count as large as the driver."""
    folder = spark.sparkContext.getCheckpointDir()
    words = [f"w{i}" for i in range(60)]
    rows = [(i, " ".join([*words[i:], f"x{i}"] if i < 12 else [f"t{i}w{k}" for k in range(9)])) for i in range(30)]
    try:
        spark.sparkContext.setCheckpointDir(str(tmp_path))
        got = simhash.near_groups(docs(spark, rows)).collect()
    finally:
        if folder:
            spark.sparkContext.setCheckpointDir(folder.rpartition("/")[0])
    assert {(r.doc_id, r.component_id) for r in got} == {(i, 0) for i in range(12)}
    assert len(list(tmp_path.glob("*/rdd-*"))) <= 15 and not list(tmp_path.glob("*/table-*/_SUCCESS"))
