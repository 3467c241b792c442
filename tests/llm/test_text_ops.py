"""WARC, quality, language, packing, URL, shuffle and BPE operators: SQL, brute force, round trips, held-out accuracy."""

import hashlib
import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from tests.oracle import assert_same
from weldrow.llm import bpe, langid, packing, quality, registry, shuffling, url_filter, warc

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
ODD = [(1, "Hello  world!\n\nIt's 2024 — naïve café <|endoftext|> end."), (2, None), (3, ""), (4, "日本語のテキスト  \t x"), (5, "aaaa" * 400), (6, " \x1c\u0085 mixed   space "), (7, "don't stop'll 12,345.67 😀😀"), (7, "don't stop'll 12,345.67 😀😀"), (None, "no id")]


def docs(spark, rows):
    return spark.createDataFrame([(i, t, None, None, None) for i, t in rows], DOCS)


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_equals_sql(spark, sf_dir, name):
    assert_same(registry.QUERIES[name](spark, sf_dir), registry.ORACLES[name], sf_dir)


def test_revisits_handle_ties_nulls_and_mismatch(spark):
    at = lambda s: F.timestamp_seconds(F.lit(s))
    rows = [(1, "response", "http://www.A.com/x/?b=2&a=1#f", 10, {"ETag": '"1"', "X": "a", "Content-Type": "t"}), (2, "response", "https://a.com/x?a=1&b=2&utm_source=z", 20, {"etag": '"2"'}), (3, "revisit", "http://a.com/x?a=1&b=2", 20, {"ETag": 'W/"1"', "X": "b", "Content-Type": "no"}), (4, "revisit", "a.com/x?a=1&b=2", 30, {"ETag": '"1"'}), (5, "revisit", "http://a.com/x?a=1&b=2", 5, None), (6, "revisit", None, 30, {}), (7, "revisit", "http://a.com/x?b=2&a=1", 99, {}), (8, "request", "http://a.com", 1, {})]
    df = spark.createDataFrame(rows, "record_id long, record_type string, target_uri string, s long, headers map<string,string>")
    got = {r.record_id: r for r in warc.resolve_revisits(df.withColumn("warc_date", F.timestamp_seconds("s"))).collect()}
    assert {k: (r.refers_to, r.status) for k, r in got.items()} == {3: (1, "resolved"), 4: (2, "mismatch"), 5: (None, "no_earlier"), 6: (None, "no_earlier"), 7: (2, "unverified")}
    assert got[3].headers == {"etag": 'W/"1"', "x": "b", "content-type": "t"} and at(1) is not None
    assert warc.resolve_revisits(df.limit(0).withColumn("warc_date", F.timestamp_seconds("s"))).count() == 0


def test_urls_without_host_and_longest_rule(spark):
    pages = spark.createDataFrame([(1, None, None), (2, "no scheme", ""), (3, "http://EXAMPLE.com/en/7?x", ""), (4, "http://a.example.com/en/8", ""), (5, "http://org/es/1", ""), (6, "http://notcom/en/", None), (6, "http://notcom/en/", None)], "page_id long, url string, html string")
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in url_filter.judge(pages.withColumn("rank", F.lit(1))).collect()}
    assert got[1] == ("", "", None, "allow") and got[2] == ("", "", None, "allow")
    assert got[3] == ("example.com", "/en/7", "example.com/en/7", "allow") and got[4][2:] == ("com/en/", "block")
    assert got[5][2] == "org/es/" and got[6][2] is None
    assert url_filter.judge(pages.limit(0)).count() == 0


def test_ranks_follow_links(spark):
    edges = spark.createDataFrame([("good", "a"), ("a", "b"), ("spam2", "spam")], "src string, dst string")
    seeds = spark.createDataFrame([("trust", "good", 1), ("distrust", "spam", 1)], "kind string, host string, weight long")
    got = {(r.kind, r.host): r["rank"] for r in url_filter.propagate(edges, seeds).collect()}
    assert got[("trust", "good")] > got[("trust", "a")] > got[("trust", "b")] > 0 and got[("distrust", "spam2")] > 0 and ("trust", "spam") not in got


def test_distrust_reaches_along_long_chains(spark):
    page = lambda i, to: (i, f"http://h{i}.xx/p", f'<a href="http://{to}/">x</a>')
    rows = [(0, "http://bad.org/es/1", ""), page(1, "bad.org"), *[page(i, f"h{i - 1}.xx") for i in range(2, 21)]]
    got = {r.page_id: r for r in url_filter.judge(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert all(got[i].verdict == "block" for i in range(21))
    want = [url_filter.ONE * 0.15 * 0.85**i for i in range(21)]  # a chain's personalised PageRank
    assert all(abs(got[i].distrust - want[i]) <= url_filter.ONE * 2e-6 for i in range(21))


def test_quality_on_held_out_documents(spark):
    d, labels = spark.read.parquet("/root/testdata/sf0.01/documents.parquet"), spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    got = quality.score(d, quality.fit(d, labels)).join(labels, "doc_id").where("held_out").toPandas()
    assert (got.predicted == got.quality).mean() > 0.9 and got[got.quality == 1].predicted.mean() > 0.95
    assert (got.held_out == [zlib.crc32(str(i).encode()) % 5 == 0 for i in got.doc_id]).all()
    odd = quality.score(docs(spark, ODD), quality.train([("good text here", 1), ("!! !! !!", 0)])).collect()
    assert len(odd) == len(ODD) and all(0 <= r.score <= 1 for r in odd)
    assert quality.train([]).score("x") == 0.5 and quality.score(docs(spark, []), quality.train([])).count() == 0


def test_features_are_a_unit_vector():
    index, value = quality.features("a b a b a")
    assert len(set(index)) == len(index) and np.isclose((value**2).sum(), 1)
    assert len(quality.features(None)[0]) == 0


def test_language_on_held_out_documents(spark):
    d = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = langid.identify(d, langid.fit(d)).join(d.select("doc_id", "lang"), "doc_id").where("held_out").toPandas()
    assert (got.lang == got.lang_pred).mean() > 0.97
    f = langid.Filters.build({"x": langid.grams(["abc abc"])[0], "y": langid.grams(["xyz xyz"])[0]})
    assert f.predict(["abc", "XYZ", None, "12 !", ""])[0] == ["x", "y", "und", "und", "und"]
    assert langid.Filters.build({}).predict(["abc"])[0] == ["und"]
    assert langid.identify(docs(spark, ODD), f).count() == len(ODD)


def test_rare_languages_are_learned(spark):
    rows = [(i, " ".join(f"{a}{b}" for a in "bcdfg" for b in "aeiou"), "often") for i in range(300)] + [(1000 + i, "qwx zwq xqz wzx qzw", "rare") for i in range(8)]
    d = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = langid.identify(d, langid.fit(d, 20)).where("doc_id >= 1000").collect()
    assert len(got) == 8 and all(r.lang_pred == "rare" for r in got)
    kept = langid.keep_known(d.withColumns({"score": F.lit(1), "lang_pred": F.lit("x")}))
    assert kept.count() == len(rows) and kept.columns[-2:] == ["score", "lang_pred"]


def test_bit_sliced_filter_has_no_false_negatives():
    rng = np.random.default_rng(1)
    known = {f"l{i}": rng.integers(0, 1 << 63, 500, dtype=np.uint64) for i in range(70)}
    f = langid.Filters.build(known)
    bits = len(f.slots).bit_length() - 1
    for i, lang in enumerate(f.languages):
        for at in f.places(known[lang], bits):
            assert ((f.slots[at, i // 64] >> np.uint64(i % 64)) & np.uint64(1)).all()


def brute_cost(cuts, costs, length, unpadded):
    best = {0: 0.0}
    for j in range(1, len(cuts)):
        best[j] = min(best[i] + (0 if cuts[j] - cuts[i] in unpadded else length - (cuts[j] - cuts[i])) for i in range(j) if cuts[j] - cuts[i] <= length) + costs[j]
    return best[len(cuts) - 1]


@pytest.mark.parametrize("seed", range(5))
def test_plan_is_optimal(seed):
    rng = np.random.default_rng(seed)
    cuts = np.unique(np.concatenate([[0], np.cumsum(rng.integers(1, 12, 60))]))
    costs = rng.choice([0.0, 2.0, 7.0], len(cuts))
    ends = packing.plan(cuts, costs, 32, (8, 16))
    windows = np.diff([0, *ends])
    cost = sum((0 if w in (8, 16) else 32 - w) for w in windows) + sum(costs[list(cuts).index(e)] for e in ends)
    assert windows.max() <= 32 and np.isclose(cost, brute_cost(cuts.tolist(), costs.tolist(), 32, (8, 16)))
    assert sum(packing.tail_sizes(77, 32)) == 77


def test_every_sentence_end_is_a_candidate():
    ids = np.array([0, 1, 0, 1, 0, 0, 1, 0])
    cuts, costs = packing.candidates(ids, np.array([5, 8]), np.array([False, True]), np.array([True, True]), 64)
    assert cuts.tolist() == [0, 2, 4, 5, 7, 8] and costs.tolist()[1:] == [packing.SENTENCE_CUT, packing.SENTENCE_CUT, 0, packing.SENTENCE_CUT, 0]


def test_packing_round_trip(spark):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(public_tokenizers.path(packing.VOCABULARY))
    rows = [r for r in ODD if r[0] != 7 and r[0] is not None] + [(50, "Long words here. " * 3000)]
    got = sorted((tuple(r) for r in packing.pack(docs(spark, rows)).collect()), key=lambda r: (r[0], r[1]))
    for i, text in rows:
        ids = np.array([*t.encode(text or "", add_special_tokens=False).ids, 1], dtype="<u4")
        at = 0
        for _, start, n, crc, total, _, _ in (r for r in got if r[0] == i):
            assert start == at and crc == zlib.crc32(ids[start : start + n].tobytes()) and total == len(ids)
            at += n
        assert at == len(ids)
    by_seq = {}
    for r in sorted(got, key=lambda r: (r[5], r[6])):
        assert r[6] == by_seq.get(r[5], 0)
        by_seq[r[5]] = r[6] + r[2]
    assert max(by_seq.values()) <= 2048
    assert packing.pack(docs(spark, ODD)).count() >= len(ODD) and packing.pack(docs(spark, [])).count() == 0


def test_shuffle_is_a_permutation(spark, tmp_path):
    rows = [(i, "text %d" % i) for i in range(500)] + ODD
    d = docs(spark, rows).withColumns({"start": F.lit("kept"), "_bucket": F.lit(1), "_start": F.lit(2), "slot": F.lit(3), "row": F.lit(4)})
    got = shuffling.shuffle(d, bucket_bytes=500).collect()
    assert sorted((str(r.doc_id), r.text or "") for r in got) == sorted((str(i), t or "") for i, t in rows)
    shards = {}
    for r in got:
        shards.setdefault(r.shard, []).append(r.slot)
    assert len(shards) == 16 and all(sorted(s) == list(range(len(s))) for s in shards.values())
    assert max(map(len, shards.values())) - min(map(len, shards.values())) <= 1
    again = shuffling.shuffle(d.repartition(7), bucket_bytes=500).where("doc_id < 500").collect()
    assert {(r.doc_id, r.shard, r.slot) for r in again if r.doc_id != 7} == {(r.doc_id, r.shard, r.slot) for r in got if r.doc_id is not None and r.doc_id < 500 and r.doc_id != 7}
    assert shuffling.shuffle(d.limit(0)).count() == 0
    assert set(shuffling.shuffle(d).columns) == {*d.columns, "shard"}
    counts = spark.range(10_000).selectExpr("id as bucket", "id % 7 as n")
    assert [r.start for r in shuffling._starts(counts).orderBy("bucket").collect()] == [0, *np.cumsum(np.arange(9999) % 7).tolist()]
    shuffling.write_shards(d, f"{tmp_path}/out")
    assert spark.read.parquet(f"{tmp_path}/out").count() == len(rows)


def test_bpe_equals_tiktoken_and_decodes(spark, monkeypatch):
    import tiktoken

    path = public_tokenizers.path(bpe.VOCABULARY)
    t = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.read_ranks(path), special_tokens={})
    codec = bpe.Codec(path, public_tokenizers.PATTERN)
    rng = np.random.default_rng(4)
    drawn = lambda letters, n: "".join(rng.choice(list(letters), n))
    long = [(20, drawn("abcdefghijklmnopqrstuvwxyz", 3000)), (21, drawn("ab", 700)), (22, "ab" * 900 + "ba" * 50), (23, drawn("éàçñ日本語", 400)), (24, drawn("ACGT", 1500)), (25, "=" * 1000 + "-" * 777)]
    rows = ODD + long
    d = docs(spark, rows).withColumns({"folds": F.lit(1), "parts": F.lit("x"), "ids": F.lit(None).cast("int")})
    want = sorted((str(i), t.encode_ordinary(x or ""), (x or "").encode()) for i, x in rows)
    for most in (bpe.FREQUENT, 3):  # words looked up, and words folded
        monkeypatch.setattr(bpe.frequent_words, "__defaults__", ("text", most))
        out = bpe.encode(d, codec).select("doc_id", "ids", codec.decoded(F.col("ids")).alias("raw"), F.sha2(codec.little_endian(F.col("ids")), 256).alias("h")).collect()
        assert sorted((str(r.doc_id), list(r.ids), bytes(r.raw)) for r in out) == want
        assert all(r.h == hashlib.sha256(np.array(r.ids, dtype="<u4").tobytes()).hexdigest() for r in out)
    assert bpe.encode(docs(spark, []), codec).count() == 0


def test_bpe_of_words_of_a_megabyte(spark):
    import tiktoken

    path = public_tokenizers.path(bpe.VOCABULARY)
    t = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.read_ranks(path), special_tokens={})
    letters = "".join(np.random.default_rng(5).choice(list("abcdefghijklmnopqrstuvwxyz"), 1 << 20))
    rows = [(1, letters), (2, "a" * (1 << 16))]
    got = {r.doc_id: list(r.ids) for r in bpe.encode(docs(spark, rows), bpe.Codec(path, public_tokenizers.PATTERN)).collect()}
    assert all(got[i] == t.encode_ordinary(x) for i, x in rows)


def test_bpe_steps_do_not_search_arrays(spark, monkeypatch):
    """Pieces up to SWEPT bytes are folded by one number a piece: array_position is left to the sweep of longer ones."""
    import pickle

    import pyarrow as pa
    import tiktoken

    path = public_tokenizers.path(bpe.VOCABULARY)
    t = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.read_ranks(path), special_tokens={})
    codec = bpe.Codec(path, public_tokenizers.PATTERN)
    letters = "".join(np.random.default_rng(6).choice(list("aeinrst"), bpe.SWEPT + 1))
    words = [w.encode() for w in (letters, letters[:-1], "a" * bpe.SWEPT, "ab" * 100, "x", " enauxrement", "ndhaenaningtiing")]
    rows = spark.createDataFrame([(i, codec.bytes[list(w)].tolist()) for i, w in enumerate(words)], "k int, single array<int>")
    searches, position = [], F.array_position
    monkeypatch.setattr(F, "array_position", lambda *a: searches.append(a) or position(*a))
    fold = codec.bound(lambda f: f(F.col("single")))
    got = {r.k: list(r.ids) for r in rows.select("k", fold.alias("ids")).collect()}
    assert [got[i] for i in range(len(words))] == [t._core_bpe.encode_single_piece(w) for w in words]
    assert len(searches) == 1  # in the sweep
    assert "unhex" not in str(codec.decoded(F.col("ids"))) + str(codec.little_endian(F.col("ids")))
    known = bpe.Folded(pa.table({"word": ["é", "ab"], "ids": pa.array([[1, 70000], []], pa.list_(pa.int32()))}))
    assert pickle.loads(pickle.dumps(known))() == {"é": np.array([1, 70000], "<i4").tobytes(), "ab": b""}
