"""SimHash near-duplicates: fingerprints, shards by bit blocks, a BK-tree for every shard, components."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from weldrow.llm.blocks import in_blocks
from weldrow.llm.runs import Sets, iter_runs
from weldrow.llm.sampling import about
from weldrow.operators.components import connected_components
from weldrow.session import ROWS_A_FILE, cut, written

SHINGLE_WORDS, RADIUS = 3, 2
#: Fingerprints in a tree; a shard with more is cut into such blocks, every two of which meet.
TREE_SIZE = 4096
#: XXH64 seed.
SEED = 42
#: Shingles whose bits are unpacked at once.
STEP = 1 << 16


def shingle_hashes(text: str | None, words: int = SHINGLE_WORDS) -> np.ndarray:
    """XXH64 of every lower-cased (A-Z) word shingle, repeats included; of all words if they are fewer."""
    raw = (text or "").encode("utf-8", "surrogatepass").lower().split()  # bytes: ASCII case and white space only
    if not raw:
        return np.empty(0, np.uint64)
    joined = b" ".join(raw)
    ends = np.cumsum(np.fromiter(map(len, raw), dtype=np.int64, count=len(raw)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    n = max(1, len(raw) - words + 1)
    h, view = xxhash.xxh64_intdigest, memoryview(joined)
    return np.array([h(view[a:b], SEED) for a, b in zip(starts[:n].tolist(), ends[min(words, len(raw)) - 1 :].tolist(), strict=True)], dtype=np.uint64)


def bits_of(hashes: np.ndarray) -> int:
    """The bits that are set in over half the hashes."""
    big = hashes.astype(">u8")
    ones = sum(np.unpackbits(big[i : i + STEP].view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64) for i in range(0, len(big), STEP))
    return int.from_bytes(np.packbits(2 * ones > len(big)).tobytes(), "big")


def fingerprint(text: str | None, words: int = SHINGLE_WORDS) -> int:
    """64-bit SimHash of word shingles; 0 without words."""
    hashes = shingle_hashes(text, words)
    return bits_of(hashes) if len(hashes) else 0


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = SHINGLE_WORDS) -> DataFrame:
    """``doc_id, fp``: the fingerprint's 64 bits as a signed long."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fps = np.array([fingerprint(t.as_py(), words) for t in b.column(1)], dtype=np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fps)], names=["doc_id", "fp"])

    slim = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    return slim.mapInArrow(scan, f"doc_id {slim.schema['doc_id'].dataType.simpleString()}, fp long")


class BKTree:
    """Burkhard-Keller tree: a node's children are keyed by their Hamming distance to it."""

    def __init__(self) -> None:
        self.values: list[int] = []
        self.children: list[dict[int, int]] = []

    def add(self, value: int) -> int:
        """The value's node; one node for equal values."""
        if not self.values:
            self.values, self.children = [value], [{}]
            return 0
        at = 0
        while d := (self.values[at] ^ value).bit_count():
            if (child := self.children[at].get(d)) is None:
                self.children[at][d] = len(self.values)
                self.values.append(value)
                self.children.append({})
                return len(self.values) - 1
            at = child
        return at

    def within(self, value: int, radius: int) -> list[int]:
        """Nodes at most ``radius`` away; only edges whose key is within the radius of the node's distance are followed."""
        found, todo = [], [0] if self.values else []
        while todo:
            at = todo.pop()
            d = (self.values[at] ^ value).bit_count()
            if d <= radius:
                found.append(at)
            if children := self.children[at]:
                todo += [children[k] for k in range(max(1, d - radius), d + radius + 1) if k in children]
        return found


def _tree_links(radius: int, direct: bool = False):
    """Over sorted block pairs: every fingerprint with the least fingerprint that it is linked to in its block pair.

    If ``direct``, the links that joined them instead, which are as few: both ends are within the radius.
    """

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        left: list[int] = []
        right: list[int] = []
        for run in iter_runs(batches, ["part", "bits", "_i", "_j"]):
            fps = run["fp"].view(np.uint64).tolist()
            if len(fps) < 2:
                continue
            sets, tree = Sets(len(fps)), BKTree()
            within_one = run["_i"][0] == run["_j"][0]
            home = [0] * len(fps)  # position of each tree node's row
            signed = run["fp"].tolist()

            def meet(x: int, y: int, sets=sets, signed=signed) -> None:
                if direct and sets.find(x) != sets.find(y):
                    left.append(signed[x])
                    right.append(signed[y])
                sets.union(x, y)

            first = range(len(fps)) if within_one else np.flatnonzero(run["_block"] == run["_i"][0]).tolist()
            for x in first:
                if within_one:
                    for at in tree.within(fps[x], radius):
                        meet(x, home[at])
                home[tree.add(fps[x])] = x
            if not within_one:
                for x in np.flatnonzero(run["_block"] == run["_j"][0]).tolist():
                    for at in tree.within(fps[x], radius):
                        meet(x, home[at])
            for x in range(len(fps)):
                if not direct and (top := sets.find(x)) != x:
                    left.append(signed[x])
                    right.append(signed[top])
            if len(left) > 50_000:
                yield pa.RecordBatch.from_arrays([pa.array(left, pa.int64()), pa.array(right, pa.int64())], names=["a", "b"])
                left, right = [], []
        yield pa.RecordBatch.from_arrays([pa.array(left, pa.int64()), pa.array(right, pa.int64())], names=["a", "b"])

    return scan


def linked(fps: DataFrame, radius: int = RADIUS, tree_size: int = TREE_SIZE, direct: bool = False) -> DataFrame:
    """Edges ``a, b`` that connect all distinct fingerprints (column ``fp``) within ``radius`` bits of each other; if ``direct``, each edge is such a pair.

    The 64 bits are cut into ``radius + 1`` parts. Two fingerprints within the radius agree in one part at least, so
    a shard is a (part, bits) value: it holds all partners of its members and a BK-tree over it finds them exactly. A
    tree spans its shard's links with one edge per fingerprint and not with every pair. Shards over ``tree_size`` are
    cut: each block's tree goes to the tasks of all other blocks.
    """
    cuts = [round(64 * i / (radius + 1)) for i in range(radius + 2)]
    parts = [F.struct(F.lit(i).alias("part"), F.shiftrightunsigned("fp", a).bitwiseAND(F.lit((1 << (b - a)) - 1)).alias("bits")) for i, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False))]
    rows = fps.select("fp", F.inline(F.array(*parts)))
    keys = ["part", "bits", "_i", "_j"]
    dealt = in_blocks(rows, ["part", "bits"], "fp", tree_size).select(*keys, "_block", "fp")
    return dealt.repartition(*keys).sortWithinPartitions(*keys, "fp").mapInArrow(_tree_links(radius, direct), "a long, b long")


def simhash_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = SHINGLE_WORDS, radius: int = RADIUS, tree_size: int = TREE_SIZE) -> DataFrame:
    """One row per input row: ``doc_id, fingerprint, component_id``.

    component_id is the smallest identifier reachable over links between fingerprints that differ in at most
    ``radius`` bits; null and wordless texts share fingerprint zero, which links like any other. Rows with a null
    identifier keep their place in a component but cannot name it (a component of such rows only has a null id);
    repeated rows link to each other. Other columns are not read. An empty table gives an empty result.
    """
    rows = cut(fingerprints(docs, id_col, text_col, words))
    distinct = cut(rows.groupBy("fp").agg(F.min("doc_id").alias("least")), rows.count())
    labels = connected_components(linked(distinct, radius, tree_size), "a", "b").select(F.col("node").alias("fp"), "component")
    named = distinct.join(labels, "fp", "left").withColumn("component", F.coalesce("component", "fp"))
    lowest = named.groupBy("component").agg(F.min("least").alias("component_id"))
    by_fp = named.join(lowest, "component").select("fp", "component_id")
    out = rows.join(by_fp, "fp")
    return out.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


#: Near duplicates of whole documents: words of a shingle, least Jaccard similarity of two shingle sets.
NEAR_WORDS, NEAR_SIMILARITY = 5, 0.8
#: Rows of a block of a shard; bits of a parity sketch at least and at most; pairs whose sketches are compared at once.
NEAR_BLOCK, PARITY, MOST_PARITY, PAIRS = 1024, 512, 1 << 15, 1 << 13
#: Characters of a block of whole texts, at most about.
NEAR_CHARS = 1 << 23
#: Documents in which frequent shingles are counted, at most about, and in how many of them such a shingle is. Both
#: only order the shingles: every order gives the same links.
ORDER_ROWS, FREQUENT = 20_000, 4
#: Orders of documents, of which a key takes one: the first of its documents leads it.
LEADERS = 4
#: Edges that one task joins at the end of the components of near duplicates, at most; more are first contracted in rounds.
ALONE = ROWS_A_FILE
#: Stands for the shingles of a document without words.
NO_WORDS = 0


def shingle_set(text: str | None, words: int = NEAR_WORDS) -> np.ndarray:
    """Sorted distinct shingle hashes of a whole text."""
    return np.unique(shingle_hashes(text, words))


def prefix(shingles: np.ndarray, similarity: float, frequent: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The first shingles in the order (count in the sample, hash), as many as may not all be missing in a similar set.

    Sets at ``similarity`` or more share at least that part of either. So at most n - ceil(similarity * n) of a set's n
    shingles are missing in the other, and the first common one in any order that all sets keep is among the first
    n - ceil(similarity * n) + 1 of both.
    """
    n = len(shingles)
    if not n:
        return np.array([NO_WORDS], np.uint64)
    count = np.zeros(n, np.int64)
    if len(frequent):
        at = np.minimum(np.searchsorted(frequent, shingles), len(frequent) - 1)
        count = np.where(frequent[at] == shingles, counts[at], 0)
    return shingles[np.argsort(count, kind="stable")[: n - math.ceil(similarity * n - 1e-9) + 1]]


def parity(shingles: np.ndarray) -> bytes:
    """Two bits a shingle, a power of two: whether an odd number of shingles falls on each. Two sets differ in at least as many shingles as bits.

    With so many bits few differences meet on one, so sets that are not similar are seldom taken for similar ones.
    """
    bits = min(MOST_PARITY, max(PARITY, 1 << (2 * len(shingles) - 1).bit_length())) if len(shingles) else PARITY
    return np.packbits(np.bincount((shingles % np.uint64(bits)).astype(np.int64), minlength=bits).astype(np.uint8) & 1).tobytes()


def folded(sketches: np.ndarray, words: int) -> np.ndarray:
    """Sketches of fewer 64-bit words: of the halves, a bit is odd where just one is."""
    while sketches.shape[1] > words:
        half = sketches.shape[1] // 2
        sketches = sketches[:, :half] ^ sketches[:, half:]
    return sketches


def may_be_near(n_a: np.ndarray, n_b: np.ndarray, odd_a: np.ndarray, odd_b: np.ndarray, similarity: float) -> np.ndarray:
    """False only for pairs that sizes and parities show to be less similar: similar sets differ in at most (1 - s) / (1 + s) of the sum of their sizes."""
    differ = np.bitwise_count(odd_a ^ odd_b).sum(axis=1, dtype=np.int64)
    return sizes_fit(n_a, n_b, similarity) & (differ <= (1 - similarity) / (1 + similarity) * (n_a + n_b) + 1e-9)


def sizes_fit(n_a: np.ndarray, n_b: np.ndarray, similarity: float) -> np.ndarray:
    return np.minimum(n_a, n_b) >= similarity * np.maximum(n_a, n_b) - 1e-9


def _words(sketches) -> np.ndarray:
    """64-bit words of each sketch."""
    return np.fromiter((len(x) // 8 for x in sketches), np.int64, len(sketches))


def _odd(sketches, words: int) -> np.ndarray:
    """Sketches of one length as rows of 64-bit words."""
    return np.frombuffer(b"".join(sketches), np.uint64).reshape(-1, words)


def _pairs(run: dict[str, np.ndarray], odd: np.ndarray, label: np.ndarray, similarity: float) -> Iterator[tuple[int, int]]:
    """Pairs of a block pair's rows that sizes and parities do not rule out, of different components and labels.

    Labels may be changed between pairs: pairs of one label are not given from then on.
    """
    group, size, words = run["component"], run["size"], _words(odd)
    within_one = run["_i"][0] == run["_j"][0]
    for w in np.unique(words).tolist():
        # sizes that fit have sketches of one length, or one has twice the other's
        mine, reach = np.flatnonzero(words == w), np.flatnonzero((words == w) | (words == 2 * w))
        rows = np.concatenate([folded(_odd(odd[at], k), w) for k in (w, 2 * w) if len(at := np.flatnonzero(words == k))])
        place = np.empty(len(group), np.int64)
        place[np.concatenate([np.flatnonzero(words == k) for k in (w, 2 * w)])] = np.arange(len(rows))
        for k in range(0, len(mine), 256):
            some = mine[k : k + 256]
            fit = (group[some][:, None] != group[reach][None, :]) & (label[some][:, None] != label[reach][None, :])
            fit &= sizes_fit(size[some][:, None], size[reach][None, :], similarity)
            fit &= (some[:, None] < reach[None, :]) | (words[reach] != w)[None, :]
            if not within_one:
                fit &= run["_block"][some][:, None] != run["_block"][reach][None, :]
            xs, ys = np.nonzero(fit)
            for j in range(0, len(xs), PAIRS):
                x, y = some[xs[j : j + PAIRS]], reach[ys[j : j + PAIRS]]
                near = (label[x] != label[y]) & may_be_near(size[x], size[y], rows[place[x]], rows[place[y]], similarity)
                for x1, y1 in zip(x[near].tolist(), y[near].tolist(), strict=True):
                    if label[x1] != label[y1]:
                        yield x1, y1


def _join(label: np.ndarray, x: int, y: int) -> None:
    """One label for all that have either's."""
    label[label == label[y]] = label[x]


def _edges(found: list[tuple[int, int]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([x[k] for x in found], pa.int64()) for k in (0, 1)], names=["a", "b"])


def _across(similarity: float):
    """Over sorted block pairs: edges that connect all rows of different components that sizes and parities do not rule out.

    Each edge joins two sets of a block pair's rows, so there are fewer edges than rows.
    """

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for run in iter_runs(batches, ["key", "_i", "_j"]):
            ids, group, found = run["id"], run["component"], []
            if (group == group[0]).all():
                continue
            label = np.arange(len(ids))
            for x, y in _pairs(run, run["odd"], label, similarity):
                found.append((ids[x], ids[y]))
                _join(label, x, y)
            if found:
                yield _edges(found)

    return scan


def _among(words: int, similarity: float):
    """Over sorted block pairs of texts: edges that connect all rows of different components whose shingle sets are similar."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for run in iter_runs(batches, ["key", "_i", "_j"]):
            ids, found = run["id"], []
            label = np.unique(run["component"], return_inverse=True)[1]
            if not label.any():
                continue
            sets = [shingle_set(t, words) for t in run["text"]]
            run["size"], odd = np.array([len(s) for s in sets]), np.empty(len(sets), object)
            odd[:] = [parity(s) for s in sets]
            for x, y in _pairs(run, odd, label, similarity):
                if _sets_near(sets[x], sets[y], similarity):
                    found.append((ids[x], ids[y]))
                    _join(label, x, y)
            if found:
                yield _edges(found)

    return scan


def _sets_near(x: np.ndarray, y: np.ndarray, similarity: float) -> bool:
    """Whether the Jaccard similarity is reached; two sets without shingles are similar."""
    common = len(np.intersect1d(x, y, assume_unique=True))
    return len(x) + len(y) == 0 or common / (len(x) + len(y) - common) >= similarity


def _similar(words: int, similarity: float):
    """Over partitions sorted by ``a, part``, the row of document a itself first: partners with a similar shingle set."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, sets = None, []
        for b in batches:
            found = []
            for i, a, part, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist(), b.column(3), strict=True):
                if at != (a, part):
                    at, sets = (a, part), []
                mine = shingle_set(text.as_py(), words)
                if i == a:  # more than one where its identifier repeats
                    sets.append(mine)
                elif any(_sets_near(x, mine, similarity) for x in sets):
                    found.append((a, i))
            yield _edges(found)

    return scan


def _frequent(slim: DataFrame, words: int) -> tuple[np.ndarray, np.ndarray]:
    """Shingles that FREQUENT documents of a sample share, sorted, and in how many each is."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for b in (whole.slice(i, 256) for i in range(0, whole.num_rows, 256)):
                shingles, n = np.unique(np.concatenate([shingle_set(t.as_py(), words) for t in b.column(1)]), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(shingles.view(np.int64)), pa.array(n)], names=["shingle", "n"])

    got = about(slim, F.col("id"), ORDER_ROWS).mapInArrow(scan, "shingle long, n long").groupBy("shingle").agg(F.sum("n").alias("n")).where(F.col("n") >= FREQUENT).toArrow()
    shingles, counts = (got.column(i).to_numpy() for i in range(2))
    order = np.argsort(shingles.view(np.uint64))
    return shingles.view(np.uint64)[order], counts[order]


def simhash_links(rows: DataFrame, radius: int = RADIUS, tree_size: int = TREE_SIZE) -> DataFrame:
    """Pairs ``a, b`` of identifiers that connect all rows (``id, fp``) whose fingerprints link, found by the BK-trees.

    Rows of one fingerprint pair with the least identifier that has it, and those of linked fingerprints with each other.
    """
    least = cut(rows.groupBy("fp").agg(F.min("id").alias("least")))
    alike = rows.join(least, "fp").where("id <> least").select(F.col("least").alias("a"), F.col("id").alias("b"))
    a, b = (least.select(F.col("fp").alias(c), F.col("least").alias(f"id_{c}")) for c in "ab")
    across = linked(least, radius, tree_size, direct=True).distinct().join(a, "a").join(b, "b").select(F.least("id_a", "id_b").alias("a"), F.greatest("id_a", "id_b").alias("b"))
    return alike.unionAll(across.where("a <> b")).distinct()


def near_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = NEAR_WORDS, similarity: float = NEAR_SIMILARITY) -> DataFrame:
    """``doc_id, component_id`` of the documents that have a near duplicate.

    Near duplicates share at least ``similarity`` of the union of their word shingles (64-bit hashes). None is missed:
    similar sets have a shingle in common among the first of both (:func:`prefix`, rare ones first). First the
    pairs of SimHash (:func:`simhash_links`) are confirmed by whole shingle sets, and for what 64 bits cannot show every
    document is compared with documents that lead the keys it shares, so that large groups become one component
    without all their pairs; then all pairs of a key that are in different components still. Sizes and parities rule
    out most. What they leave is passed on as edges that connect it, fewer than rows, and not as pairs; whole shingle
    sets decide within each set so connected, once however many keys two documents share. Rows without an identifier are left alone; rows that repeat one count
    once with each of their texts. Other columns are not read. An empty table gives an empty result.
    """
    if docs.schema[id_col].dataType.typeName() not in ("byte", "short", "integer", "long"):
        rows = written(docs.where(F.col(id_col).isNotNull()).select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")))
        first = written(rows.groupBy("doc_id").agg(F.lit(1)).select("doc_id", F.monotonically_increasing_id().alias("number")))
        groups = near_groups(rows.join(first, "doc_id").select("number", "text"), "number", "text", words, similarity).withColumnRenamed("doc_id", "number")
        named = cut(groups.join(first, "number").select("doc_id", "component_id"))
        return named.join(named.groupBy("component_id").agg(F.min("doc_id").alias("least")), "component_id").select("doc_id", F.col("least").alias("component_id"))
    slim = docs.where(F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    order = slim.sparkSession.sparkContext.broadcast(_frequent(slim, words))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for b in (whole.slice(i, 256) for i in range(0, whole.num_rows, 256)):
                sets = [shingle_set(t.as_py(), words) for t in b.column(1)]
                keys = [prefix(s, similarity, *order.value).view(np.int64) for s in sets]
                odd = [parity(s) for s in sets]
                short = [folded(np.frombuffer(x, np.uint64)[None, :], PARITY // 64).tobytes() for x in odd]
                fps = np.array([bits_of(s) if len(s) else 0 for s in sets], dtype=np.uint64).view(np.int64)
                cols = [pa.array(fps), pa.array([len(s) for s in sets], pa.int64()), pa.array(odd, pa.binary()), pa.array(short, pa.binary()), pa.array(keys, pa.list_(pa.int64()))]
                yield pa.RecordBatch.from_arrays([b.column(0), *cols], names=["id", "fp", "size", "odd", "short", "keys"])

    def plausible(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            a_n, b_n = (b.column(i).to_numpy(zero_copy_only=False) for i in (2, 3))
            a_odd, b_odd = (b.column(i).to_numpy(zero_copy_only=False) for i in (4, 5))
            a_words, b_words, fine = _words(a_odd), _words(b_odd), sizes_fit(a_n, b_n, similarity)
            for v, w in {*zip(a_words[fine].tolist(), b_words[fine].tolist(), strict=True)}:
                at = np.flatnonzero(fine & (a_words == v) & (b_words == w))
                for k in range(0, len(at), PAIRS):
                    some = at[k : k + PAIRS]
                    fine[some] = may_be_near(a_n[some], b_n[some], folded(_odd(a_odd[some], v), min(v, w)), folded(_odd(b_odd[some], w), min(v, w)), similarity)
            yield b.select(["a", "b"]).filter(pa.array(fine))

    def likely(pairs: DataFrame, odd: str) -> DataFrame:
        """Pairs that sizes and these sketches do not rule out."""
        about_a, about_b = (heads.select(F.col("id").alias(c), F.col("size").alias(f"n_{c}"), F.col(odd).alias(f"odd_{c}")) for c in "ab")
        both = pairs.join(about_a, "a").join(about_b, "b").where(f"least(n_a, n_b) >= {similarity} * greatest(n_a, n_b) - 1e-9")
        return both.select("a", "b", "n_a", "n_b", "odd_a", "odd_b").mapInArrow(plausible, "a long, b long")

    def verified(pairs: DataFrame) -> DataFrame:
        """Pairs whose whole shingle sets are similar: texts travel, one a pair, to the text that they are compared with.

        Partners of one document are cut into parts of about NEAR_BLOCK, to each of which that document goes.
        """
        pairs = cut(pairs)
        ids = pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct()
        texts = written(slim.join(ids, "id", "left_semi"))
        sizes = pairs.groupBy("a").agg(F.ceil(F.count(F.lit(1)) / NEAR_BLOCK).alias("parts"))
        dealt = pairs.join(sizes, "a").select("a", F.pmod(F.xxhash64("b"), F.col("parts")).alias("part"), F.col("b").alias("id"))
        firsts = dealt.select("a", "part", F.col("a").alias("id")).distinct()
        rows = firsts.join(texts, "id").unionAll(dealt.join(texts, "id").select("id", "a", "part", "text"))
        rows = rows.repartition("a", "part").sortWithinPartitions("a", "part", F.col("id") != F.col("a"))
        return cut(rows.mapInArrow(_similar(words, similarity), "a long, b long").distinct())

    heads = written(slim.mapInArrow(scan, "id long, fp long, size long, odd binary, short binary, keys array<long>"))
    key = Window.partitionBy("key")
    lead = F.min(F.struct(F.xxhash64("id", F.pmod("key", F.lit(LEADERS))).alias("h"), F.col("id").alias("lead"))).over(key)
    rows = heads.select("id", F.explode("keys").alias("key")).withColumns({"n": F.count(F.lit(1)).over(key), "lead": lead})
    shared = cut(rows.where("n > 1").select("key", "id", "lead.lead"))
    led = shared.where("id <> lead").select(F.least("id", "lead").alias("a"), F.greatest("id", "lead").alias("b"))
    met = simhash_links(heads.select("id", "fp")).unionAll(led).distinct()
    first = verified(likely(cut(likely(met, "short")), "odd"))
    joined = connected_components(first, "a", "b", ALONE).select(F.col("node").alias("id"), "component")
    rest = shared.join(joined, "id", "left").select("key", "id", F.coalesce("component", "id").alias("component"))
    rest = rest.withColumns({"low": F.min("component").over(key), "high": F.max("component").over(key)}).where("low <> high").select("key", "id", "component")
    on = ["key", "_i", "_j"]
    dealt = in_blocks(cut(rest), ["key"], "id", NEAR_BLOCK).join(heads.select("id", "size", "odd"), "id").select(*on, "_block", "id", "component", "size", "odd")
    maybe = cut(dealt.repartition(*on).sortWithinPartitions(*on, "id").mapInArrow(_across(similarity), "a long, b long").distinct())
    chained = connected_components(maybe, "a", "b", ALONE).select(F.col("node").alias("id"), F.col("component").alias("key"))
    texts = written(slim.join(chained, "id").join(joined, "id", "left").select("key", "id", F.coalesce("component", "id").alias("component"), "text", F.coalesce(F.length("text"), F.lit(0)).alias("chars")))
    dealt = in_blocks(texts, ["key"], "id", NEAR_BLOCK, "chars", NEAR_CHARS).select(*on, "_block", "id", "component", "text")
    second = cut(dealt.repartition(*on).sortWithinPartitions(*on, "id").mapInArrow(_among(words, similarity), "a long, b long").distinct())
    return connected_components(first.unionAll(second), "a", "b", ALONE).select(F.col("node").alias("doc_id"), F.col("component").alias("component_id"))


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = NEAR_WORDS, similarity: float = NEAR_SIMILARITY) -> DataFrame:
    """``docs`` with one document of each near-duplicate group: the one of the smallest identifier.

    Null and empty texts, and those of no words, are near duplicates of each other. Rows without an identifier stay, and so
    do rows that repeat one that stays; an empty table gives an empty result. Columns may have any names.
    """
    drop = cut(near_groups(docs, id_col, text_col, words, similarity).where("doc_id <> component_id").select(F.col("doc_id").alias("id")))
    return docs.alias("d").join(drop.alias("dropped"), F.col(f"d.{id_col}") == F.col("dropped.id"), "left_anti")


def op4_simhash_bk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_components(spark.read.parquet(f"{sf_dir}/documents.parquet"))
