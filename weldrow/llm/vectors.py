"""Embedding near-duplicates: iterative quantisation, multi-index Hamming tables, reranking with the vectors."""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weldrow.llm.blocks import in_blocks
from weldrow.llm.runs import Sets, iter_runs
from weldrow.llm.sampling import about
from weldrow.operators.components import connected_components
from weldrow.session import cut

#: Cosine from which two vectors are linked.
COSINE = 0.98
#: Vectors that rotations are learned from, at most about; rounds of learning.
TRAIN_ROWS, LEARN_ROUNDS = 20_000, 30
#: Part of the pairs at the threshold that some table must bring together, by which the number of tables is set.
RECALL = 0.99
#: Substring bits at least and at most; rows of a bucket compared at once.
LEAST_BITS, MOST_BITS, BLOCK = 8, 30, 1024
#: Pairs at the threshold that are made for a label, about; tables of a substring length at most.
PAIRS, MOST_TABLES = 1000, 64


@dataclass
class Coder:
    """Codes of vectors of one length: centre, then rotations whose signs are the bits."""

    centre: np.ndarray
    rotations: list[np.ndarray]
    tables: list[tuple[int, np.ndarray]]  # (rotation, its bit columns)

    def keys(self, unit: np.ndarray) -> np.ndarray:
        """(rows, tables): each table's substring of the code as a whole number."""
        bits = [((unit - self.centre) @ r) > 0 for r in self.rotations]
        out = np.empty((len(unit), len(self.tables)), dtype=np.int64)
        for t, (r, cols) in enumerate(self.tables):
            out[:, t] = bits[r][:, cols] @ (1 << np.arange(len(cols), dtype=np.int64))
        return out


def itq(x: np.ndarray, rounds: int, rng: np.random.Generator) -> np.ndarray:
    """A rotation for balanced codes (Gong and Lazebnik 2011): signs and rotation are fitted to each other in turns."""
    axes = np.linalg.eigh(x.T @ x)[1]
    v = x @ axes
    r = np.linalg.qr(rng.standard_normal((x.shape[1], x.shape[1])))[0]
    for _ in range(rounds):
        u, _, w = np.linalg.svd(np.where(v @ r >= 0, 1.0, -1.0).T @ v)
        r = (u @ w).T
    return axes @ r


def partners(x: np.ndarray, cosine: float, rng: np.random.Generator) -> np.ndarray:
    """For each unit vector another at ``cosine``, in a random direction."""
    off = rng.standard_normal(x.shape)
    off -= (off * x).sum(axis=1, keepdims=True) * x
    size = np.sqrt((off * off).sum(axis=1, keepdims=True))
    y = cosine * x + math.sqrt(1 - cosine * cosine) * off / np.where(size > 1e-9, size, np.inf)
    return y / np.sqrt((y * y).sum(axis=1, keepdims=True))


def learn(x: np.ndarray, rows: int, cosine: float = COSINE, recall: float = RECALL, labels: np.ndarray | None = None) -> Coder:
    """A coder for ``rows`` vectors under one label like those in ``x`` (unit length, of ``labels``).

    Substrings are as long as leaves a bucket about one vector. How often a bit differs depends on where the vectors
    lie about the centre, so the number of tables is measured: pairs at the threshold are made around the vectors of
    each label, and tables are added until those of every label meet in some table as often as ``recall`` asks for. A
    rotation gives dim // length disjoint substrings. Where MOST_TABLES do not do it, substrings become shorter; of no
    bits, all vectors meet.
    """
    dim = x.shape[1]
    rng, centre = np.random.default_rng(7), x.mean(axis=0)
    _, group = np.unique(np.zeros(len(x), np.int64) if labels is None else labels, return_inverse=True)
    # rotations fit the vectors that they are learned from, so pairs are made around others, where a label has them
    apart = np.arange(len(x)) % 2 == 1
    tried = apart | ~np.isin(group, group[apart])
    learned = x[~apart] - centre
    need = PAIRS // np.bincount(group[tried])[group[tried]] + 1
    left, owner = np.repeat(x[tried], need, axis=0), np.repeat(group[tried], need)
    right = partners(left, cosine, rng)
    size = np.bincount(owner)
    rotations: list[np.ndarray] = []
    for bits in range(min(dim, max(LEAST_BITS, min(MOST_BITS, math.ceil(math.log2(max(2, rows)))))), 0, -1):
        tables, met = [], np.zeros(len(left), dtype=bool)
        while len(tables) < MOST_TABLES:
            r, k = divmod(len(tables), dim // bits)
            if r == len(rotations):
                rotations.append(itq(learned, LEARN_ROUNDS, rng))
            cols = np.arange(k * bits, (k + 1) * bits)
            tables.append((r, cols))
            axes = rotations[r][:, cols]
            rest = np.flatnonzero(~met)
            met[rest] = ((((left[rest] - centre) @ axes) > 0) == (((right[rest] - centre) @ axes) > 0)).all(axis=1)
            if (np.bincount(owner, weights=met) >= recall * size).all():
                return Coder(centre, rotations[: r + 1], tables)
    return Coder(centre, [np.eye(dim)], [(0, np.arange(0))])


def unit(vectors: np.ndarray) -> np.ndarray:
    x = vectors.astype(np.float64)
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def _matrices(embedding: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(positions, matrix) for each length of the lists."""
    offsets, flat = embedding.offsets.to_numpy(), embedding.values.to_numpy(zero_copy_only=False)
    sizes = np.diff(offsets)
    for dim in np.unique(sizes):
        at = np.flatnonzero(sizes == dim)
        yield at, flat[offsets[at][:, None] + np.arange(dim)[None, :]] if len(at) else np.empty((0, dim))


def _links(cosine: float):
    """Over sorted block pairs: (class, links that it has here, least class that it is linked to here)."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        held = 0

        def flush() -> pa.RecordBatch:
            cols = [np.concatenate(x) if out else np.empty(0, np.int64) for x in (zip(*out, strict=True) if out else ([], [], []))]
            return pa.RecordBatch.from_arrays([pa.array(c.astype(np.int64)) for c in cols], names=["rep", "links", "to"])

        for run in iter_runs(batches, ["label", "dim", "t", "key", "_i", "_j"], lists=("embedding", "keys")):
            if len(run["rep"]) < 2:
                continue
            x, keys, reps, copies = unit(np.stack(run["embedding"])), np.stack(run["keys"]), run["rep"], run["copies"]
            near = x @ x.T >= cosine
            np.fill_diagonal(near, False)
            if run["_i"][0] != run["_j"][0]:
                near &= run["_block"][:, None] != run["_block"][None, :]
            for t in range(int(run["t"][0])):  # pairs that an earlier table brings together count there
                if not near.any():
                    break
                near &= keys[:, t][:, None] != keys[:, t][None, :]
            a, b = np.nonzero(near)
            if not len(a):
                continue
            order = np.argsort(reps, kind="stable")
            rank = np.empty_like(order)
            rank[order] = np.arange(len(order))
            sets = Sets(len(reps))
            up = a < b
            for p, q in zip(rank[a[up]].tolist(), rank[b[up]].tolist(), strict=True):
                sets.union(p, q)
            mine = np.unique(a)
            top = reps[order[[sets.find(r) for r in rank[mine].tolist()]]]
            out.append((reps[mine], np.bincount(a, weights=copies[b], minlength=len(reps))[mine].astype(np.int64), top))
            held += len(mine)
            if held > 50_000:
                yield flush()
                out, held = [], 0
        yield flush()

    return scan


def near_vectors(rows: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", label_col: str = "label", cosine: float = COSINE, train_rows: int = TRAIN_ROWS, block: int = BLOCK) -> DataFrame:
    """One row per input row: ``vec_id, n_links, component_id, kept``.

    Vectors are compared when labels are equal and not null and lengths agree, by cosine in double precision. Null,
    empty and zero vectors, vectors with a null or non-finite component and rows with a null identifier link with
    nothing. Equal vectors of a label are one class: compared once, each copy counting as a link of the others. Every
    vector is indexed; a link that no table brings together is missed (about one in a hundred at the threshold). Other
    columns are not read. An empty table gives an empty result.
    """
    slim = rows.select(F.col(id_col).alias("vec_id"), F.col(vec_col).cast("array<double>").alias("embedding"), F.col(label_col).cast("long").alias("label"))
    fine = F.forall("embedding", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))) & F.exists("embedding", lambda v: v != 0)
    slim = cut(slim.withColumn("fine", F.coalesce(fine & F.col("label").isNotNull() & F.col("vec_id").isNotNull(), F.lit(False))))
    good = slim.where("fine")
    classes = cut(good.groupBy("label", "embedding").agg(F.min("vec_id").alias("rep"), F.count(F.lit(1)).alias("copies")))
    sizes = classes.groupBy("label", F.size("embedding").alias("dim")).count().groupBy("dim").agg(F.max("count").alias("n")).collect()
    sample = about(classes.select("embedding", "label", "rep"), F.col("rep"), train_rows).select("embedding", "label").toArrow()
    sample = [(v, y) for c in sample.to_batches() for at, xs in _matrices(c.column(0)) for v, y in zip(xs, c.column(1).to_numpy()[at].tolist(), strict=True)]
    coders: dict[int, Coder] = {}
    for dim, n in sorted((r["dim"], r["n"]) for r in sizes):
        x = [(v, y) for v, y in sample if len(v) == dim]
        coders[dim] = learn(unit(np.stack([v for v, _ in x])), n, cosine, labels=np.array([y for _, y in x])) if len(x) > 1 else learn(np.eye(dim)[:1], n, cosine)
    shared = slim.sparkSession.sparkContext.broadcast(coders)

    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keys = np.empty(b.num_rows, dtype=object)
            for at, x in _matrices(b.column(0)):
                got = shared.value[x.shape[1]].keys(unit(x)) if len(at) else np.empty((0, 0))
                for i, k in zip(at.tolist(), got, strict=True):
                    keys[i] = k
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(list(keys), pa.list_(pa.int64()))], names=["embedding", "label", "rep", "copies", "keys"])

    coded = classes.select("embedding", "label", "rep", "copies").mapInArrow(code, "embedding array<double>, label long, rep long, copies long, keys array<long>")
    dealt = coded.select("*", F.size("embedding").alias("dim"), F.posexplode("keys").alias("t", "key"))
    on = ["label", "dim", "t", "key", "_i", "_j"]
    pairs = in_blocks(dealt, on[:4], "rep", block).select(*on, "_block", "rep", "copies", "embedding", "keys")
    found = cut(pairs.repartition(*on).sortWithinPartitions(*on, "rep").mapInArrow(_links(cosine), "rep long, links long, to long"))
    links = found.groupBy("rep").agg(F.sum("links").alias("links"))
    labels = connected_components(found, "rep", "to").select(F.col("node").alias("rep"), "component")
    known = classes.join(links, "rep", "left").join(labels, "rep", "left")
    known = known.select("label", "embedding", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("component", "rep").alias("component_id"))
    done = good.select("vec_id", "label", "embedding").join(known, ["label", "embedding"]).select("vec_id", "n_links", "component_id")
    alone = slim.where("not fine").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return done.unionAll(alone).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))


def op10_itq_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_vectors(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
