"""Quality classifier: logistic regression on hashed word n-grams, trained with follow-the-regularised-leader."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weldrow.llm.sampling import about, remainder

#: Hash space: 2 ** BITS weights.
BITS = 20
#: At most about so many labelled rows are trained on, taken by hash; whole passes over them make so many updates at least.
TRAIN_ROWS, UPDATES = 6000, 12_000
#: FTRL-proximal: learning rate, its offset, and the two penalties.
ALPHA, BETA, L1, L2 = 0.3, 1.0, 1e-4, 1e-4
#: Score from which a document is kept; folds of which one is held out.
KEEP_FROM, FOLDS = 0.3, 5

_WORD = re.compile(rb"[a-zA-Z0-9\x80-\xff]+|[^a-zA-Z0-9\x80-\xff\s]+")
_SALT = np.uint32(0x9E3779B1)


def features(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """(indices, values) of a text: hashed words, word pairs, and the patterns "word, same word" at one and two steps.

    Values are square roots of counts, scaled to length one; the empty text has none.
    """
    words = _WORD.findall((text or "").encode("utf-8", "surrogatepass"))
    if not words:
        return np.empty(0, np.int64), np.empty(0)
    one = np.fromiter(map(crc32, words), dtype=np.uint32, count=len(words))
    two = (one[:-1] * _SALT) ^ (one[1:] + np.uint32(0x85EBCA6B))
    repeats = [np.full(int((one[k:] == one[:-k]).sum()), crc32(b"\x00same%d" % k), np.uint32) for k in (1, 2)]
    grams = np.concatenate([one, two, *repeats])
    index, count = np.unique((grams ^ (grams >> np.uint32(BITS - 8))) & np.uint32((1 << BITS) - 1), return_counts=True)
    value = np.sqrt(count)
    return index.astype(np.int64), value / np.sqrt((value * value).sum())


@dataclass
class Model:
    """Sparse weights over the hash space and an intercept."""

    weights: np.ndarray
    bias: float

    def score(self, text: str | None) -> float:
        index, value = features(text)
        x = float(self.weights[index] @ value) + self.bias
        return float(1 / (1 + np.exp(-x)))


def train(rows: list[tuple[str | None, int]], updates: int = UPDATES) -> Model:
    """FTRL-proximal (McMahan et al. 2013), one update a document, in the given order."""
    z, n = np.zeros(1 << BITS), np.zeros(1 << BITS)
    zb = nb = bias = 0.0
    prepared = [(*features(t), y) for t, y in rows]
    for _ in range(max(2, -(-updates // max(1, len(rows))))):
        for index, value, y in prepared:
            zi, ni = z[index], n[index]
            w = np.where(np.abs(zi) > L1, -(zi - np.sign(zi) * L1) / ((BETA + np.sqrt(ni)) / ALPHA + L2), 0.0)
            bias = -zb / ((BETA + np.sqrt(nb)) / ALPHA + L2)
            g = 1 / (1 + np.exp(-(w @ value + bias))) - y
            grad = g * value
            z[index] += grad - (np.sqrt(ni + grad * grad) - np.sqrt(ni)) / ALPHA * w
            n[index] += grad * grad
            zb += g - (np.sqrt(nb + g * g) - np.sqrt(nb)) / ALPHA * bias
            nb += g * g
    w = np.where(np.abs(z) > L1, -(z - np.sign(z) * L1) / ((BETA + np.sqrt(n)) / ALPHA + L2), 0.0)
    return Model(w.astype(np.float32), -zb / ((BETA + np.sqrt(nb)) / ALPHA + L2))


def fit(docs: DataFrame, labels: DataFrame, train_rows: int = TRAIN_ROWS) -> Model:
    """Trains on at most about ``train_rows`` documents outside the held-out fold whose ``quality`` is 0 or 1.

    Only the text is a feature. Where labels repeat a doc_id, each counts. Without any labelled row every score is 0.5.
    """
    known = labels.where("quality in (0, 1)").select(F.col("doc_id").alias("_id"), "quality")
    pool = known.where(remainder(F.col("_id"), FOLDS) != 0)
    chosen = about(pool, F.col("_id"), train_rows)  # so it may be broadcast
    rows = docs.select(F.col("doc_id").alias("_id"), "text").join(F.broadcast(chosen), "_id").select("_id", "quality", "text").toPandas()
    rows = rows.assign(order=[crc32(str(i).encode()) for i in rows["_id"]]).sort_values(["order", "quality"], kind="stable")
    return train(list(zip(rows["text"], rows["quality"].astype(int), strict=True)))


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", keep_from: float = KEEP_FROM) -> DataFrame:
    """One row per input row: ``doc_id, held_out, score, predicted``.

    Null and empty texts have the score of the intercept alone. Repeated rows are scored each; other columns are not
    read; an empty table gives an empty result. The model is of fixed size, however many rows there are.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            got = shared.value
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([got.score(t.as_py()) for t in b.column(1)], pa.float64())], names=["doc_id", "score"])

    slim = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    out = slim.mapInArrow(scan, f"doc_id {slim.schema['doc_id'].dataType.simpleString()}, score double")
    return out.select("doc_id", (remainder(F.col("doc_id"), FOLDS) == 0).alias("held_out"), "score", (F.col("score") >= keep_from).cast("int").alias("predicted"))


def keep_good(docs: DataFrame, labels: DataFrame, keep_from: float = KEEP_FROM) -> DataFrame:
    """``docs`` without those that score below ``keep_from``; columns stay as they are. One pass, nothing is shuffled.

    Null and empty texts have the score of the intercept. Repeated rows are judged each; columns may have any names; an
    empty table gives an empty result.
    """
    shared = docs.sparkSession.sparkContext.broadcast(fit(docs, labels))
    at = docs.columns.index("text")

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            got = shared.value
            yield b.filter(pa.array([got.score(t.as_py()) >= keep_from for t in b.column(at)], pa.bool_()))

    return docs.mapInArrow(scan, docs.schema)


def op3_ftrl_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet")
    return score(docs, fit(docs, labels))
