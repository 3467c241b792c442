"""Language identification: a bit-sliced Bloom filter returns all languages that know an n-gram; popcounts decide."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weldrow.llm.sampling import SPAN, remainder

#: Letters in an n-gram, word ends (one space) included; hash functions; slots per n-gram of the richest language.
GRAM, HASHES, ROOM = 4, 3, 16
#: Of each language, at most about so many labelled rows are learned from, taken by hash; languages at most.
TRAIN_ROWS, MOST_LANGUAGES = 2000, 10_000
#: A language knows an n-gram that so large a part of its documents (and two of them, if it has ten) hold.
SUPPORT = 0.005
#: Folds, the held-out one, and the code for texts without a letter.
FOLDS, HELD_OUT, UNDETERMINED = 4, 2, "und"
#: In a pipeline: documents whose best language knows a smaller part of their n-grams go.
KEEP_FROM = 0.3
#: Characters hashed at once: few in prediction, so that a worker's arrays stay small; more in training, where each step's
#: counts are one set of rows.
STEP, TRAIN_STEP = 1 << 18, 1 << 20

_LETTER: np.ndarray | None = None
_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def _letters() -> np.ndarray:
    """Whether a code point is a letter, as Unicode says."""
    global _LETTER
    if _LETTER is None:
        _LETTER = np.fromiter((chr(i).isalpha() for i in range(0x110000)), dtype=bool, count=0x110000)
    return _LETTER


def grams(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash of every n-gram, position of its text, whether each text has a letter); case is folded, runs of other characters are one space."""
    low = [" " + (t or "").lower() + " " for t in texts]
    sizes = np.fromiter(map(len, low), dtype=np.int64, count=len(low))
    codes = np.frombuffer("".join(low).encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    letter = _letters()[codes]
    owner = np.repeat(np.arange(len(low), dtype=np.int32), sizes)
    has = np.zeros(len(low), dtype=bool)
    has[owner[letter]] = True
    keep = letter.copy()
    keep[1:] |= letter[:-1]
    first = np.concatenate(([0], np.cumsum(sizes)[:-1])) if len(low) else np.empty(0, np.int64)
    keep[first] = True  # each text begins with one space
    codes = np.where(letter, codes, np.uint32(32))[keep].astype(np.uint64)
    owner = owner[keep]
    n = len(codes) - GRAM + 1
    if n <= 0:
        return np.empty(0, np.uint64), np.empty(0, np.int32), has
    h = codes[:n].copy()
    for k in range(1, GRAM):
        h = h * np.uint64(0x100000001B3) + codes[k : n + k]
    h ^= h >> np.uint64(30)
    h *= _M1
    h ^= h >> np.uint64(27)
    h *= _M2
    h ^= h >> np.uint64(31)
    same = owner[:n] == owner[GRAM - 1 :]
    return h[same], owner[:n][same], has


def _steps(texts: list[str | None], step: int = STEP) -> Iterator[tuple[int, int]]:
    """Slices of the batch with about ``step`` characters; a longer text is a slice of its own."""
    start = size = 0
    for i, t in enumerate(texts):
        n = len(t or "")
        if size and size + n > step:
            yield start, i
            start, size = i, 0
        size += n
    yield start, len(texts)


@dataclass
class Filters:
    """Slots whose bit l says that an n-gram of language l hashes here."""

    languages: list[str]
    slots: np.ndarray  # (2 ** bits, words of 64 languages; bytes, if 8 are enough)
    false_rate: np.ndarray

    @staticmethod
    def places(h: np.ndarray, bits: int) -> list[np.ndarray]:
        """Slots of every hash function: its lower half and odd steps of its upper half from there."""
        mask, step = np.uint64((1 << bits) - 1), (h >> np.uint64(32)) | np.uint64(1)
        return [((h + np.uint64(k) * step) & mask).astype(np.int64) for k in range(HASHES)]

    @classmethod
    def build(cls, known: dict[str, np.ndarray]) -> Filters:
        languages = sorted(known)
        bits = int(np.ceil(np.log2(max(1024, ROOM * max((len(x) for x in known.values()), default=1)))))
        slots = np.zeros((1 << bits, max(1, -(-len(languages) // 64))), dtype=np.uint8 if len(languages) <= 8 else np.uint64)
        for i, lang in enumerate(languages):
            for at in cls.places(known[lang], bits):
                slots[at, i // 64] |= slots.dtype.type(1 << (i % 64))
        fill = np.array([((slots[:, i // 64] >> np.uint64(i % 64)) & np.uint64(1)).mean() for i in range(len(languages))])
        return cls(languages, slots, fill**HASHES)

    def predict(self, texts: list[str | None]) -> tuple[list[str], np.ndarray]:
        """Language and score of each text. The score is the best corrected share; ties go to the first language by name."""
        out, scores = [UNDETERMINED] * len(texts), np.zeros(len(texts))
        bits = int(len(self.slots)).bit_length() - 1
        for s, e in _steps(texts):
            h, owner, has = grams(texts[s:e])
            first, *others = self.places(h, bits)
            found = self.slots[first]
            for at in others:
                found &= self.slots[at]
            total = np.bincount(owner, minlength=e - s)
            share = np.zeros((e - s, len(self.languages)))
            for i in range(len(self.languages)):
                hit = ((found[:, i // 64] >> np.uint64(i % 64)) & np.uint64(1)).astype(bool)
                share[:, i] = np.bincount(owner[hit], minlength=e - s)
            share = share / np.maximum(total, 1)[:, None]
            share = np.clip((share - self.false_rate) / np.maximum(1 - self.false_rate, 1e-9), 0, 1)
            if self.languages:
                best = share.argmax(axis=1)
                for i in np.flatnonzero(has).tolist():
                    out[s + i] = self.languages[best[i]]
                scores[s:e] = np.where(has, share[np.arange(e - s), best], 0.0)
        return out, scores


def fit(docs: DataFrame, train_rows: int = TRAIN_ROWS) -> Filters:
    """Learns from text and lang of documents outside the held-out fold, whole texts: at most about ``train_rows`` a language.

    So a rare language is learned at every size of the table. Per language, n-grams are counted by document, in partial sums per task and then per n-gram; those with enough
    support enter the filter. Their number is bounded by the sample.
    """
    pool = docs.where((remainder(F.col("doc_id"), FOLDS) != HELD_OUT) & F.col("lang").isNotNull())
    pool = pool.where("text is not null").select("doc_id", "lang", "text")
    held = pool.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).limit(MOST_LANGUAGES + 1).collect()
    if len(held) > MOST_LANGUAGES:
        raise ValueError(f"lang has over {MOST_LANGUAGES} values")
    shares = docs.sparkSession.createDataFrame([(r["lang"], int(SPAN * min(1.0, train_rows / r["n"]))) for r in held], "lang string, share long")
    drawn = F.pmod(F.xxhash64(F.col("doc_id").cast("string"), F.lit("sample")), F.lit(SPAN)) < F.col("share")
    sample = pool.join(F.broadcast(shares), "lang").where(drawn).select("lang", "text")

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            langs, texts = b.column(0).to_pylist(), b.column(1).to_pylist()
            for s, e in _steps(texts, TRAIN_STEP):
                h, owner, _ = grams(texts[s:e])
                names = sorted(set(langs[s:e]))
                number = np.array([names.index(x) for x in langs[s:e]], dtype=np.int64)
                for i, name in enumerate(names):
                    mine = number[owner] == i
                    gram, whose = h[mine], owner[mine]
                    order = np.lexsort((whose, gram))
                    gram, whose = gram[order], whose[order]
                    new = np.append(True, (gram[1:] != gram[:-1]) | (whose[1:] != whose[:-1]))[: len(gram)]  # a document's once
                    gram, docs_with = np.unique(gram[new], return_counts=True)
                    yield pa.RecordBatch.from_arrays([pa.array([name] * len(gram), pa.string()), pa.array(gram.view(np.int64)), pa.array(docs_with)], names=["lang", "gram", "n"])

    counted = sample.mapInArrow(scan, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    sizes = sample.groupBy("lang").agg(F.count(F.lit(1)).alias("docs"))
    least = F.greatest(F.lit(SUPPORT) * F.col("docs"), F.when(F.col("docs") >= 10, 2).otherwise(1))
    rows = counted.join(sizes, "lang").where(F.col("n") >= least).select("lang", "gram").toPandas()
    return Filters.build({lang: g["gram"].to_numpy().view(np.uint64) for lang, g in rows.groupby("lang")})


def identify(docs: DataFrame, filters: Filters, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: ``doc_id, held_out, lang_pred, score``.

    Texts that are null or have no letter are ``und`` with score 0. Repeated rows are judged each; other columns are
    not read; an empty table gives an empty result; without training rows every text is ``und``. The filter's size is
    fixed by the training sample.
    """
    shared = docs.sparkSession.sparkContext.broadcast(filters)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            langs, scores = shared.value.predict(b.column(1).to_pylist())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(langs, pa.string()), pa.array(scores, pa.float64())], names=["doc_id", "lang_pred", "score"])

    slim = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    out = slim.mapInArrow(scan, f"doc_id {slim.schema['doc_id'].dataType.simpleString()}, lang_pred string, score double")
    return out.select("doc_id", (remainder(F.col("doc_id"), FOLDS) == HELD_OUT).alias("held_out"), "lang_pred", "score")


def keep_known(docs: DataFrame, keep_from: float = KEEP_FROM) -> DataFrame:
    """``docs`` without those of no known language: no letters, or a score under ``keep_from``. One pass, nothing is shuffled.

    Null and empty texts have no letters and go. Repeated rows are judged each; columns stay as they are, whatever their
    names; an empty table gives an empty result.
    """
    shared = docs.sparkSession.sparkContext.broadcast(fit(docs))
    at = docs.columns.index("text")

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            langs, scores = shared.value.predict(b.column(at).to_pylist())
            yield b.filter(pa.array([x != UNDETERMINED and y >= keep_from for x, y in zip(langs, scores, strict=True)], pa.bool_()))

    return docs.mapInArrow(scan, docs.schema)


def op5_bloom_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return identify(docs, fit(docs))
