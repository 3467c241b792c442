"""Order-preserving packing: dynamic programming over window cuts, with a monotone queue."""

from __future__ import annotations

import json
import re
from collections import deque
from collections.abc import Iterator
from zlib import crc32

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

LENGTH, END_ID = 2048, 1
VOCABULARY = "byte_bpe_50k.json"
#: What a cut costs, in tokens of padding: at a sentence's end and anywhere else inside a document.
SENTENCE_CUT, HARD_CUT = 4, 24
#: Window sizes that need no padding.
UNPADDED = tuple(1 << k for k in range(9, 11))
#: Tokens planned at once; the last windows of a block are planned again with the next one.
BLOCK = 1 << 18


def byte_alphabet() -> dict[str, int]:
    """The printable letter that a byte-level vocabulary writes for each byte: itself where it prints, else from 256 on."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    others = iter(range(256, 512))
    return {chr(b if b in plain else next(others)): b for b in range(256)}


class Encoder:
    """Ids of whole texts as a byte-level BPE file of the tokenizers library gives them.

    The file's vocabulary numbers tokens in the order of its merges, so tiktoken's core gives the same ids from the
    numbers alone, in a quarter of the time. Added tokens in a text are tokens, as in the library.
    """

    def __init__(self, path: str) -> None:
        import tiktoken

        with open(path, encoding="utf-8") as f:
            file = json.load(f)
        alphabet = byte_alphabet()
        special = {t["content"]: t["id"] for t in file["added_tokens"]}
        pieces = {i: bytes(alphabet[c] for c in t) for t, i in file["model"]["vocab"].items() if t not in special}
        self.core = tiktoken.Encoding("file", pat_str=public_tokenizers.PATTERN, mergeable_ranks={p: i for i, p in pieces.items()}, special_tokens=special)
        size = max([*pieces, *special.values()]) + 1
        self.closes, self.opens = np.zeros(size, bool), np.ones(size, bool)
        for i, p in pieces.items():
            self.closes[i] = bool(re.search(rb"[.!?]['\")\]]*\s*$|\n\s*$", p))
            self.opens[i] = bool(re.match(rb"\s", p))

    def ids(self, text: str) -> bytes:
        """Little-endian unsigned 32-bit ids."""
        return self.core.encode_to_numpy(text, allowed_special="all").astype("<u4").tobytes()


_ENCODERS: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]


def plan(cuts: np.ndarray, costs: np.ndarray, length: int = LENGTH, unpadded: tuple[int, ...] = UNPADDED) -> list[int]:
    """Cheapest cuts of a stretch of tokens into windows of at most ``length``.

    ``cuts``: rising positions where a window may end; the first is the stretch's start, the last its end, and no two
    neighbours are more than ``length`` apart. ``costs``: what each adds besides padding. A window is padded to
    ``length`` unless its size is in ``unpadded``. Returns the positions of window ends.

    The cost of reaching j is the least of (cost of i - j + i's position) over the i in reach plus terms of j alone, so
    a queue of rising keys gives it in constant time; exact sizes are looked up. Of equal costs the earlier cut wins.
    """
    at, extra = cuts.tolist(), costs.tolist()
    best, came = [0.0] * len(at), [0] * len(at)
    queue: deque[tuple[float, int]] = deque([(float(at[0]), 0)])
    where = {at[0]: 0}
    for j in range(1, len(at)):
        pos = at[j]
        while at[queue[0][1]] < pos - length:
            queue.popleft()
        key, i = queue[0]
        cost = key + length - pos
        for size in unpadded:
            k = where.get(pos - size)
            if k is not None and best[k] < cost:
                cost, i = best[k], k
        cost += extra[j]
        best[j], came[j] = cost, i
        where[pos] = j
        key = cost + pos
        while queue and queue[-1][0] > key:
            queue.pop()
        queue.append((key, j))
    out, j = [], len(at) - 1
    while j:
        out.append(at[j])
        j = came[j]
    return out[::-1]


def candidates(ids: np.ndarray, doc_ends: np.ndarray, closes: np.ndarray, opens: np.ndarray, length: int = LENGTH) -> tuple[np.ndarray, np.ndarray]:
    """(positions, costs) of allowed cuts: document ends, sentence ends, and every ``length // 8`` tokens without either."""
    sentence = np.flatnonzero(closes[np.minimum(ids[:-1], len(closes) - 1)] & opens[np.minimum(ids[1:], len(opens) - 1)]) + 1
    soft = np.union1d(sentence, doc_ends)
    soft = np.union1d(soft, [0, len(ids)])
    gaps = np.diff(soft)
    step = length // 8
    wide = np.flatnonzero(gaps > step)
    hard = np.concatenate([np.arange(soft[w] + step, soft[w + 1], step) for w in wide]) if len(wide) else np.empty(0, np.int64)
    cuts = np.union1d(soft, hard).astype(np.int64)
    costs = np.full(len(cuts), float(HARD_CUT))
    costs[np.isin(cuts, sentence)] = SENTENCE_CUT
    costs[np.isin(cuts, doc_ends)] = 0.0
    costs[-1] = 0.0
    return cuts, costs


def tail_sizes(n: int, length: int = LENGTH) -> list[int]:
    """The last tokens of a stream, under one window: powers of two from the largest, so that nothing is padded."""
    return [length] * (n // length) + [1 << k for k in range(length.bit_length() - 1, -1, -1) if n % length >> k & 1]


def packer(path: str, length: int, end_id: int):
    """Partition function: rows (doc_id, text) in order to pieces."""
    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, end = encoder(path), np.array([end_id], dtype="<u4").tobytes()
        sequence = TaskContext.get().partitionId() << 40
        docs: list[list] = []  # [doc_id, ids, tokens already packed]
        waiting = 0
        kind = None

        def pack(last: bool) -> pa.RecordBatch:
            nonlocal sequence, waiting, docs
            rest = [d[1][4 * d[2] :] for d in docs]
            ids = np.frombuffer(b"".join(rest), dtype="<u4")
            ends = np.cumsum([len(r) // 4 for r in rest])
            cuts, costs = candidates(ids, ends, enc.closes, enc.opens, length)
            windows = plan(cuts, costs, length)
            if last:
                whole = windows[-2] if len(windows) > 1 else 0
                windows = windows[:-1]
                for size in tail_sizes(len(ids) - whole, length):
                    whole += size
                    windows.append(whole)
            else:
                while len(windows) > 1 and len(ids) - windows[-1] < 4 * length:
                    windows.pop()
            out: list[tuple] = []
            d, pos = 0, 0
            for stop in windows:
                offset = 0
                while pos < stop:
                    doc_id, raw, done = docs[d]
                    total = len(raw) // 4
                    n = min(stop - pos, total - done)
                    out.append((doc_id, done, n, crc32(raw[4 * done : 4 * (done + n)]), total, sequence, offset))
                    offset, pos, docs[d][2] = offset + n, pos + n, done + n
                    if docs[d][2] == total:
                        d += 1
                sequence += 1
            docs = docs[d:]
            waiting -= pos
            return pa.RecordBatch.from_arrays([pa.array(c, kind if i == 0 else pa.int64()) for i, c in enumerate(zip(*out, strict=True))], names=names)

        for b in batches:
            kind = b.column(0).type
            for doc_id, text in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                ids = enc.ids(text.as_py() or "") + end
                docs.append([doc_id, ids, 0])
                waiting += len(ids) // 4
                if waiting >= BLOCK:
                    yield pack(False)
        if docs:
            yield pack(True)

    return scan


def pack(docs: DataFrame, path: str | None = None, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, end_id: int = END_ID) -> DataFrame:
    """One row per piece: ``doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset``.

    Documents are dealt to ranges of identifiers (null first); within a range their tokens, each document's ended by
    ``end_id``, are one stream in order, and windows are cut where padding plus cut penalties is least. Only the last
    window of a range is not planned: it is cut into powers of two. Null and empty texts are the end token alone;
    documents of any length are cut; rows that repeat an identifier are packed each; other columns are not read; an
    empty table gives an empty result. A stream is planned BLOCK tokens at a time, in bounded memory.
    """
    slim = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    kind = slim.schema["doc_id"].dataType.simpleString()
    rows = slim.repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")
    return rows.mapInArrow(packer(path or public_tokenizers.path(VOCABULARY), length, end_id), f"doc_id {kind}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long")


def op6_window_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(spark.read.parquet(f"{sf_dir}/documents.parquet"))
