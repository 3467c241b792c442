"""Byte-level BPE in Spark expressions: ranked merges folded over the byte pieces of words, decoding by concatenation."""

from __future__ import annotations

import base64
import json
import re
from collections import Counter
from collections.abc import Callable, Iterator
from pathlib import Path

import ahocorasick
import numpy as np
import public_tokenizers
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from weldrow.llm.sampling import about
from weldrow.session import written

VOCABULARY = "byte_bpe_multi_50k.tiktoken"
#: Most frequent words that are folded once for the whole corpus, at most; documents they are counted in, at most about.
FREQUENT, COUNTED_ROWS = 800_000, 20_000
#: Bytes of a word from which it is cut where no token can lie, and is not among the frequent ones.
LONG = 64
#: Units between spaces whose ids a worker remembers, at most, of at most LONG letters.
UNITS = 1 << 17
#: Bytes of a piece from which all places of the least pair are merged in one step.
SWEPT = 256
#: Starts of a row that are tried at once when a pair map is laid out.
FITTED = 4096
#: Characters of a plan's text that are kept.
PLAN_TEXT = 4096
#: Bits of a rank, and of a piece's place in a word that is not swept; the rank of no pair, beyond all others.
RANK_BITS, PLACE_BITS = 24, SWEPT.bit_length()
NONE = 1 << RANK_BITS


def read_ranks(path: str) -> dict[bytes, int]:
    """Token bytes to rank, from a file of base64 token and rank a line."""
    return {base64.b64decode(a): int(b) for a, b in map(bytes.split, Path(path).read_bytes().splitlines()) if a}


class PairMap:
    """Two whole numbers to a third as literals: the second is a place in the first one's row, and rows lie across each other.

    ``row[a] + b`` is the place of pair (a, b); ``left`` there is a, and ``made`` the value, if the pair is in the map. So a
    lookup is one probe. (Spark searches a literal map from end to end.) ``get`` takes the literal bound to a lambda
    variable, so that a plan holds it once.
    """

    def __init__(self, rows: dict[int, dict[int, int]]) -> None:
        span = 1 << max(10, (2 * sum(map(len, rows.values()))).bit_length())
        width = max((max(r) for r in rows.values()), default=0) + 1
        left, made, start = np.full(span + width, -1), np.zeros(span + width, np.int64), np.zeros(max(rows, default=0) + 1, np.int64)
        base = 0
        for a, row in sorted(rows.items(), key=lambda r: -len(r[1])):
            cols, tried = np.fromiter(row, np.int64, len(row)), 0
            while True:  # the next start from which all of the row's places are free
                fits = np.arange(base, min(base + FITTED, span))
                for c in cols.tolist():
                    fits = fits[left[fits + c] < 0]
                    if not len(fits):
                        break
                if len(fits):
                    break
                base, tried = (base + FITTED) % span, tried + FITTED
                if tried > span:
                    raise ValueError("pairs do not fit their table")
            start[a], base = fits[0], int(fits[0])
            left[start[a] + cols], made[start[a] + cols] = a, np.fromiter(row.values(), np.int64, len(row))
        held = {"row": start.tolist(), "left": left.tolist(), "made": made.tolist()}
        self.literal = F.from_json(F.lit(json.dumps(held, separators=(",", ":"))), "struct<row:array<int>,left:array<int>,made:array<int>>")

    @staticmethod
    def get(bound: Column, a: Column, b: Column) -> Column:
        """The value, or NONE."""
        return let(F.get(bound["row"], a) + b, lambda at: F.when(F.get(bound["left"], at) == a, F.get(bound["made"], at)).otherwise(NONE))


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once; lambdas share no common subexpressions.

    A fold over nothing hands the value on as it is; an item taken from a transformed array would be copied, and its
    type worked out through all of ``body``, for every value.
    """
    return F.aggregate(F.array().cast("array<int>"), value, lambda held, _: held, body)


class ByteIds:
    """The ids of every word's single bytes, for Python workers."""

    def __init__(self, ids: np.ndarray) -> None:
        self.ids = ids

    def __call__(self, words: list[bytes]) -> pa.ListArray:
        ends = np.cumsum([0, *map(len, words)], dtype=np.int32)
        return pa.ListArray.from_arrays(pa.array(ends), pa.array(self.ids[np.frombuffer(b"".join(words), np.uint8)]))


class Codec:
    """Encoding and decoding expressions for one vocabulary.

    A token's id is its rank. The literal rank map goes from two ids to the id of their joined bytes: all ways to cut a
    token into two tokens, so that a pair is found exactly when its bytes are a token.
    """

    def __init__(self, path: str, pat: str) -> None:
        self.ranks = ranks = read_ranks(path)
        if max(ranks.values()) >= NONE:
            raise ValueError(f"ranks must be below {NONE}")
        self.pat = pat
        pairs: dict[int, dict[int, int]] = {}
        for token, rank in ranks.items():
            for k in range(1, len(token)):
                a, b = ranks.get(token[:k]), ranks.get(token[k:])
                if a is not None and b is not None:
                    pairs.setdefault(a, {})[b] = rank
        self.pairs = PairMap(pairs)
        by_id = [b""] * (max(ranks.values()) + 1)
        for k, v in ranks.items():
            by_id[v] = k
        # text that holds any bytes; JSON has them in base64
        held = lambda xs: F.from_json(F.lit(json.dumps([base64.b64encode(x).decode() for x in xs], separators=(",", ":"))), "array<binary>").cast("array<string>")
        self.pieces, self.le = held(by_id), held([i.to_bytes(4, "little") for i in range(len(by_id))])
        self.bytes = np.array([ranks[bytes([i])] for i in range(256)], np.int32)

    def bound(self, body: Callable[[Callable[[Column], Column]], Column]) -> Column:
        """``body`` of an expression builder ids of single bytes -> ids, with the rank map bound once around it."""
        return let(self.pairs.literal, lambda pairs: body(lambda single: self._folded(single, pairs)))

    def _folded(self, single: Column, pairs: Column) -> Column:
        """Ids of one word from those of its bytes, with merges folded in: the least first and of equals the leftmost."""

        def made(a: Column, b: Column) -> Column:
            return self.pairs.get(pairs, a, b)

        def ranked(p: Column) -> Column:
            return F.transform(p, lambda x, i: made(x, F.get(p, i + 1)))

        # State: for each piece one number of the id that it and its successor make (NONE if none), its place and its id,
        # from the highest bits down. So the least number names the least pair, the leftmost of equals, and its place. Each
        # step merges that pair, as long as there is one; only the two pairs beside it are looked up again. (Spark throws
        # an exception to end array_position, and concat of arrays goes through lazy lists.)
        def state(rank: Column, place: Column, piece: Column) -> Column:
            return F.shiftleft(rank.cast("long"), PLACE_BITS + RANK_BITS).bitwiseOR(F.shiftleft(place.cast("long"), RANK_BITS)).bitwiseOR(piece)

        def piece(x: Column) -> Column:
            return x.bitwiseAND(F.lit(NONE - 1).cast("long"))

        def merged(q: Column, m: Column, at: Column) -> Column:
            def renewed(x: Column, i: Column) -> Column:
                before = let(piece(x), lambda a: state(made(a, m), i, a))
                return F.when(i > at, x - F.lit(NONE).cast("long")).when(i < at - 1, x).when(i == at, state(made(m, piece(F.get(q, at + 2))), at, m)).otherwise(before)

            return F.transform(F.filter(q, lambda _, i: i != at + 1), renewed)

        def step(q: Column, _: Column) -> Column:
            def once(least: Column) -> Column:
                place = F.shiftright(least, RANK_BITS).bitwiseAND(F.lit((1 << PLACE_BITS) - 1).cast("long")).cast("int")
                new = let(F.shiftright(least, PLACE_BITS + RANK_BITS), lambda m: let(place, lambda at: merged(q, m, at)))
                return F.when(least >= F.lit(NONE << (PLACE_BITS + RANK_BITS)), q).otherwise(new)

            return let(F.array_min(q), once)

        start = let(single, lambda p: F.transform(p, lambda x, i: state(made(x, F.get(p, i + 1)), i, x.cast("long"))))
        pairwise = F.transform(F.aggregate(F.slice(single, F.lit(2), F.size(single)), start, step), lambda x: piece(x).cast("int"))

        # Long pieces: the state is the ids as text, and a step replaces the least pair wherever it stands. No pair
        # that a merge makes ranks before it, as no token of a learned vocabulary comes before its parts.
        def ids_of(text: Column) -> Column:
            return F.split(F.substring(text, F.lit(2), F.length(text) - 2), r"\]\[").cast("array<int>")

        def replaced(p: Column, r: Column, m: Column, text: Column) -> Column:
            at = F.array_position(r, m).cast("int") - 1
            pair = F.concat(F.lit("["), F.get(p, at).cast("string"), F.lit("]["), F.get(p, at + 1).cast("string"), F.lit("]"))
            new = F.replace(text, pair, F.concat(F.lit("["), m.cast("string"), F.lit("]")))
            return F.struct(F.when(m == NONE, text).otherwise(new).alias("text"), (m == NONE).alias("done"))

        def sweep(s: Column, _: Column) -> Column:
            return F.when(s["done"], s).otherwise(let(ids_of(s["text"]), lambda p: let(ranked(p), lambda r: let(F.array_min(r), lambda m: replaced(p, r, m, s["text"])))))

        joined = F.struct(F.concat(F.lit("["), F.array_join(single.cast("array<string>"), "]["), F.lit("]")).alias("text"), F.lit(False).alias("done"))
        swept = ids_of(F.aggregate(single, joined, sweep)["text"])
        return F.when(F.size(single) > SWEPT, swept).otherwise(pairwise)

    def little_endian(self, ids: Column) -> Column:
        """The ids as unsigned 32-bit integers, lowest byte first."""
        return let(self.le, lambda le: F.array_join(F.transform(ids, lambda i: F.get(le, i)), "")).cast("binary")

    def decoded(self, ids: Column) -> Column:
        """The pieces' bytes in a row."""
        return let(self.pieces, lambda pieces: F.array_join(F.transform(ids, lambda i: F.get(pieces, i)), "")).cast("binary")


_SPACES = re.compile(r" (?:\s|\Z)")


class Splitter:
    """Words of a text by the pattern, and cuts of long words, in Python workers."""

    def __init__(self, pat: str, ranks: dict[bytes, int]) -> None:
        self.pat, self.ranks = pat, ranks
        self.words = regex.compile(pat).findall
        #: In this pattern a space is a word's first character or stands among white space.
        self.spaced = pat == public_tokenizers.PATTERN
        self.tokens: ahocorasick.Automaton | None = None

    def __reduce__(self):
        return Splitter, (self.pat, self.ranks)

    def units(self, text: str) -> list[str]:
        """Stretches that split into words on their own: cut before spaces, where none is followed by white space or the end."""
        if not self.spaced or "\0" in text or _SPACES.search(text):
            return [text]
        return text.replace(" ", "\0 ").split("\0")

    def pieces(self, raw: bytes) -> list[bytes]:
        """A long word, cut wherever no token of the vocabulary lies across: no merge can."""
        if self.tokens is None:
            self.tokens = ahocorasick.Automaton()
            for token in self.ranks:
                if len(token) > 1:
                    self.tokens.add_word(token.decode("latin-1"), len(token))
            self.tokens.make_automaton()
        across = np.zeros(len(raw) + 1, np.int64)
        for end, size in self.tokens.iter(raw.decode("latin-1")):
            across[end - size + 2] += 1
            across[end + 1] -= 1
        cuts = [0, *(np.flatnonzero(np.cumsum(across)[1 : len(raw)] == 0) + 1).tolist(), len(raw)]
        return [raw[a:b] for a, b in zip(cuts, cuts[1:], strict=False)]


class Folded:
    """Words whose ids are folded already, for Python workers: a dictionary of word to ids, four bytes each, made once a worker."""

    def __init__(self, table: pa.Table) -> None:
        sink = pa.BufferOutputStream()
        with pa.ipc.new_stream(sink, table.schema) as out:
            out.write_table(table)
        self.raw = sink.getvalue().to_pybytes()
        self.made: dict[str, bytes] | None = None

    def __getstate__(self):
        return {"raw": self.raw, "made": None}

    def __call__(self) -> dict[str, bytes]:
        if self.made is None:
            self.made = {}
            for b in pa.ipc.open_stream(self.raw):
                ends, ids = b.column(1).offsets.to_pylist(), np.asarray(b.column(1).values, "<i4").tobytes()
                self.made.update(zip(b.column(0).to_pylist(), (ids[4 * x : 4 * y] for x, y in zip(ends, ends[1:], strict=False)), strict=True))
        return self.made


def frequent_words(docs: DataFrame, codec: Codec, text_col: str = "text", most: int = FREQUENT) -> DataFrame:
    """``word, ids`` of the corpus' most frequent words that are no tokens: at most ``most`` of at most LONG bytes, each folded once."""
    splitter = docs.sparkSession.sparkContext.broadcast(Splitter(codec.pat, codec.ranks))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        split = splitter.value
        for b in batches:
            n = Counter(w for t in b.column(0) if t.is_valid for w in split.words(t.as_py()))
            some = [(w, k) for w, k in n.items() if len(raw := w.encode()) <= LONG and raw not in split.ranks]
            yield pa.RecordBatch.from_arrays([pa.array([w for w, _ in some], pa.string()), pa.array([k for _, k in some], pa.int64())], names=["word", "n"])

    def singles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), codec_bytes([w.encode() for w in b.column(0).to_pylist()])], names=["word", "single"])

    codec_bytes = ByteIds(codec.bytes)
    words = written(docs.select(text_col).mapInArrow(count, "word string, n long").groupBy("word").agg(F.sum("n").alias("n")))
    # no sort of all words: of how many words occur how often, the least count that leaves few enough
    left, least = most, None
    for r in words.groupBy("n").count().orderBy(F.desc("n")).toLocalIterator():
        if (left := left - r["count"]) < 0:
            break
        least = r["n"]
    return words.where(F.col("n") >= F.lit(least)).select("word").mapInArrow(singles, "word string, single array<int>").select("word", codec.bound(lambda fold: fold(F.col("single"))).alias("ids"))


def encode(docs: DataFrame, codec: Codec, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, ids`` for every row, null as empty.

    Arrow workers split a text into words and look up those that are tokens, and the frequent ones, whose ids were
    folded once for all documents and are broadcast (at most FREQUENT of at most LONG bytes, counted on a bounded part of the
    documents: what is among them changes the speed and never the ids). The others are folded where they stand, each
    distinct one once a document. A word of over LONG bytes is cut first where no token can lie across, and of what then
    still has over SWEPT bytes all places of a pair are merged in one step, so that words of a megabyte can be encoded.
    No row is shuffled. Repeated rows are encoded each; other columns are not read; an empty table gives an empty
    result. Plans hold the rank map as a literal: ``spark.sql.maxPlanStringLength`` should be small while they run.
    """
    counted = about(docs.select(id_col, text_col), F.col(id_col), COUNTED_ROWS)
    got = frequent_words(counted, codec, text_col).toArrow()
    shared = docs.sparkSession.sparkContext.broadcast((Splitter(codec.pat, codec.ranks), Folded(got)))
    slim = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    single = ByteIds(codec.bytes)

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """For each text, runs of known ids, and between them the numbers of the pieces that are to be folded there, and those pieces."""
        splitter, often = shared.value
        ranks, words = splitter.ranks, splitter.words
        known = often()  # and, as they are met, tokens
        whole_units: dict[str, bytes] = {}
        for whole in batches:
            for b in (whole.slice(i, 64) for i in range(0, whole.num_rows, 64)):
                pieces: list[bytes] = []
                # ids are kept as their four bytes each; a part is the ids up to its end or, if there is one, the piece to fold
                piece_ends, ids, run_ends, folds, part_ends = [0], bytearray(), [0], [], [0]
                for t in b.column(1):
                    mine: dict[bytes, int] = {}
                    for unit in splitter.units(t.as_py() or ""):
                        if (got := whole_units.get(unit)) is not None:
                            ids += got
                            continue
                        start, before = len(ids), len(folds)
                        for w in words(unit):
                            if (got := known.get(w)) is not None:
                                ids += got
                                continue
                            raw = w.encode()
                            for piece in splitter.pieces(raw) if len(raw) > LONG else (raw,):
                                if (rank := ranks.get(piece)) is None:
                                    at = len(ids) // 4
                                    if at > run_ends[-1]:
                                        run_ends.append(at)
                                        folds.append(-1)
                                    run_ends.append(at)
                                    folds.append(mine.setdefault(piece, len(mine)))
                                else:
                                    ids += (got := rank.to_bytes(4, "little"))
                                    if piece is raw:
                                        known[w] = got
                        if len(folds) == before and len(unit) <= LONG and len(whole_units) < UNITS:
                            whole_units[unit] = bytes(ids[start:])
                    run_ends.append(len(ids) // 4)
                    folds.append(-1)
                    part_ends.append(len(folds))
                    pieces += mine
                    piece_ends.append(len(pieces))
                flat = pa.Array.from_buffers(pa.int32(), len(ids) // 4, [None, pa.py_buffer(bytes(ids))])
                runs = pa.ListArray.from_arrays(pa.array(run_ends, pa.int32()), flat)
                parts = pa.ListArray.from_arrays(pa.array(part_ends, pa.int32()), pa.StructArray.from_arrays([runs, pa.array(folds, pa.int32())], names=["ids", "fold"]))
                yield pa.RecordBatch.from_arrays([b.column(0), pa.ListArray.from_arrays(pa.array(piece_ends, pa.int32()), single(pieces)), parts], names=["doc_id", "folds", "parts"])

    rows = slim.mapInArrow(split, f"doc_id {slim.schema['doc_id'].dataType.simpleString()}, folds array<array<int>>, parts array<struct<ids:array<int>,fold:int>>")
    joined = lambda done: F.flatten(F.transform("parts", lambda p: F.when(p["fold"] < 0, p["ids"]).otherwise(F.get(done, p["fold"]))))
    ids = codec.bound(lambda fold: let(F.transform("folds", fold), joined))
    return rows.select("doc_id", ids.alias("ids"))


def op9_folded_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The digests of every document's ids and of the bytes that they decode to."""
    codec = Codec(public_tokenizers.path(VOCABULARY), public_tokenizers.PATTERN)
    # plans are also kept as text, literals written out in every node; without this limit that text fills the driver
    before = spark.conf.get("spark.sql.maxPlanStringLength")
    spark.conf.set("spark.sql.maxPlanStringLength", PLAN_TEXT)
    out = encode(spark.read.parquet(f"{sf_dir}/documents.parquet"), codec)
    done = written(out.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(codec.little_endian(F.col("ids")), 256).alias("ids_sha256"), F.sha2(codec.decoded(F.col("ids")), 256).alias("decoded_sha256")))
    spark.conf.set("spark.sql.maxPlanStringLength", before)
    return done
