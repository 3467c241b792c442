"""Two-pass external shuffle into shards: seeded scatter to memory-sized buckets, then Fisher-Yates within each."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from weldrow.llm.runs import column

SHARDS, SEED = 16, 20_240
#: Bytes of text in a bucket, on average; a task holds one bucket at a time.
BUCKET_BYTES = 16 << 20
#: Buckets whose counts are summed by one task.
GROUP = 4096


def _fisher_yates(seed: int):
    """Over partitions sorted by bucket: rows in a seeded random order, ``start`` now their place in the whole order.

    The first row of a bucket is its header and carries where the bucket starts.
    """

    def shuffled(parts: list[pa.RecordBatch], bucket: int) -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches(parts)
        place = table["start"][0].as_py()
        table = table.slice(1).drop_columns(["start"])
        order = np.random.Generator(np.random.PCG64([seed, bucket])).permutation(table.num_rows)
        for start in range(0, table.num_rows, 2048):
            got = table.take(pa.array(order[start : start + 2048])).combine_chunks()
            for b in got.to_batches():
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array(np.arange(place, place + b.num_rows, dtype=np.int64))], names=[*b.schema.names, "start"])
                place += b.num_rows

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        bucket = None
        for b in batches:
            if not b.num_rows:
                continue
            keys = column(b, "bucket")
            starts = [0, *(np.flatnonzero(keys[1:] != keys[:-1]) + 1).tolist(), b.num_rows]
            for s, e in zip(starts, starts[1:], strict=False):
                if bucket is not None and keys[s] != bucket:
                    yield from shuffled(held, bucket)
                    held = []
                bucket = int(keys[s])
                held.append(b.slice(s, e - s))
        if held:
            yield from shuffled(held, bucket)

    return scan


def shuffle(docs: DataFrame, shards: int = SHARDS, seed: int = SEED, bucket_bytes: int = BUCKET_BYTES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with ``shard`` and ``slot``: a uniformly random order, cut into shards whose counts differ by one at most.

    Pass one scatters rows by a seeded hash of identifier and text into as many buckets as give each ``bucket_bytes``;
    pass two permutes every bucket. A row's place in the whole order is its bucket's start, which a header row brings along, plus its place there; places
    are dealt to the shards in turn, so slots have no gaps. The same seed gives the same order whatever the
    partitioning. Null identifiers and texts are hashed like others; repeated rows each have a place (rows that repeat
    an identifier and text share a bucket, which grows by them); other columns are carried unread, whatever their names;
    columns ``shard`` and ``slot`` are replaced. An empty table gives an empty result.
    """
    size = F.coalesce(F.octet_length(text_col), F.lit(0)) + 1
    total = docs.agg(F.sum(size.cast("long"))).first()[0] or 0
    buckets = max(1, -(-total // bucket_bytes))
    hashed = F.xxhash64(F.lit(seed), F.col(id_col), F.crc32(F.coalesce(F.col(text_col), F.lit("")).cast("binary")))
    keyed = docs.select(F.pmod(hashed, F.lit(buckets)).alias("bucket"), F.struct(*docs.columns).alias("row"), F.lit(None).cast("long").alias("start"))
    headers = _starts(keyed.groupBy("bucket").agg(F.count(F.lit(1)).alias("n"))).select("bucket", F.lit(None).cast(keyed.schema["row"].dataType).alias("row"), "start")
    dealt = keyed.unionAll(headers).repartition("bucket").sortWithinPartitions("bucket", F.col("start").isNull(), F.col("row").getField(id_col), F.col("row").getField(text_col))
    placed = dealt.mapInArrow(_fisher_yates(seed), keyed.schema)
    kept = [F.col("row").getField(c).alias(c) for c in docs.columns if c.lower() not in ("shard", "slot")]
    return placed.select(*kept, (F.col("start") % shards).cast("int").alias("shard"), F.floor(F.col("start") / shards).cast("long").alias("slot"))


def _starts(counts: DataFrame) -> DataFrame:
    """``bucket, start``: rows in the buckets before. Sums run within GROUP buckets and over the groups, so no task sees all buckets."""
    rows = counts.withColumn("group", F.floor(F.col("bucket") / GROUP))
    group = rows.groupBy("group").agg(F.sum("n").alias("all"))
    before = group.select("group", (F.sum("all").over(Window.orderBy("group")) - F.col("all")).alias("before"))
    inside = F.sum("n").over(Window.partitionBy("group").orderBy("bucket")) - F.col("n")
    return rows.withColumn("inside", inside).join(before, "group").select("bucket", (F.col("before") + F.col("inside")).alias("start"))


def write_shards(docs: DataFrame, path: str, **options) -> None:
    """The shuffled rows as one Parquet folder per shard; files are ranges of slots, each in slot order."""
    out = shuffle(docs, **options)
    out.repartitionByRange("shard", "slot").sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)


def op8_two_pass_shuffle(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = shuffle(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    text = F.coalesce(F.col("text"), F.lit(""))
    return out.select("doc_id", (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"), F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
