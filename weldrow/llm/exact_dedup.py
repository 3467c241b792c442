"""Exact deduplication: a tree of merges over sorted digest runs, in built-in functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from weldrow.llm.blocks import unused
from weldrow.session import cut

#: White space that counts as one space.
SPACE = r"[\x20\x09-\x0D]+"
#: Runs at the leaves; input partitions beyond that share a leaf. FAN_IN runs meet in every round.
LEAVES, FAN_IN = 4096, 16
#: Slices of the digest range, so that one run is many tasks' work.
SLICES = 4096


def normalized(text: Column) -> Column:
    """Null as empty; every run of ASCII white space as one space."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), SPACE, " ")


def digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, digest, n_bytes, leaf, tag) of every row, fixed by a lineage cut: tag tells repeated rows apart."""
    text = normalized(F.col(text_col))
    rows = docs.select(F.col(id_col).alias("id"), F.unhex(F.sha2(text, 256)).alias("digest"), F.octet_length(text).alias("n_bytes"))
    return cut(rows.withColumns({"leaf": F.spark_partition_id() % LEAVES, "tag": F.monotonically_increasing_id()}))


def merge_runs(rows: DataFrame, leaves: int = LEAVES, fan_in: int = FAN_IN) -> DataFrame:
    """Winners per digest: ``digest, n_bytes, least (struct no_id, id, tag), group_size``.

    A leaf run is what one input partition holds, combined before it is sent. In every round ``fan_in`` neighbouring
    runs are exchanged slice by slice of the digest range, sorted and merged; equal neighbours (the whole SHA-256 and
    the byte length are compared, not a prefix) keep their smallest identifier and add their counts. A digest reaches
    a round once per run, so a group of any size costs each task a row per run.
    """
    key = ["run", "slice", "digest", "n_bytes"]
    slices = F.conv(F.hex(F.substring("digest", 1, 4)), 16, 10).cast("long") % SLICES
    least = F.struct(F.col("id").isNull().alias("no_id"), "id", "tag")
    runs = rows.select(F.col("leaf").alias("run"), slices.alias("slice"), "digest", "n_bytes", least.alias("least"))
    runs = runs.groupBy(*key).agg(F.min("least").alias("least"), F.count(F.lit(1)).alias("group_size"))
    while leaves > 1:
        leaves = -(-leaves // fan_in)
        up = runs.withColumn("run", F.floor(F.col("run") / fan_in).cast("int"))
        runs = up.repartition("run", "slice").sortWithinPartitions(*key).groupBy(*key).agg(F.min("least").alias("least"), F.sum("group_size").alias("group_size"))
    return runs.select("digest", "n_bytes", "least", "group_size")


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: ``doc_id, keep_id, group_size, kept, text_sha256``.

    Texts are equal when identical after white space is normalised; null counts as empty. The smallest non-null
    identifier of a group stays. Rows that repeat both identifier and text count separately and only one is kept;
    a group without any identifier keeps one of its rows and has a null keep_id. Other columns of ``docs`` are not
    read, whatever their names. An empty table gives an empty result.

    The result goes down the tree again: a leaf's own (leaf, digest) rows fetch their winner and the leaf's documents
    fetch it from there, so a hot group is as many join keys as there are leaves.
    """
    rows = digests(docs, id_col, text_col)
    winners = merge_runs(rows)
    own = rows.groupBy("leaf", "digest", "n_bytes").agg(F.count(F.lit(1)).alias("_n"))
    down = own.join(winners, ["digest", "n_bytes"]).drop("_n")
    out = rows.join(down, ["leaf", "digest", "n_bytes"])
    return out.select(
        F.col("id").alias("doc_id"),
        F.col("least.id").alias("keep_id"),
        "group_size",
        (F.col("tag") == F.col("least.tag")).alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"),
    )


def keep_first(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` without the rows that :func:`exact_dedup` drops; columns stay as they are.

    Identical repeated rows are told apart by nothing, so where an identifier repeats, one row per identifier and
    text is left by a second, rarely planned step. Null texts count as empty, rows with a null identifier stay only where
    their group has no other; an empty table gives an empty result. Columns may have any names.
    """
    verdict = exact_dedup(docs, id_col, text_col)
    digest = unused(docs, "_digest")
    kept = cut(verdict.where("kept").select(F.col("doc_id").alias("_id"), F.unhex("text_sha256").alias("_kept_digest")))
    tagged = docs.withColumn(digest, F.unhex(F.sha2(normalized(F.col(text_col)), 256)))
    out = tagged.alias("d").join(kept.alias("k"), F.col(f"d.{id_col}").eqNullSafe(F.col("k._id")) & (F.col(f"d.{digest}") == F.col("k._kept_digest")), "left_semi")
    if not docs.groupBy(id_col).agg(F.count(F.lit(1)).alias("n")).where("n > 1").isEmpty():
        out = out.dropDuplicates([id_col, digest])
    return out.drop(digest)


def op2_tree_merge_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(spark.read.parquet(f"{sf_dir}/documents.parquet"))


ORACLE = r"""
WITH d AS (SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS h FROM documents),
g AS (SELECT h, min(doc_id) AS keep_id, count(*) AS group_size FROM d GROUP BY h)
SELECT d.doc_id, g.keep_id, g.group_size, d.doc_id = g.keep_id AS kept, d.h AS text_sha256 FROM d JOIN g USING (h)
"""
