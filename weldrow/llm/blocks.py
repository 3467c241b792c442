"""Comparing rows that share a key: hot keys become block pairs of bounded size."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def unused(df: DataFrame, name: str) -> str:
    """A column name that ``df`` does not have, letter case aside."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def in_blocks(rows: DataFrame, keys: list[str], row_hash: str, most: int, weight: str | None = None, heaviest: int = 1) -> DataFrame:
    """Rows of every key that at least two rows share, dealt to block pairs ``(_i, _j)`` with ``_i <= _j``.

    A key with up to ``most`` rows is one block, (0, 0). A larger one is cut into blocks by ``row_hash`` and each pair
    of blocks is a task's work of its own, so that every two rows of a key meet in exactly one block pair and none
    holds more than about twice ``most`` rows. With ``weight``, blocks hold about ``heaviest`` of that column's sum at
    most, too. ``_block`` is the row's own block. Keys must not be null.
    """
    blocks = F.ceil(F.count(F.lit(1)) / most)
    if weight:
        blocks = F.greatest(blocks, F.ceil(F.sum(weight) / heaviest))
    sizes = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"), blocks.cast("int").alias("_k")).where("_n > 1")
    rows = rows.join(sizes, keys)
    rows = rows.withColumn("_block", F.pmod(F.xxhash64(F.col(row_hash), F.lit(7)), F.col("_k")).cast("int"))
    rows = rows.withColumn("_other", F.explode(F.sequence(F.lit(0), F.col("_k") - 1)))
    return rows.withColumns({"_i": F.least("_block", "_other"), "_j": F.greatest("_block", "_other")}).drop("_n", "_k", "_other")
