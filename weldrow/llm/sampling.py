"""Bounded training samples: by hash, so that they are the same in every run and on every cluster."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SPAN = 1 << 32


def about(rows: DataFrame, key: Column, most: int) -> DataFrame:
    """About ``most`` rows (all, if there are no more), chosen by a hash of ``key``; one cheap count is run."""
    n = rows.count()
    if n <= most:
        return rows
    return rows.where(F.pmod(F.xxhash64(key.cast("string"), F.lit("sample")), F.lit(SPAN)) < int(SPAN * most / n))


def remainder(key: Column, of: int) -> Column:
    """crc32 of the key as text, modulo ``of``; null keys count as the empty text."""
    return F.pmod(F.crc32(F.coalesce(key.cast("string"), F.lit("")).cast("binary")), F.lit(of))
