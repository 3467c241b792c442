"""Source tables: read as text, mapped onto a profile's canonical columns."""

from __future__ import annotations

import hashlib
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from weldrow.config import EngagementConfig, SchemaMapping, SourceConfig
from weldrow.profiles import EntityProfile


def read_table(spark: SparkSession, path: str | Path, fmt: str = "csv", encoding: str = "utf-8", sep: str = ",") -> DataFrame:
    """Every column as text, so that leading zeros stay; blank cells are null, the text NA is a value, and quoted cells may hold line breaks."""
    if fmt == "parquet":
        df = spark.read.parquet(str(path))
        return df.select(*[F.nullif(F.col(c).cast("string"), F.lit("")).alias(c) for c in df.columns])
    if fmt != "csv":
        raise ValueError(f"unknown format '{fmt}'")
    return spark.read.csv(str(path), header=True, inferSchema=False, nullValue="", encoding=encoding, sep=sep, multiLine=True, quote='"', escape='"')


def unique_id(source: str, record_id: Column) -> Column:
    return F.concat(F.lit(f"{source}:"), record_id.cast("string"))


def apply_mapping(raw: DataFrame, mapping: SchemaMapping, source: str, record_id_column: str, profile: EntityProfile) -> DataFrame:
    """Canonical columns of an approved mapping, null where unmapped; record ids must be there and unique."""
    if mapping.status != "approved":
        raise ValueError(f"the mapping of '{source}' is {mapping.status}, not approved")
    canonical = profile.canonical_columns()
    if wrong := [t for t in mapping.as_dict().values() if t not in canonical]:
        raise ValueError(f"targets not in profile '{profile.name}': {', '.join(wrong)}")
    if absent := [c for c in [*mapping.as_dict(), record_id_column] if c not in raw.columns]:
        raise ValueError(f"columns missing in '{source}': {', '.join(absent)}")
    bad = raw.groupBy(record_id_column).count().where(F.col(record_id_column).isNull() | (F.col("count") > 1)).limit(3).collect()
    if bad:
        raise ValueError(f"record ids of '{source}' are null or repeat: {[r[0] for r in bad]}")
    by_target = {t: c for c, t in mapping.as_dict().items()}
    columns = [(F.col(by_target[c]) if c in by_target else F.lit(None)).cast("string").alias(c) for c in canonical]
    return raw.select(unique_id(source, F.col(record_id_column)).alias("unique_id"), F.lit(source).alias("source_dataset"), F.col(record_id_column).cast("string").alias("source_record_id"), *columns)


def load_source(spark: SparkSession, source: SourceConfig, config: EngagementConfig, profile: EntityProfile) -> DataFrame:
    if source.mapping is None:
        raise ValueError(f"source '{source.name}' has no mapping")
    mapping = SchemaMapping.load(config.resolve(source.mapping))
    raw = read_table(spark, config.resolve(source.path), source.format, source.encoding)
    return apply_mapping(raw, mapping, source.name, source.record_id_column, profile)


def table_files(path: str | Path) -> list[Path]:
    """The local file, or the part files of a folder that Spark wrote."""
    path = Path(path)
    return sorted(p for p in path.rglob("*") if p.is_file() and p.name[0] not in "._") if path.is_dir() else [path]


def file_snapshot_id(path: str | Path) -> str:
    """First 16 hexadecimal digits of the SHA-256 of a local table: one file, or the part files by name."""
    digest = hashlib.sha256()
    for part in table_files(path):
        with open(part, "rb") as f:
            while block := f.read(1 << 20):
                digest.update(block)
    return digest.hexdigest()[:16]
