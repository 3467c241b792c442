"""Reference data: the provider registry and ZIP centroids."""

from __future__ import annotations

import os
from collections.abc import Sequence
from dataclasses import asdict, dataclass
from functools import cached_property
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from weldrow.functions.text import npi_reason
from weldrow.sources.tables import file_snapshot_id, read_table, table_files

# Headers of the registry's public file and the columns they become.
REGISTRY_COLUMNS = {
    "NPI": "npi",
    "Entity Type Code": "entity_type",
    "Provider Organization Name (Legal Business Name)": "org_name",
    "Provider Last Name (Legal Name)": "last",
    "Provider First Name": "first",
    "Provider Middle Name": "middle",
    "Provider Name Suffix Text": "suffix",
    "Provider Credential Text": "credential",
    "Provider First Line Business Practice Location Address": "street",
    "Provider Business Practice Location Address City Name": "city",
    "Provider Business Practice Location Address State Name": "state",
    "Provider Business Practice Location Address Postal Code": "zip",
    "Provider Business Practice Location Address Telephone Number": "phone",
    "Healthcare Provider Taxonomy Code_1": "taxonomy",
    "NPI Deactivation Date": "deactivation_date",
}
ADDED = ("entity_type", "first", "last", "org_name", "state", "zip", "taxonomy", "deactivation_date")


@dataclass(frozen=True)
class SnapshotInfo:
    source: str
    snapshot_id: str
    path: str
    license: str
    license_url: str
    n_rows: int
    bytes: int

    def as_dict(self) -> dict:
        return asdict(self)


class ReferenceSource:
    name = ""
    license = ""
    license_url = ""

    def __init__(self, spark: SparkSession, path: str | Path) -> None:
        self.spark, self.path = spark, Path(path)

    def load(self) -> DataFrame:
        raise NotImplementedError

    @cached_property
    def frame(self) -> DataFrame:
        return self.load().persist()

    def snapshot(self) -> SnapshotInfo:
        return SnapshotInfo(self.name, file_snapshot_id(self.path), str(self.path), self.license, self.license_url, self.frame.count(), sum(os.path.getsize(p) for p in table_files(self.path)))


class Registry(ReferenceSource):
    """Provider registry: valid NPIs, the first row of each in file order."""

    name = "nppes"
    license = "Public domain (CMS NPPES Data Dissemination)"
    license_url = "https://download.cms.gov/nppes/NPI_Files.html"

    def load(self):
        raw = read_table(self.spark, self.path)
        columns = [(F.col(f"`{h}`") if h in raw.columns else F.lit(None).cast("string")).alias(c) for h, c in REGISTRY_COLUMNS.items()]
        rows = raw.select(*columns).withColumn("_row", F.monotonically_increasing_id())
        rows = rows.where(F.col("npi").isNotNull() & npi_reason(F.col("npi")).isNull())
        rows = rows.withColumns({"entity_type": F.expr("try_cast(entity_type as int)"), "zip": F.substring("zip", 1, 5)})
        first = Window.partitionBy("npi").orderBy("_row")
        return rows.withColumn("_n", F.row_number().over(first)).where("_n = 1").drop("_n", "_row")

    def enrich(self, records: DataFrame, npi_column: str = "npi_std", person: bool = True) -> DataFrame:
        return enrich(records, self.frame, npi_column, person)

    def hub_frame(self, canonical_columns: Sequence[str], entity_type: int = 1, source: str = "nppes") -> DataFrame:
        return hub_frame(self.frame, canonical_columns, entity_type, source)


def enrich(records: DataFrame, registry: DataFrame, npi_column: str = "npi_std", person: bool = True) -> DataFrame:
    """``nppes_*`` columns by NPI. For persons, the NPI of an organisation is made invalid; its digits stay to be seen."""
    ref = registry.select(F.col("npi").alias(npi_column), *[F.col(c).alias(f"nppes_{c}") for c in ADDED])
    out = records.join(ref, npi_column, "left").withColumns({"nppes_found": F.col("nppes_entity_type").isNotNull(), "nppes_deactivated": F.col("nppes_deactivation_date").isNotNull()})
    if person:
        group = F.coalesce(F.col("nppes_entity_type") == 2, F.lit(False))
        field = npi_column.removesuffix("_std")
        out = out.withColumns({
            npi_column: F.when(~group, F.col(npi_column)),
            f"{field}_valid": F.col(f"{field}_valid") & ~group,
            f"{field}_invalid_reason": F.when(group, "type2_organization_npi").otherwise(F.col(f"{field}_invalid_reason")),
        })
    return out.select(*records.columns, *[c for c in out.columns if c not in records.columns])


def hub_frame(registry: DataFrame, canonical_columns: Sequence[str], entity_type: int = 1, source: str = "nppes") -> DataFrame:
    """Registry entries of a type as a canonical source."""
    shared = {"npi": "npi", "address_street": "street", "address_city": "city", "address_state": "state", "address_zip": "zip", "phone": "phone"}
    own = {"name_first": "first", "name_middle": "middle", "name_last": "last", "name_suffix": "suffix", "org": "org_name"} if entity_type == 1 else {"name": "org_name"}
    of = shared | own
    columns = [(F.col(of[c]) if c in of else F.lit(None)).cast("string").alias(c) for c in canonical_columns]
    keys = [F.concat(F.lit(f"{source}:"), "npi").alias("unique_id"), F.lit(source).alias("source_dataset"), F.col("npi").alias("source_record_id")]
    return registry.where(F.col("entity_type") == entity_type).select(*keys, *columns)


class ZipCentroids(ReferenceSource):
    """``zip5, lat, lon`` from a gazetteer, comma- or tab-separated; the last row of a ZIP counts."""

    name = "zip_centroids"
    license = "Public domain (U.S. Census Bureau Gazetteer Files, ZCTA)"
    license_url = "https://www.census.gov/geographies/reference-files.html"

    def load(self):
        raw = read_table(self.spark, self.path, sep="\t" if self.path.suffix.lower() in (".txt", ".tsv") else ",")
        by_name = {c.strip().upper(): c for c in raw.columns}
        key = next((by_name[n] for n in ("GEOID", "ZIP", "ZCTA5", "ZIP5") if n in by_name), None)
        if key is None:
            raise ValueError(f"no ZIP column in {self.path}")
        number = lambda n: F.expr(f"try_cast(trim(`{by_name[n]}`) as double)")
        readable = lambda n: F.col(f"`{by_name[n]}`").isNull() | number(n).isNotNull()
        rows = raw.where(readable("INTPTLAT") & readable("INTPTLONG"))
        rows = rows.select(F.substring(F.lpad(F.trim(F.col(f"`{key}`")), 5, "0"), 1, 5).alias("zip5"), number("INTPTLAT").alias("lat"), number("INTPTLONG").alias("lon"), F.monotonically_increasing_id().alias("_row"))
        return rows.groupBy("zip5").agg(F.max_by(F.struct("lat", "lon"), "_row").alias("p")).select("zip5", "p.lat", "p.lon")
