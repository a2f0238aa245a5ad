"""Table catalog: named keyed tables under one root, with explicit schemas for the engine's own."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import schemas
from .tables import KeyedTable

TABLES = {"works": schemas.WORKS, "profiles": schemas.PROFILES, "works_metadata": schemas.METADATA, "metadata_queue": schemas.QUEUE, "partitions": schemas.PARTITIONS}
KEYS = {"works": ["orcid_id", "put_code"], "profiles": ["orcid_id"], "works_metadata": ["doi", "source"], "metadata_queue": ["doi", "source"], "partitions": ["base_query", "prefix"]}
#: Of several new rows of one key the last by these columns is taken.
ORDER = {"works_metadata": ["harvested_at"], "works": ["harvested_at"]}


#: Sort order of files, so that readers skip row groups by these columns.
LAYOUT = {"works": ["publication_year", "work_key"], "profiles": ["orcid_id"], "works_metadata": ["doi"], "metadata_queue": ["status", "doi"], "partitions": ["status", "depth"]}


class Catalog:
    """The engine's tables under ``root``; see ``tables`` for versions, deltas and writers side by side."""

    def __init__(self, spark: SparkSession, root: str | None, buckets: int = 16):
        if not root:
            raise ValueError("a catalog needs a root folder")
        self.spark, self.root, self.buckets = spark, root.rstrip("/"), buckets

    def table(self, name: str) -> KeyedTable:
        return KeyedTable(self.spark, f"{self.root}/{name}", TABLES[name], KEYS[name], layout=LAYOUT.get(name), buckets=self.buckets)

    def versions(self, name: str) -> list[int]:
        return self.table(name).versions()

    def read(self, name: str) -> DataFrame:
        return self.table(name).read()

    def write(self, name: str, rows: DataFrame) -> DataFrame:
        """All rows anew."""
        self.table(name).replace(rows)
        return self.read(name)

    def compact(self, name: str) -> DataFrame:
        self.table(name).compact()
        return self.read(name)

    def insert_new(self, name: str, rows: DataFrame) -> int:
        """Append rows whose key is not there yet, once each; returns their number.  Only new rows are written."""
        return self.table(name).insert_new(rows, ORDER.get(name))

    def upsert(self, name: str, rows: DataFrame) -> DataFrame:
        """Rows replace those of the same key; of several new ones the last harvested.  Only they are written."""
        self.table(name).put(rows, ORDER.get(name))
        return self.read(name)

    def update(self, name: str, changes: DataFrame) -> int:
        """Keys and new values of some columns: rows that differ are written; returns their number."""
        return self.table(name).update(changes)

    def delete(self, name: str, keys: DataFrame) -> int:
        return self.table(name).delete(keys)

    def unharvested(self, limit: int | None = None) -> DataFrame:
        some = self.read("profiles").where("NOT harvested AND focal_author").orderBy("orcid_id")
        return some if limit is None else some.limit(limit)

    def mark_harvested(self, ids: DataFrame) -> DataFrame:
        some = ids.select("orcid_id").distinct().withColumns({"harvested": F.lit(True), "works_harvested_at": F.current_timestamp()})
        self.update("profiles", some)
        return self.read("profiles")

    def reset_harvested(self) -> DataFrame:
        done = self.read("profiles").select("orcid_id").withColumns({"harvested": F.lit(False), "works_harvested_at": F.lit(None).cast("timestamp"), "works_count": F.lit(None).cast("long")})
        self.update("profiles", done)
        return self.read("profiles")
