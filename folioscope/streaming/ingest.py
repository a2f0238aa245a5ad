"""Incremental ingestion: payload files arrive as a stream, each micro-batch is parsed and inserted once.

Keys that span the collection are not computed here: identity is a batch step over all records.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..sources.catalog import Catalog
from ..sources.registry import new_tasks, parsed_works

PAYLOAD = "orcid_id string, put_code long, orcid_group string, json string"


def payload_stream(spark: SparkSession, folder: str, files_per_batch: int = 1000) -> DataFrame:
    return spark.readStream.schema(PAYLOAD).option("maxFilesPerTrigger", files_per_batch).json(folder)


def ingest(catalog: Catalog, folder: str, checkpoint: str, source: str = "enrichment"):
    """Take all payloads there are: new works, and enrichment tasks for new DOIs.  Inserting is by key, so a repeated batch adds nothing."""

    def step(batch: DataFrame, _: int) -> None:
        works = parsed_works(batch)
        old = catalog.read("works")
        full = old.limit(0).unionByName(works, allowMissingColumns=True)
        catalog.insert_new("works", full)
        catalog.insert_new("metadata_queue", new_tasks(works, catalog.read("metadata_queue"), source))

    return payload_stream(catalog.spark, folder).writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
