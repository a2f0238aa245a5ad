"""Paged JSON over HTTP as a Spark data source: one task for each search, which reads its pages one after the other."""

from __future__ import annotations

import json
import time
from collections.abc import Iterator
from urllib.request import Request, urlopen

from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition


class Search(InputPartition):
    def __init__(self, key: str, url: str):
        super().__init__((key, url))


class JsonPages(DataSource):
    """``spark.read.format("json_pages")`` gives (key, page, json), a row for each answer.

    Options: ``searches``, a JSON object of key -> address, where {start} and {rows} stand for the window; ``rows`` of a page
    (1000); ``items``, the field whose length tells a short, last page (absent: one page only); ``pause`` between
    requests and ``timeout`` in seconds; ``headers``, a JSON object.  Addresses of files serve as fixtures.
    """

    @classmethod
    def name(cls) -> str:
        return "json_pages"

    def schema(self) -> str:
        return "key string, page int, json string"

    def reader(self, schema) -> DataSourceReader:
        return _Reader(dict(self.options))


class _Reader(DataSourceReader):
    def __init__(self, options: dict):
        self.searches = json.loads(options["searches"])
        self.rows, self.items = int(options.get("rows", 1000)), options.get("items")
        self.pause, self.timeout = float(options.get("pause", 0.1)), float(options.get("timeout", 10))
        self.headers = json.loads(options.get("headers", "{}"))

    def partitions(self) -> list[InputPartition]:
        return [Search(k, u) for k, u in sorted(self.searches.items())]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        if partition is None:
            return
        key, url = partition.value
        page = 0
        while True:
            address = url.replace("{start}", str(page * self.rows)).replace("{rows}", str(self.rows))
            with urlopen(Request(address, headers=self.headers), timeout=self.timeout) as answer:  # noqa: S310
                text = answer.read().decode()
            yield key, page, text
            if self.items is None or len(json.loads(text).get(self.items) or ()) < self.rows:
                return
            page += 1
            time.sleep(self.pause)


def pages(spark, searches: dict[str, str], **options):
    spark.dataSource.register(JsonPages)
    reader = spark.read.format("json_pages").option("searches", json.dumps(searches))
    for k, v in options.items():
        reader = reader.option(k, json.dumps(v) if isinstance(v, dict) else str(v))
    return reader.load()


def estimate(spark, url: str, field: str = "num-found") -> int:
    """The number of results that a search without rows reports."""
    return int(json.loads(pages(spark, {"count": url.replace("{rows}", "0").replace("{start}", "0")}).first()["json"])[field])
