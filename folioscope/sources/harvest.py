"""Paged harvests that resume: the pages that are stored say which are missing.

A search has as many pages as its first answer tells.  Each round fetches pages that the table does not hold yet, over the cluster, with
retries in the task and a rate that all tasks share, and commits them as one part.  Stopped after any round, the next run begins with the first missing
page; a page that keeps failing is left for later and the others go on.
"""

from __future__ import annotations

import json
import time
from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..runtime import written
from .tables import KeyedTable

PAGE = 1000
ROUND_PAGES, RETRIES, BACKOFF = 10_000, 3, 0.5


def tried(call: Callable[[], str], retries: int = RETRIES, backoff: float = BACKOFF) -> tuple[str | None, str | None]:
    """(answer, error) of a call that is tried again, waiting twice as long each time."""
    for turn in range(retries + 1):
        try:
            return call(), None
        except Exception as error:  # noqa: BLE001  whatever a request can fail with
            told = f"{type(error).__name__}: {error}"[:500]
            if turn < retries:
                time.sleep(backoff * 2**turn)
    return None, told


class Harvest:
    """Pages of searches in a keyed table (key, page, json) under ``root``, and the totals of searches beside it.

    ``fetch(url, start, rows)`` gives the text of a page on an executor; ``field`` of the first page (or of an answer without rows) is the number of results.
    """

    def __init__(self, spark: SparkSession, root: str, fetch: Callable[[str, int, int], str], *, field: str = "num-found", rows: int = PAGE, round_pages: int = ROUND_PAGES, retries: int = RETRIES, backoff: float = BACKOFF, rate: float | None = None):
        self.spark, self.fetch, self.field, self.rows, self.round_pages = spark, fetch, field, rows, round_pages
        self.retries, self.backoff, self.rate = retries, backoff, rate
        self.pages = KeyedTable(spark, f"{root}/pages", "key string, page int, json string", ["key", "page"], layout=["key", "page"])
        self.totals = KeyedTable(spark, f"{root}/totals", "key string, url string, total long", ["key"])

    def _answers(self, requests: DataFrame) -> DataFrame:
        """(key, page, url, json, error) of requests (key, page, url, start, size)."""
        tasks = self.spark.sparkContext.defaultParallelism
        pause = tasks / self.rate if self.rate else 0.0
        fetch, retries, backoff = self.fetch, self.retries, self.backoff

        def run(parts):
            for part in parts:
                for r in part.itertuples(index=False):
                    text, error = tried(lambda r=r: fetch(r.url, int(r.start), int(r.size)), retries, backoff)
                    time.sleep(pause)
                    yield pd.DataFrame([(r.key, r.page, r.url, text, error)], columns=["key", "page", "url", "json", "error"])

        return written(requests.repartition(tasks).mapInPandas(run, "key string, page int, url string, json string, error string"))

    def _count(self, searches: DataFrame) -> int:
        """Totals of searches that have none yet; returns how many failed."""
        new = searches.select("key", "url").join(self.totals.read().select("key"), "key", "left_anti").distinct()
        field = self.field

        def totals(parts):
            for part in parts:
                found = [json.loads(t).get(field) for t in part["json"]]
                yield part[["key", "url"]].assign(total=pd.Series([int(n or 0) for n in found], index=part.index, dtype="int64"))

        got = self._answers(new.select("key", F.lit(0).alias("page"), "url", F.lit(0).alias("start"), F.lit(0).alias("size")))
        self.totals.insert_new(got.where("json IS NOT NULL").select("key", "url", "json").mapInPandas(totals, "key string, url string, total long"))
        return got.where("json IS NULL").count()

    def missing(self) -> DataFrame:
        """(key, url, total, page) of all pages that are not stored."""
        wanted = self.totals.read().where("total > 0").select("key", "url", "total", F.explode(F.sequence(F.lit(0), F.ceil(F.col("total") / self.rows).cast("int") - 1)).alias("page"))
        return wanted.join(self.pages.read().select("key", "page"), ["key", "page"], "left_anti")

    def run(self, searches: DataFrame, rounds: int | None = None) -> dict:
        """Fetch the missing pages of the searches (key, url), in at most ``rounds`` rounds; returns pages stored and failed."""
        failed, stored, bad = self._count(searches), 0, None
        while rounds is None or rounds > 0:
            left = self.missing() if bad is None else self.missing().join(bad, ["key", "page"], "left_anti")
            some = written(left.orderBy("page", "key").limit(self.round_pages))
            if some.isEmpty():
                break
            start = F.col("page") * self.rows
            got = self._answers(some.select("key", "page", "url", start.alias("start"), F.least(F.lit(self.rows), F.col("total") - start).alias("size")))
            stored += self.pages.insert_new(got.where("json IS NOT NULL").select("key", "page", "json"))
            lost = written(got.where("json IS NULL").select("key", "page"))
            bad = lost if bad is None else written(bad.unionAll(lost))
            rounds = None if rounds is None else rounds - 1
        return {"stored": stored, "failed": failed + (bad.count() if bad is not None else 0)}
