"""Paged search over works and researchers."""

from __future__ import annotations

import base64
import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text
from ..functions.params import page_bounds
from ..sources.tables import KeyedTable
from . import predicates
from .works import collapse

#: Place of works without a year, behind all others.
NO_YEAR = 1 << 30

WORK_COLUMNS = ("doi", "title", "publication_year", "type", "journal_title", "contributors")


def matching_works(records: DataFrame, **filters) -> DataFrame:
    return collapse(records.where(predicates.works(**filters)), journal="first")


def works_page(records: DataFrame, page: int = 1, limit: int = 50, **filters) -> DataFrame:
    """Works by year, newest first, then key: a page, blanks instead of nulls."""
    skip, take = page_bounds(page, limit)
    rows = matching_works(records, **filters).orderBy(F.desc_nulls_last("publication_year"), "work_key").offset(skip).limit(take)
    blank = lambda c: F.coalesce(c, F.lit("")).alias(c)
    return rows.select("work_key", "doi", blank("title"), "publication_year", blank("type"), blank("journal_title"), F.filter("contributors", lambda n: n != "").alias("contributors"))


def _token(value: tuple) -> str:
    return base64.urlsafe_b64encode(json.dumps(value).encode()).decode()


class Listing:
    """Works in the order of ``works_page``, kept as a keyed table sorted by it, so that a page starts where the last one ended.

    A cursor is the place of a page's last row, (year, key).  The next page asks for places behind it: that reaches the scan as a filter on the sort
    column, so files and row groups of earlier rows are not read, and rows that come in before the cursor move nothing.
    """

    def __init__(self, spark: SparkSession, root: str, buckets: int = 8):
        schema = "work_key string, doi string, title string, publication_year int, type string, journal_title string, contributors array<string>, place int"
        self.table = KeyedTable(spark, root, schema, ["work_key"], layout=["place", "work_key"], buckets=buckets)

    def put(self, records: DataFrame, **filters) -> int:
        """Add works, or replace those of the same key; returns their number."""
        rows = matching_works(records, **filters)
        blank = lambda c: F.coalesce(c, F.lit("")).alias(c)
        place = F.coalesce(-F.col("publication_year"), F.lit(NO_YEAR)).cast("int").alias("place")
        placed = rows.select("work_key", "doi", blank("title"), F.col("publication_year").cast("int"), blank("type"), blank("journal_title"), F.filter("contributors", lambda n: n != "").alias("contributors"), place)
        return self.table.put(placed) if self.table.versions() else self.table.replace(placed)

    def after(self, cursor: str | None = None, limit: int = 50) -> DataFrame:
        """The page behind the cursor; from the first row without one."""
        rows = self.table.read()
        if cursor:
            place, key = json.loads(base64.urlsafe_b64decode(cursor.encode()))
            rows = rows.where((F.col("place") >= place) & ((F.col("place") > place) | (F.col("work_key") > key)))
        return rows.orderBy("place", "work_key").limit(page_bounds(1, limit)[1])

    def page(self, cursor: str | None = None, limit: int = 50) -> tuple[DataFrame, str | None]:
        """(rows, cursor of the next page); no cursor behind a short page."""
        rows = self.after(cursor, limit)
        ends = [(r.place, r.work_key) for r in rows.select("place", "work_key").collect()]  # a page is small
        return rows.drop("place"), _token(ends[-1]) if len(ends) == page_bounds(1, limit)[1] else None


def works_total(records: DataFrame, **filters) -> DataFrame:
    return records.where(predicates.works(**filters)).agg(F.count_distinct("work_key").alias("total"))


def authors_page(profiles: DataFrame, page: int = 1, limit: int = 50, query=None, institutes=None) -> DataFrame:
    """Focal researchers by number of works, then identifier: a page."""
    skip, take = page_bounds(page, limit)
    rows = profiles.where(predicates.researchers(query, institutes)).orderBy(F.desc_nulls_last("unique_works_count"), "orcid_id").offset(skip).limit(take)
    return rows.select("orcid_id", F.coalesce("given_names", F.lit("")).alias("given_names"), F.coalesce("family_names", F.lit("")).alias("family_names"), F.coalesce("unique_works_count", F.lit(0)).alias("count"))


def authors_total(profiles: DataFrame, query=None, institutes=None) -> DataFrame:
    return profiles.where(predicates.researchers(query, institutes)).agg(F.count("*").alias("total"))


def all_authors(profiles: DataFrame) -> DataFrame:
    """Unpaged list with a fixed institution column, kept for older clients."""
    rows = profiles.where("focal_author").select("orcid_id", "given_names", "family_names", F.coalesce("unique_works_count", F.lit(0)).alias("count"), F.lit("N/A").alias("institution"))
    return rows.orderBy(F.desc("count"), "orcid_id")


def works_by_doi(records: DataFrame) -> DataFrame:
    """Unpaged list, one record for each DOI as stored, link only where open; kept for older clients."""
    rows = records.where("focal_work AND doi IS NOT NULL").groupBy("doi").agg(
        F.min_by(F.struct("title", "publication_year", "type", "journal_title", "is_oa", "oa_url"), F.struct("orcid_id", "put_code")).alias("r")
    )
    return rows.select("doi", "r.title", "r.publication_year", "r.type", "r.journal_title", F.when(F.col("r.is_oa"), text.safe_url(F.col("r.oa_url"))).alias("oa_url"))


def page_dict(rows: DataFrame, total: DataFrame, page: int, limit: int) -> dict:
    """The page shape of the HTTP interface; a page is small."""
    skip, take = page_bounds(page, limit)
    n = total.first()[0]
    return {"data": [r.asDict(recursive=True) for r in rows.collect()], "page": max(page, 1), "has_next": skip + take < n, "total": n}
