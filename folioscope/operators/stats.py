"""Grouped statistics over works.  Rankings have a total order: the key breaks ties."""

from __future__ import annotations

import datetime

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .predicates import years
from .works import unique_works


def _focal(records: DataFrame, start, end) -> DataFrame:
    return records.where(F.col("focal_work") & years(start, end))


def publications_per_year(records: DataFrame, start_year: int = 1969, end_year: int | None = None) -> DataFrame:
    end_year = datetime.datetime.now(datetime.UTC).year if end_year is None else end_year
    latest = _focal(records, start_year, end_year).where("work_key IS NOT NULL").groupBy("work_key").agg(F.max("publication_year").alias("year"))
    return latest.groupBy("year").agg(F.count("*").alias("count")).orderBy("year")


def publications_per_institution_per_year(records: DataFrame, start_year=None, end_year=None) -> DataFrame:
    """A name that stands twice on the chosen record counts twice."""
    some = _focal(records, start_year, end_year).where("publication_year IS NOT NULL AND size(institutions) > 0")
    one = unique_works(some, ["publication_year", "institutions"])
    return (
        one.select(F.explode("institutions.name").alias("institution"), F.col("publication_year").alias("year"))
        .groupBy("institution", "year").agg(F.count("*").alias("count")).orderBy("year", F.desc("count"), "institution")
    )


def publications_per_type(records: DataFrame, start_year=None, end_year=None) -> DataFrame:
    one = unique_works(_focal(records, start_year, end_year).where("type IS NOT NULL"), ["type"])
    return one.groupBy("type").agg(F.count("*").alias("count")).orderBy(F.desc("count"), "type")


def top_authors(records: DataFrame, profiles: DataFrame, limit: int = 10, start_year=None, end_year=None) -> DataFrame:
    """Owners among the focal researchers by their own works; keyless records of an owner are one work."""
    focal = profiles.where("focal_author").select("orcid_id").distinct()
    some = _focal(records, start_year, end_year).join(focal, "orcid_id", "left_semi")
    one = some.select("orcid_id", "work_key").distinct()
    return one.groupBy("orcid_id").agg(F.count("*").alias("count")).orderBy(F.desc("count"), "orcid_id").limit(limit)


def top_contributors(records: DataFrame, profiles: DataFrame, limit: int = 10, start_year=None, end_year=None) -> DataFrame:
    """Linked contributors among the focal researchers; each spelling of a name is a row."""
    some = _focal(records, start_year, end_year).where("size(contributors) > 0")
    each = unique_works(some, ["contributors"]).select(F.explode("contributors").alias("c")).select("c.orcid_id", F.col("c.credit_name").alias("name"))
    each = each.join(profiles.where("focal_author").select("orcid_id").distinct(), "orcid_id", "left_semi")
    return each.groupBy("orcid_id", "name").agg(F.count("*").alias("publication_count")).orderBy(F.desc("publication_count"), "orcid_id", "name").limit(limit)


def metrics_summary(records: DataFrame, start_year=None, end_year=None) -> DataFrame:
    """One row of totals, or none without records; institutions and types are counted over records, null as one value."""
    some = _focal(records, start_year, end_year)
    main = unique_works(some, ["author_count", "publication_year"]).agg(
        F.count("*").alias("total_publications"), F.round(F.avg("author_count"), 2).alias("avg_authors_per_publication"), F.min("author_count").alias("min_authors"),
        F.max("author_count").alias("max_authors"), F.min("publication_year").alias("min_year"), F.max("publication_year").alias("max_year"),
    )
    places = some.select(F.explode("institutions.name").alias("n")).distinct().agg(F.count("*").alias("total_institutions"))
    types = some.select("type").distinct().agg(F.count("*").alias("publication_types"))
    return main.where("total_publications > 0").crossJoin(F.broadcast(places)).crossJoin(F.broadcast(types))  # one row each


def value_counts(records: DataFrame, path: str, limit: int = 100) -> DataFrame:
    """Works by value of a scalar or array path, each value of a work once; values missing inside an array leave the record out."""
    array, _, field = path.partition(".")
    some = records.where("focal_work AND work_key IS NOT NULL")
    if dict(some.dtypes)[array].startswith("array"):
        pick = (lambda x: x.getItem(field)) if "." not in field else (lambda x: x[field.split(".")[0]][field.split(".")[1]])
        values = F.transform(array, pick) if field else F.col(array)
        some = some.select("orcid_id", "put_code", "work_key", values.alias("v")).where((F.size("v") > 0) & ~F.exists("v", lambda x: x.isNull()))
    else:
        some = some.select("orcid_id", "put_code", "work_key", F.array(path).alias("v")).where(F.col(path).isNotNull())
    each = unique_works(some, ["v"]).select(F.explode(F.array_distinct("v")).alias("value"))
    top = each.groupBy("value").agg(F.count("*").alias("count")).orderBy(F.desc("count"), "value").limit(limit)
    return top.where("value <> ''")


def top_keywords(records: DataFrame, limit: int = 100) -> DataFrame:
    return value_counts(records, "keywords.display_name", limit).withColumnRenamed("value", "keyword")


def type_percentages(counts: DataFrame) -> DataFrame:
    """Share of each type in percent.  The table has a row for each type, so one window over it is small."""
    return counts.withColumn("percentage", F.col("count") * 100.0 / F.sum("count").over(Window.partitionBy()))


def yearly_trend(counts: DataFrame) -> DataFrame:
    """Change against the year before, of a yearly series."""
    before = F.lag("count").over(Window.orderBy("year"))
    return counts.select("year", "count", (F.col("count") - before).alias("change"), F.when(F.col("count") > before, "UP").when(F.col("count") < before, "DOWN").when(before.isNotNull(), "SAME").alias("trend"))


def institution_totals(counts: DataFrame, limit: int = 15) -> DataFrame:
    return counts.groupBy("institution").agg(F.sum("count").alias("total")).orderBy(F.desc("total"), "institution").limit(limit)


def zero_filled(counts: DataFrame) -> DataFrame:
    """Every year from the first to the last, with 0 where none is, and the peak (first maximum)."""
    span = counts.agg(F.min("year").alias("a"), F.max("year").alias("b"), F.max_by("year", F.struct("count", -F.col("year"))).alias("peak_year"))
    all_years = span.where("a IS NOT NULL").select(F.explode(F.sequence("a", "b")).alias("year"), "peak_year")
    return all_years.join(counts, "year", "left").select("year", F.coalesce("count", F.lit(0)).alias("count"), "peak_year").orderBy("year")


def histogram(counts: DataFrame, year_from=None, year_to=None) -> DataFrame:
    """Zero-filled years with their height against the highest, and whether they are in the chosen range."""
    top = F.max("count").over(Window.partitionBy())
    return zero_filled(counts).select("year", "count", (100.0 * F.col("count") / top).alias("height"), F.coalesce(years(year_from, year_to, "year"), F.lit(True)).alias("in_range"))


def ranked(rows: DataFrame, *order) -> DataFrame:
    """Rows of a short list with their place in it, from 1."""
    return rows.withColumn("rank", F.row_number().over(Window.orderBy(*order)))


def open_access_share(works: DataFrame) -> DataFrame:
    """One row: works, open ones and their share in whole percent (halves up); 0 without works."""
    counts = works.agg(F.count("*").alias("total"), F.count_if("is_oa").alias("open_access"))
    return counts.withColumn("percent", F.when(F.col("total") > 0, F.floor(100.0 * F.col("open_access") / F.col("total") + 0.5)).otherwise(F.lit(0)).cast("int"))


def with_computed_at(rows: DataFrame) -> DataFrame:
    """Rows with the time of the computation as ISO text in UTC."""
    return rows.withColumn("computed_at", F.date_format(F.to_utc_timestamp(F.current_timestamp(), F.current_timezone()), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'"))


def institute_options(profiles: DataFrame) -> DataFrame:
    """(value, count): the institutions that focal researchers can be filtered by."""
    each = profiles.where("focal_author").select(F.explode(F.array_distinct("institution_names")).alias("value")).where("value <> ''")
    return each.groupBy("value").agg(F.count("*").alias("count")).orderBy("value")
