"""One researcher's views: totals, series, breakdowns, facets, works, collaborators, names."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text
from ..functions.params import page_bounds
from .predicates import facet, of_author
from .works import collapse, linked_to

TOP_BREAKDOWN, TOP_COLLABORATORS, MAX_NAMES = 8, 5, 8


def author_works(records: DataFrame, ident: str) -> DataFrame:
    return collapse(records.where(of_author(ident)), own_key=True)


def is_focal(profiles: DataFrame, ident: str) -> bool:
    return not profiles.where((F.col("orcid_id") == ident) & F.col("focal_author")).limit(1).isEmpty()


def totals(works: DataFrame) -> DataFrame:
    return works.agg(
        F.count("*").alias("works"), F.count_if("is_oa").alias("open_access"), F.count_if("oa_checked").alias("open_access_checked"),
        F.min("publication_year").alias("first_year"), F.max("publication_year").alias("last_year"),
    )


def per_year(works: DataFrame) -> DataFrame:
    return works.where("publication_year IS NOT NULL").groupBy(F.col("publication_year").alias("year")).agg(F.count("*").alias("count")).orderBy("year")


def values(works: DataFrame, field: str) -> DataFrame:
    each = works.select(F.explode(field).alias("value")) if field == "topics" else works.select(F.col(field).alias("value"))
    return each.where("value IS NOT NULL AND value <> ''").groupBy("value").agg(F.count("*").alias("count"))


def breakdown(works: DataFrame, field: str, limit: int | None = TOP_BREAKDOWN) -> DataFrame:
    ranked = values(works, field).orderBy(F.desc("count"), "value")
    return ranked if limit is None else ranked.limit(limit)


def facet_values(works: DataFrame, field: str, filters: dict | None) -> DataFrame:
    """Values of ``topics`` or ``type`` with counts under all filters but the field's own."""
    return breakdown(works.where(facet(filters, {"type": "types"}.get(field, field))), field, None)


def facet_years(works: DataFrame, filters: dict | None) -> DataFrame:
    return per_year(works.where(facet(filters, "years")))


def facet_open_access(works: DataFrame, filters: dict | None) -> DataFrame:
    return works.where(facet(filters, "oa")).agg(F.count_if("is_oa").alias("count"), F.count("*").alias("total"))


def facet_counts(works: DataFrame, filters: dict | None) -> DataFrame:
    """(facet, value, count) of all facets in one pass: ``total``, ``topics``, ``type``, ``years``, and ``oa`` with the values total and open.

    Each work says which filters it meets; it counts for a facet if it meets all but the facet's own.  One scan, one aggregate.
    """
    entry = lambda name, value: F.struct(F.lit(name).alias("facet"), value.cast("string").alias("value"))
    none = F.array().cast("array<struct<facet: string, value: string>>")
    given = lambda name, values: F.when(F.col(f"__{name}"), F.transform(values, lambda v: entry(name, v))).otherwise(none)
    own = {"total": None, "topics": "topics", "type": "types", "years": "years", "oa": "oa"}
    met = works.select("topics", F.col("type").alias("kind"), "publication_year", "is_oa", *(F.coalesce(facet(filters, exclude), F.lit(False)).alias(f"__{name}") for name, exclude in own.items()))
    filled = lambda c: F.filter(c, lambda v: v.isNotNull() & (v != ""))
    entries = F.concat(
        given("total", F.array(F.lit("total"))), given("topics", filled(F.col("topics"))), given("type", filled(F.array("kind"))),
        given("years", filled(F.array(F.col("publication_year").cast("string")))), given("oa", F.when(F.col("is_oa"), F.array(F.lit("total"), F.lit("open"))).otherwise(F.array(F.lit("total")))),
    )
    return met.select(F.explode(entries).alias("e")).groupBy("e.facet", "e.value").agg(F.count("*").alias("count"))


def facets(works: DataFrame, filters: dict | None) -> dict:
    """All facets of one researcher's works as a dictionary: the values of one small aggregate."""
    found: dict[str, dict[str, int]] = {}
    for r in facet_counts(works, filters).collect():  # a row for each value of one researcher's facets
        found.setdefault(r["facet"], {})[r["value"]] = r["count"]
    ranked = lambda name: [{"value": v, "count": n} for v, n in sorted(found.get(name, {}).items(), key=lambda x: (-x[1], x[0]))]
    oa = found.get("oa", {})
    return {
        "total": found.get("total", {}).get("total", 0), "topics": ranked("topics"), "types": ranked("type"),
        "years": [{"year": int(v), "count": n} for v, n in sorted(found.get("years", {}).items(), key=lambda x: int(x[0]))], "open_access": {"count": oa.get("open", 0), "total": oa.get("total", 0)},
    }


def facet_options(counts: DataFrame, selected: list[str], most: int) -> DataFrame:
    """Chosen values first, with 0 where absent, then the most frequent others, ``most`` rows in all."""
    spark = counts.sparkSession
    chosen = spark.createDataFrame([(v, i) for i, v in enumerate(selected)], "value string, place int")
    first = F.broadcast(chosen).join(counts, "value", "left").select("value", F.coalesce("count", F.lit(0)).alias("count"), F.lit(True).alias("selected"), "place")
    rest = counts.join(F.broadcast(chosen), "value", "left_anti").select("value", "count", F.lit(False).alias("selected"), F.lit(len(selected)).alias("place"))
    return first.unionAll(rest).orderBy("place", F.desc("count"), "value").limit(max(most, len(selected))).drop("place")


def facet_search(counts: DataFrame, part: str) -> DataFrame:
    """Values that contain the given text, whatever the case."""
    return counts.where(F.lower("value").contains(part.lower()))


def works_page(works: DataFrame, sort: str = "newest", page: int = 1, limit: int = 20, filters: dict | None = None) -> DataFrame:
    """A page of works by newest, oldest or title (others: newest); the key breaks ties."""
    order = {"oldest": [F.asc_nulls_first("publication_year")], "title": [text.title_order(F.col("title")).asc_nulls_first()]}.get(sort, [F.desc_nulls_last("publication_year")])
    skip, take = page_bounds(page, limit)
    link = F.when(F.col("is_oa"), text.safe_url(F.col("oa_url")))
    return (
        works.where(facet(filters)).orderBy(*order, "work_key").offset(skip).limit(take)
        .withColumn("oa_url", link).withColumn("oa_is_pdf", F.coalesce(text.is_pdf(F.col("oa_url")), F.lit(False)))
    )


def collaborators(records: DataFrame, ident: str) -> DataFrame:
    """Everyone on any record of the researcher's works, with the number of works shared."""
    focal = records.where("focal_work")
    keys = records.where(of_author(ident)).where("work_key IS NOT NULL AND work_key <> ''").select("work_key").distinct()
    people = F.array_union(F.array("orcid_id"), F.coalesce(F.transform("contributors", lambda c: c["orcid_id"]), F.array().cast("array<string>")))
    each = focal.join(keys, "work_key", "left_semi").select("work_key", F.explode(people).alias("orcid_id")).where(F.col("orcid_id").isNotNull() & (F.col("orcid_id") != ident)).distinct()
    return each.groupBy("orcid_id").agg(F.count("*").alias("count")).orderBy(F.desc("count"), "orcid_id")


def credited(records: DataFrame, ids: DataFrame | None = None) -> DataFrame:
    """(orcid_id, name, count) of credited names."""
    each = records.select(F.explode("contributors").alias("c")).select("c.orcid_id", F.col("c.credit_name").alias("name")).where("orcid_id IS NOT NULL AND name <> ''")
    if ids is not None:
        each = each.join(ids.select("orcid_id").distinct(), "orcid_id", "left_semi")
    return each.groupBy("orcid_id", "name").agg(F.count("*").alias("count"))


def observed_names(records: DataFrame, ident: str, limit: int = MAX_NAMES) -> DataFrame:
    each = records.where(linked_to(ident)).select(F.explode("contributors").alias("c")).where(F.col("c.orcid_id") == ident).select(F.col("c.credit_name").alias("name"))
    return each.where("name IS NOT NULL AND name <> ''").groupBy("name").agg(F.count("*").alias("count")).orderBy(F.desc("count"), "name").limit(limit)


def named(ids: DataFrame, profiles: DataFrame, records: DataFrame) -> DataFrame:
    """Identifiers with a display name: of the profile, else the most used credited one; and whether a profile exists."""
    most = Window.partitionBy("orcid_id").orderBy(F.desc("count"), "name")
    used = credited(records, ids).withColumn("r", F.row_number().over(most)).where("r = 1").select("orcid_id", F.col("name").alias("observed"))
    known = profiles.select("orcid_id", "given_names", "family_names", "credit_name", "institution_names", F.lit(True).alias("known")).dropDuplicates(["orcid_id"])
    full = ids.join(known, "orcid_id", "left").join(used, "orcid_id", "left")
    return full.select(
        *ids.columns, text.display_name(F.col("given_names"), F.col("family_names"), F.col("credit_name"), F.col("observed"), F.col("orcid_id")).alias("name"),
        F.coalesce("known", F.lit(False)).alias("in_dataset"),
        F.slice(F.array_sort(F.array_distinct(F.coalesce("institution_names", F.array().cast("array<string>"))), lambda a, b: F.when(F.lower(a) < F.lower(b), -1).when(F.lower(a) > F.lower(b), 1).otherwise(0)), 1, 3).alias("institutions"),
    )


def top_collaborators(records: DataFrame, profiles: DataFrame, ident: str, limit: int = TOP_COLLABORATORS) -> DataFrame:
    """The most frequent collaborators with names, and bar widths against the first."""
    top = collaborators(records, ident).limit(limit)
    full = named(top, profiles, records)
    width = 100.0 * F.col("count") / F.max("count").over(Window.partitionBy())
    return full.select("orcid_id", "name", F.col("count").alias("shared_works"), "in_dataset", width.alias("width")).orderBy(F.desc("shared_works"), "orcid_id")


def profile(records: DataFrame, profiles: DataFrame, ident: str) -> dict | None:
    """The page of a focal researcher as a dictionary; None for others.  All parts are small."""
    person = profiles.where((F.col("orcid_id") == ident) & F.col("focal_author")).select("given_names", "family_names", "credit_name", "other_names", "institution_names", "works_count").first()
    if person is None:
        return None
    works = author_works(records, ident)
    seen = [r["name"].strip() for r in observed_names(records, ident).collect()]
    one = lambda v: " ".join((v or "").split())
    name = one(f"{person.given_names or ''} {person.family_names or ''}") or one(person.credit_name) or (seen[0] if seen else ident)
    others = [n for n in dict.fromkeys(map(one, [person.credit_name, *(person.other_names or []), *seen])) if n and n != name]
    shared = collaborators(records, ident)
    return {
        "orcid_id": ident, "name": name, "observed_names": others, "institutions": sorted(set(person.institution_names or []), key=str.lower), "orcid_works_count": person.works_count,
        "stats": totals(works).first().asDict() | {"coauthors": shared.count()},
        "per_year": [r.asDict() for r in per_year(works).collect()],
        "topics": [r.asDict() for r in breakdown(works, "topics").collect()], "types": [r.asDict() for r in breakdown(works, "type").collect()],
        "topics_total": values(works, "topics").count(), "types_total": values(works, "type").count(),
        "top_collaborators": [r.asDict() for r in top_collaborators(records, profiles, ident).collect()],
    }
