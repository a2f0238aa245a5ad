"""From records to works: one row for each key.

Where the choice of a record is free, the record with the smallest (orcid_id, put_code) stands for its
work, so results repeat.  Null keys are one group in report queries.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import any_match


def _first(column: Column | str) -> Column:
    return F.min_by(column, F.struct("orcid_id", "put_code"))


def unique_works(records: DataFrame, fields: list[str], per_author: bool = False) -> DataFrame:
    """One record a work (and an owner): its key and ``fields``, all of the same record."""
    keys = ["orcid_id", "work_key"] if per_author else ["work_key"]
    one = records.groupBy(*keys).agg(_first(F.struct(*fields)).alias("r")) if fields else records.groupBy(*keys).agg(F.count("*").alias("records"))
    return one.select(*keys, *(F.col(f"r.{f}").alias(f) for f in fields if f not in keys)) if fields else one.select(*keys)


def credit_names() -> Column:
    return F.filter(F.transform("contributors", lambda c: c["credit_name"]), lambda n: n.isNotNull())


def collapse(records: DataFrame, *, own_key: bool = False, journal: str = "max", credits: bool = False) -> DataFrame:
    """Merge the records of each work.

    DOI, year and link are the largest (a value wins over none), title, type, topics and contributors those of the first
    record, open access is any.  ``own_key`` gives keyless records a work of their own; ``journal`` is max or
    first; ``credits`` keeps every record's contributors.
    """
    key = F.coalesce("work_key", F.concat_ws(":", F.lit("record"), "orcid_id", "put_code")) if own_key else F.col("work_key")
    picked = F.struct("title", "type", F.transform("topics", lambda t: t["display_name"]).alias("topics"), credit_names().alias("contributors"), F.col("journal_title").alias("journal"))
    out = records.groupBy(key.alias("work_key")).agg(
        F.max("doi").alias("doi"),
        F.max("publication_year").alias("publication_year"),
        F.max("journal_title").alias("top_journal"),
        F.max("oa_url").alias("oa_url"),
        F.bool_or(F.coalesce(F.col("is_oa"), F.lit(False))).alias("is_oa"),
        F.bool_or(F.col("is_oa").isNotNull()).alias("oa_checked"),
        F.collect_list(F.transform("contributors", lambda c: c["orcid_id"])).alias("contributor_ids"),
        _first(picked).alias("r"),
        *([F.collect_list("contributors").alias("credits")] if credits else []),
    )
    return out.select(
        "work_key", "doi", "r.title", "publication_year", "r.type",
        (F.col("top_journal") if journal == "max" else F.col("r.journal")).alias("journal_title"),
        F.col("r.contributors").alias("contributors"), "contributor_ids", F.array_distinct(F.coalesce("r.topics", F.array().cast("array<string>"))).alias("topics"),
        "is_oa", "oa_checked", "oa_url", *(["credits"] if credits else []),
    )


def work_topics(records: DataFrame) -> DataFrame:
    """(work_key, topics) as ``collapse`` has them; the other columns are neither computed nor shuffled."""
    names = F.transform("topics", lambda t: t["display_name"])
    return unique_works(records, ["topics"]).select("work_key", F.array_distinct(F.coalesce(names, F.array().cast("array<string>"))).alias("topics"))


def authorship(records: DataFrame, tasks: int | None = None) -> DataFrame:
    """Distinct (work_key, orcid_id): owners and linked contributors of keyed works.

    With ``tasks`` the records are dealt by work over so many tasks; what is then done by work needs no other deal.
    """
    people = F.array_union(F.array("orcid_id"), F.coalesce(F.transform("contributors", lambda c: c["orcid_id"]), F.array().cast("array<string>")))
    each = records.where("work_key IS NOT NULL").select("work_key", people.alias("people"))
    each = each.repartition(tasks, "work_key") if tasks else each
    return each.select("work_key", F.explode("people").alias("orcid_id")).where("orcid_id IS NOT NULL AND orcid_id <> ''").distinct()


def linked_to(ident: str) -> Column:
    return any_match(F.col("contributors"), lambda c: c["orcid_id"] == ident)


def semi(records: DataFrame, ids: DataFrame, column: str = "orcid_id") -> DataFrame:
    return records.join(ids.select(F.col("orcid_id").alias(column)).distinct(), column, "left_semi")
