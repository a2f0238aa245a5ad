"""Preparation: each step takes and returns the works (or profiles) table; a runner applies them in order."""

from __future__ import annotations

import time
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text
from ..runtime import written


def changed(old: DataFrame, new: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """Rows of ``new`` that differ from ``old`` in the given columns (nulls compare as equal)."""
    before = old.select(*keys, *(F.col(c).alias(f"__{c}") for c in columns))
    same = F.lit(True)
    for c in columns:
        same = same & F.col(c).eqNullSafe(F.col(f"__{c}"))
    return new.join(before, keys).where(~same).drop(*(f"__{c}" for c in columns))


def extract_doi(works: DataFrame) -> DataFrame:
    """DOI as stored, of the first identifier of type ``doi`` that is the work's own; none: null."""
    own = F.filter("external_ids", lambda x: (x["type"] == "doi") & (x["relationship"].isNull() | (x["relationship"] == "self")))
    return works.withColumn("doi", F.get(own, F.lit(0))["value"])


def _doi_key(column: str, exact: bool) -> Column:
    return F.col(column) if exact else F.coalesce(text.doi(F.col(column)), text.lookup_doi(F.col(column)))


def first_metadata(metadata: DataFrame, fields: list[str], exact: bool = True) -> DataFrame:
    """One metadata row a DOI: that of the smallest source name."""
    one = metadata.where("doi IS NOT NULL").groupBy(_doi_key("doi", exact).alias("__doi")).agg(F.min_by(F.struct(*fields), F.struct("source", "doi")).alias("m"))
    return one.select("__doi", *(F.col(f"m.{f}").alias(f"__{f}") for f in fields))


def merge_metadata(works: DataFrame, metadata: DataFrame, exact: bool = True) -> DataFrame:
    """Concepts, keywords and topics by DOI; empty lists overwrite nothing.  ``exact`` compares DOIs as stored."""
    fields = ["concepts", "keywords", "topics"]
    joined = works.join(first_metadata(metadata, fields, exact), _doi_key("doi", exact) == F.col("__doi"), "left")
    return joined.withColumns({f: F.coalesce(F.when(F.size(f"__{f}") > 0, F.col(f"__{f}")), F.col(f)) for f in fields}).select(works.columns)


def merge_open_access(works: DataFrame, metadata: DataFrame, exact: bool = True) -> DataFrame:
    """Open-access flag by DOI wherever the metadata has the structure, its link only where there is one."""
    joined = works.join(first_metadata(metadata, ["open_access"], exact), _doi_key("doi", exact) == F.col("__doi"), "left")
    found, link = F.col("__open_access"), F.col("__open_access.oa_url")
    return joined.withColumns({"is_oa": F.when(found.isNotNull(), F.col("__open_access.is_oa")).otherwise(F.col("is_oa")), "oa_url": F.coalesce(F.nullif(link, F.lit("")), F.col("oa_url"))}).select(works.columns)


def enrich_institutions(works: DataFrame, profiles: DataFrame) -> DataFrame:
    """The owner's institutions; without a profile an empty list."""
    known = profiles.groupBy(F.col("orcid_id").alias("__id")).agg(F.min_by("institution_names", F.to_json("institution_names")).alias("__names"))
    joined = works.join(known, F.col("orcid_id") == F.col("__id"), "left")
    names = F.transform("__names", lambda n: F.struct(n.alias("name")))
    return joined.withColumn("institutions", F.coalesce(names, F.array().cast("array<struct<name: string>>"))).select(works.columns)


def name_index(profiles: DataFrame) -> DataFrame:
    """(name, orcid_id, owners): normalised profile names with the number of researchers who have each."""
    each = profiles.select("orcid_id", text.normalized_person(F.concat_ws(" ", F.coalesce("given_names", F.lit("")), F.coalesce("family_names", F.lit("")))).alias("name")).where("name <> ''")
    return each.groupBy("name").agg(F.min("orcid_id").alias("orcid_id"), F.count_distinct("orcid_id").alias("owners"))


def contributor_links(works: DataFrame, profiles: DataFrame) -> DataFrame:
    """One row a contributor: (orcid_id, put_code, pos, c, status, linked); status: already, matched, ambiguous, unmatched."""
    index = name_index(profiles).select(F.col("name").alias("__name"), F.col("orcid_id").alias("__id"), "owners")
    each = works.select("orcid_id", "put_code", F.posexplode("contributors").alias("pos", "c"))
    met = each.join(index, F.col("c.normalized_name") == F.col("__name"), "left")
    status = (
        F.when(F.coalesce(F.col("c.orcid_id"), F.lit("")) != "", "already").when(F.col("owners") == 1, "matched").when(F.col("owners") > 1, "ambiguous").otherwise("unmatched")
    )
    return met.select("orcid_id", "put_code", "pos", "c", status.alias("status"), F.when(status == "matched", F.col("__id")).otherwise(F.col("c.orcid_id")).alias("linked"))


def link_contributors(works: DataFrame, profiles: DataFrame) -> DataFrame:
    """Identifiers for contributors whose name only one researcher has; existing links stay."""
    each = contributor_links(works, profiles)
    fields = [x.name for x in each.schema["c"].dataType.fields]
    linked = F.struct(*((F.col("linked") if f == "orcid_id" else F.col(f"c.{f}")).alias(f) for f in fields))
    lists = each.groupBy(F.col("orcid_id").alias("__o"), F.col("put_code").alias("__p")).agg(F.array_sort(F.collect_list(F.struct("pos", linked.alias("c")))).alias("__c"))
    joined = works.join(lists, F.col("orcid_id").eqNullSafe(F.col("__o")) & F.col("put_code").eqNullSafe(F.col("__p")), "left")
    return joined.withColumn("contributors", F.coalesce(F.transform("__c", lambda x: x["c"]), F.col("contributors"))).select(works.columns)


def link_statistics(works: DataFrame, profiles: DataFrame) -> DataFrame:
    each = contributor_links(works, profiles)
    return each.agg(F.count("*").alias("total"), *(F.count_if(F.col("status") == s).alias(s) for s in ("already", "matched", "ambiguous")))


def flag_authors(profiles: DataFrame, pattern: str) -> DataFrame:
    """Focal researchers: any institution whose normalised name matches the configured pattern."""
    each = profiles.select("orcid_id", F.explode("institution_names").alias("n"))
    hit = each.where(text.normalized_institution("n").rlike(pattern)).select(F.col("orcid_id").alias("__id")).distinct()
    return profiles.join(hit, F.col("orcid_id") == F.col("__id"), "left").withColumn("focal_author", F.col("__id").isNotNull()).select(profiles.columns)


def flag_works(works: DataFrame, profiles: DataFrame) -> DataFrame:
    """Focal works: a record of the work has a focal owner or contributor; keyless records are judged alone."""
    ids = profiles.where("focal_author").select("orcid_id").distinct()
    people = F.array_union(F.array("orcid_id"), F.coalesce(F.transform("contributors", lambda c: c["orcid_id"]), F.array().cast("array<string>")))
    unit = F.coalesce("work_key", F.concat_ws(":", F.lit("record"), "orcid_id", "put_code"))
    hit = works.select(unit.alias("__unit"), F.explode(people).alias("orcid_id")).join(ids, "orcid_id", "left_semi").select("__unit").distinct()
    columns = works.columns if "focal_work" in works.columns else [*works.columns, "focal_work"]
    return works.withColumn("__key", unit).join(hit, F.col("__key") == F.col("__unit"), "left").withColumn("focal_work", F.col("__unit").isNotNull()).select(columns)


def author_count(works: DataFrame) -> DataFrame:
    return works.withColumn("author_count", F.when(F.col("contributors").isNull(), 0).otherwise(F.size("contributors")))


def registry_groups(works: DataFrame, summaries: DataFrame) -> DataFrame:
    """Group identifier and identifier relationships from the registry's grouped summaries (orcid_id, put_code, orcid_group, external_ids)."""
    met = summaries.select(F.col("orcid_id").alias("__o"), F.col("put_code").alias("__p"), F.col("orcid_group").alias("__g"), F.col("external_ids").alias("__e"))
    joined = works.join(met, (F.col("orcid_id") == F.col("__o")) & (F.col("put_code") == F.col("__p")), "left")
    key = lambda x: F.concat_ws("\n", F.lower(x["type"]), F.lower(x["value"]))
    pairs = F.map_from_entries(F.array_distinct(F.transform("__e", lambda x: F.struct(key(x).alias("k"), x["relationship"].alias("v")))))
    ids = F.transform("external_ids", lambda x: x.withField("relationship", F.coalesce(F.element_at("__rel", key(x)), x["relationship"])))
    return (
        joined.withColumn("__rel", F.when(F.col("__e").isNotNull(), pairs)).withColumn("external_ids", F.when(F.col("__rel").isNotNull(), ids).otherwise(F.col("external_ids")))
        .withColumn("orcid_group", F.coalesce("__g", "orcid_group")).select(works.columns)
    )


def add_affiliations(profiles: DataFrame, found: DataFrame) -> DataFrame:
    """Profiles after a check of (orcid_id, institution) rows: new names are appended if absent, and whoever has one is focal."""
    names = found.groupBy(F.col("orcid_id").alias("__id")).agg(F.array_sort(F.collect_set("institution")).alias("__found"))
    joined = profiles.join(names, F.col("orcid_id") == F.col("__id"), "left")
    old = F.coalesce("institution_names", F.array().cast("array<string>"))
    return joined.withColumns({
        "institution_names": F.when(F.col("__found").isNull(), F.col("institution_names")).otherwise(F.concat(old, F.array_except("__found", old))),
        "focal_author": F.coalesce(F.col("focal_author"), F.lit(False)) | F.col("__found").isNotNull(),
    }).select(profiles.columns)


def unique_counts(works: DataFrame, ids: DataFrame | None = None) -> DataFrame:
    """(orcid_id, unique_works_count): keyed works that a researcher owns or is linked on."""
    people = F.array_union(F.array("orcid_id"), F.coalesce(F.transform("contributors", lambda c: c["orcid_id"]), F.array().cast("array<string>")))
    each = works.where("work_key IS NOT NULL").select("work_key", F.explode(people).alias("orcid_id")).where("orcid_id IS NOT NULL")
    if ids is not None:
        each = each.join(ids.select("orcid_id").distinct(), "orcid_id", "left_semi")
    return each.groupBy("orcid_id").agg(F.count_distinct("work_key").alias("unique_works_count"))


def set_counts(profiles: DataFrame, works: DataFrame) -> DataFrame:
    """Profiles with their unique works and raw records; none: 0."""
    unique = unique_counts(works).withColumnRenamed("orcid_id", "__u").withColumnRenamed("unique_works_count", "__n")
    raw = works.groupBy(F.col("orcid_id").alias("__r")).agg(F.count("*").alias("__m"))
    joined = profiles.join(unique, F.col("orcid_id") == F.col("__u"), "left").join(raw, F.col("orcid_id") == F.col("__r"), "left")
    return joined.withColumns({"unique_works_count": F.coalesce("__n", F.lit(0).cast("long")), "works_count": F.coalesce("__m", F.lit(0).cast("long"))}).select(profiles.columns)


def count_mismatches(profiles: DataFrame, works: DataFrame) -> DataFrame:
    """(orcid_id, stored, counted) of profiles whose stored record count is not the real one."""
    raw = works.groupBy("orcid_id").agg(F.count("*").alias("counted"))
    both = profiles.select("orcid_id", F.col("works_count").alias("stored")).join(raw, "orcid_id", "left").withColumn("counted", F.coalesce("counted", F.lit(0).cast("long")))
    return both.where(~F.col("stored").eqNullSafe(F.col("counted")))


def key_statistics(works: DataFrame) -> DataFrame:
    return works.agg(F.count("*").alias("documents"), F.count_distinct("work_key").alias("works"), (F.count("work_key") - F.count_distinct("work_key")).alias("duplicates"))


def flag_statistics(works: DataFrame, profiles: DataFrame) -> DataFrame:
    a = profiles.agg(F.count("*").alias("authors"), F.count_if("focal_author").alias("focal_authors"))
    w = works.agg(F.count("*").alias("documents"), F.count_if("focal_work").alias("focal_documents"))
    return a.crossJoin(F.broadcast(w))  # one row each


def distinct_dois(works: DataFrame) -> DataFrame:
    return works.select(F.explode("external_ids").alias("x")).where("x.type = 'doi'").select(F.col("x.value").alias("doi")).where("doi IS NOT NULL").distinct()


def run_steps(tables: dict[str, DataFrame], steps: list[tuple[str, str, Callable]]) -> tuple[dict[str, DataFrame], list[dict]]:
    """Apply (name, table, function of all tables) in order; a step that fails is recorded and leaves its table as it was.

    Each result is written to the shared folder, so what fails while it runs fails in its own step, and later steps start short.
    """
    report = []
    tables = dict(tables)
    for name, target, step in steps:
        began = time.time()
        try:
            tables[target] = written(step(tables))
            report.append({"step": name, "status": "success", "seconds": time.time() - began})
        except Exception as error:  # noqa: BLE001  the report names it, later steps go on
            report.append({"step": name, "status": "failed", "error": str(error).splitlines()[0] if str(error) else type(error).__name__, "seconds": time.time() - began})
    return tables, report


def standard_steps(pattern: str, key_step: Callable[[DataFrame], DataFrame]) -> list[tuple[str, str, Callable]]:
    """The preparation in order: DOIs, metadata, open access, institutions, links, keys, flags, counts."""
    return [
        ("extract_doi", "works", lambda t: extract_doi(t["works"])),
        ("merge_metadata", "works", lambda t: merge_metadata(t["works"], t["metadata"])),
        ("merge_open_access", "works", lambda t: merge_open_access(t["works"], t["metadata"])),
        ("enrich_institutions", "works", lambda t: enrich_institutions(t["works"], t["profiles"])),
        ("link_contributors", "works", lambda t: link_contributors(t["works"], t["profiles"])),
        ("work_keys", "works", lambda t: key_step(t["works"])),
        ("flag_authors", "profiles", lambda t: flag_authors(t["profiles"], pattern)),
        ("flag_works", "works", lambda t: flag_works(t["works"], t["profiles"])),
        ("author_count", "works", lambda t: author_count(t["works"])),
        ("set_counts", "profiles", lambda t: set_counts(t["profiles"], t["works"])),
    ]


def latest(rows: DataFrame, keys: list[str], order: str) -> DataFrame:
    """Upsert: of the rows of each key the last by ``order``."""
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc_nulls_last(order)))
    return rows.withColumn("__r", rank).where("__r = 1").drop("__r")
