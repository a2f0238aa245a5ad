"""Predicate builders: plain Columns that every search, ranking and network shares."""

from __future__ import annotations

from functools import reduce
from operator import and_, or_

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.params import holds, plain, terms
from ..functions.text import any_match


def _all(parts: list[Column]) -> Column:
    return reduce(and_, parts) if parts else F.lit(True)


def years(start: int | None, end: int | None, column: str = "publication_year") -> Column:
    """Inclusive range; each bound is optional; a missing year is in no bounded range."""
    parts = [F.col(column) >= start] if start is not None else []
    return _all(parts + ([F.col(column) <= end] if end is not None else []))


def text_search(query: str | None) -> Column:
    """Every term in the title (accents aside), a contributor's normalised name or the DOI."""

    def term(t: str) -> Column:
        name = " ".join(plain(t).replace("-", " ").split()) if plain(t).strip("-") else plain(t)
        in_name = any_match(F.col("contributors"), lambda c: F.contains(F.coalesce(c["normalized_name"], F.lit("")), F.lit(name)))
        return holds(F.col("title"), t) | in_name | holds(F.col("doi"), t)

    return _all([term(t) for t in terms(query)])


def any_institute(names: list[str], array: str = "institutions", field: str | None = "name") -> Column:
    def one(name: str) -> Column:
        return any_match(F.col(array), lambda x: holds(x[field] if field else x, name))

    return reduce(or_, [one(n) for n in names])


def works(query=None, start_year=None, end_year=None, types=None, subjects=None, keywords=None, institutes=None) -> Column:
    """Keyed works of the focal set that meet every given filter."""
    parts = [F.col("work_key").isNotNull(), F.col("focal_work"), years(start_year, end_year), text_search(query)]
    if types:
        parts.append(F.col("type").isin(list(types)))
    if subjects:
        parts.append(any_match(F.col("topics"), lambda t: t["field"]["display_name"].isin(list(subjects))))
    if keywords:
        parts.append(any_match(F.col("keywords"), lambda k: k["display_name"].isin(list(keywords))))
    if institutes:
        parts.append(any_institute(institutes))
    return _all(parts)


def researchers(query=None, institutes=None) -> Column:
    """Focal researchers: every term in a name or the identifier; any of the institutes."""
    parts = [F.col("focal_author")]
    for t in terms(query):
        parts.append(reduce(or_, [holds(F.col(c), t) for c in ("given_names", "family_names", "credit_name", "orcid_id")]))
    if institutes:
        parts.append(any_institute(institutes, "institution_names", None))
    return _all(parts)


def of_author(ident: str) -> Column:
    """Focal records that the researcher owns or is linked on."""
    return F.col("focal_work") & ((F.col("orcid_id") == ident) | any_match(F.col("contributors"), lambda c: c["orcid_id"] == ident))


def facet(filters: dict | None, exclude: str | None = None) -> Column:
    """Filters on collapsed works, without the facet that counts its own values."""
    filters = filters or {}
    parts = []
    if filters.get("topics") and exclude != "topics":
        parts.append(F.coalesce(F.arrays_overlap("topics", F.array(*map(F.lit, filters["topics"]))), F.lit(False)))
    if filters.get("types") and exclude != "types":
        parts.append(F.col("type").isin(list(filters["types"])))
    if filters.get("oa") and exclude != "oa":
        parts.append(F.col("is_oa"))
    if exclude != "years":
        parts.append(years(filters.get("year_from"), filters.get("year_to")))
    return _all(parts)
