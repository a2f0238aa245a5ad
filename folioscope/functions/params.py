"""Request parameters: pages, limits, years, search terms, repeated values."""

from __future__ import annotations

import re
import unicodedata
from urllib.parse import quote, urlencode

from pyspark.sql import Column
from pyspark.sql import functions as F

MAX_TERMS, MAX_QUERY = 10, 200
#: Fixed value: the syntax of researcher identifiers.
ID_PATTERN = r"^\d{4}-\d{4}-\d{4}-\d{3}[\dX]$"
#: Letters and their accented forms that a search treats alike.
ACCENTS = {"a": "aáàäâã", "e": "eéèëê", "i": "iíìïî", "o": "oóòöôõ", "u": "uúùüû", "n": "nñ", "c": "cç", "y": "yý"}


_FROM = "".join(ACCENTS.values())
_TO = "".join(base * len(forms) for base, forms in ACCENTS.items())


def plain(text: str) -> str:
    """A search term as it is compared: lower case, letters without marks."""
    marked = unicodedata.normalize("NFKD", text).lower()
    return "".join(filter(lambda c: not unicodedata.combining(c), marked))


def plain_column(value: Column) -> Column:
    """Text as it is compared with terms: lower case, the listed accented letters as their bases."""
    return F.translate(F.lower(value), _FROM, _TO)


def holds(value: Column, term: str) -> Column:
    """Whether the text has the term in it, case and accents aside; an absent text has none."""
    return F.coalesce(F.contains(plain_column(value), F.lit(plain(term))), F.lit(False))


def terms(query: str | None) -> list[str]:
    """At most MAX_TERMS words of the first MAX_QUERY characters."""
    return (query or "")[:MAX_QUERY].split()[:MAX_TERMS]


def page_bounds(page: int, limit: int, most: int = 100) -> tuple[int, int]:
    """(rows to skip, rows to take) of a page from 1; the limit is held between 1 and ``most``."""
    limit = min(max(limit, 1), most)
    return (max(page, 1) - 1) * limit, limit


def year_range(start, end, low: int = 1900, high: int = 2100) -> tuple[int, int]:
    """Both years as integers; ValueError outside low to high or in the wrong order."""
    start, end = int(start), int(end)
    for year in (start, end):
        if not low <= year <= high:
            raise ValueError(f"year {year} is outside {low} to {high}")
    if start > end:
        raise ValueError("the first year is after the last")
    return start, end


def cleaned(values, cut: int | None = None, most: int | None = None) -> list[str]:
    """Repeated parameter values without blanks; optionally cut to a length and a number."""
    kept = [v.strip() if cut else v for v in values or [] if v and v.strip()]
    return [v[:cut] for v in kept][:most]


def valid_id(value: str | None) -> bool:
    return bool(re.match(ID_PATTERN, value or ""))


def encoded_doi(doi: str) -> str:
    """Percent-encoded for a path; slashes stay."""
    return quote(doi)


def filter_link(path: str, topics=(), types=(), year_from=None, year_to=None) -> str:
    """A link that carries filters: a parameter for each topic and type, and the year span where one is given."""
    pairs = [("topic", t) for t in cleaned(topics)] + [("type", t) for t in cleaned(types)]
    pairs += [(name, year) for name, year in (("year_from", year_from), ("year_to", year_to)) if year is not None]
    return f"{path}?{urlencode(pairs)}" if pairs else path
