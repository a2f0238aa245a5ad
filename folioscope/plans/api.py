"""The HTTP query surface as plain methods: validated parameters in, JSON-ready dictionaries out.

Pages and reports are small, so they are collected; everything before that is a plan on the executors.
ValueError stands for a bad request, LookupError for something that is not there.
"""

from __future__ import annotations

from pyspark.sql import DataFrame

from ..functions import params
from ..operators import authors, graph, search, stats
from ..operators.works import authorship


def _rows(df: DataFrame) -> list[dict]:
    return [r.asDict(recursive=True) for r in df.collect()]


#: Nodes or edges of one answer at most.
MOST_ROWS = 100_000


class Api:
    def __init__(self, records: DataFrame, profiles: DataFrame):
        self.records, self.profiles = records, profiles

    def health(self) -> dict:
        return {"status": "ok"}

    def authors(self, page: int = 1, limit: int = 50, q: str | None = None, institute=()) -> dict:
        names = params.cleaned(institute)
        return search.page_dict(search.authors_page(self.profiles, page, limit, q, names), search.authors_total(self.profiles, q, names), page, limit)

    def _known(self, ident: str) -> None:
        if not params.valid_id(ident):
            raise ValueError("not an identifier")
        if not authors.is_focal(self.profiles, ident):
            raise LookupError(ident)

    @staticmethod
    def _filters(topic=(), type=(), year_from=None, year_to=None, oa=False) -> dict:
        if year_from is not None and year_to is not None:
            params.year_range(year_from, year_to, 0, 9999)
        return {"topics": params.cleaned(topic, 300, 50), "types": params.cleaned(type, 300, 50), "year_from": year_from, "year_to": year_to, "oa": bool(oa)}

    def author(self, ident: str) -> dict:
        self._known(ident)
        return authors.profile(self.records, self.profiles, ident)

    def author_works(self, ident: str, page: int = 1, limit: int = 20, sort: str = "newest", **filters) -> dict:
        self._known(ident)
        chosen, mine = self._filters(**filters), authors.author_works(self.records, ident)
        total = mine.where(authors.facet(chosen)).groupBy().count()
        return search.page_dict(authors.works_page(mine, sort, page, limit, chosen).drop("contributor_ids"), total, page, limit)

    def author_facets(self, ident: str, **filters) -> dict:
        self._known(ident)
        return authors.facets(authors.author_works(self.records, ident), self._filters(**filters))

    def publications_per_year(self, start_year: int = 1969, end_year: int | None = None) -> list[dict]:
        return _rows(stats.publications_per_year(self.records, start_year, end_year))

    def works(self, page: int = 1, limit: int = 50, q=None, start_year=None, end_year=None, keyword=(), institute=()) -> dict:
        chosen = {"query": q, "start_year": start_year, "end_year": end_year, "keywords": params.cleaned(keyword), "institutes": params.cleaned(institute)}
        return search.page_dict(search.works_page(self.records, page, limit, **chosen), search.works_total(self.records, **chosen), page, limit)

    def _options(self, path: str, limit: int) -> list[dict]:
        return _rows(stats.value_counts(self.records, path, params.page_bounds(1, limit, 500)[1]))

    def keywords(self, limit: int = 100) -> list[dict]:
        return [{"keyword": r["value"], "count": r["count"]} for r in self._options("keywords.display_name", limit)]

    def work_types(self, limit: int = 100) -> list[dict]:
        return self._options("type", limit)

    def subjects(self, limit: int = 100) -> list[dict]:
        return self._options("topics.field.display_name", limit)

    @staticmethod
    def _network(type=(), subject=(), keyword=(), institute=()) -> dict:
        return {"types": params.cleaned(type), "subjects": params.cleaned(subject), "keywords": params.cleaned(keyword), "institutes": params.cleaned(institute)}

    def _people(self, start, end, filters: dict) -> DataFrame:
        return authorship(graph.network_records(self.records, start, end, **self._network(**filters)))

    def coauthorship(self, startYear: int = 2020, endYear: int = 2026, **filters) -> dict:
        """The network itself; ValueError if it has more than MOST_ROWS nodes or edges: filters must make it smaller."""
        people = self._people(startYear, endYear, filters)
        found = {"nodes": graph.nodes(people).orderBy("orcid_id"), "edges": graph.edges(people).orderBy("source", "target")}
        got = {k: df.limit(MOST_ROWS + 1).collect() for k, df in found.items()}
        if any(len(v) > MOST_ROWS for v in got.values()):
            raise ValueError(f"the network has more than {MOST_ROWS} nodes or edges")
        return {k: [r.asDict(recursive=True) for r in v] for k, v in got.items()}

    def constellation(self, orcid: str, startYear: int = 2020, endYear: int = 2026, **filters) -> dict:
        found = graph.constellation(self.records, self.profiles, orcid, startYear, endYear, **self._network(**filters))
        if found is None:
            raise LookupError(orcid)
        return found

    def stats(self, startYear: int = 2020, endYear: int = 2026, **filters) -> dict:
        people = self._people(startYear, endYear, filters)
        return _rows(graph.network_stats(graph.nodes(people), graph.edges(people)))[0]
