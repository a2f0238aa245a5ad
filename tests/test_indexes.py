"""Posting lists, cursors, seeded components, one-pass facets, close titles and resumed harvests against their plain forms."""

import difflib
import json
import random

import pytest
from pyspark.sql import functions as F

from folioscope.operators import authors, graph, identity, predicates, search, textindex
from folioscope.operators.works import collapse
from folioscope.sources import adapters, harvest

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def records(spark):
    return adapters.records(spark, SF)


def rows_of(df):
    return sorted((r.orcid_id, r.put_code) for r in df.select("orcid_id", "put_code").collect())


def works(spark, some):
    kind = "orcid_id string, put_code long, title string, doi string, contributors array<struct<normalized_name: string>>, work_key string, focal_work boolean, publication_year int"
    return spark.createDataFrame([(*x, f"k{i}", True, 2000) for i, x in enumerate(some)], kind)


SEARCHES = ["red", "RÉD bolt", "ab", "a", "", None, "nowhere", "10.1/o1", "Supplier 000000001", "red red ab", "supplier-000000002", "é", "___", "%", "xyz abc"]


def test_indexed_search_gives_the_rows_of_a_scan(spark, records):
    index = textindex.TextIndex.build(records)
    total = index.postings.count()
    for asked in SEARCHES:
        want = rows_of(records.where(predicates.works(query=asked)))
        assert rows_of(index.search(records, asked)) == want
    index.candidates("red bolt")
    assert 0 < index.read < total / 10  # rows of the posting lists that a query reads


def test_indexed_search_of_odd_texts(spark):
    some = works(spark, [
        ("a", 1, "Éclair über Straße", "10.1/AbC", [("jean luc picard",), (None,)]), ("a", 2, None, None, None), ("b", 1, "", "", []), ("b", 2, "ab", "x", [("ab",)]),
        ("b", 2, "ab again", "x", [("ab",)]), (None, None, "jean without a name", None, None), ("c", 9, "x" * 5000 + " end", None, [("li",), ("o",)]),
    ])
    index = textindex.TextIndex.build(some)
    for asked in ["eclair", "ÜBER", "straße", "abc", "jean-luc", "luc pic", "picard eclair", "ab", "ab again", "jean", "end", "x end", "lio", "10.1"]:
        assert sorted(map(repr, rows_of_any(index.search(some, asked)))) == sorted(map(repr, rows_of_any(some.where(predicates.works(query=asked)))))


def rows_of_any(df):
    return [tuple(r) for r in df.select("work_key").collect()]


def test_pages_by_cursor(spark, records, tmp_path):
    listing = search.Listing(spark, f"file://{tmp_path}/l", buckets=2)
    n = listing.put(records)
    rows, cursor, seen = *listing.page(limit=100), []
    turns = 0
    while True:
        seen += [r.work_key for r in rows.collect()]
        if cursor is None:
            break
        rows, cursor = listing.page(cursor, 100)
        turns += 1
    want = [r.work_key for r in search.matching_works(records).orderBy(F.desc_nulls_last("publication_year"), "work_key").collect()]
    assert seen == want and len(want) == n
    # Rows that come in before the cursor move nothing behind it; the filter reaches the scan.
    first, cursor = listing.page(limit=50)
    second = [r.work_key for r in listing.page(cursor, 50)[0].collect()]
    listing.put(records.limit(3).withColumns({"work_key": F.concat(F.lit("new"), "put_code"), "publication_year": F.lit(2999), "focal_work": F.lit(True)}))
    assert [r.work_key for r in listing.page(cursor, 50)[0].collect()] == second
    assert [r.work_key for r in listing.page(limit=1)[0].collect()][0].startswith("new")
    assert "GreaterThanOrEqual(place," in listing.after(cursor)._jdf.queryExecution().toString()


@pytest.mark.parametrize("most_steps", [24, 2])
def test_members_from_a_seed(spark, most_steps):
    r = random.Random(1)
    pairs = {(f"w{r.randrange(150)}", f"p{r.randrange(260)}") for _ in range(300)} | {(f"c{i // 2}" if i % 2 else f"c{(i + 1) // 2}", f"z{i}") for i in range(9)} | {(f"c{i // 2}", f"z{i}") for i in range(9)}
    people = spark.createDataFrame(sorted(pairs), "work_key string, orcid_id string")
    labels = {x.orcid_id: x.component for x in graph.components(people).collect()}
    for seed in ("p1", "z0", "z4", "p77"):
        got = {x.orcid_id for x in graph.members(people, seed, most_steps).collect()}
        assert got == {p for p, c in labels.items() if c == labels.get(seed)} and (seed not in labels or seed in got)
    assert graph.members(people, "nobody", most_steps).count() == 0


@pytest.mark.parametrize("filters", [None, {}, {"topics": ["SMALL", "PROMO"]}, {"types": ["2-HIGH"], "oa": True}, {"topics": ["SMALL"], "types": ["5-LOW", "2-HIGH"], "year_from": 1994, "year_to": 1996, "oa": True}, {"topics": ["nothing"]}])
def test_facets_in_one_pass(spark, records, filters):
    mine = collapse(records.where(predicates.of_author("7"))).where("work_key IS NOT NULL")
    rows = lambda df: [r.asDict() for r in df.collect()]
    got = authors.facets(mine, filters)
    assert got == {
        "total": mine.where(authors.facet(filters)).count(), "topics": rows(authors.facet_values(mine, "topics", filters)), "types": rows(authors.facet_values(mine, "type", filters)),
        "years": rows(authors.facet_years(mine, filters)), "open_access": rows(authors.facet_open_access(mine, filters))[0],
    }
    assert authors.facet_counts(mine, filters)._jdf.queryExecution().executedPlan().toString().count("FileScan") == 1


def test_close_titles_are_those_of_all_pairs(spark):
    r = random.Random(3)
    titles = set()
    for _ in range(25):
        base = [r.choice("abcdefgh 12é") for _ in range(r.randrange(4, 40))]
        titles.add("".join(base))
        for _ in range(4):
            t = list(base)
            for _ in range(r.randrange(1, 6)):
                k = r.randrange(len(t))
                t[k : k + 1] = r.choice([[], [r.choice("abz")], [t[k], "é"]])
            titles.add("".join(t) or "x")
    rows = [(f"g{i % 2}", t) for i, t in enumerate(sorted(titles))] + [("g3", "a"), ("g3", "")]
    some = spark.createDataFrame(rows, "hub string, title string")
    want = {(g, a, b) for g, a in rows for h, b in rows if g == h and a != b and difflib.SequenceMatcher(None, a, b).ratio() >= 0.8}
    assert {tuple(x) for x in identity.close_titles(some).collect()} == want and len(want) > 40
    every = sum(g == h and a != b for g, a in rows for h, b in rows)
    assert len(want) <= identity.possible_titles(some).count() < 0.2 * every  # the share that is compared in full


def test_harvest_resumes_where_it_stopped(spark, tmp_path):
    log = tmp_path / "asked"
    log.mkdir()
    down = tmp_path / "down"

    def fetch(url, start, rows):
        n = {"u1": 25, "u2": 7, "u3": 0, "u4": 12}[url]
        mark = log / f"{url}-{start}-{rows}"
        mark.write_text(str(int(mark.read_text()) + 1 if mark.exists() else 1))
        if url == "u4" and start == 5 and (down.exists() or int(mark.read_text()) < 2):
            raise OSError("down")
        return json.dumps({"num-found": n, "items": list(range(start, min(n, start + rows)))})

    searches = spark.createDataFrame([("a", "u1"), ("b", "u2"), ("c", "u3"), ("d", "u4")], "key string, url string")
    make = lambda **more: harvest.Harvest(spark, f"file://{tmp_path}/h", fetch, rows=5, round_pages=4, backoff=0.0, **more)
    assert make().run(searches, rounds=1) == {"stored": 4, "failed": 0}
    before = {p.name for p in log.iterdir() if not p.name.endswith("-0-0")}
    down.write_text("")
    assert make(retries=1).run(searches) == {"stored": 10 - 4 - 1, "failed": 1}  # the page that is down is left, the others are stored
    assert all((log / n).read_text() == "1" for n in before)  # nothing is asked again
    down.unlink()
    assert make(retries=2).run(searches) == {"stored": 1, "failed": 0} and make().run(searches) == {"stored": 0, "failed": 0}
    got = {(r.key, r.page): json.loads(r.json)["items"] for r in make().pages.read().collect()}
    assert sorted(i for (k, _), v in got.items() if k == "a" for i in v) == list(range(25)) and len(got) == 5 + 2 + 3
    assert sum(len(v) for v in got.values()) == 25 + 7 + 12


def test_index_holds_the_trigrams_of_a_text_once(spark):
    """Records with the same texts add holders, not postings; a term's trigrams count within one text only, each term in any."""
    one = [("A", 1, "red bolt", "10.1/abc", [("ana silva",)]), ("B", 1, "red bolt", "10.1/abc", [("ana silva",)]), (None, 2, "redbo olt", None, None)]
    small, large = textindex.TextIndex.build(works(spark, one)), textindex.TextIndex.build(works(spark, one + [(f"C{i}", i, *one[0][2:]) for i in range(50)]))
    assert small.postings.count() == large.postings.count()
    assert large.holders.count() == small.holders.count() + 150
    some = works(spark, one)
    for asked, want in (("bolt", ["A", "B"]), ("silva red", ["A", "B"]), ("redbo", [None]), ("red", ["A", "B", None]), ("silva redbo", [])):
        assert sorted((r.orcid_id for r in small.candidates(asked).collect()), key=str) == want, asked
        assert sorted((r.orcid_id for r in small.search(some, asked).collect()), key=str) == want, asked


def test_index_is_written_without_tables_between(spark, monkeypatch):
    """Each task writes its own rows' part of the index: neither texts of records nor trigrams are written or shuffled first."""

    def never(*_, **__):
        raise AssertionError("written")

    some = works(spark, [(f"o{i}", i, f"red bolt {i % 7}", f"10.1/{i // 4}", [("ana silva",), (f"bo li {i // 4}",)]) for i in range(200)]).repartition(3)
    with monkeypatch.context() as m:
        m.setattr(textindex, "written", never)
        index = textindex.TextIndex.build(some)
    assert index.holders.count() == 800 and index.postings.count() == index.postings.distinct().count()
    assert len(index.holders.inputFiles()) == 3
    assert rows_of(index.search(some, "bolt 10.1/7")) == rows_of(some.where(predicates.works(query="bolt 10.1/7")))
