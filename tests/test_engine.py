"""Null semantics, preparation, registry parsing, author and network views, sinks, streaming."""

import json

import pytest
from pyspark.sql import functions as F

from folioscope import schemas
from folioscope.functions import params, text
from folioscope.operators import authors, graph, predicates, prepare, search, stats, works
from folioscope.plans.api import Api
from folioscope.sources import catalog, registry, sinks
from folioscope.streaming import ingest

RECORD = (
    "orcid_id string, put_code long, work_key string, title string, journal_title string, publication_year int, type string, doi string, is_oa boolean, oa_url string, author_count int, focal_work boolean, "
    "contributors array<struct<credit_name: string, normalized_name: string, orcid_id: string>>, topics array<struct<display_name: string, field: struct<display_name: string>>>, "
    "keywords array<struct<display_name: string>>, institutions array<struct<name: string>>, external_ids array<struct<type: string, value: string, relationship: string>>"
)


def rec(owner, code, key, year=2021, title="T", people=(), focal=True, **kw):
    topics = [(t, (t,)) for t in kw.get("topics", [])] if kw.get("topics") is not None else None
    return (
        owner, code, key, title, kw.get("journal"), year, kw.get("type", "article"), kw.get("doi"), kw.get("oa"), kw.get("url"), kw.get("n", len(people)), focal,
        [(n, n and n.lower(), i) for n, i in people], topics, [(k,) for k in kw.get("keywords", [])], [(i,) for i in kw["institutions"]] if kw.get("institutions") is not None else None, kw.get("ids"),
    )


@pytest.fixture(scope="module")
def data(spark):
    a, b, c, d, e = (("Ana", "A"), ("Beto", "B"), ("Ci", "C"), ("Da", "D"), ("Ed", "E"))
    rows = [
        rec("A", 1, "w1", 2021, "Ágil thing", [a, b], topics=["x", "x", "y"], doi="10.1/A", oa=True, url="http://h/f.pdf", institutions=["U", "U"]),
        rec("B", 1, "w1", 2022, "Agil thing", [b], topics=["x"], oa=None, journal="J"),
        rec("A", 2, "w2", 2021, "Second", [a, b], topics=["y"], oa=False, url="ftp://h/x"),
        rec("C", 1, "w3", 2023, "third", [c, b], topics=[]),
        rec("D", 1, "w4", 2021, "Pair", [d, e], topics=None),
        rec("A", 3, "w5", 2021, '"solo"', [a]),
        rec("A", 4, None, None, "Keyless", [("Ana", "A"), (None, None)], type=None),
        rec("E", 2, "w6", 0, "Zero", [e], focal=False),
    ]
    return spark.createDataFrame(rows, RECORD)


@pytest.fixture(scope="module")
def people(spark):
    return spark.createDataFrame(
        [("A", "Ana", "Uno", None, ["n2"], ["b", "A", "b"], True, 3, 4), ("B", None, "", " B  cred ", None, None, True, None, None), ("C", "Ci", "Tres", None, None, [], False, None, None)],
        "orcid_id string, given_names string, family_names string, credit_name string, other_names array<string>, institution_names array<string>, focal_author boolean, works_count long, unique_works_count long",
    )


def test_statistics_on_nulls(data, people):
    assert [tuple(r) for r in stats.publications_per_year(data, 2000, 2030).collect()] == [(2021, 3), (2022, 1), (2023, 1)]
    assert stats.publications_per_institution_per_year(data).first()["count"] == 2  # a name twice on the record
    assert {tuple(r) for r in stats.top_authors(data, people).collect()} == {("A", 4), ("B", 1)}  # the keyless record is one work
    assert {(r.orcid_id, r.publication_count) for r in stats.top_contributors(data, people).collect()} == {("A", 4), ("B", 3)}
    m = stats.metrics_summary(data).first()
    assert (m.total_publications, m.total_institutions, m.publication_types) == (6, 1, 2)
    assert stats.metrics_summary(data.limit(0)).count() == 0
    assert {tuple(r) for r in stats.value_counts(data, "topics.display_name").collect()} == {("x", 1), ("y", 2)}
    trend = stats.yearly_trend(stats.publications_per_year(data, 2000, 2030)).collect()
    assert [r.trend for r in trend] == [None, "DOWN", "SAME"]
    filled = stats.zero_filled(stats.publications_per_year(data.where("publication_year <> 2022"), 2000, 2030)).collect()
    assert [(r.year, r["count"], r.peak_year) for r in filled] == [(2021, 4, 2021), (2022, 0, 2021), (2023, 1, 2021)]


def test_predicates(data):
    ids = lambda **kw: {r.work_key for r in data.where(predicates.works(**kw)).collect()}
    assert ids() == {"w1", "w2", "w3", "w4", "w5"}
    assert ids(query="agil THING") == {"w1"} and ids(query="beto 10.1") == {"w1"} and ids(query="(") == set()
    assert ids(start_year=2022) == {"w1", "w3"} and ids(subjects=["y"]) == {"w1", "w2"} and ids(institutes=["ú"]) == {"w1"}
    assert ids(types=["none"]) == set() and ids(keywords=["k"]) == set()


def test_search_pages(data, people):
    page = search.works_page(data, page=1, limit=2).collect()
    assert [r.work_key for r in page] == ["w3", "w1"] and page[1].title == "Ágil thing"
    full = search.page_dict(search.works_page(data, 2, 2), search.works_total(data), 2, 2)
    assert full["total"] == 5 and full["has_next"] and [r["work_key"] for r in full["data"]] == ["w2", "w4"]
    assert [r.orcid_id for r in search.authors_page(people).collect()] == ["A", "B"] and search.authors_total(people, query="uno").first().total == 1
    assert search.works_by_doi(data).count() == 1 and search.all_authors(people).count() == 2
    with pytest.raises(ValueError):
        params.year_range(2022, 2020)
    with pytest.raises(ValueError):
        params.year_range(1800, 2020)
    assert params.page_bounds(0, 1000) == (0, 100) and params.cleaned([" a ", "", "b" * 400], 300, 50) == ["a", "b" * 300]
    assert params.valid_id("0000-0000-0000-000X") and not params.valid_id("x") and params.encoded_doi("10.1/a b") == "10.1/a%20b"


def test_author_view(data, people):
    mine = authors.author_works(data, "A")
    t = authors.totals(mine).first()
    assert (t.works, t.open_access, t.open_access_checked, t.first_year, t.last_year) == (4, 1, 2, 2021, 2021)  # w1's second record does not list A
    assert {tuple(r) for r in authors.breakdown(mine, "topics").collect()} == {("x", 1), ("y", 2)}
    assert [tuple(r) for r in authors.collaborators(data, "A").collect()] == [("B", 2)]
    assert {tuple(r) for r in authors.facet_values(mine, "topics", {"topics": ["x"]}).collect()} == {("x", 1), ("y", 2)}
    assert authors.facet_open_access(mine, {"oa": True}).first().asDict() == {"count": 1, "total": 4}
    page = authors.works_page(mine, "title").collect()
    assert [r.title for r in page] == ["Keyless", "Second", '"solo"', "Ágil thing"]
    links = {r.work_key: (r.oa_url, r.oa_is_pdf) for r in page}
    assert links["w1"] == ("http://h/f.pdf", True) and links["w2"] == (None, False)
    p = authors.profile(data, people, "A")
    assert p["name"] == "Ana Uno" and p["institutions"] == ["A", "b"] and p["stats"]["coauthors"] == 1 and p["observed_names"] == ["n2", "Ana"]
    assert p["top_collaborators"][0]["name"] == "B cred" and authors.profile(data, people, "C") is None
    assert authors.is_focal(people, "A") and not authors.is_focal(people, "C")
    options = authors.facet_options(authors.breakdown(mine, "topics", None), ["z"], 2).collect()
    assert [(r.value, r["count"]) for r in options] == [("z", 0), ("y", 2)]


def test_network(data, people):
    rel = works.authorship(graph.network_records(data))
    assert {tuple(r) for r in graph.edges(rel).collect()} == {("A", "B", 2), ("B", "C", 1), ("D", "E", 1)}
    s = graph.network_stats(graph.nodes(rel), graph.edges(rel)).first()
    assert (s.total_authors, s.total_edges, s.total_collaborations, s.solo_authors) == (5, 3, 4, 0)
    assert {r.orcid_id for r in graph.members(rel, "C").collect()} == {"A", "B", "C"}
    c = graph.constellation(data, people, "A")
    assert c["stats"] == {"members": 3, "shared_works": 3, "links": 2, "collaborations": 3, "first_year": 2021, "last_year": 2023}
    assert [(p["source"], p["target"], p["weight"]) for p in c["pairs"]] == [("A", "B", 2), ("B", "C", 1)]
    assert c["pairs"][0]["topics"][0] == "y" and c["members"][0]["orcid_id"] == "A" and c["members"][0]["works"] == 3
    assert graph.constellation(data, people, "nobody") is None
    alone = graph.constellation(data.where("orcid_id = 'A' AND put_code = 3"), people, "A")
    assert alone["stats"]["members"] == 1 and [w["work_key"] for w in alone["works"]] == ["w5"]


def test_api(spark, data, people):
    ident = lambda c: F.when(c == "A", F.lit("0000-0000-0000-000X")).otherwise(c)
    moved = data.withColumn("orcid_id", ident(F.col("orcid_id"))).withColumn("contributors", F.transform("contributors", lambda c: c.withField("orcid_id", ident(c["orcid_id"]))))
    api, a = Api(moved, people.withColumn("orcid_id", ident(F.col("orcid_id")))), "0000-0000-0000-000X"
    assert api.health() == {"status": "ok"} and api.authors(q="ana")["total"] == 1 and api.author(a)["stats"]["works"] == 4
    page = api.author_works(a, limit=2, topic=["y", " "])
    assert page["total"] == 2 and not page["has_next"] and {w["work_key"] for w in page["data"]} == {"w1", "w2"}
    assert api.author_facets(a, oa=True)["open_access"] == {"count": 1, "total": 4}
    assert api.works(limit=1, q="pair")["data"][0]["title"] == "Pair" and api.work_types()[0] == {"value": "article", "count": 5} and api.keywords() == []
    assert {r["value"]: r["count"] for r in api.subjects()} == {"x": 1, "y": 2} and len(api.publications_per_year(2000, 2030)) == 3
    assert len(api.coauthorship()["edges"]) == 3 and api.stats()["total_edges"] == 3 and api.constellation("D")["stats"]["members"] == 2
    for call, error in ((lambda: api.author("x"), ValueError), (lambda: api.author("0000-0000-0000-0001"), LookupError), (lambda: api.stats(2026, 2020), ValueError), (lambda: api.constellation("nobody"), LookupError)):
        with pytest.raises(error):
            call()
    counts = authors.breakdown(authors.author_works(moved, a), "topics", None)
    assert authors.facet_search(counts, "X").count() == 1


def test_components_of_a_long_path(spark):
    rel = spark.createDataFrame([(str(i), f"n{j:03d}") for i in range(120) for j in (i, i + 1)] + [("z", "zz")], "work_key string, orcid_id string")
    got = {r.orcid_id: r.component for r in graph.components(rel).collect()}
    assert set(got.values()) == {"n000", "zz"} and len(got) == 122


def test_preparation(spark, data, people):
    ids = [("doi", "10.5/Part", "part-of"), ("doi", "10.5/Own", None)]
    base = spark.createDataFrame([rec("A", 1, None, ids=ids), rec("B", 1, None, ids=[("issn", "1", None)], doi="old")], RECORD)
    assert {r.doi for r in prepare.extract_doi(base).collect()} == {"10.5/Own", None}
    meta = spark.createDataFrame([("s", "10.5/own", None, None, (None, None), [("n", ("n",))], [], [], None, None), ("r", "10.5/Own", None, None, (True, ""), [], [("k",)], [("c", 1.0)], None, None)], schemas.METADATA)
    keyed = prepare.extract_doi(base).withColumn("concepts", F.array().cast("array<struct<display_name: string, score: double>>"))
    exact = {r.orcid_id: r for r in prepare.merge_metadata(keyed, meta).collect()}
    assert [k.display_name for k in exact["A"].keywords] == ["k"] and exact["A"].topics is None
    loose = {r.orcid_id: r for r in prepare.merge_metadata(keyed, meta, exact=False).collect()}
    assert [k.display_name for k in loose["A"].keywords] == ["k"]  # the smaller source stands for the DOI
    assert {r.orcid_id: r.is_oa for r in prepare.merge_open_access(keyed, meta).collect()} == {"A": True, "B": None}
    assert {r.orcid_id: [i.name for i in r.institutions] for r in prepare.enrich_institutions(base, people).collect()} == {"A": ["b", "A", "b"], "B": []}
    named = spark.createDataFrame([("1", "María José", "García-López"), ("2", "Li", "Wu"), ("3", "LI", "wu"), ("4", None, None)], "orcid_id string, given_names string, family_names string")
    w = spark.createDataFrame([("A", 1, [("x", "maria jose garcia lopez", None), ("y", "li wu", None), ("z", "li wu", "kept"), ("q", None, None)]), ("B", 1, None)], "orcid_id string, put_code long, contributors array<struct<credit_name: string, normalized_name: string, orcid_id: string>>")
    linked = {r.orcid_id: r.contributors for r in prepare.link_contributors(w, named).collect()}
    assert [c.orcid_id for c in linked["A"]] == ["1", None, "kept", None] and linked["B"] is None
    assert prepare.link_statistics(w, named).first().asDict() == {"total": 4, "already": 1, "matched": 1, "ambiguous": 1}
    flagged = {(r.orcid_id, r.put_code): r.focal_work for r in prepare.flag_works(data.drop("focal_work"), people).collect()}
    assert flagged[("A", 4)] and not flagged[("D", 1)] and flagged[("C", 1)]
    assert {r.orcid_id: r.unique_works_count for r in prepare.unique_counts(data).collect()} == {"A": 3, "B": 3, "C": 1, "D": 1, "E": 2}
    assert {r.orcid_id: (r.unique_works_count, r.works_count) for r in prepare.set_counts(people, data).collect()} == {"A": (3, 4), "B": (3, 1), "C": (1, 1)}
    old = data.select("orcid_id", "put_code", F.lit(1).alias("v"))
    assert prepare.changed(old, old.withColumn("v", F.when(F.col("put_code") == 1, F.col("v"))), ["orcid_id", "put_code"], ["v"]).count() == 4
    steps = [("bad", "works", lambda t: t["works"].select("nothing")), ("count", "works", lambda t: prepare.author_count(t["works"]))]
    tables, report = prepare.run_steps({"works": data}, steps)
    assert [r["status"] for r in report] == ["failed", "success"] and tables["works"].where("author_count = 2").count() == 5


def test_text(spark):
    rows = [("HTTPS://dx.doi.org/10.1/A ", "<b>H</b>&amp; Ñandú—ﬁn ß", "O’Neil-Ångström, 3rd"), ("doi: 10.2/b", None, None), ("ftp://x", "", "")]
    out = spark.createDataFrame(rows, "d string, t string, n string").select(text.doi(F.col("d")).alias("d"), text.normalized_title("t").alias("t"), text.normalized_person("n").alias("n")).collect()
    assert [r.d for r in out] == ["10.1/a", "10.2/b", None] and out[0].t == "h nandu fin ss" and out[0].n == "oneil angstrom rd" and out[2].n == ""
    one = spark.range(1).select(
        text.type_label(F.lit("journal-article_x")).alias("label"), text.author_line(F.array(*(F.lit(c) for c in "abcdefgh"))).alias("line"), text.group_id(F.lit("A"), F.array(F.lit(5), F.lit(3))).alias("g"),
        text.abstract(F.create_map(F.lit("b"), F.array(F.lit(1)), F.lit("a"), F.array(F.lit(0), F.lit(2)), F.lit("c"), F.array(F.lit(2)))).alias("a"), text.abstract(F.lit(None).cast("map<string, array<int>>")).alias("none"),
        text.similarity(F.lit("abcd"), F.lit("abce")).alias("r"), text.is_pdf(F.lit("http://h/a/PDF/x?y")).alias("p"), text.is_pdf(F.lit("http://h/x?q=.pdf")).alias("q"),
    ).first()
    assert (one.label, one.line, one.g, one.a, one.none, one.r, one.p, one.q) == ("Journal article x", "a, b, c, d, e, f +2 more", "A:3", "a b c", None, 0.75, True, False)


WORK = {
    "title": {"title": {"value": "On Things"}}, "journal-title": None, "publication-date": {"year": {"value": "2019"}}, "type": "book", "visibility": "public",
    "external-ids": {"external-id": [{"external-id-type": "doi", "external-id-value": "10.9/Z", "external-id-relationship": "self"}]},
    "contributors": {"contributor": [{"credit-name": {"value": "José Pérez"}, "contributor-orcid": {"path": "P"}, "contributor-attributes": {"contributor-role": "author"}}, {"credit-name": None}]},
}


def test_registry(spark):
    summary = {"group": [{"work-summary": [{"put-code": 9, "external-ids": {"external-id": [{"external-id-type": "doi", "external-id-value": "10.9/z", "external-id-relationship": "self"}]}}, {"put-code": 4}]}]}
    both = [("A", json.dumps(summary)), ("B", json.dumps({"activities-summary": {"works": summary}})), ("C", "{}"), ("D", None)]
    got = registry.summaries(spark.createDataFrame(both, "orcid_id string, json string")).collect()
    assert {(r.orcid_id, r.put_code, r.orcid_group) for r in got} == {("A", 9, "A:4"), ("A", 4, "A:4"), ("B", 9, "B:4"), ("B", 4, "B:4")}
    payloads = spark.createDataFrame([("A", 9, "A:4", json.dumps(WORK)), ("A", 4, "A:4", "{}"), ("A", 5, None, json.dumps({"title": {"title": {"value": "On Things"}}, "publication-date": {"year": {"value": "x"}}}))], ingest.PAYLOAD)
    rows = {r.put_code: r for r in registry.parsed_works(payloads).collect()}
    assert rows[9].work_key == "doi:10.9/z" and rows[9].publication_year == 2019 and [(c.normalized_name, c.tokens, c.orcid_id) for c in rows[9].contributors] == [("jose perez", ["jose", "perez"], "P")]
    assert rows[4].work_key == "put:A:4" and rows[5].work_key == "title:A:on things|" and rows[5].publication_year is None
    works = prepare.registry_groups(spark.createDataFrame([("A", 9, None, [("DOI", "10.9/Z", None)])], "orcid_id string, put_code long, orcid_group string, external_ids array<struct<type: string, value: string, relationship: string>>"), registry.summaries(spark.createDataFrame(both, "orcid_id string, json string"))).first()
    assert works.orcid_group == "A:4" and works.external_ids[0].relationship == "self"
    raw = [(json.dumps({"id": "W1", "doi": "https://doi.org/10.9/Z", "best_oa_location": {"pdf_url": "u"}, "open_access": {"is_oa": True}, "abstract_inverted_index": {"b": [1], "a": [0]}}),), ("not json",)]
    meta = {r.doi: r for r in registry.metadata(spark.createDataFrame(raw, "json string"), "s").collect()}
    assert meta["10.9/z"].abstract == "a b" and meta["10.9/z"].topics == [] and meta["10.9/z"].pdf_url == "u" and None in meta
    act = {"employments": {"affiliation-group": [{"summaries": [{"employment-summary": {"organization": {"name": "Universidad Ñ"}, "department-name": "Dept"}}, {"x": {"organization": {"name": "Other"}}}]}]}}
    found = registry.affiliations(spark.createDataFrame([("A", json.dumps(act))], "orcid_id string, json string"), r"\buniversidad n\b").collect()
    assert [r.institution for r in found] == ["Universidad Ñ, Dept"]
    plan = registry.plan_partitions("q", lambda p: {"a": 20_000, "b": 5}.get(p.prefix, 3 if p.prefix == "ab" else 0))
    assert [p.query() for p in plan] == ["q AND family-name:b*", "q AND family-name:ab*"] and list(registry.pages(2100)) == [(0, 1000), (1000, 1000), (2000, 100)]
    answered = registry.fetched(spark.createDataFrame([("A",), ("B",)], "orcid_id string"), lambda r: json.dumps(r) if r["orcid_id"] == "A" else 1 / 0, pause=0)
    assert {r.orcid_id: r.json for r in answered.collect()} == {"A": '{"orcid_id": "A"}', "B": None}


def test_queue(spark):
    w = spark.createDataFrame([([("doi", "https://doi.org/10.1/A", "part-of")],), ([("doi", "10.1/a", None)],), ([("eid", "1", None)],), ([("DOI", "10.1/x", None)],), (None,)], "external_ids array<struct<type: string, value: string, relationship: string>>")
    queue = spark.createDataFrame([], schemas.QUEUE)
    new = registry.new_tasks(w, queue, "s")
    assert [r.doi for r in new.collect()] == ["10.1/a"] and registry.new_tasks(w, new, "s").count() == 0
    full = spark.createDataFrame([("10.1/A", "s", "pending", 0, None), ("10.1/b", "s", "pending", 0, None), ("10.1/c", "s", "failed", 2, None)], schemas.QUEUE)
    results = spark.createDataFrame([("https://doi.org/10.1/a", "s"), (None, "s"), ("10.1/c", "s")], "doi string, source string")
    assert {(r.doi, r.status, r.attempts) for r in registry.settle(full, results).collect()} == {("10.1/A", "done", 0), ("10.1/b", "failed", 1), ("10.1/c", "failed", 2)}
    assert registry.batches(full).count() == 2


def test_catalog_sinks_and_stream(spark, data, people, tmp_path):
    with pytest.raises(ValueError):
        catalog.Catalog(spark, "")
    c = catalog.Catalog(spark, f"file://{tmp_path}/cat")
    who = spark.createDataFrame([("A",), ("A",), ("B",)], "orcid_id string")
    rows = c.read("profiles").limit(0).unionByName(who.withColumns({"focal_author": F.lit(True), "harvested": F.lit(False)}), allowMissingColumns=True)
    assert c.insert_new("profiles", rows) == 2 and c.insert_new("profiles", rows) == 0 and c.unharvested().count() == 2
    c.mark_harvested(who.limit(1))
    assert [r.orcid_id for r in c.unharvested(5).collect()] == ["B"] and c.reset_harvested().where("harvested").count() == 0
    meta = c.read("works_metadata").limit(0).unionByName(spark.createDataFrame([("s", "10.1/a", "v1")], "source string, doi string, openalex_id string"), allowMissingColumns=True)
    c.upsert("works_metadata", meta)
    assert [r.openalex_id for r in c.upsert("works_metadata", meta.withColumn("openalex_id", F.lit("v2"))).collect()] == ["v2"]
    counts = sinks.dump({"works": data.select("orcid_id", "title"), "people": people}, f"file://{tmp_path}/dump")
    assert counts == {"people": 3, "works": 8} and spark.read.json(f"file://{tmp_path}/dump/metadata").count() == 2
    report = sinks.report(data, people)
    assert json.loads(sinks.report_json(report))["summary"]["total_publications"] == 6
    inbox = tmp_path / "inbox"
    inbox.mkdir()
    line = {"orcid_id": "A", "put_code": 9, "orcid_group": "A:9", "json": json.dumps(WORK)}
    (inbox / "1.json").write_text(json.dumps(line) + "\n" + json.dumps(line | {"put_code": 10}))
    for _ in range(2):
        ingest.ingest(c, f"file://{inbox}", f"file://{tmp_path}/check").awaitTermination()
    assert c.read("works").count() == 2 and c.read("metadata_queue").count() == 1
    (inbox / "2.json").write_text(json.dumps(line))
    ingest.ingest(c, f"file://{inbox}", f"file://{tmp_path}/check").awaitTermination()
    assert c.read("works").count() == 2


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0 and set(e.oracle_sql()) <= set(e.queries())


def test_works_after_release(spark, tmp_path):
    import shutil

    import pyarrow.parquet as pq

    from folioscope import runtime
    from folioscope.sources import adapters

    for name in ("lineitem", "orders", "part", "supplier", "nation"):
        shutil.copy(f"/root/testdata/sf0.001/{name}.parquet", tmp_path)
    before = adapters.records(spark, str(tmp_path)).count()
    runtime.release()
    assert adapters.records(spark, str(tmp_path)).count() == before  # written anew
    pq.write_table(pq.read_table(tmp_path / "lineitem.parquet").slice(0, 7), tmp_path / "lineitem.parquet")
    assert adapters.records(spark, str(tmp_path)).count() == 7  # a changed folder is noticed


@pytest.mark.parametrize("gathered", [0, 10**6])
def test_components_by_rounds_and_in_one_task(spark, gathered):
    import random

    from folioscope.operators import components

    r = random.Random(2)
    pairs = [(f"n{r.randrange(90)}", f"n{r.randrange(90)}") for _ in range(60)] + [(f"z{i:02d}", f"z{i + 1:02d}") for i in range(20)] + [("hub", f"m{i}") for i in range(30)] + [("self", "self")]
    label = {x: x for p in pairs for x in p}
    for _ in label:
        for a, b in pairs:
            label[a] = label[b] = min(label[a], label[b])
    got = {x.node: x.root for x in components.components(spark.createDataFrame(pairs, "a string, b string"), gathered=gathered).collect()}
    assert got == {x: y for x, y in label.items() if any(x in p and p[0] != p[1] for p in pairs)}
    assert components.components(spark.createDataFrame([], "a long, b long"), gathered=gathered).count() == 0


def test_rounds_of_components_take_more_tasks_for_more_links(spark, monkeypatch):
    """A round's table is not gathered into a fixed number of tasks, each of which would grow with the links."""
    from folioscope.operators import components
    from folioscope.runtime import written

    seen = []

    def noted(df, few=False):
        if df.columns == ["u", "v"]:
            seen.append((few, df.rdd.getNumPartitions()))
        return written(df, few)

    monkeypatch.setattr(components, "written", noted)
    monkeypatch.setattr(components, "TASK_LINKS", 100)
    links = spark.range(4000).select(F.col("id").alias("a"), (F.col("id") - F.col("id") % 40 + (F.col("id") * 7 + 3) % 40).alias("b"))
    got = {(r.node, r.root) for r in components.components(links, gathered=0).collect()}
    parent = {}

    def top(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for i in range(4000):
        a, b = sorted((top(i), top(i - i % 40 + (i * 7 + 3) % 40)))
        parent[b] = a
    alone = {i for i in range(4000) if (i * 7 + 3) % 40 == i % 40 and not any((j * 7 + 3) % 40 == i % 40 for j in range(40) if j != i % 40)}
    assert got == {(i, top(i)) for i in range(4000) if i not in alone}
    assert len(seen) > 1 and not any(few for few, _ in seen) and all(n >= 30 for _, n in seen[1:])


def test_components_of_whole_relation(spark, tmp_path):
    from folioscope.plans import queries as plans

    rows = [(o, o * 7 % 97 if o % 3 else o) for o in range(1, 400)] + [(o, (o - 1) * 7 % 97) for o in range(20, 60)] + [(None, 5), (401, None)]
    (tmp_path / "t").mkdir()
    spark.createDataFrame(rows, "l_orderkey long, l_partkey long").write.parquet(str(tmp_path / "t" / "lineitem.parquet"))
    parent = {}

    def root(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    pairs = [(str(o), ("part", p)) for o, p in rows if o is not None and p is not None]
    for o, p in pairs:
        parent[root(o)] = root(p)
    least = {}
    for o, _ in pairs:
        least[root(o)] = min(least.get(root(o), o), o)
    got = {(r.orcid_id, r.component) for r in plans.QUERIES["identifier_components_all"](spark, str(tmp_path / "t")).collect()}
    assert {x for x in got if x[0] not in (None, "401")} == {(o, least[root(o)]) for o, _ in pairs} and len({c for _, c in got}) > 50


def test_normalisers_on_all_documents(spark, tmp_path):
    from folioscope.plans import queries as plans

    texts = ["Éva Ñandú-O’Neil", "A <b>Straße</b> &amp; Ünïon: 2", "a STRASSE union 2", "", None, "Ωmega"]
    docs = [(i, t, "en", "s", len(t or "")) for i, t in enumerate(texts)]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    names = {r.doc_id: r.name for r in plans.QUERIES["person_names"](spark, str(tmp_path)).collect()}
    assert names == {0: "eva nandu oneil", 1: "a bstraeb amp union", 2: "a strasse union", 3: "", 4: "", 5: "mega"}
    blocks = {r.title: r.records for r in plans.QUERIES["title_blocks"](spark, str(tmp_path)).collect()}
    assert blocks == {"eva nandu o neil": 1, "a strasse union 2": 2, "": 2, "ωmega": 1}


def test_discovery_states(spark, tmp_path):
    from folioscope.sources import registry
    from folioscope.sources.catalog import Catalog

    catalog, saved = Catalog(spark, str(tmp_path / "c")), []

    def count(query):
        prefix = query.rpartition(":")[2].rstrip("*")
        if prefix == "c":
            raise RuntimeError("lost")
        return {"a": 5, "b": 30, "ba": 7, "bq": 2}.get(prefix, 0)

    def fetch(query, start, rows):
        return f"{query} {start} {rows}"

    found = registry.Discovery(catalog, count, fetch, lambda pages: saved.extend(sorted(r.json for r in pages.collect())), most=10)
    found.seed("q")
    found.seed("q")  # adds nothing
    assert catalog.read("partitions").count() == 26
    assert found.run() == 3 and saved == ["q AND family-name:a* 0 5", "q AND family-name:ba* 0 7", "q AND family-name:bq* 0 2"]
    # A prefix whose answer failed is not claimed again until it is released; the rest is finished without it.
    assert [r.prefix for r in catalog.read("partitions").where("status <> 'done'").collect()] == ["c"]
    assert found.run() == 0 and found.resume() == 1
    again = registry.Discovery(catalog, lambda query: 1, fetch, lambda pages: saved.extend(r.json for r in pages.collect()), most=10)
    assert again.run() == 1 and saved[-1] == "q AND family-name:c* 0 1"
    assert [r.status for r in catalog.read("partitions").select("status").distinct().collect()] == ["done"]


def test_enrichment_states(spark, tmp_path):
    import datetime

    from folioscope.sources import registry
    from folioscope.sources.catalog import Catalog

    catalog = Catalog(spark, str(tmp_path / "c"))
    now = datetime.datetime(2020, 1, 1)
    rows = [(f"10.1/{i:02d}", "e", "pending", 0, now) for i in range(7)] + [("10.1/99", "e", "processing", 0, now), ("10.1/00", "other", "pending", 0, now)]
    catalog.write("metadata_queue", spark.createDataFrame(rows, catalog.read("metadata_queue").schema))

    def fetch(dois):
        if "10.1/03" in dois:
            raise OSError("down")
        return [f'{{"id": "W", "doi": "https://doi.org/{d.upper()}"}}' for d in dois if d != "10.1/01"] + ['{"id": "X", "doi": null}']

    assert registry.enrich(catalog, "e", fetch, size=3) == {"done": 3, "failed": 4}
    state = {(r.doi, r.source): (r.status, r.attempts) for r in catalog.read("metadata_queue").collect()}
    assert state == {("10.1/00", "e"): ("done", 0), ("10.1/01", "e"): ("failed", 1), ("10.1/02", "e"): ("done", 0), **{(f"10.1/0{i}", "e"): ("failed", 1) for i in (3, 4, 5)}, ("10.1/06", "e"): ("done", 0), ("10.1/99", "e"): ("processing", 0), ("10.1/00", "other"): ("pending", 0)}
    assert {r.doi for r in catalog.read("works_metadata").collect()} == {"10.1/00", "10.1/02", "10.1/06"}
    works = spark.createDataFrame([([("doi", "10.1/00", "self")],)], "external_ids array<struct<type: string, value: string, relationship: string>>")
    assert registry.enrich_new(catalog, works, "e", fetch) == {"queued": 0, "done": 0, "failed": 0}
    assert registry.batch_url("http://x/works", ["10.1/a b", "10.2/c"]) == "http://x/works?filter=doi:10.1%2Fa%20b|10.2%2Fc&per-page=2"


def test_json_pages(spark, tmp_path):
    import json

    from folioscope.sources import http

    for i, n in enumerate([2, 2, 1]):
        (tmp_path / f"a{2 * i}").write_text(json.dumps({"items": list(range(n))}))
    (tmp_path / "b0").write_text(json.dumps({"items": None, "num-found": 41}))
    got = http.pages(spark, {k: f"file://{tmp_path}/{k}{{start}}" for k in "ab"}, rows=2, items="items", pause=0).collect()
    assert sorted((r.key, r.page, len(json.loads(r.json)["items"] or [])) for r in got) == [("a", 0, 2), ("a", 1, 2), ("a", 2, 1), ("b", 0, 0)]
    assert http.estimate(spark, f"file://{tmp_path}/b{{rows}}") == 41


def test_steps_fail_where_they_run(spark):
    from folioscope.operators import prepare

    base = spark.range(3).withColumn("x", F.lit("a"))
    tables, report = prepare.run_steps({"t": base}, [("ok", "t", lambda t: t["t"].withColumn("y", F.lit(1))), ("bad", "t", lambda t: t["t"].withColumn("z", F.expr("assert_true(id < 2)"))), ("missing", "t", lambda t: t["t"].select("no")), ("last", "t", lambda t: t["t"].withColumn("w", F.lit(2)))])
    assert [r["status"] for r in report] == ["success", "failed", "failed", "success"] and tables["t"].columns == ["id", "x", "y", "w"] and tables["t"].count() == 3


def test_links_and_times(spark):
    from folioscope.functions import params
    from folioscope.operators import stats

    assert params.filter_link("/a/works", ["x y", ""], ["t"], 2001, None) == "/a/works?topic=x+y&type=t&year_from=2001" and params.filter_link("/a") == "/a"
    stamp = stats.with_computed_at(spark.range(1)).first().computed_at
    assert len(stamp) == 27 and stamp[10] == "T" and stamp.endswith("Z")
    assert stats.open_access_share(spark.createDataFrame([], "is_oa boolean")).first().percent == 0


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_works_compute_only_what_a_query_reads(spark):
    from folioscope import runtime
    from folioscope.plans.queries import QUERIES

    runtime.release()
    counted = _plan(QUERIES["publications_per_year"](spark, "/root/testdata/sf0.001"))
    assert not runtime._written  # no table of all works
    assert "row_number" not in counted and "collect_set" not in counted and "p_name" not in counted
    assert "collect_set" not in _plan(QUERIES["work_type_counts"](spark, "/root/testdata/sf0.001"))


def test_works_of_odd_tables(spark, tmp_path):
    """A line item without a part is no record, but its owner is of the order; one without an order or owner counts for nothing; a repeated supplier is one person."""
    from folioscope.sources import adapters

    date = "timestamp '1997-01-02'"
    line = lambda o, p, s, n: f"SELECT {o}L AS l_orderkey, {p}L AS l_partkey, {s}L AS l_suppkey, {n} AS l_linenumber, 1D AS l_quantity, 1D AS l_extendedprice, 0D AS l_discount, 0D AS l_tax, 'R' AS l_returnflag, 'O' AS l_linestatus, {date} AS l_shipdate"
    lines = " UNION ALL ".join([line(1, 1, 1, 1), line(1, 9, 2, 2), line(1, 1, 8, 3), line(7, 1, 1, 1), line(2, 1, 1, 1), line(2, 1, 1, 1)])
    tables = {
        "lineitem": lines, "orders": "SELECT explode(array(1L, 2L)) AS o_orderkey, 'x' AS o_orderpriority", "part": "SELECT 1L AS p_partkey, 'a b' AS p_name, 'B#1' AS p_brand, 't' AS p_type",
        "supplier": "SELECT * FROM VALUES (1L, 'S#1', 0), (2L, 'S#2', 1), (1L, 'S#1', 0) AS t(s_suppkey, s_name, s_nationkey)", "nation": "SELECT * FROM VALUES (0, 'N', 0), (1, 'M', 1) AS t(n_nationkey, n_name, n_regionkey)",
    }
    for name, sql in tables.items():
        spark.sql(sql).write.parquet(f"{tmp_path}/{name}.parquet")
    got = sorted((r.work_key, r.orcid_id, r.put_code, r.focal_work, r.author_count, [c.orcid_id for c in r.contributors]) for r in adapters.planned(spark, str(tmp_path)).collect())
    one, two = [("doi:1", "1", 1, True, 2, ["1", "2"])] * 2, [("doi:2", "1", k, False, 1, ["1"]) for k in (2, 2, 3, 3)]
    assert got == one + two


def test_deals_follow_the_rows(spark, monkeypatch):
    """Few shuffle partitions, joined into fewer, do not make few tasks of many rows: neither where works are made, nor where a network's pairs are summed."""
    from folioscope import runtime
    from folioscope.plans import queries
    from folioscope.sources import adapters

    folder = "/root/testdata/sf0.001"
    plain = works.authorship(adapters.planned(spark, folder).where(predicates.works()))
    expected = sorted(map(tuple, graph.edges(plain).collect()))
    monkeypatch.setattr(runtime, "TASK_ROWS", 500)
    least = spark.read.parquet(f"{folder}/lineitem.parquet").count() // 500
    assert least > int(spark.conf.get("spark.sql.shuffle.partitions"))
    assert adapters.planned(spark, folder).rdd.getNumPartitions() >= least
    got = queries.network_edges_all(spark, folder)
    assert got.rdd.getNumPartitions() >= least and sorted(map(tuple, got.collect())) == expected


def test_topics_of_listed_works(spark, data, monkeypatch):
    """Keys looked up in place and keys met by a join keep the same records, each once; topics are those of the merged works, and nobody's people are gathered for them."""
    from folioscope.plans import queries

    one = [r.work_key for r in data.where("work_key IS NOT NULL").select("work_key").distinct().orderBy("work_key").limit(2).collect()]
    keys = spark.createDataFrame([(k,) for k in (*one, *one, None, "none")], "work_key string")
    expected = sorted((r.work_key, r.orcid_id, r.put_code) for r in data.collect() if r.work_key in one)
    for most in (graph.BROADCAST_KEYS, 0):
        monkeypatch.setattr(graph, "BROADCAST_KEYS", most)
        for tasks in (None, 3):
            some = graph.of_works(data, keys, tasks)
            assert sorted((r.work_key, r.orcid_id, r.put_code) for r in some.collect()) == expected and len(expected) > 2
    same = lambda df: sorted((r.work_key or "", r.topics) for r in df.select("work_key", "topics").collect())
    assert same(works.work_topics(data)) == same(works.collapse(data))
    plan = queries.component_pair_topics(spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert "collect_set" not in plan
