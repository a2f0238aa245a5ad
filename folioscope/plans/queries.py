"""The registered queries: engine operators on the supplied tables, with oracle SQL where SQL can say the same."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import params, text
from ..operators import authors, graph, identity, predicates, prepare, search, stats, textindex
from ..operators.works import collapse, work_topics
from ..runtime import shared_dir, written
from ..sources import adapters, registry
from ..sources.identities import Identities
from ..sources.tables import KeyedTable
from .oracles import AUTHOR, COMPONENT, NETWORK, sql

QUERIES: dict = {}
ORACLES: dict = {}

YEARS = (1996, 1999)
IDENT = "7"
FILTERS = {"topics": ["SMALL", "PROMO"], "types": ["2-HIGH", "5-LOW"], "year_from": 1996, "year_to": 1999}
NET = {"start": 1997, "end": 1997, "kind": "5-LOW", "topic": "PROMO", "seed": IDENT}


def query(oracle: str | None):
    def add(f):
        QUERIES[f.__name__] = f
        if oracle:
            ORACLES[f.__name__] = oracle
        return f

    return add


records, profiles, read = adapters.planned, adapters.profiles, adapters.read


# --- statistics -------------------------------------------------------------------------------------------


@query(sql("""SELECT year, count(*) AS count FROM (SELECT work_key, max(publication_year) AS year FROM fw WHERE publication_year BETWEEN 1969 AND 2100 GROUP BY work_key) GROUP BY year"""))
def publications_per_year(spark, d):
    return stats.publications_per_year(records(spark, d), end_year=2100)


@query(sql("""SELECT institution, publication_year AS year, count(*) AS count FROM (SELECT * FROM fw WHERE publication_year BETWEEN 1996 AND 1999
  QUALIFY row_number() OVER (PARTITION BY work_key ORDER BY orcid_id, put_code) = 1) GROUP BY ALL"""))
def publications_per_institution_per_year(spark, d):
    return stats.publications_per_institution_per_year(records(spark, d), *YEARS)


@query(sql("SELECT type, count(*) AS count FROM firsts GROUP BY type"))
def publications_per_type(spark, d):
    return stats.publications_per_type(records(spark, d))


@query(sql("SELECT orcid_id, count(DISTINCT work_key) AS count FROM fw JOIN people ON orcid_id = id WHERE focal GROUP BY orcid_id ORDER BY count DESC, orcid_id LIMIT 10"))
def top_authors(spark, d):
    return stats.top_authors(records(spark, d), profiles(spark, d))


@query(sql("SELECT id AS orcid_id, s_name AS name, count(*) AS publication_count FROM linked WHERE focal GROUP BY ALL ORDER BY publication_count DESC, id LIMIT 10"))
def top_contributors(spark, d):
    return stats.top_contributors(records(spark, d), profiles(spark, d))


@query(sql("""SELECT count(*) AS total_publications, round(avg(author_count), 2) AS avg_authors_per_publication, CAST(min(author_count) AS INTEGER) AS min_authors, CAST(max(author_count) AS INTEGER) AS max_authors,
  min(publication_year) AS min_year, max(publication_year) AS max_year, (SELECT count(DISTINCT institution) FROM fw) AS total_institutions, (SELECT count(DISTINCT type) FROM fw) AS publication_types FROM firsts"""))
def metrics_summary(spark, d):
    return stats.metrics_summary(records(spark, d))


@query(sql("SELECT keyword, count(DISTINCT work_key) AS count FROM (SELECT work_key, unnest(string_split(title, ' ')) AS keyword FROM firsts) GROUP BY keyword ORDER BY count DESC, keyword LIMIT 100"))
def keyword_counts(spark, d):
    return stats.top_keywords(records(spark, d))


@query(sql("SELECT type AS value, count(*) AS count FROM firsts GROUP BY type ORDER BY count DESC, value LIMIT 100"))
def work_type_counts(spark, d):
    return stats.value_counts(records(spark, d), "type")


@query(sql("SELECT topic AS value, count(*) AS count FROM firsts GROUP BY topic ORDER BY count DESC, value LIMIT 100"))
def subject_counts(spark, d):
    return stats.value_counts(records(spark, d), "topics.field.display_name")


@query(sql("SELECT institution, count(*) AS total FROM firsts GROUP BY institution ORDER BY total DESC, institution LIMIT 15"))
def institution_totals_top15(spark, d):
    return stats.institution_totals(stats.publications_per_institution_per_year(records(spark, d)))


@query(sql("SELECT type, count(*) AS count, round(count(*) * 100.0 / sum(count(*)) OVER (), 6) AS percentage FROM firsts GROUP BY type"))
def type_percentages(spark, d):
    return stats.type_percentages(stats.publications_per_type(records(spark, d))).withColumn("percentage", F.round("percentage", 6))


SERIES = "(SELECT year, count(*) AS count FROM (SELECT work_key, max(publication_year) AS year FROM fw GROUP BY work_key) GROUP BY year)"


@query(sql(f"""SELECT year, count, count - lag(count) OVER (ORDER BY year) AS change, CASE WHEN count > lag(count) OVER (ORDER BY year) THEN 'UP'
  WHEN count < lag(count) OVER (ORDER BY year) THEN 'DOWN' WHEN lag(count) OVER (ORDER BY year) IS NOT NULL THEN 'SAME' END AS trend FROM {SERIES}"""))
def yearly_trend(spark, d):
    return stats.yearly_trend(stats.publications_per_year(records(spark, d), end_year=2100))


@query(sql("""SELECT CAST(y AS INTEGER) AS year, coalesce(c, 0) AS count, (SELECT year FROM (SELECT publication_year AS year, count(*) AS c FROM mine GROUP BY ALL) ORDER BY c DESC, year LIMIT 1) AS peak_year
  FROM (SELECT unnest(range((SELECT min(publication_year) FROM mine), (SELECT max(publication_year) FROM mine) + 1)) AS y) LEFT JOIN (SELECT publication_year, count(*) AS c FROM mine GROUP BY ALL) ON y = publication_year""", AUTHOR, ident=IDENT))
def yearly_series_zero_filled(spark, d):
    return stats.zero_filled(authors.per_year(authors.author_works(records(spark, d), IDENT)))


@query(sql("""SELECT year, count, round(100.0 * count / max(count) OVER (), 6) AS height, year BETWEEN 1996 AND 1999 AS in_range FROM (SELECT publication_year AS year, count(*) AS count FROM mine GROUP BY ALL)""", AUTHOR, ident=IDENT))
def year_histogram(spark, d):
    return stats.histogram(authors.per_year(authors.author_works(records(spark, d), IDENT)), *YEARS).withColumn("height", F.round("height", 6))


# --- search -----------------------------------------------------------------------------------------------


def _page(rows: DataFrame) -> DataFrame:
    return rows.withColumn("contributors", F.array_join("contributors", ";"))


PAGE_SQL = """SELECT work_key, doi, title, publication_year, type, first_journal AS journal_title, (SELECT string_agg(s_name, ';' ORDER BY s_name) FROM linked l WHERE l.k = c.k) AS contributors
  FROM (SELECT * FROM ({rows}) ORDER BY publication_year DESC NULLS LAST, work_key LIMIT {limit} OFFSET {skip}) c"""

#: Filtered search collapses the records that match, so its oracle does too.
FILTERED = """,
hit AS (SELECT * FROM fw WHERE {where}),
hits AS (SELECT * FROM (SELECT * EXCLUDE (publication_year, journal_title), journal_title AS first_journal FROM hit QUALIFY row_number() OVER (PARTITION BY work_key ORDER BY orcid_id, put_code) = 1) JOIN
  (SELECT work_key AS wk, max(publication_year) AS publication_year FROM hit GROUP BY work_key) ON work_key = wk)
"""


@query(sql(PAGE_SQL, rows="SELECT * FROM collapsed", limit=50, skip=50))
def works_search_page(spark, d):
    return _page(search.works_page(records(spark, d), page=2))


@query(sql(PAGE_SQL, FILTERED, where="title ILIKE '%red%' AND title ILIKE '%bolt%'", rows="SELECT * FROM hits", limit=50, skip=0))
def works_search_text(spark, d):
    return _page(search.works_page(records(spark, d), query="RÉD bolt"))


@query(sql(PAGE_SQL, FILTERED, where="publication_year BETWEEN 1996 AND 1999 AND type IN ('2-HIGH', '5-LOW')", rows="SELECT * FROM hits", limit=50, skip=0))
def works_filter_years_types(spark, d):
    return _page(search.works_page(records(spark, d), start_year=1996, end_year=1999, types=["2-HIGH", "5-LOW"]))


@query(sql(PAGE_SQL, FILTERED, where="topic = 'ECONOMY' AND (title LIKE 'red %' OR title LIKE '% red') AND institution ILIKE '%n_1%'", rows="SELECT * FROM hits", limit=50, skip=0))
def works_filter_subject_keyword_institute(spark, d):
    return _page(search.works_page(records(spark, d), subjects=["ECONOMY"], keywords=["red"], institutes=["Ñ_1"]))


@query(sql("SELECT count(DISTINCT work_key) AS total FROM fw WHERE type = '5-LOW'"))
def works_total(spark, d):
    return search.works_total(records(spark, d), types=["5-LOW"])


def _counted(spark, d) -> DataFrame:
    return prepare.set_counts(profiles(spark, d), records(spark, d))


AUTHOR_COUNTS = "(SELECT id AS orcid_id, string_split(s_name, '#')[1] AS given_names, string_split(s_name, '#')[2] AS family_names, (SELECT count(*) FROM linked l WHERE l.id = p.id) AS count, n_name, focal FROM people p)"


@query(sql(f"SELECT orcid_id, given_names, family_names, count FROM {AUTHOR_COUNTS} WHERE focal ORDER BY count DESC, orcid_id LIMIT 50"))
def authors_page(spark, d):
    return search.authors_page(_counted(spark, d))


@query(sql(f"SELECT orcid_id, given_names, family_names, count FROM {AUTHOR_COUNTS} WHERE focal AND family_names LIKE '%1%' AND given_names ILIKE '%supplier%' ORDER BY count DESC, orcid_id LIMIT 5"))
def authors_search(spark, d):
    return search.authors_page(_counted(spark, d), limit=5, query="súpplier 1")


@query(sql(f"SELECT orcid_id, given_names, family_names, count, 'N/A' AS institution FROM {AUTHOR_COUNTS} WHERE focal"))
def authors_legacy(spark, d):
    return search.all_authors(_counted(spark, d))


@query(sql("SELECT doi, title, publication_year, type, journal_title, CASE WHEN is_oa THEN oa_url END AS oa_url FROM firsts"))
def works_legacy_by_doi(spark, d):
    return search.works_by_doi(records(spark, d))


# --- one author -------------------------------------------------------------------------------------------


def _mine(spark, d) -> DataFrame:
    return authors.author_works(records(spark, d), IDENT)


@query(sql("""SELECT count(*) AS works, count(*) FILTER (is_oa) AS open_access, count(*) FILTER (oa_checked) AS open_access_checked, min(publication_year) AS first_year, max(publication_year) AS last_year FROM mine""", AUTHOR, ident=IDENT))
def author_totals(spark, d):
    return authors.totals(_mine(spark, d))


@query(sql("SELECT publication_year AS year, count(*) AS count FROM mine GROUP BY ALL", AUTHOR, ident=IDENT))
def author_per_year(spark, d):
    return authors.per_year(_mine(spark, d))


@query(sql("SELECT topic AS value, count(*) AS count FROM mine GROUP BY ALL ORDER BY count DESC, value LIMIT 8", AUTHOR, ident=IDENT))
def author_topics_top8(spark, d):
    return authors.breakdown(_mine(spark, d), "topics")


@query(sql("SELECT type AS value, count(*) AS count FROM mine GROUP BY ALL ORDER BY count DESC, value LIMIT 8", AUTHOR, ident=IDENT))
def author_types_top8(spark, d):
    return authors.breakdown(_mine(spark, d), "type")


IN_YEARS, IN_TYPES, IN_TOPICS = "publication_year BETWEEN 1996 AND 1999", "type IN ('2-HIGH', '5-LOW')", "topic IN ('SMALL', 'PROMO')"


@query(sql(f"SELECT topic AS value, count(*) AS count FROM mine WHERE {IN_YEARS} AND {IN_TYPES} GROUP BY ALL", AUTHOR, ident=IDENT))
def author_facets_topics(spark, d):
    return authors.facet_values(_mine(spark, d), "topics", FILTERS)


@query(sql(f"SELECT type AS value, count(*) AS count FROM mine WHERE {IN_YEARS} AND {IN_TOPICS} GROUP BY ALL", AUTHOR, ident=IDENT))
def author_facets_types(spark, d):
    return authors.facet_values(_mine(spark, d), "type", FILTERS)


@query(sql(f"SELECT publication_year AS year, count(*) AS count FROM mine WHERE {IN_TYPES} AND {IN_TOPICS} GROUP BY ALL", AUTHOR, ident=IDENT))
def author_facets_years(spark, d):
    return authors.facet_years(_mine(spark, d), FILTERS)


@query(sql(f"SELECT count(*) FILTER (is_oa) AS count, count(*) AS total FROM mine WHERE {IN_YEARS} AND {IN_TYPES} AND {IN_TOPICS}", AUTHOR, ident=IDENT))
def author_facets_oa(spark, d):
    return authors.facet_open_access(_mine(spark, d), FILTERS | {"oa": True})


@query(sql(f"""SELECT * FROM (SELECT 'total' AS facet, 'total' AS value, count(*) AS count FROM mine WHERE {IN_YEARS} AND {IN_TYPES} AND {IN_TOPICS}
UNION ALL (SELECT 'topics', topic, count(*) FROM mine WHERE {IN_YEARS} AND {IN_TYPES} GROUP BY ALL) UNION ALL (SELECT 'type', type, count(*) FROM mine WHERE {IN_YEARS} AND {IN_TOPICS} GROUP BY ALL)
UNION ALL (SELECT 'years', CAST(publication_year AS VARCHAR), count(*) FROM mine WHERE {IN_TYPES} AND {IN_TOPICS} GROUP BY ALL)
UNION ALL SELECT 'oa', 'total', count(*) FROM mine WHERE {IN_YEARS} AND {IN_TYPES} AND {IN_TOPICS} UNION ALL SELECT 'oa', 'open', count(*) FROM mine WHERE is_oa AND {IN_YEARS} AND {IN_TYPES} AND {IN_TOPICS}) WHERE count > 0""", AUTHOR, ident=IDENT))
def author_facets_one_pass(spark, d):
    return authors.facet_counts(_mine(spark, d), FILTERS)


@query(sql(f"""SELECT value, coalesce(n, 0) AS count, value IN ('SMALL', 'NONE') AS selected FROM (SELECT unnest(['SMALL', 'NONE']) AS value UNION
  (SELECT topic FROM mine WHERE topic <> 'SMALL' GROUP BY topic ORDER BY count(*) DESC, topic LIMIT 2)) LEFT JOIN (SELECT topic, count(*) AS n FROM mine GROUP BY topic) ON topic = value""", AUTHOR, ident=IDENT))
def author_facet_options(spark, d):
    return authors.facet_options(authors.breakdown(_mine(spark, d), "topics", None), ["SMALL", "NONE"], 4)


WORKS_SQL = "SELECT work_key, title, publication_year, CASE WHEN is_oa THEN oa_url END AS oa_url, is_oa AS oa_is_pdf FROM mine ORDER BY {order}, work_key LIMIT 20 OFFSET {skip}"


def _listed(spark, d, **kw) -> DataFrame:
    return authors.works_page(_mine(spark, d), **kw).select("work_key", "title", "publication_year", "oa_url", "oa_is_pdf")


@query(sql(WORKS_SQL, AUTHOR, ident=IDENT, order="publication_year DESC NULLS LAST", skip=0))
def author_works_newest(spark, d):
    return _listed(spark, d)


@query(sql(WORKS_SQL, AUTHOR, ident=IDENT, order="publication_year ASC NULLS FIRST", skip=20))
def author_works_oldest(spark, d):
    return _listed(spark, d, sort="oldest", page=2)


@query(sql(WORKS_SQL, AUTHOR, ident=IDENT, order="lower(title)", skip=0))
def author_works_title(spark, d):
    return _listed(spark, d, sort="title")


@query(sql(f"SELECT id AS orcid_id, count(*) AS count FROM linked WHERE k IN (SELECT k FROM mine) AND id <> '{IDENT}' GROUP BY id", AUTHOR, ident=IDENT))
def author_collaborators(spark, d):
    return authors.collaborators(records(spark, d), IDENT)


@query(sql(f"""SELECT l.id AS orcid_id, replace(s_name, '#', ' ') AS name, count(*) AS shared_works, true AS in_dataset, round(100.0 * count(*) / max(count(*)) OVER (), 6) AS width
  FROM linked l WHERE k IN (SELECT k FROM mine) AND id <> '{IDENT}' GROUP BY ALL ORDER BY shared_works DESC, orcid_id LIMIT 5""", AUTHOR, ident=IDENT))
def author_top_collaborators(spark, d):
    return authors.top_collaborators(records(spark, d), profiles(spark, d), IDENT).withColumn("width", F.round("width", 6))


@query(sql(f"SELECT s_name AS name, (SELECT count(*) FROM works w JOIN linked l2 ON w.k = l2.k WHERE l2.id = '{IDENT}') AS count FROM people WHERE id = '{IDENT}'"))
def author_observed_names(spark, d):
    return authors.observed_names(records(spark, d), IDENT)


# --- networks ---------------------------------------------------------------------------------------------


def _network(spark, d, *also) -> DataFrame:
    """The network's records: who is on which work, and columns ``also``; written, as its relation is read several times."""
    some = graph.network_records(records(spark, d), NET["start"], NET["end"], types=[NET["kind"]], subjects=[NET["topic"]])
    return written(some.select("work_key", "orcid_id", "contributors", *also))


def _people(spark, d) -> DataFrame:
    return graph.authorship(_network(spark, d))


@query(sql("SELECT orcid_id, publications FROM nodes", NETWORK, **NET))
def network_nodes(spark, d):
    return graph.nodes(_people(spark, d))


@query(sql("SELECT source, target, weight FROM edges", NETWORK, **NET))
def network_edges(spark, d):
    return graph.edges(_people(spark, d))


@query(sql("""SELECT (SELECT count(*) FROM nodes) AS total_authors, (SELECT count(*) FROM edges) AS total_edges, CAST(coalesce((SELECT sum(weight) FROM edges), 0) AS BIGINT) AS total_collaborations,
  (SELECT count(*) FROM nodes WHERE orcid_id NOT IN (SELECT source FROM edges UNION SELECT target FROM edges)) AS solo_authors""", NETWORK, **NET))
def network_stats(spark, d):
    people = _people(spark, d)
    return graph.network_stats(graph.nodes(people), graph.edges(people))


@query(sql("SELECT orcid_id, publications FROM nodes WHERE orcid_id NOT IN (SELECT source FROM edges UNION SELECT target FROM edges)", NETWORK, **NET))
def network_solo_authors(spark, d):
    people = _people(spark, d)
    return graph.solo(graph.nodes(people), graph.edges(people))


@query(sql("SELECT source, target, count(*) AS weight FROM (SELECT a.id AS source, b.id AS target FROM linked a JOIN linked b ON a.k = b.k AND a.id < b.id WHERE a.k IN (SELECT k FROM fw)) GROUP BY ALL"))
def network_edges_all(spark, d):
    n = adapters.dealt(spark, d)
    return graph.edges(graph.authorship(records(spark, d).where(predicates.works()), n), n)


@query(sql("SELECT id AS orcid_id FROM reach", NETWORK, COMPONENT, **NET))
def component_members(spark, d):
    return graph.members(_people(spark, d), IDENT)


def _own(network: DataFrame) -> DataFrame:
    people = graph.authorship(network)
    return people.join(graph.members(people, IDENT), "orcid_id", "left_semi").select("work_key", "orcid_id")


@query(sql("""SELECT a.orcid_id AS source, b.orcid_id AS target, count(*) AS weight, min(year) AS first_year, max(year) AS last_year FROM common a JOIN common b
  ON a.work_key = b.work_key AND a.orcid_id < b.orcid_id LEFT JOIN years y ON a.work_key = y.work_key GROUP BY ALL""", NETWORK, COMPONENT, **NET))
def component_pairs(spark, d):
    some = _network(spark, d, "put_code", "publication_year")
    return graph.pair_report(graph.shared(_own(some)), graph.first_years(some))


@query(sql("""SELECT orcid_id, count(*) AS works, count(*) FILTER (work_key IN (SELECT work_key FROM many)) AS shared_works,
  (SELECT count(*) FROM edges WHERE source = o.orcid_id OR target = o.orcid_id) AS collaborators FROM own o GROUP BY orcid_id""", NETWORK, COMPONENT, **NET))
def component_member_activity(spark, d):
    return graph.member_activity(_own(_network(spark, d)))


@query(sql("""SELECT topic AS value, count(*) AS count FROM (SELECT DISTINCT work_key FROM common) JOIN (SELECT work_key, topic FROM works QUALIFY row_number() OVER (PARTITION BY work_key ORDER BY orcid_id, put_code) = 1) USING (work_key)
  GROUP BY topic ORDER BY count DESC, value LIMIT 10""", NETWORK, COMPONENT, **NET))
def component_topics(spark, d):
    return graph.group_values(records(spark, d), graph.shared(_own(_network(spark, d))), "topics", tasks=adapters.dealt(spark, d))


SCOPE = ", scope AS (SELECT * FROM common UNION ALL SELECT * FROM own WHERE NOT EXISTS (SELECT 1 FROM common))"


@query(sql("""SELECT work_key, year, members FROM (SELECT *, row_number() OVER (PARTITION BY focus ORDER BY year DESC NULLS LAST, work_key) AS r FROM (
  SELECT s.work_key, any_value(year) AS year, string_agg(orcid_id, ';' ORDER BY orcid_id) AS members, bool_or(orcid_id = '{seed}') AS focus FROM scope s LEFT JOIN years y ON s.work_key = y.work_key GROUP BY s.work_key))
WHERE focus OR r <= 200""", NETWORK, COMPONENT, SCOPE, **NET))
def component_listed_works(spark, d):
    some = _network(spark, d, "put_code", "publication_year")
    listed = graph.listed_works(_own(some), graph.first_years(some), IDENT)
    return listed.select("work_key", "year", F.array_join("members", ";").alias("members"))


@query(sql("""SELECT source, target, string_agg(topic, ';' ORDER BY r) AS topics FROM (SELECT source, target, topic, row_number() OVER (PARTITION BY source, target ORDER BY count(*) DESC, topic) AS r
  FROM (SELECT a.work_key, a.orcid_id AS source, b.orcid_id AS target FROM common a JOIN common b ON a.work_key = b.work_key AND a.orcid_id < b.orcid_id)
  JOIN (SELECT work_key, topic FROM works QUALIFY row_number() OVER (PARTITION BY work_key ORDER BY orcid_id, put_code) = 1) USING (work_key) GROUP BY source, target, topic) WHERE r <= 3 GROUP BY ALL""", NETWORK, COMPONENT, **NET))
def component_pair_topics(spark, d):
    common = graph.shared(_own(_network(spark, d)))
    keyed = graph.of_works(records(spark, d), common, adapters.dealt(spark, d))
    return graph.pair_topics(common, work_topics(keyed)).select("source", "target", F.array_join("topics", ";").alias("topics"))


@query(sql("""SELECT count(*) AS total, count(*) FILTER (is_oa) AS open_access, CAST(CASE WHEN count(*) > 0 THEN floor(100.0 * count(*) FILTER (is_oa) / count(*) + 0.5) ELSE 0 END AS INTEGER) AS percent FROM mine""", AUTHOR, ident=IDENT))
def open_access_share(spark, d):
    return stats.open_access_share(authors.author_works(records(spark, d), IDENT))


@query(sql("""SELECT *, row_number() OVER (ORDER BY count DESC, orcid_id) AS rank FROM (SELECT orcid_id, count(DISTINCT work_key) AS count FROM fw JOIN people ON orcid_id = id WHERE focal GROUP BY orcid_id ORDER BY count DESC, orcid_id LIMIT 10)"""))
def top_authors_ranked(spark, d):
    return stats.ranked(stats.top_authors(records(spark, d), profiles(spark, d)), F.desc("count"), "orcid_id")


@query(sql("SELECT n_name AS value, count(*) AS count FROM people WHERE focal GROUP BY n_name"))
def institute_options(spark, d):
    return stats.institute_options(profiles(spark, d))


# --- preparation ------------------------------------------------------------------------------------------


def _metadata(spark, d) -> DataFrame:
    """Parts as metadata: one row for each order number that a part key has, in two sources."""
    p = read(spark, d, "part")
    name = lambda c: F.array(F.struct(F.col(c).alias("display_name"), F.struct(F.col(c).alias("display_name")).alias("field")))
    rows = p.select(
        F.concat(F.lit("10.1/o"), F.col("p_partkey").cast("string")).alias("doi"), F.explode(F.array(F.lit("a"), F.lit("b"))).alias("source"), "p_name", "p_type", "p_size",
    )
    return rows.select(
        "doi", "source", F.when(F.col("p_size") > 10, name("p_name")).otherwise(F.slice(name("p_name"), 1, 0)).alias("topics"),
        F.array(F.struct(F.concat("p_type", "source").alias("display_name"))).alias("keywords"), F.array(F.struct(F.col("p_name").alias("display_name"), F.lit(1.0).alias("score"))).alias("concepts"),
        F.struct((F.col("p_size") > 25).alias("is_oa"), F.when(F.col("p_size") > 40, F.concat(F.lit("http://x/"), "p_name")).alias("oa_url")).alias("open_access"),
    )


@query("""SELECT p_partkey AS put_code, CASE WHEN p_partkey % 3 <> 0 THEN p_brand || ':' || p_partkey END AS orcid_group, CASE WHEN p_partkey % 3 <> 0 THEN CASE WHEN p_partkey % 2 = 0 THEN 'part-of' ELSE 'self' END END AS relationship FROM part""")
def registry_groups_join(spark, d):
    p = read(spark, d, "part")
    ident = lambda kind, prefix, rel: F.array(F.struct(F.lit(kind).alias("type"), F.concat(F.lit(prefix), F.col("p_partkey").cast("string")).alias("value"), rel.alias("relationship")))
    works = p.select(F.col("p_brand").alias("orcid_id"), F.col("p_partkey").cast("long").alias("put_code"), ident("doi", "10.1/P", F.lit(None).cast("string")).alias("external_ids"), F.lit(None).cast("string").alias("orcid_group"))
    found = p.where("p_partkey % 3 <> 0").select(
        F.col("p_brand").alias("orcid_id"), F.col("p_partkey").cast("long").alias("put_code"), text.group_id(F.col("p_brand"), F.array(F.col("p_partkey").cast("long"), F.col("p_partkey").cast("long") + 5)).alias("orcid_group"),
        ident("DOI", "10.1/p", F.when(F.col("p_partkey") % 2 == 0, "part-of").otherwise("self")).alias("external_ids"),
    )
    return prepare.registry_groups(works, found).select("put_code", "orcid_group", F.col("external_ids")[0]["relationship"].alias("relationship"))


@query("""WITH f AS (SELECT s_suppkey, [x FOR x IN [CASE WHEN s_suppkey % 5 = 0 THEN 'Lab, ' || n_name END, CASE WHEN s_suppkey % 7 = 0 THEN n_name END] IF x IS NOT NULL] AS found, n_name, n_regionkey FROM supplier JOIN nation ON s_nationkey = n_nationkey)
SELECT CAST(s_suppkey AS VARCHAR) AS orcid_id, n_name || CASE WHEN s_suppkey % 5 = 0 THEN ';Lab, ' || n_name ELSE '' END AS names, n_regionkey = 1 OR len(found) > 0 AS focal FROM f""")
def add_affiliations(spark, d):
    known = profiles(spark, d)
    own = F.col("institution_names")[0]
    found = known.select("orcid_id", F.explode(F.array(F.when(F.col("orcid_id").cast("int") % 5 == 0, F.concat(F.lit("Lab, "), own)), F.when(F.col("orcid_id").cast("int") % 7 == 0, own))).alias("institution")).where("institution IS NOT NULL")
    return prepare.add_affiliations(known, found).select("orcid_id", F.array_join("institution_names", ";").alias("names"), F.col("focal_author").alias("focal"))


def _tasks(spark, d) -> DataFrame:
    c = read(spark, d, "customer")
    status = F.when(F.col("c_custkey") % 4 == 3, "done").otherwise("pending")
    return c.select(F.concat(F.lit("10.3/"), F.col("c_custkey").cast("string")).alias("doi"), F.lit("e").alias("source"), status.alias("status"), F.lit(0).alias("attempts"), F.lit("2020-01-01").cast("timestamp").alias("created_at"))


@query("""SELECT '10.3/' || c_custkey AS doi, CASE WHEN c_custkey % 4 = 3 THEN 'done' WHEN row_number() OVER (PARTITION BY c_custkey % 4 = 3 ORDER BY '10.3/' || c_custkey) <= 25 THEN 'processing' ELSE 'pending' END AS status FROM customer""")
def claimed_tasks(spark, d):
    return registry.claim(_tasks(spark, d), ["doi", "source"], ["created_at"])[1].select("doi", "status")


@query("""SELECT '10.3/' || c_custkey AS doi, CASE WHEN c_custkey % 4 = 3 THEN 'done' WHEN c_custkey % 3 = 0 THEN 'done' ELSE 'failed' END AS status, CASE WHEN c_custkey % 4 <> 3 AND c_custkey % 3 <> 0 THEN 1 ELSE 0 END AS attempts FROM customer""")
def settled_tasks(spark, d):
    return registry.settle(_tasks(spark, d), _results(spark, d)).select("doi", "status", "attempts")


def _results(spark, d) -> DataFrame:
    return read(spark, d, "customer").where("c_custkey % 3 = 0").select(F.concat(F.lit("https://DOI.org/10.3/"), F.col("c_custkey").cast("string")).alias("doi"), F.lit("e").alias("source"))


@query("""SELECT '10.3/' || c_custkey AS doi, CASE WHEN c_custkey % 2 = 0 AND c_custkey % 3 = 0 THEN 'both' WHEN c_custkey % 2 = 0 THEN 'task' ELSE 'result' END AS side FROM customer WHERE c_custkey % 2 = 0 OR c_custkey % 3 = 0""")
def paired_results(spark, d):
    asked = _tasks(spark, d).where("CAST(substring(doi, 6) AS INT) % 2 = 0")
    return registry.paired(asked, _results(spark, d)).select("doi", "side")


@query(sql("""SELECT w.orcid_id, w.put_code, CASE WHEN p_size > 10 THEN p_name ELSE w.topic END AS topic, coalesce(p_type || 'a', string_split(title, ' ')[1]) AS keyword FROM works w LEFT JOIN part ON k = p_partkey"""))
def merge_metadata_join(spark, d):
    works = records(spark, d).withColumn("concepts", F.array().cast("array<struct<display_name: string, score: double>>"))
    merged = prepare.merge_metadata(works, _metadata(spark, d))
    return merged.select("orcid_id", "put_code", F.col("topics")[0]["display_name"].alias("topic"), F.col("keywords")[0]["display_name"].alias("keyword"))


@query(sql("""SELECT w.orcid_id, w.put_code, CASE WHEN p_partkey IS NOT NULL THEN p_size > 25 ELSE w.is_oa END AS is_oa, CASE WHEN p_size > 40 THEN 'http://x/' || p_name ELSE w.oa_url END AS oa_url FROM works w LEFT JOIN part ON k = p_partkey"""))
def merge_open_access_join(spark, d):
    return prepare.merge_open_access(records(spark, d), _metadata(spark, d)).select("orcid_id", "put_code", "is_oa", "oa_url")


@query(sql("SELECT orcid_id, put_code, CASE WHEN focal THEN n_name ELSE '' END AS institutions FROM works JOIN people ON orcid_id = id"))
def enrich_institutions_join(spark, d):
    some = profiles(spark, d).where("focal_author")
    return prepare.enrich_institutions(records(spark, d), some).select("orcid_id", "put_code", F.array_join("institutions.name", ",").alias("institutions"))


def _unlinked(spark, d) -> tuple[DataFrame, DataFrame]:
    """Contributors without links, their names as letters; some names belong to two researchers."""
    letters = lambda c, m: F.translate(F.pmod(c, F.lit(m)).cast("string"), "0123456789", "abcdefghij")
    o = read(spark, d, "orders")
    works = o.select(
        F.col("o_custkey").cast("string").alias("orcid_id"), F.col("o_orderkey").alias("put_code"),
        F.array(*(F.struct(F.lit("x").alias("credit_name"), F.concat(F.lit("supplier "), letters(F.col("o_orderkey") + i, 150)).alias("normalized_name"), F.when(F.pmod("o_orderkey", F.lit(7)) == i, F.lit("kept")).alias("orcid_id")) for i in (0, 1))).alias("contributors"),
    )
    s = read(spark, d, "supplier")
    known = s.select(F.col("s_suppkey").cast("string").alias("orcid_id"), F.lit("Supplier").alias("given_names"), letters(F.col("s_suppkey"), 90).alias("family_names"))
    return works, known


@query("""WITH names AS (SELECT s_suppkey % 90 AS n, CAST(min(s_suppkey) AS VARCHAR) AS id, count(*) AS owners, min(CAST(s_suppkey AS VARCHAR)) AS m FROM supplier GROUP BY 1),
c AS (SELECT CAST(o_custkey AS VARCHAR) AS orcid_id, o_orderkey AS put_code, i AS pos, (o_orderkey + i) % 150 AS n, CASE WHEN o_orderkey % 7 = i THEN 'kept' END AS had FROM orders, (SELECT unnest([0, 1]) AS i))
SELECT orcid_id, put_code, string_agg(coalesce(had, CASE WHEN owners = 1 THEN m END, '-'), ',' ORDER BY pos) AS links FROM c LEFT JOIN names USING (n) GROUP BY ALL""")
def link_contributors_join(spark, d):
    works, known = _unlinked(spark, d)
    linked = prepare.link_contributors(works, known)
    return linked.select("orcid_id", "put_code", F.array_join(F.transform("contributors", lambda c: F.coalesce(c["orcid_id"], F.lit("-"))), ",").alias("links"))


@query("""WITH names AS (SELECT s_suppkey % 90 AS n, count(*) AS owners FROM supplier GROUP BY 1),
c AS (SELECT (o_orderkey + i) % 150 AS n, o_orderkey % 7 = i AS had FROM orders, (SELECT unnest([0, 1]) AS i))
SELECT count(*) AS total, count(*) FILTER (had) AS already, count(*) FILTER (NOT had AND owners = 1) AS matched, count(*) FILTER (NOT had AND owners > 1) AS ambiguous FROM c LEFT JOIN names USING (n)""")
def link_statistics(spark, d):
    return prepare.link_statistics(*_unlinked(spark, d))


@query(sql("SELECT orcid_id, put_code, focal_work FROM works"))
def flag_focal_works(spark, d):
    return prepare.flag_works(records(spark, d).drop("focal_work"), profiles(spark, d)).select("orcid_id", "put_code", "focal_work")


@query("SELECT CAST(s_suppkey AS VARCHAR) AS orcid_id, n_name IN ('BRAZIL', 'CANADA') OR n_name LIKE '%2%' AS focal_author FROM supplier JOIN nation ON s_nationkey = n_nationkey")
def flag_focal_authors(spark, d):
    return prepare.flag_authors(profiles(spark, d), r"\b(brazil|canada)\b|2").select("orcid_id", "focal_author")


@query(sql("SELECT (SELECT count(*) FROM people) AS authors, (SELECT count(*) FROM people WHERE focal) AS focal_authors, count(*) AS documents, count(*) FILTER (focal_work) AS focal_documents FROM works"))
def flag_statistics(spark, d):
    return prepare.flag_statistics(records(spark, d), profiles(spark, d))


@query(sql("SELECT orcid_id, put_code, CAST(author_count AS INTEGER) AS author_count FROM works"))
def author_count(spark, d):
    return prepare.author_count(records(spark, d)).select("orcid_id", "put_code", "author_count")


@query(sql("SELECT orcid_id, put_code, 'https://doi.org/10.1/O' || k AS doi FROM works"))
def extract_doi(spark, d):
    return prepare.extract_doi(records(spark, d)).select("orcid_id", "put_code", "doi")


@query(sql("SELECT DISTINCT 'https://doi.org/10.1/O' || k AS doi FROM works"))
def distinct_dois(spark, d):
    return prepare.distinct_dois(records(spark, d))


@query(sql("SELECT id AS orcid_id, count(*) AS unique_works_count FROM linked GROUP BY id"))
def unique_works_count(spark, d):
    return prepare.unique_counts(records(spark, d))


@query(sql("SELECT orcid_id, CAST(NULL AS BIGINT) AS stored, count(*) AS counted FROM works GROUP BY orcid_id"))
def raw_works_count(spark, d):
    return prepare.count_mismatches(profiles(spark, d), records(spark, d))


@query(sql("SELECT count(*) AS documents, count(DISTINCT work_key) AS works, count(work_key) - count(DISTINCT work_key) AS duplicates FROM works"))
def key_statistics(spark, d):
    return prepare.key_statistics(records(spark, d))


@query(sql("SELECT DISTINCT lower('10.1/O' || k) AS doi, 'enrichment' AS source, 'pending' AS status, CAST(0 AS INTEGER) AS attempts FROM works WHERE k % 3 <> 0"))
def enqueue_new_dois(spark, d):
    works = records(spark, d)
    key = F.substring("doi", 7, 20).cast("long")
    queue = works.where(key % 3 == 0).select("doi", F.lit("enrichment").alias("source")).distinct()
    return registry.new_tasks(works, queue, "enrichment").drop("created_at")


# --- text, URLs, identity ---------------------------------------------------------------------------------


@query("""SELECT o_orderkey AS id, CASE o_orderkey % 5 WHEN 0 THEN NULL ELSE '10.5/a' || o_orderkey END AS doi, CASE o_orderkey % 5 WHEN 0 THEN 'x' || o_orderkey WHEN 2 THEN 'https://dx.doi.org/10.5/a' || o_orderkey WHEN 3 THEN 'doi: 10.5/a' || o_orderkey ELSE '10.5/a' || o_orderkey END AS lookup FROM orders""")
def doi_normalization(spark, d):
    o, k = read(spark, d, "orders"), F.col("o_orderkey").cast("string")
    forms = [F.concat(F.lit("X"), k), F.concat(F.lit(" HTTPS://DOI.org/10.5/A"), k), F.concat(F.lit("https://dx.doi.org/10.5/a"), k), F.concat(F.lit("doi: 10.5/a"), k), F.concat(F.lit("10.5/A"), k, F.lit(" "))]
    raw = F.element_at(F.array(*forms), (F.col("o_orderkey") % 5 + 1).cast("int"))
    return o.select(F.col("o_orderkey").alias("id"), text.doi(raw).alias("doi"), text.lookup_doi(raw).alias("lookup"))


@query("""SELECT page_id, regexp_matches(url, '^(?i)https?:') AS is_web, regexp_matches(regexp_extract(lower(url), '^(?:[a-z][a-z0-9+.-]*:)?(?://[^/?#]*)?([^?#]*)', 1), '(\\.pdf$|/pdf|/download)') AS is_pdf FROM pages""".replace("^(?i)", "(?i)^"))
def url_classification(spark, d):
    p = read(spark, d, "pages")
    return p.select("page_id", text.safe_url(F.col("url")).isNotNull().alias("is_web"), text.is_pdf(F.col("url")).alias("is_pdf"))


def _corpus(spark, d) -> DataFrame:
    """Documents as records: source and id, the first line as title."""
    t = F.split("text", "\n")[0]
    return read(spark, d, "documents").select(
        F.concat_ws(":", "source", "doc_id").alias("record_id"), F.col("source").alias("orcid_id"), F.col("doc_id").alias("put_code"), t.alias("title"), (F.lit(2000) + F.col("n_chars") % 7).cast("int").alias("publication_year"),
        F.when(F.col("doc_id") % 11 == 0, F.concat(F.lit("10.7/"), F.pmod(F.xxhash64("text"), F.lit(5000)).cast("string"))).alias("doi"), F.lit(None).cast("array<struct<type: string, value: string, relationship: string>>").alias("external_ids"),
        F.when(F.col("doc_id") % 5 == 0, F.concat_ws(":", "source", "lang", F.floor(F.col("doc_id") / 20).cast("string"))).alias("orcid_group"),
    )


@query(r"""SELECT title, count(*) AS records FROM (
  SELECT coalesce(trim(regexp_replace(replace(lower(strip_accents(regexp_replace(string_split(text, chr(10))[1], '<[^>]+>', '', 'g'))), 'ß', 'ss'), '[^\pL\pN]+', ' ', 'g')), '') AS title FROM documents)
GROUP BY title""")
def title_blocks(spark, d):
    titles = _corpus(spark, d).select(F.coalesce(text.normalized_title("title"), F.lit("")).alias("title"))
    return titles.groupBy("title").agg(F.count("*").alias("records"))


def _named_parts(spark, d) -> DataFrame:
    """Part names, and each again without its fifth letter, as the titles of a brand."""
    p = read(spark, d, "part")
    other = F.concat(F.substring("p_name", 1, 4), F.expr("substring(p_name, 6)"))
    titles = F.transform(F.array(F.col("p_name"), other), lambda t: F.concat(t, F.lit(" and other notes")))
    each = p.select("p_brand", "p_partkey", F.posexplode(titles).alias("n", "title"))
    none = F.lit(None)
    return each.select(
        F.concat_ws(":", "p_partkey", "n").alias("record_id"), F.col("p_brand").alias("orcid_id"), F.col("p_partkey").cast("long").alias("put_code"), none.cast("int").alias("publication_year"), "title",
        none.cast("string").alias("doi"), none.cast("array<struct<type: string, value: string, relationship: string>>").alias("external_ids"), none.cast("string").alias("orcid_group"),
    )


@query("""WITH t AS (SELECT DISTINCT p_brand AS owner, lower(replace(title, ' ', '')) AS c, [x FOR x IN string_split(lower(title), ' ') IF regexp_full_match(x, '[ivxlcdm]+')] AS sig
  FROM (SELECT p_brand, p_name || ' and other notes' AS title FROM part UNION ALL SELECT p_brand, substr(p_name, 1, 4) || substr(p_name, 6) || ' and other notes' FROM part))
SELECT l.owner AS orcid_id, l.c AS a, r.c AS b FROM t l JOIN t r ON l.owner = r.owner AND l.sig = r.sig AND (len(l.c) < len(r.c) OR (len(l.c) = len(r.c) AND l.c < r.c)) AND len(r.c) - len(l.c) <= greatest(2, len(l.c) // 30)
WHERE len(l.c) >= 20 AND levenshtein(l.c, r.c) <= greatest(2, len(l.c) // 30)""")
def typo_pairs(spark, d):
    return identity.typo_pairs(identity.prepared(_named_parts(spark, d))).select("orcid_id", "a", "b").distinct()


@query(None)  # whole documents' titles; held against all pairs in the tests
def typo_pairs_of_documents(spark, d):
    return identity.typo_pairs(identity.prepared(_corpus(spark, d))).select("orcid_id", "a", "b")


@query("SELECT CAST(c_custkey AS VARCHAR) AS orcid_id, min(CAST(c_custkey AS VARCHAR)) OVER (PARTITION BY c_custkey // 37) AS component FROM customer")
def identifier_components(spark, d):
    """Chains of 37 customers: each work has two neighbours."""
    c = read(spark, d, "customer").select(F.col("c_custkey").alias("n"))
    both = c.select(F.explode(F.array(F.col("n"), F.when(F.col("n") % 37 != 0, F.col("n") - 1))).alias("hub"), "n").where("hub IS NOT NULL")
    return graph.components(both.select(F.col("hub").cast("string").alias("work_key"), F.col("n").cast("string").alias("orcid_id")))


@query(None)  # whole relation; held against union-find in the tests
def identifier_components_all(spark, d):
    rel = read(spark, d, "lineitem").select(F.col("l_partkey").cast("string").alias("work_key"), F.col("l_orderkey").cast("string").alias("orcid_id")).distinct()
    return graph.components(rel)


def _order_records(spark, d, title, doi) -> DataFrame:
    o = read(spark, d, "orders")
    none = F.lit(None)
    return o.select(
        F.col("o_orderkey").cast("string").alias("record_id"), F.lit("A").alias("orcid_id"), F.col("o_orderkey").cast("long").alias("put_code"), F.year("o_orderdate").alias("publication_year"), title.alias("title"), doi.alias("doi"),
        none.cast("array<struct<type: string, value: string, relationship: string>>").alias("external_ids"), none.cast("string").alias("orcid_group"),
    )


@query("SELECT CAST(o_orderkey AS VARCHAR) AS record_id, 'doi:10.2/c' || o_custkey AS work_key FROM orders")
def work_keys_by_identifier(spark, d):
    return identity.work_keys(_order_records(spark, d, F.lit(None).cast("string"), F.concat(F.lit("https://doi.org/10.2/C"), F.col("o_custkey").cast("string"))))


@query("""WITH y AS (SELECT DISTINCT o_custkey AS c, CAST(year(o_orderdate) AS INTEGER) AS y FROM orders), i AS (SELECT c, y, y - row_number() OVER (PARTITION BY c ORDER BY y) AS island FROM y),
n AS (SELECT c, y, y - (row_number() OVER (PARTITION BY c, island ORDER BY y) - 1) % 2 AS anchor FROM i)
SELECT CAST(o_orderkey AS VARCHAR) AS record_id, 'title:A:report ' || o_custkey || '|' || anchor AS work_key FROM orders JOIN n ON o_custkey = c AND year(o_orderdate) = y""")
def work_keys_by_years(spark, d):
    """One title a customer, without identifiers: runs of two years."""
    return identity.work_keys(_order_records(spark, d, F.concat(F.lit("Report "), F.col("o_custkey").cast("string")), F.lit(None).cast("string")))


@query(None)
def work_keys(spark, d):
    return identity.work_keys(_corpus(spark, d))


def _signed_orders(spark, d, **columns) -> DataFrame:
    """Orders as records of one owner; ``columns`` replace its owner, title, year, identifier or group."""
    o = _order_records(spark, d, F.lit(""), F.lit(None).cast("string")).withColumnRenamed("record_id", "id").drop("title")
    key = read(spark, d, "orders").select(F.col("o_orderkey").cast("string").alias("id"), F.col("o_orderkey").alias("n"), F.col("o_custkey").alias("c"), F.min("o_orderkey").over(Window.partitionBy("o_custkey")).alias("first"))
    return o.join(key, "id").withColumns(columns).withColumnRenamed("id", "record_id").drop("n", "c", "first")


@query("""SELECT CAST(o_orderkey AS VARCHAR) AS record_id, min('title:A' || o_orderkey || ':growth' || CASE WHEN o_orderkey % 2 = 1 THEN 's' ELSE '' END || ' of film ' || o_custkey || '|' || y) OVER (PARTITION BY o_custkey, side) AS work_key
  FROM (SELECT o_orderkey, o_custkey, CASE WHEN o_custkey % 3 = 0 THEN o_orderkey % 2 ELSE 0 END AS side, 2000 + CASE WHEN o_custkey % 3 = 0 THEN 5 ELSE 1 END * (o_orderkey % 2) AS y FROM orders)""")
def work_keys_by_group(spark, d):
    """Rule 2: a customer's orders are a registry group of many owners; equal titles join, nearly equal ones if their years fit, which those of every third customer do not."""
    n, c = F.col("n"), F.col("c")
    return identity.work_keys(_signed_orders(
        spark, d, orcid_id=F.concat(F.lit("A"), n), title=F.concat(F.lit("Growth"), F.when(n % 2 == 1, "s").otherwise(""), F.lit(" of film "), c), orcid_group=F.concat(F.lit("g"), c),
        publication_year=(F.lit(2000) + F.when(c % 3 == 0, 5).otherwise(1) * (n % 2)).cast("int"),
    ))


@query("""SELECT CAST(o_orderkey AS VARCHAR) AS record_id, CASE WHEN o_orderkey = min(o_orderkey) OVER (PARTITION BY o_custkey) OR o_orderkey % 2 = 0 THEN 'doi:10.2/c' || o_custkey ELSE 'title:A:report ' || o_custkey || '|2010' END AS work_key FROM orders""")
def work_keys_by_doi_year(spark, d):
    """Rule 3: a customer's first order has a DOI; of the others with its title those of the next year join it, later ones are a work of their own."""
    n, c, first = F.col("n"), F.col("c"), F.col("first")
    return identity.work_keys(_signed_orders(
        spark, d, title=F.concat(F.lit("Report "), c), doi=F.when(n == first, F.concat(F.lit("10.2/C"), c)), publication_year=F.when(n == first, 2000).when(n % 2 == 0, 2001).otherwise(2010).cast("int"),
    ))


@query("""WITH o AS (SELECT o_orderkey AS n, o_custkey AS c, CASE WHEN o_orderkey % 2 = 1 THEN NULL WHEN o_custkey % 2 = 1 AND o_orderkey % 4 = 0 THEN 2015 ELSE 2005 END AS y FROM orders),
k AS (SELECT *, 'title:A:note ' || c || '|' || coalesce(CAST(y AS VARCHAR), '') AS own, min(y) OVER (PARTITION BY c) < max(y) OVER (PARTITION BY c) AS many, row_number() OVER (PARTITION BY c, y ORDER BY n) AS turn FROM o)
SELECT CAST(n AS VARCHAR) AS record_id, CASE WHEN coalesce(many, false) THEN own || CASE WHEN y IS NULL AND turn > 1 THEN '#put:A:' || n ELSE '' END ELSE min(own) OVER (PARTITION BY c) END AS work_key FROM k""")
def work_keys_undated(spark, d):
    """Rule 3 and names: undated records of a title join the only run of years; beside two runs they stay apart, and all but the first mark the key they share."""
    n, c = F.col("n"), F.col("c")
    return identity.work_keys(_signed_orders(spark, d, title=F.concat(F.lit("Note "), c), publication_year=F.when(n % 2 == 1, None).when((c % 2 == 1) & (n % 4 == 0), 2015).otherwise(2005).cast("int")))


@query("""SELECT CAST(o_orderkey AS VARCHAR) AS record_id, min('title:observations of the spectr' || CASE WHEN o_orderkey % 2 = 0 THEN 'u' ELSE 'o' END || 'm of sample ' || o_custkey || '|2000') OVER (PARTITION BY o_custkey) AS work_key FROM orders""")
def work_keys_by_typo(spark, d):
    """Rule 4: one letter apart, numbers equal."""
    n, c = F.col("n"), F.col("c")
    title = F.concat(F.lit("Observations of the spectr"), F.when(n % 2 == 0, "u").otherwise("o"), F.lit("m of sample "), c)
    return identity.work_keys(_signed_orders(spark, d, title=title, publication_year=F.lit(2000)))


@query("""SELECT CAST(o_orderkey AS VARCHAR) AS record_id, 'doi:10.2/c' || o_custkey AS work_key FROM orders""")
def work_keys_in_batches(spark, d):
    """The keys of ``work_keys_by_identifier`` from a store that got the orders in three batches."""
    rows = _order_records(spark, d, F.lit(None).cast("string"), F.concat(F.lit("https://doi.org/10.2/C"), F.col("o_custkey").cast("string")))
    store = Identities(spark, f"{shared_dir(spark)}/identities-{uuid.uuid4().hex}")
    for k in range(3):
        store.add(rows.where(F.pmod(F.xxhash64("record_id"), F.lit(3)) == k))
    return store.keys()


@query("""SELECT p_partkey, p_name, CASE WHEN p_partkey % 7 = 0 THEN -1 WHEN p_size % 10 = 0 THEN 2 * p_size ELSE p_size END AS p_size FROM part WHERE p_partkey % 11 <> 0
UNION ALL SELECT -p_partkey, 'new', 0 FROM part WHERE p_partkey % 13 = 0""")
def parts_after_changes(spark, d):
    """A keyed table after a bulk update, an upsert, a deletion and an insert, read through its deltas."""
    p = read(spark, d, "part").select("p_partkey", "p_name", "p_size")
    t = KeyedTable(spark, f"{shared_dir(spark)}/parts-{uuid.uuid4().hex}", p.schema, ["p_partkey"])
    t.insert_new(p)
    t.update(p.select("p_partkey", F.when(F.col("p_size") % 10 == 0, 2 * F.col("p_size")).otherwise(F.col("p_size")).alias("p_size")))
    t.put(p.where("p_partkey % 7 = 0").withColumn("p_size", F.lit(-1)))
    t.delete(p.where("p_partkey % 11 = 0").select("p_partkey"))
    t.insert_new(p.where("p_partkey % 13 = 0").select((-F.col("p_partkey")).alias("p_partkey"), F.lit("new").alias("p_name"), F.lit(0).alias("p_size")).unionByName(p.where("p_partkey % 11 <> 0")))
    return t.read()


@query(sql(PAGE_SQL, FILTERED, where="title ILIKE '%red%' AND title ILIKE '%bolt%'", rows="SELECT * FROM hits", limit=50, skip=0))
def works_search_indexed(spark, d):
    """``works_search_text`` through posting lists of trigrams."""
    works, asked = records(spark, d), "RÉD bolt"
    return _page(search.works_page(textindex.TextIndex.build(works).matching(works, asked), query=asked))


@query(sql(PAGE_SQL, rows="SELECT * FROM collapsed", limit=50, skip=50))
def works_pages_by_cursor(spark, d):
    """The second page of a listing, behind the cursor of the first."""
    listing = search.Listing(spark, f"{shared_dir(spark)}/listing-{uuid.uuid4().hex}")
    listing.put(records(spark, d))
    return _page(listing.page(listing.page()[1])[0])


@query("""SELECT part.p_partkey AS id, p_name || ' ' || p_type || ' ' || split_part(p_name, ' ', 1) AS abstract FROM part""")
def abstract_reconstruction(spark, d):
    p = read(spark, d, "part")
    words = F.split(F.concat_ws(" ", "p_name", "p_type", F.split("p_name", " ")[0]), " ")
    index = F.map_from_entries(F.transform(F.array_distinct(words), lambda w: F.struct(w, F.filter(F.transform(words, lambda x, i: F.when(x == w, i)), lambda i: i.isNotNull()))))
    return p.select(F.col("p_partkey").alias("id"), text.abstract(index).alias("abstract"))


@query(r"""SELECT doc_id, trim(regexp_replace(regexp_replace(regexp_replace(lower(strip_accents(text)), '[,–—-]', ' ', 'g'), '[^a-z\s]', '', 'g'), '\s+', ' ', 'g')) AS name FROM documents""")
def person_names(spark, d):
    return read(spark, d, "documents").select("doc_id", text.normalized_person("text").alias("name"))


@query("SELECT s_suppkey AS id, s_suppkey % 2 = 0 AS valid FROM supplier")
def identifier_syntax(spark, d):
    s, k = read(spark, d, "supplier"), F.lpad(F.col("s_suppkey").cast("string"), 4, "0")
    ident = F.concat_ws("-", F.lit("0000"), k, F.lit("1111"), F.when(F.col("s_suppkey") % 2 == 0, F.lit("123X")).otherwise(F.lit("12X3")))
    return s.select(F.col("s_suppkey").alias("id"), text.valid_id(ident).alias("valid"))
