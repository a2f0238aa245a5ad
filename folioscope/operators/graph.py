"""Co-authorship networks: nodes, weighted edges, statistics, connected components and their reports."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text
from ..functions.params import year_range
from ..runtime import written
from . import components as stars
from . import authors, predicates
from .works import authorship, collapse

#: Rings of a component that are searched from its seed, and keys that are broadcast, at most.
MOST_STEPS, BROADCAST_KEYS = 24, 500_000
MAX_WORKS, MAX_PAIRS, MAX_MEMBERS, TOP_VALUES, PAIR_TOPICS = 200, 300, 300, 10, 3


def network_records(records: DataFrame, start=2020, end=2026, **filters) -> DataFrame:
    start, end = year_range(start, end)
    return records.where(predicates.works(start_year=start, end_year=end, **filters))


def nodes(people: DataFrame) -> DataFrame:
    """Researchers with their number of works, of a (work_key, orcid_id) relation."""
    return people.groupBy("orcid_id").agg(F.count("*").alias("publications"))


def work_pairs(people: DataFrame) -> DataFrame:
    """(work_key, source, target), source < target, for the researchers of each work.

    The pairs of a work grow with the square of its author list: they are the edges asked for, and partial sums
    reduce them in the same stage.  A join on the key lets Spark split works with very long lists.
    """
    a, b = people.select("work_key", F.col("orcid_id").alias("source")), people.select("work_key", F.col("orcid_id").alias("target"))
    return a.join(b, "work_key").where("source < target")


def edges(people: DataFrame, tasks: int | None = None) -> DataFrame:
    """(source, target, weight).  With ``tasks`` the pairs are dealt over so many tasks: a pair seldom meets itself before, so little is summed earlier."""
    pairs = work_pairs(people)
    return (pairs.repartition(tasks, "source", "target") if tasks else pairs).groupBy("source", "target").agg(F.count("*").alias("weight"))


def solo(node_table: DataFrame, edge_table: DataFrame) -> DataFrame:
    ends = edge_table.select(F.explode(F.array("source", "target")).alias("orcid_id")).distinct()
    return node_table.join(ends, "orcid_id", "left_anti")


def network_stats(node_table: DataFrame, edge_table: DataFrame) -> DataFrame:
    """One row: nodes, edges, sum of weights, nodes without an edge."""
    n = node_table.agg(F.count("*").alias("total_authors"))
    e = edge_table.agg(F.count("*").alias("total_edges"), F.coalesce(F.sum("weight"), F.lit(0)).alias("total_collaborations"))
    s = solo(node_table, edge_table).agg(F.count("*").alias("solo_authors"))
    return n.crossJoin(F.broadcast(e)).crossJoin(F.broadcast(s))  # one row each


def components(people: DataFrame) -> DataFrame:
    """(orcid_id, component): the smallest identifier that works of two and more researchers connect to.

    Each work links its researchers to its smallest one, so no pairs are made; links are then contracted to stars.
    """
    base = written(people.select("work_key", "orcid_id").distinct())
    first = base.groupBy("work_key").agg(F.min("orcid_id").alias("first"))
    labels = stars.components(base.join(first, "work_key").select(F.col("orcid_id").alias("a"), F.col("first").alias("b")))
    known = labels.select(F.col("node").alias("orcid_id"), F.col("root").alias("component"))
    alone = base.select("orcid_id").distinct().join(known, "orcid_id", "left_anti")
    return known.unionAll(alone.select("orcid_id", F.col("orcid_id").alias("component")))


def listed_works(own: DataFrame, years: DataFrame, seed: str, most: int = MAX_WORKS) -> DataFrame:
    """(work_key, members, year): all works of the seed and the ``most`` newest others of its component."""
    scope = shared(own)
    scope = own if scope.isEmpty() else scope
    keys = scope.groupBy("work_key").agg(F.array_sort(F.collect_set("orcid_id")).alias("members")).join(years, "work_key", "left")
    return focus_first(keys, F.array_contains("members", seed), [F.desc_nulls_last("year"), F.asc("work_key")], most)


def _near(people: DataFrame, some: DataFrame, key: str) -> DataFrame:
    """The relation's rows on the given keys; up to BROADCAST_KEYS of them are looked up in place."""
    return people.join(F.broadcast(some) if some.count() <= BROADCAST_KEYS else some, key, "left_semi")


def members(people: DataFrame, seed: str, most_steps: int = MOST_STEPS) -> DataFrame:
    """(orcid_id) of the seed's component; empty if the seed has no work.

    Breadth-first from the seed: the works of the last ring, then their other researchers, until a ring is empty.  What is written and shuffled is
    the component's, whatever the size of the graph, which is only scanned.  A component with more than ``most_steps`` rings, a long chain, is
    found by labelling the graph instead, as rounds of that grow with the logarithm of a path only.
    """
    base = written(people.select("work_key", "orcid_id"))
    known = ring = written(base.where(F.col("orcid_id") == seed).select("orcid_id").distinct())
    if known.isEmpty():
        return known
    for _ in range(most_steps):
        works = written(_near(base, ring, "orcid_id").select("work_key").distinct())
        ring = written(_near(base, works, "work_key").select("orcid_id").distinct().join(known, "orcid_id", "left_anti"))
        if ring.isEmpty():
            return known
        known = written(known.unionAll(ring))
    labels = components(base)
    own = labels.where(F.col("orcid_id") == seed).select("component")
    return labels.join(F.broadcast(own), "component", "left_semi").select("orcid_id")


def first_years(records: DataFrame) -> DataFrame:
    """(work_key, year): the first record's year that is neither missing nor 0."""
    some = records.where("work_key IS NOT NULL AND publication_year IS NOT NULL AND publication_year <> 0")
    return some.groupBy("work_key").agg(F.min_by("publication_year", F.struct("orcid_id", "put_code")).alias("year"))


def shared(people: DataFrame) -> DataFrame:
    """The relation on works of two and more researchers."""
    many = people.groupBy("work_key").agg(F.count("*").alias("n")).where("n > 1").select("work_key")
    return people.join(many, "work_key", "left_semi")


def pair_report(people: DataFrame, years: DataFrame) -> DataFrame:
    """(source, target, weight, first_year, last_year), strongest first."""
    each = work_pairs(people).join(years, "work_key", "left")
    return each.groupBy("source", "target").agg(F.count("*").alias("weight"), F.min("year").alias("first_year"), F.max("year").alias("last_year")).orderBy(F.desc("weight"), "source", "target")


def member_activity(people: DataFrame) -> DataFrame:
    """(orcid_id, works, shared_works, collaborators)."""
    some = shared(people)
    works = people.groupBy("orcid_id").agg(F.count("*").alias("works"))
    common = some.groupBy("orcid_id").agg(F.count("*").alias("shared_works"))
    pairs = edges(some)
    both = pairs.select(F.col("source").alias("orcid_id")).unionAll(pairs.select(F.col("target").alias("orcid_id"))).groupBy("orcid_id").agg(F.count("*").alias("collaborators"))
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    return works.join(common, "orcid_id", "left").join(both, "orcid_id", "left").select("orcid_id", "works", zero("shared_works"), zero("collaborators"))


def focus_first(rows: DataFrame, is_focus, order: list, most: int) -> DataFrame:
    """All rows of the focus and the first ``most`` others in the given order."""
    return rows.where(is_focus).unionAll(rows.where(~is_focus).orderBy(*order).limit(most))


def of_works(records: DataFrame, keys: DataFrame, tasks: int | None = None) -> DataFrame:
    """The records of the works of ``keys``.

    Up to BROADCAST_KEYS keys are looked up in place, before the plan of the records shuffles other works' rows.  Of more, records meet their
    keys by work, over ``tasks`` tasks if given; keys are distinct, so a join keeps each record once (a semi join would slip below the deal).
    """
    some = written(keys.select("work_key").where("work_key IS NOT NULL").distinct())
    if some.count() <= BROADCAST_KEYS:
        return records.join(F.broadcast(some), "work_key", "left_semi")
    return (records.repartition(tasks, "work_key") if tasks else records).join(some, "work_key")


def group_values(records: DataFrame, keys: DataFrame, field: str, limit: int = TOP_VALUES, tasks: int | None = None) -> DataFrame:
    """Topics or types of the works, each work once; filters and flags do not matter here."""
    return authors.breakdown(collapse(of_works(records, keys, tasks)), field, limit)


def pair_topics(people: DataFrame, works: DataFrame, top: int = PAIR_TOPICS) -> DataFrame:
    """(source, target, topics): the most frequent topics of the listed works of each pair."""
    each = work_pairs(people).join(works.select("work_key", F.explode("topics").alias("topic")), "work_key").groupBy("source", "target", "topic").agg(F.count("*").alias("n"))
    rank = F.row_number().over(Window.partitionBy("source", "target").orderBy(F.desc("n"), "topic"))
    best = each.withColumn("r", rank).where(F.col("r") <= top)
    return best.groupBy("source", "target").agg(F.transform(F.array_sort(F.collect_list(F.struct("r", "topic"))), lambda x: x["topic"]).alias("topics"))


def constellation(records: DataFrame, profiles: DataFrame, seed: str, start=2020, end=2026, **filters) -> dict | None:
    """The report on the seed's component as a dictionary; None without a matching work.  Lists are capped, so it is small."""
    some = network_records(records, start, end, **filters)
    people = written(authorship(some))
    group = written(members(people, seed))
    if group.isEmpty():
        return None
    own = written(people.join(group, "orcid_id", "left_semi").select("work_key", "orcid_id"))
    common = written(shared(own))
    scope = own if common.isEmpty() else common
    years = written(first_years(some).join(scope.select("work_key").distinct(), "work_key", "left_semi"))
    keys = scope.groupBy("work_key").agg(F.array_sort(F.collect_set("orcid_id")).alias("members")).join(years, "work_key", "left")
    listed = written(focus_first(keys, F.array_contains("members", seed), [F.desc_nulls_last("year"), F.asc("work_key")], MAX_WORKS))
    details = collapse(records.join(listed.select("work_key"), "work_key", "left_semi"))
    works = written(details.join(listed.select("work_key", "members"), "work_key"))
    pairs = written(pair_report(common, years))
    is_focus = (F.col("source") == seed) | (F.col("target") == seed)
    strong = written(focus_first(pairs, is_focus, [F.desc("weight"), F.asc("source"), F.asc("target")], MAX_PAIRS))
    activity = written(member_activity(own))
    order = [F.col("orcid_id") != seed, F.desc("shared_works"), F.desc("works"), F.asc("orcid_id")]
    shown = strong.select(F.explode(F.array("source", "target")).alias("orcid_id")).unionAll(works.select(F.explode("members"))).unionAll(activity.orderBy(*order).limit(MAX_MEMBERS).select("orcid_id")).distinct()
    named = authors.named(activity.join(shown, "orcid_id", "left_semi"), profiles, records).orderBy(*order)
    topics = pair_topics(common.join(works.select("work_key"), "work_key", "left_semi"), works)
    link = F.when(F.col("is_oa"), text.safe_url(F.col("oa_url")))
    stats = pairs.agg(F.count("*").alias("links"), F.coalesce(F.sum("weight"), F.lit(0)).alias("collaborations")).first().asDict()
    span = years.agg(F.min("year").alias("first_year"), F.max("year").alias("last_year")).first().asDict()
    rows = lambda df: [r.asDict(recursive=True) for r in df.collect()]
    return {
        "focus": seed,
        "stats": {"members": group.count(), "shared_works": common.select("work_key").distinct().count()} | stats | span,
        "members": rows(named), "pairs": rows(strong.join(topics, ["source", "target"], "left").orderBy(F.desc("weight"), "source", "target")), "pairs_total": stats["links"],
        "works": rows(works.withColumn("oa_url", link).orderBy(F.coalesce("publication_year", F.lit(0)).desc(), F.lower("title"), "work_key").drop("credits", "contributor_ids")),
        "works_total": scope.select("work_key").distinct().count(),
        "per_year": rows(years.groupBy("year").agg(F.count("*").alias("count")).orderBy("year")),
        "topics": rows(group_values(records, scope, "topics")), "types": rows(group_values(records, scope, "type")),
    }
