"""Registry and enrichment JSON to tables, search partitions and the enrichment queue.

Payloads come as a text column; where they come from (a fetcher over HTTP, files) is up to the caller: see
``fetched`` for a bounded-rate fetch on executors.
"""

from __future__ import annotations

import string
import time
from collections import deque
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import reduce
from operator import and_
from urllib.parse import quote

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import text
from ..runtime import written

_ID = "struct<`external-id-type`: string, `external-id-value`: string, `external-id-relationship`: string>"
_IDS = f"struct<`external-id`: array<{_ID}>>"
WORK_JSON = (
    "struct<title: struct<title: struct<value: string>>, `journal-title`: struct<value: string>, `publication-date`: struct<year: struct<value: string>>, type: string, visibility: string, "
    f"`external-ids`: {_IDS}, contributors: struct<contributor: array<struct<`credit-name`: struct<value: string>, `contributor-orcid`: struct<path: string>, "
    "`contributor-attributes`: struct<`contributor-role`: string, `contributor-sequence`: string>>>>>"
)
GROUPS = f"struct<group: array<struct<`work-summary`: array<struct<`put-code`: long, `external-ids`: {_IDS}>>>>>"
SUMMARY_JSON = f"struct<group: array<struct<`work-summary`: array<struct<`put-code`: long, `external-ids`: {_IDS}>>>>, `activities-summary`: struct<works: {GROUPS}>>"
TOPIC = "struct<display_name: string, field: struct<display_name: string>>"
ENRICHMENT_JSON = (
    "struct<id: string, doi: string, best_oa_location: struct<pdf_url: string>, open_access: struct<is_oa: boolean, oa_url: string>, "
    f"topics: array<{TOPIC}>, keywords: array<struct<display_name: string>>, concepts: array<struct<display_name: string, score: double>>, abstract_inverted_index: map<string, array<int>>>"
)
#: Sections of a record that hold affiliations.
SECTIONS = ("employments", "educations", "qualifications", "invited-positions", "distinctions", "memberships", "services")
_SUMMARY = "map<string, struct<organization: struct<name: string>, `department-name`: string>>"
ACTIVITIES_JSON = "struct<" + ", ".join(f"`{s}`: struct<`affiliation-group`: array<struct<summaries: array<{_SUMMARY}>>>>" for s in SECTIONS) + ">"
#: Rows of one registry answer, results of a search from which it is split, identifiers of one enrichment request.
PAGE, SPLIT, BATCH = 1000, 10_000, 25


def _ids(column):
    return F.transform(column, lambda x: F.struct(x["external-id-type"].alias("type"), x["external-id-value"].alias("value"), x["external-id-relationship"].alias("relationship")))


def summaries(payloads: DataFrame) -> DataFrame:
    """(orcid_id, json) of records or of their works -> (orcid_id, put_code, orcid_group, external_ids)."""
    parsed = payloads.select("orcid_id", F.from_json("json", SUMMARY_JSON).alias("r"))
    groups = parsed.select("orcid_id", F.explode(F.coalesce("r.group", "r.activities-summary.works.group")).alias("g")).select("orcid_id", F.col("g.work-summary").alias("s"))
    coded = groups.withColumn("s", F.filter("s", lambda x: x["put-code"].isNotNull()))
    named = coded.withColumn("orcid_group", text.group_id(F.col("orcid_id"), F.transform("s", lambda x: x["put-code"])))
    return named.select("orcid_id", "orcid_group", F.explode("s").alias("w")).select("orcid_id", F.col("w.put-code").alias("put_code"), "orcid_group", _ids(F.col("w.external-ids.external-id")).alias("external_ids"))


def parsed_works(payloads: DataFrame) -> DataFrame:
    """(orcid_id, put_code, orcid_group, json) -> works rows with provisional keys; contributors without a credit name are left out."""
    w = payloads.select("orcid_id", "put_code", "orcid_group", F.from_json("json", WORK_JSON).alias("w"))
    named = F.filter("w.contributors.contributor", lambda c: F.coalesce(c["credit-name"]["value"], F.lit("")) != "")
    flat = w.select(
        "orcid_id", "put_code", "orcid_group", F.col("w.title.title.value").alias("title"), F.col("w.journal-title.value").alias("journal_title"),
        F.expr("try_cast(w.`publication-date`.year.value AS int)").alias("publication_year"), F.col("w.type").alias("type"), F.col("w.visibility").alias("visibility"),
        F.coalesce(_ids(F.col("w.external-ids.external-id")), F.array().cast("array<struct<type: string, value: string, relationship: string>>")).alias("external_ids"), named.alias("__c"),
    )
    # Names are normalised once for each distinct spelling, then looked up.
    names = flat.select(F.explode("__c").alias("c")).select(F.col("c.credit-name.value").alias("__raw")).distinct().withColumn("__form", text.normalized_person("__raw"))
    each = flat.select("orcid_id", "put_code", F.posexplode("__c").alias("pos", "c")).join(names, F.col("c.credit-name.value") == F.col("__raw"))
    person = F.struct(
        F.col("__raw").alias("credit_name"), F.col("__form").alias("normalized_name"), F.when(F.col("__form") != "", F.split("__form", " ")).otherwise(F.array().cast("array<string>")).alias("tokens"),
        F.col("c.contributor-orcid.path").alias("orcid_id"), F.col("c.contributor-attributes.contributor-role").alias("role"), F.col("c.contributor-attributes.contributor-sequence").alias("sequence"),
    )
    lists = each.groupBy(F.col("orcid_id").alias("__o"), F.col("put_code").alias("__p")).agg(F.array_sort(F.collect_list(F.struct("pos", person.alias("person")))).alias("__l"))
    joined = flat.join(lists, (F.col("orcid_id") == F.col("__o")) & (F.col("put_code") == F.col("__p")), "left")
    empty = F.array().cast("array<struct<credit_name: string, normalized_name: string, tokens: array<string>, orcid_id: string, role: string, sequence: string>>")
    return joined.withColumn("contributors", F.coalesce(F.transform("__l", lambda x: x["person"]), empty)).withColumn("work_key", provisional_key()).drop("__c", "__o", "__p", "__l")


def provisional_key(linked_doi=None):
    """Key of a record on its own: its smallest DOI, else a linked one, else its title, else its code."""
    own = F.get(text.dois_of(text.self_ids(F.col("external_ids"), F.lit(None).cast("string"))), F.lit(0))
    best = own if linked_doi is None else F.coalesce(own, linked_doi)
    form = F.coalesce(text.normalized_title("title"), F.lit(""))
    return F.coalesce(F.concat(F.lit("doi:"), best), text.title_key(F.col("orcid_id"), form, F.col("publication_year")), text.put_key(F.col("orcid_id"), F.col("put_code")))


def metadata(payloads: DataFrame, source: str) -> DataFrame:
    """(json) of enrichment results -> metadata rows; lists default to empty."""
    r = payloads.select(F.from_json("json", ENRICHMENT_JSON).alias("r"))
    rows = r.select(
        F.lit(source).alias("source"), text.lookup_doi(F.col("r.doi")).alias("doi"), F.col("r.id").alias("openalex_id"), F.col("r.best_oa_location.pdf_url").alias("pdf_url"), F.col("r.open_access").alias("open_access"),
        *(F.coalesce(f"r.{c}", F.array().cast(t)).alias(c) for c, t in (("topics", f"array<{TOPIC}>"), ("keywords", "array<struct<display_name: string>>"), ("concepts", "array<struct<display_name: string, score: double>>"))),
        text.abstract(F.col("r.abstract_inverted_index")).alias("abstract"),
    )
    return rows.withColumn("harvested_at", F.current_timestamp())


def affiliations(payloads: DataFrame, pattern: str) -> DataFrame:
    """(orcid_id, json) of activities -> (orcid_id, institution): distinct "organisation, department" names that match the pattern."""
    a = payloads.select("orcid_id", F.from_json("json", ACTIVITIES_JSON).alias("a"))
    each = a.select("orcid_id", F.explode(F.flatten(F.array(*(F.coalesce(F.flatten(F.col(f"a.{s}.affiliation-group.summaries")), F.array().cast(f"array<{_SUMMARY}>")) for s in SECTIONS)))).alias("m"))
    item = each.select("orcid_id", F.get(F.map_values("m"), F.lit(0)).alias("i"))
    org, dept = F.trim(F.coalesce("i.organization.name", F.lit(""))), F.trim(F.coalesce("i.department-name", F.lit("")))
    full = item.select("orcid_id", F.when(dept != "", F.concat(org, F.lit(", "), dept)).otherwise(org).alias("institution"))
    return full.where(text.normalized_institution("institution").rlike(pattern)).distinct()


@dataclass(frozen=True)
class Partition:
    """A search by a family-name prefix."""

    base: str
    prefix: str
    depth: int = 1

    def query(self) -> str:
        return f"{self.base} AND family-name:{self.prefix}*"

    def split(self) -> list[Partition]:
        return [Partition(self.base, self.prefix + c, self.depth + 1) for c in string.ascii_lowercase]


def plan_partitions(base: str, count: Callable[[Partition], int], most: int = SPLIT) -> list[Partition]:
    """Breadth-first: searches with results, none above ``most``."""
    queue, out = deque(Partition(base, c) for c in string.ascii_lowercase), []
    while queue:
        p = queue.popleft()
        n = count(p)
        if n > most:
            queue.extend(p.split())
        elif n:
            out.append(p)
    return out


def pages(count: int, size: int = PAGE) -> Iterator[tuple[int, int]]:
    """(start, rows) of the requests that cover ``count`` results."""
    return ((at, min(size, count - at)) for at in range(0, count, size))


def fetched(requests: DataFrame, fetch: Callable[[dict], str], pause: float = 0.1) -> DataFrame:
    """Add ``json`` to request rows by calling ``fetch`` on executors, ``pause`` seconds apart in each task; null where it fails."""
    schema = T.StructType([*requests.schema.fields, T.StructField("json", T.StringType())])

    def run(parts):
        for part in parts:
            got = []
            for row in part.to_dict("records"):
                try:
                    got.append(fetch(row))
                except Exception:  # noqa: BLE001  one answer that fails must not end the harvest
                    got.append(None)
                time.sleep(pause)
            yield part.assign(json=pd.Series(got, index=part.index, dtype=object))

    return requests.mapInPandas(run, schema)


def new_tasks(works: DataFrame, queue: DataFrame, source: str) -> DataFrame:
    """Enrichment tasks not queued yet: the first identifier of type ``doi`` of each record, whatever its relationship."""
    first = F.get(F.filter("external_ids", lambda x: x["type"] == "doi"), F.lit(0))["value"]
    dois = works.select(text.lookup_doi(first).alias("doi")).where("doi IS NOT NULL").distinct()
    known = queue.where(F.col("source") == source).select("doi")
    return dois.join(known, "doi", "left_anti").select("doi", F.lit(source).alias("source"), F.lit("pending").alias("status"), F.lit(0).alias("attempts"), F.current_timestamp().alias("created_at"))


def batches(queue: DataFrame, size: int = BATCH) -> DataFrame:
    """Pending tasks with a batch number, about ``size`` each, dealt by hash so no global order is needed."""
    pending = queue.where("status = 'pending'")
    n = max(1, -(-pending.count() // size))
    return pending.withColumn("batch", F.pmod(F.xxhash64("doi", "source"), F.lit(n)))


def settle(queue: DataFrame, results: DataFrame) -> DataFrame:
    """The queue after results: pending tasks with a result are done, others failed with one more attempt; results without a DOI count for nothing."""
    got = results.where("doi IS NOT NULL").select(text.lookup_doi(F.col("doi")).alias("__d"), F.col("source").alias("__s")).distinct()
    met = queue.join(got, (F.lower("doi") == F.col("__d")) & (F.col("source") == F.col("__s")), "left")
    open_, ok = F.col("status") == "pending", F.col("__d").isNotNull()
    return met.withColumns({
        "attempts": F.when(open_ & ~ok, F.col("attempts") + 1).otherwise(F.col("attempts")),
        "status": F.when(open_ & ok, "done").when(open_, "failed").otherwise(F.col("status")),
    }).select(queue.columns)


def claim(queue: DataFrame, keys: list[str], order: list[str], size: int = BATCH) -> tuple[DataFrame, DataFrame]:
    """(claimed rows, queue in which they are ``processing``): the first ``size`` pending rows.

    Only pending rows are claimed, so rows whose worker was lost stay ``processing`` until ``release`` gives them back.
    """
    own = written(queue.where("status = 'pending'").orderBy(*order, *keys).limit(size))  # at most ``size`` rows
    return own, mark(queue, own, keys, "processing")


def mark(queue: DataFrame, rows: DataFrame, keys: list[str], status: str, attempt: bool = False) -> DataFrame:
    """The queue with a new status for the given rows; ``attempt`` counts one more."""
    chosen = rows.select(*(F.col(k).alias(f"__{k}") for k in keys)).distinct()
    same = reduce(and_, [F.col(k).eqNullSafe(F.col(f"__{k}")) for k in keys])
    joined = queue.join(chosen.withColumn("__hit", F.lit(True)), same, "left")
    new = {"status": F.when(F.col("__hit"), F.lit(status)).otherwise(F.col("status"))}
    if attempt:
        new["attempts"] = F.when(F.col("__hit"), F.col("attempts") + 1).otherwise(F.col("attempts"))
    return joined.withColumns(new).select(queue.columns)


def release(queue: DataFrame) -> DataFrame:
    """Rows left ``processing`` are pending again."""
    return queue.withColumn("status", F.when(F.col("status") == "processing", "pending").otherwise(F.col("status")))


def paired(tasks: DataFrame, results: DataFrame) -> DataFrame:
    """(doi, source, side): tasks and results by normalised DOI; side: both, task (no result) or result (nobody asked)."""
    asked = tasks.select(text.lookup_doi(F.col("doi")).alias("a"), F.col("source").alias("s")).distinct()
    got = results.where("doi IS NOT NULL").select(text.lookup_doi(F.col("doi")).alias("b"), F.col("source").alias("t")).distinct()
    side = F.when(F.col("b").isNull(), "task").when(F.col("a").isNull(), "result").otherwise("both")
    return asked.join(got, (F.col("a") == F.col("b")) & (F.col("s") == F.col("t")), "full_outer").select(F.coalesce("a", "b").alias("doi"), F.coalesce("s", "t").alias("source"), side.alias("side"))


def batch_url(base: str, dois: list[str]) -> str:
    """One request for several DOIs: percent-encoded, joined by bars."""
    return f"{base}?filter=doi:{'|'.join(quote(d, safe='') for d in dois)}&per-page={len(dois)}"


def _dealt(requests: DataFrame, rate: float | None) -> tuple[DataFrame, float]:
    """(requests over the cluster's tasks, pause of each task between its calls), so that all tasks together keep to ``rate`` calls a second."""
    tasks = requests.sparkSession.sparkContext.defaultParallelism
    return requests.repartition(tasks), tasks / rate if rate else 0.0


class Discovery:
    """Breadth-first search of a registry by name prefixes: the frontier is the catalog's ``partitions`` table, a depth is one job.

    ``count(query)`` gives the number of results and ``fetch(query, start, rows)`` the text of one page; both run on executors.  ``save(pages)``
    takes the (base_query, prefix, page, json) rows of a depth and stores them; it must be safe to repeat, as insert-if-absent is.

    A depth takes one claim, one job for its answers, one save and one write of states and children, whatever its width.  What a
    depth answered is stored before its states change, so a crash at any point leaves prefixes ``processing``, and ``resume`` asks those again.
    A prefix whose answer fails stays ``processing`` too, and the others go on.
    """

    KEYS = ["base_query", "prefix"]

    def __init__(self, catalog, count: Callable[[str], int], fetch: Callable[[str, int, int], str], save: Callable[[DataFrame], object], most: int = SPLIT, rate: float | None = None):
        self.catalog, self.count, self.fetch, self.save, self.most, self.rate = catalog, count, fetch, save, most, rate

    def seed(self, base: str) -> None:
        rows = [(base, c, 1, "pending") for c in string.ascii_lowercase]
        self.catalog.insert_new("partitions", self.catalog.spark.createDataFrame(rows, self.catalog.read("partitions").schema))

    def resume(self) -> int:
        """Prefixes left ``processing`` are pending again; returns their number."""
        left = self.catalog.read("partitions").where("status = 'processing'")
        return self.catalog.update("partitions", left.select(*self.KEYS, F.lit("pending").alias("status")))

    def _answers(self, own: DataFrame) -> DataFrame:
        """(base_query, prefix, depth, results, page, json, error): a row for each prefix, and one for each of its pages."""
        count, fetch, most = self.count, self.fetch, self.most
        dealt, pause = _dealt(own.select("base_query", "prefix", "depth"), self.rate)
        columns = ["base_query", "prefix", "depth", "results", "page", "json", "error"]

        def run(parts):
            for part in parts:
                for row in part.itertuples(index=False):
                    p = Partition(row.base_query, row.prefix, int(row.depth))
                    key, found = (p.base, p.prefix, p.depth), []
                    try:
                        n = int(count(p.query()))
                        time.sleep(pause)
                        for i, (start, size) in enumerate(pages(n) if n <= most else ()):
                            found.append((*key, n, i, fetch(p.query(), start, size), None))
                            time.sleep(pause)
                        found.append((*key, n, None, None, None))
                    except Exception as error:  # noqa: BLE001  one prefix that fails must not end the depth
                        found = [(*key, None, None, None, f"{type(error).__name__}: {error}"[:500])]
                    yield pd.DataFrame(found, columns=columns).astype({"results": "Int64", "page": "Int32"})

        return dealt.mapInPandas(run, "base_query string, prefix string, depth int, results long, page int, json string, error string")

    def step(self) -> int | None:
        """One depth: the number of prefixes saved, or None if nothing is pending."""
        pending = self.catalog.read("partitions").where("status = 'pending'")
        depth = pending.agg(F.min("depth")).first()[0]
        if depth is None:
            return None
        own = written(pending.where(F.col("depth") == depth))
        self.catalog.update("partitions", own.select(*self.KEYS, F.lit("processing").alias("status")))
        answers = written(self._answers(own))
        self.save(answers.where("page IS NOT NULL").select("base_query", "prefix", "page", "json"))
        ends = answers.where("page IS NULL AND error IS NULL")
        done = ends.select("base_query", "prefix", "depth", F.lit("done").alias("status"))
        letters = F.explode(F.array(*map(F.lit, string.ascii_lowercase)))
        split = ends.where(F.col("results") > self.most).select("base_query", "prefix", "depth", letters.alias("c"))
        children = split.select("base_query", F.concat("prefix", "c").alias("prefix"), (F.col("depth") + 1).alias("depth"), F.lit("pending").alias("status"))
        # A child that is there already, from a run before a crash, keeps its state.
        known = self.catalog.read("partitions").where(F.col("depth") == depth + 1)
        self.catalog.upsert("partitions", done.unionAll(children.join(known, self.KEYS, "left_anti")))
        return ends.where((F.col("results") > 0) & (F.col("results") <= self.most)).count()

    def run(self) -> int:
        """Depth by depth until nothing is pending; returns how many prefixes were saved."""
        saved = 0
        while (n := self.step()) is not None:
            saved += n
        return saved


def _fetched_batches(own: DataFrame, fetch: Callable[[list[str]], list[str]], size: int, rate: float | None) -> DataFrame:
    """(doi, json, error): a row for each result, and one for each DOI of a request that failed; requests of at most ``size`` DOIs, oldest first."""
    pause = own.sparkSession.sparkContext.defaultParallelism / rate if rate else 0.0

    def answered(dois: list[str]) -> pd.DataFrame:
        try:
            rows = [(None, text, None) for text in fetch(dois)]
        except Exception as error:  # noqa: BLE001  a request that fails alone fails its own DOIs
            rows = [(d, None, f"{type(error).__name__}: {error}"[:500]) for d in dois]
        time.sleep(pause)
        return pd.DataFrame(rows, columns=["doi", "json", "error"], dtype=object)

    def run(parts):
        rest: list[str] = []
        for part in parts:
            rest += part["doi"].tolist()
            while len(rest) >= size:
                yield answered(rest[:size])
                rest = rest[size:]
        if rest:
            yield answered(rest)

    return own.orderBy("created_at", "doi").select("doi").mapInPandas(run, "doi string, json string, error string")


def enrich(catalog, source: str, fetch: Callable[[list[str]], list[str]], size: int = BATCH, most: int | None = None, rate: float | None = None) -> dict:
    """Fetch metadata for all pending tasks of a source: results make their tasks done, absent ones failed; a request that fails fails its own tasks.

    ``fetch`` takes DOIs and returns the texts of results; it runs on executors.  A round leases all pending tasks (``most`` of them, the
    oldest, if given) by one write, asks in requests of ``size`` over the cluster, and stores metadata and outcomes by one write each: the number of writes
    does not depend on that of tasks.  Metadata is stored before outcomes, so a crash leaves tasks ``processing``, which ``reopen`` gives back.
    """
    keys, done, failed = ["doi", "source"], 0, 0
    while True:
        pending = catalog.read("metadata_queue").where((F.col("source") == source) & (F.col("status") == "pending"))
        own = written(pending if most is None else pending.orderBy("created_at", "doi").limit(most))
        n = own.count()
        if not n:
            return {"done": done, "failed": failed}
        catalog.update("metadata_queue", own.select(*keys, F.lit("processing").alias("status")))
        answers = written(_fetched_batches(own, fetch, size, rate))
        rows = written(metadata(answers.where("json IS NOT NULL").select("json"), source).where("doi IS NOT NULL"))
        catalog.upsert("works_metadata", rows)
        met = rows.select(F.col("doi").alias("__d")).distinct()
        # Whatever an answer held, the DOIs of a failed request are failed.
        lost = answers.where("error IS NOT NULL").select(F.col("doi").alias("__l")).distinct()
        judged = own.join(met, text.lookup_doi(F.col("doi")) == F.col("__d"), "left").join(lost, F.col("doi") == F.col("__l"), "left")
        good = F.col("__d").isNotNull() & F.col("__l").isNull()
        outcome = written(judged.select(*keys, F.when(good, "done").otherwise("failed").alias("status"), (F.col("attempts") + F.when(good, 0).otherwise(1)).alias("attempts")))
        catalog.update("metadata_queue", outcome)
        ok = outcome.where("status = 'done'").count()
        done, failed = done + ok, failed + n - ok


def reopen(catalog, source: str, failed: bool = False, most_attempts: int = 3) -> int:
    """Tasks left ``processing``, and with ``failed`` those of fewer than ``most_attempts`` failures, are pending again; returns their number."""
    back = (F.col("status") == "processing") | (F.lit(failed) & (F.col("status") == "failed") & (F.col("attempts") < most_attempts))
    some = catalog.read("metadata_queue").where((F.col("source") == source) & back)
    return catalog.update("metadata_queue", some.select("doi", "source", F.lit("pending").alias("status")))


def enrich_new(catalog, works: DataFrame, source: str, fetch: Callable[[list[str]], list[str]]) -> dict:
    """Queue the DOIs of new works, then enrich; without a new one nothing is processed, even if older tasks are pending."""
    added = catalog.insert_new("metadata_queue", new_tasks(works, catalog.read("metadata_queue"), source))
    return {"queued": added} | (enrich(catalog, source, fetch) if added else {"done": 0, "failed": 0})
