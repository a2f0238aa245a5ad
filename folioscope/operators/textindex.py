"""Free-text search by trigrams: posting lists of texts, intersected, then verified.

A search term is found anywhere inside a text, so words cannot be looked up; but each text that has it has all its trigrams.  Many records
share a title, a name or a DOI, so the index has two levels: ``postings`` hold a row for each trigram of a distinct text, ``holders`` a row for each text of a
record.  Both are in segments: each task sorts its own rows by what is looked up and writes a file, and a reader skips what its row groups cannot hold.  Neither
trigrams nor holders are shuffled, only distinct texts.  Of each term the rarest trigrams are read; records that hold, for each term, a text with all of them are
candidates, and the search predicate itself decides about them.  Texts are known by a hash, so two of one hash only make more candidates.

Defined cases: terms of fewer than three characters restrict nothing, and without any longer one the records are scanned; null texts have no trigrams;
records are known by owner and code, and all rows of a candidate are verified, so repeated ones stay; records that
are not in the index are not found: build it anew, or add a part, when records come.
"""

from __future__ import annotations

import uuid
from functools import reduce
from operator import and_, or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.params import plain, plain_column, terms
from ..runtime import RAW_FILES, shared_dir, tasks, written
from . import predicates

SIZE, RAREST = 3, 4
KEYS = ["orcid_id", "put_code"]
#: Candidates that are broadcast at most.
BROADCAST_ROWS = 200_000
#: Texts that are given to the scan of the holders as a filter at most.
LISTED_TEXTS = 1_000


def grams(value: Column) -> Column:
    """The distinct trigrams of a text."""
    n = F.length(value) - (SIZE - 1)
    return F.when(n > 0, F.array_distinct(F.transform(F.sequence(F.lit(1), n), lambda i: F.substring(value, i, F.lit(SIZE))))).otherwise(F.array().cast("array<string>"))


def grams_of(term: str) -> list[str]:
    return sorted({term[i : i + SIZE] for i in range(len(term) - SIZE + 1)})


def texts(records: DataFrame) -> DataFrame:
    """(text, t, orcid_id, put_code): all that a search looks at, each text of a record once, and its hash."""
    none = F.array().cast("array<string>")
    names = F.coalesce(F.transform("contributors", lambda c: c["normalized_name"]), none)
    every = F.concat(F.array(plain_column(F.col("title")), plain_column(F.col("doi"))), names)
    # An outer explode: else Spark tests every record's texts twice.
    return records.select(*KEYS, F.explode_outer(F.array_distinct(F.filter(every, lambda t: F.length(t) >= SIZE))).alias("t")).where("t IS NOT NULL").select(F.xxhash64("t").alias("text"), "t", *KEYS)


def postings(held: DataFrame, n: int) -> DataFrame:
    """(gram, text): the trigrams of each distinct text, once each, over ``n`` tasks."""
    # Each text has a trigram; an outer explode, else Spark moves the test for one below, to every holder.
    distinct = held.select("text", "t").distinct().repartition(n, "text")
    return distinct.select(F.explode_outer(grams(F.col("t"))).alias("gram"), "text")


def name_form(term: str) -> str:
    return " ".join(plain(term).replace("-", " ").split()) if plain(term).strip("-") else plain(term)


class TextIndex:
    """Posting lists, their lengths and the texts' holders in a folder; ``build`` writes them, a reader opens them."""

    def __init__(self, spark, path: str):
        self.postings, self.counts, self.holders = (spark.read.parquet(f"{path}/{name}") for name in ("postings", "counts", "holders"))
        self.read = 0

    @classmethod
    def build(cls, records: DataFrame, path: str | None = None) -> TextIndex:
        spark = records.sparkSession
        path = path or f"{shared_dir(spark)}/textindex-{uuid.uuid4().hex}"
        segment = lambda rows, name, size, *by: rows.sortWithinPartitions(*by).write.mode("overwrite").option("parquet.block.size", size).options(**RAW_FILES).parquet(f"{path}/{name}")
        segment(texts(records), "holders", 4 << 20, "text", *KEYS)
        held = spark.read.parquet(f"{path}/holders")
        segment(postings(held, tasks(spark, held.count())), "postings", 1 << 20, "gram", "text")
        counts = spark.read.parquet(f"{path}/postings").groupBy("gram").agg(F.count("*").alias("n"))
        counts.repartitionByRange("gram").sortWithinPartitions("gram").write.mode("overwrite").parquet(f"{path}/counts")
        return cls(spark, path)

    def candidates(self, query: str | None) -> DataFrame | None:
        """(orcid_id, put_code) of records that have the trigrams of all terms; None if no term is long enough.  ``read`` tells the postings looked at."""
        forms = [sorted({plain(t), name_form(t)}) for t in terms(query)]
        wanted = [[grams_of(f) for f in own] for own in forms if all(len(f) >= SIZE for f in own)]
        if not wanted:
            return None
        every = sorted({g for own in wanted for some in own for g in some})
        lengths = {r.gram: r.n for r in self.counts.where(F.col("gram").isin(every)).collect()}  # a row for each trigram of the query
        # Terms have few characters in all, so the rarest trigrams of each are few too.
        picked = [[sorted(some, key=lambda g: (lengths.get(g, 0), g))[:RAREST] for some in own] for own in wanted]
        used = sorted({g for own in picked for some in own for g in some})
        self.read = sum(lengths.get(g, 0) for g in used)
        have = self.postings.where(F.col("gram").isin(used)).groupBy("text").agg(F.collect_set("gram").alias("grams"))
        holds = lambda some: reduce(and_, [F.array_contains("grams", g) for g in some])
        met = F.array_compact(F.array(*(F.when(reduce(or_, [holds(some) for some in own]), F.lit(k)) for k, own in enumerate(picked))))
        found = written(have.select(F.col("text").alias("__text"), met.alias("met")).where("size(met) > 0"), few=True)
        n = found.count()
        holders = self.holders
        if n <= LISTED_TEXTS:
            holders = holders.where(F.col("text").isin([r[0] for r in found.select("__text").collect()]))  # row groups without them are not read
        asked = holders.join(F.broadcast(found) if n <= BROADCAST_ROWS else found, F.col("text") == F.col("__text")).select(*KEYS, F.explode("met").alias("term"))
        return asked.groupBy(*KEYS).agg(F.collect_set("term").alias("terms")).where(F.size("terms") == len(picked)).select(*KEYS)

    def matching(self, records: DataFrame, query: str | None) -> DataFrame:
        """The records that may meet the query, for the predicate to decide."""
        found = self.candidates(query)
        if found is None:
            return records
        found = written(found.select(*(F.col(k).alias(f"__{k}") for k in KEYS)))
        if found.count() <= BROADCAST_ROWS:
            found = F.broadcast(found)
        return records.join(found, reduce(and_, [F.col(k).eqNullSafe(F.col(f"__{k}")) for k in KEYS]), "left_semi")

    def search(self, records: DataFrame, query: str | None, **filters) -> DataFrame:
        """The rows of ``records`` that meet the query and the filters: those that a scan would give."""
        return self.matching(records, query).where(predicates.works(query=query, **filters))
