"""Line dedup by site-relative frequency: lines on too large a share of a host's pages are dropped.

Pages are grouped by host (``source`` for documents).  A line's share is the number of the host's pages that
contain it, divided by the number of the host's pages and ``prior`` pages more, which stand for what a host has not
shown: in a host of few pages a line's plain share is large by chance (in a host of one page it is 1), so
shares of small hosts shrink.  Lines above ``ratio`` are dropped from all pages of that host.

Distribution: only (host, 16-byte line digest) pairs are shuffled, pre-aggregated.  The digests to drop go to the pages by
host, broadcast, if all of them together are at most ``BROADCAST_LINES``; else (row key, digest) pairs of the pages
are joined with them by (host, digest) and a salt, and each page gets its own digests by its row key, so no host is a hot key.  A
list is cut into 256 cells by the digest's first byte, so a line meets a 256th of it.

Defined cases: a null text stays null; a null host is a host of its own; lines without a word are kept
and not counted; a line repeated on a page counts once; a text that loses all lines is the empty text; repeated
rows count as pages; an empty table gives an empty result; other columns are passed on.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import unused, written

#: Line digests that are broadcast at most (16 bytes each).
BROADCAST_LINES = 1_000_000
SALTS = 16
#: A line goes from 5 pages on in small hosts, from 7 in a host of 93,000 pages, from 105 in one of 5 million.  Lines of four and more
#: words on 5 pages of one host are hardly chance (README).
RATIO, PRIOR = 0.00002, 225_000


WORD = r"[^\x20\x09-\x0D]"


def _digest(line: Column) -> Column:
    return F.unhex(F.md5(line.cast("binary")))


def _cell(digest: Column) -> Column:
    return F.substring(digest, 1, 1)


def _listed(lists: Column, digest: Column) -> Column:
    return F.coalesce(F.array_contains(F.try_element_at(lists, _cell(digest)), digest), F.lit(False))


def boilerplate(pages: DataFrame, *, host: str = "source", text: str = "text", ratio: float = RATIO, prior: float = PRIOR) -> DataFrame:
    """(host, line digest, n pages, n host pages) of the lines to drop."""
    lines = pages.select(F.col(host).alias("host"), F.explode(F.array_distinct(F.split(text, "\n", -1))).alias("line")).where(F.col("line").rlike(WORD))
    seen = lines.select("host", _digest(F.col("line")).alias("digest")).groupBy("host", "digest").agg(F.count("*").alias("n")).where(F.col("n") > ratio * prior)
    totals = pages.groupBy(F.col(host).alias("its")).agg(F.count("*").alias("total"))
    return seen.join(totals, F.col("host").eqNullSafe(F.col("its"))).where(F.col("n") > F.lit(ratio) * (F.col("total") + F.lit(prior))).drop("its")


def _cells(digests: DataFrame, key: str, named: str, drop: str) -> DataFrame:
    """(``named``, ``drop``): the digests of a key as a map from their first byte."""
    cells = digests.groupBy(key, _cell(F.col("digest")).alias("cell")).agg(F.collect_set("digest").alias("part"))
    return cells.groupBy(F.col(key).alias(named)).agg(F.map_from_entries(F.collect_list(F.struct("cell", "part"))).alias(drop))


def _by_row(pages: DataFrame, bad: DataFrame, host: str, text: str, drop: str) -> DataFrame:
    """``pages`` with the column ``drop``, by way of their own lines: rows of one host and text have one key."""
    row, salt, key, turn = unused(pages, "__row", "__salt", "__key", "__turn")
    keyed = pages.withColumn(row, F.xxhash64(host, F.col(host).isNull(), text))
    lines = keyed.select(F.col(row).alias("row"), F.col(host).alias("host"), F.explode(F.array_distinct(F.split(text, "\n", -1))).alias("line")).where(F.col("line").rlike(WORD))
    own = lines.select("row", "host", _digest(F.col("line")).alias("digest"), F.pmod("row", F.lit(SALTS)).cast("int").alias("salt")).distinct()
    salts = F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))
    salted = bad.select(F.col("host").alias("__host"), F.col("digest").alias("__digest"), salts.alias("__salt"))
    hits = own.join(salted, (F.col("digest") == F.col("__digest")) & (F.col("salt") == F.col("__salt")) & F.col("host").eqNullSafe(F.col("__host")))
    lists = _cells(hits.select("row", "digest"), "row", key, drop).withColumn(turn, salts)
    # Copies of one page share a key; any salt is right, as every salt has the list.
    dealt = keyed.withColumn(salt, F.pmod(F.monotonically_increasing_id(), F.lit(SALTS)).cast("int"))
    return dealt.join(lists, (F.col(row) == F.col(key)) & (F.col(salt) == F.col(turn)), "left").drop(row, salt, turn, key)


def dedup_lines(pages: DataFrame, *, host: str = "source", text: str = "text", ratio: float = RATIO, prior: float = PRIOR, report: str | None = "lines_dropped") -> DataFrame:
    """All columns of ``pages``, the text without boilerplate lines, and their number in the column ``report``."""
    bad = written(boilerplate(pages, host=host, text=text, ratio=ratio, prior=prior).select("host", "digest"), few=True)
    drop, left, key = unused(pages, "__drop", "__left", "__key")
    if bad.count() <= BROADCAST_LINES:
        joined = pages.join(F.broadcast(_cells(bad, "host", key, drop)), F.col(host).eqNullSafe(F.col(key)), "left").drop(key)
    else:
        joined = _by_row(pages, bad, host, text, drop)
    split = F.split(text, "\n", -1)
    some = F.col(drop).isNotNull() & F.col(text).isNotNull()
    out = joined.withColumn(left, F.when(some, F.filter(split, lambda line: ~(_listed(F.col(drop), _digest(line)) & line.rlike(WORD)))))
    if report:
        out = out.withColumn(report, F.when(some, F.size(split) - F.size(left)).otherwise(0))
    return out.withColumn(text, F.when(some, F.array_join(left, "\n")).otherwise(F.col(text))).drop(drop, left)


ORACLE = f"""
WITH lines AS (
  SELECT doc_id, source, unnest(string_split(text, chr(10))) AS line FROM documents),
seen AS (
  SELECT source, line, count(DISTINCT doc_id) AS n FROM lines
  WHERE regexp_matches(line, '[^\\x20\\x09-\\x0D]') GROUP BY source, line),
totals AS (SELECT source, count(*) AS total FROM documents GROUP BY source),
bad AS (
  SELECT seen.source, seen.line FROM seen JOIN totals ON seen.source IS NOT DISTINCT FROM totals.source
  WHERE n > {RATIO} * (total + {PRIOR})),
numbered AS (
  SELECT d.doc_id, d.source, g.i, string_split(d.text, chr(10))[g.i] AS line
  FROM documents d, LATERAL (SELECT unnest(range(1, len(string_split(d.text, chr(10))) + 1)) AS i) g),
kept AS (
  SELECT n.doc_id, string_agg(n.line, chr(10) ORDER BY n.i) FILTER (WHERE b.line IS NULL) AS text,
         count(*) FILTER (WHERE b.line IS NOT NULL) AS lines_dropped
  FROM numbered n LEFT JOIN bad b ON n.source IS NOT DISTINCT FROM b.source AND n.line = b.line GROUP BY n.doc_id)
SELECT d.doc_id, coalesce(k.text, CASE WHEN d.text IS NULL THEN NULL ELSE '' END) AS text,
       CAST(coalesce(k.lines_dropped, 0) AS INTEGER) AS lines_dropped
FROM documents d LEFT JOIN kept k USING (doc_id)
"""
