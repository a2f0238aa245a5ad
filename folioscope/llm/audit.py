"""Filter interaction audit: what each order of five document filters keeps and removes, and what each filter is worth.

A: too few words; B: too few distinct words; C: too many capitals; D: a symbol; E: the text of a smaller doc_id.
A document's failed filters are a mask of five bits.  Everything that the report holds is a sum over masks, so the
documents are read once: each order and step is a row of a fixed 0/1 table over the 32 masks.

Scanning.  A to D come from the Arrow buffers of a batch, without a Python object for each text: byte classes, their prefix sums at
the texts' offsets, and for distinct words the word hashes sorted within each document.  Equal neighbours are
compared byte by byte; a text with a false match is counted anew by its words themselves.  A text above
``CHUNK_BYTES`` is scanned in pieces cut at blanks, and only its distinct words are held together.

Distribution.  Texts are compared by SHA-256.  Rows are first summed by (text, part, labels, doc_id), then by (text, part, labels)
with the count at the smallest doc_id, so a text that a third of all rows share is a few rows where texts meet.

Defined cases: a null text is empty; a null source is the part ''; a row without a doc_id never fails E and is nobody's smaller
copy; repeated rows of one doc_id all count and are not copies of each other; a document with several labels has a
label if any says so, without labels it has none; empty texts fail A and are copies of each other; an empty table gives an empty report; other
columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass
from itertools import permutations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import CHUNK_BYTES, buffer_of, column, written
from .wordops import SPACED, Words, blank_cut, byte_class, mix, same_bytes, words_of

FILTERS = "ABCDE"
COPY = 1 << FILTERS.index("E")
MASKS = np.arange(1 << len(FILTERS))
CAPITALS = byte_class(range(65, 91))
_PLACE = np.uint64(0x9E3779B97F4A7C15)


@dataclass(frozen=True)
class Limits:
    """A fails under ``words``; B under ``distinct`` percent of distinct words; C over ``capitals`` percent of code points; D on any of ``symbols``."""

    words: int = 50
    distinct: int = 65
    capitals: int = 5
    symbols: bytes = b"#$%&*|"


def _distinct(words: Words) -> np.ndarray:
    """Distinct words of each text, the bytes of equal hashes compared."""
    n = len(words.first) - 1
    if not len(words):
        return np.zeros(n, dtype=np.int64)
    keys = mix(words.hashes() + words.doc.astype(np.uint64) * _PLACE)
    order = np.argsort(keys)
    a, b = order[:-1], order[1:]
    met = np.flatnonzero(keys[a] == keys[b])
    new = np.ones(len(order), dtype=bool)
    new[met + 1] = False
    out = np.bincount(words.doc[order[new]], minlength=n)
    a, b, sizes = a[met], b[met], words.ends - words.starts
    good = (words.doc[a] == words.doc[b]) & (sizes[a] == sizes[b])
    good[good] = same_bytes(words.data, words.starts[a[good]], words.starts[b[good]], sizes[a[good]])
    for d in np.unique(np.concatenate([words.doc[a[~good]], words.doc[b[~good]]])).tolist():
        out[d] = len(set(words.text(words.first[d], words.first[d + 1]).split()))
    return out


def measures(data: np.ndarray, offsets: np.ndarray, symbols: bytes = Limits.symbols) -> np.ndarray:
    """A row for each text of the buffer: words, distinct words, capitals, code points, symbols."""

    def total(flags: np.ndarray) -> np.ndarray:
        sums = np.zeros(len(flags) + 1, dtype=np.int64)
        np.cumsum(flags, out=sums[1:])
        return sums[offsets[1:]] - sums[offsets[:-1]]

    words = words_of(data, offsets)
    return np.stack([words.counts(), _distinct(words), total(CAPITALS[data]), total((data & 0xC0) != 0x80), total(byte_class(symbols)[data])], axis=1)


def long_measures(data: np.ndarray, symbols: bytes = Limits.symbols, block: int = CHUNK_BYTES) -> np.ndarray:
    """``measures`` of one long text, in pieces cut at blanks."""
    out, seen = np.zeros(5, dtype=np.int64), set()
    for piece in blank_cut(data, block):
        out += measures(piece, np.array([0, len(piece)]), symbols)[0]
        seen.update(piece.tobytes().split())
    out[1] = len(seen)
    return out


def scan(texts: pa.Array, symbols: bytes = Limits.symbols) -> np.ndarray:
    """``measures`` of a column's texts, about ``CHUNK_BYTES`` at a time."""
    data, offsets = buffer_of(texts)
    out = np.zeros((len(texts), 5), dtype=np.int64)
    i = 0
    while i < len(texts):
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + CHUNK_BYTES, side="right")) - 1)
        part = data[offsets[i] : offsets[j]]
        out[i:j] = measures(part, offsets[i : j + 1] - offsets[i], symbols) if len(part) <= CHUNK_BYTES else long_measures(part, symbols)
        i = j
    return out


def failures(docs: DataFrame, limits: Limits = Limits()) -> DataFrame:
    """(doc_id, part, digest, mask, words, distinct_words, capitals, code_points, symbols): a row for each document; the mask is that of filters A to D."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    names = ["words", "distinct_words", "capitals", "code_points", "symbols"]

    def run(batches):
        for batch in batches:
            m = scan(column(batch, "text"), limits.symbols)
            failed = [m[:, 0] < limits.words, 100 * m[:, 1] < limits.distinct * m[:, 0], 100 * m[:, 2] > limits.capitals * m[:, 3], m[:, 4] > 0]
            mask = sum(f.astype(np.int32) << i for i, f in enumerate(failed)) if len(m) else np.zeros(0, dtype=np.int32)
            yield pa.RecordBatch.from_arrays(
                [column(batch, "doc_id"), column(batch, "part"), column(batch, "digest"), pa.array(mask, pa.int32()), *(pa.array(m[:, i]) for i in range(5))], ["doc_id", "part", "digest", "mask", *names]
            )

    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select("doc_id", F.coalesce(F.col("source").cast("string"), F.lit("")).alias("part"), F.unhex(F.sha2(text, 256)).alias("digest"), "text")
    return rows.mapInArrow(run, f"doc_id {kind}, part string, digest binary, mask int, " + ", ".join(f"{n} long" for n in names))


def mask_counts(docs: DataFrame, labels: DataFrame, limits: Limits = Limits()) -> DataFrame:
    """(part, mask, n, good, toxic): documents of each part by the filters they fail, all five."""
    known = labels.where("doc_id IS NOT NULL").groupBy(F.col("doc_id").alias("__id")).agg(F.max(F.coalesce(F.col("quality") == 1, F.lit(False))).alias("good"), F.max(F.coalesce(F.col("toxic") == 1, F.lit(False))).alias("toxic"))
    failed = failures(docs, limits).select("doc_id", "part", "digest", "mask")
    met = failed.join(known, F.col("doc_id") == F.col("__id"), "left").select("doc_id", "part", "digest", "mask", F.coalesce("good", F.lit(False)).alias("good"), F.coalesce("toxic", F.lit(False)).alias("toxic"))
    kind = ["digest", "part", "mask", "good", "toxic"]
    same = met.groupBy(*kind, "doc_id").agg(F.count("*").alias("n"))
    named = F.col("doc_id").isNotNull()
    texts = written(
        same.groupBy(*kind).agg(
            F.sum("n").alias("n"), F.min(F.when(named, F.struct(F.col("doc_id").alias("id"), "n"))).alias("least"), F.coalesce(F.sum(F.when(~named, F.col("n"))), F.lit(0)).alias("unnamed"),
        )
    )
    # Only texts of several rows can have copies.
    owners = texts.groupBy(F.col("digest").alias("__digest")).agg(F.min("least.id").alias("owner"), F.sum("n").alias("all")).where("all > 1").drop("all")
    judged = texts.join(owners, F.col("digest") == F.col("__digest"), "left")
    own = F.when(F.col("__digest").isNull(), F.col("n")).otherwise(F.col("unnamed") + F.when(F.col("least.id") == F.col("owner"), F.col("least.n")).otherwise(0))
    split = judged.select("part", "good", "toxic", F.explode(F.array(F.struct("mask", own.alias("n")), F.struct((F.col("mask") + F.lit(COPY)).alias("mask"), (F.col("n") - own).alias("n")))).alias("x"))
    x = F.col("x.n")
    return split.where("x.n > 0").groupBy("part", F.col("x.mask").alias("mask")).agg(F.sum(x).alias("n"), F.sum(F.when(F.col("good"), x).otherwise(0)).alias("good"), F.sum(F.when(F.col("toxic"), x).otherwise(0)).alias("toxic"))


def tables() -> tuple[list[tuple[str, int]], dict[str, np.ndarray]]:
    """The (order, step) rows of a report, and for each of its columns the 0/1 table over masks; ``shapley`` holds sums over all orders."""
    orders = ["".join(p) for p in permutations(FILTERS)]
    rows = [(o, i + 1) for o in orders for i in range(len(FILTERS))]
    its = np.array([1 << FILTERS.index(o[i - 1]) for o, i in rows])[:, None]
    before = np.array([sum(1 << FILTERS.index(f) for f in o[: i - 1]) for o, i in rows])[:, None]
    fails, gone = (MASKS & its) > 0, (MASKS & before) > 0
    removed = fails & ~gone
    worth = {int(f): removed[its[:, 0] == f].sum(axis=0) for f in np.unique(its)}
    return rows, {
        "kept": (~fails & ~gone).astype(np.int64), "removed": removed.astype(np.int64), "redundant": (fails & gone).astype(np.int64), "unique_fails": np.equal(MASKS, its).astype(np.int64),
        "good_lost": removed.astype(np.int64), "toxic_lost": removed.astype(np.int64), "shapley": np.stack([worth[int(f)] for f in its[:, 0]]),
    }


def interactions(docs: DataFrame, labels: DataFrame, limits: Limits = Limits()) -> DataFrame:
    """(part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley): 600 rows for each part."""
    rows, table = tables()
    counted = {"good_lost": "good", "toxic_lost": "toxic"}

    def run(batches):
        for batch in batches:
            for part, masks in zip(column(batch, "part").to_pylist(), column(batch, "masks").to_pylist(), strict=True):
                by = {c: np.zeros(len(MASKS), dtype=np.int64) for c in ("n", "good", "toxic")}
                for m in masks:
                    for c in by:
                        by[c][m["mask"]] = m[c]
                sums = [pa.array(t @ by[counted.get(c, "n")]) for c, t in table.items()]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([part] * len(rows), pa.string()), pa.array([o for o, _ in rows], pa.string()), pa.array([i for _, i in rows], pa.int32()), *sums], ["part", "filter_order", "step", *table]
                )

    # At most 32 masks of a part.
    parts = mask_counts(docs, labels, limits).groupBy("part").agg(F.collect_list(F.struct("mask", "n", "good", "toxic")).alias("masks"))
    return parts.mapInArrow(run, "part string, filter_order string, step int, " + ", ".join(f"{c} long" for c in table))


_FIVE = "(VALUES (1, 'A'), (2, 'B'), (4, 'C'), (8, 'D'), (16, 'E'))"
ORACLE = f"""
WITH w AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
f AS (
  SELECT doc_id, part, (len(w) < 50)::INT + 2 * (100 * len(list_distinct(w)) < 65 * len(w))::INT
    + 4 * (100 * (length(t) - length(regexp_replace(t, '[A-Z]', '', 'g'))) > 5 * length(t))::INT + 8 * regexp_matches(t, '[#$%&*|]')::INT
    + 16 * coalesce(doc_id > min(doc_id) OVER (PARTITION BY t), false)::INT AS mask
  FROM w),
l AS (SELECT doc_id, max((quality = 1)::INT) AS good, max((toxic = 1)::INT) AS toxic FROM labels WHERE doc_id IS NOT NULL GROUP BY doc_id),
m AS (SELECT part, mask, count(*) AS n, coalesce(sum(good), 0) AS good, coalesce(sum(toxic), 0) AS toxic FROM f LEFT JOIN l USING (doc_id) GROUP BY part, mask),
five AS (SELECT * FROM {_FIVE} AS v(bit, name)),
orders AS (
  SELECT a.name || b.name || c.name || d.name || e.name AS filter_order, [a.bit, b.bit, c.bit, d.bit, e.bit] AS bits
  FROM five a, five b, five c, five d, five e WHERE a.bit + b.bit + c.bit + d.bit + e.bit = 31 AND len(list_distinct([a.bit, b.bit, c.bit, d.bit, e.bit])) = 5),
steps AS (SELECT filter_order, step::INT AS step, bits[step] AS own, coalesce(list_sum(bits[1:step - 1]), 0)::INT AS earlier FROM orders, range(1, 6) AS r(step)),
report AS (
  SELECT part, filter_order, step, own,
    coalesce(sum(n) FILTER ((mask & own) = 0 AND (mask & earlier) = 0), 0)::BIGINT AS kept, coalesce(sum(n) FILTER ((mask & own) > 0 AND (mask & earlier) = 0), 0)::BIGINT AS removed,
    coalesce(sum(n) FILTER ((mask & own) > 0 AND (mask & earlier) > 0), 0)::BIGINT AS redundant, coalesce(sum(n) FILTER (mask = own), 0)::BIGINT AS unique_fails,
    coalesce(sum(good) FILTER ((mask & own) > 0 AND (mask & earlier) = 0), 0)::BIGINT AS good_lost, coalesce(sum(toxic) FILTER ((mask & own) > 0 AND (mask & earlier) = 0), 0)::BIGINT AS toxic_lost
  FROM m, steps GROUP BY part, filter_order, step, own)
SELECT part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, (sum(removed) OVER (PARTITION BY part, own))::BIGINT AS shapley FROM report
"""
