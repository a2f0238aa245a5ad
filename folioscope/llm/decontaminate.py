"""Benchmark decontamination by winnowing: window-minimum k-gram hashes, met with the test set's, then extended.

For spans of ``span`` words, the k-grams (k words) of every span have a minimum hash; documents and test
items select the same one, so each shared span of ``span`` words is found whatever surrounds it.  Items shorter than a
span are single windows, met by their whole-window hashes for each of their lengths.

Distribution.  The test set's fingerprints are put into a Bloom filter of bounded size (``FILTER_BITS``), which all
tasks hold.  A pass over the documents extends each fingerprint in the filter to the spans that selected it and gives
their words as candidates; these are joined with the test set's windows, by the words themselves, so hash collisions
and the filter's errors never count.  A larger test set makes larger joins, never another pass, and nothing of it
is collected but the filter.  Candidates are dealt by their words and a salt, as many documents may share a passage.

Defined cases: a null or wordless text has no words and is clean; items without words have no window; items without an
item_id hit as others do, count together as one item, and have no name in ``items``; equal items all count; repeated rows give repeated results; an empty test set leaves all clean; an
empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import chunks, column, unused, utf8, written
from .wordops import ALNUM, grams, mix, tokenize, window_min

SPAN, K = 13, 8
#: Bits of the filter at most (32 MB); beyond 8 million fingerprints it lets more candidates through, and the join drops them.
FILTER_BITS = 1 << 28
#: Distinct windows of the test set that are broadcast at most; more are joined by shuffle.
BROADCAST_WINDOWS = 100_000
SALTS = 16
#: Keys of contaminated documents that are broadcast at most (16 bytes each); more are met by shuffle.
BROADCAST_ROWS = 1_000_000


class Filter:
    """A Bloom filter of 64-bit values with three positions for each."""

    def __init__(self, words: np.ndarray):
        self.words = words
        self.mask = np.uint64(64 * len(words) - 1)

    @staticmethod
    def places(values: np.ndarray, bits: int) -> list[np.ndarray]:
        out, v = [], values
        for _ in range(3):
            v = mix(v + np.uint64(0x9E3779B97F4A7C15))
            out.append(v & np.uint64(bits - 1))
        return out

    def find(self, values: np.ndarray) -> np.ndarray:
        """Positions of values that may be members."""
        at = np.arange(len(values))
        v = values
        for _ in range(3):
            v = mix(v + np.uint64(0x9E3779B97F4A7C15))
            p = v & self.mask
            hit = (self.words[(p >> np.uint64(6)).astype(np.int64)] >> (p & np.uint64(63))) & np.uint64(1) == 1
            at, v = at[hit], v[hit]
        return at


def selected(h: np.ndarray, size: int, span: int, k: int) -> np.ndarray:
    """The fingerprint of each window of ``size`` words: its minimum k-gram, or the whole window if shorter than a span."""
    if size < span:
        return mix(grams(h, size) + np.uint64(size))
    k = min(k, span)
    return window_min(grams(h, k), span - k + 1)


def test_windows(benchmark: DataFrame, *, span: int = SPAN, k: int = K) -> DataFrame:
    """(win, item, size, fp): distinct windows of each item, their words and fingerprints."""

    def run(batches):
        for batch in batches:
            names = column(batch, "item").to_pylist()
            for name, text in zip(names, utf8(column(batch, "text")), strict=True):
                words = tokenize([text], ALNUM)
                n = len(words)
                if not n:
                    continue
                size = min(n, span)
                fps = selected(words.hashes(), size, span, k).view(np.int64).tolist()
                mine = {words.text(s, s + size): fp for s, fp in enumerate(fps)}
                yield pa.RecordBatch.from_arrays(
                    [pa.array([w.decode("utf-8", "replace") for w in mine], pa.string()), pa.array([name] * len(mine), pa.string()), pa.array([size] * len(mine), pa.int32()), pa.array(list(mine.values()), pa.int64())],
                    ["win", "item", "size", "fp"],
                )

    return benchmark.select(F.col("item_id").cast("string").alias("item"), "text").mapInArrow(run, "win string, item string, size int, fp long")


def bloom(windows: DataFrame) -> Filter:
    """The filter of all fingerprints: its 64-bit words are made by the cluster, and come to the driver within FILTER_BITS."""
    n = windows.agg(F.approx_count_distinct("fp")).first()[0]
    bits = 1 << min(max(16, (32 * max(n, 1)).bit_length()), FILTER_BITS.bit_length() - 1)

    def run(batches):
        for batch in batches:
            values = np.unique(column(batch, "fp").to_numpy()).view(np.uint64)
            place = np.concatenate(Filter.places(values, bits)) if len(values) else values
            yield pa.RecordBatch.from_arrays([pa.array((place >> np.uint64(6)).astype(np.int64)), pa.array((np.uint64(1) << (place & np.uint64(63))).view(np.int64))], ["word", "bit"])

    got = windows.select("fp").mapInArrow(run, "word long, bit long").groupBy("word").agg(F.bit_or("bit").alias("bits")).toArrow()
    words = np.zeros(bits // 64, dtype=np.uint64)
    words[got["word"].to_numpy()] = got["bits"].to_numpy().view(np.uint64)
    return Filter(words)


def merge(spans: list[list[int]]) -> list[list[int]]:
    out: list[list[int]] = []
    for s, e in sorted(spans):
        if out and s <= out[-1][1]:
            out[-1][1] = max(out[-1][1], e)
        else:
            out.append([s, e])
    return out


def contaminated(n_hit: int, n_words: int) -> bool:
    return n_hit > 0 and 20 * n_hit >= n_words


def _rid() -> Column:
    """Row key: documents of one id and text have one verdict."""
    return F.xxhash64("doc_id", F.col("doc_id").isNull(), "text")


def candidates(docs: DataFrame, known: Filter, sizes: list[int], *, span: int = SPAN, k: int = K) -> DataFrame:
    """(rid, doc_id, n_words, pos, win): a row for each document, with null pos and win, and one for each window in the filter."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    shared = docs.sparkSession.sparkContext.broadcast(known)

    def run(batches):
        for batch in batches:
            ids, rids = column(batch, "doc_id"), column(batch, "rid")
            for start, texts in chunks(utf8(column(batch, "text"))):
                words = tokenize(texts, ALNUM)
                h, doc, n = words.hashes(), words.doc, len(texts)
                owner, pos, win = [], [], []
                for size in sizes:
                    at = shared.value.find(selected(h, size, span, k))
                    at = at[doc[at] == doc[at + size - 1]]  # windows of one text only
                    owner.append(doc[at])
                    pos.append(at - words.first[doc[at]])
                    win += [words.text(s, s + size).decode("utf-8", "replace") for s in at.tolist()]
                owner = np.concatenate([np.arange(n), *owner])
                row = pa.array(start + owner)
                yield pa.RecordBatch.from_arrays(
                    [
                        rids.take(row), ids.take(row), pa.concat_arrays([pa.array(words.counts(), pa.int64()), pa.nulls(len(win), pa.int64())]),
                        pa.concat_arrays([pa.nulls(n, pa.int64()), pa.array(np.concatenate([np.zeros(0, np.int64), *pos]), pa.int64())]), pa.concat_arrays([pa.nulls(n, pa.string()), pa.array(win, pa.string())]),
                    ],
                    ["rid", "doc_id", "n_words", "pos", "win"],
                )

    return docs.select(_rid().alias("rid"), "doc_id", "text").mapInArrow(run, f"rid long, doc_id {kind}, n_words long, pos long, win string")


def _met(found: DataFrame, windows: DataFrame) -> DataFrame:
    """Candidates whose words are a test window; ``windows`` are broadcast only if its own rows are few."""
    if windows.count() <= BROADCAST_WINDOWS:
        return found.join(F.broadcast(windows), "win")
    salted = windows.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return found.withColumn("salt", F.pmod(F.col("rid"), F.lit(SALTS)).cast("int")).join(salted, ["win", "salt"]).drop("salt")


def _scan(docs: DataFrame, benchmark: DataFrame, span: int, k: int) -> DataFrame:
    """``scan`` with the row key ``rid``."""
    windows = written(test_windows(benchmark, span=span, k=k))
    sizes = sorted(r.size for r in windows.select(F.col("size").alias("size")).distinct().collect())  # at most ``span``
    found = written(candidates(docs, bloom(windows), sizes, span=span, k=k))
    distinct = written(windows.groupBy("win").agg(F.first("size").alias("size")), few=True)
    met = written(_met(found.where("win IS NOT NULL").select("rid", "pos", "win"), distinct), few=True)
    spans = met.groupBy("rid").agg(F.collect_set(F.struct("pos", "size")).alias("places"))
    # One window may be that of very many items.
    owners = _met(met.select("rid", "win").distinct(), written(windows.select("win", "item").distinct(), few=True))
    items = owners.select("rid", F.struct("item").alias("item")).groupBy("rid").agg(F.collect_set("item").alias("items"))
    hits = spans.join(items, "rid")
    kind = docs.schema["doc_id"].dataType.simpleString()

    def finish(batches):
        for batch in batches:
            spans = [merge([[p["pos"], p["pos"] + p["size"]] for p in x]) if x else [] for x in column(batch, "places").to_pylist()]
            found = [[i["item"] for i in x] if x else [] for x in column(batch, "items").to_pylist()]
            items = [sorted(i for i in x if i is not None) for x in found]
            n = column(batch, "n_words").to_pylist()
            total = [sum(e - s for s, e in x) for x in spans]
            yield pa.RecordBatch.from_arrays(
                [
                    column(batch, "rid"), column(batch, "doc_id"), pa.array(n, pa.int64()), pa.array(total, pa.int64()), pa.array([len(x) for x in found], pa.int64()),
                    pa.array([hashlib.sha256(",".join(x).encode()).hexdigest() for x in items], pa.string()), pa.array([contaminated(a, b) for a, b in zip(total, n, strict=True)], pa.bool_()),
                    pa.array(spans, pa.list_(pa.list_(pa.int64()))), pa.array(items, pa.list_(pa.string())),
                ],
                ["rid", "doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated", "spans", "items"],
            )

    base = found.where("win IS NULL").select("rid", "doc_id", "n_words")
    return base.join(hits, "rid", "left").mapInArrow(
        finish, f"rid long, doc_id {kind}, n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean, spans array<array<bigint>>, items array<string>"
    )


def scan(docs: DataFrame, benchmark: DataFrame, *, span: int = SPAN, k: int = K) -> DataFrame:
    """Per document: doc_id, n_words, n_hit, n_items, items_sha256, contaminated, spans (word intervals), items."""
    return _scan(docs, benchmark, span, k).drop("rid")


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, *, span: int = SPAN, k: int = K) -> DataFrame:
    """The clean documents, all columns as they are; rows are told apart by id and text, so neither null nor repeated ids matter."""
    rid, bad_rid, ident = unused(docs, "__rid", "__bad", "__id")
    bad = written(_scan(docs, benchmark, span, k).where("contaminated").select(F.col("rid").alias(bad_rid), F.col("doc_id").alias(ident)).distinct(), few=True)
    if bad.count() <= BROADCAST_ROWS:
        bad = F.broadcast(bad)
    return docs.withColumn(rid, _rid()).join(bad, (F.col(rid) == F.col(bad_rid)) & F.col("doc_id").eqNullSafe(F.col(ident)), "left_anti").select(docs.columns)


_WORDS = "regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"
ORACLE = f"""
WITH d AS (SELECT doc_id, coalesce({_WORDS}, []) AS w FROM documents),
b AS (SELECT item_id, w, least({SPAN}, len(w)) AS n FROM (SELECT item_id, {_WORDS} AS w FROM benchmark) WHERE len(w) > 0),
bw AS (SELECT DISTINCT item_id, n, array_to_string(w[i:i + n - 1], ' ') AS win FROM b, LATERAL (SELECT unnest(range(1, len(b.w) - b.n + 2)) AS i)),
dw AS (
  SELECT doc_id, n, i, array_to_string(w[i:i + n - 1], ' ') AS win
  FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, (SELECT DISTINCT n FROM b) WHERE len(w) >= n)),
hits AS (SELECT dw.doc_id, dw.i, dw.n, bw.item_id FROM dw JOIN bw ON dw.n = bw.n AND dw.win = bw.win),
covered AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM (SELECT DISTINCT doc_id, i, n FROM hits)) GROUP BY doc_id),
items AS (
  SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS ids
  FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM hits) GROUP BY doc_id)
SELECT d.doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(ids, '')) AS items_sha256,
  coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN covered USING (doc_id) LEFT JOIN items USING (doc_id)
"""
