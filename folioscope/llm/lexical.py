"""Ranked lexical search over a tiered index: high-impact postings first, with a residual bound for each term.

The score of a document for an item is the sum, over the item's terms, of the term's weight and the impact of its
posting; both are integers.  A document's postings are dealt into tiers by impact: a term's highest go to the first tier,
up to a number that grows with its frequency, the next to the second, the rest to the last.  For each
tier and term the index knows the residual bound: the highest impact that any posting below the tier has.

Proof.  What a document has in the upper tiers is a lower bound of its score.  A document that has nothing there scores at most the
item's residual, the sum of its terms' bounds.  If the 20th lower bound is above that residual, no such document can be
among the 20: only documents whose lower bound and remaining residuals reach the 20th are scored in full.  Items without this proof fall
through to the next tier; the last has no residual.  So results are exact at any tier sizes.

Distribution.  The index is a written table with a row for each document and a pair of columns for each tier, so a round reads the upper tiers'
columns only.  Documents never move: tasks sum scores of their own documents for all items in numpy, and send 20 rows an item.
Items come in blocks of about ``BLOCK_TERMS`` terms; a block's terms, weights and bounds are what is broadcast.

Defined cases: a null or termless text has no terms and is not counted in N; a null or termless item finds nothing; equal items are items of their own;
repeated rows of one document are documents of their own, in the order of rows; documents without a doc_id come after others of their score; a very
long text is read in pieces; an empty table, of documents or items, gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import CHUNK_BYTES, chunks, column, utf8, written
from .wordops import ALNUM, LOWER, HashSet, Words, same_bytes, tokenize

TOP = 20
#: Postings of a term in the tiers up to each one but the last: at least so many, and at least this share of them.
TIER_LEAST, TIER_SHARE = (64, 2048), (1 / 256, 1 / 16)
TIERS = len(TIER_LEAST) + 1
#: Terms of a block of items, about, and cells (documents x items) that a task sums at once.
BLOCK_TERMS, CELLS = 200_000, 1 << 20
#: Impacts are counted in bins of this width.
BIN = 1 << 10
SALTS = 64


class Vocabulary:
    """Codes of a fixed set of terms: found by hash, confirmed by bytes."""

    def __init__(self, terms: list[bytes]):
        self.terms = terms
        joined = tokenize([b" ".join(terms)], ALNUM)
        self.data, self.starts, self.sizes = joined.data, joined.starts, joined.ends - joined.starts
        hashes = joined.hashes()
        order = np.argsort(hashes, kind="stable")
        self.codes, self.members = order, HashSet(hashes)
        #: Terms that share a hash with another one are found by their bytes.
        _, first, count = np.unique(hashes[order], return_index=True, return_counts=True)
        self.codes = order[first]
        self.shared = count > 1
        self.by_bytes = {t: i for i, t in enumerate(terms)} if self.shared.any() else {}

    def __len__(self) -> int:
        return len(self.terms)

    def find(self, words: Words) -> tuple[np.ndarray, np.ndarray]:
        """(word, code) of the words that are terms."""
        hashes = words.hashes()
        at = self.members.find(hashes)
        if not len(at):
            return at, at
        spot = np.searchsorted(self.members.values, hashes[at])
        code = self.codes[spot]
        if self.by_bytes:
            for k in np.flatnonzero(self.shared[spot]).tolist():
                code[k] = self.by_bytes.get(words.text(at[k], at[k] + 1), code[k])
        size = (words.ends - words.starts)[at]
        same = size == self.sizes[code]
        at, code, size = at[same], code[same], size[same]
        both = np.concatenate([words.data, self.data])
        same = same_bytes(both, words.starts[at], self.starts[code] + len(words.data), size)
        return at[same], code[same]


@dataclass
class Block:
    """Items as columns: their terms' codes and numbers of repeats; ``weight`` and ``bounds`` are set when the corpus is counted."""

    turns: list[int]
    names: list
    vocabulary: Vocabulary
    term: np.ndarray
    item: np.ndarray
    repeats: np.ndarray
    weight: np.ndarray = field(default_factory=lambda: np.zeros(0, dtype=np.int64))
    bounds: np.ndarray = field(default_factory=lambda: np.zeros((0, 0), dtype=np.int64))

    def postings(self, items: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(first, item, weight) by term code for some items, renumbered from 0 in their order."""
        place = np.full(len(self.turns), -1)
        place[items] = np.arange(len(items))
        keep = np.flatnonzero(place[self.item] >= 0)
        keep = keep[np.argsort(self.term[keep], kind="stable")]
        first = np.searchsorted(self.term[keep], np.arange(len(self.vocabulary) + 1))
        return first, place[self.item[keep]], (self.weight[self.term] * self.repeats)[keep]

    def residual(self, tier: int) -> np.ndarray:
        """What an item's terms add at most below the tier."""
        out = np.zeros(len(self.turns), dtype=np.int64)
        np.add.at(out, self.item, self.weight[self.term] * self.repeats * self.bounds[tier][self.term])
        return out


def summed(n: int, rows: np.ndarray, terms: np.ndarray, values: np.ndarray, table: tuple, items: int) -> np.ndarray:
    """[document, item]: sum of weight times value over the postings (document ``rows``, ``terms``, ``values``)."""
    first, item, weight = table
    out = np.zeros(n * items, dtype=np.int64)
    step = 1 << 20
    count = first[terms + 1] - first[terms]
    upto = np.cumsum(count)
    at = 0
    while at < len(terms):
        stop = max(at + 1, int(np.searchsorted(upto, (upto[at - 1] if at else 0) + step)))
        c = count[at:stop]
        each = np.repeat(np.arange(at, stop), c)
        spot = np.arange(len(each)) + np.repeat(first[terms[at:stop]] - (np.cumsum(c) - c), c)
        key, add = rows[each] * items + item[spot], values[each] * weight[spot]
        if add.size and float(add.max()) * len(add) < 2**53:  # sums of doubles are exact here
            out += np.bincount(key, weights=add, minlength=len(out)).astype(np.int64)
        else:
            np.add.at(out, key, add)
        at = stop
    return out.reshape(n, items)


def _flat(lists: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(row of each entry, entries) of a list column."""
    if isinstance(lists, pa.ChunkedArray):
        lists = lists.combine_chunks()
    sizes = np.diff(lists.offsets.to_numpy())
    return np.repeat(np.arange(len(lists)), sizes), lists.flatten().to_numpy(zero_copy_only=False).astype(np.int64)


def _lists(n: int, rows: np.ndarray, values: np.ndarray) -> pa.Array:
    """The list column of ``n`` rows whose entries, by rising row, are ``values``."""
    offsets = np.searchsorted(rows, np.arange(n + 1)).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(values.astype(np.int32)))


def blocks(items: DataFrame, block_terms: int = BLOCK_TERMS):
    """The items that have terms, block by block."""

    def run(batches):
        for batch in batches:
            turns, terms, repeats = [], [], []
            for turn, text in zip(column(batch, "turn").to_pylist(), utf8(column(batch, "text")), strict=True):
                words = tokenize([text], ALNUM)
                found, counts = np.unique(np.array(words.text(0, len(words)).split(), dtype=object), return_counts=True) if len(words) else ([], [])
                turns += [turn] * len(found)
                terms += list(found)
                repeats += list(counts)
            yield pa.RecordBatch.from_arrays([pa.array(turns, pa.int64()), pa.array([t.decode("utf-8", "replace") for t in terms], pa.string()), pa.array(repeats, pa.int64())], ["turn", "term", "repeats"])

    named = written(items.select("item_id", "text", F.monotonically_increasing_id().alias("turn")))
    terms = written(named.select("turn", "text").mapInArrow(run, "turn long, term string, repeats long"))
    count = max(1, -(-terms.count() // block_terms))
    block = F.pmod(F.xxhash64("turn"), F.lit(count))
    for k in range(count):
        # About ``block_terms`` rows.
        rows = terms.where(block == k).orderBy("turn", "term").toPandas()
        if not len(rows):
            continue
        names = {r.turn: r.item_id for r in named.where(block == k).select("turn", "item_id").collect()}
        turns = sorted(rows["turn"].unique().tolist())
        words = sorted({t.encode() for t in rows["term"]})
        code, place = {t: i for i, t in enumerate(words)}, {t: i for i, t in enumerate(turns)}
        yield Block(
            turns, [names[t] for t in turns], Vocabulary(words), np.array([code[t.encode()] for t in rows["term"]], dtype=np.int64), np.array([place[t] for t in rows["turn"]], dtype=np.int64),
            rows["repeats"].to_numpy(dtype=np.int64),
        )


def _pieces(text: bytes):
    """A long text in pieces that end where a word ends."""
    at = 0
    while at < len(text):
        stop = min(at + CHUNK_BYTES, len(text))
        while stop < len(text) and ALNUM[LOWER[text[stop]]]:
            stop += 1
        yield text[at:stop]
        at = stop


def vectors(docs: DataFrame, vocabulary: Vocabulary) -> DataFrame:
    """(rid, doc_id, n, terms, tfs): all terms' number and the vocabulary's terms of each document, by code."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary)

    def counted(words: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        at, code = shared.value.find(words)
        keys, counts = np.unique(words.doc[at] * len(shared.value) + code, return_counts=True)
        return keys // len(shared.value), keys % len(shared.value), counts

    def run(batches):
        for batch in batches:
            for start, texts in chunks(utf8(column(batch, "text"))):
                if len(texts) == 1 and len(texts[0]) > CHUNK_BYTES:
                    total, sums = 0, np.zeros(len(shared.value), dtype=np.int64)
                    for piece in _pieces(texts[0]):
                        words = tokenize([piece], ALNUM)
                        total += len(words)
                        _, code, counts = counted(words)
                        sums[code] += counts
                    code = np.flatnonzero(sums)
                    rows, counts, sizes = np.zeros(len(code), dtype=np.int64), sums[code], np.array([total])
                else:
                    words = tokenize(texts, ALNUM)
                    (rows, code, counts), sizes = counted(words), words.counts()
                n = len(texts)
                yield pa.RecordBatch.from_arrays(
                    [column(batch, "rid").slice(start, n), column(batch, "doc_id").slice(start, n), pa.array(sizes, pa.int64()), _lists(n, rows, code), _lists(n, rows, counts)], ["rid", "doc_id", "n", "terms", "tfs"]
                )

    return docs.select(F.monotonically_increasing_id().alias("rid"), "doc_id", "text").mapInArrow(run, f"rid long, doc_id {kind}, n long, terms array<int>, tfs array<int>")


def impacts(n: np.ndarray, rows: np.ndarray, tfs: np.ndarray, documents: int, terms: int) -> np.ndarray:
    m = 100 - 25 + (25 * n * documents) // terms
    return (1_000_000_000 * tfs) // (1000 * tfs + 12 * m[rows])


def weights(documents: int, df: np.ndarray) -> np.ndarray:
    return np.array([math.floor(1000 * math.log((2 * documents + 2) / (2 * int(d) + 1))) for d in df], dtype=np.int64)


def index(docs: DataFrame, block: Block, least=TIER_LEAST, share=TIER_SHARE) -> DataFrame | None:
    """(rid, doc_id, t0, v0, t1, v1, ...): each document's postings of the block's terms by tier, terms and impacts; sets the block's weights and bounds.

    None if no document has a term.
    """
    table, size = written(vectors(docs, block.vocabulary)), len(block.vocabulary)
    documents, terms = table.where("n > 0").agg(F.count("*"), F.sum("n")).first()
    if not documents:
        return None

    def frequencies(batches):
        sums = np.zeros(size, dtype=np.int64)
        for batch in batches:
            sums += np.bincount(_flat(column(batch, "terms"))[1], minlength=size)
        code = np.flatnonzero(sums)
        yield pa.RecordBatch.from_arrays([pa.array(code), pa.array(sums[code])], ["code", "df"])

    df = np.zeros(size, dtype=np.int64)
    for r in table.select("terms").mapInArrow(frequencies, "code long, df long").groupBy("code").agg(F.sum("df").alias("df")).collect():  # a row for each term of the block
        df[r.code] = r.df
    block.weight = weights(documents, df)

    def histogram(batches):
        bins = 1_000_000 // BIN + 1
        for batch in batches:
            (rows, code), (_, tfs) = _flat(column(batch, "terms")), _flat(column(batch, "tfs"))
            value = impacts(column(batch, "n").to_numpy(), rows, tfs, documents, terms)
            keys, back, counts = np.unique(code * bins + value // BIN, return_inverse=True, return_counts=True)
            top = np.zeros(len(keys), dtype=np.int64)
            np.maximum.at(top, back, value)
            yield pa.RecordBatch.from_arrays([pa.array(keys // bins), pa.array(keys % bins), pa.array(counts.astype(np.int64)), pa.array(top)], ["code", "bin", "n", "top"])

    bins = table.select("n", "terms", "tfs").mapInArrow(histogram, "code long, bin long, n long, top long").groupBy("code", "bin").agg(F.sum("n").alias("n"), F.max("top").alias("top"))
    # A term's bins, fewer than a thousand, from the highest down: a tier takes whole bins while there is room.
    down = Window.partitionBy("code").orderBy(F.col("bin").desc()).rowsBetween(Window.unboundedPreceding, 0)
    upto = bins.withColumn("upto", F.sum("n").over(down)).withColumn("df", F.sum("n").over(Window.partitionBy("code")))
    inside = [F.col("upto") <= F.greatest(F.lit(a), F.floor(F.col("df") * F.lit(b))) for a, b in zip(least, share, strict=True)]
    cuts = upto.groupBy("code").agg(*(F.min(F.when(x, F.col("bin"))).alias(f"cut{i}") for i, x in enumerate(inside)), *(F.max(F.when(~x, F.col("top"))).alias(f"rest{i}") for i, x in enumerate(inside))).collect()
    tiers = len(least) + 1
    cut = np.full((tiers, size), 1 << 40, dtype=np.int64)  # no bin of a term fits
    cut[-1] = 0
    block.bounds = np.zeros((tiers, size), dtype=np.int64)
    for r in cuts:  # a row for each term of the block
        for i in range(tiers - 1):
            cut[i, r.code] = cut[i, r.code] if r[f"cut{i}"] is None else r[f"cut{i}"]
            block.bounds[i, r.code] = r[f"rest{i}"] or 0
    kind = docs.schema["doc_id"].dataType.simpleString()
    names = [f"{c}{i}" for i in range(tiers) for c in "tv"]

    def dealt(batches):
        for batch in batches:
            (rows, code), (_, tfs) = _flat(column(batch, "terms")), _flat(column(batch, "tfs"))
            value = impacts(column(batch, "n").to_numpy(), rows, tfs, documents, terms)
            tier = (value // BIN < cut[:, code]).sum(axis=0)
            out = []
            for i in range(tiers):
                mine = tier == i
                out += [_lists(len(batch), rows[mine], code[mine]), _lists(len(batch), rows[mine], value[mine])]
            yield pa.RecordBatch.from_arrays([column(batch, "rid"), column(batch, "doc_id"), *out], ["rid", "doc_id", *names])

    return written(table.where("size(terms) > 0").mapInArrow(dealt, f"rid long, doc_id {kind}, " + ", ".join(f"{n} array<int>" for n in names)))


def _upper(batch: pa.RecordBatch, upto: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, term, impact) of the postings in tiers 0 to ``upto``."""
    parts = [(*_flat(column(batch, f"t{i}")), _flat(column(batch, f"v{i}"))[1]) for i in range(upto + 1)]
    return tuple(np.concatenate([p[k] for p in parts]) for k in range(3))


def _best(frame: DataFrame, group: list[str], order: list, top: int) -> DataFrame:
    """The first ``top`` rows of each group, by way of salted groups: a group gets rows of each task."""
    salted = frame.withColumn("salt", F.pmod(F.shiftright("rid", 33), F.lit(SALTS)))
    few = salted.withColumn("place", F.row_number().over(Window.partitionBy(*group, "salt").orderBy(*order))).where(F.col("place") <= top)
    return few.withColumn("place", F.row_number().over(Window.partitionBy(*group).orderBy(*order))).where(F.col("place") <= top).drop("salt")


def floors(tiers: DataFrame, block: Block, items: np.ndarray, tier: int, top: int = TOP) -> np.ndarray:
    """The ``top``-th lower bound of each item from the tiers down to ``tier``; 0 if fewer documents have one."""
    table = block.postings(items)
    step = max(1, CELLS // len(items))

    def run(batches):
        best, rid = np.zeros((top, len(items)), dtype=np.int64), 0
        for whole in batches:
            for at in range(0, len(whole), step):
                batch = whole.slice(at, step)
                rid = column(batch, "rid")[0].as_py()
                low = np.concatenate([best, summed(len(batch), *_upper(batch, tier), table, len(items))])
                best = -np.partition(-low, top - 1, axis=0)[:top]
        value = best.T.ravel()
        item = np.repeat(items, top)[value > 0]
        yield pa.RecordBatch.from_arrays([pa.array(item), pa.array(value[value > 0]), pa.array(np.full(len(item), rid))], ["item", "value", "rid"])

    rows = tiers.select("rid", *(f"{c}{i}" for i in range(tier + 1) for c in "tv")).mapInArrow(run, "item long, value long, rid long")
    out = np.zeros(len(items), dtype=np.int64)
    place = {int(i): k for k, i in enumerate(items)}
    for r in _best(rows, ["item"], [F.col("value").desc()], top).where(F.col("place") == top).collect():  # a row for each item of the block
        out[place[r.item]] = r.value
    return out


def proofs(tiers: DataFrame, block: Block, top: int = TOP) -> tuple[np.ndarray, np.ndarray]:
    """(tier, floor) of each item: the first tier that proves its results, and the score they have at least there."""
    n, last = len(block.turns), len(block.bounds) - 1
    proved, floor = np.full(n, last), np.zeros(n, dtype=np.int64)
    for tier in range(last):
        open_ = np.flatnonzero(proved == last)
        if not len(open_):
            break
        low, rest = floors(tiers, block, open_, tier, top), block.residual(tier)[open_]
        sure = (rest < low) | (rest == 0)
        proved[open_[sure]], floor[open_[sure]] = tier, low[sure]
    return proved, floor


def _ranked(tiers: DataFrame, block: Block, proved: np.ndarray, floor: np.ndarray, top: int) -> DataFrame:
    """(item, score, doc_id, rid): the best ``top`` documents of each item and task, in full scores."""
    last = len(block.bounds) - 1
    groups = [(t, np.flatnonzero(proved == t)) for t in range(last + 1) if (proved == t).any()]
    tables = [block.postings(items) for _, items in groups]
    # What a term's posting in the upper tiers takes away from the residual.
    bounds = [block.bounds[t] for t, _ in groups]
    rests = [block.residual(t)[items] for t, items in groups]
    order = [("item", "ascending"), ("score", "descending"), ("doc_id", "ascending"), ("rid", "ascending")]
    kind = tiers.schema["doc_id"].dataType.simpleString()

    def cut(rows: pa.Table) -> pa.Table:
        rows = rows.sort_by(order) if len(rows) else rows
        item = rows["item"].to_numpy()
        first = np.searchsorted(item, item)
        return rows.filter(pa.array(np.arange(len(item)) - first < top))

    def run(batches):
        kept, least = None, [np.maximum(floor[items], 1) for _, items in groups]
        for whole in batches:
            step = max(1, CELLS // max(len(items) for _, items in groups))
            for at in range(0, len(whole), step):
                batch = whole.slice(at, step)
                every, found = _upper(batch, last), []
                for g, ((tier, items), table) in enumerate(zip(groups, tables, strict=True)):
                    if tier < last:
                        upper = _upper(batch, tier)
                        most = summed(len(batch), *upper, table, len(items)) + rests[g] - summed(len(batch), upper[0], upper[1], bounds[g][upper[1]], table, len(items))
                        maybe = most >= least[g]
                        docs = np.flatnonzero(maybe.any(axis=1))
                        mine = np.isin(every[0], docs)
                        score = summed(len(docs), np.searchsorted(docs, every[0][mine]), every[1][mine], every[2][mine], table, len(items)) * maybe[docs]
                    else:
                        docs = np.arange(len(batch))
                        score = summed(len(batch), *every, table, len(items))
                    if len(docs) >= top:
                        least[g] = np.maximum(least[g], -np.partition(-score, top - 1, axis=0)[top - 1])
                    d, i = np.nonzero(score >= least[g])
                    found.append((items[i], score[d, i], docs[d]))
                item, score, row = (np.concatenate(x) for x in zip(*found, strict=True))
                new = pa.table({"item": pa.array(item), "score": pa.array(score), "doc_id": column(batch, "doc_id").take(pa.array(row)), "rid": column(batch, "rid").take(pa.array(row))})
                kept = cut(new if kept is None else pa.concat_tables([kept, new]))
        if kept is not None and len(kept):
            yield from kept.combine_chunks().to_batches()

    return tiers.mapInArrow(run, f"item long, score long, doc_id {kind}, rid long")


def search(docs: DataFrame, items: DataFrame, *, top: int = TOP, block_terms: int = BLOCK_TERMS, least=TIER_LEAST, share=TIER_SHARE) -> DataFrame:
    """Per item its ``top`` documents: item_id, rank, doc_id, score, and the tier that proved them."""
    spark = docs.sparkSession
    kind, name = docs.schema["doc_id"].dataType.simpleString(), items.schema["item_id"].dataType.simpleString()
    out = []
    for block in blocks(items, block_terms):
        tiers = index(docs, block, least, share)
        if tiers is None:
            break
        proved, floor = proofs(tiers, block, top)
        rows = _ranked(tiers, block, proved, floor, top)
        order = [F.col("score").desc(), F.col("doc_id").asc_nulls_last(), F.col("rid")]
        # A row for each item of the block.
        names = spark.createDataFrame([(i, n, int(t)) for i, (n, t) in enumerate(zip(block.names, proved, strict=True))], f"item long, item_id {name}, tier int")
        out.append(_best(rows, ["item"], order, top).join(F.broadcast(names), "item").select("item_id", F.col("place").cast("int").alias("rank"), "doc_id", "score", "tier"))
    return reduce(DataFrame.unionByName, out) if out else spark.createDataFrame([], f"item_id {name}, rank int, doc_id {kind}, score long, tier int")


_TERMS = "regexp_extract_all(translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"
ORACLE = f"""
WITH q AS (SELECT item_id, term, count(*) AS repeats FROM (SELECT item_id, unnest({_TERMS.format("text")}) AS term FROM benchmark) GROUP BY item_id, term),
t AS (SELECT doc_id, term, count(*) AS tf FROM (SELECT doc_id, unnest({_TERMS.format("text")}) AS term FROM documents) GROUP BY doc_id, term),
d AS (SELECT doc_id, sum(tf)::BIGINT AS n FROM t GROUP BY doc_id),
c AS (SELECT count(*) AS docs, sum(n)::BIGINT AS terms FROM d),
f AS (SELECT term, floor(1000 * ln((2 * docs + 2) / (2 * df + 1)))::BIGINT AS w FROM (SELECT term, count(*) AS df FROM t GROUP BY term), c),
s AS (
  SELECT item_id, doc_id, sum(repeats * w * ((1000000000 * tf) // (1000 * tf + 12 * (100 - 25 + (25 * n * docs) // terms))))::BIGINT AS score
  FROM q JOIN t USING (term) JOIN f USING (term) JOIN d USING (doc_id), c GROUP BY item_id, doc_id),
r AS (SELECT item_id, (row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id))::INT AS rank, doc_id, score FROM s WHERE score > 0)
SELECT item_id, rank, doc_id, score FROM r WHERE rank <= 20
"""
