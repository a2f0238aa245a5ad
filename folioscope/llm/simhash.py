"""SimHash near-dedup with bit-sliced comparison.

Fingerprints: XXH64 (seed 42) of the 3-word shingles of the lower-cased text, repeats included; a bit is set if it is
set in over half of the hashes.  Equal fingerprints are one node.  Distinct fingerprints within ``radius`` bits
share, cut into ``parts`` bit ranges, at least ``parts - radius`` whole ranges; so each fingerprint goes to one
bucket for each choice of that many ranges, and every link is inside some bucket.

Comparison in a bucket is bit-sliced: bit j of all fingerprints is stored as one plane of 64-bit words.  One
fingerprint meets a block of 64 others at a time: the planes, inverted where its own bit is set, are summed
into vertical carry-save counters that saturate above the radius, and a block is abandoned once all its counters are
above.  A bucket gives a spanning forest of its links, not all pairs.  The pairs of small buckets (``SMALL``) are packed
together: the bit planes of their differences are summed in the same way, 64 pairs at a time.

Buckets above ``most`` fingerprints are not compared: their fingerprints are cut anew by the pigeonhole rule on the
bits not shared yet, into smaller buckets, again and again.  No bucket is dropped or truncated, and what a
task holds at once is bounded.

Defined cases: null texts and texts without words have the fingerprint zero; texts under three words are one
shingle; equal fingerprints are one component whatever the texts; repeated rows give repeated results; an
empty table gives an empty result; other columns are ignored, and passed on by ``keep_one``.
"""

from __future__ import annotations

from itertools import accumulate, combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import column, unused, utf8, written
from .components import components

SHINGLE, SEED, RADIUS = 3, 42, 3
MOST = 4096
SMALL, PACKED = 24, 1 << 18


def fingerprint(text: bytes, shingle: int = SHINGLE, seed: int = SEED) -> int:
    words = text.lower().split()  # bytes: A-Z only; \x20 and \x09-\x0D only
    n = len(words)
    if not n:
        return 0
    joined = b" ".join(words)
    ends = list(accumulate(len(w) + 1 for w in words))
    digest = xxhash.xxh64_digest
    if n <= shingle:
        return int.from_bytes(digest(joined, seed), "big")
    starts = [0, *ends]
    raw = b"".join([digest(joined[a : b - 1], seed) for a, b in zip(starts, ends[shingle - 1 :], strict=False)])
    total = len(raw) // 8
    bits = np.zeros(64, dtype=np.int64)
    rows = np.frombuffer(raw, dtype=np.uint8).reshape(total, 8)
    for i in range(0, total, 1 << 15):
        bits += np.unpackbits(rows[i : i + (1 << 15)], axis=1).sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * bits > total).tobytes(), "big")


def fingerprints(docs: DataFrame) -> DataFrame:
    """(doc_id, fp): the fingerprint as a signed long."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches):
        for batch in batches:
            fp = np.array([fingerprint(t) for t in utf8(column(batch, "text"))], dtype=np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([column(batch, "doc_id"), pa.array(fp)], ["doc_id", "fp"])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, fp long")


def planes(fps: np.ndarray) -> np.ndarray:
    """[bit, word]: bit planes of the fingerprints, 64 fingerprints a word."""
    m = -(-len(fps) // 64) * 64
    padded = np.zeros(m, dtype=np.uint64)
    padded[: len(fps)] = fps
    bits = np.unpackbits(padded.astype("<u8").view(np.uint8).reshape(m, 8), axis=1, bitorder="little")  # [fingerprint, bit]
    return np.ascontiguousarray(np.packbits(bits.T, axis=1, bitorder="little")).view("<u8")


def within(fp: int, table: np.ndarray, radius: int, n: int) -> np.ndarray:
    """Indexes below n of fingerprints within ``radius`` bits (3 at most) of fp, from bit planes."""
    blocks = np.arange(table.shape[1])
    one = np.zeros(len(blocks), dtype=np.uint64)
    two, over = one.copy(), one.copy()
    full = np.uint64(0xFFFFFFFFFFFFFFFF)
    for j in range(64):
        x = table[j, blocks]
        if fp >> j & 1:
            x = ~x
        # Carry-save: (two, one) count to 3, over is set beyond.
        carry = one & x
        one ^= x
        over |= two & carry
        two ^= carry
        if j % 8 == 7 and j > 8:
            alive = over != full
            if not alive.all():
                blocks, one, two, over = blocks[alive], one[alive], two[alive], over[alive]
                if not len(blocks):
                    return blocks
    near = ~over
    if radius < 3:
        near &= ~two if radius == 1 else ~(two & one) if radius == 2 else ~(two | one)
    at = np.flatnonzero(near)
    bits = np.unpackbits(near[at].astype("<u8").view(np.uint8).reshape(len(at), 8), axis=1, bitorder="little")
    row, bit = np.nonzero(bits)
    out = blocks[at][row] * 64 + bit
    return out[out < n]


def forest(fps: np.ndarray, radius: int = RADIUS) -> list[tuple[int, int]]:
    """(larger, smallest) links of a bucket's components, by index into fps."""
    n = len(fps)
    table = planes(fps)
    values = fps.tolist()
    pairs = ((i, j) for i in range(n) for j in within(values[i], table, radius, n).tolist() if j > i)
    parent = list(range(n))

    def root(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for a, b in pairs:
        ra, rb = root(a), root(b)
        if ra != rb:
            parent[max(ra, rb)] = min(ra, rb)
    return [(i, root(i)) for i in range(n) if root(i) != i]


def packed(fps: np.ndarray, starts: np.ndarray, sizes: np.ndarray, radius: int = RADIUS):
    """(a, b) fingerprints within ``radius`` bits inside each bucket of a few; buckets are runs of ``fps``."""
    for n in np.unique(sizes).tolist():
        i, j = np.triu_indices(n, 1)
        own = starts[sizes == n]
        some = max(1, PACKED // max(1, len(i)))
        for k in range(0, len(own), some):
            first = own[k : k + some, None]
            a, b = fps[(first + i).ravel()], fps[(first + j).ravel()]
            at = within(0, planes(a ^ b), radius, len(a))
            yield a[at], b[at]


def ranges(mask: int, parts: int) -> list[int]:
    """The bits outside ``mask`` in ``parts`` masks of about equal size."""
    free = [j for j in range(64) if not mask >> j & 1]
    cut = [len(free) * i // parts for i in range(parts + 1)]
    return [sum(1 << j for j in free[a:b]) for a, b in zip(cut, cut[1:], strict=False)]


def keys(mask: int, parts: int, radius: int) -> list[int]:
    """Masks of shared bits, the given ones included: one for each choice of parts - radius ranges."""
    return [mask | sum(c) for c in combinations(ranges(mask, parts), parts - radius)]


def signed(x: int) -> int:
    return x - (1 << 64) if x >= 1 << 63 else x


def links(nodes: DataFrame, *, radius: int = RADIUS, most: int = MOST, rows: int | None = None) -> DataFrame:
    """(a, b): links whose components are those of all pairs of distinct ``fp`` within ``radius`` bits."""
    if radius > 3:
        raise ValueError("counters saturate above 3 bits")
    rows = nodes.count() if rows is None else rows
    # More ranges, larger keys: buckets of random fingerprints stay small as their number grows.
    parts = radius + 2 if rows < 5_000_000 else radius + 3 if rows < 2_000_000_000 else radius + 4
    todo = nodes.select("fp", F.lit(0).cast("long").alias("mask"))
    done: list[DataFrame] = []
    width = 0
    while True:
        # Fingerprints of a hot bucket share its mask; each is cut anew on the other bits.
        if width == 0:
            masks = F.array(*(F.lit(signed(m)) for m in keys(0, parts, radius)))
        else:
            known = [r.mask for r in todo.select("mask").distinct().collect()]  # bounded by the choices of ranges
            finer = {m: keys(m & (2**64 - 1), parts, radius) for m in known}
            masks = F.coalesce(*(F.when(F.col("mask") == m, F.array(*(F.lit(signed(x)) for x in v))) for m, v in finer.items()))
        spread = todo.select("fp", F.explode(masks).alias("mask")).withColumn("key", F.col("fp").bitwiseAND(F.col("mask")))
        spread = written(spread.distinct() if width else spread, few=True)
        sizes = spread.groupBy("mask", "key").agg(F.count("*").alias("n")).where("n > 1")
        cool, hot = sizes.where(F.col("n") <= most).drop("n"), sizes.where(F.col("n") > most).drop("n")
        # Two fingerprints that share all but 6 bits and fewer are all compared anyway: 64 at most.
        done.append(_compare(spread.join(cool, ["mask", "key"], "left_semi"), radius))
        width += 1
        if hot.isEmpty():
            break
        todo = written(spread.join(hot, ["mask", "key"], "left_semi").select("fp", "mask"), few=True)
    out = done[0]
    for d in done[1:]:
        out = out.unionAll(d)
    return out


def _compare(buckets: DataFrame, radius: int) -> DataFrame:
    """Links inside buckets, which arrive sorted, so one bucket at a time is held."""

    def run(batches):
        rest_k, rest_f = np.zeros((0, 2), dtype=np.int64), np.zeros(0, dtype=np.int64)

        def out(k, f):
            f = f.view(np.uint64)
            starts = np.flatnonzero(np.append(True, (k[1:] != k[:-1]).any(1)))[: len(k)]
            sizes = np.diff(np.append(starts, len(k)))
            few = (sizes > 1) & (sizes <= SMALL)
            a, b = [np.zeros(0, np.uint64)], [np.zeros(0, np.uint64)]
            for x, y in packed(f, starts[few], sizes[few], radius):
                a.append(x)
                b.append(y)
            for s, n in zip(starts[sizes > SMALL].tolist(), sizes[sizes > SMALL].tolist(), strict=True):
                own = np.unique(f[s : s + n])
                tree = np.array(forest(own, radius), dtype=np.int64).reshape(-1, 2)
                a.append(own[tree[:, 0]])
                b.append(own[tree[:, 1]])
            return pa.RecordBatch.from_arrays([pa.array(np.concatenate(x).view(np.int64)) for x in (a, b)], ["a", "b"])

        for batch in batches:
            k = np.stack([column(batch, "mask").to_numpy(), column(batch, "key").to_numpy()], axis=1)
            k, f = np.concatenate([rest_k, k]), np.concatenate([rest_f, column(batch, "fp").to_numpy()])
            last = np.flatnonzero((k == k[-1]).all(1))[0] if len(k) else 0
            yield out(k[:last], f[:last])
            rest_k, rest_f = k[last:], f[last:]
        yield out(rest_k, rest_f)

    return buckets.repartition("mask", "key").sortWithinPartitions("mask", "key").select("mask", "key", "fp").mapInArrow(run, "a long, b long")


def near_duplicates(docs: DataFrame, *, radius: int = RADIUS, most: int = MOST) -> DataFrame:
    """Per document: doc_id, fingerprint (16 hex digits), component_id (smallest doc_id of its component)."""
    found = written(fingerprints(docs))
    nodes = written(found.groupBy("fp").agg(F.min("doc_id").alias("first")), few=True)
    roots = components(links(nodes, radius=radius, most=most))
    named = nodes.join(roots, F.col("fp") == F.col("node"), "left").select("fp", "first", F.coalesce("root", "fp").alias("root"))
    least = named.groupBy("root").agg(F.min("first").alias("component_id"))
    # One row a distinct fingerprint; documents, of which one fingerprint may hold many, meet it by a join that can be split.
    label = named.join(least, "root").select("fp", "component_id")
    return found.join(label, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def keep_one(docs: DataFrame, *, radius: int = RADIUS, most: int = MOST) -> DataFrame:
    """One row of each component, that of the smallest doc_id (a null one is the largest), all columns as they are.

    Rows are told apart by a digest of all their columns, so a null or repeated doc_id neither merges components
    nor loses one; of rows equal in all columns one stays.
    """
    row = F.md5(F.to_json(F.struct(*(F.md5(F.col("text").cast("binary")).alias(c) if c == "text" else F.col(c) for c in docs.columns))))
    key = unused(docs, "__row")[0]
    keyed = docs.withColumn(key, row)
    named = keyed.select(F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id").alias("id"), F.col(key).alias("row")).alias("doc_id"), "text")
    classes = written(near_duplicates(named, radius=radius, most=most), few=True)
    kept = classes.where(F.col("doc_id") == F.col("component_id")).groupBy(F.col("doc_id.row").alias(key)).agg(F.count("*").alias("n"))
    once = keyed.join(kept.where("n = 1").select(key), key, "left_semi")
    again = keyed.join(kept.where("n > 1").select(key), key, "left_semi").dropDuplicates([key])
    return once.unionAll(again).select(docs.columns)
