"""Mixing sources to target weights by weighted fair queueing.

Each source's documents are put in a hash order.  A document's virtual finish time is the source's
cumulative words, its own included, divided by the source's target; a second pass over a source continues the
sum.  The mix is the prefix, in order of finish time, whose words fit the total budget.

Distribution: a source's cumulative sums are two-level prefix sums over ranges of the hash, so a source that
holds most rows is spread over all tasks.  The global order is never gathered: finish times are counted in
bins, the bin that holds the cut is counted again in finer bins, until it is small enough to be ordered.  Up to
``BROADCAST_SOURCES`` sources, their targets are computed on the driver and broadcast; more are ranked by a range sort, filled by
aggregates of the source table, and joined with the documents by source and a salt.

Defined cases: a null text has size 0; a null source is a source of its own, last in order; documents
of size 0 are never taken for anything but 0 words; identical rows are separate documents; an empty
table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import unused, written

#: Sources whose sizes the driver takes at most.
BROADCAST_SOURCES = 20_000
SALTS = 16
WEIGHTS = (3.0, 1.0, 2.0)
WORD = r"[^\x20\x09-\x0D]+"


def targets(sizes: dict, weights=WEIGHTS, share: float = 1.5, passes: float = 2.0) -> dict:
    """Water filling: {source: words} that share ``share`` times all words by weight, at most ``passes`` times each source's own."""
    order = sorted((s for s in sizes if s is not None)) + [None] * (None in sizes)
    weight = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    left, out = share * sum(sizes.values()), {}
    free = [s for s in order]
    while free:
        total = sum(weight[s] for s in free)
        full = [s for s in free if left * weight[s] / total > passes * sizes[s]]
        if not full:
            out |= {s: left * weight[s] / total for s in free}
            break
        for s in full:
            out[s] = passes * sizes[s]
        left -= sum(out[s] for s in full)
        free = [s for s in free if s not in out]
    return out


def _ranked(sources: DataFrame) -> DataFrame:
    """``sources`` with their ``rank`` by code point from 0, null last: places within ranges, and the sizes of the ranges before."""
    order = F.col("source").asc_nulls_last()
    dealt = sources.repartitionByRange(order).sortWithinPartitions(order)
    placed = written(dealt.withColumn("part", F.spark_partition_id()).withColumn("place", F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))))
    first, before = [], 0
    for r in placed.groupBy("part").count().orderBy("part").collect():  # a row for each range
        first.append((r["part"], before))
        before += r["count"]
    table = sources.sparkSession.createDataFrame(first, "part int, first long")
    return placed.join(F.broadcast(table), "part").withColumn("rank", F.col("first") + F.col("place")).drop("part", "place", "first")


def goals(sources: DataFrame, weights=WEIGHTS, share: float = 1.5, passes: float = 2.0) -> DataFrame:
    """(sid, source, source_size, target) of ``sources`` (source, s): ``targets`` for any number of sources.

    The water level rises with each round until no further source is full; a round is one aggregate.
    """
    weight = F.element_at(F.array(*(F.lit(float(w)) for w in weights)), (F.col("rank") % len(weights) + 1).cast("int"))
    ranked = written(_ranked(sources).withColumn("weight", weight).withColumn("most", F.lit(float(passes)) * F.col("s")))
    all_words = share * float(ranked.agg(F.sum("s")).first()[0] or 0)
    level, rising = all_words / (ranked.agg(F.sum("weight")).first()[0] or 1.0), True
    while rising:
        full = F.lit(level) * F.col("weight") > F.col("most")
        r = ranked.agg(F.sum(F.when(full, F.col("most"))).alias("full"), F.sum(F.when(~full, F.col("weight"))).alias("free")).first()
        higher = (all_words - (r["full"] or 0.0)) / r["free"] if r["free"] else level
        rising, level = higher > level * (1 + 1e-15), max(level, higher)
    return ranked.select(F.col("rank").alias("sid"), "source", F.col("s").alias("source_size"), F.least(F.lit(level) * F.col("weight"), F.col("most")).alias("target"))


def _cut(times: DataFrame, budget: float, bins: int, exact: int) -> tuple:
    """The largest (v, h, pass) key of which all keys up to it have sizes within the budget."""
    low, high, before = 0.0, 4.0, 0.0
    while True:
        step = (high - low) / bins
        inside = times.where((F.col("v") >= low) & (F.col("v") < high))
        rows = inside.groupBy(F.least(F.floor((F.col("v") - F.lit(low)) / F.lit(step)), F.lit(bins - 1)).alias("bin")).agg(F.sum("size").alias("s"), F.count("*").alias("n")).orderBy("bin").collect()
        hit = None
        for r in rows:  # at most ``bins`` rows
            if before + r.s > budget:
                hit = r
                break
            before += r.s
        if hit is None:
            return (high, 0, 0)
        # One step wider on both sides is not needed: the bin's own index is recomputed from the same expression.
        a, b = low + hit.bin * step, low + (hit.bin + 1) * step
        if hit.n <= exact or b - a < 1e-13 or not (low < a or b < high):
            chosen = inside.where(F.least(F.floor((F.col("v") - F.lit(low)) / F.lit(step)), F.lit(bins - 1)) == hit.bin)
            if hit.n > exact:  # equal times only: any cut between them is right
                return (a, 0, 0)
            last = (a, -(2**63), -1)
            for r in chosen.select("v", "h", "pass", "size").orderBy("v", "h", "pass").collect():  # at most ``exact`` rows
                if before + r["size"] > budget:
                    return last
                before += r["size"]
                last = (r.v, r.h, r["pass"])
            return last
        low, high = a, b
        # Rows whose bin and bounds round differently stay right of the cut by at most one document.


def mix(docs: DataFrame, *, weights=WEIGHTS, share: float = 1.5, passes: int = 2, bucket_rows: int = 2_000, bins: int = 4096, exact: int = 20_000) -> DataFrame:
    """Per document: doc_id, size, source_size, target, taken (words, repeats counted), copies, finish (of the first pass)."""
    spark = docs.sparkSession
    base = written(
        docs.select(
            "doc_id",
            F.col("source").cast("string").alias("source"),
            F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long").alias("size"),
            F.xxhash64(F.lit("mix"), "doc_id", "text", "source").alias("h"),
        )
    )
    sources = written(base.groupBy("source").agg(F.sum("size").alias("s"), F.count("*").alias("n")), few=True)
    count, rows = sources.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
    if count <= BROADCAST_SOURCES:
        sizes = {r.source: int(r.s) for r in sources.collect()}
        goal = targets(sizes, weights, share, passes)
        table = spark.createDataFrame([(i, s, sizes[s], float(t)) for i, (s, t) in enumerate(goal.items())], "sid long, source string, source_size long, target double")
        met = F.broadcast(table.withColumnRenamed("source", "its"))
        keyed = base.join(met, F.col("source").eqNullSafe(F.col("its"))).drop("its")
        budget = sum(goal.values())
    else:
        table = written(goals(sources, weights, share, passes), few=True)
        met = table.withColumnRenamed("source", "its").withColumn("turn", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        keyed = base.withColumn("salt", F.pmod("h", F.lit(SALTS)).cast("int")).join(met, F.col("source").eqNullSafe(F.col("its")) & (F.col("salt") == F.col("turn"))).drop("its", "salt", "turn")
        budget = float(table.agg(F.sum("target")).first()[0])
    bits = max(0, min(30, (max(rows, 1) // bucket_rows).bit_length()))
    bucket: Column = F.shiftright("h", 64 - bits) if bits else F.lit(0).cast("long")
    keyed = keyed.withColumn("bucket", bucket)
    sums = keyed.groupBy("sid", "bucket").agg(F.sum("size").alias("inside"))
    # One row for each source and hash range, not for each document.
    before = sums.withColumn("before", F.sum("inside").over(Window.partitionBy("sid").orderBy("bucket")) - F.col("inside")).drop("inside")
    within = Window.partitionBy("sid", "bucket").orderBy("h", "doc_id").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    placed = written(
        keyed.join(before, ["sid", "bucket"]).withColumn("upto", F.col("before") + F.sum("size").over(within)).select("doc_id", "h", "size", "source_size", "target", "upto"),
        few=True,
    )

    def finish(k: int) -> Column:
        # A source without words has the target 0 and no finish times.
        return F.try_divide((F.lit(k) * F.col("source_size") + F.col("upto")).cast("double"), F.col("target"))

    turns = range(passes)
    times = placed.where("size > 0").select("h", "size", F.explode(F.array(*(F.struct(finish(k).alias("v"), F.lit(k).alias("pass")) for k in turns))).alias("t")).select("h", "size", "t.*")
    v, h, k = _cut(times, budget * (1 + 1e-12), bins, exact)

    def inside(turn: int) -> Column:
        mine = F.struct(finish(turn).alias("a"), F.col("h").alias("b"), F.lit(turn).alias("c"))
        return ((F.col("size") > 0) & (mine <= F.struct(F.lit(float(v)).alias("a"), F.lit(h).cast("long").alias("b"), F.lit(k).alias("c")))).cast("int")

    copies = sum((inside(k) for k in turns), F.lit(0))
    return placed.withColumn("copies", F.coalesce(copies, F.lit(0))).select(
        "doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"), "copies", finish(0).alias("finish"), "h"
    )


def take_mix(docs: DataFrame, **options) -> DataFrame:
    """The documents of the mix, once each: all their columns, with ``mix_taken`` words and ``mix_copies`` (in place of columns of these names); identical rows share equally."""
    docs = docs.drop("mix_taken", "mix_copies")
    ident, h, key = unused(docs, "__id", "__h", "__key")
    mixed = mix(docs, **options).where("copies > 0").groupBy(F.col("doc_id").alias(ident), F.col("h").alias(h))
    mixed = mixed.agg((F.sum("taken") / F.count("*")).cast("long").alias("mix_taken"), (F.sum("copies") / F.count("*")).alias("mix_copies"))
    keyed = docs.withColumn(key, F.xxhash64(F.lit("mix"), "doc_id", "text", "source"))
    return keyed.join(mixed, F.col("doc_id").eqNullSafe(F.col(ident)) & (F.col(key) == F.col(h))).drop(ident, h, key)
