"""Connected components by minimum labels, as DataFrame joins with tables in the shared folder between rounds."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..runtime import written

#: Links that one task contracts by itself at most; more go by rounds over the cluster.
GATHERED = 200_000
#: Links of one task, about, where they go by rounds.
TASK_LINKS = 500_000


def _gathered(links: DataFrame) -> DataFrame:
    """(node, root) of at most GATHERED links, in one task."""
    kind = links.schema["u"].dataType.simpleString()

    def run(batches):
        above: dict = {}

        def top(x):
            while above[x] != x:
                above[x] = above[above[x]]
                x = above[x]
            return x

        for batch in batches:
            for u, v in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                above.setdefault(u, u)
                above.setdefault(v, v)
                low, high = sorted((top(u), top(v)))
                above[high] = low
        nodes = list(above)
        yield pa.RecordBatch.from_pydict({"node": pa.array(nodes, types[0]), "root": pa.array([top(n) for n in nodes], types[0])})

    types = [links.limit(0).toArrow().schema.field("u").type]
    return links.select("u", "v").coalesce(1).mapInArrow(run, f"node {kind}, root {kind}")


def components(edges: DataFrame, *, most_rounds: int = 200, gathered: int = GATHERED) -> DataFrame:
    """(node, root): every node that has an edge (a, b), with the smallest node of its component.

    Each round contracts to stars: a node's larger neighbours are linked to its smallest neighbour, then its
    smaller ones.  Links are kept distinct, so their number does not grow; the number of rounds
    grows with the logarithm of the longest path.  Round results are written tables: a lost executor
    costs a round at most.  Up to ``gathered`` links are contracted in one task, without rounds.  ``most_rounds`` only guards against an endless loop: it is far above what 2^64 nodes take.

    Tasks grow in number with the links, so that none holds more than some TASK_LINKS of them.
    """
    links = written(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct())
    for _ in range(most_rounds):
        size = links.count()
        if size <= gathered:
            return written(_gathered(links))
        tasks = max(links.sparkSession.sparkContext.defaultParallelism, -(-size // TASK_LINKS))
        # Of each node with a smaller neighbour the smallest one.  It is written, so that the join below reads both sides anew and Spark can split what a hub draws to one task.
        low = written(links.groupBy("u").agg(F.min("v").alias("m"))).select(F.col("u").alias("n"), "m")
        # Stars: a node with a smaller neighbour has one only, and is nobody's smaller neighbour.
        if low.count() == size and links.join(low, F.col("v") == F.col("n"), "left_semi").isEmpty():
            roots = links.select(F.col("v").alias("node")).distinct().select("node", F.col("node").alias("root"))
            return links.select(F.col("u").alias("node"), F.col("v").alias("root")).unionAll(roots)
        # Large star: for each node, neighbours above it go to the smallest of its neighbourhood, which is the node itself if it has none below.
        large = links.join(low, F.col("v") == F.col("n"), "left").select("u", F.coalesce("m", "v").alias("v")).repartition(tasks, "u").distinct()
        # Small star: for each node, its smaller neighbours and itself go to the smallest of them.
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct("u", F.col("m").alias("v")))).alias("e")).select("e.*")
        links = written(small.where("u <> v").repartition(tasks, "u").distinct())
    raise RuntimeError("components did not settle")
