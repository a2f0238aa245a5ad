"""The supplied star-schema tables read as works and profiles, so that every operator runs on them.

A line item is a record: its order is the work, its supplier the owner, all suppliers of the order its linked contributors.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..runtime import on_release, ship, tasks, written

FOCAL_REGION = 1
LINE = ("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_returnflag", "l_linestatus", "l_shipdate")


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return ship(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def profiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    s, n = read(spark, sf_dir, "supplier"), read(spark, sf_dir, "nation")
    return s.join(n, s.s_nationkey == n.n_nationkey).select(
        F.col("s_suppkey").cast("string").alias("orcid_id"), F.split("s_name", "#")[0].alias("given_names"), F.split("s_name", "#")[1].alias("family_names"), F.lit(None).cast("string").alias("credit_name"),
        F.array("n_name").alias("institution_names"), (F.col("n_regionkey") == FOCAL_REGION).alias("focal_author"), F.lit(None).cast("long").alias("works_count"), F.lit(None).cast("long").alias("unique_works_count"),
    )


#: Suppliers and parts that are broadcast at most.
BROADCAST_PEOPLE, BROADCAST_PARTS = 500_000, 200_000


_works: dict[tuple, DataFrame] = {}
on_release.append(_works.clear)


def _stamp(spark: SparkSession, sf_dir: str) -> tuple:
    """Times and sizes of the files that works are made of."""
    path, conf = spark.sparkContext._jvm.org.apache.hadoop.fs.Path, spark.sparkContext._jsc.hadoopConfiguration()
    found = []
    for name in ("lineitem", "orders", "part", "supplier", "nation"):
        where = path(f"{sf_dir}/{name}.parquet")
        found += [(name, s.getPath().getName(), s.getModificationTime(), s.getLen()) for s in where.getFileSystem(conf).listStatus(where)]
    return tuple(sorted(found))


def records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The works of ``planned``, written once for each application and state of the folder: for callers that read them many times."""
    key = (spark.sparkContext.applicationId, sf_dir, _stamp(spark, sf_dir))
    if key not in _works:
        rows = planned(spark, sf_dir)
        _works[key] = written(rows.sortWithinPartitions("publication_year"))
    return _works[key]


def dealt(spark: SparkSession, sf_dir: str) -> int:
    """Tasks that the line items are dealt over."""
    return tasks(spark, read(spark, sf_dir, "lineitem").count())


def planned(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The works as a plan, not a table: a query computes the columns that it reads and shuffles no others.

    Line items are numbered by owner, meet their parts, and are dealt by order once, for its row and for windows over its people.  A part that is missing
    takes its line item's record away, not the owner from the order's people.  Each deal is over ``dealt`` tasks, so that none grows with the tables.
    """
    line, orders, part = (read(spark, sf_dir, t) for t in ("lineitem", "orders", "part"))
    s, nation = read(spark, sf_dir, "supplier"), read(spark, sf_dir, "nation")
    people = s.join(nation, s.s_nationkey == nation.n_nationkey).select("s_suppkey", "s_name", "n_name", (F.col("n_regionkey") == FOCAL_REGION).alias("focal"))
    if s.count() <= BROADCAST_PEOPLE:
        people = F.broadcast(people)
    n = dealt(spark, sf_dir)
    numbered = line.repartition(n, "l_suppkey").withColumn("put_code", F.row_number().over(Window.partitionBy("l_suppkey").orderBy(*LINE)).cast("long"))
    person = F.struct(F.col("s_name").alias("credit_name"), F.lower(F.regexp_replace("s_name", "#", " ")).alias("normalized_name"), F.col("s_suppkey").cast("string").alias("orcid_id"))
    of_order = Window.partitionBy("l_orderkey")
    items = numbered.select("l_orderkey", "l_partkey", "l_suppkey", "l_shipdate", "l_returnflag", "put_code")
    if part.count() <= BROADCAST_PARTS:
        part = F.broadcast(part)
    else:
        items, part = items.repartition(n, "l_partkey"), part.hint("merge")
    full = (
        items.join(part, F.col("l_partkey") == F.col("p_partkey"), "left").repartition(n, "l_orderkey").join(orders.hint("merge"), F.col("l_orderkey") == F.col("o_orderkey")).join(people, F.col("l_suppkey") == F.col("s_suppkey"))
        .withColumn("contributors", F.array_sort(F.collect_set(person).over(of_order))).withColumn("focal_work", F.bool_or("focal").over(of_order))
        .where("p_partkey IS NOT NULL")
    )
    key = F.col("l_orderkey").cast("string")
    return full.select(
        F.col("l_suppkey").cast("string").alias("orcid_id"), "put_code", F.col("p_name").alias("title"), F.col("p_brand").alias("journal_title"), F.year("l_shipdate").alias("publication_year"),
        F.col("o_orderpriority").alias("type"), F.array(F.struct(F.lit("doi").alias("type"), F.concat(F.lit("https://doi.org/10.1/O"), key).alias("value"), F.lit("self").alias("relationship"))).alias("external_ids"),
        "contributors", F.concat(F.lit("doi:"), key).alias("work_key"), F.concat(F.lit("10.1/o"), key).alias("doi"),
        F.transform(F.split("p_name", " "), lambda k: F.struct(k.alias("display_name"))).alias("keywords"),
        F.array(F.struct(F.col("p_type").alias("display_name"), F.struct(F.col("p_type").alias("display_name")).alias("field"))).alias("topics"),
        (F.col("l_returnflag") == "R").alias("is_oa"), F.concat(F.lit("https://example.org/"), F.lower(F.translate("p_brand", "#", "/")), F.lit(".pdf")).alias("oa_url"),
        F.array(F.struct(F.col("n_name").alias("name"))).alias("institutions"), "focal_work", F.size("contributors").alias("author_count"),
    )
