"""URL filters: host-suffix and path-prefix expressions, joined to rules on short digest prefixes.

Each URL is expanded into the expressions that a rule could have: the last k labels of its host, for each
number of labels k that a rule has, with the first n characters of its path, for each length n that the paths of such
rules have.  This is exact for rules that are plain string prefixes; a URL has at most as many expressions as it has host labels
times path characters, and the plan holds the lengths as one array for each k.  Expressions meet rules on the first
bytes of their SHA-256; full digests and texts confirm; the longest rule wins (ties: the longer host, then block before allow).

Rules are broadcast up to ``BROADCAST_RULES``; more are joined by shuffle, with a salt, as one rule may fit a third of all pages.

Defined cases: a null URL or one without ``://`` has an empty host and path and fits no rule; repeated
rows give repeated results; no rules leave every verdict to ``default``; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: (verdict, host, path)
RULES = (("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"), ("allow", "com", "/fr/"), ("block", "com", "/de/"))
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Rules up to this many are broadcast; more are joined by shuffle.
BROADCAST_RULES = 100_000
SALTS = 16


def host_of(url: Column) -> Column:
    rest = F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)
    return F.coalesce(F.translate(rest, UPPER, LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_table(spark, rules=RULES) -> DataFrame:
    return spark.createDataFrame(list(rules), "verdict string, host string, path string")


def filter_urls(pages: DataFrame, rules: DataFrame, *, default: str = "allow", prefix_bytes: int = 4) -> DataFrame:
    """Per page: page_id, host, path, rule (null: none), verdict."""
    digest = F.sha2(F.concat_ws("\n", "host", "path"), 256)
    table = rules.select(
        F.col("verdict").alias("rule_verdict"),
        F.col("host").alias("rule_host"),
        F.col("path").alias("rule_path"),
        digest.alias("rule_digest"),
        F.substring(digest, 1, 2 * prefix_bytes).alias("short"),
    )
    parts = pages.select("page_id", "url").withColumns({"host": host_of(F.col("url")), "path": path_of(F.col("url"))})
    # Path lengths by the number of host labels: bounded by the lengths of hosts and paths, not by rules or pages.
    shapes: dict[int, list[int]] = {}
    for r in rules.select(F.size(F.split("host", r"\.")).alias("k"), F.length("path").alias("n")).where("n IS NOT NULL AND k > 0").distinct().orderBy("k", "n").collect():
        shapes.setdefault(r.k, []).append(r.n)
    labels = F.split("host", r"\.")

    def expanded(k: int, lengths: list[int]) -> Column:
        suffix = F.array_join(F.slice(labels, -k, k), ".")
        fits = F.filter(F.array(*map(F.lit, lengths)), lambda n: n <= F.length("path"))
        return F.when(F.size(labels) >= k, F.transform(fits, lambda n: F.struct(suffix.alias("h"), F.substring(F.col("path"), F.lit(1), n).alias("p"))))

    best = "struct<size: int, host_size: int, blocks: int, rule: string, verdict: string>"
    own = parts.select("page_id", "url", "host", "path", F.lit(True).alias("own"), F.lit(None).cast(best).alias("best"))
    if shapes:
        every = F.flatten(F.filter(F.array(*(expanded(k, n) for k, n in shapes.items())), lambda x: x.isNotNull()))
        wide = parts.select("page_id", "url", "host", "path", F.explode(every).alias("e"))
        wide = wide.withColumn("digest", F.sha2(F.concat_ws("\n", F.col("e.h"), F.col("e.p")), 256)).withColumn("short", F.substring("digest", 1, 2 * prefix_bytes))
        if rules.count() <= BROADCAST_RULES:
            met = wide.join(F.broadcast(table), "short")
        else:
            salted = table.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
            met = wide.withColumn("salt", F.pmod(F.xxhash64("page_id", "url"), F.lit(SALTS)).cast("int")).join(salted, ["short", "salt"])
        sure = met.where((F.col("digest") == F.col("rule_digest")) & (F.col("e.h") == F.col("rule_host")) & (F.col("e.p") == F.col("rule_path")))
        found = F.struct(
            (F.length("rule_host") + F.length("rule_path")).alias("size"), F.length("rule_host").alias("host_size"), F.when(F.col("rule_verdict") == "block", 1).otherwise(0).alias("blocks"),
            F.concat("rule_host", "rule_path").alias("rule"), F.col("rule_verdict").alias("verdict"),
        )
        own = own.unionAll(sure.select("page_id", "url", "host", "path", F.lit(False), found.cast(best)))
    # Equal rows are judged once and counted; the count brings them back.
    judged = own.groupBy("page_id", "url", "host", "path").agg(F.max("best").alias("best"), F.count_if("own").cast("int").alias("n"))
    once = judged.select("page_id", "host", "path", F.col("best.rule").alias("rule"), F.coalesce("best.verdict", F.lit(default)).alias("verdict"), "n")
    return once.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("n")))).drop("copy", "n")


ORACLE = """
WITH p AS (
  SELECT page_id, coalesce(translate(regexp_extract(url, '^.*?://([^/?#]*)', 1, 's'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS host,
    coalesce(regexp_extract(url, '^.*?://[^/?#]*([^?#]*)', 1, 's'), '') AS path FROM pages),
r(verdict, h, p) AS (VALUES {rules}),
m AS (
  SELECT page_id, max_by(h || r.p, length(h) + length(r.p)) AS rule, max_by(verdict, length(h) + length(r.p)) AS verdict
  FROM p JOIN r ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, r.p) GROUP BY page_id)
SELECT page_id, host, path, rule, coalesce(verdict, 'allow') AS verdict FROM p LEFT JOIN m USING (page_id)
""".format(rules=", ".join(str(r) for r in RULES))
