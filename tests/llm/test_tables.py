"""URL filters, mixing, components and the pipeline against plain Python."""

import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from folioscope.llm import components, mixing, url_filter

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def brute_url(url, rules):
    host = path = ""
    if url is not None and "://" in url:
        rest = url.split("://", 1)[1]
        host = re.match(r"[^/?#]*", rest)[0]
        path = re.match(r"[^?#]*", rest[len(host) :])[0]
        host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in host)
    fits = [(len(h) + len(p), len(h), v == "block", h + p, v) for v, h, p in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
    best = max(fits, default=None)
    return host, path, best[3] if best else None, best[4] if best else "allow"


@pytest.mark.parametrize("broadcast", [100_000, 0])
def test_url_filter(spark, monkeypatch, broadcast):
    monkeypatch.setattr(url_filter, "BROADCAST_RULES", broadcast)
    r = random.Random(3)
    urls = [None, "", "no scheme.org/x", "http://", "https://org/", "http://ORG/es/", "ftp://a.example.org", "x://b.Example.ORG/es/q?z#y", "http://example.org?u=http://com/de/", "http://notexample.org/es/", "http://a.com/fr", "http://a.com/fr/\nq", "y" * 20_000 + "://com/de/" + "z" * 20_000]
    urls += [f"http://{r.choice(['www.', '', 'm.a.'])}{r.choice(['example', 'x'])}.{r.choice(['org', 'com', 'net'])}{r.choice(['', '/', '/es/1', '/en/1x', '/en/2', '/fr/a', '/de/'])}" for _ in range(200)]
    rows = [(i, u, "host", "path") for i, u in enumerate(urls)] + [(7, urls[7], "a", "b")] * 2
    pages = spark.createDataFrame(rows, "page_id long, url string, digest string, html string")
    out = Counter(tuple(x) for x in url_filter.filter_urls(pages, url_filter.rule_table(spark)).collect())
    assert out == Counter((i, *brute_url(u, url_filter.RULES)) for i, u, *_ in rows)
    assert not url_filter.filter_urls(pages, url_filter.rule_table(spark).limit(0)).where("verdict <> 'allow'").count()
    assert url_filter.filter_urls(pages.limit(0), url_filter.rule_table(spark)).count() == 0


def test_targets():
    t = mixing.targets({"b": 100, "a": 10, None: 50})
    assert t["a"] == 20 and sum(t.values()) == pytest.approx(240) and t[None] == 100 and t["b"] == pytest.approx(120)
    assert mixing.targets({}) == {} and mixing.targets({"a": 0}) == {"a": 0}


def brute_mix(rows, goal, hashes):
    """Each source's rows in hash order, twice over; the finish times of all, in order, up to the sum of the targets."""
    queue = []
    for s in goal:
        mine = sorted((hashes[i], i) for i, r in enumerate(rows) if r[3] == s and len((r[1] or "").split()))
        upto = 0
        for turn in range(2):
            for h, i in mine:
                upto += len(rows[i][1].split())
                queue.append((upto / goal[s], h, turn, i))
    taken, left = Counter(), sum(goal.values()) * (1 + 1e-12)
    for _, _, _, i in sorted(queue):
        size = len(rows[i][1].split())
        if size > left:
            break
        left -= size
        taken[i] += size
    return taken


@pytest.mark.parametrize("limits, sources", [({}, 20_000), ({"bucket_rows": 8, "bins": 4, "exact": 3}, 20_000), ({}, 0)])
def test_mixing(spark, monkeypatch, limits, sources):
    monkeypatch.setattr(mixing, "BROADCAST_SOURCES", sources)
    r = random.Random(6)
    rows = [(i, " ".join(["w"] * r.choice([0, 1, 5, 40, 300])), "en", r.choice(["a", "b", "b", "c", "d", None]), 1) for i in range(400)]
    rows += [(500, None, "en", "a", 1), rows[3], rows[3], (501, "", "en", "silent", 1), (502, None, "en", "silent", 1)]
    docs = spark.createDataFrame(rows, SCHEMA).withColumn("size", F.lit("clash"))
    out = mixing.mix(docs, **limits).collect()
    assert Counter((x.doc_id, x.size) for x in out) == Counter((i, len((t or "").split())) for i, t, *_ in rows)
    sizes = Counter()
    for i, t, _, s, _ in rows:
        sizes[s] += len((t or "").split())
    goal = mixing.targets(dict(sizes))
    source = {i: s for i, _, _, s, _ in rows}
    taken = Counter()
    for x in out:
        assert x.source_size == sizes[source[x.doc_id]] and x.target == pytest.approx(goal[source[x.doc_id]])
        assert 0 <= x.taken <= 2 * x.size and (x.size == 0 or x.taken % x.size == 0)
        taken[source[x.doc_id]] += x.taken
    assert all(abs(taken[s] - goal[s]) <= 300 for s in goal) and sum(taken.values()) <= sum(goal.values()) + 1
    hashes = [x.h for x in spark.createDataFrame([(n, *r) for n, r in enumerate(rows)], "n long, " + SCHEMA).select("n", F.xxhash64(F.lit("mix"), "doc_id", "text", "source").alias("h")).orderBy("n").collect()]
    want, chosen = Counter(), brute_mix(rows, goal, hashes)
    for i, row in enumerate(rows):
        want[(row[0], chosen[i])] += 1
    assert Counter((x.doc_id, x.taken) for x in out) == want
    again = mixing.mix(docs.repartition(7), **limits).collect()
    assert Counter((x.doc_id, x.taken) for x in again) == Counter((x.doc_id, x.taken) for x in out)
    assert mixing.mix(docs.limit(0)).count() == 0
    mixed = mixing.take_mix(docs)
    assert set(docs.columns) < set(mixed.columns) and mixed.where("mix_copies < 1").count() == 0


def test_components(spark):
    r = random.Random(9)
    edges = [(r.randrange(400), r.randrange(400)) for _ in range(220)] + [(i, i + 1) for i in range(1000, 1100)] + [(2000, 2000 + i) for i in range(1, 50)]
    parent = {x: x for e in edges for x in e}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        x, y = root(a), root(b)
        parent[max(x, y)] = min(x, y)
    got = {x.node: x.root for x in components.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {x: root(x) for x in parent if sum(root(y) == root(x) for y in parent) > 1}
    assert components.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_pipeline(spark, tmp_path):
    import corpus_pipeline
    from folioscope.llm import decontaminate, line_dedup, simhash, toxicity

    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    rows = docs
    for name, stage in corpus_pipeline.STAGES:
        before, rows = rows, stage(spark, rows, sf)
        if name != "mix":
            assert rows.columns == docs.columns
        rows.write.parquet(str(tmp_path / name))
        rows = spark.read.parquet(str(tmp_path / name))
        if name == "toxicity":
            bad = toxicity.score(before, toxicity.fit(before, spark.read.parquet(f"{sf}/labels.parquet"))).where("predicted = 1").select("doc_id")
            assert rows.join(bad, "doc_id").count() == 0 and rows.count() + bad.count() == before.count()
        elif name == "line_dedup":
            assert rows.count() == before.count() and line_dedup.dedup_lines(before).exceptAll(line_dedup.dedup_lines(before)).count() == 0
        elif name == "near_dedup":
            assert rows.count() == simhash.near_duplicates(before).select("component_id").distinct().count()
        elif name == "decontaminate":
            assert rows.count() == decontaminate.scan(before, spark.read.parquet(f"{sf}/benchmark.parquet")).where("NOT contaminated").count()
    assert rows.where("mix_taken > 0").count() == rows.count() > 0


def test_targets_of_many_sources(spark):
    r = random.Random(7)
    sizes = {f"s{i}": int(r.paretovariate(0.7) * 10) for i in range(500)} | {None: 77, "": 5, "é": 0}
    got = {x.source: x.target for x in mixing.goals(spark.createDataFrame(list(sizes.items()), "source string, s long")).collect()}
    want = mixing.targets(sizes)
    assert got.keys() == want.keys() and all(got[s] == pytest.approx(want[s], rel=1e-12) for s in want)
    assert mixing.goals(spark.createDataFrame([], "source string, s long")).count() == 0


def test_pipeline_of_odd_rows(spark, tmp_path):
    """Nulls, empty and long texts, repeats, clashing columns and an empty table, against the stages by hand."""
    import corpus_pipeline

    r = random.Random(31)
    words = ["".join(r.choice("abcdefgh") for _ in range(r.randint(2, 8))) for _ in range(400)]
    text = lambda n: " ".join(r.choice(words) for _ in range(n))
    item, menu = text(30), "home about contact imprint"
    clean = [(i, f"{text(60)}\n{menu}\n{text(20)}", "en", f"s{i % 3}", 1) for i in range(60)]
    odd = [(None, None, "en", "s0", 0), (100, "", "en", None, 0), (101, text(8000), "en", "s1", 1), (None, text(50), None, "s2", 1), (None, text(50), "en", None, 1), clean[3], clean[4], clean[4]]
    copy = [(200, clean[7][1], "en", "s1", 1), (7, text(70), "en", "s1", 1)]
    dirty = [(300, f"{text(20)} {item} {text(10)}", "en", "s1", 1), (None, f"{item} {text(10)}", "en", "s0", 1)]
    toxic = [(400 + i, f"{text(12)} scumbag moronic {text(9)}", "en", "s1", 1) for i in range(40)]
    rows = [(*x, f"clash{i}", i, None, "w", 5) for i, x in enumerate(clean + odd + copy + dirty + toxic)]
    rows[-1] = (*rows[-1][:5], "same", 1, None, "w", 5)
    schema = SCHEMA + ", mix_taken string, size int, rid long, win string, __kept int"
    spark.createDataFrame(rows, schema).write.parquet(str(tmp_path / "sf" / "documents.parquet"))
    marks = [(i, 1, int(i >= 400)) for i in [*range(60), *range(400, 440)]]
    spark.createDataFrame(marks, "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "sf" / "labels.parquet"))
    spark.createDataFrame([(1, item), (None, text(40)), (2, None)], "item_id long, text string").write.parquet(str(tmp_path / "sf" / "benchmark.parquet"))
    out = corpus_pipeline.run(spark, str(tmp_path / "sf"))
    assert len(out.columns) == len(set(out.columns)) and set(out.columns) == {*[c.split()[0] for c in schema.split(", ")], "mix_copies"}
    got = out.collect()
    bare = lambda t: t.replace(f"\n{menu}\n", "\n")
    want = {bare(t) for _, t, *_ in clean} | {odd[2][1], odd[3][1], odd[4][1], copy[1][1]}
    # The mix may leave out or repeat whole documents; all that it takes came through the stages, once each.
    assert len({x.text for x in got}) == len(got) and {x.text for x in got} <= want and len(got) > 0.8 * len(want)
    kept = spark.createDataFrame(rows, schema)
    for _, stage in corpus_pipeline.STAGES[:-1]:
        kept = stage(spark, kept, str(tmp_path / "sf"))
        kept.write.mode("overwrite").parquet(str(tmp_path / "x"))
        kept = spark.createDataFrame(spark.read.parquet(str(tmp_path / "x")).collect(), schema)
    assert Counter(x.text for x in kept.collect() if x.text) == Counter(want) and sum(not x.text for x in kept.collect()) == 1
    none = tmp_path / "none"
    for t in ("documents", "labels", "benchmark"):
        spark.read.parquet(str(tmp_path / "sf" / f"{t}.parquet")).limit(0).write.parquet(str(none / f"{t}.parquet"))
    assert corpus_pipeline.run(spark, str(none)).count() == 0
