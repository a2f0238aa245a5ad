"""Keyed tables, discovery and enrichment at volume: versions, deltas, writers side by side, crashes."""

import json
import os
import random
import threading
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from folioscope.sources import registry
from folioscope.sources.catalog import Catalog
from folioscope.sources.tables import Conflict, KeyedTable, State

SCHEMA = "k string, j long, v string, n long"


def table(spark, tmp_path, **options):
    return KeyedTable(spark, f"file://{tmp_path}/t", SCHEMA, ["k", "j"], buckets=4, **options)


def rows(spark, some):
    return spark.createDataFrame(some, SCHEMA)


def content(t, version=None):
    got = [tuple(r) for r in t.read(version).collect()]
    assert len({r[:2] for r in got}) == len(got)  # a key once
    return {r[:2]: r[2:] for r in got}


def test_keyed_table_follows_a_dictionary(spark, tmp_path):
    t, model, r, history = table(spark, tmp_path, layout=["v"]), {}, random.Random(2), {}
    key = lambda: (r.choice(["a", "b", "c", None]), r.choice([1, 2, 3, 4, None]))
    for turn in range(9):
        keys = list({key() for _ in range(r.randint(1, 6))})
        step = ["put", "insert", "delete", "update", "put", "compact", "put", "replace", "insert"][turn]
        if step == "put":
            t.put(rows(spark, [(*k, f"v{turn}", turn) for k in keys]))
            model |= {k: (f"v{turn}", turn) for k in keys}
        elif step == "insert":
            new = {k for k in keys if k not in model}
            assert t.insert_new(rows(spark, [(*k, f"i{turn}", turn) for k in keys for _ in range(2)])) == len(new)
            model |= {k: (f"i{turn}", turn) for k in new}
        elif step == "delete":
            assert t.delete(spark.createDataFrame(keys, "k string, j long")) == len(model.keys() & set(keys))
            model = {k: v for k, v in model.items() if k not in keys}
        elif step == "update":
            changed = {k for k in keys if k in model and model[k][1] != 7}
            assert t.update(spark.createDataFrame([(*k, 7) for k in keys], "k string, j long, n int")) == len(changed)
            model |= {k: (model[k][0], 7) for k in changed}
        elif step == "compact":
            t.compact()
            assert all(kind == "base" for kinds in t._kinds().values() for kind in kinds)
        else:
            t.replace(rows(spark, [(*k, *v) for k, v in list(model.items())[:3]]))
            model = dict(list(model.items())[:3])
        assert content(t) == model
        if t.versions():
            history[t.versions()[-1]] = dict(model)
    for v in list(history)[-2:]:
        assert content(t, v) == history[v]  # older versions stay readable
    assert t.vacuum() > 0 and content(t) == model


def test_last_row_of_a_key_and_empty_writes(spark, tmp_path):
    t = table(spark, tmp_path)
    assert t.read().count() == 0 and t.put(rows(spark, [])) == 0 and t.insert_new(rows(spark, [])) == 0 and t.versions() == []
    t.put(rows(spark, [("a", 1, "old", 1), ("a", 1, "new", 3), ("a", 1, "none", None)]), ["n"])
    assert content(t) == {("a", 1): ("new", 3)}
    t.put(rows(spark, [("b", 1, "x", 5), ("b", 1, "y", 5)] * 3), ["n"])
    first = content(t)[("b", 1)]
    t.put(rows(spark, [("b", 1, "y", 5), ("b", 1, "x", 5)]).repartition(2), ["n"])
    assert content(t)[("b", 1)] == first  # ties do not depend on order


def size(folder):
    return sum(p.stat().st_size for p in Path(folder).rglob("*.parquet"))


def test_an_update_writes_its_own_rows(spark, tmp_path):
    t = table(spark, tmp_path)
    t.replace(spark.range(200_000).select(F.col("id").cast("string").alias("k"), F.col("id").alias("j"), F.sha2(F.col("id").cast("string"), 256).alias("v"), F.col("id").alias("n")))
    whole = size(tmp_path)
    one_percent = spark.range(0, 200_000, 100).select(F.col("id").cast("string").alias("k"), F.col("id").alias("j"), F.lit(-1).alias("n"))
    assert t.update(one_percent) == 2000 and t.update(one_percent) == 0
    assert size(tmp_path) - whole < 0.03 * whole
    assert t.read().where("n = -1").count() == 2000 and t.read().count() == 200_000


def test_writers_side_by_side(spark, tmp_path):
    t, failed, inserted = table(spark, tmp_path), [], []

    def work(i):
        try:
            mine = table(spark, tmp_path)
            mine.put(rows(spark, [("w", i * 10 + n, f"{i}", n) for n in range(5)]))
            inserted.append(mine.insert_new(rows(spark, [("same", n, f"{i}", n) for n in range(20)])))
            mine.update(spark.createDataFrame([("w", i * 10 + n, 100) for n in range(5)], "k string, j long, n long"))
        except Exception as error:  # noqa: BLE001
            failed.append(error)

    threads = [threading.Thread(target=work, args=(i,)) for i in range(3)]
    for x in threads:
        x.start()
    for x in threads:
        x.join()
    assert not failed and sum(inserted) == 20
    got = content(t)
    assert {k: v for k, v in got.items() if k[0] == "w"} == {("w", i * 10 + n): (f"{i}", 100) for i in range(3) for n in range(5)}
    assert sum(k[0] == "same" for k in got) == 20
    assert t.versions() == list(range(len(t.versions())))


def test_a_version_is_taken_once(spark, tmp_path, monkeypatch):
    t = table(spark, tmp_path)
    t.put(rows(spark, [("a", 1, "x", 1)]))
    assert not t.files.create("commits/000000000000.json", "{}") and t.files.text("commits/000000000000.json") != "{}"
    stale = t.state()
    t.put(rows(spark, [("a", 1, "y", 2)]))
    # A compaction of what another has rewritten meanwhile is given up; a put on stale knowledge lands on top.
    t.compact()
    with pytest.raises(Conflict):
        monkeypatch.setattr(KeyedTable, "state", lambda self, version=None, real=KeyedTable.state, n=iter([stale]): next(n, None) or real(self, version))
        t.compact()
    monkeypatch.undo()
    assert content(t) == {("a", 1): ("y", 2)}
    monkeypatch.setattr(KeyedTable, "versions", lambda self: [0])
    with pytest.raises(Conflict):
        t.put(rows(spark, [("a", 1, "z", 3)]))
    monkeypatch.undo()
    assert content(t) == {("a", 1): ("y", 2)}


def test_many_deltas_are_folded(spark, tmp_path, monkeypatch):
    from folioscope.sources import tables

    monkeypatch.setattr(tables, "MOST_DELTAS", 3)
    t = table(spark, tmp_path)
    for i in range(4):
        t.put(rows(spark, [("a", n, f"{i}", i) for n in range(8)]))
        assert max(kinds.count("delta") for kinds in t._kinds().values()) < 3
    assert content(t) == {("a", n): ("3", 3) for n in range(8)}
    assert t.only(t.state(), rows(spark, [("a", 1, "", 0)])).buckets.keys() < State(0, {}, t.state().buckets).buckets.keys()



def results(query):
    """A registry whose names are thick under b: every second-level prefix has results, some too many."""
    prefix = query.rpartition(":")[2].rstrip("*")
    if len(prefix) == 1:
        return {"a": 2500, "b": 90_000}.get(prefix, 20_000 if prefix > "b" else 0)
    if len(prefix) == 2:
        return 0 if prefix[1] in "xyz" else 15_000 if prefix == "bb" else 900
    return 1001 if prefix < "bbn" else 0


def page(query, start, n):
    return json.dumps({"ids": [f"{query.rpartition(':')[2]}{i}" for i in range(start, start + n)][:2], "n": n})


def test_discovery_takes_one_job_a_depth(spark, tmp_path):
    catalog, levels = Catalog(spark, f"file://{tmp_path}/c"), []
    kept = str(tmp_path / "pages")

    def save(pages):
        pages.write.mode("append").parquet(kept)
        levels.append(pages.count())

    found = registry.Discovery(catalog, results, page, save)
    found.seed("q")
    found.seed("q")
    before = len(catalog.versions("partitions"))
    n = found.run()
    want = registry.plan_partitions("q", lambda p: results(p.query()))
    assert n == len(want) and len(levels) == 3
    got = spark.read.parquet(kept)
    assert {r.prefix for r in got.select("prefix").distinct().collect()} == {p.prefix for p in want}
    assert got.count() == sum(len(list(registry.pages(results(p.query())))) for p in want)
    # 26, 650 and 26 prefixes: a claim and a write of states each, whatever their number.
    assert len(catalog.versions("partitions")) - before == 2 * 3
    assert catalog.read("partitions").where("status <> 'done'").count() == 0
    assert catalog.read("partitions").count() == 26 + 25 * 26 + 26


@pytest.mark.parametrize("crash", ["states"])
def test_discovery_resumes_after_a_crash(spark, tmp_path, crash, monkeypatch):
    catalog, kept, broken = Catalog(spark, f"file://{tmp_path}/c"), set(), [True]

    def save(pages):
        kept.update((r.prefix, r.page) for r in pages.collect())
        if crash == "save" and broken and len(kept) > 5:
            broken.clear()
            raise OSError("driver lost")

    found = registry.Discovery(catalog, results, page, save)
    found.seed("q")
    if crash == "states":
        real = Catalog.upsert
        monkeypatch.setattr(Catalog, "upsert", lambda self, name, some: (_ for _ in ()).throw(OSError("driver lost")) if kept and len(kept) > 5 else real(self, name, some))
    with pytest.raises(OSError):
        found.run()
    monkeypatch.undo()
    assert catalog.read("partitions").where("status = 'processing'").count() > 0
    again = registry.Discovery(Catalog(spark, f"file://{tmp_path}/c"), results, page, save)
    assert again.resume() > 0
    again.run()
    want = registry.plan_partitions("q", lambda p: results(p.query()))
    assert {p for p, _ in kept} == {p.prefix for p in want}
    assert catalog.read("partitions").where("status <> 'done'").count() == 0


def test_enrichment_writes_do_not_grow_with_tasks(spark, tmp_path):
    def fetch(dois):
        if "10.1/777" in dois:
            raise OSError("down")
        return [json.dumps({"id": "W", "doi": f"https://doi.org/{d.upper()}"}) for d in dois if not d.endswith("5")]

    writes = []
    for n in (1000, 30_000):
        catalog = Catalog(spark, f"file://{tmp_path}/{n}")
        tasks = spark.range(n).select(F.concat(F.lit("10.1/"), "id").alias("doi"), F.lit("e").alias("source"), F.lit("pending").alias("status"), F.lit(0).alias("attempts"), F.timestamp_seconds("id").alias("created_at"))
        catalog.write("metadata_queue", tasks)
        before = {t: len(catalog.versions(t)) for t in ("metadata_queue", "works_metadata")}
        got = registry.enrich(catalog, "e", fetch)
        failed = catalog.read("metadata_queue").where("status = 'failed'")
        lost = failed.where("NOT doi LIKE '%5'").count()
        assert got == {"done": n - n // 10 - lost, "failed": n // 10 + lost} and 0 < lost < 25  # the request of 777 alone
        assert failed.where("attempts <> 1").count() == 0 and catalog.read("works_metadata").count() == got["done"]
        writes.append({t: len(catalog.versions(t)) - v for t, v in before.items()})
    assert writes[0] == writes[1] == {"metadata_queue": 2, "works_metadata": 1}


def test_a_lost_harvest_is_reopened(spark, tmp_path, monkeypatch):
    catalog = Catalog(spark, f"file://{tmp_path}/c")
    catalog.write("metadata_queue", spark.range(60).select(F.concat(F.lit("10.1/"), "id").alias("doi"), F.lit("e").alias("source"), F.lit("pending").alias("status"), F.lit(0).alias("attempts"), F.current_timestamp().alias("created_at")))
    fetch = lambda dois: [json.dumps({"id": "W", "doi": d}) for d in dois]
    real = Catalog.upsert
    monkeypatch.setattr(Catalog, "upsert", lambda *a: (_ for _ in ()).throw(OSError("driver lost")))
    with pytest.raises(OSError):
        registry.enrich(catalog, "e", fetch)
    monkeypatch.setattr(Catalog, "upsert", real)
    assert registry.enrich(catalog, "e", fetch) == {"done": 0, "failed": 0}  # only pending tasks are taken
    assert registry.reopen(catalog, "e") == 60 and registry.enrich(catalog, "e", fetch, most=25) == {"done": 60, "failed": 0}
    assert os.listdir(tmp_path / "c")
