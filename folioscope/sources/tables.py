"""Keyed tables: key-bucketed parts, deltas merged on read, and versions that two writers cannot both take.

``root/parts/<id>/b=<bucket>`` holds the rows of one write, dealt by a hash of the key; ``root/commits/<version>.json`` names the parts that make
up each bucket at that version, oldest first.  A part is a *base* (rows whose keys no older part has) or a *delta* (rows that replace
older ones of their keys, or tombstones).  An update writes its own rows only; ``compact`` folds the deltas of the buckets that have most of them.

A commit is one file that must not exist yet.  A writer that finds its version taken reads the new state and tries again: replacing
rows needs no more than that, an insert or an update that read a bucket which has changed since is computed anew, and a
compaction keeps what came after the parts it folded.  Parts without a commit are no part of the table; ``vacuum`` removes them.

Defined cases: null key fields are equal to each other; of several rows of one key in one write the last by the given columns stays, nulls lowest, then that
with the largest hash of all its values, so a repeated run takes the same; an empty write commits nothing.
"""

from __future__ import annotations

import contextlib
import json
import os
import uuid
from collections.abc import Callable
from functools import reduce
from operator import and_
from urllib.parse import urlparse

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..runtime import written

#: Keys of deltas that are broadcast at most when a table is read; more are met by shuffle.
BROADCAST_KEYS = 200_000
#: Deltas of a bucket from which it is folded, and tries of a writer that others overtake.
MOST_DELTAS, TRIES = 16, 20


class Conflict(RuntimeError):
    """Other writers kept changing what this one had read."""


def same(keys: list[str], prefix: str) -> Column:
    return reduce(and_, [F.col(k).eqNullSafe(F.col(f"{prefix}{k}")) for k in keys])


class Files:
    """What the commits need of a store: list, read, and create a whole file that must not exist."""

    def __init__(self, spark: SparkSession, root: str):
        self.sc, self.root = spark.sparkContext, root
        self.path = self.sc._jvm.org.apache.hadoop.fs.Path
        self.fs = self.path(root).getFileSystem(self.sc._jsc.hadoopConfiguration())
        url = urlparse(str(self.fs.makeQualified(self.path(root)).toString()))
        self.local = url.path if url.scheme == "file" else None

    def names(self, folder: str) -> list[str]:
        where = self.path(f"{self.root}/{folder}")
        return sorted(s.getPath().getName() for s in self.fs.listStatus(where)) if self.fs.exists(where) else []

    def text(self, name: str) -> str:
        stream = self.fs.open(self.path(f"{self.root}/{name}"))
        try:
            return self.sc._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def create(self, name: str, text: str) -> bool:
        """Whether the file was made, with its whole text at once; False if it was there.

        A mounted folder links a finished file to its name; other stores rename one without overwriting, which must be atomic there.
        """
        folder = name.rpartition("/")[0]
        side = f"{folder}/.{uuid.uuid4().hex}"
        if self.local:
            os.makedirs(f"{self.local}/{folder}", exist_ok=True)
            with open(f"{self.local}/{side}", "w") as f:
                f.write(text)
                f.flush()
                os.fsync(f.fileno())
            try:
                os.link(f"{self.local}/{side}", f"{self.local}/{name}")
                return True
            except FileExistsError:
                return False
            finally:
                os.unlink(f"{self.local}/{side}")
        stream = self.fs.create(self.path(f"{self.root}/{side}"), True)
        stream.write(bytearray(text.encode()))
        stream.close()
        jvm = self.sc._jvm
        none = self.sc._gateway.new_array(getattr(jvm.org.apache.hadoop.fs, "Options$Rename"), 1)
        none[0] = getattr(jvm.org.apache.hadoop.fs, "Options$Rename").NONE
        try:
            jvm.org.apache.hadoop.fs.FileContext.getFileContext(self.fs.getUri(), self.sc._jsc.hadoopConfiguration()).rename(self.path(f"{self.root}/{side}"), self.path(f"{self.root}/{name}"), none)
            return True
        except Exception as error:  # noqa: BLE001  the bridge has one class for all
            if "FileAlreadyExists" in str(error):
                self.fs.delete(self.path(f"{self.root}/{side}"), False)
                return False
            raise

    def delete(self, name: str) -> None:
        self.fs.delete(self.path(f"{self.root}/{name}"), True)


class State:
    """One version: for each part its kind and rows, for each bucket its parts, oldest first."""

    def __init__(self, version: int = -1, parts: dict | None = None, buckets: dict | None = None):
        self.version, self.parts, self.buckets = version, parts or {}, buckets or {}

    def copy(self) -> State:
        return State(self.version, dict(self.parts), {b: list(p) for b, p in self.buckets.items()})

    def add(self, part: str, info: dict) -> None:
        self.parts[part] = {k: v for k, v in info.items() if k != "buckets"}
        for b in info["buckets"]:
            self.buckets.setdefault(b, []).append(part)

    def text(self, version: int) -> str:
        used = {p for parts in self.buckets.values() for p in parts}
        return json.dumps({"version": version, "parts": {p: i for p, i in self.parts.items() if p in used}, "buckets": {b: p for b, p in self.buckets.items() if p}})

    def of(self, kind: str) -> dict[str, list[str]]:
        """{part: its live buckets} of the kind."""
        out: dict[str, list[str]] = {}
        for b, parts in sorted(self.buckets.items()):
            for p in parts:
                if self.parts[p]["kind"] == kind:
                    out.setdefault(p, []).append(b)
        return out


class KeyedTable:
    def __init__(self, spark: SparkSession, root: str, schema: str | T.StructType, keys: list[str], *, layout: list[str] | None = None, buckets: int = 16):
        self.spark, self.root, self.keys, self.buckets = spark, root.rstrip("/"), keys, buckets
        self.schema = T._parse_datatype_string(schema) if isinstance(schema, str) else schema
        self.layout = layout or []
        self.files = Files(spark, self.root)

    # Versions

    def versions(self) -> list[int]:
        return [int(n[:-5]) for n in self.files.names("commits") if n.endswith(".json") and not n.startswith(".")]

    def state(self, version: int | None = None) -> State:
        if version is None:
            have = self.versions()
            if not have:
                return State()
            version = have[-1]
        got = json.loads(self.files.text(f"commits/{version:012d}.json"))
        return State(got["version"], got["parts"], got["buckets"])

    def _commit(self, change: Callable[[State], State]) -> int:
        """Make a version of what ``change`` makes of the newest one; again, if another writer takes that version first."""
        for _ in range(TRIES):
            now = self.state()
            new = change(now.copy())
            if self.files.create(f"commits/{now.version + 1:012d}.json", new.text(now.version + 1)):
                return now.version + 1
        raise Conflict(f"{self.root}: {TRIES} versions were taken by others")

    # Reading

    def _rows(self, part: str, buckets: list[str], schema: T.StructType) -> DataFrame:
        folder = f"{self.root}/parts/{part}"
        return self.spark.read.schema(schema).parquet(*(f"{folder}/b={b}" for b in buckets))

    def _empty(self) -> DataFrame:
        return self.spark.createDataFrame([], self.schema)

    def _newest(self, state: State) -> tuple[DataFrame | None, int]:
        """Of each key that deltas have its newest row, with ``_gone`` for a tombstone; and the number of rows in the deltas."""
        found = state.of("delta")
        if not found:
            return None, 0
        place = {p: i for i, p in enumerate(state.parts)}
        schema = T.StructType([*self.schema.fields, T.StructField("_gone", T.BooleanType())])
        each = [self._rows(p, b, schema).withColumn("_seq", F.lit(place[p])) for p, b in found.items()]
        names = [f.name for f in self.schema.fields] + ["_gone"]
        newest = reduce(DataFrame.unionAll, each).groupBy(*(F.col(k).alias(f"_k{i}") for i, k in enumerate(self.keys))).agg(F.max_by(F.struct(*names), "_seq").alias("r"))
        return newest.select("r.*"), sum(state.parts[p]["rows"] for p in found)

    def read(self, version: int | None = None, state: State | None = None) -> DataFrame:
        state = state or self.state(version)
        bases = [self._rows(p, b, self.schema) for p, b in state.of("base").items()]
        base = reduce(DataFrame.unionAll, bases) if bases else self._empty()
        newest, rows = self._newest(state)
        if newest is None:
            return base
        gone = newest.select(*(F.col(k).alias(f"__{k}") for k in self.keys))
        if rows <= BROADCAST_KEYS:
            gone = F.broadcast(gone)
        return base.join(gone, same(self.keys, "__"), "left_anti").unionByName(newest.where("NOT _gone").drop("_gone"))

    def only(self, state: State, rows: DataFrame) -> State:
        """The state without buckets that no key of ``rows`` falls into."""
        mine = {str(r.b) for r in rows.select(self._bucket().alias("b")).distinct().collect()}  # at most the number of buckets
        return State(state.version, state.parts, {b: p for b, p in state.buckets.items() if b in mine})

    # Writing

    def _bucket(self) -> Column:
        return F.pmod(F.xxhash64(*self.keys), F.lit(self.buckets)).cast("int")

    def _fitted(self, rows: DataFrame) -> DataFrame:
        return rows.select(*(F.col(f"`{f.name}`").cast(f.dataType).alias(f.name) for f in self.schema.fields))

    def _single(self, rows: DataFrame, order: list[str]) -> DataFrame:
        """One row of each key."""
        names = [f.name for f in self.schema.fields]
        last = F.struct(*order, F.xxhash64(F.to_json(F.struct(*names))).alias("__h"))
        return rows.groupBy(*(F.col(k).alias(f"_k{i}") for i, k in enumerate(self.keys))).agg(F.max_by(F.struct(*names), last).alias("r")).select("r.*")

    def _put_part(self, rows: DataFrame, kind: str, deletes: bool = False) -> tuple[str, dict] | None:
        part = uuid.uuid4().hex
        folder = f"{self.root}/parts/{part}"
        dealt = rows.withColumn("b", self._bucket()).hint("rebalance", "b")
        dealt.sortWithinPartitions("b", *[c for c in self.layout if c in rows.columns]).write.partitionBy("b").parquet(folder)
        buckets = [n[2:] for n in self.files.names(f"parts/{part}") if n.startswith("b=")]
        if not buckets:
            self.files.delete(f"parts/{part}")
            return None
        n = self.spark.read.parquet(folder).count()  # from the files' footers
        return part, {"kind": kind, "rows": n, "deletes": deletes, "buckets": buckets}

    def _append(self, made: tuple[str, dict] | None, read: State | None = None) -> bool:
        """Commit a part; False if a bucket of it is no longer as ``read``."""
        if made is None:
            return True
        part, info = made

        def change(now: State) -> State:
            if read is not None and any(now.buckets.get(b) != read.buckets.get(b) for b in info["buckets"]):
                raise Conflict
            now.add(part, info)
            return now

        try:
            self._commit(change)
        except Conflict:
            if read is None:
                raise
            self.files.delete(f"parts/{part}")
            return False
        if info["kind"] == "delta" and max(sum(kind == "delta" for kind in kinds) for kinds in self._kinds().values()) >= MOST_DELTAS:
            with contextlib.suppress(Conflict):  # another writer folds the same buckets
                self.compact(MOST_DELTAS // 2)
        return True

    def _kinds(self) -> dict[str, list[str]]:
        state = self.state()
        return {b: [state.parts[p]["kind"] for p in parts] for b, parts in state.buckets.items()}

    def _retried(self, step: Callable[[State], tuple[str, dict] | None]) -> int:
        """Rows that ``step`` wrote on the newest state; computed anew where others changed its buckets meanwhile."""
        for _ in range(TRIES):
            read = self.state()
            made = step(read)
            if self._append(made, read):
                return made[1]["rows"] if made else 0
        raise Conflict(f"{self.root}: others kept changing the rows")

    def replace(self, rows: DataFrame) -> int:
        """All rows anew, one of each key; returns their number."""
        made = self._put_part(self._single(self._fitted(rows), []), "base")

        def change(now: State) -> State:
            new = State(now.version)
            if made:
                new.add(*made)
            return new

        self._commit(change)
        return made[1]["rows"] if made else 0

    def put(self, rows: DataFrame, order: list[str] | None = None) -> int:
        """Rows replace those of their keys; returns how many were written."""
        delta = self._single(self._fitted(rows), order or []).withColumn("_gone", F.lit(False))
        made = self._put_part(delta, "delta")
        self._append(made)
        return made[1]["rows"] if made else 0

    def delete(self, keys: DataFrame) -> int:
        """Tombstones for keys that are there."""

        def step(read: State):
            mine = keys.select(*(F.col(k).alias(f"__{k}") for k in self.keys)).distinct()
            return self._put_part(self.read(state=read).join(mine, same(self.keys, "__"), "left_semi").withColumn("_gone", F.lit(True)), "delta", deletes=True)

        return self._retried(step)

    def insert_new(self, rows: DataFrame, order: list[str] | None = None) -> int:
        """Rows whose keys are not there yet, once each; returns their number."""
        some = written(self._single(self._fitted(rows), order or []))

        def step(read: State):
            old = self.read(state=self.only(read, some)).select(*(F.col(k).alias(f"__{k}") for k in self.keys))
            new = some.join(old, same(self.keys, "__"), "left_anti")
            # Behind a tombstone a base row would be hidden.
            if any(i.get("deletes") for i in read.parts.values()):
                return self._put_part(new.withColumn("_gone", F.lit(False)), "delta")
            return self._put_part(new, "base")

        return self._retried(step)

    def update(self, changes: DataFrame) -> int:
        """``changes`` holds the keys and new values of some columns; rows that differ are written, others and unknown keys are not."""
        changes = written(changes)
        columns = [c for c in changes.columns if c not in self.keys]
        names = [f.name for f in self.schema.fields]
        new = changes.select(*(F.col(c).alias(f"__{c}") for c in changes.columns))
        new = new.groupBy(*(f"__{k}" for k in self.keys)).agg(F.max_by(F.struct(*(f"__{c}" for c in columns)), F.xxhash64(F.to_json(F.struct(*(f"__{c}" for c in columns))))).alias("r"))
        new = new.select(*(f"__{k}" for k in self.keys), "r.*")

        def step(read: State):
            met = self.read(state=self.only(read, changes)).join(new, same(self.keys, "__"))
            kinds = {f.name: f.dataType for f in self.schema.fields}
            differs = reduce(lambda a, b: a | b, [~F.col(c).eqNullSafe(F.col(f"__{c}").cast(kinds[c])) for c in columns])
            values = [F.col(f"__{n}").cast(kinds[n]).alias(n) if n in columns else F.col(n) for n in names]
            return self._put_part(met.where(differs).select(*values).withColumn("_gone", F.lit(False)), "delta")

        return self._retried(step)

    def compact(self, deltas: int = 1) -> int:
        """Fold the buckets that have at least so many deltas, each into a base of its own; returns the number of buckets."""
        read = self.state()
        many = {b: parts for b, parts in read.buckets.items() if sum(read.parts[p]["kind"] == "delta" for p in parts) >= deltas}
        if not many:
            return 0
        made = self._put_part(self.read(state=State(read.version, read.parts, many)), "base")

        def change(now: State) -> State:
            for b, folded in many.items():
                if now.buckets.get(b, [])[: len(folded)] != folded:
                    raise Conflict(f"{self.root}: bucket {b} was rewritten by another")
                rest = now.buckets[b][len(folded) :]
                now.buckets[b] = ([made[0]] if made and b in made[1]["buckets"] else []) + rest
            if made:
                # Older parts come first, also in the order of parts.
                now.parts = {made[0]: {k: v for k, v in made[1].items() if k != "buckets"}, **now.parts}
            return now

        self._commit(change)
        return len(many)

    def vacuum(self, keep: int = 1) -> int:
        """Delete all but the last ``keep`` versions and the parts that none of them names; not beside running writers."""
        have = self.versions()
        for v in have[:-keep]:
            self.files.delete(f"commits/{v:012d}.json")
        used = {p for v in have[-keep:] for p in self.state(v).parts}
        gone = [p for p in self.files.names("parts") if p not in used]
        for p in gone:
            self.files.delete(f"parts/{p}")
        return len(gone)
