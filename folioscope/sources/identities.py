"""Work keys of a growing collection: a new batch replays only the components that it touches.

Beside each record the store keeps its component, and the touch points by which others can meet it (identifiers, groups, titles, character
marks of long titles, its own code).  A batch finds the records that share a touch point with it, takes their whole components, and resolves them together with the
batch.  No rule and no name reaches across components, so the result is that of all records at once.

Touch points are written before records, and a batch may be added again: a crash between the two leaves points of records that are not there, which meet nothing.

Defined cases: a record that is sent again replaces its old form, and what the old form was joined with is resolved anew; of several rows of one record
in a batch the last by hash stays; an empty batch changes nothing.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import schemas
from ..operators import identity
from ..runtime import written
from .tables import KeyedTable

INPUT = f"record_id string, orcid_id string, put_code long, publication_year int, title string, doi string, external_ids array<{schemas.EXTERNAL_ID}>, orcid_group string"
COLUMNS = ["record_id", "orcid_id", "put_code", "publication_year", "title", "doi", "external_ids", "orcid_group"]


class Identities:
    def __init__(self, spark: SparkSession, root: str, buckets: int = 16):
        self.records = KeyedTable(spark, f"{root}/records", f"{INPUT}, work_key string, component string", ["record_id"], buckets=buckets)
        self.points = KeyedTable(spark, f"{root}/points", "touch long, record_id string", ["touch", "record_id"], layout=["touch"], buckets=buckets)

    def keys(self) -> DataFrame:
        return self.records.read().select("record_id", "work_key")

    def add(self, works: DataFrame) -> dict:
        """Resolve a batch of records; returns how many are in it, were resolved with it, and have a new or another key."""
        batch = written(self.records._single(works.select(*COLUMNS, F.lit(None).alias("work_key"), F.lit(None).alias("component")).transform(self.records._fitted), []).select(COLUMNS))
        mine = written(identity.touch_points(written(identity.prepared(batch))))
        stored, known = self.records.read(), self.points.read()
        again = stored.join(batch.select("record_id"), "record_id", "left_semi")
        stale = known.join(again.select("record_id"), "record_id", "left_semi").join(mine, ["touch", "record_id"], "left_anti")
        met = known.join(mine.select("touch").distinct(), "touch", "left_semi").select("record_id").unionAll(batch.select("record_id")).distinct()
        touched = stored.join(met, "record_id", "left_semi").select("component").distinct()
        whole = written(stored.join(touched, "component", "left_semi"))
        beside = whole.join(batch.select("record_id"), "record_id", "left_anti")
        every = written(batch.unionByName(beside.select(COLUMNS)))
        found = identity.resolved(every)
        old = whole.select("record_id", F.col("work_key").alias("__key"), F.col("component").alias("__component"))
        fresh = batch.select("record_id", F.lit(True).alias("__sent"))
        out = written(every.join(found, "record_id").join(old, "record_id", "left").join(fresh, "record_id", "left"))
        changed = out.where("__sent OR NOT (work_key <=> __key) OR NOT (component <=> __component)")
        self.points.delete(written(stale))
        self.points.insert_new(mine)
        self.records.put(changed.select(*COLUMNS, "work_key", "component"))
        return {"batch": batch.count(), "resolved": every.count(), "renamed": out.where("NOT (work_key <=> __key)").count()}
