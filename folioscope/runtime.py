"""Session helpers: package shipping, and tables in the shared folder that cut lineage."""

from __future__ import annotations

import atexit
import re
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

#: Bytes of one Arrow batch between the JVM and Python, unless the application sets its own: whole texts travel in them.
ARROW_BYTES = "4m"

#: On a mounted folder (file:) Hadoop starts a process for the mode of each file and writes a checksum file beside it, each again
#: with a process; passing tables do without both.  Other stores do not read these settings.
RAW_FILES = {"fs.file.impl": "org.apache.hadoop.fs.RawLocalFileSystem", "fs.file.impl.disable.cache": "true"}

#: Rows that one task sorts or groups, about, where a query gives its shuffles a number of tasks itself.
TASK_ROWS = 250_000

_shipped: set[str] = set()
_written: list[tuple[SparkSession, str]] = []
#: Called when written tables go: what refers to them must forget them.
on_release: list = []


def ship(spark: SparkSession) -> SparkSession:
    """Give the package to executors that do not have it installed; once for each application."""
    sc = spark.sparkContext
    if sc.applicationId not in _shipped:
        root = Path(__file__).resolve().parent
        target = Path(tempfile.mkdtemp(prefix="folioscope-"), f"{root.name}.zip")  # on the driver, which serves it to executors
        with zipfile.ZipFile(target, "w", zipfile.ZIP_DEFLATED) as archive:
            for source in sorted(root.rglob("*.py")):
                archive.write(source, source.relative_to(root.parent))
        sc.addPyFile(str(target))
        for limit in ("maxBytesPerBatch", "maxBytesPerOutputBatch"):
            if not sc.getConf().contains(f"spark.sql.execution.arrow.{limit}"):
                spark.conf.set(f"spark.sql.execution.arrow.{limit}", ARROW_BYTES)
        _shipped.add(sc.applicationId)
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The folder all machines share: spark.checkpoint.dir; a temporary one only where it is unset and there is one machine."""
    path = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not path:
        path = spark.sparkContext.getCheckpointDir()
    if not path:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all machines of the cluster share")
        spark.sparkContext.setCheckpointDir("file://" + tempfile.mkdtemp(prefix="folioscope-"))
        path = spark.sparkContext.getCheckpointDir()
    return path.rstrip("/")


def tasks(spark: SparkSession, rows: int) -> int:
    """How many tasks so many rows are dealt over: a task's share, and so its memory, does not grow with the input, whatever the application's
    number of shuffle partitions is, and however large adaptive execution makes them.
    """
    return max(spark.sparkContext.defaultParallelism, -(-rows // TASK_ROWS))


def written(df: DataFrame, few: bool = False) -> DataFrame:
    """Cut the lineage: write ``df`` to the shared folder and read it back.

    The table is in shared storage, not in executor memory, so a lost executor costs nothing.  The
    files are removed when the Python process ends.  ``few`` is for results of a shuffle: they are written by at most four tasks
    for each core of the cluster, so that many small partitions do not make as many small files.
    """
    spark = df.sparkSession
    if few:
        df = df.coalesce(max(32, 4 * spark.sparkContext.defaultParallelism))
    path = f"{shared_dir(spark)}/folioscope-{uuid.uuid4().hex}"
    df.write.options(**RAW_FILES).parquet(path)
    if not _written:
        atexit.register(release)
    _written.append((spark, path))
    return spark.read.schema(df.schema).parquet(path)


def release() -> None:
    """Delete what ``written`` has left in the shared folder."""
    for forget in on_release:
        forget()
    while _written:
        spark, path = _written.pop()
        jvm = spark.sparkContext._jvm
        if jvm is not None and spark.sparkContext._jsc is not None:
            target = jvm.org.apache.hadoop.fs.Path(path)
            target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)
