"""Shared helpers: shared-folder tables, deterministic folds, bounded samples, Arrow chunks."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..runtime import ship, written

__all__ = ["CHUNK_BYTES", "buffer_of", "chunks", "column", "fold", "labelled_sample", "read_table", "unused", "utf8", "written"]

#: Bytes of text that the vectorised kernels take at once; a longer single text is taken alone.
CHUNK_BYTES = 1 << 19
#: Bytes of labelled text that a classifier is trained on at most.
SAMPLE_BYTES = 64 << 20


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return ship(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def fold(col, modulus: int):
    """crc32 of the value as text, modulo ``modulus``; a null value gives -1, which is no fold."""
    return F.coalesce((F.crc32(F.col(col).cast("string").cast("binary")) % modulus).cast("int"), F.lit(-1))


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, max_rows: int, folds: int = 0, max_bytes: int = SAMPLE_BYTES) -> DataFrame:
    """At most ``max_rows`` labelled documents of each class, in hash order, ``max_bytes`` of text in all: (doc_id, y, text).

    Repeated labels of one document count once (their maximum); labels without a document, and null labels, are
    left out.  Of rows that share a doc_id one stands for all, the largest text, so the bounds are on rows.
    ``folds`` > 0 leaves out the documents of fold 0.
    """
    ids = docs.select("doc_id").where(F.col("doc_id").isNotNull())
    if folds:
        ids = ids.where(fold("doc_id", folds) != 0)
    known = (
        labels.select("doc_id", F.col(label).cast("int").alias("y"))
        .where("doc_id IS NOT NULL AND y IN (0, 1)")
        .groupBy("doc_id")
        .agg(F.max("y").alias("y"))
        .join(ids.distinct(), "doc_id", "left_semi")
    )
    turn = F.xxhash64("doc_id", F.lit("sample"))
    parts = [known.where(F.col("y") == y).orderBy(turn, "doc_id").limit(max_rows) for y in (0, 1)]
    # Bounded by 2 * max_rows rows of two numbers, hence safe to broadcast.
    chosen = F.broadcast(parts[0].unionByName(parts[1]))
    rows = written(docs.select("doc_id", "text").join(chosen, "doc_id").groupBy("doc_id").agg(F.first("y").alias("y"), F.max("text").alias("text")), few=True)
    size = F.coalesce(F.octet_length("text"), F.lit(0)).cast("long")
    if (rows.agg(F.sum(size)).first()[0] or 0) <= max_bytes:
        return rows
    # Both classes by turns, in hash order, up to the budget; numbers of at most 2 * max_rows rows.
    one, every = Window.partitionBy("y").orderBy("turn", "doc_id"), Window.orderBy("place", "y")
    sizes = rows.select("doc_id", "y", size.alias("size"), turn.alias("turn")).withColumn("place", F.row_number().over(one))
    fits = sizes.withColumn("upto", F.sum("size").over(every.rowsBetween(Window.unboundedPreceding, 0))).where(F.col("upto") <= max_bytes)
    return rows.join(F.broadcast(fits.select("doc_id")), "doc_id")


def unused(df: DataFrame, *names: str) -> list[str]:
    """The names, lengthened until ``df`` has no column of that name (in any case)."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name += "_"
        out.append(name)
    return out


def utf8(column: pa.Array) -> list[bytes]:
    """The texts of an Arrow string column as bytes; null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return [x or b"" for x in column.cast(pa.binary()).to_pylist()]


def buffer_of(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string or binary column as they lie in its Arrow buffers; a null text is empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    if texts.null_count:
        texts = texts.fill_null(b"" if pa.types.is_binary(texts.type) or pa.types.is_large_binary(texts.type) else "")
    _, places, data = texts.buffers()
    wide = pa.types.is_large_string(texts.type) or pa.types.is_large_binary(texts.type)
    offsets = np.frombuffer(places, dtype=np.int64 if wide else np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64) if len(texts) else np.zeros(1, dtype=np.int64)
    return np.frombuffer(data, dtype=np.uint8) if data is not None and data.size else np.zeros(0, dtype=np.uint8), offsets


def chunks(texts: list[bytes], limit: int = CHUNK_BYTES):
    """(first, texts) runs of whole texts of about ``limit`` bytes together."""
    start, size = 0, 0
    for i, text in enumerate(texts):
        if size and size + len(text) > limit:
            yield start, texts[start:i]
            start, size = i, 0
        size += len(text) + 1
    if start < len(texts):
        yield start, texts[start:]


def column(batch: pa.RecordBatch, name: str):
    """The first column of that name, in any place among others."""
    return batch.column(batch.schema.names.index(name))

