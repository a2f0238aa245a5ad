"""Corpus pipeline: STAGES are applied to ``documents`` one after the other, each written before the next.

toxicity: documents that the classifier rejects go.  line_dedup: site boilerplate lines go, documents stay; one that
would lose all its lines is a copied document, so it stays whole and near_dedup keeps one of its copies.
near_dedup: of each SimHash component one document stays.  decontaminate: documents that hold benchmark passages
go.  mix: the documents of the weighted mix, with the words and copies taken of each.

Defined cases, stage by stage as in the operators: a null text is empty and never toxic or contaminated, and takes no part in the
mix, which takes words; all empty texts are one near-copy component; a null doc_id is an id like others and never merges or
loses rows; of rows equal in all columns one stays; very long texts are read whole; an empty table gives an empty result at each
stage; other columns are passed on unchanged, but for ``mix_taken`` and ``mix_copies``, which the mix sets.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioscope.llm import decontaminate, line_dedup, mixing, simhash, toxicity
from folioscope.llm.common import read_table, unused, written

#: The stages learn or compare; SQL can't express them.
ORACLE_SQL = None


def reject_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return toxicity.drop_toxic(docs, toxicity.fit(docs, read_table(spark, sf_dir, "labels")))


def drop_boilerplate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    whole = unused(docs, "__whole")[0]
    out = line_dedup.dedup_lines(docs.withColumn(whole, F.col("text")), report=None)
    out = out.withColumn("text", F.when(F.col("text").rlike(r"[^\x20\x09-\x0D]"), F.col("text")).otherwise(F.col(whole)))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(F.col("text").isNull(), F.col("n_chars")).otherwise(F.length("text")).cast(docs.schema["n_chars"].dataType))
    return out.select(docs.columns)


def keep_one_near_copy(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return simhash.keep_one(docs)


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.drop_contaminated(docs, read_table(spark, sf_dir, "benchmark"))


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.take_mix(docs)


STAGES = [
    ("toxicity", reject_toxic),
    ("line_dedup", drop_boilerplate),
    ("near_dedup", keep_one_near_copy),
    ("decontaminate", decontaminated),
    ("mix", mixed),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
