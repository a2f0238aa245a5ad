"""Dumps and reports."""

from __future__ import annotations

import datetime
import json

from pyspark.sql import DataFrame, SparkSession

from ..operators import stats


def dump(tables: dict[str, DataFrame], path: str, form: str = "json") -> dict[str, int]:
    """Every table as ``form`` (json or parquet) in a folder of its own, and a manifest of row counts."""
    counts = {}
    for name, rows in sorted(tables.items()):
        rows.write.mode("overwrite").format(form).save(f"{path}/{name}")
        counts[name] = rows.sparkSession.read.format(form).schema(rows.schema).load(f"{path}/{name}").count()
        spark = rows.sparkSession
    if counts:
        manifest(spark, path, counts)
    return counts


def manifest(spark: SparkSession, path: str, counts: dict[str, int]) -> None:
    rows = [(name, n, datetime.datetime.now(datetime.UTC).isoformat()) for name, n in sorted(counts.items())]
    spark.createDataFrame(rows, "collection string, rows long, dumped_at string").coalesce(1).write.mode("overwrite").json(f"{path}/metadata")


def report(records: DataFrame, profiles: DataFrame, start_year=None, end_year=None) -> dict:
    """The analysis report as a dictionary; its parts are small aggregates."""
    rows = lambda df: [r.asDict() for r in df.collect()]
    places = stats.publications_per_institution_per_year(records, start_year, end_year)
    per_year = stats.publications_per_year(records, start_year or 1969, end_year)
    return {
        "summary": (rows(stats.metrics_summary(records, start_year, end_year)) or [{}])[0],
        "per_year": rows(stats.yearly_trend(per_year)),
        "institutions": rows(stats.institution_totals(places)),
        "types": rows(stats.type_percentages(stats.publications_per_type(records, start_year, end_year))),
        "top_authors": rows(stats.top_authors(records, profiles, 10, start_year, end_year)),
        "top_contributors": rows(stats.top_contributors(records, profiles, 10, start_year, end_year)),
    }


def report_json(result: dict) -> str:
    return json.dumps(result, ensure_ascii=False, indent=2, default=str)
