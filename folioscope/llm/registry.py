"""The registered queries of this subpackage, with production parameters over whole tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from . import audit, decontaminate, lexical, licenses, line_dedup, lm_scoring, mixing, packing, pii, quality, simhash, toxicity, url_filter
from .common import read_table


def op1_brown_lm(spark, sf_dir):
    return lm_scoring.brown_scores(read_table(spark, sf_dir, "documents"))


def op2_license_scan(spark, sf_dir):
    found = licenses.scan_licenses(read_table(spark, sf_dir, "documents"))
    line = F.transform("spans", lambda s: F.concat_ws(":", s["name"], s["start"], s["stop"], F.format_number(s["coverage"], 4)))
    return found.select("doc_id", "n_words", "n_matches", F.array_join("licenses", ",").alias("licenses"), "matched_words", F.array_join(line, ",").alias("spans"))


def op3_toxicity(spark, sf_dir):
    docs = read_table(spark, sf_dir, "documents")
    return toxicity.score(docs, toxicity.fit(docs, read_table(spark, sf_dir, "labels")))


def op4_decontaminate(spark, sf_dir):
    found = decontaminate.scan(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))
    return found.drop("spans", "items")


def op5_url_filter(spark, sf_dir):
    return url_filter.filter_urls(read_table(spark, sf_dir, "pages"), url_filter.rule_table(spark))


def op6_simhash(spark, sf_dir):
    return simhash.near_duplicates(read_table(spark, sf_dir, "documents"))


def op7_quality_rules(spark, sf_dir):
    return quality.quality_rules(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))


def op8_mix_sources(spark, sf_dir):
    mixed = mixing.mix(read_table(spark, sf_dir, "documents"))
    return mixed.select("doc_id", "size", "source_size", "target", "taken")


def op9_line_dedup(spark, sf_dir):
    return line_dedup.dedup_lines(read_table(spark, sf_dir, "documents")).select("doc_id", "text", "lines_dropped")


def op10_pii(spark, sf_dir):
    docs = read_table(spark, sf_dir, "documents")
    found = pii.find_pii(docs, pii.fit(docs))
    return found.select("doc_id", "n_email", "n_ip", "n_card", "n_phone", F.sha2("base_spans", 256).alias("base_sha256"), "spans", *(c for c in found.columns if c.startswith("added_")))


def op11_ranked_search(spark, sf_dir):
    return lexical.search(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark")).drop("tier")


def op12_packing(spark, sf_dir):
    return packing.pack(read_table(spark, sf_dir, "documents"), with_ids=False)


def op13_filter_audit(spark, sf_dir):
    return audit.interactions(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))


QUERIES = {
    "op1_brown_lm": op1_brown_lm,
    "op2_license_scan": op2_license_scan,
    "op3_toxicity": op3_toxicity,
    "op4_decontaminate": op4_decontaminate,
    "op5_url_filter": op5_url_filter,
    "op6_simhash": op6_simhash,
    "op7_quality_rules": op7_quality_rules,
    "op8_mix_sources": op8_mix_sources,
    "op9_line_dedup": op9_line_dedup,
    "op10_pii": op10_pii,
    "op11_ranked_search": op11_ranked_search,
    "op12_packing": op12_packing,
    "op13_filter_audit": op13_filter_audit,
}

ORACLES = {"op4_decontaminate": decontaminate.ORACLE, "op5_url_filter": url_filter.ORACLE, "op9_line_dedup": line_dedup.ORACLE, "op11_ranked_search": lexical.ORACLE, "op13_filter_audit": audit.ORACLE}
