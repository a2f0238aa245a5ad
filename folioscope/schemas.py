"""Explicit schemas; absent and null are one."""

from __future__ import annotations

EXTERNAL_ID = "struct<type: string, value: string, relationship: string>"
CONTRIBUTOR = "struct<credit_name: string, normalized_name: string, tokens: array<string>, orcid_id: string, role: string, sequence: string>"
TOPIC = "struct<display_name: string, field: struct<display_name: string>>"
KEYWORD = "struct<display_name: string>"

WORKS = (
    "orcid_id string, put_code long, title string, journal_title string, publication_year int, type string, visibility string, "
    f"external_ids array<{EXTERNAL_ID}>, contributors array<{CONTRIBUTOR}>, work_key string, orcid_group string, doi string, "
    f"concepts array<struct<display_name: string, score: double>>, keywords array<{KEYWORD}>, topics array<{TOPIC}>, is_oa boolean, oa_url string, "
    "institutions array<struct<name: string>>, focal_work boolean, author_count int, harvested_at timestamp"
)
PROFILES = (
    "orcid_id string, given_names string, family_names string, credit_name string, other_names array<string>, emails array<string>, "
    "institution_names array<string>, focal_author boolean, discovered_at timestamp, harvested boolean, works_harvested_at timestamp, works_count long, unique_works_count long"
)
METADATA = (
    "source string, doi string, openalex_id string, pdf_url string, open_access struct<is_oa: boolean, oa_url: string>, "
    f"topics array<{TOPIC}>, keywords array<{KEYWORD}>, concepts array<struct<display_name: string, score: double>>, abstract string, harvested_at timestamp"
)
QUEUE = "doi string, source string, status string, attempts int, created_at timestamp"
PARTITIONS = "base_query string, prefix string, depth int, status string"
