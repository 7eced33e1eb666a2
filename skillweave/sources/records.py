"""The four source layouts as unified records.

Two workbooks of job ads (one with metadata but no skills, one with a skill list), a table of job descriptions and one of
résumés. Columns are taken where a source has them, null otherwise.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skillweave.functions.text import split_terms
from skillweave.sources.tables import union_records, unified

#: Key prefix, source, record type, and the source's column for each field of a record.
LAYOUTS = {
    "LINKEDIN": ("LINKEDIN", "job", {"title": "job_title", "description": "job_description", "category": "category", "company": "company", "location": "location_normalized", "seniority": "seniority"}),
    "TOPCV": (
        "TOPCV",
        "job",
        {"title": "job_title", "description": "job_description", "skills_raw": "skills_required", "category": "category", "salary_vnd": "salary_vnd", "location": "location_normalized", "seniority": "seniority"},
    ),
    "JD": ("KAGGLE_JD", "job", {"title": "Job Title", "description": "Description"}),
    "RESUME": ("KAGGLE_RESUME", "resume", {"title": "Category", "description": "Resume_str", "category": "Category", "original_id": "ID"}),
}


def _listed(column: Column) -> Column:
    """A comma-separated list, null where nothing is in it."""
    found = split_terms(column, ",")
    return F.when(F.size(found) > 0, found)


def source_records(rows: DataFrame, layout: str, order: list[str]) -> DataFrame:
    """rows of one layout as unified records, numbered in the order of the named columns."""
    source, kind, fields = LAYOUTS[layout]
    have = {c.lower(): c for c in rows.columns}
    columns = {f: F.col(f"`{have[c.lower()]}`") for f, c in fields.items() if c.lower() in have}
    if "skills_raw" in columns:
        columns["skills_raw"] = _listed(columns["skills_raw"].cast("string"))
    return unified(rows, layout, source, kind, order, **columns)


def all_records(sources: dict[str, tuple[DataFrame, list[str]]]) -> DataFrame:
    """The records of all sources: layout -> (rows, order)."""
    return union_records(*[source_records(rows, layout, order) for layout, (rows, order) in sources.items()])
