"""Rule-based evaluation of written feedback against the analysis it was written from."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skillweave.functions.text import markdown_sections, percentages

TOLERANCE = 0.5
#: Weights of hallucination, severity drift, number drift and missing skills; fixed values.
WEIGHTS = (3.0, 0.2, 0.1, 0.05)


def mentioned_skills(text: Column, longest: int = 40) -> Column:
    """Bold spans, 'Name (12%)' and bullet heads, trimmed of marks; at most longest characters and not starting with a digit."""
    found = F.concat(
        F.regexp_extract_all(text, F.lit(r"\*\*([^*\n]+)\*\*"), F.lit(1)),
        F.regexp_extract_all(text, F.lit(r"([A-Z][A-Za-z0-9+#./ -]*?) \([0-9]+[.,]?[0-9]*\s*%\)"), F.lit(1)),
        F.regexp_extract_all(text, F.lit(r"(?m)^[-*] ([A-Za-z][A-Za-z0-9+#./ -]*?):"), F.lit(1)),
    )
    clean = F.transform(found, lambda x: F.trim(F.regexp_replace(x, r"[:*]+$", "")))
    return F.array_distinct(F.filter(clean, lambda x: (x != "") & (F.length(x) <= longest) & ~x.rlike(r"^[0-9]")))


def skill_drift(source: DataFrame, said: DataFrame, key: str = "doc_id") -> DataFrame:
    """(key, hallucinated, missing, n_said): skills said but not in the source, and the reverse, letter case aside."""
    a = source.select(key, F.lower("skill").alias("skill")).distinct().withColumn("in_source", F.lit(1))
    b = said.select(key, F.lower("skill").alias("skill")).distinct().withColumn("in_text", F.lit(1))
    rows = a.join(b, [key, "skill"], "full_outer")
    return rows.groupBy(key).agg(
        F.count(F.when(F.col("in_source").isNull(), 1)).alias("hallucinated"), F.count(F.when(F.col("in_text").isNull(), 1)).alias("missing"), F.count("in_text").alias("n_said")
    )


#: Section headings by a word they hold, in this order, and the sections they open; fixed values.
SECTION_HEADINGS = {
    "tổng quan": "overview",
    "điểm mạnh": "strengths",
    "khoảng trống quan trọng": "critical_gaps",
    "khoảng trống trung bình": "medium_gaps",
    "đánh giá mức độ sẵn sàng": "readiness",
    "kế hoạch cải thiện": "improvement",
}


def severity_drift(texts: DataFrame, gaps: DataFrame, key: str = "doc_id") -> DataFrame:
    """(key, drifted, issues): gaps that a text tells under the other severity.

    texts is (key, text), gaps (key, skill, severity). A text is cut into sections at its headings; a medium gap named in the
    section of critical gaps and not in that of medium ones has drifted, and the reverse. A skill is named wherever its
    letters stand, as in a longer word. issues are sorted; texts without a drift have none. Texts of a null key are left out.
    """
    sections = markdown_sections(texts.filter(F.col(key).isNotNull()), SECTION_HEADINGS, key)
    of = lambda name: F.coalesce(F.max(F.when(F.col("section") == name, F.col("content"))), F.lit(""))
    told = sections.groupBy(key).agg(of("critical_gaps").alias("critical_text"), of("medium_gaps").alias("medium_text"))
    rows = gaps.select(key, "skill", "severity").distinct().join(told, key)
    high, low = (F.contains(F.col(f"{x}_text"), F.col("skill")) for x in ("critical", "medium"))
    issue = F.when((F.col("severity") == "medium") & high & ~low, F.format_string("Medium gap '%s' được nhắc ở section 'Quan trọng'", "skill")).when(
        (F.col("severity") == "critical") & low & ~high, F.format_string("Critical gap '%s' được nhắc ở section 'Trung bình'", "skill")
    )
    found = rows.groupBy(key).agg(F.array_sort(F.collect_list(issue)).alias("found"))
    issues = F.coalesce("found", F.array().cast("array<string>"))
    return texts.select(key).distinct().filter(F.col(key).isNotNull()).join(found, key, "left").select(key, (F.size(issues) > 0).alias("drifted"), issues.alias("issues"))


def number_drift(texts: DataFrame, known: DataFrame, key: str = "doc_id", tolerance: float = TOLERANCE) -> DataFrame:
    """(key, numbers, drifted): percentages in the text, and those further than the tolerance from every known one; known is (key, value)."""
    said = texts.select(key, F.explode(percentages(F.col("text"))).alias("said"))
    values = known.groupBy(key).agg(F.collect_set("value").alias("values"))
    far = ~F.coalesce(F.exists("values", lambda v: F.abs(v - F.col("said")) < tolerance), F.lit(False))
    return said.join(values, key, "left").groupBy(key).agg(F.count(F.lit(1)).alias("numbers"), F.count(F.when(far, 1)).alias("drifted"))


def quality(hallucination_rate: Column, severity_drift: Column, drifted: Column, missing: Column) -> Column:
    h, s, n, m = WEIGHTS
    raw = F.lit(1.0) - F.lit(h) * hallucination_rate - F.lit(s) * severity_drift.cast("int") - F.lit(n) * drifted - F.lit(m) * missing
    return F.round(F.greatest(F.lit(0.0), F.least(F.lit(1.0), raw)), 4)
