"""Sections of documents: header detection by line with carry-forward, spans between header patterns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

MAX_HEADER = 60


def lines(docs: DataFrame, key: str = "doc_id") -> DataFrame:
    """(key, line_no, line): the lines of texts, numbered from 0."""
    return docs.select(key, F.posexplode(F.split(F.coalesce("text", F.lit("")), "\n")).alias("line_no", "line"))


def header_of(line: Column, sections: dict[str, list[str]], max_length: int = MAX_HEADER) -> Column:
    """The first section in declaration order one of whose keywords the line contains, if the line looks like a header."""
    low = F.lower(line)
    plain = (F.length(line) <= max_length) & (F.length(line) - F.length(F.replace(line, F.lit(","))) <= 2) & (F.length(line) - F.length(F.replace(line, F.lit("."))) <= 1)
    out = None
    for name, words in sections.items():
        hit = F.lit(False)
        for w in words:
            hit = hit | F.contains(low, F.lit(w))
        out = F.when(hit, name) if out is None else out.when(hit, name)
    return F.when(plain & (F.length(F.trim(line)) > 0), out)


def sectioned(rows: DataFrame, sections: dict[str, list[str]], first: str = "personal_info", key: str = "doc_id") -> DataFrame:
    """Lines with their section: that of the last header above, first before any; header lines themselves are dropped."""
    carried = F.last("header", ignorenulls=True).over(W.partitionBy(key).orderBy("line_no").rowsBetween(W.unboundedPreceding, W.currentRow))
    marked = rows.withColumn("header", header_of(F.col("line"), sections)).withColumn("section", F.coalesce(carried, F.lit(first)))
    return marked.filter(F.col("header").isNull() & (F.trim("line") != "")).select(key, "line_no", "line", "section")


def spans(docs: DataFrame, patterns: dict[str, str], key: str = "doc_id") -> DataFrame:
    """(key, section, start, content): text between the first hits of patterns; what precedes them is section _pre_text."""
    hits = F.filter(F.array(*[F.struct(F.regexp_instr("text", F.lit(p)).alias("start"), F.lit(n).alias("section")) for n, p in patterns.items()]), lambda x: x["start"] > 0)
    rows = docs.select(key, "text", F.explode(F.concat(F.array(F.struct(F.lit(1).alias("start"), F.lit("_pre_text").alias("section"))), hits)).alias("h"))
    rows = rows.select(key, "text", "h.start", "h.section", F.when(F.col("h.section") == "_pre_text", 0).otherwise(1).alias("o"))
    after = F.lead("start").over(W.partitionBy(key).orderBy("start", "o", "section"))
    rows = rows.withColumn("stop", F.coalesce(after, F.length("text") + 1))
    return rows.select(key, "section", "start", F.trim(F.substring("text", F.col("start"), F.col("stop") - F.col("start"))).alias("content"))
