"""Streaming forms of extraction and counting, over any streaming DataFrame."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def windowed_counts(events: DataFrame, column: str, time: str = "ts", width: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Counts of a column's values in time windows; rows later than the watermark are left out of closed windows."""
    return events.withWatermark(time, late).groupBy(F.window(time, width), column).agg(F.count(F.lit(1)).alias("n")).select(
        F.col("window.start").alias("start"), F.col("window.end").alias("end"), column, "n"
    )


def term_counts(texts: DataFrame, ontology: DataFrame, time: str = "ts", width: str = "1 day", late: str = "1 hour") -> DataFrame:
    """Alias words of documents, each once a document, by canonical term and window: a stream-static equi-join with single-word aliases."""
    words = texts.withWatermark(time, late).select(time, F.explode(F.array_distinct(F.split(F.lower("text"), r"[^\p{L}\p{N}+#]+"))).alias("alias"))
    return words.join(ontology, "alias").groupBy(F.window(time, width), "canonical").agg(F.count(F.lit(1)).alias("n")).select(F.col("window.start").alias("start"), "canonical", "n")
