"""Delimited text whose encoding is decided for each input file: UTF-8 where the whole file is, else Latin-1."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

_MARK = "\ufeff"


def file_encodings(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """(file, utf8): whether every line of a file is valid UTF-8.

    Lines keep their bytes here, so files are split and judged wherever their blocks are.
    """
    lines = spark.read.text(path).select(F.col("_metadata.file_path").alias("file"), "value")
    return lines.groupBy("file").agg(F.bool_and(F.is_valid_utf8("value")).alias("utf8"))


def _name(raw: str) -> str:
    """A header's name as read in Latin-1: mark and the quotes behind it dropped, UTF-8 where it is."""
    try:
        raw = raw.encode("latin-1").decode("utf-8")
    except UnicodeError:
        pass
    return raw.removeprefix(_MARK).strip('"') if raw.startswith(_MARK) else raw


def read_delimited(spark: SparkSession, path: str | list[str], schema: str | None = None, sep: str = ",") -> DataFrame:
    """Files with header, quoted line breaks and doubled quotes, each in its own encoding.

    All files are read as Latin-1, which keeps every byte, in one scan; a field of a UTF-8 file is then decoded. Without a
    schema all columns are text, named by the header; with one the columns are taken by position and cast. Blank lines are
    skipped. Files share the first one's header. No file at the path raises Spark's own error.
    """
    raw = spark.read.options(header=True, multiLine=True, escape='"', encoding="ISO-8859-1", sep=sep, inferSchema=False).csv(path)
    columns = raw.columns
    raw = raw.toDF(*[f"c{i}" for i in range(len(columns))]).withColumn("file", F.col("_metadata.file_path"))
    known = raw.join(file_encodings(spark, path), "file", "left")
    text = lambda c: F.when(F.col("utf8"), F.decode(F.encode(c, "ISO-8859-1"), "UTF-8")).otherwise(F.col(c))
    if schema is None:
        return known.select(*[text(f"c{i}").alias(_name(c)) for i, c in enumerate(columns)])
    fields = T._parse_datatype_string(schema).fields
    return known.select(*[text(f"c{i}").cast(f.dataType).alias(f.name) for i, f in enumerate(fields)])
