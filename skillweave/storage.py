"""Tables that a loop keeps between its rounds, in the folder all executors share (spark.checkpoint.dir)."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T


def shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir; where it is unset a session in one process gets a folder of its own, a cluster has to name one."""
    sc = spark.sparkContext
    found = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if not found:
        if not re.fullmatch(r"local(\[.*\])?", sc.master):
            raise ValueError("spark.checkpoint.dir is not set; it has to name a folder that the driver and all executors share")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="skillweave-"))
        found = sc.getCheckpointDir()
    return found.rstrip("/")


class Levels:
    """A table that grows level by level; each level is written once, in a folder of its own, and cuts the lineage there."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.path, self.schema = spark, f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}", None

    def add(self, level: int, rows: DataFrame) -> bool:
        """Writes the rows of a level; whether there were any."""
        rows.write.parquet(f"{self.path}/level={level}")
        self.schema = self.schema or rows.schema
        return not self.at(level).isEmpty()

    def at(self, level: int) -> DataFrame:
        return self.spark.read.schema(self.schema).parquet(f"{self.path}/level={level}")

    def all(self) -> DataFrame:
        """Every row with its level."""
        return self.spark.read.schema(T.StructType([*self.schema.fields, T.StructField("level", T.IntegerType())])).option("basePath", self.path).parquet(self.path)


def stored(rows: DataFrame, name: str) -> DataFrame:
    """rows written once and read from there, wherever they are used."""
    kept = Levels(rows.sparkSession, name)
    kept.add(0, rows)
    return kept.at(0)
