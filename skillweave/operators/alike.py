"""Work done once for all candidates of one state: those with the same targets and the same owned skills get the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skillweave.storage import stored

#: Candidates of one state that take their rows from one copy of them, so that a state of very many is dealt to many tasks.
CHUNK = 4096


def for_each_state(owned: DataFrame, targets: DataFrame, work: Callable[[DataFrame, DataFrame], DataFrame]) -> DataFrame:
    """work(owned, targets) of all candidates of targets, worked out for one candidate of each state only.

    A state is all that targets (candidate, role, ...) says of a candidate, repeats counted, and the set of owned (candidate,
    skill). The smallest candidate of each state stands for it; every other gets the same rows under its own name. work has
    to return rows (candidate, ...) that depend on a candidate's state alone, never on its name or on other candidates: what
    does, like the matrix, comes from outside. Candidates who are null have no rows, as they join with nothing.
    """
    told = [c for c in targets.columns if c != "candidate"]
    mine = owned.filter("skill IS NOT NULL").groupBy("candidate").agg(F.array_sort(F.collect_set("skill")).alias("_mine"))
    rows = targets.filter("candidate IS NOT NULL").groupBy("candidate").agg(F.array_sort(F.collect_list(F.struct(*told))).alias("_told")).join(mine, "candidate", "left")
    rows = stored(rows.withColumn("_mine", F.coalesce("_mine", F.array().cast("array<string>"))), "states")
    states = stored(rows.groupBy("_told", "_mine").agg(F.min("candidate").alias("_like"), F.ceil(F.count(F.lit(1)) / CHUNK).cast("int").alias("_parts")), "alike")
    one = states.select(F.col("_like").alias("candidate"), "_told", "_mine", "_parts")
    found = work(one.select("candidate", F.explode("_mine").alias("skill")), one.select("candidate", F.inline("_told")))
    copies = found.join(one.select("candidate", "_parts"), "candidate").withColumn("_part", F.explode(F.sequence(F.lit(0), F.col("_parts") - 1)))
    copies = copies.withColumnRenamed("candidate", "_like").drop("_parts")
    whose = rows.join(states, ["_told", "_mine"]).select("candidate", "_like", F.pmod(F.xxhash64("candidate"), F.col("_parts")).cast("int").alias("_part"))
    return whose.join(copies, ["_like", "_part"]).select(found.columns)
