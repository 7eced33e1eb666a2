"""Consecutive numbers in a declared order, without one task that sees every row.

Rows are cut into ranges of the order at keys picked from a hashed sample; each range is numbered for itself and shifted by
the rows of the ranges before it. The sample and so the ranges are a function of the rows alone: the pass that counts the
ranges and the pass that numbers them cut alike, also when a lost executor's part is computed again.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

RANGE_ROWS = 1_000_000
MOST_RANGES = 4096
#: Sampled keys for each range.
PER_RANGE = 16


def _upper_bound(bounds: str, key: str, steps: int) -> Column:
    """How many of the sorted bounds are not above the key, by bisection."""
    start = F.struct(F.lit(0).alias("lo"), F.size(bounds).alias("hi"))

    def step(state, _):
        mid = F.floor((state["lo"] + state["hi"]) / 2).cast("int")
        open_ = state["lo"] < state["hi"]
        up = open_ & (F.element_at(bounds, mid + 1) <= F.col(key))
        return F.struct(F.when(up, mid + 1).otherwise(state["lo"]).alias("lo"), F.when(open_ & ~up, mid).otherwise(state["hi"]).alias("hi"))

    return F.aggregate(F.sequence(F.lit(1), F.lit(steps)), start, step, lambda s: s["lo"])


def ranged(rows: DataFrame, order: list[str], n: int, range_rows: int = RANGE_ROWS) -> DataFrame:
    """rows (of n) with _key, a struct that sorts like the order and tells unlike rows apart, and _range, its range from 0."""
    hashed = [F.col(c) for c, kind in rows.dtypes if "map<" not in kind and "variant" not in kind]
    keyed = rows.withColumn("_key", F.struct(*order, F.xxhash64(*hashed).alias("_hash")))
    ranges = min(MOST_RANGES, max(2, -(-n // range_rows)))
    every = max(1, n // (ranges * PER_RANGE))
    sample = keyed.filter(F.pmod(F.xxhash64("_key"), F.lit(every)) == 0).agg(F.array_sort(F.collect_list("_key")).alias("k"))
    step = F.greatest(F.lit(1), F.floor(F.size("k") / ranges).cast("int"))
    bounds = sample.select(F.filter("k", lambda _, i: (i > 0) & (i % step == 0)).alias("_bounds"))
    return keyed.join(F.broadcast(bounds), F.lit(True)).withColumn("_range", _upper_bound("_bounds", "_key", (2 * ranges).bit_length() + 1)).drop("_bounds")


def numbered(rows: DataFrame, order: list[str], name: str = "n", range_rows: int = RANGE_ROWS) -> tuple[DataFrame, int]:
    """rows with their numbers from 1 in ascending order (nulls first), and how many there are.

    Rows that are equal in the order are numbered by a hash of all columns; rows equal in all columns are alike, so any of
    them may come first. The driver gets one count for each range. An empty table stays empty.
    """
    cut = ranged(rows, order, rows.count(), range_rows)
    counts = {r._range: r.n for r in cut.groupBy("_range").agg(F.count(F.lit(1)).alias("n")).collect()}
    before, shifts = 0, []
    for i in range(max(counts, default=-1) + 1):
        shifts.append(before)
        before += counts.get(i, 0)
    shift = F.element_at(F.lit(shifts or [0]), F.col("_range") + 1)
    own = F.row_number().over(W.partitionBy("_range").orderBy("_key"))
    return cut.withColumn(name, (own + shift).cast("long")).drop("_key", "_range"), before
