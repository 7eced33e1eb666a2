"""Operator 2: mixing sources to target weights by Pareto order sampling, in DataFrame functions only.

Sources get water-filled word targets. A document's whole copies (the integer part of its source's factor) are certain;
the words still missing come from one Pareto order sample per source. A document's inclusion probability is proportional to
the square root of its size, at the rate at which the expected words of the sample are the words missing; documents that
would reach probability 1 are taken for certain, and the rate is set for the rest. Every other document draws a uniform u
and is ranked by the odds of u divided by the odds of its inclusion. The sample is of fixed size in words: ranks are taken
up to the document whose middle lies nearest below the words still missing.

The cut in a source is found by two histogram passes over the rank value (4096 buckets, then 4096 inside the bucket that
holds the cut) and a sort of the few rows in the last bucket; no task sorts a source, so a source may hold any share.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from skillweave.llm.common import WORD, stored, table

WEIGHTS = (5, 2, 1)
#: A source table of at most this many rows is broadcast; a larger one is joined by shuffle.
BROADCAST_SOURCES = 20_000
_BUCKETS = 4096


def words(text: Column) -> Column:
    """Number of words; null text has none."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def draw(doc_id: Column, seed: str) -> Column:
    """A uniform number strictly between 0 and 1 from the id and the seed; the same on every run."""
    digits = F.substring(F.md5(F.concat(F.lit(seed + "|"), F.coalesce(doc_id.cast("string"), F.lit("null"))).cast("binary")), 1, 13)
    return (F.conv(digits, 16, 10).cast("double") + 0.5) / F.lit(float(1 << 52))


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = 1.0, max_factor: int = 3) -> DataFrame:
    """(source, source_size, n, target): word targets by weight, stopped at max_factor times a source's size.

    Sources rank by code point, null last, and take the weights in turn. Excess is reshared by weight until no target is
    above its cap: ordered by cap over weight, a prefix of sources is capped. Reads one row per source.
    """
    src = sizes.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("n"))
    ranked = src.withColumn("rn", F.row_number().over(W.orderBy(F.col("source").asc_nulls_last())))
    weighed = (
        ranked.withColumn("w", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), ((F.col("rn") - 1) % len(weights) + 1).cast("int")))
        .withColumn("cap", F.col("source_size").cast("double") * max_factor)
        .withColumn("room", F.col("cap") / F.col("w"))
    )
    order = W.orderBy("room", "rn")
    before, onward = order.rowsBetween(W.unboundedPreceding, -1), order.rowsBetween(W.currentRow, W.unboundedFollowing)
    level = weighed.withColumn("total", F.sum("source_size").over(W.partitionBy()).cast("double") * share).withColumn(
        "level", (F.col("total") - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / F.sum("w").over(onward)
    )
    water = F.min(F.when(F.col("level") <= F.col("room"), F.struct("room", "rn", "level"))).over(W.partitionBy())
    return level.withColumn("water", water).select(
        "source",
        "source_size",
        "n",
        F.when(F.col("water").isNull() | (F.struct("room", "rn") < F.struct("water.room", "water.rn")), F.col("cap"))
        .otherwise(F.col("w") * F.col("water.level"))
        .alias("target"),
    )


def inclusion_rates(sizes: DataFrame) -> DataFrame:
    """(source, rate, sure, open) of the sources with words missing, from rows (source, size, missing).

    A document of size s is included with probability rate * sqrt(s); those above size sure are taken for certain, and open
    is how many of the missing words are left to the others. Works on the distinct sizes of a source, not on its rows.
    """
    held = sizes.filter("size > 0 AND missing > 0").groupBy("source", "size").agg(F.count(F.lit(1)).alias("n"), F.first("missing").alias("missing"))
    order = W.partitionBy("source").orderBy(F.desc("size"))
    above = F.coalesce(F.sum(F.col("n") * F.col("size")).over(order.rowsBetween(W.unboundedPreceding, -1)), F.lit(0).cast("long"))
    roots = F.sum(F.col("n") * F.col("size") * F.sqrt(F.col("size").cast("double"))).over(order.rowsBetween(W.currentRow, W.unboundedFollowing))
    tried = held.select("source", "size", (F.col("missing") - above).alias("open"), ((F.col("missing") - above) / roots).alias("rate"))
    fits = tried.filter(F.col("rate") * F.sqrt(F.col("size").cast("double")) < 1)
    return fits.groupBy("source").agg(F.max(F.struct(F.col("size").alias("sure"), "rate", "open")).alias("x")).select("source", "x.rate", "x.sure", "x.open")


def mix_sources(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = 1.0, max_factor: int = 3, seed: str = "mix") -> DataFrame:
    """(doc_id, source, size, source_size, target, copies, taken) for every row of docs.

    docs needs doc_id, source and text; other columns are ignored. Null or empty texts have size 0 and take nothing.
    A null source is a source of its own, ranked last. Rows that repeat an id draw the same number and are taken alike.
    An empty table gives an empty result.
    """
    sizes = stored(docs.select("doc_id", "source", words(F.col("text")).alias("size")), "sizes")
    targets = stored(source_targets(sizes, weights, share, max_factor), "targets")
    small = targets.limit(BROADCAST_SOURCES + 1).count() <= BROADCAST_SOURCES

    def beside(rows: DataFrame, sources: DataFrame) -> DataFrame:
        s = sources.withColumnRenamed("source", "of_source")
        return rows.join(F.broadcast(s) if small else s, F.col("source").eqNullSafe(F.col("of_source")), "left").drop("of_source")

    plan = targets.withColumn("whole", F.floor(F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)).cast("int")).withColumn(
        "missing", F.col("target") - F.col("whole") * F.col("source_size")
    )
    plan = stored(beside(plan.select("source", "source_size", "target", "whole", F.col("missing").alias("short")), inclusion_rates(beside(sizes, plan.select("source", "missing")))), "plan")
    plan = plan.withColumn("missing", F.coalesce("open", F.lit(0.0))).drop("open", "short")
    u = draw(F.col("doc_id"), seed)
    p = F.col("rate") * F.sqrt(F.col("size").cast("double"))
    placed = beside(sizes, plan.select("source", "rate", "sure")).withColumn("certain", F.coalesce(F.col("size") > F.col("sure"), F.lit(False)))
    ranked = placed.withColumn("q", F.when((F.col("size") > 0) & ~F.col("certain"), (u / (1 - u)) / (p / (1 - p)))).drop("rate", "sure")
    place = F.col("q") / (1 + F.col("q"))
    ranked = ranked.withColumn("b1", F.floor(place * _BUCKETS).cast("int")).withColumn("b2", F.floor(place * (_BUCKETS * _BUCKETS)).cast("int"))
    drawn = ranked.filter("q IS NOT NULL")

    def crossing(rows: DataFrame, bucket: str, start: Column) -> DataFrame:
        """The bucket of each source in which the cut lies, and the words before it."""
        sums = rows.groupBy("source", bucket).agg(F.sum("size").alias("held"), F.first("missing").alias("missing"), F.first(start).alias("start"))
        order = W.partitionBy("source").orderBy(bucket)
        upto = F.col("start") + F.sum("held").over(order)
        return (
            sums.withColumn("upto", upto)
            .filter((F.col("upto") > F.col("missing")) & (F.col("upto") - F.col("held") <= F.col("missing")))
            .select("source", F.col(bucket).alias("at"), (F.col("upto") - F.col("held")).alias("passed"))
        )

    first = plan.join(crossing(beside(drawn, plan.select("source", "missing")), "b1", F.lit(0).cast("long")).withColumnRenamed("source", "s1"), F.col("source").eqNullSafe(F.col("s1")), "left")
    first = stored(first.select("source", "source_size", "target", "whole", "missing", F.col("at").alias("at1"), F.col("passed").alias("passed1")), "cuts")
    inside = beside(drawn, first.filter("at1 is not null").select("source", "missing", "at1", "passed1")).filter("b1 = at1")
    second = stored(crossing(inside, "b2", F.col("passed1")).select("source", F.col("at").alias("at2"), F.col("passed").alias("passed2")), "cuts")
    last = beside(beside(drawn, first.select("source", "missing")), second).filter("b2 = at2")
    order = W.partitionBy("source").orderBy("q", "doc_id", "size")
    within = F.col("passed2") + F.sum("size").over(order.rowsBetween(W.unboundedPreceding, W.currentRow)) - F.col("size") / 2 <= F.col("missing")
    cut = last.filter("true").withColumn("in", within).filter("in").groupBy("source").agg(F.max(F.struct("q", "doc_id", "size")).alias("cut"))
    final = stored(
        beside(beside(first, second), cut).select("source", "source_size", "target", "whole", "missing", "at1", "at2", "cut"),
        "cuts",
    )
    here = F.struct("q", "doc_id", "size")
    chosen = (
        F.when(F.col("certain"), True)
        .when(F.col("q").isNull(), False)
        .when(F.col("at1").isNull(), F.col("missing") > 0)
        .when(F.col("b1") != F.col("at1"), F.col("b1") < F.col("at1"))
        .when(F.col("at2").isNull() | (F.col("b2") < F.col("at2")), True)
        .when(F.col("b2") > F.col("at2"), False)
        .otherwise(F.coalesce(here <= F.col("cut"), F.lit(False)))
    )
    copies = F.when(F.col("size") > 0, F.col("whole") + chosen.cast("int")).otherwise(0)
    return beside(ranked, final).select(
        "doc_id",
        "source",
        "size",
        "source_size",
        "target",
        copies.cast("int").alias("copies"),
        (copies * F.col("size")).cast("long").alias("taken"),
    )


def op2_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_sources(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


_SQL = r"""
WITH sizes AS (
  SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size FROM documents
), src AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM sizes GROUP BY source
), weighed AS (
  SELECT *, CAST(CASE (row_number() OVER (ORDER BY source ASC NULLS LAST) - 1) % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS DOUBLE) AS w,
    row_number() OVER (ORDER BY source ASC NULLS LAST) AS rn, CAST(source_size AS DOUBLE) * 3 AS cap,
    CAST(sum(source_size) OVER () AS DOUBLE) AS total
  FROM src
), lev AS (
  SELECT *, (total - coalesce(sum(cap) OVER (ORDER BY cap / w, rn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
    / sum(w) OVER (ORDER BY cap / w, rn ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level
  FROM weighed
), water AS (
  SELECT cap / w AS room, rn, level FROM lev WHERE level <= cap / w ORDER BY 1, 2 LIMIT 1
), targets AS (
  SELECT source, source_size,
    CASE WHEN water.level IS NULL OR lev.cap / lev.w < water.room OR (lev.cap / lev.w = water.room AND lev.rn < water.rn)
      THEN lev.cap ELSE lev.w * water.level END AS target
  FROM lev LEFT JOIN water ON true
), plan AS (
  SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size) ELSE 0 END AS whole FROM targets
), drawn AS (
  SELECT s.doc_id, s.size, p.source, p.source_size, p.target, p.whole, p.target - p.whole * p.source_size AS missing,
    (CAST(CAST('0x' || substr(md5('mix|' || coalesce(CAST(s.doc_id AS VARCHAR), 'null')), 1, 13) AS BIGINT) AS DOUBLE) + 0.5) / 4503599627370496.0 AS u
  FROM sizes s JOIN plan p ON s.source IS NOT DISTINCT FROM p.source
), held AS (
  SELECT source, size, count(*) AS n, any_value(missing) AS missing FROM drawn WHERE size > 0 AND missing > 0 GROUP BY source, size
), tried AS (
  SELECT source, size, missing - coalesce(sum(n * size) OVER (PARTITION BY source ORDER BY size DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS open,
    sum(n * size * sqrt(CAST(size AS DOUBLE))) OVER (PARTITION BY source ORDER BY size DESC ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS roots
  FROM held
), rates AS (
  SELECT source, max(size) AS sure, max_by(open / roots, size) AS rate, max_by(open, size) AS open FROM tried WHERE open / roots * sqrt(CAST(size AS DOUBLE)) < 1 GROUP BY source
), odds AS (
  SELECT d.*, coalesce(r.open, 0) AS open, coalesce(d.size > r.sure, false) AS certain, r.rate * sqrt(CAST(d.size AS DOUBLE)) AS p
  FROM drawn d LEFT JOIN rates r ON d.source IS NOT DISTINCT FROM r.source
), ranked AS (
  SELECT *, CASE WHEN size > 0 AND NOT certain AND p IS NOT NULL THEN sum(size) OVER (PARTITION BY source, certain OR size = 0 ORDER BY
    (u / (1 - u)) / (p / (1 - p)), doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) - size / 2.0 END AS middle
  FROM odds
)
SELECT doc_id, size, source_size, target,
  CAST(CASE WHEN size > 0 THEN (whole + CASE WHEN certain OR (middle <= open AND open > 0) THEN 1 ELSE 0 END) * size ELSE 0 END AS BIGINT) AS taken
FROM ranked
"""

QUERIES = {"op2_source_mixing": op2_source_mixing}
ORACLES = {"op2_source_mixing": _SQL}
