"""Market statistics: the role-by-skill matrix, frequencies, profiles of tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

NOISE_PCT = 5.0


def job_skills(jobs: DataFrame) -> DataFrame:
    """(job_id, role, skill): one row per distinct, non-blank skill of a job; jobs has job_id, role and skills."""
    return jobs.select("job_id", "role", F.explode(F.array_distinct("skills")).alias("skill")).select("job_id", "role", F.trim("skill").alias("skill")).filter("skill <> ''")


def role_skill_matrix(jobs: DataFrame, pairs: DataFrame, min_pct: float = NOISE_PCT) -> DataFrame:
    """(role, skill, frequency_pct, count, total_jobs_in_role) with frequency_pct >= min_pct.

    jobs (job_id, role) holds every job, also those without skills, and sets the totals; pairs is (job_id, role, skill),
    distinct. The filter applies to the rounded percentage. Roles are few next to jobs: both counts are pre-aggregated and
    the totals join as the small side.
    """
    totals = jobs.groupBy("role").agg(F.count(F.lit(1)).alias("total_jobs_in_role"))
    counts = pairs.groupBy("role", "skill").agg(F.count(F.lit(1)).alias("count"))
    pct = F.round(F.lit(100.0) * F.col("count") / F.col("total_jobs_in_role"), 2)
    return counts.join(totals, "role", "left").select("role", "skill", pct.alias("frequency_pct"), "count", "total_jobs_in_role").filter(F.col("frequency_pct") >= min_pct)


def ordered_matrix(matrix: DataFrame) -> DataFrame:
    return matrix.orderBy("role", F.desc("frequency_pct"), "skill")


def value_counts(rows: DataFrame, *columns: str) -> DataFrame:
    return rows.groupBy(*columns).agg(F.count(F.lit(1)).alias("n"))


def top_values(rows: DataFrame, column: str, n: int) -> DataFrame:
    """The n most frequent values with their counts; ties by value."""
    return value_counts(rows, column).orderBy(F.desc("n"), column).limit(n)


def top_skills_per_role(matrix: DataFrame, roles: int = 10, skills: int = 5) -> DataFrame:
    """The first skills of each of the largest roles; ties by name. Roles are ranked by their number of jobs."""
    largest = matrix.groupBy("role").agg(F.first("total_jobs_in_role").alias("total")).orderBy(F.desc("total"), "role").limit(roles)
    rank = F.row_number().over(W.partitionBy("role").orderBy(F.desc("frequency_pct"), "skill"))
    return matrix.join(largest.select("role"), "role", "left_semi").withColumn("rank", rank).filter(F.col("rank") <= skills).select("role", "rank", "skill", "frequency_pct")


def role_rows(matrix: DataFrame, wanted: str) -> DataFrame:
    """Rows of the role named wanted, whatever its letter case; if there is none, of all roles that contain it."""
    low, name = F.lower("role"), wanted.strip().lower()
    tier = F.when(low == name, 1).when(F.contains(low, F.lit(name)), 2)
    tiers = matrix.withColumn("tier", tier).filter("tier is not null")
    best = tiers.agg(F.min("tier").alias("best"))
    return tiers.join(F.broadcast(best), F.col("tier") == F.col("best")).drop("tier", "best")


def role_stats(matrix: DataFrame, wanted: str) -> DataFrame:
    """role_rows with each skill's rank by frequency."""
    rank = F.row_number().over(W.partitionBy("role").orderBy(F.desc("frequency_pct"), "skill"))
    return role_rows(matrix, wanted).withColumn("rank", rank)


def null_profile(rows: DataFrame) -> DataFrame:
    """(column, nulls, null_pct) for every column, in one pass."""
    sums = rows.agg(F.count(F.lit(1)).alias("_n"), *[F.sum(F.col(f"`{c}`").isNull().cast("long")).alias(f"_{i}") for i, c in enumerate(rows.columns)])
    parts = F.array(*[F.struct(F.lit(c).alias("column"), F.coalesce(F.col(f"_{i}"), F.lit(0)).alias("nulls")) for i, c in enumerate(rows.columns)])
    return sums.select("_n", F.explode(parts).alias("x")).select(
        "x.column", "x.nulls", F.round(F.when(F.col("_n") > 0, F.lit(100.0) * F.col("x.nulls") / F.col("_n")).otherwise(0.0), 2).alias("null_pct")
    )


def size_summary(rows: DataFrame, size: Column, *by: str) -> DataFrame:
    """Rows, share with a positive size, and mean, median, least and greatest size; by groups if named."""
    x = size.cast("double")
    grouped = rows.groupBy(*by) if by else rows.groupBy()
    return grouped.agg(
        F.count(F.lit(1)).alias("n"),
        F.round(F.avg((size > 0).cast("double")) * 100, 2).alias("coverage_pct"),
        F.round(F.avg(x), 4).alias("mean_size"),
        F.median(x).alias("median_size"),
        F.min(size).cast("long").alias("min_size"),
        F.max(size).cast("long").alias("max_size"),
    )


def skill_sets(matrix: DataFrame, min_pct: float) -> DataFrame:
    """(role, skills): sorted skills of each role at or above a frequency."""
    return matrix.filter(F.col("frequency_pct") >= min_pct).groupBy("role").agg(F.array_sort(F.collect_set("skill")).alias("skills"))


def table_summary(**tables: DataFrame) -> DataFrame:
    """(name, rows) of the given tables."""
    out = None
    for name, df in sorted(tables.items()):
        one = df.agg(F.count(F.lit(1)).alias("rows")).select(F.lit(name).alias("name"), "rows")
        out = one if out is None else out.unionByName(one)
    return out
