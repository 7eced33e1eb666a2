"""What the query catalogues share: the registry, proxies of jobs, candidates and skills in the given tables, and their SQL.

A job is an order, its role the customer's market segment, its skills the brands of its lines' parts; a candidate is a
customer, who owns the brands of their urgent orders. Frequencies lie between 10 and 20 per cent there, so cuts are lower
than the operators' defaults. Arrays leave as text joined by '|'.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skillweave.operators import gap, market
from skillweave.session import table

NOISE, IMPORTANT, CORE, CRITICAL = 12.0, 14.0, 15.0, 16.0
QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def add(name: str, sql: str | None = None):
    def register(f):
        QUERIES[name] = f
        if sql is not None:
            ORACLES[name] = sql
        return f

    return register


def joined(c):
    return F.array_join(c, "|")


def jobs(s: SparkSession, d: str) -> DataFrame:
    orders, customer = table(s, d, "orders"), table(s, d, "customer")
    return orders.join(customer, orders.o_custkey == customer.c_custkey).select(F.col("o_orderkey").alias("job_id"), F.col("c_mktsegment").alias("role"))


def brands(s: SparkSession, d: str) -> DataFrame:
    lines, part = table(s, d, "lineitem").select("l_orderkey", "l_partkey"), table(s, d, "part").select("p_partkey", "p_brand")
    return lines.join(part, lines.l_partkey == part.p_partkey).select(F.col("l_orderkey").alias("job_id"), F.col("p_brand").alias("skill")).distinct()


def matrix(s: SparkSession, d: str, noise: float = NOISE) -> DataFrame:
    rows = jobs(s, d)
    return market.role_skill_matrix(rows, rows.join(brands(s, d), "job_id").select("job_id", "role", "skill"), noise)


def owned(s: SparkSession, d: str) -> DataFrame:
    urgent = table(s, d, "orders").filter("o_orderpriority = '1-URGENT'").select(F.col("o_orderkey").alias("job_id"), F.col("o_custkey").alias("candidate"))
    lines, part = table(s, d, "lineitem").select(F.col("l_orderkey").alias("job_id"), "l_partkey"), table(s, d, "part").select(F.col("p_partkey").alias("l_partkey"), F.col("p_brand").alias("skill"))
    return urgent.join(lines, "job_id").join(part, "l_partkey").select("candidate", "skill").distinct()


def targets(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "customer").select(F.col("c_custkey").alias("candidate"), F.col("c_mktsegment").alias("role"))


BASE = """
WITH jobs AS (SELECT o_orderkey AS job_id, c_mktsegment AS role, o_custkey AS candidate, o_orderpriority FROM orders JOIN customer ON o_custkey = c_custkey),
brands AS (SELECT DISTINCT l_orderkey AS job_id, p_brand AS skill FROM lineitem JOIN part ON l_partkey = p_partkey),
totals AS (SELECT role, count(*) AS total FROM jobs GROUP BY role),
allskills AS (SELECT role, skill, round(100.0 * count(*) / any_value(total), 2) AS frequency_pct, count(*) AS count, any_value(total) AS total_jobs_in_role
  FROM jobs JOIN brands USING (job_id) JOIN totals USING (role) GROUP BY role, skill),
matrix AS (SELECT * FROM allskills WHERE frequency_pct >= 12),
owned AS (SELECT DISTINCT o_custkey AS candidate, skill FROM orders JOIN brands ON o_orderkey = job_id WHERE o_orderpriority = '1-URGENT'),
targets AS (SELECT c_custkey AS candidate, c_mktsegment AS role FROM customer)
"""


