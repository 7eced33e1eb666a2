"""Configuration of the graph and roadmap queries, for Spark and as SQL: a skill graph, clusters, projects, brands as skills."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from skillweave.session import table

NODES = ["python", "sql", "statistics", "pandas", "ml", "dl", "nlp", "llm", "rag", "docker", "mlops"]
EDGES = [
    ("pandas", "python", "prerequisite", 0),
    ("ml", "python", "prerequisite", 0),
    ("ml", "statistics", "prerequisite", 1),
    ("ml", "pandas", "prerequisite", 2),
    ("dl", "ml", "prerequisite", 0),
    ("nlp", "dl", "prerequisite", 0),
    ("llm", "nlp", "prerequisite", 0),
    ("llm", "dl", "prerequisite", 1),
    ("rag", "llm", "prerequisite", 0),
    ("rag", "sql", "prerequisite", 1),
    ("mlops", "docker", "prerequisite", 0),
    ("mlops", "ml", "prerequisite", 1),
    ("python", "pandas", "leads_to", 0),
    ("python", "ml", "leads_to", 1),
    ("pandas", "ml", "leads_to", 0),
    ("ml", "dl", "leads_to", 0),
    ("ml", "mlops", "leads_to", 1),
    ("dl", "nlp", "leads_to", 0),
    ("docker", "mlops", "leads_to", 0),
    ("sql", "pandas", "related", 0),
    ("statistics", "ml", "related", 0),
    ("llm", "rag", "related", 0),
]
CLUSTERS = [("data", "python", 0), ("data", "sql", 1), ("data", "pandas", 2), ("ai", "ml", 0), ("ai", "dl", 1), ("ai", "nlp", 2), ("ops", "docker", 0), ("ops", "mlops", 1)]
#: How many of the 25 brands, in order, stand for each node: skills that many or few candidates own.
BRANDS_PER_NODE = (5, 4, 3, 3, 2, 2, 2, 1, 1, 1, 1)
PAIRS = [("python", "sql"), ("python", "ml"), ("dl", "ml"), ("pandas", "statistics")]
POOL = [
    ("Sales dashboard", "Beginner", ["Python", "SQL", "Pandas"], ["Student", "Fresher"]),
    ("Churn model", "Intermediate", ["Python", "SQL"], ["Junior"]),
    ("Container lab", "Beginner", ["docker", "mlops"], ["Fresher"]),
    ("Question answering", "Advanced", ["LLM", "RAG", "Python"], ["Senior"]),
]


def _values(name: str, columns: str, rows) -> str:
    show = lambda x: "[" + ", ".join(map(repr, x)) + "]" if isinstance(x, list) else (f"CAST({x} AS DOUBLE)" if isinstance(x, float) else repr(x))
    return f"{name}({columns}) AS (VALUES " + ", ".join("(" + ", ".join(map(show, r)) + ")" for r in rows) + ")"


GRAPH_SQL = _values("edges", "src, dst, type, ordinal", EDGES)
CLUSTER_SQL = _values("clusters", "cluster, skill, pos", CLUSTERS)
POOL_SQL = _values("pool", "name, difficulty, primary_skills, suitable_stages", POOL)


def brand_nodes() -> list[tuple[str, str]]:
    """(brand, node): brands in order, node after node."""
    names = [f"Brand#{i}" for i in range(1, 26)]
    return list(zip(names, [n for n, k in zip(NODES, BRANDS_PER_NODE) for _ in range(k)]))


BRAND_SQL = _values("brandnode", "brand, node", brand_nodes())


def edges(s: SparkSession) -> DataFrame:
    return s.createDataFrame(EDGES, "src string, dst string, type string, ordinal int")


def nodes(s: SparkSession) -> DataFrame:
    return s.createDataFrame([(n,) for n in NODES], "skill string")


def clusters(s: SparkSession) -> DataFrame:
    return s.createDataFrame(CLUSTERS, "cluster string, skill string, pos int")


def pool(s: SparkSession) -> DataFrame:
    return s.createDataFrame(POOL, "name string, difficulty string, primary_skills array<string>, suitable_stages array<string>")


def spelled_parts(s: SparkSession, d: str) -> DataFrame:
    """(p_partkey, name): part names, four of five spelled in another way."""
    n, k = F.col("p_name"), F.col("p_partkey") % 5
    spelled = F.when(k == 1, F.concat(F.substring(n, 1, 1), F.expr("substring(p_name, 3)"))).when(k == 2, F.concat(F.substring(n, 1, 3), F.expr("substring(p_name, 3)"))).when(k == 3, F.upper(n)).when(k == 4, F.concat(n, F.lit("s")))
    return table(s, d, "part").select("p_partkey", F.coalesce(spelled, n).alias("name"))


def part_names(s: SparkSession, d: str) -> DataFrame:
    """The vocabulary of the most frequent spellings of part names: (name, ordinal, frequency)."""
    from skillweave.operators.fuzzy import TOP_NAMES
    from skillweave.operators.market import top_values

    top = top_values(spelled_parts(s, d).select("name"), "name", TOP_NAMES)
    return top.select("name", F.row_number().over(W.orderBy(F.desc("n"), "name")).alias("ordinal"), F.col("n").alias("frequency"))
