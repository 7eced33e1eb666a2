"""Sources and sinks: declared schemas, CSV with encoding choice, JSON maps, unified records, vector tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from skillweave.functions.text import surrogate_key
from skillweave.operators.numbering import numbered
from skillweave.sources.delimited import read_delimited

METADATA = "struct<company: string, location: string, seniority: string, salary_vnd: string, original_id: string>"
RECORD = f"record_id string, source string, record_type string, title string, description string, skills_raw array<string>, category string, metadata {METADATA}"
MATRIX = "role string, skill string, frequency_pct double, count bigint, total_jobs_in_role bigint"


class MissingInput(FileNotFoundError):
    """An input that a caller asked for does not exist."""


def read_csv(spark: SparkSession, path: str | list[str], schema: str | None = None) -> DataFrame:
    """CSV files with header, quoted line breaks and doubled quotes, each file in its own encoding (see delimited)."""
    return read_delimited(spark, path, schema)


def read_matrix(spark: SparkSession, path: str) -> DataFrame:
    """The role-by-skill matrix from CSV with or without a byte order mark."""
    df = read_csv(spark, path)
    return df.select(*[F.col(f.name).cast(f.dataType) for f in T._parse_datatype_string(MATRIX).fields])


def read_or_none(spark: SparkSession, path: str, kind: str = "parquet") -> DataFrame | None:
    """A table, or None where the path does not exist; any other failure is raised."""
    from pyspark.errors import AnalysisException

    try:
        return spark.read.format(kind).load(path)
    except AnalysisException as e:
        if "PATH_NOT_FOUND" in str(e):
            return None
        raise


def required(df: DataFrame | None, what: str) -> DataFrame:
    if df is None:
        raise MissingInput(what)
    return df


def json_map(spark: SparkSession, path: str, key: str = "alias", value: str = "canonical") -> DataFrame:
    """One JSON object of strings as rows (key, value)."""
    text = spark.read.text(path, wholetext=True)
    return text.select(F.explode(F.from_json("value", "map<string,string>")).alias(key, value))


def skill_graph(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """nodes (skill, category), edges (src, dst, type, ordinal) and clusters (cluster, skill, pos) of a graph file.

    The file holds skills: name -> {category, prerequisites, related, leads_to}, and skill_clusters: name -> names.
    """
    node = "struct<category: string, prerequisites: array<string>, related: array<string>, leads_to: array<string>>"
    text = spark.read.text(path, wholetext=True)
    parsed = text.select(F.from_json("value", f"skills map<string, {node}>, skill_clusters map<string, array<string>>").alias("g"))
    nodes = parsed.select(F.explode("g.skills").alias("skill", "n"))
    kinds = (("prerequisites", "prerequisite"), ("related", "related"), ("leads_to", "leads_to"))
    edges = None
    for column, kind in kinds:
        one = nodes.select(F.col("skill").alias("src"), F.posexplode(f"n.{column}").alias("ordinal", "dst")).select("src", "dst", F.lit(kind).alias("type"), "ordinal")
        edges = one if edges is None else edges.unionByName(one)
    clusters = parsed.select(F.explode("g.skill_clusters").alias("cluster", "names")).select("cluster", F.posexplode("names").alias("pos", "skill"))
    return nodes.select("skill", "n.category"), edges, clusters.select("cluster", "skill", "pos")


PROJECT = "struct<name: string, difficulty: string, primary_skills: array<string>, tech_stack: array<string>, deliverables: array<string>, learning_outcomes: array<string>, estimated_hours: int, suitable_stages: array<string>>"


def project_pool(spark: SparkSession, path: str) -> DataFrame:
    """The projects of a pool file {projects: {name: {...}}}, one row each."""
    parsed = spark.read.text(path, wholetext=True).select(F.from_json("value", f"projects map<string, {PROJECT}>").alias("p"))
    return parsed.select(F.explode("p.projects").alias("key", "project")).select(F.coalesce("project.name", "key").alias("name"), *[f"project.{c}" for c in ("difficulty", "primary_skills", "tech_stack", "deliverables", "learning_outcomes", "estimated_hours", "suitable_stages")])


def skill_metadata(spark: SparkSession, path: str) -> DataFrame:
    """(skill, category, description, importance_reason) of a file {skill: {...}}."""
    kind = "map<string, struct<category: string, description: string, importance_reason: string>>"
    return spark.read.text(path, wholetext=True).select(F.explode(F.from_json("value", kind)).alias("skill", "m")).select("skill", "m.*")


def prompt_template(spark: SparkSession, path: str) -> str:
    """The text of one template file."""
    return spark.read.text(path, wholetext=True).first().value


def ontology(*parts: DataFrame) -> DataFrame:
    """(alias, canonical): parts (alias, canonical) in order of priority, aliases in lower case, the first one wins."""
    rows = None
    for prio, df in enumerate(parts):
        one = df.select(F.lower("alias").alias("alias"), "canonical", F.lit(prio).alias("prio"))
        rows = one if rows is None else rows.unionByName(one)
    rn = F.row_number().over(W.partitionBy("alias").orderBy("prio", "canonical"))
    return rows.withColumn("rn", rn).filter("rn = 1").select("alias", "canonical")


def unified(rows: DataFrame, prefix: str, source: str, record_type: str, order: str | list[str], **columns) -> DataFrame:
    """A source's rows as unified records; columns name title, description, skills_raw, category and metadata fields.

    Keys number the rows in the declared order, range by range, so no task sorts a whole source.
    """
    fields = [f.name for f in T._parse_datatype_string(METADATA).fields]
    at = lambda name, kind: columns[name].cast(kind) if name in columns else F.lit(None).cast(kind)
    wanted = rows.select(
        *[F.col(f"`{c}`").alias(f"_o{i}") for i, c in enumerate([order] if isinstance(order, str) else order)],
        at("title", "string").alias("title"),
        at("description", "string").alias("description"),
        at("skills_raw", "array<string>").alias("skills_raw"),
        at("category", "string").alias("category"),
        F.struct(*[at(f, "string").alias(f) for f in fields]).alias("metadata"),
    )
    counted, total = numbered(wanted, [c for c in wanted.columns if c.startswith("_o")], "_n")
    return counted.select(
        surrogate_key(prefix, F.col("_n"), F.lit(total)).alias("record_id"),
        F.lit(source).alias("source"),
        F.lit(record_type).alias("record_type"),
        "title",
        "description",
        "skills_raw",
        "category",
        "metadata",
    )


def union_records(*sources: DataFrame) -> DataFrame:
    out = sources[0]
    for df in sources[1:]:
        out = out.unionByName(df, allowMissingColumns=True)
    return out


def write_table(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").parquet(path)


def write_csv(df: DataFrame, path: str) -> None:
    """CSV with header and doubled quotes, as read_csv reads it; no byte order mark."""
    df.write.mode("overwrite").options(header=True, escape='"').csv(path)


def write_json(df: DataFrame, path: str) -> None:
    """One JSON document a row, nulls left out."""
    df.select(F.to_json(F.struct("*"), {"ignoreNullFields": "true"}).alias("value")).write.mode("overwrite").text(path)


def write_vectors(df: DataFrame, path: str) -> None:
    """A vector collection (id, embedding, document, metadata) that replaces the one before."""
    df.select("id", F.col("embedding").cast("array<float>").alias("embedding"), "document", "metadata").write.mode("overwrite").parquet(path)
