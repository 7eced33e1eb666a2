"""Career stages by rule tables: months of work history, skill depth, title and education signals."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

CV = "work_history array<struct<duration_months: int>>, experience_years double, skills array<string>, job_titles array<string>, education string"
_RULES = (
    "stages array<string>, rules struct<experience_thresholds: map<string, struct<min_years: double, max_years: double>>, skill_depth_adjustments: struct<advanced_skills: array<string>>, "
    "job_title_keywords: map<string, array<string>>, education_signals: map<string, struct<indicators: array<string>, stage: string>>>"
)
#: The order in which education signals count, fixed values.
EDUCATION = ("currently_studying", "recent_graduate")


class StageRules(NamedTuple):
    """thresholds (ordinal, stage, max_years), advanced (skill), titles and education (ordinal, stage, keyword)."""

    thresholds: DataFrame
    advanced: DataFrame
    titles: DataFrame
    education: DataFrame


def read_stage_rules(spark: SparkSession, path: str) -> StageRules:
    """The rule file's tables; parts that it lacks are empty. Stages and keywords keep the file's order of stages."""
    parsed = spark.read.text(path, wholetext=True).select(F.from_json("value", _RULES).alias("r"))
    order = parsed.select(F.posexplode("r.stages").alias("ordinal", "stage"))
    limits = parsed.select(F.explode("r.rules.experience_thresholds").alias("stage", "t")).select("stage", "t.max_years")
    words = parsed.select(F.explode("r.rules.job_title_keywords").alias("stage", "words")).select("stage", F.explode("words").alias("keyword"))
    signals = parsed.select(F.explode("r.rules.education_signals").alias("signal", "s"))
    rank = F.array_position(F.array(*[F.lit(x) for x in EDUCATION]), F.col("signal")).cast("int")
    return StageRules(
        order.join(limits, "stage", "left").select("ordinal", "stage", "max_years"),
        parsed.select(F.explode("r.rules.skill_depth_adjustments.advanced_skills").alias("skill")),
        words.join(order, "stage").select("ordinal", "stage", "keyword"),
        signals.select(rank.alias("ordinal"), "s.stage", F.explode("s.indicators").alias("keyword")).filter("ordinal > 0"),
    )


def _listed(rows: DataFrame, *fields: str) -> DataFrame:
    """A rule table as one row: its structs in order."""
    return rows.agg(F.array_sort(F.collect_list(F.struct(*fields))).alias("x"))


def detected_stages(cvs: DataFrame, rules: StageRules, key: str = "candidate") -> DataFrame:
    """(key, stage, confidence, years, skill_count, advanced, title_stage, education_stage, reason) of CVs (key and the columns of CV).

    Years are the months of the work history over twelve, or experience_years without a history; unknown if the months are
    none. The base stage is the first whose threshold they do not pass, the first of all if unknown, the last beyond all.
    Three advanced skills raise it by one, five by two, to the last at most. Titles and education are signals: a stage told
    by the titles that agrees raises the confidence, as an advanced skill does, unknown years lower it. Nulls count as nothing given.
    """
    none = lambda kind: F.array().cast(f"array<{kind}>")
    one = cvs
    for name, table in (("_stages", _listed(rules.thresholds, "ordinal", "stage", "max_years")), ("_titles", _listed(rules.titles, "ordinal", "stage", "keyword")), ("_edu", _listed(rules.education, "ordinal", "stage", "keyword"))):
        one = one.join(F.broadcast(table.withColumnRenamed("x", name)), F.lit(True))
    one = one.join(F.broadcast(rules.advanced.agg(F.collect_set("skill").alias("_advanced"))), F.lit(True))
    history, skills, titles = F.coalesce("work_history", none("struct<duration_months: int>")), F.coalesce("skills", none("string")), F.coalesce("job_titles", none("string"))
    months = F.aggregate(history, F.lit(0).cast("long"), lambda n, x: n + F.coalesce(x["duration_months"], F.lit(0)))
    years = F.when(F.size(history) == 0, F.col("experience_years")).when(months > 0, months / 12.0)
    advanced = F.size(F.filter(skills, lambda x: F.array_contains("_advanced", x)))
    last = F.size("_stages") - 1
    passed = F.size(F.filter("_stages", lambda x: (x["ordinal"] < last) & (F.col("years") > x["max_years"])))
    base = F.when(F.col("years").isNull(), 0).otherwise(passed)
    level = F.least(last, base + F.when(F.col("advanced") >= 5, 2).when(F.col("advanced") >= 3, 1).otherwise(0))
    told = F.filter("_titles", lambda r: F.exists(titles, lambda t: F.contains(F.lower(t), r["keyword"])))
    learned = F.filter("_edu", lambda r: F.contains(F.lower(F.coalesce("education", F.lit(""))), r["keyword"]))
    rows = one.withColumn("years", years).withColumn("advanced", advanced)
    rows = rows.withColumn("stage", F.element_at("_stages", (level + 1).cast("int"))["stage"]).withColumn("title_stage", F.try_element_at(told, F.lit(1))["stage"])
    sure = F.lit(0.7) + F.when(F.col("title_stage") == F.col("stage"), 0.1).otherwise(0.0) - F.when(F.col("years").isNull(), 0.2).otherwise(0.0) + F.when(F.col("advanced") > 0, 0.1).otherwise(0.0)
    known = F.when(F.col("years").isNull(), "không có thông tin kinh nghiệm").otherwise(F.format_string("%.1f năm kinh nghiệm", F.bround("years", 1)))
    some = F.when(F.col("advanced") > 0, F.format_string("có %d advanced skills", "advanced"))
    return rows.select(
        key, "stage", F.round(F.greatest(F.lit(0.0), F.least(F.lit(1.0), sure)), 2).alias("confidence"), "years", F.size(skills).alias("skill_count"), "advanced", "title_stage",
        F.try_element_at(learned, F.lit(1))["stage"].alias("education_stage"), F.concat_ws(" + ", known, F.format_string("%d core skills", F.size(skills)), some).alias("reason"),
    )
