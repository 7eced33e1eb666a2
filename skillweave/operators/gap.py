"""Skill gaps of many candidates against many roles in one plan.

owned is (candidate, skill), distinct; targets is (candidate, role); matrix is the role-by-skill matrix. Every function works
in long form, one row per candidate, role and skill, so a candidate is one filter and no candidate's rows are collected.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

CORE_PCT, IMPORTANT_PCT = 50.0, 20.0
CRITICAL_PCT, MEDIUM_PCT = 70.0, 50.0
REQUIRED_PCT = 50.0


def strength_level(pct: Column, core: float = CORE_PCT, important: float = IMPORTANT_PCT) -> Column:
    return F.when(pct >= core, "Core").when(pct >= important, "Important").otherwise("Bonus")


def severity(pct: Column, critical: float = CRITICAL_PCT, medium: float = MEDIUM_PCT) -> Column:
    return F.when(pct >= critical, "critical").when(pct >= medium, "medium").otherwise("optional")


class UnknownRole(ValueError):
    """A target role that the matrix does not have."""


def validated(targets: DataFrame, matrix: DataFrame) -> DataFrame:
    """targets, if the matrix has all their roles by their exact names; else UnknownRole with ten roles it has."""
    roles = matrix.select("role").distinct()
    wrong = targets.join(roles, "role", "left_anti").select("role").limit(1).collect()
    if wrong:
        known = [r.role for r in roles.orderBy("role").limit(10).collect()]
        raise UnknownRole(f"role {wrong[0].role!r} is not in the matrix, which has {', '.join(map(repr, known))} and others")
    return targets


def _role_skills(targets: DataFrame, matrix: DataFrame) -> DataFrame:
    return targets.join(matrix.select("role", "skill", "frequency_pct"), "role")


def _held(owned: DataFrame) -> DataFrame:
    """(candidate, low): owned skills without letter case."""
    return owned.select("candidate", F.lower("skill").alias("low")).distinct()


def strengths(owned: DataFrame, targets: DataFrame, matrix: DataFrame, core: float = CORE_PCT, important: float = IMPORTANT_PCT) -> DataFrame:
    """Owned skills of the role (letter case aside), with their level."""
    rows = _role_skills(targets, matrix).withColumn("low", F.lower("skill")).join(_held(owned), ["candidate", "low"], "left_semi").drop("low")
    return rows.withColumn("level", strength_level(F.col("frequency_pct"), core, important))


def weaknesses(owned: DataFrame, targets: DataFrame, matrix: DataFrame, critical: float = CRITICAL_PCT, medium: float = MEDIUM_PCT) -> DataFrame:
    """Missing skills of the role (letter case aside), with their severity."""
    rows = _role_skills(targets, matrix).withColumn("low", F.lower("skill")).join(_held(owned), ["candidate", "low"], "left_anti").drop("low")
    return rows.withColumn("severity", severity(F.col("frequency_pct"), critical, medium))


def extra_skills(owned: DataFrame, targets: DataFrame, matrix: DataFrame) -> DataFrame:
    """Owned skills the role does not list, letter case aside."""
    listed = matrix.select("role", F.lower("skill").alias("low")).distinct()
    return owned.join(targets, "candidate").withColumn("low", F.lower("skill")).join(listed, ["role", "low"], "left_anti").drop("low")


def readiness(owned: DataFrame, targets: DataFrame, matrix: DataFrame) -> DataFrame:
    """(candidate, role, readiness): owned share of the role's frequencies in per cent, half to even; 0 without skills.

    Skills match whatever their letter case.
    """
    rows = _role_skills(targets, matrix).withColumn("low", F.lower("skill")).join(_held(owned).withColumn("has", F.lit(True)), ["candidate", "low"], "left")
    owned_sum, total = F.sum(F.when(F.col("has"), F.col("frequency_pct")).otherwise(0.0)), F.sum("frequency_pct")
    scores = rows.groupBy("candidate", "role").agg(F.round(owned_sum, 2).alias("owned_weight"), F.round(total, 2).alias("total_weight"))
    scores = scores.withColumn("readiness", F.when(F.col("total_weight") > 0, F.bround(F.col("owned_weight") / F.col("total_weight") * 100, 0)).otherwise(0.0).cast("long"))
    return targets.join(scores, ["candidate", "role"], "left").fillna({"owned_weight": 0.0, "total_weight": 0.0, "readiness": 0})


def market_gap(owned: DataFrame, targets: DataFrame, matrix: DataFrame, required_pct: float = REQUIRED_PCT) -> DataFrame:
    """(candidate, role, required, have, need, match_pct): required are the role's skills at or above required_pct, all if none."""
    high = F.max((F.col("frequency_pct") >= required_pct).cast("int")).over(W.partitionBy("role"))
    required = matrix.withColumn("high", high).filter((F.col("high") == 0) | (F.col("frequency_pct") >= required_pct)).select("role", "skill")
    rows = targets.join(required, "role").join(owned.withColumn("has", F.lit(True)), ["candidate", "skill"], "left")
    have = F.array_sort(F.collect_list(F.when(F.col("has"), F.col("skill"))))
    need = F.array_sort(F.collect_list(F.when(F.col("has").isNull(), F.col("skill"))))
    return rows.groupBy("candidate", "role").agg(
        F.count(F.lit(1)).alias("required"), have.alias("have"), need.alias("need"), F.round(F.count("has") / F.count(F.lit(1)) * 100, 2).alias("match_pct")
    )


def improvement_actions(weak: DataFrame, templates: DataFrame | None = None, max_actions: int = 5) -> DataFrame:
    """The first max_actions gaps of each candidate and role: critical, medium, optional, by frequency within each.

    templates (skill, action) gives the texts; other skills get a general one.
    """
    priority = F.when(F.col("severity") == "critical", 1).when(F.col("severity") == "medium", 2).otherwise(3)
    ranked = weak.withColumn("priority", F.element_at(F.array(F.lit("High"), F.lit("Medium"), F.lit("Low")), priority)).withColumn(
        "rank", F.row_number().over(W.partitionBy("candidate", "role").orderBy(priority, F.desc("frequency_pct"), "skill"))
    )
    ranked = ranked.filter(F.col("rank") <= max_actions)
    general = F.concat(F.lit("Learn and practise "), F.col("skill"))
    if templates is None:
        return ranked.withColumn("action", general)
    return ranked.join(templates.select("skill", F.col("action").alias("own_action")), "skill", "left").withColumn("action", F.coalesce("own_action", general)).drop("own_action")


def merged_order(*lists: DataFrame) -> DataFrame:
    """(candidate, role, skill, step): lists of (candidate, role, skill, pos) in order of priority, each skill at its first place."""
    rows = None
    for prio, df in enumerate(lists):
        one = df.select("candidate", "role", "skill", F.lit(prio).alias("prio"), "pos")
        rows = one if rows is None else rows.unionByName(one)
    first = rows.withColumn("rn", F.row_number().over(W.partitionBy("candidate", "role", "skill").orderBy("prio", "pos"))).filter("rn = 1")
    return first.withColumn("step", F.row_number().over(W.partitionBy("candidate", "role").orderBy("prio", "pos", "skill"))).select("candidate", "role", "skill", "prio", "step")


def with_metadata(rows: DataFrame, metadata: DataFrame) -> DataFrame:
    """rows (.., skill) with category, description and importance_reason of metadata (skill, ...); null where it has none."""
    return rows.join(metadata.select("skill", "category", "description", "importance_reason").dropDuplicates(["skill"]), "skill", "left")


def gap_document(
    owned: DataFrame, targets: DataFrame, matrix: DataFrame, max_actions: int = 5, metadata: DataFrame | None = None, critical: float = CRITICAL_PCT, medium: float = MEDIUM_PCT, core: float = CORE_PCT, important: float = IMPORTANT_PCT
) -> DataFrame:
    """One nested row per candidate and role: readiness, strengths, gaps by severity, extra skills and actions.

    With metadata (skill, category, description, importance_reason) strengths, critical and medium gaps and actions carry
    what it knows of their skills, actions the reason too.
    """
    key = ["candidate", "role"]
    known = (lambda rows: rows) if metadata is None else (lambda rows: with_metadata(rows, metadata))
    about = [] if metadata is None else ["category", "description"]

    def by_pct(rows: DataFrame, name: str, extra: list[str]) -> DataFrame:
        listed = F.array_sort(F.collect_list(F.struct((-F.col("frequency_pct")).alias("o"), "skill", "label", *extra)))
        return rows.groupBy(*key).agg(F.transform(listed, lambda x: F.struct(x["skill"].alias("skill"), (-x["o"]).alias("frequency_pct"), x["label"].alias("label"), *[x[c].alias(c) for c in extra])).alias(name))

    strong = by_pct(known(strengths(owned, targets, matrix, core, important).withColumnRenamed("level", "label")), "strengths", about)
    weak = weaknesses(owned, targets, matrix, critical, medium)
    labelled = known(weak.withColumnRenamed("severity", "label"))
    if metadata is not None:
        labelled = labelled.select("*").withColumns({c: F.when(F.col("label") != "optional", F.col(c)) for c in about})
    gaps = by_pct(labelled, "gaps", about)
    extra = extra_skills(owned, targets, matrix).groupBy(*key).agg(F.array_sort(F.collect_list("skill")).alias("extra_skills"))
    reason = [] if metadata is None else ["category", "description", "importance_reason"]
    actions = known(improvement_actions(weak, max_actions=max_actions)).groupBy(*key).agg(F.array_sort(F.collect_list(F.struct("rank", "priority", "skill", "action", *reason))).alias("actions"))
    out = readiness(owned, targets, matrix)
    for part in (strong, gaps, extra, actions):
        out = out.join(part, key, "left")
    of = lambda name: F.filter("gaps", lambda x: x["label"] == name)
    return out.select(
        *key, "readiness", "strengths", of("critical").alias("critical_gaps"), of("medium").alias("medium_gaps"), of("optional").alias("optional_gaps"), "extra_skills", "actions"
    )
