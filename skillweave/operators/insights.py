"""Graph insights of a gap analysis and the roadmap documents built on them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from skillweave.operators import gap, graph, narratives, roadmap
from skillweave.storage import Levels, stored

STRONG_PCT, OPTIONAL_PCT = 50.0, 20.0


def graph_insights(owned: DataFrame, targets: DataFrame, matrix: DataFrame, edges: DataFrame, strong: float = STRONG_PCT, optional: float = OPTIONAL_PCT) -> DataFrame:
    """(candidate, role, kind, skill, via, pos): what is missing before gaps, what strengths lead to, what optional gaps need.

    kind is prerequisite (of a gap), expand (a strength at strong leads there and it is not owned) or deepen (needed by an
    optional gap at optional); pos orders a kind's rows by the frequency of the skill they come from.
    """
    weak, good = gap.weaknesses(owned, targets, matrix), gap.strengths(owned, targets, matrix)
    needs = edges.filter("type = 'prerequisite'").select(F.col("src").alias("via"), F.col("dst").alias("skill"), "ordinal")
    leads = edges.filter("type = 'leads_to'").select(F.col("src").alias("via"), F.col("dst").alias("skill"), "ordinal")

    def through(rows: DataFrame, links: DataFrame, kind: str) -> DataFrame:
        met = rows.select("candidate", "role", F.col("skill").alias("via"), "frequency_pct").join(links, "via").join(owned, ["candidate", "skill"], "left_anti")
        first = met.withColumn("rn", F.row_number().over(W.partitionBy("candidate", "role", "skill").orderBy(F.desc("frequency_pct"), "via", "ordinal"))).filter("rn = 1")
        pos = F.row_number().over(W.partitionBy("candidate", "role").orderBy(F.desc("frequency_pct"), "via", "ordinal"))
        return first.withColumn("pos", pos).select("candidate", "role", F.lit(kind).alias("kind"), "skill", "via", "pos")

    gaps = through(weak.filter("severity <> 'optional'"), needs, "prerequisite")
    expand = through(good.filter(F.col("frequency_pct") >= strong), leads, "expand")
    deepen = through(weak.filter((F.col("severity") == "optional") & (F.col("frequency_pct") >= optional)), needs, "deepen")
    return gaps.unionByName(expand).unionByName(deepen)


def learning_order(weak: DataFrame, insights: DataFrame) -> DataFrame:
    """(candidate, role, skill, prio, step): prerequisites, critical and medium gaps, expansions, deepenings; first place wins."""
    at = lambda severity: weak.filter(F.col("severity") == severity).withColumn("pos", F.row_number().over(W.partitionBy("candidate", "role").orderBy(F.desc("frequency_pct"), "skill")))
    of = lambda kind: insights.filter(F.col("kind") == kind)
    return gap.merged_order(of("prerequisite"), at("critical"), at("medium"), of("expand"), of("deepen"))


def penalty_lengths(goals: DataFrame, owned: DataFrame, edges: DataFrame) -> DataFrame:
    """(candidate, goal, missing): prerequisite edges met on the way up, so a skill needed from two places counts twice.

    Every skill of a walk is expanded once; owned skills end it.
    """
    reached = graph.missing_prerequisites(goals, owned, edges).select("candidate", "goal", "skill").unionByName(goals.select("candidate", "goal", F.col("goal").alias("skill")))
    needs = edges.filter("type = 'prerequisite'").select(F.col("src").alias("skill"), F.col("dst").alias("need")).distinct()
    met = reached.join(needs, "skill").join(owned.select("candidate", F.col("skill").alias("need")), ["candidate", "need"], "left_anti")
    return goals.join(met.groupBy("candidate", "goal").agg(F.count(F.lit(1)).alias("missing")), ["candidate", "goal"], "left").fillna({"missing": 0})


def rule_phases(weak: DataFrame, insights: DataFrame, closing: str = "docker") -> DataFrame:
    """(candidate, role, phase, skill): at most three prerequisites, two medium gaps, two critical and one optional gap at 30 %,
    two expansions and a closing skill, as phases 1 to 4."""
    take = lambda rows, order, n, phase: rows.withColumn("rn", F.row_number().over(W.partitionBy("candidate", "role").orderBy(*order))).filter(F.col("rn") <= n).select("candidate", "role", F.lit(phase).alias("phase"), "skill")
    by = (F.desc("frequency_pct"), F.col("skill"))
    keys = weak.select("candidate", "role").distinct()
    parts = [
        take(insights.filter("kind = 'prerequisite'"), ("pos",), 3, 1),
        take(weak.filter("severity = 'medium'"), by, 2, 2),
        take(weak.filter("severity = 'critical'"), by, 2, 3),
        take(weak.filter("severity = 'optional' AND frequency_pct >= 30"), by, 1, 3),
        take(insights.filter("kind = 'expand'"), ("pos",), 2, 4),
        keys.select("candidate", "role", F.lit(4).alias("phase"), F.lit(closing).alias("skill")),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.distinct()


def roadmap_document(owned: DataFrame, targets: DataFrame, matrix: DataFrame, edges: DataFrame) -> DataFrame:
    """One nested row per candidate and role: readiness today, phases of gaps with prerequisites before, projected scores.

    Depth is the walk from each gap up to owned skills; phases chunk the gaps by depth, deepest prerequisites first, and
    are repaired until a prerequisite never sits later.
    """
    weak = gap.weaknesses(owned, targets, matrix).filter("severity <> 'optional'")
    goals = weak.select("candidate", F.col("skill").alias("goal"))
    depth = graph.missing_prerequisites(goals, owned, edges).groupBy("candidate", F.col("goal").alias("skill")).agg(F.max("depth").alias("depth"))
    rows = weak.select("candidate", "skill", "frequency_pct").join(depth, ["candidate", "skill"], "left").fillna({"depth": 0})
    ordered = rows.withColumn("pos", F.row_number().over(W.partitionBy("candidate").orderBy("depth", F.desc("frequency_pct"), "skill")))
    phases = roadmap.repaired_phases(roadmap.chunk_phases(ordered.select("candidate", "skill", "pos")).select("candidate", "skill", "phase"), edges)
    listed = phases.groupBy("candidate", "phase").agg(F.array_sort(F.collect_list("skill")).alias("skills")).groupBy("candidate").agg(F.array_sort(F.collect_list(F.struct("phase", "skills"))).alias("phases"))
    return gap.readiness(owned, targets, matrix).select("candidate", "role", "readiness").join(listed, "candidate", "left")


def ordered_statuses(owned: DataFrame, targets: DataFrame, matrix: DataFrame, edges: DataFrame) -> DataFrame:
    """(candidate, completed, partial, missing): the role's skills by status, the most frequent first; see roadmap.overlay."""
    weak = gap.weaknesses(owned, targets, matrix)
    rows = roadmap.overlay(gap.strengths(owned, targets, matrix).select("candidate", "skill"), weak, edges).join(targets, "candidate").join(matrix.select("role", "skill", "frequency_pct"), ["role", "skill"])
    listed = lambda status: F.transform(F.array_sort(F.collect_list(F.when(F.col("status") == status, F.struct((-F.col("frequency_pct")).alias("o"), "skill")))), lambda x: x["skill"]).alias(status)
    return rows.groupBy("candidate").agg(listed("completed"), listed("partial"), listed("missing"))


def full_roadmap(owned: DataFrame, targets: DataFrame, matrix: DataFrame, edges: DataFrame, stages: DataFrame, pool: DataFrame, allowed: dict[str, list[str]], threshold: float = 0.5) -> DataFrame:
    """One nested row for each candidate and role: stage, readiness, scores today and at the end, phases, story and report.

    targets has one role for each candidate, stages is (candidate, stage), pool the projects. A phase is a struct of its
    number, title, skills, mean depth, reason, paragraph, project (null without a fitting one), score after it and gain.
    Phases hold the missing skills with all their prerequisites; scores are those of the graph projection with a skill's
    frequency as weight. The report tells the score from the bottlenecks and the prerequisites that are missing today.
    Candidates who lack nothing have no phases.
    """
    spark = owned.sparkSession
    plan, scored = Levels(spark, "phases"), Levels(spark, "scores")
    weak = gap.weaknesses(owned, targets, matrix)
    plan.add(0, roadmap.expanded_phases(owned, weak, edges))
    rank = F.row_number().over(W.partitionBy("candidate").orderBy(F.desc("frequency_pct"), "skill"))
    skills = targets.join(matrix, "role").select("candidate", "skill", (F.col("frequency_pct") / 100).alias("weight"), F.lit(1.0).alias("market"), rank.alias("ordinal"))
    scored.add(0, roadmap.graph_projection(skills, owned, plan.at(0).select("candidate", "phase", "skill"), edges))
    scores, summary = scored.at(0), roadmap.expanded_summary(plan.at(0)).join(stages, "candidate", "left")
    wanted = summary.select(F.struct("candidate", "phase").alias("phase_id"), "stage", "skills")
    projects = roadmap.select_projects(wanted, pool, allowed, threshold).select("phase_id.candidate", "phase_id.phase", F.col("name").alias("project"))
    told = narratives.phase_narrative(F.col("phase"), F.col("title"), F.col("skills"), F.col("avg_depth"))
    parts = summary.withColumn("paragraph", told).join(projects, ["candidate", "phase"], "left").join(scores.select("candidate", "phase", "score", "delta"), ["candidate", "phase"])
    parts = parts.groupBy("candidate").agg(F.array_sort(F.collect_list(F.struct("phase", "title", "skills", "avg_depth", "reason", "paragraph", "project", "score", "delta"))).alias("phases"))
    today = scores.groupBy("candidate").agg(F.min_by("score", "phase").alias("current_score"), F.max_by("score", "phase").alias("final_score"), F.min_by("bottlenecks", "phase").alias("bottlenecks"))
    short = penalty_lengths(weak.select("candidate", F.col("skill").alias("goal")), owned, edges).filter("missing > 0")
    lost = short.groupBy("candidate").agg(F.array_sort(F.collect_list(F.struct(F.col("goal").alias("skill"), F.least(F.lit(roadmap.PENALTY) * F.col("missing"), F.lit(roadmap.PENALTY_CAP)).alias("penalty")))).alias("penalties"))
    rows = gap.readiness(owned, targets, matrix).select("candidate", "role", "readiness")
    for part in (stages, today, lost, parts, ordered_statuses(owned, targets, matrix, edges)):
        rows = rows.join(part, "candidate", "left")
    rows = stored(rows.withColumn("first_phase", F.try_element_at("phases", F.lit(1))["skills"]), "documents")
    story = narratives.personal_story(rows).select("candidate", F.struct("summary", "focus", "advice").alias("story"))
    report = narratives.score_report(rows).select("candidate", F.struct("report", "weaknesses", "next_actions", "improvement").alias("report"))
    whole = rows.join(story, "candidate").join(report, "candidate")
    return whole.select("candidate", "role", "stage", "readiness", "current_score", "final_score", "bottlenecks", "completed", "partial", "missing", "phases", "story", "report")
