"""Roadmaps: phases from prerequisite depth, projected scores, overlays, career stage, projects."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from skillweave.operators import walks
from skillweave.operators.graph import depth_to_owned, prerequisites
from skillweave.storage import Levels, stored

MAX_PER_PHASE, MIN_PER_PHASE, MAX_PHASES = 5, 2, 6
PENALTY, PENALTY_CAP, SYNERGY, SYNERGY_CAP = 0.15, 0.5, 0.02, 0.10


def chunk_phases(ordered: DataFrame, by: str = "candidate", max_per: int = MAX_PER_PHASE, min_per: int = MIN_PER_PHASE) -> DataFrame:
    """Adds phase (from 1) to rows (by, pos, ...): even chunks in order of pos, as few as max_per allows, of min_per at least.

    A last chunk below min_per joins the one before.
    """
    rank = F.row_number().over(W.partitionBy(by).orderBy("pos")) - 1
    total = F.count(F.lit(1)).over(W.partitionBy(by))
    size = F.greatest(F.lit(min_per), F.ceil(F.col("_n") / F.ceil(F.col("_n") / max_per)).cast("int"))
    phase = F.floor(F.col("_r") / F.col("_s")).cast("int") + 1
    last = F.ceil(F.col("_n") / F.col("_s")).cast("int")
    short = (last > 1) & (F.col("_n") - (last - 1) * F.col("_s") < min_per)
    out = ordered.withColumn("_r", rank).withColumn("_n", total).withColumn("_s", size)
    return out.withColumn("phase", F.when(short & (phase == last), last - 1).otherwise(phase)).drop("_r", "_n", "_s")


def repaired_phases(phases: DataFrame, edges: DataFrame, by: str = "candidate") -> DataFrame:
    """(by, skill, phase): no skill before its prerequisites.

    A skill that moves one phase later while a prerequisite sits in a later one ends in the latest phase of all it needs,
    directly or through other skills of the roadmap; that phase is looked up by a walk inside the roadmap. Prerequisites in
    a circle meet in one phase.
    """
    own = phases.select(by, F.col("skill").alias("node"))
    needs = walks.reached(phases.select(by, "skill", F.col("skill").alias("node")), prerequisites(edges), [by, "skill"], inside=own)
    latest = needs.join(phases.select(by, F.col("skill").alias("node"), F.col("phase").cast("int").alias("phase")), [by, "node"])
    return latest.groupBy(by, "skill").agg(F.max("phase").alias("phase"))


def expanded_phases(owned: DataFrame, missing: DataFrame, edges: DataFrame, max_per: int = MAX_PER_PHASE, min_per: int = MIN_PER_PHASE, max_phases: int = MAX_PHASES) -> DataFrame:
    """(candidate, phase, skill, depth, pos): missing skills (candidate, skill) and all their prerequisites that are not owned, in phases.

    The depth of a skill is the longest chain that leads from an owned skill to it through skills to learn; 0 without one.
    Skills are cut in order of depth and name into even phases: as many as max_per needs but at most max_phases, of at least
    min_per skills; then none stays before its prerequisites (repaired_phases). Candidates who miss nothing have no rows.
    """
    mine = owned.select("candidate", F.col("skill").alias("node")).distinct()
    closed = walks.reached(missing.select("candidate", F.col("skill").alias("node")), prerequisites(edges), ["candidate"], barred=mine)
    learn = closed.select("candidate", "node").join(mine, ["candidate", "node"], "left_anti")
    down = prerequisites(edges).select(F.col("dst").alias("src"), F.col("src").alias("dst"))
    depth = walks.farthest(mine, down, ["candidate"], inside=learn)
    rows = learn.join(depth, ["candidate", "node"], "left").select("candidate", F.col("node").alias("skill"), F.coalesce("depth", F.lit(0)).alias("depth"))
    every = W.partitionBy("candidate")
    pos = F.row_number().over(every.orderBy("depth", "skill"))
    n = F.count(F.lit(1)).over(every)
    wanted = F.least(F.lit(max_phases), F.greatest(F.lit(1), F.ceil(F.col("_n") / max_per)))
    size = F.greatest(F.lit(min_per), F.ceil(F.col("_n") / wanted)).cast("int")
    cut = rows.withColumn("pos", pos).withColumn("_n", n).withColumn("phase", (F.floor((F.col("pos") - 1) / size) + 1).cast("int")).drop("_n")
    kept = Levels(owned.sparkSession, "phases")
    kept.add(0, cut)
    return kept.at(0).drop("phase").join(repaired_phases(kept.at(0).select("candidate", "skill", "phase"), edges), ["candidate", "skill"])


def expanded_reason(depth: Column) -> Column:
    """One sentence on a phase by the mean depth of its skills; the wordings are fixed values."""
    return (
        F.when(depth < 1, "Kiến thức nền tảng, làm quen với các khái niệm cơ bản")
        .when(depth < 2, "Kỹ năng cốt lõi, xây dựng nền tảng vững chắc")
        .when(depth < 3, "Phát triển chuyên sâu, áp dụng vào dự án thực tế")
        .otherwise("Kỹ năng nâng cao, tối ưu và mở rộng hệ thống")
    )


def phase_title(phase: Column) -> Column:
    return F.coalesce(F.try_element_at(F.array(*[F.lit(t) for t in TITLES]), phase.cast("int")), F.concat(F.lit("Phase "), phase.cast("string")))


def expanded_summary(phases: DataFrame) -> DataFrame:
    """(candidate, phase, title, skills, skill_count, avg_depth, reason) of expanded_phases; skills by depth and name."""
    found = phases.groupBy("candidate", "phase").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "skill"))), lambda x: x["skill"]).alias("skills"), F.avg("depth").alias("mean"))
    return found.select("candidate", "phase", phase_title(F.col("phase")).alias("title"), "skills", F.size("skills").alias("skill_count"), F.round("mean", 2).alias("avg_depth"), expanded_reason(F.col("mean")).alias("reason"))


def projection(owned: DataFrame, phases: DataFrame, weights: DataFrame, by: str = "candidate") -> DataFrame:
    """(by, phase, score, delta): readiness after each phase, phase 0 being today; weights is (skill, weight).

    A phase's skills count from that phase on: the running sum of newly owned weights over the total, half to even.
    """
    total = weights.agg(F.sum("weight").alias("total"))
    today = owned.join(weights, "skill").groupBy(by).agg(F.sum("weight").alias("w")).select(by, F.lit(0).alias("phase"), "w")
    fresh = phases.join(owned, [by, "skill"], "left_anti").groupBy(by, "skill").agg(F.min("phase").alias("phase")).join(weights, "skill").groupBy(by, "phase").agg(F.sum("weight").alias("w"))
    steps = phases.select(by, "phase").union(phases.select(by, F.lit(0))).distinct()
    rows = steps.join(today.unionByName(fresh), [by, "phase"], "left").fillna({"w": 0.0}).join(F.broadcast(total), F.lit(True))
    order = W.partitionBy(by).orderBy("phase")
    score = F.bround(F.sum("w").over(order.rowsBetween(W.unboundedPreceding, W.currentRow)) / F.col("total") * 100, 0).cast("long")
    return rows.withColumn("score", score).select(by, "phase", "score", (F.col("score") - F.coalesce(F.lag("score").over(order), F.col("score"))).alias("delta"))


def graph_score(skills: DataFrame, by: str = "candidate") -> DataFrame:
    """(by, score): sum of weight * completion * (1 - min(0.15 missing, 0.5)) * market over the sum of weights, a whole number, at most 100.

    skills is (by, skill, weight, completion, missing, market).
    """
    part = F.col("weight") * F.col("completion") * (1 - F.least(F.lit(PENALTY) * F.col("missing"), F.lit(PENALTY_CAP))) * F.col("market")
    return skills.groupBy(by).agg(F.bround(F.least(F.lit(100.0), F.sum(part) / F.sum("weight") * 100), 0).cast("long").alias("score"))


def bottlenecks(skills: DataFrame, by: str = "candidate") -> DataFrame:
    """The three skills of lowest completion (ties by ordinal), of these the ones below one half."""
    rank = F.row_number().over(W.partitionBy(by).orderBy("completion", "ordinal", "skill"))
    return skills.withColumn("rank", rank).filter((F.col("rank") <= 3) & (F.col("completion") < 0.5)).select(by, "rank", "skill", "completion")


def weighted_score(skills: DataFrame, pairs: DataFrame, by: str = "candidate") -> DataFrame:
    """(by, score): weighted mastery * market, times the product of 1 - min(penalty, 0.5) of missing skills, times 1 + synergy,
    a whole number, at most 100.

    skills is (by, skill, weight, mastery, market, penalty, status); pairs (a, b) of owned skills add 0.02 each, 0.10 at most.
    """
    base = F.sum(F.col("weight") * F.col("mastery") * F.col("market")) / F.sum("weight") * 100
    kept = F.product(F.when(F.col("status") == "missing", 1 - F.least(F.col("penalty"), F.lit(PENALTY_CAP))).otherwise(1.0))
    scores = skills.groupBy(by).agg(base.alias("base"), kept.alias("kept"))
    owned = skills.filter(F.col("status") == "owned").select(by, "skill")
    both = pairs.join(owned.withColumnRenamed("skill", "a"), "a").join(owned.withColumnRenamed("skill", "b"), [by, "b"])
    bonus = both.groupBy(by).agg(F.least(F.lit(SYNERGY) * F.count(F.lit(1)), F.lit(SYNERGY_CAP)).alias("bonus"))
    score = F.bround(F.least(F.lit(100.0), F.col("base") * F.col("kept") * (1 + F.coalesce("bonus", F.lit(0.0)))), 0).cast("long")
    return scores.join(bonus, by, "left").select(by, score.alias("score"))


def completion(depth: Column, unreachable: int = 999) -> Column:
    """1 for owned skills (depth 0), else 1 over the nodes on the shortest way to an owned one, 0 without one."""
    return F.when(depth == 0, 1.0).when(depth >= unreachable, 0.0).otherwise(1.0 / (depth + 1))


def skill_priority(market: Column, impact: Column, centrality: Column, difficulty: Column) -> Column:
    return F.round(F.lit(0.4) * market + F.lit(0.3) * impact / 100 + F.lit(0.2) * centrality + F.lit(0.1) * F.least(F.lit(1.5), F.lit(3.0) / difficulty), 3)


#: Stage names, fixed values.
STAGES = ("Student", "Fresher", "Junior", "Middle")


def career_stage(years: Column, advanced: Column, title_agrees: Column | None = None) -> list[Column]:
    """stage and confidence from years of experience and the number of advanced skills.

    Unknown years and years up to 0, 1, 3 and beyond give the base stage; three advanced skills raise it by one, five by
    two, to the last at most. Only unknown years lower the confidence.
    """
    y = F.coalesce(years, F.lit(0.0))
    base = F.when(y <= 0, 0).when(y <= 1, 1).when(y <= 3, 2).otherwise(3)
    stage = F.least(F.lit(len(STAGES) - 1), base + F.when(advanced >= 5, 2).when(advanced >= 3, 1).otherwise(0))
    sure = F.lit(0.7) + F.when(title_agrees if title_agrees is not None else F.lit(False), 0.1).otherwise(0.0)
    sure = sure - F.when(years.isNull(), 0.2).otherwise(0.0) + F.when(advanced > 0, 0.1).otherwise(0.0)
    return [F.element_at(F.array(*[F.lit(s) for s in STAGES]), (stage + 1).cast("int")).alias("stage"), F.round(F.greatest(F.lit(0.0), F.least(F.lit(1.0), sure)), 2).alias("confidence")]


def select_projects(phases: DataFrame, pool: DataFrame, allowed: dict[str, list[str]], threshold: float = 0.5) -> DataFrame:
    """(phase_id, name, match): the best project of each phase (phase_id, stage, skills).

    A project (name, difficulty, primary_skills, suitable_stages) is open to a stage that it lists or whose difficulties
    hold its own; the match is the Jaccard of skills without letter case, at least threshold; ties by name.
    """
    from skillweave.functions.sets import jaccard_folded

    levels = F.create_map(*[x for s, d in allowed.items() for x in (F.lit(s), F.array(*[F.lit(i) for i in d]))])
    left = phases.select("phase_id", "stage", "skills", F.explode(F.transform("skills", F.lower)).alias("k"))
    right = pool.select("name", "difficulty", "primary_skills", "suitable_stages", F.explode(F.transform("primary_skills", F.lower)).alias("k"))
    met = left.join(right, "k").drop("k").dropDuplicates(["phase_id", "name"])
    fits = F.array_contains("suitable_stages", F.col("stage")) | F.coalesce(F.array_contains(F.try_element_at(levels, F.col("stage")), F.col("difficulty")), F.lit(False))
    scored = met.filter(fits).withColumn("match", F.round(jaccard_folded(F.col("skills"), F.col("primary_skills")), 4)).filter(F.col("match") >= threshold)
    rn = F.row_number().over(W.partitionBy("phase_id").orderBy(F.desc("match"), "name"))
    return scored.withColumn("rn", rn).filter("rn = 1").select("phase_id", "name", "match")


def overlay(owned: DataFrame, gaps: DataFrame, edges: DataFrame, by: str = "candidate") -> DataFrame:
    """(by, skill, status): owned skills completed, gaps with an owned prerequisite partial, other gaps missing."""
    needs = edges.filter(F.col("type") == "prerequisite").select(F.col("src").alias("skill"), F.col("dst").alias("need"))
    started = gaps.select(by, "skill").join(needs, "skill").join(owned.select(by, F.col("skill").alias("need")), [by, "need"], "left_semi").select(by, "skill").distinct().withColumn("some", F.lit(True))
    rows = gaps.select(by, "skill").join(started, [by, "skill"], "left")
    return owned.select(by, "skill", F.lit("completed").alias("status")).unionByName(rows.select(by, "skill", F.when(F.col("some"), "partial").otherwise("missing").alias("status")))


def market_insights(matrix: DataFrame, gaps: DataFrame) -> DataFrame:
    """(candidate, role, skill, frequency_pct, priority): role skills with their gap's severity as priority, else Low."""
    name = F.when(F.col("severity") == "critical", "High").when(F.col("severity") == "medium", "Medium").otherwise("Low")
    keys = gaps.select("candidate", "role").distinct()
    return keys.join(matrix.select("role", "skill", "frequency_pct"), "role").join(gaps.select("candidate", "role", "skill", "severity"), ["candidate", "role", "skill"], "left").select(
        "candidate", "role", "skill", "frequency_pct", name.alias("priority")
    )


#: Titles of the phases, fixed values.
TITLES = ("Nền tảng cơ bản", "Kỹ năng cốt lõi", "Phát triển chuyên sâu", "Kỹ năng nâng cao", "Production-ready", "Tối ưu & Mở rộng")


def phase_reason(depth: Column, count: Column) -> Column:
    """One sentence on a phase by the mean depth of its skills; the wordings are fixed values."""
    return (
        F.when(depth < 1, F.concat(F.lit("Kiến thức nền tảng, "), count.cast("string"), F.lit(" kỹ năng cơ bản")))
        .when(depth < 2, "Kỹ năng cốt lõi, xây dựng nền tảng vững chắc")
        .when(depth < 3, "Phát triển chuyên sâu, áp dụng vào dự án thực tế")
        .otherwise("Kỹ năng nâng cao, tối ưu và mở rộng hệ thống")
    )


def phase_summary(phases: DataFrame, depths: DataFrame, by: str = "candidate") -> DataFrame:
    """(by, phase, title, skills, skill_count, avg_depth, reason) of phases (by, skill, phase); depths is (skill, depth), 0 if absent."""
    rows = phases.join(depths.select("skill", "depth"), "skill", "left").fillna({"depth": 0})
    found = rows.groupBy(by, "phase").agg(F.array_sort(F.collect_list("skill")).alias("skills"), F.avg("depth").alias("mean"))
    n = F.size("skills")
    return found.select(by, "phase", phase_title(F.col("phase")).alias("title"), "skills", n.alias("skill_count"), F.round("mean", 2).alias("avg_depth"), phase_reason(F.col("mean"), n).alias("reason"))


def graph_projection(skills: DataFrame, owned: DataFrame, phases: DataFrame, edges: DataFrame, in_progress: DataFrame | None = None) -> DataFrame:
    """(candidate, phase, score, delta, bottlenecks): the graph score today (phase 0) and after each phase.

    skills is (candidate, skill, weight, market, ordinal), owned and in_progress (candidate, skill), phases (candidate, phase,
    skill) from 1. A phase's skills are owned from that phase on; all that are owned or in progress are in hand. A skill that is not
    owned counts by the share of its shortest way up to one in hand (0 without one); a missing one loses 0.15 for every
    prerequisite met on the way that is not in hand, 0.5 at most, repeats counted. Scores are whole, half to even, at most
    100; skills of no weight do not count, and a candidate of no weights at all has score 0. bottlenecks are the three
    skills of the least share (ties by ordinal), of these those below one half. Every phase of a roadmap is one key of one
    walk for all.
    """
    from skillweave.operators.insights import penalty_lengths

    stages = skills.select("candidate", F.lit(0).alias("stage")).union(phases.select("candidate", F.col("phase").cast("int"))).distinct()
    bought = owned.select("candidate", "skill", F.lit(0).alias("since")).unionByName(phases.select("candidate", "skill", F.col("phase").cast("int").alias("since"))).groupBy("candidate", "skill").agg(F.min("since").alias("since"))
    at = lambda rows: rows.join(stages, "candidate").select(F.struct("candidate", "stage").alias("candidate"), *[c for c in rows.columns if c != "candidate"], "stage")
    done = at(bought).filter("since <= stage").select("candidate", "skill")
    begun = done if in_progress is None else done.unionByName(at(in_progress.select("candidate", "skill")).select("candidate", "skill"))
    rows = stored(at(skills.filter("weight <> 0").select("candidate", "skill", "weight", "market", "ordinal")).drop("stage"), "wanted")
    hand = stored(begun.distinct(), "held")
    depth = depth_to_owned(rows, hand, edges)
    lacking = penalty_lengths(rows.select("candidate", F.col("skill").alias("goal")).distinct(), hand, edges).withColumnRenamed("goal", "skill")
    rated = rows.join(depth, ["candidate", "skill"]).join(lacking, ["candidate", "skill"]).join(done.withColumn("done", F.lit(True)), ["candidate", "skill"], "left")
    rated = stored(rated.select("candidate", "skill", "weight", "market", "ordinal", F.when(F.col("done"), 1.0).otherwise(completion(F.col("depth"))).alias("completion"), F.when(F.col("depth") == 0, 0).otherwise(F.col("missing")).alias("missing")), "rated")
    scores = graph_score(rated)
    low = bottlenecks(rated).groupBy("candidate").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "skill"))), lambda x: x["skill"]).alias("bottlenecks"))
    keys = stages.select(F.struct("candidate", "stage").alias("candidate"))
    whole = keys.join(scores, "candidate", "left").join(low, "candidate", "left")
    whole = whole.select("candidate.candidate", F.col("candidate.stage").alias("phase"), F.coalesce("score", F.lit(0).cast("long")).alias("score"), F.coalesce("bottlenecks", F.array().cast("array<string>")).alias("bottlenecks"))
    order = W.partitionBy("candidate").orderBy("phase")
    return whole.select("candidate", "phase", "score", (F.col("score") - F.coalesce(F.lag("score").over(order), F.col("score"))).alias("delta"), "bottlenecks")
