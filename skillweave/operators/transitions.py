"""Role transitions by shared skills, seeded pairs, and paths over them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from skillweave.operators import walks

SET_PCT, TOP_PCT, MIN_WEIGHT, SEED_WEIGHT = 30.0, 50.0, 0.25, 0.3


def overlap_pairs(sets: DataFrame, key: str = "role", item: str = "skill") -> DataFrame:
    """(a, b, shared, size_a, size_b) for pairs a < b that share an item; sets is (key, item), distinct.

    An equi-join on the item instead of all pairs: pairs that share nothing cannot reach a positive similarity.
    """
    sized = sets.select(F.col(key).alias("k"), F.col(item).alias("i"), F.count(F.lit(1)).over(W.partitionBy(key)).alias("n"))
    left, right = sized.select(F.col("k").alias("a"), "i", F.col("n").alias("size_a")), sized.select(F.col("k").alias("b"), "i", F.col("n").alias("size_b"))
    return left.join(right, "i").filter("a < b").groupBy("a", "b", "size_a", "size_b").agg(F.count(F.lit(1)).alias("shared"))


def similarity() -> Column:
    return F.col("shared") / (F.col("size_a") + F.col("size_b") - F.col("shared"))


def transitions(matrix: DataFrame, set_pct: float = SET_PCT, top_pct: float = TOP_PCT, min_weight: float = MIN_WEIGHT) -> DataFrame:
    """(from, to, weight, shared_skills, new_skills_needed) for role pairs with Jaccard >= min_weight.

    Sets are skills at set_pct; the smaller set leads to the larger, equal ones in order of name. New skills are those at
    top_pct that the origin lacks at top_pct.
    """
    member = matrix.filter(F.col("frequency_pct") >= set_pct)
    pairs = overlap_pairs(member).withColumn("weight", F.round(similarity(), 4)).filter(similarity() >= min_weight)
    swap = F.col("size_a") > F.col("size_b")
    ends = pairs.select(F.when(swap, F.col("b")).otherwise(F.col("a")).alias("from"), F.when(swap, F.col("a")).otherwise(F.col("b")).alias("to"), "weight")
    return with_skills(ends, matrix, set_pct, top_pct)


def with_skills(ends: DataFrame, matrix: DataFrame, set_pct: float = SET_PCT, top_pct: float = TOP_PCT) -> DataFrame:
    collect = lambda pct, name: matrix.filter(F.col("frequency_pct") >= pct).groupBy("role").agg(F.array_sort(F.collect_set("skill")).alias(name))
    empty = F.array().cast("array<string>")
    out = ends
    for side in ("from", "to"):
        for pct, name in ((set_pct, "set"), (top_pct, "top")):
            s = collect(pct, f"{side}_{name}").withColumnRenamed("role", side)
            out = out.join(s, side, "left")
    get = lambda c: F.coalesce(F.col(c), empty)
    return out.select(
        "from",
        "to",
        "weight",
        F.array_sort(F.array_intersect(get("from_set"), get("to_set"))).alias("shared_skills"),
        F.array_sort(F.array_except(get("to_top"), get("from_top"))).alias("new_skills_needed"),
    )


def seeded(found: DataFrame, seeds: DataFrame, matrix: DataFrame, set_pct: float = SET_PCT, top_pct: float = TOP_PCT, weight: float = SEED_WEIGHT) -> DataFrame:
    """Transitions plus the pairs of seeds (from, to) they lack; a pair weighs its Jaccard, or weight if neither role has a set."""
    fresh = seeds.join(found.select("from", "to"), ["from", "to"], "left_anti")
    sets = matrix.filter(F.col("frequency_pct") >= set_pct).groupBy("role").agg(F.collect_set("skill").alias("s"))
    both = fresh.join(sets.select(F.col("role").alias("from"), F.col("s").alias("sf")), "from", "left").join(sets.select(F.col("role").alias("to"), F.col("s").alias("st")), "to", "left")
    j = F.size(F.array_intersect("sf", "st")) / F.size(F.array_union("sf", "st"))
    weighed = both.select("from", "to", F.when(F.col("sf").isNull() & F.col("st").isNull(), F.lit(weight)).otherwise(F.coalesce(F.round(j, 4), F.lit(0.0))).alias("weight"))
    return found.unionByName(with_skills(weighed, matrix, set_pct, top_pct))


def graph_roles(found: DataFrame) -> DataFrame:
    """(role): the roles that a transition leaves or enters."""
    return found.select(F.col("from").alias("role")).union(found.select(F.col("to").alias("role"))).distinct()


def closest_role(owned: DataFrame, matrix: DataFrame, set_pct: float = SET_PCT, roles: DataFrame | None = None) -> DataFrame:
    """(candidate, role, similarity): for each candidate with skills the role whose set is most similar; ties by name.

    Roles are those of roles (role), as of a transition graph, or all of the matrix. Without a shared skill it is the role
    most words of which are skills of the candidate, or else the first by name, with similarity 0.
    """
    roles = matrix.select("role").distinct() if roles is None else roles.select("role").distinct()
    member = matrix.join(roles, "role", "left_semi").filter(F.col("frequency_pct") >= set_pct).select("role", "skill", F.count(F.lit(1)).over(W.partitionBy("role")).alias("n_role"))
    mine = owned.select("candidate", "skill", F.count(F.lit(1)).over(W.partitionBy("candidate")).alias("n_own"))
    scored = mine.join(member, "skill").groupBy("candidate", "role", "n_own", "n_role").agg(F.count(F.lit(1)).alias("shared"))
    scored = scored.withColumn("similarity", F.round(F.col("shared") / (F.col("n_own") + F.col("n_role") - F.col("shared")), 4))
    best = scored.groupBy("candidate").agg(F.min(F.struct((-F.col("similarity")).alias("o"), "role")).alias("x")).select("candidate", "x.role", (-F.col("x.o")).alias("similarity"))
    words = roles.select("role", F.explode(F.array_distinct(F.split(F.trim(F.lower("role")), r"\s+"))).alias("word"))
    hits = owned.select("candidate", F.lower("skill").alias("word")).distinct().join(words, "word").groupBy("candidate", "role").agg(F.count(F.lit(1)).alias("n"))
    named = hits.groupBy("candidate").agg(F.min(F.struct((-F.col("n")).alias("o"), "role")).alias("x")).select("candidate", F.col("x.role").alias("named"))
    first = roles.agg(F.min("role").alias("first"))
    rows = owned.select("candidate").distinct().join(best, "candidate", "left").join(named, "candidate", "left").join(F.broadcast(first), F.lit(True))
    return rows.select("candidate", F.coalesce("role", "named", "first").alias("role"), F.coalesce("similarity", F.lit(0.0)).alias("similarity")).filter("role IS NOT NULL")


def shortest_path(edges: DataFrame, pairs: DataFrame) -> DataFrame:
    """(start, goal, path, steps): the shortest undirected path of each pair (start, goal) of roles; see walks.shortest_paths."""
    found = walks.shortest_paths(pairs, edges.select(F.col("from").alias("src"), F.col("to").alias("dst")))
    return found.withColumn("steps", F.size("path") - 1)


def arcs(found: DataFrame) -> DataFrame:
    """(from, to, shared_skills, skills_to_learn): transitions in both directions, one for each ordered pair of roles.

    Backwards the skills shared are those to learn. Of several the heaviest counts, a forward one first among equals.
    """
    ahead = found.select("from", "to", (-F.col("weight")).alias("o"), F.lit(0).alias("back"), "shared_skills", F.col("new_skills_needed").alias("learn"))
    back = found.select(F.col("to").alias("from"), F.col("from").alias("to"), (-F.col("weight")).alias("o"), F.lit(1).alias("back"), "shared_skills", F.col("shared_skills").alias("learn"))
    best = ahead.unionByName(back).groupBy("from", "to").agg(F.min(F.struct("o", "back", "shared_skills", "learn")).alias("x"))
    return best.select("from", "to", "x.shared_skills", F.col("x.learn").alias("skills_to_learn"))


def career_roadmaps(owned: DataFrame, targets: DataFrame, found: DataFrame, matrix: DataFrame, set_pct: float = SET_PCT) -> DataFrame:
    """(candidate, start_role, target_role, path, steps, total_new_skills): the way from a candidate's closest role to the target.

    targets is (candidate, role); a target is met without letter case, spaces around it aside. found is the transition graph;
    its roles are the possible starts. Candidates without skills start at the first role by name. steps has one struct (from,
    to, shared_skills, skills_to_learn) for each transition of the shortest path; path and steps are empty where the target
    is unknown or out of reach, and a path to the start itself is that role alone. Ways are found once for each distinct pair.
    """
    roles = graph_roles(found)
    first = roles.agg(F.min("role").alias("first"))
    starts = closest_role(owned, matrix, set_pct, roles).select("candidate", F.col("role").alias("closest"))
    known = roles.groupBy(F.lower("role").alias("low")).agg(F.min("role").alias("goal"))
    asked = targets.filter("trim(role) <> ''").select("candidate", F.col("role").alias("target_role"), F.lower(F.trim("role")).alias("low"))
    asked = asked.join(starts, "candidate", "left").join(F.broadcast(first), F.lit(True)).join(known, "low", "left")
    asked = asked.select("candidate", F.coalesce("closest", "first").alias("start"), "target_role", "goal")
    ways = walks.shortest_paths(asked.select("start", "goal"), found.select(F.col("from").alias("src"), F.col("to").alias("dst")))
    hops = ways.filter("size(path) > 1").select("start", "goal", F.posexplode(F.expr("transform(sequence(0, size(path) - 2), i -> struct(path[i] AS f, path[i + 1] AS t))")).alias("at", "hop"))
    told = hops.join(arcs(found), (F.col("hop.f") == F.col("from")) & (F.col("hop.t") == F.col("to")))
    steps = told.groupBy("start", "goal").agg(F.array_sort(F.collect_list(F.struct("at", F.struct("from", "to", "shared_skills", "skills_to_learn").alias("s")))).alias("s"))
    steps = steps.withColumn("steps", F.transform("s", lambda x: x["s"])).withColumn("total", F.array_sort(F.array_distinct(F.flatten(F.transform("steps", lambda x: x["skills_to_learn"])))))
    none = F.array().cast("array<string>")
    whole = asked.join(ways, ["start", "goal"], "left").join(steps.select("start", "goal", "steps", "total"), ["start", "goal"], "left")
    kind = F.array().cast("array<struct<from: string, to: string, shared_skills: array<string>, skills_to_learn: array<string>>>")
    return whole.select("candidate", F.col("start").alias("start_role"), "target_role", F.coalesce("path", none).alias("path"), F.coalesce("steps", kind).alias("steps"), F.coalesce("total", none).alias("total_new_skills"))
