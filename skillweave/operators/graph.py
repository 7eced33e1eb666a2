"""Skill graph: edges (src, dst, type, ordinal) of types prerequisite, related and leads_to, as plain relations.

A prerequisite edge says that src needs dst. Candidates are walked together, keyed by candidate. A graph of up to MAX_EDGES
edges becomes a map literal, and a walk one projection over each row; a larger one is walked level by level (walks). Neither
way limits the length of a walk.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from skillweave.operators import walks

MAX_EDGES = 2000


def neighbours(edges: DataFrame, kind: str) -> DataFrame:
    """(src, neighbours): direct neighbours of a type in their listed order."""
    rows = edges.filter(F.col("type") == kind)
    return rows.groupBy("src").agg(F.transform(F.array_sort(F.collect_list(F.struct("ordinal", "dst"))), lambda x: x["dst"]).alias("neighbours"))


def _listed(edges: DataFrame, kind: str, most: int) -> dict[str, list[str]] | None:
    """Node -> neighbours in order, or None above most edges."""
    rows = edges.filter(F.col("type") == kind).select("src", "dst", "ordinal").limit(most + 1).collect()
    if len(rows) > most:
        return None
    by: dict[str, list[str]] = {}
    for r in sorted(rows, key=lambda r: (r.src, r.ordinal)):
        by.setdefault(r.src, []).append(r.dst)
    return by


def _literal(by: dict[str, list[str]]) -> Column:
    if not by:
        return F.create_map().cast("map<string, array<string>>")
    return F.create_map(*[x for src, dst in by.items() for x in (F.lit(src), F.array(*[F.lit(d) for d in dst]))])


def _levels(by: dict[str, list[str]]) -> int:
    """The most steps that the shortest way between two nodes takes."""
    most = 0
    for start in by:
        seen, front, depth = {start}, [start], 0
        while front := [d for s in front for d in by.get(s, ()) if d not in seen and not seen.add(d)]:
            depth += 1
        most = max(most, depth)
    return most


def prerequisites(edges: DataFrame) -> DataFrame:
    return edges.filter(F.col("type") == "prerequisite").select("src", "dst")


def missing_prerequisites(goals: DataFrame, owned: DataFrame, edges: DataFrame, most: int = MAX_EDGES) -> DataFrame:
    """(candidate, goal, skill, depth): unowned prerequisites of goals at their least depth; owned skills end a walk.

    goals is (candidate, goal), owned (candidate, skill). Up to most edges every candidate's walk is one projection over its
    own row, in as many steps as the graph is deep, that each add what the frontier needs and has not been met; larger
    graphs are walked level by level (transitive_prerequisites). A cycle ends by itself, as a node is met once.
    """
    by = _listed(edges, "prerequisite", most)
    if by is None:
        return transitive_prerequisites(goals, owned, edges)
    need, none = _literal(by), F.array().cast("array<string>")
    mine = owned.groupBy("candidate").agg(F.collect_set("skill").alias("mine"))
    rows = goals.join(mine, "candidate", "left").withColumn("mine", F.coalesce("mine", none))

    def step(state, level):
        reached = F.array_distinct(F.flatten(F.transform(state["front"], lambda x: F.coalesce(F.try_element_at(need, x), none))))
        front = F.array_except(F.array_except(reached, F.col("mine")), F.transform(state["met"], lambda x: x["skill"]))
        met = F.concat(state["met"], F.transform(front, lambda x: F.struct(x.alias("skill"), level.alias("depth"))))
        return F.struct(front.alias("front"), met.alias("met"))

    start = F.struct(F.array("goal").alias("front"), F.array(F.struct(F.col("goal").alias("skill"), F.lit(0).alias("depth"))).alias("met"))
    walked = rows.select("candidate", "goal", F.aggregate(F.sequence(F.lit(1), F.lit(max(1, _levels(by)))), start, step).alias("w"))
    return walked.select("candidate", "goal", F.explode("w.met").alias("m")).select("candidate", "goal", "m.skill", "m.depth").filter("depth > 0")


def transitive_prerequisites(goals: DataFrame, owned: DataFrame, edges: DataFrame) -> DataFrame:
    """missing_prerequisites for a graph of any size: one level of all candidates' walks after the other."""
    starts = goals.select("candidate", "goal", F.col("goal").alias("node"))
    found = walks.reached(starts, prerequisites(edges), ["candidate", "goal"], barred=owned.select("candidate", F.col("skill").alias("node")))
    return found.filter("depth > 0").withColumnRenamed("node", "skill")


def learning_path(prerequisites: DataFrame, by: tuple[str, ...] = ("goal",)) -> DataFrame:
    """(by, step, skill, kind): prerequisites (by, skill, depth), deepest first, then the goal, which is the last of by."""
    rows = prerequisites.select(*by, "skill", "depth", F.lit("prerequisite").alias("kind")).unionByName(
        prerequisites.select(*by).distinct().select(*by, F.col(by[-1]).alias("skill"), F.lit(0).alias("depth"), F.lit("target").alias("kind"))
    )
    step = F.row_number().over(W.partitionBy(*by).orderBy(F.desc("depth"), "skill"))
    return rows.select(*by, step.alias("step"), "skill", "kind")


def next_skills(owned: DataFrame, edges: DataFrame, top: int = 5) -> DataFrame:
    """(candidate, skill, score, leading): unowned skills that owned ones lead to.

    score = leading skills * (met prerequisites, leading ones counted in) / prerequisites; without prerequisites the ratio is 1.
    """
    leads, needs = edges.filter(F.col("type") == "leads_to"), edges.filter(F.col("type") == "prerequisite")
    led = owned.join(leads.select(F.col("src").alias("skill"), "dst").distinct(), "skill").select("candidate", F.col("skill").alias("via"), F.col("dst").alias("skill"))
    led = led.join(owned, ["candidate", "skill"], "left_anti").groupBy("candidate", "skill").agg(F.array_sort(F.collect_set("via")).alias("leading"))
    pre = needs.groupBy(F.col("src").alias("skill")).agg(F.collect_set("dst").alias("needed"))
    mine = owned.groupBy("candidate").agg(F.collect_set("skill").alias("mine"))
    rows = led.join(pre, "skill", "left").join(mine, "candidate")
    met = F.size(F.array_union(F.array_intersect("needed", "mine"), F.col("leading")))
    score = F.size("leading") * F.when(F.col("needed").isNull(), F.lit(1.0)).otherwise(met / F.size("needed"))
    rank = F.row_number().over(W.partitionBy("candidate").orderBy(F.desc("score"), "skill"))
    return rows.select("candidate", "skill", F.round(score, 4).alias("score"), F.size("leading").alias("leading")).withColumn("rn", rank).filter(F.col("rn") <= top).drop("rn")


def cluster_coverage(owned: DataFrame, clusters: DataFrame) -> DataFrame:
    """(candidate, cluster, pct, have, missing) for candidates and clusters that share a skill; clusters is (cluster, skill)."""
    touched = owned.join(clusters, "skill").select("candidate", "cluster").distinct()
    rows = touched.join(clusters.select("cluster", "skill"), "cluster").join(owned.withColumn("has", F.lit(True)), ["candidate", "skill"], "left")
    return rows.groupBy("candidate", "cluster").agg(
        F.round(F.count("has") / F.count(F.lit(1)) * 100, 2).alias("pct"),
        F.array_sort(F.collect_list(F.when(F.col("has"), F.col("skill")))).alias("have"),
        F.array_sort(F.collect_list(F.when(F.col("has").isNull(), F.col("skill")))).alias("missing"),
    )


def first_cluster(skills: DataFrame, clusters: DataFrame) -> DataFrame:
    """(skill, cluster): the cluster listed first that holds a skill; clusters has a pos."""
    return skills.join(clusters.groupBy("skill").agg(F.min_by("cluster", F.struct("pos", "cluster")).alias("cluster")), "skill", "left")


def induced(edges: DataFrame, nodes: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """(by, src, dst, type): edges with both ends in nodes (by, skill)."""
    inside = edges.join(nodes.select(*by, F.col("skill").alias("src")).distinct(), "src")
    return inside.join(nodes.select(*by, F.col("skill").alias("dst")).distinct(), [*by, "dst"], "left_semi").select(*by, "src", "dst", "type")


def _over_others(nodes: DataFrame, counts: DataFrame, name: str, by: tuple[str, ...]) -> DataFrame:
    """(by, skill, name, centrality): a count over one less than the nodes of by."""
    rows = nodes.select(*by, "skill").join(counts, [*by, "skill"], "left").fillna({name: 0})
    n = F.count(F.lit(1)).over(W.partitionBy(*by)) if by else None
    rows = rows.withColumn("n", n) if by else rows.join(F.broadcast(nodes.agg(F.count(F.lit(1)).alias("n"))), F.lit(True))
    return rows.select(*by, "skill", name, F.when(F.col("n") > 1, F.round(F.col(name) / (F.col("n") - 1), 4)).otherwise(0.0).alias("centrality"))


def dependent_centrality(edges: DataFrame, nodes: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """(by, skill, dependents, centrality): how many nodes need a skill, over n - 1."""
    inside = induced(edges.filter(F.col("type") == "prerequisite"), nodes, by)
    return _over_others(nodes, inside.groupBy(*by, F.col("dst").alias("skill")).agg(F.countDistinct("src").alias("dependents")), "dependents", by)


def degree_centrality(edges: DataFrame, nodes: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """(by, skill, degree, centrality): prerequisites and leads_to of a skill inside nodes, over n - 1."""
    inside = induced(edges.filter(F.col("type").isin("prerequisite", "leads_to")), nodes, by)
    return _over_others(nodes, inside.groupBy(*by, F.col("src").alias("skill")).agg(F.count(F.lit(1)).alias("degree")), "degree", by)


def prerequisite_boost(edges: DataFrame, role_skills: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """(by, skill, boost): 1 + 0.1 for each skill of the role that needs it, at most 1.5."""
    needed = edges.filter(F.col("type") == "prerequisite").join(role_skills.select(*by, F.col("skill").alias("src")).distinct(), "src")
    return needed.groupBy(*by, F.col("dst").alias("skill")).agg(F.least(F.lit(1.0) + F.lit(0.1) * F.countDistinct("src"), F.lit(1.5)).alias("boost"))


def depth_to_owned(nodes: DataFrame, owned: DataFrame, edges: DataFrame, unreachable: int = 999) -> DataFrame:
    """(candidate, skill, depth): least number of prerequisite steps from a skill of nodes to an owned one; owned 0, unreachable as given.

    One search for each candidate, from all owned skills down to what needs them.
    """
    down = prerequisites(edges).select(F.col("dst").alias("src"), F.col("src").alias("dst"))
    near = walks.reached(owned.select("candidate", F.col("skill").alias("node")), down, ["candidate"]).withColumnRenamed("node", "skill")
    return nodes.select("candidate", "skill").distinct().join(near, ["candidate", "skill"], "left").select("candidate", "skill", F.coalesce("depth", F.lit(unreachable)).alias("depth"))


def longest_depth(nodes: DataFrame, owned: DataFrame, edges: DataFrame) -> DataFrame:
    """(candidate, skill, depth): length of the longest prerequisite chain inside a candidate's nodes from a skill on, owned skills not walked.

    Chains are followed from their ends: the longest way down to a skill is its depth. A cycle inside nodes raises
    walks.CyclicGraph.
    """
    down = prerequisites(edges).select(F.col("dst").alias("src"), F.col("src").alias("dst"))
    every = nodes.select("candidate", "skill").distinct()
    fresh = every.join(owned.select("candidate", "skill"), ["candidate", "skill"], "left_anti").withColumnRenamed("skill", "node")
    found = walks.farthest(fresh, down, ["candidate"], inside=fresh).withColumnRenamed("node", "skill")
    return every.join(found, ["candidate", "skill"], "left").select("candidate", "skill", F.coalesce("depth", F.lit(0)).alias("depth"))


def first_prerequisite_chain(goals: DataFrame, edges: DataFrame) -> DataFrame:
    """(candidate, goal, step, skill): the chain of first-listed prerequisites that ends at each goal (candidate, goal), from step 0."""
    starts = goals.select("candidate", "goal", F.col("goal").alias("node"))
    found = walks.reached(starts, edges.filter("type = 'prerequisite' AND ordinal = 0"), ["candidate", "goal"])
    last = F.max("depth").over(W.partitionBy("candidate", "goal"))
    return found.select("candidate", "goal", (last - F.col("depth")).cast("int").alias("step"), F.col("node").alias("skill"))


def skill_trees(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """(skill, children): what a skill leads to, else what it is related to, in listed order."""
    leads, related = neighbours(edges, "leads_to"), neighbours(edges, "related")
    rows = nodes.select(F.col("skill").alias("src")).join(leads.withColumnRenamed("neighbours", "a"), "src", "left").join(related.withColumnRenamed("neighbours", "b"), "src", "left")
    return rows.select(F.col("src").alias("skill"), F.coalesce("a", "b", F.array().cast("array<string>")).alias("children"))


def role_aware_prune(nodes: DataFrame, edges: DataFrame, scores: Column, min_relevance: float = 0.2, per_depth: int = 8, by: tuple[str, ...] = ()) -> DataFrame:
    """Nodes kept for a role: relevance at least min_relevance, the best per_depth of each depth, and their direct prerequisites.

    nodes is (by, skill, relevance, depth, ...); scores is a column over it. Adds score and whether a node came in as a
    prerequisite.
    """
    scored = nodes.withColumn("score", scores)
    rank = F.row_number().over(W.partitionBy(*by, "depth").orderBy(F.desc("score"), "skill"))
    best = scored.filter(F.col("relevance") >= min_relevance).withColumn("rn", rank).filter(F.col("rn") <= per_depth).drop("rn")
    needs = edges.filter(F.col("type") == "prerequisite").join(best.select(*by, F.col("skill").alias("src")), "src").select(*by, F.col("dst").alias("skill")).distinct()
    added = scored.join(needs, [*by, "skill"], "left_semi").join(best.select(*by, "skill"), [*by, "skill"], "left_anti")
    return best.withColumn("added", F.lit(False)).unionByName(added.withColumn("added", F.lit(True)))


def pruned_graph(nodes: DataFrame, edges: DataFrame, scores: Column, min_relevance: float = 0.2, per_depth: int = 8, by: tuple[str, ...] = ()) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The kept nodes, the edges between them, and statistics of role_aware_prune.

    Statistics are (by, original_nodes, pruned_nodes, removed_nodes, reduction_ratio, kept_by_relevance, kept_by_dependency,
    pruned_edges).
    """
    kept = role_aware_prune(nodes, edges, scores, min_relevance, per_depth, by)
    links = induced(edges, kept, by)
    ok = F.count_if(F.col("relevance") >= min_relevance)
    stats = nodes.groupBy(*by).agg(F.count(F.lit(1)).alias("original_nodes"), ok.alias("kept_by_relevance"))
    parts = (kept.groupBy(*by).agg(F.count(F.lit(1)).alias("pruned_nodes"), F.count_if("added").alias("kept_by_dependency")), links.groupBy(*by).agg(F.count(F.lit(1)).alias("pruned_edges")))
    for rows in parts:
        stats = stats.join(rows, list(by), "left") if by else stats.join(F.broadcast(rows), F.lit(True), "left")
    stats = stats.fillna(0, ["pruned_nodes", "kept_by_dependency", "pruned_edges"])
    gone = F.col("original_nodes") - F.col("pruned_nodes")
    return kept, links, stats.select(*by, "original_nodes", "pruned_nodes", gone.alias("removed_nodes"), F.round(gone / F.col("original_nodes"), 3).alias("reduction_ratio"), "kept_by_relevance", "kept_by_dependency", "pruned_edges")


def node_score(depth: str = "depth") -> Column:
    """relevance * market * centrality * boost, a fifth more above depth 2; columns by these names."""
    base = reduce(lambda a, b: a * b, [F.col("relevance"), F.col("market"), F.col("centrality"), F.col("boost")])
    return F.round(base * F.when(F.col(depth) < 2, 1.2).otherwise(1.0), 6)
