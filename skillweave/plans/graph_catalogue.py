"""Queries of the skill graph, insights and roadmaps over all customers.

Brands stand for the nodes of a skill graph, which is configuration: a candidate owns the nodes of the brands of their urgent
orders, and the matrix of a segment holds the share of its customers who own a node.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from skillweave.operators import alike, gap, graph, insights, market, narratives, roadmap, transitions
from skillweave.plans import fixtures as fx
from skillweave.plans.base import BASE, add, joined, owned, targets
from skillweave.session import table
from skillweave.storage import stored

_N = (
    BASE.replace("WITH jobs", "WITH RECURSIVE jobs")
    + f", {fx.BRAND_SQL}, {fx.GRAPH_SQL}, needs AS (SELECT src, dst, ordinal FROM edges WHERE type = 'prerequisite'),"
    " own AS (SELECT DISTINCT candidate, node AS skill FROM owned JOIN brandnode ON brand = skill), heads AS (SELECT role, count(*) AS total FROM targets GROUP BY role),"
    " m AS (SELECT role, skill, round(100.0 * count(*) / any_value(total), 2) AS frequency_pct, count(*) AS count FROM targets JOIN own USING (candidate) JOIN heads USING (role) GROUP BY role, skill),"
    " w AS (SELECT t.candidate, t.role, m.skill, m.frequency_pct, CASE WHEN frequency_pct >= 70 THEN 'critical' WHEN frequency_pct >= 50 THEN 'medium' ELSE 'optional' END AS severity"
    " FROM targets t JOIN m USING (role) WHERE NOT EXISTS (SELECT 1 FROM own o WHERE o.candidate = t.candidate AND o.skill = m.skill))"
)


def _own(s, d) -> DataFrame:
    nodes = s.createDataFrame(fx.brand_nodes(), "skill string, node string")
    return owned(s, d).join(F.broadcast(nodes), "skill").select("candidate", F.col("node").alias("skill")).distinct()


def _market(s, d, own: DataFrame) -> DataFrame:
    jobs = targets(s, d).withColumnRenamed("candidate", "job_id")
    return market.role_skill_matrix(jobs, jobs.join(own.withColumnRenamed("candidate", "job_id"), "job_id").select("job_id", "role", "skill"), 0.0)


def _all(s, d):
    """owned nodes, targets and the matrix of nodes."""
    own = _own(s, d)
    return own, targets(s, d), _market(s, d, own)


def _stored(s, d):
    """_all with the owned nodes and the matrix written once, for queries that use them often."""
    own = stored(_own(s, d), "owned")
    return own, targets(s, d), stored(_market(s, d, own), "matrix")


def _weak(s, d) -> DataFrame:
    return gap.weaknesses(*_all(s, d), 70.0, 50.0)


def _up(goals: str, extra: str = "") -> str:
    """CTEs goals and up: every unowned prerequisite of goals (candidate, goal) with its steps, the goal at 0."""
    return (
        f", goals AS ({goals}), up(candidate, goal, skill, depth) AS (SELECT candidate, goal, goal, 0 FROM goals UNION SELECT u.candidate, u.goal, e.dst, u.depth + 1 FROM up u JOIN needs e ON e.src = u.skill"
        f" WHERE NOT EXISTS (SELECT 1 FROM own o WHERE o.candidate = u.candidate AND o.skill = e.dst)){extra}"
    )


# Walks


@add("q_direct_prereqs", _N + " SELECT w.candidate, w.skill, string_agg(e.dst, '|' ORDER BY e.ordinal) AS neighbours FROM w JOIN needs e ON e.src = w.skill GROUP BY 1, 2")
def q_direct_prereqs(s, d):
    near = graph.neighbours(fx.edges(s), "prerequisite").withColumnRenamed("src", "skill")
    return _weak(s, d).select("candidate", "skill").join(near, "skill").select("candidate", "skill", joined("neighbours").alias("neighbours"))


@add("q_missing_prereqs_batch", _N + _up("SELECT candidate, skill AS goal FROM w") + " SELECT candidate, goal, skill, min(depth) AS depth FROM up WHERE depth > 0 GROUP BY ALL")
def q_missing_prereqs_batch(s, d):
    weak = _weak(s, d).select("candidate", F.col("skill").alias("goal"))
    return graph.missing_prerequisites(weak, _own(s, d), fx.edges(s))


_FAR = "SELECT candidate, goal FROM targets, (VALUES ('rag'), ('mlops')) v(goal)"


def _far_goals(s, d):
    return targets(s, d).select("candidate", F.explode(F.array(F.lit("rag"), F.lit("mlops"))).alias("goal"))


@add("q_transitive_prereqs", _N + _up(_FAR) + " SELECT candidate, goal, skill, min(depth) AS depth FROM up WHERE depth > 0 GROUP BY ALL")
def q_transitive_prereqs(s, d):
    return graph.transitive_prerequisites(_far_goals(s, d), _own(s, d), fx.edges(s))


@add(
    "q_learning_path",
    _N + _up(_FAR) + ", x AS (SELECT candidate, goal, skill, min(depth) AS depth FROM up GROUP BY ALL), y AS (SELECT *, count(*) OVER (PARTITION BY candidate, goal) AS n FROM x)"
    " SELECT candidate, goal, CAST(row_number() OVER (PARTITION BY candidate, goal ORDER BY depth DESC, skill) AS INTEGER) AS step, skill, CASE WHEN depth = 0 THEN 'target' ELSE 'prerequisite' END AS kind FROM y WHERE n > 1",
)
def q_learning_path(s, d):
    return graph.learning_path(graph.missing_prerequisites(_far_goals(s, d), _own(s, d), fx.edges(s)), ("candidate", "goal"))


#: Nodes of the role, with the steps from each up to an owned one.
_DEPTH = (
    ", want AS (SELECT t.candidate, m.skill FROM targets t JOIN m USING (role)), climb(candidate, skill, here, depth) AS (SELECT candidate, skill, skill, 0 FROM want UNION SELECT c.candidate, c.skill, e.dst, c.depth + 1 FROM climb c JOIN needs e ON e.src = c.here"
    " WHERE NOT EXISTS (SELECT 1 FROM own o WHERE o.candidate = c.candidate AND o.skill = c.here)),"
    " near AS (SELECT c.candidate, c.skill, CAST(coalesce(min(CASE WHEN o.skill IS NOT NULL THEN depth END), 999) AS INTEGER) AS depth FROM climb c LEFT JOIN own o ON o.candidate = c.candidate AND o.skill = c.here GROUP BY 1, 2)"
)


@add("q_depth", _N + _DEPTH + " SELECT * FROM near")
def q_depth(s, d):
    own, to, m = _all(s, d)
    return graph.depth_to_owned(to.join(m, "role").select("candidate", "skill"), own, fx.edges(s))


@add(
    "q_longest_depth",
    _N + ", chain(candidate, skill, here, depth) AS (SELECT candidate, skill, skill, 0 FROM w UNION SELECT c.candidate, c.skill, e.dst, c.depth + 1 FROM chain c JOIN needs e ON e.src = c.here JOIN w ON w.candidate = c.candidate AND w.skill = e.dst)"
    " SELECT candidate, skill, max(depth) AS depth FROM chain GROUP BY 1, 2",
)
def q_longest_depth(s, d):
    return graph.longest_depth(_weak(s, d), _own(s, d), fx.edges(s))


@add(
    "q_shortest_path",
    _N + ", ends AS (SELECT src AS x, dst AS y FROM edges UNION SELECT dst, src FROM edges), pairs AS (SELECT DISTINCT o.a AS start, x.b AS goal FROM (SELECT candidate, min(skill) AS a FROM own GROUP BY 1) o JOIN (SELECT candidate, max(skill) AS b FROM w GROUP BY 1) x USING (candidate)),"
    " walk(start, goal, node, path, steps) AS (SELECT start, goal, start, [start], 0 FROM pairs UNION ALL SELECT k.start, k.goal, b.y, list_append(k.path, b.y), k.steps + 1 FROM walk k JOIN ends b ON b.x = k.node WHERE NOT list_contains(k.path, b.y) AND k.node <> k.goal)"
    " SELECT start, goal, array_to_string(path, '|') AS path, CAST(steps AS INTEGER) AS steps FROM (SELECT *, row_number() OVER (PARTITION BY start, goal ORDER BY steps, path) AS rn FROM walk WHERE node = goal) WHERE rn = 1",
)
def q_shortest_path(s, d):
    pairs = _own(s, d).groupBy("candidate").agg(F.min("skill").alias("start")).join(_weak(s, d).groupBy("candidate").agg(F.max("skill").alias("goal")), "candidate")
    arcs = fx.edges(s).select(F.col("src").alias("from"), F.col("dst").alias("to"))
    return transitions.shortest_path(arcs, pairs).withColumn("path", joined("path"))


@add(
    "q_first_prereq_chain",
    _N + ", goals AS (SELECT candidate, max(skill) AS goal FROM w GROUP BY 1), walk(candidate, goal, skill, depth) AS (SELECT candidate, goal, goal, 0 FROM goals UNION ALL SELECT k.candidate, k.goal, e.dst, k.depth + 1 FROM walk k JOIN needs e ON e.src = k.skill AND e.ordinal = 0)"
    " SELECT candidate, goal, CAST(max(depth) OVER (PARTITION BY candidate, goal) - depth AS INTEGER) AS step, skill FROM walk",
)
def q_first_prereq_chain(s, d):
    return graph.first_prerequisite_chain(_weak(s, d).groupBy("candidate").agg(F.max("skill").alias("goal")), fx.edges(s))


# Neighbourhoods


@add(
    "q_next_skills",
    _N + ", led AS (SELECT o.candidate, e.dst AS skill, list(DISTINCT o.skill) AS via FROM own o JOIN edges e ON e.src = o.skill AND e.type = 'leads_to' WHERE NOT EXISTS (SELECT 1 FROM own x WHERE x.candidate = o.candidate AND x.skill = e.dst) GROUP BY 1, 2),"
    " pre AS (SELECT src AS skill, list(DISTINCT dst) AS needed FROM needs GROUP BY 1), mine AS (SELECT candidate, list(skill) AS mine FROM own GROUP BY 1),"
    " sc AS (SELECT candidate, led.skill, len(via) * CASE WHEN needed IS NULL THEN 1.0 ELSE CAST(len(list_distinct(list_concat(list_intersect(needed, mine), via))) AS DOUBLE) / len(needed) END AS score, len(via) AS n_via"
    " FROM led LEFT JOIN pre USING (skill) JOIN mine USING (candidate))"
    " SELECT candidate, skill, round(score, 4) AS score, CAST(n_via AS INTEGER) AS \"leading\" FROM (SELECT *, row_number() OVER (PARTITION BY candidate ORDER BY score DESC, skill) AS rn FROM sc) WHERE rn <= 5",
)
def q_next_skills(s, d):
    return graph.next_skills(_own(s, d), fx.edges(s))


@add(
    "q_cluster_coverage",
    _N + f", {fx.CLUSTER_SQL}, t AS (SELECT DISTINCT candidate, cluster FROM own JOIN clusters USING (skill))"
    " SELECT t.candidate, t.cluster, round(count(o.skill) / count(*) * 100, 2) AS pct, coalesce(string_agg(c.skill, '|' ORDER BY c.skill) FILTER (o.skill IS NOT NULL), '') AS have, coalesce(string_agg(c.skill, '|' ORDER BY c.skill) FILTER (o.skill IS NULL), '') AS missing"
    " FROM t JOIN clusters c USING (cluster) LEFT JOIN own o ON o.candidate = t.candidate AND o.skill = c.skill GROUP BY 1, 2",
)
def q_cluster_coverage(s, d):
    return graph.cluster_coverage(_own(s, d), fx.clusters(s)).select("candidate", "cluster", "pct", joined("have").alias("have"), joined("missing").alias("missing"))


@add(
    "q_first_cluster",
    _N + f", {fx.CLUSTER_SQL} SELECT candidate, skill, c.cluster FROM own LEFT JOIN (SELECT skill, arg_min(cluster, (pos, cluster)) AS cluster FROM clusters GROUP BY 1) c USING (skill)",
)
def q_first_cluster(s, d):
    return graph.first_cluster(_own(s, d), fx.clusters(s)).select("candidate", "skill", "cluster")


@add("q_induced_graph", _N + " SELECT a.candidate, e.src, e.dst, e.type FROM edges e JOIN own a ON a.skill = e.src JOIN own b ON b.skill = e.dst AND b.candidate = a.candidate")
def q_induced_graph(s, d):
    return graph.induced(fx.edges(s), _own(s, d), ("candidate",))


_PICKED = ", picked AS (SELECT role, skill FROM m WHERE frequency_pct >= 45), k AS (SELECT role, count(*) AS n FROM picked GROUP BY 1)"


def _picked(s, d):
    return _market(s, d, _own(s, d)).filter("frequency_pct >= 45").select("role", "skill")


@add(
    "q_centrality",
    _N + _PICKED + ", i AS (SELECT a.role, e.* FROM edges e JOIN picked a ON a.skill = e.src JOIN picked b ON b.skill = e.dst AND b.role = a.role),"
    " dep AS (SELECT role, dst AS skill, count(DISTINCT src) AS k FROM i WHERE type = 'prerequisite' GROUP BY 1, 2), deg AS (SELECT role, src AS skill, count(*) AS k FROM i WHERE type IN ('prerequisite', 'leads_to') GROUP BY 1, 2)"
    " SELECT role, skill, coalesce(dep.k, 0) AS dependents, CASE WHEN n > 1 THEN round(coalesce(dep.k, 0) / (n - 1), 4) ELSE 0.0 END AS centrality, coalesce(deg.k, 0) AS degree, CASE WHEN n > 1 THEN round(coalesce(deg.k, 0) / (n - 1), 4) ELSE 0.0 END AS degree_centrality"
    " FROM picked JOIN k USING (role) LEFT JOIN dep USING (role, skill) LEFT JOIN deg USING (role, skill)",
)
def q_centrality(s, d):
    nodes = _picked(s, d)
    a = graph.dependent_centrality(fx.edges(s), nodes, ("role",))
    return a.join(graph.degree_centrality(fx.edges(s), nodes, ("role",)).withColumnRenamed("centrality", "degree_centrality"), ["role", "skill"])


@add("q_prereq_boost", _N + _PICKED + " SELECT role, dst AS skill, least(1.0 + 0.1 * count(DISTINCT src), 1.5) AS boost FROM needs JOIN picked ON skill = src GROUP BY 1, 2")
def q_prereq_boost(s, d):
    return graph.prerequisite_boost(fx.edges(s), _picked(s, d), ("role",))


@add(
    "q_skill_trees",
    _N + " SELECT candidate, skill, coalesce((SELECT string_agg(dst, '|' ORDER BY ordinal) FROM edges WHERE src = skill AND type = 'leads_to'), (SELECT string_agg(dst, '|' ORDER BY ordinal) FROM edges WHERE src = skill AND type = 'related'), '') AS children FROM w",
)
def q_skill_trees(s, d):
    weak = _weak(s, d).select("candidate", "skill")
    return weak.join(graph.skill_trees(fx.edges(s), weak.select("skill").distinct()), "skill").select("candidate", "skill", joined("children").alias("children"))


#: Nodes of a role: skills of at least 70 % count as at hand for the depth.
_SCORED = (
    ", held AS (SELECT role, skill FROM m WHERE frequency_pct >= 70), climb(role, skill, here, depth) AS (SELECT role, skill, skill, 0 FROM m UNION SELECT c.role, c.skill, e.dst, c.depth + 1 FROM climb c JOIN needs e ON e.src = c.here"
    " WHERE NOT EXISTS (SELECT 1 FROM held h WHERE h.role = c.role AND h.skill = c.here)),"
    " near AS (SELECT c.role, c.skill, CAST(coalesce(min(CASE WHEN h.skill IS NOT NULL THEN depth END), 999) AS INTEGER) AS depth FROM climb c LEFT JOIN held h ON h.role = c.role AND h.skill = c.here GROUP BY 1, 2),"
    " dep AS (SELECT a.role, e.dst AS skill, count(DISTINCT e.src) AS k FROM needs e JOIN m a ON a.skill = e.src JOIN m b ON b.skill = e.dst AND b.role = a.role GROUP BY 1, 2), n AS (SELECT role, count(*) AS n FROM m GROUP BY 1),"
    " bo AS (SELECT a.role, e.dst AS skill, least(1.0 + 0.1 * count(DISTINCT e.src), 1.5) AS boost FROM needs e JOIN m a ON a.skill = e.src AND a.frequency_pct >= 50 GROUP BY 1, 2),"
    " sc AS (SELECT m.role, m.skill, frequency_pct / 100 AS relevance, depth, round(frequency_pct / 100 * (0.8 + (m.count % 5) / 10) * (0.1 + CASE WHEN n > 1 THEN round(coalesce(dep.k, 0) / (n - 1), 4) ELSE 0.0 END) * coalesce(boost, 1.0) * CASE WHEN depth < 2 THEN 1.2 ELSE 1.0 END, 6) AS score"
    " FROM m JOIN near USING (role, skill) JOIN n USING (role) LEFT JOIN dep USING (role, skill) LEFT JOIN bo USING (role, skill)),"
    " best AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY role, depth ORDER BY score DESC, skill) AS rn FROM sc WHERE relevance >= 0.3) WHERE rn <= 2),"
    " pruned AS (SELECT role, skill, depth, score, false AS added FROM best UNION ALL SELECT role, skill, depth, score, true FROM sc"
    " WHERE EXISTS (SELECT 1 FROM needs e JOIN best b ON b.skill = e.src AND b.role = sc.role WHERE e.dst = sc.skill) AND NOT EXISTS (SELECT 1 FROM best b WHERE b.role = sc.role AND b.skill = sc.skill))"
)


def _scored(s, d):
    m = _market(s, d, _own(s, d))
    e, by = fx.edges(s), ("role",)
    as_candidate = lambda rows: rows.select(F.col("role").alias("candidate"), "skill")
    depth = graph.depth_to_owned(as_candidate(m), as_candidate(m.filter("frequency_pct >= 70")), e).withColumnRenamed("candidate", "role")
    rows = m.join(depth, ["role", "skill"]).join(graph.dependent_centrality(e, m, by).select("role", "skill", "centrality"), ["role", "skill"])
    rows = rows.join(graph.prerequisite_boost(e, m.filter("frequency_pct >= 50"), by), ["role", "skill"], "left")
    relevance, lift = (F.col("frequency_pct") / 100).alias("relevance"), (F.lit(0.8) + F.col("count") % 5 / 10).alias("market")
    return rows.select("role", "skill", "depth", relevance, lift, (F.lit(0.1) + F.col("centrality")).alias("centrality"), F.coalesce("boost", F.lit(1.0)).alias("boost"))


@add("q_prune_topk_per_depth", _N + _SCORED + " SELECT * FROM pruned")
def q_prune_topk_per_depth(s, d):
    return graph.role_aware_prune(_scored(s, d), fx.edges(s), graph.node_score(), 0.3, 2, ("role",)).select("role", "skill", "depth", "score", "added")


@add(
    "q_prune_statistics",
    _N + _SCORED + ", lk AS (SELECT a.role, count(*) AS k FROM edges e JOIN pruned a ON a.skill = e.src JOIN pruned b ON b.skill = e.dst AND b.role = a.role GROUP BY 1), p AS (SELECT role, count(*) AS kept, count(CASE WHEN added THEN 1 END) AS dependency FROM pruned GROUP BY 1)"
    " SELECT sc.role, count(*) AS original_nodes, coalesce(any_value(kept), 0) AS pruned_nodes, count(*) - coalesce(any_value(kept), 0) AS removed_nodes, round((count(*) - coalesce(any_value(kept), 0)) / count(*), 3) AS reduction_ratio,"
    " count(CASE WHEN relevance >= 0.3 THEN 1 END) AS kept_by_relevance, coalesce(any_value(dependency), 0) AS kept_by_dependency, coalesce(any_value(lk.k), 0) AS pruned_edges FROM sc LEFT JOIN p USING (role) LEFT JOIN lk USING (role) GROUP BY 1",
)
def q_prune_statistics(s, d):
    return graph.pruned_graph(_scored(s, d), fx.edges(s), graph.node_score(), 0.3, 2, ("role",))[2]


# Scores


@add(
    "q_overlay",
    _N + " SELECT candidate, skill, 'completed' AS status FROM own UNION ALL SELECT w.candidate, w.skill, CASE WHEN EXISTS (SELECT 1 FROM needs e JOIN own o ON o.skill = e.dst AND o.candidate = w.candidate WHERE e.src = w.skill) THEN 'partial' ELSE 'missing' END FROM w",
)
def q_overlay(s, d):
    return roadmap.overlay(_own(s, d), _weak(s, d), fx.edges(s))


@add(
    "q_penalty_lengths",
    _N + _up("SELECT candidate, skill AS goal FROM w", ", met AS (SELECT DISTINCT candidate, goal, skill FROM up)")
    + " SELECT g.candidate, g.goal, count(e.dst) AS missing FROM goals g JOIN met u USING (candidate, goal) LEFT JOIN needs e ON e.src = u.skill AND NOT EXISTS (SELECT 1 FROM own o WHERE o.candidate = u.candidate AND o.skill = e.dst) GROUP BY 1, 2",
)
def q_penalty_lengths(s, d):
    return insights.penalty_lengths(_weak(s, d).select("candidate", F.col("skill").alias("goal")), _own(s, d), fx.edges(s))


#: Every skill of a candidate's role as scores see it.
_RATED = (
    _DEPTH + _up("SELECT candidate, skill AS goal FROM want", ", met AS (SELECT DISTINCT candidate, goal, skill FROM up)")
    + ", lack AS (SELECT u.candidate, u.goal AS skill, count(e.dst) AS missing FROM met u LEFT JOIN needs e ON e.src = u.skill AND NOT EXISTS (SELECT 1 FROM own o WHERE o.candidate = u.candidate AND o.skill = e.dst) GROUP BY 1, 2),"
    " rated AS (SELECT t.candidate, m.skill, row_number() OVER (PARTITION BY t.candidate ORDER BY frequency_pct DESC, m.skill) AS ordinal, frequency_pct / 100 AS weight, CASE WHEN depth = 0 THEN 1.0 WHEN depth >= 999 THEN 0.0 ELSE 1.0 / (depth + 1) END AS completion,"
    " CASE WHEN depth = 0 THEN 0 ELSE missing END AS missing, 0.8 + (m.count % 5) / 10 AS market, CASE WHEN depth = 0 THEN 0.5 + (t.candidate % 6) / 10 ELSE 0.0 END AS mastery, CASE WHEN depth = 0 THEN 0.0 ELSE 0.1 * missing END AS penalty, CASE WHEN depth = 0 THEN 'owned' ELSE 'missing' END AS status"
    " FROM targets t JOIN m USING (role) JOIN near ON near.candidate = t.candidate AND near.skill = m.skill JOIN lack ON lack.candidate = t.candidate AND lack.skill = m.skill)"
)


def _rated(s, d):
    own, to, m = _all(s, d)
    want = to.join(m, "role").select("candidate", "skill", "frequency_pct", "count")
    lack = insights.penalty_lengths(want.select("candidate", F.col("skill").alias("goal")), own, fx.edges(s)).withColumnRenamed("goal", "skill")
    rows = want.join(graph.depth_to_owned(want, own, fx.edges(s)), ["candidate", "skill"]).join(lack, ["candidate", "skill"])
    has = F.col("depth") == 0
    return rows.select(
        "candidate",
        "skill",
        F.row_number().over(W.partitionBy("candidate").orderBy(F.desc("frequency_pct"), "skill")).alias("ordinal"),
        (F.col("frequency_pct") / 100).alias("weight"),
        roadmap.completion(F.col("depth")).alias("completion"),
        F.when(has, 0).otherwise(F.col("missing")).alias("missing"),
        (F.lit(0.8) + F.col("count") % 5 / 10).alias("market"),
        F.when(has, F.lit(0.5) + F.col("candidate") % 6 / 10).otherwise(0.0).alias("mastery"),
        F.when(has, 0.0).otherwise(F.lit(0.1) * F.col("missing")).alias("penalty"),
        F.when(has, "owned").otherwise("missing").alias("status"),
    )


@add("q_graph_score", _N + _RATED + " SELECT candidate, CAST(round_even(least(100.0, sum(weight * completion * (1 - least(0.15 * missing, 0.5)) * market) / sum(weight) * 100), 0) AS BIGINT) AS score FROM rated GROUP BY 1")
def q_graph_score(s, d):
    return roadmap.graph_score(_rated(s, d))


@add("q_bottlenecks", _N + _RATED + " SELECT candidate, CAST(rank AS INTEGER) AS rank, skill, completion FROM (SELECT *, row_number() OVER (PARTITION BY candidate ORDER BY completion, ordinal, skill) AS rank FROM rated) WHERE rank <= 3 AND completion < 0.5")
def q_bottlenecks(s, d):
    return roadmap.bottlenecks(_rated(s, d))


@add(
    "q_weighted_score",
    _N + _RATED + f", pairs(a, b) AS (VALUES {', '.join(map(str, fx.PAIRS))}), bonus AS (SELECT x.candidate, least(0.02 * count(*), 0.10) AS bonus FROM pairs JOIN rated x ON x.skill = a AND x.status = 'owned' JOIN rated y ON y.skill = b AND y.status = 'owned' AND y.candidate = x.candidate GROUP BY 1),"
    " sc AS (SELECT candidate, sum(weight * mastery * market) / sum(weight) * 100 AS base, product(CASE WHEN status = 'missing' THEN 1 - least(penalty, 0.5) ELSE 1.0 END) AS kept FROM rated GROUP BY 1)"
    " SELECT candidate, CAST(round_even(least(100.0, base * kept * (1 + coalesce(bonus, 0.0))), 0) AS BIGINT) AS score FROM sc LEFT JOIN bonus USING (candidate)",
)
def q_weighted_score(s, d):
    return roadmap.weighted_score(_rated(s, d), s.createDataFrame(fx.PAIRS, "a string, b string"))


@add("q_skill_priority", _N + _RATED + " SELECT candidate, skill, round(0.4 * market + 0.3 * (weight * 100) / 100 + 0.2 * completion + 0.1 * least(1.5, 3.0 / (missing + 1)), 3) AS priority FROM rated")
def q_skill_priority(s, d):
    c = F.col
    return _rated(s, d).select("candidate", "skill", roadmap.skill_priority(c("market"), c("weight") * 100, c("completion"), c("missing") + 1).alias("priority"))


# Insights and roadmaps

_INS = (
    ", st AS (SELECT t.candidate, t.role, m.skill, m.frequency_pct FROM targets t JOIN m USING (role) JOIN own o ON o.candidate = t.candidate AND o.skill = m.skill),"
    " met AS (SELECT 'prerequisite' AS kind, w.candidate, w.role, w.skill AS via, w.frequency_pct, e.dst AS skill, e.ordinal FROM w JOIN edges e ON e.src = w.skill AND e.type = 'prerequisite' WHERE severity <> 'optional'"
    " UNION ALL SELECT 'expand', st.candidate, st.role, st.skill, st.frequency_pct, e.dst, e.ordinal FROM st JOIN edges e ON e.src = st.skill AND e.type = 'leads_to' WHERE frequency_pct >= 50"
    " UNION ALL SELECT 'deepen', w.candidate, w.role, w.skill, w.frequency_pct, e.dst, e.ordinal FROM w JOIN edges e ON e.src = w.skill AND e.type = 'prerequisite' WHERE severity = 'optional' AND frequency_pct >= 20),"
    " un AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY kind, candidate, role, skill ORDER BY frequency_pct DESC, via, ordinal) AS rn FROM met WHERE NOT EXISTS (SELECT 1 FROM own o WHERE o.candidate = met.candidate AND o.skill = met.skill)) WHERE rn = 1),"
    " ins AS (SELECT candidate, role, kind, skill, via, CAST(row_number() OVER (PARTITION BY kind, candidate, role ORDER BY frequency_pct DESC, via, ordinal) AS INTEGER) AS pos FROM un)"
)


@add("q_graph_insights", _N + _INS + " SELECT * FROM ins")
def q_graph_insights(s, d):
    return insights.graph_insights(*_all(s, d), fx.edges(s))


@add(
    "q_learning_order",
    _N + _INS + ", l AS (SELECT candidate, role, skill, 0 AS prio, pos FROM ins WHERE kind = 'prerequisite' UNION ALL SELECT candidate, role, skill, 1, row_number() OVER (PARTITION BY candidate, role ORDER BY frequency_pct DESC, skill) FROM w WHERE severity = 'critical'"
    " UNION ALL SELECT candidate, role, skill, 2, row_number() OVER (PARTITION BY candidate, role ORDER BY frequency_pct DESC, skill) FROM w WHERE severity = 'medium' UNION ALL SELECT candidate, role, skill, 3, pos FROM ins WHERE kind = 'expand' UNION ALL SELECT candidate, role, skill, 4, pos FROM ins WHERE kind = 'deepen'),"
    " f AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY candidate, role, skill ORDER BY prio, pos) AS rn FROM l) WHERE rn = 1)"
    " SELECT candidate, role, skill, prio, CAST(row_number() OVER (PARTITION BY candidate, role ORDER BY prio, pos, skill) AS INTEGER) AS step FROM f",
)
def q_learning_order(s, d):
    o, t, m = _all(s, d)
    return insights.learning_order(gap.weaknesses(o, t, m, 70.0, 50.0), insights.graph_insights(o, t, m, fx.edges(s)))


@add(
    "q_rule_phases",
    _N + _INS + ", r AS (SELECT *, row_number() OVER (PARTITION BY candidate, role, severity ORDER BY frequency_pct DESC, skill) AS rn FROM w),"
    " o AS (SELECT *, row_number() OVER (PARTITION BY candidate, role ORDER BY frequency_pct DESC, skill) AS rn FROM w WHERE severity = 'optional' AND frequency_pct >= 30)"
    " SELECT DISTINCT * FROM (SELECT candidate, role, 1 AS phase, skill FROM ins WHERE kind = 'prerequisite' AND pos <= 3 UNION ALL SELECT candidate, role, 2, skill FROM r WHERE severity = 'medium' AND rn <= 2 UNION ALL SELECT candidate, role, 3, skill FROM r WHERE severity = 'critical' AND rn <= 2"
    " UNION ALL SELECT candidate, role, 3, skill FROM o WHERE rn <= 1 UNION ALL SELECT candidate, role, 4, skill FROM ins WHERE kind = 'expand' AND pos <= 2 UNION ALL SELECT DISTINCT candidate, role, 4, 'docker' FROM w)",
)
def q_rule_phases(s, d):
    o, t, m = _all(s, d)
    return insights.rule_phases(gap.weaknesses(o, t, m, 70.0, 50.0), insights.graph_insights(o, t, m, fx.edges(s)))


#: Phases cut from rows (candidate, skill, pos), as chunk_phases does.
_CHUNKS = (
    "sz AS (SELECT *, CAST(greatest(2, ceil(n / ceil(n / 5.0))) AS BIGINT) AS k FROM pos), ph AS (SELECT candidate, skill, CAST(CASE WHEN ceil(n / CAST(k AS DOUBLE)) > 1 AND n - (ceil(n / CAST(k AS DOUBLE)) - 1) * k < 2"
    " AND (pos - 1) // k + 1 = ceil(n / CAST(k AS DOUBLE)) THEN (pos - 1) // k ELSE (pos - 1) // k + 1 END AS INTEGER) AS phase FROM sz)"
)
#: The latest phase of what each skill of ph needs inside ph.
_REPAIRED = (
    ", inner_up(candidate, skill, need) AS (SELECT candidate, skill, skill FROM ph UNION SELECT u.candidate, u.skill, e.dst FROM inner_up u JOIN needs e ON e.src = u.need JOIN ph p ON p.candidate = u.candidate AND p.skill = e.dst),"
    " fixed AS (SELECT u.candidate, u.skill, max(p.phase) AS phase FROM inner_up u JOIN ph p ON p.candidate = u.candidate AND p.skill = u.need GROUP BY 1, 2)"
)
_READY = (
    ", ready AS (SELECT t.candidate, t.role, CAST(coalesce(round_even(round(sum(CASE WHEN o.skill IS NOT NULL THEN frequency_pct ELSE 0 END), 2) / round(sum(frequency_pct), 2) * 100, 0), 0) AS BIGINT) AS readiness"
    " FROM targets t LEFT JOIN m USING (role) LEFT JOIN own o ON o.candidate = t.candidate AND o.skill = m.skill GROUP BY 1, 2)"
)


@add(
    "q_roadmap_document",
    _N + _up("SELECT candidate, skill AS goal FROM w WHERE severity <> 'optional'", ", least_up AS (SELECT candidate, goal, skill, min(depth) AS depth FROM up GROUP BY ALL), deep AS (SELECT candidate, goal AS skill, max(depth) AS depth FROM least_up GROUP BY 1, 2)")
    + ", pos AS (SELECT candidate, skill, row_number() OVER (PARTITION BY candidate ORDER BY depth, frequency_pct DESC, skill) AS pos, count(*) OVER (PARTITION BY candidate) AS n FROM w JOIN deep USING (candidate, skill) WHERE severity <> 'optional'), "
    + _CHUNKS + _REPAIRED + _READY
    + ", each AS (SELECT candidate, phase, '{\"phase\":' || phase || ',\"skills\":[' || string_agg('\"' || skill || '\"', ',' ORDER BY skill) || ']}' AS one FROM fixed GROUP BY 1, 2), listed AS (SELECT candidate, '[' || string_agg(one, ',' ORDER BY phase) || ']' AS phases FROM each GROUP BY 1)"
    " SELECT candidate, role, readiness, phases FROM ready LEFT JOIN listed USING (candidate)",
)
def q_roadmap_document(s, d):
    out = insights.roadmap_document(*_all(s, d), fx.edges(s))
    return out.select("candidate", "role", "readiness", F.to_json("phases").alias("phases"))


#: Skills to learn with all their prerequisites, their longest chains from what is owned, and even phases.
_EXPANDED = (
    ", closed(candidate, skill) AS (SELECT candidate, skill FROM w UNION SELECT c.candidate, e.dst FROM closed c JOIN needs e ON e.src = c.skill WHERE NOT EXISTS (SELECT 1 FROM own o WHERE o.candidate = c.candidate AND o.skill = e.dst)),"
    " chain(candidate, skill, depth) AS (SELECT candidate, skill, 0 FROM own UNION SELECT c.candidate, e.src, c.depth + 1 FROM chain c JOIN needs e ON e.dst = c.skill JOIN closed x ON x.candidate = c.candidate AND x.skill = e.src),"
    " deep AS (SELECT x.candidate, x.skill, coalesce(max(c.depth), 0) AS depth FROM closed x LEFT JOIN chain c USING (candidate, skill) GROUP BY 1, 2),"
    " pos AS (SELECT *, row_number() OVER (PARTITION BY candidate ORDER BY depth, skill) AS pos, count(*) OVER (PARTITION BY candidate) AS n FROM deep),"
    " ph AS (SELECT candidate, skill, depth, pos, CAST((pos - 1) // CAST(greatest(2, ceil(n / least(6, greatest(1, ceil(n / 5.0))))) AS BIGINT) + 1 AS INTEGER) AS phase FROM pos)"
)


def _expanded(s, d):
    return roadmap.expanded_phases(_own(s, d), _weak(s, d), fx.edges(s))


@add(
    "q_expanded_phases",
    _N + _EXPANDED + _REPAIRED + f", named AS (SELECT f.candidate, f.phase, string_agg(f.skill, '|' ORDER BY p.pos) AS skills, CAST(count(*) AS INTEGER) AS skill_count, avg(p.depth) AS mean FROM fixed f JOIN ph p USING (candidate, skill) GROUP BY 1, 2)"
    f" SELECT candidate, phase, coalesce([{', '.join(repr(t) for t in roadmap.TITLES)}][phase], 'Phase ' || phase) AS title, skills, skill_count, round(mean, 2) AS avg_depth,"
    " CASE WHEN mean < 1 THEN 'Kiến thức nền tảng, làm quen với các khái niệm cơ bản' WHEN mean < 2 THEN 'Kỹ năng cốt lõi, xây dựng nền tảng vững chắc' WHEN mean < 3 THEN 'Phát triển chuyên sâu, áp dụng vào dự án thực tế' ELSE 'Kỹ năng nâng cao, tối ưu và mở rộng hệ thống' END AS reason FROM named",
)
def q_expanded_phases(s, d):
    return roadmap.expanded_summary(_expanded(s, d)).withColumn("skills", joined("skills"))


@add(
    "q_graph_projection",
    _N + _EXPANDED + _REPAIRED
    + ", want AS (SELECT t.candidate, m.skill, frequency_pct / 100 AS weight, 0.8 + (m.count % 5) / 10 AS market, row_number() OVER (PARTITION BY t.candidate ORDER BY frequency_pct DESC, m.skill) AS ordinal FROM targets t JOIN m USING (role)),"
    " stages AS (SELECT DISTINCT candidate, 0 AS phase FROM want UNION SELECT candidate, phase FROM fixed), since AS (SELECT candidate, skill, min(phase) AS phase FROM (SELECT candidate, skill, 0 AS phase FROM own UNION ALL SELECT * FROM fixed) GROUP BY 1, 2),"
    " hand AS (SELECT s.candidate, s.phase, x.skill FROM stages s JOIN since x ON x.candidate = s.candidate AND x.phase <= s.phase),"
    " climb(candidate, phase, skill, here, depth) AS (SELECT candidate, phase, skill, skill, 0 FROM stages JOIN want USING (candidate) UNION SELECT c.candidate, c.phase, c.skill, e.dst, c.depth + 1 FROM climb c JOIN needs e ON e.src = c.here"
    " WHERE NOT EXISTS (SELECT 1 FROM hand h WHERE h.candidate = c.candidate AND h.phase = c.phase AND h.skill = c.here)),"
    " near AS (SELECT c.candidate, c.phase, c.skill, coalesce(min(CASE WHEN h.skill IS NOT NULL THEN depth END), 999) AS depth FROM climb c LEFT JOIN hand h ON h.candidate = c.candidate AND h.phase = c.phase AND h.skill = c.here GROUP BY 1, 2, 3),"
    " seen(candidate, phase, goal, skill) AS (SELECT candidate, phase, skill, skill FROM stages JOIN want USING (candidate) UNION SELECT u.candidate, u.phase, u.goal, e.dst FROM seen u JOIN needs e ON e.src = u.skill"
    " WHERE NOT EXISTS (SELECT 1 FROM hand h WHERE h.candidate = u.candidate AND h.phase = u.phase AND h.skill = e.dst)),"
    " lack AS (SELECT u.candidate, u.phase, u.goal AS skill, count(e.dst) AS missing FROM seen u LEFT JOIN needs e ON e.src = u.skill AND NOT EXISTS (SELECT 1 FROM hand h WHERE h.candidate = u.candidate AND h.phase = u.phase AND h.skill = e.dst) GROUP BY 1, 2, 3),"
    " rated AS (SELECT n.candidate, n.phase, n.skill, weight, market, ordinal, CASE WHEN depth = 0 THEN 1.0 WHEN depth >= 999 THEN 0.0 ELSE 1.0 / (depth + 1) END AS completion, CASE WHEN depth = 0 THEN 0 ELSE missing END AS missing"
    " FROM near n JOIN lack l USING (candidate, phase, skill) JOIN want USING (candidate, skill)),"
    " scores AS (SELECT candidate, phase, CAST(round_even(least(100.0, sum(weight * completion * (1 - least(0.15 * missing, 0.5)) * market) / sum(weight) * 100), 0) AS BIGINT) AS score FROM rated GROUP BY 1, 2),"
    " low AS (SELECT candidate, phase, string_agg(skill, '|' ORDER BY rn) AS bottlenecks FROM (SELECT *, row_number() OVER (PARTITION BY candidate, phase ORDER BY completion, ordinal) AS rn FROM rated) WHERE rn <= 3 AND completion < 0.5 GROUP BY 1, 2)"
    " SELECT candidate, CAST(phase AS INTEGER) AS phase, score, score - coalesce(lag(score) OVER (PARTITION BY candidate ORDER BY phase), score) AS delta, coalesce(bottlenecks, '') AS bottlenecks FROM scores LEFT JOIN low USING (candidate, phase)",
)
def q_graph_projection(s, d):
    own, to, m = _stored(s, d)
    rank = F.row_number().over(W.partitionBy("candidate").orderBy(F.desc("frequency_pct"), "skill"))

    def projected(owned, targets):
        skills = targets.join(m, "role").select("candidate", "skill", (F.col("frequency_pct") / 100).alias("weight"), (F.lit(0.8) + F.col("count") % 5 / 10).alias("market"), rank.alias("ordinal"))
        phases = roadmap.expanded_phases(owned, gap.weaknesses(owned, targets, m, 70.0, 50.0), fx.edges(s)).select("candidate", "phase", "skill")
        return roadmap.graph_projection(skills, owned, phases, fx.edges(s)).withColumn("bottlenecks", joined("bottlenecks"))

    return alike.for_each_state(own, to, projected)


_ALLOWED = {"Student": ["Beginner"], "Fresher": ["Beginner"], "Junior": ["Beginner", "Intermediate"], "Middle": ["Intermediate", "Advanced"]}


@add(
    "q_project_select",
    _N + f", {fx.POOL_SQL}, pos AS (SELECT candidate, skill, row_number() OVER (PARTITION BY candidate ORDER BY frequency_pct DESC, skill) AS pos, count(*) OVER (PARTITION BY candidate) AS n FROM w), " + _CHUNKS
    + ", need AS (SELECT candidate * 100 + phase AS phase_id, ['Student', 'Fresher', 'Junior', 'Middle'][candidate % 4 + 1] AS stage, list(skill) AS skills FROM ph GROUP BY candidate, phase),"
    f" allowed(stage, difficulties) AS (VALUES {', '.join(f'({k!r}, {v!r})' for k, v in _ALLOWED.items())}),"
    " x AS (SELECT phase_id, name, round(CAST(len(list_intersect(list_transform(skills, lambda x: lower(x)), list_transform(primary_skills, lambda x: lower(x)))) AS DOUBLE)"
    " / len(list_distinct(list_concat(list_transform(skills, lambda x: lower(x)), list_transform(primary_skills, lambda x: lower(x))))), 4) AS match FROM need n, pool p"
    " WHERE list_contains(p.suitable_stages, n.stage) OR list_contains((SELECT difficulties FROM allowed a WHERE a.stage = n.stage), p.difficulty))"
    " SELECT phase_id, name, match FROM (SELECT *, row_number() OVER (PARTITION BY phase_id ORDER BY match DESC, name) AS rn FROM x WHERE match >= 0.25) WHERE rn = 1",
)
def q_project_select(s, d):
    pos = F.row_number().over(W.partitionBy("candidate").orderBy(F.desc("frequency_pct"), "skill"))
    phases = roadmap.chunk_phases(_weak(s, d).select("candidate", "skill", pos.alias("pos")))
    stage = F.element_at(F.array(*[F.lit(x) for x in roadmap.STAGES]), (F.col("candidate") % 4 + 1).cast("int"))
    need = phases.groupBy("candidate", "phase").agg(F.collect_list("skill").alias("skills")).select((F.col("candidate") * 100 + F.col("phase")).alias("phase_id"), stage.alias("stage"), "skills")
    return roadmap.select_projects(need, fx.pool(s), _ALLOWED, 0.25)


#: The role's skills by status, the most frequent first.
_STATUS = (
    ", status AS (SELECT t.candidate, m.skill, m.frequency_pct, CASE WHEN o.skill IS NOT NULL THEN 'completed' WHEN EXISTS (SELECT 1 FROM needs e JOIN own x ON x.skill = e.dst AND x.candidate = t.candidate JOIN m y ON y.role = t.role AND y.skill = e.dst WHERE e.src = m.skill) THEN 'partial' ELSE 'missing' END AS status"
    " FROM targets t JOIN m USING (role) LEFT JOIN own o ON o.candidate = t.candidate AND o.skill = m.skill),"
    " st AS (SELECT candidate, coalesce(list(skill ORDER BY frequency_pct DESC, skill) FILTER (status = 'completed'), []) AS c, coalesce(list(skill ORDER BY frequency_pct DESC, skill) FILTER (status = 'partial'), []) AS p, coalesce(list(skill ORDER BY frequency_pct DESC, skill) FILTER (status = 'missing'), []) AS x FROM status GROUP BY 1)"
)


@add(
    "q_personal_story",
    _N + _STATUS + ", k AS (SELECT *, ['Student', 'Fresher', 'Junior', 'Middle'][candidate % 4 + 1] AS stage FROM st JOIN targets USING (candidate))"
    " SELECT candidate, 'Chào bạn! ' || CASE stage WHEN 'Student' THEN 'bạn đang là sinh viên' WHEN 'Fresher' THEN 'bạn mới ra trường' WHEN 'Junior' THEN 'bạn đang ở cấp độ Junior' ELSE 'bạn đã có kinh nghiệm' END || '. Bạn đang nhắm đến vị trí ' || role || '. '"
    " || CASE WHEN len(c) > 0 THEN 'Điểm mạnh hiện tại của bạn: ' || array_to_string(c[1:5], ', ') || '. ' ELSE 'Bạn đang bắt đầu từ đầu. ' END || CASE WHEN len(p) > 0 THEN 'Bạn đang trong quá trình học ' || array_to_string(p[1:3], ', ') || '. ' ELSE '' END"
    " || 'Còn thiếu ' || len(x) || ' kỹ năng quan trọng: ' || array_to_string(x[1:3], ', ') || '.' AS summary,"
    " concat_ws('|', CASE WHEN len(p) > 0 THEN 'Hoàn thành ' || array_to_string(p[1:2], ', ') || ' trước' END, CASE WHEN len(x) > 0 THEN 'Tập trung vào ' || x[1] || ' - đây là kỹ năng cốt lõi' END) AS focus,"
    " CASE stage WHEN 'Student' THEN 'Tận dụng thời gian ở trường để xây dựng portfolio' WHEN 'Fresher' THEN 'Tập trung xây dựng các dự án cá nhân để chứng minh năng lực' ELSE 'Kết hợp học lý thuyết với thực hành qua dự án thực tế' END AS advice FROM k",
)
def q_personal_story(s, d):
    own, to, m = _all(s, d)
    stage = F.element_at(F.array(*[F.lit(x) for x in roadmap.STAGES]), (F.col("candidate") % 4 + 1).cast("int"))
    rows = insights.ordered_statuses(own, to, m, fx.edges(s)).join(to, "candidate").withColumn("stage", stage).withColumn("first_phase", F.array().cast("array<string>"))
    return narratives.personal_story(rows).select("candidate", "summary", joined("focus").alias("focus"), F.element_at("advice", 1).alias("advice"))


@add(
    "q_score_report",
    _N + ", k AS (SELECT c_custkey AS candidate, c_mktsegment AS role, c_custkey % 97 AS now, c_custkey % 97 + c_custkey % 5 AS last, CASE WHEN c_custkey % 3 = 0 THEN [] ELSE ['sql', 'ml'] END AS low, c_custkey % 4 AS lost FROM customer)"
    " SELECT candidate, 'Bạn đạt ' || now || '% mức độ phù hợp cho vị trí ' || role || ' - ' || CASE WHEN now < 30 THEN 'còn rất nhiều khoảng cách' WHEN now < 60 THEN 'đang ở mức trung bình' WHEN now < 80 THEN 'khá tốt' ELSE 'rất tốt' END || '. '"
    " || CASE WHEN len(low) > 0 THEN 'Điểm nghẽn chính: sql, ml. ' ELSE '' END || CASE WHEN lost > 0 THEN 'Bạn bị trừ ' || lost * 25 || '% do thiếu các kỹ năng nền tảng. ' ELSE '' END"
    " || CASE WHEN last > now THEN 'Sau khi hoàn thành roadmap, bạn có thể đạt ' || last || '% (tăng ' || (last - now) || '%).' ELSE 'Hoàn thành roadmap giúp bạn đạt ' || last || '%.' END AS report,"
    " concat_ws('|', CASE WHEN len(low) > 0 THEN 'sql' END, CASE WHEN len(low) > 0 THEN 'ml' END, CASE WHEN lost > 0 THEN 'dl' END) AS weaknesses,"
    " CASE WHEN len(low) = 0 AND last = now THEN 'Bắt đầu với kỹ năng có độ khó thấp nhất trước' ELSE concat_ws('|', CASE WHEN len(low) > 0 THEN 'Tập trung vào sql - đây là kỹ năng quan trọng nhất còn thiếu' END, CASE WHEN last > now THEN 'Hoàn thành Phase 2 để tăng ' || (last - now) || '% ATS' END) END AS next_actions, last - now AS improvement FROM k",
)
def q_score_report(s, d):
    key = F.col("c_custkey")
    low = F.when(key % 3 == 0, F.array().cast("array<string>")).otherwise(F.array(F.lit("sql"), F.lit("ml")))
    lost = F.when(key % 4 > 0, F.array(F.struct(F.lit("dl").alias("skill"), (key % 4 * 0.25).cast("double").alias("penalty")), F.struct(F.lit("sql").alias("skill"), F.lit(0.0).alias("penalty"))))
    lost = F.when((key % 4 > 0) & (key % 3 == 0), F.slice(lost, 1, 1)).otherwise(lost)
    gains = F.array(F.struct(F.lit(1).alias("phase"), F.lit(0).cast("long").alias("delta")), F.struct(F.lit(2).alias("phase"), key % 5 * F.lit(1).cast("long")).cast("struct<phase: int, delta: bigint>"))
    rows = table(s, d, "customer").select(key.alias("candidate"), F.col("c_mktsegment").alias("role"), (key % 97).alias("current_score"), (key % 97 + key % 5).alias("final_score"), low.alias("bottlenecks"), lost.alias("penalties"), gains.alias("phases"))
    return narratives.score_report(rows).withColumn("weaknesses", joined("weaknesses")).withColumn("next_actions", joined("next_actions"))


@add("q_full_roadmap")
def q_full_roadmap(s, d):
    """Every customer's whole roadmap document as JSON; its parts have oracles of their own, tests hold the whole against them."""
    own, to, m = _stored(s, d)
    stage = F.element_at(F.array(*[F.lit(x) for x in roadmap.STAGES]), (F.col("candidate") % 4 + 1).cast("int"))

    def documents(owned, targets):
        out = insights.full_roadmap(owned, targets.select("candidate", "role"), m, fx.edges(s), targets.select("candidate", "stage"), fx.pool(s), _ALLOWED, 0.25)
        return out.select("candidate", "role", "current_score", "final_score", F.to_json(F.struct("stage", "readiness", "bottlenecks", "phases", "story", "report")).alias("document"))

    return alike.for_each_state(own, to.withColumn("stage", stage), documents)
