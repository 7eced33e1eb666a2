"""The query catalogue: name -> callable(spark, sf_dir), and name -> oracle SQL.

The operators run on proxies in the driver's tables: a job is an order, its role the customer's market segment, its skills
the brands of its lines' parts; a candidate is a customer, who owns the brands of their urgent orders. Frequencies lie
between 10 and 20 per cent there, so cuts are lower than the operators' defaults. Arrays leave as text joined by '|'.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from skillweave.functions import sets, text
from skillweave.functions.repair import repaired_json
from skillweave.operators import evaluate, fuzzy, gap, market, matching, profile, roadmap, sections, transitions
from skillweave.plans import fixtures as fx
from skillweave.plans.base import BASE as _BASE
from skillweave.plans.base import CORE, CRITICAL, IMPORTANT, ORACLES, QUERIES
from skillweave.plans.base import add as _add
from skillweave.plans.base import brands as _brands
from skillweave.plans.base import joined as _join
from skillweave.plans.base import matrix as _matrix
from skillweave.plans.base import owned as _owned
from skillweave.plans.base import targets as _targets
from skillweave.session import table
from skillweave.sources import tables
from skillweave.storage import stored

#: Owned skills as every second candidate would shout them.
_MIXED = "mixed AS (SELECT candidate, CASE WHEN candidate % 2 = 0 THEN upper(skill) ELSE skill END AS skill FROM owned)"


def _mixed(s: SparkSession, d: str) -> DataFrame:
    return _owned(s, d).withColumn("skill", F.when(F.col("candidate") % 2 == 0, F.upper("skill")).otherwise(F.col("skill")))


# Sources and profiles


@_add(
    "q_union_sources",
    "SELECT source, count(*) AS n, CAST(sum(length(coalesce(txt, ''))) AS BIGINT) AS chars, min(record_id) AS first_id FROM ("
    " SELECT 'documents' AS source, text AS txt, 'DOC_' || lpad(CAST(row_number() OVER (ORDER BY doc_id) AS VARCHAR), CAST(greatest(4, length(CAST((SELECT count(*) FROM documents) AS VARCHAR))) AS INTEGER), '0') AS record_id FROM documents"
    " UNION ALL SELECT 'conversations', text, 'CONV_' || lpad(CAST(row_number() OVER (ORDER BY conv_id, turn) AS VARCHAR), CAST(greatest(4, length(CAST((SELECT count(*) FROM conversations) AS VARCHAR))) AS INTEGER), '0') FROM conversations"
    " UNION ALL SELECT 'benchmark', text, 'BENCH_' || lpad(CAST(row_number() OVER (ORDER BY item_id) AS VARCHAR), CAST(greatest(4, length(CAST((SELECT count(*) FROM benchmark) AS VARCHAR))) AS INTEGER), '0') FROM benchmark) GROUP BY source",
)
def q_union_sources(s, d):
    docs = tables.unified(table(s, d, "documents"), "DOC", "documents", "text", "doc_id", description=F.col("text"))
    rows = tables.union_records(
        docs,
        tables.unified(table(s, d, "conversations"), "CONV", "conversations", "text", ["conv_id", "turn"], description=F.col("text")),
        tables.unified(table(s, d, "benchmark"), "BENCH", "benchmark", "text", "item_id", description=F.col("text")),
    )
    return rows.groupBy("source").agg(F.count(F.lit(1)).alias("n"), F.sum(F.length(F.coalesce("description", F.lit("")))).alias("chars"), F.min("record_id").alias("first_id"))


@_add(
    "q_value_counts",
    "SELECT source, lang, count(*) AS n FROM documents GROUP BY source, lang",
)
def q_value_counts(s, d):
    return market.value_counts(table(s, d, "documents"), "source", "lang")


@_add(
    "q_null_profile",
    "WITH j AS (SELECT d.doc_id, d.lang, l.quality, l.toxic FROM documents d LEFT JOIN labels l USING (doc_id)) "
    + " UNION ALL ".join(f'SELECT \'{c}\' AS "column", count(*) FILTER ({c} IS NULL) AS nulls, round(100.0 * count(*) FILTER ({c} IS NULL) / count(*), 2) AS null_pct FROM j' for c in ("doc_id", "lang", "quality", "toxic")),
)
def q_null_profile(s, d):
    return market.null_profile(table(s, d, "documents").select("doc_id", "lang").join(table(s, d, "labels"), "doc_id", "left").select("doc_id", "lang", "quality", "toxic"))


_SIZES = "count(*) AS n, round(avg(CASE WHEN k > 0 THEN 1.0 ELSE 0.0 END) * 100, 2) AS coverage_pct, round(avg(CAST(k AS DOUBLE)), 4) AS mean_size, median(CAST(k AS DOUBLE)) AS median_size, CAST(min(k) AS BIGINT) AS min_size, CAST(max(k) AS BIGINT) AS max_size"


def _candidate_sizes(s, d):
    n = _owned(s, d).groupBy("candidate").agg(F.count(F.lit(1)).alias("k"))
    return _targets(s, d).join(n, "candidate", "left").fillna({"k": 0})


@_add("q_size_summary", _BASE + f"SELECT {_SIZES} FROM (SELECT t.candidate, count(o.skill) AS k FROM targets t LEFT JOIN owned o USING (candidate) GROUP BY 1)")
def q_size_summary(s, d):
    return market.size_summary(_candidate_sizes(s, d), F.col("k"))


@_add("q_size_summary_by_role", _BASE + f"SELECT role, {_SIZES} FROM (SELECT t.candidate, any_value(t.role) AS role, count(o.skill) AS k FROM targets t LEFT JOIN owned o USING (candidate) GROUP BY 1) GROUP BY role")
def q_size_summary_by_role(s, d):
    return market.size_summary(_candidate_sizes(s, d), F.col("k"), "role")


@_add("q_distinct_counts", _BASE + "SELECT count(DISTINCT role) AS roles, count(DISTINCT skill) AS skills, count(*) AS cells FROM matrix")
def q_distinct_counts(s, d):
    return _matrix(s, d).agg(F.countDistinct("role").alias("roles"), F.countDistinct("skill").alias("skills"), F.count(F.lit(1)).alias("cells"))


@_add("q_table_summary", "SELECT 'documents' AS name, count(*) AS rows FROM documents UNION ALL SELECT 'labels', count(*) FROM labels UNION ALL SELECT 'part', count(*) FROM part")
def q_table_summary(s, d):
    return market.table_summary(**{n: table(s, d, n) for n in ("documents", "labels", "part")})


# Market


@_add("q_role_skill_matrix", _BASE + "SELECT * FROM matrix")
def q_role_skill_matrix(s, d):
    return market.ordered_matrix(_matrix(s, d))


@_add("q_skill_frequency_top", "SELECT p_brand AS skill, count(*) AS n FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1 ORDER BY n DESC, skill LIMIT 10")
def q_skill_frequency_top(s, d):
    lines, part = table(s, d, "lineitem"), table(s, d, "part")
    return market.top_values(lines.join(part, lines.l_partkey == part.p_partkey).select(F.col("p_brand").alias("skill")), "skill", 10)


@_add(
    "q_top_skills_per_role",
    _BASE + "SELECT role, CAST(rank AS INTEGER) AS rank, skill, frequency_pct FROM (SELECT *, row_number() OVER (PARTITION BY role ORDER BY frequency_pct DESC, skill) AS rank FROM matrix) WHERE rank <= 5",
)
def q_top_skills_per_role(s, d):
    return market.top_skills_per_role(_matrix(s, d))


@_add(
    "q_role_stats_exact",
    _BASE + "SELECT role, skill, frequency_pct, CAST(row_number() OVER (PARTITION BY role ORDER BY frequency_pct DESC, skill) AS INTEGER) AS rank FROM matrix WHERE lower(role) = 'building'",
)
def q_role_stats_exact(s, d):
    return market.role_stats(_matrix(s, d), "Building").select("role", "skill", "frequency_pct", "rank")


@_add(
    "q_role_stats_lookup",
    _BASE + "SELECT role, skill, frequency_pct, CAST(row_number() OVER (PARTITION BY role ORDER BY frequency_pct DESC, skill) AS INTEGER) AS rank FROM matrix WHERE contains(lower(role), 'u')",
)
def q_role_stats_lookup(s, d):
    return market.role_stats(_matrix(s, d), "U").select("role", "skill", "frequency_pct", "rank")


@_add("q_skill_sets", _BASE + "SELECT role, string_agg(skill, '|' ORDER BY skill) AS skills, CAST(count(*) AS INTEGER) AS n FROM matrix WHERE frequency_pct >= 15 GROUP BY role")
def q_skill_sets(s, d):
    return market.skill_sets(_matrix(s, d), CORE).select("role", _join("skills").alias("skills"), F.size("skills").alias("n"))


# Gaps


@_add(
    "q_strengths",
    _BASE + f", {_MIXED} SELECT t.candidate, t.role, m.skill, m.frequency_pct, CASE WHEN frequency_pct >= 15 THEN 'Core' WHEN frequency_pct >= 14 THEN 'Important' ELSE 'Bonus' END AS level FROM targets t JOIN matrix m USING (role) JOIN mixed o ON o.candidate = t.candidate AND lower(o.skill) = lower(m.skill)",
)
def q_strengths(s, d):
    return gap.strengths(_mixed(s, d), _targets(s, d), _matrix(s, d), CORE, IMPORTANT).select("candidate", "role", "skill", "frequency_pct", "level")


_WEAK = "weak AS (SELECT t.candidate, t.role, m.skill, m.frequency_pct, CASE WHEN frequency_pct >= 16 THEN 'critical' WHEN frequency_pct >= 15 THEN 'medium' ELSE 'optional' END AS severity FROM targets t JOIN matrix m USING (role) WHERE NOT EXISTS (SELECT 1 FROM owned o WHERE o.candidate = t.candidate AND o.skill = m.skill))"


def _weak(s, d):
    return gap.weaknesses(_owned(s, d), _targets(s, d), _matrix(s, d), CRITICAL, CORE)


@_add("q_weaknesses", _BASE + f", {_WEAK} SELECT candidate, role, skill, frequency_pct, severity FROM weak")
def q_weaknesses(s, d):
    return _weak(s, d).select("candidate", "role", "skill", "frequency_pct", "severity")


@_add("q_severity", _BASE + f", {_WEAK} SELECT role, severity, count(*) AS n, count(DISTINCT candidate) AS candidates FROM weak GROUP BY 1, 2")
def q_severity(s, d):
    return _weak(s, d).groupBy("role", "severity").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("candidate").alias("candidates"))


@_add("q_extra_skills", _BASE + f", {_MIXED} SELECT o.candidate, t.role, o.skill FROM mixed o JOIN targets t USING (candidate) WHERE NOT EXISTS (SELECT 1 FROM matrix m WHERE m.role = t.role AND lower(m.skill) = lower(o.skill))")
def q_extra_skills(s, d):
    return gap.extra_skills(_mixed(s, d), _targets(s, d), _matrix(s, d)).select("candidate", "role", "skill")


@_add(
    "q_readiness",
    _BASE + f", {_MIXED} SELECT t.candidate, t.role, round(sum(CASE WHEN o.skill IS NOT NULL THEN frequency_pct ELSE 0 END), 2) AS owned_weight, round(sum(frequency_pct), 2) AS total_weight,"
    " CAST(round_even(round(sum(CASE WHEN o.skill IS NOT NULL THEN frequency_pct ELSE 0 END), 2) / round(sum(frequency_pct), 2) * 100, 0) AS BIGINT) AS readiness"
    " FROM targets t JOIN matrix m USING (role) LEFT JOIN mixed o ON o.candidate = t.candidate AND lower(o.skill) = lower(m.skill) GROUP BY 1, 2",
)
def q_readiness(s, d):
    return gap.readiness(_mixed(s, d), _targets(s, d), _matrix(s, d)).select("candidate", "role", "owned_weight", "total_weight", "readiness")


@_add(
    "q_market_gap",
    _BASE + ", need AS (SELECT role, skill FROM (SELECT *, max(CASE WHEN frequency_pct >= 15 THEN 1 ELSE 0 END) OVER (PARTITION BY role) AS hi FROM matrix) WHERE hi = 0 OR frequency_pct >= 15)"
    " SELECT t.candidate, t.role, count(*) AS required, coalesce(string_agg(n.skill, '|' ORDER BY n.skill) FILTER (o.skill IS NOT NULL), '') AS have, coalesce(string_agg(n.skill, '|' ORDER BY n.skill) FILTER (o.skill IS NULL), '') AS need,"
    " round(count(o.skill) / count(*) * 100, 2) AS match_pct FROM targets t JOIN need n USING (role) LEFT JOIN owned o ON o.candidate = t.candidate AND o.skill = n.skill GROUP BY 1, 2",
)
def q_market_gap(s, d):
    out = gap.market_gap(_owned(s, d), _targets(s, d), _matrix(s, d), CORE)
    return out.select("candidate", "role", "required", _join("have").alias("have"), _join("need").alias("need"), "match_pct")


@_add(
    "q_improvement_actions",
    _BASE + f", {_WEAK}, ranked AS (SELECT *, CASE severity WHEN 'critical' THEN 'High' WHEN 'medium' THEN 'Medium' ELSE 'Low' END AS priority,"
    " row_number() OVER (PARTITION BY candidate, role ORDER BY CASE severity WHEN 'critical' THEN 1 WHEN 'medium' THEN 2 ELSE 3 END, frequency_pct DESC, skill) AS rank FROM weak)"
    " SELECT candidate, role, skill, priority, CAST(rank AS INTEGER) AS rank, 'Learn and practise ' || skill AS action FROM ranked WHERE rank <= 5",
)
def q_improvement_actions(s, d):
    return gap.improvement_actions(_weak(s, d)).select("candidate", "role", "skill", "priority", "rank", "action")


@_add(
    "q_merged_order",
    _BASE + f", {_WEAK}, lists AS (SELECT candidate, role, skill, 0 AS prio, row_number() OVER (PARTITION BY candidate, role ORDER BY skill DESC) AS pos FROM weak WHERE severity = 'critical'"
    " UNION ALL SELECT candidate, role, skill, 1, row_number() OVER (PARTITION BY candidate, role ORDER BY frequency_pct, skill) FROM weak),"
    " firsts AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY candidate, role, skill ORDER BY prio, pos) AS rn FROM lists) WHERE rn = 1)"
    " SELECT candidate, role, skill, prio, CAST(row_number() OVER (PARTITION BY candidate, role ORDER BY prio, pos, skill) AS INTEGER) AS step FROM firsts",
)
def q_merged_order(s, d):
    weak = _weak(s, d)
    at = lambda rows, *order: rows.withColumn("pos", F.row_number().over(W.partitionBy("candidate", "role").orderBy(*order)))
    return gap.merged_order(at(weak.filter("severity = 'critical'"), F.desc("skill")), at(weak, "frequency_pct", "skill"))


@_add(
    "q_market_insights",
    _BASE + f", {_WEAK} SELECT k.candidate, m.role, m.skill, m.frequency_pct, CASE w.severity WHEN 'critical' THEN 'High' WHEN 'medium' THEN 'Medium' ELSE 'Low' END AS priority"
    " FROM (SELECT DISTINCT candidate, role FROM weak) k JOIN matrix m USING (role) LEFT JOIN weak w ON w.candidate = k.candidate AND w.role = m.role AND w.skill = m.skill",
)
def q_market_insights(s, d):
    return roadmap.market_insights(_matrix(s, d), _weak(s, d))


# Transitions

_SETS = "sets AS (SELECT role, skill FROM allskills WHERE frequency_pct >= 14.7), sizes AS (SELECT role, count(*) AS n FROM sets GROUP BY role), tops AS (SELECT role, skill FROM allskills WHERE frequency_pct >= 15)"
_LISTS = (
    " coalesce((SELECT string_agg(x.skill, '|' ORDER BY x.skill) FROM sets x JOIN sets y ON x.skill = y.skill WHERE x.role = e.f AND y.role = e.t), '') AS shared_skills,"
    " coalesce((SELECT string_agg(x.skill, '|' ORDER BY x.skill) FROM tops x WHERE x.role = e.t AND NOT EXISTS (SELECT 1 FROM tops y WHERE y.role = e.f AND y.skill = x.skill)), '') AS new_skills_needed"
)
_PAIRS = (
    "ov AS (SELECT a.role AS a, b.role AS b, count(*) AS shared FROM sets a JOIN sets b ON a.skill = b.skill AND a.role < b.role GROUP BY 1, 2),"
    " found AS (SELECT CASE WHEN x.n > y.n THEN b ELSE a END AS f, CASE WHEN x.n > y.n THEN a ELSE b END AS t, round(CAST(shared AS DOUBLE) / (x.n + y.n - shared), 4) AS weight"
    " FROM ov JOIN sizes x ON x.role = a JOIN sizes y ON y.role = b WHERE CAST(shared AS DOUBLE) / (x.n + y.n - shared) >= 0.25)"
)


def _transitions(s, d):
    return transitions.transitions(_matrix(s, d), 14.7, 15.0, 0.25)


def _flat(rows):
    return rows.select(F.col("from").alias("from_role"), F.col("to").alias("to_role"), "weight", _join("shared_skills").alias("shared_skills"), _join("new_skills_needed").alias("new_skills_needed"))


@_add("q_role_transitions", _BASE + f", {_SETS}, {_PAIRS} SELECT f AS from_role, t AS to_role, weight, {_LISTS} FROM found e")
def q_role_transitions(s, d):
    return _flat(_transitions(s, d))


_SEEDS = [("AUTOMOBILE", "BUILDING"), ("MACHINERY", "FURNITURE"), ("ASTRONAUT", "PILOT")]


@_add(
    "q_predefined_transitions",
    _BASE + f", {_SETS}, {_PAIRS}, seeds(f, t) AS (VALUES {', '.join(map(str, _SEEDS))}),"
    " added AS (SELECT s.f, s.t, CASE WHEN x.n IS NULL AND y.n IS NULL THEN 0.3 ELSE coalesce(round(CAST((SELECT count(*) FROM sets p JOIN sets q ON p.skill = q.skill WHERE p.role = s.f AND q.role = s.t) AS DOUBLE)"
    " / (x.n + y.n - (SELECT count(*) FROM sets p JOIN sets q ON p.skill = q.skill WHERE p.role = s.f AND q.role = s.t)), 4), 0) END AS weight"
    " FROM seeds s LEFT JOIN sizes x ON x.role = s.f LEFT JOIN sizes y ON y.role = s.t WHERE NOT EXISTS (SELECT 1 FROM found o WHERE o.f = s.f AND o.t = s.t))"
    f" SELECT f AS from_role, t AS to_role, weight, {_LISTS} FROM (SELECT * FROM found UNION ALL SELECT * FROM added) e",
)
def q_predefined_transitions(s, d):
    seeds = s.createDataFrame(_SEEDS, "from string, to string")
    return _flat(transitions.seeded(_transitions(s, d), seeds, _matrix(s, d), 14.7, 15.0))


# Matching and search


@_add(
    "q_job_match_jaccard",
    _BASE + ", want(skill) AS (VALUES ('Brand#11'), ('Brand#22'), ('Brand#33'), ('Brand#44')), k AS (SELECT job_id, count(*) AS n, count(w.skill) AS hit FROM brands b LEFT JOIN want w USING (skill) GROUP BY 1)"
    " SELECT job_id, round(CAST(hit AS DOUBLE) / (n + 4 - hit) * 100, 2) AS score FROM k WHERE hit > 0 ORDER BY score DESC, job_id LIMIT 50",
)
def q_job_match_jaccard(s, d):
    jobs = _brands(s, d).groupBy("job_id").agg(F.collect_set("skill").alias("skills"))
    return matching.match_by_skills(jobs, F.array(*[F.lit(f"Brand#{i}") for i in (11, 22, 33, 44)]), 50)


@_add(
    "q_job_match_coverage",
    _BASE + ", want(skill) AS (VALUES ('Brand#11'), ('Brand#22'), ('Brand#33'), ('Brand#44')), k AS (SELECT job_id, count(*) AS n, count(w.skill) AS hit FROM brands b LEFT JOIN want w USING (skill) GROUP BY 1),"
    " sem AS (SELECT o_orderkey AS job_id, 0.5 AS score FROM orders WHERE o_orderstatus = 'F')"
    " SELECT job_id, round((0.7 * coalesce(sem.score, 0) + 0.3 * (CAST(hit AS DOUBLE) / n)) * 100, 2) AS score FROM k LEFT JOIN sem USING (job_id)"
    " WHERE round((0.7 * coalesce(sem.score, 0) + 0.3 * (CAST(hit AS DOUBLE) / n)) * 100, 2) > 0 ORDER BY score DESC, job_id LIMIT 50",
)
def q_job_match_coverage(s, d):
    jobs = _brands(s, d).groupBy("job_id").agg(F.collect_set("skill").alias("skills"))
    sem = table(s, d, "orders").filter("o_orderstatus = 'F'").select(F.col("o_orderkey").alias("job_id"), F.lit(0.5).alias("score"))
    return matching.match_by_text(jobs, F.array(*[F.lit(f"Brand#{i}") for i in (11, 22, 33, 44)]), sem, 50)


_COS = (
    "WITH v AS (SELECT vec_id AS id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS e FROM embeddings),"
    " sc AS (SELECT q.id AS query_id, v.id, round(greatest(0, least(1, list_cosine_similarity(q.e, v.e))), 4) AS score FROM v JOIN v q ON v.id <> q.id WHERE q.id % 100 = 0),"
    " top AS (SELECT * FROM (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS INTEGER) AS rank FROM sc) WHERE rank <= {k})"
)


def _vectors(s, d):
    return table(s, d, "embeddings").select(F.col("vec_id").alias("id"), "embedding")


def _near(s, d, k):
    v = _vectors(s, d)
    return matching.vector_top_k(v, v.filter("id % 100 = 0").select(F.col("id").alias("query_id"), "embedding"), k)


@_add("q_cosine_topk", _COS.format(k=10) + " SELECT query_id, rank, id, score FROM top")
def q_cosine_topk(s, d):
    return _near(s, d, 10)


@_add(
    "q_hybrid_rerank",
    _COS.format(k=100) + ", b AS (SELECT DISTINCT l_orderkey AS id, p_brand AS skill FROM lineitem JOIN part ON l_partkey = p_partkey),"
    " k AS (SELECT query_id, t.id, any_value(t.score) AS sem, count(b.skill) AS n, count(CASE WHEN b.skill IN ('Brand#11', 'Brand#22', 'Brand#33') THEN 1 END) AS hit FROM top t LEFT JOIN b ON b.id = t.id GROUP BY query_id, t.id),"
    " r AS (SELECT query_id, id, round(0.6 * sem + 0.4 * (least(1.0, CAST(n AS DOUBLE) / 5) * least(1.0, CAST(hit AS DOUBLE) / 3)), 4) AS score FROM k)"
    " SELECT * FROM (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS INTEGER) AS rank FROM r) WHERE rank <= 20",
)
def q_hybrid_rerank(s, d):
    near = stored(_near(s, d, 100).select("query_id", "id", F.col("score").alias("sem")), "near")
    lines = table(s, d, "lineitem").select(F.col("l_orderkey").alias("id"), "l_partkey").join(near.select("id").distinct(), "id", "left_semi")
    part = table(s, d, "part").select(F.col("p_partkey").alias("l_partkey"), F.col("p_brand").alias("skill"))
    skills = lines.join(part, "l_partkey").groupBy("id").agg(F.collect_set("skill").alias("skills"))
    rows = near.join(skills, "id", "left").withColumn("skills", F.coalesce("skills", F.array().cast("array<string>")))
    return matching.hybrid_rank(rows, F.array(*[F.lit(f"Brand#{i}") for i in (11, 22, 33)]), 20)


_WORDS = ("brass", "small", "7", "2")


@_add(
    "q_keyword_bonus",
    "SELECT p_partkey, CAST(round(least(0.08, 0.04 * (" + " + ".join(f"(CASE WHEN contains(lower(p_type), '{w}') OR contains(lower(p_name), '{w}') THEN 1 ELSE 0 END)" for w in _WORDS) + "))"
    " + CASE WHEN " + " OR ".join(f"contains(lower(p_brand), '{w}')" for w in _WORDS) + " THEN 0.02 ELSE 0 END, 4) AS DOUBLE) AS bonus FROM part",
)
def q_keyword_bonus(s, d):
    c = F.col
    return table(s, d, "part").select("p_partkey", F.round(matching.keyword_bonus(c("p_type"), c("p_name"), c("p_brand"), list(_WORDS)), 4).alias("bonus"))


@_add("q_content_dedup", "SELECT md5(text) AS content_hash, min(doc_id) AS doc_id FROM documents GROUP BY 1")
def q_content_dedup(s, d):
    return matching.first_by_content(table(s, d, "documents").select("doc_id", "text"), F.col("text"), "doc_id").select("content_hash", "doc_id")


@_add(
    "q_job_texts",
    "SELECT p_partkey, md5(coalesce(p_name, '') || '::' || coalesce(p_brand, '') || '::' || lower(p_type)) AS job_hash, concat_ws('. ', 'Title: ' || p_name, 'Role: ' || p_type, 'Company: ' || p_brand, 'Skills: ' || p_type) AS job_text FROM part",
)
def q_job_texts(s, d):
    c = F.col
    return table(s, d, "part").select(
        "p_partkey",
        F.md5(matching.job_content(c("p_name"), c("p_brand"), F.array("p_type")).cast("binary")).alias("job_hash"),
        matching.job_text(c("p_name"), c("p_type"), c("p_brand"), F.lit(None).cast("string"), F.array("p_type")).alias("job_text"),
    )


# Text

_TERMS = [("the", "THE"), ("and", "AND"), ("der", "Und"), ("of the", "OF_THE"), ("que", "QUE"), ("de la de la de", "LA"), ("pour", "Pour la")]
_GRAMS = [(t.lower().replace("_", " "), c) for a, c in _TERMS for t in (a, c)]


@_add(
    "q_skill_extract_text",
    "WITH w AS (SELECT doc_id, list_filter(list_transform(regexp_split_to_array(lower(coalesce(text, '')), '[^\\p{L}\\p{N}+#.]+'), lambda x: regexp_replace(x, '^\\.+|\\.+$', '', 'g')), lambda x: x <> '') AS w FROM documents),"
    " g AS (SELECT doc_id, unnest(w) AS gram FROM w UNION SELECT doc_id, unnest(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) FROM w"
    " UNION SELECT doc_id, unnest(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))) FROM w)"
    f" SELECT DISTINCT doc_id, canonical FROM g JOIN (VALUES {', '.join(map(str, _GRAMS))}) t(gram, canonical) USING (gram)",
)
def q_skill_extract_text(s, d):
    return text.extract_terms(table(s, d, "documents").select("doc_id", "text"), s.createDataFrame(_TERMS, "alias string, canonical string"))


@_add(
    "q_alias_resolution",
    "SELECT word, n, coalesce(canonical, trim(word)) AS canonical, canonical IS NOT NULL AS known FROM (SELECT word, count(*) AS n FROM (SELECT unnest(regexp_split_to_array(p_type, ' ')) AS word FROM part) GROUP BY word)"
    " LEFT JOIN (VALUES ('brass', 'Brass alloy'), ('small', 'Small size')) t(alias, canonical) ON lower(trim(word)) = alias",
)
def q_alias_resolution(s, d):
    words = table(s, d, "part").select(F.explode(F.split("p_type", " ")).alias("skill")).groupBy("skill").agg(F.count(F.lit(1)).alias("n"))
    onto = s.createDataFrame([("brass", "Brass alloy"), ("small", "Small size")], "alias string, canonical string")
    return text.resolve_aliases(words, onto).withColumnRenamed("skill", "word")


#: What the documents lack, put behind each.
_TAIL_SQL = "(' www.github.com/a.b-' || doc_id || ' linkedin.com/in/x_y. https://w.example/?q=' || source || CASE WHEN doc_id % 3 = 0 THEN ' cpa: 3.25/4.0' ELSE ' GPA 3.5/4.0' END)"


@_add(
    "q_regex_fields",
    f"SELECT doc_id, nullif(regexp_extract(t, '{text.EMAIL}', 0), '') AS email, coalesce({', '.join(f'''nullif(regexp_extract(t, '{p}', 0), '')''' for p in text.PHONES)}) AS phone,"
    f" {', '.join(f'''CASE WHEN starts_with(regexp_extract(t, '{p}', 0), 'http') THEN regexp_extract(t, '{p}', 0) ELSE 'https://' || nullif(regexp_extract(t, '{p}', 0), '') END AS {n}''' for p, n in ((text.GITHUB, 'github'), (text.LINKEDIN, 'linkedin')))},"
    f" coalesce(array_to_string(regexp_extract_all(t, '{text.URL}'), '|'), '') AS urls, nullif(regexp_extract(t, '(?i){text.GPA}', 1), '') || '/' || regexp_extract(t, '(?i){text.GPA}', 2) AS gpa"
    f" FROM (SELECT doc_id, text || {_TAIL_SQL} AS t FROM documents)",
)
def q_regex_fields(s, d):
    docs = table(s, d, "documents")
    tail = F.concat(F.lit(" www.github.com/a.b-"), F.col("doc_id").cast("string"), F.lit(" linkedin.com/in/x_y. https://w.example/?q="), F.col("source"), F.when(F.col("doc_id") % 3 == 0, " cpa: 3.25/4.0").otherwise(" GPA 3.5/4.0"))
    return docs.select("doc_id", *text.contact_fields(F.concat(F.col("text"), tail))).withColumn("urls", _join("urls"))


@_add(
    "q_split_terms",
    "SELECT doc_id, len(t) AS n_terms, coalesce(t[1], '') AS first_term FROM (SELECT doc_id, list_filter(list_transform(regexp_split_to_array(text, '[,;\n]+'), lambda x: trim(x, ' ')), lambda x: x <> '') AS t FROM documents)",
)
def q_split_terms(s, d):
    t = table(s, d, "documents").select("doc_id", text.split_terms(F.col("text")).alias("t"))
    return t.select("doc_id", F.size("t").cast("long").alias("n_terms"), F.coalesce(F.try_element_at("t", F.lit(1)), F.lit("")).alias("first_term"))


@_add("q_text_preview", "SELECT doc_id, coalesce(substring(text, 1, 100), '') AS preview, greatest(CAST(floor(length(text) / 4) AS BIGINT), 0) AS quarter FROM documents")
def q_text_preview(s, d):
    return table(s, d, "documents").select("doc_id", text.preview(F.col("text"), 100).alias("preview"), F.floor(F.length("text") / 4).cast("long").alias("quarter"))


@_add("q_trailing_number", "SELECT c_custkey, coalesce(try_cast(regexp_extract(c_name, '([0-9]+)[^0-9]*$', 1) AS BIGINT), 0) AS number FROM customer")
def q_trailing_number(s, d):
    return table(s, d, "customer").select("c_custkey", text.trailing_number(F.col("c_name")).alias("number"))


_SECTIONS = {"alpha": ["the "], "beta": ["and ", "der "], "gamma": ["que "]}


@_add(
    "q_line_sections",
    "WITH l AS (SELECT doc_id, unnest(range(0, len(ls))) AS line_no, unnest(ls) AS line FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents)),"
    " h AS (SELECT *, CASE WHEN length(line) <= 60 AND length(line) - length(replace(line, ',', '')) <= 2 AND length(line) - length(replace(line, '.', '')) <= 1 AND length(trim(line, ' ')) > 0 THEN"
    " CASE WHEN contains(lower(line), 'the ') THEN 'alpha' WHEN contains(lower(line), 'and ') OR contains(lower(line), 'der ') THEN 'beta' WHEN contains(lower(line), 'que ') THEN 'gamma' END END AS header FROM l),"
    " c AS (SELECT *, coalesce(last_value(header IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY line_no ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 'personal_info') AS section FROM h)"
    " SELECT doc_id, section, count(*) AS lines, CAST(min(line_no) AS INTEGER) AS first_line FROM c WHERE header IS NULL AND trim(line, ' ') <> '' GROUP BY 1, 2",
)
def q_line_sections(s, d):
    rows = sections.sectioned(sections.lines(table(s, d, "documents")), _SECTIONS)
    return rows.groupBy("doc_id", "section").agg(F.count(F.lit(1)).alias("lines"), F.min("line_no").alias("first_line"))


@_add(
    "q_section_spans",
    "WITH p AS (SELECT doc_id, text, instr(text, 'The') AS a, instr(text, 'and') AS b FROM documents WHERE text IS NOT NULL),"
    " h AS (SELECT doc_id, text, 1 AS start, '_pre_text' AS section, 0 AS o FROM p UNION ALL SELECT doc_id, text, a, 'alpha', 1 FROM p WHERE a > 0 UNION ALL SELECT doc_id, text, b, 'beta', 1 FROM p WHERE b > 0),"
    " n AS (SELECT *, coalesce(lead(start) OVER (PARTITION BY doc_id ORDER BY start, o, section), length(text) + 1) AS stop FROM h)"
    " SELECT doc_id, section, CAST(start AS INTEGER) AS start, CAST(length(trim(substring(text, start, stop - start), ' ')) AS INTEGER) AS n_chars FROM n",
)
def q_section_spans(s, d):
    docs = table(s, d, "documents").filter("text is not null")
    return sections.spans(docs, {"alpha": "The", "beta": "and"}).select("doc_id", "section", "start", F.length("content").alias("n_chars"))


_DOMAINS = [("english", 0, w) for w in ("the ", "with ", "that ")] + [("french", 1, w) for w in ("que ", "pour ", "dans ")] + [("german", 2, w) for w in ("der ", "und ", "nicht ")]


@_add(
    "q_domain_detect",
    "WITH h AS (SELECT doc_id, " + ", ".join("(" + " + ".join(f"CAST(contains(lower(coalesce(text, '')), '{w}') AS INTEGER)" for x, _, w in _DOMAINS if x == n) + f") AS {n}" for n in ("english", "french", "german")) + " FROM documents)"
    " SELECT doc_id, CASE WHEN greatest(english, french, german) < 2 THEN NULL WHEN english >= french AND english >= german THEN 'english' WHEN french >= german THEN 'french' ELSE 'german' END AS domain, greatest(english, french, german) AS hits FROM h",
)
def q_domain_detect(s, d):
    return text.detect_domain(table(s, d, "documents"), s.createDataFrame(_DOMAINS, "domain string, ordinal int, keyword string"))


@_add(
    "q_number_drift",
    "WITH t AS (SELECT doc_id, coalesce(text, '') || ' ' || (doc_id % 7) || ',5% ' || (doc_id % 5) || '.2%' AS text FROM documents),"
    " said AS (SELECT doc_id, unnest(list_transform(regexp_extract_all(text, '([0-9]+[.,]?[0-9]*)\\s*%', 1), lambda x: try_cast(replace(x, ',', '.') AS DOUBLE))) AS said FROM t)"
    " SELECT doc_id, count(*) AS numbers, count(CASE WHEN NOT (abs(doc_id % 5 - said) < 0.5) THEN 1 END) AS drifted FROM said GROUP BY 1",
)
def q_number_drift(s, d):
    docs = table(s, d, "documents")
    tail = F.concat(F.coalesce("text", F.lit("")), F.lit(" "), (F.col("doc_id") % 7).cast("string"), F.lit(",5% "), (F.col("doc_id") % 5).cast("string"), F.lit(".2%"))
    return evaluate.number_drift(docs.select("doc_id", tail.alias("text")), docs.select("doc_id", (F.col("doc_id") % 5).cast("double").alias("value")))


# Roadmap

_PH = _BASE + f", {_WEAK}, pos AS (SELECT candidate, skill, row_number() OVER (PARTITION BY candidate ORDER BY frequency_pct DESC, skill) AS pos, count(*) OVER (PARTITION BY candidate) AS n FROM weak), sz AS (SELECT *, CAST(greatest(2, ceil(n / ceil(n / 5.0))) AS BIGINT) AS s FROM pos), ph AS (SELECT candidate, skill, CAST(CASE WHEN ceil(n / CAST(s AS DOUBLE)) > 1 AND n - (ceil(n / CAST(s AS DOUBLE)) - 1) * s < 2 AND (pos - 1) // s + 1 = ceil(n / CAST(s AS DOUBLE)) THEN (pos - 1) // s ELSE (pos - 1) // s + 1 END AS INTEGER) AS phase FROM sz)"


def _phases(s, d):
    pos = F.row_number().over(W.partitionBy("candidate").orderBy(F.desc("frequency_pct"), "skill"))
    return roadmap.chunk_phases(_weak(s, d).select("candidate", "skill", pos.alias("pos"))).select("candidate", "skill", "phase")


@_add("q_phases", _PH + " SELECT candidate, skill, phase FROM ph")
def q_phases(s, d):
    return _phases(s, d)


@_add(
    "q_phase_projection",
    _PH + ", wt AS (SELECT skill, sum(count) AS weight FROM matrix GROUP BY skill), tot AS (SELECT sum(weight) AS total FROM wt),"
    " ev AS (SELECT candidate, 0 AS phase, sum(weight) AS w FROM owned JOIN wt USING (skill) GROUP BY 1 UNION ALL SELECT candidate, phase, sum(weight) FROM ph JOIN wt USING (skill) GROUP BY 1, 2),"
    " st AS (SELECT DISTINCT candidate, phase FROM ph UNION SELECT DISTINCT candidate, 0 FROM ph),"
    " run AS (SELECT st.candidate, st.phase, CAST(round_even(sum(coalesce(w, 0)) OVER (PARTITION BY st.candidate ORDER BY st.phase) / total * 100, 0) AS BIGINT) AS score FROM st LEFT JOIN ev ON ev.candidate = st.candidate AND ev.phase = st.phase, tot)"
    " SELECT candidate, phase, score, score - coalesce(lag(score) OVER (PARTITION BY candidate ORDER BY phase), score) AS delta FROM run",
)
def q_phase_projection(s, d):
    weights = _matrix(s, d).groupBy("skill").agg(F.sum("count").cast("double").alias("weight"))
    return roadmap.projection(_owned(s, d), _phases(s, d), weights)


@_add(
    "q_stage_detect",
    "WITH x AS (SELECT c_custkey AS candidate, CAST(nullif(c_custkey % 6, 5) AS DOUBLE) AS years, c_custkey % 7 AS advanced FROM customer), b AS (SELECT *, CASE WHEN years IS NULL OR years <= 0 THEN 0 WHEN years <= 1 THEN 1 WHEN years <= 3 THEN 2 ELSE 3 END + CASE WHEN advanced >= 5 THEN 2 WHEN advanced >= 3 THEN 1 ELSE 0 END AS k FROM x)"
    " SELECT candidate, ['Student', 'Fresher', 'Junior', 'Middle'][least(3, k) + 1] AS stage, round(0.7 - CASE WHEN years IS NULL THEN 0.2 ELSE 0 END + CASE WHEN advanced > 0 THEN 0.1 ELSE 0 END, 2) AS confidence FROM b",
)
def q_stage_detect(s, d):
    return table(s, d, "customer").select(F.col("c_custkey").alias("candidate"), *roadmap.career_stage(F.nullif(F.col("c_custkey") % 6, F.lit(5)).cast("double"), F.col("c_custkey") % 7))


_TITLES = ", ".join(f"'{t}'" for t in roadmap.TITLES)


@_add(
    "q_phase_narrative",
    _PH + f" SELECT candidate, phase, coalesce([{_TITLES}][phase], 'Phase ' || phase) AS title, string_agg(skill, '|' ORDER BY skill) AS skills, CAST(count(*) AS INTEGER) AS skill_count, round(avg(CAST(regexp_extract(skill, '[0-9]+$') AS INTEGER) % 5), 2) AS avg_depth,"
    " CASE WHEN avg(CAST(regexp_extract(skill, '[0-9]+$') AS INTEGER) % 5) < 1 THEN 'Kiến thức nền tảng, ' || count(*) || ' kỹ năng cơ bản' WHEN avg(CAST(regexp_extract(skill, '[0-9]+$') AS INTEGER) % 5) < 2 THEN 'Kỹ năng cốt lõi, xây dựng nền tảng vững chắc'"
    " WHEN avg(CAST(regexp_extract(skill, '[0-9]+$') AS INTEGER) % 5) < 3 THEN 'Phát triển chuyên sâu, áp dụng vào dự án thực tế' ELSE 'Kỹ năng nâng cao, tối ưu và mở rộng hệ thống' END AS reason FROM ph GROUP BY 1, 2",
)
def q_phase_narrative(s, d):
    depths = table(s, d, "part").select(F.col("p_brand").alias("skill")).distinct().withColumn("depth", F.regexp_extract("skill", "[0-9]+$", 0).cast("int") % 5)
    return roadmap.phase_summary(_phases(s, d), depths).withColumn("skills", _join("skills"))


# Profiles and insights


@_add(
    "q_head_names",
    "WITH l AS (SELECT doc_id, unnest(range(0, len(ls))) AS n, unnest(ls) AS line FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents))"
    " SELECT doc_id, arg_min(trim(line, ' '), n) AS name FROM l WHERE length(trim(line, ' ')) >= 3 AND NOT regexp_matches(line, '[@+|§—]') AND NOT contains(lower(line), 'the ') GROUP BY 1",
)
def q_head_names(s, d):
    return profile.head_name(sections.lines(table(s, d, "documents")), ["the "])


_YEARS = "coalesce(try_cast(nullif(regexp_extract(ex, '([0-9]+\\.?[0-9]*)\\s*(?:năm|year)', 1), '') AS DOUBLE), 0) AS years"


@_add(
    "q_career_profile",
    "WITH l AS (SELECT doc_id, lang, source, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents), x AS (SELECT doc_id, trim(ls[1], ' ') AS name, lower(coalesce(ls[1], '') || ' ' || coalesce(ls[2], '')) AS edu, ls[3:] AS exp, lower(array_to_string(ls[3:], ' ')) AS ex,"
    " list_distinct(list_filter(list_transform(list_concat(regexp_split_to_array(regexp_replace(coalesce(ls[1], ''), '(?s)^[^:]*:', ''), '[;,]'), [lang, source, 'SQL']), lambda x: trim(x, ' ')), lambda x: x <> '')) AS sk FROM l),"
    f" y AS (SELECT *, regexp_matches(edu, 'present|hiện tại|nay|university|học viện|trường|viện') AS st, {_YEARS},"
    " list_filter([CASE WHEN len(list_filter(sk, lambda x: contains(lower(x), 'ation'))) > 0 THEN 'a' END, CASE WHEN len(list_filter(sk, lambda x: contains(lower(x), 'und') OR contains(lower(x), 'que'))) > 0 THEN 'b' END], lambda x: x IS NOT NULL) AS dom FROM x)"
    " SELECT doc_id, CASE WHEN st AND years > 0 THEN 'Intern/Junior' WHEN st THEN 'Student' ELSE 'Entry' END AS stage, years, coalesce(substring(nullif(trim(exp[1], ' '), ''), 1, 100), 'Unknown') AS role, array_to_string(list_sort(sk), '|') AS technology_stack, array_to_string(dom, '|') AS domains,"
    " CASE WHEN len(dom) > 0 THEN coalesce(nullif(name, '') || ' - Ứng viên tiềm năng | Lĩnh vực: ' || array_to_string(dom, ', '), 'Lĩnh vực chuyên môn: ' || array_to_string(dom, ', ')) ELSE coalesce(nullif(name, '') || ' - Ứng viên tiềm năng', '') END AS summary FROM y",
)
def q_career_profile(s, d):
    lines = F.split(F.coalesce("text", F.lit("")), "\n")
    skills = F.array(F.get(lines, 0), F.concat(F.lit("Tools: "), "lang", F.lit("; "), "source", F.lit(" , SQL")))
    cvs = table(s, d, "documents").select("doc_id", F.slice(lines, 1, 1).alias("personal_info"), F.slice(lines, 1, 2).alias("education"), F.slice(lines, 3, 1_000_000).alias("experience"), skills.alias("skills"))
    out = profile.career_profile(cvs, {"a": ["ation"], "b": ["und", "que"]}).drop("skills")
    return out.withColumn("domains", _join("domains")).withColumn("technology_stack", _join("technology_stack"))


@_add(
    "q_job_profiles",
    "SELECT 'PART_' || lpad(CAST(row_number() OVER (ORDER BY p_partkey) AS VARCHAR), CAST(greatest(4, length(CAST(count(*) OVER () AS VARCHAR))) AS INTEGER), '0') AS job_id, p_name AS title_original, p_brand AS company, p_type AS skills, 1 AS skill_count FROM part",
)
def q_job_profiles(s, d):
    parts = table(s, d, "part")
    rec = tables.unified(parts, "PART", "part", "job", "p_partkey", title=F.col("p_name"), skills_raw=F.array("p_type"), company=F.col("p_brand"))
    out = profile.job_profiles(rec.withColumn("skills_extracted", F.col("skills_raw")), F.col("title"))
    return out.select("job_id", "title_original", "company", _join("skills").alias("skills"), "skill_count")


@_add("q_token_estimate", "SELECT doc_id, CAST(greatest(floor(len(list_filter(regexp_split_to_array(trim(text, ' '), '\\s+'), lambda x: x <> '')) * 1.3), floor(length(text) / 4)) AS BIGINT) AS tokens FROM documents")
def q_token_estimate(s, d):
    return table(s, d, "documents").select("doc_id", text.token_estimate(F.col("text")).alias("tokens"))


# The other catalogues register their queries beside these.
from skillweave.plans import graph_catalogue, rules_catalogue  # noqa: E402, F401
