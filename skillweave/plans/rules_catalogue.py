"""Queries of roles, career paths, texts by rule, documents and near names over the given tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from skillweave.functions import documents, repair, role_rules, text
from skillweave.operators import evaluate, fuzzy, gap, layout, market, profile, sections, stages, transitions
from skillweave.plans import fixtures as fx
from skillweave.plans.base import BASE, CORE, CRITICAL, IMPORTANT, add, brands, joined, matrix, owned, targets
from skillweave.plans.graph_catalogue import _N, _own
from skillweave.session import table

# Roles and ways between them. Roles are segments in the first query and nations in the second.


def _found(sets: str, tops: str, source: str, weight: float) -> str:
    """CTEs sets, sizes, tops and found (f, t, weight): transitions between the roles of a matrix."""
    return (
        f"sets AS (SELECT role, skill FROM {source} WHERE frequency_pct >= {sets}), sizes AS (SELECT role, count(*) AS n FROM sets GROUP BY role), tops AS (SELECT role, skill FROM {source} WHERE frequency_pct >= {tops}),"
        " ov AS (SELECT a.role AS a, b.role AS b, count(*) AS shared FROM sets a JOIN sets b ON a.skill = b.skill AND a.role < b.role GROUP BY 1, 2),"
        " found AS (SELECT CASE WHEN x.n > y.n THEN b ELSE a END AS f, CASE WHEN x.n > y.n THEN a ELSE b END AS t, round(CAST(shared AS DOUBLE) / (x.n + y.n - shared), 4) AS weight"
        f" FROM ov JOIN sizes x ON x.role = a JOIN sizes y ON y.role = b WHERE CAST(shared AS DOUBLE) / (x.n + y.n - shared) >= {weight}), groles AS (SELECT f AS role FROM found UNION SELECT t FROM found)"
    )


#: The closest role of each candidate of mine (candidate, skill) among groles.
_CLOSEST = (
    ", held AS (SELECT candidate, count(*) AS n FROM mine GROUP BY 1), sc AS (SELECT o.candidate, s.role, round(CAST(count(*) AS DOUBLE) / (any_value(held.n) + any_value(sizes.n) - count(*)), 4) AS similarity"
    " FROM mine o JOIN sets s USING (skill) JOIN groles USING (role) JOIN held ON held.candidate = o.candidate JOIN sizes ON sizes.role = s.role GROUP BY 1, 2),"
    " best AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY candidate ORDER BY similarity DESC, role) AS rn FROM sc) WHERE rn = 1),"
    " words AS (SELECT role, unnest(list_distinct(regexp_split_to_array(trim(lower(role), ' '), '\\s+'))) AS word FROM groles),"
    " hits AS (SELECT candidate, role, count(*) AS n FROM (SELECT DISTINCT candidate, lower(skill) AS word FROM mine) JOIN words USING (word) GROUP BY 1, 2),"
    " named AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY candidate ORDER BY n DESC, role) AS rn FROM hits) WHERE rn = 1),"
    " closest AS (SELECT h.candidate, coalesce(best.role, named.role, (SELECT min(role) FROM groles)) AS role, coalesce(similarity, 0.0) AS similarity FROM held h LEFT JOIN best USING (candidate) LEFT JOIN named USING (candidate))"
)


@add(
    "q_closest_role",
    BASE + f", {_found('14.7', '15', 'allskills', 0.25)}, mine AS (SELECT candidate, skill FROM owned WHERE candidate % 4 <> 0 UNION SELECT candidate, 'Machinery' FROM owned WHERE candidate % 3 = 0 UNION SELECT candidate, 'nothing' FROM owned WHERE candidate % 4 = 0)"
    + _CLOSEST + " SELECT candidate, role, similarity FROM closest WHERE role IS NOT NULL",
)
def q_closest_role(s, d):
    # Every fourth candidate keeps no brand, every third also owns a skill named like a role.
    own = owned(s, d)
    key = F.col("candidate")
    named = own.select("candidate").distinct().select("candidate", F.explode(F.array(F.when(key % 3 == 0, F.lit("Machinery")), F.when(key % 4 == 0, F.lit("nothing")))).alias("skill")).filter("skill IS NOT NULL")
    m = matrix(s, d)
    roles = transitions.graph_roles(transitions.transitions(m, 14.7, 15.0, 0.25))
    return transitions.closest_role(own.filter("candidate % 4 <> 0").unionByName(named), m, 14.7, roles)


_NATIONS = (
    BASE.replace("WITH jobs", "WITH RECURSIVE jobs")
    + ", njobs AS (SELECT job_id, n_name AS role FROM jobs JOIN customer ON c_custkey = candidate JOIN nation ON n_nationkey = c_nationkey), ntotals AS (SELECT role, count(*) AS total FROM njobs GROUP BY role),"
    " nall AS (SELECT role, skill, round(100.0 * count(*) / any_value(total), 2) AS frequency_pct FROM njobs JOIN brands USING (job_id) JOIN ntotals USING (role) GROUP BY role, skill),"
    " ntargets AS (SELECT c_custkey AS candidate, CASE WHEN c_custkey % 11 = 0 THEN 'Nowhere' WHEN c_custkey % 2 = 0 THEN lower(n_name) ELSE n_name END AS role FROM customer JOIN nation ON n_nationkey = (c_nationkey + c_custkey) % 25)"
)


def _nations(s, d):
    customer, nation = table(s, d, "customer"), table(s, d, "nation")
    where = customer.join(F.broadcast(nation), customer.c_nationkey == nation.n_nationkey).select("c_custkey", F.col("n_name").alias("role"))
    jobs = table(s, d, "orders").join(where, F.col("o_custkey") == F.col("c_custkey")).select(F.col("o_orderkey").alias("job_id"), "role")
    return market.role_skill_matrix(jobs, jobs.join(brands(s, d), "job_id").select("job_id", "role", "skill"), 12.0)


@add(
    "q_career_roadmap",
    _NATIONS + f", {_found('16.5', '17', 'nall', 0.45)}, mine AS (SELECT * FROM owned)" + _CLOSEST
    + ", asked AS (SELECT t.candidate, coalesce(c.role, (SELECT min(role) FROM groles)) AS start, t.role AS target, g.role AS goal FROM ntargets t LEFT JOIN closest c USING (candidate) LEFT JOIN groles g ON lower(g.role) = lower(trim(t.role, ' '))),"
    " links AS (SELECT f AS x, t AS y FROM found UNION SELECT t, f FROM found), pairs AS (SELECT DISTINCT start, goal FROM asked WHERE goal IS NOT NULL),"
    " spread(goal, node, depth) AS (SELECT DISTINCT goal, goal, 0 FROM pairs UNION SELECT s.goal, l.y, s.depth + 1 FROM spread s JOIN links l ON l.x = s.node WHERE s.depth < 25), near AS (SELECT goal, node, min(depth) AS depth FROM spread GROUP BY 1, 2),"
    " hop AS (SELECT a.goal, a.node, min(l.y) AS next FROM near a JOIN links l ON l.x = a.node JOIN near b ON b.goal = a.goal AND b.node = l.y AND b.depth = a.depth - 1 GROUP BY 1, 2),"
    " walk(start, goal, node, pos) AS (SELECT p.start, p.goal, p.start, 0 FROM pairs p JOIN near n ON n.goal = p.goal AND n.node = p.start UNION ALL SELECT w.start, w.goal, h.next, w.pos + 1 FROM walk w JOIN hop h ON h.goal = w.goal AND h.node = w.node),"
    " ways AS (SELECT start, goal, string_agg(node, '|' ORDER BY pos) AS path, count(*) - 1 AS n_steps FROM walk GROUP BY 1, 2),"
    " arc AS (SELECT f, t, weight, 0 AS back FROM found UNION ALL SELECT t, f, weight, 1 FROM found), arcs AS (SELECT f, t, arg_min(back, (-weight, back)) AS back FROM arc GROUP BY 1, 2),"
    " learn AS (SELECT a.f, a.t, x.skill FROM arcs a JOIN tops x ON x.role = a.t WHERE back = 0 AND NOT EXISTS (SELECT 1 FROM tops y WHERE y.role = a.f AND y.skill = x.skill)"
    " UNION SELECT a.f, a.t, x.skill FROM arcs a JOIN sets x ON x.role = a.f JOIN sets y ON y.role = a.t AND y.skill = x.skill WHERE back = 1),"
    " hops AS (SELECT a.start, a.goal, a.pos, a.node AS f, b.node AS t FROM walk a JOIN walk b ON b.start = a.start AND b.goal = a.goal AND b.pos = a.pos + 1),"
    " told AS (SELECT h.start, h.goal, string_agg(h.f || '>' || h.t || ':' || coalesce((SELECT string_agg(skill, ',' ORDER BY skill) FROM learn l WHERE l.f = h.f AND l.t = h.t), ''), ';' ORDER BY pos) AS steps FROM hops h GROUP BY 1, 2),"
    " total AS (SELECT start, goal, string_agg(skill, '|' ORDER BY skill) AS total_new_skills FROM (SELECT DISTINCT h.start, h.goal, l.skill FROM hops h JOIN learn l ON l.f = h.f AND l.t = h.t) GROUP BY 1, 2)"
    " SELECT candidate, start AS start_role, target AS target_role, coalesce(path, '') AS path, CAST(coalesce(n_steps, 0) AS INTEGER) AS n_steps, coalesce(steps, '') AS steps, coalesce(total_new_skills, '') AS total_new_skills"
    " FROM asked LEFT JOIN ways USING (start, goal) LEFT JOIN told USING (start, goal) LEFT JOIN total USING (start, goal)",
)
def q_career_roadmap(s, d):
    m = _nations(s, d)
    customer, nation = table(s, d, "customer"), table(s, d, "nation")
    key = F.col("c_custkey")
    wanted = customer.join(F.broadcast(nation), F.col("n_nationkey") == (F.col("c_nationkey") + key) % 25)
    to = wanted.select(key.alias("candidate"), F.when(key % 11 == 0, "Nowhere").when(key % 2 == 0, F.lower("n_name")).otherwise(F.col("n_name")).alias("role"))
    out = transitions.career_roadmaps(owned(s, d), to, transitions.transitions(m, 16.5, 17.0, 0.45), m, 16.5)
    steps = F.transform("steps", lambda x: F.concat(x["from"], F.lit(">"), x["to"], F.lit(":"), F.array_join(F.array_sort(x["skills_to_learn"]), ",")))
    return out.select("candidate", "start_role", "target_role", joined("path").alias("path"), F.size("steps").alias("n_steps"), F.array_join(steps, ";").alias("steps"), joined("total_new_skills").alias("total_new_skills"))


_PREFIXES = ("Senior ", "mid-level  ", "", "Lead ", "Head of ")
_TITLES = [line.split(" = ")[0] for line in role_rules.MARKET_ROLES.strip().splitlines()]


def _map_sql(name: str, lines: str) -> str:
    quote = lambda x: "'" + x.replace("'", "''") + "'"
    return f"{name}(title, role) AS (VALUES {', '.join('(' + ', '.join(quote(x) for x in line.split(' = ', 1)) + ')' for line in lines.strip().splitlines())})"


def _strip_sql(column: str, patterns) -> str:
    for p in patterns:
        column = f"regexp_replace({column}, '{p}', '', 'gi')"
    return f"regexp_replace({column}, '\\s+', ' ', 'g')"


def _titled_sql(column: str) -> str:
    return f"list_aggregate(list_transform(regexp_extract_all({column}, '[a-z]+|[^a-z]+'), lambda x: upper(x[1]) || substring(x, 2)), 'string_agg', '')"


_ENGLISH = [p for p in role_rules.MARKET_STRIP if p.isascii()], [p for p in role_rules.PROFILE_STRIP if p.isascii()]


@add(
    "q_role_normalize",
    f"WITH {_map_sql('market', role_rules.MARKET_ROLES)}, {_map_sql('prof', role_rules.PROFILE_ROLES)}, titles AS (SELECT p_partkey, [{', '.join(repr(x) for x in _PREFIXES)}][p_partkey % 5 + 1] || CASE WHEN p_partkey % 3 = 0 THEN p_name || ' lead' ELSE [{', '.join(repr(x) for x in _TITLES)}][p_partkey % 64 + 1] END AS title FROM part),"
    " x AS (SELECT *, trim(regexp_replace(lower(title), '\\s+', ' ', 'g'), ' ') AS whole FROM titles),"
    f" y AS (SELECT *, trim(trim({_strip_sql('whole', _ENGLISH[0])}, ' '), '-,/ ') AS bare_m, trim(trim({_strip_sql('whole', _ENGLISH[1])}, ' '), '-, ') AS bare_p FROM x)"
    f" SELECT p_partkey, y.title, coalesce(a.role, b.role, CASE WHEN bare_m <> '' THEN {_titled_sql('bare_m')} ELSE 'Unknown' END) AS market_role, coalesce(c.role, e.role, CASE WHEN bare_p <> '' THEN {_titled_sql('bare_p')} ELSE {_titled_sql('whole')} END) AS profile_role"
    " FROM y LEFT JOIN market a ON a.title = whole LEFT JOIN market b ON b.title = bare_m LEFT JOIN prof c ON c.title = whole LEFT JOIN prof e ON e.title = bare_p",
)
def q_role_normalize(s, d):
    key = F.col("p_partkey")
    at = lambda names, i: F.element_at(F.array(*[F.lit(x) for x in names]), (i + 1).cast("int"))
    titles = table(s, d, "part").select("p_partkey", F.concat(at(_PREFIXES, key % 5), F.when(key % 3 == 0, F.concat("p_name", F.lit(" lead"))).otherwise(at(_TITLES, key % 64))).alias("title"))
    both = role_rules.market_roles(titles).withColumnRenamed("role", "market_role")
    return role_rules.profile_roles(both).withColumnRenamed("role", "profile_role")


# Stages by rule tables

_ADVANCED = ("llm", "rag", "docker", "mlops", "ml")
_KEYWORDS = [(0, "Student", "machin"), (2, "Junior", "build"), (3, "Middle", "auto"), (3, "Middle", "household")]
_SIGNALS = [(1, "Student", "7"), (2, "Fresher", "3")]


@add(
    "q_stage_rules",
    _N + ", mo AS (SELECT o_custkey AS candidate, sum(o_orderkey % 7) AS months FROM orders WHERE o_orderpriority = '1-URGENT' GROUP BY 1), sk AS (SELECT candidate, count(*) AS n, count(CASE WHEN skill IN ('llm', 'rag', 'docker', 'mlops', 'ml') THEN 1 END) AS adv FROM own GROUP BY 1),"
    " x AS (SELECT c_custkey AS candidate, lower(c_mktsegment) AS t, c_name, coalesce(n, 0) AS n, coalesce(adv, 0) AS adv, CASE WHEN months IS NULL THEN CASE WHEN c_custkey % 2 = 0 THEN CAST(c_custkey % 5 AS DOUBLE) END WHEN months > 0 THEN months / 12.0 END AS years FROM customer LEFT JOIN mo ON mo.candidate = c_custkey LEFT JOIN sk ON sk.candidate = c_custkey),"
    " y AS (SELECT *, ['Student', 'Fresher', 'Junior', 'Middle'][least(3, CASE WHEN years IS NULL OR years <= 0 THEN 0 WHEN years <= 1 THEN 1 WHEN years <= 3 THEN 2 ELSE 3 END + CASE WHEN adv >= 5 THEN 2 WHEN adv >= 3 THEN 1 ELSE 0 END) + 1] AS stage,"
    " CASE WHEN contains(t, 'machin') THEN 'Student' WHEN contains(t, 'build') THEN 'Junior' WHEN contains(t, 'auto') OR contains(t, 'household') THEN 'Middle' END AS title_stage, CASE WHEN contains(c_name, '7') THEN 'Student' WHEN contains(c_name, '3') THEN 'Fresher' END AS education_stage FROM x)"
    " SELECT candidate, stage, round(0.7 + CASE WHEN title_stage = stage THEN 0.1 ELSE 0 END - CASE WHEN years IS NULL THEN 0.2 ELSE 0 END + CASE WHEN adv > 0 THEN 0.1 ELSE 0 END, 2) AS confidence, round(years, 4) AS years, CAST(n AS INTEGER) AS skill_count, CAST(adv AS INTEGER) AS advanced, title_stage, education_stage FROM y",
)
def q_stage_rules(s, d):
    make = lambda rows, schema: s.createDataFrame(rows, schema)
    limits = make([(0, "Student", 0.0), (1, "Fresher", 1.0), (2, "Junior", 3.0), (3, "Middle", 6.0)], "ordinal int, stage string, max_years double")
    word = "ordinal int, stage string, keyword string"
    rules = stages.StageRules(limits, make([(x,) for x in _ADVANCED], "skill string"), make(_KEYWORDS, word), make(_SIGNALS, word))
    history = table(s, d, "orders").filter("o_orderpriority = '1-URGENT'").groupBy(F.col("o_custkey").alias("candidate")).agg(F.collect_list(F.struct((F.col("o_orderkey") % 7).cast("int").alias("duration_months"))).alias("work_history"))
    skills = _own(s, d).groupBy("candidate").agg(F.collect_list("skill").alias("skills"))
    key = F.col("c_custkey")
    cvs = table(s, d, "customer").select(key.alias("candidate"), F.when(key % 2 == 0, (key % 5).cast("double")).alias("experience_years"), F.array("c_mktsegment").alias("job_titles"), F.col("c_name").alias("education"))
    found = stages.detected_stages(cvs.join(history, "candidate", "left").join(skills, "candidate", "left"), rules)
    return found.drop("reason").withColumn("years", F.round("years", 4))


# Texts

_LINES = "l AS (SELECT doc_id, unnest(range(0, len(ls))) AS line_no, unnest(ls) AS raw FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents))"


def _header_sql(x: str) -> str:
    return f"(upper({x}) IN ({', '.join(repr(h) for h in layout.HEADERS)}) OR (length({x}) > 2 AND length(regexp_replace({x}, '[^\\p{{Lu}}]', '', 'g')) > 0.7 * length({x})))"


_PLAIN = lambda x: f"({x} <> '' AND NOT {_header_sql(x)} AND NOT regexp_matches({x}, '{layout.BULLET}'))"


@add(
    "q_merged_lines",
    f"WITH RECURSIVE {_LINES}, t AS (SELECT doc_id, line_no, regexp_replace(raw, '^\\s+|\\s+$', '', 'g') AS line FROM l), n AS (SELECT *, lead(line) OVER (PARTITION BY doc_id ORDER BY line_no) AS below FROM t),"
    f" j AS (SELECT *, coalesce({_PLAIN('line')} AND {_PLAIN('below')} AND (regexp_matches(lower(line), '(?:,|-|and|or|&|;)$') OR NOT regexp_matches(line, '[.!?);]$')"
    f" OR (len(regexp_split_to_array(below, '\\s+')) < 3 AND (NOT regexp_matches(line, '{layout.DATE}') OR NOT regexp_matches(line, '[.!?;:]$')))), false) AS joins FROM n),"
    " w(doc_id, line_no) AS (SELECT DISTINCT doc_id, 0::BIGINT FROM j UNION ALL SELECT w.doc_id, w.line_no + CASE WHEN j.joins THEN 2 ELSE 1 END FROM w JOIN j ON j.doc_id = w.doc_id AND j.line_no = w.line_no)"
    " SELECT j.doc_id, CAST(j.line_no AS INTEGER) AS line_no, md5(CASE WHEN joins THEN line || ' ' || below ELSE line END) AS line_md5 FROM w JOIN j ON j.doc_id = w.doc_id AND j.line_no = w.line_no WHERE line <> ''",
)
def q_merged_lines(s, d):
    return layout.merged_lines(sections.lines(table(s, d, "documents"))).select("doc_id", "line_no", F.md5(F.encode("line", "utf-8")).alias("line_md5"))


@add(
    "q_project_blocks",
    f"WITH {_LINES}, b AS (SELECT doc_id, line_no, CASE WHEN line_no % 4 = 1 THEN '• ' || raw ELSE raw END AS raw FROM l), p AS (SELECT *, sum(CASE WHEN regexp_matches(raw, '{layout.PROJECT}') THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY line_no ROWS UNBOUNDED PRECEDING) AS project FROM b)"
    " SELECT doc_id, CAST(project AS BIGINT) AS project, CAST(count(*) AS INTEGER) AS n_blocks, md5(string_agg(raw, chr(10) ORDER BY line_no)) AS body FROM p WHERE project > 0 AND regexp_replace(raw, '^\\s+|\\s+$', '', 'g') <> '' GROUP BY 1, 2",
)
def q_project_blocks(s, d):
    lines = sections.lines(table(s, d, "documents")).withColumn("line", F.when(F.col("line_no") % 4 == 1, F.concat(F.lit("• "), "line")).otherwise(F.col("line")))
    out = layout.project_blocks(lines)
    return out.select("doc_id", "project", F.size("blocks").alias("n_blocks"), F.md5(F.encode(F.array_join("blocks", "\n"), "utf-8")).alias("body"))


_CATEGORY = "CASE " + " ".join(f"WHEN {' OR '.join(f'contains(lower(skill), {w!r})' for w in words)} THEN {name!r}" for name, words in layout.CATEGORIES.items()) + " ELSE 'General' END"


@add(
    "q_skill_lines",
    _N + ", s0 AS (SELECT candidate, string_agg(skill, ', ' ORDER BY skill) AS line FROM own GROUP BY 1),"
    " l2 AS (SELECT candidate, 0 AS line_no, CAST(NULL AS VARCHAR) AS named, line FROM s0 UNION ALL SELECT c_custkey, 1, upper(c_mktsegment[1]) || lower(substring(c_mktsegment, 2)), c_name || '; ' || 'C++' FROM customer),"
    " e AS (SELECT candidate, line_no, named, unnest(regexp_split_to_array(line, '[;,] *')) AS skill FROM l2)"
    f" SELECT candidate, line_no, skill, coalesce(named, {_CATEGORY}) AS category FROM e",
)
def q_skill_lines(s, d):
    listed = _own(s, d).groupBy("candidate").agg(F.array_join(F.array_sort(F.collect_list("skill")), ", ").alias("line")).select("candidate", F.lit(0).alias("line_no"), "line")
    named = table(s, d, "customer").select(F.col("c_custkey").alias("candidate"), F.lit(1).alias("line_no"), F.concat("c_mktsegment", F.lit(": "), "c_name", F.lit("; C++")).alias("line"))
    return layout.categorised_skills(listed.unionByName(named), "candidate").select("candidate", "line_no", "skill", "category")


@add(
    "q_second_parser",
    "WITH c AS (SELECT c_custkey, c_name, c_mktsegment, c_custkey % 5 AS k FROM customer)"
    " SELECT c_custkey, c_name AS name, CASE WHEN k <> 1 THEN 'c' || c_custkey || '@mail.example' END AS email, CASE WHEN k <> 2 THEN 'github.com/u-' || c_custkey END AS github,"
    " CASE WHEN k <> 3 THEN c_mktsegment || ' University' END AS institution, CASE WHEN k <> 3 THEN '3.' || k || '/4.0' END AS gpa, CASE WHEN k <> 3 AND k <> 4 THEN '09/20' || (10 + k) END AS start_date,"
    " CASE WHEN k = 3 THEN NULL WHEN k = 4 THEN '01/2024' ELSE 'Present' END AS end_date, CASE WHEN k <> 3 THEN lower(c_mktsegment) END AS field FROM c",
)
def q_second_parser(s, d):
    key, text_of = F.col("c_custkey"), lambda *x: F.concat(*[F.lit(i) if isinstance(i, str) else i for i in x])
    k = key % 5
    contact = text_of("mail ", F.when(k != 1, text_of("c", key.cast("string"), "@mail.example")).otherwise("none"), " or ", F.when(k != 2, text_of("https://GitHub.com/u-", key.cast("string"))).otherwise("none"))
    personal = F.array(text_of(" ", F.col("c_name"), " "), F.lower(contact))
    school = F.when(k != 3, text_of(F.col("c_mktsegment"), " University")).otherwise("nowhere")
    dates = F.when(k == 4, "until 01/2024").otherwise(text_of("09/20", (k + 10).cast("string"), " - Present"))
    education = F.array(school, F.lit(" "), text_of("GPA: 3.", k.cast("string"), "/4.0"), dates, text_of("Major: ", F.lower("c_mktsegment")))
    rows = table(s, d, "customer").select("c_custkey", profile.personal_of(personal).alias("p"), profile.education_of(education).alias("e"))
    return rows.select("c_custkey", "p.name", "p.email", "p.github", "e.institution", "e.gpa", "e.start_date", "e.end_date", "e.field")


# Evaluation. What is said under which heading follows a candidate's number.

_TOLD = (
    ", weak AS (SELECT t.candidate, m.skill, CASE WHEN frequency_pct >= 16 THEN 'critical' WHEN frequency_pct >= 15 THEN 'medium' ELSE 'optional' END AS severity FROM targets t JOIN matrix m USING (role) WHERE NOT EXISTS (SELECT 1 FROM owned o WHERE o.candidate = t.candidate AND lower(o.skill) = lower(m.skill))),"
    " told AS (SELECT candidate, coalesce(string_agg('- ' || skill, chr(10) ORDER BY skill) FILTER ((severity = 'critical' AND candidate % 4 <> 2) OR (severity = 'medium' AND candidate % 4 = 1)), '') AS hi,"
    " coalesce(string_agg('- ' || skill, chr(10) ORDER BY skill) FILTER ((severity = 'medium' AND candidate % 4 <> 1) OR (severity = 'critical' AND candidate % 4 = 2)), '') AS lo FROM weak WHERE severity <> 'optional' GROUP BY 1),"
    " issue AS (SELECT candidate, CASE WHEN severity = 'medium' AND contains(hi, skill) AND NOT contains(lo, skill) THEN 'Medium gap ''' || skill || ''' được nhắc ở section ''Quan trọng'''"
    " WHEN severity = 'critical' AND contains(lo, skill) AND NOT contains(hi, skill) THEN 'Critical gap ''' || skill || ''' được nhắc ở section ''Trung bình''' END AS issue FROM weak JOIN told USING (candidate)),"
    " drift AS (SELECT t.candidate, count(issue) > 0 AS drifted, coalesce(string_agg(issue, '|' ORDER BY issue), '') AS issues FROM told t LEFT JOIN issue USING (candidate) GROUP BY 1)"
)


def _severity_drift(s, d):
    weak = gap.weaknesses(owned(s, d), targets(s, d), matrix(s, d), CRITICAL, CORE).select("candidate", "skill", "severity")
    turn = F.col("candidate") % 4
    high = (F.col("severity") == "critical") & (turn != 2) | (F.col("severity") == "medium") & (turn == 1)
    low = (F.col("severity") == "medium") & (turn != 1) | (F.col("severity") == "critical") & (turn == 2)
    under = lambda some: F.array_join(F.transform(F.array_sort(F.collect_list(F.when(some, F.col("skill")))), lambda x: F.concat(F.lit("- "), x)), "\n")
    told = weak.filter("severity <> 'optional'").groupBy("candidate").agg(F.concat(F.lit("# Khoảng trống quan trọng\n"), under(high), F.lit("\n# Khoảng trống trung bình\n"), under(low)).alias("text"))
    return evaluate.severity_drift(told, weak, "candidate")


@add("q_severity_drift", BASE + _TOLD + " SELECT * FROM drift")
def q_severity_drift(s, d):
    return _severity_drift(s, d).withColumn("issues", joined("issues"))


@add(
    "q_skill_drift",
    BASE + _TOLD + ", a AS (SELECT candidate, lower(skill) AS skill FROM owned), b AS (SELECT candidate, lower(skill) AS skill FROM targets JOIN matrix USING (role)),"
    " f AS (SELECT coalesce(a.candidate, b.candidate) AS candidate, a.skill AS x, b.skill AS y FROM a FULL OUTER JOIN b ON a.candidate = b.candidate AND a.skill = b.skill)"
    " SELECT f.candidate, count(CASE WHEN x IS NULL THEN 1 END) AS hallucinated, count(CASE WHEN y IS NULL THEN 1 END) AS missing, count(y) AS n_said, coalesce(any_value(drifted), false) AS severity_drift,"
    " round(greatest(0, least(1, 1 - 3 * (count(CASE WHEN x IS NULL THEN 1 END) / greatest(count(y), 1)) - 0.2 * CASE WHEN any_value(drifted) THEN 1 ELSE 0 END - 0.05 * count(CASE WHEN y IS NULL THEN 1 END))), 4) AS quality FROM f LEFT JOIN drift USING (candidate) GROUP BY 1",
)
def q_skill_drift(s, d):
    said = targets(s, d).join(matrix(s, d), "role").select("candidate", "skill")
    rows = evaluate.skill_drift(owned(s, d), said, "candidate").join(_severity_drift(s, d).select("candidate", "drifted"), "candidate", "left")
    rate = F.col("hallucinated") / F.greatest(F.col("n_said"), F.lit(1))
    drifted = F.coalesce("drifted", F.lit(False))
    return rows.select("candidate", "hallucinated", "missing", "n_said", drifted.alias("severity_drift"), evaluate.quality(rate, drifted, F.lit(0), F.col("missing")).alias("quality"))


# Documents

_WEAK = (
    ", weak AS (SELECT t.candidate, t.role, m.skill, m.frequency_pct, CASE WHEN frequency_pct >= 16 THEN 'critical' WHEN frequency_pct >= 15 THEN 'medium' ELSE 'optional' END AS severity FROM targets t JOIN matrix m USING (role) WHERE NOT EXISTS (SELECT 1 FROM owned o WHERE o.candidate = t.candidate AND o.skill = m.skill)),"
    " strong AS (SELECT t.candidate, m.skill, m.frequency_pct, CASE WHEN frequency_pct >= 15 THEN 'Core' WHEN frequency_pct >= 14 THEN 'Important' ELSE 'Bonus' END AS level FROM targets t JOIN matrix m USING (role) JOIN owned o ON o.candidate = t.candidate AND o.skill = m.skill),"
    " ready AS (SELECT t.candidate, t.role, CAST(coalesce(round_even(round(sum(CASE WHEN o.skill IS NOT NULL THEN frequency_pct ELSE 0 END), 2) / round(sum(frequency_pct), 2) * 100, 0), 0) AS BIGINT) AS readiness FROM targets t LEFT JOIN matrix m USING (role) LEFT JOIN owned o ON o.candidate = t.candidate AND o.skill = m.skill GROUP BY 1, 2),"
    " ranked AS (SELECT *, row_number() OVER (PARTITION BY candidate ORDER BY CASE severity WHEN 'critical' THEN 1 WHEN 'medium' THEN 2 ELSE 3 END, frequency_pct DESC, skill) AS rank FROM weak)"
)
_GAP_JSON = "'{\"skill\":\"' || skill || '\",\"frequency_pct\":' || frequency_pct || ',\"label\":\"' || LABEL || '\"MORE}'"


def _json_list(source: str, label: str, where: str, name: str, more: str = "") -> str:
    one = _GAP_JSON.replace("LABEL", label).replace("MORE", more)
    return f" {name} AS (SELECT candidate, '[' || string_agg({one}, ',' ORDER BY frequency_pct DESC, skill) || ']' AS {name} FROM {source} WHERE {where} GROUP BY 1)"


@add(
    "q_gap_document",
    BASE + _WEAK + "," + _json_list("strong", "level", "true", "strengths") + "," + _json_list("weak", "severity", "severity = 'optional'", "optional_gaps")
    + ", extra AS (SELECT o.candidate, string_agg(o.skill, '|' ORDER BY o.skill) AS extra_skills FROM owned o JOIN targets t USING (candidate) WHERE NOT EXISTS (SELECT 1 FROM matrix m WHERE m.role = t.role AND m.skill = o.skill) GROUP BY 1),"
    " acts AS (SELECT candidate, '[' || string_agg('{\"rank\":' || rank || ',\"priority\":\"' || CASE severity WHEN 'critical' THEN 'High' WHEN 'medium' THEN 'Medium' ELSE 'Low' END || '\",\"skill\":\"' || skill || '\",\"action\":\"Learn and practise ' || skill || '\"}', ',' ORDER BY rank) || ']' AS actions FROM ranked WHERE rank <= 5 GROUP BY 1)"
    " SELECT candidate, role, readiness, strengths, CASE WHEN w.candidate IS NOT NULL THEN coalesce(optional_gaps, '[]') END AS optional_gaps, extra_skills, actions FROM ready LEFT JOIN strengths USING (candidate) LEFT JOIN optional_gaps USING (candidate) LEFT JOIN extra USING (candidate) LEFT JOIN acts USING (candidate)"
    " LEFT JOIN (SELECT DISTINCT candidate FROM weak) w USING (candidate)",
)
def q_gap_document(s, d):
    doc = gap.gap_document(owned(s, d), targets(s, d), matrix(s, d), critical=CRITICAL, medium=CORE, core=CORE, important=IMPORTANT)
    return doc.select("candidate", "role", "readiness", F.to_json("strengths").alias("strengths"), F.to_json("optional_gaps").alias("optional_gaps"), joined("extra_skills").alias("extra_skills"), F.to_json("actions").alias("actions"))


_ABOUT = ",\"category\":\"' || category || '\",\"description\":\"' || parts || ' parts\""


@add(
    "q_feedback_document",
    BASE + _WEAK + ", about AS (SELECT p_brand AS skill, min(p_type) AS category, count(*) AS parts FROM part GROUP BY 1), sm AS (SELECT * FROM strong JOIN about USING (skill)), wm AS (SELECT * FROM weak JOIN about USING (skill)),"
    + _json_list("sm", "level", "true", "st", _ABOUT) + "," + _json_list("wm", "severity", "severity = 'critical'", "cr", _ABOUT) + "," + _json_list("wm", "severity", "severity = 'medium'", "md", _ABOUT)
    + ", acts AS (SELECT candidate, '[' || string_agg('{\"mức_độ_ưu_tiên\":\"' || CASE severity WHEN 'critical' THEN 'Cao' WHEN 'medium' THEN 'Trung bình' ELSE 'Thấp' END || '\",\"kỹ_năng\":\"' || skill || '\",\"hành_động\":\"Learn and practise ' || skill || '\"" + _ABOUT + "}', ',' ORDER BY rank) || ']' AS ac FROM ranked JOIN about USING (skill) WHERE rank <= 5 GROUP BY 1)"
    " SELECT candidate, '{\"vai_trò_mục_tiêu\":\"' || role || '\",\"điểm_sẵn_sàng\":' || readiness || coalesce(',\"điểm_mạnh\":' || st, '') || coalesce(',\"khoảng_trống_quan_trọng\":' || cr, '') || coalesce(',\"khoảng_trống_trung_bình\":' || md, '') || coalesce(',\"hành_động_cải_thiện\":' || ac, '') || '}' AS document"
    " FROM ready LEFT JOIN st USING (candidate) LEFT JOIN cr USING (candidate) LEFT JOIN md USING (candidate) LEFT JOIN acts USING (candidate)",
)
def q_feedback_document(s, d):
    part = table(s, d, "part").groupBy(F.col("p_brand").alias("skill")).agg(F.min("p_type").alias("category"), F.count(F.lit(1)).alias("n"))
    about = part.select("skill", "category", F.concat(F.col("n").cast("string"), F.lit(" parts")).alias("description"), F.lit("").alias("importance_reason"))
    doc = gap.gap_document(owned(s, d), targets(s, d), matrix(s, d), metadata=about, critical=CRITICAL, medium=CORE, core=CORE, important=IMPORTANT)
    whole = documents.translated_document(doc.drop("candidate"), documents.PROMPT_NAMES, documents.PROMPT_VALUES, documents.PROMPT_DROPPED)
    return doc.select("candidate", whole.alias("document"))


@add(
    "q_json_props",
    "SELECT event_id, CASE WHEN event_id % 8 < 6 THEN CAST(json_extract(props, '$.k') AS BIGINT) END AS k, ['whole', 'whole', 'block', 'repaired', 'repaired', 'block', NULL, NULL][event_id % 8 + 1] AS step, CASE event_id % 8 WHEN 6 THEN 'no_bracket' WHEN 7 THEN 'cut' END AS reason FROM events",
)
def q_json_props(s, d):
    """Props damaged in seven ways, read again or put in quarantine."""
    p, kind = F.col("props"), F.col("event_id") % 8
    ways = [p, F.concat(F.lit("```json\n"), p, F.lit("\n```")), F.concat(F.lit("It is "), p, F.lit(" then.")), F.concat(F.rtrim(p, F.lit("}")), F.lit(",}")), F.replace(p, F.lit('"'), F.lit("'")), F.rtrim(p, F.lit("}")), F.lit("nothing to read"), F.lit('{"k": ')]
    damaged = F.element_at(F.array(*ways), (kind + 1).cast("int"))
    rows = table(s, d, "events").select("event_id", damaged.alias("damaged"))
    read = repair.read_json(rows, "damaged")
    return read.select("event_id", F.get_json_object("fixed", "$.k").cast("long").alias("k"), "step", "reason")


@add("q_cv_round_trip", "SELECT c_custkey, c_name AS name, c_mktsegment AS first_skill, 1 AS n_skills, c_custkey % 90 AS months FROM customer")
def q_cv_round_trip(s, d):
    job = F.struct(F.col("c_mktsegment").alias("title"), (F.col("c_custkey") % 90).cast("int").alias("duration_months"))
    doc = F.to_json(F.struct(F.struct(F.col("c_name").alias("name")).alias("personal_info"), F.array("c_mktsegment").alias("skills"), F.array(job).alias("experience")))
    cv = table(s, d, "customer").select("c_custkey", profile.parse_cv(profile.dump_cv(profile.parse_cv(doc))).alias("cv"))
    return cv.select("c_custkey", F.col("cv.personal_info.name").alias("name"), F.element_at("cv.skills", 1).alias("first_skill"), F.size("cv.skills").alias("n_skills"), F.element_at("cv.experience", 1)["duration_months"].alias("months"))


# Near names: a ratio that SQL does not have; tests hold these against every pair.


@add("q_fuzzy_pairs")
def q_fuzzy_pairs(s, d):
    return fuzzy.similar_pairs(fx.part_names(s, d))


@add("q_fuzzy_components")
def q_fuzzy_components(s, d):
    names = fx.part_names(s, d)
    return fuzzy.canonical_names(fuzzy.groups(names, fuzzy.similar_pairs(names)), names)


def _part_ontology(s, d):
    """Half of the part names, as they are written in upper case."""
    names = table(s, d, "part").select("p_name").distinct().filter("length(p_name) % 2 = 0")
    return names.select(F.col("p_name").alias("alias"), F.upper("p_name").alias("canonical"), F.xxhash64("p_name").alias("ordinal"))


@add("q_skill_normalize")
def q_skill_normalize(s, d):
    return fuzzy.normalized_skills(fx.spelled_parts(s, d).withColumnRenamed("name", "skill"), _part_ontology(s, d))


def _part_records(s, d):
    parts = fx.spelled_parts(s, d).join(table(s, d, "part").select("p_partkey", "p_type", "p_name"), "p_partkey")
    return parts.select(F.col("p_partkey").alias("record_id"), F.col("p_type").alias("title"), F.concat(F.lit("Made as a "), "p_name").alias("description"), F.array("name").alias("skills_raw"))


@add("q_record_skills")
def q_record_skills(s, d):
    return fuzzy.record_skills(_part_records(s, d), _part_ontology(s, d)).select("record_id", joined("skills").alias("skills"))


@add("q_ontology")
def q_ontology(s, d):
    manual = _part_ontology(s, d).filter("length(alias) < 9").select("alias", "canonical")
    seeds = table(s, d, "part").select(F.lower("p_type").alias("skill")).distinct()
    found, _, _ = fuzzy.iterated_ontology(_part_records(s, d), manual, seeds, iterations=3)
    return found


@add("q_skills_master")
def q_skills_master(s, d):
    manual = _part_ontology(s, d).filter("length(alias) < 9").select("alias", "canonical")
    seeds = table(s, d, "part").select(F.lower("p_type").alias("skill")).distinct()
    found, grouped = fuzzy.mined_ontology(fx.spelled_parts(s, d).select("name"), manual, seeds)
    return fuzzy.skills_master(found, grouped).withColumn("aliases", F.array_join("aliases", ", "))


@add("q_enriched_query", "SELECT doc_id, CASE lang WHEN 'fr' THEN 'French text. ' || source WHEN 'de' THEN 'German text. ' || source ELSE source END AS query FROM documents")
def q_enriched_query(s, d):
    hints = {"fr": "French text", "de": "German text"}
    return table(s, d, "documents").select("doc_id", text.enriched_query(F.col("source"), F.col("lang"), hints).alias("query"))
