import pytest
from pyspark.sql import functions as F

from skillweave.operators import evaluate, fuzzy, gap, graph, market, matching, roadmap, sections, transitions
from skillweave.plans import fixtures as fx


def rows(df, *order):
    return [tuple(r) for r in (df.orderBy(*order) if order else df).collect()]


@pytest.fixture(scope="module")
def jobs(spark):
    data = [(1, "A", ["python", "sql"]), (2, "A", ["python", " "]), (3, "A", []), (4, "B", ["sql", "sql"])]
    return spark.createDataFrame(data, "job_id int, role string, skills array<string>")


def test_matrix_counts_jobs_without_skills(spark, jobs):
    m = market.role_skill_matrix(jobs.select("job_id", "role"), market.job_skills(jobs))
    assert rows(m, "role", "skill") == [("A", "python", 66.67, 2, 3), ("A", "sql", 33.33, 1, 3), ("B", "sql", 100.0, 1, 1)]


def test_role_lookup_prefers_exact(spark):
    m = spark.createDataFrame([("Data", "x", 50.0, 1, 2), ("Data Engineer", "y", 50.0, 1, 2)], "role string, skill string, frequency_pct double, count long, total_jobs_in_role long")
    assert {r.role for r in market.role_rows(m, "data").collect()} == {"Data"}
    assert {r.role for r in market.role_rows(m, "engin").collect()} == {"Data Engineer"}
    assert market.role_rows(m, "none").count() == 0


@pytest.fixture(scope="module")
def gaps(spark):
    m = spark.createDataFrame([("R", "a", 80.0, 4, 5), ("R", "b", 60.0, 3, 5), ("R", "c", 20.0, 1, 5)], "role string, skill string, frequency_pct double, count long, total_jobs_in_role long")
    owned = spark.createDataFrame([(1, "b"), (1, "z"), (2, "a")], "candidate int, skill string")
    targets = spark.createDataFrame([(1, "R"), (2, "R"), (3, "R"), (4, "none")], "candidate int, role string")
    return owned, targets, m


def test_readiness(gaps):
    assert {r.candidate: r.readiness for r in gap.readiness(*gaps).collect()} == {1: 38, 2: 50, 3: 0, 4: 0}


def test_levels_and_actions(gaps):
    assert rows(gap.strengths(*gaps).select("candidate", "skill", "level"), "candidate") == [(1, "b", "Core"), (2, "a", "Core")]
    weak = gap.weaknesses(*gaps)
    assert rows(weak.filter("candidate = 1").select("skill", "severity"), "skill") == [("a", "critical"), ("c", "optional")]
    assert rows(gap.extra_skills(*gaps).select("candidate", "skill")) == [(1, "z")]
    assert rows(gap.improvement_actions(weak, max_actions=1).select("candidate", "skill", "priority"), "candidate") == [(1, "a", "High"), (2, "b", "Medium"), (3, "a", "High")]


def test_document_has_every_target(gaps):
    doc = {r.candidate: r for r in gap.gap_document(*gaps).collect()}
    assert set(doc) == {1, 2, 3, 4} and [s.skill for s in doc[3].critical_gaps] == ["a"] and doc[1].strengths[0].skill == "b"


def test_transitions_go_from_small_to_large(spark):
    data = [("Big", s, 40.0) for s in "abcd"] + [("Small", s, 60.0) for s in "ab"] + [("Far", "z", 90.0)]
    m = spark.createDataFrame(data, "role string, skill string, frequency_pct double")
    out = transitions.transitions(m)
    assert rows(out.select("from", "to", "weight", "shared_skills")) == [("Small", "Big", 0.5, ["a", "b"])]
    seeded = transitions.seeded(out, spark.createDataFrame([("Small", "Big"), ("Far", "Big"), ("X", "Y")], "from string, to string"), m)
    assert {(r["from"], r["to"]): r.weight for r in seeded.collect()} == {("Small", "Big"): 0.5, ("Far", "Big"): 0.0, ("X", "Y"): 0.3}


def test_prerequisites_agree_in_both_forms(spark):
    e = fx.edges(spark)
    goals, owned = spark.createDataFrame([(1, "rag")], "candidate int, goal string"), spark.createDataFrame([(1, "ml")], "candidate int, skill string")
    single = rows(graph.transitive_prerequisites(goals, owned, e).select("goal", "skill", "depth"), "depth", "skill")
    assert rows(graph.missing_prerequisites(goals, owned, e, most=3).select("goal", "skill", "depth"), "depth", "skill") == single
    batch = rows(graph.missing_prerequisites(goals, owned, e).select("goal", "skill", "depth"), "depth", "skill")
    assert single == batch == [("rag", "llm", 1), ("rag", "sql", 1), ("rag", "dl", 2), ("rag", "nlp", 2)]


def test_depths_and_paths(spark):
    e = fx.edges(spark)
    own = spark.createDataFrame([(1, "python"), (2, "docker"), (2, "ml")], "candidate int, skill string")
    some = spark.createDataFrame([(k, s) for k in (1, 2, 3) for s in ("rag", "docker", "python")], "candidate int, skill string")
    depths = {(r.candidate, r.skill): r.depth for r in graph.depth_to_owned(some, own, e).collect()}
    assert {s: d for (k, s), d in depths.items() if k == 1} == {"rag": 4, "docker": 999, "python": 0}
    assert depths[2, "rag"] == 3 and depths[2, "python"] == 999 and depths[3, "rag"] == 999 and len(depths) == 9
    nodes = spark.createDataFrame([(k, s) for k in (1, 2, 3) for s in fx.NODES], "candidate int, skill string")
    longest = {(r.candidate, r.skill): r.depth for r in graph.longest_depth(nodes, own, e).collect()}
    assert longest[3, "rag"] == 6  # llm, nlp, dl, ml, pandas, python
    assert longest[1, "rag"] == 5 and longest[1, "python"] == 0 and longest[2, "rag"] == 3 and longest[2, "ml"] == 0 and longest[2, "mlops"] == 0
    chain = graph.first_prerequisite_chain(spark.createDataFrame([(1, "rag"), (1, "mlops")], "candidate int, goal string"), e)
    assert rows(chain.filter("goal = 'rag'").select("step", "skill"), "step") == [(0, "python"), (1, "ml"), (2, "dl"), (3, "nlp"), (4, "llm"), (5, "rag")]
    paths = e.select(F.col("src").alias("from"), F.col("dst").alias("to"))
    found = transitions.shortest_path(paths, spark.createDataFrame([("docker", "python"), ("docker", "nowhere")], "start string, goal string")).collect()
    assert [(r.path, r.steps) for r in found] == [(["docker", "mlops", "ml", "python"], 3)]


def test_phases_keep_prerequisites_before(spark):
    ordered = spark.createDataFrame([(1, i, s) for i, s in enumerate(["rag", "llm", "nlp", "dl", "ml", "pandas"])], "candidate int, pos int, skill string")
    first = roadmap.chunk_phases(ordered)
    assert dict(rows(first.select("skill", "phase"))) == {"rag": 1, "llm": 1, "nlp": 1, "dl": 2, "ml": 2, "pandas": 2}  # six are three and three
    for n, want in ((1, [1]), (3, [3]), (5, [5]), (7, [4, 3]), (11, [4, 4, 3]), (13, [5, 5, 3]), (16, [4, 4, 4, 4]), (21, [5, 5, 5, 6])):
        some = roadmap.chunk_phases(spark.createDataFrame([(1, i) for i in range(n)], "candidate int, pos int"))
        assert [r[1] for r in rows(some.groupBy("phase").count(), "phase")] == want, n
    split = roadmap.chunk_phases(ordered, max_per=3)
    fixed = dict(rows(roadmap.repaired_phases(split.select("candidate", "skill", "phase"), fx.edges(spark)).select("skill", "phase")))
    for src, dst, kind, _ in fx.EDGES:
        if kind == "prerequisite" and src in fixed and dst in fixed:
            assert fixed[src] >= fixed[dst]


def test_projection_is_monotone(spark):
    owned = spark.createDataFrame([(1, "a")], "candidate int, skill string")
    phases = spark.createDataFrame([(1, "b", 1), (1, "c", 2), (1, "a", 2)], "candidate int, skill string, phase int")
    weights = spark.createDataFrame([("a", 1.0), ("b", 2.0), ("c", 1.0)], "skill string, weight double")
    assert rows(roadmap.projection(owned, phases, weights), "phase") == [(1, 0, 25, 0), (1, 1, 75, 50), (1, 2, 100, 25)]


def test_stage(spark):
    df = spark.createDataFrame([(0.0, 0), (0.0, 2), (2.0, 3), (9.0, 5), (None, 0), (None, 5)], "y double, n int")
    assert rows(df.select(*roadmap.career_stage(F.col("y"), F.col("n")))) == [("Student", 0.7), ("Student", 0.8), ("Middle", 0.8), ("Middle", 0.8), ("Student", 0.5), ("Junior", 0.6)]


def test_cosine(spark):
    df = spark.createDataFrame([([1.0, 0.0], [1.0, 1.0]), ([0.0, 0.0], [1.0, 1.0])], "a array<double>, b array<double>")
    a, b = (r[0] for r in df.select(matching.cosine(F.col("a"), F.col("b"))).collect())
    assert abs(a - 0.5**0.5) < 1e-12 and b is None


def test_sections(spark):
    docs = spark.createDataFrame([(1, "Ann Lee\nEducation\nA school, 2019\nSkills:\nPython")], "doc_id int, text string")
    out = sections.sectioned(sections.lines(docs), {"education": ["education"], "skills": ["skills"]})
    assert rows(out.select("line", "section"), "line_no") == [("Ann Lee", "personal_info"), ("A school, 2019", "education"), ("Python", "skills")]
    spans = rows(sections.spans(docs, {"education": "Education", "skills": "Skills:"}).select("section", "content"), "start", F.desc("section"))
    assert dict(spans) == {"_pre_text": "Ann Lee\n", "education": "Education\nA school, 2019\n", "skills": "Skills:\nPython"} or len(spans) == 3


def test_fuzzy_groups(spark):
    names = spark.createDataFrame([("reactjs", 1, 5), ("react.js", 2, 9), ("react js", 3, 1), ("python", 4, 7)], "name string, ordinal int, frequency long")
    pairs = fuzzy.similar_pairs(names, 85)
    found = {r.name: r.canonical for r in fuzzy.canonical_names(fuzzy.groups(names, pairs), names).collect()}
    assert found == {"reactjs": "react.js", "react.js": "react.js", "react js": "react.js", "python": "python"}


def test_evaluation(spark):
    t = spark.createDataFrame([(1, "You know **Python** well.\n- SQL: 55% of jobs\nDocker (12,4%) too")], "doc_id int, text string")
    assert set(t.select(evaluate.mentioned_skills(F.col("text"))).first()[0]) == {"Python", "SQL", "Docker"}
    known = spark.createDataFrame([(1, 55.0), (1, 13.0)], "doc_id int, value double")
    assert rows(evaluate.number_drift(t, known)) == [(1, 2, 1)]


def test_profiles(spark):
    from skillweave.operators import profile

    docs = spark.createDataFrame([(1, "Curriculum\nann@x.org\nAnn Lee\nMaster student, 3 years")], "doc_id int, text string")
    assert profile.head_name(sections.lines(docs), ["curriculum"]).first().name == "Ann Lee"
    cvs = spark.createDataFrame(
        [(1, ["Ann Lee"], ["X University", "2020 - present"], [" Data engineer ", "2.5 years of it"], ["AI tools: MLflow; SQL", "SQL, Excel"]), (2, ["Bo"], ["School of life"], ["3 năm"], []), (3, [], ["Học viện A"], [], None), (4, None, None, None, ["html"])],
        "doc_id int, personal_info array<string>, education array<string>, experience array<string>, skills array<string>",
    )
    found = profile.career_profile(cvs, {"ai": ["mlf"], "web": ["html"]})
    career = [(*r[:4], r.domains, r.summary) for r in found.orderBy("doc_id").collect()]
    assert career == [
        (1, "Intern/Junior", 2.5, "Data engineer", ["ai"], "Ann Lee - Ứng viên tiềm năng | Lĩnh vực: ai"),
        (2, "Entry", 3.0, "3 năm", [], "Bo - Ứng viên tiềm năng"),
        (3, "Student", 0.0, "Unknown", [], ""),
        (4, "Entry", 0.0, "Unknown", ["web"], "Lĩnh vực chuyên môn: web"),
    ]
    one = found.filter("doc_id = 1").first()
    assert one.skills == ["MLflow", "SQL", "Excel"] and one.technology_stack == ["Excel", "MLflow", "SQL"]
    assert rows(profile.career_profile(cvs).select("doc_id", "domains"), "doc_id")[0] == (1, ["AI/ML", "Data Science"])
    blocks = spark.createDataFrame([(["• Shop -", "My role: lead", "Python, FastAPI , Go", "Sold things", "Position: head", "well"],)], "b array<string>")
    got = blocks.select(profile.project_of(F.col("b")).alias("p")).first().p
    assert (got.name, got.role, got.technologies, got.description) == ("Shop", "Position: head", ["Python", "FastAPI", "Go"], "Sold things well")
    bad = spark.createDataFrame([("no json",), ('{"skills": ["a"]}',)], "j string").select(profile.parse_cv(F.col("j")).alias("cv")).collect()
    assert (bad[0].cv is None or bad[0].cv.skills is None) and bad[1].cv.skills == ["a"]
    assert docs.select(profile.prompt("Say {structured_analysis}.", F.struct("doc_id"))).first()[0] == 'Say {"doc_id":1}.'


def test_roadmap_documents(spark, gaps):
    from skillweave.operators import insights

    owned = spark.createDataFrame([(1, "python")], "candidate int, skill string")
    targets = spark.createDataFrame([(1, "AI")], "candidate int, role string")
    m = spark.createDataFrame([("AI", "python", 90.0), ("AI", "ml", 75.0), ("AI", "dl", 80.0)], "role string, skill string, frequency_pct double")
    doc = insights.roadmap_document(owned, targets, m, fx.edges(spark)).first()
    assert doc.readiness == 37 and [p.skills for p in doc.phases] == [["dl", "ml"]]
    lengths = insights.penalty_lengths(spark.createDataFrame([(1, "dl")], "candidate int, goal string"), owned, fx.edges(spark))
    assert lengths.first().missing == 3  # ml; of ml: statistics, pandas


def test_vector_search_in_blocks_equals_broadcast(spark, monkeypatch):
    v = spark.createDataFrame([(i, [float(i % 7), float(i % 11) - 5, float(i % 3)]) for i in range(120)] + [(120, [0.0] * 3)], "id long, embedding array<double>")
    q = v.select(F.col("id").alias("query_id"), "embedding")
    want = rows(matching.vector_top_k(v, q, 4), "query_id", "rank")
    for name, value in (("MAX_QUERIES", 10), ("SHARD", 50), ("BLOCK", 9)):
        monkeypatch.setattr(matching, name, value, raising=False)
    assert len(want) == 121 * 4 and rows(matching.vector_top_k(v, q, 4), "query_id", "rank") == want


def test_gaps_without_letter_case(spark, gaps):
    _, targets, m = gaps
    shouted = gaps[0].withColumn("skill", F.upper("skill"))
    for f in (gap.strengths, gap.weaknesses, gap.readiness):
        assert sorted(rows(f(shouted, targets, m))) == sorted(rows(f(*gaps)))
    assert sorted(rows(gap.extra_skills(shouted, targets, m).select("candidate", F.lower("skill")))) == sorted(rows(gap.extra_skills(*gaps).select("candidate", "skill")))


def test_unknown_roles(spark, gaps):
    owned, targets, m = gaps
    known = targets.join(m.select("role").distinct(), "role", "left_semi")
    assert gap.validated(known, m).count() == known.count()
    with pytest.raises(gap.UnknownRole, match="'Pilot'"):
        gap.validated(known.union(spark.createDataFrame([("Pilot", 9)], "role string, candidate int").select(*known.columns)), m)


def test_closest_role_falls_back(spark):
    m = spark.createDataFrame([("Data Engineer", "sql", 60.0), ("Data Engineer", "spark", 40.0), ("AI Engineer", "ml", 90.0)], "role string, skill string, frequency_pct double")
    owned = spark.createDataFrame([(1, "sql"), (2, "Data"), (3, "cooking"), (4, "engineer")], "candidate int, skill string")
    assert rows(transitions.closest_role(owned, m, 30.0), "candidate") == [(1, "Data Engineer", 0.5), (2, "Data Engineer", 0.0), (3, "AI Engineer", 0.0), (4, "AI Engineer", 0.0)]


def test_phase_summary(spark):
    phases = spark.createDataFrame([(1, "a", 1), (1, "b", 1), (1, "c", 2), (1, "d", 7)], "candidate int, skill string, phase int")
    depths = spark.createDataFrame([("a", 0), ("b", 1), ("c", 2)], "skill string, depth int")
    out = rows(roadmap.phase_summary(phases, depths).select("phase", "title", "avg_depth", "reason"), "phase")
    assert out[0] == (1, "Nền tảng cơ bản", 0.5, "Kiến thức nền tảng, 2 kỹ năng cơ bản")
    assert out[1][2:] == (2.0, "Phát triển chuyên sâu, áp dụng vào dự án thực tế") and out[2][1] == "Phase 7"


def test_graph_projection(spark):
    """By hand: ml needs python, statistics, pandas (pandas needs python); dl needs ml."""
    table = lambda rows, schema: spark.createDataFrame(rows, f"candidate int, {schema}")
    skills = table([(c, s, 0.5, 1.0, i) for c in (1, 2, 3) for i, s in enumerate(("ml", "dl"))] + [(4, "ml", 0.0, 1.0, 0)], "skill string, weight double, market double, ordinal int")
    owned, started = table([(1, "python"), (4, "ml")], "skill string"), table([(3, "ml")], "skill string")
    phases = table([(1, 1, "statistics"), (1, 2, "ml"), (4, 1, "x")], "phase int, skill string")
    got = roadmap.graph_projection(skills, owned, phases, fx.edges(spark), started)
    out = {(r.candidate, r.phase): (r.score, r.delta, r.bottlenecks) for r in got.collect()}
    # 1: ml is two steps from python (1/2), two missing (0.7): 0.35; dl 1/3, three missing (0.55): 0.1833; together 26.67.
    assert out[1, 0] == (27, 0, ["dl"])
    # statistics in hand: ml 1/2 * 0.85, dl 1/3 * 0.7 (ml, pandas): 32.9.
    assert out[1, 1] == (33, 6, ["dl"])
    # ml in hand: 1, dl 1/2 with pandas still met on the way? ml is in hand, so nothing is missing: 0.5.
    assert out[1, 2] == (75, 42, [])
    assert out[2, 0] == (0, 0, ["ml", "dl"]) and out[3, 0] == (75, 0, []) and out[4, 1] == (0, 0, [])
