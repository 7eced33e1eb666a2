"""Whole roadmap documents, parsers by lines, sinks, and small functions that queries do not reach."""

from pyspark.sql import functions as F

from skillweave.functions import sets, text
from skillweave.operators import insights, profile, roadmap
from skillweave.plans import fixtures as fx
from skillweave.sources import tables


def test_full_roadmap(spark):
    table = lambda rows, schema: spark.createDataFrame(rows, schema)
    owned = table([(1, "python"), (3, "python"), (3, "ml")], "candidate int, skill string")
    targets = table([(1, "AI"), (2, "AI"), (3, "Done")], "candidate int, role string")
    m = table([("AI", "python", 90.0), ("AI", "ml", 75.0), ("AI", "dl", 60.0), ("Done", "ml", 80.0)], "role string, skill string, frequency_pct double")
    stages = table([(1, "Junior"), (3, "Student")], "candidate int, stage string")
    got = {r.candidate: r for r in insights.full_roadmap(owned, targets, m, fx.edges(spark), stages, fx.pool(spark), {"Junior": ["Beginner"]}, 0.1).collect()}
    one = got[1]
    skills = [s for p in one.phases for s in p.skills]
    assert set(skills) == {"ml", "dl", "pandas", "statistics"} and one.completed == ["python"] and one.partial == ["ml"] and one.missing == ["dl"]
    # ml is one step from python with statistics and pandas missing, dl two with three missing.
    assert one.readiness == 40 and one.current_score == round((90 + 75 / 2 * 0.7 + 60 / 3 * 0.55) / 225 * 100) and one.final_score == 100
    assert [p.score - b for p, b in zip(one.phases, [one.current_score, *[p.score for p in one.phases]])] == [p.delta for p in one.phases]
    assert one.phases[0].project == "Sales dashboard" and one.phases[0].paragraph.startswith("Phase 1 - ") and one.report.improvement == 100 - one.current_score
    assert one.story.focus[0] == "Hoàn thành ml trước" and "trừ 75%" in one.report.report
    two = got[2]
    assert two.stage is None and two.current_score == 0 and two.completed == [] and two.bottlenecks == ["python", "ml", "dl"] and "Bạn đang bắt đầu từ đầu." in two.story.summary
    three = got[3]
    assert three.phases is None and three.current_score == three.final_score == 100 and three.report.next_actions == ["Bắt đầu với kỹ năng có độ khó thấp nhất trước"]


def test_education_by_lines(spark):
    rows = [
        (1, ["Học viện A", "GPA: 3.1/4", "GPA 3.47/4.0", "09/2020 - 06/2024", "Chuyên ngành: CNTT - AI"]),
        (2, ["School", "Major: x"]),
        (3, ["Trường B 09/2020 3.2/4.0", " to 01/2021", "hiện tại 02/2022 present", "ngành"]),
        (4, []),
        (5, None),
    ]
    got = {r.i: r.e for r in spark.createDataFrame(rows, "i int, l array<string>").select("i", profile.education_of(F.col("l")).alias("e")).collect()}
    assert tuple(got[1]) == ("Học viện A", "09/2020", "06/2024", "3.47/4.0", "CNTT - AI")
    assert got[2] is None and got[4] is None and got[5] is None
    assert tuple(got[3]) == ("Trường B 09/2020 3.2/4.0", "hiện tại", "02/2022", None, None)
    person = spark.createDataFrame([([" Ann ", "a.b@x.org +84 912 345 678 GitHub.com/ann"],), ([],)], "l array<string>").select(profile.personal_of(F.col("l")).alias("p")).collect()
    assert person[0].p.name == "Ann" and person[0].p.email == "a.b@x.org" and person[0].p.github == "GitHub.com/ann" and person[0].p.phone and person[1].p.name is None


def test_sinks_replace_what_was_there(spark, tmp_path):
    df = spark.createDataFrame([("Kỹ sư", 1, None), ('a "b",\nc', 2, "x")], "role string, n int, note string")
    for _ in range(2):
        tables.write_csv(df, str(tmp_path / "c"))
    assert sorted((r.role, r.n, r.note) for r in tables.read_csv(spark, str(tmp_path / "c"), "role string, n int, note string").collect()) == sorted([("Kỹ sư", 1, None), ('a "b",\nc', 2, "x")])
    tables.write_json(df, str(tmp_path / "j"))
    assert sorted(r.value for r in spark.read.text(str(tmp_path / "j")).collect()) == sorted(['{"role":"Kỹ sư","n":1}', '{"role":"a \\"b\\",\\nc","n":2,"note":"x"}'])
    vectors = spark.createDataFrame([("a", [1.0, 2.0], "doc", {"k": "v"}, 9)], "id string, embedding array<double>, document string, metadata map<string,string>, extra int")
    for _ in range(2):
        tables.write_vectors(vectors, str(tmp_path / "v"))
    back = spark.read.parquet(str(tmp_path / "v"))
    assert back.dtypes[1] == ("embedding", "array<float>") and back.columns == ["id", "embedding", "document", "metadata"] and back.count() == 1


def test_small_functions(spark):
    t = spark.createDataFrame([("\x1b[31mred\x1b[0m \x07 text⠋  here\n\n\n\nend ",)], "t string")
    assert t.select(text.clean_terminal(F.col("t"))).first()[0] == "red text here\n\nend"
    fields = spark.createDataFrame([("a", "b"), (" ", "b"), (None, "b"), ("a", None)], "r string, m string")
    assert [x[0] for x in fields.select(profile.merged_fields(F.col("r"), F.col("m"))).collect()] == ["a", "b", "b", "a"]
    assert [x[0] for x in fields.select(profile.merged_fields(F.col("r"), F.col("m"), False)).collect()] == ["b", "b", "b", "a"]
    records = spark.createDataFrame([("RESUME_0012", "KAGGLE_RESUME", "resume", "IT", ["sql"], "x" * 600), ("JD_0001", "KAGGLE_JD", "job", None, ["go"], "y")], "record_id string, source string, record_type string, category string, skills_extracted array<string>, description string")
    (cv,) = profile.resume_profiles(records).collect()
    assert cv.candidate_id == 12 and cv.skill_count == 1 and len(cv.description_preview) == 500
    lists = spark.createDataFrame([(["b", "a"], ["a", "c"])], "x array<string>, y array<string>")
    assert lists.select(sets.ordered_union(F.col("x"), F.col("y"))).first()[0] == ["b", "a", "c"]
    assert roadmap.STAGES == ("Student", "Fresher", "Junior", "Middle")
