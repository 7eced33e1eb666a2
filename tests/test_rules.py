"""Rules as data and documents: lines, projects, sections, roles, stages, translated documents, quarantine, severity drift."""

import json
import random
import re

import pytest
from pyspark.sql import functions as F

from skillweave.functions import documents, repair, role_rules
from skillweave.operators import evaluate, gap, layout, stages
from skillweave.sources import tables


def plain_merge(lines):
    """Left to right, two lines at most at a time."""
    lines = [x.strip() for x in lines]
    upper = lambda x: x.upper() in layout.HEADERS or (len(x) > 2 and sum(c.isupper() for c in x) / len(x) > 0.7)
    bullet = lambda x: any(re.match(p, x) for p in (r"[•\-\*]\s+", r"\d+\.\s+", r"[a-zA-Z]\.\s+"))
    dated = lambda x: re.search(layout.DATE, x) is not None
    out, i = [], 0
    while i < len(lines):
        a, b = lines[i], lines[i + 1] if i + 1 < len(lines) else ""
        if a and b and not any(f(x) for f in (upper, bullet) for x in (a, b)):
            goes_on = any(a.lower().endswith(e) for e in (",", "-", "and", "or", "&", ";")) or a[-1] not in ".!?);"
            short = len(b.split()) < 3
            if goes_on or (short and not dated(a)) or (a[-1] not in ".!?;:" and short):
                out.append(f"{a} {b}")
                i += 2
                continue
        if a:
            out.append(a)
        i += 1
    return out


def test_lines_join_as_read_from_the_top(spark):
    r = random.Random(2)
    some = ["Led a team,", "of five.", "Worked from 01/2020.", "to now", "EXPERIENCE", "- bullet one", "and more", "Built things and", "1. first", "", "  padded line  ", "Ends here.", "Done!", "ABC Corp", "Kỹ năng", "x", "Tháng 3 làm việc.", "Two words)", "a. item", "HÀ NỘI VIỆT", "since 2019-04."]
    docs = {d: [r.choice(some) for _ in range(r.choice([0, 1, 5, 40]))] for d in range(40)}
    rows = spark.createDataFrame([(d, i * 2, x) for d, xs in docs.items() for i, x in enumerate(xs)], "doc_id int, line_no int, line string")
    got = {d: [] for d in docs}
    for x in layout.merged_lines(rows).orderBy("doc_id", "line_no").collect():
        got[x.doc_id].append(x.line)
    assert got == {d: plain_merge(xs) for d, xs in docs.items()}


def test_project_blocks_and_sections(spark):
    blocks = ["intro", "• Shop", "sold things", " ", "My App: a tool", "built", "- Other", "lower case: no", "Big Thing–x"]
    rows = spark.createDataFrame([(1, i, x) for i, x in enumerate(blocks)] + [(2, 0, "nothing")], "doc_id int, line_no int, line string")
    got = {(x.doc_id, x.project): x.blocks for x in layout.project_blocks(rows).collect()}
    assert got == {(1, 1): ["• Shop", "sold things"], (1, 2): ["My App: a tool", "built"], (1, 3): ["- Other", "lower case: no"], (1, 4): ["Big Thing–x"]}
    parts = spark.createDataFrame([(1, "My Skills", 2, ["b"]), (1, "skills", 1, ["a"]), (1, "hobbies", 3, ["c"]), (1, "education", 4, []), (1, "Schooling education", 5, ["d", "e"])], "doc_id int, section string, pos int, lines array<string>")
    named = {x.section: x.lines for x in layout.named_sections(parts, {"skills": ["skill"], "education": ["education", "school"]}).collect()}
    assert named == {"skills": ["a", "b"], "hobbies": ["c"], "education": ["d", "e"]}
    lines = spark.createDataFrame([(1, 0, "back end: Go, ;C++"), (1, 1, "Python, Docker; cooking, • PyTorch"), (1, 2, "  ")], "doc_id int, line_no int, line string")
    found = [(x.skill, x.category) for x in layout.categorised_skills(lines).orderBy("line_no", "pos").collect()]
    assert found == [("Go", "Back End"), ("C++", "Back End"), ("Python", "Programming"), ("Docker", "Tools"), ("cooking", "General"), ("• PyTorch", "Ai Ml")]


def test_role_maps(spark, tmp_path):
    titles = ["Senior  Backend Developer", "SRE", "sre", "Kỹ sư Phần mềm", "Intern", " ", None, "Mid-level data analyst - ", "VP of Sales/", "senior/lead react developer", "C++ developer", "Chuyên  viên ABC", "Head of Data Engineer", "QUẢN LÝ kho"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(titles)], "i int, title string")
    market = [x.role for x in role_rules.market_roles(df).orderBy("i").collect()]
    profile = [x.role for x in role_rules.profile_roles(df).orderBy("i").collect()]
    assert market == ["Backend Developer", "SRE", "SRE", "Phần Mềm", "Unknown", "Unknown", "Unknown", "Data Analyst", "Of Sales", "React Developer", "C++ Developer", "Abc", "Data Engineer", "Kho"]
    assert profile == ["Backend Developer", "Site Reliability Engineer", "Site Reliability Engineer", "Phần Mềm", "Intern", "Unknown", "Unknown", "Data Analyst", "Vp Of Sales/", "/ React Developer", "Backend Developer", "Abc", "Head Of Data Engineer", "Quản Lý Kho"]
    maps = [dict(tuple(r) for r in role_rules.role_map(spark, m).collect()) for m in (role_rules.MARKET_ROLES, role_rules.PROFILE_ROLES)]
    assert [len(m) for m in maps] == [64, 82] and len(maps[0].keys() & maps[1].keys()) == 49
    assert sum(maps[0][k] != maps[1][k] for k in maps[0].keys() & maps[1].keys()) == 8
    (tmp_path / "roles.txt").write_text("# rules\ncook = Chef\n\nhead cook = Chef = Boss\n")
    assert {tuple(r) for r in role_rules.read_role_map(spark, str(tmp_path)).collect()} == {("cook", "Chef"), ("head cook", "Chef = Boss")}


RULES = {
    "stages": ["Student", "Fresher", "Junior", "Middle"],
    "rules": {
        "experience_thresholds": {"Student": {"max_years": 0, "max_months": 6}, "Fresher": {"min_years": 0, "max_years": 1}, "Junior": {"min_years": 1, "max_years": 3}, "Middle": {"min_years": 3, "max_years": 6}},
        "skill_depth_adjustments": {"advanced_skills": ["LLM", "RAG", "Docker", "MLOps", "Rust"], "adjustment_rules": []},
        "job_title_keywords": {"Student": ["intern"], "Junior": ["junior"], "Middle": ["senior", "lead"]},
        "education_signals": {"recent_graduate": {"indicators": ["tốt nghiệp"], "stage": "Fresher"}, "currently_studying": {"indicators": ["đang học", "student"], "stage": "Student"}},
    },
}


def test_stages_by_rule_file(spark, tmp_path):
    (tmp_path / "r.json").write_text(json.dumps(RULES, ensure_ascii=False, indent=1))
    rules = stages.read_stage_rules(spark, str(tmp_path / "r.json"))
    months = lambda *m: [(x,) for x in m]
    cvs = [
        (1, [], None, ["Python", "SQL", "ML"], [], "Đang học năm 4"),
        (2, months(6), None, ["Python", "LLM", "RAG", "Docker"], None, None),
        (3, months(12, 18), 9.0, ["PyTorch"], ["Junior AI Engineer"], "Đã tốt nghiệp, student club"),
        (4, None, 0.0, None, ["Tech Lead", "Intern"], "tốt nghiệp"),
        (5, months(0, None), 4.0, ["LLM", "RAG", "Docker", "MLOps", "Rust"], [], None),
        (6, [], 30.0, ["LLM"], ["Senior"], ""),
        (7, months(3), None, [None, "x"], [None, "x"], "none"),
    ]
    got = {r.candidate: r for r in stages.detected_stages(spark.createDataFrame(cvs, f"candidate int, {stages.CV}"), rules).collect()}
    view = {k: (r.stage, r.confidence, r.title_stage, r.education_stage, r.reason) for k, r in got.items()}
    assert view[1] == ("Student", 0.5, None, "Student", "không có thông tin kinh nghiệm + 3 core skills")
    assert view[2] == ("Junior", 0.8, None, None, "0.5 năm kinh nghiệm + 4 core skills + có 3 advanced skills")
    assert view[3] == ("Junior", 0.8, "Junior", "Student", "2.5 năm kinh nghiệm + 1 core skills")
    assert view[4] == ("Student", 0.8, "Student", "Fresher", "0.0 năm kinh nghiệm + 0 core skills")
    assert view[5][:2] == ("Junior", 0.6) and got[5].years is None
    assert view[6] == ("Middle", 0.9, "Middle", None, "30.0 năm kinh nghiệm + 1 core skills + có 1 advanced skills")
    assert view[7][4].startswith("0.2 năm") and view[7][0] == "Fresher"


def test_rule_files(spark, tmp_path):
    pool = {"projects": {"A": {"name": "A", "difficulty": "Beginner", "primary_skills": ["SQL"], "tech_stack": ["x"], "deliverables": ["d"], "learning_outcomes": [], "estimated_hours": 40, "suitable_stages": ["Student"]}, "B": {"difficulty": "Advanced", "primary_skills": []}}}
    (tmp_path / "p.json").write_text(json.dumps(pool))
    rows = {r.name: r for r in tables.project_pool(spark, str(tmp_path / "p.json")).collect()}
    assert rows["A"].estimated_hours == 40 and rows["A"].suitable_stages == ["Student"] and rows["B"].tech_stack is None
    (tmp_path / "m.json").write_text(json.dumps({"SQL": {"category": "Data", "description": "tables", "importance_reason": "everywhere"}, "Go": {"category": "Lang"}}))
    known = {r.skill: tuple(r) for r in tables.skill_metadata(spark, str(tmp_path / "m.json")).collect()}
    assert known == {"SQL": ("SQL", "Data", "tables", "everywhere"), "Go": ("Go", "Lang", None, None)}
    (tmp_path / "t.txt").write_text("Say {x}.\nAnd more.\n")
    assert tables.prompt_template(spark, str(tmp_path / "t.txt")) == "Say {x}.\nAnd more.\n"


def plain_translated(value, names, values, dropped, path=""):
    if isinstance(value, dict):
        out = {}
        for k, v in value.items():
            p = f"{path}.{k}".lstrip(".")
            if p not in dropped:
                x = plain_translated(v, names, values, dropped, p)
                if x not in (None, "", [], {}):
                    out[names.get(p, k)] = x
        return out or None
    if isinstance(value, list):
        return [x for v in value if (x := plain_translated(v, names, values, dropped, path)) not in (None, "", [], {})] or None
    return values.get(path, {}).get(value, value)


def test_documents_are_translated_and_pruned(spark):
    docs = [
        {"role": "Dev", "note": "", "parts": [{"name": "a", "level": "High", "tags": ["x", ""]}, {"name": None, "level": "Odd", "tags": []}, {"name": None, "level": None, "tags": None}], "inner": {"deep": {"x": 1, "y": None}, "gone": "z"}},
        {"role": None, "note": None, "parts": [], "inner": {"deep": {"x": None, "y": None}, "gone": "only"}},
    ]
    schema = "role string, note string, parts array<struct<name: string, level: string, tags: array<string>>>, inner struct<deep: struct<x: int, y: int>, gone: string>"
    df = spark.createDataFrame([tuple([d["role"], d["note"], [tuple(p.values()) for p in d["parts"]], ((d["inner"]["deep"]["x"], d["inner"]["deep"]["y"]), d["inner"]["gone"])]) for d in docs], schema)
    names, values, dropped = {"role": "vai_trò", "parts": "phần", "parts.level": "mức", "inner.deep.x": "X"}, {"parts.level": {"High": "Cao"}}, {"inner.gone", "note.none"}
    got = [json.loads(r[0]) for r in df.select(documents.translated_document(df, names, values, dropped)).collect()]
    assert got == [plain_translated(d, names, values, dropped) or {} for d in docs]
    assert got[0]["phần"][0] == {"name": "a", "mức": "Cao", "tags": ["x"]} and got[1] == {}


def test_gap_documents_with_metadata(spark):
    owned = spark.createDataFrame([(1, "sql")], "candidate int, skill string")
    targets = spark.createDataFrame([(1, "D")], "candidate int, role string")
    m = spark.createDataFrame([("D", "sql", 90.0), ("D", "go", 75.0), ("D", "ml", 55.0), ("D", "x", 10.0)], "role string, skill string, frequency_pct double")
    known = spark.createDataFrame([("go", "Lang", "a language", "speed"), ("x", "Odd", "rare", "none"), ("sql", "Data", None, None)], "skill string, category string, description string, importance_reason string")
    doc = gap.gap_document(owned, targets, m, metadata=known).drop("candidate")
    got = json.loads(doc.select(documents.translated_document(doc, documents.PROMPT_NAMES, documents.PROMPT_VALUES, documents.PROMPT_DROPPED)).first()[0])
    assert got["vai_trò_mục_tiêu"] == "D" and got["điểm_mạnh"] == [{"skill": "sql", "frequency_pct": 90.0, "label": "Core", "category": "Data"}]
    assert got["khoảng_trống_quan_trọng"] == [{"skill": "go", "frequency_pct": 75.0, "label": "critical", "category": "Lang", "description": "a language"}]
    assert got["khoảng_trống_trung_bình"] == [{"skill": "ml", "frequency_pct": 55.0, "label": "medium"}]
    first = got["hành_động_cải_thiện"][0]
    assert first == {"mức_độ_ưu_tiên": "Cao", "kỹ_năng": "go", "hành_động": "Learn and practise go", "category": "Lang", "description": "a language", "importance_reason": "speed"}
    assert "optional_gaps" not in got and "extra_skills" not in got


def test_quarantine(spark):
    texts = [('{"a": 1}', "whole"), ('```json\n{"a": 1}\n```', "whole"), ('so {"a": 1} it is', "block"), ('{"a": [1, 2', "block"), ("{'a': True, b: None,}", "repaired"), ('{"a": 1 "b" 2 :}', "malformed"), ('{"a": ', "cut"), ("no value", "no_bracket"), ("  \n", "empty"), (None, "null")]
    rows = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(texts)], "i int, text string")
    good, bad = repair.repaired_and_rejected(rows, "text")
    got = {r.i: r.step for r in good.collect()} | {r.i: r.reason for r in bad.collect()}
    assert got == {i: want for i, (_, want) in enumerate(texts)} and good.columns == ["i", "text", "fixed", "step"] and bad.columns == ["i", "text", "reason"]
    assert {r.i: json.loads(r.fixed) for r in good.collect()}[4] == {"a": True, "b": None}


def test_severity_drift(spark):
    text = "intro Go\n# Khoảng trống quan trọng\n- SQL and Go\n## khoảng trống trung bình (2)\n- ML, Docker\n# Kế hoạch cải thiện\nML Go SQL"
    texts = spark.createDataFrame([(1, text), (2, "no headings"), (3, None), (None, text), (4, "# Điểm mạnh\nx")], "doc_id int, text string")
    gaps = spark.createDataFrame([(1, "SQL", "critical"), (1, "Docker", "critical"), (1, "Go", "medium"), (1, "ML", "medium"), (1, "x", "optional"), (2, "Go", "medium"), (4, "x", "critical"), (None, "Go", "medium")], "doc_id int, skill string, severity string")
    got = {r.doc_id: (r.drifted, r.issues) for r in evaluate.severity_drift(texts, gaps).collect()}
    assert got == {1: (True, ["Critical gap 'Docker' được nhắc ở section 'Trung bình'", "Medium gap 'Go' được nhắc ở section 'Quan trọng'"]), 2: (False, []), 3: (False, []), 4: (False, [])}
