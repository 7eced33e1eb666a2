import json
import string

import pandas as pd
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from skillweave.functions import sets, text
from skillweave.functions.repair import repair


def one(spark, *columns, **values):
    schema = ", ".join(f"{k} {'array<string>' if isinstance(v, list) else 'string' if v is None or isinstance(v, str) else 'long'}" for k, v in values.items())
    return spark.createDataFrame([tuple(values.values())], schema).select(*columns).first()


def test_jaccard_and_coverage(spark):
    a, b = F.col("a"), F.col("b")
    r = one(spark, sets.jaccard(a, b), sets.coverage(a, b), sets.jaccard(F.col("e"), b), sets.coverage(a, F.col("e")), sets.jaccard_folded(F.transform(a, F.upper), b), a=["x", "y"], b=["y", "z"], e=[])
    assert tuple(r) == (1 / 3, 0.5, 0.0, 0.0, 1 / 3)


def test_title_case_is_pythons(spark):
    for s in ("ux/ui front-end", "node.js dev", "c++ LEAD", "", "kỹ sư phần mềm"):
        assert one(spark, text.title_case(F.col("t")), t=s)[0] == s.title()


def test_trailing_number_and_keys(spark):
    assert one(spark, text.trailing_number(F.col("t")), t="RES_12_0034")[0] == 34
    assert one(spark, text.trailing_number(F.col("t")), t="none")[0] == 0
    assert one(spark, text.surrogate_key("DOC", F.col("n"), F.col("c")), n=7, c=12)[0] == "DOC_0007"
    assert one(spark, text.surrogate_key("DOC", F.col("n"), F.col("c")), n=7, c=123456)[0] == "DOC_000007"


def test_fields(spark):
    t = "Ann\nann.b@example.org 0912345678 github.com/ann.b linkedin.com/in/ann-b see https://x.example/a CPA: 3.52/4.0"
    r = one(spark, *text.contact_fields(F.col("t")), t=t)
    assert r.email == "ann.b@example.org" and r.phone == "0912345678" and r.github == "https://github.com/ann.b"
    assert r.linkedin == "https://linkedin.com/in/ann-b" and r.urls == ["https://x.example/a"] and r.gpa == "3.52/4.0"
    assert one(spark, *text.contact_fields(F.col("t")), t="call +84 91 234 5678, a 1.5/2").phone == "+84 91 234 5678" and one(spark, *text.contact_fields(F.col("t")), t="x 3.5/4.0").gpa is None
    assert one(spark, *text.contact_fields(F.col("t")), t=None).email is None


def test_percentages_and_tokens(spark):
    assert one(spark, text.percentages(F.col("t")), t="50% and 12,5 % or 3.5%")[0] == [50.0, 12.5, 3.5]
    assert one(spark, text.token_estimate(F.col("t")), t="a b c d e")[0] == 6


def test_terms_respect_borders(spark):
    docs = spark.createDataFrame([(1, "We use C++, machine-learning and Node.js."), (2, None), (3, "maintain")], "doc_id int, text string")
    onto = spark.createDataFrame([("c++", "C++"), ("machine learning", "ML"), ("node.js", "Node.js"), ("ai", "AI")], "alias string, canonical string")
    found = {tuple(r) for r in text.extract_terms(docs, onto).collect()}
    assert found == {(1, "C++"), (1, "ML"), (1, "Node.js")}


def test_terms_by_canonical_name_and_of_any_length(spark, monkeypatch):
    docs = spark.createDataFrame([(1, "Apache Spark. And. the very long name of it"), (2, "spark sql"), (3, "...")], "doc_id int, text string")
    onto = spark.createDataFrame([("pyspark", "Apache Spark"), ("very long name of it", "VL"), ("sql", "SQL"), ("...", "dots")], "alias string, canonical string")
    want = {(1, "Apache Spark"), (1, "VL"), (2, "SQL")}
    assert {tuple(r) for r in text.extract_terms(docs, onto).collect()} == want
    monkeypatch.setattr(text, "TERMS_BOUND", 2)
    assert {tuple(r) for r in text.extract_terms(docs, onto).collect()} == want
    assert text.extract_terms(docs, onto.limit(0)).count() == 0


def test_markdown_and_queries(spark):
    docs = spark.createDataFrame([(1, "intro\n# Điểm mạnh\ngood\nmore\n## other\nstill\n#  Lộ trình x\nstep\nđiểm mạnh no heading"), (2, None)], "doc_id int, text string")
    out = {(r.doc_id, r.section): r.content for r in text.markdown_sections(docs, {"điểm mạnh": "strengths", "lộ trình": "path"}).collect()}
    assert out == {(1, "strengths"): "good\nmore\n## other\nstill", (1, "path"): "step\nđiểm mạnh no heading"}
    assert one(spark, text.enriched_query(F.col("q"), F.col("d"), {"web": "Web role"}), q="me", d="web")[0] == "Web role. me"
    assert one(spark, text.enriched_query(F.col("q"), F.col("d"), {"web": "Web role"}), q="me", d=None)[0] == "me"

@settings(max_examples=60, deadline=None)
@given(st.recursive(st.none() | st.booleans() | st.integers() | st.text(string.ascii_letters + " ,'", max_size=8), lambda x: st.lists(x, max_size=3) | st.dictionaries(st.text(string.ascii_letters, min_size=1, max_size=5), x, max_size=3), max_leaves=8))
def test_json_repair_keeps_valid_json(value):
    assert json.loads(repair(json.dumps(value))) == value
    assert json.loads(repair(f"Here:\n```json\n{json.dumps(value)}\n```")) == value


def test_json_repair_mends():
    assert json.loads(repair('{"a": [1, 2,], "b": True,}')) == {"a": [1, 2], "b": True}
    assert json.loads(repair("text {'a': 'x', b: None} more")) == {"a": "x", "b": None}
    assert json.loads(repair('{"a": "line\nbreak", "b": [1')) == {"a": "line\nbreak", "b": [1]}
    assert repair("nothing here") is None and repair(None) is None



def test_ratio_is_difflibs(spark):
    from difflib import SequenceMatcher

    from skillweave.operators.fuzzy import ratio

    pairs = [("tide", "diet"), ("diet", "tide"), ("React.js", "ReactJS"), ("", "a"), ("same", "SAME")]
    got = spark.createDataFrame(pairs, "a string, b string").select(ratio("a", "b").alias("r")).toPandas()["r"]
    assert list(got) == [SequenceMatcher(None, a.lower(), b.lower()).ratio() * 100 for a, b in pairs]
    assert isinstance(got, pd.Series)
