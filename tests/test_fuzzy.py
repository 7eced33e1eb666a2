"""Near names: bounds against every pair, tiers of normalisation, components, and an ontology mined in passes."""

import random
from difflib import SequenceMatcher

from pyspark.sql import functions as F

from skillweave.operators import fuzzy, walks


def near(a, b):
    return SequenceMatcher(None, a.lower(), b.lower()).ratio() * 100


def spelled(r, word):
    i = r.randrange(len(word))
    return r.choice([word[:i] + word[i + 1 :], word[:i] + r.choice("abcxyz") + word[i:], word[:i] + word[i : i + 2][::-1] + word[i + 2 :], word.upper(), word])


WORDS = ["kubernetes", "postgresql", "javascript", "typescript", "react native", "machine learning", "deep learning", "docker", "c++", "c#", "go", "node.js", "tensorflow", "pytorch"]


def test_bounds_lose_no_pair(spark):
    r = random.Random(1)
    names = sorted({spelled(r, r.choice(WORDS)) for _ in range(120)} - {""})
    df = spark.createDataFrame([(n, i) for i, n in enumerate(names)], "name string, ordinal int")
    for threshold in (85.0, 60.0):
        got = {(x.a, x.b) for x in fuzzy.similar_pairs(df, threshold).collect()}
        assert got == {(a, b) for i, a in enumerate(names) for b in names[i + 1 :] if near(a, b) >= threshold}


def test_tiers_of_normalisation(spark):
    r = random.Random(4)
    ontology = [(w, w.title()) for w in WORDS] + [("js", "Javascript"), ("k8s", "Kubernetes"), ("js", "Later")]
    raw = [spelled(r, r.choice(WORDS)) for _ in range(80)] + [" JS ", "k8s", "cooking", "", None, "Cooking ", "golangs"]
    rows = spark.createDataFrame([(i, s) for i, s in enumerate(raw)], "record_id int, skill string")
    aliases = spark.createDataFrame([(a, c, i) for i, (a, c) in enumerate(ontology)], "alias string, canonical string, ordinal int")
    got = {x.record_id: (x.canonical, x.found) for x in fuzzy.normalized_skills(rows, aliases).collect()}
    first = {}
    for a, c in ontology:
        first.setdefault(a, c)
    want = {}
    for i, s in enumerate(raw):
        low = (s or "").strip().lower()
        if not low:
            continue
        best, at = 0.0, None
        for a, c in first.items():
            if near(low, a) >= 85 and near(low, a) > best:
                best, at = near(low, a), c
        want[i] = (first[low], "exact") if low in first else (at, "near") if at else (s.strip(), "own")
    assert got == want and {f for _, f in got.values()} == {"exact", "near", "own"}


def test_record_skills(spark):
    aliases = spark.createDataFrame([("js", "JavaScript", 0), ("kubernetes", "Kubernetes", 1), ("sql", "SQL", 2)], "alias string, canonical string, ordinal int")
    records = spark.createDataFrame([("r1", "JS dev", "We use SQL.", ["kubernets", " chess "]), ("r2", None, None, None), ("r3", "Cook", "sql sql", [])], "record_id string, title string, description string, skills_raw array<string>")
    got = {x.record_id: x.skills for x in fuzzy.record_skills(records, aliases).collect()}
    assert got == {"r1": ["JavaScript", "Kubernetes", "SQL", "chess"], "r2": [], "r3": ["SQL"]}


def test_components_of_chains_and_stars(spark):
    r = random.Random(6)
    nodes = list(range(60))
    edges = [(i, i + 1) for i in range(20)] + [(30, k) for k in range(31, 45)] + [(r.randrange(45, 60), r.randrange(45, 60)) for _ in range(6)]
    root = {n: n for n in nodes}
    for _ in nodes:
        for a, b in edges:
            root[a] = root[b] = min(root[a], root[b])
    df = spark.createDataFrame([(f"n{i}", i) for i in nodes], "node string, ordinal long")
    got = {x.node: x.root for x in walks.components(df, spark.createDataFrame([(f"n{a}", f"n{b}") for a, b in edges], "a string, b string")).collect()}
    assert got == {f"n{i}": root[i] for i in nodes}


def test_ontology_settles(spark):
    manual = spark.createDataFrame([("k8s", "Kubernetes"), ("js", "JavaScript")], "alias string, canonical string")
    seeds = spark.createDataFrame([("Docker",), ("SQL",), ("kubernetes",)], "skill string")
    raw = [["Dockerr", "docker"], ["sql", "k8s"], ["Pandas", "pandas"], ["Pandass"], ["Pandas", "JS"], ["SQL", "Dockers"]]
    records = spark.createDataFrame([(f"r{i}", None, "uses kubernetes" if i == 1 else None, x) for i, x in enumerate(raw)], "record_id string, title string, description string, skills_raw array<string>")
    ontology, groups, passes = fuzzy.iterated_ontology(records, manual, seeds, iterations=5)
    again, _, more = fuzzy.iterated_ontology(records, manual, seeds, iterations=passes + 1)
    found = {r.alias: r.canonical for r in ontology.collect()}
    assert passes < 5 and more == passes and found == {r.alias: r.canonical for r in again.collect()}
    assert found["k8s"] == "Kubernetes" and found["kubernetes"] == "kubernetes" and found["pandas"] == "Pandas" == found.get("pandass", "Pandas") and found["docker"] == "Docker"
    one, grouped, _ = fuzzy.iterated_ontology(records, manual, seeds, iterations=1)
    assert {r.name: r.canonical for r in grouped.collect()}["Pandass"] == "Pandas"
    master = {r.skill: (r.frequency, r.aliases) for r in fuzzy.skills_master(one, grouped).collect()}
    assert master["Pandas"] == (4, ["pandass"]) and "js" in master["JavaScript"][1] and sum(f for f, _ in master.values()) == grouped.agg(F.sum("frequency")).first()[0]
