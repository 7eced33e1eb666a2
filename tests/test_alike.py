"""Work done once for all candidates of one state."""

import os

import pytest
from pyspark.sql import functions as F

from skillweave.operators import alike, insights, roadmap
from skillweave.plans import catalogue, graph_catalogue

SF = "/root/testdata/sf0.001"


def test_candidates_of_one_state_share_their_rows(spark, monkeypatch):
    monkeypatch.setattr(alike, "CHUNK", 3)
    owned = [(c, s) for c in range(1, 20) for s in ("a", "b")[: c % 3]] + [(20, "a"), (20, "a"), (20, None), (99, "a"), (None, "b")]
    targets = [(c, "x") for c in range(20)] + [(20, "x"), (20, "y"), (21, None), (22, "y"), (22, "y"), (None, "x")]
    owned, targets = spark.createDataFrame(owned, "candidate int, skill string"), spark.createDataFrame(targets, "candidate int, role string")
    seen = []

    def work(o, t):
        seen.append((t.count(), o.count()))
        return t.join(o, "candidate", "left").groupBy("candidate").agg(F.array_sort(F.collect_list(F.concat_ws("-", "role", "skill"))).alias("all"), F.count("skill").alias("n"))

    got = {tuple(r) for r in alike.for_each_state(owned, targets, work).select("candidate", F.concat_ws(",", "all"), "n").collect()}
    want = work(owned.dropna().distinct(), targets.filter("candidate IS NOT NULL")).select("candidate", F.concat_ws(",", "all"), "n").collect()
    assert got == {tuple(r) for r in want} and len(got) == len(want) == 23
    # x with none, a or both; x and y with a; null; y twice.
    assert seen[0] == (8, 4)


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
def test_projection_is_worked_out_once_for_each_state(spark, monkeypatch):
    plain, walked = roadmap.graph_projection, []
    monkeypatch.setattr(roadmap, "graph_projection", lambda skills, *rest: walked.append(skills.select("candidate").distinct().count()) or plain(skills, *rest))
    query = catalogue.QUERIES["q_graph_projection"]
    got = sorted(map(tuple, query(spark, SF).collect()))
    own, to, _ = graph_catalogue._all(spark, SF)
    rows = to.join(own.groupBy("candidate").agg(F.array_sort(F.collect_set("skill")).alias("mine")), "candidate", "left")
    assert walked == [rows.select("role", "mine").distinct().count()] and walked[0] < rows.count()
    monkeypatch.setattr(alike, "for_each_state", lambda owned, targets, work: work(owned, targets))
    assert got == sorted(map(tuple, query(spark, SF).collect())) and walked[1] == rows.count()


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
def test_roadmaps_are_worked_out_once_for_each_state(spark, monkeypatch):
    plain, walked = insights.full_roadmap, []
    monkeypatch.setattr(insights, "full_roadmap", lambda owned, targets, *rest: walked.append(targets.count()) or plain(owned, targets, *rest))
    got = catalogue.QUERIES["q_full_roadmap"](spark, SF).collect()
    own, to, _ = graph_catalogue._all(spark, SF)
    rows = to.join(own.groupBy("candidate").agg(F.array_sort(F.collect_set("skill")).alias("mine")), "candidate", "left").collect()
    state = {r.candidate: (r.role, r.candidate % 4, tuple(r.mine or ())) for r in rows}
    assert sorted(r.candidate for r in got) == sorted(state) and walked == [len(set(state.values()))] and walked[0] < len(state)
    assert len({(state[r.candidate], r.document) for r in got}) == walked[0] and all(r.role == state[r.candidate][0] for r in got)
