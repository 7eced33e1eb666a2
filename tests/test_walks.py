"""Walks over dense, long and cyclic graphs against plain searches; career roadmaps on top of them."""

import random
from collections import deque

import pytest
from pyspark.sql import functions as F

from skillweave.operators import transitions, walks


def graph(seed, n, p, acyclic=False):
    r = random.Random(seed)
    return sorted({(f"n{a:03}", f"n{b:03}") for a in range(n) for b in range(n) if a != b and r.random() < p and (a < b or not acyclic)})


def plain_reached(start, edges, barred=()):
    out, todo = {start: 0}, deque([start])
    while todo:
        x = todo.popleft()
        for a, b in edges:
            if a == x and b not in out and b not in barred:
                out[b] = out[x] + 1
                todo.append(b)
    return out


def table(spark, edges):
    return spark.createDataFrame(edges, "src string, dst string")


@pytest.mark.parametrize("seed, n, p", [(1, 30, 0.05), (2, 40, 0.4)])
def test_reached_from_many_starts(spark, seed, n, p):
    edges = graph(seed, n, p)
    starts = [(k, f"n{k * 3:03}") for k in range(6)] + [(None, "n001"), (7, None), (8, "nowhere")]
    barred = [(1, "n005"), (2, "n006"), (2, "n006"), (1, "n003")]
    got = walks.reached(spark.createDataFrame(starts, "k int, node string"), table(spark, edges + edges[:9]), ["k"], spark.createDataFrame(barred, "k int, node string"))
    found = {}
    for r in got.collect():
        found.setdefault(r.k, {})[r.node] = r.depth
    want = {k: plain_reached(s, edges, {b for i, b in barred if i == k}) for k, s in starts[:6]}
    assert found == want | {8: {"nowhere": 0}}


def test_a_chain_has_no_step_cap(spark):
    chain = [(f"c{i:03}", f"c{i + 1:03}") for i in range(40)]
    start = spark.createDataFrame([("x", "c000")], "k string, node string")
    assert walks.reached(start, table(spark, chain), ["k"]).agg(F.max("depth")).first()[0] == 40
    path = walks.shortest_paths(spark.createDataFrame([("c000", "c040"), ("c005", "c003"), ("c001", "zz"), ("zz", "c001"), ("c002", "c002")], "start string, goal string"), table(spark, chain))
    got = {(r.start, r.goal): r.path for r in path.collect()}
    assert got == {("c000", "c040"): [f"c{i:03}" for i in range(41)], ("c005", "c003"): ["c005", "c004", "c003"], ("c002", "c002"): ["c002"]}


def test_longest_chains(spark):
    edges = graph(5, 14, 0.5, acyclic=True)
    inside = {f"n{i:03}" for i in range(14) if i not in (4, 9)}

    def longest(x):
        return {x: 0} | {b: max(1 + d for c in [y for a, y in edges if a == x and y in inside] for e, d in longest(c).items() if e == b) for b in {e for c in [y for a, y in edges if a == x and y in inside] for e in longest(c)}}

    keys = spark.createDataFrame([(k, n) for k in (0, 4) for n in sorted(inside)], "k int, node string")
    got = {}
    for r in walks.farthest(spark.createDataFrame([(0, "n000"), (4, "n004")], "k int, node string"), table(spark, edges), ["k"], keys).collect():
        got.setdefault(r.k, {})[r.node] = r.depth
    assert got == {0: longest("n000"), 4: longest("n004")}
    ring = table(spark, [("a", "b"), ("b", "c"), ("c", "b")])
    with pytest.raises(walks.CyclicGraph):
        walks.farthest(spark.createDataFrame([(1, "a")], "k int, node string"), ring, ["k"], spark.createDataFrame([(1, "b"), (1, "c")], "k int, node string"))


def test_paths_of_a_dense_graph(spark):
    """Every pair of forty nodes, far more paths than could be listed."""
    edges = [e for e in graph(3, 40, 0.12) if e[0] < e[1]]
    both = sorted({(a, b) for a, b in edges} | {(b, a) for a, b in edges})
    nodes = sorted({a for a, _ in both})

    def plain(start, goal):
        away = plain_reached(goal, both)
        if start not in away:
            return None
        path = [start]
        while path[-1] != goal:
            path.append(min(b for a, b in both if a == path[-1] and away.get(b) == away[path[-1]] - 1))
        return path

    pairs = [(a, b) for a in nodes for b in nodes]
    got = {(r.start, r.goal): r.path for r in walks.shortest_paths(spark.createDataFrame(pairs, "start string, goal string"), table(spark, edges)).collect()}
    want = {k: p for k in pairs if (p := plain(*k))}
    assert got == want and max(map(len, want.values())) > 3


def test_career_roadmaps(spark):
    arc = "from string, to string, weight double, shared_skills array<string>, new_skills_needed array<string>"
    found = spark.createDataFrame([("A dev", "B dev", 0.5, ["s"], ["x", "a"]), ("C ops", "B dev", 0.4, ["q", "r"], ["z"]), ("B dev", "C ops", 0.3, ["q"], ["y"]), ("D far", "E far", 0.9, [], ["w"])], arc)
    matrix = spark.createDataFrame([("A dev", "s", 50.0), ("A dev", "t", 40.0), ("B dev", "s", 60.0), ("Z not in graph", "only", 90.0), ("C ops", "u", 31.0)], "role string, skill string, frequency_pct double")
    owned = spark.createDataFrame([(1, "s"), (1, "t"), (2, "only"), (2, "Ops"), (3, "nothing"), (5, "s"), (5, "t"), (6, "u"), (7, "s"), (7, "t")], "candidate int, skill string")
    targets = spark.createDataFrame([(1, " c OPS "), (2, "A dev"), (3, "B dev"), (4, "b dev"), (5, "A DEV"), (6, "E far"), (7, "Unknown"), (7, ""), (7, None)], "candidate int, role string")
    got = {r.candidate: r for r in transitions.career_roadmaps(owned, targets, found, matrix).collect()}
    assert got[1].path == ["A dev", "B dev", "C ops"] and got[1].total_new_skills == ["a", "q", "r", "x"] and got[1].target_role == " c OPS "
    assert [(s["from"], s.to, s.skills_to_learn) for s in got[1].steps] == [("A dev", "B dev", ["x", "a"]), ("B dev", "C ops", ["q", "r"])]
    assert got[2].start_role == "C ops" and got[2].path == ["C ops", "B dev", "A dev"] and got[2].total_new_skills == ["s", "z"]
    assert got[3].start_role == "A dev" and got[4].start_role == "A dev" and got[4].path == ["A dev", "B dev"]
    assert (got[5].path, got[5].steps) == (["A dev"], []) and got[6].path == [] and got[7].path == [] and len(got) == 7
