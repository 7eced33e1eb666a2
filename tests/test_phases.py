"""Phases of missing skills with all their prerequisites, against a plain reading of the rules."""

import math
import random
from collections import deque

from skillweave.operators import roadmap
from skillweave.plans import fixtures as fx

NEEDS = {}
for s, d, kind, _ in fx.EDGES:
    if kind == "prerequisite":
        NEEDS.setdefault(s, []).append(d)


def plain(owned, missing, needs, max_per=5, min_per=2, most=6):
    learn = set(missing)
    for skill in missing:
        queue, seen = [skill], set()
        while queue:
            x = queue.pop()
            if x not in seen:
                seen.add(x)
                queue += [p for p in needs.get(x, ()) if p not in owned and p not in seen]
                learn |= {p for p in needs.get(x, ()) if p not in owned}
    learn -= owned
    depth, queue = dict.fromkeys(learn, 0), deque((o, 0) for o in owned)
    while queue:
        x, d = queue.popleft()
        for s in learn:
            if x in needs.get(s, ()) and d + 1 > depth[s]:
                depth[s] = d + 1
                queue.append((s, d + 1))
    order = sorted(learn, key=lambda s: (depth[s], s))
    if not order:
        return {}
    wanted = min(most, max(1, math.ceil(len(order) / max_per)))
    size = max(min_per, math.ceil(len(order) / wanted))
    phase = {s: i // size + 1 for i, s in enumerate(order)}
    moved = True
    while moved:
        moved = False
        for s in order:
            if any(p in phase and phase[p] > phase[s] for p in needs.get(s, ())):
                phase[s] += 1
                moved = True
    return {s: (phase[s], depth[s]) for s in order}


def test_expanded_phases(spark):
    r = random.Random(3)
    owned = {c: set(r.sample(fx.NODES, r.randint(0, 4))) for c in range(25)}
    missing = {c: set(r.sample(fx.NODES + ["poetry", "chess"], r.randint(0, 6))) for c in range(25)}
    rows = lambda sets: spark.createDataFrame([(c, s) for c, x in sets.items() for s in sorted(x)], "candidate int, skill string")
    for limits in ({}, {"max_per": 2, "min_per": 1, "max_phases": 4}):
        got = {c: {} for c in owned}
        phases = roadmap.expanded_phases(rows(owned), rows(missing), fx.edges(spark), **limits)
        for x in phases.collect():
            got[x.candidate][x.skill] = (x.phase, x.depth)
        assert got == {c: plain(owned[c], missing[c], NEEDS, limits.get("max_per", 5), limits.get("min_per", 2), limits.get("max_phases", 6)) for c in owned}
    first = next(c for c in got if len(got[c]) > 4)
    summary = roadmap.expanded_summary(phases).filter(f"candidate = {first}").orderBy("phase").collect()
    assert [s for x in summary for s in x.skills] == sorted(got[first], key=lambda s: (got[first][s][0], got[first][s][1], s))
    assert all(x.title == roadmap.TITLES[x.phase - 1] and x.skill_count == len(x.skills) for x in summary)
    assert roadmap.expanded_phases(rows({1: {"python"}}), rows({1: {"python"}}), fx.edges(spark)).count() == 0


def test_phases_of_prerequisites_in_a_circle(spark):
    ring = spark.createDataFrame([("a", "b", "prerequisite", 0), ("b", "c", "prerequisite", 0), ("c", "a", "prerequisite", 0), ("d", "a", "prerequisite", 0)], "src string, dst string, type string, ordinal int")
    rows = spark.createDataFrame([(1, "d", 1), (1, "a", 1), (1, "b", 2), (1, "c", 3), (1, "e", 1), (2, "d", 1)], "candidate int, skill string, phase int")
    got = {(x.candidate, x.skill): x.phase for x in roadmap.repaired_phases(rows, ring).collect()}
    assert got == {(1, "a"): 3, (1, "b"): 3, (1, "c"): 3, (1, "d"): 3, (1, "e"): 1, (2, "d"): 1}
