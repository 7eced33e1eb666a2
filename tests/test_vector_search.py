"""Vector search in blocks against the score's definition, pair by pair."""

import os

import numpy as np
import pytest
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from skillweave.operators import matching
from skillweave.plans import catalogue
from skillweave.session import table

SF = "/root/testdata/sf0.001"
NAN = float("nan")


def by_pairs(v, q, k):
    """Every pair's cosine by Spark's expressions; 1 where it is no number."""
    unit = lambda c: F.transform(c, lambda x: F.try_divide(x.cast("double"), F.sqrt(matching.dot(c, c))))
    pairs = v.join(q.withColumnRenamed("embedding", "asked"), F.col("id") != F.col("query_id"))
    score = F.round(F.greatest(F.lit(0.0), F.least(F.lit(1.0), matching.dot(unit(F.col("asked")), unit(F.col("embedding"))))), 4)
    score = F.when((F.size("asked") == 0) | (F.size("embedding") == 0), 1.0).otherwise(score)
    rank = F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("score"), "id"))
    rows = pairs.select("query_id", "id", score.alias("score")).withColumn("rank", rank).filter(F.col("rank") <= k)
    return sorted(map(tuple, rows.select("query_id", "rank", "id", "score").collect()))


@pytest.mark.parametrize("kind", ["random", "odd", "copies"])
def test_vector_search_equals_every_pair(spark, monkeypatch, kind):
    for name, value in (("SHARD", 90), ("BLOCK", 20), ("TILE", 16), ("WAYS", 7), ("PAIRS", 50)):
        monkeypatch.setattr(matching, name, value)
    rng = np.random.default_rng(7)
    rows = [(i, [float(x) for x in np.float32(rng.normal(size=5))]) for i in range(300)]
    if kind == "odd":
        for i, x in enumerate([None, [], [0.0] * 5, [1.0, None, 0.0, 0.0, 2.0], [NAN, 1.0, 1.0, 1.0, 1.0], [1.0, 2.0], [3.0, 1.0], [float("inf"), 1.0, 1.0, 1.0, 1.0]]):
            rows[37 * i] = (37 * i, x)
    if kind == "copies":
        rows = [(i, rows[i % 3][1] if i % 5 else [float(i % 2), 1.0, -1.0, 0.5, 0.25]) for i, _ in rows]
    v = spark.createDataFrame([*rows, (None, [1.0] * 5)], "id long, embedding array<float>")
    q = v.filter("id % 37 = 0 OR id % 11 = 0").select(F.col("id").alias("query_id"), "embedding")
    for k in (1, 6, 400):
        assert sorted(map(tuple, matching.vector_top_k(v, q, k).collect())) == by_pairs(v, q, k), (kind, k)
    assert matching.vector_top_k(v, q.filter("false"), 3).count() == 0


def test_vector_search_names_few_pairs(spark, monkeypatch):
    """Pairs of the search are products of tiles; only those that may be among the best are summed one by one."""
    v = np.random.default_rng(3).normal(size=(4096, 16))
    v /= np.linalg.norm(v, axis=1)[:, None]
    summed, pair_scores = [], matching._pair_scores
    monkeypatch.setattr(matching, "_pair_scores", lambda *a: summed.append(len(a[2])) or pair_scores(*a))
    ids, wide = np.arange(4096), np.full(4096, 16)
    row, query, score = matching._best(v, wide, ids, v[:64], wide[:64], ids[:64], 5, 256, 1 << 20)
    near = np.round(np.clip(v @ v[:64].T, 0, 1), 4)
    near[ids[:64], ids[:64]] = -1
    assert all(row[query == j].tolist() == np.lexsort((ids, -near[:, j]))[:5].tolist() for j in range(64)) and sum(summed) < 64 * 4096 / 50


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
def test_rerank_makes_the_brands_of_found_rows_only(spark, monkeypatch):
    def of_all(*_):
        raise AssertionError("brands of every order were asked for")

    found = [(0, i, 0.5 + i / 1000) for i in range(1, 60)] + [(100, 7, 0.9), (100, 10**9, 0.8)]
    monkeypatch.setattr(catalogue, "_brands", of_all)
    monkeypatch.setattr(catalogue, "_near", lambda s, d, k: s.createDataFrame(found, "query_id long, id long, score double"))
    lines, part = (table(spark, SF, n).collect() for n in ("lineitem", "part"))
    brand, owned = {p.p_partkey: p.p_brand for p in part}, {}
    for x in lines:
        owned.setdefault(x.l_orderkey, set()).add(brand[x.l_partkey])
    want = {}
    for q, i, sem in found:
        have = owned.get(i, set())
        want.setdefault(q, []).append((-round(0.6 * sem + 0.4 * min(1, len(have) / 5) * min(1, len(have & {"Brand#11", "Brand#22", "Brand#33"}) / 3), 4), i))
    got = {(r.query_id, r["rank"]): (-r.score, r.id) for r in catalogue.QUERIES["q_hybrid_rerank"](spark, SF).collect()}
    assert got == {(q, n + 1): x for q, rows in want.items() for n, x in enumerate(sorted(rows)[:20])}
