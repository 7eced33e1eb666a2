"""Operator 6: exact top-k inner-product search by MaxScore over sharded postings.

Vectors are sparse-vector style documents whose terms are dimensions: a shard keeps one postings array per dimension (the
value of every vector of the shard) and the dimension's extremes. For a query, a dimension can move a score between the
smaller and the larger of weight times extreme; those are its bounds. Dimensions are ranked by how far they can move a
score. Measured from the lower bounds every posting is non-negative, so MaxScore's split applies: the trailing dimensions
whose joint swing cannot lift a vector over the k-th score so far are non-essential. Essential postings are traversed for all vectors of the shard, vectors whose sum plus the bound of what is
left cannot reach the k-th score fall out, and the rest are probed dimension by dimension while they stay competitive.
Shards then merge by score and id.

Every task holds one shard (about SHARD vectors) and one block of queries (about BLOCK), whatever the table's size.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from skillweave.llm.common import stored, table

SHARD = 8192
BLOCK = 4096
#: Vectors of a shard that are scored in full to set the first threshold.
SEED_ROWS = 256
#: Dimensions probed between two prunings.
PROBE = 4


def finite(vector: Column) -> Column:
    """Not null, and every component a finite number."""
    good = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return vector.isNotNull() & F.coalesce(good, F.lit(False))


def maxscore(ids: np.ndarray, rows: np.ndarray, postings: np.ndarray, low: np.ndarray, high: np.ndarray, own_row: int, query: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The shard's k best (id, score) for one query, ties to the smaller id; postings has a row per dimension.

    rows number the vectors; the one numbered own_row is the query itself.
    """
    n = len(ids)
    a, b = query * low, query * high
    least, most = np.minimum(a, b), np.maximum(a, b)
    order = np.argsort(least - most, kind="stable")
    rest = np.concatenate([np.cumsum(most[order][::-1])[::-1], [0.0]])
    own = rows == own_row
    seed = np.flatnonzero(~own[:SEED_ROWS])
    scores = query @ postings[:, seed]
    floor = np.partition(scores, len(scores) - k)[len(scores) - k] if len(scores) >= k else -np.inf
    swing = np.concatenate([np.cumsum((most - least)[order][::-1])[::-1], [0.0]])
    essential = int(np.count_nonzero(least.sum() + swing[:-1] >= floor))
    head = order[:essential]
    total = query[head] @ postings[head]
    alive = np.flatnonzero((total + rest[essential] >= floor) & ~own)
    total = total[alive]
    at = essential
    while at < len(order) and len(alive):
        dims = order[at : at + PROBE]
        total = total + query[dims] @ postings[dims][:, alive]
        at += len(dims)
        if len(alive) > k:
            keep = total + rest[min(at, len(order))] >= floor
            alive, total = alive[keep], total[keep]
    best = np.lexsort((ids[alive], -total))[:k]
    return ids[alive][best], total[best]


def _matrix(lists, width: int) -> np.ndarray:
    out = np.zeros((len(lists), width))
    for i, x in enumerate(lists):
        out[i, : len(x)] = x
    return out


def _whole_numbers(left: pd.DataFrame, right: pd.DataFrame, k: int) -> pd.DataFrame:
    """The k highest scores of each query of right in left, by Python's integers."""
    out = []
    terms = [[int(c) for c in x] for x in left["terms"]]
    for query, query_id, row, own in zip(right["query"], right["vec_id"], right["row"], right["terms"]):
        own = [int(c) for c in own]
        scores = sorted((-sum(a * b for a, b in zip(own, x)), vec_id) for x, vec_id, r in zip(terms, left["vec_id"], left["row"]) if r != row)[:k]
        out += [(query, query_id, vec_id, -s) for s, vec_id in scores]
    if any(not -(2**63) <= s < 2**63 for *_, s in out):
        raise OverflowError("a score is not a long")
    return pd.DataFrame(out, columns=["query", "query_id", "vec_id", "score"])


def top_k(vectors: DataFrame, queries: DataFrame, k: int, shard: int = SHARD, block: int = BLOCK) -> DataFrame:
    """(query_id, rank, vec_id, score): for each row of queries the k highest inner products with rows of vectors.

    Both need vec_id and terms (array of long, without nulls); a shorter array has zeros at its end. A query is never
    matched with its own row: the one of the same number in a column row (long), where vectors has one, else all of its
    vec_id. Ties go to the smaller id; repeated rows count as rows, as candidates and as queries. Other columns are
    ignored. Queries against an empty table, and no queries, give no rows. Where sums may pass 2**53, whole numbers of any
    size are added up instead; a score that no long holds raises OverflowError.
    """
    row = F.col("row" if "row" in vectors.columns else "vec_id").cast("long").alias("row")
    vectors, queries = stored(vectors.select("vec_id", row, "terms"), "vectors"), queries.select("vec_id", row, "terms")
    # Equal rows of queries are told apart by their own number, which is stored with them.
    queries = stored(queries.withColumn("query", F.monotonically_increasing_id()), "queries")
    shards, blocks = max(1, -(-vectors.count() // shard)), max(1, -(-queries.count() // block))
    width = vectors.select(F.max(F.size("terms"))).first()[0] or 0
    width = max(width, queries.select(F.max(F.size("terms"))).first()[0] or 0)
    number = lambda n: F.pmod(F.xxhash64("row", "terms"), F.lit(n))
    spread = lambda rows, own, other, n, m: rows.select("*", number(n).alias(own), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(m - 1).cast("long"))).alias(other))
    schema = "query long, query_id long, vec_id long, score long"

    def search(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if not len(left) or not len(right):
            return pd.DataFrame({c: pd.Series(dtype="int64") for c in ("query", "query_id", "vec_id", "score")})
        ids, rows = left["vec_id"].to_numpy(np.int64), left["row"].to_numpy(np.int64)
        most = lambda lists: max((abs(int(c)) for x in lists if len(x) for c in (min(x), max(x))), default=0)
        if most(left["terms"]) * most(right["terms"]) * max(1, width) >= 2**53:
            return _whole_numbers(left, right, k)
        m = _matrix(left["terms"], width)
        low, high = m.min(axis=0), m.max(axis=0)
        postings = np.ascontiguousarray(m.T)
        out = [maxscore(ids, rows, postings, low, high, r, v, k) for r, v in zip(right["row"].to_numpy(np.int64), _matrix(right["terms"], width))]
        sizes = [len(x) for x, _ in out]
        asked = {"query": np.repeat(right["query"].to_numpy(np.int64), sizes), "query_id": np.repeat(right["vec_id"].to_numpy(np.int64), sizes)}
        return pd.DataFrame(asked | {"vec_id": np.concatenate([x for x, _ in out]), "score": np.concatenate([s for _, s in out]).astype(np.int64)})

    left = spread(vectors, "shard", "block", shards, blocks).groupBy("shard", "block")
    right = spread(queries, "block", "shard", blocks, shards).groupBy("shard", "block")
    found = left.cogroup(right).applyInPandas(search, schema)
    rank = F.row_number().over(W.partitionBy("query").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op6_topk_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings").select("vec_id", "embedding").filter(F.col("vec_id").isNotNull() & finite(F.col("embedding")))
    terms = F.transform("embedding", lambda x: F.floor(x.cast("double") * 256).cast("long"))
    rows = stored(rows.select("vec_id", F.monotonically_increasing_id().alias("row"), terms.alias("terms")), "terms")
    return top_k(rows, rows.filter("vec_id % 50 = 0"), k=5)


_SQL = """
WITH v AS (
  SELECT vec_id, row_number() OVER () AS r, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS t FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT q.vec_id AS query_id, q.r, c.vec_id, CAST(list_inner_product(q.t, c.t) AS BIGINT) AS score
  FROM v q JOIN v c ON q.r <> c.r WHERE q.vec_id % 50 = 0
)
SELECT query_id, rank, vec_id, score FROM (
  SELECT *, CAST(row_number() OVER (PARTITION BY r ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s
) WHERE rank <= 5
"""

QUERIES = {"op6_topk_search": op6_topk_search}
ORACLES = {"op6_topk_search": _SQL}
