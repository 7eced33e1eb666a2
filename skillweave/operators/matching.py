"""Job matching and vector search: cosine scores, hybrid ranking, keyword bonuses."""

from __future__ import annotations

from decimal import ROUND_HALF_UP, Decimal

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from skillweave.functions.sets import coverage, jaccard, saturating_coverage

SEMANTIC_SHARE, SKILL_SHARE = 0.7, 0.3
SEARCH_SEMANTIC, SEARCH_SKILL = 0.6, 0.4
#: Rows and queries that one task of a vector search holds; of these, rows and queries of one product, and pairs summed at once.
SHARD, BLOCK = 32_768, 4096
TILE, WAYS, PAIRS = 4096, 1024, 1 << 20


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    """Cosine in double precision; null for a zero vector."""
    return F.try_divide(dot(a, b), F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)))


def _matrix(column) -> tuple[np.ndarray, np.ndarray]:
    """Unit vectors of an Arrow list column as rows, zeros after their ends, and their widths.

    Rows of NaN stand for vectors without a direction: null, empty, zero, of no finite length, or holding null or NaN.
    """
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    width = pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    out = np.zeros((len(width), int(width.max(initial=0))))
    place = np.arange(width.sum()) - np.repeat(np.cumsum(width) - width, width)
    out[np.repeat(np.arange(len(width)), width), place] = pc.list_flatten(column).cast(pa.float64()).to_numpy(zero_copy_only=False)
    square = np.zeros(len(out))
    with np.errstate(all="ignore"):
        for x in out.T:
            square += x * x
        out /= np.where((square > 0) & np.isfinite(square), np.sqrt(square), np.nan)[:, None]
    out[width == 0] = np.nan
    return out, width


def _pair_scores(v: np.ndarray, q: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """The cosine of pairs of unit vectors, summed component by component, within 0..1; 1 where it is no number."""
    total = np.zeros(len(i))
    for d in range(v.shape[1]):
        total += v[i, d] * q[j, d]
    return np.where(np.isnan(total), 1.0, np.clip(total, 0.0, 1.0))


def _rounded(score: np.ndarray) -> np.ndarray:
    """Ten-thousandths, half up by the shortest decimal form of the score."""
    scaled = score * 1e4
    out = np.floor(scaled + 0.5)
    close = np.flatnonzero(np.abs(scaled - np.floor(scaled) - 0.5) < 1e-6)
    if len(close):
        values, at = np.unique(score[close], return_inverse=True)
        out[close] = np.array([float(Decimal(repr(float(x))).quantize(Decimal("0.0001"), ROUND_HALF_UP).scaleb(4)) for x in values])[at]
    return out


def _best(v: np.ndarray, wide: np.ndarray, ids: np.ndarray, q: np.ndarray, q_wide: np.ndarray, q_ids: np.ndarray, k: int, tile: int, most: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, query, score) of the k rows of best rounded score for each query, ties to the smaller id; ids ascend.

    Tiles of products name the pairs that may be among the best; these are summed and rounded again, exactly as the score is
    defined. As ids ascend, a later row has to beat the rounded score of the k-th row so far.
    """
    m = len(q)
    row = query = np.zeros(0, np.int64)
    score = rank = np.zeros(0)
    floor, uneven = np.full(m, -np.inf), len(np.unique(np.concatenate([wide, q_wide]))) > 1
    clash = np.isin(ids, q_ids)
    for at in range(0, len(v), tile):
        with np.errstate(invalid="ignore"):
            near = v[at : at + tile] @ q.T
        if uneven:
            near[wide[at : at + tile, None] != q_wide] = np.nan
        near[np.isnan(near)] = 1.0
        np.clip(near, 0.0, 1.0, out=near)
        for i in np.flatnonzero(clash[at : at + tile]):
            near[i, q_ids == ids[at + i]] = -1.0
        least = floor
        if at == 0 and len(near) > k:
            least = np.partition(near, len(near) - k, axis=0)[len(near) - k] - 1e-4 - 1e-9
        i, j = np.nonzero(near >= np.maximum(least, 0.0))
        for part in range(0, max(1, len(i)), most):
            x, y = i[part : part + most] + at, j[part : part + most]
            new = _pair_scores(v, q, x, y)
            if uneven:
                new[wide[x] != q_wide[y]] = 1.0
            row, query, score, rank = np.concatenate([row, x]), np.concatenate([query, y]), np.concatenate([score, new]), np.concatenate([rank, _rounded(new)])
            order = np.lexsort((row, -rank, query))
            row, query, score, rank = row[order], query[order], score[order], rank[order]
            keep = np.arange(len(query)) - np.searchsorted(query, query) < k
            row, query, score, rank = row[keep], query[keep], score[keep], rank[keep]
        full = np.flatnonzero(np.bincount(query, minlength=m) >= k)
        floor = np.full(m, -np.inf)
        floor[full] = (rank[np.searchsorted(query, full) + k - 1] + 0.5) * 1e-4 - 1e-9
    return row, query, score


def vector_top_k(vectors: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """(query_id, rank, id, score): the k rows most similar to each query; vectors (id, embedding), queries (query_id, embedding).

    Rows are dealt to shards and queries to blocks, and every block meets every shard under a key of its own, so no task
    holds more than one of each; a shard sends on its best k rows for each query. The score is the sum of the products of
    the unit vectors' components in their order, in double precision, within 0..1; it is 1 for vectors of different widths
    or without a direction (null, empty, zero, holding what is no finite number), as least and greatest take no number for 1. Scores
    are rounded to four decimals, half up; ties go to the smaller id. A row is no match of the query of its own id; null ids
    take no part.
    """
    v, q = vectors.select("id", "embedding").filter("id IS NOT NULL"), queries.select("query_id", F.col("embedding").alias("asked")).filter("query_id IS NOT NULL")
    shards, blocks = max(1, -(-v.count() // SHARD)), max(1, -(-q.count() // BLOCK))
    number = lambda c, m: F.pmod(F.xxhash64(c), F.lit(m)).cast("int")
    each = lambda m: F.explode(F.sequence(F.lit(0), F.lit(m - 1)))
    tile, ways, pairs = TILE, WAYS, PAIRS
    v = v.withColumn("shard", number("id", shards)).withColumn("block", each(blocks))
    q = q.withColumn("block", number("query_id", blocks)).withColumn("shard", each(shards))

    def best(left: pa.Table, right: pa.Table) -> pa.Table:
        left = left.sort_by("id")
        named = pc.rank(pa.chunked_array([*left["id"].chunks, *right["query_id"].chunks], left["id"].type), "ascending", tiebreaker="dense").to_numpy(zero_copy_only=False).astype(np.int64)
        (rows, wide), (asked, q_wide) = _matrix(left["embedding"]), _matrix(right["asked"])
        most = max(rows.shape[1], asked.shape[1])
        rows, asked = (np.pad(x, ((0, 0), (0, most - x.shape[1])), constant_values=0.0) for x in (rows, asked))
        rows[wide == 0], asked[q_wide == 0] = np.nan, np.nan
        out = [_best(rows, wide, named[: len(rows)], asked[b : b + ways], q_wide[b : b + ways], named[len(rows) + b : len(rows) + b + ways], k, tile, pairs) for b in range(0, len(asked), ways)]
        row, query, score = (np.concatenate([np.zeros(0, np.int64), *[x[n] + (b * ways if n == 1 else 0) for b, x in enumerate(out)]]) for n in range(3))
        return pa.table({"query_id": right["query_id"].take(pa.array(query)), "id": left["id"].take(pa.array(row.astype(np.int64))), "score": pa.array(score, pa.float64())})

    schema = T.StructType([queries.schema["query_id"], vectors.schema["id"], T.StructField("score", T.DoubleType())])
    scored = v.groupBy("shard", "block").cogroup(q.groupBy("shard", "block")).applyInArrow(best, schema).withColumn("score", F.round("score", 4))
    rank = F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("score"), "id"))
    return scored.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", "rank", "id", "score")


def match_by_skills(jobs: DataFrame, skills: Column, n: int) -> DataFrame:
    """Jobs by Jaccard * 100 with a set of skills; jobs (job_id, skills) without skills do not match."""
    score = F.round(jaccard(F.col("skills"), skills) * 100, 2)
    return jobs.filter(F.size("skills") > 0).select("job_id", score.alias("score")).filter("score > 0").orderBy(F.desc("score"), "job_id").limit(n)


def match_by_text(jobs: DataFrame, skills: Column, semantic: DataFrame, n: int) -> DataFrame:
    """Jobs by (0.7 semantic + 0.3 coverage of the job's skills) * 100; jobs without a semantic score count 0 for it."""
    joined = jobs.join(semantic.select("job_id", F.col("score").alias("sem")), "job_id", "left")
    score = F.round((F.lit(SEMANTIC_SHARE) * F.coalesce("sem", F.lit(0.0)) + F.lit(SKILL_SHARE) * coverage(skills, F.col("skills"))) * 100, 2)
    return joined.select("job_id", score.alias("score")).filter("score > 0").orderBy(F.desc("score"), "job_id").limit(n)


def keyword_bonus(role: Column, title: Column, document: Column, keywords: list[str]) -> Column:
    """min(0.08, 0.04 for each of a domain's keywords in the role or the title) + 0.02 if any is in the document."""
    has = lambda c, w: F.contains(F.lower(F.coalesce(c, F.lit(""))), F.lit(w.lower()))
    hits = sum(((has(role, w) | has(title, w)).cast("int") for w in keywords), F.lit(0))
    found = F.lit(False)
    for w in keywords:
        found = found | has(document, w)
    return F.least(F.lit(0.08), F.lit(0.04) * hits) + F.when(found, 0.02).otherwise(0.0)


def hybrid_rank(candidates: DataFrame, query_skills: Column, n: int, bonus: Column | None = None) -> DataFrame:
    """The n best candidates (query_id, id, sem, skills) of each query by 0.6 sem + 0.4 saturating coverage + bonus; ties by id."""
    shared = F.size(F.array_intersect("skills", query_skills))
    score = F.lit(SEARCH_SEMANTIC) * F.col("sem") + F.lit(SEARCH_SKILL) * saturating_coverage(F.size("skills"), shared)
    if bonus is not None:
        score = score + bonus
    scored = candidates.select("query_id", "id", F.round(score, 4).alias("score"))
    rank = F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("score"), "id"))
    return scored.withColumn("rank", rank).filter(F.col("rank") <= n)


def first_by_content(rows: DataFrame, key: Column, order: str) -> DataFrame:
    """One row for each md5 of key: the one smallest in order, picked by partial aggregates."""
    named = rows.withColumn("content_hash", F.md5(key.cast("binary")))
    return named.groupBy("content_hash").agg(F.min_by(F.struct(*rows.columns), F.struct(F.col(order).isNull(), order)).alias("x")).select("x.*", "content_hash")


def job_content(title: Column, company: Column, skills: Column) -> Column:
    return F.concat_ws("::", F.coalesce(title, F.lit("")), F.coalesce(company, F.lit("")), F.array_join(F.array_sort(F.transform(skills, F.lower)), "|"))


def job_text(title: Column, role: Column, company: Column, location: Column, skills: Column) -> Column:
    """The non-empty parts of a job in one line; the role only where it differs from the title."""
    part = lambda label, c: F.when(F.length(F.trim(c)) > 0, F.concat(F.lit(label), c))
    return F.concat_ws(
        ". ",
        part("Title: ", title),
        F.when(F.lower(role) != F.lower(F.coalesce(title, F.lit(""))), part("Role: ", role)),
        part("Company: ", company),
        part("Location: ", location),
        F.when(F.size(skills) > 0, F.concat(F.lit("Skills: "), F.array_join(skills, ", "))),
    )
