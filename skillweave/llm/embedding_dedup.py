"""Operator 9: embedding near-duplicates by spherical-cap filters from random product codes.

Vectors are first turned by one random rotation for their width. A filter is a direction made of PARTS codewords, one per
slice of the dimensions; a vector is in every filter whose inner product with it reaches a threshold (a spherical cap). The
threshold lies a reach below the vector's best filter, so every vector has filters, and two vectors at the wanted cosine, whose inner products with any direction differ by little, share
one. Inner products shrink with the square root of the width, and so does the reach. The codes' product structure makes list
decoding cheap: partial sums of the first two and the last two slices are sorted, and pairs of halves that reach the
threshold are read off in descending order. Several independent code books can be used: what one separates meets in another.

Equal vectors of one label are one class with a count. Classes of one label meet in a filter's bucket; buckets are cut into
blocks and every pair of blocks is compared for itself, so a bucket may hold any share of the rows. Partitions sorted by
bucket are read as a stream, small buckets many at a time. A linked pair that shares several filters counts in the smallest.
What leaves a task is per class (its new links, one neighbour for each component found there), never the pairs.

Recall is a property of the filters, not of the verification: no pair below the threshold is reported. It is measured
against brute force in the tests (at least 0.9 asked; 0.99 and more found for pairs exactly at the threshold, at 16, 64 and
768 dimensions, for dense, sparse, one-hot and low-rank vectors alike).
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skillweave.llm.common import components, shuffle_partitions, stored, table
from skillweave.llm.topk_search import finite

THRESHOLD = 0.98
BOOKS = 1
PARTS = 4
WORDS = 32
#: How far below the vector's best filter a filter's inner product may lie, times the square root of the width.
REACH = 0.4
#: Filters of a vector in a book are at most as many, its nearest; two vectors at the threshold have the nearest in common.
MOST = 96
#: Classes of a bucket that are compared at once are at most about two blocks.
BLOCK = 512
#: Pairs of smaller groups are taken side by side.
SMALL = 48
SEED = 20_240_817


def code_books(width: int, books: int = BOOKS, words: int = WORDS, seed: int = SEED) -> list[list[np.ndarray]]:
    """books x PARTS matrices of random unit codewords; the same for a width on every executor.

    A slice of few dimensions has few codewords, so that no vector is near very many of them: both directions for one
    dimension, twice as many for each more, one for none.
    """
    rng = np.random.default_rng(seed + width)
    slices = [x.size for x in np.array_split(np.arange(width), PARTS)]
    out = []
    for _ in range(books):
        parts = [np.array([[1.0], [-1.0]])[: n + 1] if n < 2 else rng.standard_normal((min(words, 2 << n), n)) for n in slices]
        out.append([p / np.linalg.norm(p, axis=1, keepdims=True) for p in parts])
    return out


def rotation(width: int, seed: int = SEED) -> np.ndarray:
    """A random orthogonal matrix; the same for a width on every executor.

    Vectors are turned before they are sliced. Cosines stay, and a vector of few non-zero components, whose slices of zeros
    would be equally near to every codeword, looks like any other.
    """
    q, r = np.linalg.qr(np.random.default_rng(seed - width).standard_normal((width, width)))
    return q * np.where(np.diag(r) < 0, -1.0, 1.0)


def filters_of(x: np.ndarray, books: list[list[np.ndarray]], reach: float = REACH, most: int = MOST) -> np.ndarray:
    """The filters of one unit vector, ascending: list decoding of every product code, the nearest most of each book."""
    reach = reach / max(1, len(x)) ** 0.5
    slices = np.array_split(x, PARTS)
    found = []
    for number, book in enumerate(books):
        sums = [part @ (s if len(s) else np.zeros(1)) for part, s in zip(book, slices)]
        left = (sums[0][:, None] + sums[1][None, :]).ravel()
        right = (sums[2][:, None] + sums[3][None, :]).ravel()
        need = left.max() + right.max() - reach
        heads = np.flatnonzero(left >= need - right.max())
        order = np.argsort(-right, kind="stable")
        upto = np.searchsorted(-right[order], left[heads] - need, "right")
        head = np.repeat(heads, upto)
        tail = order[np.arange(len(head)) - np.repeat(np.cumsum(upto) - upto, upto)]
        filters = (number * len(left) + head) * len(right) + tail
        if len(filters) > most:
            filters = filters[np.argsort(-(left[head] + right[tail]), kind="stable")[:most]]
        found.append(filters)
    return np.unique(np.concatenate(found)) if found else np.zeros(0, np.int64)


_FILTERED = "node long, n long, label string, unit array<double>, filters array<int>"


def _decode(reach: float, books: int):
    def run(batches):
        cache: dict[int, tuple] = {}
        for pdf in batches:
            units, lists = [], []
            for v in pdf["embedding"]:
                x = np.asarray(v, np.float64)
                x = x / np.abs(x).max()
                x = x / np.sqrt(x @ x)
                units.append(x)
                if len(x) not in cache:
                    cache[len(x)] = (rotation(len(x)), code_books(len(x), books))
                turn, book = cache[len(x)]
                lists.append(filters_of(turn @ x, book, reach).astype(np.int32))
            yield pd.DataFrame({"node": pdf["node"], "n": pdf["n"], "label": pdf["label"], "unit": units, "filters": lists})

    return run


def _first_labels(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Smallest index reachable from each of n nodes over the links a-b."""
    label = np.arange(n)
    while len(a):
        new = label.copy()
        np.minimum.at(new, a, label[b])
        np.minimum.at(new, b, label[a])
        new = new[new]
        if (new == label).all():
            break
        label = new
    return label


_FOUND = "node long, links long, near long"


def _pairs(units: np.ndarray, starts: np.ndarray, ends: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """All pairs of rows of one group at or above the threshold, the groups being the rows from starts to ends."""
    found = [(np.zeros(0, np.int64), np.zeros(0, np.int64))]
    size = ends - starts
    for n in np.unique(size[size <= SMALL]).tolist():
        i, j = np.triu_indices(n, 1)
        some = starts[size == n]
        per = max(1, (1 << 18) // max(1, len(i)))
        for at in range(0, len(some), per):
            a, b = ((some[at : at + per, None] + x[None, :]).ravel() for x in (i, j))
            near = np.einsum("ij,ij->i", units[a], units[b]) >= threshold
            found.append((a[near], b[near]))
    for s, e in zip(starts[size > SMALL].tolist(), ends[size > SMALL].tolist()):
        a, b = np.nonzero(np.triu(units[s:e] @ units[s:e].T >= threshold, 1))
        found.append((a + s, b + s))
    return tuple(np.concatenate(x) for x in zip(*found))


def _linked(pdf: pd.DataFrame, threshold: float) -> pd.DataFrame:
    """The new links of whole groups: rows sorted by group, of any widths."""
    out = []
    for _, part in pdf.groupby(pdf["unit"].map(len), sort=False):
        group = part["pairing"].to_numpy()
        starts = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1]]))
        a, b = _pairs(np.stack(part["unit"].to_list()), starts, np.append(starts[1:], len(group)), threshold)
        block, apart = part["block"].to_numpy(), part["apart"].to_numpy()
        open_ = ~apart[a] | (block[a] != block[b])
        a, b = a[open_], b[open_]
        if not len(a):
            continue
        # A pair counts where the smallest filter it shares is the group's own: filters of linked rows, as (row, filter) keys.
        rows, at = np.unique(np.concatenate([a, b]), return_inverse=True)
        own = part["filter"].to_numpy()
        lists = [x[x < own[r]] for r, x in zip(rows.tolist(), part["filters"].iloc[rows])]
        values, place = np.unique(np.concatenate(lists), return_inverse=True)
        known = np.repeat(np.arange(len(rows)), [len(x) for x in lists]) * max(1, len(values)) + place
        first = np.concatenate([[0], np.cumsum([len(x) for x in lists])])
        left, right = at[: len(a)], at[len(a) :]
        new = np.ones(len(a), bool)
        for cut in range(0, len(a), 1 << 18):
            l, r = left[cut : cut + (1 << 18)], right[cut : cut + (1 << 18)]
            n = first[l + 1] - first[l]
            pair = np.repeat(np.arange(len(l)), n)
            item = place[np.repeat(first[l], n) + np.arange(len(pair)) - np.repeat(np.cumsum(n) - n, n)]
            key = r[pair] * max(1, len(values)) + item
            shared = known[np.minimum(np.searchsorted(known, key), len(known) - 1)] == key if len(known) else np.zeros(0, bool)
            new[cut + pair[shared]] = False
        a, b = a[new], b[new]
        n, node = part["n"].to_numpy(np.int64), part["node"].to_numpy(np.int64)
        links = np.bincount(a, n[b], len(n)) + np.bincount(b, n[a], len(n))
        label = _first_labels(len(n), a, b)
        some = links > 0
        out.append(pd.DataFrame({"node": node[some], "links": links[some].astype(np.int64), "near": node[label[some]]}))
    return pd.concat(out) if out else pd.DataFrame({"node": np.zeros(0, np.int64), "links": np.zeros(0, np.int64), "near": np.zeros(0, np.int64)})


def _stream(threshold: float):
    def run(batches):
        rest = None
        for pdf in batches:
            if not len(pdf):
                continue
            pdf = pdf if rest is None else pd.concat([rest, pdf], ignore_index=True)
            last = int(np.searchsorted(pdf["pairing"].to_numpy(), pdf["pairing"].iloc[-1], "left"))
            yield _linked(pdf.iloc[:last], threshold)
            rest = pdf.iloc[last:].reset_index(drop=True)
        if rest is not None:
            yield _linked(rest, threshold)

    return run


def near_vectors(rows: DataFrame, threshold: float = THRESHOLD, reach: float = REACH, books: int = BOOKS, block: int = BLOCK) -> DataFrame:
    """(vec_id, n_links, component_id, kept) for every row of rows (vec_id, embedding, label).

    Links join different rows of equal, non-null label whose cosine in double precision is at least the threshold.
    Vectors that are null, empty, zero or hold null or non-finite components, and rows without label or vec_id, link with
    nothing and are kept. Rows that repeat a vec_id are rows of their own, with their own vectors, links and components.
    Labels of any type compare as text; other columns are ignored. An empty table gives an empty result.
    """
    rows = rows.select("vec_id", "embedding", F.col("label").cast("string").alias("label"))
    good = F.col("vec_id").isNotNull() & F.col("label").isNotNull() & finite(F.col("embedding")) & F.coalesce(F.exists("embedding", lambda x: x != 0), F.lit(False))
    rows = rows.withColumn("embedding", F.col("embedding").cast("array<double>")).withColumn("node", F.when(good, F.xxhash64("label", "embedding")))
    usable = rows.filter("node IS NOT NULL")
    classes = usable.groupBy("node").agg(F.count(F.lit(1)).alias("n"), F.min("vec_id").alias("least"), F.min("label").alias("label"), F.first("embedding").alias("embedding"))
    classes = stored(classes, "classes")
    filtered = stored(classes.select("node", "n", "label", "embedding").mapInPandas(_decode(reach, books), _FILTERED), "filters")
    keyed = filtered.select("node", "label", F.size("unit").alias("width"), F.explode("filters").alias("filter"))
    sizes = stored(keyed.groupBy("label", "width", "filter").agg(F.count(F.lit(1)).alias("met")).filter("met > 1"), "buckets")
    placed = keyed.join(sizes, ["label", "width", "filter"]).withColumn("blocks", F.ceil(F.col("met") / block).cast("int"))
    placed = placed.withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    pairs = F.expr("transform(sequence(0, blocks - 1), x -> struct(least(block, x) AS bi, greatest(block, x) AS bj))")
    tasks = placed.select("node", "label", "width", "filter", "block", F.explode(pairs).alias("pair"))
    tasks = tasks.select("node", F.xxhash64("label", "width", "filter", "pair.bi", "pair.bj").alias("pairing"), "filter", "block", (F.col("pair.bi") != F.col("pair.bj")).alias("apart"))
    tasks = tasks.join(filtered.select("node", "n", "unit", "filters"), "node")
    dealt = tasks.repartition(shuffle_partitions(rows.sparkSession), "pairing").sortWithinPartitions("pairing", "node")
    found = stored(dealt.mapInPandas(_stream(threshold), _FOUND), "links")
    counts = found.groupBy("node").agg(F.sum("links").alias("links"))
    joined = components(found.filter("node <> near").select(F.col("node").alias("a"), F.col("near").alias("b")))
    own = classes.select("node", "n", "least").join(counts, "node", "left").join(joined, "node", "left")
    own = own.select("node", "least", (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("links"), F.coalesce("component", "node").alias("component"))
    own = stored(own, "own")
    named = own.groupBy("component").agg(F.min("least").alias("component_id"))
    results = stored(own.join(named, "component").select(F.col("node").alias("of"), "links", "component_id"), "named")
    return (
        rows.select("vec_id", "node")
        .join(results, F.col("node") == F.col("of"), "left")
        .select("vec_id", F.coalesce("links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component_id", "vec_id").alias("component_id"))
        .withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))
    )


def op9_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_vectors(table(spark, sf_dir, "embeddings"))


QUERIES = {"op9_embedding_dedup": op9_embedding_dedup}
ORACLES: dict[str, str] = {}
