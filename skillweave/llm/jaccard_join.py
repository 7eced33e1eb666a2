"""Operator 8: near-duplicate documents by an n-gram Jaccard join with rare-first prefix filtering.

1. Equal texts form one class; classes are dealt to shards, and a shard asks the hash buckets for the document frequency of
   its shingles (see common.ask), so the order "rarest first, then by hash" is global.
2. Two sets that reach the threshold share a shingle among the first |s| - ceil(0.75 |s|) + 1 of each. Shingles no other
   class has come first in that order and cannot be shared, so only what remains of a prefix enters the index; a document
   without near-duplicates usually leaves nothing.
3. Candidates meet on prefix shingles and pass the length and the positional filter; a suffix filter and then the exact
   sets decide. First every class is tried against one pivot of its shingles (the class whose prefix is shared most, in a
   family of copies the original); then every remaining pair of classes that meet on a shingle and are not yet in one
   component is verified, once. Pairs inside a component are not expanded: they cannot change it. This
   loses no component; links inside one are neither all verified nor returned.
4. Components of links between classes, plus membership, give each document its component.

Hot shingles are harmless: a group whose classes are already one component emits nothing, however large it is. Shingles and
classes are named by 64-bit hashes.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skillweave.llm.common import ASKED, answers, ask, components, even_keys, mixed, packed, shuffle_partitions, squeeze, stored, summed, table, unpacked, unsqueeze, words_of

WORDS = 5
#: Similarity in per cent: links need 100 * intersection >= PERCENT * union.
PERCENT = 75
_STEP = np.uint64(0x9E3779B97F4A7C15)


def shingles(texts: list[bytes], words: int = WORDS) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all shingles of the texts in order and the text each belongs to.

    A text with fewer words than a shingle has its whole sequence as one; a text without words has none.
    """
    hashes, first, upto = words_of(texts)
    size = upto - first
    count = np.where(size >= words, size - words + 1, np.minimum(size, 1))
    owner = np.repeat(np.arange(len(texts), dtype=np.int32), count)
    start = first[owner] + np.arange(len(owner)) - np.repeat(np.cumsum(count) - count, count)
    span = np.minimum(size[owner], words)
    out = span.astype(np.uint64)
    for k in range(words):
        more = k < span
        at = start[more] + k
        out[more] = mixed(out[more] * _STEP + hashes[at])
    return out, owner


def shingle_sets(texts: list[bytes], words: int = WORDS) -> tuple[np.ndarray, np.ndarray]:
    """As shingles, but each hash once a text, ordered by hash and then by text."""
    hashes, owner = shingles(texts, words)
    order = np.argsort(hashes, kind="stable")
    hashes, owner = hashes[order], owner[order]
    new = np.ones(len(hashes), bool)
    new[1:] = (hashes[1:] != hashes[:-1]) | (owner[1:] != owner[:-1])
    return hashes[new], owner[new]


def least_overlap(a, b, percent: int = PERCENT):
    """Smallest intersection of sets of a and b elements that links them."""
    return -(-(percent * (a + b)) // (100 + percent))


def suffix_bound(x: np.ndarray, y: np.ndarray, depth: int = 2) -> int:
    """An upper bound of the intersection of two sorted sets: both are split at the middle element of y, and each half
    overlaps by no more than its smaller side."""
    if depth == 0 or not len(x) or not len(y):
        return min(len(x), len(y))
    m = len(y) // 2
    i = int(np.searchsorted(x, y[m]))
    hit = int(i < len(x) and x[i] == y[m])
    return suffix_bound(x[:i], y[:m], depth - 1) + hit + suffix_bound(x[i + hit :], y[m + 1 :], depth - 1)


INDEX = "node long, n long, grams array<long>, places array<int>, body binary"


def prefix_index(docs: DataFrame, words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """One row a class of docs (node long, text): set size, and the prefix shingles it shares with other classes.

    places holds their 0-based places in the class's rare-first order. body, only where grams is not empty, is the
    compressed text.
    """
    spark = docs.sparkSession
    keys = even_keys(spark, shuffle_partitions(spark))
    bundles = packed(docs.select(F.col("node").alias("doc_id"), F.lit(True).alias("flag"), "text"), keys)

    def classes(pdf: pd.DataFrame) -> tuple[np.ndarray, list[bytes]]:
        ids, _, _, texts = unpacked(pdf)
        _, at = np.unique(ids, return_index=True)
        return ids[at], [texts[i] for i in at]

    def requests(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        hashes, _ = shingle_sets(classes(pdf)[1], words)
        distinct, counts = np.unique(hashes, return_counts=True)
        return pd.DataFrame(ask(key[0], 0, distinct, counts, keys), columns=[c.split()[0] for c in ASKED.split(", ")])

    replies = summed(bundles.groupBy("shard").applyInPandas(requests, ASKED), keys)

    def index(key: tuple, left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        nodes, texts = classes(left)
        hashes, owner = shingle_sets(texts, words)
        new = np.ones(len(hashes), bool)
        new[1:] = hashes[1:] != hashes[:-1]
        df = answers(right, 0, keys)[0][np.cumsum(new) - 1]
        n = np.bincount(owner, minlength=len(nodes))
        alone = np.bincount(owner[df < 2], minlength=len(nodes))
        prefix = n - -(-(percent * n) // 100) + 1
        active = (n > 0) & (alone < prefix)
        use = active[owner] & (df >= 2)
        own, h, f = owner[use], hashes[use], df[use]
        order = np.lexsort((h, f, own))
        own, h = own[order], h[order]
        rank = np.arange(len(own)) - np.searchsorted(own, own, "left") + alone[own]
        inside = rank < prefix[own]
        own, h, rank = own[inside], h[inside].view(np.int64), rank[inside].astype(np.int32)
        cuts = np.searchsorted(own, np.arange(len(nodes) + 1))
        return pd.DataFrame(
            {
                "node": nodes,
                "n": n,
                "grams": [h[a:b] for a, b in zip(cuts[:-1], cuts[1:])],
                "places": [rank[a:b] for a, b in zip(cuts[:-1], cuts[1:])],
                "body": [squeeze(t) if b > a else None for t, a, b in zip(texts, cuts[:-1], cuts[1:])],
            }
        )

    return bundles.groupBy("shard").cogroup(replies.groupBy("shard")).applyInPandas(index, INDEX)


def verified(pairs: DataFrame, bodies: DataFrame, words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """The pairs (a, b) whose shingle sets link; bodies has (node, body)."""
    body = bodies.filter("body is not null").select("node", "body")
    rows = pairs.join(body.select(F.col("node").alias("a"), F.col("body").alias("body_a")), "a")
    rows = rows.join(body.select(F.col("node").alias("b"), F.col("body").alias("body_b")), "b").select("a", "b", "body_a", "body_b")

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 1000):
                part = batch.slice(at, 1000)
                a, b = (part.column(i).to_numpy() for i in (0, 1))
                found = {}
                for ids, column in ((a, part.column(2)), (b, part.column(3))):
                    for i, node in enumerate(ids.tolist()):
                        if node not in found:
                            found[node] = unsqueeze(column[i].as_py())
                place = {node: i for i, node in enumerate(found)}
                hashes, owner = shingle_sets(list(found.values()), words)
                order = np.argsort(owner, kind="stable")
                cuts = np.searchsorted(owner[order], np.arange(len(found) + 1))
                hashes = hashes[order]
                sets = [hashes[x:y] for x, y in zip(cuts[:-1], cuts[1:])]
                good = []
                for x, y in zip(a.tolist(), b.tolist()):
                    s, t = sets[place[x]], sets[place[y]]
                    need = least_overlap(len(s), len(t), percent)
                    good.append(suffix_bound(s, t) >= need and len(np.intersect1d(s, t, assume_unique=True)) >= need)
                good = np.array(good, bool)
                yield pa.RecordBatch.from_arrays([pa.array(a[good]), pa.array(b[good])], ["a", "b"])

    return rows.mapInArrow(run, "a long, b long")


def near_duplicates(docs: DataFrame, words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """(doc_id, n_shingles, component_id) for every row of docs (doc_id long, text).

    A-Z are lowered; words are runs of anything but space and 0x09 to 0x0D. Null, empty and wordless texts have no
    shingle and are linked with nothing; their component is their own id. Rows that repeat an id are rows of their own. A
    null id stands for itself: its rows link others but never name a component unless all members are null. Other
    columns are ignored; an empty table gives an empty result.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text")).withColumn("node", F.xxhash64("text"))
    index = stored(prefix_index(rows.select("node", "text"), words, percent), "index")
    entries = index.filter("size(grams) > 0").select(
        "node", "n", (F.size("grams") / F.col("n")).alias("fill"), F.explode(F.arrays_zip("grams", "places")).alias("e")
    ).select("node", "n", "fill", F.col("e.grams").alias("gram"), F.col("e.places").alias("place"))

    def may_link(n1, p1, n2, p2):
        """The length filter, and the positional filter for a first common shingle at places p1 and p2."""
        need = F.expr(f"({percent} * ({n1} + {n2}) + {99 + percent}) div {100 + percent}")
        longer, shorter = F.greatest(n1, n2), F.least(n1, n2)
        return (shorter * 100 >= longer * percent) & (F.least(F.col(n1) - F.col(p1), F.col(n2) - F.col(p2)) >= need)

    pivot = entries.groupBy("gram").agg(F.max(F.struct("fill", "node", "n", "place")).alias("p"), F.count(F.lit(1)).alias("met")).filter("met > 1")
    pivot = pivot.select("gram", F.col("p.node").alias("pivot"), F.col("p.n").alias("pn"), F.col("p.place").alias("pp"))
    star = entries.join(pivot, "gram").filter("node <> pivot").filter(may_link("n", "place", "pn", "pp"))
    votes = star.groupBy("node", "pivot").agg(F.count(F.lit(1)).alias("votes"))
    first = votes.groupBy("node").agg(F.max_by("pivot", F.struct("votes", "pivot")).alias("pivot"))
    first = stored(first.select(F.least("node", "pivot").alias("a"), F.greatest("node", "pivot").alias("b")).distinct(), "tried")
    links = stored(verified(first, index, words, percent), "links")

    def labelled(links: DataFrame) -> DataFrame:
        found = components(links).withColumnRenamed("node", "of")
        return index.select("node", "n").join(found, F.col("node") == F.col("of"), "left").select("node", "n", F.coalesce("component", "node").alias("component"))

    labels = stored(labelled(links), "classes")
    placed = entries.join(labels.select("node", "component"), "node").select("gram", "node", "n", "place", "component")
    open_grams = placed.groupBy("gram").agg(F.min("component").alias("x"), F.max("component").alias("y")).filter("x <> y").select("gram")
    placed = stored(placed.join(open_grams, "gram"), "open")
    other = placed.select("gram", F.col("node").alias("node2"), F.col("n").alias("n2"), F.col("place").alias("place2"), F.col("component").alias("component2"))
    rest = placed.join(other, (placed.gram == other.gram) & (F.col("node") < F.col("node2")) & (F.col("component") != F.col("component2")) & may_link("n", "place", "n2", "place2"))
    # Pairs that were verified and do not link are not tried again.
    rest = rest.select(F.col("node").alias("a"), F.col("node2").alias("b")).distinct().join(first, ["a", "b"], "left_anti")
    more = stored(verified(rest, index, words, percent), "links")
    if more.limit(1).count():
        labels = stored(labelled(links.unionByName(more)), "classes")
    members = rows.select("doc_id", F.col("node").alias("of")).join(labels, F.col("of") == F.col("node"), "left")
    members = stored(members.select("doc_id", F.col("n").alias("n_shingles"), "component"), "members")
    smallest = stored(members.filter("n_shingles > 0").groupBy("component").agg(F.min("doc_id").alias("component_id")), "smallest")
    return members.join(smallest, "component", "left").select(
        "doc_id", "n_shingles", F.when(F.col("n_shingles") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id")
    )


def op8_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))


QUERIES = {"op8_jaccard_join": op8_jaccard_join}
ORACLES: dict[str, str] = {}
