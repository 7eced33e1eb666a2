"""Operator 12: the trie of conversation prefixes, built from chained digests.

Every turn becomes a SHA-256 digest of its role and text, and every conversation a chain: the digest of a prefix is the
digest of the shorter prefix's digest and the next turn's. Equal chains are equal prefixes, so grouping all prefixes by
(depth, digest) gives the nodes, and texts never travel beyond the scan. Chains are read off partitions sorted by
conversation as a stream, so a conversation may have any number of turns.

Subtree sums: each node belongs to the smallest conversation through it, its owner. The owner's other prefixes are the
node's ancestors, and the nodes that a conversation owns are the last ones of its path. So each conversation sums its own
nodes from the deepest up (a window) and sends one row to every prefix it has: every node reaches all of its ancestors,
already added up, in as many rows as there are prefixes, never the square of a depth. A common first turn is a sum of
partial sums. The ids that end at a node are joined in blocks of id ranges, and a node's blocks are hashed as a sorted
stream: no list of a node's members is ever in memory.
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from skillweave.llm.common import WORD, release, stored, table

#: Conversations whose first turns come from one and the same conversation.
FAMILY = 20
#: One more than the most turns that come from it.
HEADS = 4
#: Ids of one block are joined at once: at most as many.
BLOCK = 4096

_ROOT = hashlib.sha256(b"").digest()
_PREFIXES = "conv_id long, depth long, digest binary, parent binary, words long, ends boolean"
_KEY = ["depth", "digest"]


def turns_of(rows: DataFrame) -> DataFrame:
    """(conv_id, pos, turn_digest, words) of every row of rows (conv_id, turn, role, text): pos numbers a conversation's turns.

    Turns are ordered by turn (null first), then role, then the digest of role and text, so ties have one order and rows
    that repeat are turns of their own. Null roles and texts are empty; rows without conv_id belong to no conversation.
    """
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    digest = F.unhex(F.sha2(F.encode(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text), "utf-8"), 256))
    flat = rows.filter("conv_id IS NOT NULL").select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").alias("turn"), role.alias("role"), digest.alias("turn_digest"), F.regexp_count(text, F.lit(WORD)).cast("long").alias("words")
    )
    order = W.partitionBy("conv_id").orderBy(F.asc_nulls_first("turn"), "role", "turn_digest")
    return flat.select("conv_id", F.row_number().over(order).cast("long").alias("pos"), "turn_digest", "words")


def rebuilt(turns: DataFrame, family: int = FAMILY, heads: int = HEADS) -> DataFrame:
    """turns with each conversation's first h taken from conversation c - c % family, h being crc32 of the decimal c modulo heads.

    Every conversation also gets a row at pos 0 with no digest, so that one without turns is there. A family has at most
    2 * family - 1 members and less than heads turns to give, so no row is copied more often.
    """
    convs = turns.select("conv_id").distinct()
    h = F.crc32(F.col("conv_id").cast("string").cast("binary")) % heads
    first = turns.filter((F.col("conv_id") % family == 0) & (F.col("pos") < heads)).withColumnRenamed("conv_id", "base")
    takers = convs.select("conv_id", h.alias("h"), (F.col("conv_id") - F.col("conv_id") % family).alias("base")).filter("h > 0")
    taken = first.join(takers, "base").filter("pos <= h").select("conv_id", "pos", "turn_digest", "words")
    own = turns.filter(F.col("pos") > h)
    roots = convs.select("conv_id", F.lit(0).cast("long").alias("pos"), F.lit(None).cast("binary").alias("turn_digest"), F.lit(0).cast("long").alias("words"))
    return own.unionByName(taken).unionByName(roots)


def _chained(batches):
    """Prefix digests of whole conversations, from rows (conv_id, turn_digest, words) that start with a root row each."""
    names = [c.split()[0] for c in _PREFIXES.split(", ")]
    kinds = [pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.int64(), pa.bool_()]
    emit = lambda rows: pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows) if rows else [()] * 6, kinds)], names)
    last = None
    for batch in batches:
        out = []
        for conv, turn, words in zip(*(c.to_pylist() for c in batch.columns)):
            if turn is None:
                new = (conv, 0, _ROOT, None, 0)
            else:
                new = (conv, last[1] + 1, hashlib.sha256(last[2] + turn).digest(), last[2], words)
            if last is not None:
                out.append((*last, turn is None))
            last = new
        yield emit(out)
    if last is not None:
        yield emit([(*last, True)])
    release()


def prefixes(turns: DataFrame) -> DataFrame:
    """(conv_id, depth, digest, parent, words, ends): one row for every prefix of every conversation of rebuilt turns.

    words are those of the prefix's last turn; ends marks a conversation's whole sequence.
    """
    dealt = turns.repartition("conv_id").sortWithinPartitions("conv_id", "pos").select("conv_id", "turn_digest", "words")
    return dealt.mapInArrow(_chained, _PREFIXES)


def _hashed(batches):
    """SHA-256 of each node's blocks, joined by commas, from rows (depth, digest, ids) sorted by node and block."""
    node = state = None
    emit = lambda rows: pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows) if rows else [()] * 3, [pa.int64(), pa.binary(), pa.string()])], [*_KEY, "ends_sha256"])
    for batch in batches:
        out = []
        for depth, digest, ids in zip(*(c.to_pylist() for c in batch.columns)):
            if (depth, digest) != node:
                if node is not None:
                    out.append((*node, state.hexdigest()))
                node, state = (depth, digest), hashlib.sha256(ids.encode())
            else:
                state.update(b"," + ids.encode())
        yield emit(out)
    if node is not None:
        yield emit([(*node, state.hexdigest())])


def ends_of(paths: DataFrame, block: int = BLOCK) -> DataFrame:
    """(depth, digest, ends_sha256) of the nodes at which conversations end."""
    blocks = paths.filter("ends").groupBy(*_KEY, F.floor(F.col("conv_id") / block).alias("block")).agg(F.array_join(F.transform(F.sort_array(F.collect_list("conv_id")), lambda c: c.cast("string")), ",").alias("ids"))
    dealt = blocks.repartition(*_KEY).sortWithinPartitions(*_KEY, "block").select(*_KEY, "ids")
    return dealt.mapInArrow(_hashed, "depth long, digest binary, ends_sha256 string")


def prefix_nodes(paths: DataFrame, block: int = BLOCK) -> DataFrame:
    """The nodes of the trie of prefixes: digest, conv_id (smallest member), depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256.

    An empty table gives an empty result.
    """
    paths = stored(paths, "prefixes")
    grouped = stored(paths.groupBy(*_KEY, "parent", "words").agg(F.min("conv_id").alias("conv_id"), F.count(F.lit(1)).alias("n_convs")), "groups")
    children = grouped.filter("depth > 0").groupBy((F.col("depth") - 1).alias("depth"), F.col("parent").alias("digest")).agg(F.count(F.lit(1)).alias("n_children"))
    nodes = stored(grouped.join(children, _KEY, "left").withColumn("n_children", F.coalesce("n_children", F.lit(0).cast("long"))), "nodes")

    nothing = F.lit(0).cast("long")
    given = nodes.select("conv_id", *_KEY, (F.col("n_children") == 0).cast("long").alias("leaves"), ((F.col("n_convs") - 1) * F.col("words")).alias("saved"), F.lit(True).alias("own"))
    asked = paths.select("conv_id", *_KEY, nothing.alias("leaves"), nothing.alias("saved"), F.lit(False).alias("own"))
    upward = W.partitionBy("conv_id").orderBy(F.desc("depth")).rangeBetween(W.unboundedPreceding, W.currentRow)
    added = given.unionByName(asked).select(*_KEY, "own", F.sum("leaves").over(upward).alias("leaves"), F.sum("saved").over(upward).alias("saved"))
    sums = added.filter("NOT own").groupBy(*_KEY).agg(F.sum("leaves").alias("n_leaves"), F.sum("saved").alias("saved_tokens"))

    above = grouped.select((F.col("depth") + 1).alias("depth"), F.col("digest").alias("parent"), F.col("conv_id").alias("parent_conv_id"))
    return (
        nodes.join(sums, _KEY)
        .join(ends_of(paths, block), _KEY, "left")
        .join(above, ["depth", "parent"], "left")
        .select("digest", "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", F.coalesce("ends_sha256", F.lit(_ROOT.hex())).alias("ends_sha256"))
    )


def conversation_trie(rows: DataFrame, block: int = BLOCK) -> DataFrame:
    """prefix_nodes of the rebuilt conversations of rows (conv_id, turn, role, text); other columns are ignored."""
    turns = stored(turns_of(rows), "turns")
    return prefix_nodes(prefixes(rebuilt(turns)), block)


def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversation_trie(table(spark, sf_dir, "conversations")).drop("digest")


#: Prefixes as lists of turns; every node is unnested to all of its ancestors. CRC-32 goes bit by bit.
_SQL = r"""
WITH turns AS (
  SELECT conv_id AS c, coalesce(role, '') AS r, coalesce(text, '') AS x,
    row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''),
      sha256(strlen(coalesce(role, ''))::VARCHAR || ':' || coalesce(role, '') || coalesce(text, ''))) AS p
  FROM conversations WHERE conv_id IS NOT NULL
), convs AS (
  SELECT c, c - c % 20 AS base,
    xor(list_reduce([4294967295::BIGINT] || list_transform(string_split(c::VARCHAR, ''), lambda z: ascii(z)::BIGINT),
      lambda a, b: list_reduce([xor(a, b), 0, 0, 0, 0, 0, 0, 0, 0]::BIGINT[],
        lambda u, v: xor(u >> 1, CASE WHEN u % 2 = 1 THEN 3988292384::BIGINT ELSE 0::BIGINT END))), 4294967295::BIGINT) % 4 AS h
  FROM (SELECT DISTINCT c FROM turns)
), rebuilt AS (
  SELECT v.c, t.p, t.r, t.x FROM convs v JOIN turns t ON t.c = v.base AND t.p <= v.h
  UNION ALL
  SELECT v.c, t.p, t.r, t.x FROM convs v JOIN turns t ON t.c = v.c AND t.p > v.h
), paths AS (
  SELECT c, row_number() OVER w AS d, list({'r': r, 'x': x}) OVER w AS path FROM rebuilt
  WINDOW w AS (PARTITION BY c ORDER BY p ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)
  UNION ALL
  SELECT c, 0, [] FROM convs
), nodes AS (
  SELECT d, path, min(c) AS c, count(*) AS n,
    CASE WHEN d = 0 THEN 0 ELSE len(regexp_extract_all(path[d].x, '[^\x20\x09-\x0D]+')) END AS words
  FROM paths GROUP BY d, path
), families AS (
  SELECT m.d, m.path, m.c, m.n, m.words, u.c AS up, coalesce(k.n_children, 0) AS n_children
  FROM nodes m LEFT JOIN nodes u ON u.d = m.d - 1 AND u.path = m.path[1:m.d - 1]
  LEFT JOIN (SELECT d - 1 AS d, path[1:d - 1] AS path, count(*) AS n_children FROM nodes WHERE d > 0 GROUP BY ALL) k ON k.d = m.d AND k.path = m.path
), upward AS (
  SELECT a AS d, path[1:a] AS path, CASE WHEN n_children = 0 THEN 1 ELSE 0 END AS leaf, (n - 1) * words AS saved
  FROM (SELECT *, unnest(range(0, d + 1)) AS a FROM families)
), sums AS (
  SELECT d, path, sum(leaf) AS n_leaves, sum(saved) AS saved_tokens FROM upward GROUP BY d, path
), ends AS (
  SELECT d, path, string_agg(c::VARCHAR, ',' ORDER BY c) AS ids
  FROM (SELECT *, row_number() OVER (PARTITION BY c ORDER BY d DESC) AS k FROM paths) WHERE k = 1 GROUP BY d, path
)
SELECT f.c AS conv_id, f.d::BIGINT AS depth, f.up AS parent_conv_id, f.n AS n_convs, f.n_children::BIGINT AS n_children,
  s.n_leaves::BIGINT AS n_leaves, s.saved_tokens::BIGINT AS saved_tokens, sha256(coalesce(e.ids, '')) AS ends_sha256
FROM families f JOIN sums s ON s.d = f.d AND s.path = f.path LEFT JOIN ends e ON e.d = f.d AND e.path = f.path
"""

QUERIES = {"op12_prefix_trie": op12_prefix_trie}
ORACLES = {"op12_prefix_trie": _SQL}
