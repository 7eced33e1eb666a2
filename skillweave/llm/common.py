"""What several training-data operators share: shared storage, byte-level tokens, shards, components."""

from __future__ import annotations

import ctypes
import re
import sys
import tempfile
import uuid

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes that separate words: space and 0x09 to 0x0D.
SEPARATORS = np.zeros(256, bool)
SEPARATORS[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
#: A-Z to a-z, every other byte to itself.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
WORD = r"[^\x20\x09-\x0D]+"

_TRIM = getattr(ctypes.CDLL(None), "malloc_trim", None) if sys.platform == "linux" else None

_M1, _M2 = np.uint64(0xFF51AFD7ED558CCD), np.uint64(0xC4CEB9FE1A85EC53)
_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)
_POWERS: dict[str, np.ndarray] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir.

    Where it is unset, a session in one process (local master) gets a folder of its own; a cluster has to name one.
    """
    sc = spark.sparkContext
    found = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if not found:
        if not re.fullmatch(r"local(\[.*\])?", sc.master):
            raise ValueError("spark.checkpoint.dir is not set; it has to name a folder that the driver and all executors share")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="skillweave-"))
        found = sc.getCheckpointDir()
    return found.rstrip("/")


def stored(df: DataFrame, name: str) -> DataFrame:
    """Writes df to the shared folder and reads it again: lineage ends there and lost executors lose nothing."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def shuffle_partitions(spark: SparkSession) -> int:
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


def even_keys(spark: SparkSession, n: int) -> list[int]:
    """n integers that hash partitioning deals to n different partitions, one to each (n is a partition count)."""
    rows = (
        spark.range(0, 40 * n + 400, 1, 1)
        .select(F.col("id").cast("int").alias("k"))
        .groupBy(F.expr(f"pmod(hash(k), {n})").alias("p"))
        .agg(F.min("k").alias("k"))
        .orderBy("p")
        .collect()
    )
    keys = [r.k for r in rows]
    return keys + [40 * n + 400 + i for i in range(n - len(keys))]


def shard_of(columns: list, keys: list[int]):
    """A column that deals rows evenly to the keys of even_keys by a hash of the columns."""
    return F.element_at(F.lit(keys), (F.pmod(F.xxhash64(*columns), F.lit(len(keys))) + 1).cast("int")).cast("int")



def release() -> None:
    """Gives freed memory back to the system; a Python worker is used again and would keep the most it ever took."""
    pa.default_memory_pool().release_unused()
    if _TRIM is not None:
        _TRIM(0)


def squeeze(data: bytes) -> bytes:
    return zstandard.ZstdCompressor(level=1).compress(data)


def unsqueeze(data: bytes) -> bytes:
    return zstandard.ZstdDecompressor().decompress(data)


def pack_sorted(keys: np.ndarray) -> bytes:
    """Sorted uint64 keys as compressed byte planes of their differences."""
    if not len(keys):
        return b""
    gaps = np.diff(keys, prepend=np.uint64(0))
    return squeeze(gaps.view(np.uint8).reshape(-1, 8).T.tobytes())


def unpack_sorted(data: bytes) -> np.ndarray:
    if not data:
        return np.zeros(0, np.uint64)
    planes = np.frombuffer(unsqueeze(data), np.uint8).reshape(8, -1)
    return np.cumsum(np.ascontiguousarray(planes.T).view(np.uint64).ravel(), dtype=np.uint64)


def pack_counts(counts: np.ndarray) -> bytes:
    c = np.ascontiguousarray(counts, np.int64)
    return squeeze(c.view(np.uint8).reshape(-1, 8).T.tobytes()) if len(c) else b""


def unpack_counts(data: bytes) -> np.ndarray:
    if not data:
        return np.zeros(0, np.int64)
    planes = np.frombuffer(unsqueeze(data), np.uint8).reshape(8, -1)
    return np.ascontiguousarray(planes.T).view(np.int64).ravel()


def mixed(x: np.ndarray) -> np.ndarray:
    """A 64-bit finalizer: every input bit reaches every output bit."""
    x = x ^ (x >> np.uint64(33))
    x = x * _M1
    x ^= x >> np.uint64(33)
    x *= _M2
    x ^= x >> np.uint64(33)
    return x


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2**64, up to n."""
    if len(_POWERS.get("up", ())) <= n:
        size = 1 << max(16, int(n).bit_length())
        for name, base in (("up", _BASE), ("down", _INVERSE)):
            p = np.ones(size, np.uint64)
            step, have = np.uint64(base), 1
            while have < size:
                p[have : 2 * have] = p[:have] * step
                step = np.uint64(pow(base, 2 * have, 1 << 64))
                have *= 2
            _POWERS[name] = p
    return _POWERS["up"], _POWERS["down"]


_TABLE = mixed(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))


def prefix_hash(data: np.ndarray) -> np.ndarray:
    """h with h[j] - h[i] depending on data[i:j] and i only; one longer than data."""
    up, _ = powers(len(data))
    h = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_TABLE[data] * up[: len(data)], out=h[1:])
    return h


def span_hash(h: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of data[starts:ends], alike for equal bytes at any place."""
    _, down = powers(len(h))
    return mixed((h[ends] - h[starts]) * down[starts] + (ends - starts).astype(np.uint64))


#: Bytes of text hashed at once; a longer text is hashed whole.
CHUNK_BYTES = 1 << 19


def chunks(sizes: np.ndarray, most: int = CHUNK_BYTES) -> list[tuple[int, int]]:
    """Ranges of texts whose bytes together stay near most."""
    if not len(sizes):
        return []
    part = np.cumsum(sizes + 1) // most
    at = np.concatenate([[0], np.flatnonzero(np.diff(part)) + 1, [len(sizes)]])
    return list(zip(at[:-1].tolist(), at[1:].tolist()))


def words_of(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Word hashes of all texts in order (A-Z lowered), and the first and the end word of each text."""
    sizes = np.fromiter((len(t) for t in texts), np.int64, len(texts))
    hashes, counts = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
    for a, b in chunks(sizes):
        data = LOWER[np.frombuffer(b"\n".join(texts[a:b]) + b"\n", np.uint8)]
        edge = np.flatnonzero(np.diff(SEPARATORS[data], prepend=True))
        starts, ends = edge[0::2], edge[1::2]
        hashes.append(span_hash(prefix_hash(data), starts, ends))
        counts.append(np.diff(np.searchsorted(starts, np.cumsum(sizes[a:b] + 1), "left"), prepend=0))
    upto = np.cumsum(np.concatenate(counts))
    return np.concatenate(hashes), upto - np.concatenate(counts), upto


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """(node, component): smallest node reachable over the undirected edges (a, b).

    Minimum labels spread along edges and then jump along their own labels, so chains shorten by half each round.
    Labels are stored after each round; nothing but one count a round reaches the driver. Nodes without an edge are
    not listed; an empty edge table gives an empty result.
    """
    both = stored(edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "edges")
    labels = stored(both.groupBy(F.col("a").alias("node")).agg(F.least(F.col("node"), F.min("b")).alias("component")), "labels")
    for _ in range(rounds):
        near = both.join(labels, both.b == labels.node).groupBy(F.col("a").alias("node")).agg(F.min("component").alias("near"))
        spread = labels.join(near, "node").select("node", F.least("component", "near").alias("mid"), F.col("component").alias("was"))
        up = spread.select(F.col("node").alias("mid"), F.col("mid").alias("top"))
        new = stored(spread.join(up, "mid").select("node", F.least("mid", "top").alias("component"), (F.least("mid", "top") != F.col("was")).alias("changed")), "labels")
        labels = new.select("node", "component")
        if not new.filter("changed").limit(1).count():
            return labels
    raise RuntimeError(f"components did not settle in {rounds} rounds")


def frame(schema: str, **columns) -> pd.DataFrame:
    """A pandas frame with the columns in the order of a 'name type, ...' schema."""
    return pd.DataFrame({name: columns[name] for name in (c.split()[0] for c in schema.split(","))})


def text_bytes(column: pa.Array) -> tuple[memoryview, np.ndarray, np.ndarray]:
    """The UTF-8 bytes of an Arrow text column without a copy, and where each text starts and ends; nulls are empty."""
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64 if pa.types.is_large_string(column.type) else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    if not len(at):
        at = np.zeros(1, np.int64)
    starts, ends = at[:-1], at[1:]
    if column.null_count:
        ends = np.where(column.is_null().to_numpy(zero_copy_only=False), starts, ends)
    return memoryview(data) if data is not None else memoryview(b""), starts, ends


PACKED = "shard int, ids binary, nulls binary, flags binary, sizes binary, body binary"


def packed(docs: DataFrame, keys: list[int], by: list | None = None) -> DataFrame:
    """docs (doc_id long, flag boolean, text) as compressed bundles, dealt evenly to len(keys) shards and partitioned by shard.

    Each Arrow batch gives at most one bundle for each shard, so a text crosses the network once and compressed. by names
    the columns whose hash picks the shard (doc_id by default).
    """
    rows = docs.select("doc_id", "flag", "text", shard_of(by or [F.col("doc_id")], keys).alias("shard"))

    kinds = [pa.int32()] + [pa.binary()] * 5

    def run(batches):
        for batch in batches:
            shard = batch.column(3).to_numpy(zero_copy_only=False)
            data, starts, ends = text_bytes(batch.column(2))
            null = np.array(batch.column(0).is_null().to_numpy(zero_copy_only=False), bool)
            ids = batch.column(0).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
            flags = batch.column(1).to_numpy(zero_copy_only=False).astype(bool)
            order = np.argsort(shard, kind="stable")
            out = []
            for group in np.split(order, np.flatnonzero(np.diff(shard[order])) + 1) if len(order) else []:
                body = b"".join(data[s:e] for s, e in zip(starts[group].tolist(), ends[group].tolist()))
                out.append((int(shard[group[0]]), ids[group].tobytes(), null[group].tobytes(), flags[group].tobytes(), (ends - starts)[group].tobytes(), squeeze(body)))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out) if out else [[]] * 6, kinds)], ["shard", "ids", "nulls", "flags", "sizes", "body"])
        release()

    return rows.mapInArrow(run, PACKED).repartition(len(keys), "shard")


def unpacked(pdf: pd.DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[bytes]]:
    """ids, null marks, flags and texts of the bundles of one shard, by id."""
    release()
    ids = np.frombuffer(b"".join(pdf["ids"]), np.int64)
    null = np.frombuffer(b"".join(pdf["nulls"]), bool)
    flags = np.frombuffer(b"".join(pdf["flags"]), bool)
    texts: list[bytes] = []
    for sizes, body in zip(pdf["sizes"], pdf["body"]):
        data, at = unsqueeze(body), 0
        for n in np.frombuffer(sizes, np.int64):
            texts.append(data[at : at + n])
            at += n
    order = np.lexsort((ids, null))
    return ids[order], null[order], flags[order], [texts[i] for i in order]


def bucket_cuts(keys: np.ndarray, n: int) -> np.ndarray:
    """Where each of n equal ranges of the 64-bit hashes begins in sorted keys, and their end."""
    inner = np.searchsorted(keys, np.array([(i << 64) // n for i in range(1, n)], np.uint64), "left") if n > 1 else np.zeros(0, np.int64)
    return np.concatenate([[0], inner, [len(keys)]]).astype(np.int64)


#: What shards ask the key buckets, and what the buckets answer.
ASKED = "bucket int, shard int, kind int, keys binary, counts binary"
ANSWERED = "shard int, bucket int, kind int, counts binary, present long, total long"


def ask(shard: int, kind: int, keys: np.ndarray, counts: np.ndarray, buckets: list[int], every: bool = False) -> list[tuple]:
    """Rows that ask for the corpus counts of a shard's sorted distinct keys, one for each bucket that has some.

    every asks the others as well, for the sake of their present and total.
    """
    n = len(buckets)
    at = bucket_cuts(keys, n)
    return [(buckets[i], shard, kind, pack_sorted(keys[at[i] : at[i + 1]]), pack_counts(counts[at[i] : at[i + 1]])) for i in range(n) if every or at[i] < at[i + 1]]


def summed(asked: DataFrame, buckets: list[int], apart: int | None = None) -> DataFrame:
    """Answers each row of ask with the keys' sums over all shards, in the keys' order.

    present and total are the bucket's number of keys with a positive sum, and the sum of all; the key apart, if any, is
    left out of both.
    """

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        out = []
        for kind, part in pdf.groupby("kind"):
            keys = [unpack_sorted(x) for x in part["keys"]]
            counts = np.concatenate([unpack_counts(x) for x in part["counts"]]) if len(keys) else np.zeros(0, np.int64)
            distinct, back = np.unique(np.concatenate(keys), return_inverse=True)
            total = np.zeros(len(distinct), np.int64)
            np.add.at(total, back, counts)
            own = total if apart is None else np.where(distinct == np.uint64(apart), 0, total)
            present, whole, at = int((own > 0).sum()), int(own.sum()), 0
            for shard, k in zip(part["shard"], keys):
                out.append((shard, key[0], kind, pack_counts(total[back[at : at + len(k)]]), present, whole))
                at += len(k)
        return pd.DataFrame(out, columns=[c.split()[0] for c in ANSWERED.split(", ")])

    return asked.repartition(len(buckets), "bucket").groupBy("bucket").applyInPandas(run, ANSWERED)


def answers(pdf: pd.DataFrame, kind: int, buckets: list[int]) -> tuple[np.ndarray, int, int]:
    """The counts of a shard's keys of a kind, in the keys' order, and the corpus' present and total."""
    place = {b: i for i, b in enumerate(buckets)}
    part = pdf[pdf["kind"] == kind]
    part = part.iloc[np.argsort(part["bucket"].map(place).to_numpy(), kind="stable")]
    return np.concatenate([np.zeros(0, np.int64), *[unpack_counts(x) for x in part["counts"]]]), int(part["present"].sum()), int(part["total"].sum())


def folded(parts: DataFrame, merge, keys: tuple[str, ...] = (), fan: int = 64) -> DataFrame:
    """parts (keys, place long, body binary) with the bodies of equal keys merged to one: (keys, body).

    place tells the rows of a key apart, as the number of the task that made them does. merge turns a list of bodies, in the
    order of their places, into one. Rows meet in groups of about fan places at a time, level by level, so no task gets all
    that many tasks made. An empty table stays empty.
    """
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in parts.schema.fields)
    names = [*keys, "place", "body"]

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        bodies = pdf.sort_values("place")["body"].to_list()
        return pd.DataFrame([(*key, merge(bodies))], columns=names)

    parts = stored(parts.select(*names), "parts")
    left = (parts.agg(F.max("place")).first()[0] or 0) + 1
    while left > 1:
        left = -(-left // fan)
        grouped = parts.withColumn("place", F.col("place") % left).groupBy(*keys, "place")
        parts = stored(grouped.applyInPandas(run, schema), "parts")
    return parts.drop("place")
