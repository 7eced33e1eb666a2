"""Operator 1: exact removal of repeated byte strings by merging shard Burrows-Wheeler transforms.

What is to be found are the blocks of suffixes (of all texts of all shards) that agree on their first WIDTH bytes, and in
each block the first suffix. Three things make this work on a cluster:

* Only suffixes that can repeat take part. Every WIDTH-byte string contains exactly one anchor, the leftmost least-hashed
  K-byte string in it, so equal strings have equal anchors at equal offsets. Round one counts anchors and drops singles.
* Copies take part once. An anchor owns a stretch of strings; round two finds equal stretches and keeps the first.
* In round three a shard sorts the stretches left to it, for each range of anchor hashes, into a Burrows-Wheeler transform.
  The buckets of that range merge the shards' transforms by interleave refinement (see transforms.py): the intervals whose
  common prefix reaches WIDTH are the repeated strings, wherever their stretches come from. Equal strings have equal
  anchors, so a bucket holds all suffixes it has to compare, and last-to-first steps never leave it.

An anchor that occurs more than CROWD times could fill a bucket with different stretches around it. Its strings go another
exact way, in the same round: named by a hash put together from fixed pieces, at most one name per string and shard.

A task holds one shard's texts or one bucket's transforms and names. Texts cross the network once, compressed; the shuffle is
reused by all rounds.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skillweave.llm.common import chunks, even_keys, mixed, pack_counts, pack_sorted, packed, prefix_hash, shuffle_partitions, span_hash, stored, table, squeeze, unpack_counts, unpack_sorted, unpacked, unsqueeze
from skillweave.llm.transforms import last_to_first, merge, transform, walked

WIDTH = 100
K = 36
SYMBOL = 25
#: Occurrences of an anchor up to which its stretches are merged as transforms; those of others are named string by string.
CROWD = 1 << 14
_STEP = np.uint64(0x9E3779B97F4A7C15)
_PLACE = np.uint64((1 << 28) - 1)
#: Bytes of a longer text are looked at in pieces, as a place has 28 bits.
_PIECE = 1 << 28
_LAST = np.iinfo(np.int64).max


def anchors(data: np.ndarray, h: np.ndarray, bounds: np.ndarray, width: int, k: int):
    """Anchors of all width-byte strings that lie in one text: place, first and last string start owned, and the text.

    data holds texts side by side, bounds their borders; h is its prefix hash. Ties go left.
    """
    empty = np.zeros(0, np.int64)
    n = len(data)
    if n < width:
        return empty, empty, empty, empty
    if n > _PIECE:
        return _anchors_in_pieces(data, bounds, width, k)
    grams = span_hash(h, np.arange(n - k + 1), np.arange(k, n + 1))
    key = (grams & ~_PLACE) | np.arange(len(grams), dtype=np.uint64)
    need, span = width - k + 1, 1
    while span * 2 <= need:
        key = np.minimum(key[:-span], key[span:])
        span *= 2
    if need > span:
        key = np.minimum(key[: len(key) - (need - span)], key[need - span :])
    text = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
    start = np.arange(n - width + 1)
    inside = text[: len(start)] == text[width - 1 :]
    start = start[inside]
    if not len(start):
        return empty, empty, empty, empty
    place = (key[inside] & _PLACE).astype(np.int64)
    new = np.ones(len(start), bool)
    new[1:] = (place[1:] != place[:-1]) | (np.diff(start) != 1)
    at = np.flatnonzero(new)
    last = np.append(at[1:], len(start)) - 1
    return place[at], start[at], start[last], text[start[at]]


def _anchors_in_pieces(data: np.ndarray, bounds: np.ndarray, width: int, k: int):
    """anchors() of data too long for the bits of a place: pieces that overlap by less than a string, cut stretches joined again."""
    step, found = _PIECE - width + 1, []
    for a in range(0, len(data) - width + 1, step):
        part = data[a : min(len(data), a + step + width - 1)]
        place, first, last, text = anchors(part, prefix_hash(part), np.clip(bounds - a, 0, len(part)), width, k)
        found.append((place + a, first + a, last + a, text))
    place, first, last, text = (np.concatenate(x) for x in zip(*found))
    new = np.ones(len(place), bool)
    new[1:] = (place[1:] != place[:-1]) | (first[1:] != last[:-1] + 1)
    at = np.flatnonzero(new)
    return place[at], first[at], last[np.append(at[1:], len(place)) - 1] if len(at) else last, text[at]


def named(h: np.ndarray, starts: np.ndarray, width: int, symbol: int) -> np.ndarray:
    """Hashes of the width-byte strings at starts, put together from pieces of symbol bytes, from the last to the first."""
    name = np.zeros(len(starts), np.uint64)
    for at in range(width - symbol if width % symbol == 0 else width - width % symbol, -1, -symbol):
        stop = np.minimum(at + symbol, width)
        name = mixed(name * _STEP + span_hash(h, starts + at, starts + stop))
    return name


class Shard:
    """A shard's texts with the anchors of all their strings; texts are in order of id, null last."""

    def __init__(self, pdf: pd.DataFrame, width: int, k: int):
        self.ids, self.null, _, self.texts = unpacked(pdf)
        self.width, self.k = width, k
        place = np.where(self.null, _LAST, self.ids)
        sizes = np.fromiter((len(t) for t in self.texts), np.int64, len(self.texts))
        self.parts = [p for p in chunks(sizes)]
        self.gram, self.context, self.doc, self.pos, self.low, self.high, self.part, self.text, self.base = ([] for _ in range(9))
        for number, (a, b) in enumerate(self.parts):
            data, bounds, h = self.view(number)
            p, low, high, text = anchors(data, h, bounds, width, k)
            self.gram.append(mixed(span_hash(h, p, p + k)))  # mixed again: the least hashes of all would crowd the first bucket
            self.context.append(mixed(span_hash(h, low, high + width) + mixed((p - low).astype(np.uint64) << np.uint64(20) ^ (high - low).astype(np.uint64))))
            self.doc.append(place[a + text])
            self.pos.append(p - bounds[text])
            self.low.append(low)
            self.high.append(high)
            self.text.append(a + text)
            self.base.append(bounds[text])
            self.part.append(np.full(len(p), number))
        for name in ("gram", "context", "doc", "pos", "low", "high", "part", "text", "base"):
            parts = getattr(self, name)
            setattr(self, name, np.concatenate(parts) if parts else np.zeros(0, np.uint64 if name in ("gram", "context") else np.int64))

    def view(self, number: int):
        a, b = self.parts[number]
        data = np.frombuffer(b"".join(self.texts[a:b]), np.uint8)
        bounds = np.concatenate([[0], np.cumsum([len(t) for t in self.texts[a:b]])]).astype(np.int64)
        return data, bounds, prefix_hash(data)

    def strings(self, use: np.ndarray, symbol: int):
        """Block names, places and anchors of all strings owned by the anchors marked in use."""
        names, docs, starts, owners = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        which = np.flatnonzero(use)
        for number in np.unique(self.part[which]):
            own = which[self.part[which] == number]
            h = self.view(int(number))[2]
            n = self.high[own] - self.low[own] + 1
            owner = np.repeat(own, n)
            start = self.low[owner] + np.arange(len(owner)) - np.repeat(np.cumsum(n) - n, n)
            names.append(named(h, start, self.width, symbol))
            docs.append(self.doc[owner])
            starts.append(start - self.base[owner])
            owners.append(owner)
        return np.concatenate(names), np.concatenate(docs), np.concatenate(starts), np.concatenate(owners)

    def stretches(self, use: np.ndarray, buckets: int) -> list[np.ndarray]:
        """The anchors marked in use, for each of the ranges of anchor hashes."""
        which = np.flatnonzero(use)
        cuts = np.array([(i << 64) // buckets for i in range(1, buckets)], np.uint64)
        bucket = np.searchsorted(cuts, self.gram[which], "right")
        order = np.argsort(bucket, kind="stable")
        return np.split(which[order], np.cumsum(np.bincount(bucket, minlength=buckets))[:-1])

    def transformed(self, own: np.ndarray) -> np.ndarray:
        """The transform of the stretches of the anchors own."""
        text, low, high = self.text[own], (self.low - self.base)[own], (self.high - self.base)[own] + self.width
        return transform([self.texts[t][a:b] for t, a, b in zip(text.tolist(), low.tolist(), high.tolist())])


#: The third round sends names as the others do, and as round TRANSFORMS one row for a bucket with the transforms of its SLICES parts.
NAMES, TRANSFORMS, SLICES = 3, 4, 8
ASKED = "bucket int, shard int, round int, keys binary, counts binary, docs binary, places binary"
ANSWERED = "shard int, bucket int, round int, counts binary, docs binary, places binary"


def _named_blocks(names: np.ndarray, docs: np.ndarray, places: np.ndarray):
    """Blocks of equal names: the distinct names ascending, each row's block, block sizes, and each block's first row."""
    order = np.lexsort((places, docs, names))
    ordered = names[order]
    head = np.ones(len(order), bool)
    head[1:] = ordered[1:] != ordered[:-1]
    block = np.empty(len(order), np.int64)
    block[order] = np.cumsum(head) - 1
    return ordered[head], block, np.diff(np.append(np.flatnonzero(head), len(order))), order[head]


def _ask(shard: int, number: int, names, docs, places, buckets: list[int]) -> list[tuple]:
    keys, _, size, first = _named_blocks(names, docs, places)
    n = len(buckets)
    cuts = np.searchsorted(keys, np.array([(i << 64) // n for i in range(1, n)], np.uint64), "left") if n > 1 else np.zeros(0, np.int64)
    at = np.concatenate([[0], cuts, [len(keys)]])
    d, p = docs[first], places[first]
    pack = lambda x: pack_counts(x) if number > 1 else b""
    return [
        (buckets[i], shard, number, pack_sorted(keys[a:b]), pack_counts(size[a:b]), pack(d[a:b]), pack(p[a:b])) for i, (a, b) in enumerate(zip(at[:-1], at[1:])) if b > a
    ]


def repeated(transforms: list[np.ndarray], docs: list[np.ndarray], places: list[np.ndarray], width: int) -> list[np.ndarray]:
    """For each transform, marks of the width-byte strings that also start earlier, string by string of the collection.

    docs and places tell where the strings of a collection start. A string of n bytes has n - width + 1 marks.
    """
    steps = [last_to_first(t) for t in transforms]
    order, prefix = merge(transforms, width, steps)
    strings = [int((t == 0).sum()) for t in transforms]
    if not sum(strings):
        return [np.zeros(0, bool) for _ in transforms]
    base = np.cumsum([0, *[len(t) for t in transforms]])
    ends = np.concatenate([np.arange(b, b + m) for b, m in zip(base, strings)])
    owner, length, size = walked(np.concatenate(transforms), np.concatenate([x + np.int32(b) for x, b in zip(steps, base)]), ends)
    interval = np.cumsum(prefix < width)
    whole = np.flatnonzero(length[order] >= width)
    interval, row = interval[whole], order[whole]
    shared = np.bincount(interval, minlength=1)[interval] > 1
    interval, row = interval[shared], row[shared]
    offset = size[owner[row]] - length[row]
    doc, place = np.concatenate(docs)[owner[row]], np.concatenate(places)[owner[row]] + offset
    at = np.lexsort((place, doc, interval))
    head = np.diff(interval[at], prepend=-1) != 0
    first = at[np.flatnonzero(head)][np.cumsum(head) - 1]
    again = at[(doc[first] != doc[at]) | (place[first] != place[at])]
    marks = np.maximum(size - width + 1, 0)
    found = np.zeros(int(marks.sum()), bool)
    found[(np.cumsum(marks) - marks)[owner[row[again]]] + offset[again]] = True
    return np.split(found, np.append(0, np.cumsum(marks))[np.cumsum(strings)[:-1]])


def _merged(asked: DataFrame, buckets: list[int], width: int) -> DataFrame:
    """Merges the shards' lists bucket by bucket.

    Transforms get the marks of repeated strings, names the block's size over all shards and its first place.
    """

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        out = []
        for number, part in pdf.groupby("round"):
            if number == TRANSFORMS:
                marks: list[list[bytes]] = [[] for _ in range(len(part))]
                parts = [_opened(x) for x in part["keys"]]
                starts = [(unpack_counts(d), unpack_counts(p)) for d, p in zip(part["docs"], part["places"])]
                used = [0] * len(parts)
                for at in range(SLICES):
                    found = [x[at] for x in parts]
                    n = [int((x == 0).sum()) for x in found]
                    own = [slice(u, u + m) for u, m in zip(used, n)]
                    used = [u + m for u, m in zip(used, n)]
                    for i, x in enumerate(repeated(found, [d[o] for (d, _), o in zip(starts, own)], [p[o] for (_, p), o in zip(starts, own)], width)):
                        marks[i].append(np.packbits(x).tobytes())
                out.extend((shard, key[0], number, squeeze(b"".join(x)), b"", b"") for shard, x in zip(part["shard"], marks))
                continue
            lists = [unpack_sorted(x) for x in part["keys"]]
            counts = np.concatenate([unpack_counts(x) for x in part["counts"]])
            names = np.concatenate(lists)
            docs = np.concatenate([unpack_counts(x) for x in part["docs"]]) if number > 1 else np.zeros(len(names), np.int64)
            places = np.concatenate([unpack_counts(x) for x in part["places"]]) if number > 1 else docs
            keys, block, _, first = _named_blocks(names, docs, places)
            size = np.zeros(len(keys), np.int64)
            np.add.at(size, block, counts)
            at = 0
            for shard, own in zip(part["shard"], lists):
                b = block[at : at + len(own)]
                at += len(own)
                out.append((shard, key[0], number, pack_counts(size[b]), pack_counts(docs[first[b]]) if number > 1 else b"", pack_counts(places[first[b]]) if number > 1 else b""))
        return pd.DataFrame(out, columns=[c.split()[0] for c in ANSWERED.split(", ")])

    return asked.repartition(len(buckets), "bucket").groupBy("bucket").applyInPandas(run, ANSWERED)


def _answers(pdf: pd.DataFrame, number: int, names, docs, places, buckets: list[int]):
    """Block size and first place over all shards for each of a shard's suffixes."""
    _, block, _, _ = _named_blocks(names, docs, places)
    at = {b: i for i, b in enumerate(buckets)}
    part = pdf[pdf["round"] == number]
    part = part.iloc[np.argsort(part["bucket"].map(at).to_numpy(), kind="stable")] if len(part) else part
    join = lambda column: np.concatenate([np.zeros(0, np.int64), *[unpack_counts(x) for x in part[column]]])
    size = join("counts")[block]
    return (size, None, None) if number == 1 else (size, join("docs")[block], join("places")[block])


def _closed(transforms: list[np.ndarray]) -> bytes:
    """A slice's transform each, side by side, after their lengths and the bytes of a symbol."""
    kind = max(t.itemsize for t in transforms)
    head = np.array([kind, *[len(t) for t in transforms]], np.int64).tobytes()
    return squeeze(head + b"".join(t.astype(f"u{kind}").tobytes() for t in transforms))


def _opened(data: bytes) -> list[np.ndarray]:
    data = unsqueeze(data)
    kind, *sizes = np.frombuffer(data, np.int64, SLICES + 1).tolist()
    return np.split(np.frombuffer(data, f"u{kind}", offset=8 * (SLICES + 1)), np.cumsum(sizes)[:-1])


def _ask_transforms(s: Shard, shard: int, use: np.ndarray, buckets: list[int]) -> list[tuple]:
    out, slices = [], s.stretches(use, SLICES * len(buckets))
    for at, bucket in enumerate(buckets):
        parts = slices[at * SLICES : (at + 1) * SLICES]
        own = np.concatenate(parts)
        if len(own):
            out.append((bucket, shard, TRANSFORMS, _closed([s.transformed(x) for x in parts]), b"", pack_counts(s.doc[own]), pack_counts((s.low - s.base)[own])))
    return out


def _marked(s: Shard, pdf: pd.DataFrame, use: np.ndarray, buckets: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """Starts (in their text) and anchors of the strings of the anchors marked in use that also start earlier."""
    part = pdf[pdf["round"] == TRANSFORMS]
    bits = {bucket: np.frombuffer(unsqueeze(x), np.uint8) for bucket, x in zip(part["bucket"], part["counts"])}
    starts, owners, used = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], 0
    for at, own in enumerate(s.stretches(use, SLICES * len(buckets))):
        used = used if at % SLICES else 0
        if not len(own):
            continue
        n = s.high[own] - s.low[own] + 1
        owner = np.repeat(own, n)
        start = (s.low - s.base)[owner] + np.arange(len(owner)) - np.repeat(np.cumsum(n) - n, n)
        size = -(-len(owner) // 8)
        again = np.unpackbits(bits[buckets[at // SLICES]][used : used + size], count=len(owner)).astype(bool)
        used += size
        starts.append(start[again])
        owners.append(owner[again])
    return np.concatenate(starts), np.concatenate(owners)


SPANS = "doc_id long, n_bytes long, spans array<struct<start: long, stop: long>>, kept_sha256 string, kept binary"


def remove_repeats(docs: DataFrame, width: int = WIDTH, k: int = K, symbol: int = SYMBOL, with_kept: bool = False, crowd: int = CROWD) -> DataFrame:
    """One row per row of docs (doc_id long, text): removed byte spans, the hash of what is kept and, if asked for, the bytes.

    A byte goes if a width-byte string that covers it also starts earlier: in a smaller doc_id (null after all others), or
    in the same text further left. Strings never cross texts and are judged on the input. Null and empty texts have no
    bytes. Rows that repeat an id are compared like others, except that strings at the same place of both are the same
    place. Other columns are ignored; an empty table gives an empty result. Needs k <= width.
    """
    spark = docs.sparkSession
    keys = even_keys(spark, shuffle_partitions(spark))
    bundles = packed(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.lit(True).alias("flag"), "text"), keys)
    columns = [c.split()[0] for c in ASKED.split(", ")]

    def first_round(key: tuple, left: pd.DataFrame) -> pd.DataFrame:
        s = Shard(left, width, k)
        zero = np.zeros(len(s.gram), np.int64)
        return pd.DataFrame(_ask(key[0], 1, s.gram, zero, zero, keys), columns=columns)

    def open_after_first(s: Shard, right: pd.DataFrame):
        zero = np.zeros(len(s.gram), np.int64)
        size = _answers(right, 1, s.gram, zero, zero, keys)[0]
        return size, np.flatnonzero(size > 1)

    def second_round(key: tuple, left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if not len(left):
            return pd.DataFrame([], columns=columns)
        s = Shard(left, width, k)
        _, go = open_after_first(s, right)
        return pd.DataFrame(_ask(key[0], 2, s.context[go], s.doc[go], s.pos[go], keys), columns=columns)

    def open_after_second(s: Shard, right: pd.DataFrame):
        """Marks of anchors whose strings all repeat, of anchors whose stretches are merged, and of those too frequent for it."""
        size, go = open_after_first(s, right)
        whole, single = np.zeros(len(size), bool), np.zeros(len(size), bool)
        alike, doc, pos = _answers(right, 2, s.context[go], s.doc[go], s.pos[go], keys)
        first = (doc == s.doc[go]) & (pos == s.pos[go])
        whole[go[~first]] = True
        single[go[first & (size[go] > alike)]] = True
        return whole, single & (size <= crowd), single & (size > crowd)

    def third_round(key: tuple, left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if not len(left):
            return pd.DataFrame([], columns=columns)
        s = Shard(left, width, k)
        _, merged, crowded = open_after_second(s, right)
        names, docs_, starts, _ = s.strings(crowded, symbol)
        return pd.DataFrame(_ask_transforms(s, key[0], merged, keys) + _ask(key[0], NAMES, names, docs_, starts, keys), columns=columns)

    def removal(key: tuple, left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        out = []
        if not len(left):
            return pd.DataFrame(out, columns=["doc_id", "n_bytes", "spans", "kept_sha256", "kept"])
        s = Shard(left, width, k)
        whole, merged, crowded = open_after_second(s, right)
        names, docs_, starts, owners = s.strings(crowded, symbol)
        _, doc, pos = _answers(right, NAMES, names, docs_, starts, keys)
        again = (doc != docs_) | (pos != starts)
        more, holders = _marked(s, right, merged, keys)
        starts, owners = np.concatenate([starts[again], more]), np.concatenate([owners[again], holders])
        from_ = np.concatenate([(s.low - s.base)[whole], starts])
        to = np.concatenate([(s.high - s.base)[whole], starts]) + width
        text = np.concatenate([s.text[whole], s.text[owners]])
        order = np.argsort(text, kind="stable")
        cuts = np.searchsorted(text[order], np.arange(len(s.texts) + 1))
        for i, t in enumerate(s.texts):
            own = order[cuts[i] : cuts[i + 1]]
            spans, kept = [], t
            if len(own):
                depth = np.zeros(len(t) + 1, np.int64)
                np.add.at(depth, from_[own], 1)
                np.add.at(depth, to[own], -1)
                gone = np.cumsum(depth[:-1]) > 0
                edge = np.flatnonzero(np.diff(gone, prepend=False, append=False))
                spans = [{"start": int(a), "stop": int(b)} for a, b in zip(edge[0::2], edge[1::2])]
                kept = np.frombuffer(t, np.uint8)[~gone].tobytes()
            out.append((None if s.null[i] else int(s.ids[i]), len(t), spans, hashlib.sha256(kept).hexdigest(), kept if with_kept else None))
        frame = pd.DataFrame(out, columns=["doc_id", "n_bytes", "spans", "kept_sha256", "kept"])
        frame["doc_id"] = frame["doc_id"].astype("Int64")
        return frame

    left = lambda: bundles.groupBy("shard")
    # Answers are stored, as later rounds read them again: a bucket answers once, and a lost executor costs only its own.
    one = stored(_merged(left().applyInPandas(first_round, ASKED), keys, width), "answers")
    two = stored(_merged(left().cogroup(one.groupBy("shard")).applyInPandas(second_round, ASKED), keys, width), "answers")
    both = one.unionByName(two)
    three = _merged(left().cogroup(both.groupBy("shard")).applyInPandas(third_round, ASKED), keys, width)
    return left().cogroup(both.unionByName(three).groupBy("shard")).applyInPandas(removal, SPANS)


def op1_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = remove_repeats(table(spark, sf_dir, "documents"))
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda n, x: n + x.stop - x.start)
    return found.select("doc_id", "n_bytes", removed.alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), "kept_sha256")


QUERIES = {"op1_suffix_dedup": op1_suffix_dedup}
ORACLES: dict[str, str] = {}
