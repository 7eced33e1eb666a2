"""Operator 10: SentencePiece encoding and decoding over a relational lattice.

A text gets a space in front and is cut between two bytes wherever no piece of the table has them side by side (checked on
the table itself, so no path is lost); what lies between two cuts is a word. No piece has a space after another character,
so words begin at runs of spaces at the latest. Texts are dealt to shards, shards ask hash buckets for their distinct words,
and the distinct words of the corpus become a relation. Its lattice is built by joins: all substrings up to the longest
piece's length are exploded, the piece table is equi-joined to them (its size is that of a vocabulary, at most PIECES_BOUND
rows, so it is broadcast), and the edges that remain are grouped by word. A higher-order aggregate folds them, ordered by
end, into the best path to every position, and a second one reads the path back. Buckets answer every shard with the ids of
its words in the order it asked, and shards lay them out text by text.

The path is the one with the greatest sum of piece scores; ties go to the longer last piece. A character without a piece is
an edge of UNKNOWN below the lowest score and becomes its UTF-8 bytes' pieces, so decoding gives every text back exactly.
The table writes a space as the mark U+2581; here it stays a space, so that a mark in a text is a character like any other.
The fold copies an array at every edge; words of more than LONG characters take the same recurrence in a loop instead, whose
time is proportional to their length.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skillweave.llm.common import bucket_cuts, chunks, even_keys, packed, prefix_hash, shuffle_partitions, span_hash, squeeze, table, unpacked, unsqueeze

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
MARK = "▁"
PIECES_BOUND = 1 << 18
#: An unknown character costs this much more than the lowest piece.
UNKNOWN = 10.0
#: Words of more code points are encoded outside the relation.
LONG = 256


@dataclass
class Pieces:
    """A piece table: text of the normal pieces, byte pieces' ids, scores by id."""

    rows: list[tuple[str, int, float]]
    byte_ids: list[int]
    hexes: list[str]

    @property
    def longest(self) -> int:
        return max(len(p) for p, _, _ in self.rows)

    @property
    def unknown(self) -> float:
        return min(s for _, _, s in self.rows) - UNKNOWN

    def together(self) -> np.ndarray:
        """256 x 256: whether some piece has the two bytes side by side, or the second continues a character."""
        pair = np.zeros((256, 256), bool)
        pair[:, 0x80:0xC0] = True
        for piece, _, _ in self.rows:
            b = np.frombuffer(piece.replace(MARK, " ").encode(), np.uint8)
            pair[b[:-1], b[1:]] = True
        return pair

    def best_path(self, word: str) -> list[int]:
        """The ids of the best path of one word, by the recurrence that encode_words folds."""
        known = {t.replace(MARK, " "): (i, s) for t, i, s in self.rows}
        longest, unknown = self.longest, self.unknown
        score, back = [0.0], [(0, 0)]
        for end in range(1, len(word) + 1):
            top = None
            for start in range(max(0, end - longest), end):
                edge = known.get(word[start:end])
                if edge is None and end - start > 1:
                    continue
                s = score[start] + (unknown if edge is None else edge[1])
                if top is None or s > top[0]:
                    top = (s, start, -1 if edge is None else edge[0])
            score.append(top[0])
            back.append(top[1:])
        out, at = [], len(word)
        while at:
            start, number = back[at]
            out.append([number] if number >= 0 else [self.byte_ids[b] for b in word[start:at].encode()])
            at = start
        return [i for ids in reversed(out) for i in ids]


def load(path: str = MODEL) -> Pieces:
    """The table of a SentencePiece model file with byte pieces; all its normal pieces are used."""
    import sentencepiece

    m = sentencepiece.SentencePieceProcessor(model_file=path)
    size = m.get_piece_size()
    if size > PIECES_BOUND:
        raise ValueError(f"{path} has {size} pieces; at most {PIECES_BOUND} are broadcast")
    rows, byte_ids, hexes = [], [0] * 256, [""] * size
    for i in range(size):
        piece = m.id_to_piece(i)
        if m.is_byte(i):
            byte_ids[int(piece[3:5], 16)] = i
            hexes[i] = piece[3:5]
        elif not (m.is_control(i) or m.is_unknown(i) or m.is_unused(i)):
            if "\n" in piece or " " in piece:
                raise ValueError(f"piece {i} reaches over a space or a line break")
            if len(piece) > 32:
                raise ValueError(f"piece {i} has more than 32 characters, which an edge's 5 bits for a length cannot hold")
            if MARK in piece.lstrip(MARK):
                raise ValueError(f"piece {i} has a mark after another character")
            hexes[i] = piece.replace(MARK, " ").encode().hex()
            rows.append((piece, i, m.get_score(i)))
    return Pieces(rows, byte_ids, hexes)


def encode_words(words: DataFrame, pieces: Pieces) -> DataFrame:
    """(bucket, word, ids) for distinct non-null, non-empty words (bucket int, word) of at most LONG characters."""
    spark = words.sparkSession
    longest, unknown = pieces.longest, pieces.unknown
    spaced = [(p.replace(MARK, " "), i) for p, i, _ in pieces.rows]
    rows = F.broadcast(spark.createDataFrame(spaced, "piece string, id int"))
    scores = ["0"] * len(pieces.hexes)
    for _, i, s in pieces.rows:
        scores[i] = repr(s)
    literal = lambda items, kind: F.split(F.lit(" ".join(items)), " ").cast(f"array<{kind}>")
    # Dealt before they are exploded, so that the edges need no exchange.
    words = words.repartition(shuffle_partitions(spark), "bucket", "word")
    starts = words.select("bucket", "word", F.explode(F.sequence(F.lit(1), F.length("word"))).alias("i"))
    spans = starts.select("bucket", "word", "i", F.explode(F.sequence(F.lit(1), F.least(F.length("word") - F.col("i") + 1, F.lit(longest)))).alias("len"))
    spans = spans.select("bucket", "word", (F.col("i") + F.col("len") - 1).alias("end"), "len", F.substring("word", F.col("i"), F.col("len")).alias("piece"))
    joined = spans.join(rows, "piece", "left")
    allowed = F.col("id").isNotNull()
    # An edge in one number: its end, then the shorter start first, then the piece (0: unknown character).
    edge = F.expr(f"shiftleft(cast(end AS bigint), 24) + shiftleft(cast({longest} - len AS bigint), 19)").alias("at")
    edges = joined.filter(allowed | (F.col("len") == 1)).select("bucket", "word", (edge + F.when(allowed, F.col("id") + 1).otherwise(0)).alias("edge"))
    lattice = edges.groupBy("bucket", "word").agg(F.sort_array(F.collect_list("edge")).alias("edges"))
    table_row = literal(scores, "double")
    zero = F.array(F.struct(F.lit(0.0).alias("s"), F.lit(0).alias("start"), F.lit(-1).alias("id")))

    def step(best, e):
        end = F.shiftright(e, 24).cast("int")
        start = end - (F.lit(longest) - F.shiftright(e, 19).bitwiseAND(31)).cast("int")
        number = e.bitwiseAND((1 << 19) - 1).cast("int") - 1
        s = F.element_at(best, start + 1)["s"] + F.when(number < 0, F.lit(unknown)).otherwise(F.element_at(table_row, F.greatest(number, F.lit(0)) + 1))
        new = F.struct(s.alias("s"), start.alias("start"), number.alias("id"))
        return (
            F.when(F.size(best) == end, F.array_append(best, new))
            .when(s > F.element_at(best, end + 1)["s"], F.array_append(F.slice(best, 1, end), new))
            .otherwise(best)
        )

    folded = lattice.select("bucket", "word", F.aggregate("edges", zero, step).alias("best"))
    path = folded.select("bucket", "word", F.reverse(F.expr(
        "aggregate(sequence(size(best) - 1, 1, -1), named_struct('at', size(best) - 1, 'path', cast(array() AS array<int>)), "
        "(a, i) -> if(i = a.at, named_struct('at', element_at(best, i + 1).start, 'path', array_append(a.path, if(element_at(best, i + 1).id < 0, -i, element_at(best, i + 1).id))), a)).path"
    )).alias("path"))
    bytes_row = literal([str(i) for i in pieces.byte_ids], "int")

    def spelled(x):
        code = F.hex(F.encode(F.substring(F.col("word"), -x, F.lit(1)), "utf-8"))
        each = F.transform(F.sequence(F.lit(0), (F.length(code) / 2).cast("int") - 1), lambda k: F.element_at(bytes_row, F.conv(F.substring(code, k * 2 + 1, F.lit(2)), 16, 10).cast("int") + 1))
        return F.when(x < 0, each).otherwise(F.array(x))

    return path.select("bucket", "word", F.when(F.exists("path", lambda x: x < 0), F.flatten(F.transform("path", spelled))).otherwise(F.col("path")).alias("ids"))


def decode(ids, pieces: Pieces):
    """Column of text from a column of ids: pieces' bytes side by side, marks as spaces, without the first space.

    Null ids give null; no ids give ''. Only ids of the table are defined.
    """
    hexes = F.split(F.lit(" ".join(h or "-" for h in pieces.hexes)), " ")
    data = F.unhex(F.array_join(F.transform(ids, lambda i: F.element_at(hexes, i + 1)), ""))
    return F.substring(F.decode(data, "utf-8"), 2, 2_000_000_000)


def _spans(texts: list[bytes], together: np.ndarray):
    """Data, starts and ends of all words of texts and the number of words of each text.

    A word's spaces are in the data, the one in front of the text as well. A text without bytes has no word.
    """
    data = np.frombuffer(b" " + b" ".join(texts), np.uint8)
    sizes = np.fromiter((len(t) for t in texts), np.int64, len(texts))
    begin = np.cumsum(sizes + 1) - (sizes + 1)
    first = np.ones(len(data), bool)
    first[1:] = ~together[data[:-1], data[1:]]
    first[begin] = True
    starts = np.flatnonzero(first)
    ends = np.append(starts[1:], len(data))
    text = np.searchsorted(begin, starts, "right") - 1
    real = sizes[text] > 0
    return data, starts[real], ends[real], np.bincount(text[real], minlength=len(texts))


def _hashes(data, starts, ends) -> np.ndarray:
    return span_hash(prefix_hash(data), starts, ends)


def _strings(sizes: bytes, body: bytes) -> pa.Array:
    """The words of one request."""
    size = np.frombuffer(unsqueeze(sizes), np.int32)
    stop = np.concatenate([[0], np.cumsum(size)]).astype(np.int32)
    return pa.Array.from_buffers(pa.string(), len(size), [None, pa.py_buffer(stop.tobytes()), pa.py_buffer(unsqueeze(body))])


ASKED = "bucket int, shard int, sizes binary, body binary"
ANSWERED = "shard int, bucket int, sizes binary, body binary"
ENCODED = "doc_id long, ids array<int>"


def encode(docs: DataFrame, pieces: Pieces, shards: int | None = None) -> DataFrame:
    """(doc_id, ids) for every row of docs (doc_id long, text).

    Null and empty texts have no ids; null ids of rows stay null; rows that repeat are encoded alike; other columns are
    ignored; an empty table gives an empty result. Texts and words of any length are encoded whole.
    """
    spark = docs.sparkSession
    keys = even_keys(spark, shards or shuffle_partitions(spark))
    place = {k: i for i, k in enumerate(keys)}
    together = pieces.together()
    bundles = packed(docs.select("doc_id", F.lit(True).alias("flag"), "text"), keys)

    def requests(key: tuple, rows: pa.Table) -> pa.Table:
        texts = unpacked(rows.to_pandas())[3]
        names, words = [np.zeros(0, np.uint64)], []
        for a, b in chunks(np.fromiter((len(t) for t in texts), np.int64, len(texts))):
            data, starts, ends, _ = _spans(texts[a:b], together)
            distinct, first = np.unique(_hashes(data, starts, ends), return_index=True)
            new = ~np.isin(distinct, np.concatenate(names), assume_unique=True)
            names.append(distinct[new])
            raw = data.tobytes()
            words += [raw[s:e] for s, e in zip(starts[first[new]].tolist(), ends[first[new]].tolist())]
        name = np.concatenate(names)
        order = np.argsort(name)
        at = bucket_cuts(name[order], len(keys))
        out = []
        for i, (a, b) in enumerate(zip(at[:-1], at[1:])):
            own = [words[j] for j in order[a:b]]
            if own:
                out.append((keys[i], key[0].as_py(), squeeze(np.fromiter((len(w) for w in own), np.int32, len(own)).tobytes()), squeeze(b"".join(own))))
        return pa.table([pa.array(c, t) for c, t in zip(zip(*out) if out else [[]] * 4, [pa.int32(), pa.int32(), pa.binary(), pa.binary()])], names=["bucket", "shard", "sizes", "body"])

    asked = bundles.groupBy("shard").applyInArrow(requests, ASKED).repartition(len(keys), "bucket")

    def distinct(key: tuple, rows: pa.Table) -> pa.Table:
        words = pa.chunked_array([_strings(s.as_py(), b.as_py()) for s, b in zip(rows.column("sizes"), rows.column("body"))], pa.string()).unique()
        words = words.filter(pc.less_equal(pc.utf8_length(words), LONG))
        return pa.table([pa.array(np.full(len(words), key[0].as_py(), np.int32)), words], names=["bucket", "word"])

    coded = encode_words(asked.groupBy("bucket").applyInArrow(distinct, "bucket int, word string"), pieces)

    def answer(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
        known = right.column("word").combine_chunks()
        lists = right.column("ids").combine_chunks()
        flat = lists.flatten().to_numpy(zero_copy_only=False).astype(np.int32, copy=False)
        sizes = lists.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
        out = []
        for shard, size, body in zip(left.column("shard"), left.column("sizes"), left.column("body")):
            words = _strings(size.as_py(), body.as_py())
            at = pc.index_in(words, value_set=known)
            long = {i: np.array(pieces.best_path(words[i].as_py()), np.int32) for i in np.flatnonzero(at.is_null().to_numpy(zero_copy_only=False)).tolist()}
            at = at.fill_null(0).to_numpy(zero_copy_only=False)
            ids, count = _taken(flat, sizes, at) if len(sizes) else (np.zeros(0, np.int32), np.zeros(len(at), np.int64))
            if long:
                upto = np.cumsum(count)
                parts = [long.get(i, ids[b - n : b]) for i, (n, b) in enumerate(zip(count.tolist(), upto.tolist()))]
                ids, count = np.concatenate(parts), np.array([len(x) for x in parts])
            out.append((shard.as_py(), key[0].as_py(), squeeze(count.astype(np.int32).tobytes()), squeeze(ids.astype(np.int32).view(np.uint8).reshape(-1, 4).T.tobytes())))
        return pa.table([pa.array(c, t) for c, t in zip(zip(*out) if out else [[]] * 4, [pa.int32(), pa.int32(), pa.binary(), pa.binary()])], names=["shard", "bucket", "sizes", "body"])

    replies = asked.groupBy("bucket").cogroup(coded.groupBy("bucket")).applyInArrow(answer, ANSWERED)

    def lay_out(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
        ids, null, _, texts = unpacked(left.select(["ids", "nulls", "flags", "sizes", "body"]).to_pandas())
        del left
        order = np.argsort([place[b.as_py()] for b in right.column("bucket")], kind="stable")
        sizes = np.concatenate([np.zeros(0, np.int32), *[np.frombuffer(unsqueeze(right.column("sizes")[i].as_py()), np.int32) for i in order.tolist()]]).astype(np.int64)
        flat = np.concatenate([np.zeros(0, np.int32), *[np.ascontiguousarray(np.frombuffer(unsqueeze(right.column("body")[i].as_py()), np.uint8).reshape(4, -1).T).view(np.int32).ravel() for i in order.tolist()]])
        del right
        parts = chunks(np.fromiter((len(t) for t in texts), np.int64, len(texts)))
        hashes, counts = [np.zeros(0, np.uint64)], []
        for a, b in parts:
            data, starts, ends, count = _spans(texts[a:b], together)
            hashes.append(_hashes(data, starts, ends))
            counts.append(count)
        texts.clear()
        # The shard asked in the order of its distinct hashes.
        names = np.unique(np.concatenate([np.unique(h) for h in hashes]))
        lists = []
        for own, count in zip(hashes[1:], counts):
            coded, n = _taken(flat, sizes, np.searchsorted(names, own))
            stops = np.concatenate([[0], np.cumsum(n)])[np.concatenate([[0], np.cumsum(count)])]
            if stops[-1] >= 1 << 31:
                raise ValueError("texts of one chunk have 2**31 ids or more")
            lists.append(pa.ListArray.from_arrays(pa.array(stops.astype(np.int32)), pa.array(coded)))
        return pa.table([pa.chunked_array([pa.array(ids, mask=null)]), pa.chunked_array(lists, pa.list_(pa.int32()))], names=["doc_id", "ids"])

    return bundles.groupBy("shard").cogroup(replies.groupBy("shard")).applyInArrow(lay_out, ENCODED)


def _taken(flat: np.ndarray, sizes: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The lists at of flat (lists of sizes side by side) one after the other, and their sizes."""
    begin, n = np.cumsum(sizes) - sizes, sizes[at]
    total = np.cumsum(n)
    return flat[np.repeat(begin[at] - (total - n), n) + np.arange(total[-1] if len(total) else 0)], n


def op10_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = load()
    coded = encode(table(spark, sf_dir, "documents"), pieces)
    text = decode(F.col("ids"), pieces)
    return coded.select("doc_id", F.size("ids").cast("long").alias("n_pieces"), "ids", F.md5(F.encode(text, "utf-8")).alias("decoded_md5"))


QUERIES = {"op10_pieces": op10_pieces}
ORACLES: dict[str, str] = {}
