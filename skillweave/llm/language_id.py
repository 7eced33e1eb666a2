"""Operator 11: language identification by hyperdimensional profiles.

Every symbol has a random vector of DIMS signs, made from its code point alone, so no table is kept or sent. An n-gram is the
product of its symbols' vectors, the earlier ones permuted (rolled) further: order counts. A text's profile is the sum
(bundle) of the vectors of all its n-grams, a language's prototype the sum over all of its training texts, and a text has the
language whose prototype has the greatest cosine with its profile.

Symbols are letters in lower case and combining marks; any run of others is one separator, also before and after a text.
Texts are read in slices that carry their last symbols on, whole texts whatever their length. A task adds up the prototypes
of what it reads and sends one vector for each language; those meet level by level. Prototypes are read back in blocks of
LANGUAGES, so neither driver nor task holds more, however many languages there are.
"""

from __future__ import annotations

import unicodedata

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skillweave.llm.common import folded, mixed, release, table, text_bytes

#: Signs of a vector; a multiple of 64.
DIMS = 1024
#: Symbols of an n-gram. Three code points fit a 64-bit key.
GRAM = 3
#: Prototypes that are compared at once; more languages take another pass over the texts.
LANGUAGES = 1024
#: Characters and texts whose n-grams are counted at once.
SLICE = 1 << 18
TEXTS = 64
#: N-gram vectors that are unrolled at once.
VECTORS = 2048
SEED = 11
UNKNOWN = "und"

_SPACE = 32
_SYMBOLS: list[np.ndarray] = []


def symbols() -> tuple[np.ndarray, np.ndarray]:
    """For every code point the symbol it reads as, and whether it is a letter."""
    if not _SYMBOLS:
        read, letter = np.full(0x110000, _SPACE, np.uint32), np.zeros(0x110000, bool)
        for c in range(0x110000):
            x = chr(c)
            if x.isalpha():
                read[c], letter[c] = ord(x.lower()[0]), True
            elif unicodedata.combining(x):
                read[c] = c
        _SYMBOLS.extend((read, letter))
    return _SYMBOLS[0], _SYMBOLS[1]


def signs(points: np.ndarray, dims: int = DIMS) -> np.ndarray:
    """The random vectors of code points, as rows of +1 and -1; the same everywhere."""
    at = points.astype(np.uint64)[:, None] * np.uint64(dims // 64) + np.arange(dims // 64, dtype=np.uint64)[None, :]
    bits = np.unpackbits(mixed(mixed(at + np.uint64(SEED << 40))).view(np.uint8).reshape(len(points), -1), axis=1)
    return (bits.astype(np.int8) << 1) - np.int8(1)


def read(text: str, carry: np.ndarray) -> tuple[np.ndarray, bool]:
    """The symbols of a slice behind the carried ones, runs of separators as one; and whether it has a letter."""
    table_, letter = symbols()
    points = np.frombuffer(text.encode("utf-32-le", "replace"), np.uint32)
    found = np.concatenate([carry, table_[points]])
    gap = found == _SPACE
    keep = ~gap
    keep[1:] |= ~gap[:-1]
    keep[: len(carry)] = True
    return found[keep], bool(letter[points].any())


class Counter:
    """Counts n-grams of many rows' texts and adds their vectors up, row by row."""

    def __init__(self, rows: int, dims: int = DIMS):
        self.bundles, self.letters = np.zeros((rows, dims)), np.zeros(rows, bool)
        self.waiting: list[tuple[int, np.ndarray]] = []
        self.size, self.dims = 0, dims

    def add(self, row: int, data: bytes) -> None:
        """All n-grams of one whole text (UTF-8); counted into row."""
        carry, at = np.full(1, _SPACE, np.uint32), 0
        while at < len(data):
            end = min(len(data), at + SLICE)
            while end < len(data) and data[end] & 0xC0 == 0x80:
                end += 1
            got, some = read(data[at:end].decode("utf-8", "replace"), carry)
            self.letters[row] |= some
            self._wait(row, got)
            carry, at = got[1 - GRAM :], end
        if len(carry) and carry[-1] != _SPACE:
            self._wait(row, np.append(carry, np.uint32(_SPACE)))

    def _wait(self, row: int, got: np.ndarray) -> None:
        if len(got) >= GRAM:
            self.waiting.append((row, got))
            self.size += len(got)
            if self.size >= SLICE:
                self.flush()

    def flush(self) -> None:
        """Counts what waits: one key for each row and n-gram, symbols numbered among those that occur."""
        if not self.waiting:
            return
        rows = np.unique([r for r, _ in self.waiting])
        whole = np.concatenate([g for _, g in self.waiting])
        owner = np.searchsorted(rows, np.repeat([r for r, _ in self.waiting], [len(g) for _, g in self.waiting]))
        piece = np.repeat(np.arange(len(self.waiting)), [len(g) for _, g in self.waiting])
        self.waiting, self.size = [], 0
        there = np.zeros(0x110000, bool)
        there[whole] = True
        points = np.flatnonzero(there)
        number = np.zeros(0x110000, np.int64)
        number[points] = np.arange(len(points))
        dense, base = number[whole], len(points)
        n = len(whole) - GRAM + 1
        key = dense[:n].copy()
        for k in range(1, GRAM):
            key = key * base + dense[k : k + n]
        key = (key + owner[:n] * base**GRAM)[piece[:n] == piece[GRAM - 1 :]]
        key, count = np.unique(key, return_counts=True)
        row, gram = np.divmod(key, base**GRAM)
        distinct, place = np.unique(gram, return_inverse=True)
        letters = signs(points, self.dims)
        rolled = [np.roll(letters, GRAM - 1 - k, 1) for k in range(GRAM)]
        order = np.argsort(place, kind="stable")
        cut = np.searchsorted(place[order], np.arange(0, len(distinct) + VECTORS, VECTORS))
        for i, at in enumerate(range(0, len(distinct), VECTORS)):
            rest, vectors = distinct[at : at + VECTORS], None
            for k in range(GRAM - 1, -1, -1):
                rest, one = np.divmod(rest, base)
                vectors = rolled[k][one] if vectors is None else vectors * rolled[k][one]
            some = order[cut[i] : cut[i + 1]]
            counts = np.zeros((len(rows), len(vectors)), np.float32)
            counts[row[some], place[some] - at] = count[some]
            self.bundles[rows] += counts @ vectors.astype(np.float32)


def prototypes(docs: DataFrame, dims: int = DIMS) -> DataFrame:
    """(lang, body): for every language the summed profiles of all rows of docs (lang, text) as doubles; null lang or text teaches nothing."""

    def run(batches):
        found: dict[str, Counter] = {}
        for batch in batches:
            data, starts, ends = text_bytes(batch.column(1))
            for lang, s, e in zip(batch.column(0).to_pylist(), starts.tolist(), ends.tolist()):
                found.setdefault(lang, Counter(1, dims)).add(0, bytes(data[s:e]))
        out = []
        for lang, counter in found.items():
            counter.flush()
            if counter.bundles.any():
                out.append((lang, TaskContext.get().partitionId(), counter.bundles[0].tobytes()))
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out) if out else [()] * 3, [pa.string(), pa.int64(), pa.binary()])], ["lang", "place", "body"])
        release()

    known = docs.select("lang", "text").filter("lang IS NOT NULL AND text IS NOT NULL")
    return folded(known.mapInArrow(run, "lang string, place long, body binary"), lambda bodies: sum(map(np.frombuffer, bodies)).tobytes(), keys=("lang",))


def predicted(docs: DataFrame, known: DataFrame, dims: int = DIMS, block: int = LANGUAGES) -> DataFrame:
    """docs (doc_id, held_out, text) as (doc_id, held_out, lang_pred, score), by the prototypes known (lang, body).

    Every row is scored, whole texts; the cosine counts from 0 to 1. Null texts and texts without a letter are UNKNOWN with
    score 0, as all are if nothing is known. Equal cosines go to the language first in code point order. Texts that read as
    one letter between separators have an n-gram, so any letter gives a profile.
    """
    n, schema = known.count(), "doc_id {}, held_out boolean, lang_pred string, score double"
    schema = schema.format(dict(docs.dtypes)["doc_id"])
    rows = docs.select("doc_id", "held_out", "text", F.lit(UNKNOWN).alias("lang_pred"), F.lit(0.0).alias("score"))
    for at in range(0, n, block):
        some = known.orderBy("lang").offset(at).limit(block).collect()
        matrix = np.stack([np.frombuffer(r.body) for r in some])
        sent = docs.sparkSession.sparkContext.broadcast(([r.lang for r in some], (matrix / np.linalg.norm(matrix, axis=1, keepdims=True)).T))
        last = at + block >= n

        def run(batches, sent=sent, last=last):
            langs, units = sent.value
            for batch in batches:
                data, starts, ends = text_bytes(batch.column(2))
                best, score = batch.column(3).to_pylist(), batch.column(4).to_numpy(zero_copy_only=False).copy()
                for a in range(0, len(best), TEXTS):
                    counter = Counter(min(TEXTS, len(best) - a), dims)
                    for i, (s, e) in enumerate(zip(starts[a : a + TEXTS].tolist(), ends[a : a + TEXTS].tolist())):
                        counter.add(i, bytes(data[s:e]))
                    counter.flush()
                    norm = np.sqrt((counter.bundles**2).sum(1))
                    cosine = np.round(counter.bundles @ units / np.maximum(norm, 1e-300)[:, None], 12)  # equal prototypes tie whatever the order of sums
                    first = cosine.argmax(1)
                    for i, f in enumerate(first.tolist()):
                        value = min(1.0, max(0.0, float(cosine[i, f])))
                        if counter.letters[i] and (best[a + i] == UNKNOWN and not score[a + i] or value > score[a + i]):
                            best[a + i], score[a + i] = langs[f], value
                columns = [batch.column(0), batch.column(1), *([] if last else [batch.column(2)]), pa.array(best, pa.string()), pa.array(score, pa.float64())]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "held_out", *([] if last else ["text"]), "lang_pred", "score"])
            release()

        rows = rows.mapInArrow(run, schema if last else schema.replace("boolean", "boolean, text string"))
    return rows.drop("text")


def identified(docs: DataFrame, dims: int = DIMS, block: int = LANGUAGES) -> DataFrame:
    """(doc_id, held_out, lang_pred, score) for every row of docs (doc_id, held_out, lang, text); other columns are ignored.

    Prototypes come from all rows that are not held out (null: not). Repeated rows count as often as they occur; an empty
    table gives an empty result.
    """
    docs = docs.select("doc_id", F.coalesce("held_out", F.lit(False)).alias("held_out"), F.col("lang").cast("string").alias("lang"), F.col("text").cast("string").alias("text"))
    return predicted(docs, prototypes(docs.filter("NOT held_out"), dims), dims, block)


def op11_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    held = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0
    return identified(table(spark, sf_dir, "documents").select("doc_id", held.alias("held_out"), "lang", "text"))


QUERIES = {"op11_language_id": op11_language_id}
ORACLES: dict[str, str] = {}
