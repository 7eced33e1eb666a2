"""Operator 7: log-probabilities of texts by a weighted backoff automaton over smoothed n-grams.

States are histories (n-grams below the highest order, the start of a text among them). From a state, a word seen after
it has an arc that carries its smoothed log-probability; every other word takes the state's failure arc, whose weight is
the smoothing's share of the shorter history, to the state of that history, down to single words. Smoothing is Dirichlet's
(MacKay and Peto 1995): p(w|h) = (c(hw) + MU p(w|h'))/(c(h) + MU), h' one word shorter; single words have add-one
probabilities with one unit for all unknown words. An unseen word therefore costs exactly the failure arc's weight and
its arc further down, and each state's probabilities sum to one.

The n-grams of a corpus do not fit a machine. Texts are dealt to shards; a shard asks the hash buckets for the counts of
its own distinct n-grams (tokens repeat, so this is far less than the texts), buckets sum what the training texts of all
shards hold and answer, and the shard builds the part of the automaton its texts can reach: numbered states, arcs by state
and word, a failure arc for each state. Every text is then read once from left to right: it carries its state, and each
word follows an arc, or failure arcs until one is found, and adds up their weights. The texts of a shard advance side by
side, one word a step, so a step is a few array operations. Keys are 64-bit hashes of n-grams.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skillweave.llm.common import ASKED, answers, ask, even_keys, mixed, packed, shuffle_partitions, summed, table, unpacked, words_of

#: Order of score_corpus unless it is told another, and of the query.
ORDER, QUERY_ORDER = 2, 3
MU = 100.0
_START, _END = np.uint64(0x5851F42D4C957F2D), np.uint64(0x14057B7EF767814F)

SCORED = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"


def sequence(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Token hashes of all texts (start, words, end of each), each token's place in its text, and each text's first token."""
    words, first, upto = words_of(texts)
    size = upto - first + 2
    begin = np.cumsum(size) - size
    tokens = np.empty(int(size.sum()), np.uint64)
    place = np.arange(len(tokens)) - np.repeat(begin, size)
    inner = np.ones(len(tokens), bool)
    inner[begin] = inner[begin + size - 1] = False
    tokens[inner] = words
    tokens[begin], tokens[begin + size - 1] = _START, _END
    return tokens, place, begin


def grams(tokens: np.ndarray, place: np.ndarray, order: int):
    """For each order in turn the hash of the n-gram that ends at each token; meaningless where place < order - 1."""
    last = tokens
    yield last
    for k in range(1, order):
        prev = np.concatenate([np.zeros(1, np.uint64), last[:-1]])
        last = mixed(prev * np.uint64(0x9E3779B97F4A7C15) + tokens + np.uint64(k))
        yield last


def numbered(gram: np.ndarray, valid: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct n-grams of the valid places, ascending, and every place's number among them (0 where not valid)."""
    distinct, back = np.unique(gram[valid], return_inverse=True)
    index = np.zeros(len(gram), np.int32)
    index[valid] = back
    return distinct, index


class Automaton:
    """States, arcs and failure arcs that a shard's texts can reach; state 0 is the empty history.

    index holds each place's n-gram number by order, counts the training count of each number. A history is a state if
    training texts hold it. An arc that training has seen leads to the longest state that its history and word end in; the
    empty history has an arc for every word, known or not. Failure arcs lead to the history without its first word.
    """

    def __init__(self, index: list[np.ndarray], place: np.ndarray, counts: list[np.ndarray], vocabulary: int, total: int, mu: float):
        words = len(counts[0])
        p = (counts[0] + 1.0) / (total + vocabulary + 1)
        numbers, begin = [], 1
        for c in counts[: max(1, len(counts) - 1)]:
            numbers.append(np.where(c > 0, begin + np.cumsum(c > 0) - 1, 0).astype(np.int32))
            begin += int((c > 0).sum())
        #: The state a text starts in, by the number of its first token.
        self.first = numbers[0] if len(counts) > 1 else np.zeros(words, np.int32)
        self.words = words
        keys, weights, to = [np.arange(words, dtype=np.int64)], [np.log10(p)], [self.first]
        self.fail, self.fail_weight = np.zeros(begin, np.int32), np.zeros(begin)
        if len(counts) > 1:
            seen = counts[0] > 0
            self.fail_weight[numbers[0][seen]] = np.log10(mu / (counts[0][seen] + mu))
        for k in range(1, len(counts)):
            at = np.zeros(len(counts[k]), np.int64)
            valid = np.flatnonzero(place >= k)
            at[index[k][valid]] = valid
            history, shorter, word = index[k - 1][at - 1], index[k - 1][at], index[0][at]
            del at, valid
            seen = counts[k] > 0
            p = np.where(seen, (counts[k] + mu * p[shorter]) / (counts[k - 1][history] + mu), 0.0)
            keys.append((numbers[k - 1][history].astype(np.int64) * words + word)[seen])
            weights.append(np.log10(p[seen]))
            if k < len(counts) - 1:
                own = numbers[k][seen]
                to.append(own)
                self.fail[own] = numbers[k - 1][shorter][seen]
                self.fail_weight[own] = np.log10(mu / (counts[k][seen] + mu))
            else:
                to.append(numbers[k - 1][shorter][seen])
        keys, weights, to = np.concatenate(keys), np.concatenate(weights), np.concatenate(to)
        order = np.argsort(keys, kind="stable").astype(np.int32)
        self.keys = keys[order]
        del keys
        self.weight, self.to = weights[order], to[order]

    def step(self, state: np.ndarray, word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Log10 probabilities of one word after each state, and the states it leads to."""
        key = state.astype(np.int64) * self.words + word
        at = np.searchsorted(self.keys, key)
        miss = np.flatnonzero(self.keys[np.minimum(at, len(self.keys) - 1)] != key)
        gain = np.zeros(len(word))
        state = state.copy()
        while len(miss):
            gain[miss] += self.fail_weight[state[miss]]
            state[miss] = self.fail[state[miss]]
            key = state[miss].astype(np.int64) * self.words + word[miss]
            at[miss] = np.searchsorted(self.keys, key)
            miss = miss[self.keys[np.minimum(at[miss], len(self.keys) - 1)] != key]
        return gain + self.weight[at], self.to[at]

    def traverse(self, word: np.ndarray, begin: np.ndarray, size: np.ndarray) -> np.ndarray:
        """Log10 probability of each text (word numbers side by side, a start mark first), read once from left to right."""
        longest = np.argsort(-size, kind="stable")
        at, ends, total = begin[longest], -size[longest], np.zeros(len(begin))
        state = self.first[word[at]]
        for i in range(1, -int(ends[0]) if len(ends) else 0):
            live = int(np.searchsorted(ends, -i, "left"))
            gain, state = self.step(state[:live], word[at[:live] + i])
            total[:live] += gain
        out = np.empty(len(begin))
        out[longest] = total
        return out


def score_corpus(docs: DataFrame, order: int = ORDER, mu: float = MU, shards: int | None = None) -> DataFrame:
    """One row per row of docs (doc_id long, held_out boolean, text): counts, base score and score, see SCORED.

    Rows that are not held out (null counts as not) train the model. Null and empty texts are the end token alone. Null ids and repeated rows
    are scored like any other; other columns are ignored; an empty table gives an empty result.
    """
    spark = docs.sparkSession
    keys = even_keys(spark, shards or shuffle_partitions(spark))
    bundles = packed(docs.select("doc_id", F.coalesce("held_out", F.lit(False)).alias("flag"), "text"), keys)

    def requests(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        _, _, held, texts = unpacked(pdf)
        tokens, place, begin = sequence(texts)
        train = np.repeat(~held, np.diff(np.append(begin, len(tokens))))
        rows = []
        for k, gram in enumerate(grams(tokens, place, order)):
            valid = place >= k
            distinct, index = numbered(gram, valid)
            counts = np.bincount(index[valid], weights=train[valid], minlength=len(distinct)).astype(np.int64)
            rows += ask(key[0], k, distinct, counts, keys, every=k == 0)
        return pd.DataFrame(rows, columns=[c.split()[0] for c in ASKED.split(", ")])

    replies = summed(bundles.groupBy("shard").applyInPandas(requests, ASKED), keys, apart=int(_START))

    def scores(key: tuple, left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        ids, null, held, texts = unpacked(left)
        tokens, place, begin = sequence(texts)
        counts, index = [], []
        vocabulary = total = 0
        for k, gram in enumerate(grams(tokens, place, order)):
            index.append(numbered(gram, place >= k)[1])
            got, present, whole = answers(right, k, keys)
            counts.append(got)
            if k == 0:
                vocabulary, total = present, whole
        del tokens, gram, right, texts
        score = Automaton(index, place, counts, vocabulary, total, mu).traverse(index[0], begin, np.diff(np.append(begin, len(place))))
        count = counts[0][index[0]]
        base = np.log10((count + 1.0) / (total + vocabulary + 1))
        real = place > 0
        add = lambda x: np.add.reduceat(np.where(real, x, 0), begin) if len(begin) else np.zeros(0)
        return pd.DataFrame(
            {
                "doc_id": pd.array(np.where(null, 0, ids), dtype="Int64") if not null.any() else pd.array([None if z else int(i) for i, z in zip(ids, null)], dtype="Int64"),
                "held_out": held,
                "n_tokens": add(np.ones(len(place), np.int64)),
                "n_known": add((count > 0).astype(np.int64)),
                "train_tokens": np.full(len(begin), total),
                "base_score": add(base),
                "score": score,
            }
        )

    return bundles.groupBy("shard").cogroup(replies.groupBy("shard")).applyInPandas(scores, SCORED)


def op7_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 2, F.lit(False))
    return score_corpus(table(spark, sf_dir, "documents").select("doc_id", held.alias("held_out"), "text"), order=QUERY_ORDER)


QUERIES = {"op7_lm_scoring": op7_lm_scoring}
ORACLES: dict[str, str] = {}
