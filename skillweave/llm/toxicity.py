"""Operator 4: toxicity by a bidirectional gated recurrent network with attention pooling, trained and run in numpy.

A word enters as two vectors side by side: an embedding of the whole word (hashed) and the mean of embeddings of its byte
5-grams with its borders (hashed), so that unseen words still show their characters. Every text is cut into overlapping
windows of WINDOW words, STRIDE apart; the network reads each window in both directions, attention pools its states, and a
text's logit is its highest window's. A logistic curve fitted on rows the network has not trained on turns it into a score.

Learning is by multiple instances: first every window carries its text's label, later each text trains by the windows the
network now rates highest. The network learns from at most SAMPLE labelled texts of SAMPLE_BYTES bytes together (positive
ones at most a third of them, rank by a hash of the id; texts over TEXT_BYTES are not learned from); scoring covers every
window of every text. One executor task reads the sample and returns the weights alone. Scoring shuffles nothing: the
fitted network has a fixed size and goes to the tasks with the function.
"""

from __future__ import annotations

import pickle
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from skillweave.llm.common import LOWER, SEPARATORS, chunks, mixed, prefix_hash, release, span_hash, table, text_bytes

WINDOW = 64
STRIDE = 48
#: Bound of the sample of labelled texts the network is fitted on.
SAMPLE = 3000
#: Bound of the sample's bytes, and of one of its texts.
SAMPLE_BYTES = 32 << 20
TEXT_BYTES = 1 << 18
WORD_ROWS = 1 << 15
GRAM_ROWS = 1 << 15
WORD_DIM = 8
GRAM_DIM = 8
HIDDEN = 16
GRAM = 5
STEPS = (160, 120, 120)
BATCH = 192
#: Windows read side by side; bounds a task's memory.
CHUNK = 1024


def _tokens(texts: list[bytes]):
    """Distinct words of the texts (hash, gram ids, gram counts) and each text's words as indices into them."""
    sizes = np.fromiter((len(t) for t in texts), np.int64, len(texts))
    known, grams, counts = [np.zeros(0, np.uint64)], [np.zeros(0, np.int32)], [np.zeros(0, np.int64)]
    words, ends_at = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
    for a, b in chunks(sizes):
        data = LOWER[np.frombuffer(b"\n" + b"\n".join(texts[a:b]) + b"\n" * (GRAM + 1), np.uint8)]
        edge = np.flatnonzero(np.diff(SEPARATORS[data], prepend=True))
        starts, ends = edge[0::2], edge[1::2]
        hashes = span_hash(prefix_hash(data), starts, ends)
        words.append(hashes)
        ends_at.append(np.diff(np.searchsorted(starts, np.cumsum(sizes[a:b] + 1) + 1, "left"), prepend=0))
        distinct, first = np.unique(hashes, return_index=True)
        new = ~np.isin(distinct, np.concatenate(known), assume_unique=True)
        distinct, first = distinct[new], first[new]
        start, n = starts[first] - 1, np.maximum(1, (ends - starts)[first] + 3 - GRAM)
        owner = np.repeat(np.arange(len(start)), n)
        place = start[owner] + np.arange(len(owner)) - np.repeat(np.cumsum(n) - n, n)
        last = ends[first][owner]
        code = np.zeros(len(place), np.uint64)
        for i in range(GRAM):
            code = code * np.uint64(257) + np.where(place + i <= last, data[place + i], 0).astype(np.uint64)
        known.append(distinct)
        grams.append((mixed(code) % np.uint64(GRAM_ROWS)).astype(np.int32))
        counts.append(n)
    distinct = np.concatenate(known)
    order = np.argsort(distinct)
    index = order[np.searchsorted(distinct[order], np.concatenate(words))] if len(distinct) else np.zeros(0, np.int64)
    upto = np.cumsum(np.concatenate(ends_at))
    return distinct, np.concatenate(grams), np.concatenate(counts), index, upto - np.concatenate(ends_at), upto


def _windows(first: np.ndarray, upto: np.ndarray, window: int, stride: int):
    """Start, end and text of every window: all starts a stride apart until one reaches the text's end."""
    size = upto - first
    count = np.where(size > 0, 1 + np.maximum(0, -(-(size - window) // stride)), 0)
    owner = np.repeat(np.arange(len(size)), count)
    start = first[owner] + stride * (np.arange(len(owner)) - np.repeat(np.cumsum(count) - count, count))
    return start, np.minimum(start + window, upto[owner]), owner


def _sigmoid(x):
    np.clip(x, -30, 30, out=x)
    np.negative(x, out=x)
    np.exp(x, out=x)
    x += 1
    return np.reciprocal(x, out=x)


@dataclass
class Network:
    """Weights by name; gates lie side by side as reset, update, candidate."""

    p: dict = field(default_factory=dict)
    slope: float = 1.0
    shift: float = 0.0

    @staticmethod
    def fresh(seed: int) -> "Network":
        r = np.random.default_rng(seed)
        h, e = HIDDEN, WORD_DIM + GRAM_DIM
        f = lambda *s, by: (r.standard_normal(s) * by).astype(np.float32)
        p = {"words": f(WORD_ROWS, WORD_DIM, by=0.1), "grams": f(GRAM_ROWS, GRAM_DIM, by=0.1), "win": f(e, 6 * h, by=e**-0.5), "bin": np.zeros(6 * h, np.float32)}
        p |= {"uf": f(h, 3 * h, by=h**-0.5), "ub": f(h, 3 * h, by=h**-0.5), "att": f(2 * h, 2 * h, by=(2 * h) ** -0.5), "attb": np.zeros(2 * h, np.float32)}
        p |= {"v": f(2 * h, by=0.5), "out": f(2 * h, by=0.3), "outb": np.zeros(1, np.float32)}
        return Network(p)

    def inputs(self, distinct: np.ndarray, grams: np.ndarray, n: np.ndarray):
        """Gate inputs of distinct words for both directions, with what a backward pass needs."""
        rows = (distinct % np.uint64(WORD_ROWS)).astype(np.int32)
        means = np.add.reduceat(self.p["grams"][grams], np.cumsum(n) - n, axis=0) / n[:, None].astype(np.float32) if len(n) else np.zeros((0, GRAM_DIM), np.float32)
        x = np.concatenate([self.p["words"][rows], means], axis=1)
        return x @ self.p["win"] + self.p["bin"], x, rows

    @staticmethod
    def halves(gates: np.ndarray, pad: bool = False) -> list[np.ndarray]:
        """Gate inputs of either direction; with pad and a row of zeros at the end."""
        out = []
        for half in np.split(gates, 2, axis=1):
            out.append(np.zeros((len(gates) + pad, half.shape[1]), np.float32))
            out[-1][: len(gates)] = half
        return out

    def read(self, halves: list[np.ndarray], ids: np.ndarray, mask: np.ndarray, keep: bool = False):
        """Logits of windows (rows of ids, right-padded; mask is 0 at padding); with keep, also the trace."""
        p, h = self.p, HIDDEN
        b, steps = ids.shape
        states = np.empty((steps, b, 2 * h), np.float32)
        trace = [{}, {}]
        for d, u, order in ((0, p["uf"], range(steps)), (1, p["ub"], range(steps - 1, -1, -1))):
            own = halves[d]
            state = np.zeros((b, h), np.float32)
            for t in order:
                x = own[ids[:, t]]
                a = state @ u
                rz = _sigmoid(x[:, : 2 * h] + a[:, : 2 * h])
                r, z = rz[:, :h], rz[:, h:]
                c = np.tanh(x[:, 2 * h :] + r * a[:, 2 * h :])
                new = (c + z * (state - c)) * mask[:, t : t + 1]
                if keep:
                    trace[d][t] = (state, r, z, c, a[:, 2 * h :])
                state = new
                states[t, :, h * d : h * (d + 1)] = state
        bent = np.tanh(states @ p["att"] + p["attb"])
        score = np.where(mask.T > 0, bent @ p["v"], -1e9)
        weight = np.exp(score - score.max(axis=0))
        weight /= weight.sum(axis=0)
        pooled = np.einsum("tb,tbh->bh", weight, states)
        logit = pooled @ p["out"] + p["outb"][0]
        return (logit, (states, trace, bent, weight, pooled)) if keep else logit

    def gradients(self, gates, x, rows, grams, n, ids, mask, label):
        """Mean logistic loss and its gradients over a batch of windows."""
        p, h = self.p, HIDDEN
        logit, (states, trace, bent, weight, pooled) = self.read(self.halves(gates), ids, mask, True)
        prob = 1 / (1 + np.exp(-np.clip(logit, -30, 30)))
        d = ((prob - label) / len(label)).astype(np.float32)
        g = {"out": pooled.T @ d, "outb": np.array([d.sum()], np.float32)}
        dpool = d[:, None] * p["out"]
        dw = np.einsum("bh,tbh->tb", dpool, states)
        ds = weight * (dw - (weight * dw).sum(axis=0))
        dstates = weight[:, :, None] * dpool
        g["v"] = np.einsum("tb,tbh->h", ds, bent)
        dbent = ds[:, :, None] * p["v"] * (1 - bent**2)
        g["att"] = np.einsum("tbi,tbj->ij", states, dbent)
        g["attb"] = dbent.sum(axis=(0, 1))
        dstates = dstates + dbent @ p["att"].T
        dgates = np.zeros_like(gates)
        steps = ids.shape[1]
        by = np.argsort(ids.T.ravel(), kind="stable")
        places, heads = np.unique(ids.T.ravel()[by], return_index=True)
        for k, name, order in ((0, "uf", range(steps - 1, -1, -1)), (1, "ub", range(steps))):
            u = p[name]
            g[name] = np.zeros_like(u)
            carry = np.zeros((len(label), h), np.float32)
            into = np.empty((steps, len(label), 3 * h), np.float32)
            for t in order:
                state, r, z, c, ac = trace[k][t]
                dh = (carry + dstates[t, :, h * k : h * (k + 1)]) * mask[:, t : t + 1]
                dc = dh * (1 - z) * (1 - c**2)
                dr, dz = dc * ac * r * (1 - r), dh * (state - c) * z * (1 - z)
                da = np.concatenate([dr, dz, dc * r], axis=1)
                g[name] += state.T @ da
                carry = dh * z + da @ u.T
                into[t] = np.concatenate([dr, dz, dc], axis=1)
            dgates[places, 3 * h * k : 3 * h * (k + 1)] = np.add.reduceat(into.reshape(-1, 3 * h)[by], heads, axis=0)
        g["win"], g["bin"] = x.T @ dgates, dgates.sum(axis=0)
        dx = dgates @ p["win"].T
        g["words"], g["grams"] = (rows, dx[:, :WORD_DIM]), (grams, np.repeat(dx[:, WORD_DIM:] / n[:, None].astype(np.float32), n, axis=0))
        return g

    def logits(self, texts: list[bytes], window: int = WINDOW, stride: int = STRIDE) -> np.ndarray:
        """Highest window logit of each text; a text without words reads as one empty window."""
        distinct, grams, n, index, first, upto = _tokens(texts)
        start, end, owner = _windows(first, upto, window, stride)
        logit = self._run(self.inputs(distinct, grams, n)[0], index, start, end)
        out = np.full(len(texts), float(self.p["outb"][0]), np.float64)
        has = upto > first
        out[has] = -np.inf
        np.maximum.at(out, owner, logit)
        return out

    def _run(self, gates, index, start, end) -> np.ndarray:
        pad, halves = len(gates), self.halves(gates, pad=True)
        del gates
        logit = np.empty(len(start), np.float32)
        order = np.argsort(end - start, kind="stable")
        for at in range(0, len(order), CHUNK):
            some = order[at : at + CHUNK]
            ids, mask = _padded(index, start[some], end[some], pad)
            logit[some] = self.read(halves, ids, mask)
        return logit

    def scores(self, texts: list[bytes]) -> np.ndarray:
        z = self.slope * self.logits(texts) + self.shift
        return 1 / (1 + np.exp(-np.clip(z, -500, 500)))


def _padded(index, start, end, pad):
    size = end - start
    steps = np.arange(size.max())
    inside = steps[None, :] < size[:, None]
    ids = index[np.minimum(start[:, None] + steps, len(index) - 1)]
    return np.where(inside, ids, pad), inside.astype(np.float32)


def _platt(z: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[float, float]:
    """Slope and shift of a logistic curve; halved Newton steps, targets drawn in as Platt did so that slopes stay finite."""
    n1, n0 = y.sum(), (1 - y).sum()
    goal = np.where(y > 0, (n1 + 1) / (n1 + 2), 1 / (n0 + 2))
    mean, spread = z.mean(), z.std() + 1e-6
    x = np.stack([(z - mean) / spread, np.ones_like(z)], axis=1)
    loss = lambda c: float((weight * (np.logaddexp(0, x @ c) - goal * (x @ c))).sum() + 5e-3 * c[0] ** 2)
    c = np.array([1.0, 0.0])
    for _ in range(100):
        q = 1 / (1 + np.exp(-np.clip(x @ c, -30, 30)))
        grad = x.T @ (weight * (q - goal)) + np.array([1e-2 * c[0], 0])
        hess = (x * (weight * q * (1 - q))[:, None]).T @ x + np.diag([1e-2, 1e-6])
        step = np.linalg.solve(hess, grad)
        while loss(c - step) > loss(c) and np.abs(step).max() > 1e-9:
            step = step / 2
        c = c - step
        if np.abs(step).max() < 1e-7:
            break
    return float(c[0] / spread), float(c[1] - c[0] * mean / spread)


def train(texts: list[bytes], labels: np.ndarray, share: float | None = None, seed: int = 7, steps: tuple[int, ...] = STEPS) -> Network:
    """A network fitted on whole labelled texts; share is the population's share of label 1, by default the sample's."""
    net = Network.fresh(seed)
    labels = np.asarray(labels, np.float32)
    if not len(texts) or labels.min() == labels.max():
        net.slope, net.shift = 0.0, 6.0 if len(texts) and labels.max() > 0 else -6.0
        return net
    rng = np.random.default_rng(seed)
    held = rng.random(len(texts)) < 0.25
    distinct, grams, n, index, first, upto = _tokens(texts)
    bounds = np.concatenate([[0], np.cumsum(n)])
    start, end, owner = _windows(first, upto, WINDOW, STRIDE)
    fit = ~held[owner]
    y = labels[owner]
    momentum = {k: [np.zeros_like(v), np.zeros_like(v)] for k, v in net.p.items()}
    done = 0
    pools = [np.flatnonzero(fit & (y == k)) for k in (0, 1)]
    for phase, rounds in enumerate(steps):
        if phase:
            logit = net._run(net.inputs(distinct, grams, n)[0], index, start, end)
            order = np.lexsort((-logit, owner))
            rank = np.empty(len(order), np.int64)
            rank[order] = np.arange(len(order)) - np.searchsorted(owner[order], owner[order], "left")
            pools = [np.flatnonzero(fit & (y == 0) & (rank < 4)), np.flatnonzero(fit & (y == 1) & (rank < 2))]
        for _ in range(rounds):
            if not all(len(x) for x in pools):
                break
            some = np.concatenate([rng.choice(pools[1], BATCH // 3), rng.choice(pools[0], BATCH - BATCH // 3)])
            ids, mask = _padded(index, start[some], end[some], 0)
            words, local = np.unique(ids, return_inverse=True)
            local = local.reshape(ids.shape)
            mine = grams[np.repeat(bounds[words] - np.cumsum(n[words]) + n[words], n[words]) + np.arange(n[words].sum())]
            gates, x, rows = net.inputs(distinct[words], mine, n[words])
            g = net.gradients(gates, x, rows, mine, n[words], local, mask, y[some])
            done += 1
            rate = 0.01 if phase < 2 else 0.004
            for name, grad in g.items():
                m, v = momentum[name]
                if isinstance(grad, tuple):
                    at, back = np.unique(grad[0], return_inverse=True)
                    dense = np.zeros((len(at), grad[1].shape[1]), np.float32)
                    by = np.argsort(back, kind="stable")
                    dense[:] = np.add.reduceat(grad[1][by], np.unique(back[by], return_index=True)[1], axis=0)
                    v[at] += dense**2
                    net.p[name][at] -= 0.1 * dense / (np.sqrt(v[at]) + 1e-7)
                else:
                    m += 0.1 * (grad - m)
                    v += 0.01 * (grad**2 - v)
                    net.p[name] -= rate * (m / (1 - 0.9**done)) / (np.sqrt(v / (1 - 0.99**done)) + 1e-7)
    use = held if min((labels[held] == k).sum() for k in (0, 1)) >= 5 else np.ones(len(texts), bool)
    z = net.logits([t for t, k in zip(texts, use) if k])
    target = labels[use].astype(np.float64)
    mean = float(labels.mean()) if share is None else min(max(share, 1e-4), 1 - 1e-4)
    own = target.mean()
    net.slope, net.shift = _platt(z, target, np.where(target > 0, mean / own, (1 - mean) / (1 - own)))
    net.slope = max(net.slope, 1e-3)
    return net


def labelled_sample(docs: DataFrame, labels: DataFrame, size: int = SAMPLE, most: int = SAMPLE_BYTES, longest: int = TEXT_BYTES) -> tuple[DataFrame, float]:
    """Rows (doc_id, text binary, toxic) to learn from, and the share of label 1 in all that could be learned from.

    At most size rows and most bytes, a third of either at most of label 1, by the hash of the id. Rows whose crc32(doc_id as
    text) mod 5 is 0 are left out, and so are texts of more than longest bytes. labels has doc_id and toxic; null labels and
    ids are left out; an id that is labelled both ways counts as toxic; of texts that repeat an id the greatest is taken. A
    null text is an empty one.
    """
    known = labels.filter(F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    known = known.filter(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 != 0)
    sizes = docs.select("doc_id", F.coalesce(F.octet_length("text"), F.lit(0)).alias("bytes")).groupBy("doc_id").agg(F.max("bytes").cast("long").alias("bytes"))
    known = known.join(sizes.filter(F.col("bytes") <= longest), "doc_id")
    counts = {r.toxic: r["count"] for r in known.groupBy("toxic").count().collect()}
    total = sum(counts.values())
    rank = (F.xxhash64("doc_id"), F.col("doc_id"))

    def ranked(k: int, rows: int, room: int) -> DataFrame:
        first = known.filter(F.col("toxic") == k).orderBy(*rank).limit(rows)
        return first.withColumn("upto", F.sum("bytes").over(W.partitionBy("toxic").orderBy(*rank))).filter(F.col("upto") <= room).select("doc_id", "toxic")

    positive = min(counts.get(1, 0), size // 3)
    chosen = ranked(1, positive, most // 3).unionByName(ranked(0, size - positive, most - most // 3))
    rows = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").groupBy("doc_id").agg(F.max(F.coalesce("text", F.lit(""))).alias("text"), F.max("toxic").alias("toxic"))
    return rows.select("doc_id", F.encode("text", "utf-8").alias("text"), "toxic"), counts.get(1, 0) / total if total else 0.0


def fitted(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Network:
    """A network fitted on the labelled sample in one executor task; without labelled rows it calls nothing toxic."""
    rows, share = labelled_sample(docs, labels, sample)

    def run(batches):
        found = sorted(r for batch in batches for r in zip(*(c.to_pylist() for c in batch.columns)))
        net = train([bytes(t) for _, t, _ in found], np.array([y for _, _, y in found], np.float32), share)
        yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(net)], pa.binary())], ["net"])
        release()

    out = rows.repartition(1).mapInArrow(run, "net binary").collect()
    return pickle.loads(out[0].net) if out else train([], np.zeros(0))


def score_texts(docs: DataFrame, net: Network) -> DataFrame:
    """docs (doc_id, text, ...) with a column score added last, in 0..1.

    Every row is scored; null and empty texts read as one empty window. Columns of any name pass through, except that an
    own column named score is replaced. An empty table gives an empty result.
    """
    docs = docs.drop("score")
    at = docs.columns.index("text")
    schema = T.StructType([*docs.schema.fields, T.StructField("score", T.DoubleType())])

    def run(batches):
        for batch in batches:
            data, starts, ends = text_bytes(batch.column(at))
            out = [net.scores([bytes(data[s:e]) for s, e in zip(starts[a:b].tolist(), ends[a:b].tolist())]) for a, b in chunks(ends - starts)]
            score = pa.array(np.concatenate(out) if out else np.zeros(0), pa.float64())
            yield pa.RecordBatch.from_arrays([*batch.columns, score], [*batch.schema.names, "score"])
        release()

    return docs.mapInArrow(run, schema)


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    net = fitted(docs, table(spark, sf_dir, "labels").select("doc_id", "toxic"))
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, F.lit(False))
    return score_texts(docs, net).select("doc_id", held.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


QUERIES = {"op4_toxicity": op4_toxicity}
ORACLES: dict[str, str] = {}
