"""Language identification (11), conversation prefix trie (12), embedding whitening (13)."""

import hashlib
import random
import re
import zlib
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from skillweave.llm import language_id, prefix_trie, whitening
from skillweave.llm.common import folded

TURNS = "conv_id long, turn long, role string, text string"


def brute_trie(rows):
    """Every node by its whole sequence of turns, every sum by a look at all nodes."""
    own = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            own[c].append((turn is not None, turn or 0, role or "", hashlib.sha256(f"{len((role or '').encode())}:{role or ''}{text or ''}".encode()).hexdigest(), text or ""))
    turns = {c: [(r, t) for *_, r, _, t in sorted(x)] for c, x in own.items()}
    paths = {}
    for c in turns:
        h = zlib.crc32(str(c).encode()) % 4
        base = c - (abs(c) % 20 if c >= 0 else -(abs(c) % 20))
        paths[c] = tuple(turns.get(base, [])[:h] + turns[c][h:])
    members = defaultdict(list)
    for c, p in paths.items():
        for d in range(len(p) + 1):
            members[p[:d]].append(c)
    words = lambda t: len(re.findall("[^\x20\x09-\x0d]+", t))
    out = []
    for p, ms in members.items():
        below = [q for q in members if q[: len(p)] == p]
        childless = [q for q in below if not any(len(z) == len(q) + 1 and z[: len(q)] == q for z in members)]
        saved = sum((len(members[q]) - 1) * words(q[-1][1]) for q in below if q)
        ends = ",".join(map(str, sorted(c for c, x in paths.items() if x == p)))
        kids = sum(len(q) == len(p) + 1 for q in below)
        out.append((min(ms), len(p), min(members[p[:-1]]) if p else None, len(ms), kids, len(childless), saved, hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=str)


def conversations(seed, n):
    r = random.Random(seed)
    texts = ["hello there", "hi", "", None, "tell me\tmore  of it", " one word", "long " * 40]
    rows = []
    for c in r.sample(range(-45, 130), n):
        turns = r.choice([list(range(r.randint(1, 6))), [None, 0, 0, 3], [2, 2, 2]])
        rows += [(c, t, r.choice(["user", "assistant", None]), r.choice(texts[: r.choice([2, 7])])) for t in turns]
    return rows


@pytest.mark.parametrize("seed, block", [(1, 4096), (2, 7)])
def test_trie_against_brute_force(spark, seed, block):
    rows = conversations(seed, 60) + [(None, 1, "user", "nobody's")]
    copies = [(c, t, "user", x) for c in range(200, 215) for t, x in enumerate(["same first", "same second"])]
    rows += copies + [(300, 5, "user", "twice"), (300, 5, "user", "twice")]
    random.Random(seed).shuffle(rows)
    df = spark.createDataFrame(rows, TURNS).withColumn("depth", F.lit(7)).withColumn("digest", F.lit("x")).withColumn("pos", F.lit(1))
    got = sorted((tuple(r) for r in prefix_trie.conversation_trie(df, block).drop("digest").collect()), key=str)
    assert got == brute_trie(rows)


def test_trie_of_a_deep_conversation(spark):
    """A long conversation, alone and beside one that leaves it late: sums stay right, rows stay in proportion."""
    rows = [(20, i, "user", f"turn {i} of many") for i in range(3000)] + [(40, i, "user", f"turn {i} of many" if i < 2990 else "leaves") for i in range(3000)]
    nodes = {(r.conv_id, r.depth): r for r in prefix_trie.prefix_nodes(prefix_trie.prefixes(prefix_trie.rebuilt(prefix_trie.turns_of(spark.createDataFrame(rows, TURNS))))).collect()}
    h = zlib.crc32(b"40") % 4
    assert len(nodes) == 3001 + 10
    assert nodes[20, 0].n_leaves == 2 and nodes[20, 0].n_convs == 2 and nodes[20, 0].saved_tokens == 2990 * 4
    assert nodes[20, 2990].n_children == 2 and nodes[20, 2991].n_leaves == 1 and nodes[40, 2991].parent_conv_id == 20 and h < 4


def test_trie_of_turnless_and_empty(spark):
    none = prefix_trie.conversation_trie(spark.createDataFrame([], TURNS))
    assert none.count() == 0
    short = next(c for c in range(1, 400) if zlib.crc32(str(c).encode()) % 4 == 3 and c % 20)
    rows = [(short, 0, "user", "gone"), (short, 1, None, None)]
    (root,) = prefix_trie.conversation_trie(spark.createDataFrame(rows, TURNS)).collect()
    assert (root.conv_id, root.depth, root.parent_conv_id, root.n_convs, root.n_leaves, root.saved_tokens) == (short, 0, None, 1, 1, 0)
    assert root.ends_sha256 == hashlib.sha256(str(short).encode()).hexdigest()


VECTORS = "vec_id long, embedding array<float>"


def brute_whitening(x):
    u = np.unique(x, axis=0)
    n, s = len(u), u.sum(0)
    c = u - s / n
    w, v = np.linalg.eigh(c.T @ c / n)
    w, v = w[::-1], v[:, ::-1]
    return n, ((n * x.astype(object) - s.astype(object)) ** 2).sum(1), np.abs((x - s / n) @ v[:, :4] / np.sqrt(w[:4])), w[:4] / w.sum()


def test_whitening_against_brute_force(spark):
    r = np.random.default_rng(3)
    e = (r.normal(size=(400, 9)) * np.linspace(0.3, 0.02, 9) @ np.linalg.qr(r.normal(size=(9, 9)))[0] + 0.4).astype(np.float32)
    e[50:200] = e[7]
    odd = [(900, None), (901, []), (902, [float("nan")] * 9), (903, [float("inf")] + [0.0] * 8), (None, e[3].tolist()), (7, e[3].tolist())]
    rows = [(i, v.tolist()) for i, v in enumerate(e)] + odd
    df = spark.createDataFrame(rows, VECTORS).repartition(5).withColumn("x", F.lit("clash")).withColumn("component", F.lit(2))
    df = df.union(df.limit(1).select(F.lit(904).cast("long"), F.array(F.lit(None).cast("float")), "x", "component"))
    got = whitening.whitened(df).toPandas()
    assert len(got) == 4 * 402 and not set(got.vec_id.dropna()) & {900, 901, 902, 903, 904}
    x = np.floor(e.astype(np.float64) * 256).astype(np.int64)
    n, deviation, white, explained = brute_whitening(x)
    first = got[got.vec_id.notna() & (got.vec_id != 7)].sort_values(["vec_id", "component"])
    ids = sorted(set(range(400)) - {7})
    assert (first.n == n).all() and n == 250
    assert first.deviation.to_numpy().reshape(-1, 4)[:, 0].tolist() == deviation[ids].tolist()
    assert np.abs(first.whitened.abs().to_numpy().reshape(-1, 4) - white[ids]).max() < 1e-9
    assert np.abs(first.explained.to_numpy()[:4] / explained - 1).max() < 1e-12
    assert got.identity_error.nunique() == 1 and got.identity_error.iloc[0] < 1e-12


def test_whitening_of_few_wide_and_mixed_vectors(spark):
    make = lambda rows: whitening.whitened(spark.createDataFrame(rows, VECTORS))
    assert make([]).count() == 0
    assert make([(1, [0.5, 0.25]), (2, [0.5, 0.25])]).count() == 0
    line = make([(1, [0.0, 0.0, 0.0]), (2, [1.0, 0.0, 0.0]), (3, [0.0, 0.0, 0.0]), (4, [1.0])]).collect()
    assert {r.vec_id for r in line} == {1, 2, 3} and all(r.component == 1 and r.n == 2 and abs(abs(r.whitened) - 1) < 1e-12 and r.explained == 1.0 for r in line)
    assert {r.deviation for r in line} == {256**2}
    both = make([(i, [float(i), float(i * i % 7)]) for i in range(6)] + [(10 + i, [float(i)]) for i in range(3)]).collect()
    assert {(r.vec_id < 10, r.component, r.n) for r in both} == {(True, 1, 6), (True, 2, 6), (False, 1, 3)}


def test_whitening_is_exact_for_large_entries(spark):
    """Sums and deviations beyond 53 and beyond 64 bits; null where no long holds the deviation."""
    rows = [(1, [3.0e9, 1.0]), (2, [-2.0e9, 0.5]), (3, [1.0e9, 2.0]), (4, [float(2**54), 0.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = {r.vec_id: r for r in whitening.whitened(df.filter("vec_id < 4")).filter("component = 1").collect()}
    x = [[int(a * 256), int(b * 256)] for _, (a, b) in rows[:3]]
    s = [sum(c) for c in zip(*x)]
    for i in (1, 2, 3):
        want = sum((3 * a - t) ** 2 for a, t in zip(x[i - 1], s))
        assert got[i].deviation == (want if want < 2**63 else None)
    assert {r.deviation for r in whitening.whitened(df).collect()} == {None}
    assert whitening.integers(spark.createDataFrame([(1, [1e300]), (2, [1.0])], "vec_id long, embedding array<double>")).count() == 1


def test_rotations_keep_small_singular_values():
    """Columns graded over twelve decades: each singular value keeps its digits, unlike those of a covariance matrix."""
    r = np.random.default_rng(1)
    q = np.linalg.qr(r.normal(size=(40, 7)))[0]
    sizes = 10.0 ** -np.arange(0, 14, 2)
    sigma, v = whitening.jacobi(np.linalg.qr(q * sizes, mode="r"))
    assert np.abs(sigma / sizes - 1).max() < 1e-10 and np.abs(v.T @ v - np.eye(7)).max() < 1e-13
    for n in (2, 5, 8):
        met = [(int(p), int(q)) for ps, qs in whitening.pairings(n) for p, q in zip(ps, qs)]
        assert sorted(met) == [(i, j) for i in range(n) for j in range(i + 1, n)]


def test_folded_merges_in_levels(spark):
    rows = [(k, i, bytes([i % 251])) for k in ("a", "b") for i in range(300) if k == "a" or i % 7 == 0]
    df = spark.createDataFrame(rows, "k string, place long, body binary")
    got = {r.k: sorted(bytes(r.body)) for r in folded(df, b"".join, keys=("k",), fan=4).collect()}
    assert got == {k: sorted(b for x, _, y in rows if x == k for b in y) for k in ("a", "b")}
    assert folded(df.filter("place < 0"), b"".join, keys=("k",)).count() == 0


DOCS = "doc_id long, held_out boolean, lang string, text string"


def plain_profile(text, dims):
    """The bundle of one text, n-gram by n-gram."""
    table, letter = language_id.symbols()
    seen = [32]
    for c in text:
        s = int(table[ord(c)])
        if s != 32 or seen[-1] != 32:
            seen.append(s)
    if seen[-1] != 32:
        seen.append(32)
    total = np.zeros(dims)
    for i in range(len(seen) - 2):
        v = np.ones(dims)
        for k, s in enumerate(seen[i : i + 3]):
            v = v * np.roll(language_id.signs(np.array([s]), dims)[0], 2 - k)
        total += v
    return total


def test_profiles_against_single_ngrams(monkeypatch):
    texts = ["Äpfel und Birnen!", "a", "", "  ", "12 3", "x́y 你好 né", "ab " * 30, "𝔘nd ǅ mixed\x00 text"]
    for slice_, vectors in ((language_id.SLICE, language_id.VECTORS), (7, 3)):
        monkeypatch.setattr(language_id, "SLICE", slice_)
        monkeypatch.setattr(language_id, "VECTORS", vectors)
        counter = language_id.Counter(len(texts), 128)
        for i, t in enumerate(texts):
            counter.add(i, t.encode())
        counter.flush()
        for i, t in enumerate(texts):
            assert (counter.bundles[i] == plain_profile(t, 128)).all(), t
        assert counter.letters.tolist() == [any(c.isalpha() for c in t) for t in texts]


def languages(seed, n, words=30):
    r = random.Random(seed)
    parts = {"aa": "ba ko lu mi ra".split(), "bb": "sch ein ung ver lich".split(), "cc": "éa ou eux tre ment".split()}
    make = lambda k: " ".join("".join(r.choice(parts[k]) for _ in range(r.randint(1, 3))) for _ in range(words))
    return [(i, i % 5 == 0, k, make(k)) for i in range(n) for k in [r.choice(list(parts))]]


def test_languages_held_out(spark):
    rows = languages(1, 300)
    extra = [(900, False, None, "ver ein ung"), (901, False, "aa", None), (902, None, "bb", ""), (903, True, None, "12!"), (None, True, "cc", "ment eux tre"), (5, True, "bb", "ver lich ung")]
    df = spark.createDataFrame(rows + extra, DOCS).repartition(5).withColumn("score", F.lit("clash")).withColumn("place", F.lit(1))
    got = language_id.identified(df).collect()
    assert len(got) == 306
    by = {r.doc_id: r for r in got if r.doc_id not in (None, 5)}
    held = [(by[i].lang_pred, k) for i, h, k, _ in rows if h and i != 5]
    assert np.mean([a == b for a, b in held]) > 0.97
    for i in (901, 902, 903):
        assert (by[i].lang_pred, by[i].score) == ("und", 0.0)
    assert by[900].lang_pred == "bb" and by[902].held_out is False
    assert next(r for r in got if r.doc_id is None).lang_pred == "cc" and {r.lang_pred for r in got if r.doc_id == 5} >= {"bb"}
    assert all(0 <= r.score <= 1 for r in got)


def test_languages_against_plain_cosines(spark):
    rows = languages(2, 60, 6)
    df = spark.createDataFrame(rows, DOCS)
    known = {}
    for _, h, k, t in rows:
        if not h:
            known[k] = known.get(k, 0) + plain_profile(t, 256)
    whole = {r.doc_id: (r.lang_pred, r.score) for r in language_id.identified(df, 256).collect()}
    parts = {r.doc_id: (r.lang_pred, r.score) for r in language_id.identified(df, 256, block=2).collect()}
    assert whole.keys() == parts.keys() and all(whole[i] == (parts[i][0], pytest.approx(parts[i][1], abs=1e-9)) for i in whole)
    for i, _, _, t in rows:
        p = plain_profile(t, 256)
        best = max(sorted(known), key=lambda k: known[k] @ p / np.linalg.norm(known[k]))
        assert whole[i][0] == best
        assert whole[i][1] == pytest.approx(max(0, known[best] @ p / np.linalg.norm(known[best]) / np.linalg.norm(p)), abs=1e-9)


def test_languages_of_nothing_and_ties(spark):
    none = spark.createDataFrame([], DOCS)
    assert language_id.identified(none).count() == 0
    unknown = language_id.identified(spark.createDataFrame([(1, True, "aa", "words of it"), (2, False, None, "more")], DOCS)).collect()
    assert {(r.lang_pred, r.score) for r in unknown} == {("und", 0.0)}
    tied = language_id.identified(spark.createDataFrame([(1, False, "zz", "same text"), (2, False, "bb", "same text"), (3, True, "", "same text")], DOCS))
    assert {r.lang_pred for r in tied.collect()} == {"bb"}
    long = "ver ein ung " * 60_000
    got = language_id.identified(spark.createDataFrame([(1, False, "bb", long), (2, False, "aa", "ba ko lu"), (3, True, None, long)], DOCS)).collect()
    assert {r.doc_id: r.lang_pred for r in got}[3] == "bb"
