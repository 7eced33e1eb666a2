"""Operators over whole texts (1, 7, 8, 10) against brute force, with null, empty, long, repeated and odd rows."""

import collections
import hashlib
import math
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from skillweave.llm import jaccard_join, lm_scoring, pieces, suffix_dedup, transforms
from skillweave.llm.common import components, pack_counts, pack_sorted, unpack_counts, unpack_sorted

WORD = re.compile(r"[^\x20\x09-\x0d]+")
LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def texts():
    r = random.Random(3)
    words = ["".join(r.choice("abcdeéñ") for _ in range(r.randint(1, 7))) for _ in range(300)]
    make = lambda n: " ".join(r.choice(words) for _ in range(n))
    passage, base = make(60), make(150)
    out = [(i, make(r.randint(1, 120))) for i in range(40)]
    out += [(100 + i, f"{make(20)} {passage}\n{make(15)}") for i in range(6)]
    for i in range(8):
        w = base.split(" ")
        w[r.randrange(len(w))] = "changed"
        out.append((200 + i, " ".join(w)))
    out += [(300, base), (301, base), (302, base.upper()), (303, None), (304, ""), (305, " \n\t "), (306, "a b"), (307, "A  b"), (308, "ab" * 400), (309, "z" * 100), (310, "z" * 100), (None, make(30))]
    return out


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(texts(), "doc_id long, text string").withColumn("node", F.lit("clash")).withColumn("shard", F.lit(0)).repartition(3)


def test_packing():
    keys = np.unique(np.random.default_rng(0).integers(0, 2**64, 1000, dtype=np.uint64))
    assert (unpack_sorted(pack_sorted(keys)) == keys).all() and len(unpack_sorted(pack_sorted(keys[:0]))) == 0
    counts = np.array([-5, 0, 1, 2**62])
    assert (unpack_counts(pack_counts(counts)) == counts).all()


def test_components_of_a_chain(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(60)] + [(100, 200), (300, 300)], "a long, b long")
    got = {r.node: r.component for r in components(edges).collect()}
    assert all(got[i] == 0 for i in range(61)) and got[200] == 100 and got[300] == 300


def test_transforms_and_their_merge():
    r = random.Random(5)
    for trial in range(150):
        shards = [[bytes(r.choice(b"ab\xff" if trial % 3 == 0 else b"ab") for _ in range(r.randrange(14))) for _ in range(r.randrange(1, 5))] for _ in range(r.randrange(1, 5))]
        depth, found, rows = r.choice([1, 3, 6, 20]), [transforms.transform(s) for s in shards], []
        for strings, got in zip(shards, found):
            want = sorted((tuple(x + 1 for x in s[i:]) + (j - len(strings),), j, len(s) - i, s[i - 1] + 1 if i else 0) for j, s in enumerate(strings) for i in range(len(s) + 1))
            assert got.tolist() == [w[3] for w in want]
            owner, length, sizes = transforms.walked(got, transforms.last_to_first(got))
            assert (owner.tolist(), length.tolist(), sizes.tolist()) == ([w[1] for w in want], [w[2] for w in want], [len(s) for s in strings])
            rows += [w[0][:-1] for w in want]
        order, prefix = transforms.merge(found, depth)
        merged = [rows[i] for i in order]
        assert sorted(order.tolist()) == list(range(len(rows))) and [m[:depth] for m in merged] == sorted(m[:depth] for m in merged)
        common = [next((k for k in range(min(len(a), len(b), depth)) if a[k] != b[k]), min(len(a), len(b), depth)) for a, b in zip(merged, merged[1:])]
        assert prefix.tolist() == [-1, *common]


@pytest.mark.parametrize("crowd", [suffix_dedup.CROWD, 9, 0])
def test_suffix_dedup(spark, docs, crowd):
    order = sorted(((1 << 62 if i is None else i, (t or "").encode()) for i, t in texts()))
    seen, want = set(), {}
    for i, b in order:
        gone = np.zeros(len(b), bool)
        for s in range(len(b) - 99):
            if b[s : s + 100] in seen:
                gone[s : s + 100] = True
            seen.add(b[s : s + 100])
        edge = np.flatnonzero(np.diff(gone, prepend=False, append=False)).reshape(-1, 2)
        want[i] = (len(b), [tuple(e) for e in edge.tolist()], hashlib.sha256(np.frombuffer(b, np.uint8)[~gone].tobytes()).hexdigest())
    got = {(1 << 62 if r.doc_id is None else r.doc_id): (r.n_bytes, [(s.start, s.stop) for s in r.spans], r.kept_sha256) for r in suffix_dedup.remove_repeats(docs, crowd=crowd).collect()}
    assert got == want and sum(len(w[1]) for w in want.values()) > 10


def test_jaccard_join(spark, docs):
    sets = {}
    for i, t in texts():
        w = WORD.findall((t or "").translate(LOW))
        sets[i] = {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())
    parent = {i: i for i in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = [i for i in sets if i is not None]
    for a in ids:
        for b in ids:
            both = len(sets[a] & sets[b])
            if a < b and both and 100 * both >= 75 * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard_join.near_duplicates(docs).collect()}
    assert got == {i: (len(sets[i]), find(i) if i is not None else None) for i in sets}
    assert got[207][1] == 200 and got[307][1] == 306


def test_lm_scoring(spark, docs):
    held = F.coalesce(F.col("doc_id") % 7 == 2, F.lit(False))
    got = {r.doc_id: r for r in lm_scoring.score_corpus(docs.withColumn("held_out", held)).collect()}
    seqs = {i: ["<s>", *WORD.findall((t or "").translate(LOW)), "</s>"] for i, t in texts()}
    one, two, starts = collections.Counter(), collections.Counter(), 0
    for i, w in seqs.items():
        if i is None or i % 7 != 2:
            one.update(w[1:])
            two.update(zip(w, w[1:]))
            starts += 1
    n, v = sum(one.values()), len(one)
    context = dict(one) | {"<s>": starts}
    for i, w in seqs.items():
        base = score = 0.0
        for h, x in zip(w, w[1:]):
            p = (one[x] + 1) / (n + v + 1)
            base += math.log10(p)
            score += math.log10((two[h, x] + lm_scoring.MU * p) / (context.get(h, 0) + lm_scoring.MU))
        assert (got[i].n_tokens, got[i].n_known, got[i].train_tokens) == (len(w) - 1, sum(one[x] > 0 for x in w[1:]), n)
        assert got[i].base_score == pytest.approx(base) and got[i].score == pytest.approx(score)


def test_lm_query_scores_histories_of_two_words(spark, docs, tmp_path):
    docs.select("doc_id", "text").write.parquet(str(tmp_path / "documents.parquet"))
    got = {r.doc_id: r for r in lm_scoring.op7_lm_scoring(spark, str(tmp_path)).collect()}
    seqs = {i: ["<s>", *WORD.findall((t or "").translate(LOW)), "</s>"] for i, t in texts()}
    seen, histories, n = collections.Counter(), collections.Counter(), 0
    for i, w in seqs.items():
        if not got[i].held_out:
            n += len(w) - 1
            for at in range(1, len(w)):
                for k in range(min(at, 2) + 1):
                    seen[tuple(w[at - k : at + 1])] += 1
                    histories[tuple(w[at - k : at])] += k > 0
    v = sum(len(g) == 1 for g in seen)
    assert {r.held_out for r in got.values()} == {True, False}
    for i, w in seqs.items():
        score = 0.0
        for at in range(1, len(w)):
            p = (seen[(w[at],)] + 1) / (n + v + 1)
            for k in range(1, min(at, 2) + 1):
                p = (seen[tuple(w[at - k : at + 1])] + lm_scoring.MU * p) / (histories[tuple(w[at - k : at])] + lm_scoring.MU)
            score += math.log10(p)
        assert got[i].score == pytest.approx(score), i


def test_automaton_states_and_arcs():
    """The state carried after every word is the longest history below the order that training holds; every failure arc
    shortens the history by its first word; weights along the path add up to the smoothed probability."""
    r, order, mu = random.Random(8), 3, 7.0
    make = lambda n: " ".join(r.choice("abcdef") for _ in range(n)).encode()
    texts, train = [make(r.randint(0, 14)) for _ in range(30)] + [b"a b x a", b"", b"f " * 40], np.arange(33) < 12
    tokens, place, begin = lm_scoring.sequence(texts)
    seqs = [["<s>", *t.decode().split(), "</s>"] for t in texts]
    flat = [tuple(w[max(0, i - 2) : i + 1]) for w in seqs for i in range(len(w))]
    seen = collections.Counter(tuple(w[i - k : i + 1]) for w, t in zip(seqs, train) if t for i in range(len(w)) for k in range(min(i, 2) + 1))
    index, counts, names = [], [], []
    for k, gram in enumerate(lm_scoring.grams(tokens, place, order)):
        distinct, number = lm_scoring.numbered(gram, place >= k)
        name = [None] * len(distinct)
        for i in np.flatnonzero(place >= k):
            name[number[i]] = flat[i][-k - 1 :]
        index.append(number)
        names.append(name)
        counts.append(np.array([seen[x] for x in name]))
    total, vocabulary = sum(c for x, c in seen.items() if len(x) == 1 and x != ("<s>",)), sum(len(x) == 1 and x != ("<s>",) for x in seen)
    a = lm_scoring.Automaton(index, place, counts, vocabulary, total, mu)
    history = {0: ()}
    for k in range(order - 1):
        for x in names[k]:
            if seen[x]:
                history[len(history)] = x
    assert len(history) == len(a.fail) and all(history[a.fail[s]] == history[s][1:] for s in history if s)

    def p(w, h):
        if not h:
            return (seen[(w,)] + 1) / (total + vocabulary + 1)
        return p(w, h[1:]) if not seen[h] else (seen[(*h, w)] + mu * p(w, h[1:])) / (seen[h] + mu)

    longest = lambda h: next(h[i:] for i in range(len(h) + 1) if not h[i:] or seen[h[i:]])
    scores = a.traverse(index[0], begin, np.array([len(w) for w in seqs]))
    for w, b, score in zip(seqs, begin, scores):
        state, want = a.first[index[0][b : b + 1]], 0.0
        assert history[state[0]] == longest(("<s>",))
        for i in range(1, len(w)):
            gain, state = a.step(state, index[0][b + i : b + i + 1])
            want += math.log10(p(w[i], tuple(w[max(0, i - 2) : i])))
            assert history[state[0]] == longest(tuple(w[max(0, i - 1) : i + 1])) or w[i] == "</s>"
        assert score == pytest.approx(want)


def test_lm_probabilities_sum_to_one():
    rng = np.random.default_rng(1)
    words = [w.encode() for w in "a b c d e".split()]
    train = [b" ".join(words[k] for k in rng.integers(0, 4, 12)) for _ in range(20)]
    one, two = collections.Counter(), collections.Counter()
    for t in train:
        w = [b"<s>", *t.split(), b"</s>"]
        one.update(w[1:])
        two.update(zip(w, w[1:]))
    n, v = sum(one.values()), len(one)
    p1 = lambda x: (one[x] + 1) / (n + v + 1)
    for h in [*one, b"<s>"]:
        c = 20 if h == b"<s>" else one[h]
        if h != b"</s>":
            total = sum((two[h, x] + 100 * p1(x)) / (c + 100) for x in one) + 100 / (n + v + 1) / (c + 100)
            assert total == pytest.approx(1)


@pytest.fixture(scope="module")
def table():
    p = pieces.Pieces([], list(range(3, 259)), [""] * 400)
    for b in range(256):
        p.hexes[3 + b] = f"{b:02x}"
    for i, (t, s) in enumerate([("▁", -9.0), ("a", -5.0), ("b", -5.5), ("ab", -6.0), ("▁a", -7.0), ("ba", -6.0), ("▁ab", -12.0), ("aba", -11.5), ("é", -6.0), ("c", -5.0), ("▁changed", -3.0)]):
        p.rows.append((t, 300 + i, s))
        p.hexes[300 + i] = t.replace("▁", " ").encode().hex()
    return p


def best_path(word, p):
    known = {t: (i, s) for t, i, s in p.rows}
    best = [(0.0, [])]
    for end in range(1, len(word) + 1):
        top = None
        for start in range(max(0, end - p.longest), end):
            part = word[start:end]
            if part in known and not (start and pieces.MARK in part):
                new = (best[start][0] + known[part][1], best[start][1] + [known[part][0]])
            elif end - start == 1:
                new = (best[start][0] + p.unknown, best[start][1] + [p.byte_ids[b] for b in part.encode()])
            else:
                continue
            if top is None or new[0] > top[0]:
                top = new
        best.append(top)
    return best[-1][1]


def test_pieces_round_trip_and_best_path(spark, docs, table):
    extra = spark.createDataFrame([(400, "  a▁b \n\nab漢𝄞"), (401, "ab" * 300)], "doc_id long, text string")
    rows = docs.select("doc_id", "text").union(extra)
    out = pieces.encode(rows, table)
    got = {r.doc_id: (r.ids, r.t) for r in out.select("doc_id", "ids", pieces.decode(F.col("ids"), table).alias("t")).collect()}
    for i, t in rows.collect():
        assert got[i][1] == (t or "")
        want = [] if not t else [x for w in t.split(" ") for x in best_path(pieces.MARK + w, table)]
        assert list(got[i][0]) == want


def test_runs_of_spaces_are_pieces(spark):
    p = pieces.load()
    known = {t: (i, s) for t, i, s in p.rows}
    runs = [t for t in known if len(t) > 1 and not t.strip(pieces.MARK)]
    assert len(runs) == 14
    odd = ["a    b", "  lead", "trail   ", "x\n    if y:\n\n  z  = 1", " ", " " * 37 + "q", "a \n b", "a ▁b\n▁c  ▁", "one two"]

    def cost(word):
        """Viterbi over the whole table and the unsplit text; a mark of the text itself has no piece."""
        best = [0.0]
        for end in range(1, len(word) + 1):
            top = best[end - 1] + p.unknown
            for start in range(max(0, end - p.longest), end):
                part = word[start:end]
                if pieces.MARK not in part and (q := part.replace(" ", pieces.MARK)) in known:
                    top = max(top, best[start] + known[q][1])
            best.append(top)
        return best[-1]

    docs = spark.createDataFrame(list(enumerate(odd)), "doc_id long, text string")
    out = pieces.encode(docs, p)
    score = {i: s for _, i, s in p.rows}
    for r in out.select("doc_id", "ids", pieces.decode(F.col("ids"), p).alias("t")).collect():
        text = odd[r.doc_id]
        odd_chars = [c for c in text if pieces.MARK == c or c not in known and c != " "]
        spelled = sum(len(c.encode()) for c in odd_chars)
        assert r.t == text and sum(i not in score for i in r.ids) == spelled
        assert sum(score.get(i, 0.0) for i in r.ids) + p.unknown * len(odd_chars) == pytest.approx(cost(" " + text), rel=1e-12)
    ids = out.filter("doc_id = 0").first().ids
    assert list(ids) == [known[t][0] for t in ("▁a", "▁▁▁", "▁b")]


def test_nothing(spark, table):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert suffix_dedup.remove_repeats(empty).count() == 0
    assert jaccard_join.near_duplicates(empty).count() == 0
    assert lm_scoring.score_corpus(empty.withColumn("held_out", F.lit(False))).count() == 0
    assert pieces.encode(empty, table).count() == 0


def test_anchors_of_texts_longer_than_a_piece(monkeypatch):
    """A text in pieces has the anchors and stretches of the whole, also where a cut falls into a stretch or on a text's border."""
    import numpy as np

    from skillweave.llm import common, suffix_dedup

    r = np.random.default_rng(3)
    data = r.integers(97, 101, 6000).astype(np.uint8)
    data[3000:3400] = data[100:500]
    data[4000:4200] = 97
    bounds = np.array([0, 1500, 1500, 3101, 6000])
    whole = suffix_dedup.anchors(data, common.prefix_hash(data), bounds, 100, 36)
    for piece in (700, 1499, 6000 - 1, 199):
        monkeypatch.setattr(suffix_dedup, "_PIECE", piece)
        parts = suffix_dedup.anchors(data, common.prefix_hash(data), bounds, 100, 36)
        assert all((a == b).all() for a, b in zip(whole, parts)), piece
