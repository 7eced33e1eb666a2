"""Toxicity (4), page text (5), exact search (6), vector near-duplicates (9)."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from skillweave.llm import embedding_dedup, html_text, topk_search, toxicity


def corpus(n, seed):
    r = random.Random(seed)
    words = ["".join(r.choice("bcdfglmnrst") + r.choice("aeiou") for _ in range(r.randint(1, 3))) for _ in range(200)]
    texts, labels = [], []
    for i in range(n):
        w = [r.choice(words) for _ in range(r.randint(5, 160))]
        bad = i % 3 == 0
        if bad:
            w[r.randrange(len(w))] = r.choice(["zoxgrub", "zoxmel", "zoxtarn"])
        texts.append(" ".join(w).encode())
        labels.append(float(bad))
    return texts, np.array(labels)


def test_gradients_match_differences():
    net = toxicity.Network.fresh(1)
    texts, labels = corpus(6, 5)
    distinct, grams, n, index, first, upto = toxicity._tokens(texts)
    start, end, owner = toxicity._windows(first, upto, 8, 4)
    ids, mask = toxicity._padded(index, start[:9], end[:9], 0)
    y = labels[owner[:9]].astype(np.float32)

    def loss():
        gates, x, rows = net.inputs(distinct, grams, n)
        z = net.read(net.halves(gates), ids, mask).astype(np.float64)
        return np.mean(np.logaddexp(0, z) - y * z), gates, x, rows

    _, gates, x, rows = loss()
    g = net.gradients(gates, x, rows, grams, n, ids, mask, y)
    for name in ("win", "uf", "ub", "att", "v", "out", "outb"):
        p = net.p[name]
        at = np.unravel_index(np.argmax(np.abs(g[name])), p.shape)
        old, step = p[at], np.float32(1e-2)
        p[at] = old + step
        up = loss()[0]
        p[at] = old - step
        down = loss()[0]
        p[at] = old
        assert (up - down) / (2 * step) == pytest.approx(g[name][at], rel=0.05, abs=1e-4)


def test_held_out_accuracy():
    net = toxicity.train(*corpus(500, 1), steps=(80, 60, 60))
    texts, labels = corpus(300, 2)
    predicted = net.scores(texts) >= 0.5
    assert (predicted == (labels > 0)).mean() > 0.95
    late = b" ".join([b"lo"] * 3000 + [b"zoxgrub"] + [b"lo"] * 3000)
    assert net.scores([late])[0] > net.scores([b"lo " * 6000])[0]


def test_scores_every_row(spark):
    docs = spark.createDataFrame([(1, None, "x"), (2, "", "y"), (None, "some words", "z"), (2, "", "y")], "doc_id long, text string, score string")
    net = toxicity.Network.fresh(0)
    out = toxicity.score_texts(docs, net).collect()
    assert len(out) == 4 and all(0 <= r.score <= 1 for r in out)
    assert toxicity.score_texts(docs.limit(0), net).count() == 0
    assert toxicity.train([], np.zeros(0)).scores([b"a"])[0] < 0.5  # nothing labelled, nothing rejected


def test_forward_pass_step_by_step():
    net, (texts, _) = toxicity.Network.fresh(3), corpus(5, 8)
    net.p["attb"] += 0.3
    distinct, grams, n, index, first, upto = toxicity._tokens(texts)
    gates = net.inputs(distinct, grams, n)[0].astype(np.float64)
    p, h = {k: v.astype(np.float64) for k, v in net.p.items()}, toxicity.HIDDEN
    sig = lambda x: 1 / (1 + np.exp(-x))

    def one(ids):
        states = np.zeros((len(ids), 2 * h))
        for d, u, order in ((0, p["uf"], range(len(ids))), (1, p["ub"], range(len(ids) - 1, -1, -1))):
            state = np.zeros(h)
            for t in order:
                x, a = gates[ids[t], 3 * h * d : 3 * h * (d + 1)], state @ u
                r, z = sig(x[:h] + a[:h]), sig(x[h : 2 * h] + a[h : 2 * h])
                state = (1 - z) * np.tanh(x[2 * h :] + r * a[2 * h :]) + z * state
                states[t, h * d : h * (d + 1)] = state
        e = np.exp(np.tanh(states @ p["att"] + p["attb"]) @ p["v"])
        return (e / e.sum()) @ states @ p["out"] + p["outb"][0]

    want = [max(one(index[a : min(a + 8, b)]) for a in range(s, max(s + 1, b - 4), 4)) for s, b in zip(first, upto)]
    assert net.logits(texts, 8, 4) == pytest.approx(want, abs=1e-3)


def test_labelled_sample(spark):
    import zlib

    rows = [(i, f"text {i} " + "x" * (i % 9), "clash") for i in range(300)] + [(7, "zz later", "clash"), (None, "none", "c"), (301, "y" * 5000, "long"), (302, None, "c")]
    labels = [(i, int(i % 4 == 0)) for i in range(303)] + [(9, 1), (9, 0), (None, 1), (10, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, toxic string").repartition(3)
    known = spark.createDataFrame(labels, "doc_id long, toxic int")
    found, share = toxicity.labelled_sample(docs, known, 60, longest=1000)
    got = sorted((r.doc_id, bytes(r.text).decode(), r.toxic) for r in found.collect())
    again = sorted((r.doc_id, bytes(r.text).decode(), r.toxic) for r in toxicity.labelled_sample(docs.repartition(7), known, 60, longest=1000)[0].collect())
    usable = [i for i in range(303) if i not in (300, 301) and zlib.crc32(str(i).encode()) % 5]
    assert got == again and len(got) == 60 and {i for i, _, _ in got} <= set(usable) and sum(y for _, _, y in got) == 20
    assert share == pytest.approx(sum(i % 4 == 0 or i == 9 for i in usable) / len(usable))
    everything = {i: (t, y) for i, t, y in ((r.doc_id, bytes(r.text).decode(), r.toxic) for r in toxicity.labelled_sample(docs, known, longest=1000)[0].collect())}
    assert set(everything) - {i for i in usable if i % 4 == 0 or i == 9} == {i for i in usable if i % 4 and i != 9}
    assert everything.get(7, ("zz later",))[0] == "zz later" and everything.get(302, ("",))[0] == "" and everything.get(9, (0, 1))[1] == 1
    small = toxicity.labelled_sample(docs, known, 60, most=300, longest=1000)[0].collect()
    assert 0 < sum(len(r.text) for r in small) <= 300
    assert toxicity.labelled_sample(docs, known.limit(0))[0].count() == 0 and toxicity.labelled_sample(docs.limit(0), known)[1] == 0.0


PAGE = """<!DOCTYPE html><html><head><title>No</title><style>p{x}</style><script>var a="</p>";</script></head><body>
<header><a href=/>Site</a></header><nav><ul><li><a href=a>Menu</a></ul></nav><div class="cookie-notice">We use cookies</div>
<main><article><h1>A &amp; B</h1><p>First   <b>bold<br>text &lt;x&gt; with many words in it, and more of them.<p>Second paragraph, also long enough to be text.
<ul><li>one item<li>two item</ul><form><input value=q>Search</form><aside>Also read</aside><div id="comments"><p>Nice!</p></div></article></main>
<div class="sidebar"><p>Side</p></div><footer>&copy; me</footer></body></html>"""


def test_page_text():
    want = "A & B\n\nFirst bold text <x> with many words in it, and more of them.\n\nSecond paragraph, also long enough to be text.\n\none item\n\ntwo item"
    assert html_text.main_text(PAGE) == want
    assert html_text.main_text(None) == html_text.main_text("") == html_text.main_text("<script>x</script>") == ""
    assert html_text.main_text("just text &am; &amp <") == "just text &am; & <"
    assert html_text.main_text("<div>" * 3000 + "deep words" + "</div>" * 3000) == "deep words"


def test_page_text_of_nested_pages():
    text = lambda name, n: f"{name} " + "word " * n + "end"
    many = lambda tag, name, count, n: "".join(f"<{tag}>{text(f'{name}{i}', n)}</{tag}>" for i in range(count))
    links = "<div>" + "".join(f"<a href={i}>Go {i}</a> " for i in range(30)) + "</div>"

    def firsts(body):
        return [x.split(" ")[0] for x in html_text.main_text(f"<html><body>{links}{body}</body></html>").split("\n\n")]

    a, b = [f"A{i}" for i in range(10)], [f"B{i}" for i in range(3)]
    # Sections beside each other, the second with far less of the density sum.
    assert firsts(f"<article><section>{many('p', 'A', 10, 60)}</section><section>{many('p', 'B', 3, 80)}</section></article>") == a + b
    # Plain paragraphs beside the densest block are leaves.
    assert firsts(f"<article><p>{text('Lead', 150)}</p><div>{many('p', 'A', 10, 60)}</div><p>{text('Tail', 150)}</p></article>") == ["Lead", *a, "Tail"]
    # A list with more density than its article has beside it.
    assert firsts(f"<article>{many('p', 'B', 3, 100)}<ul>{many('li', 'A', 10, 40)}</ul></article>") == b + a
    # Nested one level more, away from the densest node's own path.
    assert firsts(f"<main><div><section>{many('p', 'A', 10, 60)}</section></div><div><div>{many('p', 'B', 3, 80)}</div></div></main>") == a + b
    # What stays below the threshold is no content.
    assert firsts(f"<article><div>{many('p', 'A', 10, 60)}</div></article><p>Short note</p>") == a


def test_article_text_is_not_lost():
    words = lambda name, n: " ".join([name] + ["word"] * n)
    paragraphs = lambda name, count, n: "".join(f"<p>{words(name + str(i), n)}</p>" for i in range(count))
    firsts = lambda page: [x.split(" ")[0] for x in html_text.main_text(page).split("\n\n")]
    body, names = paragraphs("A", 20, 60), [f"A{i}" for i in range(20)]
    for n in (300, 80):
        assert firsts(f"<body><p>{words('Lead', n)}</p><div>{body}</div></body>") == ["Lead", *names]
    assert firsts(f"<body><div>{body}</div><div>{paragraphs('B', 2, 60)}</div></body>") == [*names, "B0", "B1"]
    for kind in ('p class="related-work"', 'div class="search-results"', 'p class="alert"', 'p id="notice"'):
        assert firsts(f"<article><{kind}>{words('Kept', 30)}</{kind.split(' ')[0]}>{body}</article>") == ["Kept", *names], kind
    for kind in ('div class="related-posts"', 'p class="ad"', 'div class="ad-slot-3 wide"', 'section id="comments"', 'div class="newsletter-signup"', 'div role="navigation"'):
        assert firsts(f"<article>{body}<{kind}>{words('Gone', 30)}</{kind.split(' ')[0]}></article>") == names, kind
    links = "".join(f"<li><a href={i}>Some other page {i}</a></li>" for i in range(30))
    assert firsts(f"<main><article>{body}<ul>{links}</ul><p>Short end</p></article></main>") == [*names, "Short"]
    assert main_text_of_ties() == ["One", "Two"]
    assert len(html_text.main_text(f"<article>{paragraphs('Z', 4000, 40)}</article>")) > 700_000


def main_text_of_ties():
    block = "".join(f"<p>{'same words here ' * 20}</p>" for _ in range(5))
    page = f"<body><section><h2>One</h2>{block}</section><section><h2>Two</h2>{block}</section></body>"
    return [x for x in html_text.main_text(page).split("\n\n") if len(x) < 9]


def words(name, n):
    return " ".join(f"{name}{i}" for i in range(n))


def paragraphs(name, count, n):
    return "".join(f"<p>{words(f'{name}{i}x', n)}</p>" for i in range(count))


def test_pages_keep_formulas_leads_and_their_only_article():
    text = html_text.main_text
    assert text(f"<body><p>Energy <math><mi>E</mi>=<mi>mc2</mi><annotation>tex</annotation></math> is <svg><text>no</text></svg> {words('W', 30)}</p></body>").startswith("Energy E=mc2 is W0 W1")
    promo = "".join(f"<p>{words(f'P{i}x', 40)}</p>" for i in range(5))
    assert text(f'<nav><a href=x>menu</a></nav><article class="promo">{promo}</article>').count("\n\n") == 4
    both = text(f'<article class="promo">{promo}</article><article>{paragraphs("A", 5, 40)}</article>')
    assert "P0x" not in both and both.count("\n\n") == 4
    page = f"<body><div><h2>Of all</h2><div><p><a href=x>unrelated link here</a></p><h1>The title</h1><p>{words('Lead', 15)}</p><div>{paragraphs('B', 6, 60)}</div></div></div></body>"
    assert [x.split(" ")[0] for x in text(page).split("\n\n")][:3] == ["Of", "The", "Lead0"]


def test_deep_and_broken_pages_take_linear_time():
    import time

    pages = ["<div>" * 20000 + "deep", "<b>" * 20000 + "<p>x" * 20000, "<i><div>" + "<b>" * 20000 + "</i>" * 20000, "<div>" * 20000 + "<li>x" * 20000, "<div>" * 20000 + "</section>" * 20000]
    pages += ["<a " * 100000, '<b "> " ' * 40000, "<b \"'>" * 40000, '<span class="x">' * 40000, '<div class="a b">' * 20000 + '<p class="c">z</p>' * 20000, "<!--" * 50000, "<a>" * 40000]
    for page in pages:
        began = time.process_time()
        html_text.main_text(page)
        assert time.process_time() - began < 5, page[:30]


def independent(page):
    """Density sums of a well-formed page of blocks by the standard library's parser, recursively, and the text of the greatest."""
    import math
    from html.parser import HTMLParser

    tree = {"tag": "body", "kids": [], "own": 0, "link": 0, "links": 0, "texts": []}

    class Reader(HTMLParser):
        def __init__(self):
            super().__init__()
            self.open, self.in_link = [tree], 0

        def handle_starttag(self, tag, attrs):
            if tag == "a":
                self.in_link += 1
                self.open[-1]["links"] += 1
            elif tag not in ("html", "body"):
                x = {"tag": tag, "kids": [], "own": 0, "link": 0, "links": 0, "texts": []}
                self.open[-1]["kids"].append(x)
                self.open[-1]["texts"].append(x)
                self.open.append(x)

        def handle_endtag(self, tag):
            if tag == "a":
                self.in_link -= 1
            elif tag not in ("html", "body"):
                self.open.pop()

        def handle_data(self, data):
            n = len("".join(data.split()))
            self.open[-1]["own"] += n
            self.open[-1]["link"] += n * bool(self.in_link)
            self.open[-1]["texts"].append(data)

    Reader().feed(page)
    total = lambda x, k: x[k] + sum(total(y, k) for y in x["kids"])
    count = lambda x: x["links"] + sum(1 + count(y) for y in x["kids"])
    share = total(tree, "link") / max(1, total(tree, "own"))

    def density(x):
        chars, link, links, tags = total(x, "own"), total(x, "link"), total(x, "links"), max(1, count(x))
        if not chars:
            return 0.0
        base = math.log(chars / max(1, chars - link) * max(1, link) + share * chars + math.e)
        return chars / tags * max(0.0, math.log(max(1.0, chars / max(1, link) * tags / max(1, links)))) / base

    every = []

    def visit(x):
        every.append((sum(density(y) for y in x["kids"]), x))
        for y in x["kids"]:
            visit(y)

    visit(tree)
    best = max(every, key=lambda t: t[0])
    flat = lambda x: [z for y in x["texts"] for z in (flat(y) if isinstance(y, dict) else [" ".join(y.split())]) if z]
    return best[0], flat(best[1])


def test_root_against_an_independent_selection():
    for seed in range(60):
        r = random.Random(seed)

        def block(depth):
            if depth == 0 or r.random() < 0.4:
                n = r.choice([2, 8, 40, 120])
                return f"<p>{words(f'w{r.randrange(9999)}', n)}{' <a>' + words('l', r.choice([1, 9])) + '</a>' if r.random() < 0.3 else ''}</p>"
            return "<div>" + "".join(block(depth - 1) for _ in range(r.randint(1, 5))) + "</div>"

        page = "<body>" + "".join(block(3) for _ in range(r.randint(2, 5))) + "</body>"
        root, blocks = html_text.parse(page)
        todo, best = [root], 0.0
        while todo:
            x = todo.pop()
            best = max(best, x.total)
            todo += x.kids
        total, texts = independent(page)
        assert best == pytest.approx(total)
        kept = html_text.main_text(page).split("\n\n")
        assert set(" ".join(texts).split()) <= set(" ".join(kept).split()), page


def test_densities_by_hand():
    """Composite density and density sums of a small tree, from the page itself."""
    import math

    root, _ = html_text.parse("<body><div><p>abcd efgh <a href=x>link</a></p><p>ijklmnop</p></div></body>")
    box = root.kids[0]
    a, b = box.kids

    def density(chars, tags, link_chars, links):
        share = 4 / 20
        base = math.log(chars / max(1, chars - link_chars) * max(1, link_chars) + share * chars + math.e)
        return chars / max(1, tags) * max(0.0, math.log(max(1.0, chars / max(1, link_chars) * max(1, tags) / max(1, links)))) / base

    assert (a.chars, a.tags, a.link_chars, a.links) == (12, 1, 4, 1) and a.density == pytest.approx(density(12, 1, 4, 1))
    assert b.density == pytest.approx(density(8, 0, 0, 0)) and box.total == pytest.approx(a.density + b.density)
    assert (box.chars, box.tags) == (20, 3) and box.density == pytest.approx(density(20, 3, 4, 1))


def test_pages(spark):
    pages = spark.createDataFrame([(1, "u", PAGE, "x"), (None, None, None, "y"), (2, "v", "", "z")], "page_id long, url string, html string, text string")
    out = {r.page_id: r for r in html_text.extract_pages(pages).collect()}
    assert out[1].n_chars == len(out[1].text) > 50 and out[None].text == "" and out[2].n_chars == 0
    assert html_text.extract_pages(pages.limit(0)).count() == 0


def test_search_equals_brute_force(spark):
    r = np.random.default_rng(4)
    v = r.integers(-40, 40, (700, 12))
    v[5] = v[6] = v[7]
    rows = spark.createDataFrame([(i, [int(x) for x in row]) for i, row in enumerate(v)], "vec_id long, terms array<long>")
    got = {(g.query_id, g["rank"]): (g.vec_id, g.score) for g in topk_search.top_k(rows, rows.filter("vec_id % 50 = 5 or vec_id = 699"), 5, shard=90, block=4).collect()}
    for q in [*range(5, 700, 50), 699]:
        best = sorted(((-int(v[q] @ v[i]), i) for i in range(700) if i != q))[:5]
        assert [got[q, k + 1] for k in range(5)] == [(i, -s) for s, i in best]
    assert topk_search.top_k(rows.limit(0), rows.limit(2), 5).count() == 0
    assert topk_search.top_k(rows, rows.limit(0), 5).count() == 0
    assert topk_search.top_k(rows.limit(3), rows.limit(1), 5).count() == 2


def test_search_query_on_odd_rows(spark, tmp_path):
    import duckdb

    r = np.random.default_rng(6)
    rows = [(i, [float(x) for x in r.integers(-3, 4, 4) / 8]) for i in range(120)]
    rows += [(50, rows[50][1]), (50, rows[3][1]), (7, rows[7][1]), (None, rows[1][1]), (150, None), (200, [1.0, None]), (250, [float("nan")] * 4), (300, [float("inf")] * 4)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("row", F.lit("clash")).withColumn("terms", F.lit(0))
    df.repartition(3).write.parquet(str(tmp_path / "embeddings.parquet"))
    con = duckdb.connect()
    con.execute(f"create view embeddings as select * from '{tmp_path}/embeddings.parquet/*.parquet'")
    want = sorted(con.sql(topk_search.ORACLES["op6_topk_search"]).fetchall())
    got = topk_search.op6_topk_search(spark, str(tmp_path)).collect()
    assert sorted((g.query_id, g["rank"], g.vec_id, g.score) for g in got) == want
    assert sum(g.query_id == 50 for g in got) == 15 and any(g.query_id == g.vec_id == 50 for g in got)


def test_search_in_whole_numbers(spark):
    """Sums beyond 53 bits, where doubles would tie: exact scores, and a clear end where no long holds one."""
    r = random.Random(8)
    rows = [(i, [r.randrange(-(2**29), 2**29) for _ in range(9)]) for i in range(60)]
    df = spark.createDataFrame(rows, "vec_id long, terms array<long>").repartition(3)
    got = {}
    for x in topk_search.top_k(df, df.filter("vec_id < 4"), 5, shard=20, block=2).orderBy("query_id", "rank").collect():
        got.setdefault(x.query_id, []).append((x.vec_id, x.score))
    for q in range(4):
        want = sorted((-sum(a * b for a, b in zip(rows[q][1], v)), i) for i, v in rows if i != q)[:5]
        assert got[q] == [(i, -s) for s, i in want] and any(abs(s) > 2**53 for s, _ in want)
    huge = spark.createDataFrame([(1, [2**62, 2**62]), (2, [2**62, 2**62])], "vec_id long, terms array<long>")
    with pytest.raises(Exception, match="not a long"):
        topk_search.top_k(huge, huge, 1).collect()


def test_unusable_vectors(spark):
    df = spark.createDataFrame([([1.0, 2.0],), ([1.0, None],), ([float("nan")],), ([float("inf")],), (None,)], "v array<double>")
    assert [r[0] for r in df.select(topk_search.finite(F.col("v"))).collect()] == [True, False, False, False, False]


def linked(rows, threshold=0.98):
    """Brute force over (vec_id, embedding, label): links of each row and its component's smallest id."""
    ok = [k for k, (i, v, label) in enumerate(rows) if i is not None and label is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    unit = {k: np.array(rows[k][1]) / np.linalg.norm(rows[k][1]) for k in ok}
    links, label = [0] * len(rows), list(range(len(rows)))
    for x, a in enumerate(ok):
        for b in ok[x + 1 :]:
            if rows[a][2] == rows[b][2] and len(unit[a]) == len(unit[b]) and unit[a] @ unit[b] >= threshold:
                links[a] += 1
                links[b] += 1
                old, new = label[b], label[a]
                label = [new if z == old else z for z in label]
    least = {}
    for k, (i, _, _) in enumerate(rows):
        least.setdefault(label[k], []).append(i)
    return sorted(((i, links[k], None if None in least[label[k]] else min(least[label[k]])) for k, (i, _, _) in enumerate(rows)), key=str)


def test_vector_groups(spark):
    r = np.random.default_rng(9)
    centre = r.standard_normal((6, 32))
    rows = []
    for i in range(240):
        c = centre[i % 6] + r.standard_normal(32) * (0.02 if i % 2 else 2.0)
        rows.append([i, [float(x) for x in c], None if i % 40 == 39 else i % 3])
    rows[10][1], rows[11][1], rows[12][1], rows[13][1] = None, [0.0] * 32, [float("nan")] * 32, [1.0, None]
    rows += [[300 + i, [2.0 * x for x in rows[1][1]], 1] for i in range(70)]  # copies of each other, and proportional to another
    rows += [[1, rows[2][1], 2], [1, rows[1][1], 1], [1, rows[1][1], 1], [None, rows[1][1], 1], [400, [], 1], [401, [1.0], 1], [402, [2.0], 1]]
    table = spark.createDataFrame([tuple(x) for x in rows], "vec_id long, embedding array<double>, label int")
    for block in (16, 512):
        out = embedding_dedup.near_vectors(table.withColumn("node", F.lit(1)).withColumn("links", F.lit("x")).repartition(5), block=block).collect()
        assert sorted(((g.vec_id, g.n_links, g.component_id) for g in out), key=str) == linked(rows)
        assert all(g.kept == (g.vec_id == g.component_id) for g in out)
    assert embedding_dedup.near_vectors(table.limit(0)).count() == 0


def odd_vectors(r, kind, n, width):
    if kind == "sparse":
        out = np.zeros((n, width))
        for x in out:
            x[r.choice(width, 3, replace=False)] = r.standard_normal(3)
        return out
    if kind == "one-hot":
        return np.eye(width)[r.integers(0, width, n)] * r.uniform(0.5, 2, (n, 1))
    return r.standard_normal((n, 2)) @ r.standard_normal((2, width))


@pytest.mark.parametrize("kind", ["sparse", "one-hot", "low-rank"])
def test_vectors_of_few_directions(spark, kind):
    """Few filters for each vector, recall at the threshold, and whole results against brute force."""
    r = np.random.default_rng(5)
    turn, books = embedding_dedup.rotation(64), embedding_dedup.code_books(64)
    assert np.abs(turn @ turn.T - np.eye(64)).max() < 1e-12
    hit, counts = 0, []
    for x in odd_vectors(r, kind, 200, 64):
        x /= np.linalg.norm(x)
        z = r.standard_normal(64)
        z -= z @ x * x
        y = 0.98 * x + (1 - 0.98**2) ** 0.5 * z / np.linalg.norm(z)
        own = embedding_dedup.filters_of(turn @ x, books)
        counts.append(len(own))
        hit += len(np.intersect1d(own, embedding_dedup.filters_of(turn @ y, books))) > 0
    assert hit / 200 > 0.97 and max(counts) <= embedding_dedup.MOST and np.mean(counts) < 30
    rows = [(i, [float(c) for c in v], i % 2) for i, v in enumerate(odd_vectors(r, kind, 240, 64))]
    out = embedding_dedup.near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")).collect()
    want = linked(rows)
    assert sum(g.n_links for g in out) >= 0.97 * sum(n for _, n, _ in want)
    assert all(n >= g.n_links for (_, n, _), g in zip(want, sorted(out, key=lambda g: str((g.vec_id, g.n_links, g.component_id)))) if kind == "sparse")


def test_thousands_of_sparse_vectors_finish(spark):
    r = np.random.default_rng(0)
    rows = [(i, [float(c) for c in v], 0) for i, v in enumerate(odd_vectors(r, "sparse", 3000, 64))]
    got = {g.vec_id: g.n_links for g in embedding_dedup.near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")).collect()}
    x = np.array([v for _, v, _ in rows])
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    links = (x @ x.T >= 0.98).sum(1) - 1
    assert sum(got.values()) >= 0.97 * links.sum() and all(got[i] <= links[i] for i in got)


@pytest.mark.parametrize("width,rows", [(16, 300), (64, 300), (768, 80)])
def test_recall_at_the_threshold(width, rows):
    r, books, hit, filters = np.random.default_rng(2), embedding_dedup.code_books(width), 0, 0
    for _ in range(rows):
        x, z = r.standard_normal((2, width))
        x /= np.linalg.norm(x)
        z -= z @ x * x
        y = 0.98 * x + (1 - 0.98**2) ** 0.5 * z / np.linalg.norm(z)
        own = embedding_dedup.filters_of(x, books)
        filters += len(own)
        hit += len(np.intersect1d(own, embedding_dedup.filters_of(y, books))) > 0
    assert hit / rows > 0.98 and filters / rows < 80
