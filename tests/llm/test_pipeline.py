"""The corpus pipeline: every stage on odd rows and on nothing, each against what it promises, and all of them together."""

import random

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from skillweave.llm import jaccard_join, pieces, source_mixing

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    r = random.Random(4)
    words = ["".join(r.choice("bcdfglmnrst") + r.choice("aeiou") for _ in range(r.randint(1, 3))) for _ in range(250)]
    make = lambda n: " ".join(r.choice(words) for _ in range(n))
    rows, labels = [], []
    for i in range(1, 181):
        bad = i % 3 == 0
        text = make(r.randint(20, 90)) + (" zoxgrub " + make(5) if bad else "") + "\n" + (f"All rights reserved {i} by someone" if i % 2 else make(8))
        rows.append((i, text, "en", f"s{i % 3}"))
        labels.append((i, 1, int(bad)))
    base = make(120)
    rows += [(300 + i, base, "en", "s1") for i in range(5)] + [(310, base + " more", None, None), (320, None, "en", "s2"), (321, "", None, "s2"), (322, "Tiny  text", "en", None), (322, "Tiny  text", "en", None), (None, make(40), "en", "s0")]
    folder = str(tmp_path_factory.mktemp("tables"))
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").withColumn("n_chars", F.length("text").cast("long"))
    docs.repartition(3).write.parquet(folder + "/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(folder + "/labels.parquet")
    return folder, rows


def key(row):
    return str(tuple(row))


def test_stages(spark, tables):
    folder, rows = tables
    docs = spark.read.parquet(folder + "/documents.parquet")
    steps = dict(corpus_pipeline.STAGES)
    assert list(steps) == ["toxicity", "line dedup", "n-gram Jaccard join", "mixing sources", "SentencePiece encoding"]

    kept = steps["toxicity"](spark, docs, folder)
    assert kept.columns == COLUMNS
    got = [row.text for row in kept.collect()]
    toxic = sum("zoxgrub" in (t or "") for t in got)
    # About 140 labelled texts are few; empty and null ones stay.
    assert toxic <= 6 and {"", None} <= set(got) and len(got) - toxic >= 0.93 * sum("zoxgrub" not in (t or "") for _, t, _, _ in rows)

    cut = steps["line dedup"](spark, docs, folder)
    out = {row.doc_id: row for row in cut.collect()}
    assert cut.columns == COLUMNS and cut.count() == docs.count()
    assert "reserved" in out[1].text and not any("reserved" in out[i].text for i in range(3, 181, 2)) and out[320].text is None and out[300].text == out[304].text
    assert all(row.n_chars == len(row.text) for row in out.values() if row.text is not None)

    one = steps["n-gram Jaccard join"](spark, docs, folder)
    links = {row.doc_id: row.component_id for row in jaccard_join.near_duplicates(docs).collect()}
    ids = [row.doc_id for row in one.collect()]
    assert one.columns == COLUMNS and set(ids) == {i for i, c in links.items() if i == c} and ids.count(322) == 2
    assert 300 in ids and not {301, 304, 310} & set(ids) and {320, 321, None} <= set(ids)

    mixed = steps["mixing sources"](spark, docs, folder)
    copies = source_mixing.mix_sources(docs.select("doc_id", "source", "text")).filter("copies > 0")
    want = sorted(key((row.doc_id, row.source)) for row in copies.collect() for _ in range(row.copies))
    assert mixed.columns == COLUMNS and sorted(key((row.doc_id, row.source)) for row in mixed.collect()) == want

    coded = steps["SentencePiece encoding"](spark, docs, folder)
    table = pieces.load()
    back = coded.select("doc_id", "n_pieces", F.size("ids").alias("n"), pieces.decode(F.col("ids"), table).alias("t")).collect()
    assert sorted(key((row.doc_id, row.t)) for row in back) == sorted(key((i, t or "")) for i, t, _, _ in rows) and all(row.n == row.n_pieces for row in back)


def test_stages_on_nothing(spark, tables):
    folder, _ = tables
    docs = spark.read.parquet(folder + "/documents.parquet").limit(0)
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, folder)
        assert out.count() == 0 and (out.columns == COLUMNS or name == corpus_pipeline.STAGES[-1][0])


def test_stages_with_clashing_columns(spark, tables):
    """Columns named like those of the operators pass through every stage with their values."""
    folder, _ = tables
    names = ["score", "n_dropped", "n_lines", "copies", "component_id", "size", "key", "rest", "of", "__copies", "__kept_id", "ids", "lines", "flag", "shard", "with space", "a.b"]
    docs = spark.read.parquet(folder + "/documents.parquet").filter("doc_id < 60 OR doc_id >= 300 OR doc_id IS NULL")
    marked = docs.select(*docs.columns, *[F.concat(F.lit(n + " of "), F.coalesce(F.col("doc_id").cast("string"), F.lit("none"))).alias(n) for n in names])
    for name, stage in corpus_pipeline.STAGES[:-1]:
        plain, out = stage(spark, docs, folder), stage(spark, marked, folder)
        assert out.columns == marked.columns
        rows = out.collect()
        assert all(row[n] == f"{n} of {'none' if row.doc_id is None else row.doc_id}" for row in rows for n in names), name
        assert sorted(key(row[:5]) for row in rows) == sorted(key(row) for row in plain.collect()), name
    last = corpus_pipeline.STAGES[-1][1](spark, marked, folder)
    assert last.columns == ["doc_id", "ids", "n_pieces"] and last.count() == docs.count()


def test_run(spark, tables):
    out = corpus_pipeline.run(spark, tables[0]).collect()
    assert len(out) > 50 and all(row.n_pieces == len(row.ids) for row in out) and not {301, 302, 303, 304} & {row.doc_id for row in out}
