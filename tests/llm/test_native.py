"""Mixing (2) and line dedup (3): oracle SQL on small tables with every odd row, plus the methods' own promises."""

import duckdb
import pytest
from pyspark.sql import functions as F

from skillweave.llm import line_dedup, source_mixing

ODD = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, " ".join(["w%d" % (i * 7 + k) for k in range(1 + i * i % 23)]), "en", f"s{i % 4}", 1) for i in range(200)]
    rows += [(500, None, None, "s1", None), (501, "", "en", None, 0), (502, "one two\tthree\x0bfour", None, None, 9), (None, "lost id here", "en", "s2", 3), (503, "x " * 5000, "en", "z only", 1)]
    return spark.createDataFrame(rows, ODD)


def test_mix_equals_sql(spark, docs, tmp_path):
    docs.coalesce(1).write.parquet(str(tmp_path / "d"))
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{tmp_path}/d/*.parquet'")
    want = {tuple(r) for r in con.sql(source_mixing.ORACLES["op2_source_mixing"]).fetchall()}
    got = source_mixing.mix_sources(docs.withColumn("size", F.lit("clash")).withColumn("q", F.lit(1)))
    key = lambda r: (r[0], r[1], r[2], round(r[3], 6), r[4])
    assert {key((r.doc_id, r.size, r.source_size, r.target, r.taken)) for r in got.collect()} == {key(w) for w in want}


def test_mix_promises(spark, docs):
    rows = source_mixing.mix_sources(docs).collect()
    again = source_mixing.mix_sources(docs.repartition(7)).collect()
    assert sorted(map(str, rows)) == sorted(map(str, again))
    by = {}
    for r in rows:
        assert 0 <= r.taken <= 3 * r.size
        t = by.setdefault(r.source, [0, r.target, r.source_size, 0])
        t[0] += r.taken
        t[3] = max(t[3], r.size)
    assert abs(sum(t[1] for t in by.values()) - sum(t[2] for t in by.values())) < 1e-6
    for taken, target, size, largest in by.values():
        assert target <= 3 * size + 1e-9 and abs(taken - target) <= largest


def test_inclusion_odds(spark):
    """Probabilities add up to the words missing, the largest documents are certain, ties and repeated rows are taken alike."""
    sizes = [1] * 50 + [4] * 20 + [9] * 10 + [400] * 2
    rows = spark.createDataFrame([("a", s, 700.0) for s in sizes], "source string, size long, missing double")
    r = source_mixing.inclusion_rates(rows.repartition(5)).first()
    assert r.sure < 400 or r.rate * 20 < 1
    some = [s for s in sizes if s <= r.sure]
    assert sum(r.rate * s**0.5 * s for s in some) == pytest.approx(r.open) and sum(s for s in sizes if s > r.sure) + r.open == 700
    docs = [(i % 30, " ".join(["x"] * (5 + i % 3)), "en", "one", 1) for i in range(90)] + [(200 + i, "y " * 300, "en", "two", 1) for i in range(4)]
    got = source_mixing.mix_sources(spark.createDataFrame(docs, ODD)).collect()
    alike = {}
    for g in got:
        alike.setdefault((g.doc_id, g.size), set()).add(g.copies)
    assert len(got) == 94 and all(len(v) == 1 for v in alike.values())


def test_mix_of_nothing(spark):
    assert source_mixing.mix_sources(spark.createDataFrame([], ODD)).count() == 0
    assert [r.taken for r in source_mixing.mix_sources(spark.createDataFrame([(1, None, None, None, None)], ODD)).collect()] == [0]


def lines(spark):
    tag = lambda i, k: chr(97 + i) + chr(97 + k)
    body = lambda i: "\n".join(f"al{tag(i, k)} be{tag(k, i)} ga{tag(i, i)} delta om{tag(i, k)}" for k in range(6))
    rows = [(i, f"{body(i)}\nAll rights reserved 20{i:02d} by Some Company.\n\nend{i}") for i in range(12)]
    rows += [(50, None), (51, ""), (52, "All rights reserved 1999 by Some Company."), (None, "only here"), (53, "a b c\n" * 400)]
    return spark.createDataFrame(rows, "doc_id long, text string")


def test_recurring_template_goes(spark):
    out = {r.doc_id: r for r in line_dedup.drop_recurring_lines(lines(spark).withColumn("lines", F.lit(1)).withColumn("parsed", F.lit(2)).withColumn("of", F.lit(3))).collect()}
    assert "rights reserved" in out[0].text and out[0].n_dropped == 0  # the holder
    for i in range(1, 12):
        assert "rights reserved" not in out[i].text and out[i].n_dropped == 1 and f"end{i}" in out[i].text and out[i].parsed == 2 and out[i].of == 3
    assert out[50].text is None and out[50].n_lines == 0 and out[51].text == "" and out[51].n_lines == 1
    assert out[52].text == "" and out[52].n_dropped == out[52].n_lines == 1  # nothing else in it, still not the holder
    assert out[None].text == "only here" and out[53].n_dropped == 0


def test_copies_short_lines_and_shares(spark):
    copy = "whole copy line one\nwhole copy line two"
    rows = [(i, copy) for i in range(40)] + [(i, copy) for i in (3, 3)]
    rows += [(100 + i, f"ok\n7 8\nown {chr(97 + i)}x\nshared boiler plate line\n") for i in range(10)]
    rows += [(100, "shared boiler plate line\nof a repeated id"), (None, "shared boiler plate line\nno id"), (120, "z " * 50_000 + "\nok\n" + "\n".join(["shared boiler plate line"] * 500))]
    out = [(r.doc_id, r.text) for r in line_dedup.drop_recurring_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()]
    assert out.count((3, copy)) == 3 and sum(t == copy for _, t in out) == 42  # copies make no line recur
    assert (100, rows[42][1]) in out and (100, "shared boiler plate line\nof a repeated id") in out  # both hold it
    assert all((100 + i, f"7 8\nown {chr(97 + i)}x\n") in out for i in range(1, 10))  # over half of it goes, fields stay
    assert (None, "no id") in out and (120, "z " * 50_000) in out


def test_lines_equal_sql(spark, tmp_path):
    rows = [(200 + i, f"head of the {w} line {w}{w} by {i} tail\n\t mixed \x0b spaces {w}\nok\nfour <*> tokens here\n{w}") for i, w in enumerate("abcdefghijklmnopqrst")]
    rows += [(None, "ok\nfour <*> tokens here"), (200, "ok"), (200, "ok\nelse"), (300, "ok"), (300, "ok")]
    df = lines(spark).union(spark.createDataFrame(rows, "doc_id long, text string"))
    df.coalesce(1).write.parquet(str(tmp_path / "d"))
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{tmp_path}/d/*.parquet'")
    want = {tuple(r) for r in con.sql(line_dedup.ORACLES["op3_line_dedup"]).fetchall()}
    got = line_dedup.drop_recurring_lines(df).select("doc_id", "n_lines", "n_dropped", F.length("text").cast("long"), F.md5(F.encode("text", "utf-8")))
    assert {tuple(r) for r in got.collect()} == want


def test_no_lines(spark):
    assert line_dedup.drop_recurring_lines(spark.createDataFrame([], "doc_id long, text string")).count() == 0
