import json

from pyspark.sql import functions as F

from skillweave.sources import tables
from skillweave.streaming.frequencies import term_counts, windowed_counts


def test_csv_encodings_and_mark(spark, tmp_path):
    (tmp_path / "a.csv").write_bytes("﻿role,skill,frequency_pct,count,total_jobs_in_role\nKỹ sư,SQL,50.0,1,2\n".encode())
    (tmp_path / "b.csv").write_bytes('name,text\nJosé,"a ""b""\nc"\n'.encode("latin-1"))
    assert tables.read_matrix(spark, str(tmp_path / "a.csv")).first().role == "Kỹ sư"
    r = tables.read_csv(spark, str(tmp_path / "b.csv")).first()
    assert r.name == "José" and r.text == 'a "b"\nc'


def test_missing_and_maps(spark, tmp_path):
    assert tables.read_or_none(spark, str(tmp_path / "none")) is None
    (tmp_path / "o.json").write_text(json.dumps({"js": "JavaScript", "ts": "TypeScript"}))
    seeds = spark.createDataFrame([("JS", "Other"), ("Go", "Go")], "alias string, canonical string")
    got = dict(tuple(r) for r in tables.ontology(tables.json_map(spark, str(tmp_path / "o.json")), seeds).collect())
    assert got == {"js": "JavaScript", "ts": "TypeScript", "go": "Go"}


def test_graph_file(spark, tmp_path):
    g = {"skills": {"ml": {"category": "ai", "prerequisites": ["python", "sql"], "related": [], "leads_to": ["dl"]}}, "skill_clusters": {"c": ["ml", "dl"]}}
    (tmp_path / "g.json").write_text(json.dumps(g))
    nodes, edges, clusters = tables.skill_graph(spark, str(tmp_path / "g.json"))
    assert nodes.count() == 1 and clusters.count() == 2
    assert {(r.dst, r.type, r.ordinal) for r in edges.collect()} == {("python", "prerequisite", 0), ("sql", "prerequisite", 1), ("dl", "leads_to", 0)}


def test_records_and_sinks(spark, tmp_path):
    a = spark.createDataFrame([(2, "x"), (1, "y")], "id int, t string")
    recs = tables.union_records(tables.unified(a, "A", "a", "job", "id", title=F.col("t")), tables.unified(a.limit(0), "B", "b", "job", "id"))
    assert [(r.record_id, r.title) for r in recs.orderBy("record_id").collect()] == [("A_0001", "y"), ("A_0002", "x")]
    tables.write_table(recs, str(tmp_path / "r"))
    assert spark.read.parquet(str(tmp_path / "r")).dtypes == recs.dtypes
    tables.write_json(recs, str(tmp_path / "j"))
    assert json.loads(spark.read.text(str(tmp_path / "j")).first()[0])["source"] == "a"


def test_streaming_counts(spark, tmp_path):
    rows = spark.sql("SELECT timestamp'2024-01-01 00:10:00' AS ts, 'a' AS k UNION ALL SELECT timestamp'2024-01-01 00:20:00', 'a' UNION ALL SELECT timestamp'2024-01-01 02:00:00', 'b'")
    rows.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in"))
    q = windowed_counts(stream, "k").writeStream.outputMode("complete").format("memory").queryName("counts").start()
    q.processAllAvailable()
    q.stop()
    assert sorted((r.k, r.n) for r in spark.table("counts").collect()) == [("a", 2), ("b", 1)]


def test_streaming_terms(spark, tmp_path):
    rows = spark.sql("SELECT timestamp'2024-01-01 00:10:00' AS ts, 'JS and js, SQL.' AS text UNION ALL SELECT timestamp'2024-01-01 00:20:00', 'sql C++' UNION ALL SELECT timestamp'2024-01-03 02:00:00', NULL")
    rows.write.parquet(str(tmp_path / "in"))
    aliases = spark.createDataFrame([("js", "JavaScript"), ("sql", "SQL"), ("c++", "C++")], "alias string, canonical string")
    stream = spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in"))
    q = term_counts(stream, aliases).writeStream.outputMode("complete").format("memory").queryName("terms").start()
    q.processAllAvailable()
    q.stop()
    assert sorted((r.canonical, r.n) for r in spark.table("terms").collect()) == [("C++", 1), ("JavaScript", 1), ("SQL", 2)]
