"""Operator 3: recurring lines by a log-template tree, in DataFrame functions only.

Parsing tree of fixed depth: a line goes to a leaf by its number of tokens and its DEPTH leading tokens (tokens with a
digit are fields and count as <*>). In a leaf that MIN_DOCS lines of different texts reach, a token is constant at its
position if it is met there that often; the others are variable fields and become <*>. A line whose constants make up at
least CONSTANT of its tokens has that as its template, any other line its own tokens. A template that MIN_DOCS different
texts use recurs, and its lines are dropped from every text but its holder, the user with the smallest document id, so that
no content is lost with all of its carriers. Equal texts are one text: copies alone make no line recur, and the copies of a
holder keep what it keeps. A line of fields only says nothing and is never a template; nor is an empty one.

Only hashes travel until the lines of crowded leaves are looked at, one carrier of each; then the texts travel once to meet
their lists of lines (as sorted merges at every size). Counts are pre-aggregated. What a join adds is stored first, so a hot leaf, template or text makes
a skewed join of two plain exchanges, which Spark splits.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from skillweave.llm.common import stored, table

DEPTH = 3
MIN_DOCS = 10
CONSTANT = 0.7

#: A line with single spaces between tokens, none around them, and <*> for every token with a digit. The test for what is
#: to be changed is far cheaper than the change.
_MASKED = (
    r"transform(split(text, '\\n'), l -> trim(if(l rlike '[0-9\\t\\x0B-\\r]' OR contains(l, '  '), "
    r"regexp_replace(regexp_replace(l, '(?<![^ \\t\\x0B-\\r])[^ \\t\\x0B-\\r0-9]*+[0-9][^ \\t\\x0B-\\r]*+', '<*>'), '[ \\t\\x0B-\\r]+', ' '), l)))"
)
_TOKENS = "length(m) - length(replace(m, ' ', '')) + 1"


def _leaf(depth: int) -> str:
    return f"xxhash64({_TOKENS}, substring_index(m, ' ', {depth}))"


def _lines(depth: int) -> str:
    """The distinct lines of a text that are more than fields: hash and leaf."""
    useful = f"filter({_MASKED}, m -> m <> '' AND (NOT contains(m, '<*>') OR replace(replace(m, '<*>', ''), ' ', '') <> ''))"
    return f"array_distinct(transform({useful}, m -> struct(xxhash64(m) AS line, {_leaf(depth)} AS leaf)))"


def recurring_lines(docs: DataFrame, depth: int = DEPTH, min_docs: int = MIN_DOCS, constant: float = CONSTANT) -> DataFrame:
    """(key, lines): the hashes of the lines that go from each text that loses some; docs has key, doc_id and a text."""
    met = docs.select("key", "doc_id", F.explode(F.expr(_lines(depth))).alias("x")).select("key", "doc_id", "x.line", "x.leaf")
    uses = stored(met.groupBy("line", "leaf", "key").agg(F.min("doc_id").alias("owner")), "uses")
    crowded = stored(uses.groupBy("leaf").agg(F.count(F.lit(1)).alias("docs")).filter(F.col("docs") >= min_docs).select("leaf"), "leaves")
    inside = stored(uses.join(crowded, "leaf"), "inside")
    wanted = stored(inside.groupBy("line", "leaf").agg(F.count(F.lit(1)).alias("docs"), F.min(F.struct("key", "owner")).alias("one")), "wanted")
    # The tokens of a line are read from one row that has it.
    held = docs.select("key", "doc_id", F.explode(F.expr(f"array_distinct({_MASKED})")).alias("m")).withColumn("of", F.xxhash64("m"))
    one = wanted.select("line", "leaf", "docs", F.col("one.key").alias("one_key"), F.col("one.owner").alias("one_owner"))
    found = held.join(one.hint("merge"), (F.col("of") == F.col("line")) & (F.col("key") == F.col("one_key")) & F.col("doc_id").eqNullSafe(F.col("one_owner")))
    lines = stored(found.dropDuplicates(["line"]).select("line", "leaf", "docs", F.split("m", " ").alias("t")), "tokens")
    # Leading tokens are constant in a crowded leaf. A leaf's token at a place is one hashed name.
    places = lines.select("line", "leaf", "docs", F.posexplode("t").alias("place", "token")).filter((F.col("place") >= depth) & (F.col("token") != "<*>"))
    places = places.select("line", "docs", "place", F.xxhash64("leaf", "place", "token").alias("name"))
    constants = stored(places.groupBy("name").agg(F.sum("docs").alias("seen")).filter(F.col("seen") >= min_docs).select("name"), "constants")
    kept = F.coalesce("kept", F.array().cast("array<int>"))
    leading = F.size(F.filter(F.slice("t", 1, depth), lambda x: x != "<*>"))
    shape = F.to_json(F.transform(kept, lambda p: F.struct(p.alias("place"), F.element_at("t", p + 1).alias("token"))))
    template = F.when(leading + F.size(kept) >= F.lit(constant) * F.size("t"), F.xxhash64("leaf", shape)).otherwise(F.col("line"))
    places_of = places.select("line", "place", "name").join(constants, "name").groupBy("line").agg(F.sort_array(F.collect_list("place")).alias("kept"))
    templates = stored(lines.select("line", "leaf", "t").join(places_of, "line", "left").select("line", template.alias("template")), "templates")
    used = stored(inside.select("key", "owner", "line").join(templates, "line"), "used")
    often = used.groupBy("template", "key").agg(F.min("owner").alias("owner")).groupBy("template").agg(F.count(F.lit(1)).alias("docs"), F.min("owner").alias("holder"))
    often = stored(often.filter(F.col("docs") >= min_docs).select("template", "holder"), "often")
    gone = used.join(often, "template").filter(~F.col("owner").eqNullSafe(F.col("holder")))
    return gone.groupBy("key").agg(F.collect_set("line").alias("lines"))


def drop_recurring_lines(docs: DataFrame, depth: int = DEPTH, min_docs: int = MIN_DOCS, constant: float = CONSTANT) -> DataFrame:
    """docs (doc_id, text, ...) with recurring lines taken out of text, and columns n_lines and n_dropped added last.

    Every row stays, if with an empty text. Lines end at \\n; the lines that stay are joined by \\n again; empty lines and
    lines of nothing but fields always stay. A null text stays null and has no line; an empty one has one empty line. Rows
    with equal texts lose the same lines. Ids decide who holds a line, null after all others: texts that share the smallest
    id hold it both. An own column named n_lines or n_dropped is replaced, all others pass. An empty table gives an empty
    result.
    """
    extra = [c for c in docs.columns if c not in ("doc_id", "text", "n_lines", "n_dropped")]
    # Other columns travel in one struct, so that none of their names can meet one of ours.
    keyed = docs.select("doc_id", "text", F.struct(F.lit(0).alias("_"), *[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(extra)]).alias("rest"))
    keyed = keyed.withColumn("key", F.when(F.col("text").isNotNull(), F.xxhash64("text")))
    found = stored(recurring_lines(keyed.filter("text IS NOT NULL").select("key", "doc_id", "text"), depth, min_docs, constant), "gone").withColumnRenamed("key", "of")
    joined = keyed.join(found.hint("merge"), F.col("key") == F.col("of"), "left")
    pairs = f"arrays_zip(split(text, '\\\\n'), {_MASKED})"
    left = F.when(F.col("lines").isNotNull(), F.expr(f"transform(filter({pairs}, x -> NOT array_contains(lines, xxhash64(x.`1`))), x -> x.`0`)"))
    n_lines = F.when(F.col("text").isNull(), 0).otherwise(F.length("text") - F.length(F.replace("text", F.lit("\n"), F.lit(""))) + 1)
    text = F.when(F.col("left").isNotNull(), F.array_join("left", "\n")).otherwise(F.col("text"))
    place = {c: f"rest.c{i}" for i, c in enumerate(extra)}
    return joined.withColumn("left", left).select(
        *[text.alias("text") if c == "text" else F.col(place.get(c, c)).alias(c) for c in docs.columns if c not in ("n_lines", "n_dropped")],
        n_lines.cast("long").alias("n_lines"),
        F.when(F.col("left").isNotNull(), n_lines - F.size("left")).otherwise(0).cast("long").alias("n_dropped"),
    )


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = drop_recurring_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_lines", "n_dropped", F.length("text").cast("long").alias("n_chars"), F.md5(F.encode("text", "utf-8")).alias("text_md5"))


#: The same rule for DuckDB: {documents} is a table with doc_id and text, the result adds new_text, n_lines and n_dropped.
RULE_SQL = r"""
o_texts AS (
  SELECT row_number() OVER () AS tid, text, min(doc_id) AS owner FROM {documents} WHERE text IS NOT NULL GROUP BY text
), o_lines AS (
  SELECT tid, unnest(range(1, len(ls) + 1)) AS no, unnest(ls) AS l FROM (SELECT tid, string_split(text, chr(10)) AS ls FROM o_texts)
), o_tok AS (
  SELECT tid, no, l, list_transform(list_filter(regexp_split_to_array(l, '[ \t\x0B-\x0D]+'), lambda x: x <> ''), lambda x: CASE WHEN regexp_matches(x, '[0-9]') THEN '<*>' ELSE x END) AS t FROM o_lines
), o_met AS (
  SELECT DISTINCT tid, owner, t, len(t) AS n, t[1:3] AS lead FROM o_tok JOIN o_texts USING (tid) WHERE replace(replace(array_to_string(t, ' '), '<*>', ''), ' ', '') <> ''
), o_crowded AS (
  SELECT n, lead FROM o_met GROUP BY n, lead HAVING count(*) >= 10
), o_in AS (
  SELECT o_met.* FROM o_met JOIN o_crowded USING (n, lead)
), o_distinct AS (
  SELECT t, n, lead, count(*) AS docs FROM o_in GROUP BY t, n, lead
), o_places AS (
  SELECT t, n, lead, docs, unnest(range(0, n)) AS place, unnest(t) AS token FROM o_distinct
), o_const AS (
  SELECT n, lead, place, token FROM o_places WHERE token <> '<*>' GROUP BY n, lead, place, token HAVING sum(docs) >= 10
), o_kept AS (
  SELECT p.t, p.n, p.lead, list(p.place || '=' || p.token ORDER BY p.place) AS kept FROM o_places p JOIN o_const USING (n, lead, place, token) GROUP BY p.t, p.n, p.lead
), o_templates AS (
  SELECT d.t, CASE WHEN len(k.kept) >= 0.7 * d.n THEN 'T' || d.n || CAST(d.lead AS VARCHAR) || CAST(k.kept AS VARCHAR) ELSE 'L' || CAST(d.t AS VARCHAR) END AS template FROM o_distinct d LEFT JOIN o_kept k ON d.t = k.t
), o_used AS (
  SELECT i.tid, i.owner, i.t, m.template FROM o_in i JOIN o_templates m ON i.t = m.t
), o_often AS (
  SELECT template, min(owner) AS holder FROM o_used GROUP BY template HAVING count(DISTINCT tid) >= 10
), o_gone AS (
  SELECT DISTINCT u.tid, u.t FROM o_used u JOIN o_often o USING (template) WHERE u.owner IS DISTINCT FROM o.holder
), o_docs AS (
  SELECT k.tid, count(*) AS n_lines, count(g.t) AS gone, string_agg(k.l, chr(10) ORDER BY k.no) FILTER (g.t IS NULL) AS left_text
  FROM o_tok k LEFT JOIN o_gone g ON k.tid = g.tid AND k.t = g.t GROUP BY k.tid
), o_out AS (
  SELECT r.*, CASE WHEN d.gone > 0 THEN coalesce(d.left_text, '') ELSE r.text END AS new_text,
    CAST(coalesce(d.n_lines, 0) AS BIGINT) AS n_lines, CAST(coalesce(d.gone, 0) AS BIGINT) AS n_dropped
  FROM {documents} r LEFT JOIN o_texts x ON r.text = x.text LEFT JOIN o_docs d ON d.tid = x.tid
)
"""

_SQL = (
    "WITH "
    + RULE_SQL.replace("{documents}", "documents")
    + "SELECT doc_id, n_lines, n_dropped, CAST(length(new_text) AS BIGINT) AS n_chars, md5(new_text) AS text_md5 FROM o_out"
)

QUERIES = {"op3_line_dedup": op3_line_dedup}
ORACLES = {"op3_line_dedup": _SQL}
