"""The corpus pipeline: documents to mixed, deduplicated, encoded training data.

STAGES lists (name, function); a function takes (spark, docs, sf_dir) and returns a DataFrame that is written and read again
as the next one's docs. All but the last return the columns of documents. Rows that repeat an id stand or fall together.
"""

from __future__ import annotations

import functools

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skillweave.llm import jaccard_join, line_dedup, pieces, source_mixing, toxicity
from skillweave.llm.common import stored, table


#: The columns that stages know; any others travel beside them.
COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def keeps_columns(stage):
    """A stage over the known columns, with all others carried in one struct: none of their names can meet one of an operator's."""

    @functools.wraps(stage)
    def whole(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        others = [c for c in docs.columns if c not in COLUMNS]
        if not others:
            return stage(spark, docs, sf_dir)
        rest = F.struct(*[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(others)]).alias("__rest")
        out = stage(spark, docs.select(*[c for c in docs.columns if c in COLUMNS], rest), sf_dir)
        return out.select(*[F.col(c) if c in COLUMNS else F.col(f"__rest.c{others.index(c)}").alias(c) for c in docs.columns])

    return whole


@keeps_columns
def clean(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity network does not reject; it learns from the labels of docs' own ids.

    Null and empty texts are scored as one empty window; without labels nothing is rejected. Repeated rows are alike, so they
    stay or go together.
    """
    net = toxicity.fitted(docs, table(spark, sf_dir, "labels").select("doc_id", "toxic"))
    return toxicity.score_texts(docs, net).filter("score < 0.5").drop("score")


@keeps_columns
def without_recurring_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document, without the lines whose template recurs; n_chars follows the text.

    Null texts stay null; a document all of whose lines go keeps an empty text. The holder of a template is the smallest id
    (null ids last); rows that repeat lose the same lines.
    """
    cut = line_dedup.drop_recurring_lines(docs)
    cut = cut.withColumn("n_chars", F.when(F.col("n_dropped") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars")))
    return cut.select(*docs.columns)


@keeps_columns
def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates: the one with the smallest id.

    Texts without a word, null ones among them, are near nothing and stay. Rows that repeat the id of a group's first
    document all stay, as do rows without an id that are near no row with one.
    """
    found = jaccard_join.near_duplicates(docs.select("doc_id", "text"))
    kept = found.filter(F.col("doc_id").eqNullSafe(F.col("component_id"))).select(F.col("doc_id").alias("__kept_id")).distinct()
    return docs.join(kept, F.col("doc_id").eqNullSafe(F.col("__kept_id")), "left_semi")


@keeps_columns
def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document as often as the mix of sources takes it.

    Documents of no word, null texts among them, are taken not at all; a null source is a source of its own. Ranks of equal
    odds are told apart by id, so reruns agree. Rows that repeat an id and a source are taken equally often.
    """
    copies = source_mixing.mix_sources(docs.select("doc_id", "source", "text"))
    copies = copies.groupBy(F.col("doc_id").alias("__id"), F.col("source").alias("__source")).agg(F.max("copies").alias("__copies")).filter("__copies > 0")
    joined = docs.join(copies, F.col("doc_id").eqNullSafe(F.col("__id")) & F.col("source").eqNullSafe(F.col("__source")))
    return joined.withColumn("__copy", F.explode(F.sequence(F.lit(1), F.col("__copies")))).select(*docs.columns)


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, ids, n_pieces) of every row, repeated rows and null ids among them; other columns are ignored.

    Null and empty texts have no ids. Of paths of equal score the lattice keeps the first it meets, always the same one.
    """
    return pieces.encode(docs.select("doc_id", "text"), pieces.load()).withColumn("n_pieces", F.size("ids").cast("long"))


STAGES = [
    ("toxicity", clean),
    ("line dedup", without_recurring_lines),
    ("n-gram Jaccard join", one_of_each),
    ("mixing sources", mixed),
    ("SentencePiece encoding", encoded),
]

#: The first stage is a fitted network, which SQL does not express; tests hold the stages against brute force instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on documents; what each returns is stored in the shared folder and read again."""
    docs = table(spark, sf_dir, "documents")
    for at, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if at < len(STAGES) - 1:
            docs = stored(docs, f"stage-{at}")
    return docs
