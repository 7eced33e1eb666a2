"""Fuzzy grouping of skill names by the Ratcliff-Obershelp ratio, and the ontology built from the groups."""

from __future__ import annotations

from difflib import SequenceMatcher

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import DoubleType

from skillweave.operators import walks
from skillweave.storage import Levels

THRESHOLD = 85.0
TOP_NAMES = 200


@pandas_udf(DoubleType())
def ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    """2M/T * 100 of lower-cased strings, M matched characters, T the total; not symmetric, the first is compared with the second."""
    return pd.Series([SequenceMatcher(None, x.lower(), y.lower()).ratio() * 100 if x is not None and y is not None else None for x, y in zip(a, b)])


def character_marks(text: Column) -> Column:
    """The characters of a lower-cased string, each with the number of its occurrence: equal marks of two strings are common characters."""
    chars = F.filter(F.split(F.lower(text), ""), lambda c: c != "")
    return F.transform(chars, lambda c, i: F.concat(c, F.lit("#"), F.size(F.filter(F.slice(chars, 1, i + 1), lambda x: x == c)).cast("string")))


def _reach(n: Column, threshold: float) -> Column:
    """The lengths whose ratio with length n can pass: it is at most 2 min / (sum)."""
    least = threshold / (200 - threshold)
    return F.sequence(F.ceil(n * least).cast("int"), F.floor(n / least).cast("int"))


def _close(left: str, right: str, threshold: float) -> Column:
    """Whether so many characters are common that the ratio can reach the threshold; whole numbers, no order of characters."""
    return F.size(F.array_intersect(left, right)) * 200 >= (F.size(left) + F.size(right)) * threshold


def similar_pairs(names: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """(a, b, ratio) for names a < b by ordinal with a ratio of at least the threshold; names is (name, ordinal), distinct.

    Names meet in an equi-join on the lengths that can pass, then by a bound on their common characters; both lose no pair,
    and the ratio runs on the survivors. Null and blank names pair with nothing.
    """
    sized = names.filter("trim(name) <> ''").select("name", "ordinal", F.length("name").alias("n"), character_marks(F.col("name")).alias("marks"))
    reach = sized.select(F.col("name").alias("b"), F.col("ordinal").alias("ob"), F.col("marks").alias("mb"), F.explode(_reach(F.col("n"), threshold)).alias("n"))
    pairs = sized.select(F.col("name").alias("a"), F.col("ordinal").alias("oa"), F.col("marks").alias("ma"), "n").join(reach, "n").filter("oa < ob").filter(_close("ma", "mb", threshold))
    return pairs.select("a", "b", F.round(ratio("a", "b"), 4).alias("ratio")).filter(F.col("ratio") >= threshold)


def best_alias(skills: DataFrame, ontology: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """(skill, canonical, ratio): for each distinct skill the alias with the greatest ratio at the threshold; ties to the first by ordinal."""
    aliases = ontology.select("alias", "canonical", "ordinal", F.length("alias").alias("n"), character_marks(F.col("alias")).alias("ma"))
    wanted = skills.select("skill").distinct().filter("trim(skill) <> ''").select("skill", character_marks(F.col("skill")).alias("ms"), F.explode(_reach(F.length("skill"), threshold)).alias("n"))
    scored = wanted.join(aliases, "n").filter(_close("ms", "ma", threshold)).withColumn("ratio", ratio("skill", "alias")).filter(F.col("ratio") >= threshold)
    best = scored.groupBy("skill").agg(F.min(F.struct((-F.col("ratio")).alias("o"), "ordinal", "canonical")).alias("x"))
    return best.select("skill", "x.canonical", F.round(-F.col("x.o"), 4).alias("ratio"))


def normalized_skills(rows: DataFrame, ontology: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """rows (.., skill) with canonical and how it was found: exact, near or own.

    A skill, trimmed and in lower case, is first looked up among the aliases (alias, canonical, ordinal); what is left over
    takes the nearest alias at the threshold, and what is near none keeps its own trimmed text. Each distinct leftover is compared
    once, however often it occurs. Blank and null skills are left out.
    """
    known = ontology.groupBy(F.lower(F.trim("alias")).alias("low")).agg(F.min_by("canonical", "ordinal").alias("exact"), F.min("ordinal").alias("ordinal"))
    cleaned = rows.withColumn("low", F.lower(F.trim("skill"))).filter("low <> ''")
    left = cleaned.select(F.col("low").alias("skill")).distinct().join(known.select(F.col("low").alias("skill")), "skill", "left_anti")
    near = best_alias(left, known.select(F.col("low").alias("alias"), F.col("exact").alias("canonical"), "ordinal"), threshold)
    joined = cleaned.join(known.select("low", "exact"), "low", "left").join(near.select(F.col("skill").alias("low"), F.col("canonical").alias("near")), "low", "left")
    how = F.when(F.col("exact").isNotNull(), "exact").when(F.col("near").isNotNull(), "near").otherwise("own")
    return joined.select(*rows.columns, F.coalesce("exact", "near", F.trim("skill")).alias("canonical"), how.alias("found"))


def record_skills(records: DataFrame, ontology: DataFrame, key: str = "record_id", threshold: float = THRESHOLD) -> DataFrame:
    """(key, skills): sorted distinct skills of each record (key, title, description, skills_raw): its list normalised, and the terms in its description and title.

    Records without any skill have an empty list.
    """
    from skillweave.functions.text import extract_terms

    listed = records.select(key, F.explode("skills_raw").alias("skill"))
    raw = normalized_skills(listed, ontology, threshold).select(key, "canonical")
    texts = records.select(key, F.concat_ws("\n", F.coalesce("description", F.lit("")), F.coalesce("title", F.lit(""))).alias("text"))
    both = raw.unionByName(extract_terms(texts, ontology.select("alias", "canonical"), key)).groupBy(key).agg(F.array_sort(F.collect_set("canonical")).alias("found"))
    return records.select(key).join(both, key, "left").select(key, F.coalesce("found", F.array().cast("array<string>")).alias("skills"))


def groups(names: DataFrame, pairs: DataFrame) -> DataFrame:
    """(name, root): components of pairs (a, b) of names (name, ordinal), named by the smallest ordinal."""
    found = walks.components(names.select(F.col("name").alias("node"), F.col("ordinal").cast("long").alias("ordinal")), pairs.select("a", "b"))
    return found.select(F.col("node").alias("name"), "root")


def canonical_names(grouped: DataFrame, frequency: DataFrame) -> DataFrame:
    """(name, canonical): each group's most frequent name, then its shortest, then the first by name."""
    rows = grouped.join(frequency.select("name", "frequency"), "name", "left").fillna({"frequency": 0})
    rn = F.row_number().over(W.partitionBy("root").orderBy(F.desc("frequency"), F.length("name"), "name"))
    best = rows.withColumn("rn", rn).filter("rn = 1").select("root", F.col("name").alias("canonical"))
    return rows.join(best, "root").select("name", "canonical", "frequency")


def build_ontology(found: DataFrame, manual: DataFrame, seeds: DataFrame) -> DataFrame:
    """(alias, canonical): mined groups (name, canonical), overridden by manual aliases (alias, canonical), completed by seeds (skill).

    Aliases are trimmed and in lower case. A manual canonical maps to itself where nothing else has its name, and so does a
    seed; a seed that is some canonical but for its letter case gives the case.
    """
    low = lambda c: F.lower(F.trim(c))
    mined = found.select(low("name").alias("alias"), "canonical", F.lit(1).alias("prio"))
    own = manual.select(low("canonical").alias("alias"), "canonical", F.lit(2).alias("prio"))
    fresh = seeds.select(low("skill").alias("alias"), F.col("skill").alias("canonical"), F.lit(3).alias("prio"))
    rows = manual.select(low("alias").alias("alias"), "canonical", F.lit(0).alias("prio")).unionByName(mined).unionByName(own).unionByName(fresh)
    first = rows.groupBy("alias").agg(F.min(F.struct("prio", "canonical")).alias("x")).select("alias", F.col("x.canonical").alias("canonical"))
    cased = seeds.groupBy(low("skill").alias("alias")).agg(F.min("skill").alias("seed"))
    return first.join(cased, "alias", "left").select("alias", F.when(low("canonical") == F.col("alias"), F.coalesce("seed", "canonical")).otherwise(F.col("canonical")).alias("canonical"))


def skills_master(ontology: DataFrame, grouped: DataFrame) -> DataFrame:
    """(skill, frequency, aliases): the summed frequency of each canonical's variants, and its other aliases, sorted.

    grouped is (name, canonical, frequency) as mined; a group counts for the canonical that the ontology gives its own.
    """
    final = grouped.withColumn("alias", F.lower(F.trim("canonical"))).join(ontology.withColumnRenamed("canonical", "final"), "alias", "left")
    counts = final.groupBy(F.coalesce("final", "canonical").alias("skill")).agg(F.sum("frequency").alias("frequency"), F.collect_set(F.lower(F.trim("name"))).alias("variants"))
    names = ontology.groupBy(F.col("canonical").alias("skill")).agg(F.collect_set("alias").alias("named"))
    rows = names.join(counts, "skill", "full_outer")
    none = F.array().cast("array<string>")
    every = F.array_sort(F.array_distinct(F.concat(F.coalesce("named", none), F.coalesce("variants", none))))
    return rows.select("skill", F.coalesce("frequency", F.lit(0).cast("long")).alias("frequency"), F.filter(every, lambda a: a != F.lower(F.trim("skill"))).alias("aliases"))


def mined_ontology(names: DataFrame, manual: DataFrame, seeds: DataFrame, threshold: float = THRESHOLD, top: int = TOP_NAMES) -> tuple[DataFrame, DataFrame]:
    """(ontology, groups) of the most frequent names (name): one row for each use of a name."""
    ranked = names.filter("trim(name) <> ''").groupBy("name").agg(F.count(F.lit(1)).alias("frequency")).orderBy(F.desc("frequency"), "name").limit(top)
    numbers = Levels(names.sparkSession, "names")
    numbers.add(0, ranked.withColumn("ordinal", F.row_number().over(W.orderBy(F.desc("frequency"), "name"))))
    vocabulary = numbers.at(0)
    grouped = canonical_names(groups(vocabulary, similar_pairs(vocabulary, threshold)), vocabulary)
    return build_ontology(grouped, manual, seeds), grouped


def iterated_ontology(records: DataFrame, manual: DataFrame, seeds: DataFrame, iterations: int = 2, key: str = "record_id", threshold: float = THRESHOLD, top: int = TOP_NAMES) -> tuple[DataFrame, DataFrame, int]:
    """(ontology, groups, passes): skills are extracted with the ontology so far and mined again, until the ontology stays as it is.

    The first pass starts from the manual aliases and the seeds. Each pass is stored before the next reads it; iterations bounds the
    passes, and passes tells how many were made, the last without a change among them.
    """
    kept = Levels(records.sparkSession, "ontology")
    numbered = lambda o: o.withColumn("ordinal", F.xxhash64("alias", "canonical"))
    kept.add(0, build_ontology(seeds.select(F.col("skill").alias("name"), F.col("skill").alias("canonical")).limit(0), manual, seeds))
    grouped, done = None, 0
    while done < iterations:
        skills = record_skills(records, numbered(kept.at(done)), key, threshold)
        fresh, grouped = mined_ontology(skills.select(F.explode("skills").alias("name")), manual, seeds, threshold, top)
        kept.add(done + 1, fresh)
        done += 1
        if kept.at(done).exceptAll(kept.at(done - 1)).isEmpty() and kept.at(done - 1).exceptAll(kept.at(done)).isEmpty():
            break
    return kept.at(done), grouped, done
