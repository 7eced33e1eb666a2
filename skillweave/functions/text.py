"""Text columns: splitting, casing, field extraction, cleaning, term matching. JVM-side unless named *_udf."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Field patterns, fixed values.
EMAIL = r"[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\.[a-zA-Z]{2,}"
PHONES = (
    r"\+84[\s\-]?[0-9]{1,2}[\s\-]?[0-9]{3,4}[\s\-]?[0-9]{3,4}",
    r"0[0-9]{1,2}[\s\-]?[0-9]{3,4}[\s\-]?[0-9]{3,4}",
    r"\+[0-9]{1,3}[\s\-]?[0-9]{6,14}",
)
GITHUB = r"(?:https?://)?(?:www\.)?github\.com/[a-zA-Z0-9._-]+"
LINKEDIN = r"(?:https?://)?(?:www\.)?linkedin\.com/in/[a-zA-Z0-9._-]+"
URL = r"https?://[^\s]+"
GPA = r"\b(?:GPA|CPA|CGPA)[\s:]*([0-9]+\.[0-9]{2})/([0-9]+\.[0-9]{1,2})\b"
PERCENT = r"([0-9]+[.,]?[0-9]*)\s*%"


def split_terms(text: Column, pattern: str = r"[,;\n]+") -> Column:
    """Parts between delimiters, trimmed, without empty ones; null text gives none."""
    return F.filter(F.transform(F.split(F.coalesce(text, F.lit("")), pattern), lambda x: F.trim(x)), lambda x: x != "")


def title_case(text: Column) -> Column:
    """Every run of letters starts upper and goes on lower, whatever separates the runs."""
    runs = F.regexp_extract_all(text, F.lit(r"(\p{L}+|[^\p{L}]+)"), F.lit(1))
    return F.array_join(F.transform(runs, lambda x: F.concat(F.upper(F.substring(x, 1, 1)), F.lower(F.substring(x, 2, 1_000_000_000)))), "")


def preview(text: Column, n: int = 500) -> Column:
    return F.coalesce(F.substring(text, 1, n), F.lit(""))


def trailing_number(text: Column) -> Column:
    """The last run of digits as a number, else 0."""
    return F.coalesce(F.try_element_at(F.regexp_extract_all(text, F.lit(r"(\d+)"), F.lit(1)), F.lit(-1)).try_cast("bigint"), F.lit(0).cast("long"))


def surrogate_key(prefix: str, number: Column, count: Column) -> Column:
    """prefix_ and the number, padded with zeros to the count's width, four digits at least."""
    width = F.greatest(F.lit(4), F.length(count.cast("string")))
    digits = number.cast("string")
    return F.concat(F.lit(prefix + "_"), F.repeat(F.lit("0"), F.greatest(F.lit(0), width - F.length(digits))), digits)


def bound(value: Column, use) -> Column:
    """use(value) with the value worked out once, however often it is used."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def first_match(text: Column, pattern: str, group: int = 0) -> Column:
    """The first match of a pattern, or null; an empty group is null too."""
    if not group:
        return F.regexp_substr(text, F.lit(pattern))
    return bound(F.regexp_extract(text, pattern, group), lambda x: F.nullif(x, F.lit("")))


def _from(text: Column, at: Column, back: int = 0) -> Column:
    """The text from back characters before a place on, null where the place is 0 or null: what a pattern has to search."""
    return bound(at, lambda p: F.when(p > 0, F.substring(text, F.greatest(p - back, F.lit(1)), F.lit(2**31 - 1))))


def _grade_place(text: Column) -> Column:
    """Where 'gpa' or 'cpa' stands first, letter case aside; 1 where lower case moves places, 0 without either."""
    marks = lambda low: F.coalesce(F.array_min(F.filter(F.array(F.instr(low, "gpa"), F.instr(low, "cpa")), lambda x: x > 0)), F.lit(0))
    return bound(F.lower(text), lambda low: F.when(F.length(low) == F.length(text), marks(low)).otherwise(F.lit(1)))


def contact_fields(text: Column) -> list[Column]:
    """email, phone, github and linkedin (with scheme), urls and gpa (points/scale), each null or empty where absent.

    Every pattern is tried only from where the first of its matches can start, so a text without marks costs a plain search.
    """
    schemed = lambda c: bound(c, lambda x: F.when(F.startswith(x, F.lit("http")), x).otherwise(F.concat(F.lit("https://"), x)))
    near = lambda mark, back=0: _from(text, F.instr(text, mark), back)
    host = len("https://www.")
    return [
        F.when(F.contains(text, F.lit("@")), first_match(text, EMAIL)).alias("email"),
        F.coalesce(*[first_match(near(m), p) for m, p in zip(("+84", "0", "+"), PHONES)]).alias("phone"),
        schemed(first_match(near("github.com", host), GITHUB)).alias("github"),
        schemed(first_match(near("linkedin.com", host), LINKEDIN)).alias("linkedin"),
        F.coalesce(F.regexp_extract_all(near("://", len("https")), F.lit(f"({URL})"), F.lit(1)), F.array().cast("array<string>")).alias("urls"),
        F.regexp_replace(first_match(_from(text, _grade_place(text), 2), "(?i)" + GPA), r"^[^0-9]*", "").alias("gpa"),
    ]


def percentages(text: Column) -> Column:
    """All numbers before a per cent sign, comma read as point."""
    return F.filter(F.transform(F.regexp_extract_all(text, F.lit(PERCENT), F.lit(1)), lambda x: F.replace(x, F.lit(","), F.lit(".")).try_cast("double")), lambda x: x.isNotNull())


def token_estimate(text: Column) -> Column:
    """max(floor(1.3 words), floor(characters / 4))."""
    words = F.size(F.filter(F.split(F.trim(text), r"\s+"), lambda x: x != ""))
    return F.greatest(F.floor(words * 1.3), F.floor(F.length(text) / 4)).cast("long")


def clean_terminal(text: Column) -> Column:
    """Text without escape sequences, control and braille characters, with single spaces."""
    out = F.regexp_replace(text, r"\x1B\[[0-9;?]*[ -/]*[@-~]", "")
    out = F.regexp_replace(out, r"[\x00-\x08\x0B\x0C\x0E-\x1F\x7F]", "")
    out = F.regexp_replace(out, r"[⠀-⣿]", "")
    out = F.regexp_replace(out, r"[ \t]+", " ")
    return F.trim(F.regexp_replace(out, r"\n{3,}", "\n\n"))


def enriched_query(query: Column, domain: Column, hints: dict[str, str]) -> Column:
    """The query behind its domain's hint and '. '; as it is for an unknown or no domain."""
    hint = F.lit(None).cast("string")
    for name, text in hints.items():
        hint = F.when(domain == name, F.lit(text)).otherwise(hint)
    return F.coalesce(F.concat(hint, F.lit(". "), query), query)


def markdown_sections(texts: DataFrame, headers: dict[str, str], key: str = "doc_id") -> DataFrame:
    """(key, section, content): the lines below each heading line (#) that holds one of headers' names, up to the next such.

    headers maps a name (compared in lower case, in the given order) to a section; lines before the first are left out; of
    several sections of one name the last is taken. Each text is one array, so nothing is shuffled.
    """
    lines = F.split(F.coalesce("text", F.lit("")), "\n")
    found = F.lit(None).cast("string")
    line = F.col("l")
    for name, section in reversed(headers.items()):
        found = F.when(F.contains(F.lower(line), F.lit(name)), F.lit(section)).otherwise(found)
    rows = texts.select(key, F.posexplode(lines).alias("n", "l")).withColumn("head", F.when(F.startswith(F.trim(line), F.lit("#")), found))
    order = W.partitionBy(key).orderBy("n")
    rows = rows.withColumn("part", F.count("head").over(order)).withColumn("section", F.last("head", ignorenulls=True).over(order)).filter("part > 0")
    joined = rows.groupBy(key, "section", "part").agg(F.array_sort(F.collect_list(F.when(F.col("head").isNull(), F.struct("n", "l")))).alias("x"))
    content = F.array_join(F.transform("x", lambda y: y["l"]), "\n")
    return joined.groupBy(key, "section").agg(F.max_by(content, "part").alias("content"))


#: Dictionaries of at most this many terms are tried on each text; larger ones meet its n-grams in a join.
TERMS_BOUND = 2_000


def spaced_words(text: Column) -> Column:
    """The lower-case words of a text with one space around each: + # and inner . belong to words, all else separates them."""
    out = F.regexp_replace(F.concat(F.lit(" "), F.lower(F.coalesce(text, F.lit(""))), F.lit(" ")), r"[^\p{L}\p{N}+#.]+", " ")
    return F.regexp_replace(F.regexp_replace(out, r" \.+|\.+ ", " "), " {2,}", " ")


def extract_terms(texts: DataFrame, ontology: DataFrame, key: str = "doc_id") -> DataFrame:
    """(key, canonical): distinct canonicals of ontology (alias, canonical) that occur in texts (key, text).

    Aliases and the canonical names themselves are terms, of any number of words. The ontology is a dictionary: up to
    TERMS_BOUND terms become one array that each text filters, and only hits are exploded; more meet the texts' word n-grams
    of the terms' lengths in an equi-join.
    """
    both = ontology.select("canonical", F.explode(F.array("alias", "canonical")).alias("term"))
    terms = both.select("canonical", spaced_words(F.col("term")).alias("term")).filter("trim(term) <> ''").distinct()
    few = terms.limit(TERMS_BOUND + 1).collect()
    rows = texts.select(key, spaced_words(F.col("text")).alias("words"))
    if len(few) <= TERMS_BOUND:
        listed = F.array(*[F.struct(F.lit(r.term).alias("term"), F.lit(r.canonical).alias("canonical")) for r in few]) if few else None
        if listed is None:
            return rows.filter("false").select(key, F.lit("").alias("canonical"))
        hits = F.filter(listed, lambda t: F.contains(F.col("words"), t["term"]))
        return rows.select(key, F.explode(F.array_distinct(F.transform(hits, lambda t: t["canonical"]))).alias("canonical")).distinct()
    sizes = [r.n for r in terms.select((F.size(F.split(F.trim("term"), " "))).alias("n")).distinct().collect()]
    words = F.split(F.trim("words"), " ")
    runs = lambda n: F.transform(F.sequence(F.lit(1), F.greatest(F.size("w") - n + 1, F.lit(1))), lambda i: F.concat(F.lit(" "), F.array_join(F.slice("w", i, n), " "), F.lit(" ")))
    grams = rows.select(key, words.alias("w")).select(key, F.explode(F.array_distinct(F.concat(*[runs(n) for n in sizes]))).alias("term"))
    return grams.join(terms, "term").select(key, "canonical").distinct()


def resolve_aliases(skills: DataFrame, ontology: DataFrame) -> DataFrame:
    """skills (.., skill) with canonical (exact, any letter case) and known; unmatched skills keep their own text."""
    known = ontology.select(F.lower("alias").alias("low"), F.col("canonical").alias("found"))
    joined = skills.withColumn("low", F.lower(F.trim("skill"))).join(known, "low", "left")
    return joined.select(*skills.columns, F.coalesce("found", F.trim("skill")).alias("canonical"), F.col("found").isNotNull().alias("known"))


def detect_domain(texts: DataFrame, keywords: DataFrame, least: int = 2) -> DataFrame:
    """(doc_id, domain, hits): the domain with most keywords contained in the text, at least two; ties to the first listed.

    keywords is (domain, ordinal, keyword), a small table that becomes one expression, so texts are scanned once.
    """
    rows = [(r.domain, r.ordinal, r.keyword.lower()) for r in keywords.orderBy("ordinal", "keyword").collect()]
    by: dict[tuple[int, str], list[str]] = {}
    for domain, ordinal, word in rows:
        by.setdefault((ordinal, domain), []).append(word)
    low = F.lower(F.coalesce("text", F.lit("")))
    scores = [F.struct(sum((F.contains(low, F.lit(w)).cast("int") for w in words), F.lit(0)).alias("hits"), F.lit(-o).alias("o"), F.lit(d).alias("domain")) for (o, d), words in sorted(by.items())]
    best = F.array_max(F.array(*scores))
    return texts.select("doc_id", best.alias("b")).select("doc_id", F.when(F.col("b.hits") >= least, F.col("b.domain")).alias("domain"), F.col("b.hits").alias("hits"))
