"""Text from page layouts: broken lines joined, blocks gathered into projects, section names made one."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Headers in upper case, fixed values.
HEADERS = (
    "GIÁO DỤC", "EDUCATION", "KINH NGHIỆM", "EXPERIENCE", "KỸ NĂNG", "SKILLS", "DỰ ÁN", "PROJECTS", "AWARDS", "GIẢI THƯỞNG", "CHỨNG CHỈ", "CERTIFICATIONS", "HOẠT ĐỘNG", "ACTIVITIES", "NGÔN NGỮ", "LANGUAGES",
    "ĐẠI HỌC", "CÔNG VIỆC", "NHÀ TUYỂN DỤNG", "CUỘC THI", "COMPETITIONS", "ACHIEVEMENTS", "THÔNG TIN CÁ NHÂN", "PERSONAL INFO", "TÓM TẮT", "SUMMARY", "LIÊN HỆ", "CONTACT", "LIÊN KẾT", "LINKS",
)
#: Bullets and dates, fixed values.
BULLET = r"^(?:[•\-*]\s+|\d+\.\s+|[a-zA-Z]\.\s+)"
DATE = r"(?i)\d{1,2}/\d{4}|\d{4}-\d{2}|(?:January|February|March|April|May|June|July|August|September|October|November|December|Jan|Feb|Mar|Apr|May|Jun|Jul|Aug|Sep|Oct|Nov|Dec)\s+\d{4}|Tháng|Năm|January|February"
UPPER_SHARE = 0.7
#: Words of a line that counts as short are fewer.
SHORT = 3


def stripped(text: Column) -> Column:
    return F.regexp_replace(text, r"^\s+|\s+$", "")


def is_header(line: Column, share: float = UPPER_SHARE) -> Column:
    """Whether a stripped line is a known header, or longer than two characters and mostly upper-case letters."""
    upper = F.length(F.regexp_replace(line, r"[^\p{Lu}]", "")) / F.length(line)
    return F.upper(line).isin(*HEADERS) | (F.length(line) > 2) & F.coalesce(upper > share, F.lit(False))


def is_bullet(line: Column) -> Column:
    return line.rlike(BULLET)


def _open(line: Column) -> Column:
    """Whether a line goes on: it ends in a joining word or mark, or in nothing that ends a sentence."""
    return F.lower(line).rlike(r"(?:,|-|and|or|&|;)$") | ~line.rlike(r"[.!?);]$")


def _joins(line: Column, following: Column) -> Column:
    """Whether a stripped line and the one below are one line that the layout broke."""
    plain = lambda x: (x != "") & ~is_header(x) & ~is_bullet(x)
    short = F.size(F.split(following, r"\s+")) < SHORT
    go_on = _open(line) | short & (~line.rlike(DATE) | ~line.rlike(r"[.!?;:]$"))
    return F.coalesce(plain(line) & plain(following) & go_on, F.lit(False))


def merged_lines(rows: DataFrame, key: str = "doc_id") -> DataFrame:
    """(key, line_no, line): lines (key, line_no, line) with broken ones joined to the next, blank ones left out.

    Lines are taken from the top; a line that is joined to takes no other. Whether two neighbours join depends on them
    alone, so in a run of lines that would each join the next the first, third and so on do: two windows tell a line's
    place in its run, and no line waits for the ones above. Headers and bullets stay alone.
    """
    order = W.partitionBy(key).orderBy("line_no")
    lines = rows.select(key, "line_no", stripped(F.col("line")).alias("line")).withColumn("below", F.lead("line").over(order))
    marked = lines.withColumn("joins", _joins(F.col("line"), F.col("below"))).withColumn("at", F.row_number().over(order))
    run = W.partitionBy(key, "joins", "run").orderBy("line_no")
    placed = marked.withColumn("run", F.col("at") - F.row_number().over(W.partitionBy(key, "joins").orderBy("line_no")))
    takes = placed.withColumn("takes", F.col("joins") & (F.row_number().over(run) % 2 == 1))
    taken = takes.withColumn("taken", F.coalesce(F.lag("takes").over(order), F.lit(False)))
    whole = F.when(F.col("takes"), F.concat("line", F.lit(" "), "below")).otherwise(F.col("line"))
    return taken.filter(~F.col("taken")).select(key, "line_no", whole.alias("line")).filter("line <> ''")


#: A block that opens a project, fixed value.
PROJECT = r"^(?:[•\-*]|[A-Z][\p{L}\p{N}_\s]+(?:–|:))"


def project_blocks(rows: DataFrame, key: str = "doc_id") -> DataFrame:
    """(key, project, blocks): text blocks (key, line_no, line) gathered into projects, numbered from 1.

    A block that starts with a bullet, or with a capitalised name before a dash or colon, opens a project; blank blocks and
    those above the first project are left out.
    """
    opens = F.col("line").rlike(PROJECT)
    number = F.sum(opens.cast("int")).over(W.partitionBy(key).orderBy("line_no").rowsBetween(W.unboundedPreceding, W.currentRow))
    kept = rows.select(key, "line_no", "line", number.alias("project")).filter((F.col("project") > 0) & (stripped(F.col("line")) != ""))
    return kept.groupBy(key, "project").agg(F.transform(F.array_sort(F.collect_list(F.struct("line_no", "line"))), lambda x: x["line"]).alias("blocks"))


def named_sections(rows: DataFrame, sections: dict[str, list[str]], key: str = "doc_id") -> DataFrame:
    """(key, section, lines): sections (key, section, pos, lines) under their canonical names, contents in order of pos joined.

    A name that is canonical stays; another one takes the first canonical section one of whose keywords it holds, letter
    case aside, and stays if there is none. Empty sections are left out.
    """
    low = F.lower("section")
    found = F.when(F.col("section").isin(*sections), F.col("section"))
    for name, words in sections.items():
        hit = F.lit(False)
        for w in words:
            hit = hit | F.contains(low, F.lit(w))
        found = found.when(hit, F.lit(name))
    kept = rows.filter(F.size("lines") > 0).select(key, found.otherwise(F.col("section")).alias("section"), "pos", "lines")
    return kept.groupBy(key, "section").agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("pos", "lines"))), lambda x: x["lines"])).alias("lines"))


#: Categories by keyword, in order, and those of names that hold none of them; fixed values.
CATEGORIES = {
    "Programming": ("python", "c/c++", "java", "javascript", "typescript", "cpp"),
    "Ai Ml": ("pytorch", "transformers", "nlp", "llm", "rag", "computer vision", "hugging face", "phobert", "gpt", "gemini"),
    "Frameworks": ("fastapi", "react", "streamlit", "pandas", "numpy", "scikit-learn", "opencv", "matplot", "kare"),
    "Tools": ("git", "github", "docker", "kaggle", "jupyter", "colab", "latex", "overleaf", "vllm", "chromadb"),
    "Programming Language": ("python", "java", "c++", "javascript"),
    "AI/ML": ("pytorch", "transformers", "nlp"),
}


def skill_category(skill: Column) -> Column:
    """The first category one of whose keywords a skill's name holds, else General."""
    low = F.trim(F.replace(F.lower(skill), F.lit("•"), F.lit("")))
    out = None
    for name, words in CATEGORIES.items():
        hit = F.lit(False)
        for w in words:
            hit = hit | F.contains(low, F.lit(w))
        out = F.when(hit, name) if out is None else out.when(hit, name)
    return out.otherwise("General")


def categorised_skills(rows: DataFrame, key: str = "doc_id") -> DataFrame:
    """(key, line_no, pos, skill, category) of skill lines (key, line_no, line): 'Category: a, b' or a list with categories by keyword."""
    from skillweave.functions.text import split_terms, title_case

    named = F.instr("line", ":") > 0
    rest = F.when(named, F.expr("substring(line, instr(line, ':') + 1)")).otherwise(F.col("line"))
    parts = rows.select(key, "line_no", F.when(named, title_case(stripped(F.substring_index("line", ":", 1)))).alias("named"), F.posexplode(split_terms(rest, "[;,]")).alias("pos", "skill"))
    return parts.select(key, "line_no", "pos", "skill", F.coalesce("named", skill_category(F.col("skill"))).alias("category"))
