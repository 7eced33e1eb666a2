"""Profiles: candidates and jobs in one shape, CV heads and careers by rule, documents to and from JSON."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from skillweave.functions.text import first_match, preview, split_terms, trailing_number

CV = (
    "personal_info struct<name: string, email: string, phone: string, github: string, linkedin: string>, summary string, "
    "education array<struct<institution: string, degree: string, gpa: double>>, experience array<struct<title: string, company: string, duration_months: int>>, "
    "projects array<struct<name: string, role: string, technologies: array<string>, description: string>>, skills array<string>, certifications array<string>, languages array<string>"
)


def resume_profiles(records: DataFrame) -> DataFrame:
    """Résumé records with skills as profiles; the id is the last number of the record id."""
    return records.filter("record_type = 'resume'").select(
        trailing_number(F.col("record_id")).alias("candidate_id"), "source", "category", F.col("skills_extracted").alias("skills"), F.size("skills_extracted").alias("skill_count"), preview(F.col("description")).alias("description_preview")
    )


def job_profiles(records: DataFrame, role: Column) -> DataFrame:
    """Job records with skills as profiles; role is the normalised title."""
    meta = lambda f: F.coalesce(F.col(f"metadata.{f}"), F.lit("")).alias(f)
    return records.filter("record_type = 'job'").select(
        F.col("record_id").alias("job_id"), "source", role.alias("role"), F.col("title").alias("title_original"), meta("company"), meta("location"), meta("salary_vnd"), meta("seniority"),
        F.col("skills_extracted").alias("skills"), F.size("skills_extracted").alias("skill_count"), "category",
    )


def head_name(rows: DataFrame, titles: list[str], key: str = "doc_id") -> DataFrame:
    """(key, name): the first line of three characters or more without contact marks and without a title word."""
    low = F.lower("line")
    plain = (F.length(F.trim("line")) >= 3) & ~F.col("line").rlike(r"[@+|§—]")
    for t in titles:
        plain = plain & ~F.contains(low, F.lit(t))
    return rows.filter(plain).groupBy(key).agg(F.min_by(F.trim("line"), "line_no").alias("name"))


#: Fields of work and the keywords that tell them, fixed values.
DOMAINS = {
    "AI/ML": ["ai", "ml", "machine learning", "deep learning", "nlp", "llm", "rag", "transformer", "pytorch", "tensorflow"],
    "Backend Development": ["backend", "api", "fastapi", "flask", "django", "spring", "nodejs", "express"],
    "Frontend Development": ["frontend", "react", "vue", "angular", "html", "css", "javascript", "typescript"],
    "Data Science": ["data", "analysis", "pandas", "numpy", "sql", "database", "big data"],
    "DevOps/Cloud": ["devops", "docker", "kubernetes", "ci/cd", "aws", "azure", "gcp"],
    "Healthcare Tech": ["healthcare", "medical", "y tế", "sức khỏe"],
}


def listed_skills(lines: Column) -> Column:
    """The distinct skills of lines, in order: what stands behind a line's first colon, or all of it, cut at commas and semicolons."""
    rest = lambda x: F.when(F.contains(x, F.lit(":")), F.regexp_replace(x, r"(?s)^[^:]*:", "")).otherwise(x)
    none = F.array().cast("array<string>")
    return F.array_distinct(F.flatten(F.transform(F.filter(F.coalesce(lines, none), lambda x: x.isNotNull()), lambda x: split_terms(rest(x), "[;,]"))))


def career_profile(cvs: DataFrame, domains: dict[str, list[str]] = DOMAINS, key: str = "doc_id") -> DataFrame:
    """(key, stage, years, role, skills, technology_stack, domains, summary) of sectioned CVs (key, personal_info, education, experience, skills arrays of lines).

    Study words in the education give Student, years before 'năm' or 'year' in the experience turn that into Intern/Junior,
    anything else is Entry. The role is the first line of the experience. Skills are those listed_skills finds; a domain needs a
    keyword inside one. The stage names, study words and the summary's wording are fixed values.
    """
    none = F.array().cast("array<string>")
    flat = lambda c: F.lower(F.array_join(F.coalesce(c, none), " "))
    education, experience = flat("education"), flat("experience")
    studying = F.lit(False)
    for word in ("present", "hiện tại", "nay", "university", "học viện", "trường", "viện"):
        studying = studying | F.contains(education, F.lit(word))
    years = F.coalesce(F.regexp_extract(experience, r"([0-9]+\.?[0-9]*)\s*(?:năm|year)", 1).try_cast("double"), F.lit(0.0))
    stage = F.when(studying & (years > 0), "Intern/Junior").when(studying, "Student").otherwise("Entry")
    first = lambda c: F.nullif(F.trim(F.try_element_at(F.col(c), F.lit(1))), F.lit(""))
    rows = cvs.withColumn("_skills", listed_skills(F.col("skills"))).withColumn("_low", F.transform("_skills", F.lower))

    def any_of(words: list[str]) -> Column:
        return F.exists("_low", lambda x: F.array_contains(F.array(*[F.contains(x, F.lit(w)) for w in words]), True))

    rows = rows.withColumn("_domains", F.filter(F.array(*[F.when(any_of(words), F.lit(name)) for name, words in domains.items()]), lambda x: x.isNotNull()))
    fields = F.array_join("_domains", ", ")
    named = F.concat(first("personal_info"), F.lit(" - Ứng viên tiềm năng"))
    summary = F.when(F.size("_domains") > 0, F.coalesce(F.concat(named, F.lit(" | Lĩnh vực: "), fields), F.concat(F.lit("Lĩnh vực chuyên môn: "), fields))).otherwise(F.coalesce(named, F.lit("")))
    return rows.select(
        key, stage.alias("stage"), years.alias("years"), F.coalesce(F.substring(first("experience"), 1, 100), F.lit("Unknown")).alias("role"), F.col("_skills").alias("skills"), F.array_sort("_skills").alias("technology_stack"),
        F.col("_domains").alias("domains"), summary.alias("summary"),
    )


#: Patterns of the parser by lines, fixed values.
PERSONAL = {
    "email": r"[\p{L}\p{N}_.\-]+@[\p{L}\p{N}_.\-]+\.[\p{L}\p{N}_]+",
    "phone": r"(?:\+?\d{1,3}[-.\s]?)?\(?\d{2,4}\)?[-.\s]?\d{3}[-.\s]?\d{3,4}",
    "github": r"(?i)github\.com/[\p{L}\p{N}_\-.]+",
    "linkedin": r"(?i)linkedin\.com/in/[\p{L}\p{N}_\-.]+",
}
SCHOOL, FIELD = ("university", "học viện", "trường", "viện"), ("major", "chuyên ngành", "ngành")
EDUCATION = "institution string, start_date string, end_date string, gpa string, field string"


def personal_of(lines: Column) -> Column:
    """(name, email, phone, github, linkedin) of the lines of a section: the first line is the name, the others are first matches; null where absent."""
    text = F.array_join(F.coalesce(lines, F.array().cast("array<string>")), "\n")
    return F.struct(F.trim(F.try_element_at(lines, F.lit(1))).alias("name"), *[first_match(text, p).alias(f) for f, p in PERSONAL.items()])


def education_of(lines: Column) -> Column:
    """(institution, start_date, end_date, gpa, field) of the lines of a section, or null if none names a school.

    A line is of one kind: it names a school, or else has a grade over a scale, or else a month and year, or else a field of
    study; of several the last counts. A line of two dates gives start and end, one of a single date the end.
    """
    line = F.filter(F.transform(F.coalesce(lines, F.array().cast("array<string>")), lambda x: F.trim(x)), lambda x: x != "")
    has = lambda x, words: F.array_contains(F.array(*[F.contains(F.lower(x), F.lit(w)) for w in words]), True)
    school = lambda x: has(x, SCHOOL)
    grade = lambda x: ~school(x) & x.rlike(r"\d+\.\d+/\d+")
    dated = lambda x: ~school(x) & ~x.rlike(r"\d+\.\d+/\d+") & x.rlike(r"\d{2}/\d{4}")
    study = lambda x: ~school(x) & ~x.rlike(r"\d+\.\d+/\d+") & ~x.rlike(r"\d{2}/\d{4}") & has(x, FIELD) & x.rlike(r"[:\-–]")
    last = lambda xs: F.try_element_at(xs, F.lit(-1))
    points = F.filter(F.transform(F.filter(line, grade), lambda x: F.regexp_extract(x, r"(\d+\.\d+/\d+\.\d+)", 1)), lambda x: x != "")
    dates = F.transform(F.filter(line, dated), lambda x: F.regexp_extract_all(x, F.lit(r"((?i)\d{2}/\d{4}|Present|Hiện tại)"), F.lit(1)))
    start = last(F.transform(F.filter(dates, lambda d: F.size(d) >= 2), lambda d: F.element_at(d, 1)))
    end = last(F.transform(dates, lambda d: F.when(F.size(d) >= 2, F.element_at(d, 2)).otherwise(F.try_element_at(d, F.lit(1)))))
    field = last(F.transform(F.filter(line, study), lambda x: F.trim(F.regexp_replace(x, r"(?s)^[^:\-–]*[:\-–]", ""))))
    found = F.struct(last(F.filter(line, school)).alias("institution"), start.alias("start_date"), end.alias("end_date"), last(points).alias("gpa"), field.alias("field"))
    return F.when(F.exists(line, school), found)


#: Words that mark a line of technologies, fixed values.
TECHNOLOGIES = ("python", "fastapi", "pytorch")


def project_of(block: Column) -> Column:
    """A block of lines as a project: its first line without bullets is the name; of the others the last one about a role or
    position is the role, the last one with a known technology the list of technologies, and the rest describes it."""
    none = F.array().cast("array<string>")
    lines = F.transform(F.slice(block, 2, 1_000_000), lambda x: F.trim(x))
    is_role = lambda x: F.contains(F.lower(x), F.lit("role")) | F.contains(F.lower(x), F.lit("position"))
    is_tech = lambda x: ~is_role(x) & (F.contains(F.lower(x), F.lit(TECHNOLOGIES[0])) | F.contains(F.lower(x), F.lit(TECHNOLOGIES[1])) | F.contains(F.lower(x), F.lit(TECHNOLOGIES[2])))
    last = lambda some: F.try_element_at(F.filter(lines, some), F.lit(-1))
    return F.struct(
        F.btrim(F.element_at(block, 1), F.lit("•- *")).alias("name"),
        F.coalesce(last(is_role), F.lit("")).alias("role"),
        F.coalesce(F.transform(F.split(last(is_tech), ","), lambda x: F.trim(x)), none).alias("technologies"),
        F.array_join(F.filter(lines, lambda x: ~is_role(x) & ~is_tech(x)), " ").alias("description"),
    )


def parse_cv(document: Column, schema: str = CV) -> Column:
    """JSON text as a CV; fields that do not fit are null, text that is no JSON gives null."""
    return F.from_json(document, schema, {"mode": "PERMISSIVE"})


def dump_cv(cv: Column, exclude_none: bool = True) -> Column:
    return F.to_json(cv, {"ignoreNullFields": str(exclude_none).lower()})


def merged_fields(rules: Column, model: Column, rules_first: bool = True) -> Column:
    """One of two extractions of a field: the preferred one unless it is null or blank."""
    a, b = (rules, model) if rules_first else (model, rules)
    return F.coalesce(F.when(F.trim(a) != "", a), b)


def prompt(template: str, analysis: Column, mark: str = "{structured_analysis}") -> Column:
    """A prompt document: the template with the analysis as JSON at the mark."""
    return F.replace(F.lit(template), F.lit(mark), F.to_json(analysis))
