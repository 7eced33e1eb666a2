"""Role names as data: titles that mean a role, and the words that say only how senior or in which language.

Rules are tables: read from here or from files, they are joined to titles and folded over them in their order.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from skillweave.functions.text import title_case

#: Titles and their roles as the market matrix names them, fixed values.
MARKET_ROLES = """
frontend developer = Frontend Developer
front-end developer = Frontend Developer
frontend engineer = Frontend Developer
front end developer = Frontend Developer
web developer = Frontend Developer
ui developer = Frontend Developer
backend developer = Backend Developer
back-end developer = Backend Developer
backend engineer = Backend Developer
back end developer = Backend Developer
server developer = Backend Developer
api developer = Backend Developer
fullstack developer = Fullstack Developer
full-stack developer = Fullstack Developer
full stack developer = Fullstack Developer
fullstack engineer = Fullstack Developer
ai engineer = AI Engineer
machine learning engineer = ML Engineer
ml engineer = ML Engineer
deep learning engineer = ML Engineer
data scientist = Data Scientist
nlp engineer = NLP Engineer
computer vision engineer = Computer Vision Engineer
cv engineer = Computer Vision Engineer
data analyst = Data Analyst
business intelligence analyst = Data Analyst
bi analyst = Data Analyst
data engineer = Data Engineer
etl developer = Data Engineer
big data engineer = Data Engineer
devops engineer = DevOps Engineer
sre = SRE
site reliability engineer = SRE
cloud engineer = Cloud Engineer
infrastructure engineer = Cloud Engineer
platform engineer = Platform Engineer
qa engineer = QA Engineer
test engineer = QA Engineer
automation tester = QA Automation
qa automation = QA Automation
manual tester = QA Manual
qa manual = QA Manual
product manager = Product Manager
pm = Product Manager
product owner = Product Owner
po = Product Owner
business analyst = Business Analyst
ba = Business Analyst
scrum master = Scrum Master
ux designer = UX/UI Designer
ui designer = UX/UI Designer
ux/ui designer = UX/UI Designer
ui/ux designer = UX/UI Designer
security engineer = Security Engineer
cyber security = Security Engineer
penetration tester = Security Engineer
mobile developer = Mobile Developer
ios developer = Mobile Developer
android developer = Mobile Developer
flutter developer = Mobile Developer
react native developer = Mobile Developer
sap consultant = SAP Consultant
salesforce developer = Salesforce Developer
erp developer = ERP Developer
"""

#: Titles and their roles as profiles name them, fixed values; eight differ from the market's.
PROFILE_ROLES = """
frontend developer = Frontend Developer
front-end developer = Frontend Developer
frontend engineer = Frontend Developer
front-end engineer = Frontend Developer
web developer = Frontend Developer
ui developer = Frontend Developer
react developer = Frontend Developer
angular developer = Frontend Developer
vue developer = Frontend Developer
javascript developer = Frontend Developer
typescript developer = Frontend Developer
backend developer = Backend Developer
back-end developer = Backend Developer
backend engineer = Backend Developer
back-end engineer = Backend Developer
server developer = Backend Developer
api developer = Backend Developer
java developer = Backend Developer
python developer = Backend Developer
golang developer = Backend Developer
go developer = Backend Developer
node.js developer = Backend Developer
nodejs developer = Backend Developer
.net developer = Backend Developer
dotnet developer = Backend Developer
php developer = Backend Developer
c# developer = Backend Developer
c++ developer = Backend Developer
fullstack developer = Fullstack Developer
full-stack developer = Fullstack Developer
full stack developer = Fullstack Developer
fullstack engineer = Fullstack Developer
full-stack engineer = Fullstack Developer
ai engineer = AI Engineer
ml engineer = ML Engineer
machine learning engineer = ML Engineer
deep learning engineer = ML Engineer
ai researcher = AI Engineer
nlp engineer = AI Engineer
computer vision engineer = AI Engineer
llm engineer = AI Engineer
data scientist = Data Scientist
data analyst = Data Analyst
data engineer = Data Engineer
big data engineer = Data Engineer
analytics engineer = Data Analyst
bi analyst = Data Analyst
business intelligence analyst = Data Analyst
devops engineer = DevOps Engineer
devops = DevOps Engineer
sre = Site Reliability Engineer
site reliability engineer = Site Reliability Engineer
cloud engineer = Cloud Engineer
infrastructure engineer = Cloud Engineer
platform engineer = Platform Engineer
qa engineer = QA Engineer
test engineer = QA Engineer
software tester = QA Engineer
automation tester = QA Engineer
qc engineer = QA Engineer
mobile developer = Mobile Developer
ios developer = Mobile Developer
android developer = Mobile Developer
flutter developer = Mobile Developer
react native developer = Mobile Developer
security engineer = Security Engineer
cybersecurity engineer = Security Engineer
penetration tester = Security Engineer
product manager = Product Manager
project manager = Project Manager
scrum master = Scrum Master
business analyst = Business Analyst
ba = Business Analyst
ux designer = UX Designer
ui designer = UX Designer
ux/ui designer = UX Designer
product designer = UX Designer
software engineer = Software Engineer
software developer = Software Engineer
developer = Software Engineer
engineer = Software Engineer
programmer = Software Engineer
"""

#: Patterns that are stripped from titles in this order, fixed values.
MARKET_STRIP = (
    r"\bsenior\b", r"\bjunior\b", r"\bmid[- ]?level\b", r"\bmid\b",
    r"\blead\b", r"\bprincipal\b", r"\bentry[- ]?level\b", r"\bentry\b",
    r"\bintern\b", r"\bfresher\b", r"\bassociate\b", r"\bstaff\b",
    r"\bhead of\b", r"\bdirector\b", r"\bvp\b",
    r"\bkỹ sư\b", r"\bchuyên viên\b", r"\bnhân viên\b",
    r"\btrưởng nhóm\b", r"\bphó trưởng\b", r"\bgiám đốc\b",
    r"\bquản lý\b", r"\bthực tập\b", r"\bmới tốt nghiệp\b",
    r"\bcó kinh nghiệm\b", r"\blập trình viên\b",
)
PROFILE_STRIP = (
    r"\bsenior\b", r"\bjunior\b", r"\bmid[- ]?level\b", r"\bmid\b", r"\blead\b", r"\bprincipal\b", r"\bintern\b", r"\bentry[- ]?level\b", r"\bstaff\b",
    r"kỹ\s*sư", r"chuyên\s*viên", r"nhân\s*viên", r"trưởng\s*nhóm", r"giám\s*đốc",
)
#: Marks trimmed from both ends of a stripped title, fixed values.
MARKET_MARKS, PROFILE_MARKS = "-,/ ", "-, "
UNKNOWN = "Unknown"


def role_map(spark: SparkSession, lines: str) -> DataFrame:
    """(title, role) of lines 'title = role'."""
    rows = [tuple(x.strip() for x in line.split(" = ", 1)) for line in lines.strip().splitlines()]
    return spark.createDataFrame(rows, "title string, role string")


def read_role_map(spark: SparkSession, path: str) -> DataFrame:
    """role_map of a text file, one rule a line; blank lines and lines that start with # are left out."""
    lines = spark.read.text(path).filter(r"trim(value) <> '' AND NOT startswith(trim(value), '#') AND contains(value, ' = ')")
    return lines.select(F.trim(F.substring_index("value", " = ", 1)).alias("title"), F.trim(F.expr("substring(value, instr(value, ' = ') + 3)")).alias("role"))


def bare_title(squeezed: Column, strip: tuple[str, ...], marks: str) -> Column:
    """A title in lower case without the patterns, single spaces, without marks at its ends."""
    out = squeezed
    for pattern in strip:
        out = F.regexp_replace(out, f"(?iU){pattern}", "")
    return F.btrim(F.trim(F.regexp_replace(out, r"\s+", " ")), F.lit(marks))


def role_names(titles: DataFrame, roles: DataFrame, strip: tuple[str, ...], marks: str, own: bool = False, title: str = "title") -> DataFrame:
    """titles (.., title) with role: by the whole title, else by what is left of it without strip, else that in title case.

    roles is (title, role) and is joined twice, so it may be of any size. Titles that strip to nothing are UNKNOWN, or their own title case if own;
    null and blank titles are UNKNOWN.
    """
    squeezed = F.trim(F.regexp_replace(F.lower(F.coalesce(F.col(title), F.lit(""))), r"\s+", " "))
    rows = titles.withColumn("_whole", squeezed)
    rows = rows.withColumn("_bare", bare_title(F.col("_whole"), strip, marks))
    for at in ("_whole", "_bare"):
        rows = rows.join(roles.select(F.col("title").alias(at), F.col("role").alias(f"{at}_role")), at, "left")
    left = F.when(F.col("_bare") != "", title_case(F.col("_bare"))).otherwise(title_case(F.col("_whole")) if own else F.lit(UNKNOWN))
    role = F.when(F.col("_whole") == "", UNKNOWN).otherwise(F.coalesce("_whole_role", "_bare_role", left))
    return rows.select(*titles.columns, role.alias("role"))


def market_roles(titles: DataFrame, title: str = "title") -> DataFrame:
    return role_names(titles, role_map(titles.sparkSession, MARKET_ROLES), MARKET_STRIP, MARKET_MARKS, title=title)


def profile_roles(titles: DataFrame, title: str = "title") -> DataFrame:
    return role_names(titles, role_map(titles.sparkSession, PROFILE_ROLES), PROFILE_STRIP, PROFILE_MARKS, own=True, title=title)
