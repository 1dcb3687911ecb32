"""Adjudication reports: write (A5) and read back.

A report lists every screened record in one text block, grouped into
sections by how the model's decision compares with the human code. Writing
sorts blocks by (section, ordinal) with a distributed range sort and writes
ordered part files; reading splits the text at the block marker (a
splittable text scan, one block per row) and extracts fields with regular
expressions. A block's section follows from its two codes by the same rule,
so reading needs no scan in file order.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# The report layout (headings and block template).
SECTION_HEADINGS = [
    "#### **Disagreements**\n\n##### **False exclusion**\n",
    "##### **False inclusion**\n",
    "#### **Agreements**\n",
]
SECTIONS = ["False exclusion", "False inclusion", "Agreements"]
BLOCK_MARK = "**STUDY-ID: "
BLOCK_TEMPLATE = (
    "**STUDY-ID: {study_id}:**\n\n"
    "-- **Title:** '{title}'\n\n"
    "-- **Abstract**: '{abstract}'\n\n"
    "-- **Answer (GPT)**: {answer}\n\n"
    "-- **Answer (GPT - numeric)**: {decision}\n\n"
    "-- **Answer (Human)**: {human}\n\n"
    "*Please add a comment on whether and why you agree with the GPT decision or not:*\n\n"
    "&nbsp;\n\n"
    "-- **Model**: {model}\n\n"
    "-- **Run date**: {run_date}\n\n"
    "&nbsp;\n"
)


def section_of(decision: str | Column, human: str | Column) -> tuple[Column, Column]:
    """(section name, sort rank): human 1/model 0 -> False exclusion (0);
    human 0/model 1 -> False inclusion (1); equal -> Agreements, 1/1 (2)
    before 0/0 (3). Rows missing a code are not reported (null)."""
    d = F.col(decision) if isinstance(decision, str) else decision
    h = F.col(human) if isinstance(human, str) else human
    rank = (F.when((h == 1) & (d == 0), 0).when((h == 0) & (d == 1), 1)
            .when((h == 1) & (d == 1), 2).when((h == 0) & (d == 0), 3))
    name = F.when(rank.isNotNull(), F.element_at(F.array(*[F.lit(s) for s in SECTIONS]), F.least(rank, F.lit(2)) + 1))
    return name, rank


def _shown(value: Column) -> Column:
    """A value in a block: a missing one is NA; a text that reads ``NA`` gets a backslash, so it stays a text."""
    return F.coalesce(F.when(value.rlike(r"\A\\*NA\z"), F.concat(F.lit("\\"), value)).otherwise(value), F.lit("NA"))


def _meant(shown: Column) -> Column:
    """The value that ``_shown`` was given."""
    return F.when(shown.rlike(r"\A\\+NA\z"), F.substr(shown, F.lit(2))).when(shown != "NA", shown)


def _fill(template: str, cols: dict[str, Column]) -> Column:
    """format the block: literal pieces and values concatenated (no format codes)."""
    out: list[Column] = []
    rest = template
    while "{" in rest:
        pre, _, tail = rest.partition("{")
        key, _, rest = tail.partition("}")
        out += [F.lit(pre), _shown(cols[key].cast("string"))]
    out.append(F.lit(rest))
    return F.concat(*out)


def report_rows(df: DataFrame, study_id: str = "eppi_id", title: str = "title", abstract: str = "abstract",
                answer: str = "answer", decision: str = "decision_binary", human: str = "human_code",
                model: str = "model", run_date: str = "run_date", ordinal: str = "ordinal",
                header_title: str = "Screening Results") -> DataFrame:
    """Rows ``(k1, k2, k3, value)`` of the report text in order: header, headings, blocks (``k3``: the ordinal as it is)."""
    name, rank = section_of(decision, human)
    block = _fill(BLOCK_TEMPLATE, {
        "study_id": F.col(study_id), "title": F.col(title), "abstract": F.col(abstract), "answer": F.col(answer),
        "decision": F.col(decision), "human": F.col(human), "model": F.col(model), "run_date": F.col(run_date)})
    blocks = df.select(rank.alias("k1"), F.lit(1).alias("k2"), F.col(ordinal).alias("k3"), block.alias("value")).filter(
        F.col("k1").isNotNull())
    spark = df.sparkSession
    head = [(-1, 0, f'---\ntitle: " {header_title} "\nsubtitle: " Full report "\nformat:\n   docx  \n---\n')]
    # heading of section s sorts just before its first block; the Agreements
    # heading precedes rank 2 (1/1) and rank 3 (0/0) blocks.
    for s, text in zip([0, 1, 2], SECTION_HEADINGS):
        head.append((s, 0, text))
    heads = spark.createDataFrame(head, "k1 int, k2 int, value string")
    return blocks.unionByName(heads, allowMissingColumns=True)


def write_report(df: DataFrame, path: str, mode: str = "overwrite", **kw) -> None:
    """A5: write the report as ordered text part files (distributed sort)."""
    rows = report_rows(df, **kw)
    rows.orderBy("k1", "k2", "k3").select("value").write.mode(mode).text(path)


def _grab(text: str, pattern: str) -> Column:
    return F.regexp_extract(F.col(text), pattern, 1)


def read_report(spark: SparkSession, path: str) -> DataFrame:
    """One row per block: section, study_id, title, abstract, answer,
    decision_binary, human_code, model, run_date. ``NA`` reads as missing."""
    raw = spark.read.option("lineSep", BLOCK_MARK).text(path).select(F.col("value").alias("b"))
    raw = raw.filter(F.col("b").rlike(r"\A[^\n]*:\*\*\n"))
    out = raw.select(
        _grab("b", r"\A([^\n]*):\*\*\n").alias("study_id"),
        _grab("b", r"(?s)-- \*\*Title:\*\* '(.*?)'\n\n-- \*\*Abstract\*\*").alias("title"),
        _grab("b", r"(?s)-- \*\*Abstract\*\*: '(.*?)'\n\n-- \*\*Answer \(GPT\)\*\*").alias("abstract"),
        _grab("b", r"(?s)-- \*\*Answer \(GPT\)\*\*: (.*?)\n\n-- \*\*Answer \(GPT - numeric\)").alias("answer"),
        _grab("b", r"Answer \(GPT - numeric\)\*\*: (\d+)").try_cast("int").alias("decision_binary"),
        _grab("b", r"Answer \(Human\)\*\*: (\d+)").try_cast("int").alias("human_code"),
        _grab("b", r"-- \*\*Model\*\*: ([^\n]*)").alias("model"),
        F.to_date(_grab("b", r"-- \*\*Run date\*\*: (\S+)")).alias("run_date"),
    )
    out = out.withColumns({c: _meant(F.col(c)) for c in ("study_id", "title", "abstract", "answer", "model")})
    name, _ = section_of("decision_binary", "human_code")
    return out.withColumn("section", name)
