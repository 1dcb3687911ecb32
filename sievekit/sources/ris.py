"""Citation files (RIS): read into record rows (A1, A2) and write back (A3).

Reading is a splittable text scan whose record separator is the end tag
(``\\nER  -``), so one record is one input row and large files are cut into
many tasks. Each record is parsed with built-in string and array functions:
a line that starts a tag (``XY  - value``) begins an entry, any other line
continues the previous value (joined with a newline). Repeated tags become
arrays, unmapped tags go to the ``extra`` map.

``ordinal`` keeps the input order without relying on partition order:
``file_rank * 2^40 + (split start byte + record index within the split)``.
The record index within a split is strictly smaller than the split length,
so ordinals are unique and increase through each file.
"""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

# The record grammar and the tag -> column mapping.
END_TAG = "ER  -"
TAG_LINE = r"[A-Z][A-Z0-9]  -"
FIRST_OF = {
    "type": ["TY"],
    "title": ["T1", "TI"],
    "secondary_title": ["T2", "BT"],
    "journal": ["JF", "JO"],
    "date": ["DA", "Y1"],
    "abstract": ["AB"],
    "volume": ["VL"],
    "issue": ["IS"],
    "start_page": ["SP"],
    "end_page": ["EP"],
    "doi": ["DO"],
    "url": ["UR"],
    "issn": ["SN"],
    "publisher": ["PB"],
    "place": ["CY"],
    "short_title": ["ST"],
    "eppi_id": ["U1"],
    "other_id": ["U2"],
    "notes": ["N1"],
}
ALL_OF = {"author": ["A1", "AU"], "keywords": ["KW"]}
YEAR_TAGS = ["PY", "Y1", "DA"]
# Tags written back for each column (export dialect).
WRITE_TAGS = [
    ("type", "TY"), ("title", "T1"), ("secondary_title", "T2"), ("journal", "JF"), ("author", "A1"),
    ("keywords", "KW"), ("year", "PY"), ("date", "DA"), ("abstract", "AB"), ("volume", "VL"), ("issue", "IS"),
    ("start_page", "SP"), ("end_page", "EP"), ("doi", "DO"), ("url", "UR"), ("issn", "SN"),
    ("publisher", "PB"), ("place", "CY"), ("short_title", "ST"), ("eppi_id", "U1"), ("other_id", "U2"),
    ("notes", "N1"),
]

MAPPED = sorted({t for ts in FIRST_OF.values() for t in ts} | {t for ts in ALL_OF.values() for t in ts} | {"PY"})


def _values(entries: str, tags: list[str]) -> Column:
    keep = F.filter(entries, lambda e: e["tag"].isin(tags))
    return F.transform(keep, lambda e: e["value"])


def _full_path(spark: SparkSession, path: str) -> str:
    """The path as Spark reports it for its files (scheme, no trailing slash)."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    full = p.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(p).toString()
    return re.sub(r"^(\w+):/+", r"\1:/", full).rstrip("/")


def _below(file: Column, paths: Sequence[str]) -> Column:
    """Position in ``paths`` of the file itself or of its deepest folder there; null if none.

    A bare name stands for every file of exactly that name.
    """
    out = F.lit(None).cast("int")
    for i, p in sorted(enumerate(paths), key=lambda x: len(x[1])):
        same = (file == p) | file.startswith(p + "/") if "/" in p else file.endswith("/" + p)
        out = F.when(same, F.lit(i)).otherwise(out)
    return out


def _file_offsets(splits: DataFrame, paths: Sequence[str]) -> DataFrame:
    """(source_file -> file_base): bytes of all files before it, by position of the input path, then name.

    Built from the per-split table (one row per split); ranked by a window
    over one row per file.
    """
    files = splits.groupBy("source_file").agg(F.max("file_size").alias("size"))
    idx = F.coalesce(_below(F.col("source_file"), paths), F.lit(len(paths)))
    w = Window.orderBy(idx, F.col("source_file")).rowsBetween(Window.unboundedPreceding, -1)
    return files.select("source_file", F.coalesce(F.sum("size").over(w), F.lit(0)).alias("file_base"))


def _unused(entry: Column, i: Column) -> Column:
    """Entries that no column takes: other tags, later values, a synonym whose first tag is there, a longer year."""
    tag = entry["tag"]
    later = i + 1 != F.array_position("tags", tag)
    second = F.lit(False)
    for tags in FIRST_OF.values():
        for t in tags[1:]:
            second = second | ((tag == t) & F.array_contains("tags", tags[0]))
    scalar = sorted({t for tags in FIRST_OF.values() for t in tags})
    long_year = (tag == "PY") & ~F.trim(entry["value"]).rlike(r"^\d{4}$")
    return ~tag.isin(MAPPED) | (tag.isin(scalar) & (later | second)) | ((tag == "PY") & (later | long_year))


def read_ris(spark: SparkSession, paths: str | Sequence[str], labels: dict[str, dict] | None = None) -> DataFrame:
    """A1/A2: read citation files into record rows.

    ``labels`` optionally maps an input file or folder to constant columns
    (e.g. ``{"incl.ris": {"cite_label": "included", "human_code": 1}}``); a
    file takes those of its own path or name, or of its deepest labelled folder. A
    value that has no column of its own (a repeated tag, a second synonym)
    is kept in ``extra`` under its tag. ``ordinal`` is the bytes of the files
    before, plus the place in the file.
    """
    paths = [paths] if isinstance(paths, str) else list(paths)
    full = [_full_path(spark, p) for p in paths]
    raw = (
        spark.read.option("lineSep", "\n" + END_TAG).text(paths)
        .select(
            F.col("value").alias("chunk"),
            F.regexp_replace(F.url_decode(F.col("_metadata.file_path")), r"^(\w+):/+", "$1:/").alias("source_file"),
            F.col("_metadata.file_size").alias("file_size"),
            F.col("_metadata.file_block_start").alias("block_start"),
            F.monotonically_increasing_id().alias("mono"),
        )
    )
    # Record index within its split: offset from the split's first row id.
    firsts = raw.groupBy("source_file", "block_start").agg(
        F.min("mono").alias("mono0"), F.max("file_size").alias("file_size"))
    bases = _file_offsets(firsts, full)
    recs = (
        raw.join(firsts.drop("file_size"), ["source_file", "block_start"])
        .join(bases, "source_file")
        .withColumn("ordinal", F.col("file_base") + F.col("block_start") + F.col("mono") - F.col("mono0"))
    )
    text = F.regexp_replace(F.regexp_replace("chunk", "\r", ""), r"(?m)\A[\s\S]*?(?=^TY  -)", "")
    recs = recs.withColumn("__t", text).filter(F.col("__t").startswith("TY  -"))
    marked = F.regexp_replace("__t", rf"\n(?={TAG_LINE})", "\u0001")
    entries = F.transform(
        F.split(marked, "\u0001"),
        lambda ln: F.struct(
            F.substring(ln, 1, 2).alias("tag"),
            F.regexp_replace(F.regexp_replace(F.regexp_replace(
                F.substr(ln, F.lit(3)), r"^  - ?", ""), r"[ \t\n]+$", ""), rf"\n (?= *{TAG_LINE})", "\n").alias("value"),
        ),
    )
    e = recs.select("ordinal", "source_file", entries.alias("entries"))
    e = e.withColumn("tags", F.transform("entries", lambda x: x["tag"]))
    cols: dict[str, Column] = {}
    for name, tags in FIRST_OF.items():
        firsts_ = [F.get(_values("entries", [t]), 0) for t in tags]
        cols[name] = F.coalesce(*firsts_) if len(firsts_) > 1 else firsts_[0]
    for name, tags in ALL_OF.items():
        cols[name] = _values("entries", tags)
    year_txt = F.coalesce(*[F.get(_values("entries", [t]), 0) for t in YEAR_TAGS])
    cols["year"] = F.regexp_extract(year_txt, r"(\d{4})", 1).try_cast("int")
    e = e.withColumn("rest", F.filter("entries", _unused))
    other_tags = F.array_distinct(F.transform("rest", lambda x: x["tag"]))
    cols["extra"] = F.map_from_arrays(other_tags, F.transform(other_tags, lambda t: F.transform(
        F.filter("rest", lambda x: x["tag"] == t), lambda x: x["value"])))
    out = e.select(
        F.col("ordinal"), F.col("source_file"),
        *[cols[c].alias(c) for c in ["eppi_id", "type", "title", "secondary_title", "author", "journal", "year",
                                     "date", "abstract", "keywords", "volume", "issue", "start_page", "end_page",
                                     "doi", "url", "issn", "publisher", "place", "short_title", "other_id", "notes",
                                     "extra"]],
    )
    if labels:
        named = [_full_path(spark, p) if "/" in p or p in paths else p for p in labels]
        at = _below(F.col("source_file"), named)
        for k in sorted({k for v in labels.values() for k in v}):
            value = F.lit(None)
            for i, consts in enumerate(labels.values()):
                value = F.when(at == i, F.lit(consts.get(k))).otherwise(value)
            out = out.withColumn(k, value)
    return out


def _escaped(v: Column) -> Column:
    """A line of the value that looks like a tag gets one more blank before it (read_ris takes it away)."""
    return F.regexp_replace(v.cast("string"), rf"\n(?= *{TAG_LINE})", "\n ")


def _tag_line(tag: str):
    def line(v: Column) -> Column:
        return F.concat(F.lit(f"{tag}  - "), _escaped(v))

    return line


def ris_text(df: DataFrame) -> Column:
    """The citation-file text of one row (A3): tags in export order, arrays repeated.

    A column without a tag is an error: select what the file can hold, or put it into ``extra``.
    """
    parts = []
    present = set(df.columns)
    lost = present - {name for name, _ in WRITE_TAGS} - {"extra", "ordinal", "source_file"}
    if lost:
        raise ValueError(f"no tag for {sorted(lost)}")
    for name, tag in WRITE_TAGS:
        if name not in present:
            continue
        c = F.col(name)
        dt = dict(df.dtypes)[name]
        if dt.startswith("array"):
            parts.append(F.transform(F.coalesce(c, F.array().cast("array<string>")), _tag_line(tag)))
        else:
            parts.append(F.when(c.isNotNull(), F.array(F.concat(F.lit(f"{tag}  - "), _escaped(c))))
                         .otherwise(F.array().cast("array<string>")))
    if "extra" in present:
        parts.append(F.flatten(F.transform(F.map_entries(F.coalesce("extra", F.create_map().cast("map<string,array<string>>"))),
                                           lambda kv: F.transform(kv["value"], lambda v: F.concat(kv["key"], F.lit("  - "), _escaped(v))))))
    lines = F.concat(*parts) if parts else F.array()
    return F.concat(F.array_join(lines, "\n"), F.lit(f"\n{END_TAG} \n"))


def write_ris(df: DataFrame, path: str, order_by: str = "ordinal", mode: str = "overwrite") -> None:
    """A3: write one record per row; part files follow ``order_by`` (range sort)."""
    (df.select(ris_text(df).alias("value"), F.col(order_by).alias("__o")).orderBy("__o").select("value")
     .write.mode(mode).text(path))
