"""Parquet tables (A4) and the record view over the driver tables.

The driver tables stand in for the screening data: ``documents`` are the
records (the first line of the text is the title, the whole text the
abstract), ``labels`` holds the human codes (``quality``) and the final
inclusions (``toxic``), null where a record was not labelled.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sievekit.functions.scalars import first_line

TABLES = (
    "region nation customer supplier part orders lineitem events documents "
    "embeddings pages benchmark labels conversations"
).split()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def save_table(df: DataFrame, path: str, mode: str = "overwrite", partition_by: list[str] | None = None) -> None:
    """A4 snapshot save as Parquet."""
    w = df.write.mode(mode)
    if partition_by:
        w = w.partitionBy(*partition_by)
    w.parquet(path)


def load_table(spark: SparkSession, path: str) -> DataFrame:
    """A4 snapshot load."""
    return spark.read.parquet(path)


def records(spark: SparkSession, sf_dir: str, labels: bool = True) -> DataFrame:
    """The record view ``R``.

    Columns: eppi_id, ordinal, title, abstract, human_code, included_full,
    decision_binary, model, score, n_chars, lang. ``score`` is an integer
    valued double with many ties on purpose; ``decision_binary`` stands for a
    model's include/exclude answer.

    ``labels=False`` leaves out the two code columns and the join that brings
    them: Spark cannot drop an unused outer join, and on large tables that
    join would shuffle the whole text just to discard the codes.
    """
    d = table(spark, sf_dir, "documents")
    if labels:
        lab = table(spark, sf_dir, "labels").select(
            "doc_id", F.col("quality").alias("human_code"), F.col("toxic").alias("included_full")
        )
        d = d.join(lab, "doc_id", "left")
    codes = ["human_code", "included_full"] if labels else []
    return d.select(
        F.col("doc_id").alias("eppi_id"),
        F.col("doc_id").alias("ordinal"),
        first_line("text").alias("title"),
        F.col("text").alias("abstract"),
        *codes,
        F.when(F.col("n_chars") % 3 == 0, 1).otherwise(0).alias("decision_binary"),
        F.col("source").alias("model"),
        (F.col("n_chars") % 997).cast("double").alias("score"),
        "n_chars",
        "lang",
    )


# SQL form of the same view for the DuckDB oracle.
RECORDS_SQL = """
R AS (
  SELECT d.doc_id AS eppi_id, d.doc_id AS ordinal,
         split_part(d.text, chr(10), 1) AS title, d.text AS abstract,
         l.quality AS human_code, l.toxic AS included_full,
         CASE WHEN d.n_chars % 3 = 0 THEN 1 ELSE 0 END AS decision_binary,
         d.source AS model, CAST(d.n_chars % 997 AS DOUBLE) AS score,
         d.n_chars, d.lang
  FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id
)"""
