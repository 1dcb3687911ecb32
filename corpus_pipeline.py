"""Training corpus pipeline: filter, de-duplicate, mix and pack documents.

Each stage takes ``(spark, docs, sf_dir)`` and returns a DataFrame; what it
returns is written as Parquet and read again as the next stage's ``docs``.
All stages but the last return the columns of ``documents``.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sievekit.llm.common import stash, table
from sievekit.llm.exact_dedup import drop_copies
from sievekit.llm.mixing import replicate
from sievekit.llm.ngram_join import jaccard_components
from sievekit.llm.packing import pack
from sievekit.llm.quality_rules import quality_rules, with_trust


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep; trusted texts are those of ``docs`` that the labels call good."""
    marked = with_trust(docs, table(spark, sf_dir, "labels"))
    return quality_rules(docs, F.col("__trusted"), corpus=marked).filter("kept").select(*docs.columns)


def drop_exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each text (white space aside): the one with the least id."""
    return drop_copies(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-copy group: the one with the least id."""
    groups = jaccard_components(docs)
    gone = stash(groups.filter("component_id <> doc_id").select(F.col("doc_id").alias("__id")), "gone")
    return docs.join(gone, F.col("doc_id") == F.col("__id"), "left_anti")


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents repeated to the target source weights, in a global random order."""
    return replicate(docs).select(*docs.columns)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of token sequences of fixed length."""
    return pack(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality_rules", keep_good),
    ("exact_dedup", drop_exact_copies),
    ("ngram_jaccard_join", drop_near_copies),
    ("poisson_mixing", mix_sources),
    ("packing", pack_sequences),
]

#: Hashed n-grams and a tokenizer vocabulary are not expressible in SQL; tests compare with plain Python.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each stage's result is written to the shared folder and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stash(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
