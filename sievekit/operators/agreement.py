"""Decisions of one model, and agreement between two runs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sievekit.functions.scalars import column_range, to_number


def decisions_for_model(decisions: DataFrame, model: str, first: str = "human_code", last: str = "included_full",
                        model_col: str = "model") -> DataFrame:
    """One model's rows, codes in the column range ``first:last`` made numeric."""
    out = decisions.filter(F.col(model_col) == F.lit(model))
    rng = column_range(out, first, last)
    return out.withColumns({c: to_number(F.col(c).cast("string"), "double") for c in rng})


def run_agreement(a: DataFrame, b: DataFrame, key: str = "eppi_id", decision: str = "decision_binary") -> DataFrame:
    """J2 cross-tab of two runs' decisions on the ids both runs have."""
    j = a.select(key, F.col(decision).alias("decision_a")).join(
        b.select(key, F.col(decision).alias("decision_b")), key, "inner")
    return j.groupBy("decision_a", "decision_b").agg(F.count(F.lit(1)).cast("long").alias("n"))


def agreement_summary(crosstab: DataFrame) -> DataFrame:
    """J2 summary from the cross-tab: n, agreements, flips, rate, Cohen's kappa."""
    a, b, n = F.col("decision_a"), F.col("decision_b"), F.col("n")
    s = crosstab.agg(
        F.sum(n).alias("n"),
        F.sum(F.when(a.eqNullSafe(b), n).otherwise(0)).alias("agree"),
        F.sum(F.when(a == 1, n).otherwise(0)).alias("a1"),
        F.sum(F.when(a == 0, n).otherwise(0)).alias("a0"),
        F.sum(F.when(b == 1, n).otherwise(0)).alias("b1"),
        F.sum(F.when(b == 0, n).otherwise(0)).alias("b0"),
    )
    po = F.try_divide(F.col("agree").cast("double"), F.col("n").cast("double"))
    pe = F.try_divide((F.col("a1") * F.col("b1") + F.col("a0") * F.col("b0")).cast("double"),
                      (F.col("n") * F.col("n")).cast("double"))
    return s.select(
        F.col("n").cast("long").alias("n"),
        F.col("agree").cast("long").alias("agree"),
        (F.col("n") - F.col("agree")).cast("long").alias("flips"),
        po.alias("agreement_rate"),
        F.try_divide(po - pe, F.lit(1.0) - pe).alias("kappa"),
    )


def flips(a: DataFrame, b: DataFrame, key: str = "eppi_id", decision: str = "decision_binary") -> DataFrame:
    """Ids whose decision differs between the runs."""
    j = a.select(key, F.col(decision).alias("decision_a")).join(
        b.select(key, F.col(decision).alias("decision_b")), key, "inner")
    return j.filter(~F.col("decision_a").eqNullSafe(F.col("decision_b")))
