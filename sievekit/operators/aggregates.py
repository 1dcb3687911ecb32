"""Counts, screening performance, error lists and label conflicts.

All are single aggregations with map-side partial aggregation; totals stay
1-row DataFrames (joined back by broadcast) instead of driver scalars.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sievekit.functions.scalars import col_


def count_equal(c: str | Column, value=1) -> Column:
    """E1 ``sum(x == v, na.rm = TRUE)``: missing values are not counted."""
    return F.count_if(col_(c) == F.lit(value)).cast("long")


def group_summary(df: DataFrame, by: list[str], first_of: str, ordinal: str, value: str) -> DataFrame:
    """E3 ``summarise(first(x), n(), min(v), max(v))`` per group.

    ``first`` is the value at the least ``ordinal`` (``min_by``), not
    whatever row a task sees first.
    """
    return df.groupBy(*by).agg(
        F.min_by(F.col(first_of), F.col(ordinal)).alias(f"first_{first_of}"),
        F.count(F.lit(1)).cast("long").alias("n"),
        F.min(value).alias(f"min_{value}"),
        F.max(value).alias(f"max_{value}"),
    )


def any_true(cond: Column) -> Column:
    """E4 as an aggregate: ``any(cond)``; missing counts as false, no rows give false."""
    return F.coalesce(F.bool_or(F.coalesce(cond, F.lit(False))), F.lit(False))


def any_match(df: DataFrame, cond: Column, name: str = "any_match") -> DataFrame:
    """E4 ``any(cond)`` over the table; missing counts as false. One row."""
    return df.agg(any_true(cond).alias(name))


def performance(decisions: DataFrame, by: list[str] | None = None, decision: str = "decision_binary",
                truth: str = "human_code") -> DataFrame:
    """E5 screening performance: confusion counts and the standard measures.

    Rows with a missing decision or truth are not counted in the confusion
    cells. Ratios with a zero denominator are null.
    """
    d, t = F.col(decision), F.col(truth)
    agg = decisions.groupBy(*(by or [])).agg(
        F.count(F.lit(1)).cast("long").alias("n"),
        F.count_if((d == 1) & (t == 1)).cast("long").alias("tp"),
        F.count_if((d == 0) & (t == 1)).cast("long").alias("fn"),
        F.count_if((d == 1) & (t == 0)).cast("long").alias("fp"),
        F.count_if((d == 0) & (t == 0)).cast("long").alias("tn"),
    )

    def r(num, den):
        return F.try_divide(num.cast("double"), den.cast("double"))

    tp, fn, fp, tn = (F.col(x) for x in ("tp", "fn", "fp", "tn"))
    return agg.withColumns({
        "recall": r(tp, tp + fn),
        "specificity": r(tn, tn + fp),
        "precision": r(tp, tp + fp),
        "npv": r(tn, tn + fn),
        "accuracy": r(tp + tn, tp + tn + fp + fn),
        "f1": r(2 * tp, 2 * tp + fp + fn),
    })


def error_lists(decisions: DataFrame, decision: str = "decision_binary", truth: str = "human_code",
                columns: list[str] | None = None) -> DataFrame:
    """False negatives and false positives with their texts, one table."""
    d, t = F.col(decision), F.col(truth)
    kind = F.when((d == 0) & (t == 1), F.lit("false_negative")).when((d == 1) & (t == 0), F.lit("false_positive"))
    cols = columns or ["abstract", decision, truth]
    return decisions.withColumn("error_type", kind).filter(F.col("error_type").isNotNull()).select(
        *[c for c in decisions.columns if c in ("eppi_id",)], "error_type", *cols
    )


def label_conflicts(df: DataFrame, group: str, label: str, code: str, ordinal: str = "ordinal",
                    id_col: str | None = None, included: str = "included", excluded: str = "excluded") -> DataFrame:
    """A merged record labelled both included and excluded gets code 1.

    Per group: ``labels`` (sorted distinct labels joined by ", ", null if
    none; bounded whatever the group size), ``conflict``, and ``human_code``
    resolved as 1 on conflict, else the code of the first member that has
    one. The test is on the label set, so every order and multiplicity of the
    two labels is caught (the fixed list of three orders is not needed).
    With ``id_col`` the group's least id is returned as ``cluster_id``. A row
    without a group key is a record of its own.
    """
    alone = F.when(F.col(group).isNull(), F.col(ordinal))
    labs = F.array_sort(F.collect_set(label))
    extra = [F.min(id_col).alias("cluster_id")] if id_col else []
    g = df.groupBy(group, alone.alias("__alone")).agg(
        *extra,
        F.count(F.lit(1)).cast("long").alias("n_members"),
        labs.alias("__labs"),
        F.min_by(F.col(code), F.when(F.col(code).isNotNull(), F.col(ordinal))).alias("__code"),
    )
    conflict = F.array_contains("__labs", included) & F.array_contains("__labs", excluded)
    return g.select(
        group,
        *(["cluster_id"] if id_col else []),
        "n_members",
        F.when(F.size("__labs") > 0, F.array_join("__labs", ", ")).alias("labels"),
        conflict.alias("conflict"),
        F.when(conflict, F.lit(1)).otherwise(F.col("__code")).cast("long").alias("human_code"),
    )


def label_conflict_rows(df: DataFrame, group: str, label: str, included: str = "included",
                        excluded: str = "excluded") -> DataFrame:
    """E7 audit: the rows of every group that holds both labels (null groups never do)."""
    both = df.filter(F.col(group).isNotNull() & F.col(label).isin(included, excluded)).groupBy(group).agg(
        F.min(label).alias("__lo"), F.max(label).alias("__hi")).filter("__lo <> __hi").select(group)
    return df.join(both, group, "left_semi")
