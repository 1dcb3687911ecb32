"""Filters with the two missing-value rules, and the criteria screen."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def keep(df: DataFrame, cond: Column) -> DataFrame:
    """C1 ``filter``: keep rows where ``cond`` is true; null drops the row."""
    return df.filter(cond)


def filter_out(df: DataFrame, cond: Column) -> DataFrame:
    """C2 ``filter_out``: drop rows where ``cond`` is true; null KEEPS the row.

    ``df.filter(~cond)`` would lose the null rows as well.
    """
    return df.filter(~F.coalesce(cond, F.lit(False)))


def criteria_screen(df: DataFrame, criteria: dict[str, Column], text: str | Column | None = None,
                    decision: str = "decision_binary", failed: str = "failed_criteria") -> DataFrame:
    """Include a record iff ALL criteria hold.

    ``criteria`` maps a criterion name to a boolean Column (a regex test, an
    array membership, a ``pandas_udf`` scorer...). A criterion that is null
    (e.g. missing abstract) counts as not met. Adds ``decision`` (1/0) and
    ``failed`` (sorted names of the criteria not met).
    """
    names = sorted(criteria)
    met = {n: F.coalesce(criteria[n], F.lit(False)) for n in names}
    fails = F.array_compact(F.array(*[F.when(~met[n], F.lit(n)) for n in names]))
    all_met = F.lit(True)
    for n in names:
        all_met = all_met & met[n]
    return df.withColumn(decision, all_met.cast("int")).withColumn(failed, fails)


def regex_criterion(text: str | Column, pattern: str) -> Column:
    """Case-insensitive regular-expression criterion on a text column."""
    c = F.col(text) if isinstance(text, str) else text
    return c.rlike(f"(?i){pattern}")
