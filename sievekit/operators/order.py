"""Ranked lists and the measures read off them.

A ranked list is a DataFrame with a unique ``ordinal`` (input order, the
tie-break) and a ``position`` column (1..n) assigned by
:func:`sievekit.plans.global_order.rank_rows`; nothing relies on partition
order and no step moves the whole list into one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sievekit.functions.scalars import col_, round_half_even
from sievekit.plans.global_order import rank_rows
from sievekit.session import materialize


def rank_list(df: DataFrame, score: str = "score", ordinal: str = "ordinal", position: str = "position",
              descending: bool = True, rows_per_bucket: int | None = None) -> DataFrame:
    """G1 + F1: order by score (desc, missing last), ties in input order; number rows."""
    out = rank_rows(df, score, ordinal, position=position, descending=descending,
                    rows_per_bucket=rows_per_bucket, totals=True)
    return out


def is_relevant(flag: str | Column, value: int = 1) -> Column:
    """Relevance test ``flag == value``; a missing flag is not relevant."""
    return F.coalesce(col_(flag) == F.lit(value), F.lit(False))


def recall_curve(df: DataFrame, relevant: str | Column, score: str = "score", ordinal: str = "ordinal",
                 rows_per_bucket: int | None = None) -> DataFrame:
    """F6 (+F8): position, cumulative relevant, recall %, percent of list.

    ``relevant`` is a column name (tested ``== 1``) or a boolean Column; null
    counts as not relevant in the running count and the total (``na.rm``).
    With no relevant row the recall is null instead of 0/0.
    """
    cond = is_relevant(relevant) if isinstance(relevant, str) else F.coalesce(relevant, F.lit(False))
    ranked = rank_rows(df, score, ordinal, flags={"relevant": cond}, rows_per_bucket=rows_per_bucket)
    return (
        ranked.withColumnRenamed("cum_relevant", "cumulative_relevant")
        .withColumn("recall", F.try_divide(F.col("cumulative_relevant").cast("double"),
                                           F.col("total_relevant").cast("double")) * F.lit(100.0))
        .withColumn("perc_of_total", F.col("position").cast("double") / F.col("n_rows") * F.lit(100.0))
    )


def stopping_runs(df: DataFrame, flag: str, irrelevant_value: int = 0, score: str = "score",
                  ordinal: str = "ordinal", rows_per_bucket: int | None = None) -> DataFrame:
    """runs of consecutive irrelevant rows in the ranked list.

    Output ``run_id, run_length, start_row, end_row, pct_of_total`` sorted by
    length (desc) then ``run_id``. ``run_id`` counts the state changes before
    the run (first run 0), so irrelevant runs are numbered 0,2,4,... when row
    1 is irrelevant, else 1,3,5,... A row with a missing flag is not
    irrelevant: it ends a run and belongs to none.

    Sparse plan: a running count of the *break* rows (relevant or missing)
    keys each irrelevant row to its run, so runs come from one aggregation
    with partial aggregation (a run as long as a third of the list costs no
    more than any other); the runs are then numbered with a second
    partition-parallel rank over the (smaller) run table.
    """
    irr = F.coalesce(F.col(flag) == F.lit(irrelevant_value), F.lit(False))
    ranked = rank_rows(df.withColumn("__irr", irr), score, ordinal, flags={"brk": ~F.col("__irr")},
                       rows_per_bucket=rows_per_bucket)
    runs = (
        ranked.filter(F.col("__irr"))
        .groupBy("cum_brk")
        .agg(
            F.count(F.lit(1)).alias("run_length"),
            F.min("position").alias("start_row"),
            F.max("position").alias("end_row"),
            F.max("n_rows").alias("n_rows"),
        )
    )
    # The run table (one row per run) is read three times by the second rank;
    # checkpoint it so the first rank over the whole list runs once.
    runs = materialize(runs)
    numbered = rank_rows(runs.withColumn("__k", F.col("start_row").cast("double")), "__k", "start_row",
                         descending=False, position="__j", rows_per_bucket=rows_per_bucket, totals=False)
    # Row 1 is a break exactly when no irrelevant run starts at position 1.
    first = runs.agg(F.when(F.min("start_row") == 1, 0).otherwise(1).alias("__first_brk"))
    return (
        numbered.crossJoin(F.broadcast(first))
        .select(
            ((F.col("__j") - 1) * 2 + F.col("__first_brk")).cast("long").alias("run_id"),
            F.col("run_length").cast("long").alias("run_length"),
            F.col("start_row").cast("long").alias("start_row"),
            F.col("end_row").cast("long").alias("end_row"),
            (F.col("run_length").cast("double") / F.col("n_rows") * F.lit(100.0)).alias("pct_of_total"),
        )
        .orderBy(F.col("run_length").desc(), F.col("run_id"))
    )


def last_relevant_fraction(ranked: DataFrame, relevant: str | Column, position: str = "position") -> DataFrame:
    """position of the last relevant row and its share of the list.

    One row: ``last_position`` (null if none), ``n_rows``, ``fraction``.
    """
    cond = is_relevant(relevant) if isinstance(relevant, str) else F.coalesce(relevant, F.lit(False))
    return ranked.agg(
        F.max(F.when(cond, F.col(position))).cast("long").alias("last_position"),
        F.count(F.lit(1)).alias("n_rows"),
    ).withColumn("fraction", F.try_divide(F.col("last_position").cast("double"), F.col("n_rows").cast("double")))


def recall_threshold(curve: DataFrame, targets: list[float] = (95.0, 100.0)) -> DataFrame:
    """first position whose recall reaches each target (null if never).

    One conditional ``min`` per target in a single aggregate (partial
    aggregation, one pass), then one output row per target.
    """
    mins = curve.agg(*[
        F.min(F.when(F.col("recall") >= F.lit(float(t)), F.col("position"))).alias(f"__t{i}")
        for i, t in enumerate(targets)
    ])
    pairs = F.array(*[F.struct(F.lit(float(t)).alias("target"), F.col(f"__t{i}").cast("long").alias("position"))
                      for i, t in enumerate(targets)])
    return mins.select(F.inline(pairs))


def slice_max(df: DataFrame, by: str, n: int = 1, partition: list[str] | None = None) -> DataFrame:
    """F7 general form: rows with the ``n`` largest values of ``by``, ties kept.

    Same rows as ``rank() <= n``. With groups: a window per group (Spark
    inserts a per-partition WindowGroupLimit before the shuffle). Without
    groups no global window is used: the n-th largest value is found by a
    top-n (``orderBy().limit(n)``, n rows per task) and every row at or
    above it is kept by a broadcast 1-row comparison.
    """
    base = df.filter(F.col(by).isNotNull())
    if partition:
        w = Window.partitionBy(*partition).orderBy(F.col(by).desc())
        return base.withColumn("__rk", F.rank().over(w)).filter(F.col("__rk") <= n).drop("__rk")
    cut = base.select(F.col(by).alias("__v")).orderBy(F.col("__v").desc()).limit(n).agg(F.min("__v").alias("__cut"))
    return base.crossJoin(F.broadcast(cut)).filter(F.col(by) >= F.col("__cut")).drop("__cut")


def cut_count(n: Column, share: float) -> Column:
    """Number of rows in the first ``share`` of ``n`` rows, half to even."""
    return round_half_even(n.cast("double") * F.lit(float(share)), 0).cast("long")


def head_rows(ranked: DataFrame, n: int | Column, position: str = "position") -> DataFrame:
    """The first ``n`` positions."""
    return ranked.filter(F.col(position) <= (n if isinstance(n, Column) else F.lit(n)))


def tail_rows(ranked: DataFrame, n: int | Column, position: str = "position") -> DataFrame:
    """Positions from ``n + 1`` on."""
    return ranked.filter(F.col(position) > (n if isinstance(n, Column) else F.lit(n)))


def drop_top_share(ranked: DataFrame, share: float = 0.12, position: str = "position",
                   n_col: str = "n_rows") -> DataFrame:
    """G5 + B9: drop the first ``round(share * n)`` rows."""
    return ranked.filter(F.col(position) > cut_count(F.col(n_col), share))


def lag_first(c: str, order: list[Column], partition: list[str] | None = None) -> Column:
    """``lag(c)`` whose default is the first value of the group.

    Spark's ``lag`` default must be a constant, and ``coalesce(lag, c)``
    would also hide a null value in mid-list; only row 1 takes its own value.
    Meant for bounded groups (e.g. within one cell or one run table).
    """
    w = Window.partitionBy(*(partition or [])).orderBy(*order)
    return F.when(F.row_number().over(w) == 1, F.col(c)).otherwise(F.lag(c).over(w))
