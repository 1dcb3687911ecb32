"""Global order without a single partition.

``Window.orderBy`` with no ``partitionBy`` moves every row into one task.
Row numbers and running sums over a whole ranked list are computed here in
three steps instead:

1. One distributed aggregate returns the row count and approximate quantile
   cuts of the score and of the tie-break ordinal (``percentile_approx``,
   partial aggregation, a few thousand numbers reach the driver).
2. Every row gets a *cell* ``(ob, sb)`` that depends only on its own values
   (so a recomputed task lands in the same cell): ``ob`` is the score bucket in
   list order, found by binary search (``Bucketizer``) over split points where
   every cut value has a bucket of its own; a value that holds many rows
   becomes a cut, so its bucket is a *singleton* (one score value) and is
   split again by the ordinal cuts into ``sb``. Null and NaN scores form
   singleton buckets too. Other buckets use ``sb = 0``. Cells are contiguous
   in list order and hold about ``n / k`` rows each, whatever the skew.
3. Per-cell counts and flag sums (a tiny table, one row per occupied cell)
   give exclusive prefix offsets; it is broadcast back (its size is bounded by
   the number of cells) and the window runs inside ``partitionBy(ob, sb)``.

Approximate cuts only change cell sizes, never the result.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# The most buckets a list is cut into: 16384 cells of 10^6 rows cover
# 1.6 * 10^10 rows per list (longer lists get proportionally larger cells).
MAX_BUCKETS = 16384
ROWS_PER_BUCKET = 1_000_000
# Smallest cell when the size is chosen from the list length: a list is cut
# into about 4 cells per core (so mid-size lists use every core), cells
# between MIN_ROWS_PER_BUCKET and ROWS_PER_BUCKET rows.
MIN_ROWS_PER_BUCKET = 50_000
# Probes taken with the row count in the first pass.
FIRST_PROBES = 64
# Largest cell table we broadcast (rows); above it Spark picks the join.
BROADCAST_CELL_LIMIT = 2_000_000

_OB = "__ob"
_SB = "__sb"


@dataclass
class OrderStats:
    n: int
    score_cuts: list[float]
    ordinal_cuts: list[float]


def _cuts(vals: list, k: int) -> list[float]:
    """Probe quantiles ``i/k`` -> distinct sorted cuts.

    A value holding more than 1/k of the rows fills several probes, so it
    always becomes a cut and gets a singleton bucket.
    """
    if k <= 1:
        return []
    return sorted({float(c) for c in vals if c is not None and not math.isnan(float(c))})


def _probe_aggs(score: str, ordinal: str, k: int) -> list:
    probes = [i / k for i in range(1, k)]
    acc = max(10_000, 4 * k)
    return [F.percentile_approx(F.col(score).cast("double"), probes, acc).alias("sc"),
            F.percentile_approx(F.col(ordinal).cast("double"), probes, acc).alias("oc")]


def adaptive_rows_per_bucket(df: DataFrame, n: int) -> int:
    """About four cells per core, within [MIN_ROWS_PER_BUCKET, ROWS_PER_BUCKET]."""
    try:
        cores = df.sparkSession.sparkContext.defaultParallelism
    except Exception:  # noqa: BLE001 - no context (remote session)
        cores = 8
    return min(ROWS_PER_BUCKET, max(MIN_ROWS_PER_BUCKET, math.ceil(n / (4 * max(1, cores)))))


def order_stats(df: DataFrame, score: str, ordinal: str, rows_per_bucket: int | None = None,
                max_buckets: int = MAX_BUCKETS) -> OrderStats:
    """Row count and quantile cuts.

    One aggregate gives the count and ``FIRST_PROBES`` probe quantiles, which
    serve every list up to ``FIRST_PROBES * rows_per_bucket`` rows; longer
    lists take a second aggregate with ``k - 1`` probes (k buckets).
    """
    row = df.agg(F.count(F.lit(1)).alias("n"), *_probe_aggs(score, ordinal, FIRST_PROBES)).first()
    n = int(row["n"])
    if rows_per_bucket is None:
        rows_per_bucket = adaptive_rows_per_bucket(df, n)
    k = max(1, min(max_buckets, math.ceil(n / max(1, rows_per_bucket))))
    if k <= 1:
        return OrderStats(n=n, score_cuts=[], ordinal_cuts=[])
    if k <= FIRST_PROBES:
        # every (FIRST_PROBES / k)-th probe: quantiles close to i/k
        step = FIRST_PROBES / k
        pick = [int(round(step * i)) - 1 for i in range(1, k)]
        sc = [(row["sc"] or [None] * FIRST_PROBES)[j] for j in pick]
        oc = [(row["oc"] or [None] * FIRST_PROBES)[j] for j in pick]
        return OrderStats(n=n, score_cuts=_cuts(sc, k), ordinal_cuts=_cuts(oc, k))
    row = df.agg(*_probe_aggs(score, ordinal, k)).first()
    return OrderStats(n=n, score_cuts=_cuts(row["sc"] or [], k), ordinal_cuts=_cuts(row["oc"] or [], k))


def _splits(cuts: list[float]) -> tuple[list[float], set[int]]:
    """Split points where each cut value gets its own bucket [c, nextup(c))."""
    pts = [-math.inf]
    singles: set[int] = set()
    for c in cuts:
        if c > pts[-1]:
            pts.append(c)
        up = math.nextafter(c, math.inf)
        if up > pts[-1] and up != math.inf:
            singles.add(len(pts) - 1)
            pts.append(up)
    pts.append(math.inf)
    return pts, singles


def assign_cells(df: DataFrame, score: str, ordinal: str, stats: OrderStats,
                 descending: bool = True, nulls_last: bool = True) -> DataFrame:
    """Add the cell columns ``__ob`` (bucket in list order) and ``__sb``."""
    splits, singles = _splits(stats.score_cuts)
    nb = len(splits) - 1
    tmp_s, tmp_b = "__s_in", "__s_b"
    nan_b = nb  # Bucketizer's "keep" bucket for NaN
    if nb >= 2:
        bucketed = Bucketizer(splits=splits, inputCol=tmp_s, outputCol=tmp_b, handleInvalid="keep").transform(
            df.withColumn(tmp_s, F.coalesce(F.col(score).cast("double"), F.lit(0.0)))
        )
    else:  # no cuts: one bucket (plus NaN and null)
        bucketed = df.withColumn(tmp_s, F.lit(0.0)).withColumn(
            tmp_b, F.when(F.isnan(F.col(score).cast("double")), F.lit(nan_b)).otherwise(F.lit(0)))
    bi = F.col(tmp_b).cast("int")
    if descending:
        ob = F.when(bi == nan_b, F.lit(-1)).otherwise(F.lit(nb - 1) - bi)
        single_ob = [nb - 1 - i for i in singles] + [-1]
    else:
        ob = bi
        single_ob = sorted(singles) + [nan_b]
    null_ob = nb + 1 if nulls_last else -2
    ob = F.when(F.col(score).isNull(), F.lit(null_ob)).otherwise(ob)
    single_ob.append(null_ob)

    # Cell columns are made non-nullable so the join on them infers no
    # IsNotNull filter (which would run the bucket search twice per row).
    out = bucketed.withColumn(_OB, F.coalesce(ob, F.lit(-9))).drop(tmp_s, tmp_b)
    # Null/NaN buckets are singletons even when there are no score cuts (an
    # all-null list), so sub-splitting depends on the ordinal cuts only.
    if stats.ordinal_cuts:
        osplits = [-math.inf] + sorted(set(stats.ordinal_cuts)) + [math.inf]
        out = Bucketizer(splits=osplits, inputCol="__o_in", outputCol="__o_b", handleInvalid="keep").transform(
            out.withColumn("__o_in", F.col(ordinal).cast("double"))
        )
        sb = F.when(F.col(_OB).isin(single_ob), F.col("__o_b").cast("int")).otherwise(F.lit(0))
        out = out.withColumn(_SB, F.coalesce(sb, F.lit(0))).drop("__o_in", "__o_b")
    else:
        out = out.withColumn(_SB, F.lit(0))
    return out


def _flag_int(c: Column) -> Column:
    return F.coalesce(c.cast("boolean"), F.lit(False)).cast("long")


def rank_rows(df: DataFrame, score: str, ordinal: str, flags: dict[str, Column] | None = None,
              descending: bool = True, nulls_last: bool = True, position: str = "position",
              rows_per_bucket: int | None = None, max_buckets: int = MAX_BUCKETS,
              totals: bool = True, stats: OrderStats | None = None) -> DataFrame:
    """Global ``row_number`` and ROWS-frame running sums, partition-parallel.

    Order is ``score`` (desc/asc, nulls and NaN last/first) then ``ordinal`` ascending;
    ``ordinal`` must be unique so the order is total. For each entry of
    ``flags`` (name -> boolean Column; null counts as false) the output gets
    ``cum_<name>`` (running count up to and including the row) and, with
    ``totals``, ``total_<name>``; ``n_rows`` is the list length.
    """
    flags = flags or {}
    # Re-ranking a ranked list replaces the earlier rank's columns.
    df = df.drop(position, *(["n_rows"] if totals else []), *[f"cum_{k}" for k in flags],
                 *([f"total_{k}" for k in flags] if totals else []))
    # R's order(): NaN is missing, so it stands with the nulls, by ordinal.
    kept = None
    if dict(df.dtypes).get(score) in ("double", "float"):
        kept, df = score, df.withColumn("__key", F.when(~F.isnan(score), F.col(score)))
        score = "__key"
    stats = stats or order_stats(df, score, ordinal, rows_per_bucket, max_buckets)
    fl = {f"__f_{k}": _flag_int(v) for k, v in flags.items()}
    cells_in = assign_cells(df, score, ordinal, stats, descending, nulls_last)
    if fl:
        cells_in = cells_in.withColumns(fl)

    # Per-cell sizes and flag sums -> exclusive prefix offsets (tiny table).
    cells = cells_in.groupBy(_OB, _SB).agg(
        F.count(F.lit(1)).alias("__cnt"), *[F.sum(c).alias(f"__s{c}") for c in fl]
    )
    before = Window.orderBy(_OB, _SB).rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy(F.lit(0))
    off_cols = [F.coalesce(F.sum("__cnt").over(before), F.lit(0)).alias("__off")]
    off_cols += [F.coalesce(F.sum(f"__s{c}").over(before), F.lit(0)).alias(f"__o{c}") for c in fl]
    if totals:
        off_cols.append(F.sum("__cnt").over(whole).alias("n_rows"))
        off_cols += [F.sum(f"__s{c}").over(whole).alias(f"total_{c[4:]}") for c in fl]
    offsets = cells.select(_OB, _SB, *off_cols)

    # The cell table has at most one row per (score split, ordinal split)
    # pair and never more rows than the list: broadcast only under the bound.
    n_splits = 2 * len(stats.score_cuts) + 4
    bound = min(stats.n, n_splits * (len(stats.ordinal_cuts) + 2))
    if bound <= BROADCAST_CELL_LIMIT:
        offsets = F.broadcast(offsets)
    joined = cells_in.join(offsets, [_OB, _SB], "inner")

    sc = F.col(score)
    if descending:
        sort_score = sc.desc_nulls_last() if nulls_last else sc.desc_nulls_first()
    else:
        sort_score = sc.asc_nulls_last() if nulls_last else sc.asc_nulls_first()
    w = Window.partitionBy(_OB, _SB).orderBy(sort_score, F.col(ordinal).asc())
    run = w.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    out = joined.withColumn(position, (F.col("__off") + F.row_number().over(w)).cast("long"))
    for c in fl:
        out = out.withColumn(f"cum_{c[4:]}", (F.col(f"__o{c}") + F.sum(c).over(run)).cast("long"))
    drop = [_OB, _SB, "__off"] + (["__key"] if kept else []) + list(fl) + [f"__o{c}" for c in fl]
    out = out.drop(*drop)
    if totals:
        out = out.withColumn("n_rows", F.col("n_rows").cast("long"))
        for c in fl:
            out = out.withColumn(f"total_{c[4:]}", F.col(f"total_{c[4:]}").cast("long"))
    return out


def lag_rows(df: DataFrame, columns: dict[str, str], score: str, ordinal: str, descending: bool = True,
             nulls_last: bool = True, rows_per_bucket: int | None = None, max_buckets: int = MAX_BUCKETS) -> DataFrame:
    """F3 over a whole ranked list: each row gets the values of the row before it, partition-parallel.

    ``columns`` maps output names to columns. The first row of the list takes
    its own values; a null value of the row before stays null. Inside a cell
    (see the module's head) it is a plain ``lag``; the first row of a cell takes
    the last row of the cell before, which a table of one row per cell carries
    over. Order as in :func:`rank_rows`.
    """
    df = df.drop(*columns)
    given = df.columns
    nan = dict(df.dtypes).get(score) in ("double", "float")
    keyed = df.withColumn("__key", F.when(~F.isnan(score), F.col(score)) if nan else F.col(score))
    stats = order_stats(keyed, "__key", ordinal, rows_per_bucket, max_buckets)
    cells_in = assign_cells(keyed, "__key", ordinal, stats, descending, nulls_last).withColumn(
        "__row", F.struct(*[F.col(c).alias(f"c{i}") for i, c in enumerate(columns.values())]))
    # A cell holds either null keys only or none, so the sign alone orders it.
    place = F.struct(F.coalesce(-F.col("__key") if descending else F.col("__key"), F.lit(0)), F.col(ordinal))
    cells = cells_in.groupBy(_OB, _SB).agg(F.max_by("__row", place).alias("__last"))
    cells = cells.withColumn("__carry", F.lag("__last").over(Window.orderBy(_OB, _SB))).drop("__last")
    if min(stats.n, (2 * len(stats.score_cuts) + 4) * (len(stats.ordinal_cuts) + 2)) <= BROADCAST_CELL_LIMIT:
        cells = F.broadcast(cells)
    key = F.col("__key")
    w = Window.partitionBy(_OB, _SB).orderBy(key.desc() if descending else key.asc(), F.col(ordinal).asc())
    # lag of a struct is null on a cell's first row alone: rows are never null themselves.
    before = F.coalesce(F.lag("__row").over(w), F.col("__carry"), F.col("__row"))
    out = cells_in.join(cells, [_OB, _SB]).withColumn("__before", before)
    return out.select(*given, *[F.col(f"__before.c{i}").alias(name) for i, name in enumerate(columns)])
