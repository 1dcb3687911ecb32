"""Repeatable sampling, shuffling and first-per-key.

Random draws use :func:`hash_key` (md5 of id and seed): the same rows are
drawn whatever the partitioning, on recompute after a lost executor, and by
any SQL engine. R's own random stream cannot be reproduced and is not tried.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sievekit.functions.scalars import hash_key
from sievekit.plans.global_order import rank_rows
from sievekit.session import materialize

#: Bits of ``hash_key``, and of the ranges that a sample counts before it ranks.
HASH_BITS, HASH_RANGE_BITS = 52, 12
HASH_RANGES = 1 << HASH_RANGE_BITS

def _draw(df: DataFrame, key: str, ordinal: str | None) -> tuple[Column, str | None]:
    """What is hashed for a row: its id as text, or its ordinal where the id is missing."""
    if ordinal is None and "ordinal" in df.columns and key != "ordinal":
        ordinal = "ordinal"
    ident = F.col(key).cast("string")
    missing = F.concat(F.lit("row "), F.col(ordinal).cast("string")) if ordinal else F.lit("")
    return F.coalesce(ident, missing), ordinal


def _drawn_order(df: DataFrame, seed: int | str, key: str, ordinal: str | None, position: str) -> DataFrame:
    """Global draw order: hash, then ordinal (or id, or the hash's next digits) on ties."""
    ident, ordinal = _draw(df, key, ordinal)
    whole = dict(df.dtypes).get(ordinal or key, "") in ("bigint", "int", "smallint", "tinyint")
    tie = F.col(ordinal or key).cast("long") if whole else hash_key(ident, seed, 1)
    keyed = df.withColumn("__hd", hash_key(ident, seed).cast("double")).withColumn("__tie", tie)
    return rank_rows(keyed, "__hd", "__tie", descending=False, position=position, totals=False).drop("__hd", "__tie")


def sample_n(df: DataFrame, n: int, seed: int | str, key: str = "eppi_id", order_col: str = "sample_rank",
             strict: bool = False, ordinal: str | None = None) -> DataFrame:
    """Seeded sample of ``n`` rows without replacement.

    Adds ``sample_rank`` (1..n, the draw order). Counts per range of the hash
    (at most ``HASH_RANGES`` numbers) give a bound below which at least ``n``
    rows lie; only those, ``n`` and one range's rows at most, are kept and
    ranked, partition-parallel for every ``n``. The input is read twice. A row without an id is drawn by its ``ordinal`` (default: the
    column of that name). ``strict`` raises when the table has fewer than
    ``n`` rows (as R's ``sample_n``), at the cost of a count; otherwise all
    rows are returned.
    """
    if strict:
        have = df.count()
        if have < n:
            raise ValueError(f"cannot take a sample of {n} from {have} rows")
    ident, _ = _draw(df, key, ordinal)
    drawn = F.shiftright(hash_key(ident, seed), HASH_BITS - HASH_RANGE_BITS)
    low = df.filter(drawn <= _range_with(df.groupBy(drawn.alias("range")).count().collect(), n))
    return _drawn_order(materialize(low), seed, key, ordinal, order_col).filter(F.col(order_col) <= n)


def _range_with(counts: list, n: int) -> int:
    """The least hash range at or below which at least ``n`` rows lie (the last one, if there are fewer)."""
    have = 0
    for row in sorted(counts):
        have += row["count"]
        if have >= n:
            return row["range"]
    return 1 << HASH_RANGE_BITS


def shuffle_rows(df: DataFrame, seed: int | str, key: str = "eppi_id", position: str = "position",
                 ordinal: str | None = None) -> DataFrame:
    """G4 ``slice_sample(prop = 1)`` + ``row_number``: a full seeded permutation.

    All rows are kept (no row count is taken before rows are added). The new
    position is a partition-parallel global rank of the hash key.
    """
    return _drawn_order(df, seed, key, ordinal, position)


SLICES = 64


def sample_strata(df: DataFrame, strata: list[tuple[str, Column, int | None]], seed: int | str,
                  key: str = "eppi_id") -> DataFrame:
    """n_i rows from each stratum, stacked in stratum order, first per key.

    ``strata`` = [(name, condition, n), ...]; ``n = None`` takes the whole
    stratum. A row may meet several conditions and is then kept once, from
    the first stratum that drew it (``bind_rows`` + ``slice(1, .by = key)``).
    Adds ``stratum``, ``stratum_index`` and ``sample_rank`` (draw order
    within the stratum; null for whole strata).

    One pass: each row is expanded to the strata it meets, ranked by its
    hash within the stratum; ``row_number() <= n`` lets Spark cut every
    partition to n rows per stratum before the shuffle (WindowGroupLimit).
    Whole strata are not ranked, so an unbounded stratum never goes through
    one window task.
    """
    names = F.array(*[F.lit(s[0]) for s in strata])
    sizes = F.array(*[F.lit(int(s[2]) if s[2] is not None else -1) for s in strata])
    member = F.array_compact(F.array(*[F.when(F.coalesce(c, F.lit(False)), F.lit(i)) for i, (_, c, _) in enumerate(strata)]))
    exploded = df.withColumn("stratum_index", F.explode(member))
    size = F.element_at(sizes, F.col("stratum_index") + 1)
    whole = exploded.filter(size < 0).withColumn("sample_rank", F.lit(None).cast("int"))
    limited = exploded.filter(size >= 0)
    # Each stratum draws with its own seed "<seed>-<index>".
    stratum_seed = F.concat(F.lit(f"{seed}-"), F.col("stratum_index").cast("string"))
    ident, ordinal = _draw(df, key, None)
    tie = [c for c in (key, ordinal) if c]
    limited = limited.withColumn("__h", hash_key(ident, stratum_seed))
    # Two levels: a stratum is first cut to n rows per slice of the hash, so
    # the last window sees at most SLICES * n rows however many tasks there are.
    limited = limited.withColumn("__slice", F.pmod(F.col("__h"), F.lit(SLICES)))
    sliced = Window.partitionBy("stratum_index", "__slice").orderBy("__h", *tie)
    w = Window.partitionBy("stratum_index").orderBy("__h", *tie)
    # The literal bound lets Spark infer a per-partition WindowGroupLimit
    # (the per-stratum size alone is not foldable).
    n_max = max([int(s[2]) for s in strata if s[2] is not None] or [0])
    first = limited.withColumn("__r", F.row_number().over(sliced)).filter(
        (F.col("__r") <= F.lit(n_max)) & (F.col("__r") <= size))
    drawn = first.withColumn("sample_rank", F.row_number().over(w)).filter(
        (F.col("sample_rank") <= F.lit(n_max)) & (F.col("sample_rank") <= size)
    ).drop("__h", "__slice", "__r")
    drawn = drawn.unionByName(whole)
    drawn = drawn.withColumn("stratum", F.element_at(names, F.col("stratum_index") + 1))
    # A row without an id is no repeat of another such row.
    drawn = drawn.withColumn("__o", F.struct("stratum_index", "sample_rank")).withColumn(
        "__k", F.when(F.col(key).isNull(), F.col(ordinal) if ordinal else F.monotonically_increasing_id()))
    firsts = first_per_key(drawn, [key, "__k"], "__o")
    return firsts.drop("__o", "__k").withColumn("sample_rank", F.col("sample_rank").cast("long"))


def first_per_key(df: DataFrame, key: str | list[str], ordinal: str = "ordinal") -> DataFrame:
    """F2 ``slice(1, .by = key)``: the first row of each key in input order.

    ``min_by`` over a struct of all columns is an aggregate with map-side
    partial aggregation, so a key holding a third of the rows is reduced in
    every task before the shuffle (a ``row_number`` window would sort the
    whole hot group in one task). Null keys form one group, as in R.
    """
    keys = [key] if isinstance(key, str) else list(key)
    rest = [c for c in df.columns if c not in keys]
    packed = df.groupBy(*keys).agg(F.min_by(F.struct(*rest), F.col(ordinal)).alias("__first"))
    return packed.select(*keys, *[F.col(f"__first.{c}").alias(c) for c in rest]).select(*df.columns)
