"""Mixing sources to target weights by Poisson replication (operator 7).

Every source has a mean repetition rate: its target share of the corpus over
its actual share. A document is repeated as often as a Poisson variable with
that mean says; the variable is the inverse of the distribution function at a
number that a hash of the seed and the document's id gives, so a document's
count does not depend on partitions, order or other documents. The copies are
then put into one global order by a hash of seed, id and copy number.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sievekit.llm.common import share_cut, stash

SEED = 7
#: Target share of a source: its size to this power (1: as it is, 0: all alike).
TEMPERATURE = 0.5
#: The distribution function is tabulated up to mean + 12 standard deviations + 40.
TAIL_SD, TAIL = 12, 40


def source_rates(docs: DataFrame, source_col: str, size: Column, temperature: float = TEMPERATURE,
                 weights: dict[str, float] | None = None, repeat: float = 1.0) -> DataFrame:
    """``source, size, rate, cdf``: each source's mean repetition rate and its distribution function.

    ``size`` measures a document (1, or its words). Target shares come from
    ``weights`` (a source not named there has share 0) or are proportional
    to size to the power ``temperature``; the target total is ``repeat``
    times the corpus. ``cdf[k]`` is P(count <= k).
    """
    sizes = docs.groupBy(F.col(source_col).cast("string").alias("source")).agg(F.sum(size).cast("double").alias("size"))
    if weights is None:
        goal = F.when(F.col("size") > 0, F.pow("size", F.lit(float(temperature)))).otherwise(0.0)
    else:
        given = [x for k, w in sorted(weights.items()) for x in (F.lit(k), F.lit(float(w)))]
        goal = F.coalesce(F.create_map(*given)[F.col("source")], F.lit(0.0)) if given else F.lit(0.0)
    goals = sizes.withColumn("goal", goal)
    total = goals.agg(F.sum("size").alias("all_size"), F.sum("goal").alias("all_goal"))
    rated = goals.crossJoin(F.broadcast(total)).withColumn("rate", F.when(
        (F.col("size") > 0) & (F.col("all_goal") > 0),
        repeat * F.col("all_size") * F.col("goal") / F.col("all_goal") / F.col("size")).otherwise(0.0))
    top = F.ceil(F.col("rate") + TAIL_SD * F.sqrt("rate") + TAIL).cast("int")
    # log p(k) = log p(k - 1) + log(rate / k): no underflow at large rates.
    step = lambda acc, k: F.struct(
        (acc["lp"] + F.log(F.col("rate") / k)).alias("lp"),
        F.concat(acc["cdf"], F.array(F.element_at(acc["cdf"], -1) + F.exp(acc["lp"] + F.log(F.col("rate") / k)))).alias(
            "cdf"))
    first = F.struct((-F.col("rate")).alias("lp"), F.array(F.exp(-F.col("rate"))).alias("cdf"))
    table = F.aggregate(F.sequence(F.lit(1), top), first, step, lambda acc: acc["cdf"])
    return rated.select("source", "size", "rate", F.when(F.col("rate") > 0, table).otherwise(F.array(F.lit(1.0))).alias(
        "cdf"))


def replicate(docs: DataFrame, id_col: str = "doc_id", source_col: str = "source", size: Column | None = None,
              temperature: float = TEMPERATURE, weights: dict[str, float] | None = None, repeat: float = 1.0,
              seed: int = SEED, broadcast_rows: int = 20_000) -> DataFrame:
    """``docs`` repeated to target source weights and shuffled globally; adds ``rate, copies, copy, order_key``.

    A row appears ``copies`` times (``copy`` from 1), or not at all. The result is
    sorted by ``order_key``, a hash of seed, id and copy, over all
    partitions (ties by id and copy). A null source is a source of its own; a
    null id counts as the text ``null``; repeated rows get equal counts and
    each is replicated. An empty table gives an empty result; a column of
    ``docs`` named like an added one is replaced.
    """
    own = docs.drop(*[c for c in ("rate", "copies", "copy", "order_key") if c in docs.columns])
    rates = stash(source_rates(own, source_col, size if size is not None else F.lit(1), temperature, weights, repeat)
                  .select(F.col("source").alias("__source"), F.col("rate").alias("__rate"), F.col("cdf").alias("__cdf")), "rates")
    if rates.limit(broadcast_rows + 1).count() <= broadcast_rows:
        rates = F.broadcast(rates)
    key = F.coalesce(F.col(id_col).cast("string"), F.lit("null"))
    # The number is made below the join, so that the search in the table does not work out its hash per entry.
    drawn = own.withColumn("__u", share_cut(key, seed))
    met = drawn.join(rates, F.col(source_col).cast("string").eqNullSafe(F.col("__source")))
    counted = met.withColumn("copies", F.size(F.filter("__cdf", lambda c: c < F.col("__u"))))
    many = counted.filter("copies > 0").withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies"))))
    keyed = many.withColumn("order_key", share_cut(F.concat_ws(":", key, F.col("copy").cast("string")), seed + 1))
    return keyed.select(*own.columns, F.col("__rate").alias("rate"), "copies", "copy", "order_key").repartitionByRange(
        "order_key", id_col, "copy").sortWithinPartitions("order_key", id_col, "copy")


def poisson_inverse(u: float, rate: float) -> int:
    """The least k with P(count <= k) >= u (used by the tests)."""
    k, p = 0, math.exp(-rate)
    total = p
    while total < u:
        k += 1
        p *= rate / k
        total += p
    return k
