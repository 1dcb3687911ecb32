"""Membership joins, the train/unseen split and title links.

Id lists stay DataFrames (never collected). Matching is null-safe like R's
``%in%`` (a missing id matches a missing id in the list); Spark still plans
``<=>`` keys as an equi-join, so Catalyst/AQE choose broadcast or
sort-merge by size.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sievekit.functions.scalars import normalise_text


def _ids(ids: DataFrame, id_col: str) -> DataFrame:
    return ids.select(F.col(id_col).alias("__id")).distinct()


def semi_ids(df: DataFrame, ids: DataFrame, key: str = "eppi_id", id_col: str | None = None) -> DataFrame:
    """D1 ``filter(key %in% ids)``."""
    i = _ids(ids, id_col or key)
    return df.join(i, df[key].eqNullSafe(i["__id"]), "left_semi")


def anti_ids(df: DataFrame, ids: DataFrame, key: str = "eppi_id", id_col: str | None = None) -> DataFrame:
    """D2 ``filter(!key %in% ids)``: a missing key not in the list is kept.

    ``left_anti`` on ``<=>``; SQL ``NOT IN`` would drop such rows.
    """
    i = _ids(ids, id_col or key)
    return df.join(i, df[key].eqNullSafe(i["__id"]), "left_anti")


def flag_ids(df: DataFrame, ids: DataFrame, flag: str, key: str = "eppi_id", id_col: str | None = None,
             yes=1, no=0) -> DataFrame:
    """D3 ``if_else(key %in% ids, yes, no)``; never null (``%in%`` is never NA)."""
    i = _ids(ids, id_col or key).withColumn("__hit", F.lit(True))
    j = df.join(i, df[key].eqNullSafe(i["__id"]), "left")
    return j.withColumn(flag, F.when(F.col("__hit").isNotNull(), F.lit(yes)).otherwise(F.lit(no))).drop("__id", "__hit")


def flag_by_member(unique: DataFrame, clusters: DataFrame, ids: DataFrame, flag: str, key: str = "eppi_id",
                   id_col: str | None = None) -> DataFrame:
    """D3 over merged records: whether any member of a record's cluster has an id of the list.

    ``clusters`` has ``key`` and ``cluster_id`` for every row before the
    merge (:func:`~sievekit.operators.dedup.dedup`), so an id that a merge swallowed is still found. A
    missing id matches none here: it names no member.
    """
    listed = _ids(ids, id_col or key).filter("__id IS NOT NULL")
    hit = clusters.select("cluster_id", F.col(key).alias("__id")).join(listed, "__id", "left_semi").select(
        F.col("cluster_id").alias("__cluster")).distinct().withColumn(flag, F.lit(True))
    j = unique.drop(flag).join(hit, F.col("cluster_id") == F.col("__cluster"), "left")
    return j.drop("__cluster").withColumn(flag, F.coalesce(flag, F.lit(False)))


def split_train_unseen(df: DataFrame, train_ids: DataFrame, key: str = "eppi_id",
                       holdout_ids: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """Training rows and the unseen pool to rank.

    Training rows are ``train_ids`` found in ``df`` minus held-out (test) ids;
    the unseen pool is every other row, held-out ids added back. The two are
    disjoint and their union is ``df``.
    """
    pool = anti_ids(df, holdout_ids, key) if holdout_ids is not None else df
    train = semi_ids(pool, train_ids, key)
    unseen = anti_ids(df, train.select(key), key)
    return train, unseen


def title_link(left: DataFrame, right: DataFrame, left_title: str = "title", right_title: str = "title",
               right_cols: list[str] | None = None) -> DataFrame:
    """Attach ``right`` rows whose normalised title equals the left title.

    An equi-join on the normalised key (lower case, letters and digits only);
    empty keys never link.
    """
    lk = normalise_text(left_title)
    rk = normalise_text(F.col(right_title))
    r = right.select(rk.alias("__k"), *(right_cols or [c for c in right.columns if c != right_title]))
    r = r.filter(F.col("__k").isNotNull())
    return left.withColumn("__k", lk).join(r, "__k", "inner").drop("__k")
