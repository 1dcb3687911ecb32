"""Priority screening (I4): sample -> split -> features -> CV lasso -> score -> rank.

The composition of the screening scripts, with every step a Spark job:
the training sample is drawn by hash (G6), the unseen pool is every other
row with held-out test ids added back (D6), the model is fitted on the
(small) training set and scores the (large) pool in parallel, the scored
pool is checkpointed to the shared folder (the rank reads it three times)
and ranked by the partition-parallel global order (G1, F1).
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sievekit.operators import model as M
from sievekit.operators.joins import anti_ids, flag_ids, split_train_unseen
from sievekit.operators.sampling import sample_strata
from sievekit.plans.global_order import rank_rows
from sievekit.session import materialize

#: Training rows of a partition at most, and those that are worth a partition of their own while cores are free.
TRAIN_ROWS_PER_PARTITION, FEW_ROWS = 100_000, 2_000


def spark_parallelism(df: DataFrame) -> int:
    return df.sparkSession.sparkContext.defaultParallelism


def deal_training(train: DataFrame) -> DataFrame:
    """The checkpointed training set in as few partitions as its size needs: every pass of the path sends one sum for each."""
    n_train = train.count()
    parts = max(math.ceil(n_train / TRAIN_ROWS_PER_PARTITION), min(spark_parallelism(train), math.ceil(n_train / FEW_ROWS)))
    return materialize(train.repartition(max(1, parts)))


def screening_split(data: DataFrame, strata: list[tuple[str, Column, int | None]], seed: int | str,
                    key: str = "eppi_id", holdout_ids: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """``(train, unseen)``: the stratified training sample and every other row, held-out ids included; no model."""
    if holdout_ids is not None:
        holdout_ids = materialize(holdout_ids.select(key))
    pool = data if holdout_ids is None else data.join(holdout_ids, key, "left_anti")
    train_ids = materialize(sample_strata(pool, strata, seed, key).select(key))
    return split_train_unseen(data, train_ids, key, holdout_ids)


def priority_screening(data: DataFrame, strata: list[tuple[str, Column, int | None]], seed: int | str,
                       key: str = "eppi_id", ordinal: str = "ordinal", label: str = "decision_binary",
                       vec: str = "embedding", holdout_ids: DataFrame | None = None,
                       final_ids: DataFrame | None = None, n_lambda: int = 100, folds: int = 10,
                       checkpoint: bool = True) -> tuple[DataFrame, dict]:
    """Return (ranked unseen list, fit info).

    The list has ``position``, ``priority_score`` and, with ``final_ids``,
    ``review_included`` (D3). Info: ``lambda_max``, ``lambda``, ``n_train``.
    """
    train, unseen = screening_split(data, strata, seed, key, holdout_ids)
    train = M.embedding_features(train, vec)
    if checkpoint:
        # The optimiser runs one job per iteration for every fold and penalty:
        # read a checkpointed training set in as few partitions as its size
        # needs, not the sampling lineage in many small tasks.
        train = materialize(train)
        # unseen = every row not trained on (held-out ids included), taken
        # against the checkpoint so the sampling is not recomputed.
        unseen = anti_ids(data, train.select(key), key)
        train = deal_training(train)
    lam_max = M.lambda_max(train, vec, label)
    model, lam = M.fit_priority(train, label=label, key=key, lam_max=lam_max * 1.0001 if lam_max > 0 else 1.0,
                                n_lambda=n_lambda, folds=folds)
    scored = M.score(model, M.embedding_features(unseen, vec)).drop("features", vec)
    if checkpoint:
        scored = materialize(scored)
    ranked = rank_rows(scored, "priority_score", ordinal)
    if final_ids is not None:
        ranked = flag_ids(ranked, final_ids, "review_included", key)
    return ranked, {"lambda_max": lam_max, "lambda": lam}
