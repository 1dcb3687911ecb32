"""Text features and the ranking model.

* I1 features: a stored embedding column (``array<float>`` ->
  ``array_to_vector``), hashed term frequencies with IDF (JVM transformers),
  or a caller's encoder as an iterator ``pandas_udf`` (model loaded once per
  worker, texts sent in Arrow batches).
* I2 lasso logistic regression with cross-validation: a log-spaced grid that
  starts at the smallest penalty giving no coefficient (lambda_max, one
  aggregate over the training rows), all folds (by hash) and neighbouring
  penalties fitted together by passes over the rows until each fit meets its
  optimality conditions, best = least log loss (``lambda.min``), then Spark ML ``LogisticRegression(elasticNetParam=1)`` on all rows.
* I3 score: P(y = 1) from ``model.transform``; rows keep their key, so no
  positional alignment is needed.
"""

from __future__ import annotations

import math
import warnings
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa

from pyspark import TaskContext
from pyspark.ml.classification import LogisticRegression, LogisticRegressionModel
from pyspark.ml.feature import IDF, HashingTF, RegexTokenizer
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sievekit.functions.scalars import hash_key
from sievekit.session import materialize


def embedding_features(df: DataFrame, col: str = "embedding", out: str = "features") -> DataFrame:
    """I1 (a): stored vectors -> ML vector column."""
    return df.withColumn(out, array_to_vector(F.col(col).cast("array<double>")))


def hashed_text_features(train: DataFrame, text: str, num_features: int = 1 << 18, out: str = "features"):
    """I1 (b): tokens -> hashed term counts -> IDF fitted on ``train``.

    Returns a function that adds ``out`` to any DataFrame with ``text``.
    """
    tok = RegexTokenizer(inputCol=text, outputCol="__tok", pattern=r"[^\p{L}\p{N}]+", gaps=True)
    tf = HashingTF(inputCol="__tok", outputCol="__tf", numFeatures=num_features)
    idf = IDF(inputCol="__tf", outputCol=out).fit(tf.transform(tok.transform(train)))

    def apply(df: DataFrame) -> DataFrame:
        return idf.transform(tf.transform(tok.transform(df))).drop("__tok", "__tf")

    return apply


def record_vectors(df: DataFrame, texts: list[str], vec: str = "embedding", dim: int = 64,
                   out: str = "record_vector") -> DataFrame:
    """I1 (a) + (b) for every record: the stored vector, a flag for a missing one, and hashed word counts.

    A record without a stored vector has zeros in its place, so it is ranked
    by its texts (all of ``texts``, null as empty) instead of being left out.
    """
    width = df.agg(F.max(F.size(vec))).first()[0] or 0
    words = F.concat_ws(" ", *[F.coalesce(F.col(t), F.lit("")) for t in texts])
    tok = RegexTokenizer(inputCol="__text", outputCol="__tok", pattern=r"[^\p{L}\p{N}]+", gaps=True)
    tf = HashingTF(inputCol="__tok", outputCol="__tf", numFeatures=dim)
    counted = tf.transform(tok.transform(df.withColumn("__text", words)))
    stored = F.coalesce(F.col(vec).cast("array<double>"), F.array_repeat(F.lit(0.0), int(width)))
    missing = F.array(F.when(F.col(vec).isNull(), 1.0).otherwise(0.0))
    counts = F.transform(vector_to_array("__tf"), lambda x: F.log1p(x))
    return counted.withColumn(out, F.concat(stored, missing, counts)).drop("__text", "__tok", "__tf")


def encoder_features(make_encoder: Callable[[], Callable], dim: int) -> Callable[[Column], Column]:
    """I1 (c): a caller's sentence encoder as an iterator ``pandas_udf``.

    ``make_encoder()`` runs once per Python worker and returns
    ``encode(list[str]) -> array (n, dim)``; batches arrive through Arrow.
    """
    @F.pandas_udf("array<float>")
    def encode(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        enc = make_encoder()
        for s in batches:
            vecs = enc(s.fillna("").tolist())
            if len(vecs) and len(vecs[0]) != dim:
                raise ValueError(f"encoder returned width {len(vecs[0])}, expected {dim}")
            yield pd.Series([list(map(float, v)) for v in vecs])

    return encode


def lambda_max(train: DataFrame, vec: str, label: str) -> float:
    """Smallest lasso penalty with all coefficients zero (standardised x).

    max_j |cov_pop(x_j, y)| / sd_pop(x_j) over the training rows, one
    aggregation (Friedman, Hastie & Tibshirani 2010).
    """
    row = lambda_max_df(train, vec, label).first()
    return float(row["lambda_max"] or 0.0)


def lambda_max_df(train: DataFrame, vec: str, label: str) -> DataFrame:
    x = train.select(F.posexplode(F.col(vec).cast("array<double>")).alias("j", "x"), F.col(label).cast("double").alias("y"))
    per = x.groupBy("j").agg(F.covar_pop("x", "y").alias("c"), F.stddev_pop("x").alias("s"))
    return per.agg(F.max(F.try_divide(F.abs("c"), F.col("s"))).alias("lambda_max"))


def fold_column(key: str | Column, folds: int, seed: int = 7) -> Column:
    k = F.col(key) if isinstance(key, str) else key
    return F.pmod(hash_key(k, str(seed)), F.lit(folds)).cast("int")


#: Penalties that are fitted side by side, the ratio (as a logarithm) over which they share second derivatives, and
#: partial sums that are added up in one task.
GROUP, ALIKE, FAN_IN = 20, 0.2, 16
#: Optimality: the largest violation of the lasso conditions, as a share of the penalty.
TOLERANCE = 1e-3


class NotOptimal(RuntimeError):
    """A fit cannot be brought within the tolerance of its optimality conditions."""


def _sums(data: DataFrame, work: Callable[[np.ndarray, np.ndarray, np.ndarray], np.ndarray]) -> np.ndarray:
    """Sum over all rows of ``work(rows with a leading 1, labels, folds)``, added up on the executors."""
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: np.ndarray | None = None
        for b in batches:
            y = b.column(1).to_numpy()
            x = np.column_stack([np.ones(len(y)), b.column(0).flatten().to_numpy().reshape(len(y), -1)])
            part = work(x, y, b.column(2).to_numpy())
            total = part if total is None else total + part
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array([TaskContext.get().partitionId()]), pa.array([total.tobytes()], pa.binary())],
                                             ["part", "total"])

    def added(t: pa.Table) -> pa.Table:
        total = sum(np.frombuffer(x.as_py()) for x in t["total"])
        return pa.table({"part": t["part"].slice(0, 1), "total": pa.array([total.tobytes()], pa.binary())})

    kind, n = "part long, total binary", data.rdd.getNumPartitions()
    sums = data.mapInArrow(rows, kind)
    while n > 1:  # the driver gets one sum, whatever the number of partitions
        n = -(-n // FAN_IN)
        sums = sums.groupBy(F.pmod("part", F.lit(n)).alias("to")).applyInArrow(added, kind)
    return sum((np.frombuffer(r["total"]) for r in sums.collect()), np.zeros(1))


def _violation(grad: np.ndarray, w: np.ndarray, lam: np.ndarray) -> np.ndarray:
    """How far ``w`` (..., penalty, coefficient; intercept first) is from the conditions of a lasso optimum."""
    cut = np.broadcast_to(lam[:, None], w.shape).copy()
    cut[..., 0] = 0
    off = np.where(w != 0, np.abs(grad + cut * np.sign(w)), np.maximum(np.abs(grad) - cut, 0))
    return off.max(-1) / lam


def _lasso_move(hess: np.ndarray, grad: np.ndarray, w: np.ndarray, lam: np.ndarray, shared: int, sweeps: int = 4,
                solves: int = 3) -> np.ndarray:
    """Minimiser of the second-order model plus penalty for every (fold, penalty).

    Sweeps over the coordinates find which coefficients are used; those are
    solved for together, a coefficient that would change its sign becoming
    zero, and the better of the two is kept. ``hess`` is (fold, run of ``shared`` penalties, coefficient, coefficient).
    """
    folds, runs, d = hess.shape[:3]
    more = -len(lam) % shared
    pad, shape = ((0, 0), (0, more), (0, 0)), (folds, runs, shared, d)
    cut = np.broadcast_to(np.pad(lam, (0, more), mode="edge").reshape(runs, shared), shape[:3])
    start = np.pad(w, pad, mode="edge").reshape(shape)
    first = np.pad(grad, pad, mode="edge").reshape(shape)
    at = start.copy()
    eye, free = np.eye(d), np.append(0.0, np.ones(d - 1))

    def value(point: np.ndarray) -> np.ndarray:
        go = point - start
        return ((first + go @ hess / 2) * go).sum(-1) + cut * np.abs(point[..., 1:]).sum(-1)

    for _ in range(solves):
        g = first + (at - start) @ hess
        for _ in range(sweeps):
            for j in range(d):
                line = hess[:, :, j]
                h = line[:, :, j, None]
                z = at[..., j] - g[..., j] / h
                new = z if j == 0 else np.sign(z) * np.maximum(np.abs(z) - cut / h, 0)
                step = new - at[..., j]
                if step.any():
                    at[..., j] = new
                    g += step[..., None] * line[:, :, None]
        on = (at != 0) | (free == 0)  # the intercept has no penalty
        sign = np.sign(at) * free
        both = on[..., :, None] & on[..., None, :]
        right = np.where(on, -(g + cut[..., None] * sign), 0)
        to = at + np.linalg.solve(np.where(both, hess[:, :, None], eye), right[..., None])[..., 0]
        to = np.where(on & (to * sign >= 0), to, 0)
        at = np.where((value(to) < value(at))[..., None], to, at)
    return at.reshape(folds, -1, d)[:, :len(lam)]


def path_losses(data: DataFrame, width: int, lams: list[float], folds: int,
                tol: float = TOLERANCE) -> tuple[np.ndarray, np.ndarray]:
    """Held-out log loss (fold, penalty) of the lasso path of every fold, and each fit's violation of optimality.

    ``data`` has ``x`` (array), ``label`` and ``fold``; penalties fall. All
    folds and ``GROUP`` neighbouring penalties go on together from the fits
    before them. A round is one pass over the rows: losses and gradients of
    every fit and the second derivatives of one in a few alike. A step that
    does not lower its objective is halved, and a group ends when every fit
    meets the conditions of an optimum within ``tol``; there is no bound on
    the rounds, a fit that cannot be moved any more raises
    :class:`NotOptimal`. Columns are scaled per training part; a fold
    without rows, or that leaves none, has NaN.
    """
    all_lams, d = np.asarray(lams), width + 1

    def moments(x: np.ndarray, y: np.ndarray, fold: np.ndarray) -> np.ndarray:
        return np.stack([x[fold == f].T @ x[fold == f] for f in range(folds)])

    total = _sums(data, moments)
    own = np.zeros((folds, d, d)) + (total.reshape(folds, d, d) if total.size > 1 else 0)
    rest = own.sum(0) - own
    n, held = rest[:, 0, 0], own[:, 0, 0]
    used = (n > 0) & (held > 0)
    rows = np.maximum(n, 1)
    mean = rest[:, 0] / rows[:, None]
    var = np.maximum(np.diagonal(rest, axis1=1, axis2=2) / rows[:, None] - mean ** 2, 0)
    sd = np.sqrt(var * (rows / np.maximum(rows - 1, 1))[:, None])
    scale = np.where(sd > 1e-9 * (1 + np.abs(mean)), 1 / np.maximum(sd, 1e-300), 0.0)
    mean[:, 0], scale[:, 0] = 0.0, 1.0
    # rows are centred and scaled: z = x @ turn
    turn = np.zeros((folds, d, d))
    for f in range(folds):
        turn[f] = np.diag(scale[f])
        turn[f, 0] -= mean[f] * scale[f]
    between = -np.diff(np.log(all_lams)) if len(all_lams) > 1 else np.ones(1)
    shared = int(np.clip(ALIKE / max(between.max(), 1e-9), 1, GROUP))
    fits = np.zeros((folds, len(all_lams), d))
    gaps = np.full((folds, len(all_lams)), np.nan)
    half = np.triu_indices(d)  # second derivatives are symmetric

    def derivatives(to: np.ndarray, active: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Loss, gradient and (of one fit in ``shared``) second derivatives of every active fold at ``to``."""
        k = to.shape[1]
        of = np.minimum(np.arange(0, k, shared) + shared // 2, k - 1)
        raw = turn[active] @ to.transpose(0, 2, 1)

        def work(x: np.ndarray, y: np.ndarray, fold: np.ndarray) -> np.ndarray:
            out = np.zeros((len(active), k + k * d + len(of) * len(half[0])))
            for i, f in enumerate(active):
                kept = fold != f
                xs, ys = x[kept], y[kept]
                m = xs @ raw[i]
                p = 1 / (1 + np.exp(-np.clip(m, -500, 500)))
                curve = np.maximum(p[:, of] * (1 - p[:, of]), 1e-9)
                out[i] = np.concatenate([(np.logaddexp(0, m) - ys[:, None] * m).sum(0), ((p - ys[:, None]).T @ xs).ravel(),
                                         *[((xs * c[:, None]).T @ xs)[half] for c in curve.T]])
            return out

        got = _sums(data, work).reshape(len(active), -1) / rows[active, None]
        grad = got[:, k:k + k * d].reshape(-1, k, d) @ turn[active]
        sides = turn[active][:, None]
        full = np.zeros((len(active), len(of), d, d))
        full[..., half[0], half[1]] = full[..., half[1], half[0]] = got[:, k + k * d:].reshape(len(active), len(of), -1)
        hess = sides.transpose(0, 1, 3, 2) @ full @ sides
        return got[:, :k], grad, hess + 1e-8 * np.eye(d)

    for a in range(0, len(all_lams), GROUP):
        lam = all_lams[a:a + GROUP]
        active = np.flatnonzero(used)
        w = np.repeat(fits[:, max(a - 1, 0)][:, None], len(lam), 1)  # accepted fits
        goal = np.full((folds, len(lam)), np.inf)
        move, share = np.zeros_like(w), np.ones((folds, len(lam)))
        while len(active):
            to = w[active] + share[active][..., None] * move[active]
            loss, grad, hess = derivatives(to, active)
            value = loss + lam * np.abs(to[..., 1:]).sum(-1)
            better = value <= goal[active] + 1e-12
            gap = np.where(better, _violation(grad, to, lam), np.inf)
            fresh = to + np.where(better[..., None], _lasso_move(hess, grad, to, lam, shared) - to, 0)
            for i, f in enumerate(active):
                ok = better[i]
                w[f][ok], goal[f][ok], gaps[f, a:a + len(lam)][ok] = to[i][ok], value[i][ok], gap[i][ok]
                move[f][ok], share[f][ok] = (fresh - to)[i][ok], 1.0
                share[f][~ok] /= 2
                done = ok & (gap[i] <= tol)
                move[f][done] = 0
                if (share[f] < 1e-9).any():
                    raise NotOptimal(f"fold {f}: violation {np.max(gap[i]):.2g} of the penalty")
            active = np.array([f for i, f in enumerate(active) if not (better[i] & (gap[i] <= tol)).all()], int)
        fits[:, a:a + len(lam)] = w

    def losses(x: np.ndarray, y: np.ndarray, fold: np.ndarray) -> np.ndarray:
        out = np.zeros((folds, len(all_lams)))
        for f in range(folds):
            m = x[fold == f] @ (turn[f] @ fits[f].T)
            out[f] = (np.logaddexp(0, m) - y[fold == f][:, None] * m).sum(0)
        return out

    total = _sums(data, losses)
    loss = np.zeros((folds, len(all_lams))) + (total.reshape(folds, -1) if total.size > 1 else 0)
    return np.where(used[:, None], loss / np.maximum(held, 1)[:, None], np.nan), gaps


def cross_validate(train: DataFrame, features: str = "features", label: str = "decision_binary", key: str = "eppi_id",
                   lam_max: float | None = None, n_lambda: int = 100, min_ratio: float = 1e-2, folds: int = 10,
                   seed: int = 7) -> tuple[list[float], np.ndarray, np.ndarray]:
    """The grid of penalties, and the held-out losses and violations of :func:`path_losses` on it."""
    lam_top = lam_max if lam_max is not None else 1.0
    grid_vals = [lam_top * math.exp(math.log(min_ratio) * i / max(1, n_lambda - 1)) for i in range(n_lambda)]
    rows = materialize(train.select(vector_to_array(features).alias("x"), F.col(label).cast("double").alias("label"),
                                    fold_column(key, folds, seed).alias("fold")))
    width = rows.agg(F.max(F.size("x"))).first()[0] or 0
    return grid_vals, *path_losses(rows, width, grid_vals, folds)


def fit_priority(train: DataFrame, features: str = "features", label: str = "decision_binary",
                 key: str = "eppi_id", lam_max: float | None = None, n_lambda: int = 100,
                 min_ratio: float = 1e-2, folds: int = 10, seed: int = 7,
                 max_iter: int = 100) -> tuple[LogisticRegressionModel, float]:
    """Cross-validated lasso logistic regression; returns (model, chosen lambda).

    The held-out loss of every penalty comes from :func:`path_losses`, whose
    fits all meet the conditions of an optimum; the model is then fitted on
    all rows by Spark ML, with more iterations until it converges. A fit that
    does not is reported as a warning.
    """
    grid_vals, losses, _ = cross_validate(train, features, label, key, lam_max, n_lambda, min_ratio, folds, seed)
    data = train.select(key, features, F.col(label).cast("double").alias("label"))
    means = np.nanmean(losses, 0) if np.isfinite(losses).any() else np.zeros(n_lambda)
    best = int(np.argmin(means))
    for more in range(6):
        lr = LogisticRegression(featuresCol=features, labelCol="label", elasticNetParam=1.0, standardization=True,
                                maxIter=max_iter << more, family="binomial", regParam=grid_vals[best])
        model = lr.fit(data)
        if model.summary.totalIterations < max_iter << more:
            break
    else:
        warnings.warn("the priority model did not converge", RuntimeWarning, stacklevel=2)
    return model, grid_vals[best]


def score(model: LogisticRegressionModel, df: DataFrame, features: str = "features",
          out: str = "priority_score") -> DataFrame:
    """P(y = 1) for every row; the key and other columns are kept."""
    scored = model.transform(df)
    return scored.withColumn(out, vector_to_array(F.col("probability"))[1]).drop(
        "rawPrediction", "probability", "prediction")
