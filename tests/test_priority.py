"""Priority screening (I1-I4) properties on the small tables."""

import inspect

import numpy as np
from pyspark.ml.classification import LogisticRegression
from pyspark.sql import functions as F

from conftest import SF_SMALL
from sievekit.operators import model as M
from sievekit.operators.sampling import sample_n
from sievekit.plans.priority import priority_screening
from sievekit.plans.registry import _with_vectors


def test_priority_list_properties(spark):
    data = _with_vectors(spark, SF_SMALL)
    hold = sample_n(data.select("eppi_id"), 20, 3).select("eppi_id")
    strata = [("inc", F.col("decision_binary") == 1, None), ("exc", F.col("decision_binary") == 0, 40)]
    ranked, info = priority_screening(data, strata, 11, holdout_ids=hold, n_lambda=3, folds=3)
    rows = ranked.select("eppi_id", "ordinal", "position", "priority_score").orderBy("position").collect()
    n_all = data.count()
    n_inc = data.filter(F.col("decision_binary") == 1).join(hold, "eppi_id", "left_anti").count()
    n_train = n_inc + 40
    assert len(rows) == n_all - n_train
    assert [r["position"] for r in rows] == list(range(1, len(rows) + 1))
    for a, b in zip(rows, rows[1:]):
        assert a["priority_score"] > b["priority_score"] or (
            a["priority_score"] == b["priority_score"] and a["ordinal"] < b["ordinal"])
    held = {r[0] for r in hold.collect()}
    assert held <= {r["eppi_id"] for r in rows}  # test ids are ranked, never trained on
    assert info["lambda_max"] > 0


def test_lambda_max_gives_empty_model(spark):
    data = M.embedding_features(_with_vectors(spark, SF_SMALL), "embedding").withColumn(
        "label", F.col("decision_binary").cast("double"))
    lam = M.lambda_max(data, "embedding", "decision_binary")
    above = LogisticRegression(elasticNetParam=1.0, regParam=lam * 1.02, maxIter=50).fit(data)
    below = LogisticRegression(elasticNetParam=1.0, regParam=lam * 0.8, maxIter=50).fit(data)
    assert all(abs(c) < 1e-12 for c in above.coefficients.toArray())
    assert any(abs(c) > 0 for c in below.coefficients.toArray())


def test_hashed_text_features(spark):
    df = spark.createDataFrame([(1, "alpha beta gamma"), (2, "beta delta"), (3, "")], "id long, t string")
    apply = M.hashed_text_features(df, "t", num_features=64)
    out = {r["id"]: r["features"] for r in apply(df).collect()}
    assert out[3].numNonzeros() == 0 and out[1].numNonzeros() >= 2


def test_encoder_features_with_callable(spark):
    def make():
        return lambda texts: [[float(len(t)), 1.0] for t in texts]

    enc = M.encoder_features(make, 2)
    df = spark.createDataFrame([("ab",), (None,)], "t string")
    got = [r[0] for r in df.select(enc("t")).collect()]
    assert got == [[2.0, 1.0], [0.0, 1.0]]


def test_default_path_is_whole_and_converges(spark):
    assert [inspect.signature(f).parameters[k].default for f in (M.fit_priority, priority_screening)
            for k in ("n_lambda", "folds")] == [100, 10, 100, 10]
    rng = np.random.default_rng(4)
    x = rng.normal(0, [1, 5, 0.2, 1], (160, 4))
    y = (x[:, 0] + x[:, 1] / 5 + rng.normal(0, 1, 160) > 0).astype(float)
    df = spark.createDataFrame([(k, r.tolist(), float(v), k % 4) for k, (r, v) in enumerate(zip(x, y))],
                               "id long, x array<double>, label double, fold int").repartition(3)
    lams = [0.1, 0.01]
    got, gaps = M.path_losses(df.select("x", "label", "fold"), 4, lams, 4)
    assert gaps.max() <= M.TOLERANCE
    data = M.embedding_features(df, "x")
    for j, lam in enumerate(lams):  # Spark's own fit of a fold
        m = LogisticRegression(elasticNetParam=1.0, regParam=lam, maxIter=200, tol=1e-9).fit(data.filter("fold <> 1"))
        p = [(r["probability"][1], r["label"]) for r in m.transform(data.filter("fold = 1")).collect()]
        want = -np.mean([np.log(a if b else 1 - a) for a, b in p])
        assert abs(got[1, j] - want) < 2e-3


def test_every_fit_of_a_separable_table_is_optimal(spark):
    """Few rows, many columns and a fold without rows: fits that are nearly exact still meet their conditions."""
    rng = np.random.default_rng(9)
    x = rng.normal(0, 1, (60, 30))
    df = spark.createDataFrame([(r.tolist(), float(r[0] > 0), k % 3) for k, r in enumerate(x)],
                               "x array<double>, label double, fold int").repartition(3)
    lams = [0.3 * 0.9 ** k for k in range(25)]
    loss, gaps = M.path_losses(df, 30, lams, 4)
    assert np.isnan(loss[3]).all() and np.isnan(gaps[3]).all()
    assert gaps[:3].max() <= M.TOLERANCE and np.isfinite(loss[:3]).all()


def test_driver_gets_one_sum_of_many_partitions(spark, monkeypatch):
    data = spark.range(400).select(F.array(F.col("id").cast("double")).alias("x"), F.lit(1.0).alias("label"),
                                   F.lit(0).alias("fold")).repartition(40)
    sent, collect = [], type(data).collect
    monkeypatch.setattr(type(data), "collect", lambda self: sent.append(collect(self)) or sent[-1])
    total = M._sums(data, lambda x, y, fold: x.sum(0))
    assert total.tolist() == [400, 79800] and [len(rows) for rows in sent] == [1]
