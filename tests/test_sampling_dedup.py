"""Sampling repeatability, strata, dedup properties, components."""

import pytest
from pyspark.sql import functions as F

from sievekit.operators.dedup import dedup, exact_clusters
from sievekit.operators.sampling import sample_n, sample_strata, shuffle_rows
from sievekit.plans.components import connected_components


def _ids(df):
    return [r[0] for r in df.collect()]


def test_sample_repeatable_across_partitionings(spark):
    base = spark.range(0, 2000).select(F.col("id").alias("eppi_id"), (F.col("id") % 3).alias("c"))
    got = []
    for parts in (1, 4, 200):
        s = sample_n(base.repartition(parts), 50, 42).orderBy("sample_rank").select("eppi_id")
        got.append(_ids(s))
    assert got[0] == got[1] == got[2] and len(set(got[0])) == 50


def test_sample_is_the_start_of_a_larger_one(spark):
    base = spark.range(0, 3000).select(F.col("id").cast("string").alias("eppi_id"))
    small = sample_n(base, 50, 9).orderBy("sample_rank").select("eppi_id")
    big = sample_n(base, 2500, 9).orderBy("sample_rank").select("eppi_id")
    assert _ids(small) == _ids(big)[:50]


def test_rows_without_id_are_drawn_like_others(spark):
    base = spark.range(0, 2000).select(
        F.when(F.col("id") % 2 == 0, F.col("id")).alias("eppi_id"), F.col("id").alias("ordinal"))
    drawn = sample_n(base, 400, 3).collect()
    assert len(drawn) == 400 and 140 < sum(r["eppi_id"] is None for r in drawn) < 260
    strata = sample_strata(base, [("all", F.col("ordinal") >= 0, 400)], 3).collect()
    assert len(strata) == 400 and 140 < sum(r["eppi_id"] is None for r in strata) < 260


def test_strata_larger_than_stratum_and_overlap(spark):
    base = spark.range(0, 100).select(F.col("id").alias("eppi_id"), (F.col("id") < 10).alias("a"), (F.col("id") < 60).alias("b"))
    s = sample_strata(base, [("a", F.col("a"), 500), ("b", F.col("b"), 20)], 1)
    rows = s.collect()
    ids = [r["eppi_id"] for r in rows]
    assert len(ids) == len(set(ids))
    assert sum(1 for r in rows if r["stratum"] == "a") == 10
    assert sum(1 for r in rows if r["stratum"] == "b") <= 20
    whole = sample_strata(base, [("all_b", F.col("b"), None)], 1)
    assert whole.count() == 60


def test_shuffle_is_permutation(spark):
    base = spark.range(0, 1000).select(F.col("id").alias("eppi_id"))
    pos = sorted(r[0] for r in shuffle_rows(base, 5).select("position").collect())
    assert pos == list(range(1, 1001))


def test_components_chain_and_star(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(30)] + [(100, 101), (102, 100)], "src long, dst long")
    comp = {r["node"]: r["component"] for r in connected_components(edges).collect()}
    assert all(comp[i] == 0 for i in range(31))
    assert comp[101] == comp[102] == comp[100] == 100


@pytest.fixture()
def docs(spark):
    text = ("the quick brown fox jumps over the lazy dog near the river bank while birds sing "
            "softly in the tall green trees and children play games in the park after school "
            "then a long quiet evening follows with soft rain on the old wooden roof of the barn "
            "where farmers store grain hay tools and many other things for the cold winter months "
            "until spring returns with warm light and new leaves on every branch of the orchard")
    other = "completely different words about statistics regression models and sampling frames in surveys"
    rows = [
        (1, 1, text, "included"),
        (2, 2, text, "excluded"),                                  # exact copy
        (3, 3, text.replace("softly", "loudly"), "excluded"),     # near copy
        (4, 4, other, "included"),
        (5, 5, other + " extra tail words here now", None),
        (6, 6, "short unrelated note", "excluded"),
    ]
    return spark.createDataFrame(rows, "eppi_id long, ordinal long, abstract string, cite_label string")


def test_dedup_clusters_and_labels(docs):
    out = dedup(docs, label="cite_label")
    cl = {r["eppi_id"]: r["cluster_id"] for r in out["clusters"].collect()}
    assert cl[1] == cl[2] == cl[3] == 1
    assert cl[6] == 6
    uniq = {r["cluster_id"]: r for r in out["unique"].collect()}
    assert uniq[1]["n_members"] == 3 and uniq[1]["labels"] == "excluded, included"
    assert uniq[1]["ordinal"] == 1


def test_dedup_idempotent_and_order_free(docs):
    a = {r["eppi_id"]: r["cluster_id"] for r in dedup(docs)["clusters"].collect()}
    b = {r["eppi_id"]: r["cluster_id"] for r in dedup(docs.orderBy(F.col("eppi_id").desc()).repartition(3))["clusters"].collect()}
    assert a == b
    uniq = dedup(docs)["unique"].select("eppi_id", "ordinal", "abstract", "cite_label")
    again = {r["eppi_id"]: r["cluster_id"] for r in dedup(uniq)["clusters"].collect()}
    assert all(k == v for k, v in again.items())


def test_exact_clusters_null_key(spark):
    df = spark.createDataFrame([(1, "a"), (2, "a"), (3, None), (4, None)], "id long, k string")
    got = {r["id"]: (r["cluster_id"], r["n_members"]) for r in exact_clusters(df, "id", "k").collect()}
    assert got == {1: (1, 2), 2: (1, 2), 3: (3, 1), 4: (4, 1)}


def test_components_refuse_unconverged(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(64)], "src long, dst long")
    with pytest.raises(RuntimeError):
        connected_components(edges, max_rounds=1)


def test_dedup_keeps_rows_with_null_and_repeated_ids(spark):
    rows = [(None, 1, "alpha beta gamma delta"), ("x", 2, "one two three four"), ("x", 3, "five six seven eight"),
            (None, 4, "nine ten eleven twelve"), ("y", 5, "Nine, ten. Eleven twelve"), ("z", 6, None), (None, 7, None)]
    df = spark.createDataFrame(rows, "eppi_id string, ordinal long, abstract string")
    out = dedup(df)
    got = {r["ordinal"]: r["n_members"] for r in out["unique"].collect()}
    assert got == {1: 1, 2: 1, 3: 1, 4: 2, 6: 1, 7: 1}
    with pytest.raises(ValueError):
        dedup(df.withColumn("ordinal", F.lit(1)))
