"""Bucketed global rank equals the brute-force global order (§4.2)."""

import math
import random

import pytest
from pyspark.sql import functions as F

from sievekit.plans.global_order import lag_rows, order_stats, rank_rows


def _brute(rows, descending=True):
    # rows: (ordinal, score, flag); order: score desc, nulls and NaN last by ordinal.
    def key(r):
        s = r[1]
        if s is None or math.isnan(s):
            grp, v = 2, 0.0
        else:
            grp, v = 1, (-s if descending else s)
        return (grp, v, r[0])

    out, cum = {}, 0
    for pos, r in enumerate(sorted(rows, key=key), start=1):
        cum += 1 if r[2] else 0
        out[r[0]] = (pos, cum)
    return out


def _data(kind, n=3000, seed=7):
    rnd = random.Random(seed)
    rows = []
    for i in range(n):
        if kind == "all_tied":
            s = 0.5
        elif kind == "few_values":
            s = float(rnd.randint(0, 10))
        elif kind == "values_nulls":
            s = None if rnd.random() < 0.2 else float(rnd.randint(0, 10))
        elif kind == "heavy":
            s = 1.0 if rnd.random() < 0.9 else rnd.random()
        else:
            s = rnd.random()
        if kind == "values_nulls" and rnd.random() < 0.02:
            s = float("nan")
        rows.append((i * 3 + 1, s, rnd.random() < 0.3))
    rnd.shuffle(rows)
    return rows


@pytest.mark.parametrize("kind", ["all_tied", "few_values", "values_nulls", "heavy", "distinct"])
@pytest.mark.parametrize("descending", [True, False])
def test_rank_rows_matches_brute_force(spark, kind, descending):
    rows = _data(kind)
    df = spark.createDataFrame(rows, "ordinal long, score double, flag boolean").repartition(5)
    out = rank_rows(df, "score", "ordinal", flags={"rel": F.col("flag")}, descending=descending,
                    rows_per_bucket=97)
    got = {r["ordinal"]: (r["position"], r["cum_rel"]) for r in out.collect()}
    assert got == _brute(rows, descending)
    st = order_stats(df, "score", "ordinal", rows_per_bucket=97)
    assert st.n == len(rows)


def test_cells_bounded_under_skew(spark):
    # 90 % of rows share one score: the heavy value is split by ordinal.
    from sievekit.plans.global_order import assign_cells

    rows = _data("heavy", n=6000)
    df = spark.createDataFrame(rows, "ordinal long, score double, flag boolean")
    st = order_stats(df, "score", "ordinal", rows_per_bucket=200)
    sizes = [r["c"] for r in assign_cells(df, "score", "ordinal", st).groupBy("__ob", "__sb")
             .agg(F.count("*").alias("c")).collect()]
    assert max(sizes) < 6000 * 0.2


def test_plan_has_no_single_partition_over_list(spark):
    df = spark.range(0, 5000).select(F.col("id").alias("ordinal"), (F.col("id") % 7).cast("double").alias("score"))
    out = rank_rows(df, "score", "ordinal", rows_per_bucket=500)
    plan = out._jdf.queryExecution().executedPlan().toString()
    # The only single-partition exchange allowed is over the small cell table.
    assert "CartesianProduct" not in plan
    assert "hashpartitioning(__ob" in plan


@pytest.mark.parametrize("score_expr", ["CAST(NULL AS DOUBLE)", "0.25"])
def test_all_null_or_all_tied_scores_are_split(spark, score_expr):
    from sievekit.plans.global_order import assign_cells

    df = spark.range(0, 4000).selectExpr("id * 7 AS ordinal", f"{score_expr} AS score")
    st = order_stats(df, "score", "ordinal", rows_per_bucket=100)
    sizes = [r["c"] for r in assign_cells(df, "score", "ordinal", st).groupBy("__ob", "__sb")
             .agg(F.count("*").alias("c")).collect()]
    assert max(sizes) <= 4000 * 0.05
    out = rank_rows(df, "score", "ordinal", rows_per_bucket=100)
    got = [r["ordinal"] for r in out.orderBy("position").collect()]
    assert got == sorted(got)


@pytest.mark.parametrize("kind", ["all_tied", "values_nulls", "heavy", "distinct"])
@pytest.mark.parametrize("descending", [True, False])
def test_lag_over_cells(spark, kind, descending):
    rows = [(o, s, None if o % 5 == 0 else o * 10) for o, s, _ in _data(kind, n=1500)]
    df = spark.createDataFrame(rows, "ordinal long, score double, v long").repartition(4)
    out = lag_rows(df, {"before": "v", "ordinal_before": "ordinal"}, "score", "ordinal", descending, rows_per_bucket=61)
    got = {r["ordinal"]: (r["before"], r["ordinal_before"]) for r in out.collect()}
    place = {o: p for o, (p, _) in _brute([(r[0], r[1], False) for r in rows], descending).items()}
    ranked = sorted(rows, key=lambda r: place[r[0]])
    assert got == {r[0]: (b[2], b[0]) for r, b in zip(ranked, [ranked[0], *ranked])}
    plan = out._jdf.queryExecution().executedPlan().toString().splitlines()
    for line, below in zip(plan, plan[1:]):  # only the table of cells meets in one task
        assert "SinglePartition" not in line or "Aggregate(key=[__ob" in below


def test_lag_of_one_and_no_rows(spark):
    df = spark.createDataFrame([(1, None, 7)], "ordinal long, score double, v long")
    assert [r["b"] for r in lag_rows(df, {"b": "v"}, "score", "ordinal").collect()] == [7]
    assert lag_rows(df.filter("v = 0"), {"b": "v"}, "score", "ordinal").count() == 0
