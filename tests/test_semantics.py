"""Missing-value and order rules of the screening scripts."""

import random

import pytest
from pyspark.sql import functions as F

from sievekit.functions import scalars as S
from sievekit.operators import joins as J
from sievekit.operators import order as O
from sievekit.operators.filters import criteria_screen, filter_out, keep
from sievekit.operators.sampling import first_per_key
from sievekit.operators.sets import bind_rows


@pytest.fixture()
def recs(spark):
    rows = [(1, 1, "a", 1, 0.9), (2, 2, None, None, 0.8), (3, 3, "", 0, 0.8), (4, 4, "d", 1, None), (None, 5, "e", 0, 0.1)]
    return spark.createDataFrame(rows, "eppi_id long, ordinal long, abstract string, code int, score double")


def test_filter_vs_filter_out(recs):
    assert sorted(r[0] for r in keep(recs, F.col("code") == 1).select("ordinal").collect()) == [1, 4]
    # filter_out drops TRUE only: the null-code row stays
    assert sorted(r[0] for r in filter_out(recs, F.col("code") == 1).select("ordinal").collect()) == [2, 3, 5]


def test_blank_to_null_and_paste(recs):
    out = {r["ordinal"]: r for r in recs.select(
        "ordinal", S.blank_to_null("abstract").alias("b"), S.paste("abstract", F.lit("x")).alias("p"),
        S.paste("abstract", F.lit("x"), na="skip").alias("q")).collect()}
    assert out[3]["b"] is None and out[2]["b"] is None and out[1]["b"] == "a"
    assert out[2]["p"] == "NA x" and out[2]["q"] == "x"


def test_if_else_keeps_null(recs):
    out = {r[0]: r[1] for r in recs.select("ordinal", S.if_else(F.col("code") == 1, "in", "out")).collect()}
    assert out == {1: "in", 2: None, 3: "out", 4: "in", 5: "out"}


def test_round_half_even_and_try_cast(spark):
    r = spark.range(1).select(S.round_half_even(F.lit(2.5)).alias("a"), S.round_half_even(F.lit(3.5)).alias("b"),
                              S.to_number(F.lit("x1"), "double").alias("c"), S.to_number(F.lit("7"), "int").alias("d")).first()
    assert (r["a"], r["b"], r["c"], r["d"]) == (2.0, 4.0, None, 7)


def test_membership_null_safe(spark, recs):
    ids = spark.createDataFrame([(1,), (None,)], "eppi_id long")
    assert sorted(r[0] for r in J.semi_ids(recs, ids).select("ordinal").collect()) == [1, 5]
    no_null = spark.createDataFrame([(1,)], "eppi_id long")
    # %in% never NA: the row with a missing id is kept by the anti join
    assert sorted(r[0] for r in J.anti_ids(recs, no_null).select("ordinal").collect()) == [2, 3, 4, 5]
    flags = {r[0]: r[1] for r in J.flag_ids(recs, no_null, "f").select("ordinal", "f").collect()}
    assert flags == {1: 1, 2: 0, 3: 0, 4: 0, 5: 0}


def test_split_disjoint_and_complete(spark):
    df = spark.range(0, 300).select(F.col("id").alias("eppi_id"), F.col("id").alias("ordinal"))
    tr_ids = spark.range(0, 300, 7).select(F.col("id").alias("eppi_id"))
    hold = spark.range(0, 300, 21).select(F.col("id").alias("eppi_id"))
    train, unseen = J.split_train_unseen(df, tr_ids, holdout_ids=hold)
    t = {r[0] for r in train.collect()}
    u = {r[0] for r in unseen.select("eppi_id").collect()}
    assert not (t & u) and (t | u) == set(range(300))
    assert not (t & {i for i in range(0, 300, 21)})


def test_bind_rows_fills_and_checks_types(spark):
    a = spark.createDataFrame([(1, "x")], "id long, t string")
    b = spark.createDataFrame([(2, 5)], "id long, n int")
    out = bind_rows(a, b).orderBy("part").collect()
    assert out[0]["n"] is None and out[1]["t"] is None and [r["part"] for r in out] == [0, 1]
    c = spark.createDataFrame([(3, 1)], "id long, t int")
    with pytest.raises(TypeError):
        bind_rows(a, c)


def test_first_per_key_null_key_is_a_group(recs, spark):
    df = recs.withColumn("k", F.when(F.col("ordinal") <= 2, F.lit(None)).otherwise(F.col("code")))
    got = sorted(((r["k"], r["ordinal"]) for r in first_per_key(df, "k").collect()), key=lambda t: (t[0] is not None, t))
    assert got == [(None, 1), (0, 3), (1, 4)]


def test_criteria_screen(recs):
    out = {r["ordinal"]: (r["decision_binary"], r["failed_criteria"]) for r in criteria_screen(
        recs, {"A": F.col("abstract") != "", "B": F.col("code") == 1}).collect()}
    assert out[1] == (1, []) and out[2] == (0, ["A", "B"]) and out[3] == (0, ["A", "B"])


def test_recall_zero_relevant_is_null(recs):
    curve = O.recall_curve(recs, F.lit(False))
    assert all(r["recall"] is None for r in curve.collect())


def _dense_runs(flags):
    """R's form with the null rule: is_irrelevant = coalesce(flag == 0, False)."""
    irr = [f == 0 if f is not None else False for f in flags]
    out, run, prev = {}, 0, None
    for pos, x in enumerate(irr, start=1):
        if prev is not None and x != prev:
            run += 1
        prev = x
        if x:
            s = out.setdefault(run, [0, pos, pos])
            s[0] += 1
            s[2] = pos
    n = len(flags)
    return sorted((k, v[0], v[1], v[2], round(v[0] / n * 100, 6)) for k, v in out.items())


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_stopping_runs_match_dense_form(spark, seed):
    rnd = random.Random(seed)
    n = 700
    flags = [rnd.choice([0, 0, 0, 1, None]) for _ in range(n)]
    if seed == 2:
        flags[0] = 1
    # score decreasing with position, with ties broken by ordinal
    rows = [(i + 1, float(n - i) // 3, flags[i]) for i in range(n)]
    df = spark.createDataFrame(rows, "ordinal long, score double, f int")
    got = sorted((r["run_id"], r["run_length"], r["start_row"], r["end_row"], round(r["pct_of_total"], 6))
                 for r in O.stopping_runs(df, "f", rows_per_bucket=50).collect())
    assert got == _dense_runs(flags)


def test_slice_max_keeps_ties(recs):
    got = sorted(r["ordinal"] for r in O.slice_max(recs, "score", 2).collect())
    assert got == [1, 2, 3]  # 0.9 and the two tied 0.8


def test_lag_first_default_is_first_value(spark):
    rows = [("a", 1, 0), ("a", 2, None), ("a", 3, 1), ("b", 1, 1), ("b", 2, 1)]
    df = spark.createDataFrame(rows, "g string, o long, x int")
    out = {(r["g"], r["o"]): r["lx"] for r in df.select(
        "g", "o", O.lag_first("x", [F.col("o")], ["g"]).alias("lx")).collect()}
    # row 1 takes its own value; a null in mid-list is carried, not hidden
    assert out == {("a", 1): 0, ("a", 2): 0, ("a", 3): None, ("b", 1): 1, ("b", 2): 1}


def test_bind_rows_numbers_later_inputs_anew(spark):
    a = spark.createDataFrame([(1, "x"), (2, "y")], "ordinal long, t string")
    b = spark.createDataFrame([(1, "z"), (5, "w")], "ordinal long, t string")
    both = bind_rows(a, b)
    assert [(r["ordinal"], r["t"]) for r in both.orderBy("ordinal").collect()] == [(1, "x"), (2, "y"), (3, "z"), (7, "w")]
    again = bind_rows(both, a.limit(0), b)
    assert again.select("ordinal").distinct().count() == 6 and {"part", "part_inner"} <= set(again.columns)


def test_whole_numbers_from_decimal_texts(spark):
    from sievekit.functions.scalars import to_number

    rows = [("12.7", 12), ("2013.0", 2013), ("-3.9", -3), ("x", None), ("", None), (None, None),
            ("9007199254740993", 9007199254740993), ("NaN", None), ("1e30", None)]
    df = spark.createDataFrame(rows, "t string, want long")
    assert all(r["got"] == r["want"] for r in df.withColumn("got", to_number("t", "bigint")).collect())


def test_keys_of_any_script_and_null_groups(spark):
    from sievekit.functions.scalars import normalise_text
    from sievekit.operators.aggregates import label_conflict_rows, label_conflicts

    texts = ["Исследование", "研究", "Grüße aus Köln", "Gre aus Kln", "!?", "", None]
    df = spark.createDataFrame([(k, t, "included" if k % 2 else "excluded", k % 2) for k, t in enumerate(texts)],
                               "ordinal long, t string, cite_label string, human_code int")
    keyed = df.withColumn("k", normalise_text("t"))
    keys = [r["k"] for r in keyed.orderBy("ordinal").collect()]
    assert len(set(keys[:4])) == 4 and keys[4:] == [None] * 3
    out = label_conflicts(keyed, "k", "cite_label", "human_code").collect()
    assert len(out) == 7 and not any(r["conflict"] for r in out)
    assert label_conflict_rows(keyed, "k", "cite_label").count() == 0
    assert label_conflict_rows(keyed.withColumn("k", F.lit("a")), "k", "cite_label").count() == 7
