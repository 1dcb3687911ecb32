import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from sievekit.llm.hard_negatives import SortedLists, hard_negatives, score_window

SCHEMA = "vec_id long, embedding array<float>, label int, id long, vec string, positives int, block int, anchor_id long"


def brute(rows, n_pos=5, n_neg=3, low=50, high=95):
    kept = {}
    for i, v, label in rows:
        if i is None or v is None or label is None or any(x is None or not math.isfinite(x) for x in v):
            continue
        label = (label + 1) % 10 if i % 7 == 0 else label
        mine = (label, [math.floor(256 * float(np.float32(x))) for x in v])
        kept[i] = min(kept.get(i, mine), mine)
    dot = lambda a, b: sum(x * y for x, y in zip(a, b))
    out = []
    for i, (label, v) in kept.items():
        if i % 50:
            continue
        ranked = sorted((-dot(v, w), j, other == label) for j, (other, w) in kept.items() if j != i)
        for s, j, _ in [r for r in ranked if r[2]][:n_pos]:
            hits = [r for r in ranked if not r[2] and low * -s <= 100 * -r[0] <= high * -s][:n_neg]
            out += [(i, j, n + 1, r[1], -s, -r[0]) for n, r in enumerate(hits)]
    return sorted(out)


def awkward(seed=4, n=700):
    rng = random.Random(seed)
    centres = [[rng.gauss(0, 1) for _ in range(8)] for _ in range(6)]
    rows = []
    for i in range(n):
        c = centres[i % 6 if i % 3 else 0]
        v = [x + rng.gauss(0, 0.4) for x in c]
        if i % 9 == 0:
            v = [round(2 * x) / 2.0 for x in v]  # many ties
        if i % 11 == 0:
            v = list(centres[0])  # the same vector many times
        rows.append((i, v, i % 6 if i % 4 else 0))
    rows += [(50, None, 1), (1001, [1.0, None, 0.5], 1), (1050, [float("nan")] * 8, 1), (1100, [float("inf")] * 8, 1),
             (1150, [], 2), (1200, [0.0] * 8, 3), (1250, [1.0, 2.0], 0), (1300, [1.0] * 11, 0), (1350, [3.0] * 8, None),
             (None, [1.0] * 8, 1), (1400, [-4.0] * 8, 9), (1401, [-4.0] * 8, 9), rows[100], rows[100],
             (150, rows[150][1], 0), (-50, [2.0] * 8, 1), (1450, [1e6] * 8, 1), (1453, [1e6] * 8, 1), (1452, [7e5] * 8, 2)]
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("parts,block_rows", [(1, 4096), (6, 25)])
def test_against_brute_force(spark, parts, block_rows):
    rows = awkward()
    frame = spark.createDataFrame([(*r, 1, "v", 2, 3, 4) for r in rows], SCHEMA).repartition(parts)
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    out = hard_negatives(frame, F.col("vec_id") % 50 == 0, label, block_rows=block_rows)
    assert out.columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    assert sorted(tuple(r) for r in out.collect()) == brute(rows)


def test_empty(spark):
    empty = spark.createDataFrame([], "vec_id long, embedding array<float>, label int")
    assert hard_negatives(empty, F.col("vec_id") % 50 == 0, F.col("label")).count() == 0


def test_sorted_access_stops_early_and_reads_ties():
    rng = np.random.default_rng(1)
    x = rng.integers(-50, 50, (4000, 3))
    x[:40] = [300, 0, 300]  # forty equal best rows: the least ids must win
    ids = rng.permutation(4000)
    lists = SortedLists(ids, np.zeros(4000, int), x)
    calls = []
    scores = lists.scores
    lists.scores = lambda at, a: calls.append(len(at)) or scores(at, a)
    got = lists.search(np.array([2, 0, 1]), np.ones(4000, bool), [(None, None)], 5)[0]
    assert [i for _, i in got] == sorted(ids[:40])[:5] and {s for s, _ in got} == {900}
    assert sum(calls) < 1000


def test_window_of_whole_scores():
    for p in range(-30, 60):
        least, most = score_window(p, 50, 95)
        assert [s for s in range(-60, 60) if 50 * p <= 100 * s <= 95 * p] == list(range(least, most + 1))
