"""Title blocks of any size, and fields that rule titles out, against all pairs in plain Python."""

import random

import pytest
from pyspark.sql import functions as F
from test_citations import brute, citations, mistyped, similarity, titles

from sievekit.operators.citations import citation_clusters
from sievekit.operators.near_titles import near_keys

SCHEMA = "ordinal long, key string, author string, year string, volume string, issue string"


def found(out):
    return {(r["src"], r["dst"]): (round(r["similarity"], 9), r["agree"], r["differ"]) for r in out["manual_pairs"].collect()}


def generic():
    rng = random.Random(21)
    some = lambda *values: rng.choice([None, *values])
    rows = [(mistyped(rng, "editorialofthejournal", rng.randint(0, 3) if rng.random() < 0.3 else 0),
             some("smith", "li", "kim"), some("2001", "2002", "2003"), some("1", "2"), some("a", "b")) for _ in range(150)]
    names = ["author", "year", "volume", "issue"]
    return [dict(zip(["ordinal", "key", *names], (i + 1, *r), strict=True)) for i, r in enumerate(rows)], names


@pytest.mark.parametrize("made", [citations, generic])
@pytest.mark.parametrize("block_pairs", [1, 100])
def test_doubtful_pairs_of_oversize_blocks_are_listed(spark, made, block_pairs):
    rows, names = made()
    out = citation_clusters(spark.createDataFrame(rows, SCHEMA), {n: F.col(n) for n in names}, F.col("key"), block_pairs=block_pairs)
    clusters, pairs = brute(rows, names)
    assert {r["ordinal"]: r["cluster_id"] for r in out["clusters"].collect()} == clusters
    assert found(out) == pairs and len(pairs) > 20 and out["oversize"].count() > 0


def test_equal_profiles_meet_by_title_alone(spark):
    rows = [(i, "a generic title", None, None, "7" if i > 3 else None, None) for i in range(1, 6)]
    out = citation_clusters(spark.createDataFrame(rows, SCHEMA), {n: F.col(n) for n in ("author", "year", "volume")}, F.col("key"))
    assert found(out) == {(a, b): (1.0, int(a > 3), 0) for a in range(1, 6) for b in range(a + 1, 6)}


@pytest.mark.parametrize("most", [0, 1])
def test_fields_rule_out_no_pair_that_may_meet(spark, most):
    rng = random.Random(4)
    rows = [(k, *(rng.choice([None, 1, 2, 3]) for _ in range(3))) for k in titles() for _ in range(rng.randint(1, 3))]
    df = spark.createDataFrame(rows, "key string, x int, y int, z int").withColumns({"in_left": F.lit(True), "in_right": F.lit(True)})
    got = {(r["key_a"], r["key_b"]) for r in near_keys(df, 0.85, fields=["x", "y", "z"], max_differ=most).collect()}
    want, near = set(), set()
    for a, *p in rows:
        for b, *q in rows:
            if a != b and similarity(a, b, 0.85) is not None:
                near.add((a, b))
                if sum(x != y for x, y in zip(p, q) if x is not None and y is not None) <= most:
                    want.add((a, b))
    assert got == want and 20 < len(want) < len(near)


def test_last_word_of_a_text(spark, tmp_path):
    from sievekit.plans.registry import QUERIES

    texts = ["one title\nsome words Smith \t\n\r", "one title\nother words\tSMITH", "one title\n", "one title\nsmith li", None, ""]
    docs = [(i, t, "en", "s", 84) for i, t in enumerate(texts)]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(
        str(tmp_path / "documents.parquet"))
    got = {r["ordinal"]: r["cluster_id"] for r in QUERIES["dedup_citations"](spark, str(tmp_path)).collect()}
    assert got == {0: 0, 1: 0, 2: 2, 3: 3, 4: 4, 5: 5}
