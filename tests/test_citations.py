"""Near titles and citation evidence against all pairs in plain Python."""

import random
from collections import defaultdict

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from sievekit.operators.citations import citation_clusters, citation_fields
from sievekit.operators.near_titles import _near, near_keys, title_link_near


def levenshtein(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def similarity(a, b, t):
    n = max(len(a), len(b))
    if min(len(a), len(b)) < n * t - 1e-9:
        return None
    d = levenshtein(a, b)
    return 1 - d / n if d <= int(n * (1 - t) + 1e-9) else None


def mistyped(rng, s, edits):
    s = list(s)
    for _ in range(edits):
        at = rng.randrange(len(s) + 1)
        kind = rng.randrange(3)
        if kind == 0 or not s:
            s.insert(at, rng.choice("abcé"))
        elif kind == 1:
            del s[min(at, len(s) - 1)]
        else:
            s[min(at, len(s) - 1)] = rng.choice("abcé")
    return "".join(s)


def titles(seed=5):
    rng = random.Random(seed)
    out = {"a", "ab", "abc", "abd", "aaaaaaaaaaaaaaaaaaaa", "aaaaaaaaaaaaaaaaaaab", "abababababababababab", "babababababababababa"}
    for _ in range(40):
        base = "".join(rng.choice("abcdefé") for _ in range(rng.randint(1, 70)))
        out |= {base, *(mistyped(rng, base, rng.randint(1, 9)) for _ in range(4))}
    return sorted(k for k in out if k)


@pytest.mark.parametrize("t", [0.85, 0.9, 0.97, 1.0])
def test_near_keys_lose_nothing(spark, t):
    keys = titles()
    df = spark.createDataFrame([(k, i % 3 != 0, i % 3 != 1) for i, k in enumerate(keys)], "key string, in_left boolean, in_right boolean")
    got = {(r["key_a"], r["key_b"]): round(r["similarity"], 9) for r in near_keys(df, t).collect()}
    want = {(a, b): round(s, 9) for i, a in enumerate(keys) if i % 3 != 0 for j, b in enumerate(keys)
            if j % 3 != 1 and a != b and (s := similarity(a, b, t)) is not None}
    assert got == want and (t > 0.95 or len(want) > 50)


def test_long_titles_of_few_grams(spark):
    """Long keys of common syllables share most grams: sketches leave near pairs only, whatever the other grams."""
    rng = random.Random(3)
    parts = ["th", "on", "an", "er", "ti", "re", "in", "ou", "st", "ed"]
    keys = {"".join(rng.choice(parts) for _ in range(rng.randint(40, 50))) for _ in range(60)}
    keys |= {mistyped(rng, k, rng.randint(1, 6)) for k in sorted(keys)[:20]}
    keys = sorted(keys)
    rows = pa.table({"key": keys, "at": [0] * len(keys)})
    got = {tuple(sorted((keys[a], keys[b]))): d for x, y, ds in _near(rows, 0.9) for a, b, d in zip(x, y, ds)}
    want = {(a, b): levenshtein(a, b) for i, a in enumerate(keys) for b in keys[i + 1:] if similarity(a, b, 0.9) is not None}
    assert got == want and len(want) > 10
    left = [F.lit(True).alias("in_left"), F.lit(True).alias("in_right")]
    plan = near_keys(spark.createDataFrame([(k,) for k in keys], "key string").select("key", *left), 0.9)
    assert plan.count() == 2 * len(want)


def test_bad_threshold(spark):
    with pytest.raises(ValueError):
        near_keys(spark.createDataFrame([], "key string, in_left boolean, in_right boolean"), 0.5)


def test_generic_titles_are_told_by_number(spark):
    recs = spark.range(500).select(F.col("id").alias("eppi_id"), F.when(F.col("id") < 400, "editorialnote").otherwise(
        F.concat(F.lit("a long enough title number "), F.col("id"))).alias("t"))
    lst = spark.createDataFrame([("x", "editorialnotes"), ("y", "a long enough title number 417"), ("z", None), ("z", "none")],
                                "list_id string, lt string")
    got = {(r["list_id"], r["first_id"]): r["n_records"] for r in title_link_near(recs, lst, F.col("t"), F.col("lt")).collect()}
    assert got[("x", 0)] == 400 and got[("y", 417)] == 1 and len(got) == 101


def brute(rows, names, t_auto=0.9, t_manual=0.85):
    parent = {r["ordinal"]: r["ordinal"] for r in rows}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    near = []
    for i, a in enumerate(rows):
        for b in rows[i + 1:]:
            if a["key"] is None or b["key"] is None:
                continue
            s = similarity(a["key"], b["key"], t_manual)
            if s is None:
                continue
            known = [(a[n], b[n]) for n in names if a[n] is not None and b[n] is not None]
            agree = sum(x == y for x, y in known)
            near.append((a["ordinal"], b["ordinal"], s, agree, len(known) - agree))
            if s >= t_auto and agree >= 2 and len(known) - agree <= 1:
                x, y = find(a["ordinal"]), find(b["ordinal"])
                parent[max(x, y)] = min(x, y)
    clusters = {k: find(k) for k in parent}
    pairs = defaultdict(lambda: (0.0, 0, 9))
    for a, b, s, agree, differ in near:
        pair = tuple(sorted((clusters[a], clusters[b])))
        if pair[0] != pair[1] and differ <= 1:
            old = pairs[pair]
            pairs[pair] = (max(old[0], round(s, 9)), max(old[1], agree), min(old[2], differ))
    return clusters, dict(pairs)


def citations():
    rng = random.Random(8)
    rows = []
    for k in range(60):
        base = "".join(rng.choice("abcdefgh") for _ in range(rng.randint(8, 40)))
        fields = [rng.choice(["smith", "li", None]), rng.choice(["2001", "2002", None]), rng.choice(["1", "2", None]), None]
        for _ in range(rng.randint(1, 4)):
            own = [f if rng.random() < 0.8 else rng.choice([None, "9"]) for f in fields]
            rows.append((mistyped(rng, base, rng.randint(0, 4)) or None, *own))
    rows += [("editorial", rng.choice(["smith", None]), rng.choice(["2001", "2002", None]), None, None) for _ in range(40)]
    rows += [(None, "smith", "2001", "1", "2")] * 3
    names = ["author", "year", "volume", "issue"]
    return [dict(zip(["ordinal", "key", *names], (i + 1, *r), strict=True)) for i, r in enumerate(rows)], names


def test_citation_clusters(spark):
    rows, names = citations()
    df = spark.createDataFrame(rows, "ordinal long, key string, author string, year string, volume string, issue string")
    out = citation_clusters(df.repartition(5), {n: F.col(n) for n in names}, F.col("key"))
    clusters, pairs = brute(rows, names)
    assert {r["ordinal"]: r["cluster_id"] for r in out["clusters"].collect()} == clusters
    got = {(r["src"], r["dst"]): (round(r["similarity"], 9), r["agree"], r["differ"]) for r in out["manual_pairs"].collect()}
    assert got == pairs and out["oversize"].count() == 0
    small = citation_clusters(df, {n: F.col(n) for n in names}, F.col("key"), block_pairs=100)
    assert {r["ordinal"]: r["cluster_id"] for r in small["clusters"].collect()} == clusters  # merges need no list
    big = small["oversize"].collect()
    assert [(r["n_a"], r["n_b"]) for r in big] == [(40, 40)]


def test_fields_of_records(spark):
    df = spark.createDataFrame([(1, ["Smith, J.", "Li, X."], 2001, " 3 ", "")], "ordinal long, author array<string>, year int, volume string, issue string")
    row = df.select(*[c.alias(n) for n, c in citation_fields(df).items()]).first().asDict()
    assert row == {"year": "2001", "volume": "3", "issue": None, "author": "smith"}
