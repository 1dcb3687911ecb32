import hashlib
import random

from pyspark.sql import functions as F

from sievekit.llm.exact_dedup import CuckooFilter, Shard, apply_changes, drop_copies, exact_dedup, key_changes, settle_keeps
from tests.llm.cases import SCHEMA, SPACE, documents, frame


def digest(t):
    return hashlib.sha256(SPACE.sub(" ", t or "").encode()).hexdigest()


def brute(rows):
    groups = {}
    for r in rows:
        groups.setdefault(digest(r[1]), []).append(r[0])
    out = []
    for r in rows:
        ids = groups[digest(r[1])]
        keep = min((x for x in ids if x is not None), default=None)
        out.append((r[0], keep, len(ids), r[0] == keep, digest(r[1])))
    return sorted(out, key=str)


def test_awkward_rows(spark):
    rows = documents()
    assert sorted((tuple(r) for r in exact_dedup(frame(spark, rows)).collect()), key=str) == brute(rows)
    kept = drop_copies(frame(spark, rows)).collect()
    assert sorted(digest(r["text"]) for r in kept) == sorted({digest(r[1]) for r in rows})
    unique = {r[0]: r for r in rows}
    rows = list(unique.values())
    kept = drop_copies(frame(spark, rows)).collect()
    assert sorted(r["doc_id"] or 0 for r in kept) == sorted(k or 0 for k, _, _, keep, _ in brute(rows) if keep)


def test_empty(spark):
    assert exact_dedup(spark.createDataFrame([], SCHEMA)).count() == 0
    assert drop_copies(spark.createDataFrame([], SCHEMA)).count() == 0


def test_filter_insert_delete():
    rng = random.Random(1)
    keys = [rng.randbytes(32) for _ in range(3000)]
    f = CuckooFilter(3000)
    assert all(f.insert(k) for k in keys) and all(k in f for k in keys)
    for k in keys[:1500]:
        f.delete(k)
    assert all(k in f for k in keys[1500:])
    assert sum(k in f for k in keys[:1500]) < 30
    small = CuckooFilter(8)
    taken = [k for k in keys if small.insert(k)]
    assert len(taken) < len(keys) and all(k in small for k in taken)  # a failed insertion loses nothing


def test_shard_resizes_from_stored_keys():
    rng = random.Random(2)
    keys = [rng.randbytes(32) for _ in range(2000)]
    s = Shard(4)
    for n, k in enumerate(keys):
        s.add(k, 1, n)
    s.add(keys[7], 2, 3)
    assert s.resizes > 3 and s.find(keys[7]) == [3, 3, False] and all(s.find(k) for k in keys)
    s.remove(keys[7], 3, 3)
    assert s.find(keys[7]) is None and len(s) == 1999


def test_shard_against_a_plain_table():
    """Insertions, deletions and resizes in any order, with fingerprints that clash."""
    rng = random.Random(3)
    keys = [bytes(8) + rng.randbytes(1) + bytes(7) + bytes([k % 5, 1]) + rng.randbytes(14) for k in range(400)]
    s, plain = Shard(4), {}
    for _ in range(6000):
        k, row = rng.choice(keys), rng.randrange(1000)
        if rng.random() < 0.55:
            s.add(k, 1, row)
            plain.setdefault(k, []).append(row)
        elif k in plain:
            row = rng.choice(plain[k])
            s.remove(k, 1, row)
            plain[k].remove(row)
            if not plain[k]:
                del plain[k]
    assert len(s) == len(plain) and s.false_hits > 100 and s.resizes > 0
    for k in keys:
        got = s.find(k)
        assert (got is None) == (k not in plain) and (got is None or got[0] == len(plain[k]))
        assert got is None or got[2] or got[1] == min(plain[k])


def test_text_ids_and_clashing_names(spark):
    rows = [("b", "x y", "1"), ("a", "x  y", "2"), ("a", "x\ty", "3"), (None, "x y", "4"), ("c", "z", "5"), ("c", "z", "6")]
    df = spark.createDataFrame(rows, "doc_id string, text string, text_sha256 string").withColumns(
        {c: F.lit(0) for c in ("keep_id", "kept", "key", "keep", "refs", "id", "shard", "stale", "group_size", "p")})
    got = sorted((r["doc_id"] or "", r["keep_id"], r["group_size"], r["kept"]) for r in exact_dedup(df).collect())
    assert got == [("", "a", 4, False), ("a", "a", 4, True), ("a", "a", 4, True), ("b", "a", 4, False), ("c", "c", 2, True), ("c", "c", 2, True)]
    kept = drop_copies(df).collect()
    assert sorted(r["doc_id"] for r in kept) == ["a", "c"] and kept[0].__fields__ == df.columns


def test_keep_after_deletion(spark):
    docs = spark.createDataFrame([(k, "same") for k in range(5)] + [(9, "other")], "doc_id long, text string")
    index = apply_changes(None, key_changes(docs, "doc_id", "text"), shards=4)
    left = docs.filter("doc_id NOT IN (0, 1)")
    index = apply_changes(index, None, key_changes(docs.filter("doc_id IN (0, 1)"), "doc_id", "text").groupBy("key").agg(
        F.sum("refs").alias("refs"), F.min("keep").alias("keep")), shards=4)
    state = {r["refs"]: (r["keep"], r["stale"]) for r in index.collect()}
    assert state == {3: (None, True), 1: (9, False)}
    assert {r["refs"]: r["keep"] for r in settle_keeps(index, left).collect()} == {3: 2, 1: 9}


def test_index_follows_changes(spark):
    rows = [r for r in documents() if r[0] is not None]
    first, second = rows[:80], rows[80:]
    index = apply_changes(None, key_changes(frame(spark, first), "doc_id", "text"), shards=4)
    gone = key_changes(frame(spark, first[:50]), "doc_id", "text")
    index = apply_changes(index, key_changes(frame(spark, second), "doc_id", "text"), gone, shards=4)
    live = {}
    for r in first[50:] + second:
        live[digest(r[1])] = live.get(digest(r[1]), 0) + 1
    assert {bytes(r["key"]).hex(): r["refs"] for r in index.collect()} == live
