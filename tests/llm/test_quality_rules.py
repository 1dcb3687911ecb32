import math

import xxhash

from pyspark.sql import functions as F
from sievekit.llm.quality_rules import quality_rules, trusted_documents, with_trust
from tests.llm.cases import SCHEMA, WORD, documents, frame

B = 512


def signed(x):
    return x - (1 << 64) if x >= 1 << 63 else x


def buckets(t):
    h = [xxhash.xxh64_intdigest(x.encode(), 42) for x in WORD.findall(t or "")]
    pair = lambda a, b: xxhash.xxh64_intdigest(b.to_bytes(8, "little"), xxhash.xxh64_intdigest(a.to_bytes(8, "little"), 42))
    return [signed(x) % B for x in h + [pair(a, b) for a, b in zip(h, h[1:], strict=False)]]


def statistics(t):
    t = t or ""
    w = WORD.findall(t)
    lines = [x for x in t.split("\n") if WORD.search(x)]
    wins = [tuple(w[i:i + 3]) for i in range(len(w) - 2)]
    many = {x for x in wins if wins.count(x) > 1} if len(wins) < 2000 else {
        x for x, c in __import__("collections").Counter(wins).items() if c > 1}
    covered = {i + k for i, x in enumerate(wins) if x in many for k in range(3)}
    return (len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t), len(lines) - len(set(lines)), len(covered))


def brute(rows, trusted, threshold):
    raw, good = [0] * B, [0] * B
    for r in rows:
        for x in buckets(r[1]):
            raw[x] += 1
    for t in trusted:
        for x in buckets(t):
            good[x] += 1
    nr, nt = sum(raw), sum(good)
    share = [(r + 1) / (nr + B) for r in raw]
    ratio = [round(1e6 * math.log((g + 8 * B * q) / ((nt + 8 * B) * q))) for g, q in zip(good, share, strict=True)]
    out = []
    for r in rows:
        s, x = statistics(r[1]), buckets(r[1])
        failed = s[0] < 50 or 100 * s[4] > 50 * s[0]
        total = sum(ratio[k] for k in x)
        out.append((r[0], *s, failed, len(x), total, not failed and total >= round(threshold * 1e6) * len(x)))
    return sorted(out, key=str)


def test_awkward_rows(spark):
    rows = documents()
    marks = [(r[0], k % 2) for k, r in enumerate(rows) if k % 3] + [(None, 1), (123456789, 1)]
    labels = spark.createDataFrame(marks, "doc_id long, quality int")
    docs = frame(spark, rows)
    good = {m for m, q in marks if q == 1 and m is not None}
    trusted = [r[1] for r in rows if r[0] in good]
    for limit in (2_000_000, 3):  # broadcast or not; a table of its own or a flag
        marked = with_trust(docs, labels, broadcast_rows=limit)
        if limit == 3:
            df = quality_rules(docs, trusted_documents(docs, labels, limit), buckets=B, threshold=-0.05)
        else:
            df = quality_rules(docs, F.col("__trusted"), buckets=B, threshold=-0.05, corpus=marked)
        cols = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "n_grams", "llr_sum", "kept"]
        got = sorted((tuple(r) for r in df.select(*cols).collect()), key=str)
        want = brute(rows, trusted, -0.05)
        assert [x[:8] for x in got] == [x[:8] for x in want]
        assert all(abs(a[8] - b[8]) <= a[7] for a, b in zip(got, want, strict=True))  # at most one millionth per n-gram
    assert df.columns.count("kept") == 1 and df.filter("kept").count() == sum(x[9] for x in got)


def test_clean_texts_are_kept_and_junk_is_not(spark):
    for base, junk_left in (("/root/testdata/sf0.001", 1.0), ("/root/testdata/sf0.01", 0.15)):
        docs, labels = (spark.read.parquet(f"{base}/{t}.parquet") for t in ("documents", "labels"))
        out = quality_rules(docs, trusted_documents(docs, labels)).join(labels, "doc_id", "left").filter("not base_failed")
        n = {(r["quality"], r["kept"]): r["count"] for r in out.groupBy("quality", "kept").count().collect()}
        rate = lambda q, kept: n.get((q, kept), 0) / (n.get((q, True), 0) + n.get((q, False), 0))  # noqa: B023, E731
        assert rate(1, False) == 0 and rate(0, True) <= junk_left
        assert rate(None, False) < 0.2  # texts that taught nothing are not mistaken for junk


def test_empty_and_untrusted(spark):
    docs = spark.createDataFrame([], SCHEMA)
    assert quality_rules(docs, docs).count() == 0
    rows = documents()
    out = quality_rules(frame(spark, rows), docs)
    assert out.filter(F.col("kept") == F.col("base_failed")).count() == 0
