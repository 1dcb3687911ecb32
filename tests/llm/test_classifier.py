import zlib

import numpy as np
import pyarrow as pa

from sievekit.llm.classifier import FEATURES, IDENTITY, POOLED, classify, text_features
from tests.llm.cases import SCHEMA, documents, frame


def held(i):
    return zlib.crc32(("" if i is None else str(i)).encode()) % 5 == 0


def density(x, mean, cov):
    d = x - mean
    return -0.5 * (np.linalg.slogdet(cov)[1] + np.einsum("ij,jk,ik->i", d, np.linalg.inv(cov), d))


def test_scores_are_those_of_the_formula(spark):
    rows = documents()
    x = text_features(pa.array([r[1] for r in rows], pa.string()))
    marks = {r[0]: k % 2 for k, r in enumerate(rows) if r[0] is not None and k % 5}
    at = [k for k, r in enumerate(rows) if r[0] in marks and not held(r[0])]
    y = np.array([marks[rows[k][0]] for k in at])
    t = x[at]
    cov = [np.cov(t[y == c].T, bias=True) for c in (0, 1)]
    both = sum((y == c).sum() * cov[c] for c in (0, 1)) / len(y)
    logs = []
    for c in (0, 1):
        s = (1 - POOLED) * cov[c] + POOLED * both
        s = (1 - IDENTITY) * s + IDENTITY * np.trace(s) / len(FEATURES) * np.eye(len(FEATURES))
        logs.append(np.log((y == c).mean()) + density(x, t[y == c].mean(0), s))
    want = sorted((r[0] or -1, held(r[0]), round(p, 5)) for r, p in zip(rows, 1 / (1 + np.exp(logs[0] - logs[1])), strict=True))
    labels = spark.createDataFrame([*marks.items(), (10**9, 1), (None, 0), (1, 7), (4, None)], "doc_id long, quality int")
    out = classify(frame(spark, rows), labels).collect()
    got = sorted((r["doc_id"] or -1, r["held_out"], round(r["score"], 5)) for r in out)
    assert [g[:2] for g in got] == [w[:2] for w in want]
    assert all(abs(g[2] - w[2]) < 1e-4 for g, w in zip(got, want, strict=True))
    assert all(r["predicted"] == (r["score"] >= 0.3) and 0 <= r["score"] <= 1 for r in out)


def test_held_out_accuracy(spark):
    base = "/root/testdata/sf0.01"
    docs, labels = (spark.read.parquet(f"{base}/{t}.parquet") for t in ("documents", "labels"))
    out = classify(docs, labels).join(labels, "doc_id").filter("held_out").select("predicted", "quality").collect()
    assert len(out) > 50 and np.mean([r[0] == r[1] for r in out]) > 0.95


def test_empty_and_one_class(spark):
    labels = spark.createDataFrame([(1, 1), (2, 1), (3, 1), (4, 1), (6, 1)], "doc_id long, quality int")
    assert classify(spark.createDataFrame([], SCHEMA), labels).count() == 0
    rows = documents()
    assert {r["score"] for r in classify(frame(spark, rows), labels).collect()} == {1.0}
    assert {r["score"] for r in classify(frame(spark, rows), labels.limit(0)).collect()} == {0.5}
