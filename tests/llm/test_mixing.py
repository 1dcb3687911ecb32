import hashlib
from collections import Counter

from pyspark.sql import functions as F

from sievekit.llm.mixing import SEED, poisson_inverse, replicate, source_rates
from tests.llm.cases import SCHEMA, documents, frame


def share(key, seed):
    return (int(hashlib.md5(f"{seed}:{key}".encode()).hexdigest()[:13], 16) + 0.5) / (1 << 52)


def test_counts_and_order(spark):
    rows = documents()
    sizes = Counter(r[3] for r in rows)
    goal = {s: n ** 0.5 for s, n in sizes.items()}
    rate = {s: len(rows) * goal[s] / sum(goal.values()) / n for s, n in sizes.items()}
    name = lambda r: "null" if r[0] is None else str(r[0])
    want = Counter()
    for r in rows:
        for c in range(1, poisson_inverse(share(name(r), SEED), rate[r[3]]) + 1):
            want[(r[0], r[1], c, share(f"{name(r)}:{c}", SEED + 1))] += 1
    out = replicate(frame(spark, rows))
    assert out.columns[:4] == ["doc_id", "text", "lang", "source"] and out.columns.count("copies") == 1
    got = out.select("doc_id", "text", "copy", "order_key").withColumn("p", F.spark_partition_id()).collect()
    assert Counter(tuple(r[:4]) for r in got) == want
    keys = [r["order_key"] for r in sorted(got, key=lambda r: r["p"])]
    assert keys == sorted(keys)  # one order over all partitions


def test_given_weights_and_large_rates(spark):
    docs = spark.range(4000).select(F.col("id").alias("doc_id"), F.when(F.col("id") < 3990, "a").otherwise("b").alias("source"))
    out = replicate(docs, weights={"a": 0.25, "b": 0.75})
    n = {r["source"]: r["count"] for r in out.groupBy("source").count().collect()}
    assert abs(n["a"] - 1000) < 150 and abs(n["b"] - 3000) < 250
    cdf = source_rates(docs, "source", F.lit(1), weights={"b": 1.0}, repeat=5).filter("source = 'b'").first()
    assert abs(cdf["rate"] - 2000) < 1e-6 and abs(cdf["cdf"][-1] - 1) < 1e-9
    assert replicate(docs, weights={}).count() == 0


def test_empty(spark):
    assert replicate(spark.createDataFrame([], SCHEMA)).count() == 0


def test_clashing_names(spark):
    docs = spark.createDataFrame([(f"d{k}", "s", 1.0) for k in range(20)], "doc_id string, source string, cdf double").withColumns(
        {c: F.lit(1) for c in ("rate", "size", "goal", "copy", "order_key", "all_size", "all_goal")})
    out = replicate(docs)
    assert out.columns == ["doc_id", "source", "cdf", "size", "goal", "all_size", "all_goal", "rate", "copies", "copy", "order_key"]
    assert out.count() > 0 and {r["cdf"] for r in out.collect()} == {1.0}
