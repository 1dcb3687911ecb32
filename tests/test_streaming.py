"""Streaming decision summary over several micro-batches equals the batch summary."""

import os
import tempfile

from sievekit.streaming.decisions import batch_summary, start_summary, with_measures


def test_streaming_summary_over_batches(spark):
    base = tempfile.mkdtemp(prefix="stream-")
    codes = spark.createDataFrame([(i, i % 2 if i % 5 else None) for i in range(60)], "eppi_id long, human_code int")
    answers = spark.createDataFrame([(i, f"m{i % 2}", (i // 3) % 2) for i in range(60)],
                                    "eppi_id long, model string, decision_binary int")
    # three files: two halves, then every answer again (repeats must not count)
    answers.filter("eppi_id < 30").coalesce(1).write.parquet(os.path.join(base, "in", "f1"))
    answers.filter("eppi_id >= 30").coalesce(1).write.parquet(os.path.join(base, "in", "f2"))
    answers.coalesce(1).write.parquet(os.path.join(base, "in", "f3"))
    q = start_summary(os.path.join(base, "in", "*"), codes, os.path.join(base, "out"), os.path.join(base, "ck"),
                      max_files_per_trigger=1)
    q.awaitTermination()
    assert len([p for p in q.recentProgress if p["numInputRows"] > 0]) >= 2
    got = {r["model"]: tuple(r)[1:6] for r in spark.read.parquet(os.path.join(base, "out"))
           .select("model", "n", "tp", "fn", "fp", "tn").collect()}
    want = {r["model"]: tuple(r)[1:6] for r in batch_summary(answers, codes)
            .select("model", "n", "tp", "fn", "fp", "tn").collect()}
    assert got == want
    assert set(with_measures(spark.read.parquet(os.path.join(base, "out"))).columns) >= {"recall", "f1"}
