"""Screening decisions as they arrive (Structured Streaming).

The screening scripts send every record to a model and collect answers as
they come back; the performance summary (E5) is then read off the answers.
Here the answers land as files in a folder and a streaming query keeps the
summary current:

* the first answer per ``(eppi_id, model)`` counts (``dropDuplicates`` with
  its key in the state store; a repeated answer is ignored, as
  ``slice(1, .by = ...)`` does in batch),
* human codes are a static table joined to the stream (stream-static join,
  broadcast when small, shuffled otherwise),
* confusion counts per model are a streaming aggregation; each micro-batch
  writes the complete summary to a table in the shared folder
  (``foreachBatch``), so nothing is collected on the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from sievekit.operators.aggregates import performance

DECISION_SCHEMA = "eppi_id long, model string, decision_binary int"


def decision_stream(spark: SparkSession, folder: str, schema: str = DECISION_SCHEMA,
                    max_files_per_trigger: int | None = None) -> DataFrame:
    """Answers landing as parquet files in ``folder``."""
    r = spark.readStream.schema(schema).format("parquet")
    if max_files_per_trigger:
        r = r.option("maxFilesPerTrigger", max_files_per_trigger)
    return r.load(folder)


def first_answers(stream: DataFrame, key: str = "eppi_id", model: str = "model") -> DataFrame:
    """The first answer per (key, model); later repeats are dropped."""
    return stream.dropDuplicates([key, model])


def running_counts(answers: DataFrame, codes: DataFrame, key: str = "eppi_id", truth: str = "human_code") -> DataFrame:
    """Streaming confusion counts per model (stream-static join with codes)."""
    joined = answers.join(codes.select(key, truth), key, "left")
    return joined.groupBy("model").agg(
        F.count(F.lit(1)).cast("long").alias("n"),
        F.count_if((F.col("decision_binary") == 1) & (F.col(truth) == 1)).cast("long").alias("tp"),
        F.count_if((F.col("decision_binary") == 0) & (F.col(truth) == 1)).cast("long").alias("fn"),
        F.count_if((F.col("decision_binary") == 1) & (F.col(truth) == 0)).cast("long").alias("fp"),
        F.count_if((F.col("decision_binary") == 0) & (F.col(truth) == 0)).cast("long").alias("tn"),
    )


def with_measures(counts: DataFrame) -> DataFrame:
    """Ratios from the counts (same formulas as the batch summary)."""
    tp, fn, fp, tn = (F.col(x) for x in ("tp", "fn", "fp", "tn"))

    def r(num, den):
        return F.try_divide(num.cast("double"), den.cast("double"))

    return counts.withColumns({
        "recall": r(tp, tp + fn), "specificity": r(tn, tn + fp), "precision": r(tp, tp + fp),
        "npv": r(tn, tn + fn), "accuracy": r(tp + tn, tp + tn + fp + fn), "f1": r(2 * tp, 2 * tp + fp + fn),
    })


def start_summary(answers_folder: str, codes: DataFrame, out_table: str, checkpoint: str,
                  trigger_once: bool = True, max_files_per_trigger: int | None = None) -> StreamingQuery:
    """Run the streaming summary; every batch overwrites ``out_table`` (parquet)."""
    spark = codes.sparkSession
    stream = decision_stream(spark, answers_folder, max_files_per_trigger=max_files_per_trigger)
    counts = running_counts(first_answers(stream), codes)

    def sink(batch: DataFrame, _epoch: int) -> None:
        with_measures(batch).write.mode("overwrite").parquet(out_table)

    w = counts.writeStream.outputMode("complete").option("checkpointLocation", checkpoint).foreachBatch(sink)
    w = w.trigger(availableNow=True) if trigger_once else w.trigger(processingTime="10 seconds")
    return w.start()


# Batch twin, for checks: the same summary over a static answers table.
def batch_summary(answers: DataFrame, codes: DataFrame, key: str = "eppi_id") -> DataFrame:
    return performance(answers.dropDuplicates([key, "model"]).join(codes.select(key, "human_code"), key, "left"),
                       ["model"])
