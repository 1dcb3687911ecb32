"""Helpers shared by the operators of this package."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sievekit.session import scratch_dir

#: The white space of every contract of this package: space and \t \n \v \f \r.
SPACES = " \t\n\x0b\x0c\r"
#: One or more of them, as a regular expression.
SPACE_RUN = r"[ \t-\r]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A driver table by name; the path is only ever read by Spark."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def stash(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once to the shared scratch folder and read it back.

    Cuts the lineage: later reads survive lost executors and nothing is
    computed twice. The files lie below ``spark.checkpoint.dir``.
    """
    path = scratch_dir(df.sparkSession, name)
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.stash_path = path
    return out


def unstash(*frames: DataFrame) -> None:
    """Delete the files of stashed frames that no later plan reads."""
    for df in frames:
        spark = df.sparkSession
        path = spark._jvm.org.apache.hadoop.fs.Path(df.stash_path)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


class Scratch:
    """A folder below the shared one for the tables of one operator call; ``clear`` deletes what was not kept."""

    def __init__(self, spark: SparkSession, name: str) -> None:
        self.spark, self.name, self.held = spark, name, []

    def put(self, df: DataFrame, name: str) -> DataFrame:
        """``stash`` that ``clear`` undoes."""
        out = stash(df, f"{self.name}-{name}")
        self.held.append(out)
        return out

    def clear(self) -> None:
        """Delete all tables put here; call it when no later plan reads them."""
        unstash(*self.held)
        self.held = []


def text_words(text: Column) -> Column:
    """The words of a text (runs of non-space), in order; null or blank: empty array."""
    one = F.trim(F.translate(F.coalesce(text, F.lit("")), "\t\n\x0b\x0c\r", "     "))
    return F.filter(F.split(one, " +"), lambda w: w != "")


def ascii_lower(text: Column) -> Column:
    """``A-Z`` to ``a-z``; every other character as it is."""
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def share_cut(key: Column, seed: int) -> Column:
    """A number in (0, 1) that depends on the key and the seed alone (52 bits of MD5)."""
    bits = F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:"), key.cast("string"))), 1, 13), 16, 10).cast("double")
    return (bits + 0.5) / F.lit(float(1 << 52))
