"""Quality classifier: regularised quadratic discriminant analysis (operator 10).

Every text becomes a short vector of transformed statistics (logs of counts
per word). The labelled training rows give, per class, their number, the sum
of the vectors and the sum of their outer products; tasks send partial sums,
so the fit covers all labelled rows and what reaches the driver has a fixed
size. A class covariance is shrunk towards the pooled one and towards a
multiple of the identity. Its Cholesky factor is worked out once and used for
every document: the score is the logistic function of the difference of the
two log densities plus the log prior odds.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sievekit.llm.common import stash
from sievekit.llm.shingles import text_slices, words_of

FEATURES = ("words", "word_bytes", "symbols", "exclamations", "capitals", "repeats", "stops", "distinct", "digits",
            "lines")
POOLED, IDENTITY = 0.1, 0.02
SHARE = 5  # every fifth id (by hash) is held out
CUT = 0.3

_IS = {name: np.isin(np.arange(256), np.frombuffer(chars, np.uint8)) for name, chars in {
    "symbols": b"#*$%&|<>~^_=+@{}[]\\/", "exclamations": b"!", "stops": b".,;:?", "digits": b"0123456789",
    "lines": b"\n", "capitals": bytes(range(65, 91)), "small": bytes(range(97, 123))}.items()}


def text_features(texts: pa.Array) -> np.ndarray:
    """One row of :data:`FEATURES` per text; null, empty and blank texts have counts of zero."""
    out = np.zeros((len(texts), len(FEATURES)))
    for first, data, off in text_slices(texts):
        rows = len(off) - 1
        h, bounds = words_of(data, off)
        n = np.diff(bounds).astype(float)
        count = {}
        for name, mask in _IS.items():
            run = np.concatenate([[0], np.cumsum(mask[data])])
            count[name] = (run[off[1:]] - run[off[:-1]]).astype(float)
        same = np.concatenate([[0], np.cumsum(np.concatenate([[0], (h[1:] == h[:-1]).astype(int)]))]) if len(h) else \
            np.zeros(1, int)
        lo = np.minimum(bounds[:-1] + 1, bounds[1:])
        repeats = (same[bounds[1:]] - same[lo]).astype(float)
        distinct = np.array([len(np.unique(h[a:b])) for a, b in zip(bounds[:-1], bounds[1:], strict=True)], float)
        solid = np.diff(off) - np.array(count["lines"])
        letters = count["capitals"] + count["small"]
        per = lambda x: np.log((x + 0.5) / (n + 1))
        out[first:first + rows] = np.column_stack([
            np.log1p(n), np.log((solid + 1) / (n + 1)), per(count["symbols"]), per(count["exclamations"]),
            np.log((count["capitals"] + 0.5) / (letters + 1)), per(repeats), per(count["stops"]), per(distinct),
            per(count["digits"]), per(count["lines"])])
    return out


def feature_table(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``id, x`` for every row: the text is read once."""
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        d = len(FEATURES)
        for b in batches:
            x = text_features(b.column(1))
            off = pa.array(np.arange(0, (len(x) + 1) * d, d), pa.int32())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.ListArray.from_arrays(off, pa.array(x.ravel()))],
                                             ["id", "x"])

    src = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    return src.mapInArrow(rows, T.StructType([
        T.StructField("id", src.schema["id"].dataType), T.StructField("x", T.ArrayType(T.DoubleType()))]))


def class_sums(rows: DataFrame) -> DataFrame:
    """``label, place, value`` over ``label, x``: per class the count, the sums and the outer products, laid flat."""
    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        d = len(FEATURES)
        total = {0: np.zeros(1 + d + d * d), 1: np.zeros(1 + d + d * d)}
        for b in batches:
            x = b.column(1).flatten().to_numpy().reshape(-1, d)
            label = b.column(0).to_numpy()
            for c, t in total.items():
                y = x[label == c]
                t += np.concatenate([[len(y)], y.sum(0), (y.T @ y).ravel()])
        for c, t in total.items():
            yield pa.RecordBatch.from_arrays([
                pa.array(np.full(len(t), c), pa.int32()), pa.array(np.arange(len(t)), pa.int32()), pa.array(t)],
                ["label", "place", "value"])

    parts = rows.select(F.col("label").cast("int").alias("label"), "x").mapInArrow(
        sums, "label int, place int, value double")
    return parts.groupBy("label", "place").agg(F.sum("value").alias("value"))


@dataclass(frozen=True)
class Discriminant:
    """Class means, inverses of the Cholesky factors, log determinants and log priors."""

    mean: tuple[np.ndarray, ...]
    whiten: tuple[np.ndarray, ...]
    logdet: tuple[float, ...]
    prior: tuple[float, ...]

    @classmethod
    def fit(cls, sums: dict[int, np.ndarray], pooled: float = POOLED, identity: float = IDENTITY) -> Discriminant | None:
        """None unless both classes have rows."""
        d = len(FEATURES)
        if any(sums.get(c) is None or sums[c][0] < 1 for c in (0, 1)):
            return None
        n = [sums[c][0] for c in (0, 1)]
        mean = [sums[c][1:1 + d] / n[c] for c in (0, 1)]
        cov = [sums[c][1 + d:].reshape(d, d) / n[c] - np.outer(mean[c], mean[c]) for c in (0, 1)]
        both = (n[0] * cov[0] + n[1] * cov[1]) / (n[0] + n[1])
        whiten, logdet = [], []
        for c in (0, 1):
            s = (1 - pooled) * cov[c] + pooled * both
            s = (1 - identity) * s + identity * (max(np.trace(s) / d, 1e-6)) * np.eye(d)
            low = np.linalg.cholesky(s)
            whiten.append(np.linalg.inv(low).T)
            logdet.append(2 * float(np.log(np.diag(low)).sum()))
        return cls(tuple(mean), tuple(whiten), tuple(logdet), tuple(float(np.log(k / sum(n))) for k in n))

    def score(self, x: np.ndarray) -> np.ndarray:
        """P(class 1) by the difference of the Mahalanobis log densities."""
        logs = [self.prior[c] - 0.5 * (self.logdet[c] + (((x - self.mean[c]) @ self.whiten[c]) ** 2).sum(1))
                for c in (0, 1)]
        return 1 / (1 + np.exp(np.clip(logs[0] - logs[1], -700, 700)))


def classify(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text",
             label_col: str = "quality", share: int = SHARE, cut: float = CUT) -> DataFrame:
    """``id_col, held_out, score, predicted`` for every row of ``docs``.

    Rows with a label of 0 or 1 and ``crc32(id as text) mod share <> 0`` train; labels of
    other values, null ids and label rows without a document do not. Null
    and empty texts are scored like any other (all counts zero); repeated rows
    are scored alike; an id with two labels trains with both. Without rows
    of both classes every score is the share of class 1 among the training rows (0.5 without any).
    """
    held = F.pmod(F.crc32(F.coalesce(F.col("id").cast("string"), F.lit("")).cast("binary")), F.lit(share)) == 0
    x = stash(feature_table(docs, id_col, text_col), "features").withColumn("held_out", held)
    marks = labels.select(F.col(id_col).alias("id"), F.col(label_col).alias("label")).filter("label in (0, 1)")
    sums: dict[int, np.ndarray] = {}
    size = 1 + len(FEATURES) + len(FEATURES) ** 2
    for r in class_sums(x.filter(~F.col("held_out")).join(marks, "id").select("label", "x")).collect():
        sums.setdefault(r["label"], np.zeros(size))[r["place"]] = r["value"]
    model = Discriminant.fit(sums)
    n = [float(sums[c][0]) if c in sums else 0.0 for c in (0, 1)]
    flat = n[1] / sum(n) if sum(n) else 0.5

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            v = b.column(2).flatten().to_numpy().reshape(-1, len(FEATURES))
            s = model.score(v) if model else np.full(b.num_rows, flat)
            yield pa.RecordBatch.from_arrays([
                b.column(0), b.column(1), pa.array(s), pa.array((s >= cut).astype(np.int32))],
                [id_col, "held_out", "score", "predicted"])

    return x.select("id", "held_out", "x").mapInArrow(rows, T.StructType([
        T.StructField(id_col, x.schema["id"].dataType), T.StructField("held_out", T.BooleanType()),
        T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType())]))
