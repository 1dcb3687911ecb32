"""Hard-negative mining by Fagin's threshold algorithm (operator 13).

Vectors are whole numbers per dimension; a score is an integer inner product.
All rows are dealt into blocks by a hash of their id. A block holds, for every
dimension, its rows sorted by that component. An anchor reads the lists of the
dimensions where it is not zero, from the top where its own component is
positive and from the bottom where it is negative (sorted access), and scores
each new row in full (random access). No row that has not been read can score
above the threshold, the inner product with the components where the lists
stand; an anchor stops in a block once the threshold is strictly below the
k-th score of each of its windows there, or below a window's lower bound.
Ties go to the smaller id, so an equal threshold reads on.

Two passes run this way: the best rows of the anchor's label give its
positives, each positive's score a window for the rows of other labels. What
the blocks return, at most k rows per window, is ranked once more over all
blocks. Anchors (a stated share of the rows) stream past the blocks; a task
holds one block and one Arrow batch of anchors at a time.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sievekit.llm.common import Scratch, stash

#: Rows of one block; the number of blocks follows the table.
BLOCK_ROWS = 4096
#: Blocks that a small table is dealt into at least (for parallel work).
LEAST_BLOCKS = 12
#: List entries per dimension that the first step of sorted access reads; each later step doubles the depth.
FIRST_DEPTH = 8
SCALE = 256
#: Below this bound sums of products are exact in doubles.
EXACT = 1 << 53

Scored = list[tuple[int, int]]


def integer_vectors(rows: DataFrame, id_col: str, label: Column, vector_col: str) -> DataFrame:
    """``id, label, vec`` of the rows that take part: one per id, components floor(256 x).

    A row takes no part if its id, label or vector is null or a component is
    null or not finite. Of several rows with one id the least by label, then
    vector stays.
    """
    vec = F.transform(F.col(vector_col), lambda x: x.cast("double"))
    odd = F.exists(vec, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    whole = F.transform(vec, lambda x: F.floor(x * SCALE).cast("long"))
    kept = rows.select(F.col(id_col).cast("long").alias("id"), label.cast("long").alias("label"),
                       F.when(~odd, whole).alias("vec")).filter("id IS NOT NULL AND label IS NOT NULL AND vec IS NOT NULL")
    return kept.groupBy("id").agg(F.min(F.struct("label", "vec")).alias("x")).select("id", "x.label", "x.vec")


class SortedLists:
    """Rows of one block (or of one label in it) with their per-dimension order."""

    def __init__(self, ids: np.ndarray, labels: np.ndarray, x: np.ndarray) -> None:
        by_id = np.argsort(ids, kind="stable")
        self.ids, self.labels, self.x = ids[by_id], labels[by_id], x[by_id]
        self.order = np.argsort(self.x, axis=0, kind="stable").T.copy()
        self.most = np.abs(self.x).max(axis=0, initial=0).astype(object)
        self.real = self.x.astype(np.float64)

    def scores(self, at: np.ndarray, anchor: np.ndarray) -> np.ndarray:
        """Integer inner products of some rows with the anchor."""
        if int(np.abs(anchor).astype(object) @ self.most) < EXACT:
            return (self.real[at] @ anchor.astype(np.float64)).astype(np.int64)
        return self.x[at].astype(object) @ anchor.astype(object)

    def search(self, anchor: np.ndarray, allowed: np.ndarray, windows: list[tuple[int | None, int | None]],
               k: int) -> list[Scored]:
        """Per window (least score, most score) its first k ``(score, id)`` among the allowed rows."""
        found: list[Scored] = [[] for _ in windows]
        live, n = list(range(len(windows))), len(self.ids)
        dims, rising = np.flatnonzero(anchor > 0), np.flatnonzero(anchor < 0)  # read from the top, from the bottom
        seen = np.zeros(n, bool)
        start, stop = 0, FIRST_DEPTH if len(dims) + len(rising) else n
        while n and live:
            stop = min(stop, n)
            if stop == n:  # the lists end here
                new = ~seen
            else:
                read = np.zeros(n, bool)
                read[self.order[dims, n - stop:n - start]] = True
                read[self.order[rising, start:stop]] = True
                new = read & ~seen
            seen |= new
            at = np.flatnonzero(new & allowed)
            if len(at):
                score = self.scores(at, anchor)
                for w in live:
                    found[w] = self._first(found[w], score, self.ids[at], windows[w], k)
            if stop == n:
                break
            threshold = sum(int(anchor[j]) * int(self.x[self.order[j, at], j])
                            for signed, at in ((dims, n - stop), (rising, stop - 1)) for j in signed)
            live = [w for w in live if not (
                (len(found[w]) == k and threshold < found[w][-1][0])
                or (windows[w][0] is not None and threshold < windows[w][0]))]
            start, stop = stop, stop * 2
        return found

    @staticmethod
    def _first(old: Scored, score: np.ndarray, ids: np.ndarray, window: tuple[int | None, int | None],
               k: int) -> Scored:
        least, most = window
        inside = np.ones(len(score), bool)
        if least is not None:
            inside &= score >= least
        if most is not None:
            inside &= score <= most
        score, ids = score[inside], ids[inside]
        if len(score) > k:  # keeps every tie of the k-th score
            kth = np.partition(score, len(score) - k)[len(score) - k]
            score, ids = score[score >= kth], ids[score >= kth]
        new = [(int(s), int(i)) for s, i in zip(score, ids, strict=True)]
        return sorted(old + new, key=lambda p: (-p[0], p[1]))[:k]


def _matrix(lists: pa.ListArray, width: int) -> np.ndarray:
    """Rows of ``width`` components; a shorter vector is padded with zeros, a longer one is cut (zeros there anyway)."""
    lengths = np.asarray(pa.compute.list_value_length(lists))
    flat = np.asarray(lists.flatten())
    out = np.zeros((len(lists), width), np.int64)
    row = np.repeat(np.arange(len(lists)), lengths)
    col = np.arange(len(flat)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
    out[row[col < width], col[col < width]] = flat[col < width]
    return out


def _column(batches: list[pa.RecordBatch], name: str) -> pa.Array:
    return pa.chunked_array([b.column(name) for b in batches]).combine_chunks()


class Block:
    """The candidates of one block, and the sorted lists made of them."""

    def __init__(self, held: list[pa.RecordBatch]) -> None:
        self.ids, self.labels = (np.asarray(_column(held, c)) for c in ("id", "label"))
        vec = _column(held, "vec")
        self.width = max(len(v) for v in vec) if len(vec) else 0
        self.x = _matrix(vec, self.width)
        self.lists: dict[int | None, SortedLists] = {}

    def of(self, label: int | None) -> SortedLists:
        """Lists of one label's rows, or of all."""
        if label not in self.lists:
            rows = slice(None) if label is None else self.labels == label
            self.lists[label] = SortedLists(self.ids[rows], self.labels[rows], self.x[rows])
        return self.lists[label]


def _by_block(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[Block, pa.RecordBatch]]:
    """Anchor rows with their block; the rows of a block come sorted, its candidates before its anchors."""
    current, held, block = None, [], None
    for batch in batches:
        if not batch.num_rows:
            continue
        number, kind = np.asarray(batch.column("block")), np.asarray(batch.column("kind"))
        edges = np.flatnonzero((np.diff(number) != 0) | (np.diff(kind) != 0)) + 1
        for lo, hi in zip([0, *edges], [*edges, len(number)], strict=True):
            part = batch.slice(lo, hi - lo)
            if number[lo] != current:
                current, held, block = number[lo], [], None
            if kind[lo] == 0:
                held.append(part)
            elif held:
                block = block or Block(held)
                yield block, part


def _dealt(rows: DataFrame, anchors: DataFrame, blocks: int) -> DataFrame:
    """Candidates by block, then every anchor once per block, sorted so that a task needs one block at a time."""
    both = rows.select(F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("int").alias("block"), F.lit(0).alias("kind"), "id",
                       "label", "vec", F.lit(None).cast("array<long>").alias("positives")).unionByName(
        anchors.select(F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"), F.lit(1).alias("kind"), "id",
                       "label", "vec", "positives"))
    return both.repartition(blocks, "block").sortWithinPartitions("block", "kind", "id")


def _positives(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block, part in _by_block(batches):
            out: list[tuple[int, int, int]] = []
            ids, labels = part.column("id").to_pylist(), part.column("label").to_pylist()
            for i, label, a in zip(ids, labels, _matrix(part.column("vec"), block.width), strict=True):
                lists = block.of(label)
                for score, other in lists.search(a, lists.ids != i, [(None, None)], k)[0]:
                    out.append((i, other, score))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out, strict=True)],
                                                 ["anchor_id", "positive_id", "positive_score"])
    return run


def score_window(positive: int, low: int, high: int) -> tuple[int, int]:
    """Least and greatest whole score s with low * positive <= 100 s <= high * positive."""
    return -((-low * positive) // 100), (high * positive) // 100


def _negatives(k: int, low: int, high: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block, part in _by_block(batches):
            out: list[tuple[int, int, int, int]] = []
            columns = (part.column(c).to_pylist() for c in ("id", "label", "positives"))
            for i, label, scores, a in zip(*columns, _matrix(part.column("vec"), block.width), strict=True):
                lists = block.of(None)
                bounds = [score_window(p, low, high) for p in scores]
                for p, first in zip(scores, lists.search(a, lists.labels != label, bounds, k), strict=True):
                    out += [(i, p, score, other) for score, other in first]
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out, strict=True)],
                                                 ["anchor_id", "positive_score", "negative_score", "negative_id"])
    return run


def hard_negatives(rows: DataFrame, anchor: Column, label: Column, id_col: str = "vec_id", vector_col: str = "embedding",
                   n_positives: int = 5, n_negatives: int = 3, low: int = 50, high: int = 95,
                   block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Hard negatives of each anchor's positives: ``anchor_id, positive_id, rank, negative_id, positive_score, negative_score``.

    ``anchor`` and ``label`` are expressions over ``rows``. An anchor's
    positives are its first ``n_positives`` other rows of the same label; a
    positive's negatives are the first ``n_negatives`` rows of other labels
    whose score lies between ``low`` and ``high`` percent of the positive's
    (all, if fewer). Higher scores come first, ties by smaller id.
    ``integer_vectors`` says which rows take part and what repeated rows
    count; shorter vectors are padded with zeros, so an empty one scores 0.
    Scores must fit a long. An empty table gives an empty result; other columns
    are not read.
    """
    spark = rows.sparkSession
    scratch = Scratch(spark, "negatives")
    flagged = rows.select(F.col(id_col), F.col(vector_col), label.alias("__label"), anchor.alias("__anchor"))
    data = scratch.put(integer_vectors(flagged, id_col, F.col("__label"), vector_col), "vectors")
    chosen = flagged.filter("__anchor").select(F.col(id_col).cast("long").alias("id")).distinct()
    anchors = scratch.put(data.join(chosen, "id", "left_semi"), "anchors")
    blocks = max(LEAST_BLOCKS, math.ceil(data.count() / block_rows))
    met = _dealt(data, anchors.withColumn("positives", F.lit(None).cast("array<long>")), blocks).mapInArrow(
        _positives(n_positives), "anchor_id long, positive_id long, positive_score long")
    best = Window.partitionBy("anchor_id").orderBy(F.desc("positive_score"), "positive_id")
    pairs = scratch.put(met.withColumn("n", F.row_number().over(best)).filter(F.col("n") <= n_positives).drop("n"), "pairs")
    wanted = pairs.groupBy(F.col("anchor_id").alias("id")).agg(F.collect_set("positive_score").alias("positives"))
    met = _dealt(data, anchors.join(wanted, "id"), blocks).mapInArrow(
        _negatives(n_negatives, low, high),
        "anchor_id long, positive_score long, negative_score long, negative_id long")
    best = Window.partitionBy("anchor_id", "positive_score").orderBy(F.desc("negative_score"), "negative_id")
    ranked = met.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= n_negatives)
    out = stash(pairs.join(ranked, ["anchor_id", "positive_score"]).select(
        "anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), "negative_id", "positive_score",
        "negative_score"), "hard-negatives")
    scratch.clear()
    return out
