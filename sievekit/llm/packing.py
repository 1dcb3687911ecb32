"""Packing token ids into fixed-length sequences: concatenate and cut (operator 1).

Pass 1 encodes every document once and writes, per scan partition, the
documents' ids with their start inside the partition. The partitions' token
totals are added up to a global start per partition (a table with one row per
partition). Pass 2 cuts the one long concatenation into fixed windows: a
document that crosses a window's end gives one boundary record per window.
Only the last sequence is shorter than the window.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sievekit.llm.common import stash
from sievekit.llm.tokens import encoder, text_runs

SEQUENCE = 2048
END_ID = 1
VOCABULARY = "byte_bpe_50k.json"


def encoded_documents(docs: DataFrame, id_col: str, text_col: str, vocabulary: str, end_id: int) -> DataFrame:
    """``part, at, doc, ids``: every row's ids and end id, and its start in its partition."""
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens, part, at = encoder(vocabulary), TaskContext.get().partitionId(), 0
        for b in batches:
            texts = b.column(1).to_pylist()
            for run in text_runs(texts):
                ids = [np.append(x, np.uint32(end_id)) for x in tokens.ids(texts[run])]
                sizes = np.array([len(x) for x in ids], np.int64)
                starts = at + np.cumsum(sizes) - sizes
                at += int(sizes.sum())
                off = pa.array(np.append(0, np.cumsum(sizes)), pa.int32())
                yield pa.RecordBatch.from_arrays([
                    pa.array(np.full(len(ids), part), pa.int32()), pa.array(starts),
                    b.column(0).slice(run.start, len(ids)),
                    pa.ListArray.from_arrays(off, pa.array(np.concatenate(ids).view(np.int32)))],
                    ["part", "at", "doc", "ids"])

    src = docs.select(F.col(id_col).alias("doc"), F.col(text_col).cast("string").alias("text"))
    schema = T.StructType([
        T.StructField("part", T.IntegerType()), T.StructField("at", T.LongType()),
        T.StructField("doc", src.schema["doc"].dataType), T.StructField("ids", T.ArrayType(T.IntegerType()))])
    return src.mapInArrow(rows, schema)


def pack(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = SEQUENCE,
         vocabulary: str = VOCABULARY, end_id: int = END_ID) -> DataFrame:
    """Pieces of all rows of ``docs`` in sequences of ``length`` ids, one row per piece.

    ``id_col, start, length, ids_crc32, doc_tokens, sequence_id, offset,
    padded_length, ids``: the piece holds the document's ids from ``start``
    on and lies at ``offset`` of its sequence. Rows are packed in the order
    the table is read; every sequence but the last is full, so padding is at
    most ``length - 1`` ids in all (``padded_length`` is the last sequence's
    own length if that is a power of two). Null and empty texts are the end
    id alone; repeated rows are packed each time; an empty table gives no
    pieces; other columns are not read.
    """
    coded = stash(encoded_documents(docs, id_col, text_col, vocabulary, end_id), "encoded")
    totals = coded.groupBy("part").agg(F.max(F.col("at") + F.size("ids")).alias("total"))
    upto = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    # One row per scan partition: bounded by the number of tasks.
    base = totals.select("part", (F.sum("total").over(upto) - F.col("total")).alias("base"),
                         F.sum("total").over(Window.partitionBy()).alias("all"))
    placed = coded.join(F.broadcast(base), "part").select(
        "doc", "ids", (F.col("base") + F.col("at")).alias("at"), "all")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            whole = b.column(1)
            off = whole.offsets.to_numpy()
            values = whole.values.to_numpy()
            at, size = b.column(2).to_numpy(), np.diff(off)
            first, last = at // length, (at + size - 1) // length
            n = last - first + 1
            row = np.repeat(np.arange(b.num_rows), n)
            seq = first[row] + np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
            lo = np.maximum(seq * length, at[row])
            hi = np.minimum((seq + 1) * length, (at + size)[row])
            start = lo - at[row]
            data = values[off[0]:off[-1]]
            cuts = off[row] - off[0] + start
            crc = [zlib.crc32(data[c:c + k]) for c, k in zip(cuts, hi - lo, strict=True)]
            end = b.column(3).to_numpy()[row]
            tail = np.minimum(length, end - seq * length)
            pad = np.where((tail & (tail - 1)) == 0, tail, length)
            yield pa.RecordBatch.from_arrays([
                b.column(0).take(pa.array(row)), pa.array(start), pa.array(hi - lo), pa.array(crc, pa.int64()),
                pa.array(size[row].astype(np.int64)), pa.array(seq), pa.array(lo - seq * length), pa.array(pad),
                pa.ListArray.from_arrays(pa.array(np.append(cuts, len(data)), pa.int32()), pa.array(data))],
                names)

    names = [id_col, "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "padded_length", "ids"]
    longs = [T.StructField(x, T.LongType()) for x in names[1:-1]]
    schema = T.StructType([T.StructField(id_col, coded.schema["doc"].dataType), *longs,
                           T.StructField("ids", T.ArrayType(T.IntegerType()))])
    return placed.mapInArrow(cut, schema)
