"""Binary files of token ids, range-coded in checksummed blocks (operator 9).

Documents are sorted by id over all partitions, encoded, and written as
records. A record holds whole documents: a header, a table of document ids
and lengths, a table of blocks (bytes and CRC-32 of each block's ids) and the
blocks, each coded from an empty model (:mod:`range_coder`), closed by a
CRC-32 of everything before it. A file is a Parquet file with one record per
row, so Spark lists, splits and reads it from any store; a record is decoded
without any other.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sievekit.llm.range_coder import LANES, decode_blocks, encode_blocks
from sievekit.llm.tokens import PieceEncoder, text_runs

VOCABULARY = "word_bpe_49k.json"
END_ID = 1
BLOCK = 1024
RECORD_IDS = LANES * BLOCK
#: Records in one file at most, so that a reader's batch has a bounded size.
RECORDS_PER_FILE = 16
MAGIC = b"TIDB\x01"
_HEAD = struct.Struct("<5sIIQI")


class CorruptRecord(ValueError):
    """A checksum of a record or block does not match."""


def _grouped(ids: np.ndarray, sizes: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    for a in range(0, len(sizes), LANES):
        part = sizes[a:a + LANES]
        rows = np.zeros((len(part), BLOCK), np.uint16)
        flat = ids[a * BLOCK:a * BLOCK + int(part.sum())]
        rows.ravel()[:len(flat)] = flat  # every block but the last is full
        yield rows, part


def _block_sizes(n: int) -> np.ndarray:
    full, rest = divmod(n, BLOCK)
    return np.array([BLOCK] * full + [rest] * (rest > 0), np.int64)


def encode_record(docs: list[int | None], ids: list[np.ndarray]) -> bytes:
    """One record of whole documents; ids must be below 65,536."""
    flat = np.concatenate(ids) if ids else np.zeros(0, np.uint32)
    if len(flat) and flat.max() > 0xFFFF:
        raise ValueError("token ids of this format have 16 bits")
    flat = flat.astype(np.uint16)
    sizes = _block_sizes(len(flat))
    payloads = [p for rows, part in _grouped(flat, sizes) for p in encode_blocks(rows, part)]
    sums = [zlib.crc32(flat[k * BLOCK:(k + 1) * BLOCK]) for k in range(len(sizes))]
    body = b"".join([
        _HEAD.pack(MAGIC, BLOCK, len(docs), len(flat), len(sizes)),
        np.array([d is None for d in docs], np.uint8).tobytes(),
        np.array([0 if d is None else d for d in docs], np.int64).tobytes(),
        np.array([len(x) for x in ids], np.uint64).tobytes(),
        np.array([len(p) for p in payloads], np.uint32).tobytes(), np.array(sums, np.uint32).tobytes(), *payloads])
    return body + struct.pack("<I", zlib.crc32(body))


def decode_record(data: bytes) -> tuple[list[int | None], list[np.ndarray]]:
    """The documents of a record and their ids; raises :class:`CorruptRecord` if a checksum fails."""
    if len(data) < _HEAD.size + 4 or zlib.crc32(data[:-4]) != struct.unpack("<I", data[-4:])[0]:
        raise CorruptRecord("the record's checksum does not match")
    magic, block, n_docs, n_ids, n_blocks = _HEAD.unpack_from(data)
    if magic != MAGIC or block != BLOCK:
        raise CorruptRecord("unknown record format")
    at = _HEAD.size

    def take(kind: type, n: int) -> np.ndarray:
        nonlocal at
        out = np.frombuffer(data, kind, n, at)
        at += out.nbytes
        return out

    missing, docs, lens = take(np.uint8, n_docs), take(np.int64, n_docs), take(np.uint64, n_docs).astype(np.int64)
    bytes_, sums = take(np.uint32, n_blocks).astype(np.int64), take(np.uint32, n_blocks)
    ends = at + np.cumsum(bytes_)
    payloads = [data[e - n:e] for e, n in zip(ends, bytes_, strict=True)]
    sizes = _block_sizes(n_ids)
    parts = []
    for a in range(0, n_blocks, LANES):
        rows = decode_blocks(payloads[a:a + LANES], sizes[a:a + LANES])
        for k, size in enumerate(sizes[a:a + LANES]):
            if zlib.crc32(rows[k, :size].copy()) != sums[a + k]:
                raise CorruptRecord(f"block {a + k}: the checksum of its ids does not match")
        parts.append(rows.ravel()[:int(sizes[a:a + LANES].sum())])
    flat = np.concatenate(parts).astype(np.uint32) if parts else np.zeros(0, np.uint32)
    return ([None if m else int(d) for m, d in zip(missing, docs, strict=True)],
            np.split(flat, np.cumsum(lens)[:-1]) if n_docs else [])


def write_token_files(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text",
                      vocabulary: str = VOCABULARY, end_id: int = END_ID) -> None:
    """Write the ids of all texts to ``path``, in ascending order of id.

    Null and empty texts are the end id alone; null ids come first; repeated
    rows are written each time; an empty table writes no records.
    """
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, part = PieceEncoder.of(vocabulary), TaskContext.get().partitionId()
        seq, at, held, keys, ids = 0, 0, 0, [], []

        def record() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([
                pa.array([part], pa.int32()), pa.array([seq], pa.int32()), pa.array([at], pa.int64()),
                pa.array([held], pa.int64()), pa.array([encode_record(keys, ids)], pa.binary())],
                ["part", "seq", "at", "n_ids", "data"])

        for b in batches:
            texts, names = b.column(1).to_pylist(), b.column(0).to_pylist()
            for run in text_runs(texts):
                for name, x in zip(names[run], encoder.ids(texts[run]), strict=True):
                    keys.append(name)
                    ids.append(np.append(x, np.uint32(end_id)))
                    held += len(x) + 1
                    if held >= RECORD_IDS:
                        yield record()
                        seq, at, held, keys, ids = seq + 1, at + held, 0, [], []
        if keys:
            yield record()

    src = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    ordered = src.repartitionByRange("id").sortWithinPartitions("id")
    coded = ordered.mapInArrow(rows, "part int, seq int, at long, n_ids long, data binary")
    coded.write.option("maxRecordsPerFile", RECORDS_PER_FILE).parquet(path)


def read_token_files(spark: SparkSession, path: str, id_col: str = "doc_id", with_ids: bool = True) -> DataFrame:
    """``id_col, start, n_tokens, ids_crc32`` (and ``ids``) per document, decoded from the files.

    ``start`` counts the ids of all documents before it; the checksum is over
    the ids as little-endian unsigned 32-bit numbers.
    """
    files = spark.read.schema("part int, seq int, at long, n_ids long, data binary").parquet(path)
    totals = files.groupBy("part").agg(F.sum("n_ids").alias("total"))
    upto = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    # One row per writing task.
    base = totals.select(F.col("part").alias("p"), (F.sum("total").over(upto) - F.col("total")).alias("base"))

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for k in range(b.num_rows):
                docs, ids = decode_record(b.column(2)[k].as_py())
                n = np.array([len(x) for x in ids], np.int64)
                out = [pa.array(np.full(len(n), b.column(0)[k].as_py()), pa.int32()), pa.array(docs, pa.int64()),
                       pa.array(b.column(1)[k].as_py() + np.cumsum(n) - n), pa.array(n),
                       pa.array([zlib.crc32(x.astype("<u4")) for x in ids], pa.int64())]
                if with_ids:
                    off = pa.array(np.append(0, np.cumsum(n)), pa.int32())
                    out.append(pa.ListArray.from_arrays(off, pa.array(np.concatenate(ids).astype(np.int32))))
                yield pa.RecordBatch.from_arrays(out, names)

    names = ["part", "id", "at", "n_tokens", "ids_crc32"] + ["ids"] * with_ids
    schema = "part int, id long, at long, n_tokens long, ids_crc32 long" + ", ids array<int>" * with_ids
    found = files.select("part", "at", "data").mapInArrow(rows, schema)
    met = found.join(F.broadcast(base), F.col("part") == F.col("p"))
    return met.select(F.col("id").alias(id_col), (F.col("base") + F.col("at")).alias("start"), *names[3:])
