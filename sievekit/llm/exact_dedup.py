"""Exact de-duplication with a sharded cuckoo-filter index (operator 6).

A text's key is the SHA-256 of the text with each run of white space replaced
by one space. Keys are dealt to shards by their first bits; each shard holds a
cuckoo filter (buckets of four 16-bit fingerprints) and a store of its live
keys with the number of rows that hold each. Every fingerprint points to its
place in the store, and there is no other way in: a key whose fingerprint is in
neither of its buckets is new, a hit reads the stored key behind it and
compares. When an insertion finds no room after a bounded number of moves, the
shard doubles its filter and fills it again from the stored keys. Deleting the
last row of a key takes its fingerprint out, so the filter stays right while
documents come and go.

Rows of one key are added up before they are shuffled (one row per key and
task), so a text that a third of all rows share costs a shard no more than
one row per task.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sievekit.llm.common import SPACE_RUN, stash

SLOTS = 4
MAX_MOVES = 200
#: Distinct keys per shard that the number of shards is planned for.
SHARD_KEYS = 50_000


def state_schema(id_type: str) -> str:
    """Columns of an index over ids of this type; ``stale``: the kept row is gone, ``settle_keeps`` finds the next."""
    return f"shard int, key binary, refs long, keep {id_type}, stale boolean"


def text_key(text: Column) -> Column:
    """SHA-256 (lowercase hex) of the text with white space runs as one space; null counts as empty."""
    return F.sha2(F.regexp_replace(F.coalesce(text.cast("string"), F.lit("")), SPACE_RUN, " ").cast("binary"), 256)


class CuckooFilter:
    """Partial-key cuckoo filter over 32-byte keys: 16-bit fingerprints, four to a bucket."""

    def __init__(self, keys: int) -> None:
        buckets = 2
        while buckets * SLOTS * 0.85 < keys:
            buckets *= 2
        self.table = np.zeros((buckets, SLOTS), np.uint16)
        #: Where the store holds the key of each fingerprint.
        self.place = np.zeros((buckets, SLOTS), np.int64)
        self.mask = buckets - 1

    @staticmethod
    def _parts(key: bytes) -> tuple[int, int]:
        return int.from_bytes(key[8:16], "little"), (int.from_bytes(key[16:18], "little") or 1)

    def _other(self, bucket: int, print_: int) -> int:
        return (bucket ^ (print_ * 0x5BD1E995)) & self.mask

    def _places(self, key: bytes) -> tuple[int, int, int]:
        h, print_ = self._parts(key)
        a = h & self.mask
        return a, self._other(a, print_), print_

    def __contains__(self, key: bytes) -> bool:
        a, b, print_ = self._places(key)
        return bool((self.table[a] == print_).any() or (self.table[b] == print_).any())

    def hits(self, key: bytes) -> list[int]:
        """Places in the store that a key with this fingerprint may have."""
        a, b, print_ = self._places(key)
        found = self.place[a][self.table[a] == print_].tolist()
        return found if a == b else found + self.place[b][self.table[b] == print_].tolist()

    def insert(self, key: bytes, place: int = 0) -> bool:
        """False: no room after the bounded number of moves (the caller resizes)."""
        a, b, print_ = self._places(key)
        for at in (a, b):
            free = np.flatnonzero(self.table[at] == 0)
            if len(free):
                self.table[at, free[0]], self.place[at, free[0]] = print_, place
                return True
        at, moved = b, []
        for turn in range(MAX_MOVES):
            slot = (print_ + turn) % SLOTS
            old = int(self.table[at, slot]), int(self.place[at, slot])
            moved.append((at, slot, *old))
            self.table[at, slot], self.place[at, slot] = print_, place
            print_, place = old
            at = self._other(at, print_)
            free = np.flatnonzero(self.table[at] == 0)
            if len(free):
                self.table[at, free[0]], self.place[at, free[0]] = print_, place
                return True
        for at, slot, *old in reversed(moved):  # as it was: no stored key may lose its fingerprint
            self.table[at, slot], self.place[at, slot] = old
        return False

    def delete(self, key: bytes, place: int = 0) -> None:
        a, b, print_ = self._places(key)
        for at in (a, b):
            slot = np.flatnonzero((self.table[at] == print_) & (self.place[at] == place))
            if len(slot):
                self.table[at, slot[0]] = 0
                return
        raise KeyError("key is not in the filter")


class Shard:
    """One shard of the index: the filter and the store of live keys with their rows."""

    def __init__(self, expected: int = 0) -> None:
        self.filter = CuckooFilter(max(expected, 8))
        self.keys: list[bytes | None] = []  # None: a free place
        self.held: list[list] = []  # [refs, keep, stale] of each place
        self.free: list[int] = []
        self.resizes = self.verified = self.false_hits = 0

    def __len__(self) -> int:
        return len(self.keys) - len(self.free)

    def _grow(self) -> None:
        size = len(self.filter.table) * SLOTS
        while True:
            size *= 2
            self.resizes += 1
            self.filter = CuckooFilter(size)
            if all(self.filter.insert(k, at) for at, k in enumerate(self.keys) if k is not None):
                return

    def _at(self, key: bytes) -> int | None:
        for at in self.filter.hits(key):
            self.verified += 1
            if self.keys[at] == key:
                return at
            self.false_hits += 1
        return None

    def find(self, key: bytes) -> list | None:
        """``[refs, keep, stale]`` of a live key."""
        at = self._at(key)
        return None if at is None else self.held[at]

    def add(self, key: bytes, refs: int, keep: object, stale: bool = False) -> None:
        got = self.find(key)
        if got is not None:
            got[0] += refs
            if keep is not None and not got[2] and (got[1] is None or keep < got[1]):
                got[1] = keep
            return
        if self.free:
            at = self.free.pop()
            self.keys[at], self.held[at] = key, [refs, keep, stale]
        else:
            at = len(self.keys)
            self.keys.append(key)
            self.held.append([refs, keep, stale])
        if not self.filter.insert(key, at):
            self._grow()

    def remove(self, key: bytes, refs: int, least: object) -> None:
        """Takes rows of a key out, ``least`` being their least id; an unknown key is no error.

        With the kept row gone and others left, which one is next is not known here: ``keep`` is null and stale.
        """
        at = self._at(key)
        if at is None:
            return
        got = self.held[at]
        got[0] -= refs
        if got[0] <= 0:
            self.filter.delete(key, at)
            self.keys[at], self.held[at] = None, []
            self.free.append(at)
        elif least is not None and got[1] == least:
            got[1], got[2] = None, True

    def rows(self, shard: int, id_type: pa.DataType) -> pa.Table:
        live = [(k, *v) for k, v in zip(self.keys, self.held, strict=True) if k is not None]
        column = lambda i, kind: pa.array([r[i] for r in live], kind)
        return pa.table({"shard": pa.array([shard] * len(live), pa.int32()), "key": column(0, pa.binary()),
                         "refs": column(1, pa.int64()), "keep": column(2, id_type), "stale": column(3, pa.bool_())})


def _sharded(keys: DataFrame, shards: int) -> DataFrame:
    return keys.withColumn("shard", F.pmod(F.conv(F.hex(F.substring("key", 1, 4)), 16, 10).cast("long"),
                                           F.lit(shards)).cast("int"))


def key_changes(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``key, refs, keep`` per key and scan partition: rows added up where they are read."""
    keys = docs.select(F.col(id_col).alias("id"), F.unhex(text_key(F.col(text_col))).alias("key"))
    return keys.groupBy("key", F.spark_partition_id().alias("p")).agg(
        F.count(F.lit(1)).alias("refs"), F.min("id").alias("keep")).drop("p")


def apply_changes(index: DataFrame | None, added: DataFrame | None, removed: DataFrame | None = None,
                  shards: int = 64) -> DataFrame:
    """The live keys after ``removed`` and then ``added`` (``key, refs, keep``) are applied to ``index``.

    ``index`` is a table of live keys (``state_schema``) made by this function
    with the same number of shards, or None for an empty one. Where the kept
    row of a text was removed and others stay, ``keep`` is null and ``stale``.
    """
    first = added if added is not None else removed
    spark, id_type = first.sparkSession, first.schema["keep"].dataType.simpleString()
    state = state_schema(id_type)
    live = index if index is not None else spark.createDataFrame([], state)

    def kind(df: DataFrame | None, mark: int) -> DataFrame:
        if df is None:
            return live.limit(0).select("shard", "key", "refs", "keep", "stale", F.lit(mark).alias("kind"))
        return _sharded(df, shards).select("shard", "key", "refs", "keep", F.lit(False).alias("stale"), F.lit(mark).alias("kind"))

    events = live.select("shard", "key", "refs", "keep", "stale", F.lit(0).alias("kind")).unionByName(
        kind(removed, 1)).unionByName(kind(added, 2))

    def shard(t: pa.Table) -> pa.Table:
        rows = list(zip(*(t[c].to_pylist() for c in ("kind", "key", "refs", "keep", "stale")), strict=True))
        held = Shard(sum(r[0] != 1 for r in rows))
        for kind, key, refs, keep, stale in sorted(rows, key=lambda r: r[0]):
            if kind == 1:
                held.remove(key, refs, keep)
            else:
                held.add(key, refs, keep, stale)
        return held.rows(t["shard"][0].as_py(), t.schema.field("keep").type)

    return events.groupBy("shard").applyInArrow(shard, state)


def settle_keeps(index: DataFrame, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``index`` with the least live id of every stale key, found in the live rows ``docs``."""
    stale = index.filter("stale").select("key")
    found = key_changes(docs, id_col, text_col).join(stale, "key", "left_semi").groupBy("key").agg(F.min("keep").alias("next"))
    met = index.join(found, "key", "left")
    return met.select("shard", "key", "refs", F.when(F.col("stale"), F.col("next")).otherwise(F.col("keep")).alias("keep"),
                      F.lit(False).alias("stale"))


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col, keep_id, group_size, kept, text_sha256`` for every row of ``docs``.

    Texts are equal when they are identical after each run of white space
    is replaced by one space; null counts as empty. Of equal texts the row
    with the least id is kept. Rows that repeat both id and text are kept
    alike (``group_size`` counts them all); a null id is never the least, and
    a group of null ids alone keeps them. Ids may be numbers or texts. An empty table gives an empty
    result; other columns are not read.
    """
    added = stash(key_changes(docs, id_col, text_col), "keys")
    shards = max(16, -(-added.count() // SHARD_KEYS))
    live = apply_changes(None, added, shards=shards).select("key", "refs", "keep")
    rows = docs.select(F.col(id_col).alias("id"), F.unhex(text_key(F.col(text_col))).alias("key"))
    out = rows.join(live, "key").withColumn("kept", F.col("id").eqNullSafe(F.col("keep")))
    return out.select(F.col("id").alias(id_col), F.col("keep").alias("keep_id"), F.col("refs").alias("group_size"),
                      "kept", F.lower(F.hex("key")).alias("text_sha256"))


def drop_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that :func:`exact_dedup` keeps, with all their columns.

    Exactly one row stays per text, also where rows repeat id and text (ids
    that occur once, the usual case, need no second look).
    """
    copies = exact_dedup(docs, id_col, text_col).filter(~F.col("kept")).select(
        F.col(id_col).alias("__id"), F.col("text_sha256").alias("__sha"))
    again = stash(docs.groupBy(F.col(id_col).alias("__id")).agg(F.count(F.lit(1)).alias("__n")).filter(
        "__n > 1").drop("__n"), "repeated")
    gone = stash(copies.select("__id").distinct(), "copies")
    same = lambda d: F.col(id_col).eqNullSafe(d["__id"])
    if again.isEmpty():
        return docs.join(gone, same(gone), "left_anti")
    once = docs.join(gone.unionByName(again).distinct().alias("g"), F.col(id_col).eqNullSafe(F.col("g.__id")), "left_anti")
    many = docs.join(again, same(again), "left_semi").withColumn("__key", text_key(F.col(text_col)))
    left = many.join(copies, same(copies) & (F.col("__key") == F.col("__sha")), "left_anti")
    return once.unionByName(left.dropDuplicates(["__key"]).drop("__key"))
