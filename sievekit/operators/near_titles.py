"""Titles that differ by a few characters (D7, and the evidence for D4).

:func:`near_keys` finds all pairs of distinct title keys whose edit similarity
``1 - distance / longer length`` is at least ``t``. Long titles of one language
share so many short grams that posting lists grow with the list and their pairs
with its square, so none are made. Keys are dealt into blocks by length, and
blocks whose lengths allow ``t`` meet in one task. There a key is a sketch of
bits, the parities of its hashed 4-grams (a second occurrence counts as another gram): one edit flips 2 * 4 bits at most, so
pairs that differ in more bits than their lengths allow are ruled out by bit
operations (a folded sketch first, the full one for those that pass), without a
row of their own; the edit distance decides the few others in the same task. A task holds two blocks, whatever the list; a key is shuffled once for
each block that its block meets. The bit tests are all pairs of comparable
lengths, so their number still grows with the square of the list. Where the evidence of fields decides too (``fields`` of
:func:`near_keys`), their codes are compared first and the sketches only of keys that their fields allow to meet.
Titles are met as distinct keys: a title that a third of all records carry is
one key, and :func:`title_link_near` reports its number of records in place of
multiplying rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sievekit.session import materialize

#: Characters of a gram, bits of a sketch per character of the longest key, and words of the full sketch per word of the folded one.
GRAM, BITS, FOLD = 4, 8, 4
#: Below this similarity the sketches rule out too few pairs.
LEAST_SIMILARITY = 0.85
#: Characters and keys of a block (its keys are dealt by hash), keys that one key is tested against at once, and pairs of a batch.
BLOCK_CHARS, BLOCK_KEYS, TILE, BATCH = 8 << 20, 1 << 15, 1 << 12, 1 << 11
SLACK = 1e-9


def _meetings(named: DataFrame, t: float) -> DataFrame:
    """The rows of ``named`` with ``meet, at``: every meeting of two blocks that their block takes part in, and its side."""
    step = math.log(max(1 / t, 1.02)) * (1 + 1e-6)  # lengths that allow t are in one bin or in neighbouring ones
    binned = named.withColumn("bin", F.floor(F.log(F.col("len")) / step).cast("int"))
    most = F.least(F.lit(BLOCK_KEYS), F.greatest(F.lit(1), F.floor(F.lit(BLOCK_CHARS) / F.max("len"))))
    sizes = materialize(binned.groupBy("bin", "l", "r").agg(F.ceil(F.count(F.lit(1)) / most).cast("long").alias("parts")))
    name = F.concat_ws(" ", "bin", "l", "r", "part").alias("block")
    blocks = sizes.select("bin", "l", "r", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"))
    side = lambda s: blocks.select("bin", *[c.alias(f"{n}_{s}") for n, c in (("block", name), ("l", F.col("l")), ("r", F.col("r")))])
    above = side("b").withColumn("own", F.lit(True)).unionByName(
        side("b").withColumn("bin", F.col("bin") - 1).withColumn("own", F.lit(False)))
    met = side("a").join(above, "bin").filter("(NOT own OR block_a <= block_b) AND (l_a AND r_b OR r_a AND l_b)").select(
        "block_a", "block_b", F.concat_ws("/", "block_a", "block_b").alias("meet"))
    part = lambda s, at: met.select(F.col(f"block_{s}").alias("block"), "meet", F.lit(at).alias("at"))
    met = materialize(part("a", 0).unionByName(part("b", 1).join(met.filter("block_a = block_b").select("meet"), "meet", "left_anti")))
    held = binned.join(F.broadcast(sizes), ["bin", "l", "r"]).withColumn("part", F.pmod("sid", "parts")).withColumn("block", name)
    spark = named.sparkSession
    most = max(4 * spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    rest = [c for c in named.columns if c not in ("sid", "len")]
    return held.join(F.broadcast(met), "block").select("meet", "at", *rest).repartition(
        max(1, min(met.count(), most)), "meet")


def _sketches(keys: list[str], words: int) -> np.ndarray:
    """``words`` x key: the parities of the hashed grams of each key, a gram's every occurrence being one of its own."""
    lens = np.array([len(k) for k in keys])
    chars = np.frombuffer("".join(keys).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    out = np.zeros((words, len(keys)), np.uint64)
    if len(chars) >= GRAM:
        hashed = np.zeros(len(chars) - GRAM + 1, np.uint64)
        for i in range(GRAM):
            hashed = (hashed + chars[i:len(chars) - GRAM + 1 + i] + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
            hashed ^= hashed >> np.uint64(29)
        own = np.repeat(np.arange(len(keys)), lens)
        whole = own[:len(hashed)] == own[GRAM - 1:]  # grams within one key
        hashed, own = hashed[whole], own[:len(hashed)][whole]
        # Key and the first 40 bits of the gram's hash in one number (a task holds fewer than 2^24 keys).
        hashed = np.sort(own.astype(np.uint64) << np.uint64(40) | hashed >> np.uint64(24))
        place = np.arange(len(own))
        new = np.append(True, hashed[1:] != hashed[:-1])[:len(own)]
        own, hashed = (hashed >> np.uint64(40)).astype(np.int64), hashed & np.uint64((1 << 40) - 1)
        nth = (place - np.maximum.accumulate(np.where(new, place, 0))).astype(np.uint64)
        bit = (hashed + nth * np.uint64(0xC2B2AE3D27D4EB4F)) * np.uint64(0xD6E8FEB86659FD93)
        bit = (bit ^ (bit >> np.uint64(32))) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(20) & np.uint64(64 * words - 1)
        np.bitwise_xor.at(out, ((bit >> np.uint64(6)).astype(np.int64), own), np.uint64(1) << (bit & np.uint64(63)))
    return out


def _places(key: str) -> dict[str, int]:
    """Where each character stands, as bits."""
    out: dict[str, int] = {}
    for i, c in enumerate(key):
        out[c] = out.get(c, 0) | 1 << i
    return out


def _distance(places: dict[str, int], m: int, other: str, most: int) -> int | None:
    """Edit distance of a key of ``m`` characters to ``other`` if it is at most ``most``.

    Bits stand for a column of the table (Myers 1999); a column that leaves too few characters to come down ends it.
    """
    mask, top = (1 << m) - 1, 1 << (m - 1)
    up, down, score, spare = mask, 0, m, most + len(other)
    for c in other:
        eq = places.get(c, 0)
        side = (((eq & up) + up) ^ up) | eq
        more, less = down | ((side | up) & mask ^ mask), up & side
        score += bool(more & top) - bool(less & top)
        spare -= 1
        if score > spare:
            return None
        more, less = more << 1 | 1, less << 1
        eq |= down
        up, down = (less | ((eq | more) & mask ^ mask)) & mask, more & eq & mask
    return score


class _Allowed:
    """Which keys of side b do not differ in more than ``most`` known fields from a key of side a."""

    def __init__(self, rows: pa.Table, fields: Sequence[str], most: int, first: np.ndarray, order: list[np.ndarray]) -> None:
        """``first``: the first row with the key of each row; ``order``: the first rows of both sides' keys, in their order."""
        self.most = most
        codes = np.stack([rows[f].fill_null(0).to_numpy() for f in fields], 1)
        known = np.stack([rows[f].is_valid().to_numpy() for f in fields], 1)
        (rows_a, owner_a), (rows_b, owner_b) = (self._held(first, o) for o in order)
        by = sorted(range(len(fields)), key=lambda f: self._equal(codes[rows_b, f], known[rows_b, f]))
        self.codes_a, self.known_a = codes[rows_a][:, by], known[rows_a][:, by]
        self.codes_b, self.known_b = np.ascontiguousarray(codes[rows_b][:, by].T), np.ascontiguousarray(known[rows_b][:, by].T)
        self.from_a, self.from_b = (np.searchsorted(o, np.arange(len(k) + 1)) for o, k in zip((owner_a, owner_b), order))
        self.owner_b, self.single = owner_b, len(owner_b) == len(order[1])

    @staticmethod
    def _equal(codes: np.ndarray, known: np.ndarray) -> float:
        """The share of pairs that a field says nothing against."""
        counts = np.unique(codes[known], return_counts=True)[1]
        share = known.mean() if len(known) else 0.0
        return 1 - share ** 2 * (1 - ((counts / max(1, counts.sum())) ** 2).sum())

    @staticmethod
    def _held(first: np.ndarray, order: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The rows of the keys in ``order`` and each row's place there."""
        rank = np.full(len(first), -1)
        rank[order] = np.arange(len(order))
        rank = rank[first]
        rows = np.argsort(rank, kind="stable")[np.count_nonzero(rank < 0):]
        return rows, rank[rows]

    def places(self, i: int, lo: int, hi: int) -> np.ndarray:
        """Places after ``lo`` of the keys of side b from ``lo`` to ``hi`` that key ``i`` of side a may be near to."""
        start, end = self.from_b[lo], self.from_b[hi]
        rows: list[np.ndarray] = []
        for row in range(self.from_a[i], self.from_a[i + 1]):
            fields = np.flatnonzero(self.known_a[row])
            differ = np.zeros(end - start, np.uint8)
            for f in fields[:self.most + 1]:
                differ += self._differs(row, f, slice(start, end))
            hits = np.flatnonzero(differ <= self.most)
            differ, hits = differ[hits], hits + start
            for f in fields[self.most + 1:]:
                keep = np.flatnonzero((differ := differ + self._differs(row, f, hits)) <= self.most)
                differ, hits = differ[keep], hits[keep]
            rows.append(hits)
        hits = rows[0] if len(rows) == 1 else np.unique(np.concatenate(rows))
        places = self.owner_b[hits] - lo
        return places if self.single else places[np.append(True, places[1:] != places[:-1])[:len(places)]]

    def _differs(self, row: int, f: int, at: slice | np.ndarray) -> np.ndarray:
        return ((self.codes_b[f, at] != self.codes_a[row, f]) & self.known_b[f, at]).view(np.uint8)


def _near(rows: pa.Table, t: float, fields: Sequence[str] = (), most: int = 0) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Places (of side 0, of the other side) in ``rows`` and edit distances of the near pairs.

    With ``fields`` a key may have several rows; its first one stands for it.
    """
    keys, at = rows["key"].to_pylist(), rows["at"].to_numpy()
    seen: dict[str, int] = {}
    first_row = np.array([seen.setdefault(k, i) for i, k in enumerate(keys)])
    own_row = first_row == np.arange(len(keys))
    lens = np.array([len(k) for k in keys])
    words = 1 << max(0, math.ceil(math.log2(lens.max() * BITS / 64)))
    count = np.uint16 if words < 1 << 10 else np.uint32
    alone = not at.any()
    order = [np.flatnonzero(own_row & (at == 0))] * 2 if alone else [np.flatnonzero(own_row & (at == s)) for s in (0, 1)]
    order = [o[np.argsort(lens[o], kind="stable")] for o in order]
    full_a = _sketches([keys[i] for i in order[0]], FOLD * words)
    full_b = full_a if alone else _sketches([keys[i] for i in order[1]], FOLD * words)
    a, b = (np.bitwise_xor.reduce(s.reshape(FOLD, words, -1)) for s in (full_a, full_b))
    full_a, full_b = (np.ascontiguousarray(s.T) for s in (full_a, full_b))
    len_a, len_b = (lens[o] for o in order)
    first = np.searchsorted(len_b, len_a * t - 1)
    last = np.searchsorted(len_b, (len_a + 1) / t, "right")
    fielded = _Allowed(rows, fields, most, first_row, order) if fields else None
    tile = TILE * FOLD if fields else TILE
    some_a, some_b = (np.ascontiguousarray(s.T) for s in (a, b)) if fields else (None, None)
    for i, n in enumerate(len_a.tolist()):
        for lo in range(max(first[i], i + 1) if alone else first[i], last[i], tile):
            hi = min(lo + tile, last[i])
            fit = fielded.places(i, lo, hi) if fields else np.arange(hi - lo)
            if len(fit) * FOLD < hi - lo:  # few are left: each by itself
                differ = np.bitwise_count(some_b[lo + fit] ^ some_a[i]).sum(1, dtype=np.int64)
            else:
                differ = np.zeros(hi - lo, count)
                for w in range(words):
                    differ += np.bitwise_count(b[w, lo:hi] ^ a[w, i])
                differ = differ[fit]
            longer = np.maximum(len_b[lo + fit], n)
            allowed = np.floor(longer * (1 - t) + SLACK).astype(np.int64)
            keep = (differ <= 2 * GRAM * allowed) & (np.minimum(len_b[lo + fit], n) >= longer * t - SLACK)
            fit, allowed = fit[keep], allowed[keep]
            if len(fit):
                differ = np.bitwise_count(full_b[lo + fit] ^ full_a[i]).sum(1, dtype=np.int64)
                keep = differ <= 2 * GRAM * allowed
                fit, allowed = fit[keep], allowed[keep]
            if len(fit):
                own = _places(keys[order[0][i]])
                found = [_distance(own, n, keys[order[1][lo + f]], int(k)) for f, k in zip(fit, allowed)]
                fit = fit[[d is not None for d in found]]
                yield np.full(len(fit), order[0][i]), order[1][lo + fit], np.array([d for d in found if d is not None], np.int64)


def _batched(found: Iterator[tuple[np.ndarray, ...]]) -> Iterator[tuple[np.ndarray, ...]]:
    """The same rows, about ``BATCH`` at a time."""
    held: list[tuple[np.ndarray, ...]] = []
    for some in found:
        held.append(some)
        if sum(len(x[0]) for x in held) >= BATCH:
            yield tuple(np.concatenate(p) for p in zip(*held))
            held = []
    if held:
        yield tuple(np.concatenate(p) for p in zip(*held))


def near_keys(keys: DataFrame, t: float = 0.9, left: str = "in_left", right: str = "in_right", fields: Sequence[str] = (),
              max_differ: int = 0) -> DataFrame:
    """``key_a, key_b, similarity`` of all keys of the left side and different keys of the right side.

    ``keys`` holds ``key`` (distinct, not null) and two flags that say on which sides a key
    stands. With both sides the same table each pair comes in both orders.
    With ``fields`` a key may have several rows, one for each set of values that it stands with, and pairs are left out if
    all their rows differ in more than ``max_differ`` fields (a null differs from nothing).
    """
    if t < LEAST_SIMILARITY:
        raise ValueError(f"t must be at least {LEAST_SIMILARITY}")
    named = materialize(keys.filter(F.length("key") > 0).select(
        "key", F.col(left).alias("l"), F.col(right).alias("r"), F.xxhash64("key").alias("sid"), F.length("key").alias("len"),
        *[F.when(F.col(c).isNotNull(), F.hash(c)).alias(f"f{i}") for i, c in enumerate(fields)]))
    codes = [f"f{i}" for i in range(len(fields))]  # equal hashes of different values only rule out less

    def pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = pa.Table.from_batches(list(batches))
        for x, y, distance in _batched(_near(rows, t, codes, max_differ)):
            a, b = rows.take(x), rows.take(y)
            yield pa.RecordBatch.from_arrays([c.combine_chunks() for c in (a["key"], b["key"], a["l"], a["r"], b["l"], b["r"])] + [
                pa.array(distance)], ["x", "y", "lx", "rx", "ly", "ry", "distance"])

    met = _meetings(named, t).groupBy("meet").applyInArrow(
        pairs, "x string, y string, lx boolean, rx boolean, ly boolean, ry boolean, distance long")
    scored = met.withColumn("similarity", 1 - F.col("distance").cast("double") / F.greatest(F.length("x"), F.length("y")))
    both = F.array(F.when(F.col("lx") & F.col("ry"), F.struct(F.col("x").alias("key_a"), F.col("y").alias("key_b"))),
                   F.when(F.col("rx") & F.col("ly"), F.struct(F.col("y").alias("key_a"), F.col("x").alias("key_b"))))
    return scored.select("similarity", F.explode(F.array_compact(both)).alias("pair")).select("pair.key_a", "pair.key_b", "similarity")


def title_link_near(records: DataFrame, listed: DataFrame, record_key: Column, list_key: Column, id_col: str = "eppi_id",
                    t: float = 0.9) -> DataFrame:
    """Every row of ``listed`` with the record titles that equal or nearly equal its own.

    One row per list row and distinct record title: the columns of
    ``listed``, ``first_id`` (least id with that title), ``n_records`` (rows
    that carry it: a generic title is told by its number, never multiplied)
    and ``similarity``. Rows without a key link to nothing.
    """
    titles = materialize(records.select(record_key.alias("key"), F.col(id_col).alias("__id")).filter("key IS NOT NULL").groupBy(
        "key").agg(F.min("__id").alias("first_id"), F.count(F.lit(1)).cast("long").alias("n_records")))
    wanted = listed.withColumn("__key", list_key).filter("__key IS NOT NULL")
    keys = titles.select("key", F.lit(True).alias("l"), F.lit(False).alias("r")).unionByName(
        wanted.select(F.col("__key").alias("key"), F.lit(False).alias("l"), F.lit(True).alias("r")))
    keys = materialize(keys.groupBy("key").agg(F.max("l").alias("in_left"), F.max("r").alias("in_right")))
    pairs = near_keys(keys, t).unionByName(keys.filter("in_left AND in_right").select(
        F.col("key").alias("key_a"), F.col("key").alias("key_b"), F.lit(1.0).alias("similarity")))
    hits = pairs.join(titles, F.col("key_a") == F.col("key")).select("key_b", "first_id", "n_records", "similarity")
    return wanted.join(hits, F.col("__key") == F.col("key_b")).drop("__key", "key_b")
