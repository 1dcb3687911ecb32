"""Conversation prefix trie by Van Emde Boas recursion (operator 11).

A node of depth d is a distinct sequence of first d turns. The depth range is
cut in half, again and again; all blocks of one size are one Spark round:

* **Cut and name.** The items of a block (lo, lo + 2S] are distinct turn
  sequences below one root. Those that reach the middle are grouped by root
  and digest of their upper half; the least conversation id of a group names
  the cut prefix. Digests of long halves come from a hash tree over chunks of
  64 turns; in smaller blocks an item carries the digests of its turns.
* **Upper trie and lower forests.** The cut prefixes, each once, are the
  items of the upper block; what hangs below a cut prefix is the lower
  block's, with that prefix as its root. Both go on to the next rounds side
  by side. Blocks of size one hold the nodes.
* **Graft.** A node remembers the cut prefixes that it hangs below, at most
  one per round. The total of the forest below each cut prefix is the sum over
  them, and is handed to the nodes on the way from that prefix to its block's
  root, block by block in halves. A conversation of n turns costs O(n) rows
  in each of log n rounds; no list of ancestors is ever made.

Groups are only summed or reduced to their least id before a shuffle; the
join that hands a group's name back to its members is a plain equi-join that
adaptive execution splits at hot keys. Rounds are Parquet tables in the shared
folder. The digest of a node's ids streams over sorted chunks of ids.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sievekit.llm.common import Scratch, stash

#: Turns of a conversation that one row holds (64), as a power of two; beyond that a hash tree takes over.
CHUNK_LEVELS = 6
CHUNK = 1 << CHUNK_LEVELS
#: Conversation ids of one range of this many ids are one piece of a digest's input.
ID_BITS = 9
EMPTY_SHA = hashlib.sha256(b"").hexdigest()
TURN = ("conv_id", "turn", "role", "text")


def _sha(data: Column) -> Column:
    return F.unhex(F.sha2(data, 256))


def _digest_of(digests: Column) -> Column:
    """Digest of a short array of digests in order."""
    return _sha(F.aggregate(digests, F.lit(b""), lambda acc, d: F.concat(acc, d)))


def ordered_turns(conversations: DataFrame, scratch: Scratch) -> tuple[DataFrame, DataFrame]:
    """``(c, pos, dig, bytes)`` per turn and ``(c, n)`` per conversation, positions from 0.

    Positions come from a range partitioning and the counts of its parts, so a
    conversation that holds a third of all rows is ordered by many tasks.
    Order: turn (null first), then the digest of role and text; null role and
    text are empty; rows without a conversation id belong to none.
    """
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    named = F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text)
    rows = conversations.filter("conv_id IS NOT NULL").select(
        F.col("conv_id").cast("long").alias("c"), "turn", _sha(named.cast("binary")).alias("dig"),
        F.octet_length(text).cast("long").alias("bytes"))
    order = ("c", "turn", "dig")
    laid = rows.repartitionByRange(*order).sortWithinPartitions(*order).select(
        "c", "dig", "bytes", F.spark_partition_id().alias("part"), F.monotonically_increasing_id().alias("seq"))
    laid = scratch.put(laid, "turns")
    runs = laid.groupBy("c", "part").agg(F.min("seq").alias("first"), F.count("*").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("c").orderBy("part").rowsBetween(
        Window.unboundedPreceding, -1)), F.lit(0))
    runs = runs.withColumn("before", before)
    turns = laid.join(runs.drop("n"), ["c", "part"]).select(
        "c", (F.col("seq") - F.col("first") + F.col("before")).alias("pos"), "dig", "bytes")
    return turns, runs.groupBy("c").agg(F.sum("n").alias("n"))


def rebuilt_turns(turns: DataFrame, sizes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Every conversation with the first turns of its group's first one in place of its own.

    Conversation c takes the first h turns of conversation c - c % 5, h being
    the CRC-32 of its decimal id modulo 9, then its own turns after the first h.
    """
    convs = sizes.select("c", "n", (F.crc32(F.col("c").cast("string").cast("binary")) % 9).alias("h"),
                         (F.col("c") - F.col("c") % 5).alias("base"))
    heads = sizes.select(F.col("c").alias("base"), F.col("n").alias("base_n"))
    convs = convs.join(heads, "base", "left").withColumn("pre", F.least("h", F.coalesce("base_n", F.lit(0))))
    own = turns.join(convs.select("c", "h", "pre"), "c").filter("pos >= h").select(
        "c", (F.col("pos") - F.col("h") + F.col("pre")).alias("pos"), "dig", "bytes")
    lent = turns.filter("pos < 8").withColumnRenamed("c", "base").join(convs.select("c", "base", "h"), "base").filter(
        "pos < h").select("c", "pos", "dig", "bytes")
    lengths = convs.select("c", (F.col("pre") + F.greatest(F.col("n") - F.col("h"), F.lit(0))).alias("n"))
    return own.unionByName(lent), lengths


class HashTree:
    """Chunks of 64 turns of every conversation, and digests of its aligned blocks of 64, 128, ... turns."""

    def __init__(self, turns: DataFrame, lengths: DataFrame, depth: int, scratch: Scratch) -> None:
        chunk = turns.groupBy("c", F.shiftright("pos", CHUNK_LEVELS).alias("b")).agg(
            F.array_sort(F.collect_list(F.struct("pos", "dig", "bytes"))).alias("x"))
        #: ``c, b, digs, bytes, dig``: at most 64 turns a row.
        self.chunks = scratch.put(chunk.select("c", "b", F.col("x.dig").alias("digs"), F.col("x.bytes").alias("bytes"),
                                               _digest_of(F.col("x.dig")).alias("dig")), "chunks")
        now = self.chunks.select("c", "b", "dig")
        self.levels: dict[int, DataFrame] = {CHUNK_LEVELS: now}
        whole = now.filter("b = 0")
        if depth > CHUNK:
            now = now.join(lengths.filter(F.col("n") > CHUNK).select("c"), "c", "left_semi")
            left, right = (F.max(F.when(F.col("b") % 2 == i, F.col("dig"))) for i in (0, 1))
            for level in range(CHUNK_LEVELS + 1, (depth - 1).bit_length() + 1):
                now = scratch.put(now.groupBy("c", F.shiftright("b", 1).alias("half")).agg(
                    _sha(F.concat(left, F.coalesce(right, F.lit(b"")))).alias("dig")).withColumnRenamed("half", "b"), "tree")
                self.levels[level] = now
            whole = whole.join(now.select("c", F.col("dig").alias("long_dig")), "c", "left").select(
                "c", F.coalesce("long_dig", "dig").alias("dig"))
        #: ``c, n, dig``: length and digest name the whole sequence.
        self.whole = lengths.join(whole.select("c", "dig"), "c", "left").select(
            "c", "n", F.coalesce("dig", F.lit(b"")).alias("dig"))


def _streamed_digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``q, n, w, ends_sha256`` per sequence, from id pieces sorted by sequence and first id."""
    key, sha, first, count, done = None, None, 0, 0, []
    for batch in batches:
        n, dig, ids, least, many = (batch.column(i).to_pylist() for i in range(5))
        for row in zip(n, dig, ids, least, many, strict=True):
            if key != row[:2]:
                if key is not None:
                    done.append((first, key[0], count, sha.hexdigest()))
                key, sha, first, count = row[:2], hashlib.sha256(), row[3], 0
            else:
                sha.update(b",")
            sha.update(row[2].encode())
            count += row[4]
        if len(done) >= 10_000:
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*done, strict=True)], ["q", "n", "w", "ends_sha256"])
            done = []
    if key is not None:
        done.append((first, key[0], count, sha.hexdigest()))
        yield pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*done, strict=True)], ["q", "n", "w", "ends_sha256"])


def distinct_sequences(whole: DataFrame) -> DataFrame:
    """``q, n, w, ends_sha256`` per distinct sequence: least id, length, number and digest of the ids that have it."""
    pieces = whole.groupBy("n", "dig", F.shiftright("c", ID_BITS).alias("range")).agg(
        F.array_sort(F.collect_list("c")).alias("ids"))
    pieces = pieces.select("n", "dig", F.array_join(F.transform("ids", lambda i: i.cast("string")), ",").alias("text"),
                           F.element_at("ids", 1).alias("least"), F.size("ids").cast("long").alias("many"))
    sorted_pieces = pieces.repartition("n", "dig").sortWithinPartitions("n", "dig", "least")
    return sorted_pieces.mapInArrow(_streamed_digests, "q long, n long, w long, ends_sha256 string")


def _due(length: Column, most: int) -> Column:
    """The round that cuts an item of this length: floor(log2), at most ``most``."""
    return F.least(F.length(F.bin(length)) - 1, F.lit(most))


def cut_rounds(sequences: DataFrame, tree: HashTree, least: int, depth: int,
               scratch: Scratch) -> tuple[dict[int, DataFrame], DataFrame]:
    """The recursion down: per round k the items that reach lo + 2^k, and the nodes.

    An item ``lo, root, q, end, w`` is a distinct sequence below the node
    ``root`` of depth lo; q is the least id that has it, w the number of
    conversations it stands for, ``hooks`` the cut prefixes it hangs below. A
    round adds ``name``, the least id that shares the first lo + 2^k turns, and
    ``name_w``. In blocks of 64 turns and less an item carries its turns.
    """
    top = depth.bit_length() - 1
    items = [sequences.filter("n > 0").select(
        F.lit(0).cast("long").alias("lo"), F.lit(least).cast("long").alias("root"), "q", F.col("n").alias("end"), "w",
        F.array().cast("array<struct<k:int,lo:bigint,q:bigint>>").alias("hooks"), _due(F.col("n"), top).alias("due"))]
    rounds: dict[int, DataFrame] = {}
    for k in range(max(top, CHUNK_LEVELS - 1), -1, -1):
        size, near = 1 << k, k < CHUNK_LEVELS
        if k == CHUNK_LEVELS - 1:  # from here on the turns come along
            chunk = tree.chunks.select(F.col("c").alias("q"), (F.col("b") * CHUNK).alias("lo"), "digs", "bytes")
            items = [scratch.put(reduce(DataFrame.unionByName, items).filter(F.col("due") <= k).join(
                chunk, ["q", "lo"]), "items")]
        if k > top:
            continue
        reach = reduce(DataFrame.unionByName, items).filter(F.col("due") == k).drop("due")
        if near:
            keyed = reach.withColumn("dig", _digest_of(F.slice("digs", 1, size)))
        else:
            level = tree.levels[k].select(F.col("c").alias("q"), F.shiftleft("b", k).alias("lo"), "dig")
            keyed = reach.join(level, ["q", "lo"])
        # Written on its own, so that the join's two sides are plain shuffles, which Spark splits at hot keys.
        names = scratch.put(keyed.groupBy("lo", "root", "dig").agg(F.min("q").alias("name"), F.sum("w").alias("name_w")),
                            "names")
        rounds[k] = scratch.put(keyed.join(names, ["lo", "root", "dig"]).drop("dig"), "cut")
        items += [upper_items(rounds[k], k, near).withColumn("due", F.lit(k - 1)),
                  lower_items(rounds[k], k, near).withColumn("due", _due(F.col("end") - F.col("lo"), k - 1))]
    nodes = reduce(DataFrame.unionByName, items[-2:]).select(
        "lo", "root", "q", "w", "hooks", F.get("bytes", F.lit(0)).alias("bytes"))
    return rounds, nodes


def upper_items(cut: DataFrame, k: int, near: bool) -> DataFrame:
    """The cut prefixes, each once: items of the upper blocks."""
    turns = [F.slice(c, 1, 1 << k).alias(c) for c in ("digs", "bytes") if near]
    return cut.filter("q = name").select("lo", "root", "q", (F.col("lo") + (1 << k)).alias("end"),
                                         F.col("name_w").alias("w"), "hooks", *turns)


def lower_items(cut: DataFrame, k: int, near: bool) -> DataFrame:
    """What goes on below a cut prefix: items of the lower blocks."""
    low = F.col("lo") + (1 << k)
    hook = F.struct(F.lit(k).alias("k"), low.alias("lo"), F.col("name").alias("q"))
    turns = [F.slice(c, (1 << k) + 1, 1 << k).alias(c) for c in ("digs", "bytes") if near]
    return cut.filter(F.col("end") > low).select(low.alias("lo"), F.col("name").alias("root"), "q", "end", "w",
                                                 F.concat("hooks", F.array(hook)).alias("hooks"), *turns)


def graft(values: DataFrame, rounds: dict[int, DataFrame], totals: tuple[str, ...], scratch: Scratch) -> DataFrame:
    """``lo, q`` and totals: what all proper descendants of the node q of depth lo + 1 add up to.

    ``values`` has every node's ``hooks`` and own values. The forest that hangs
    below a cut prefix inside its lower block is the sum over the nodes hooked
    there. It counts for every node on the way from that prefix to the root
    of the upper block; each half of that block takes it for its own part.
    """
    add = [F.sum(t).alias(t) for t in totals]
    hung = scratch.put(values.select(F.explode("hooks").alias("hook"), *totals).groupBy(
        F.col("hook.k").alias("k"), F.col("hook.lo").alias("lo"), F.col("hook.q").alias("q")).agg(*add), "hung")
    given: DataFrame | None = None
    for k in sorted(rounds, reverse=True):
        size = 1 << k
        now = hung.filter(F.col("k") == k).select((F.col("lo") - size).alias("lo"), "q", *totals)
        if given is not None:
            met = given.join(rounds[k].select("lo", "q", "name"), ["lo", "q"])
            halves = F.explode(F.array(F.struct(F.col("lo"), F.col("name").alias("q")),
                                       F.struct((F.col("lo") + size).alias("lo"), F.col("q")))).alias("half")
            now = now.unionByName(met.select(halves, *totals).select("half.lo", "half.q", *totals))
        given = now.groupBy("lo", "q").agg(*add)
    return given


def prefix_trie(conversations: DataFrame) -> DataFrame:
    """One row per trie node of the rebuilt conversations: counts, leaves and the tokens (bytes) that sharing saves.

    Columns: ``conv_id`` (least member), ``depth``, ``parent_conv_id``,
    ``n_convs``, ``n_children``, ``n_leaves``, ``saved_tokens``,
    ``ends_sha256``. See ``ordered_turns`` for order and nulls; repeated rows are
    turns of their own, other columns are not read, and ids must be whole
    numbers. An empty table has no node, a table of turnless conversations the
    root alone.
    """
    missing = set(TURN) - set(conversations.columns)
    if missing:
        raise ValueError(f"conversations lack {sorted(missing)}")
    spark = conversations.sparkSession
    scratch = Scratch(spark, "trie")
    laid, sizes = ordered_turns(conversations.select(*TURN), scratch)
    turns, lengths = (scratch.put(t, "rebuilt") for t in rebuilt_turns(laid, sizes))
    count, least, depth = lengths.agg(F.count("*"), F.min("c"), F.max("n")).first()
    tree = HashTree(turns, lengths, depth or 0, scratch)
    sequences = scratch.put(distinct_sequences(tree.whole), "sequences")
    turnless = sequences.filter("n = 0").agg(F.max("ends_sha256")).first()[0] or EMPTY_SHA
    out = ("conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, "
           "saved_tokens long, ends_sha256 string")
    if not count:
        return spark.createDataFrame([], out)
    if not depth:
        return spark.createDataFrame([(least, 0, None, count, 0, 1, 0, turnless)], out)
    rounds, found = cut_rounds(sequences, tree, least, depth, scratch)
    nodes = scratch.put(found, "nodes")
    children = nodes.groupBy(F.col("lo").alias("depth"), F.col("root").alias("q")).agg(F.count("*").alias("n_children"))
    nodes = scratch.put(nodes.withColumn("depth", F.col("lo") + 1).join(children, ["depth", "q"], "left").select(
        "lo", "root", "q", "w", "hooks", F.coalesce("n_children", F.lit(0)).alias("n_children"),
        F.when(F.col("n_children").isNull(), 1).otherwise(0).cast("long").alias("leaf"),
        ((F.col("w") - 1) * F.col("bytes")).alias("saved")), "valued")
    below = graft(nodes.select("hooks", "leaf", "saved"), rounds, ("leaf", "saved"), scratch)
    end_names = reduce(DataFrame.unionByName, [
        cut.filter(F.col("end") == F.col("lo") + (1 << k)).select(F.col("q").alias("seq"), (F.col("end") - 1).alias("lo"),
                                                                  F.col("name").alias("q"))
        for k, cut in rounds.items()])
    ends = sequences.select(F.col("q").alias("seq"), "ends_sha256").join(end_names, "seq")
    # One shuffle brings a node, what it was given and its ends together: each is at most one row per node.
    none = F.lit(None).cast("long")
    parts = [nodes.select("lo", "q", "root", "w", "n_children", "leaf", "saved", F.lit(None).cast("string").alias("ends")),
             below.select("lo", "q", none.alias("root"), none.alias("w"), none.alias("n_children"), "leaf", "saved",
                          F.lit(None).cast("string").alias("ends")),
             ends.select("lo", "q", none.alias("root"), none.alias("w"), none.alias("n_children"), none.alias("leaf"),
                         none.alias("saved"), F.col("ends_sha256").alias("ends"))]
    inner = reduce(DataFrame.unionByName, parts).groupBy("lo", "q").agg(
        *[F.max(c).alias(c) for c in ("root", "w", "n_children", "ends")], *[F.sum(c).alias(c) for c in ("leaf", "saved")])
    inner = inner.select(
        F.col("q").alias("conv_id"), (F.col("lo") + 1).alias("depth"), F.col("root").alias("parent_conv_id"),
        F.col("w").alias("n_convs"), "n_children", F.col("leaf").alias("n_leaves"), F.col("saved").alias("saved_tokens"),
        F.coalesce("ends", F.lit(EMPTY_SHA)).alias("ends_sha256"))
    root = nodes.agg(F.sum((F.col("lo") == 0).cast("long")).alias("n_children"), F.sum("leaf").alias("n_leaves"),
                     F.sum("saved").alias("saved_tokens"))
    root = root.select(
        F.lit(least).cast("long").alias("conv_id"), F.lit(0).cast("long").alias("depth"),
        F.lit(None).cast("long").alias("parent_conv_id"), F.lit(count).cast("long").alias("n_convs"), "n_children",
        "n_leaves", "saved_tokens", F.lit(turnless).alias("ends_sha256"))
    result = stash(inner.unionByName(root), "trie")
    scratch.clear()
    return result
