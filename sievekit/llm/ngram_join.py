"""N-gram Jaccard self-join by vertical partitioning (operator 2).

The global order of n-grams is cut into fragments. Every document's n-gram
set is cut at the same places, and all segments of one fragment meet in one
task, which knows the exact document frequency of each of its n-grams. A
pair's overlap is the sum of its partial overlaps, one per fragment.

Pairs are looked for without listing all pairs of a group:

1. Documents with the same set are one class; a class is joined once.
2. N-grams of one class only cannot be in an overlap. A class is *active*
   when its rarest ``n - ceil(t n) + 1`` n-grams (its prefix in the order by
   frequency) hold a shared one; only active classes can have a link.
3. Each n-gram of the prefixes is a posting list. A round compares every
   list member with one centre of the list, unless both are already in one
   component. Lists that lie within one component are done.
4. What stays is compared exactly: members outside the largest component of
   their list with every member of another component.

The result is exact: a pair that links shares a prefix n-gram, and a pair is
left out only if its size or the n-gram's position rules it out or both ends
are already connected. Hashes have 64 bits.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sievekit.llm.common import stash, unstash
from sievekit.llm.shingles import shingle_sets
from sievekit.plans.components import connected_components

#: N-grams that one task of the fragment step holds (16 bytes each while it works).
FRAGMENT_TOKENS = 1_500_000
FLUSH_TOKENS = 1_000_000
#: Parts of a document's set that partial overlaps are counted over.
OVERLAP_PARTS = 2
LEAST_FRAGMENTS = 96
STAR_ROUNDS = 6


def _class_key(s: np.ndarray) -> int:
    return int.from_bytes(hashlib.blake2b(s.tobytes(), digest_size=8).digest(), "little", signed=True)


def set_table(docs: DataFrame, id_col: str, text_col: str, n: int) -> DataFrame:
    """``id, n_shingles, cls`` per row; ``cls`` hashes the whole set (null for an empty one)."""
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            size, cls = np.zeros(b.num_rows, np.int64), np.zeros(b.num_rows, np.int64)
            for r, s in shingle_sets(b.column(1), n):
                size[r] = len(s)
                cls[r] = _class_key(s) if len(s) else 0
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array(size), pa.array(cls, mask=size == 0)], ["id", "n_shingles", "cls"])

    src = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    schema = T.StructType([T.StructField("id", src.schema["id"].dataType), T.StructField("n_shingles", T.LongType()),
                           T.StructField("cls", T.LongType())])
    return src.mapInArrow(rows, schema)


def fragment_segments(docs: DataFrame, text_col: str, n: int, fragments: int) -> DataFrame:
    """``frag, tokens, cls, lens``: per fragment, the segments of a run of documents, packed.

    ``tokens`` holds the 64-bit n-gram hashes of ``len(cls)`` segments one
    after the other, ``lens`` their lengths. A task sends each set once.
    """
    def pack(sets: list[np.ndarray], keys: list[int]) -> pa.RecordBatch:
        tok = np.concatenate(sets)
        who = np.repeat(np.arange(len(sets), dtype=np.int64), [len(s) for s in sets])
        frag = ((tok >> np.uint64(32)) * np.uint64(fragments) >> np.uint64(32)).astype(np.int64)
        order = np.argsort(frag, kind="stable")
        tok, seg = tok[order], frag[order] * len(sets) + who[order]
        cut = np.flatnonzero(np.diff(seg, prepend=-1))
        lens = np.diff(cut, append=len(seg))
        seg_frag, seg_key = seg[cut] // len(sets), np.array(keys, np.int64)[seg[cut] % len(sets)]
        first = np.flatnonzero(np.diff(seg_frag, prepend=-1))
        out: list[tuple] = []
        for a, b in zip(first, [*first[1:], len(cut)], strict=True):
            lo, hi = cut[a], cut[b] if b < len(cut) else len(tok)
            out.append((int(seg_frag[a]), tok[lo:hi].tobytes(), seg_key[a:b].tobytes(),
                        lens[a:b].astype(np.uint32).tobytes()))
        cols = list(zip(*out, strict=True))
        return pa.RecordBatch.from_arrays(
            [pa.array(cols[0], pa.int32()), *(pa.array(c, pa.binary()) for c in cols[1:])],
            ["frag", "tokens", "cls", "lens"])

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        sets: list[np.ndarray] = []
        keys: list[int] = []
        held = 0
        for b in batches:
            for _, s in shingle_sets(b.column(0), n):
                if not len(s) or (key := _class_key(s)) in seen:
                    continue
                seen.add(key)
                sets.append(s)
                keys.append(key)
                held += len(s)
                if held >= FLUSH_TOKENS:
                    yield pack(sets, keys)
                    sets, keys, held = [], [], 0
        if sets:
            yield pack(sets, keys)

    return docs.select(F.col(text_col).cast("string").alias("text")).mapInArrow(
        rows, "frag int, tokens binary, cls binary, lens binary")


def shared_tokens(segments: DataFrame) -> DataFrame:
    """``cls, frag, tokens, dfs``: per class and fragment, the n-grams of two or more classes."""
    def one(key: tuple, t: pa.Table) -> pa.Table:
        join = lambda name, kind: np.concatenate([np.frombuffer(x, kind) for x in t[name].to_pylist()])
        tok, cls, lens = join("tokens", np.uint64), join("cls", np.int64), join("lens", np.uint32).astype(np.int64)
        classes, first = np.unique(cls, return_index=True)
        number = np.full(len(cls), -1, np.int64)
        number[first] = np.arange(len(classes))
        who = np.repeat(number, lens)
        tok, who = tok[who >= 0], who[who >= 0]
        order = np.argsort(tok, kind="stable")
        tok, who = tok[order], who[order]
        start = np.flatnonzero(np.concatenate([[True], tok[1:] != tok[:-1]]))
        df = np.repeat(runs := np.diff(start, append=len(tok)), runs)
        tok, who, df = tok[df > 1], who[df > 1], df[df > 1]
        order = np.argsort(who, kind="stable")
        tok, who, df = tok[order], who[order], df[order]
        start = np.flatnonzero(np.diff(who, prepend=-1))
        off = pa.array(np.append(start, len(who)), pa.int32())
        return pa.table({
            "cls": pa.array(classes[who[start]], pa.int64()),
            "frag": pa.array(np.full(len(start), key[0].as_py()), pa.int32()),
            "tokens": pa.ListArray.from_arrays(off, pa.array(tok.view(np.int64))),
            "dfs": pa.ListArray.from_arrays(off, pa.array(df.astype(np.int32)))})

    return segments.groupBy("frag").applyInArrow(one, "cls long, frag int, tokens array<long>, dfs array<int>")


def _may_link(num: int, den: int) -> Column:
    """Size and position bounds of a pair met at one n-gram (columns n, pos and cn, cpos).

    Exact: at the first common n-gram of a pair that links, the n-grams from
    there on must hold the whole overlap.
    """
    size = (F.col("n") * num <= F.col("cn") * den) & (F.col("cn") * num <= F.col("n") * den)
    room = F.least(F.col("n") - F.col("pos"), F.col("cn") - F.col("cpos"))
    return size & (room * (num + den) >= (F.col("n") + F.col("cn")) * num)


def _pairs(met: DataFrame) -> DataFrame:
    swap = F.col("cls") < F.col("ccls")
    return met.select(
        F.when(swap, F.col("cls")).otherwise(F.col("ccls")).alias("a"),
        F.when(swap, F.col("ccls")).otherwise(F.col("cls")).alias("b"),
        F.when(swap, F.col("n")).otherwise(F.col("cn")).alias("na"),
        F.when(swap, F.col("cn")).otherwise(F.col("n")).alias("nb")).distinct()


def verified(pairs: DataFrame, parts: DataFrame, num: int, den: int) -> DataFrame:
    """Pairs whose partial overlaps, summed over the fragments, reach the threshold."""
    left = parts.select(F.col("cls").alias("a"), "part", F.col("tokens").alias("ta"))
    right = parts.select(F.col("cls").alias("b"), "part", F.col("tokens").alias("tb"))
    met = pairs.join(left, "a").join(right, ["b", "part"])
    total = met.withColumn("o", F.size(F.array_intersect("ta", "tb"))).groupBy("a", "b", "na", "nb").agg(
        F.sum("o").alias("overlap"))
    return total.filter(F.col("overlap") * den >= (F.col("na") + F.col("nb") - F.col("overlap")) * num)


def jaccard_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", n: int = 5,
                       percent: int = 75) -> DataFrame:
    """``id_col, n_shingles, component_id, n_class`` for every row of ``docs``.

    Two rows link when ``100 |A n B| >= percent |A u B|`` over their sets of
    distinct ``n``-word shingles (fewer words: the whole sequence is one
    shingle). ``component_id`` is the least id that links reach, the row's
    own id included; ``n_class`` counts the rows with exactly the same set.
    Null, empty and blank texts have an empty set, link with nothing and
    keep their own id. Repeated rows are rows of the same class. An empty
    table gives an empty result. Only the two named columns are read.
    """
    num, den = percent, 100
    sets = stash(set_table(docs, id_col, text_col, n), "sets")
    classes = sets.filter("cls is not null").groupBy("cls").agg(
        F.min("id").alias("rep"), F.max("n_shingles").alias("n"), F.count(F.lit(1)).alias("n_class"))
    total = classes.agg(F.sum("n")).first()[0] or 0
    labels = _linked(docs, text_col, classes.select("cls", "n"), n, num, den, int(total)) if total else None
    reached = classes
    if labels is not None:
        reached = classes.join(labels, "cls", "left")
        reached = reached.withColumn("component", F.coalesce("component", "cls"))
    else:
        reached = reached.withColumn("component", F.col("cls"))
    least = reached.groupBy("component").agg(F.min("rep").alias("component_id"))
    named = reached.join(least, "component").select("cls", "n_class", "component_id")
    out = sets.join(named, "cls", "left")
    return out.select(F.col("id").alias(id_col), "n_shingles",
                      F.coalesce("component_id", "id").alias("component_id"),
                      F.coalesce("n_class", F.lit(1)).alias("n_class"))


def _joined(labels: DataFrame | None, edges: DataFrame) -> DataFrame:
    """``cls, component`` after further edges: components so far are the nodes, so that later rounds stay small."""
    if labels is None:
        return connected_components(edges, "a", "b").withColumnRenamed("node", "cls")
    at = lambda c: labels.select(F.col("cls").alias(c), F.col("component").alias(f"at_{c}"))
    ends = edges.join(at("a"), "a", "left").join(at("b"), "b", "left").select(
        F.coalesce("at_a", "a").alias("a"), F.coalesce("at_b", "b").alias("b")).filter("a <> b").distinct()
    merged = stash(connected_components(ends, "a", "b").select("node", F.col("component").alias("into")), "merged")
    moved = labels.join(merged, F.col("component") == F.col("node"), "left").select(
        "cls", F.coalesce("into", "component").alias("component"))
    fresh = merged.join(labels, F.col("node") == F.col("cls"), "left_anti").select(
        F.col("node").alias("cls"), F.col("into").alias("component"))
    return stash(moved.unionByName(fresh), "labels")


def _linked(docs: DataFrame, text_col: str, classes: DataFrame, n: int, num: int, den: int,
            total: int) -> DataFrame | None:
    """``cls, component`` of the classes with a link (None: there is no link to look for)."""
    fragments = max(LEAST_FRAGMENTS, -(-total // FRAGMENT_TOKENS))
    shared = stash(shared_tokens(fragment_segments(docs, text_col, n, fragments)), "segments")
    # n - common: n-grams that only this class has; they come first in the order by frequency.
    # weight: how common its n-grams are; the most common member of a list is its first centre.
    common = shared.groupBy("cls").agg(F.sum(F.size("tokens")).alias("common"), F.sum(F.aggregate(
        "dfs", F.lit(0.0), lambda w, d: w + F.log2(d.cast("double")))).alias("weight"))
    prefix = F.expr(f"n - (({num} * n + {den - 1}) div {den}) + 1")
    active = stash(classes.join(common, "cls").withColumn("own", F.col("n") - F.col("common"))
                   .withColumn("take", prefix - F.col("own")).filter("take > 0")
                   .withColumn("weight", F.round(F.col("weight") / F.col("n"), 6)), "active")
    kept = shared.join(active, "cls")
    parts = stash(kept.groupBy("cls", (F.col("frag") * OVERLAP_PARTS / fragments).cast("int").alias("part")).agg(
        F.flatten(F.collect_list("tokens")).alias("tokens")), "parts")
    ranked = kept.select("cls", "n", "own", "take", "weight", F.arrays_zip("dfs", "tokens").alias("t")).groupBy(
        "cls", "n", "own", "take", "weight").agg(F.sort_array(F.flatten(F.collect_list("t"))).alias("t"))
    posts = ranked.select("cls", "n", "own", "weight", F.posexplode(F.expr("slice(t, 1, cast(take as int))"))).select(
        F.col("col.tokens").alias("token"), "cls", "n", "weight", (F.col("own") + F.col("pos")).alias("pos"))
    posted = stash(posts, "postings")
    unstash(shared)
    multi = posted.groupBy("token").agg(F.count(F.lit(1)).alias("m")).filter("m > 1").drop("m")
    lists = stash(posted.join(multi, "token"), "lists")
    unstash(posted)
    labels, tested, before = None, None, 0

    def check(pairs: DataFrame) -> None:
        nonlocal labels, tested
        if tested is not None:
            pairs = pairs.join(tested, ["a", "b"], "left_anti")
        pairs = stash(pairs, "pairs")
        found = stash(verified(pairs, parts, num, den).select("a", "b"), "links")
        labels = _joined(labels, found)
        done = pairs.select("a", "b")
        tested = done if tested is None else tested.unionByName(done)

    for turn in range(STAR_ROUNDS + 1):
        if labels is None:
            open_lists = lists.withColumn("comp", F.col("cls"))
        else:
            open_lists = lists.join(labels, "cls", "left").withColumn("comp", F.coalesce("component", "cls")).drop(
                "component")
            open_lists = stash(open_lists, "open")
        per = open_lists.groupBy("token", "comp").agg(F.count(F.lit(1)).alias("m")).groupBy("token").agg(
            F.max_by("comp", "m").alias("big"), F.max("m").alias("top"), F.sum("m").alias("size"),
            F.count(F.lit(1)).alias("comps")).filter("comps > 1")
        left = per.agg(F.sum((F.col("size") - F.col("top")) * F.col("size")), F.sum("size")).first()
        work, rows = int(left[0] or 0), int(left[1] or 0)
        if not rows:
            break
        slow = turn > 0 and 2 * work > before  # the last round did not halve what is open
        before = work
        if work <= 4 * rows or slow or turn == STAR_ROUNDS:
            one = open_lists.join(per.select("token", "big"), "token")
            other = one.select("token", F.col("cls").alias("ccls"), F.col("n").alias("cn"), F.col("pos").alias("cpos"),
                               F.col("comp").alias("ccomp"))
            met = one.filter("comp != big").join(other, "token").filter(
                "comp != ccomp and (ccomp = big or cls < ccls)")
            check(_pairs(met.filter(_may_link(num, den))))
            break
        # First the most common member, then any one outside the list's largest component.
        outer = open_lists if labels is None else open_lists.join(
            per.select("token", "big"), "token").filter("comp != big")
        centre = outer.groupBy("token").agg(F.max_by(
            F.struct("cls", "n", "pos", "comp"),
            F.struct("weight", "cls") if labels is None else F.xxhash64("cls", F.lit(turn))).alias("c")).select(
            "token", F.col("c.cls").alias("ccls"), F.col("c.n").alias("cn"), F.col("c.pos").alias("cpos"),
            F.col("c.comp").alias("ccomp"))
        met = open_lists.join(centre, "token").filter("comp != ccomp")
        check(_pairs(met.filter(_may_link(num, den))))
    return labels
