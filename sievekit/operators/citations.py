"""De-duplication of citations on their fields (D4 without abstracts).

Two records are compared by title (edit similarity) and by further fields such
as first author, year, volume, issue and first page. A field agrees, differs,
or, when missing on either side, says nothing. Records merge when their titles
are nearly equal, at least ``min_agree`` fields agree and at most
``max_differ`` differ; near titles with less evidence are doubtful pairs.

Records of near titles are not paired to find this out. For two records that
know certain fields, ``max_differ`` may differ: they have equal values in one of
the parts of their common fields that leave out so many. So a record is offered
with each such part, once for every pattern of known fields that it may meet
(:func:`_ways`), and all records that share an offer are pairs wanted: merges link
them to the least one, doubtful pairs pair their clusters. Records with one and
the same profile are one node. Doubtful pairs are listed whatever the size of a
title block; blocks of more than ``block_pairs`` pairs (a generic title) are also
reported by title with their sizes.
"""

from __future__ import annotations

import json
import math
from functools import reduce
from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sievekit.functions.scalars import normalise_text
from sievekit.operators.dedup import clusters_from_edges, dedup, key_hash
from sievekit.operators.near_titles import near_keys
from sievekit.session import materialize

#: Profiles of a title up to which each meets other titles with its own fields; with more the title meets all near ones.
TITLE_PROFILES = 8


def citation_fields(df: DataFrame) -> dict[str, Column]:
    """Evidence columns of a citation record (those that ``df`` has)."""
    plain = lambda c: F.nullif(F.lower(F.trim(F.col(c).cast("string"))), F.lit(""))
    out = {c: plain(c) for c in ("year", "volume", "issue", "start_page") if c in df.columns}
    if "author" in df.columns:
        out["author"] = normalise_text(F.split(F.get(F.col("author"), 0), ",").getItem(0))
    return out


def _ways(rows: DataFrame, fields: list[str], max_differ: int) -> DataFrame:
    """``own, other, part, agree, differ``: how records that know the fields ``own`` meet those that know ``other``.

    Equal values in the fields ``part`` mean that at least ``agree`` fields agree and at most ``differ`` differ;
    the pair's exact evidence is one of its meetings. Sets of fields are bits. As many rows as
    patterns of known fields allow, whatever the records.
    """
    masks = [r["own"] for r in rows.select("own").distinct().collect()]
    ways = []
    for own in masks:
        for other in masks:
            both = [i for i in range(len(fields)) if (own & other) >> i & 1]
            for n in range(max(0, len(both) - max_differ), len(both) + 1):
                ways += [(own, other, sum(1 << i for i in part), n, len(both) - n) for part in combinations(both, n)]
    names = ["own", "other", "part", "agree", "differ"]
    listed = F.from_json(F.lit(json.dumps([dict(zip(names, w)) for w in ways])), f"array<struct<{', '.join(f'{n}:int' for n in names)}>>")
    return rows.sparkSession.range(1).select(F.inline(listed))


def _offers(rows: DataFrame, names: list[str], ways: DataFrame) -> DataFrame:
    """``rows`` once for each way, with the ``values`` of its part in place of their fields."""
    values = [F.when(F.col("part").bitwiseAND(F.lit(1 << i)) != 0, F.col(n)).alias(n) for i, n in enumerate(names)]
    rest = [c for c in rows.columns if c not in (*names, "own")]
    return rows.join(F.broadcast(ways), "own").select(*rest, *ways.columns, F.struct(F.lit(0), *values).alias("values"))


def _met(near: DataFrame, offers: DataFrame) -> DataFrame:
    """The offers of both titles of each near pair that say the same (``_a``, ``_b``)."""
    met = near.join(_side(offers, "a"), "kid_a").join(_side(offers, "b").withColumnsRenamed(
        {"other_b": "own_a", "own_b": "other_a", "part_b": "part_a", "values_b": "values_a"}).drop("agree_b", "differ_b"),
        ["kid_b", "own_a", "other_a", "part_a", "values_a"])
    return met.withColumnsRenamed({"agree_a": "agree", "differ_a": "differ"})


def _side(df: DataFrame, s: str) -> DataFrame:
    return df.select(*[F.col(c).alias(f"{c}_{s}") for c in df.columns])


def citation_clusters(df: DataFrame, fields: dict[str, Column], key: Column, ordinal: str = "ordinal",
                      t_auto: float = 0.9, t_manual: float = 0.85, min_agree: int = 2, max_differ: int = 1,
                      block_pairs: int = 10_000, links: DataFrame | None = None) -> dict[str, DataFrame]:
    """Clusters of citations by title and fields.

    ``fields`` are named evidence columns, ``key`` the normalised title (null:
    no title, linked by ``links`` alone), ``links`` known edges (``src,
    dst``) such as equal DOIs. Returns ``clusters`` (ordinal, ``cluster_id``),
    ``manual_pairs`` (``src, dst`` cluster ids, ``similarity, agree`` the
    greatest and ``differ`` the least of their near-title pairs with at most
    ``max_differ`` differing fields) and ``oversize`` (``first_a, first_b, n_a,
    n_b, similarity`` of title blocks of more than ``block_pairs`` pairs).
    """
    if min_agree != 2:
        raise ValueError("candidates are met on pairs of fields: min_agree is 2")
    names = sorted(fields)
    base = materialize(df.select(F.col(ordinal).alias("id"), key.alias("key"), *[fields[n].alias(n) for n in names]))
    own = sum((F.when(F.col(n).isNotNull(), 1 << i).otherwise(0) for i, n in enumerate(names)), F.lit(0))
    titled = base.filter("key IS NOT NULL").withColumn("kid", key_hash("key")).withColumn("own", own.cast("int"))
    known = sum((F.when(F.col(n).isNotNull(), 1).otherwise(0) for n in names), F.lit(0))
    profiles = materialize(titled.groupBy("kid", "own", *names).agg(
        F.min("key").alias("key"), F.min("id").alias("pid"), F.count(F.lit(1)).alias("n")))
    same = titled.filter(known >= min_agree).alias("r").join(
        profiles.alias("p"), reduce(lambda x, n: x & F.col(f"r.{n}").eqNullSafe(F.col(f"p.{n}")), names,
                                    F.col("r.kid") == F.col("p.kid")))
    edges = [same.select(F.col("r.id").alias("src"), F.col("p.pid").alias("dst")).filter("src <> dst")]
    if links is not None:
        edges.append(links.select("src", "dst"))
    # A title with many profiles meets all near ones, and so does each one of an oversize block.
    titles = materialize(profiles.groupBy("kid").agg(
        F.min("key").alias("key"), F.min("pid").alias("first"), F.sum("n").alias("n"), F.count(F.lit(1)).alias("profiles")).withColumn(
        "any", (F.col("profiles") > TITLE_PROFILES) | (F.col("n") > math.isqrt(max(0, block_pairs)))))
    few = profiles.join(titles.filter("NOT any").select("kid"), "kid", "left_semi").select("key", *names)
    any_ = titles.filter("any").select("key", *[F.lit(None).cast(base.schema[n].dataType).alias(n) for n in names])
    flagged = few.unionByName(any_).withColumns({"in_left": F.lit(True), "in_right": F.lit(True)})
    near = near_keys(flagged, t_manual, fields=names, max_differ=max_differ).filter("key_a < key_b")
    near = materialize(near.select(key_hash("key_a").alias("kid_a"), key_hash("key_b").alias("kid_b"), "similarity").unionByName(
        titles.filter("n > 1").select(F.col("kid").alias("kid_a"), F.col("kid").alias("kid_b"), F.lit(1.0).alias("similarity"))))
    involved = lambda pairs: pairs.select(F.explode(F.array("kid_a", "kid_b")).alias("kid")).distinct()
    ways = _ways(profiles, names, max_differ)
    # Certain merges: all records that share an offer merge, so each meets the least one only.
    close = near.filter(F.col("similarity") >= t_auto)
    offers = _offers(profiles.join(involved(close), "kid", "left_semi").select("kid", "own", "pid", *names), names,
                     ways.filter(F.col("agree") >= min_agree))
    offer = [c for c in offers.columns if c != "pid"]
    met = materialize(_met(close, offers.groupBy(*offer).agg(F.min("pid").alias("pid"))).select(
        *[f"{c}_a" for c in ("kid", "own", "other", "part", "values", "pid")], "kid_b", "pid_b"))
    ends = met.select(F.col("kid_a").alias("kid"), *[F.col(f"{c}_a").alias(c) for c in ("own", "other", "part", "values")],
                      F.col("pid_a").alias("least")).unionByName(
        met.select(F.col("kid_b").alias("kid"), F.col("other_a").alias("own"), F.col("own_a").alias("other"),
                   *[F.col(f"{c}_a").alias(c) for c in ("part", "values")], F.col("pid_b").alias("least"))).distinct()
    star = offers.join(ends, ["kid", "own", "other", "part", "values"]).select(F.col("pid").alias("src"), F.col("least").alias("dst"))
    edges += [met.select(F.col("pid_a").alias("src"), F.col("pid_b").alias("dst")).filter("src <> dst"), star.filter("src <> dst").distinct()]
    clusters = materialize(clusters_from_edges(base, "id", reduce(DataFrame.unionByName, edges)))
    # Doubtful pairs: the clusters of a shared offer, where it is not one that merges.
    nodes = titled.join(involved(near), "kid", "left_semi").join(clusters.distinct(), "id").select(
        "kid", "own", "cluster_id", *names).distinct()
    open_pairs = []
    for pairs, some in ((close, ways.filter(F.col("agree") < min_agree)), (near.filter(F.col("similarity") < t_auto), ways)):
        open_pairs.append(_met(pairs, _offers(nodes.join(involved(pairs), "kid", "left_semi"), names, some).distinct()).filter(
            "cluster_id_a <> cluster_id_b").select("cluster_id_a", "cluster_id_b", "similarity", "agree", "differ"))
    doubtful = reduce(DataFrame.unionByName, open_pairs).groupBy(
        F.least("cluster_id_a", "cluster_id_b").alias("src"), F.greatest("cluster_id_a", "cluster_id_b").alias("dst")).agg(
        F.max("similarity").alias("similarity"), F.max("agree").alias("agree"), F.min("differ").alias("differ"))
    sizes = titles.select("kid", "first", "n")
    oversize = near.join(_side(sizes, "a"), "kid_a").join(_side(sizes, "b"), "kid_b").filter(
        F.when(F.col("kid_a") == F.col("kid_b"), F.col("n_a") * (F.col("n_a") - 1) / 2).otherwise(
            F.col("n_a") * F.col("n_b")) > block_pairs).select("first_a", "first_b", "n_a", "n_b", "similarity")
    return {"clusters": clusters.withColumnRenamed("id", ordinal), "manual_pairs": doubtful, "oversize": oversize}


def dedup_citations(df: DataFrame, id_col: str = "eppi_id", text: str = "abstract", title: str = "title",
                    ordinal: str = "ordinal", label: str | None = None, fields: dict[str, Column] | None = None,
                    key: Column | None = None) -> dict[str, DataFrame]:
    """D4 for citation records: equal keys, near abstracts and the evidence of the fields in one cluster map.

    The outputs of :func:`~sievekit.operators.dedup.dedup`, with ``title_pairs`` (doubtful by
    title and fields, between final clusters) and ``oversize`` title blocks.
    ``fields`` and ``key`` default to :func:`citation_fields` and the normalised title.
    """
    by_field = citation_clusters(df, fields or citation_fields(df), key if key is not None else normalise_text(title), ordinal)
    edges = by_field["clusters"].select(F.col(ordinal).alias("src"), F.col("cluster_id").alias("dst")).filter("src <> dst")
    out = dedup(df, id_col, text, ordinal, label=label, links=edges)
    to = lambda c: out["clusters"].select(F.col(ordinal).alias(c), F.col("cluster_id").alias(f"__{c}"))
    title_pairs = by_field["manual_pairs"].join(to("src"), "src").join(to("dst"), "dst").filter("__src <> __dst").groupBy(
        F.least("__src", "__dst").alias("src"), F.greatest("__src", "__dst").alias("dst")).agg(
        F.max("similarity").alias("similarity"), F.max("agree").alias("agree"), F.min("differ").alias("differ"))
    return {**out, "title_pairs": title_pairs, "oversize": by_field["oversize"]}
