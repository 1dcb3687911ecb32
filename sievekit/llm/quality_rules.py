"""Quality rules: log-likelihood ratio of hashed n-grams (operator 5, native).

Words and word pairs of every text are hashed into a fixed number of buckets.
Two multinomials over the buckets are counted: one over trusted texts, one
over the whole raw corpus; the trusted one is smoothed by the raw one, so that a bucket
without evidence says nothing. A document's score is the mean over its n-grams of
``log p_trusted - log p_raw``; the per-bucket ratios are rounded to whole
millionths, so sums do not depend on order and the threshold decides every
document the same way on every run. Plain text rules come first: a text that
fails them is rejected whatever its score.

Only DataFrame functions are used. The counts leave each task as at most one
row per bucket, the ratio table is one array of ``buckets`` numbers.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sievekit.llm.common import SPACES, stash, text_words

BUCKETS = 1 << 16
#: Mean log ratio (natural, per n-gram) below which a text is rejected.
THRESHOLD = -0.10
#: Weight of the raw distribution in the trusted one, in n-grams per bucket. It is a number of n-grams, not a
#: share: with few trusted texts most buckets say little, so that clean texts of other words are not rejected.
PRIOR = 8
SCALE = 1_000_000
#: Characters counted as symbols.
SYMBOLS = "#*$%&|<>"
MIN_WORDS = 50


def _ngrams(df: DataFrame, buckets: int) -> DataFrame:
    """Add ``hashes`` (64 bits per word) and ``grams``: the 1-based bucket of every word and pair of neighbours."""
    bucket = lambda h: (F.pmod(h, F.lit(buckets)) + 1).cast("int")
    hashed = df.withColumn("hashes", F.transform(text_words(F.col("text")), lambda w: F.xxhash64(w)))
    pairs = F.transform(F.sequence(F.lit(0), F.size("hashes") - 2), lambda i: bucket(F.xxhash64(
        F.get("hashes", i), F.get("hashes", i + 1))))
    ones = F.transform("hashes", lambda h: bucket(h))
    return hashed.withColumn("grams", F.concat(ones, F.when(F.size("hashes") > 1, pairs).otherwise(
        F.array().cast("array<int>"))))


def bucket_counts(texts: DataFrame, text_col: str, buckets: int, trusted: Column | None = None) -> DataFrame:
    """``bucket, r, t``: n-grams of all texts and of the trusted ones by bucket, in one pass.

    Each task sends one row per bucket at most.
    """
    mark = F.coalesce(trusted, F.lit(False)) if trusted is not None else F.lit(False)
    grams = _ngrams(texts.select(F.col(text_col).cast("string").alias("text"), mark.cast("int").alias("mark")), buckets)
    # explode() would add a filter on the array and work out the n-grams twice.
    counts = grams.select("mark", F.explode_outer("grams").alias("bucket")).groupBy("bucket").agg(
        F.count(F.lit(1)).alias("r"), F.sum("mark").alias("t"))
    return counts.filter("bucket is not null")


def bucket_ratios(raw: DataFrame, trusted: DataFrame | Column, text_col: str, buckets: int) -> DataFrame:
    """One row, ``ratios``: per bucket ``log p_trusted - log p_raw`` in millionths."""
    if isinstance(trusted, DataFrame):
        counts = bucket_counts(raw, text_col, buckets).unionByName(bucket_counts(trusted, text_col, buckets).select(
            "bucket", F.lit(0).alias("r"), F.col("r").alias("t")))
    else:
        counts = bucket_counts(raw, text_col, buckets, trusted)
    every = raw.sparkSession.range(1, buckets + 1).select(
        F.col("id").cast("int").alias("bucket"), F.lit(0).alias("r"), F.lit(0).alias("t"))
    both = counts.unionByName(every).groupBy("bucket").agg(F.sum("r").alias("r"), F.sum("t").alias("t"))
    pairs = both.agg(F.sort_array(F.collect_list(F.struct("bucket", "r", "t"))).alias("x"),
                     F.sum("r").alias("nr"), F.sum("t").alias("nt"))
    known = (F.col("nt") > 0) & (F.col("nr") > 0)
    raw_share = lambda x: (x["r"] + 1.0) / (F.col("nr") + buckets)
    weight = float(PRIOR * buckets)
    return pairs.select(F.transform("x", lambda x: F.when(known, F.round(SCALE * F.log(
        (x["t"] + weight * raw_share(x)) / ((F.col("nt") + weight) * raw_share(x))))).otherwise(0.0).cast(
        "int")).alias("ratios"))


def quality_rules(docs: DataFrame, trusted: DataFrame | Column, text_col: str = "text", buckets: int = BUCKETS,
                  threshold: float = THRESHOLD, corpus: DataFrame | None = None) -> DataFrame:
    """``docs`` with ``n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, n_grams,
    llr_sum, llr, kept``; every row stays.

    ``llr`` is the mean log-likelihood ratio per n-gram; ``kept`` is false
    where the base rules fail (under 50 words, or more than half of the words
    in three-word windows that occur twice) or where ``llr`` is below
    ``threshold``. ``trusted`` is a table with the same text column, or a condition on
    ``corpus`` (null: not trusted), which saves a pass; ``corpus`` is the raw corpus,
    by default ``docs``. Null and empty texts
    have zero counts, no ``llr`` and fail the base rules. Without any trusted
    text all ratios are zero and the base rules decide alone. Repeated rows
    are decided alike; an empty table gives an empty result. Columns of
    ``docs`` with the names of result columns are replaced.
    """
    out_names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "n_grams",
                 "llr_sum", "llr", "kept"]
    # One row: the ratio table, written once so that its corpus passes run once.
    ratios = stash(bucket_ratios(docs if corpus is None else corpus, trusted, text_col, buckets), "ratios")
    own = docs.drop(*[c for c in docs.columns if c in out_names and c != text_col])
    df = own.select(F.struct(*own.columns).alias("row"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias(
        "text"))
    df = _ngrams(df, buckets)
    df = df.withColumn("n_words", F.size("hashes").cast("long"))
    # Windows by hash, sorted with their position in the low bits: equal ones are neighbours.
    df = df.withColumn("windows", F.when(F.col("n_words") > 3, F.transform(
        F.sequence(F.lit(0), F.size("hashes") - 3),
        lambda i: F.xxhash64(F.get("hashes", i), F.get("hashes", i + 1), F.get("hashes", i + 2)))))
    df = df.withColumn("low", F.pow(F.lit(2.0), F.ceil(F.log2(
        F.col("n_words") + 1))).cast("long") - 1)
    df = df.withColumn("ranked", F.sort_array(F.transform("windows", lambda h, i: h.bitwiseAND(
        F.bitwise_not("low")).bitwiseOR(i.cast("long")))))
    place = lambda x: x.bitwiseAND(F.col("low")).cast("int")

    def equal(x: Column, y: Column) -> Column:
        return F.coalesce((x.bitwiseXOR(y) <= F.col("low")) & (x.bitwiseXOR(y) >= 0) & (
            F.get("windows", place(x)) == F.get("windows", place(y))), F.lit(False))

    # The positions of windows that have an equal one, sorted again, give the words covered.
    df = df.withColumn("twice", F.sort_array(F.transform(F.filter("ranked", lambda x, i: equal(
        x, F.get("ranked", i - 1)) | equal(x, F.get("ranked", i + 1))), place)))
    df = df.withColumn("lines", F.filter(F.split("text", "\n"), lambda x: F.translate(x, " \t\x0b\x0c\r", "") != ""))
    covered = F.aggregate(F.sequence(F.lit(1), F.size("twice")), F.lit(0).cast("long"), lambda n, i: n + F.least(
        F.lit(3), F.coalesce(F.get("twice", i) - F.get("twice", i - 1), F.lit(3))))
    df = df.select(
        "row", "n_words",
        F.length(F.translate("text", SPACES, "")).cast("long").alias("word_chars"),
        (F.length("text") - F.length(F.translate("text", SYMBOLS, ""))).cast("long").alias("n_symbols"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.when(F.size("twice") > 0, covered).otherwise(0).cast("long").alias("n_repeat_words"),
        F.size("grams").cast("long").alias("n_grams"), "grams")
    scored = df.crossJoin(F.broadcast(ratios)).withColumn("llr_sum", F.aggregate(
        "grams", F.lit(0).cast("long"), lambda n, g: n + F.element_at("ratios", g)))
    # A one-row inline_outer keeps a later filter on the decision from being pushed below, which would work out
    # the arrays a second time for every element.
    scored = scored.select("row", F.inline_outer(F.array(F.struct(*out_names[:5], "n_grams", "llr_sum"))))
    scored = scored.withColumn("llr", F.when(F.col("n_grams") > 0, F.col("llr_sum") / F.col("n_grams") / SCALE))
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    passed = F.col("llr_sum") >= F.lit(round(threshold * SCALE)) * F.col("n_grams")
    scored = scored.withColumn("base_failed", failed).withColumn("kept", ~failed & passed)
    return scored.select("row.*", *[c for c in out_names if c != text_col])


def with_trust(docs: DataFrame, labels: DataFrame, flag: str = "__trusted", broadcast_rows: int = 2_000_000) -> DataFrame:
    """``docs`` with ``flag``: whether ``labels`` calls the document good; the id list is broadcast only while it is short."""
    good = labels.filter("quality = 1").select(F.col("doc_id").alias("__good")).distinct()
    if good.limit(broadcast_rows + 1).count() <= broadcast_rows:
        good = F.broadcast(good)
    return docs.join(good, F.col("doc_id") == F.col("__good"), "left").withColumn(
        flag, F.col("__good").isNotNull()).drop("__good")


def trusted_documents(docs: DataFrame, labels: DataFrame, broadcast_rows: int = 2_000_000) -> DataFrame:
    """Rows of ``docs`` that ``labels`` marks as good."""
    return with_trust(docs, labels, "__trusted", broadcast_rows).filter("__trusted").drop("__trusted")
