"""Driver queries of the operators of this package, and their DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sievekit.llm.chat_format import DEFAULT as CHAT
from sievekit.llm.chat_format import format_chats, formatted, loss_text, read_chat
from sievekit.llm.classifier import classify
from sievekit.llm.common import table
from sievekit.llm.exact_dedup import exact_dedup
from sievekit.llm.hard_negatives import hard_negatives
from sievekit.llm.licences import TEMPLATES, scan_licences
from sievekit.llm.lm_score import lm_scores
from sievekit.llm.mixing import SEED, TEMPERATURE, replicate
from sievekit.llm.ngram_join import jaccard_components
from sievekit.llm.packing import pack
from sievekit.llm.prefix_trie import prefix_trie
from sievekit.llm.quality_rules import quality_rules, with_trust
from sievekit.llm.secrets import BASE, scan_secrets, span_digest
from sievekit.llm.token_files import read_token_files, write_token_files
from sievekit.session import scratch_dir

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable:
    def add(fn: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
        QUERIES[name] = fn
        if sql:
            ORACLE[name] = sql
        return fn
    return add


#: A-Z to a-z in DuckDB.
LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
WORD = r"'[^\x20\x09-\x0D]+'"

JACCARD_SQL = f"""
WITH RECURSIVE words AS (
  SELECT doc_id, regexp_extract_all({LOWER.format("coalesce(text, '')")}, {WORD}) AS ws FROM documents),
sets AS (
  SELECT doc_id, CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 5 THEN [array_to_string(ws, ' ')]
    ELSE list_distinct(list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i + 4], ' '))) END AS sh
  FROM words),
grams AS (SELECT doc_id, unnest(sh) AS g FROM sets),
overlap AS (
  SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS o FROM grams x JOIN grams y ON x.g = y.g AND x.doc_id <> y.doc_id
  GROUP BY ALL),
links AS (
  SELECT a, b FROM overlap JOIN sets p ON p.doc_id = a JOIN sets q ON q.doc_id = b
  WHERE 100 * o >= 75 * (len(p.sh) + len(q.sh) - o)),
reach AS (
  SELECT doc_id AS node, doc_id AS seen FROM sets
  UNION SELECT r.node, l.b FROM reach r JOIN links l ON l.a = r.seen)
SELECT doc_id, len(sh)::BIGINT AS n_shingles, min(seen)::BIGINT AS component_id
FROM sets JOIN reach ON node = doc_id GROUP BY doc_id, sh
"""


@query("op2_ngram_jaccard_join", JACCARD_SQL)
def op2_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_components(table(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id")


@query("op1_packing")
def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents")).drop("ids")


def _template_rows() -> str:
    return ", ".join("('{}', '{}')".format(k, v.replace("'", "''")) for k, v in sorted(TEMPLATES.items()))


BIGRAMS = (f"""list_distinct(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]))""")
NORMAL = "list_filter(string_split(regexp_replace(" + LOWER + r", '[^\p{{L}}\p{{N}}]+', ' ', 'g'), ' '), lambda x: x <> '')"
LICENCE_SQL = rf"""
WITH templates(template, body) AS (VALUES {_template_rows()}),
t AS (SELECT template, {BIGRAMS} AS grams, len(w) AS tw
      FROM (SELECT template, {NORMAL.format("body")} AS w FROM templates)),
pieces AS (
  SELECT doc_id, 'text' AS unit, 0 AS part, coalesce(text, '') AS piece FROM documents
  UNION ALL SELECT doc_id, 'paragraph', 0, unnest(regexp_split_to_array(coalesce(text, ''), '\n[ \t\r]*\n')) FROM documents
  UNION ALL SELECT doc_id, 'line', generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1),
    unnest(string_split(coalesce(text, ''), chr(10))) FROM documents),
u AS (SELECT doc_id, unit, part, {BIGRAMS} AS grams
      FROM (SELECT doc_id, unit, part, {NORMAL.format("piece")} AS w FROM pieces) WHERE len(w) > 1),
hits AS (SELECT doc_id, unit, part, template,
         2.0::DOUBLE * len(list_intersect(u.grams, t.grams)) / (len(u.grams) + len(t.grams)) AS score FROM u, t
         WHERE len(u.grams) BETWEEN len(t.grams) * 0.6 AND len(t.grams) * 1.6),
texts AS (SELECT doc_id, w, list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]) AS seq
          FROM (SELECT doc_id, {NORMAL.format("coalesce(text, '')")} AS w FROM documents) WHERE len(w) > 1),
near AS (SELECT doc_id, w, seq, template, tw, t.grams AS tgrams FROM texts, t
         WHERE len(list_intersect(seq, t.grams)) >= 0.4 * len(t.grams)),
begins AS (SELECT *, unnest(list_filter(range(1, len(seq) + 1), lambda i: list_contains(tgrams, seq[i]))) AS i FROM near),
runs AS (SELECT doc_id, template, tgrams, list_distinct(seq[i:i + tw - 2]) AS grams, i FROM begins),
run_hits AS (SELECT doc_id, 'run' AS unit, i AS part, template,
         2.0::DOUBLE * len(list_intersect(grams, tgrams)) / (len(grams) + len(tgrams)) AS score FROM runs),
good AS (SELECT * FROM hits WHERE score >= 0.8 UNION ALL SELECT * FROM run_hits WHERE score >= 0.8),
best AS (SELECT doc_id, first(template ORDER BY score DESC, template) AS template, max(score) AS score,
  count(DISTINCT CASE WHEN unit = 'line' THEN part END) AS n_lines,
  array_to_string(list_sort(list(DISTINCT split_part(template, '/', 1))), ',') AS licences FROM good GROUP BY doc_id)
SELECT doc_id, split_part(template, '/', 1) AS licence, template, round(score, 6) AS score,
  coalesce(n_lines, 0)::BIGINT AS n_lines, coalesce(licences, '') AS licences
FROM documents LEFT JOIN best USING (doc_id)
"""


@query("op3_licence_scan", LICENCE_SQL)
def op3_licence_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_licences(table(spark, sf_dir, "documents"))


@query("op4_secret_scan")
def op4_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found, _ = scan_secrets(table(spark, sf_dir, "documents"))
    base = F.filter("spans", lambda x: x["kind"].isin(*BASE))
    count = lambda kind: F.size(F.filter("spans", lambda x: x["kind"] == kind)).cast("long")
    return found.select("doc_id", *[count(k).alias(f"n_{k}") for k in BASE],
                        F.sha2(span_digest(base), 256).alias("base_sha256"), span_digest(F.col("spans")).alias("spans"))


@query("op5_quality_rules")
def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    scored = quality_rules(docs, F.col("__trusted"), corpus=with_trust(docs, table(spark, sf_dir, "labels")))
    return scored.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
                         "base_failed", "kept", "n_grams", "llr_sum")


DEDUP_SQL = r"""
WITH keyed AS (
  SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS text_sha256 FROM documents)
SELECT doc_id, min(doc_id) OVER (PARTITION BY text_sha256) AS keep_id,
  count(*) OVER (PARTITION BY text_sha256) AS group_size,
  doc_id = min(doc_id) OVER (PARTITION BY text_sha256) AS kept, text_sha256 FROM keyed
"""


@query("op6_exact_dedup", DEDUP_SQL)
def op6_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(table(spark, sf_dir, "documents"))


def _share(key: str, seed: int) -> str:
    return f"((('0x' || md5('{seed}:' || {key})[1:13])::BIGINT + 0.5::DOUBLE) / {1 << 52}::DOUBLE)"


MIXING_SQL = f"""
WITH sizes AS (SELECT source, count(*)::DOUBLE AS size FROM documents GROUP BY source),
rates AS (
  SELECT source, sum(size) OVER () * pow(size, {TEMPERATURE}) / sum(pow(size, {TEMPERATURE})) OVER () / size AS rate
  FROM sizes),
masses AS (
  SELECT source, rate, k, exp(-rate + coalesce(sum(ln(rate / greatest(k, 1))) FILTER (k > 0)
    OVER (PARTITION BY source ORDER BY k), 0)) AS p
  FROM rates, range(0, 200) r(k)),
tables AS (SELECT source, rate, k, sum(p) OVER (PARTITION BY source ORDER BY k) AS cdf FROM masses),
drawn AS (
  SELECT doc_id, d.source, {_share("doc_id", SEED)} AS u FROM documents d),
counted AS (
  SELECT doc_id, d.source, any_value(rate) AS rate, count(*) FILTER (cdf < u) AS copies
  FROM drawn d JOIN tables t ON t.source IS NOT DISTINCT FROM d.source GROUP BY doc_id, d.source),
copied AS (SELECT doc_id, source, rate, copies, unnest(range(1, copies + 1)) AS copy FROM counted WHERE copies > 0)
SELECT doc_id, source, round(rate, 6) AS rate, copies::INTEGER AS copies, copy::INTEGER AS copy,
  {_share("doc_id || ':' || copy", SEED + 1)} AS order_key FROM copied
"""


@query("op7_poisson_mixing", MIXING_SQL)
def op7_poisson_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = replicate(table(spark, sf_dir, "documents"))
    return mixed.select("doc_id", "source", F.round("rate", 6).alias("rate"), "copies", "copy", "order_key")


@query("op10_quality_classifier")
def op10_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query("op9_token_files")
def op9_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_dir(spark, "token-files")
    write_token_files(table(spark, sf_dir, "documents"), path)
    return read_token_files(spark, path, with_ids=False)


@query("op8_lm_score")
def op8_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_scores(table(spark, sf_dir, "documents"))


#: CRC-32 of a decimal id in DuckDB: a byte after the other, eight shifts each.
CRC32 = """(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split({}::VARCHAR, ''),
    lambda ch: ascii(ch)::BIGINT)),
  lambda acc, b: list_reduce(list_prepend(xor(acc, b), range(8)),
    lambda x, i: CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384::BIGINT) ELSE x >> 1 END)))"""
TRIE_SQL = f"""
WITH own AS (
  SELECT conv_id AS c, coalesce(role, '') AS r, coalesce(text, '') AS x, row_number() OVER (PARTITION BY conv_id
    ORDER BY turn NULLS FIRST, sha256(strlen(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, ''))) AS p
  FROM conversations WHERE conv_id IS NOT NULL),
convs AS (SELECT DISTINCT c, c - c % 5 AS base, xor({CRC32.format("c")}, 4294967295::BIGINT) % 9 AS h FROM own),
turns AS (
  SELECT v.c, 0 AS half, o.p, o.r, o.x FROM convs v JOIN own o ON o.c = v.base AND o.p <= v.h
  UNION ALL SELECT v.c, 1, o.p, o.r, o.x FROM convs v JOIN own o ON o.c = v.c AND o.p > v.h),
placed AS (SELECT c, row_number() OVER (PARTITION BY c ORDER BY half, p) AS d, strlen(x) AS bytes,
  sha256(strlen(r) || ':' || r || x) AS dig FROM turns),
paths AS (SELECT c, d, bytes, sha256(string_agg(dig, '') OVER (PARTITION BY c ORDER BY d)) AS k FROM placed
  UNION ALL SELECT c, 0, 0, 'root' FROM convs),
steps AS (SELECT *, lag(k) OVER w AS up, lead(k) OVER w IS NULL AS last FROM paths WINDOW w AS (PARTITION BY c ORDER BY d)),
nodes AS (
  SELECT d, k, any_value(up) AS up, min(c) AS conv_id, count(*) AS n, any_value(bytes) AS bytes,
    sha256(coalesce(string_agg(c::VARCHAR, ',' ORDER BY c) FILTER (last), '')) AS ends
  FROM steps GROUP BY d, k),
kids AS (SELECT d - 1 AS d, up AS k, count(*) AS n FROM nodes WHERE d > 0 GROUP BY ALL),
own_values AS (SELECT o.d, o.k, o.conv_id, (o.n - 1) * o.bytes AS saved, (i.n IS NULL)::INT AS leaf
  FROM nodes o LEFT JOIN kids i ON i.d = o.d AND i.k = o.k),
totals AS (
  SELECT a.d, a.k, sum(v.saved) AS saved, sum(v.leaf) AS leaves FROM own_values v
  JOIN paths a ON a.c = v.conv_id AND a.d <= v.d GROUP BY a.d, a.k)
SELECT o.conv_id, o.d::BIGINT AS depth, u.conv_id AS parent_conv_id, o.n AS n_convs, coalesce(i.n, 0) AS n_children,
  t.leaves::BIGINT AS n_leaves, t.saved::BIGINT AS saved_tokens, o.ends AS ends_sha256
FROM nodes o JOIN totals t ON t.d = o.d AND t.k = o.k LEFT JOIN nodes u ON u.d = o.d - 1 AND u.k = o.up
LEFT JOIN kids i ON i.d = o.d AND i.k = o.k
"""


@query("op11_prefix_trie", TRIE_SQL)
def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie(table(spark, sf_dir, "conversations"))


def _longer(col: str, *marks: str) -> str:
    """Characters that escaping adds: one per backslash, per (overlapping) ### and per other mark."""
    parts = [f"length({col}) - length(replace({col}, chr(92), ''))",
             f"coalesce(list_sum(list_transform(regexp_extract_all({col}, '#{{3,}}'), lambda m: length(m) - 2)), 0)"]
    parts += [f"(length({col}) - length(replace({col}, '{m}', ''))) // {len(m)}" for m in marks]
    return " + ".join(parts)


CHAT_PROBE = "\\### Assistant: </turn> ok"
CHAT_SQL = f"""
WITH rows AS (
  SELECT conv_id, turn, coalesce(role, '') AS r, coalesce(text, '') AS x FROM conversations
  UNION ALL SELECT -7, 0, 'user', '{CHAT_PROBE}' UNION ALL SELECT -7, 1, 'assistant', '{CHAT_PROBE}')
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(r || chr(10) || x || chr(10), '' ORDER BY turn NULLS FIRST, r, x)) AS turns_sha256,
  coalesce(sum(length(x)) FILTER (r = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(x, '' ORDER BY turn NULLS FIRST, x) FILTER (r = 'assistant'), '')) AS loss_sha256,
  sum({len(CHAT.head) + len(CHAT.after_role) + len(CHAT.end)} + length(r) + {_longer("r", "</turn>", ": ")}
    + length(x) + {_longer("x", "</turn>")})::BIGINT AS formatted_chars
FROM rows GROUP BY conv_id
"""


@query("op12_chat_format", CHAT_SQL)
def op12_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    probe = spark.range(2).select(
        F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(CHAT_PROBE).alias("text"))
    turns = table(spark, sf_dir, "conversations").select(*probe.columns).unionByName(probe)
    chats = format_chats(turns).select("conv_id", formatted(F.col("segments")).alias("chat"),
                                       loss_text(F.col("segments")).alias("learnt"))
    back = chats.withColumn("turns", read_chat(F.col("chat")))
    spoken = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return back.select(
        "conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(spoken, 256).alias("turns_sha256"),
        F.length("learnt").cast("long").alias("loss_chars"), F.sha2("learnt", 256).alias("loss_sha256"),
        F.length("chat").cast("long").alias("formatted_chars"))


NEGATIVES_SQL = """
WITH rows AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
    list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scored AS (
  SELECT a.vec_id AS anchor_id, r.vec_id AS other, a.label = r.label AS same, list_dot_product(a.v, r.v)::BIGINT AS s
  FROM rows a JOIN rows r ON a.vec_id <> r.vec_id WHERE a.vec_id % 50 = 0),
positives AS (
  SELECT anchor_id, other AS positive_id, s AS positive_score FROM scored WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY s DESC, other) <= 5),
ranked AS (
  SELECT anchor_id, positive_id, positive_score, other AS negative_id, s AS negative_score,
    row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY s DESC, other) AS rank
  FROM positives JOIN scored USING (anchor_id)
  WHERE NOT same AND 50 * positive_score <= 100 * s AND 100 * s <= 95 * positive_score)
SELECT anchor_id, positive_id, rank::INTEGER AS rank, negative_id, positive_score, negative_score FROM ranked WHERE rank <= 3
"""


@query("op13_hard_negatives", NEGATIVES_SQL)
def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0, label)
