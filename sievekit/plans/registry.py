"""Named queries over the driver tables and their DuckDB oracle SQL.

Each query is ``f(spark, sf_dir) -> DataFrame``; every one reads the whole
tables (no id subsets or row caps). ``ORACLE`` holds, for the keys that are
SQL-expressible, an independent dense formulation (global windows etc.).
Positions and counts are bigint and doubles are rounded to 6 places on both
sides.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sievekit.operators import order
from sievekit.sources.tables import RECORDS_SQL, records

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def register(name: str, sql: str | None = None):
    def deco(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql
        return fn

    return deco


def tidy(df: DataFrame) -> DataFrame:
    """Small ints to bigint, doubles rounded to 6 places (oracle contract)."""
    cols = []
    for f in df.schema.fields:
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, (T.IntegerType, T.ShortType, T.ByteType)):
            c = c.cast("long")
        elif isinstance(f.dataType, (T.DoubleType, T.FloatType)):
            c = F.round(c.cast("double"), 6)
        cols.append(c.alias(f.name))
    return df.select(*cols)


def with_r(body: str) -> str:
    return f"WITH {RECORDS_SQL},\n{body}"


# ---------------------------------------------------------------- recall curves
_RELEVANCE = {"final": "included_full", "model": "decision_binary", "human": "human_code"}


def _recall_sql(flag: str) -> str:
    f = f"CASE WHEN {flag} = 1 THEN 1 ELSE 0 END"
    return with_r(f"""
L AS (
  SELECT eppi_id,
         row_number() OVER (ORDER BY score DESC NULLS LAST, ordinal) AS position,
         sum({f}) OVER (ORDER BY score DESC NULLS LAST, ordinal
                        ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS cum,
         count(*) OVER () AS n,
         sum({f}) OVER () AS total
  FROM R)
SELECT eppi_id, CAST(position AS BIGINT) AS position, CAST(cum AS BIGINT) AS cumulative_relevant,
       round(CASE WHEN total = 0 THEN NULL ELSE CAST(cum AS DOUBLE) / total * 100 END, 6) AS recall,
       round(CAST(position AS DOUBLE) / n * 100, 6) AS perc_of_total
FROM L""")


def _recall_query(flag: str):
    def q(spark: SparkSession, sf_dir: str) -> DataFrame:
        curve = order.recall_curve(records(spark, sf_dir), flag)
        return tidy(curve.select("eppi_id", "position", "cumulative_relevant", "recall", "perc_of_total"))

    return q


for _k, _flag in _RELEVANCE.items():
    register(f"recall_curve_{_k}", _recall_sql(_flag))(_recall_query(_flag))


# ---------------------------------------------------------------- stopping runs
def _runs_sql(flag: str) -> str:
    return with_r(f"""
L AS (
  SELECT row_number() OVER (ORDER BY score DESC NULLS LAST, ordinal) AS position,
         coalesce({flag} = 0, false) AS irr, count(*) OVER () AS n
  FROM R),
G AS (SELECT *, lag(irr) OVER (ORDER BY position) AS prev FROM L),
C AS (SELECT *, sum(CASE WHEN prev IS NOT NULL AND irr <> prev THEN 1 ELSE 0 END)
                 OVER (ORDER BY position ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS run_id
      FROM G)
SELECT CAST(run_id AS BIGINT) AS run_id, CAST(count(*) AS BIGINT) AS run_length,
       CAST(min(position) AS BIGINT) AS start_row, CAST(max(position) AS BIGINT) AS end_row,
       round(CAST(count(*) AS DOUBLE) / max(n) * 100, 6) AS pct_of_total
FROM C WHERE irr GROUP BY run_id""")


def _runs_query(flag: str):
    def q(spark: SparkSession, sf_dir: str) -> DataFrame:
        return tidy(order.stopping_runs(records(spark, sf_dir), flag))

    return q


for _k, _flag in (("final", "included_full"), ("model", "decision_binary")):
    register(f"stopping_runs_{_k}", _runs_sql(_flag))(_runs_query(_flag))


# ---------------------------------------------------------------- shared SQL bits
RANK_SQL = "row_number() OVER (ORDER BY score DESC NULLS LAST, ordinal)"


def _hash_sql(ident: str, seed: str) -> str:
    """SQL twin of functions.scalars.hash_key."""
    return f"('0x' || substr(md5(CAST({ident} AS VARCHAR) || ':' || {seed}), 1, 13))::BIGINT"


def _norm_sql(x: str) -> str:
    """SQL twin of functions.scalars.normalise_text."""
    plain = f"lower(regexp_replace({x}, '&(amp|lt|gt|quot|#39);', '', 'g'))"
    return f"nullif(array_to_string(regexp_extract_all({plain}, '[\\p{{L}}\\p{{M}}\\p{{N}}]'), ''), '')"


# ---------------------------------------------------------------- flagship (C2 + F6)
@register("flagship_recall_human", with_r(f"""
K AS (SELECT * FROM R WHERE NOT coalesce(nullif(abstract, '') IS NULL, false)),
L AS (
  SELECT eppi_id,
         {RANK_SQL} AS position,
         sum(CASE WHEN human_code = 1 THEN 1 ELSE 0 END) OVER (ORDER BY score DESC NULLS LAST, ordinal
                        ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS cum,
         count(*) OVER () AS n,
         sum(CASE WHEN human_code = 1 THEN 1 ELSE 0 END) OVER () AS total
  FROM K)
SELECT eppi_id, CAST(position AS BIGINT) AS position, CAST(cum AS BIGINT) AS cumulative_relevant,
       round(CASE WHEN total = 0 THEN NULL ELSE CAST(cum AS DOUBLE) / total * 100 END, 6) AS recall,
       round(CAST(position AS DOUBLE) / n * 100, 6) AS perc_of_total
FROM L"""))
def q_flagship(spark, sf_dir):
    from sievekit.functions.scalars import blank_to_null
    from sievekit.operators.filters import filter_out

    r = records(spark, sf_dir).withColumn("abstract", blank_to_null("abstract"))
    kept = filter_out(r, F.col("abstract").isNull())
    curve = order.recall_curve(kept, "human_code")
    return tidy(curve.select("eppi_id", "position", "cumulative_relevant", "recall", "perc_of_total"))


# ---------------------------------------------------------------- F7 F9 slice_max
@register("last_relevant_fraction", with_r(f"""
L AS (SELECT included_full, {RANK_SQL} AS position FROM R)
SELECT CAST(max(CASE WHEN included_full = 1 THEN position END) AS BIGINT) AS last_position,
       CAST(count(*) AS BIGINT) AS n_rows,
       round(CAST(max(CASE WHEN included_full = 1 THEN position END) AS DOUBLE) / count(*), 6) AS fraction
FROM L"""))
def q_last_relevant(spark, sf_dir):
    ranked = order.rank_list(records(spark, sf_dir))
    return tidy(order.last_relevant_fraction(ranked, "included_full"))


@register("recall_threshold", with_r(f"""
L AS (
  SELECT {RANK_SQL} AS position,
         sum(CASE WHEN human_code = 1 THEN 1 ELSE 0 END) OVER (ORDER BY score DESC NULLS LAST, ordinal
                        ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS cum,
         sum(CASE WHEN human_code = 1 THEN 1 ELSE 0 END) OVER () AS total
  FROM R),
C AS (SELECT position, CASE WHEN total = 0 THEN NULL ELSE CAST(cum AS DOUBLE) / total * 100 END AS recall FROM L),
T AS (SELECT * FROM (VALUES (95.0::DOUBLE), (100.0::DOUBLE)) v(target))
SELECT round(T.target, 6) AS target, CAST(min(C.position) FILTER (WHERE C.recall >= T.target) AS BIGINT) AS position
FROM T CROSS JOIN C GROUP BY T.target"""))
def q_recall_threshold(spark, sf_dir):
    curve = order.recall_curve(records(spark, sf_dir), "human_code")
    return tidy(order.recall_threshold(curve, [95.0, 100.0]))


@register("slice_max_ties", with_r("""
P AS (SELECT * FROM R WHERE human_code = 1)
SELECT eppi_id, score FROM P WHERE score = (SELECT max(score) FROM P)"""))
def q_slice_max(spark, sf_dir):
    r = records(spark, sf_dir)
    return tidy(order.slice_max(r.filter(F.col("human_code") == 1), "score", 1).select("eppi_id", "score"))


# ---------------------------------------------------------------- G5 B9
@register("drop_top_12pct", with_r(f"""
L AS (SELECT eppi_id, {RANK_SQL} AS position, count(*) OVER () AS n FROM R)
SELECT eppi_id, CAST(position AS BIGINT) AS position FROM L WHERE position > round_even(0.12 * n, 0)"""))
def q_drop_top(spark, sf_dir):
    ranked = order.rank_list(records(spark, sf_dir))
    return tidy(order.drop_top_share(ranked, 0.12).select("eppi_id", "position"))


@register("head_slice", with_r(f"""
L AS (SELECT eppi_id, {RANK_SQL} AS position FROM R)
SELECT eppi_id, CAST(position AS BIGINT) AS position FROM L WHERE position <= 80"""))
def q_head(spark, sf_dir):
    return tidy(order.head_rows(order.rank_list(records(spark, sf_dir)), 80).select("eppi_id", "position"))


@register("tail_slice", with_r(f"""
L AS (SELECT eppi_id, {RANK_SQL} AS position FROM R)
SELECT eppi_id, CAST(position AS BIGINT) AS position FROM L WHERE position > 80"""))
def q_tail(spark, sf_dir):
    return tidy(order.tail_rows(order.rank_list(records(spark, sf_dir)), 80).select("eppi_id", "position"))


# ---------------------------------------------------------------- F2 first per key
@register("first_per_key_events", """
SELECT event_id, user_id, event_type, round(value, 6) AS value
FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS rn FROM events) WHERE rn = 1""")
def q_first_events(spark, sf_dir):
    from sievekit.operators.sampling import first_per_key
    from sievekit.sources.tables import table

    ev = table(spark, sf_dir, "events").select("event_id", "user_id", "event_type", "value")
    return tidy(first_per_key(ev, "user_id", "event_id"))


@register("first_per_key_conversations", """
SELECT conv_id, turn, role, text
FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS rn FROM conversations) WHERE rn = 1""")
def q_first_conv(spark, sf_dir):
    from sievekit.operators.sampling import first_per_key
    from sievekit.sources.tables import table

    cv = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    return tidy(first_per_key(cv, "conv_id", "turn"))


# ---------------------------------------------------------------- C1 C2 B3
@register("filter_out_blank", with_r("""
B AS (SELECT eppi_id, nullif(split_part(abstract, chr(10), 2), '') AS second_line FROM R)
SELECT eppi_id, second_line FROM B WHERE NOT coalesce(second_line IS NULL, false)"""))
def q_filter_out_blank(spark, sf_dir):
    from sievekit.functions.scalars import blanks_to_null
    from sievekit.operators.filters import filter_out

    r = records(spark, sf_dir, labels=False).select("eppi_id", F.split_part("abstract", F.lit("\n"), F.lit(2)).alias("second_line"))
    return tidy(filter_out(blanks_to_null(r), F.col("second_line").isNull()))


@register("filter_out_keeps_null", with_r("""
SELECT eppi_id, included_full FROM R WHERE NOT coalesce(included_full = 0, false)"""))
def q_filter_out_null(spark, sf_dir):
    from sievekit.operators.filters import filter_out

    r = records(spark, sf_dir).select("eppi_id", "included_full")
    return tidy(filter_out(r, F.col("included_full") == 0))


@register("filter_and_null", with_r("""
SELECT eppi_id, human_code, decision_binary FROM R WHERE human_code = 1 AND decision_binary = 1"""))
def q_filter_and(spark, sf_dir):
    from sievekit.operators.filters import keep

    r = records(spark, sf_dir).select("eppi_id", "human_code", "decision_binary")
    return tidy(keep(r, (F.col("human_code") == 1) & (F.col("decision_binary") == 1)))


# ---------------------------------------------------------------- G3 G4 G6
@register("sample_n", with_r(f"""
H AS (SELECT eppi_id, {_hash_sql('eppi_id', "'42'")} AS h FROM R WHERE human_code = 0),
K AS (SELECT eppi_id, row_number() OVER (ORDER BY h, eppi_id) AS sample_rank FROM H)
SELECT eppi_id, CAST(sample_rank AS BIGINT) AS sample_rank FROM K WHERE sample_rank <= 100"""))
def q_sample_n(spark, sf_dir):
    from sievekit.operators.sampling import sample_n

    r = records(spark, sf_dir).filter(F.col("human_code") == 0)
    return tidy(sample_n(r, 100, 42).select("eppi_id", "sample_rank"))


_STRATA_SQL = f"""
S AS (SELECT eppi_id, 0 AS stratum_index, 'included' AS stratum FROM R WHERE human_code = 1
      UNION ALL SELECT eppi_id, 1, 'final' FROM R WHERE included_full = 1
      UNION ALL SELECT eppi_id, 2, 'excluded' FROM R WHERE human_code = 0),
H AS (SELECT *, {_hash_sql('eppi_id', "'42-' || CAST(stratum_index AS VARCHAR)")} AS h FROM S),
D AS (SELECT *, row_number() OVER (PARTITION BY stratum_index ORDER BY h, eppi_id) AS sample_rank FROM H),
K AS (SELECT * FROM D WHERE sample_rank <= CASE stratum_index WHEN 0 THEN 48 WHEN 1 THEN 5 ELSE 100 END),
F1 AS (SELECT *, row_number() OVER (PARTITION BY eppi_id ORDER BY stratum_index, sample_rank) AS k FROM K),
SAMPLE AS (SELECT eppi_id, stratum, stratum_index, sample_rank FROM F1 WHERE k = 1)"""


def _strata():
    return [("included", F.col("human_code") == 1, 48), ("final", F.col("included_full") == 1, 5),
            ("excluded", F.col("human_code") == 0, 100)]


@register("sample_strata", with_r(_STRATA_SQL + """
SELECT eppi_id, stratum, CAST(stratum_index AS BIGINT) AS stratum_index,
       CAST(sample_rank AS BIGINT) AS sample_rank FROM SAMPLE"""))
def q_sample_strata(spark, sf_dir):
    from sievekit.operators.sampling import sample_strata

    s = sample_strata(records(spark, sf_dir), _strata(), 42)
    return tidy(s.select("eppi_id", "stratum", "stratum_index", "sample_rank"))


@register("shuffle_order", with_r(f"""
H AS (SELECT eppi_id, {_hash_sql('eppi_id', "'42'")} AS h FROM R)
SELECT eppi_id, CAST(row_number() OVER (ORDER BY h, eppi_id) AS BIGINT) AS position FROM H"""))
def q_shuffle(spark, sf_dir):
    from sievekit.operators.sampling import shuffle_rows

    return tidy(shuffle_rows(records(spark, sf_dir).select("eppi_id"), 42).select("eppi_id", "position"))


# ---------------------------------------------------------------- D1 D2 D3 D6 D7
@register("semi_ids", with_r("""
SELECT eppi_id, title FROM R
WHERE EXISTS (SELECT 1 FROM labels l WHERE l.toxic = 1 AND l.doc_id IS NOT DISTINCT FROM R.eppi_id)"""))
def q_semi(spark, sf_dir):
    from sievekit.operators.joins import semi_ids
    from sievekit.sources.tables import table

    ids = table(spark, sf_dir, "labels").filter(F.col("toxic") == 1).select(F.col("doc_id").alias("eppi_id"))
    return tidy(semi_ids(records(spark, sf_dir).select("eppi_id", "title"), ids))


@register("anti_ids_null", with_r("""
SELECT eppi_id, human_code FROM R
WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.toxic = 1 AND l.toxic IS NOT DISTINCT FROM R.human_code)"""))
def q_anti(spark, sf_dir):
    from sievekit.operators.joins import anti_ids
    from sievekit.sources.tables import table

    codes = table(spark, sf_dir, "labels").filter(F.col("toxic") == 1).select(F.col("toxic").alias("human_code"))
    return tidy(anti_ids(records(spark, sf_dir).select("eppi_id", "human_code"), codes, "human_code"))


@register("flag_ids", with_r("""
SELECT eppi_id, CAST(CASE WHEN EXISTS (SELECT 1 FROM labels l WHERE l.toxic = 1 AND l.doc_id = R.eppi_id)
                     THEN 1 ELSE 0 END AS BIGINT) AS review_included FROM R"""))
def q_flag(spark, sf_dir):
    from sievekit.operators.joins import flag_ids
    from sievekit.sources.tables import table

    ids = table(spark, sf_dir, "labels").filter(F.col("toxic") == 1).select(F.col("doc_id").alias("eppi_id"))
    return tidy(flag_ids(records(spark, sf_dir).select("eppi_id"), ids, "review_included"))


_SPLIT_SQL = f"""
HO AS (SELECT eppi_id FROM (SELECT eppi_id, row_number() OVER (ORDER BY {_hash_sql('eppi_id', "'7'")}, eppi_id) AS k
                            FROM R) WHERE k <= 50),
POOL AS (SELECT * FROM R WHERE NOT EXISTS (SELECT 1 FROM HO WHERE HO.eppi_id = R.eppi_id)),
S AS (SELECT eppi_id, 0 AS si FROM POOL WHERE decision_binary = 1
      UNION ALL SELECT eppi_id, 1 FROM POOL WHERE decision_binary = 0),
D AS (SELECT *, row_number() OVER (PARTITION BY si ORDER BY
        {_hash_sql('eppi_id', "'2026-' || CAST(si AS VARCHAR)")}, eppi_id) AS rk FROM S),
TR AS (SELECT DISTINCT eppi_id FROM D WHERE rk <= 40),
PARTS AS (SELECT R.*, CASE WHEN TR.eppi_id IS NULL THEN 'unseen' ELSE 'train' END AS part,
                 EXISTS (SELECT 1 FROM HO WHERE HO.eppi_id = R.eppi_id) AS held
          FROM R LEFT JOIN TR ON R.eppi_id = TR.eppi_id)"""


@register("split_counts", with_r(_SPLIT_SQL + """
SELECT part, CAST(count(*) AS BIGINT) AS n_rows,
       CAST(count(*) FILTER (WHERE decision_binary = 1) AS BIGINT) AS n_included,
       CAST(count(*) FILTER (WHERE held) AS BIGINT) AS n_holdout
FROM PARTS GROUP BY part"""))
def q_split_counts(spark, sf_dir):
    from sievekit.operators.sampling import sample_n
    from sievekit.plans.priority import screening_split

    r = records(spark, sf_dir, labels=False)
    r = r.select("eppi_id", "ordinal", "decision_binary")
    holdout = sample_n(r.select("eppi_id"), 50, 7).select("eppi_id")
    strata = [("inc", F.col("decision_binary") == 1, 40), ("exc", F.col("decision_binary") == 0, 40)]
    train, unseen = screening_split(r, strata, 2026, holdout_ids=holdout)
    held = holdout.withColumn("__held", F.lit(True))
    parts = train.withColumn("part", F.lit("train")).unionByName(unseen.withColumn("part", F.lit("unseen")))
    parts = parts.join(held, "eppi_id", "left")
    return tidy(parts.groupBy("part").agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.count_if(F.col("decision_binary") == 1).alias("n_included"),
        F.count_if(F.col("__held").isNotNull()).alias("n_holdout"),
    ))


@register("title_link", with_r(f"""
LST AS (SELECT DISTINCT split_part(d.text, chr(10), 1) AS list_title
        FROM documents d JOIN labels l ON d.doc_id = l.doc_id WHERE l.toxic = 1),
LK AS (SELECT list_title, {_norm_sql('list_title')} AS k FROM LST)
SELECT R.eppi_id, LK.list_title FROM R JOIN LK ON {_norm_sql('R.title')} = LK.k"""))
def q_title_link(spark, sf_dir):
    from sievekit.operators.joins import title_link
    from sievekit.sources.tables import table

    lab = table(spark, sf_dir, "labels").filter(F.col("toxic") == 1)
    lst = (table(spark, sf_dir, "documents").join(lab, "doc_id", "left_semi")
           .select(F.split_part("text", F.lit("\n"), F.lit(1)).alias("list_title")).distinct())
    lst = lst.withColumn("t", F.col("list_title"))
    linked = title_link(records(spark, sf_dir, labels=False).select("eppi_id", "title"), lst, "title", "t", ["list_title"])
    return tidy(linked.select("eppi_id", "list_title"))


# ---------------------------------------------------------------- H1 H2 A2 B2
_BIND_SQL = """
SRC AS (SELECT d.doc_id AS eppi_id, d.doc_id AS ordinal, split_part(d.text, chr(10), 1) AS title,
               l.quality AS human_code, 'search' AS cite_source,
               CASE l.quality WHEN 1 THEN 'included' WHEN 0 THEN 'excluded' END AS cite_label, 0 AS part
        FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id),
BEN AS (SELECT item_id AS other_id,
               item_id - (SELECT min(item_id) FROM benchmark) + (SELECT max(doc_id) + 1 FROM documents) AS ordinal, split_part(text, chr(10), 1) AS title, 1 AS human_code,
               'benchmark' AS cite_source, 'benchmark' AS cite_label, 1 AS part FROM benchmark),
U AS (SELECT * FROM SRC UNION ALL BY NAME SELECT * FROM BEN)"""


def _bound(spark, sf_dir):
    from sievekit.operators.sets import bind_rows, with_constants
    from sievekit.sources.tables import table

    r = records(spark, sf_dir)
    src = with_constants(
        r.select("eppi_id", "ordinal", "title", "human_code",
                 F.when(F.col("human_code") == 1, "included").when(F.col("human_code") == 0, "excluded").alias("cite_label")),
        cite_source="search")
    ben = with_constants(
        table(spark, sf_dir, "benchmark").select(
            F.col("item_id").alias("other_id"), F.col("item_id").alias("ordinal"),
            F.split_part("text", F.lit("\n"), F.lit(1)).alias("title")),
        human_code=1, cite_source="benchmark", cite_label="benchmark")
    return bind_rows(src, ben.withColumn("human_code", F.col("human_code").cast("int")))


@register("bind_rows_fill", "WITH " + _BIND_SQL + """
SELECT CAST(eppi_id AS BIGINT) AS eppi_id, CAST(other_id AS BIGINT) AS other_id, CAST(ordinal AS BIGINT) AS ordinal,
       title, CAST(human_code AS BIGINT) AS human_code, cite_source, cite_label, CAST(part AS BIGINT) AS part FROM U""")
def q_bind(spark, sf_dir):
    return tidy(_bound(spark, sf_dir).select("eppi_id", "other_id", "ordinal", "title", "human_code",
                                             "cite_source", "cite_label", "part"))


@register("unique_labels", "WITH " + _BIND_SQL + "\nSELECT DISTINCT cite_label FROM U")
def q_unique(spark, sf_dir):
    from sievekit.operators.sets import unique_values

    return unique_values(_bound(spark, sf_dir), "cite_label")


# ---------------------------------------------------------------- B1 B4 B5 B6
@register("paste_na", with_r("""
SELECT eppi_id, coalesce(title, 'NA') || ' ' || coalesce(nullif(split_part(abstract, chr(10), 2), ''), 'NA') AS text
FROM R"""))
def q_paste(spark, sf_dir):
    from sievekit.functions.scalars import blank_to_null, paste

    r = records(spark, sf_dir, labels=False)
    second = blank_to_null(F.split_part("abstract", F.lit("\n"), F.lit(2)))
    return r.select("eppi_id", paste("title", second).alias("text"))


@register("cast_codes", with_r("""
SELECT eppi_id, CAST(TRY_CAST(substr(model, 4) AS INTEGER) AS BIGINT) AS model_num,
       TRY_CAST(lang AS DOUBLE) AS lang_num, TRY_CAST(CAST(human_code AS VARCHAR) AS DOUBLE) AS code_num FROM R"""))
def q_cast(spark, sf_dir):
    from sievekit.functions.scalars import to_number

    r = records(spark, sf_dir)
    return tidy(r.select("eppi_id", to_number(F.substring("model", 4, 1 << 20), "int").alias("model_num"),
                         to_number(F.col("lang"), "double").alias("lang_num"),
                         to_number(F.col("human_code").cast("string"), "double").alias("code_num")))


@register("if_else_null", with_r("""
SELECT eppi_id, CASE WHEN included_full = 1 THEN 'include' WHEN NOT (included_full = 1) THEN 'exclude' END AS verdict
FROM R"""))
def q_if_else(spark, sf_dir):
    from sievekit.functions.scalars import if_else

    r = records(spark, sf_dir)
    return r.select("eppi_id", if_else(F.col("included_full") == 1, "include", "exclude").alias("verdict"))


@register("select_range", with_r("""
SELECT eppi_id, CAST(human_code AS BIGINT) AS human_code, CAST(included_full AS BIGINT) AS included_full,
       CAST(decision_binary AS BIGINT) AS decision_binary FROM R"""))
def q_select_range(spark, sf_dir):
    from sievekit.functions.scalars import select_range

    return tidy(select_range(records(spark, sf_dir), "human_code", "decision_binary", keep=["eppi_id"]))


# ---------------------------------------------------------------- E5 E6 J1
def _ratio_sql(num: str, den: str) -> str:
    return f"round(CASE WHEN ({den}) = 0 THEN NULL ELSE CAST({num} AS DOUBLE) / ({den}) END, 6)"


@register("performance_by_model", with_r(f"""
C AS (SELECT model, count(*) AS n,
             count(*) FILTER (WHERE decision_binary = 1 AND human_code = 1) AS tp,
             count(*) FILTER (WHERE decision_binary = 0 AND human_code = 1) AS fn,
             count(*) FILTER (WHERE decision_binary = 1 AND human_code = 0) AS fp,
             count(*) FILTER (WHERE decision_binary = 0 AND human_code = 0) AS tn
      FROM R GROUP BY model)
SELECT model, CAST(n AS BIGINT) AS n, CAST(tp AS BIGINT) AS tp, CAST(fn AS BIGINT) AS fn,
       CAST(fp AS BIGINT) AS fp, CAST(tn AS BIGINT) AS tn,
       {_ratio_sql('tp', 'tp + fn')} AS recall, {_ratio_sql('tn', 'tn + fp')} AS specificity,
       {_ratio_sql('tp', 'tp + fp')} AS precision, {_ratio_sql('tn', 'tn + fn')} AS npv,
       {_ratio_sql('tp + tn', 'tp + tn + fp + fn')} AS accuracy, {_ratio_sql('2 * tp', '2 * tp + fp + fn')} AS f1
FROM C"""))
def q_performance(spark, sf_dir):
    from sievekit.operators.aggregates import performance

    return tidy(performance(records(spark, sf_dir), ["model"]))


@register("error_lists", with_r("""
SELECT eppi_id, model,
       CASE WHEN decision_binary = 0 AND human_code = 1 THEN 'false_negative' ELSE 'false_positive' END AS error_type,
       CAST(decision_binary AS BIGINT) AS decision_binary, CAST(human_code AS BIGINT) AS human_code, abstract
FROM R WHERE (decision_binary = 0 AND human_code = 1) OR (decision_binary = 1 AND human_code = 0)"""))
def q_errors(spark, sf_dir):
    from sievekit.operators.aggregates import error_lists

    r = records(spark, sf_dir)
    return tidy(error_lists(r, columns=["model", "decision_binary", "human_code", "abstract"]))


@register("missed_final", with_r("""
SELECT eppi_id, title, TRY_CAST(CAST(human_code AS VARCHAR) AS DOUBLE) AS human_code,
       TRY_CAST(CAST(included_full AS VARCHAR) AS DOUBLE) AS included_full,
       TRY_CAST(CAST(decision_binary AS VARCHAR) AS DOUBLE) AS decision_binary
FROM R WHERE model = 'src1' AND included_full = 1 AND decision_binary = 0"""))
def q_missed_final(spark, sf_dir):
    from sievekit.operators.agreement import decisions_for_model

    d = decisions_for_model(records(spark, sf_dir), "src1", "human_code", "decision_binary")
    return tidy(d.filter((F.col("included_full") == 1) & (F.col("decision_binary") == 0))
                .select("eppi_id", "title", "human_code", "included_full", "decision_binary"))


# ---------------------------------------------------------------- J2
_AGREE_SQL = """
A AS (SELECT eppi_id, decision_binary AS decision_a FROM R),
B AS (SELECT doc_id AS eppi_id, quality AS decision_b FROM labels),
X AS (SELECT decision_a, decision_b, count(*) AS n FROM A JOIN B ON A.eppi_id = B.eppi_id GROUP BY ALL)"""


def _runs_ab(spark, sf_dir):
    from sievekit.sources.tables import table

    a = records(spark, sf_dir).select("eppi_id", "decision_binary")
    b = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("eppi_id"), F.col("quality").alias("decision_binary"))
    return a, b


@register("run_agreement", with_r(_AGREE_SQL + """
SELECT CAST(decision_a AS BIGINT) AS decision_a, CAST(decision_b AS BIGINT) AS decision_b, CAST(n AS BIGINT) AS n FROM X"""))
def q_agreement(spark, sf_dir):
    from sievekit.operators.agreement import run_agreement

    return tidy(run_agreement(*_runs_ab(spark, sf_dir)))


@register("run_agreement_summary", with_r(_AGREE_SQL + """,
S AS (SELECT sum(n) AS n, sum(n) FILTER (WHERE decision_a IS NOT DISTINCT FROM decision_b) AS agree,
             sum(n) FILTER (WHERE decision_a = 1) AS a1, sum(n) FILTER (WHERE decision_a = 0) AS a0,
             sum(n) FILTER (WHERE decision_b = 1) AS b1, sum(n) FILTER (WHERE decision_b = 0) AS b0 FROM X),
P AS (SELECT *, CAST(agree AS DOUBLE) / n AS po, CAST(coalesce(a1,0) * coalesce(b1,0) + coalesce(a0,0) * coalesce(b0,0) AS DOUBLE) / (n * n) AS pe FROM S)
SELECT CAST(n AS BIGINT) AS n, CAST(agree AS BIGINT) AS agree, CAST(n - agree AS BIGINT) AS flips,
       round(po, 6) AS agreement_rate, round(CASE WHEN pe = 1 THEN NULL ELSE (po - pe) / (1 - pe) END, 6) AS kappa FROM P"""))
def q_agreement_summary(spark, sf_dir):
    from sievekit.operators.agreement import agreement_summary, run_agreement

    return tidy(agreement_summary(run_agreement(*_runs_ab(spark, sf_dir))))


# ---------------------------------------------------------------- E4 E7 D4 (exact)
_GROUPS_SQL = f"""
G AS (SELECT eppi_id, ordinal, human_code, {_norm_sql('abstract')} AS k,
             CASE human_code WHEN 1 THEN 'included' WHEN 0 THEN 'excluded' END AS cite_label FROM R),
LC AS (SELECT min(eppi_id) AS cluster_id, count(*) AS n_members,
              list_sort(list(DISTINCT cite_label) FILTER (WHERE cite_label IS NOT NULL)) AS labs,
              arg_min(human_code, ordinal) FILTER (WHERE human_code IS NOT NULL) AS code
       FROM G GROUP BY k),
LC2 AS (SELECT *, coalesce(list_contains(labs, 'included') AND list_contains(labs, 'excluded'), false) AS conflict FROM LC)"""


def _conflicts(spark, sf_dir):
    from sievekit.functions.scalars import normalise_text
    from sievekit.operators.aggregates import label_conflicts

    from sievekit.operators.dedup import key_hash

    # group on a 128-bit hash of the normalised text, not the long text itself
    r = records(spark, sf_dir).withColumn("__k", key_hash(normalise_text("abstract"))).withColumn(
        "cite_label", F.when(F.col("human_code") == 1, "included").when(F.col("human_code") == 0, "excluded"))
    out = label_conflicts(r, "__k", "cite_label", "human_code", id_col="eppi_id")
    return out


@register("label_conflicts", with_r(_GROUPS_SQL + """
SELECT cluster_id, CAST(n_members AS BIGINT) AS n_members,
       CASE WHEN len(labs) > 0 THEN array_to_string(labs, ', ') END AS labels, conflict,
       CAST(CASE WHEN conflict THEN 1 ELSE code END AS BIGINT) AS human_code FROM LC2"""))
def q_label_conflicts(spark, sf_dir):
    return tidy(_conflicts(spark, sf_dir).select("cluster_id", "n_members", "labels", "conflict", "human_code"))


@register("label_conflict_any", with_r(_GROUPS_SQL + """
SELECT coalesce(bool_or(conflict), false) AS any_conflict, CAST(count(*) FILTER (WHERE conflict) AS BIGINT) AS n_conflicts
FROM LC2"""))
def q_label_any(spark, sf_dir):
    from sievekit.operators.aggregates import any_true

    return tidy(_conflicts(spark, sf_dir).agg(
        any_true(F.col("conflict")).alias("any_conflict"), F.count_if(F.col("conflict")).alias("n_conflicts")))


@register("dedup_exact", with_r(f"""
G AS (SELECT eppi_id, {_norm_sql('abstract')} AS k FROM R)
SELECT eppi_id, min(eppi_id) OVER (PARTITION BY k) AS cluster_id,
       CAST(count(*) OVER (PARTITION BY k) AS BIGINT) AS n_members FROM G"""))
def q_dedup_exact(spark, sf_dir):
    from sievekit.operators.dedup import exact_clusters
    from sievekit.functions.scalars import normalise_text

    r = records(spark, sf_dir, labels=False).select("eppi_id", normalise_text("abstract").alias("k"))
    return tidy(exact_clusters(r, "eppi_id", "k").select("eppi_id", "cluster_id", "n_members"))


# ---------------------------------------------------------------- C3
@register("criteria_screen", with_r("""
C AS (SELECT eppi_id,
             coalesce(regexp_matches(abstract, '(?i)(^|[^a-z])the([^a-z]|$)'), false) AS a,
             coalesce(lang = 'en', false) AS b, coalesce(n_chars >= 500, false) AS c FROM R)
SELECT eppi_id, CAST(CASE WHEN a AND b AND c THEN 1 ELSE 0 END AS BIGINT) AS decision_binary,
       concat_ws(',', CASE WHEN NOT a THEN 'A' END, CASE WHEN NOT b THEN 'B' END, CASE WHEN NOT c THEN 'C' END)
         AS failed_criteria
FROM C"""))
def q_criteria(spark, sf_dir):
    from sievekit.operators.filters import criteria_screen, regex_criterion

    r = records(spark, sf_dir, labels=False)
    crit = {"A": regex_criterion("abstract", "(^|[^a-z])the([^a-z]|$)"), "B": F.col("lang") == "en",
            "C": F.col("n_chars") >= 500}
    s = criteria_screen(r, crit)
    return tidy(s.select("eppi_id", "decision_binary", F.array_join("failed_criteria", ",").alias("failed_criteria")))


# ---------------------------------------------------------------- D4 fuzzy
#: Clusters of the records: equal normalised text, or all-pairs Jaccard >= 0.8 on word 3-grams, and what they reach.
_CLUSTERS_SQL = f"""
WS AS (SELECT eppi_id, {_norm_sql('abstract')} AS k,
         list_filter(regexp_split_to_array(lower(coalesce(abstract, '')), '[^\\p{{L}}\\p{{N}}]+'), lambda x: x <> '') AS w FROM R),
SH AS (SELECT eppi_id, k, list_distinct(CASE WHEN len(w) < 3 THEN w ELSE
         list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]) END) AS s FROM WS),
GR AS (SELECT eppi_id, unnest(s) AS g FROM SH),
OV AS (SELECT x.eppi_id AS a, y.eppi_id AS b, count(*) AS o FROM GR x JOIN GR y ON x.g = y.g AND x.eppi_id < y.eppi_id
       GROUP BY ALL),
SIM AS (SELECT a, b, o::DOUBLE / (len(p.s) + len(q.s) - o) AS similarity
        FROM OV JOIN SH p ON p.eppi_id = a JOIN SH q ON q.eppi_id = b),
LINKS AS (SELECT a, b FROM SIM WHERE similarity >= 0.8::DOUBLE
          UNION SELECT x.eppi_id, y.eppi_id FROM SH x JOIN SH y ON x.k = y.k AND x.eppi_id < y.eppi_id),
BOTH_WAYS AS (SELECT a, b FROM LINKS UNION ALL SELECT b, a FROM LINKS),
REACH AS (SELECT eppi_id AS node, eppi_id AS seen FROM SH
          UNION SELECT r.node, l.b FROM REACH r JOIN BOTH_WAYS l ON l.a = r.seen),
CL AS (SELECT node AS eppi_id, min(seen) AS cluster_id FROM REACH GROUP BY node)"""


@register("dedup_fuzzy", with_r(f"""{_CLUSTERS_SQL}
SELECT eppi_id, eppi_id AS ordinal, cluster_id FROM CL""").replace("WITH", "WITH RECURSIVE", 1))
def q_dedup_fuzzy(spark, sf_dir):
    """Cluster map of the records: exact copies and all near copies."""
    from sievekit.operators.dedup import dedup

    r = records(spark, sf_dir).withColumn(
        "cite_label", F.when(F.col("human_code") == 1, "included").when(F.col("human_code") == 0, "excluded"))
    out = dedup(r.select("eppi_id", "ordinal", "abstract", "cite_label"), label="cite_label")
    return tidy(out["clusters"])


# ---------------------------------------------------------------- A1 A3 round trip
def _ris_source(spark, sf_dir):
    r = records(spark, sf_dir, labels=False)
    return r.select(
        F.col("eppi_id").cast("string").alias("eppi_id"), "ordinal", F.lit("JOUR").alias("type"), "title",
        "abstract", F.array("model").alias("author"), F.array("lang", "model").alias("keywords"),
        (F.lit(1990) + F.col("n_chars") % 30).cast("int").alias("year"),
    )


@register("ris_round_trip", with_r("""
SELECT CAST(eppi_id AS VARCHAR) AS eppi_id, 'JOUR' AS type, title,
       regexp_replace(abstract, '[ \t\n]+$', '') AS abstract, model AS author, lang || '|' || model AS keywords,
       CAST(1990 + n_chars % 30 AS BIGINT) AS year
FROM R"""))
def q_ris_round_trip(spark, sf_dir):
    """Write the records as a citation file, read it back (A3 -> A1)."""
    from sievekit.session import scratch_dir
    from sievekit.sources.ris import read_ris, write_ris

    path = scratch_dir(spark, "ris")
    write_ris(_ris_source(spark, sf_dir), path)
    back = read_ris(spark, path)
    return tidy(back.select("eppi_id", "type", "title", "abstract", F.array_join("author", "|").alias("author"),
                            F.array_join("keywords", "|").alias("keywords"), "year"))


# ---------------------------------------------------------------- A5 A6 report
@register("report_blocks", with_r("""
SELECT CAST(eppi_id AS VARCHAR) AS study_id,
       CASE WHEN human_code = 1 AND decision_binary = 0 THEN 'False exclusion'
            WHEN human_code = 0 AND decision_binary = 1 THEN 'False inclusion' ELSE 'Agreements' END AS section,
       title, CAST(decision_binary AS BIGINT) AS decision_binary, CAST(human_code AS BIGINT) AS human_code, model,
       'criteria met: ' || CAST(decision_binary AS VARCHAR) AS answer,
       regexp_replace(abstract, '[ \t\n]+$', '') AS abstract, DATE '2025-01-31' AS run_date
FROM R WHERE human_code IS NOT NULL"""))
def q_report_blocks(spark, sf_dir):
    """Write the adjudication report for the coded records, read it back."""
    from sievekit.session import scratch_dir
    from sievekit.sources.report import read_report, write_report

    r = records(spark, sf_dir).withColumn(
        "answer", F.concat(F.lit("criteria met: "), F.col("decision_binary").cast("string"))
    ).withColumn("run_date", F.lit("2025-01-31"))
    path = scratch_dir(spark, "report")
    write_report(r, path)
    back = read_report(spark, path)
    return tidy(back.select("study_id", "section", "title", "decision_binary", "human_code", "model", "answer",
                            "abstract", "run_date"))


@register("report_ids", with_r("""
SELECT 'study ' || eppi_id || CASE WHEN eppi_id % 2 = 0 THEN ':**' ELSE ': x' END AS study_id,
       CASE eppi_id % 4 WHEN 0 THEN NULL WHEN 1 THEN 'NA' WHEN 2 THEN chr(92) || 'NA' ELSE title END AS title,
       CASE WHEN eppi_id % 3 <> 0 THEN 'a ' || eppi_id END AS abstract
FROM R WHERE human_code IS NOT NULL"""))
def q_report_ids(spark, sf_dir):
    """Ids with blanks and marks, missing values and texts that read like them survive the report (A5 -> A6)."""
    from sievekit.session import scratch_dir
    from sievekit.sources.report import read_report, write_report

    i = F.col("ordinal")
    r = records(spark, sf_dir).withColumns({
        "eppi_id": F.concat(F.lit("study "), i.cast("string"), F.when(i % 2 == 0, ":**").otherwise(": x")),
        "title": F.when(i % 4 == 0, F.lit(None)).when(i % 4 == 1, "NA").when(i % 4 == 2, "\\NA").otherwise(F.col("title")),
        "abstract": F.when(i % 3 != 0, F.concat(F.lit("a "), i.cast("string"))),
        "answer": F.lit("yes"), "run_date": F.lit("2025-01-31")})
    path = scratch_dir(spark, "report")
    write_report(r, path)
    return tidy(read_report(spark, path).select("study_id", "title", "abstract"))


# ---------------------------------------------------------------- I1-I4 model
def _with_vectors(spark, sf_dir):
    from sievekit.sources.tables import table

    emb = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("eppi_id"), "embedding")
    return records(spark, sf_dir).join(emb, "eppi_id")


@register("priority_lambda_max", with_r("""
E AS (SELECT R.eppi_id, CAST(R.decision_binary AS DOUBLE) AS y, e.embedding FROM R JOIN embeddings e ON e.vec_id = R.eppi_id),
X AS (SELECT y, unnest(embedding) AS x, generate_subscripts(embedding, 1) AS j FROM E),
P AS (SELECT j, covar_pop(x, y) AS c, stddev_pop(x) AS s FROM X GROUP BY j)
SELECT round(max(abs(c) / s), 6) AS lambda_max FROM P"""))
def q_lambda_max(spark, sf_dir):
    from sievekit.operators.model import lambda_max_df

    return tidy(lambda_max_df(_with_vectors(spark, sf_dir), "embedding", "decision_binary"))


def _screening(spark, sf_dir, data):
    """Train on all model-included + 100 excluded records; 50 held out; final inclusions flagged."""
    from sievekit.operators.sampling import sample_n
    from sievekit.sources.tables import table

    holdout = sample_n(data.select("eppi_id"), 50, 17).select("eppi_id")
    finals = table(spark, sf_dir, "labels").filter(F.col("toxic") == 1).select(F.col("doc_id").alias("eppi_id"))
    strata = [("included", F.col("decision_binary") == 1, None), ("excluded", F.col("decision_binary") == 0, 100)]
    return strata, holdout, finals


def _priority_data(spark, sf_dir):
    from sievekit.operators.model import record_vectors
    from sievekit.sources.tables import table

    emb = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("eppi_id"), "embedding")
    data = record_vectors(records(spark, sf_dir).join(emb, "eppi_id", "left"), ["title", "abstract"])
    return data.drop("abstract", "embedding")


def _priority(spark, sf_dir):
    """Rank every record that is not trained on."""
    from sievekit.plans.priority import priority_screening

    data = _priority_data(spark, sf_dir)
    strata, holdout, finals = _screening(spark, sf_dir, data)
    return priority_screening(data, strata, 17, vec="record_vector", holdout_ids=holdout, final_ids=finals)[0]


@register("priority_list")
def q_priority_list(spark, sf_dir):
    return tidy(_priority(spark, sf_dir).select("eppi_id", "position", "priority_score", "review_included"))


_TRAIN_SQL = f"""
HO AS (SELECT eppi_id FROM R ORDER BY {_hash_sql('eppi_id', "'17'")}, eppi_id LIMIT 50),
P AS (SELECT * FROM R WHERE eppi_id NOT IN (SELECT eppi_id FROM HO)),
TR AS (SELECT eppi_id FROM P WHERE decision_binary = 1
       UNION ALL (SELECT eppi_id FROM P WHERE decision_binary = 0
                  ORDER BY {_hash_sql('eppi_id', "'17-1'")}, eppi_id LIMIT 100))"""


@register("priority_fit_check", with_r(_TRAIN_SQL + f""",
T AS (SELECT {_hash_sql('eppi_id', "'7'")} % 10 AS fold, decision_binary FROM R WHERE eppi_id IN (SELECT eppi_id FROM TR))
SELECT f.fold, (SELECT count(*) FROM T WHERE T.fold <> f.fold) AS n_train,
       (SELECT count(*) FROM T WHERE T.fold <> f.fold AND decision_binary = 1) AS n_included,
       CAST(100 AS BIGINT) AS n_fits, CAST(100 AS BIGINT) AS n_optimal
FROM (SELECT DISTINCT fold FROM T) f"""))
def q_priority_fit_check(spark, sf_dir):
    """Each fold's training rows, and how many of its fits meet the conditions of a lasso optimum."""
    from sievekit.operators import model as M
    from sievekit.plans.priority import deal_training, screening_split
    from sievekit.session import materialize

    data = _priority_data(spark, sf_dir)
    strata, holdout, _ = _screening(spark, sf_dir, data)
    train = screening_split(data, strata, 17, holdout_ids=holdout)[0]
    train = deal_training(materialize(M.embedding_features(train, "record_vector").select(
        "eppi_id", "decision_binary", "record_vector", "features")))
    top = M.lambda_max(train, "record_vector", "decision_binary")
    gaps = M.cross_validate(train, lam_max=top * 1.0001)[2]
    fits = spark.createDataFrame([(k, len(g), int((g <= M.TOLERANCE).sum())) for k, g in enumerate(gaps)],
                                 "fold int, n_fits long, n_optimal long")
    rows = train.select(M.fold_column("eppi_id", len(gaps)).alias("own"), "decision_binary")
    per = rows.groupBy("own").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("decision_binary") == 1).alias("inc"))
    used = per.select(F.col("own").alias("fold"))
    rest = used.join(F.broadcast(per), F.col("fold") != F.col("own"))  # one row per fold on either side
    sums = rest.groupBy("fold").agg(F.sum("n").alias("n_train"), F.sum("inc").alias("n_included"))
    return tidy(sums.join(fits, "fold").select("fold", "n_train", "n_included", "n_fits", "n_optimal"))


@register("priority_ids", with_r(_TRAIN_SQL + """
SELECT eppi_id, CAST(CASE WHEN coalesce(included_full = 1, false) THEN 1 ELSE 0 END AS BIGINT) AS review_included
FROM R WHERE eppi_id NOT IN (SELECT eppi_id FROM TR)"""))
def q_priority_ids(spark, sf_dir):
    """The records that the list ranks: all but the training set (no model is fitted for them)."""
    from sievekit.operators.joins import flag_ids
    from sievekit.plans.priority import screening_split

    data = records(spark, sf_dir, labels=False).select("eppi_id", "ordinal", "decision_binary")
    strata, holdout, finals = _screening(spark, sf_dir, data)
    unseen = screening_split(data, strata, 17, holdout_ids=holdout)[1]
    return tidy(flag_ids(unseen, finals, "review_included").select("eppi_id", "review_included"))


# ---------------------------------------------------------------- streaming E5
@register("streaming_performance", ORACLE["performance_by_model"])
def q_streaming_performance(spark, sf_dir):
    """Answers land as files (every answer twice); the streaming summary must
    equal the batch one."""
    from sievekit.session import scratch_dir
    from sievekit.streaming.decisions import start_summary

    r = records(spark, sf_dir)
    answers = r.select("eppi_id", "model", "decision_binary")
    base = scratch_dir(spark, "stream")
    for part in ("a", "b"):
        answers.repartition(4, "model").write.mode("overwrite").parquet(f"{base}/answers/{part}")
    q = start_summary(f"{base}/answers/*", r.select("eppi_id", "human_code"), f"{base}/summary", f"{base}/ckpt")
    q.awaitTermination()
    return tidy(spark.read.parquet(f"{base}/summary").select(
        "model", "n", "tp", "fn", "fp", "tn", "recall", "specificity", "precision", "npv", "accuracy", "f1"))


# ---------------------------------------------------------------- E1 E3 A4
@register("included_totals", with_r("""
SELECT model, CAST(count(*) FILTER (WHERE included_full = 1) AS BIGINT) AS n_final,
       CAST(count(*) FILTER (WHERE human_code = 1) AS BIGINT) AS n_human,
       CAST(sum(decision_binary) AS BIGINT) AS sum_decision, CAST(count(*) AS BIGINT) AS n
FROM R GROUP BY model"""))
def q_included_totals(spark, sf_dir):
    from sievekit.operators.aggregates import count_equal

    r = records(spark, sf_dir)
    return tidy(r.groupBy("model").agg(
        count_equal("included_full").alias("n_final"), count_equal("human_code").alias("n_human"),
        F.sum("decision_binary").alias("sum_decision"), F.count(F.lit(1)).alias("n")))


@register("group_summary", with_r("""
SELECT model, CAST(arg_min(decision_binary, ordinal) AS BIGINT) AS first_decision_binary, CAST(count(*) AS BIGINT) AS n,
       round(min(score), 6) AS min_score, round(max(score), 6) AS max_score
FROM R GROUP BY model"""))
def q_group_summary(spark, sf_dir):
    from sievekit.operators.aggregates import group_summary

    return tidy(group_summary(records(spark, sf_dir), ["model"], "decision_binary", "ordinal", "score"))


@register("snapshot_round_trip", with_r("""
SELECT eppi_id, title, CAST(human_code AS BIGINT) AS human_code, CAST(included_full AS BIGINT) AS included_full, model
FROM R"""))
def q_snapshot(spark, sf_dir):
    """A4: save the record table as a Parquet snapshot (partitioned by model) and load it."""
    from sievekit.session import scratch_dir
    from sievekit.sources.tables import load_table, save_table

    path = scratch_dir(spark, "snapshot")
    save_table(records(spark, sf_dir).select("eppi_id", "title", "human_code", "included_full", "model"), path,
               partition_by=["model"])
    return tidy(load_table(spark, path).select("eppi_id", "title", "human_code", "included_full", "model"))


@register("dedup_manual_pairs", with_r(f"""{_CLUSTERS_SQL}
SELECT least(x.cluster_id, y.cluster_id) AS src, greatest(x.cluster_id, y.cluster_id) AS dst,
       round(max(similarity), 6) AS similarity
FROM SIM JOIN CL x ON x.eppi_id = a JOIN CL y ON y.eppi_id = b
WHERE similarity >= 0.5::DOUBLE AND x.cluster_id <> y.cluster_id GROUP BY ALL""").replace("WITH", "WITH RECURSIVE", 1))
def q_dedup_manual(spark, sf_dir):
    """D4 second output: pairs of clusters too doubtful to merge (for review)."""
    from sievekit.operators.dedup import dedup

    out = dedup(records(spark, sf_dir, labels=False).select("eppi_id", "ordinal", "abstract"))
    return tidy(out["manual_pairs"].select("src", "dst", "similarity"))


# ---------------------------------------------------------------- near titles, citation fields
def _ascii_key(c):
    """Title key with one mark for every character outside a-z and 0-9 (DuckDB counts edits in bytes)."""
    from sievekit.functions.scalars import normalise_text

    return F.regexp_replace(normalise_text(c), "[^a-z0-9]", "~")


def _ascii_key_sql(x: str) -> str:
    return f"regexp_replace({_norm_sql(x)}, '[^a-z0-9]', '~', 'g')"


_EDIT_SQL = "1 - levenshtein({a}, {b})::DOUBLE / greatest(length({a}), length({b}))"


@register("title_link_near", with_r(f"""
T AS (SELECT {_ascii_key_sql('title')} AS k, min(eppi_id) AS first_id, count(*) AS n_records FROM R GROUP BY k HAVING k IS NOT NULL),
LST AS (SELECT DISTINCT title[:2] || 'q' || title[4:] AS list_title FROM R WHERE included_full = 1),
LK AS (SELECT list_title, {_ascii_key_sql('list_title')} AS q FROM LST),
P AS (SELECT list_title, first_id, n_records, {_EDIT_SQL.format(a='k', b='q')} AS similarity FROM T JOIN LK
      ON least(length(k), length(q)) >= greatest(length(k), length(q)) * 0.9::DOUBLE - 1e-9
      WHERE levenshtein(k, q) <= floor(greatest(length(k), length(q)) * (1 - 0.9::DOUBLE) + 1e-9))
SELECT list_title, first_id, n_records, round(similarity, 6) AS similarity FROM P"""))
def q_title_link_near(spark, sf_dir):
    """List titles with a typing error, linked to the record titles."""
    from sievekit.operators.near_titles import title_link_near

    r = records(spark, sf_dir)
    lst = r.filter("included_full = 1").select(
        F.concat(F.substring("title", 1, 2), F.lit("q"), F.substr("title", F.lit(4))).alias("list_title")).distinct()
    out = title_link_near(r.select("eppi_id", "title"), lst, _ascii_key("title"), _ascii_key("list_title"))
    return tidy(out.select("list_title", "first_id", "n_records", "similarity"))


_CITATIONS_SQL = f"""
C AS (SELECT eppi_id, {_ascii_key_sql('title')} AS k,
        nullif(lower(regexp_extract(abstract, '([^ \\t\\n\\r]+)[ \\t\\n\\r]*$', 1)), '') AS f1,
        CASE WHEN n_chars % 7 <> 0 THEN (2000 + n_chars % 5)::VARCHAR END AS f2,
        model AS f3, CASE WHEN n_chars % 4 <> 0 THEN lang END AS f4,
        CASE WHEN n_chars % 3 <> 0 THEN n_chars::VARCHAR END AS f5 FROM R),
PR AS (SELECT a.eppi_id AS a, b.eppi_id AS b, {_EDIT_SQL.format(a='a.k', b='b.k')} AS similarity,
         greatest(length(a.k), length(b.k)) AS longer, levenshtein(a.k, b.k) AS d,
         {' + '.join(f'coalesce((a.f{i} = b.f{i})::INT, 0)' for i in range(1, 6))} AS agree,
         {' + '.join(f'coalesce((a.f{i} <> b.f{i})::INT, 0)' for i in range(1, 6))} AS differ
       FROM C a JOIN C b ON a.eppi_id < b.eppi_id
         AND least(length(a.k), length(b.k)) >= greatest(length(a.k), length(b.k)) * 0.85::DOUBLE - 1e-9),
NEAR AS (SELECT * FROM PR WHERE d <= floor(longer * (1 - 0.85::DOUBLE) + 1e-9)),
LINKS AS (SELECT a, b FROM NEAR WHERE similarity >= 0.9::DOUBLE AND agree >= 2 AND differ <= 1),
BOTH_WAYS AS (SELECT a, b FROM LINKS UNION ALL SELECT b, a FROM LINKS),
REACH AS (SELECT eppi_id AS node, eppi_id AS seen FROM C
          UNION SELECT r.node, l.b FROM REACH r JOIN BOTH_WAYS l ON l.a = r.seen),
CL AS (SELECT node AS eppi_id, min(seen) AS cluster_id FROM REACH GROUP BY node)"""


def _citations(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    """The records as citations without abstracts: fields made from text length, last word, source and language."""
    from sievekit.operators.citations import citation_clusters

    r = records(spark, sf_dir, labels=False)
    n = F.col("n_chars")
    last = F.rtrim("abstract", F.lit(" \t\n\r"))  # the last word by cutting: a search for the end tries every word
    for mark in " \t\n\r":
        last = F.substring_index(last, mark, -1)
    fields = {"author": F.nullif(F.lower(last), F.lit("")),
              "year": F.when(n % 7 != 0, (2000 + n % 5).cast("string")), "volume": F.col("model"),
              "issue": F.when(n % 4 != 0, F.col("lang")), "start_page": F.when(n % 3 != 0, n.cast("string"))}
    return citation_clusters(r, fields, _ascii_key("title"))


@register("dedup_citations", with_r(f"{_CITATIONS_SQL}\nSELECT eppi_id AS ordinal, cluster_id FROM CL").replace(
    "WITH", "WITH RECURSIVE", 1))
def q_dedup_citations(spark, sf_dir):
    """Clusters by title and fields."""
    return tidy(_citations(spark, sf_dir)["clusters"])


@register("citation_pairs", with_r(f"""{_CITATIONS_SQL}
SELECT least(x.cluster_id, y.cluster_id) AS src, greatest(x.cluster_id, y.cluster_id) AS dst,
  round(max(similarity), 6) AS similarity, max(agree)::BIGINT AS agree, min(differ)::BIGINT AS differ
FROM NEAR JOIN CL x ON x.eppi_id = a JOIN CL y ON y.eppi_id = b
WHERE differ <= 1 AND x.cluster_id <> y.cluster_id GROUP BY 1, 2""").replace("WITH", "WITH RECURSIVE", 1))
def q_citation_pairs(spark, sf_dir):
    """Pairs of clusters with near titles and too little evidence to merge."""
    return tidy(_citations(spark, sf_dir)["manual_pairs"])


# ---------------------------------------------------------------- corpus build
_CORPUS_SQL = _CLUSTERS_SQL.replace("FROM R)", "FROM R WHERE human_code IS NOT NULL)", 1) + """,
BL AS (SELECT CASE WHEN eppi_id % 3 <> 0 THEN eppi_id END AS id, eppi_id FROM R WHERE included_full = 1),
U AS (SELECT c.cluster_id, count(*) AS n_members, min_by(R.eppi_id, (1 - R.human_code, R.eppi_id)) AS eppi_id,
        min_by(R.human_code, (1 - R.human_code, R.eppi_id)) AS human_code,
        string_agg(DISTINCT CASE WHEN R.human_code = 1 THEN 'included' ELSE 'excluded' END, ', ' ORDER BY
          CASE WHEN R.human_code = 1 THEN 'included' ELSE 'excluded' END) AS labels,
        bool_or(EXISTS (SELECT 1 FROM BL WHERE BL.id = c.eppi_id)) AS is_benchmark
      FROM CL c JOIN R ON R.eppi_id = c.eppi_id GROUP BY c.cluster_id)"""


def _corpus(spark: SparkSession, sf_dir: str):
    """Labelled records in two parts; the benchmark list is the final inclusions, every third one without an id."""
    from sievekit.operators.sets import with_constants
    from sievekit.plans.corpus import build_corpus

    r = records(spark, sf_dir).select("eppi_id", "ordinal", "title", "abstract", "human_code", "included_full")
    r = r.withColumn("eppi_id", F.col("eppi_id").cast("string"))
    part = lambda code, name: with_constants(r.filter(F.col("human_code") == code).drop("included_full"), cite_label=name)
    bench = r.filter("included_full = 1").withColumn("eppi_id", F.when(F.col("eppi_id") % 3 != 0, F.col("eppi_id")).otherwise(""))
    bench = with_constants(bench.drop("included_full"), cite_label="benchmark").withColumn("human_code", F.lit(1))
    return build_corpus([part(1, "included"), part(0, "excluded")], bench, 23)


@register("benchmark_tag", with_r(_CORPUS_SQL + """
SELECT eppi_id::VARCHAR AS eppi_id, is_benchmark, labels, n_members::BIGINT AS n_members FROM U""").replace(
    "WITH", "WITH RECURSIVE", 1))
def q_benchmark_tag(spark, sf_dir):
    """Merged records that hold a benchmark id, whichever member has it."""
    corpus, _ = _corpus(spark, sf_dir)
    return tidy(corpus.filter("n_members IS NOT NULL").select("eppi_id", "is_benchmark", "labels", "n_members"))


@register("corpus_build", with_r(_CORPUS_SQL + """,
ALL_ROWS AS (
  SELECT eppi_id::VARCHAR AS eppi_id, CASE WHEN is_benchmark THEN 'benchmark' ELSE labels END AS cite_label,
    CASE WHEN labels = 'excluded, included' THEN 1 ELSE human_code END AS human_code, n_members FROM U
  UNION ALL SELECT NULL, 'benchmark', 1, NULL FROM BL WHERE id IS NULL)
SELECT eppi_id, cite_label, human_code::BIGINT AS human_code, n_members::BIGINT AS n_members, count(*)::BIGINT AS n_rows
FROM ALL_ROWS GROUP BY ALL""").replace("WITH", "WITH RECURSIVE", 1))
def q_corpus_build(spark, sf_dir):
    """Rows of the corpus (rows without an id have no name, so equal ones are counted)."""
    corpus, _ = _corpus(spark, sf_dir)
    return tidy(corpus.groupBy("eppi_id", "cite_label", "human_code", "n_members").agg(F.count(F.lit(1)).alias("n_rows")))


# ---------------------------------------------------------------- large lists: many cells
_EVENTS_SQL = """
WITH I AS (SELECT event_id AS eppi_id, event_id AS ordinal,
                  CASE WHEN user_id % 7 = 0 THEN NULL WHEN user_id % 7 = 1 THEN 'NaN'::DOUBLE
                       ELSE floor(value / 5) END AS score,
                  CASE event_type WHEN 'click' THEN 1 WHEN 'view' THEN 0 END AS human_code FROM events),
K AS (SELECT *, CASE WHEN isnan(score) THEN NULL ELSE score END AS k FROM I)"""
_EVENT_CELL = 400  # rows per cell, so that the small tables run the split path


def _event_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    from sievekit.sources.tables import table

    kind = F.col("user_id") % 7
    score = F.when(kind == 0, None).when(kind == 1, F.lit(float("nan"))).otherwise(
        F.floor(F.col("value") / 5).cast("double"))
    code = F.when(F.col("event_type") == "click", 1).when(F.col("event_type") == "view", 0)
    return table(spark, sf_dir, "events").select(
        F.col("event_id").alias("eppi_id"), F.col("event_id").alias("ordinal"), score.alias("score"),
        code.alias("human_code"))


@register("rank_events", _EVENTS_SQL + """
SELECT eppi_id, CAST(row_number() OVER (ORDER BY k DESC NULLS LAST, ordinal) AS BIGINT) AS position FROM K""")
def q_rank_events(spark, sf_dir):
    from sievekit.plans.global_order import rank_rows

    ranked = rank_rows(_event_list(spark, sf_dir), "score", "ordinal", rows_per_bucket=_EVENT_CELL, totals=False)
    return tidy(ranked.select("eppi_id", "position"))


@register("curve_events", _EVENTS_SQL + """,
L AS (SELECT eppi_id, row_number() OVER w AS position,
             sum(CASE WHEN human_code = 1 THEN 1 ELSE 0 END) OVER w AS cum, count(*) OVER () AS n,
             sum(CASE WHEN human_code = 1 THEN 1 ELSE 0 END) OVER () AS total
      FROM K WINDOW w AS (ORDER BY k DESC NULLS LAST, ordinal ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))
SELECT eppi_id, CAST(position AS BIGINT) AS position, CAST(cum AS BIGINT) AS cumulative_relevant,
       round(CAST(cum AS DOUBLE) / total * 100, 6) AS recall, round(CAST(position AS DOUBLE) / n * 100, 6) AS perc_of_total
FROM L""")
def q_curve_events(spark, sf_dir):
    curve = order.recall_curve(_event_list(spark, sf_dir), "human_code", rows_per_bucket=_EVENT_CELL)
    return tidy(curve.select("eppi_id", "position", "cumulative_relevant", "recall", "perc_of_total"))


@register("lag_events", _EVENTS_SQL + """,
P AS (SELECT *, row_number() OVER w AS n, lag(human_code) OVER w AS before_code, lag(eppi_id) OVER w AS before_id
      FROM K WINDOW w AS (ORDER BY k DESC NULLS LAST, ordinal))
SELECT eppi_id, CASE WHEN n = 1 THEN human_code ELSE before_code END::BIGINT AS code_before,
       CASE WHEN n = 1 THEN eppi_id ELSE before_id END AS id_before FROM P""")
def q_lag_events(spark, sf_dir):
    """F3 over a list of many cells, with ties, nulls and NaN."""
    from sievekit.plans.global_order import lag_rows

    out = lag_rows(_event_list(spark, sf_dir), {"code_before": "human_code", "id_before": "eppi_id"}, "score", "ordinal",
                   rows_per_bucket=_EVENT_CELL)
    return tidy(out.select("eppi_id", "code_before", "id_before"))


# ---------------------------------------------------------------- rows without an id (G3 G4 G6), decimals (B4), audit
_TEXT_IDS_SQL = "CASE WHEN doc_id % 3 = 0 THEN NULL ELSE 'id-' || doc_id END"


def _text_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    from sievekit.sources.tables import table

    return table(spark, sf_dir, "documents").select(
        F.when(F.col("doc_id") % 3 != 0, F.concat(F.lit("id-"), F.col("doc_id").cast("string"))).alias("eppi_id"),
        F.col("doc_id").alias("ordinal"), "n_chars")


_TEXT_HASH_SQL = _hash_sql(f"coalesce({_TEXT_IDS_SQL}, 'row ' || doc_id)", "'42'")


@register("sample_missing_ids", f"""
WITH H AS (SELECT {_TEXT_IDS_SQL} AS eppi_id, doc_id AS ordinal, {_TEXT_HASH_SQL} AS h FROM documents),
K AS (SELECT *, row_number() OVER (ORDER BY h, ordinal) AS sample_rank FROM H)
SELECT eppi_id, ordinal, CAST(sample_rank AS BIGINT) AS sample_rank FROM K WHERE sample_rank <= 150""")
def q_sample_missing_ids(spark, sf_dir):
    from sievekit.operators.sampling import sample_n

    return tidy(sample_n(_text_ids(spark, sf_dir), 150, 42).select("eppi_id", "ordinal", "sample_rank"))


@register("strata_missing_ids", f"""
WITH S AS (SELECT {_TEXT_IDS_SQL} AS eppi_id, doc_id AS ordinal, n_chars % 2 AS stratum_index,
             {_hash_sql(f"coalesce({_TEXT_IDS_SQL}, 'row ' || doc_id)", "'7-' || CAST(n_chars % 2 AS VARCHAR)")} AS h
           FROM documents),
K AS (SELECT *, row_number() OVER (PARTITION BY stratum_index ORDER BY h, eppi_id NULLS FIRST, ordinal) AS r FROM S)
SELECT eppi_id, ordinal, CAST(stratum_index AS BIGINT) AS stratum_index, CAST(r AS BIGINT) AS sample_rank FROM K
WHERE r <= CASE stratum_index WHEN 0 THEN 90 ELSE 60 END""")
def q_strata_missing_ids(spark, sf_dir):
    from sievekit.operators.sampling import sample_strata

    even = F.col("n_chars") % 2 == 0
    s = sample_strata(_text_ids(spark, sf_dir), [("even", even, 90), ("odd", ~even, 60)], 7)
    return tidy(s.select("eppi_id", "ordinal", "stratum_index", "sample_rank"))


@register("cast_decimals", """
SELECT l_orderkey, CAST(l_linenumber AS BIGINT) AS l_linenumber,
       CAST(trunc(CAST(CAST(l_extendedprice AS VARCHAR) AS DOUBLE)) AS BIGINT) AS price_whole FROM lineitem""")
def q_cast_decimals(spark, sf_dir):
    from sievekit.functions.scalars import to_number
    from sievekit.sources.tables import table

    items = table(spark, sf_dir, "lineitem").withColumn("price", F.col("l_extendedprice").cast("string"))
    return tidy(items.select("l_orderkey", "l_linenumber", to_number("price", "bigint").alias("price_whole")))


@register("label_conflict_rows", with_r(_GROUPS_SQL + """,
C AS (SELECT k FROM G WHERE cite_label IS NOT NULL AND k IS NOT NULL GROUP BY k HAVING count(DISTINCT cite_label) = 2)
SELECT eppi_id, cite_label FROM G WHERE k IN (SELECT k FROM C)"""))
def q_label_conflict_rows(spark, sf_dir):
    from sievekit.functions.scalars import normalise_text
    from sievekit.operators.aggregates import label_conflict_rows
    from sievekit.operators.dedup import key_hash

    r = records(spark, sf_dir).select(
        "eppi_id", key_hash(normalise_text("abstract")).alias("k"),
        F.when(F.col("human_code") == 1, "included").when(F.col("human_code") == 0, "excluded").alias("cite_label"))
    return tidy(label_conflict_rows(r, "k", "cite_label").select("eppi_id", "cite_label"))


# ---------------------------------------------------------------- A2 labels, J2 flips
@register("ris_labels", with_r("""
SELECT CAST(eppi_id AS VARCHAR) AS eppi_id,
       CASE eppi_id % 3 WHEN 0 THEN 'included' WHEN 1 THEN 'excluded' ELSE 'benchmark' END AS cite_label,
       CAST(CASE eppi_id % 3 WHEN 0 THEN 1 WHEN 1 THEN 0 END AS BIGINT) AS human_code FROM R"""))
def q_ris_labels(spark, sf_dir):
    """Three labelled citation files whose names end alike (A2)."""
    from sievekit.session import scratch_dir
    from sievekit.sources.ris import read_ris, write_ris

    base = scratch_dir(spark, "labelled")
    paths = [f"{base}/{name}" for name in ("incl.ris", "asylum_incl.ris", "more_asylum_incl.ris")]
    consts = [{"cite_label": "included", "human_code": 1}, {"cite_label": "excluded", "human_code": 0},
              {"cite_label": "benchmark"}]
    src = _ris_source(spark, sf_dir)
    for i, p in enumerate(paths):
        write_ris(src.filter(F.col("ordinal") % 3 == i), p)
    back = read_ris(spark, paths, labels=dict(zip(paths, consts, strict=True)))
    return tidy(back.select("eppi_id", "cite_label", "human_code"))


@register("run_flips", with_r("""
SELECT R.eppi_id, CAST(R.decision_binary AS BIGINT) AS decision_a, CAST(l.quality AS BIGINT) AS decision_b
FROM R JOIN labels l ON l.doc_id = R.eppi_id WHERE R.decision_binary IS DISTINCT FROM l.quality"""))
def q_run_flips(spark, sf_dir):
    from sievekit.operators.agreement import flips

    return tidy(flips(*_runs_ab(spark, sf_dir)))
