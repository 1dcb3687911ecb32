"""Secret scans with an incremental blob ledger (operator 4, native).

Every version of a text is a blob, addressed by the SHA-256 of its content.
The ledger lists, per blob, the rule versions that have scanned it and the
spans they found. A run works out which pairs of blob and rule version are
unseen, scans one copy of each such blob with those rules alone, appends the
result to the ledger and joins the spans back to every path that holds the
blob, now or in an earlier version.

Spans come from two built-in functions: the matches of a pattern and the text
between them; running sums of their lengths give the places.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sievekit.llm.common import stash

LEDGER = "sha string, rules array<string>, spans array<struct<start:long,place:int,kind:string,end:long>>"


@dataclass(frozen=True)
class Rule:
    """One pattern; a match counts if its group ``group`` has ``least`` characters or more."""

    kind: str
    version: int
    pattern: str
    group: int = 0
    least: int = 1

    @property
    def name(self) -> str:
        return f"{self.kind}@{self.version}"


# The three base rules, then rules that this method adds.
BASE = ("assign", "access", "hex")
RULES = (
    Rule("assign", 1, r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
         2, 6),
    # AKIA[A-Z0-9]+ of 20 characters and [0-9a-f]+ of 24: a run too short holds no longer one.
    Rule("access", 1, r"AKIA[A-Z0-9]{16,}"),
    Rule("hex", 1, r"[0-9a-f]{24,}+"),
    Rule("pem", 1, r"-----BEGIN [A-Z ]{0,20}PRIVATE KEY-----"),
    Rule("github", 1, r"gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("jwt", 1, r"eyJ[A-Za-z0-9_-]{10,}\.eyJ[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}"),
)


def content_address(text: Column) -> Column:
    """SHA-256 (lowercase hex) of the text; null counts as empty."""
    return F.sha2(F.coalesce(text.cast("string"), F.lit("")).cast("binary"), 256)


def _places(zipped: Column, place: int, rule: Rule) -> Column:
    return F.coalesce(F.transform(zipped, lambda x, i: F.struct(
        F.lit(place).alias("place"), F.lit(rule.kind).alias("kind"), i.alias("i"), F.length(x["g"]).alias("gap"),
        F.length(x["m"]).alias("size"), (F.length(x["k"]) >= rule.least).alias("ok"))), F.array())


def _matches(df: DataFrame, rules: tuple[Rule, ...]) -> DataFrame:
    """``sha, todo, place, kind, i, gap, size, ok``: the matches of every rule that the blob still lacks.

    A blob without matches has one row without a kind.
    """
    hits = [f"__m{k}" for k in range(len(rules))]
    for h, r in zip(hits, rules, strict=True):
        df = df.withColumn(h, F.when(F.array_contains("todo", r.name), F.regexp_extract_all(
            "text", F.lit(r.pattern), F.lit(0))))
    lists = []
    for place, (h, r) in enumerate(zip(hits, rules, strict=True)):
        found = F.size(h) > 0
        gaps = F.when(found, F.split("text", r.pattern, -1))
        kept = F.when(found, F.regexp_extract_all("text", F.lit(r.pattern), F.lit(r.group))) if r.group else F.col(h)
        zipped = F.arrays_zip(gaps.alias("g"), F.col(h).alias("m"), kept.alias("k"))
        lists.append(_places(F.when(found, zipped), place, r))
    # Outer, or a filter on the array would run every pattern a second time.
    return df.select("sha", "todo", F.inline_outer(F.concat(*lists)))


def scan_blobs(blobs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """Ledger rows of ``blobs`` (``sha, text, todo``): each is scanned by the rules named in ``todo``."""
    rows = _matches(blobs, rules).distinct()
    order = Window.partitionBy("sha", "kind").orderBy("i").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    ended = rows.withColumn("end", F.sum(F.col("gap") + F.coalesce("size", F.lit(0))).over(order))
    span = F.struct((F.col("end") - F.col("size")).alias("start"), "place", "kind", F.col("end"))
    return ended.groupBy("sha").agg(
        F.first("todo").alias("rules"),
        F.sort_array(F.collect_list(F.when(F.col("ok"), span))).alias("spans"))


def update_ledger(docs: DataFrame, ledger: DataFrame | None = None, id_col: str = "doc_id", text_col: str = "text",
                  rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """New ledger rows for the blobs of ``docs``; only unseen pairs of blob and rule version are scanned."""
    spark, names = docs.sparkSession, F.array(*[F.lit(r.name) for r in rules])
    held = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"),
                       content_address(F.col(text_col)).alias("sha"))
    one = held.groupBy("sha").agg(F.min("id").alias("id"))
    done = (ledger if ledger is not None else spark.createDataFrame([], LEDGER)).groupBy("sha").agg(
        F.flatten(F.collect_list("rules")).alias("done"))
    todo = one.join(done, "sha", "left").withColumn("todo", F.array_except(names, F.coalesce("done", F.array())))
    todo = todo.filter(F.size("todo") > 0).select(F.col("sha").alias("s"), F.col("id").alias("i"), "todo")
    # One row of a blob stands for all: its text alone is moved.
    chosen = held.join(todo, (F.col("sha") == F.col("s")) & F.col("id").eqNullSafe(F.col("i")))
    return scan_blobs(chosen.select("sha", "text", "todo"), rules)


def scan_secrets(docs: DataFrame, ledger: DataFrame | None = None, id_col: str = "doc_id", text_col: str = "text",
                 rules: tuple[Rule, ...] = RULES) -> tuple[DataFrame, DataFrame]:
    """``(findings, new ledger rows)``: every row of ``docs`` with the spans of its text.

    ``findings`` has ``id_col, sha, spans`` (structs of start, place, kind,
    end in code points, end exclusive, sorted). Null texts count as empty;
    versions of one path are rows of their own; repeated rows get the same
    spans. A null id keeps its own row. An empty table gives an empty result.
    Only the two named columns are read. Append the second frame to the
    ledger: a later run scans its blobs no more.
    """
    fresh = stash(update_ledger(docs, ledger, id_col, text_col, rules), "ledger")
    every = fresh if ledger is None else ledger.unionByName(fresh)
    # A ledger row's spans count for the rule versions asked for, not for older ones.
    name = F.create_map(*[x for r in rules for x in (F.lit(r.kind), F.lit(r.name))])
    known = every.filter(F.size("spans") > 0).withColumn("spans", F.filter(
        "spans", lambda x: F.array_contains("rules", name[x["kind"]])))
    known = known.groupBy("sha").agg(F.sort_array(F.array_distinct(F.flatten(F.collect_list("spans")))).alias("spans"))
    paths = docs.select(F.col(id_col), content_address(F.col(text_col)).alias("sha"))
    found = paths.join(known, "sha", "left").select(
        id_col, "sha", F.coalesce("spans", F.array().cast(known.schema["spans"].dataType)).alias("spans"))
    return found, fresh


def span_digest(spans: Column) -> Column:
    """``kind:start:end`` of every span, comma-joined in order."""
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(
        ":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")
