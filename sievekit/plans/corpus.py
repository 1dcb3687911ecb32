"""The labelled corpus build: stack, clean, de-duplicate, tag, settle conflicts, add, shuffle.

One plan over the operators: labelled record tables are stacked (H1) and
blanks become missing (B3); copies merge and keep all their labels (D4);
a record is a benchmark study if any of its members has a benchmark id (D3);
a record with conflicting labels gets code 1 (E7), which is settled on the
members' labels, so the tag cannot hide a conflict; benchmark rows without an
id are appended (H1) and all rows are put into a seeded order (G4).
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sievekit.functions.scalars import blanks_to_null
from sievekit.operators.dedup import dedup
from sievekit.operators.joins import flag_by_member
from sievekit.operators.sampling import shuffle_rows
from sievekit.operators.sets import bind_rows
from sievekit.session import materialize


def build_corpus(parts: list[DataFrame], benchmark: DataFrame, seed: int | str, key: str = "eppi_id",
                 ordinal: str = "ordinal", positive: str = "included", tag: str = "benchmark",
                 merge: Callable[..., dict[str, DataFrame]] = dedup) -> tuple[DataFrame, dict[str, DataFrame]]:
    """``(corpus, outputs of the merge)`` from labelled tables and a benchmark list.

    ``parts`` and ``benchmark`` have ``key``, ``ordinal``, ``abstract``,
    ``cite_label`` and ``human_code``. The corpus has the columns of the parts,
    ``n_members``, ``labels`` (all members' labels), ``is_benchmark`` and
    ``position``. ``cite_label`` is ``tag`` for benchmark records, else
    ``labels``; ``human_code`` is 1 where the members' labels are several and
    one of them is ``positive``. All rows are kept: the order is drawn over the
    whole corpus, appended rows included.
    """
    rows = materialize(blanks_to_null(bind_rows(*parts, part_col=None, ordinal=ordinal)))
    bench = blanks_to_null(benchmark)
    out = merge(rows, id_col=key, ordinal=ordinal, label="cite_label")
    tagged = flag_by_member(out["unique"], out["clusters"], bench, "is_benchmark", key)
    several = F.contains("labels", F.lit(", ")) & F.array_contains(F.split("labels", ", "), positive)
    settled = tagged.withColumn("human_code", F.when(several, F.lit(1)).otherwise(F.col("human_code").cast("int"))).withColumn(
        "cite_label", F.when(F.col("is_benchmark"), F.lit(tag)).otherwise(F.col("labels")))
    settled = settled.drop("cluster_id")
    extra = bench.filter(F.col(key).isNull()).select(*[c for c in rows.columns if c in bench.columns]).withColumns({
        "human_code": F.col("human_code").cast("int"), "is_benchmark": F.lit(True), "cite_label": F.lit(tag)})
    corpus = materialize(bind_rows(settled, extra, part_col=None, ordinal=ordinal))
    return shuffle_rows(corpus, seed, key, ordinal=ordinal), out
