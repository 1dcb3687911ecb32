"""Stacking tables by column name and distinct values (H1 H2 A2 B2)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def bind_rows(*dfs: DataFrame, part_col: str | None = "part", ordinal: str = "ordinal") -> DataFrame:
    """H1 ``bind_rows``: UNION ALL by column name, missing columns null.

    Types of a shared column must agree (R refuses e.g. text vs number; Spark
    would silently widen). ``part_col`` records which input a row came from
    (a nested bind keeps its own parts under ``<part_col>_inner``). An
    ``ordinal`` that every input has is renumbered: from the second input on,
    ordinals follow those of the inputs before, so they stay unique and in stacked
    order (one small aggregate per input).
    """
    types: dict[str, str] = {}
    for i, d in enumerate(dfs):
        for f in d.schema.fields:
            t = f.dataType.simpleString()
            if f.name in types and types[f.name] != t and t != "void" and types[f.name] != "void":
                raise TypeError(f"column {f.name!r}: {types[f.name]} vs {t} (input {i})")
            types.setdefault(f.name, t)
    if all(dict(d.dtypes).get(ordinal) in ("bigint", "int") for d in dfs) and len(dfs) > 1:
        last, moved = None, []
        for d in dfs:
            lo, hi = d.agg(F.min(ordinal), F.max(ordinal)).first()
            shift = 0 if lo is None or last is None else last + 1 - int(lo)
            moved.append(d.withColumn(ordinal, F.col(ordinal).cast("long") + shift))
            last = last if lo is None else int(hi) + shift
        dfs = tuple(moved)
    if part_col:
        dfs = tuple(d.withColumnRenamed(part_col, f"{part_col}_inner").withColumn(part_col, F.lit(i))
                    for i, d in enumerate(dfs))
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), dfs)


def with_constants(df: DataFrame, **values) -> DataFrame:
    """B2/A2: constant columns, e.g. ``cite_source="search", human_code=1``.

    ``None`` gives a typed null when passed as ``(None, "double")``.
    """
    cols = {}
    for k, v in values.items():
        if isinstance(v, tuple) and v[0] is None:
            cols[k] = F.lit(None).cast(v[1])
        else:
            cols[k] = F.lit(v)
    return df.withColumns(cols)


def unique_values(df: DataFrame, column: str) -> DataFrame:
    """H2 ``unique``: distinct values of one column (one null kept)."""
    return df.select(column).distinct()
