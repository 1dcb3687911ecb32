"""Column expressions with the missing-value rules of the screening scripts.

All are built-in Spark expressions (JVM side, whole-stage codegen).
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def col_(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def blank_to_null(c: str | Column) -> Column:
    """``""`` becomes null; other values, null included, unchanged."""
    return F.nullif(col_(c), F.lit(""))


def blanks_to_null(df: DataFrame, columns: Iterable[str] | None = None) -> DataFrame:
    """B3 over named columns, or over every string column of the schema."""
    if columns is None:
        columns = [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType)]
    return df.withColumns({c: blank_to_null(c) for c in columns})


_WHOLE = ("tinyint", "smallint", "int", "integer", "bigint", "long")


def to_number(c: str | Column, kind: str = "double") -> Column:
    """Numeric cast where a malformed value becomes null, never an error.

    A whole-number type drops the decimals of a decimal text ("12.7" gives
    12, "2013.0" gives 2013); a text of digits is read exactly.
    """
    x = col_(c)
    if kind.lower() not in _WHOLE:
        return x.try_cast(kind)
    cut = F.when(F.isnan(x.try_cast("double")), None).otherwise(x.try_cast("double"))
    return F.coalesce(x.try_cast("bigint"), cut.try_cast("bigint")).try_cast(kind)


def if_else(cond: Column, yes, no) -> Column:
    """Two-way conditional; a null condition gives null (not ``no``)."""
    yes = yes if isinstance(yes, Column) else F.lit(yes)
    no = no if isinstance(no, Column) else F.lit(no)
    return F.when(cond, yes).when(~cond, no)


def paste(*cols: str | Column, sep: str = " ", na: str = "text") -> Column:
    """Join values with ``sep``.

    ``na="text"`` turns a missing value into the text ``NA`` (the default of
    the scripts); ``na="skip"`` leaves missing values out.
    """
    cs = [col_(c) for c in cols]
    if na == "skip":
        return F.concat_ws(sep, *cs)
    parts: list[Column] = []
    for i, c in enumerate(cs):
        if i:
            parts.append(F.lit(sep))
        parts.append(F.coalesce(c.cast("string"), F.lit("NA")))
    return F.concat(*parts)


def ratio(num: str | Column, den: str | Column, scale: float = 1.0) -> Column:
    """``num / den * scale``; a zero denominator gives null (no error)."""
    return F.try_divide(col_(num).cast("double"), col_(den).cast("double")) * F.lit(float(scale))


def percent(num: str | Column, den: str | Column) -> Column:
    return ratio(num, den, 100.0)


def flag_eq(c: str | Column, value) -> Column:
    """``c == value`` as a nullable boolean."""
    return col_(c) == F.lit(value)


def round_half_even(c: str | Column, digits: int = 0) -> Column:
    """R's ``round`` (2.5 -> 2)."""
    return F.bround(col_(c), digits)


def column_range(df: DataFrame, first: str, last: str) -> list[str]:
    """B1: the inclusive column range ``first:last`` in schema order."""
    names = df.columns
    i, j = names.index(first), names.index(last)
    if i > j:
        i, j = j, i
    return names[i : j + 1]


def select_range(df: DataFrame, first: str, last: str, keep: Iterable[str] = ()) -> DataFrame:
    return df.select(*keep, *column_range(df, first, last))


def normalise_text(c: str | Column) -> Column:
    """Comparison key for titles/texts: letters, marks and digits of any script, lower case.

    The common HTML entities (``&amp;`` ``&lt;`` ``&gt;`` ``&quot;``
    ``&#39;``) stand for punctuation, which the key drops, so they are
    dropped whole (only texts that contain ``&`` are searched); then the
    text is lower-cased and all other characters are dropped. A text with
    nothing left has no key (null), so it equals no other.
    """
    x = col_(c)
    x = F.when(F.instr(x, "&") > 0, F.regexp_replace(x, r"&(?:amp|lt|gt|quot|#39);", "")).otherwise(x)
    return F.nullif(F.regexp_replace(F.lower(x), r"[^\p{L}\p{M}\p{N}]+", ""), F.lit(""))


def normalise_doi(c: str | Column) -> Column:
    """DOI without resolver prefix, lower case, trimmed."""
    x = F.lower(F.trim(col_(c)))
    x = F.regexp_replace(x, r"^(https?://)?(dx\.)?doi\.org/", "")
    x = F.regexp_replace(x, r"^doi:\s*", "")
    return blank_to_null(x)


def first_line(c: str | Column) -> Column:
    return F.split_part(col_(c), F.lit("\n"), F.lit(1))


def hash_key(ident: str | Column, seed: int | str | Column, part: int = 0) -> Column:
    """Repeatable pseudo-random order key for sampling and shuffling.

    13 hex digits of ``md5(id || ':' || seed)`` as a bigint (``part`` 0: the
    first 13, 1: the next 13): it depends on the row only (not on
    partitioning), fits a double exactly, and the same number can be computed
    by any SQL engine with ``md5``.
    """
    sd = seed if isinstance(seed, Column) else F.lit(str(seed))
    s = F.concat(col_(ident).cast("string"), F.lit(":"), sd)
    return F.conv(F.substring(F.md5(s), 1 + 13 * part, 13), 16, 10).cast("long")
