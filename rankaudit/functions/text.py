"""Column expressions for text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed value: the default word pattern of the reference's vectoriser
# ("(?u)\b\w\w+\b"), i.e. lower-cased runs of two or more Unicode letters,
# digits or underscores.  Java's plain \w is ASCII-only and (?U)\w also takes
# combining marks, so the classes are spelled out.
TOKEN_PATTERN = r"[\p{L}\p{N}_]{2,}"


def _col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def tokens(text: str | Column) -> Column:
    """Array of tokens of one text field (null text -> empty array)."""
    return F.regexp_extract_all(F.lower(F.coalesce(_col(text), F.lit(""))), F.lit(TOKEN_PATTERN), 0)


def n_tokens(text: str | Column) -> Column:
    """Token count of a field (document length ``d``)."""
    return F.size(tokens(text)).cast("bigint")


def word_counts(words: Column) -> Column:
    """``array<struct<term, tf>>`` by term, of an array of words: the runs of the sorted array, so
    a row is counted where it lies."""

    def runs(s: Column) -> Column:
        starts = F.array_compact(F.transform(s, lambda w, i: F.when((i == 0) | (w != F.get(s, i - 1)), i)))
        # array(x) and [0] bind x once for the inner function
        return F.transform(
            F.array(starts),
            lambda at: F.transform(at, lambda p, j: F.struct(F.get(s, p).alias("term"), (F.coalesce(F.get(at, j + 1), F.size(s)) - p).cast("bigint").alias("tf"))),
        )[0]

    return F.transform(F.array(F.sort_array(words)), runs)[0]


def char_length(text: str | Column) -> Column:
    """F8: length in characters (code points); null -> 0."""
    return F.length(F.coalesce(_col(text), F.lit(""))).cast("bigint")


def int_value(c: str | Column, dtype: str = "string") -> Column:
    """integer value of a column, null when it does not parse.

    Strings are trimmed and must be a whole number; floating values are
    truncated towards zero and NaN gives null.
    """
    col = _col(c)
    if dtype in ("double", "float"):
        return F.when(~F.isnan(col), col.try_cast("bigint"))
    if dtype in ("bigint", "int", "smallint", "tinyint", "long", "integer"):
        return col.cast("bigint")
    trimmed = F.trim(col.cast("string"))
    return F.when(trimmed.rlike(r"^[+-]?[0-9]+$"), trimmed.try_cast("bigint"))
