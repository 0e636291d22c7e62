"""Array-column arithmetic for dense feature vectors (higher-order functions,
stay inside whole-stage codegen)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def _col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def weights_literal(weights: Sequence[float]) -> Column:
    """A constant ``ARRAY<DOUBLE>`` (the model is tiny and fixed in size)."""
    return F.array(*[F.lit(float(w)) for w in weights])


def dot(x: str | Column, weights: Sequence[float]) -> Column:
    """``w·x`` with nulls counting as 0 (the svmlight reader's convention)."""
    xs = _col(x)
    terms = [F.coalesce(xs[i], F.lit(0.0)) * F.lit(float(w)) for i, w in enumerate(weights) if w != 0.0]
    if not terms:
        return F.lit(0.0)
    out = terms[0]
    for t in terms[1:]:
        out = out + t
    return out


def diff(a: str | Column, b: str | Column) -> Column:
    """Element-wise ``a − b`` (G1)."""
    return F.zip_with(_col(a), _col(b), lambda u, v: F.coalesce(u, F.lit(0.0)) - F.coalesce(v, F.lit(0.0)))


def scale(x: str | Column, factor: Column) -> Column:
    """Multiply every element by a scalar column."""
    return F.transform(_col(x), lambda u: u * factor)


def standardize(x: str | Column, means: Sequence[float], stds: Sequence[float]) -> Column:
    """``(x − mean) / std`` per position; std 0 divides by 1."""
    m = weights_literal(means)
    s = weights_literal([v if v != 0.0 else 1.0 for v in stds])
    return F.transform(_col(x), lambda u, i: (u - m[i]) / s[i])


def to_double_array(x: str | Column) -> Column:
    return _col(x).cast("array<double>")
