"""Ranking by a linear model.

A ranked list is a flat table ``qid, rank, ord, doc_id, rel, score,
features``; order is a column, ties are broken by the row ordinal.  Lists too long for one
task are numbered in blocks (``scan``).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

from ..functions.vectors import diff, dot, standardize
from .scan import number_rows


def score(rows: DataFrame, weights: Sequence[float], features: str = "features", *, means=None, stds=None) -> DataFrame:
    """``score = w·x`` (raw features by default, as the reference applies the
    model; pass ``means``/``stds`` to score scaled features instead)."""
    x = F.col(features)
    if means is not None:
        x = standardize(x, means, stds)
    return rows.withColumn("score", dot(x, weights))


def rank_documents(
    rows: DataFrame,
    weights: Sequence[float],
    *,
    features: str = "features",
    qid: str = "qid",
    ord_col: str = "ord",
    means=None,
    stds=None,
) -> DataFrame:
    """H1: per query, descending model score; ties by ordinal ascending."""
    return number_rows(score(rows, weights, features, means=means, stds=stds), qid, "score", ord_col, "rank")


def predict_order(
    rows: DataFrame, weights: Sequence[float], features: str = "features", ord_col: str = "ord", qid: str = "qid"
) -> DataFrame:
    """Per query, 0-based position of each row when sorted by ``w·x``
    ascending (argsort; ties by ordinal)."""
    placed = number_rows(score(rows, weights, features), qid, "score", ord_col, "position", descending=False)
    return placed.withColumn("position", F.col("position") - 1)


def prefer(pairs: DataFrame, weights: Sequence[float], intercept: float, a: str = "x_a", b: str = "x_b") -> DataFrame:
    """+1 when the first document is preferred: sign of w·(a−b)+b0 > 0."""
    m = dot(diff(a, b), weights) + F.lit(float(intercept))
    return pairs.withColumn("prefer", F.when(m > 0, F.lit(1)).otherwise(F.lit(-1)))


def preference_margin(pairs: DataFrame, weights: Sequence[float], a: str = "x_a", b: str = "x_b") -> DataFrame:
    """w·(a−b), no intercept."""
    return pairs.withColumn("margin", dot(diff(a, b), weights))


def pairwise_order(rows: DataFrame, weights: Sequence[float], intercept: float, *, qid: str = "qid", ord_col: str = "ord") -> DataFrame:
    """Q6 parity option: the reference sorts each query with the comparator
    ``predict(b − a)`` (intercept included, never 0).  Reproduced per query
    with ``applyInPandas`` and Python's ``cmp_to_key`` sort; for parity tests,
    not for scale (it is sequential within a query)."""
    import functools

    import numpy as np
    import pandas as pd

    w = np.asarray(weights, dtype=float)
    b0 = float(intercept)

    def per_query(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(ord_col)
        xs = [np.nan_to_num(np.asarray(x, dtype=float)) for x in pdf["features"]]

        def cmp(i, j):
            return 1 if float(np.dot(xs[j] - xs[i], w)) + b0 > 0 else -1

        order = sorted(range(len(xs)), key=functools.cmp_to_key(cmp))
        out = pdf.iloc[order].copy()
        out["rank"] = np.arange(1, len(out) + 1)
        return out

    schema = StructType([*rows.schema.fields, StructField("rank", IntegerType())])
    return rows.groupBy(qid).applyInPandas(per_query, schema=schema)
