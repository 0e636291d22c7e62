"""Report tables behind the reference's figures."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .measures import GAMMA

# Fixed value: the exposure figure uses a stop probability of 0.8.
CURVE_STOP = 0.8


def exposure_curve(ranks: DataFrame, *, gamma: float = GAMMA, stop: float = CURVE_STOP, rank: str = "rank") -> DataFrame:
    """Exposure at each rank for an all-relevant and an all-irrelevant
    list: γ^(i−1)·(1 − stop·rel)^(i−1); ``ranks`` supplies the rank positions."""
    r = ranks.select(F.col(rank).alias("rank")).distinct()
    i1 = (F.col("rank") - 1).cast("double")
    return r.select(
        "rank",
        (F.pow(F.lit(gamma), i1) * F.pow(F.lit(1.0 - stop), i1)).alias("relevant"),
        F.pow(F.lit(gamma), i1).alias("irrelevant"),
    )


def group_share_stack(shares: DataFrame) -> DataFrame:
    """Stacked-bar data: per gid (ascending) and measure, the share, the
    cumulative offset below it, the label midpoint and a '12.3%' label.

    ``shares`` is the per-group table of H8 (one row per group id, so the
    un-partitioned window runs over a handful of rows)."""
    long = shares.select(
        "gid",
        F.explode(
            F.array(
                F.struct(F.lit("relevance").alias("measure"), F.col("relevance_share").alias("share")),
                F.struct(F.lit("exposure").alias("measure"), F.col("exposure_share").alias("share")),
            )
        ).alias("m"),
    ).select("gid", "m.measure", "m.share")
    w = Window.partitionBy("measure").orderBy("gid").rowsBetween(Window.unboundedPreceding, -1)
    return long.select(
        "gid",
        "measure",
        "share",
        F.coalesce(F.sum("share").over(w), F.lit(0.0)).alias("bottom"),
    ).select(
        "gid",
        "measure",
        "share",
        "bottom",
        (F.col("bottom") + F.col("share") / 2).alias("label_y"),
        F.format_string("%.1f%%", F.col("share") * 100).alias("label"),
    )
