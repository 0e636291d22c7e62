"""Ranks and running values of long lists.

A window over one list runs in one task.  Here a list beyond ``LONG`` rows is cut into
blocks that tasks take separately; a block's rows are numbered (or multiplied, or summed) by a
window over the block alone, the blocks' totals (a few rows per list) by a window
over the list, and each block is joined to what precedes it.

``number_rows`` cuts a list by value, at approximate quantiles of its own values: whatever
they are, a row's block is decided by comparing its value with them, so the result
does not depend on the cuts, only the balance does.  A value that many rows share is hit by
a quantile and becomes a block of its own, cut further by the tie-breaker.
``running`` cuts a ranked list every ``SPAN`` ranks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Rows beyond which a list is cut, rows of a block of ranks (or of tied rows), and cuts of a list.
LONG, SPAN, CUTS = 65_536, 8_192, 255


def long_lists(rows: DataFrame, key: str) -> DataFrame | None:
    """The keys of lists beyond ``LONG`` rows, or None where there are none (one aggregate)."""
    found = rows.groupBy(key).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > LONG).select(key)
    return None if found.isEmpty() else found


def number_rows(rows: DataFrame, key: str, by: str, tie: str, out: str, *, descending: bool = True) -> DataFrame:
    """``rows`` plus ``out``: the row's number (from 1) in its list by ``by``, then ``tie`` ascending.
    ``by`` is a number, ``tie`` a whole number; nulls of ``by`` come last descending, first ascending.  Rows without a key are one list,
    numbered by one window."""
    order = [F.col(by).desc() if descending else F.col(by).asc(), F.col(tie).asc()]
    lists = long_lists(rows, key)
    if lists is None:
        return rows.withColumn(out, F.row_number().over(Window.partitionBy(key).orderBy(*order)))
    shares = F.array(*[F.lit(i / (CUTS + 1)) for i in range(1, CUTS + 1)])
    cuts = rows.select(key, by).join(lists, key, "left_semi").groupBy(key).agg(F.array_distinct(F.percentile_approx(by, shares, F.lit(10_000))).alias("_cuts"))
    placed = rows.join(cuts, key, "left")
    at = 2 * F.size(F.filter("_cuts", lambda c: c < F.col(by))) + F.exists("_cuts", lambda c: c == F.col(by)).cast("int")
    at = F.when(F.col("_cuts").isNull(), 0).when(F.col(by).isNull(), -1).otherwise(at)  # null: before all
    tied = F.coalesce(F.exists("_cuts", lambda c: c == F.col(by)) | F.col(by).isNull(), F.lit(False))
    tied = F.when(F.col("_cuts").isNotNull() & tied, F.floor(F.col(tie) / SPAN)).otherwise(0)
    placed = placed.withColumn("_b", -at if descending else at).withColumn("_s", tied).drop("_cuts")
    block = [key, "_b", "_s"]
    before = Window.partitionBy(key).orderBy("_b", "_s").rowsBetween(Window.unboundedPreceding, -1)
    totals = placed.groupBy(*block).agg(F.count(F.lit(1)).alias("_n")).select(*block, F.sum("_n").over(before).alias("_before"))
    inside = placed.withColumn("_in", F.row_number().over(Window.partitionBy(*block).orderBy(*order)))
    numbered = inside.join(totals, block, "left").withColumn(out, (F.coalesce("_before", F.lit(0)) + F.col("_in")).cast("int"))
    return numbered.select(*rows.columns, out)


def running(rows: DataFrame, key: str, rank: str, out: str, value: Column, how: str, *, with_own: bool) -> DataFrame:
    """``rows`` plus ``out``: the ``how`` (``sum`` or ``product``) of ``value`` over the ranks above
    a row's, its own included (``with_own``) or not; null at the first without its own.
    ``rank`` counts from 1 in every list."""
    over = {"sum": F.sum, "product": F.product}[how]
    join = {"sum": lambda a, b: a + b, "product": lambda a, b: a * b}[how]
    placed = rows.withColumn("_v", value).withColumn("_blk", F.floor((F.col(rank) - 1) / SPAN))
    inside = Window.partitionBy(key, "_blk").orderBy(rank).rowsBetween(Window.unboundedPreceding, 0 if with_own else -1)
    before = Window.partitionBy(key).orderBy("_blk").rowsBetween(Window.unboundedPreceding, -1)
    totals = placed.groupBy(key, "_blk").agg(over("_v").alias("_t")).withColumn("_before", over("_t").over(before))
    own = placed.withColumn("_in", over("_v").over(inside)).join(totals.where("_before IS NOT NULL").drop("_t"), [key, "_blk"], "left")
    both = F.when(F.col("_before").isNull(), F.col("_in")).when(F.col("_in").isNull(), F.col("_before")).otherwise(join(F.col("_before"), F.col("_in")))
    return own.select(*rows.columns, both.alias(out))
