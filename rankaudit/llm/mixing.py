"""Mixing sources to target weights by hash-threshold histograms.

Every source gets a token target by weight, capped at ``cap`` times its size
(the excess is shared again by weight).  A source then contributes each
document floor(target / size) times, and once more those documents whose hash
lies below a threshold.  The threshold is found without sorting documents:
sizes are summed per (source, top hash bits), the bucket in which the budget
runs out is located, and only that bucket is refined by its next bits, until a
single hash value is left, which is taken when that lands nearer the target.
Every pass is one partial aggregate of at most 2**BITS rows per source and
task, so a source holding most rows is summed by all tasks.

Defined cases: a null text has size 0; null sources form one source, ordered
last; a source of size 0 has target 0 and nothing taken; rows that repeat an id
share its hash and are taken or left together; a null id hashes as the empty
string; an empty table gives an empty result; extra columns are ignored
by ``mix_sources`` and kept by ``mixed_documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from rankaudit.llm.store import written

BITS = 12
LEVELS = 5  # 60 hash bits
#: Source tables up to so many rows are broadcast; above it the join is shuffled.
BROADCAST_SOURCES = 10_000
WORDS = r"[^\x20\x09-\x0D]+"


def source_targets(sized: DataFrame, weights=(5, 2, 1), share: float = 1.5, cap: float = 2.0) -> DataFrame:
    """(source, source_size, target): water-filled token targets, one row per source."""
    sizes = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    w = sizes.select(
        "source", "source_size",
        F.element_at(F.array(*[F.lit(float(x)) for x in weights]), (((F.row_number().over(by_name)) - 1) % len(weights) + 1).cast("int")).alias("w"),
    ).withColumn("ceiling", F.lit(cap) * F.col("source_size"))
    by_ratio = Window.orderBy((F.col("ceiling") / F.col("w")).asc(), F.col("source").asc_nulls_last())
    before = by_ratio.rowsBetween(Window.unboundedPreceding, -1)
    onward = by_ratio.rowsBetween(0, Window.unboundedFollowing)
    everything = Window.orderBy(F.lit(1)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    level = w.withColumn(
        "level",  # share per unit of weight if all sources with a lower ratio are full
        (F.lit(share) * F.sum("source_size").over(everything) - F.coalesce(F.sum("ceiling").over(before), F.lit(0.0)))
        / F.sum("w").over(onward),
    ).withColumn("full", F.col("level") * F.col("w") > F.col("ceiling"))
    final = level.withColumn("unit", F.min(F.when(~F.col("full"), F.struct((F.col("ceiling") / F.col("w")).alias("r"), F.col("source").isNull().alias("z"), F.col("source").alias("s"), "level"))).over(everything))
    return final.select(
        "source", "source_size",
        F.when(F.col("full"), F.col("ceiling")).otherwise(F.col("unit.level") * F.col("w")).alias("target"),
    )


def _on_source(rows: DataFrame, state: DataFrame, small: bool) -> DataFrame:
    state = state.withColumnRenamed("source", "s_source")
    return rows.join(F.broadcast(state) if small else state, F.col("source").eqNullSafe(F.col("s_source"))).drop("s_source")


def hash_thresholds(sized: DataFrame, targets: DataFrame, small: bool) -> DataFrame:
    """targets plus ``copies`` (whole copies of every document), ``edge`` (hash at
    which one more copy stops) and ``edge_in`` (whether the edge itself is taken)."""
    state = written(
        targets.withColumn("copies", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long"))
        .withColumn("budget", F.col("target") - F.col("copies") * F.col("source_size"))
        .withColumn("edge", F.lit(0).cast("long")).withColumn("used", F.lit(0).cast("long")).withColumn("edge_size", F.col("source_size")),
        "mix-state",
    )
    for level in range(LEVELS):
        left = BITS * (LEVELS - 1 - level)  # bits below this level's bucket
        inside = _on_source(sized, state.select("source", "edge"), small).where(F.shiftright("h", left + BITS) == F.col("edge"))
        hist = inside.groupBy("source", F.shiftright("h", left).alias("bucket")).agg(F.sum("size").alias("in_bucket"))
        so_far = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
        hist = hist.withColumn("below", F.coalesce(F.sum("in_bucket").over(so_far), F.lit(0)))
        hist = _on_source(hist, state.select("source", "used", "budget"), small)
        edge = (
            hist.where(F.col("used") + F.col("below") <= F.col("budget"))
            .groupBy("source").agg(F.max(F.struct("bucket", "below", "in_bucket")).alias("e"))
            .withColumnRenamed("source", "e_source")
        )
        state = written(
            state.join(edge, F.col("source").eqNullSafe(F.col("e_source")), "left").select(
                "source", "source_size", "target", "copies", "budget",
                F.coalesce("e.bucket", F.shiftleft("edge", BITS)).alias("edge"),
                (F.col("used") + F.coalesce("e.below", F.lit(0))).alias("used"),
                F.coalesce("e.in_bucket", F.lit(0).cast("long")).alias("edge_size"),
            ),
            "mix-state",
        )
    over = F.col("used") + F.col("edge_size") - F.col("budget")
    return state.withColumn("edge_in", (over <= 0) | (over < F.col("budget") - F.col("used")))


def mix_sources(
    docs: DataFrame, weights=(5, 2, 1), share: float = 1.5, cap: float = 2.0, id_col: str = "doc_id",
    text_col: str = "text", source_col: str = "source", keep: bool = False,
) -> DataFrame:
    """One row per input row: doc_id, size, source_size, target, copies, taken, and
    with ``keep`` the whole row as struct ``row``.  ``copies`` is how often the mix
    takes the document."""
    hashed = F.conv(F.substring(F.md5(F.coalesce(F.col(id_col).cast("string"), F.lit(""))), 1, 15), 16, 10).cast("long")
    base = docs.select(
        F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"),
        F.coalesce(F.regexp_count(F.col(text_col), F.lit(WORDS)), F.lit(0)).cast("long").alias("size"),
        hashed.alias("h"), *([F.struct(*docs.columns).alias("row")] if keep else []),
    )
    sized = written(base.select("doc_id", "source", "size", "h"), "mix-sizes")
    targets = written(source_targets(sized, weights, share, cap), "mix-targets")
    small = targets.count() <= BROADCAST_SOURCES
    state = hash_thresholds(sized, targets, small)
    # re-reading the texts is cheaper than carrying them through the sizes table
    out = _on_source(base if keep else sized, state, small)
    extra = ((F.col("h") < F.col("edge")) | ((F.col("h") == F.col("edge")) & F.col("edge_in"))).cast("long")
    out = out.withColumn("n_copies", F.col("copies") + F.when(F.col("source_size") > 0, extra).otherwise(0))
    return out.select(
        "doc_id", "size", "source_size", "target", F.col("n_copies").alias("copies"),
        (F.col("size") * F.col("n_copies")).alias("taken"), *(["row"] if keep else []),
    )


def mixed_documents(docs: DataFrame, **how) -> DataFrame:
    """The rows of ``docs``, each as often as the mix takes it."""
    out = mix_sources(docs, keep=True, **how).where("copies > 0")
    return out.select("row", F.explode(F.sequence(F.lit(1).cast("long"), "copies"))).select("row.*")


ORACLE = r"""
WITH d AS (
  SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size,
         CAST('0x' || substr(md5(CAST(doc_id AS VARCHAR)), 1, 15) AS BIGINT) AS h
  FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source),
n AS (SELECT *, row_number() OVER (ORDER BY source NULLS LAST) AS k FROM s),
w AS (SELECT *, CAST(CASE (k - 1) % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS DOUBLE) AS w,
             CAST(2 AS DOUBLE) * source_size AS ceiling FROM n),
l AS (SELECT *, (CAST(1.5 AS DOUBLE) * (SELECT sum(source_size) FROM s)
        - coalesce(sum(ceiling) OVER (ORDER BY ceiling / w, k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
        / sum(w) OVER (ORDER BY ceiling / w, k ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM w),
t AS (SELECT source, source_size, CASE WHEN level * w > ceiling THEN ceiling
        ELSE w * (SELECT arg_min(level, ceiling / w) FROM l WHERE level * w <= ceiling) END AS target FROM l),
c AS (SELECT *, CASE WHEN source_size > 0 THEN CAST(floor(target / source_size) AS BIGINT) ELSE 0 END AS copies FROM t),
b AS (SELECT d.*, c.source_size, c.target, c.copies, c.target - c.copies * c.source_size AS budget,
        sum(size) OVER (PARTITION BY d.source ORDER BY h RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS upto
      FROM d JOIN c ON d.source IS NOT DISTINCT FROM c.source),
g AS (SELECT *, upto - sum(size) OVER (PARTITION BY source, h) AS under FROM b),
x AS (SELECT *, copies + CASE WHEN source_size = 0 THEN 0
        WHEN upto <= budget THEN 1 WHEN under <= budget AND upto - budget < budget - under THEN 1 ELSE 0 END AS n FROM g)
SELECT doc_id, size, source_size, target, CAST(n AS BIGINT) AS copies, CAST(size * n AS BIGINT) AS taken FROM x
"""
