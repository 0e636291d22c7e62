"""Pairwise training data.

``rows``: ``ord, qid, rel, features ARRAY<DOUBLE>`` where ``ord`` is the row's
0-based position in the feature file (as written by ``sinks.assign_ordinals``).

G1/G2 are an equi-join on ``qid`` with the residual ``a.ord < b.ord AND
a.rel <> b.rel`` — never a cartesian product.  The pair table is quadratic in
the judged list length of a query *by definition* (it is the reference's
training set); the join is on the query key, so AQE's skew-join splitting
spreads a long query over several tasks.

Balancing (G2): the reference walks all C(n,2) index pairs of the whole file
in order and gives the k-th pair the label (−1)^k, flipping the difference
when needed.  Only the parity of k matters:
``k = i(2n−i−1)/2 + (j−i−1)``; its parity is computed from residues mod 4 so
no product overflows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.vectors import diff, scale, standardize


def pair_index_parity(i: Column, j: Column, n: Column) -> Column:
    """Parity (0/1) of the combination index of (i, j), i < j < n."""
    a = F.pmod(i, F.lit(4))
    b = F.pmod(F.lit(2) * n - i - F.lit(1), F.lit(4))
    half = F.pmod(a * b, F.lit(4)) / F.lit(2)  # i(2n-i-1) is even: residue 0 or 2
    return F.pmod(half.cast("bigint") + F.pmod(j - i - F.lit(1), F.lit(2)), F.lit(2)).cast("int")


def pairwise_diffs(rows: DataFrame, features: str = "features") -> DataFrame:
    """G1: ``qid, i, j, sign, diff`` for i < j in the same query with
    different relevance; ``diff = x_i − x_j``, ``sign = sign(y_i − y_j)``."""
    a = rows.select(F.col("qid"), F.col("ord").alias("i"), F.col("rel").alias("rel_i"), F.col(features).alias("x_i"))
    b = rows.select(F.col("qid"), F.col("ord").alias("j"), F.col("rel").alias("rel_j"), F.col(features).alias("x_j"))
    p = a.join(b, "qid").where((F.col("i") < F.col("j")) & (F.col("rel_i") != F.col("rel_j")))
    return p.select(
        "qid",
        "i",
        "j",
        F.signum(F.col("rel_i") - F.col("rel_j")).cast("int").alias("sign"),
        diff("x_i", "x_j").alias("diff"),
    )


def balance_pairs(pairs: DataFrame, n_rows: Column, balance: str = "pair_index") -> DataFrame:
    """``label`` = (−1)^k and ``diff`` flipped to agree with it
    (``balance='none'`` keeps label = sign and the raw difference)."""
    if balance == "none":
        return pairs.withColumn("label", F.col("sign")).withColumn("k_parity", F.lit(None).cast("int"))
    if balance != "pair_index":
        raise ValueError("balance must be 'pair_index' or 'none'")
    par = pair_index_parity(F.col("i"), F.col("j"), n_rows)
    label = F.when(par == 0, F.lit(1)).otherwise(F.lit(-1))
    flip = (label * F.col("sign")).cast("double")
    out = pairs.withColumn("k_parity", par).withColumn("label", label).withColumn("_flip", flip)
    return out.withColumn("diff", scale("diff", F.col("_flip"))).drop("_flip")


def training_pairs(rows: DataFrame, features: str = "features", balance: str = "pair_index") -> DataFrame:
    """G1 + G2: ``qid, i, j, k_parity, label, diff``."""
    n = F.lit(rows.count()).cast("long")  # one number
    return balance_pairs(pairwise_diffs(rows, features), n, balance).select(
        "qid", "i", "j", "k_parity", "label", "diff"
    )


def column_stats(pairs: DataFrame, dim: int, col: str = "diff") -> tuple[list[float], list[float]]:
    """Per-position mean and *population* std (one aggregate, ``dim`` small)."""
    aggs = []
    for i in range(dim):
        x = F.col(col)[i]
        aggs += [F.avg(x).alias(f"m{i}"), F.stddev_pop(x).alias(f"s{i}")]
    r = pairs.agg(*aggs).first()
    means = [float(r[f"m{i}"] or 0.0) for i in range(dim)]
    stds = [float(r[f"s{i}"] or 0.0) for i in range(dim)]
    return means, stds


def scale_features(pairs: DataFrame, dim: int, col: str = "diff") -> tuple[DataFrame, list[float], list[float]]:
    """``(x − mean)/std`` per position, population std, std 0 -> 1."""
    means, stds = column_stats(pairs, dim, col)
    return pairs.withColumn(col, standardize(col, means, stds)), means, stds


def split_pairs(pairs: DataFrame, *, train_size: float = 0.8, seed: int = 42, key=("i", "j")) -> DataFrame:
    """Exactly ``floor(train_size·n)`` training pairs, chosen by a seeded
    hash order (ties by key); adds ``split`` ('train'/'test').

    The hash is 60 bits of the MD5 of ``seed:key:...``.  The cut is found by
    distributed selection, 15 bits at a time: each step is one aggregate with
    at most 32,768 groups, and only those counts reach the driver.  No global
    sort or row numbering.
    """
    text = F.concat_ws(":", F.lit(str(seed)), *[F.col(k).cast("string") for k in key])
    hp = pairs.withColumn("_h", F.conv(F.substring(F.md5(text), 1, 15), 16, 10).cast("long"))
    n = hp.count()
    n_train = int(n * train_size)
    if n_train <= 0 or n_train >= n:
        return hp.drop("_h").withColumn("split", F.lit("train" if n > 0 and n_train >= n else "test"))
    prefix, need = 0, n_train
    for level in range(4):
        shift = 45 - 15 * level
        bucket = F.shiftright("_h", shift).bitwiseAND(0x7FFF)
        sel = hp.where(F.shiftright("_h", shift + 15) == F.lit(prefix))
        counts = sorted(tuple(r) for r in sel.groupBy(bucket.alias("b")).agg(F.count(F.lit(1))).collect())
        acc = 0
        for b, c in counts:
            if acc + c >= need:
                need -= acc
                prefix = (prefix << 15) | b
                break
            acc += c
    # the first `need` keys that carry exactly the cut hash complete the training set
    edge = hp.where(F.col("_h") == F.lit(prefix))
    row = F.struct(*key)
    last = edge.select(*key).orderBy(*key).limit(need).agg(F.max(row).alias("last")).first()["last"]
    at_edge = row <= F.struct(*[F.lit(v).cast(pairs.schema[k].dataType) for k, v in zip(key, last)])
    train = (F.col("_h") < F.lit(prefix)) | ((F.col("_h") == F.lit(prefix)) & at_edge)
    return hp.withColumn("split", F.when(train, F.lit("train")).otherwise(F.lit("test"))).drop("_h")
