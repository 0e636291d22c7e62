"""Ranking measures (H2–H9): exposure, NDCG, MAP, utility and group
exposure fairness.

Exposure follows a cascade browsing model: the first document is seen with
probability 1 and each next one with ``e_{i+1} = e_i · γ · (1 − s·rel_i)``.

Fairness compares, per author group, the share of total exposure with the
share of total relevance: ``sqrt(Σ_g (exp_share_g − rel_share_g)²)``.

Running values of a list are taken in blocks of ranks (``scan``), so no task needs a whole
list.  Shapes: per-document tables are keyed by ``qid, rank``; the author and group
tables are aggregates (group tables have one row per group id).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .scan import number_rows, running

# Fixed values of the reference.
GAMMA = 0.5
STOP_PROB = 0.7


def exposure(ranked: DataFrame, *, gamma: float = GAMMA, stop_prob: float = STOP_PROB, rel: str = "rel", qid: str = "qid", rank: str = "rank") -> DataFrame:
    """H2: add ``exposure`` = Π over higher-ranked docs of γ(1 − s·rel)."""
    factor = F.lit(gamma) * (F.lit(1.0) - F.lit(stop_prob) * F.col(rel))
    return running(ranked, qid, rank, "exposure", factor, "product", with_own=False).withColumn("exposure", F.coalesce("exposure", F.lit(1.0)))


def ndcg_per_query(ranked: DataFrame, *, rel: str = "rel", qid: str = "qid", rank: str = "rank") -> DataFrame:
    """H3 per query: ``qid, dcg, idcg, ndcg`` (ndcg null when idcg = 0)."""
    r = number_rows(ranked.select(qid, rel, rank), qid, rel, rank, "_irank")
    agg = r.groupBy(qid).agg(
        F.sum(F.col(rel) / F.log2(F.col(rank) + 1)).alias("dcg"),
        F.sum(F.col(rel) / F.log2(F.col("_irank") + 1)).alias("idcg"),
    )
    return agg.withColumn("ndcg", F.when(F.col("idcg") != 0, F.col("dcg") / F.col("idcg")))


def mean_ndcg(ranked: DataFrame, *, empty: str = "nan", **kw) -> DataFrame:
    """H3: mean NDCG over queries.  Queries whose ideal DCG is 0: ``'nan'``
    makes the mean NaN (numpy), ``'skip'`` drops them, ``'zero'`` counts 0."""
    per = ndcg_per_query(ranked, **kw)
    if empty == "skip":
        return per.agg(F.avg("ndcg").alias("ndcg"))
    if empty == "zero":
        return per.agg(F.avg(F.coalesce("ndcg", F.lit(0.0))).alias("ndcg"))
    if empty == "nan":
        return per.agg(
            F.when(F.count_if(F.col("ndcg").isNull()) > 0, F.lit(float("nan"))).otherwise(F.avg("ndcg")).alias("ndcg")
        )
    raise ValueError("empty must be 'nan', 'skip' or 'zero'")


def average_precision(ranked: DataFrame, *, rel: str = "rel", qid: str = "qid", rank: str = "rank") -> DataFrame:
    """H4 per query: AP = mean over relevant docs (rel > 0) of precision at
    their rank; ``qid, ap`` (null when the query has no relevant doc)."""
    r = running(ranked.select(qid, rel, rank), qid, rank, "_hits", (F.col(rel) > 0).cast("int"), "sum", with_own=True)
    return r.groupBy(qid).agg(
        F.avg(F.when(F.col(rel) > 0, F.col("_hits") / F.col(rank))).alias("ap")
    )


def mean_average_precision(ranked: DataFrame, **kw) -> DataFrame:
    """H4: MAP over queries with at least one relevant document."""
    return average_precision(ranked, **kw).agg(F.avg("ap").alias("map"))


def relevance_utility(ranked_exp: DataFrame, *, stop_prob: float = STOP_PROB, rel: str = "rel", qid: str = "qid") -> DataFrame:
    """H5: Σ exposure·rel·s divided by the number of queries."""
    return ranked_exp.agg(
        (F.sum(F.col("exposure") * F.col(rel) * F.lit(stop_prob)) / F.count_distinct(qid)).alias("utility")
    )


def author_exposure(ranked_exp: DataFrame, doc_authors: DataFrame, *, stop_prob: float = STOP_PROB, rel: str = "rel") -> DataFrame:
    """H6: per author over all queries ``author_id, exposure, relevance``
    (Σ exposure and Σ s·rel of the documents listing the author)."""
    j = ranked_exp.select("doc_id", "exposure", rel).join(doc_authors.select("doc_id", "author_id"), "doc_id")
    return j.groupBy("author_id").agg(
        F.sum("exposure").alias("exposure"), F.sum(F.lit(stop_prob) * F.col(rel)).alias("relevance")
    )


def group_exposure(author_exp: DataFrame, groups: DataFrame) -> DataFrame:
    """H7: per gid Σ author exposure and relevance.  Groups LEFT JOIN authors:
    group members never ranked count 0; a repeated (author, gid) row counts
    again; ranked authors in no group are ignored."""
    j = groups.select("author_id", "gid").join(author_exp, "author_id", "left")
    return j.groupBy("gid").agg(
        F.sum(F.coalesce("exposure", F.lit(0.0))).alias("exposure"),
        F.sum(F.coalesce("relevance", F.lit(0.0))).alias("relevance"),
    )


def _share(c: str, total: str, zero_total: str) -> Column:
    return F.when(F.col(total) != 0, F.col(c) / F.col(total)).otherwise(F.lit(float("nan") if zero_total == "nan" else 0.0))


def group_shares(group_exp: DataFrame, *, zero_total: str = "nan") -> DataFrame:
    """H8: ``gid, exposure_share, relevance_share``.  A total of 0 makes its
    shares NaN (``zero_total='nan'``) or 0 (``'zero'``).

    The group table has one row per group; its one-row total is joined back
    as a window over it, without another pass over what is upstream."""
    if zero_total not in ("nan", "zero"):
        raise ValueError("zero_total must be 'nan' or 'zero'")
    listed = group_exp.agg(
        F.collect_list(F.struct("gid", "exposure", "relevance")).alias("g"),
        F.coalesce(F.sum("exposure"), F.lit(0.0)).alias("te"),
        F.coalesce(F.sum("relevance"), F.lit(0.0)).alias("tr"),
    )
    each = listed.select(F.explode("g").alias("g"), "te", "tr").select("g.*", "te", "tr")
    return each.select(
        "gid", _share("exposure", "te", zero_total).alias("exposure_share"), _share("relevance", "tr", zero_total).alias("relevance_share")
    )


def exposure_fairness(shares: DataFrame) -> DataFrame:
    """H9: sqrt(Σ_g (exposure share − relevance share)²); 0 = fair."""
    return shares.agg(
        F.sqrt(F.sum(F.pow(F.col("exposure_share") - F.col("relevance_share"), 2))).alias("fairness")
    )


def fairness_and_utility(ranked: DataFrame, doc_authors: DataFrame, groups: DataFrame, *, zero_total: str = "nan", **kw) -> DataFrame:
    """Corpus-wide measure pair (the reference's rank-and-measure entry): two
    one-row tables side by side."""
    ex = exposure(ranked, **kw)
    fair = exposure_fairness(group_shares(group_exposure(author_exposure(ex, doc_authors), groups), zero_total=zero_total))
    both = fair.select("fairness", F.lit(None).cast("double").alias("utility")).unionByName(
        relevance_utility(ex).select(F.lit(None).cast("double").alias("fairness"), "utility")
    )
    return both.agg(F.max("fairness").alias("fairness"), F.max("utility").alias("utility"))
