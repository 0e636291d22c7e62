"""Exposure-aware re-ranking.

Per query, the reference walks adjacent positions once, top to bottom, and
keeps a swap when it lowers the query's group-exposure unfairness by more
than it raises the model utility.  Accepted swaps carry forward.

Everything except the walk is a DataFrame job.  The walk is sequential inside
a query and independent across queries: rows come sorted by query and rank, each
with its model relevance and its group weights (how many group-table rows its
authors hit per group), and all queries of an Arrow batch advance together, one rank
at a time, as numpy arrays.  Inside the walk a swap changes only the two swapped
documents' exposure (the product over the pair commutes, so lower ranks keep
theirs), so each candidate costs O(#groups).  ``walk`` is the same pass over one
query's lists.

Exposure at least halves with every rank, so neither change may be computed as
a difference of two totals, nor exposure be kept as one number that underflows.
Both changes are computed as (exposure at the upper rank) x (a factor of
ordinary size); exposures are mantissa and binary exponent.  A change is a tie
when it is below ``TIE`` of the terms that it is the sum of, so the rule holds at
any rank.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

from .measures import GAMMA, STOP_PROB, exposure, fairness_and_utility

TIE = 1e-12


def doc_group_weights(doc_authors: DataFrame, groups: DataFrame) -> DataFrame:
    """``doc_id, gid, n``: number of (author, gid) group rows reached through
    the document's author set (duplicate group rows count again)."""
    return (
        doc_authors.select("doc_id", "author_id")
        .join(groups.select("author_id", "gid"), "author_id")
        .groupBy("doc_id", "gid")
        .agg(F.count(F.lit(1)).alias("n"))
    )


def model_relevance(ranked: DataFrame, qid: str = "qid") -> DataFrame:
    """``rhat = (m + M)/(2M)·2`` with m = w·(x − x_top), M = w·(x_top −
    x_last): 1 at the top, 0 at the bottom, NaN when M = 0."""
    ends = ranked.groupBy(qid).agg(
        F.min_by("score", "rank").alias("s_top"), F.max_by("score", "rank").alias("s_last")
    )
    j = ranked.join(ends, qid)
    m = F.col("score") - F.col("s_top")
    big_m = F.col("s_top") - F.col("s_last")
    rhat = F.when(big_m == 0, F.lit(float("nan"))).otherwise((m + big_m) / (F.lit(2.0) * big_m) * F.lit(2.0))
    return j.withColumn("rhat", rhat).drop("s_top", "s_last")


def query_model_utility(ranked_rhat: DataFrame, *, gamma: float = GAMMA, stop_prob: float = STOP_PROB, qid: str = "qid") -> DataFrame:
    """Per query Σ e_i·r̂_i·s, exposure driven by r̂ (not averaged)."""
    ex = exposure(ranked_rhat, gamma=gamma, stop_prob=stop_prob, rel="rhat").withColumnRenamed("exposure", "_e")
    return ex.groupBy(qid).agg(F.sum(F.col("_e") * F.col("rhat") * F.lit(stop_prob)).alias("utility"))


def query_exposure_fairness(ranked: DataFrame, weights: DataFrame, *, gamma: float = GAMMA, stop_prob: float = STOP_PROB, qid: str = "qid") -> DataFrame:
    """Per query fairness ``qid, fairness``.  A query none of whose
    authors is in a group scores 0; one whose group members all have zero
    relevance scores NaN (the reference's 0/0)."""
    ex = exposure(ranked, gamma=gamma, stop_prob=stop_prob)
    g = ex.select(qid, "doc_id", "exposure", "rel").join(weights, "doc_id")
    ge = g.groupBy(qid, "gid").agg(
        F.sum(F.col("exposure") * F.col("n")).alias("E"),
        F.sum(F.lit(stop_prob) * F.col("rel") * F.col("n")).alias("R"),
    )
    tot = ge.groupBy(qid).agg(F.sum("E").alias("te"), F.sum("R").alias("tr"))
    sh = ge.join(tot, qid).select(
        qid,
        F.when(F.col("te") == 0, F.lit(float("nan"))).otherwise(F.col("E") / F.col("te")).alias("es"),
        F.when(F.col("tr") == 0, F.lit(float("nan"))).otherwise(F.col("R") / F.col("tr")).alias("rs"),
    )
    fair = sh.groupBy(qid).agg(F.sqrt(F.sum(F.pow(F.col("es") - F.col("rs"), 2))).alias("fairness"))
    queries = ranked.select(qid).distinct()
    return queries.join(fair, qid, "left").select(qid, F.coalesce("fairness", F.lit(0.0)).alias("fairness"))


def _scaled(mantissa: float, exponent: int) -> tuple[float, int]:
    m, x = math.frexp(mantissa)
    return m, x + exponent


def _settled(terms) -> float:
    """Sum of ``terms``, 0 where it is below rounding."""
    total = math.fsum(terms)
    return 0.0 if abs(total) <= TIE * max((abs(t) for t in terms), default=0.0) else total


def walk(rel: list[float], rhat: list[float], weights, gamma: float, stop_prob: float, relevance_delta: str) -> list[int]:
    """Order of one query's documents after the single top-to-bottom pass;
    ``weights[i]`` holds document i's weight in every group."""
    n = len(rel)
    order = list(range(n))
    weights = np.asarray(weights, dtype=float).reshape(n, -1)
    if n < 2 or weights.sum() <= 0:
        return order
    seen = gamma * (1 - stop_prob * np.asarray(rel))  # factor a document leaves to the next by true relevance
    seen_hat = gamma * (1 - stop_prob * np.asarray(rhat))  # and by model relevance
    relevance = (stop_prob * np.asarray(rel)[:, None] * weights).sum(axis=0)
    if relevance.sum() == 0:
        return order  # fairness is 0/0: no comparison succeeds
    target = relevance / relevance.sum()
    exposed, e = np.zeros(weights.shape[1]), 1.0
    for i in range(n):
        exposed, e = exposed + e * weights[i], e * seen[i]
    up, up_hat = (1.0, 0), (1.0, 0)  # exposure of the upper of the two ranks
    for i in range(n - 1):
        a, b = order[i], order[i + 1]
        # swapping changes the groups' exposure by (exposure at i) * change
        change = (1 - seen[a]) * weights[b] - (1 - seen[b]) * weights[a]
        at = math.ldexp(*up)
        total, total_new = exposed.sum(), (exposed + at * change).sum()
        swap = False
        if total != 0 and total_new != 0:
            share = exposed / total
            fair, fair_new = (math.sqrt((((x / x.sum()) - target) ** 2).sum()) for x in (exposed, exposed + at * change))
            if fair + fair_new > 0:
                # old share minus new share, over the exposure at i
                moved = np.array([_settled((x * change.sum(), -c * total)) for x, c in zip(exposed, change)]) / (total * total_new)
                gain = _settled(list(moved * 2 * (share - target) / (fair + fair_new)) + [-at * float((moved * moved).sum()) / (fair + fair_new)])
                cost = stop_prob * _settled(((1 - seen_hat[a]) * rhat[b], -(1 - seen_hat[b]) * rhat[a]))
                if relevance_delta != "gain":
                    cost = -cost
                if not (math.isnan(gain) or math.isnan(cost)):
                    (g, gx), (c, cx) = _scaled(gain * up[0], up[1]), _scaled(cost * up_hat[0], up_hat[1])
                    top = max(x for m, x in ((g, gx), (c, cx), (0.0, -(10**9))) if m or x == -(10**9))
                    g, c = math.ldexp(g, max(gx - top, -2000)), math.ldexp(c, max(cx - top, -2000))
                    swap = g > 0 and _settled((g, -c)) > 0
        if swap:
            order[i], order[i + 1] = b, a
            exposed = exposed + at * change
        up = _scaled(up[0] * seen[order[i]], up[1])
        up_hat = _scaled(up_hat[0] * seen_hat[order[i]], up_hat[1])
    return order


def _both(x, y):
    """x + y elementwise, 0 where that is below rounding."""
    total = x + y
    return np.where(np.abs(total) <= TIE * np.maximum(np.abs(x), np.abs(y)), 0.0, total)


def _times(m, x, factor):
    """(mantissa, exponent) times a factor."""
    m, up = np.frexp(m * factor)
    return m, x + up


class _Walks:
    """The swap pass of many queries at once: ``step`` moves every active query on by a rank.
    A row of each array is a query; ``exposed`` and ``target`` are its groups' exposure and
    share of relevance, ``up`` and ``up_hat`` the exposure at its upper rank as (mantissa,
    exponent), ``live`` whether its swaps can be judged."""

    def __init__(self, exposed, relevance, gamma: float, stop_prob: float, gains: bool):
        total = relevance.sum(1)
        self.live = (total != 0) & ~np.isnan(total)
        self.exposed, self.target = exposed, relevance / np.where(self.live, total, 1.0)[:, None]
        self.up = [np.ones(len(exposed)), np.zeros(len(exposed), int)]
        self.up_hat = [np.ones(len(exposed)), np.zeros(len(exposed), int)]
        self.gamma, self.stop, self.gains = gamma, stop_prob, gains

    def step(self, n: int, rel, rhat, weights, rel_b, rhat_b, weights_b) -> np.ndarray:
        """Of the first ``n`` queries, which swap the document carried (rel, rhat, weights) with
        the next (…_b); all move on."""
        seen, seen_b = self.gamma * (1 - self.stop * rel), self.gamma * (1 - self.stop * rel_b)
        hat, hat_b = self.gamma * (1 - self.stop * rhat), self.gamma * (1 - self.stop * rhat_b)
        exposed, target = self.exposed[:n], self.target[:n]
        (um, ux), (hm, hx) = [v[:n] for v in self.up], [v[:n] for v in self.up_hat]
        with np.errstate(all="ignore"):
            at = np.ldexp(um, ux)
            change = (1 - seen)[:, None] * weights_b - (1 - seen_b)[:, None] * weights
            new = exposed + at[:, None] * change
            total, total_new = exposed.sum(1), new.sum(1)
            share = exposed / total[:, None]
            both = np.sqrt(((share - target) ** 2).sum(1)) + np.sqrt(((new / total_new[:, None] - target) ** 2).sum(1))
            moved = _both(exposed * change.sum(1)[:, None], -change * total[:, None]) / (total * total_new)[:, None]
            terms = np.concatenate([moved * 2 * (share - target), -(at * (moved**2).sum(1))[:, None]], axis=1) / both[:, None]
            gain = terms.sum(1)
            gain = np.where(np.abs(gain) <= TIE * np.abs(terms).max(1), 0.0, gain)
            cost = self.stop * _both((1 - hat) * rhat_b, -(1 - hat_b) * rhat)
            cost = cost if self.gains else -cost
            judged = self.live[:n] & (total != 0) & (total_new != 0) & (both > 0) & ~np.isnan(gain) & ~np.isnan(cost)
            (g, gx), (c, cx) = _times(um, ux, gain), _times(hm, hx, cost)
            top = np.maximum(np.where(g != 0, gx, -(10**9)), np.where(c != 0, cx, -(10**9)))
            g, c = np.ldexp(g, np.maximum(gx - top, -2000)), np.ldexp(c, np.maximum(cx - top, -2000))
            swap = judged & (g > 0) & (_both(g, -c) > 0)
            self.exposed[:n] = np.where(swap[:, None], new, exposed)
            for held, factor, factor_b in ((self.up, seen, seen_b), (self.up_hat, hat, hat_b)):
                held[0][:n], held[1][:n] = _times(held[0][:n], held[1][:n], np.where(swap, factor_b, factor))
        return swap


def _matrix(column: pa.ListArray, width: int) -> np.ndarray:
    """The lists as rows, filled up with 0."""
    sizes = np.diff(column.offsets.to_numpy())
    out = np.zeros((len(sizes), width))
    out[np.arange(width) < sizes[:, None]] = column.flatten().to_numpy(zero_copy_only=False)
    return out


def _walk_batches(batches: Iterator[pa.RecordBatch], names: list[str], gamma: float, stop_prob: float, gains: bool) -> Iterator[pa.RecordBatch]:
    """Rows of queries in order of (query, rank) -> the same in adjusted order.  The queries of a
    batch advance together, a rank at a time; the last one may go on in the next batch,
    so its carried document and its state wait for that."""
    row = state = None  # the carried row of the last query, and its (exposed, target, live, up, up_hat)
    place = 0  # its rank

    def out(rows: pa.Table, order: np.ndarray, ranks: np.ndarray) -> pa.RecordBatch:
        got = rows.take(pa.array(order))
        columns = [pa.array(ranks, pa.int32()) if c == "rank" else got[c].combine_chunks() for c in names]
        return pa.RecordBatch.from_arrays(columns, names=names)

    for batch in batches:
        if not batch.num_rows:
            continue
        rows = pa.Table.from_batches([batch]) if row is None else pa.concat_tables([row, pa.Table.from_batches([batch])]).combine_chunks()
        keys = rows[names[0]].to_pylist()
        starts = np.flatnonzero([True] + [a != b for a, b in zip(keys, keys[1:])])
        sizes = np.diff(np.append(starts, len(keys)))
        goes_on = row is not None and sizes[0] > 1
        chunk = lambda c: rows[c].combine_chunks()
        rel, rhat = (np.array(rows[c].to_pylist(), float) for c in ("rel", "rhat"))
        width = max(1, *(int(x) for x in np.diff(_lists(chunk("exposed")).offsets.to_numpy())), state[0].shape[0] if state is not None else 1)
        weights, exposed, relevance = (_matrix(_lists(chunk(c)), width) for c in ("weights", "exposed", "relevance"))
        order = np.argsort(-sizes, kind="stable")  # longest first, so that the active ones stay in front
        at, size = starts[order], sizes[order]
        walks = _Walks(exposed[at], relevance[at], gamma, stop_prob, gains)
        first_rank = np.ones(len(order), int)
        if row is not None:
            k = int(np.flatnonzero(order == 0)[0])
            first_rank[k] = place
            if goes_on:
                e, t, live, up, up_hat = state
                walks.exposed[k], walks.target[k], walks.live[k] = 0.0, 0.0, live
                walks.exposed[k, : len(e)], walks.target[k, : len(t)] = e, t
                for held, v in ((walks.up, up), (walks.up_hat, up_hat)):
                    held[0][k], held[1][k] = v
        carried, placed, ranks = at.copy(), [], []
        for step in range(1, int(size[0])):
            n = int(np.searchsorted(-size, -step, side="left"))  # queries with more than ``step`` rows
            a, b = carried[:n], at[:n] + step
            swap = walks.step(n, rel[a], rhat[a], weights[a], rel[b], rhat[b], weights[b])
            placed.append(np.where(swap, b, a))
            ranks.append(first_rank[:n] + step - 1)
            carried[:n] = np.where(swap, a, b)
        last = int(np.flatnonzero(order == len(order) - 1)[0])
        ends = np.arange(len(order)) != last
        placed.append(carried[ends])
        ranks.append((first_rank + size - 1)[ends])
        yield out(rows, np.concatenate(placed), np.concatenate(ranks))
        row, place = rows.slice(int(carried[last]), 1), int(first_rank[last] + size[last] - 1)
        state = (
            walks.exposed[last].copy(), walks.target[last].copy(), walks.live[last],
            (walks.up[0][last], walks.up[1][last]), (walks.up_hat[0][last], walks.up_hat[1][last]),
        )
    if row is not None:
        yield out(row, np.array([0]), np.array([place]))


def _lists(column):
    return column.chunk(0) if isinstance(column, pa.ChunkedArray) else column


def adjust_for_exposure(
    ranked_rhat: DataFrame,
    weights: DataFrame,
    *,
    gamma: float = GAMMA,
    stop_prob: float = STOP_PROB,
    relevance_delta: str = "gain",
    qid: str = "qid",
) -> DataFrame:
    """I4: the swap pass; returns ``qid, rank, doc_id, rel, rhat, score`` in
    the adjusted order (rank from 1); ids keep their types.

    What a query starts from (its groups' exposure and relevance) is aggregated by
    Spark; its rows then stream by rank, many queries of a batch side by side, and a
    list of any length holds one document and one number per group."""
    weights = weights.where(F.col("gid").isNotNull())
    per_doc = weights.groupBy("doc_id").agg(F.map_from_entries(F.collect_list(F.struct("gid", F.col("n").cast("double")))).alias("_of"))
    exposed = exposure(ranked_rhat, gamma=gamma, stop_prob=stop_prob, qid=qid).select(qid, "doc_id", "exposure", "rel")
    groups = exposed.join(weights, "doc_id").groupBy(qid, "gid").agg(
        F.sum(F.col("exposure") * F.col("n")).alias("e"), F.sum(F.lit(stop_prob) * F.col("rel") * F.col("n")).alias("r")
    )
    starts = groups.groupBy(qid).agg(F.sort_array(F.collect_list(F.struct("gid", "e", "r"))).alias("_g"))
    names = [qid, "rank", "doc_id", "rel", "rhat", "score"]
    slim = ranked_rhat.select(*names).join(per_doc, "doc_id", "left").join(starts, qid, "left")
    empty = F.array().cast("array<double>")
    rows = slim.select(
        *names,
        F.coalesce(F.transform("_g", lambda g: F.coalesce(F.try_element_at("_of", g["gid"]), F.lit(0.0))), empty).alias("weights"),
        F.coalesce(F.col("_g.e"), empty).alias("exposed"), F.coalesce(F.col("_g.r"), empty).alias("relevance"),
    )
    fields = {f.name: f for f in rows.schema.fields}
    schema = StructType([StructField("rank", IntegerType()) if c == "rank" else fields[c] for c in names])
    dealt = rows.repartition(qid).sortWithinPartitions(qid, "rank")
    gains = relevance_delta == "gain"
    return dealt.mapInArrow(lambda batches: _walk_batches(batches, names, gamma, stop_prob, gains), schema)


def adjustment_report(before: DataFrame, after: DataFrame, doc_authors: DataFrame, groups: DataFrame, *, zero_total: str = "zero") -> DataFrame:
    """Corpus-wide fairness and utility before and after the adjustment."""

    def measure(r: DataFrame, label: str) -> DataFrame:
        out = fairness_and_utility(r, doc_authors, groups, zero_total=zero_total)
        return out.select(F.lit(label).alias("stage"), "fairness", "utility")

    return measure(before, "before").unionByName(measure(after, "after"))
