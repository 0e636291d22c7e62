"""The pairwise ranking model fitted without a pair table.

A pair of rows e before t (by ``ord``) of one query with different relevance has the
label ``(−1)^k``.  The parity of the pair's index k splits into a part of e and a part of t,
so the label is a product ``A_e · C_t`` of two signs, and with ``m = v·x`` the pair's margin
is ``m_hi − m_lo + A_e C_t β`` (hi: the more relevant row).  So whether a pair is active
(margin below 1) is a threshold on the other row's m within one relevance class and one
sign, and all sums over pairs are sums of prefix sums of sorted rows:

* rows of a query are cut into blocks by ``ord``; a block with itself and every two
  blocks of a query are units of work.  A unit is resolved by halving: first by ord, so
  that all of the left half come before the right, then by relevance, so that all of one side
  are more relevant; what remains is a sort by m, one binary search and prefix sums of
  1, m, m² and x (n log² n, n the rows of a unit; never a list of pairs);
* each step is one pass of ``mapInArrow`` over the units, which are dealt and written
  once, and a sum of one vector per task: loss, gradient and Hessian in (v, β).

Scaling (G3) is linear: a weight w on scaled differences is v = w/σ with
β = b − μ·v, and μ and σ are read off the same pass at v = 0, where every pair is active.
The solver is the Newton method of ``ranksvm`` on the same objective.

A list of n rows makes (n / BLOCK)² / 2 units of at most 2·BLOCK rows, dealt over the
tasks; nothing holds a whole list.  Null relevances take no part, null and NaN
features count as 0, as in the pair table.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import written_table
from .pairs import pair_index_parity
from .ranksvm import RankModel

#: Rows of a block; a unit of work holds two at most.
BLOCK = 16_384
#: Rows below which a part of a unit is resolved pair by pair.
SMALL = 160
#: Halvings of a step that are tried.
STEPS = 12


def _signs(n_rows: int) -> tuple[Column, Column]:
    """(A, C): the sign a row gives a pair as the earlier and as the later row."""
    i, n = F.col("ord"), F.lit(n_rows).cast("long")
    # the parity with the next row, whose own part is the parity of its ordinal
    alone = (pair_index_parity(i, i + 1, n) + F.pmod(i + 1, F.lit(2))) % 2
    return F.lit(1) - F.lit(2) * alone.cast("int"), F.lit(1) - F.lit(2) * F.pmod(i, F.lit(2)).cast("int")


def row_units(rows: DataFrame, dim: int, *, balance: str = "pair_index", features: str = "features", block: int = BLOCK) -> DataFrame:
    """``rows`` (ord, qid, rel, features) dealt into units, written once: qid, one, two, late,
    ord, rel, a, c (0 without balancing), x.  In the unit (one, one) all rows are paired with each other, in
    (one, two) those with ``late`` = 0 with those with ``late`` = 1."""
    if balance not in ("pair_index", "none"):
        raise ValueError("balance must be 'pair_index' or 'none'")
    a, c = _signs(rows.count()) if balance == "pair_index" else (None, None)
    x = F.transform(F.slice(F.col(features).cast("array<double>"), 1, dim), lambda v: F.coalesce(F.nanvl(v, F.lit(0.0)), F.lit(0.0)))
    x = F.concat(x, F.array_repeat(F.lit(0.0), F.lit(dim) - F.size(x)))
    slim = rows.where(F.col("rel").isNotNull()).select(
        "qid", "ord", F.col("rel").cast("double").alias("rel"), (F.lit(0) if a is None else a).cast("int").alias("a"),
        (F.lit(0) if c is None else c).cast("int").alias("c"), x.alias("x"), F.floor(F.col("ord") / block).cast("long").alias("own"),
    )
    blocks = slim.groupBy("qid", "own").agg(F.count(F.lit(1)).alias("n")).select("qid", F.col("own").alias("other"))
    met = slim.join(blocks, "qid")
    units = met.select(
        "qid", F.least("own", "other").alias("one"), F.greatest("own", "other").alias("two"), (F.col("own") > F.col("other")).cast("int").alias("late"), "ord", "rel", "a", "c", "x"
    )
    return written_table(units.repartition("qid", "one", "two").sortWithinPartitions("qid", "one", "two"), "row-units")


class _Sums:
    """Coefficients of a unit's rows, from which its loss, gradient and Hessian follow."""

    def __init__(self, rel, a, c, m, beta, x):
        self.rel, self.m, self.beta, self.x = rel, m, beta, x
        n = len(m)
        self.plain = bool(n) and not a.any()  # unbalanced: the label is 1 where the earlier row is the more relevant
        self.a, self.c = (np.ones(n, int), np.ones(n, int)) if self.plain else (a, c)
        self.loss = self.pull = self.count = self.right = 0.0
        self.degree, self.weight, self.side = np.zeros(n), np.zeros(n), np.zeros(n)
        self.reach = np.zeros_like(x)

    def within(self, at: np.ndarray) -> None:
        """All pairs of the rows ``at``, which are in order of ord."""
        if len(at) < 2:
            return
        if len(at) <= SMALL:
            e, t = np.triu_indices(len(at), 1)
            self._pairs(at[e], at[t])
            return
        half = len(at) // 2
        self.within(at[:half])
        self.within(at[half:])
        self.across(at[:half], at[half:])

    def across(self, early: np.ndarray, late: np.ndarray) -> None:
        """Every row of ``early`` with every one of ``late``."""
        if not len(early) or not len(late):
            return
        if len(early) * len(late) <= SMALL * SMALL:
            self._pairs(np.repeat(early, len(late)), np.tile(late, len(early)))
            return
        re, rl = self.rel[early], self.rel[late]
        low, high = min(re.min(), rl.min()), max(re.max(), rl.max())
        if low == high:
            return
        if re.min() > rl.max():
            self._above(early, late, self.a, self.c)
        elif re.max() < rl.min():
            self._above(late, early, self.c, self.a, -1 if self.plain else 1)
        else:
            values = np.unique(np.concatenate([re, rl]))
            cut = values[len(values) // 2]  # above the least, so both sides are smaller
            up, down = early[re >= cut], early[re < cut]
            up_l, down_l = late[rl >= cut], late[rl < cut]
            if len(up) and len(down_l):
                self._above(up, down_l, self.a, self.c)
            if len(down) and len(up_l):
                self._above(up_l, down, self.c, self.a, -1 if self.plain else 1)
            self.across(up, up_l)
            self.across(down, down_l)

    def _above(self, hi: np.ndarray, lo: np.ndarray, sign_hi, sign_lo, turned: int = 1) -> None:
        """Rows ``hi`` that are all more relevant than the rows ``lo``; their pairs' labels
        are the products of the two signs and ``turned``."""
        for s in np.unique(sign_hi[hi]):
            p = hi[sign_hi[hi] == s]
            for r in np.unique(sign_lo[lo]):
                q = lo[sign_lo[lo] == r]
                q = q[np.argsort(self.m[q], kind="stable")]
                label, mq, mp = float(s * r * turned), self.m[q], self.m[p]
                own = 1.0 - mp - label * self.beta  # 1 - margin = own + m of the lesser row
                first = np.searchsorted(mq, -own, side="right")
                n = len(q)
                suffix = lambda v: np.concatenate([np.cumsum(v[::-1], axis=0)[::-1], np.zeros((1, *v.shape[1:]))])
                met = (n - first).astype(float)
                s1 = suffix(mq)[first]
                self.loss += float((met * own**2 + 2 * own * s1 + suffix(mq**2)[first]).sum())
                zero = mp + label * self.beta  # margin above 0 (or 0 where the label is negative): ranked right
                self.right += float(np.searchsorted(mq, zero, side="left" if label >= 0 else "right").sum())
                pulls = met * own + s1
                self.count += float(met.sum())
                self.pull += label * float(pulls.sum())
                self.weight[p] += pulls
                self.degree[p] += met
                self.side[p] += label * met
                self.reach[p] += suffix(self.x[q])[first]
                back = np.bincount(first, minlength=n + 1)[:n].cumsum().astype(float)
                owns = np.bincount(first, weights=own, minlength=n + 1)[:n].cumsum()
                self.weight[q] -= owns + back * mq
                self.degree[q] += back
                self.side[q] -= label * back

    def _pairs(self, e: np.ndarray, t: np.ndarray) -> None:
        keep = self.rel[e] != self.rel[t]
        e, t = e[keep], t[keep]
        above = self.rel[e] > self.rel[t]
        label = np.where(above, 1.0, -1.0) if self.plain else (self.a[e] * self.c[t]).astype(float)
        hi, lo = np.where(above, e, t), np.where(above, t, e)
        margin = self.m[hi] - self.m[lo] + label * self.beta
        gap = 1.0 - margin
        live = gap > 0
        self.loss += float((gap[live] ** 2).sum())
        self.right += float(((margin > 0) | ((margin == 0) & (label < 0))).sum())
        hi, lo, label, gap = hi[live], lo[live], label[live], gap[live]
        n = len(self.m)
        add = lambda at, v: np.bincount(at, weights=v, minlength=n)
        self.count += float(len(hi))
        self.pull += float((label * gap).sum())
        self.weight += add(hi, gap) - add(lo, gap)
        self.degree += add(hi, np.ones(len(hi))) + add(lo, np.ones(len(lo)))
        self.side += add(hi, label) - add(lo, label)
        np.add.at(self.reach, hi, self.x[lo])

    def vector(self) -> np.ndarray:
        """loss, pairs ranked right, gradient (v, β) and Hessian of (v, β), without the factor 2C."""
        x, d = self.x, self.x.shape[1]
        cross = x.T @ self.reach
        hess = np.empty((d + 1, d + 1))
        hess[:d, :d] = (x * self.degree[:, None]).T @ x - cross - cross.T
        hess[:d, d] = hess[d, :d] = x.T @ self.side
        hess[d, d] = self.count
        return np.concatenate([[self.loss, self.right], -(x.T @ self.weight), [-self.pull], hess.ravel()])


def _unit_groups(batches: Iterator[pa.RecordBatch], dim: int) -> Iterator[dict[str, np.ndarray]]:
    """The rows of each unit as arrays in order of ord; a unit may span batches."""
    held: list[pa.RecordBatch] = []
    key = None

    def done() -> dict[str, np.ndarray]:
        t = pa.Table.from_batches(held).combine_chunks()
        order = np.argsort(t["ord"].to_numpy(), kind="stable")
        out = {c: t[c].to_numpy()[order] for c in ("late", "rel", "a", "c")}
        out["x"] = t["x"].combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)[order]
        return out

    for batch in batches:
        if not batch.num_rows:
            continue
        keys = list(zip(*[batch.column(c).to_pylist() for c in ("qid", "one", "two")]))
        start = 0
        for i in range(len(keys) + 1):
            if i < len(keys) and keys[i] == keys[start]:
                continue
            if held and keys[start] != key:
                yield done()
                held = []
            key = keys[start]
            held.append(batch.slice(start, i - start))
            start = i
    if held:
        yield done()


def _pass(units: DataFrame, dim: int, point: np.ndarray) -> np.ndarray:
    """Sums over all pairs at (v, β): the vector of ``_Sums``."""
    size = 2 + (dim + 1) + (dim + 1) ** 2

    def run(batches):
        total = np.zeros(size)
        for u in _unit_groups(batches, dim):
            early, late = np.nonzero(u["late"] == 0)[0], np.nonzero(u["late"] == 1)[0]
            sums = _Sums(u["rel"], u["a"], u["c"], u["x"] @ point[:dim], point[dim], u["x"])
            if len(late):
                sums.across(early, late)
            else:
                sums.within(early)
            total += sums.vector()
        yield pa.RecordBatch.from_arrays([pa.array([total.tolist()], pa.list_(pa.float64()))], names=["v"])

    sums = units.mapInArrow(run, "v array<double>").select(F.posexplode("v").alias("pos", "s")).groupBy("pos").agg(F.sum("s").alias("s")).collect()
    out = np.zeros(size)
    for r in sums:  # one row per entry of the vector
        out[r["pos"]] = r["s"]
    return out


def _parts(v: np.ndarray, dim: int):
    d1 = dim + 1
    return v[0], v[1], v[2 : 2 + d1], v[2 + d1 :].reshape(d1, d1)


def pair_moments(units: DataFrame, dim: int) -> tuple[int, np.ndarray, np.ndarray]:
    """G3 without pairs: the number of pairs, and the mean and population standard deviation
    of every balanced difference."""
    n, _, _, hess = _parts(_pass(units, dim, np.zeros(dim + 1)), dim)  # at 0 every pair is active with loss 1
    if n == 0:
        return 0, np.zeros(dim), np.zeros(dim)
    mean = hess[:dim, dim] / n
    return int(round(n)), mean, np.sqrt(np.maximum(np.diag(hess)[:dim] / n - mean**2, 0.0))


def fit_rank_svm_rows(
    rows: DataFrame, dim: int, *, c: float = 1.0, tol: float = 1e-6, max_iter: int | None = 1000, scaled: bool = True,
    balance: str = "pair_index", record: bool = False, block: int = BLOCK,
) -> RankModel:
    """G5 over every pair of ``rows`` (ord, qid, rel, features), without a pair table: the
    weights that ``fit_rank_svm`` finds on ``scale_features(training_pairs(rows))``
    (``scaled=False``: on ``training_pairs(rows)``)."""
    units = row_units(rows, dim, balance=balance, block=block)
    mean, std = np.zeros(dim), np.ones(dim)
    if scaled:
        _, mean, std = pair_moments(units, dim)
    scale = np.where(std > 0, std, 1.0)
    # (v, β) = turn @ (w, b)
    turn = np.zeros((dim + 1, dim + 1))
    turn[:dim, :dim] = np.diag(1 / scale)
    turn[dim, :dim], turn[dim, dim] = -mean / scale, 1.0
    def at(w: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
        """Objective, gradient and Hessian."""
        loss, _, grad, hess = _parts(_pass(units, dim, turn @ w), dim)
        return 0.5 * float(w @ w) + c * loss, w + 2 * c * (turn.T @ grad), np.eye(dim + 1) + 2 * c * (turn.T @ hess @ turn)

    w, hist, it = np.zeros(dim + 1), [], 0
    obj, g, hess = at(w)
    g0 = float(np.linalg.norm(g))
    while True:
        gnorm = float(np.linalg.norm(g))
        if record:
            hist.append({"iter": it, "w": w.copy(), "grad_norm": gnorm, "objective": obj})
        converged = gnorm <= tol * max(g0, 1e-300)
        if converged or (max_iter is not None and it >= max_iter):
            break
        step = np.linalg.solve(hess, -g)
        down, size, found = float(g @ step), 1.0, None
        for _ in range(STEPS):  # the whole step nearly always does, and its pass is the next one's
            tried = at(w + size * step)
            if tried[0] <= obj + 1e-4 * size * down:
                found = tried
                break
            size /= 2
        if found is None:
            break
        w, (obj, g, hess), it = w + size * step, found, it + 1
    return RankModel(w[:dim].tolist(), float(w[dim]), it, gnorm, obj, converged, means=mean.tolist(), stds=std.tolist(), history=hist)


def row_pair_accuracy(units: DataFrame, model: RankModel, dim: int) -> tuple[int, float]:
    """G7 without pairs: the number of pairs and the share that the model (on scaled
    differences where it has means) ranks right."""
    scale = np.array([s if s else 1.0 for s in model.stds]) if model.stds else np.ones(dim)
    mean = np.array(model.means) if model.means else np.zeros(dim)
    v = np.array(model.weights) / scale
    n = _pass(units, dim, np.zeros(dim + 1))[0]
    right = _pass(units, dim, np.append(v, model.intercept - float(mean @ v)))[1]
    return int(round(n)), right / n if n else float("nan")
