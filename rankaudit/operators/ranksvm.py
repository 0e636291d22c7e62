"""Linear pairwise ranking model.

The reference fits a linear SVM on pair differences with the library
defaults: squared hinge loss, L2 penalty, C = 1 and an intercept that is
*regularised* (fitted as the weight of a constant feature 1).  That objective

    f(w̃) = ½‖w̃‖² + C Σ_p max(0, 1 − y_p·w̃·x̃_p)²,   x̃ = [x, 1]

is strictly convex, so its minimiser is unique and any exact solver agrees.
We solve it with a distributed primal Newton method:

* one pass over the (persisted) pair table per step computes the loss, the
  gradient ``w̃ + 2C Σ_active (y w̃·x̃ − 1) y x̃`` and the generalised Hessian
  ``I + 2C Σ_active x̃ x̃ᵀ``.  Each partition reduces its rows with BLAS
  (``mapInPandas``, Arrow batches) to one (d+1)² + (d+1) + 1 vector; those
  partial vectors are summed element-wise by Spark (``posexplode`` +
  ``groupBy``), so the driver only receives the final (d+1)² numbers;
* the (d+1)×(d+1) system is solved on the driver;
* a backtracking line search evaluates 12 step lengths in one more pass.

The stopping rule is ``‖∇f‖ ≤ tol·‖∇f(0)‖``; the fit also ends when no step
length lowers the objective (the limit of double precision) or after
``max_iter`` steps.  ``converged`` tells whether the rule was met.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.vectors import dot

STEPS = [0.5**k for k in range(12)]


@dataclass
class RankModel:
    weights: list[float]
    intercept: float
    iterations: int = 0
    grad_norm: float = float("nan")
    objective: float = float("nan")
    converged: bool = False
    means: list[float] | None = None
    stds: list[float] | None = None
    history: list[dict] = field(default_factory=list)

    def row(self):
        return (self.weights, self.intercept, self.iterations, self.grad_norm, self.objective)


def _partials(pairs: DataFrame, w: np.ndarray, c: float, steps: list[float] | None, direction: np.ndarray | None):
    """Sum over all pairs, distributed, of the Newton statistics (steps=None)
    or of the line-search losses (steps given)."""
    dim = len(w)
    size = len(steps) if steps is not None else dim * dim + dim + 1

    def part(batches):
        import pandas as pd

        acc = np.zeros(size)
        for pdf in batches:
            if len(pdf) == 0:
                continue
            x = np.nan_to_num(np.stack(pdf["diff"].to_numpy()).astype(float))
            xt = np.hstack([x, np.ones((len(x), 1))])
            y = pdf["label"].to_numpy().astype(float)
            if steps is None:
                z = y * (xt @ w)
                act = z < 1.0
                xa, ya, za = xt[act], y[act], z[act]
                acc[0] += float(np.sum((1.0 - za) ** 2))
                acc[1 : 1 + dim] += 2.0 * c * (xa.T @ ((za - 1.0) * ya))
                acc[1 + dim :] += (2.0 * c * (xa.T @ xa)).ravel()
            else:
                base = y * (xt @ w)
                dz = y * (xt @ direction)
                for k, t in enumerate(steps):
                    m = 1.0 - (base + t * dz)
                    acc[k] += float(np.sum(np.where(m > 0, m * m, 0.0)))
        yield pd.DataFrame({"v": [acc.tolist()]})

    partial = pairs.select("diff", "label").mapInPandas(part, "v array<double>")
    summed = (
        partial.select(F.posexplode("v").alias("pos", "x"))
        .groupBy("pos")
        .agg(F.sum("x").alias("x"))
        .collect()
    )
    out = np.zeros(size)
    for r in summed:
        out[r["pos"]] = r["x"]
    return out


def fit_rank_svm(
    pairs: DataFrame,
    dim: int,
    *,
    c: float = 1.0,
    tol: float = 1e-6,
    max_iter: int | None = 1000,
    record: bool = False,
    persist: bool = True,
) -> RankModel:
    """Fit on ``pairs`` (``diff ARRAY<DOUBLE>, label ±1``).

    ``record=True`` keeps every iterate in ``history`` (used by the learning
    curve and the tolerance sweep, which re-use one solver path)."""
    data = pairs.select("diff", "label")
    if persist:
        data = data.persist(StorageLevel.MEMORY_AND_DISK)
    d1 = dim + 1
    w = np.zeros(d1)
    hist: list[dict] = []
    g0 = None
    gnorm = float("nan")
    obj = float("nan")
    it = 0
    converged = False
    try:
        while True:
            s = _partials(data, w, c, None, None)
            obj = 0.5 * float(w @ w) + c * s[0]
            g = w + s[1 : 1 + d1]
            hess = np.eye(d1) + s[1 + d1 :].reshape(d1, d1)
            gnorm = float(np.linalg.norm(g))
            if g0 is None:
                g0 = gnorm
            if record:
                hist.append({"iter": it, "w": w.copy(), "grad_norm": gnorm, "objective": obj})
            converged = gnorm <= tol * max(g0, 1e-300)
            if converged or (max_iter is not None and it >= max_iter):
                break
            step = np.linalg.solve(hess, -g)
            losses = _partials(data, w, c, STEPS, step)
            decrease = float(g @ step)
            better = [
                t for t, loss in zip(STEPS, losses)
                if 0.5 * float((w + t * step) @ (w + t * step)) + c * loss <= obj + 1e-4 * t * decrease
            ]
            if not better:
                break
            w = w + better[0] * step
            it += 1
    finally:
        if persist:
            data.unpersist()
    return RankModel(list(map(float, w[:dim])), float(w[dim]), it, gnorm, obj, converged, history=hist)


def classify(pairs: DataFrame, model: RankModel, col: str = "diff") -> DataFrame:
    """``pred`` = +1 if w·x + b > 0 else −1."""
    m = dot(col, model.weights) + F.lit(model.intercept)
    return pairs.withColumn("pred", F.when(m > 0, F.lit(1)).otherwise(F.lit(-1)))


def pair_accuracy(pairs: DataFrame, model: RankModel, col: str = "diff") -> DataFrame:
    """mean(pred = label); chance is 0.5."""
    return classify(pairs, model, col).agg(F.avg((F.col("pred") == F.col("label")).cast("double")).alias("accuracy"))


def performance_report(split: DataFrame, model: RankModel, col: str = "diff") -> DataFrame:
    """Accuracy over all pairs (the reference's "training" score), over
    the test pairs and over the true training pairs, with counts."""
    p = classify(split, model, col)
    hit = (F.col("pred") == F.col("label")).cast("double")
    return p.agg(
        F.avg(hit).alias("all_accuracy"),
        F.avg(F.when(F.col("split") == "test", hit)).alias("test_accuracy"),
        F.avg(F.when(F.col("split") == "train", hit)).alias("train_accuracy"),
        F.count(F.lit(1)).alias("n_pairs"),
        F.count_if(F.col("split") == "test").alias("n_test"),
    )


def objective_gradient(pairs: DataFrame, model: RankModel, c: float = 1.0, col: str = "diff") -> DataFrame:
    """``idx, gradient``: the gradient of the objective at the model's weights (the
    intercept last), by plain aggregates; zero at the optimum."""
    dim = len(model.weights)
    margin = F.lit(1.0) - F.col("label") * (dot(col, model.weights) + F.lit(model.intercept))
    pull = F.lit(-2.0 * c) * F.col("label") * F.greatest(margin, F.lit(0.0))
    parts = [F.coalesce(F.sum(pull * F.coalesce(F.col(col)[i], F.lit(0.0))), F.lit(0.0)) + F.lit(model.weights[i]) for i in range(dim)]
    parts.append(F.coalesce(F.sum(pull), F.lit(0.0)) + F.lit(model.intercept))
    return pairs.agg(F.array(*parts).alias("g")).select(F.posexplode("g").alias("idx", "gradient"))


def iterate_at(model: RankModel, max_iter: int) -> np.ndarray:
    """Weights (with intercept last) after ``max_iter`` solver steps; a solver that
    had converged by then stays where it is, one cut off earlier is an error."""
    h = model.history
    if max_iter >= len(h) and not model.converged:
        raise ValueError(f"the recorded fit ended after {len(h) - 1} steps without converging")
    return h[min(max_iter, len(h) - 1)]["w"]


def learning_curve(split: DataFrame, model: RankModel, points=(1, 10, 100, 1000, 10000, 100000), col: str = "diff") -> DataFrame:
    """Test accuracy after 10⁰…10⁵ solver steps (one recorded solver
    path, all points scored in a single aggregate)."""
    test = split.where(F.col("split") == "test")
    aggs = []
    for p in points:
        w = iterate_at(model, p)
        m = dot(col, list(w[:-1])) + F.lit(float(w[-1]))
        pred = F.when(m > 0, F.lit(1)).otherwise(F.lit(-1))
        aggs.append(F.avg((pred == F.col("label")).cast("double")).alias(f"p{p}"))
    r = test.agg(*aggs)
    return r.select(
        F.explode(
            F.array(*[F.struct(F.lit(p).cast("bigint").alias("max_iter"), F.col(f"p{p}").alias("accuracy")) for p in points])
        ).alias("s")
    ).select("s.max_iter", "s.accuracy")


def tolerance_iterate(model: RankModel, tol: float) -> np.ndarray:
    """First recorded iterate satisfying the relative-gradient rule for ``tol``."""
    g0 = model.history[0]["grad_norm"]
    for h in model.history:
        if h["grad_norm"] <= tol * max(g0, 1e-300):
            return h["w"]
    raise ValueError(f"no recorded step meets tolerance {tol}")


def tolerance_sweep(
    rows: DataFrame, model: RankModel, doc_authors: DataFrame, groups: DataFrame, tolerances=(1e-2, 1e-4, 1e-6, 1e-8), *, zero_total: str = "zero"
) -> DataFrame:
    """``tol, fairness, utility`` of the ranking by the weights with which a fit (one recorded
    path) would have ended at each tolerance."""
    from .measures import fairness_and_utility
    from .ranking import rank_documents

    out = None
    for tol in tolerances:
        ranked = rank_documents(rows, [float(v) for v in tolerance_iterate(model, tol)[:-1]])
        r = fairness_and_utility(ranked, doc_authors, groups, zero_total=zero_total).select(F.lit(float(tol)).alias("tol"), "fairness", "utility")
        out = r if out is None else out.unionByName(r)
    return out
