import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from rankaudit.operators import pairs as PR
from rankaudit.operators import ranksvm as SVM
from rankaudit.operators import rowsvm as RV

SCHEMA = "ord long, qid long, rel double, features array<double>"


def table(spark, n=160, dim=4, seed=5, queries=4, levels=4):
    rnd = random.Random(seed)
    rows = [(i, rnd.randrange(queries), rnd.choice([None, *map(float, range(levels))]) if i % 17 == 0 else float(rnd.randrange(levels)), [rnd.gauss(0, 1) for _ in range(dim)]) for i in range(n)]
    rows[3] = (3, rows[3][1], rows[3][2], [1.0, None, float("nan"), 2.0][:dim])
    rows[9] = (9, 99, 1.0, rows[9][3])  # a query of one row
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


def as_zero(df):
    return df.withColumn("features", F.transform("features", lambda v: F.coalesce(F.nanvl(v, F.lit(0.0)), F.lit(0.0))))


@pytest.mark.parametrize("block,small", [(16_384, 48), (16, 2), (7, 1)])
def test_sums_equal_the_pair_table(spark, monkeypatch, block, small):
    monkeypatch.setattr(RV, "SMALL", small)
    df, dim = table(spark), 4
    units = RV.row_units(df, dim, block=block)
    pairs = PR.training_pairs(as_zero(df)).where("label is not null").collect()
    x = np.array([[*p.diff, 1.0] for p in pairs])
    y = np.array([p.label for p in pairs], float)
    for point in (np.zeros(5), np.array([0.3, -0.8, 0.1, 0.4, 0.25]), np.array([2.0, 1.0, -3.0, 0.5, -0.7])):
        z = y * (x @ point)
        live = z < 1
        loss, right, grad, hess = RV._parts(RV._pass(units, dim, point), dim)
        assert abs(loss - ((1 - z[live]) ** 2).sum()) < 1e-6
        assert right == (((x @ point) > 0) == (y > 0)).sum()
        assert np.allclose(grad, x[live].T @ ((z[live] - 1) * y[live]))
        assert np.allclose(hess, x[live].T @ x[live])
    n, mean, std = RV.pair_moments(units, dim)
    assert n == len(pairs) and np.allclose(mean, x[:, :4].mean(0)) and np.allclose(std, x[:, :4].std(0))


def test_weights_equal_the_pair_solver(spark):
    df, dim = as_zero(table(spark, seed=6)), 4
    scaled, means, stds = PR.scale_features(PR.training_pairs(df), dim)
    want = SVM.fit_rank_svm(scaled, dim, tol=1e-12)
    got = RV.fit_rank_svm_rows(df, dim, tol=1e-12, block=32, record=True)
    assert np.allclose(got.weights, want.weights, atol=1e-8) and abs(got.intercept - want.intercept) < 1e-8
    assert np.allclose(got.means, means) and np.allclose(got.stds, stds) and got.history[0]["iter"] == 0
    n, accuracy = RV.row_pair_accuracy(RV.row_units(df, dim, block=32), got, dim)
    assert n == scaled.count() and abs(accuracy - SVM.pair_accuracy(scaled, want).first().accuracy) < 1e-12
    raw = SVM.fit_rank_svm(PR.training_pairs(df, balance="none"), dim, tol=1e-12)
    plain = RV.fit_rank_svm_rows(df, dim, tol=1e-12, scaled=False, balance="none")
    assert np.allclose(plain.weights, raw.weights, atol=1e-8)


def test_many_relevance_levels(spark):
    rnd = random.Random(9)
    df = spark.createDataFrame([(i, 1, rnd.random(), [rnd.gauss(0, 1), rnd.gauss(0, 1)]) for i in range(300)], SCHEMA)
    want = SVM.fit_rank_svm(PR.training_pairs(df), 2, tol=1e-12)
    got = RV.fit_rank_svm_rows(df, 2, tol=1e-12, scaled=False, block=100)
    assert np.allclose(got.weights, want.weights, atol=1e-7)


def test_one_long_list_without_pairs(spark):
    n = 100_000
    x0, x1 = F.randn(3), F.randn(4)
    rows = spark.range(n).select(F.col("id").alias("ord"), F.lit(7).cast("long").alias("qid"), x0.alias("u"), x1.alias("v"))
    rows = rows.select("ord", "qid", F.floor(F.lit(2) + F.col("u") + F.lit(0.2) * F.col("v")).cast("double").alias("rel"), F.array("u", "v").alias("features"))
    units = RV.row_units(rows, 2)
    assert units.select("one", "two").distinct().count() == 28  # 7 blocks, spread over tasks
    model = RV.fit_rank_svm_rows(rows, 2, tol=1e-3)
    assert model.converged and model.weights[0] > 0
    pairs, accuracy = RV.row_pair_accuracy(units, model, 2)
    assert pairs > 2_000_000_000 and accuracy > 0.95


def test_nothing_to_pair(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert RV.fit_rank_svm_rows(none, 2).weights == [0.0, 0.0]
    same = spark.createDataFrame([(0, 1, 1.0, [1.0, 2.0]), (1, 1, 1.0, [0.0, 2.0])], SCHEMA)
    assert RV.pair_moments(RV.row_units(same, 2), 2)[0] == 0
