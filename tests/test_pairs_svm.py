import itertools
import random

import numpy as np
from pyspark.sql import functions as F

from rankaudit.operators import pairs as PR
from rankaudit.operators import ranksvm as SVM


def _rows(spark, n=40, dim=4, seed=3):
    rnd = random.Random(seed)
    rows = [(i, i % 5, float(rnd.randint(0, 3)), [rnd.gauss(0, 1) for _ in range(dim)]) for i in range(n)]
    return rows, spark.createDataFrame(rows, "ord long, qid long, rel double, features array<double>")


def test_pairs_and_balance_match_combinations(spark):
    rows, df = _rows(spark)
    got = {(r.i, r.j): (r.label, r.diff) for r in PR.training_pairs(df).collect()}
    X = np.array([r[3] for r in rows])
    y = np.array([r[2] for r in rows])
    q = np.array([r[1] for r in rows])
    exp = {}
    for k, (i, j) in enumerate(itertools.combinations(range(len(rows)), 2)):
        if y[i] == y[j] or q[i] != q[j]:
            continue
        xd, lab = X[i] - X[j], np.sign(y[i] - y[j])
        if lab != (-1) ** k:
            xd, lab = -xd, -lab
        exp[(i, j)] = (int(lab), xd)
    assert set(got) == set(exp)
    for key, (lab, xd) in exp.items():
        assert got[key][0] == lab
        assert np.allclose(got[key][1], xd)


def test_parity_large_n(spark):
    n = 3_000_000_000
    df = spark.createDataFrame([(5, 7), (123456789, 2999999999)], "i long, j long")
    got = [r[0] for r in df.select(PR.pair_index_parity(F.col("i"), F.col("j"), F.lit(n))).collect()]
    exp = [((i * (2 * n - i - 1)) // 2 + (j - i - 1)) % 2 for i, j in [(5, 7), (123456789, 2999999999)]]
    assert got == exp


def test_split_exact(spark):
    df = spark.range(0, 1003).select(F.col("id").alias("i"), (F.col("id") * 7).alias("j"))
    s = PR.split_pairs(df, train_size=0.8, seed=7)
    counts = {r[0]: r[1] for r in s.groupBy("split").count().collect()}
    assert counts == {"train": 802, "test": 201}
    again = {r[0]: r[1] for r in PR.split_pairs(df, train_size=0.8, seed=7).groupBy("split").count().collect()}
    assert again == counts


def test_newton_reaches_optimum(spark):
    rows, df = _rows(spark, n=60, dim=3)
    p = PR.training_pairs(df)
    m = SVM.fit_rank_svm(p, 3, tol=1e-10, max_iter=100)
    d = p.select("diff", "label").collect()
    X = np.hstack([np.array([r.diff for r in d]), np.ones((len(d), 1))])
    y = np.array([r.label for r in d], dtype=float)
    w = np.array(m.weights + [m.intercept])
    z = y * (X @ w)
    act = z < 1
    g = w + 2 * (X[act].T @ ((z[act] - 1) * y[act]))
    assert np.linalg.norm(g) < 1e-6
    acc = SVM.pair_accuracy(p, m).first().accuracy
    assert 0.0 <= acc <= 1.0
