import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from rankaudit.llm import topk as T

SCHEMA = "vec_id long, embedding array<float>, score string"


def brute(rows, k=5):
    ok = [(i, np.floor(256 * np.array(v, np.float32).astype(float))) for i, v, _ in rows
          if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)]
    dim = max(len(v) for _, v in ok)
    ok = [(i, np.pad(v, (0, dim - len(v)))) for i, v in ok]
    out = []
    for a, (i, q) in enumerate(ok):
        if i % 50 == 0:
            best = sorted((-int(q @ v), j) for b, (j, v) in enumerate(ok) if a != b)[:k]
            out += [(i, n + 1, j, -s) for n, (s, j) in enumerate(best)]
    return sorted(out)


def got(spark, rows):
    out = T.exact_top_k(spark.createDataFrame(rows, SCHEMA).repartition(3), F.col("id") % 50 == 0)
    return sorted(tuple(r) for r in out.select("query_id", "rank", "vec_id", "score").collect())


def test_clusters_ties_nulls_and_repeats(spark):
    rnd = random.Random(2)
    centres = [[rnd.gauss(0, 1) for _ in range(8)] for _ in range(4)]
    rows = [(i, [c + rnd.gauss(0, 0.2) for c in centres[i % 4]], "x") for i in range(400)]
    rows += [(400 + i, rows[50][1], None) for i in range(150)]  # one very common vector
    rows += [(50, rows[7][1], None), (3, rows[9][1], None), (None, rows[1][1], None), (900, None, None), (950, [1.0, None], None)]
    rows += [(1000, [float("nan")] * 8, None), (1050, [float("inf")] * 8, None), (1100, [0.5, -0.5], None), (1150, [0.0] * 8, None)]
    assert got(spark, rows) == brute(rows)


def test_best_scores_bound_every_score():
    """The case of a short query along the pivot of the longest vector, and vectors of any length."""
    x = np.array([[0.0, 1000.0]])
    annuli = T.Annuli(T.augmented(x, 1e6), 1e6, [{"cell": 0, "low": 0.0, "high": 0.0, "n": 1}])
    assert annuli.best_scores(0.1 * x)[0, 0] >= 1e5

    rng = np.random.default_rng(7)
    x = np.floor(256 * rng.normal(size=(3000, 6)) * rng.lognormal(0, 1, (3000, 1)))
    m2 = float((x * x).sum(1).max())
    pivots = T.fit_pivots(T.augmented(x, m2), 60)
    d = T.distances(T.augmented(x, m2), pivots)
    near, dist = d.argmin(1), d.min(1)
    cell = near * T.RINGS + (np.arange(len(x)) % T.RINGS)
    rows = [{"cell": c, "low": dist[cell == c].min(), "high": dist[cell == c].max(), "n": int((cell == c).sum())} for c in np.unique(cell)]
    annuli = T.Annuli(pivots, m2, rows)
    at = np.searchsorted(annuli.cell, cell)
    assert (annuli.best_scores(x[::10])[:, at] >= x[::10] @ x.T).all()


def test_shards_keep_pivots_apart_and_cut_large_annuli():
    shard, bit, parts = T.sharded(np.array([0, 1, 2, 16, 17, 40]), np.array([600, 400, 1, 2500, 10, 1000]))
    assert shard.tolist() == [0, 0, 1, 2, 3, 4] and bit.tolist() == [0, 1, 0, 0, 0, 0] and parts.tolist() == [1, 1, 1, 3, 1, 1]


@pytest.mark.parametrize(("chunk", "block", "small"), [(7, 3, 0), (40, 16, 0), (T.CHUNK, 5, T.SMALL)])
def test_many_parts_and_blocks(spark, monkeypatch, chunk, block, small):
    monkeypatch.setattr(T, "CHUNK", chunk)
    monkeypatch.setattr(T, "QUERY_BLOCK", block)
    monkeypatch.setattr(T, "QUERY_SLICE", block)
    monkeypatch.setattr(T, "SMALL", small)
    rnd = random.Random(3)
    rows = [(i % 700, [rnd.gauss(0, 1) * 10 ** (i % 3) for _ in range(4)], None) for i in range(900)]
    rows += [(700 + i, rows[50][1], None) for i in range(60)]
    assert got(spark, rows) == brute(rows)


@pytest.mark.parametrize("scale", [1.0, 1e3, 1e9])
def test_packed_components_of_any_size(spark, scale):
    rnd = random.Random(4)
    rows = [(i, [rnd.gauss(0, 1) * scale for _ in range(3)], None) for i in range(200)]
    if scale < 1e9:
        assert got(spark, rows) == brute(rows)
    x = np.floor(256 * np.array([v for _, v, _ in rows]))
    kind = T.packing(float(((np.abs(x) + 257) ** 2).sum(1).max()))
    assert kind == {1.0: np.int16, 1e3: np.int32, 1e9: np.float64}[scale]
    assert (T.unpacked([r.tobytes() for r in x.astype(kind)], kind, 3) == x).all()


def test_vectors_of_varied_length(spark):
    rng = np.random.default_rng(8)
    x = rng.normal(size=(3000, 2))
    x *= rng.lognormal(0, 1, (3000, 1)) / np.linalg.norm(x, axis=1, keepdims=True)
    rows = [(i, [float(c) for c in v], None) for i, v in enumerate(x)]
    assert got(spark, rows) == brute(rows)


def test_few_rows(spark):
    assert got(spark, []) == []
    assert got(spark, [(50, [1.0], None)]) == []
    assert got(spark, [(50, [1.0], None), (1, [2.0], None)]) == [(50, 1, 1, 256 * 512)]


@pytest.mark.parametrize("scale", [1.0, 1e6])
def test_inner_products_are_exact(scale):
    rng = np.random.default_rng(1)
    q, x = (np.floor(rng.normal(size=(5, 7)) * 256 * scale) for _ in range(2))
    want = [[sum(int(a) * int(b) for a, b in zip(r, c, strict=True)) for c in x] for r in q]
    assert T.inner_products(q, x).tolist() == want
