import random

import numpy as np
import pytest

from rankaudit.llm import whitening as W

SCHEMA = "vec_id long, embedding array<float>, label int, n string, index long"


def brute(rows):
    """vec_id lists, n, deviations, whitened and explained of the usable rows."""
    rows = [(i, v) for i, v in rows if v is not None and all(c is not None and np.isfinite(c) for c in v)]
    d = max((len(v) for _, v in rows), default=0)
    x = np.array([[int(np.floor(64 * float(np.float32(c)))) + 1_000_000 for c in v] + [1_000_000] * (d - len(v)) for _, v in rows], dtype=object).reshape(len(rows), d)
    n, s = len(rows), x.sum(axis=0)
    deviation = [int(sum((n * a - b) ** 2 for a, b in zip(r, s))) for r in x]
    y = ((n * x - s).astype(float)) / n
    values, axes = np.linalg.eigh(y.T @ y / n)
    values, axes = values[::-1], axes[:, ::-1]
    return [i for i, _ in rows], n, deviation, y @ axes / np.sqrt(np.maximum(values, 1e-300)), values / values.sum()


def compare(df, rows, rank):
    ids, n, deviation, whitened, explained = brute(rows)
    got = {}
    for r in W.whitened_components(df).collect():
        assert r["n"] == n and r["identity_error"] <= 1e-4
        assert abs(r["explained"] - explained[r["component"] - 1]) <= 1e-6 * max(explained[r["component"] - 1], 1e-6)
        got.setdefault((r["vec_id"], r["deviation"]), {}).setdefault(r["component"], []).append(r["whitened"])
    k = min(32, whitened.shape[1])
    want = {}
    for i, (v, dev) in enumerate(zip(ids, deviation)):
        want.setdefault((v, dev), []).append(whitened[i])
    assert got.keys() == want.keys()
    for c in range(min(rank, k)):  # one sign for all rows
        pairs = [(a, b) for key, ws in want.items() for a, b in zip(sorted(got[key][c + 1]), sorted(w[c] for w in ws))]
        flipped = [(a, b) for key, ws in want.items() for a, b in zip(sorted(got[key][c + 1]), sorted(-w[c] for w in ws))]
        assert min(max(abs(a - b) for a, b in p) for p in (pairs, flipped)) < 1e-6
    return got


def test_equals_numpy_with_odd_rows(spark):
    rnd = np.random.default_rng(4)
    scale = 1.5 ** -np.arange(40) + 0.02 * np.arange(1, 41)[::-1]
    rows = [(i, (rnd.normal(size=40) * scale + 3).astype(np.float32).tolist()) for i in range(700)]
    rows[5] = (5, rows[5][1][:30])
    rows += [(9000, None), (9001, [None] + rows[0][1][1:]), (9002, [float("nan")] * 40), (9003, [float("inf")] + [0.0] * 39), (None, rows[3][1]), rows[7], rows[7], (9004, [])]
    df = spark.createDataFrame([(i, v, 1, "x", 3) for i, v in rows], SCHEMA).repartition(7)
    got = compare(df, rows, 32)
    assert all(len(v) == 32 for v in got.values())


def test_small_blocks_give_the_same(spark, monkeypatch):
    monkeypatch.setattr(W, "BLOCK", 64)
    monkeypatch.setattr(W, "WIDE", 4)
    rnd = np.random.default_rng(5)
    rows = [(i, (rnd.normal(size=9) * np.arange(1, 10)).astype(np.float32).tolist()) for i in range(200)]
    compare(spark.createDataFrame([(i, v, 1, "x", 3) for i, v in rows], SCHEMA).repartition(3), rows, 9)


def test_without_variance(spark):
    rows = [(i, [float(i % 3), 2.0, 5.0]) for i in range(10)]
    df = spark.createDataFrame([(i, v, 1, "x", 3) for i, v in rows], SCHEMA)
    got = W.whitened_components(df).collect()
    assert len(got) == 30 and all(r["identity_error"] < 1e-9 for r in got)
    assert all(r["whitened"] == 0 and r["explained"] == 0 for r in got if r["component"] > 1)
    one = W.whitened_components(spark.createDataFrame([(1, [1.0, 2.0], 0, "x", 3)], SCHEMA)).collect()
    assert [(r["component"], r["n"], r["deviation"], r["whitened"]) for r in one] == [(1, 1, 0, 0.0), (2, 1, 0, 0.0)]


@pytest.mark.parametrize("rows", [[], [(1, None, 0, "x", 3)], [(1, [], 0, "x", 3), (2, [], 0, "x", 3)]])
def test_no_vectors(spark, rows):
    got = W.whitened_components(spark.createDataFrame(rows, SCHEMA))
    assert got.collect() == []
    assert got.columns == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]


def test_large_entries_stay_exact(spark):
    rnd = random.Random(6)
    rows = [(i, [rnd.choice((-1, 1)) * 2.0 ** rnd.randint(0, 40), 2.0**20]) for i in range(30)]
    df = spark.createDataFrame([(i, v, 1, "x", 3) for i, v in rows], SCHEMA)
    x = [[max(-W.LARGEST, min(W.LARGEST, int(64 * c))) for c in v] for _, v in rows]
    s = [sum(c) for c in zip(*x)]
    want = {i: sum((30 * a - b) ** 2 for a, b in zip(r, s)) for (i, _), r in zip(rows, x)}
    for r in W.whitened_components(df).collect():
        assert r["deviation"] == (want[r["vec_id"]] if want[r["vec_id"]] < 2**63 else None)
