import math
import random
from decimal import Decimal, localcontext

import pytest
from pyspark.sql import functions as F

from rankaudit.operators import measures as M
from rankaudit.operators import rerank as RR


def _ranked(spark, rows):
    return spark.createDataFrame(rows, "qid long, rank int, doc_id long, rel double, score double")


def test_exposure_and_utility_fixture(spark):
    r = _ranked(spark, [(1, i + 1, i, float(rel), 0.0) for i, rel in enumerate([1, 0, 2, 1, 0])])
    ex = M.exposure(r).orderBy("rank").collect()
    assert [round(x.exposure, 10) for x in ex] == [1.0, 0.15, 0.075, -0.015, -0.00225]
    u = M.relevance_utility(M.exposure(r)).first().utility
    assert abs(u - 0.7945) < 1e-12


def test_ndcg_empty_modes(spark):
    r = _ranked(spark, [(1, 1, 1, 1.0, 0.0), (1, 2, 2, 0.0, 0.0), (2, 1, 3, 0.0, 0.0), (2, 2, 4, 0.0, 0.0)])
    assert math.isnan(M.mean_ndcg(r, empty="nan").first().ndcg)
    assert M.mean_ndcg(r, empty="skip").first().ndcg == 1.0
    assert M.mean_ndcg(r, empty="zero").first().ndcg == 0.5


def test_fairness_no_group_author_is_zero(spark):
    r = _ranked(spark, [(1, 1, 1, 1.0, 0.0), (1, 2, 2, 0.0, 0.0)])
    da = spark.createDataFrame([(1, 10), (2, 11)], "doc_id long, author_id long")
    groups = spark.createDataFrame([(99, "g")], "author_id long, gid string")
    ge = M.group_exposure(M.author_exposure(M.exposure(r), da), groups)
    assert M.exposure_fairness(M.group_shares(ge, zero_total="zero")).first().fairness == 0.0
    assert math.isnan(M.exposure_fairness(M.group_shares(ge)).first().fairness)
    with pytest.raises(ValueError):
        M.group_shares(ge, zero_total="skip")


# ---- the rule in exact arithmetic, everything recomputed for every candidate
def _twin(docs, groups, gamma=Decimal("0.5"), s=Decimal("0.7")):
    """docs: list of (doc_id, rel, rhat, authors) in rank order; groups: list of (author, gid)."""
    names = sorted({g for _, g in groups})
    counts = [[sum(1 for a, g in groups if g == name and a in d[3]) for name in names] for d in docs]
    rel, rhat = [Decimal(d[1]) for d in docs], [Decimal(d[2]) for d in docs]
    relevance = [sum(s * rel[i] * counts[i][k] for i in range(len(docs))) for k in range(len(names))]
    if not sum(relevance):
        return [d[0] for d in docs]

    def chain(order, values):
        e, out = Decimal(1), []
        for i in order:
            out.append(e)
            e *= gamma * (1 - s * values[i])
        return out

    def fairness(order):
        e = chain(order, rel)
        exposed = [sum(x * counts[i][k] for x, i in zip(e, order, strict=True)) for k in range(len(names))]
        return sum((x / sum(exposed) - r / sum(relevance)) ** 2 for x, r in zip(exposed, relevance, strict=True)).sqrt()

    def utility(order):
        return sum(x * rhat[i] * s for x, i in zip(chain(order, rhat), order, strict=True))

    order = list(range(len(docs)))
    f, u = fairness(order), utility(order)
    nil = Decimal(10) ** -350
    for i in range(len(docs) - 1):
        t = order.copy()
        t[i], t[i + 1] = t[i + 1], t[i]
        tf, tu = fairness(t), utility(t)
        if f - tf > nil and (f - tf) - (tu - u) > nil:
            order, f, u = t, tf, tu
    return [docs[i][0] for i in order]


def _list(rnd, n, share, authors=15, key=str):
    docs = []
    for k in range(n):
        by = sorted({rnd.randrange(authors) for _ in range(rnd.randint(1, 3))})
        docs.append((key(k), float(rnd.random() < share), 1 - k / max(n - 1, 1), by))
    return docs


GROUPS = [(a, f"g{a % 3}") for a in range(12)] + [(0, "g1")]  # a duplicated author row


@pytest.mark.parametrize("n, share", [(2, 0.5), (9, 0.5), (30, 0.5), (80, 0.5), (80, 0.05), (200, 0.1)])
def test_walk_is_exact_at_any_rank(n, share):
    moved = 0
    for seed in range(3 if n < 100 else 1):
        docs = _list(random.Random(seed), n, share)
        names = sorted({g for _, g in GROUPS})
        weights = [[sum(1 for a, g in GROUPS if g == name and a in d[3]) for name in names] for d in docs]
        with localcontext() as c:
            c.prec = 500
            want = _twin(docs, GROUPS)
        got = RR.walk([d[1] for d in docs], [d[2] for d in docs], weights, 0.5, 0.7, "gain")
        assert [docs[i][0] for i in got] == want
        moved = max([moved, *[k for k, i in enumerate(got) if i != k]])
    assert n < 30 or moved > 2 * n // 3


@pytest.mark.parametrize("kind", ["long", "string"])
def test_adjust_matches_the_rule(spark, kind):
    rnd = random.Random(5)
    rows, expected = [], {}
    for q in range(6):
        name = (lambda k, q=q: q * 100 + k) if kind == "long" else (lambda k, q=q: f"d{q}-{k}")
        docs = _list(rnd, rnd.randint(2, 12), 0.5, key=name)
        qid = q if kind == "long" else f"q{q}"
        with localcontext() as c:
            c.prec = 500
            expected[qid] = _twin(docs, GROUPS)
        rows += [(qid, k + 1, d, rel, rh, float(-k), by) for k, (d, rel, rh, by) in enumerate(docs)]
    df = spark.createDataFrame(rows, f"qid {kind}, rank int, doc_id {kind}, rel double, rhat double, score double, authors array<long>")
    da = df.select("doc_id", F.explode("authors").alias("author_id"))
    g = spark.createDataFrame(GROUPS, "author_id long, gid string")
    out = RR.adjust_for_exposure(df.drop("authors"), RR.doc_group_weights(da, g))
    got = {}
    for r in out.orderBy("qid", "rank").collect():
        got.setdefault(r.qid, []).append(r.doc_id)
    assert got == expected


def test_order_by_the_reference_comparator(spark):
    """Q6: ``predict(b - a)`` with the intercept and never a tie, sorted by Python's comparator sort."""
    import functools
    import random

    from rankaudit.operators.ranking import pairwise_order

    rnd = random.Random(3)
    rows = [(i, i % 3, [rnd.gauss(0, 1), None if i == 5 else rnd.gauss(0, 1)]) for i in range(30)]
    df = spark.createDataFrame(rows, "ord long, qid long, features array<double>").repartition(3)
    w, b = [0.7, -0.4], 0.05
    got = {(r["qid"], r["rank"]): r["ord"] for r in pairwise_order(df, w, b).collect()}
    for q in range(3):
        mine = [r for r in rows if r[1] == q]
        margin = lambda x, y: sum(u * ((c or 0.0) - (a or 0.0)) for u, a, c in zip(w, x[2], y[2])) + b
        want = sorted(mine, key=functools.cmp_to_key(lambda x, y: 1 if margin(x, y) > 0 else -1))
        assert [got[(q, i + 1)] for i in range(len(want))] == [r[0] for r in want]


def test_strict_lookup_fails_where_a_record_is_missing_or_twice(spark):
    import pytest

    from rankaudit.operators.records import paper_with_corpus

    papers = spark.createDataFrame([("a", 1), ("b", 2), ("c", 3)], "paper_sha string, n int")
    corpus = spark.createDataFrame([("a", "x"), ("b", "y"), ("b", "z")], "id string, title string")
    rows = {r["paper_sha"]: r["title"] for r in paper_with_corpus(papers, corpus).collect()}
    assert rows == {"a": "x", "b": None, "c": None}
    with pytest.raises(Exception):
        paper_with_corpus(papers, corpus, strict=True).collect()


def test_a_wrong_iterate_changes_the_sweep(spark):
    from rankaudit.operators import ranksvm as SVM
    from rankaudit.plans import queries as Q
    from rankaudit.sources import adapters as A

    sf = "/root/testdata/sf0.001"
    rows, da, groups = A.feature_rows(spark, sf, binary=True), Q._doc_author_set(spark, sf), A.groups(spark, sf)
    right = [(r["fairness"], r["utility"]) for r in SVM.tolerance_sweep(rows, Q._fixed_path(), da, groups).orderBy("tol").collect()]
    assert len(set(right)) == 4  # every tolerance has a result of its own
    path = Q._fixed_path()
    path.history[2]["w"] = path.history[3]["w"]
    wrong = [(r["fairness"], r["utility"]) for r in SVM.tolerance_sweep(rows, path, da, groups).orderBy("tol").collect()]
    assert sum(a != b for a, b in zip(right, wrong)) == 1


def test_curve_and_sweep_of_a_real_fit(spark):
    import numpy as np

    from rankaudit.operators import pairs as PR
    from rankaudit.operators import ranksvm as SVM

    import random
    rnd = random.Random(4)
    rows = spark.createDataFrame([(i, i // 12, float(rnd.randrange(3)), [rnd.gauss(0, 1) for _ in range(3)]) for i in range(120)], "ord long, qid long, rel double, features array<double>")
    split = PR.split_pairs(PR.training_pairs(rows))
    model = SVM.fit_rank_svm(split.where("split = 'train'"), 3, tol=1e-10, record=True)
    test = split.where("split = 'test'").collect()
    for r in SVM.learning_curve(split, model, points=(0, 1, 2, 1000)).collect():
        w = SVM.iterate_at(model, r["max_iter"])
        hits = [(1 if float(np.dot(p["diff"], w[:-1]) + w[-1]) > 0 else -1) == p["label"] for p in test]
        assert abs(r["accuracy"] - sum(hits) / len(hits)) < 1e-12
    norms = [h["grad_norm"] for h in model.history]
    for tol in (1e-2, 1e-10):  # the first step that meets the rule, and no earlier one
        k = next(i for i, g in enumerate(norms) if g <= tol * norms[0])
        assert SVM.tolerance_iterate(model, tol) is model.history[k]["w"]


def test_walks_side_by_side_equal_one_by_one(spark):
    """Queries of very different lengths, cut over Arrow batches, against ``walk``."""
    import random

    import numpy as np

    from rankaudit.operators import rerank as RR

    rnd = random.Random(9)
    lists, rows, weights = {}, [], []
    for q in range(30):
        n = rnd.choice([1, 2, 3, 8, 20, 20, 150])
        score = sorted((rnd.random() for _ in range(n)), reverse=True)
        lists[q] = []
        for r in range(n):
            doc = len(rows)
            own = {g: rnd.randint(1, 3) for g in rnd.sample("abcde", rnd.randint(0, 3))} if q != 4 else {}
            weights += [(doc, g, c) for g, c in own.items()]
            rel = float(rnd.random() < 0.4) if q != 5 else 0.0
            rhat = (score[r] - score[-1]) / (score[0] - score[-1]) if n > 1 else float("nan")
            rows.append((q, r + 1, doc, rel, rhat, score[r]))
            lists[q].append((doc, rel, rhat, own))
    df = spark.createDataFrame(rows, "qid long, rank int, doc_id long, rel double, rhat double, score double").repartition(3)
    w = spark.createDataFrame(weights, "doc_id long, gid string, n long")
    want = {}
    for q, docs in lists.items():
        groups = sorted({g for d in docs for g in d[3]})
        table = np.array([[d[3].get(g, 0) for g in groups] for d in docs], float).reshape(len(docs), len(groups))
        order = RR.walk([d[1] for d in docs], [d[2] for d in docs], table, 0.5, 0.7, "gain")
        want[q] = [docs[i][0] for i in order]
    assert any(v != [d[0] for d in lists[q]] for q, v in want.items())
    old = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    try:
        for size in ("10000", "7", "1"):
            spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", size)
            got = {}
            for r in sorted(RR.adjust_for_exposure(df, w).collect(), key=lambda r: (r["qid"], r["rank"])):
                got.setdefault(r["qid"], []).append((r["rank"], r["doc_id"]))
            assert got == {q: list(enumerate(v, 1)) for q, v in want.items()}
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", old)
