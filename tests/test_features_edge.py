"""Feature edge cases against a plain-Python brute force of the formulas."""

import math
import re

from rankaudit.operators.features import FeatureSpec, judged_features

TOK = re.compile(r"(?u)\b\w\w+\b")


def brute(docs, query, k1=1.2, b=0.75, lam=0.1, mu=2000.0, delta=0.7):
    toks = {d: TOK.findall(t.lower()) for d, t in docs.items()}
    n = len(docs)
    tf = {d: {} for d in docs}
    for d, ts in toks.items():
        for t in ts:
            tf[d][t] = tf[d].get(t, 0) + 1
    df, cf = {}, {}
    for d in docs:
        for t, c in tf[d].items():
            df[t] = df.get(t, 0) + 1
            cf[t] = cf.get(t, 0) + c
    total = sum(cf.values())
    idf = {t: math.log((1 + n) / (1 + df[t])) + 1 for t in df}
    avg = total / n
    q = [t for t in dict.fromkeys(TOK.findall(query.lower())) if t in df]
    out = {}
    for d in docs:
        dl = len(toks[d])
        norm = math.sqrt(sum((c * idf[t]) ** 2 for t, c in tf[d].items()))
        f = [0.0] * 7
        for t in q:
            x, p = tf[d].get(t, 0), cf[t] / total
            f[0] += x
            f[1] += idf[t]
            f[2] += x * idf[t] / norm if x else 0.0
            f[3] += idf[t] * x * (k1 + 1) / (x + k1 * (1 - b + b * dl / avg))
            if dl:
                f[4] -= math.log(max(x - delta, 0) / dl + delta * df[t] / dl * p)
                f[5] -= math.log((x + mu * p) / (dl + mu))
                f[6] -= math.log((1 - lam) * x / dl + lam * p)
        out[d] = f
    return out


def test_text_features_edge_cases(spark):
    docs = {1: "a1 b2 b2 c3 café", 2: "", 3: "c3 c3 x_1 a1", 4: "zz yy"}
    corpus = spark.createDataFrame([(k, v) for k, v in docs.items()], "id long, paperAbstract string")
    specs = [FeatureSpec("text", "paperAbstract")]
    for qid, query in [(1, "a1 a1 c3"), (2, "nothing here matches"), (3, "a1")]:
        judged = spark.createDataFrame(
            [(qid, query, d, 1.0) for d in docs] + [(qid, query, 99, 0.0)],  # 99: unknown doc, skipped
            "qid long, query string, doc_id long, relevance double",
        )
        got = {r.doc_id: r.features for r in judged_features(judged, corpus, specs).collect()}
        exp = brute(docs, query)
        assert set(got) == set(docs)
        for d in docs:
            assert all(abs(g - e) < 1e-9 for g, e in zip(got[d], exp[d])), (query, d, got[d], exp[d])
    # repeated query term counts once
    assert brute(docs, "a1 a1")[1] == brute(docs, "a1")[1]


def test_repeated_judgements_two_texts_and_papers(spark):
    docs = {1: "a1 b2 b2 c3 café", 2: "", 3: "c3 c3 x_1 a1", 4: "zz yy"}
    corpus = spark.createDataFrame([(k, v) for k, v in docs.items()], "id long, paperAbstract string")
    specs = [FeatureSpec("text", "paperAbstract"), FeatureSpec("num", "n_citations")]
    judged = spark.createDataFrame(
        [(1, "a1 c3", 1, 1.0), (1, "a1 c3", 1, 0.0), (1, "zz", 1, 1.0), (1, "zz", 4, 1.0), (2, None, 3, 1.0), (2, "c3", 2, 1.0)],
        "qid long, query string, doc_id long, relevance double",
    )
    papers = spark.createDataFrame([(1, 0, 5), (1, 1, 9), (3, 2, 7), (4, 3, None), (8, 4, 1)], "paper_sha long, doc_idx long, n_citations int")
    got = judged_features(judged, corpus, specs, papers=papers, paper_ord="doc_idx").collect()
    assert len(got) == 5  # document 2 is in no paper
    texts = {"a1 c3": brute(docs, "a1 c3"), "zz": brute(docs, "zz")}
    ones = sorted(tuple(round(x, 9) for x in r.features[:7]) for r in got if r.doc_id == 1)
    want = sorted(tuple(round(x, 9) for x in texts[t][1]) for t in ("a1 c3", "a1 c3", "zz"))
    assert ones == want
    assert {r.doc_id: r.features[7] for r in got} == {1: 5.0, 3: 7.0, 4: None}
    assert [r.features[:7] for r in got if r.doc_id == 3] == [[0.0] * 7]


def test_documents_are_tokenised_once(spark):
    corpus = spark.createDataFrame([(1, "a1 b2"), (2, "b2")], "id long, paperAbstract string")
    judged = spark.createDataFrame([(1, "a1", 1, 1.0)], "qid long, query string, doc_id long, relevance double")
    plan = judged_features(judged, corpus, [FeatureSpec("text", "paperAbstract")])._jdf.queryExecution().optimizedPlan().toString()
    assert not re.search(r"Generate explode.*paperAbstract", plan)  # words of documents come from the written postings
    assert "Cartesian" not in plan
