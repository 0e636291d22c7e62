"""Words are counted where they lie, and rare terms alone are shuffled; results do not depend on sizes."""

import random
import re
import uuid
from collections import Counter

import pytest
from pyspark.sql import functions as F

from rankaudit import session
from rankaudit.functions.text import tokens, word_counts
from rankaudit.operators import features as FT
from rankaudit.operators import index as IX
from rankaudit.operators import termstats as TS
from rankaudit.sources import io as IO

TEXTS = ["b a b", "", None, "aa bb aa cc aa bb", "zz", "Äh äh " * 300, "aa " * 5 + "x y"]


def index_of(spark, texts):
    corpus = spark.createDataFrame(list(enumerate(texts)), "id long, paperAbstract string").repartition(3)
    return corpus, IX.build_index(corpus, ["paperAbstract"], session.shared_dir(spark, f"test-index-{uuid.uuid4().hex}"))


def texts_of(n=150):
    rnd = random.Random(5)
    words, weights = [f"w{i}" for i in range(300)], [1 / (i + 1) for i in range(300)]
    return [" ".join(rnd.choices(words, weights, k=rnd.randint(0, 40))) for _ in range(n)]


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def rows(df):
    return sorted(tuple(round(v, 9) if isinstance(v, float) else v for v in r) for r in df.collect())


def test_word_counts(spark):
    df = spark.createDataFrame(list(enumerate(TEXTS)), "id long, t string")
    got = df.select(tokens("t").alias("words"), word_counts(tokens("t")).alias("counts")).collect()
    for r in got:
        assert [tuple(x) for x in r["counts"]] == sorted(Counter(r["words"]).items())


def test_postings_are_not_shuffled(spark):
    """neither writing a segment nor compacting moves words between tasks."""
    corpus, index = index_of(spark, TEXTS)
    assert "hashpartitioning" not in plan(IX.counted(corpus.withColumn("copy", F.lit(0)), ["paperAbstract"], "id"))
    more = index.append(corpus.withColumn("id", F.col("id") + 100)).compact()
    assert len(more.segments) == 1 and "Exchange" not in plan(more.postings)
    assert rows(more.postings.groupBy("term").agg(F.sum("tf"))) == rows(index.postings.groupBy("term").agg(F.sum("tf") * 2))


def test_weights_do_not_depend_on_sizes(spark, monkeypatch):
    """frequent terms are broadcast, rare ones shuffled."""
    _, index = index_of(spark, texts_of())
    view = index.field("paperAbstract")
    expect = rows(view.postings.join(view.terms.select("term", "df", "idf"), "term"))
    for small in (0, 3, 100):
        monkeypatch.setattr(TS, "SMALL", max(small, 1))
        got = TS.with_terms(view.postings, view.terms, ["term"], ["df", "idf"])
        assert rows(got.select("term", "doc_id", "tf", "df", "idf")) == expect


@pytest.mark.parametrize("small", [1, 1 << 18])
def test_scores_and_features_do_not_depend_on_sizes(spark, monkeypatch, small):
    texts = texts_of()
    corpus, index = index_of(spark, texts)
    view, queries = index.field("paperAbstract"), spark.createDataFrame([(i, t) for i, t in enumerate([texts[3], "w0 w5 w5", "none", None])], "qid long, query string")
    for module in (session, TS, FT):
        monkeypatch.setattr(module, "SMALL", small)
    df, n = Counter(w for t in texts for w in set(t.split())), len(texts)
    import math

    idf = {w: math.log((1 + n) / (1 + c)) + 1 for w, c in df.items()}
    expect = []
    for q in queries.collect():
        asked = {w for w in (q["query"] or "").split() if w in idf}
        for d, t in enumerate(texts):
            tf = Counter(t.split())
            if asked & set(tf):
                norm = math.sqrt(sum((c * idf[w]) ** 2 for w, c in tf.items()))
                expect.append((q["qid"], d, sum(tf[w] * idf[w] for w in asked) / norm))
    got = FT.score_corpus(queries, view)
    assert [r[:2] for r in rows(got)] == [r[:2] for r in sorted(expect)]
    assert all(abs(a[2] - b[2]) < 1e-8 for a, b in zip(rows(got), sorted(expect)))
    if small > 1:  # F3, F4, F8: one exchange of words by document, none of scores
        assert not re.search(r"hashpartitioning\(qid#\d+L?, doc_id", plan(got))
    assert rows(index.searchable("paperAbstract").top_k(queries, 3)) == rows(FT.search_top_k(queries, view, 3))

    judged = queries.crossJoin(corpus.select(F.col("id").alias("doc_id"))).withColumn("relevance", F.lit(1.0)).withColumn("query", F.coalesce("query", F.lit("")))
    specs = [FT.FeatureSpec("text", "paperAbstract")]
    feats = FT.judged_features(judged, corpus, specs, index=index)
    by = {(r["qid"], r["doc_id"]): r["features"] for r in feats.collect()}
    assert len(by) == 4 * n
    for qid, d, score in expect:
        assert abs(by[qid, d][2] - score) < 1e-8  # the sum of tf·idf shares
    assert by[2, 5] == [0.0] * 7
    # texts of queries and words of pairs are not shuffled together
    assert not re.search(r"hashpartitioning\(f#\d+, doc_id#\d+L?, term", plan(feats))


def test_a_lowest_id_that_matched_keeps_its_score(spark):
    _, index = index_of(spark, ["aa bb", "aa", "cc", "aa cc"])
    queries = spark.createDataFrame([(1, "cc"), (2, "aa"), (3, "dd")], "qid long, query string")
    got = {(r["qid"], r["rank"]): (r["doc_id"], round(r["score"], 3)) for r in FT.search_top_k(queries, index.field("paperAbstract"), 3).collect()}
    assert got[1, 1] == (2, 1.0) and got[1, 2][0] == 3 and got[1, 3] == (0, 0.0)
    assert [got[2, r][0] for r in (1, 2, 3)][0] == 1 and all(got[2, r][1] > 0 for r in (1, 2, 3))
    assert [got[3, r] for r in (1, 2, 3)] == [(0, 0.0), (1, 0.0), (2, 0.0)]


def test_text_of_known_width_is_parsed_once(spark, tmp_path, monkeypatch):
    """with width and base given no pass looks for the indices."""
    (tmp_path / "t").mkdir()
    (tmp_path / "t" / "a.txt").write_text("1.0 qid:3 0:2.5 1:0.5\n0.0 qid:3  1:4.0\n")
    seen = []
    monkeypatch.setattr(type(spark.range(1)), "first", lambda self: seen.append(self))
    got = IO.read_ranking_text(spark, str(tmp_path / "t"), n_features=2, zero_based=True)
    assert rows(got.select("ord", "features")) == [(0, [2.5, 0.5]), (1, [0.0, 4.0])] and not seen
