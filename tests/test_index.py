"""A kept index against indexes built anew, and pruned search against full scoring."""

import random
import uuid

import pytest
from pyspark.sql import functions as F

from rankaudit.operators import features as FT
from rankaudit.operators import index as IX
from rankaudit.operators import termstats as TS
from rankaudit.session import shared_dir

SCHEMA = "id long, paperAbstract string, title string, place int"


def new_path(spark):
    return shared_dir(spark, f"test-index-{uuid.uuid4().hex}")


def documents(n=400, seed=2):
    rnd = random.Random(seed)
    words = [f"w{i}" for i in range(600)]
    weights = [1 / (i + 1) for i in range(600)]
    text = lambda k: " ".join(rnd.choices(words, weights, k=k))
    return [(i, text(rnd.randint(0, 60)), text(3), i) for i in range(n)]


@pytest.fixture(scope="module")
def corpus(spark):
    rows = documents()
    rows[7] = (7, None, "", 7)
    rows[11] = (11, rows[10][1], "copy", 11)  # the same text twice
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def queries(spark, corpus):
    texts = [r["paperAbstract"] for r in corpus.where("id in (10, 33, 90, 200)").orderBy("id").collect()]
    extra = ["w0 w1 w2", "w590 w0", "nothing matches", None, "w3"]
    return spark.createDataFrame(list(enumerate(texts + extra)), "qid long, query string")


def same(a, b, digits=9):
    rows = lambda df: sorted(tuple(round(v, digits) if isinstance(v, float) else v for v in r) for r in df.collect())
    x, y = rows(a), rows(b)
    assert x == y and a.columns == b.columns
    return len(x)


def test_segments_add_up(spark, corpus, queries):
    fields = ["paperAbstract", "title"]
    parts = [corpus.where(F.col("id") % 3 == r) for r in range(3)]
    index = IX.build_index(parts[0], fields, new_path(spark))
    for p in parts[1:]:
        index = index.append(p)
    assert len(index.segments) == 3
    again = index.append(parts[1].limit(40))  # a replayed batch
    assert again.n_docs == index.n_docs and len(again.segments) == 3
    one = index.compact()
    assert len(one.segments) == 1 and len(IX.load_index(spark, index.path).segments) == 1
    want = TS.field_index(corpus, "paperAbstract")
    judged = queries.crossJoin(corpus.select(F.col("id").alias("doc_id")).where("doc_id < 20")).withColumn("relevance", F.lit(1.0))
    specs = [FT.FeatureSpec("text", "paperAbstract"), FT.FeatureSpec("len", "title"), FT.FeatureSpec("text", "title")]
    for kept in (index, one):
        view = kept.field("paperAbstract")
        same(TS.idf(view), TS.idf(want))
        same(TS.tfidf(view), TS.tfidf(want))
        same(TS.collection_stats(view), TS.collection_stats(want))
        same(view.doc_length(), want.doc_length())
        same(TS.query_terms(queries, view), TS.query_terms(queries, want))
    got = FT.judged_features(judged, corpus, specs, index=one).select("qid", "doc_id", F.explode("features").alias("v"))
    same(got, FT.judged_features(judged, corpus, specs).select("qid", "doc_id", F.explode("features").alias("v")), 7)
    plan = FT.score_corpus(queries, one.field("paperAbstract"))._jdf.queryExecution().optimizedPlan().toString()
    assert "paperAbstract" not in plan  # nothing of the documents is tokenised


@pytest.mark.parametrize("k", [1, 10])
def test_pruned_search_equals_full_scoring(spark, corpus, queries, k, monkeypatch):
    monkeypatch.setattr(IX, "BLOCK", 16)
    index = IX.build_index(corpus, ["paperAbstract"], new_path(spark))
    search = index.searchable("paperAbstract")
    full = TS.field_index(corpus, "paperAbstract")
    n = same(search.top_k(queries, k), FT.search_top_k(queries, full, k))
    assert n == 9 * k
    assert index.searchable("paperAbstract").path == search.path  # written once
    grown = index.append(spark.createDataFrame([(5000, "w0 w1 w2 w590", "", 5000)], SCHEMA))
    assert grown.searchable("paperAbstract").path != search.path
    more = corpus.unionByName(spark.createDataFrame([(5000, "w0 w1 w2 w590", "", 5000)], SCHEMA))
    same(grown.searchable("paperAbstract").top_k(queries, k), FT.search_top_k(queries, TS.field_index(more, "paperAbstract"), k))


def test_search_reads_few_postings(spark, monkeypatch):
    monkeypatch.setattr(IX, "BLOCK", 64)
    rows = documents(3000, seed=4)
    corpus = spark.createDataFrame(rows, SCHEMA)
    queries = spark.createDataFrame([(i, rows[i * 97][1]) for i in range(20)], "qid long, query string")
    search = IX.build_index(corpus, ["paperAbstract"], new_path(spark)).searchable("paperAbstract")
    r = search.scanned(queries).agg(F.sum("postings"), F.sum("scanned")).first()
    assert r[1] < 0.5 * r[0]


def test_a_feature_of_ones_own(spark, corpus, queries):
    coverage = FT.TextFeature("share", "share of words of {field}", lambda t: F.when(t.tf > 0, F.lit(1.0)).otherwise(F.lit(0.0)))
    vowels = FT.DocFeature("vowels in {field}", lambda c: F.length(F.regexp_replace(c, "[^aeiou]", "")))
    specs = [FT.FeatureSpec("text", "paperAbstract", (*FT.built_in(), coverage)), FT.FeatureSpec("doc", "title", (vowels,))]
    assert specs[0].names()[-1] == "share of words of paperAbstract" and specs[1].names() == ["vowels in title"]
    judged = queries.crossJoin(corpus.select(F.col("id").alias("doc_id")).where("doc_id < 12")).withColumn("relevance", F.lit(1.0))
    got = FT.judged_features(judged, corpus, specs).collect()
    plain = FT.judged_features(judged, corpus, [FT.FeatureSpec("text", "paperAbstract")]).collect()
    by = {(r.qid, r.doc_id): r.features for r in plain}
    texts = {r.id: (r.paperAbstract or "", r.title) for r in corpus.collect()}
    asked = {r.qid: (r.query or "") for r in queries.collect()}
    vocabulary = {w for t, _ in texts.values() for w in t.split()}
    for r in got:
        assert r.features[:7] == pytest.approx(by[(r.qid, r.doc_id)])
        words = set(asked[r.qid].split()) & vocabulary
        assert r.features[7] == len(words & set(texts[r.doc_id][0].split()))
        assert r.features[8] == sum(c in "aeiou" for c in texts[r.doc_id][1])


def test_repeated_corpus_ids(spark):
    corpus = spark.createDataFrame([(1, "a1 a1 b2", "t", 0), (1, "a1 a1 c3", "u", 1), (2, "b2", "v", 2), (None, "a1", "w", 3)], SCHEMA)
    judged = spark.createDataFrame([(1, "a1", 1, 1.0)], "qid long, query string, doc_id long, relevance double")
    specs = [FT.FeatureSpec("text", "paperAbstract"), FT.FeatureSpec("len", "title"), FT.FeatureSpec("num", "place")]
    for rows in (FT.judged_features(judged, corpus, specs, ord_col="place").collect(), FT.judged_features(judged, corpus, specs).collect()):
        assert len(rows) == 1 and rows[0].features[0] == 2.0 and rows[0].features[-1] == 0.0
    # all rows count for the statistics
    _, terms = FT.field_postings(corpus, ["paperAbstract"], ord_col="place")
    assert {r.term: (r.df, r.cf) for r in terms.collect()} == {"a1": (2, 4), "b2": (2, 2), "c3": (1, 1)}
    index = IX.build_index(corpus, ["paperAbstract"], new_path(spark), ord_col="place")
    assert index.n_docs == 3 and {r.term: r.df for r in index.terms.collect()} == {"a1": 2, "b2": 2, "c3": 1}
    rows = FT.judged_features(judged, corpus, specs, ord_col="place", index=index).collect()
    assert len(rows) == 1 and rows[0].features[0] == 2.0


def test_feature_names(spark):
    rows = FT.feature_names(spark, FT.default_specs()).orderBy("index").collect()
    assert len(rows) == 25 and rows[0].name == "TF(q, d) in paperAbstract" and rows[24].name == "num of n_chars"
    assert [r.name for r in rows[4:7]] == [f"LMIR_{k}(q, d) in paperAbstract" for k in ("ABS", "DIR", "JM")]


def test_empty_index(spark, queries):
    empty = spark.createDataFrame([], SCHEMA)
    index = IX.build_index(empty, ["paperAbstract"], new_path(spark))
    assert index.n_docs == 0 and index.searchable("paperAbstract").top_k(queries, 2).collect() == []
    assert index.append(spark.createDataFrame([(1, "w0", "", 0)], SCHEMA)).n_docs == 1
