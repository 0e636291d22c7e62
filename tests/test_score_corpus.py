"""score_corpus (F12) gives each query a score of every document, 0 where they share no term."""

import math
import re
import uuid
from collections import Counter

import duckdb
import pytest

import __spark_entry__ as E
from rankaudit import session
from rankaudit.operators import features as FT
from rankaudit.operators import index as IX
from rankaudit.operators import termstats as TS

TEXTS = ["red fox", "red red hen", "", None, "blue hen", "a", "red fox"] + [f"word{i} fox" for i in range(20)]
QUERIES = [(1, "red fox"), (2, "nothing of it"), (3, None), (4, "hen hen blue"), (5, "")]


def brute():
    """The reference's sum, over dense vectors."""
    tfs = [Counter(w for w in (t or "").split() if len(w) > 1) for t in TEXTS]
    df = Counter(w for tf in tfs for w in tf)
    idf = {w: math.log((1 + len(TEXTS)) / (1 + n)) + 1 for w, n in df.items()}
    norms = [math.sqrt(sum((n * idf[w]) ** 2 for w, n in tf.items())) for tf in tfs]
    asked = [(q, {w for w in (t or "").split() if w in idf}) for q, t in QUERIES]
    return {(q, d): round(sum(tf[w] * idf[w] / norms[d] for w in words if tf[w]), 6) for q, words in asked for d, tf in enumerate(tfs)}


def scores(rows):
    found = {(r[0], r[1]): round(r[2], 6) for r in rows}
    assert len(found) == len(rows)  # one row a pair
    return found


def near(got, want):
    return got.keys() == want.keys() and all(abs(got[k] - want[k]) <= 2e-6 for k in want)


def test_the_query_scores_every_document(spark, tmp_path):
    docs = [(d, t, "en", "src", len(t or "")) for d, t in enumerate(TEXTS)]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(QUERIES, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    want = brute()
    assert len(want) == len(TEXTS) * len(QUERIES) and 0.0 in want.values()
    got = E.queries()["score_corpus"](spark, str(tmp_path))
    assert got.columns == ["qid", "doc_id", "score"] and near(scores(got.collect()), want)
    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{tmp_path}/{t}.parquet/*.parquet')")
    assert near(scores(con.sql(E.oracle_sql()["score_corpus"]).fetchall()), want)


@pytest.mark.parametrize("small", [1, 1 << 18])
def test_scores_of_every_document_do_not_depend_on_sizes(spark, monkeypatch, small):
    """Rows of few queries are never shuffled with their documents; many queries meet them by several keys."""
    for module in (session, TS, FT):
        monkeypatch.setattr(module, "SMALL", small)
    monkeypatch.setattr(FT, "DOCS_A_TASK", 4)
    corpus = spark.createDataFrame(list(enumerate(TEXTS)), "id long, paperAbstract string").repartition(3)
    queries = spark.createDataFrame(QUERIES, "qid long, query string")
    kept = IX.build_index(corpus, ["paperAbstract"], session.shared_dir(spark, f"test-index-{uuid.uuid4().hex}"))
    for index in (kept.field("paperAbstract"), TS.field_index(corpus, "paperAbstract")):
        got = FT.score_corpus(queries, index, every=True)
        assert near(scores(got.collect()), brute())
        plan = got._jdf.queryExecution().executedPlan().toString()
        assert small == 1 or not re.search(r"hashpartitioning\(qid#\d+L?, doc_id", plan)
        matches = scores(FT.score_corpus(queries, index).collect())  # without ``every``: the same without zeros
        assert near(matches, {k: v for k, v in brute().items() if v})


def test_repeated_and_missing_keys(spark):
    """A query or document that comes twice has one row a pair; a document without id has none, a query without id has its own."""
    corpus = spark.createDataFrame([(1, "red fox"), (1, "hen"), (2, "hen"), (3, ""), (None, "red")], "id long, paperAbstract string")
    queries = spark.createDataFrame([(7, "hen"), (7, "hen"), (8, "none"), (None, "red")], "qid long, query string")
    index = IX.build_index(corpus, ["paperAbstract"], session.shared_dir(spark, f"test-index-{uuid.uuid4().hex}")).field("paperAbstract")
    every, matches = (scores(FT.score_corpus(queries, index, every=e).collect()) for e in (True, False))
    assert every.keys() == {(q, d) for q in (7, 8, None) for d in (1, 2, 3)}
    assert {k: v for k, v in every.items() if v} == matches
