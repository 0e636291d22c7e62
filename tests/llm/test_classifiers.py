import zlib

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest

from rankaudit.llm import language, quality, toxicity
from tests.llm import fixtures


def fold(doc_id, parts):
    return zlib.crc32(str(doc_id).encode()) % parts


@pytest.fixture(scope="module")
def labelled():
    docs = pq.read_table("/root/testdata/sf0.1/documents.parquet").to_pandas()
    return docs, docs.merge(pq.read_table("/root/testdata/sf0.1/labels.parquet").to_pandas(), on="doc_id")


def run(scorer, texts):
    out = {}
    for lo in range(0, len(texts), 300):
        for k, v in scorer(pa.record_batch({"text": texts[lo : lo + 300]})).items():
            out.setdefault(k, []).extend(v)
    return out


def test_quality_held_out(labelled):
    m = labelled[1]
    held = m.doc_id.map(lambda i: fold(i, 4) == 2)
    model = quality.train(list(m.text[~held]), list(m.quality[~held]))
    p = np.array(run(quality.scorer(model, "text", None), list(m.text[held]))["score"])
    assert ((p >= 0.7) == (m.quality[held] == 1)).mean() > 0.97


def test_toxicity_held_out(labelled):
    m = labelled[1]
    held = m.doc_id.map(lambda i: fold(i, 3) == 1)
    model = toxicity.train(list(m.text[~held]), list(m.toxic[~held]))
    p = np.array(run(toxicity.scorer(model, "text"), list(m.text[held]))["score"])
    y, said = (m.toxic[held] == 1).to_numpy(), p >= 0.7
    assert said[~y].mean() < 0.02  # clean documents are left alone
    assert said[y].mean() > 0.5  # 300 toxic rows to learn from; see README for more
    known = (m.text[held].str.lower().str.count("idiot|moron|scum|loser") >= 4).to_numpy() & y
    assert said[known].mean() > 0.8


def test_language_held_out(labelled):
    d = labelled[0].iloc[:6000]
    held = d.doc_id.map(lambda i: fold(i, 5) == 0)
    trained = language.train(list(d.text[~held])[:3000], list(d.lang[~held])[:3000])
    got = run(language.scorer(trained, "text"), list(d.text[held]))
    assert (np.array(got["lang_pred"]) == d.lang[held].to_numpy()).mean() > 0.98
    assert np.mean(got["rejected"]) < 0.05
    odd = run(language.scorer(trained, "text"), [None, "", "123 !!", "the and of"])
    assert odd["lang_pred"][:3] == ["und"] * 3 and odd["score"][:3] == [0.0] * 3 and odd["lang_pred"][3] == "en"


def test_factorisation_identity():
    model = quality.FactorisationMachine(50, factors=3)
    rng = np.random.default_rng(0)
    model.w[:] = rng.normal(size=50)
    model.v[:] = rng.normal(size=(50, 3))
    feature, value = np.array([3, 9, 20, 41]), rng.normal(size=4)
    pairs = sum(model.v[feature[i]] @ model.v[feature[j]] * value[i] * value[j] for i in range(4) for j in range(i))
    assert np.isclose(model.margin(np.zeros(4, int), feature, value, 1)[0], model.w[feature] @ value + pairs)


def labels(spark):
    return spark.createDataFrame([(i, i % 2, int(i % 5 == 0)) for i in range(0, 70)] + [(3, None, None), (None, 1, 1)], "doc_id long, quality int, toxic int")


@pytest.mark.parametrize("job, parts, part", [(quality.quality, 4, 2), (toxicity.toxicity, 3, 1)])
def test_edges(spark, docs, none, job, parts, part):
    got = job(docs, labels(spark)).collect()
    assert len(got) == len(fixtures.rows())
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7) for r in got)
    assert all(r.held_out == (fold(r.doc_id, parts) == part) for r in got if r.doc_id is not None)
    assert {r.score for r in got if r.doc_id in (74, 75, 76, 77)} == {0.0}  # null and blank texts
    assert sorted(map(str, got)) == sorted(map(str, job(docs, labels(spark)).collect()))
    assert job(none, labels(spark)).collect() == []
    unlearned = job(docs, labels(spark).where("doc_id < 0")).collect()
    assert {r.score for r in unlearned} == {0.0}


def test_language_edges(spark, docs, none):
    got = language.language_id(docs).collect()
    assert len(got) == len(fixtures.rows()) and {r.lang_pred for r in got} == {"en", "und"}
    assert all(r.held_out == (fold(r.doc_id, 5) == 0) for r in got if r.doc_id is not None)
    assert language.language_id(none).collect() == []


def test_pipeline_stage_keeps_rows_and_columns(spark, docs):
    out = toxicity.drop_toxic(docs, labels(spark).where("doc_id < 0"))
    assert out.columns == docs.columns and out.count() == docs.count()
    assert sorted(map(str, out.collect())) == sorted(map(str, docs.collect()))


def test_a_negative_length_counts_as_none(spark, labelled):
    m = labelled[1].iloc[:600]
    model = quality.train(list(m.text), list(m.quality))
    rows = spark.createDataFrame([(1, "some words here", -5), (2, "some words here", None), (3, "some words here", 15)], "doc_id long, text string, n_chars long")
    scores = {r.score for r in quality.score_quality(rows, model, meta_col="n_chars").collect()}
    assert len(scores) == 1 and 0 <= scores.pop() <= 1


def test_sampled_rows(spark):
    from rankaudit.llm.labelled import in_fold, labelled_sample

    rows = [(i, f"text {i}", "en" if i % 2 else "de") for i in range(100)] + [(5, "fünf", "de"), (5, "cinq", "fr"), (7, None, "en"), (8, "x" * 50, "en"), (None, "none", "en"), (9, "no label", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    never = in_fold("doc_id", 1, 1)
    texts, labels = labelled_sample(docs, docs, "lang", never, 1000, 40, own=True)
    want = sorted((t, lang) for i, t, lang in rows if i is not None and t and len(t) <= 40 and lang)
    assert sorted(zip(texts, labels)) == want  # rows that repeat an id keep their own languages
    texts, labels = labelled_sample(docs, docs, "lang", in_fold("doc_id", 5, 0), 20, 40, own=True)
    # at most 20: a chosen row may have no text that can be used
    assert 15 <= len(texts) <= 20 and all(fold(t.split()[1], 5) != 0 for t in texts if t.startswith("text"))
    apart = spark.createDataFrame([(1, 1), (1, 0), (2, None), (3, 1)], "doc_id long, quality int")
    texts, labels = labelled_sample(docs, apart, "quality", never, 1000, 40)
    assert sorted(zip(texts, labels)) == [("text 1", 0), ("text 1", 1), ("text 3", 1)]
