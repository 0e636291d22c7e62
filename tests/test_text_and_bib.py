from pyspark.sql import functions as F

from rankaudit.functions.text import int_value, tokens
from rankaudit.operators import bibliometrics as BIB
from rankaudit.sources.schemas import CORPUS


def test_tokenizer_edge_cases(spark):
    df = spark.createDataFrame([("A x_1 U.S. state-of-the-art café 孝之",), ("",), (None,)], "t string")
    out = [r[0] for r in df.select(tokens("t")).collect()]
    assert out[0] == ["x_1", "state", "of", "the", "art", "café", "孝之"]
    assert out[1] == [] and out[2] == []


def test_int_value(spark):
    df = spark.createDataFrame([(" 12 ",), ("x",), ("1.5",), ("-3",), (None,)], "s string")
    assert [r[0] for r in df.select(int_value("s")).collect()] == [12, None, None, -3, None]
    d = spark.createDataFrame([(2.9,), (float("nan"),)], "x double")
    assert [r[0] for r in d.select(int_value("x", "double")).collect()] == [2, None]


def _corpus(spark, rows):
    base = {f.name: None for f in CORPUS.fields}
    recs = []
    for r in rows:
        x = dict(base)
        x.update(r)
        recs.append(tuple(x[f.name] for f in CORPUS.fields))
    return spark.createDataFrame(recs, CORPUS)


def test_h_index_i10_class(spark):
    cites = [12, 10, 3, 3, 0]
    rows = [
        {"id": f"p{k}", "title": "t", "year": 2000, "venue": "v", "authors": [{"name": "A", "ids": ["1"]}],
         "inCitations": [str(i) for i in range(c)], "outCitations": []}
        for k, c in enumerate(cites)
    ]
    a = BIB.authors_table(_corpus(spark, rows)).collect()
    assert len(a) == 1
    r = a[0]
    assert (r.h_index, r.i10, r.h_class, r.num_papers, r.num_citations) == (3, 2, "L", 5, 28)


def test_h_index_matches_definition(spark):
    import random

    random.seed(1)
    links = [(a, random.randint(0, 30)) for a in range(20) for _ in range(random.randint(1, 25))]
    df = spark.createDataFrame(links, "author long, c int")
    got = {r[0]: r[1] for r in BIB.h_index_from(df, "author", "c").collect()}
    for a in range(20):
        cs = sorted((c for x, c in links if x == a), reverse=True)
        h = max([i for i in range(1, len(cs) + 1) if cs[i - 1] >= i], default=0)
        assert got[a] == h


def test_links_repeated_empty_null_ids(spark):
    rows = [
        {"id": "p1", "authors": [{"name": "X", "ids": ["7", "7"]}], "inCitations": ["a"], "outCitations": []},
        {"id": "p2", "authors": [{"name": "Y", "ids": []}, {"name": "Z", "ids": [None]}], "inCitations": [], "outCitations": []},
    ]
    c = _corpus(spark, rows)
    links = BIB.paper_authors(c).orderBy("paper_sha", "position").collect()
    assert [(r.paper_sha, r.corpus_author_id, r.position) for r in links] == [("p1", 7, 1), ("p1", 7, 1), ("p2", None, 2)]
    prof = {r.corpus_author_id: r for r in BIB.author_profile(c).collect()}
    assert prof[7].num_papers == 2 and prof[7].name == "X"


def test_paper_author_set_ragged(spark):
    from rankaudit.operators.records import paper_author_set

    rows = [{"id": "p1", "authors": [{"name": "a", "ids": ["1"]}, {"name": "b", "ids": ["2", "3"]}]}]
    c = _corpus(spark, rows)
    authors = spark.createDataFrame([(1,), (2,), (3,)], "corpus_author_id long")
    keep = sorted(r.corpus_author_id for r in paper_author_set(c, authors).collect())
    drop = paper_author_set(c, authors, ragged_ids="drop").count()
    assert keep == [1, 2, 3] and drop == 0
