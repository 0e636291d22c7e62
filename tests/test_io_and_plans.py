import os
import tempfile

import pytest

from pyspark.sql import functions as F

from rankaudit.sources import io as IO


def test_ranking_text_roundtrip_with_null(spark):
    rows = spark.createDataFrame(
        [(0, 1.0, 3, [1.5, None, 2.0]), (1, 0.0, 3, [0.0, 4.0, 1e-7])],
        "ord long, relevance double, qid long, features array<double>",
    )
    lines = [r.line for r in IO.ranking_lines(rows).orderBy("ord").collect()]
    assert lines[0] == "1.0 qid:3 0:1.5  2:2.0"
    d = tempfile.mkdtemp(prefix="rt-", dir="/tmp")
    IO.write_ranking_text(rows, os.path.join(d, "r"))
    back = IO.read_ranking_text(spark, os.path.join(d, "r")).orderBy("ord").collect()
    assert back[0].features == [1.5, 0.0, 2.0] and back[1].features == [0.0, 4.0, 1e-7]
    assert (back[0].qid, back[0].rel) == (3, 1.0)


def test_assign_ordinals(spark):
    df = spark.createDataFrame([(2, 5), (1, 9), (1, 3), (2, 1)], "qid long, doc_id long")
    got = [(r.qid, r.doc_id, r.ord) for r in IO.assign_ordinals(df).orderBy("ord").collect()]
    assert got == [(1, 3, 0), (1, 9, 1), (2, 1, 2), (2, 5, 3)]


def test_assign_ordinals_over_many_partitions(spark):
    df = spark.range(3000).selectExpr("(id * 7919) % 613 as qid", "id as doc_id").repartition(7)
    got = [(r.qid, r.doc_id) for r in IO.assign_ordinals(df).orderBy("ord").collect()]
    assert got == sorted((r.qid, r.doc_id) for r in df.collect())


def test_pair_join_is_equi_join(spark):
    from rankaudit.operators.pairs import training_pairs

    df = spark.createDataFrame([(0, 1, 1.0, [1.0]), (1, 1, 0.0, [2.0])], "ord long, qid long, rel double, features array<double>")
    plan = training_pairs(df)._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan


def test_lines_are_numbered_over_files_and_blocks(spark):
    d = tempfile.mkdtemp(prefix="nl-", dir="/tmp")
    for f in range(3):
        with open(os.path.join(d, f"part-{f}.txt"), "w") as out:
            out.writelines(f"{f}:{i}\n" for i in range(400))
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "700")
    try:
        got = [r.line for r in IO.numbered_lines(spark, d).orderBy("ord").collect()]
        ords = sorted(r.ord for r in IO.numbered_lines(spark, d).collect())
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    assert got == [f"{f}:{i}" for f in range(3) for i in range(400)] and ords == list(range(1200))


def test_ranking_text_without_feature_zero(spark):
    rows = spark.createDataFrame([(0, 1.0, 3, [None, 2.0])], "ord long, relevance double, qid long, features array<double>")
    d = tempfile.mkdtemp(prefix="rt-", dir="/tmp")
    IO.write_ranking_text(rows, os.path.join(d, "r"))
    assert IO.read_ranking_text(spark, os.path.join(d, "r"), n_features=2, zero_based=True).first().features == [0.0, 2.0]


def test_linker_with_string_ids(spark):
    d = os.path.join(tempfile.mkdtemp(prefix="ln-", dir="/tmp"), "l")
    IO.write_linker(spark.createDataFrame([(0, "a1"), (1, "b2")], "ord long, doc_id string"), d)
    assert [tuple(r) for r in IO.read_linker(spark, d, "string").orderBy("libsvm_id").collect()] == [(0, "a1"), (1, "b2")]
    with pytest.raises(Exception):
        IO.read_linker(spark, d).collect()


def test_boundary_round_trips(spark):
    from rankaudit.operators.bibliometrics import paper_authors, papers
    from rankaudit.operators.ranksvm import RankModel
    from rankaudit.sources import adapters as A

    sf = "/root/testdata/sf0.001"
    d = tempfile.mkdtemp(prefix="io-", dir="/tmp")
    bib = A.bib_corpus(spark, sf)
    records = bib.select(F.col("id").cast("string").alias("id"), "title", F.lit(None).cast("string").alias("paperAbstract"), "year", "venue", "authors", "inCitations", "outCitations")
    IO.append_corpus(records, f"{d}/c.jsonl")
    IO.append_corpus(records.limit(5), f"{d}/c.jsonl")
    back = IO.read_corpus(spark, f"{d}/c.jsonl")
    assert back.count() == bib.count() and back.where("paperAbstract = ''").count() == back.count()
    IO.write_trec_tables(papers(bib), papers(bib).select("paper_sha"), paper_authors(bib), d)
    assert IO.read_table_csv(spark, f"{d}/papers", papers(bib).schema, strict=True).count() == bib.count()
    j = A.judgements(spark, sf)
    j.select("qid", "query", F.col("documents").cast("array<struct<doc_id:string,relevance:double>>")).write.json(f"{d}/j")
    assert IO.explode_judgements(IO.read_judgements(spark, f"{d}/j")).count() == A.judged(spark, sf).count()
    A.groups(spark, sf).write.option("header", True).csv(f"{d}/groups.csv")
    assert IO.read_groups(spark, f"{d}/groups.csv").count() == A.groups(spark, sf).count()
    loaded = IO.load_inputs(spark, {"corpus": f"{d}/c.jsonl", "groups": f"{d}/groups.csv", "rows": f"{sf}/region.parquet"})
    assert {k: v.count() for k, v in IO.preview(loaded, 3).items()} == {"corpus": 3, "groups": 3, "rows": 3}
    with pytest.raises(ValueError):
        IO.load_inputs(spark, {"x": "a.txt"})
    model = RankModel([1.0, 2.0], 0.5, 3, 1e-9, 7.0, means=[0.0, 1.0], stds=[1.0, 1.0])
    IO.save_model(spark, model, f"{d}/m")
    again = IO.load_model(spark, f"{d}/m")
    assert (again.weights, again.intercept, again.means) == (model.weights, model.intercept, model.means)
    IO.save_pairs(A.feature_rows(spark, sf), f"{d}/p")
    assert IO.load_pairs(spark, f"{d}/p").count() == A.feature_rows(spark, sf).count()


def test_author_tables_on_odd_records(spark):
    from rankaudit.operators import bibliometrics as B
    from rankaudit.operators.records import paper_author_set

    schema = "id string, doc_idx int, authors array<struct<name:string,ids:array<string>>>, inCitations array<string>"
    rows = [
        ("z", 0, [("Second", ["1"]), ("None", None), ("X", ["x9"])], ["c"] * 12),
        ("a", 1, [("First", ["1"]), ("Y", ["y9"]), ("Nul", [None])], ["c"] * 2),
        ("a", 2, [("Again", ["1", "2"])], None),
    ]
    corpus = spark.createDataFrame(rows, schema)
    got = {(r.corpus_author_id, r.name): (r.num_citations, r.num_papers, r.i10, r.h_index, r.h_class) for r in B.authors_table(corpus).collect()}
    assert got == {
        (1, "Second"): (14, 3, 1, 2, "L"), (2, "Again"): (0, 1, 0, 0, "L"), (None, "X"): (12, 1, 1, 1, "L"),
        (None, "Y"): (2, 1, 0, 1, "L"), (None, "Nul"): (2, 1, 0, 1, "L"),
    }
    known = spark.createDataFrame([(1,), (2,)], "corpus_author_id long")
    assert {(r.paper_sha, r.corpus_author_id) for r in paper_author_set(corpus, known).collect()} == {("z", 1), ("a", 1), ("a", 2)}


def test_keyed_append_reads_only_its_buckets(spark):
    from rankaudit.sources.idstore import IdStore, bucket_of

    d = tempfile.mkdtemp(prefix="ids-", dir="/tmp")
    rows = spark.range(500).select(F.col("id").cast("string").alias("id"), F.lit("t").alias("title"))
    IO.append_corpus(rows.where("id < 300"), f"{d}/c", batch="one")
    IO.append_corpus(rows, f"{d}/c", batch="two")
    before = sorted(r.id for r in IO.read_corpus(spark, f"{d}/c").collect())
    for batch in ("one", "two"):  # replayed
        IO.append_corpus(rows.where("id < 300") if batch == "one" else rows, f"{d}/c", batch=batch)
    assert sorted(r.id for r in IO.read_corpus(spark, f"{d}/c").collect()) == before == sorted(str(i) for i in range(500))
    few = spark.createDataFrame([("7",), ("x",)], "id string")
    store = IdStore(spark, f"{d}/c.ids")
    missing = store.missing(few)
    assert [r.id for r in missing.collect()] == ["x"]
    touched = {r[0] for r in few.select(bucket_of("id")).collect()}
    read = {int(f.split("bucket=")[1].split("/")[0]) for f in missing.inputFiles() if "bucket=" in f}
    plan = missing._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [bucket" in plan.replace("isnotnull(bucket", "bucket") and len(touched) == 2 and read
