import os
import tempfile

from pyspark.sql import functions as F

from rankaudit.sources import adapters as A
from rankaudit.streaming.ingest import ingest_batch, start_corpus_ingest

SF = "/root/testdata/sf0.001"


def test_stream_ingest_idempotent(spark):
    base = tempfile.mkdtemp(prefix="ingest-", dir="/tmp")
    landed = os.path.join(base, "landed")
    corpus = os.path.join(base, "corpus")
    resp = A.landed_responses(spark, SF)
    resp.limit(300).write.json(os.path.join(landed, "b1"))
    q = start_corpus_ingest(spark, landed, corpus, checkpoint=os.path.join(base, "ck"), available_now=True)
    q.awaitTermination(120)
    # a second drop repeats every response of the first plus new ones
    resp.write.json(os.path.join(landed, "b2"))
    q = start_corpus_ingest(spark, landed, corpus, checkpoint=os.path.join(base, "ck"), available_now=True)
    q.awaitTermination(120)
    got = spark.read.parquet(corpus)
    ok = resp.where(F.col("status_code") == 200)
    assert got.count() == ok.count()
    assert got.select("id").distinct().count() == got.count()
    retry = spark.read.parquet(corpus + "_retry").select("doc_id").distinct().count()
    assert retry == resp.where(F.col("status_code") == 429).select("doc_id").distinct().count()


def test_replayed_batch_adds_nothing_and_bad_bodies_are_errors(spark):
    base = tempfile.mkdtemp(prefix="ingest-", dir="/tmp")
    dirs = {f"{k}_dir": os.path.join(base, k) for k in ("corpus", "retry", "error")}
    resp = A.landed_responses(spark, SF).limit(200).union(
        spark.createDataFrame([("bad1", 200, "<html>"), ("bad2", 200, None), ("bad3", 200, "{}")], "doc_id string, status_code int, body string")
    )
    counts = []
    for _ in range(2):
        ingest_batch(resp, 0, **dirs)
        counts.append([spark.read.parquet(dirs[d]).count() for d in sorted(dirs)])
    assert counts[0] == counts[1]
    errors = {r.doc_id for r in spark.read.parquet(dirs["error_dir"]).collect()}
    assert {"bad1", "bad2", "bad3"} <= errors
    assert spark.read.parquet(dirs["corpus_dir"]).where("id like 'bad%'").count() == 0
