import os

from pyspark.sql import functions as F

from rankaudit.llm import line_dedup, topk
from rankaudit.llm.store import drop_written, written
from rankaudit.session import shared_dir


def tables(spark):
    return {n for n in os.listdir(shared_dir(spark, "").removeprefix("file:")) if n.startswith("llm-")}


def kinds(names):
    return {n.removeprefix("llm-").rsplit("-", 1)[0] for n in names}


def test_a_dropped_table_is_gone(spark):
    before = tables(spark)
    a, b = written(spark.range(10), "kept"), written(spark.range(0), "dropped")
    c = written(a.where("id > 4"), "dropped")
    assert c.count() == 5
    drop_written(b, c)
    assert kinds(tables(spark) - before) == {"kept"} and a.count() == 10


def test_operators_leave_only_what_their_result_reads(spark, docs):
    before = tables(spark)
    assert line_dedup.line_digests(docs).count() > 0
    assert not kinds(tables(spark) - before) & {"line-pairs", "line-places", "line-sets"}
    vectors = spark.range(300).select(F.col("id").alias("vec_id"), F.array(F.sin("id"), F.cos("id")).alias("embedding"))
    assert topk.exact_top_k(vectors, F.col("id") % 50 == 0).count() == 30
    left = [n for n in tables(spark) - before if kinds([n]) & {"pivot-keys", "probes", "top-hits"}]
    assert kinds(left) == {"top-hits"} and len(left) == 1
