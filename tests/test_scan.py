import random

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from rankaudit.operators import measures as M
from rankaudit.operators import ranking as RK
from rankaudit.operators import scan


@pytest.fixture(scope="module")
def lists(spark):
    rnd = random.Random(1)
    rows = [(i, rnd.choice([1, 1, 1, 2, 3, None]), rnd.choice([None, float("nan"), 0.0, -0.0, 1.5, 1.5, rnd.gauss(0, 1), rnd.gauss(0, 1)]), float(rnd.randrange(3))) for i in range(3000)]
    return spark.createDataFrame(rows, "ord long, qid long, score double, rel double").repartition(5)


@pytest.mark.parametrize("descending", [True, False])
@pytest.mark.parametrize("long,cuts", [(100, 7), (1200, 255), (10**6, 3)])
def test_numbers_equal_the_window(lists, monkeypatch, descending, long, cuts):
    for name, v in (("LONG", long), ("SPAN", 64), ("CUTS", cuts)):
        monkeypatch.setattr(scan, name, v)
    order = [F.col("score").desc() if descending else F.col("score").asc(), F.col("ord").asc()]
    want = lists.withColumn("rank", F.row_number().over(Window.partitionBy("qid").orderBy(*order)))
    got = scan.number_rows(lists, "qid", "score", "ord", "rank", descending=descending)
    assert got.columns == want.columns
    pick = lambda df: sorted((r["ord"], r["rank"]) for r in df.collect())
    assert pick(got) == pick(want)


def test_measures_in_blocks(lists, monkeypatch):
    ranked = lists.withColumn("rank", F.row_number().over(Window.partitionBy("qid").orderBy("ord"))).where("qid IS NOT NULL").withColumn("doc_id", F.col("ord"))
    def all_of():
        return [
            sorted(tuple(round(v, 9) if v is not None else -1 for v in r) for r in df.collect())
            for df in (M.exposure(ranked, gamma=0.99, stop_prob=0.01).select("ord", "exposure"), M.ndcg_per_query(ranked), M.average_precision(ranked), M.relevance_utility(M.exposure(ranked)))
        ]
    want = all_of()
    for name, v in (("LONG", 50), ("SPAN", 32), ("CUTS", 15)):
        monkeypatch.setattr(scan, name, v)
    assert all_of() == want


def test_a_long_list_takes_several_tasks(spark, monkeypatch):
    monkeypatch.setattr(scan, "LONG", 20_000)
    n = 100_000
    rows = spark.range(n).select(F.col("id").alias("ord"), F.lit(1).cast("long").alias("qid"), F.array(F.rand(5), (F.col("id") % 3).cast("double")).alias("features"))
    ranked = RK.rank_documents(rows, [1.0, 0.0])
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        spread = ranked.select("rank", F.spark_partition_id().alias("p")).groupBy("p").count().collect()
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    assert len(spread) > 1 and max(r["count"] for r in spread) < n and sum(r["count"] for r in spread) == n
    assert ranked.agg(F.max("rank"), F.count_distinct("rank")).first() == (n, n)
    wrong = ranked.alias("a").join(ranked.alias("b"), F.expr("a.rank + 1 = b.rank")).where("a.score < b.score")
    assert wrong.isEmpty()
    tied = RK.rank_documents(rows, [0.0, 1.0])  # a third of the list ties
    wrong = tied.alias("a").join(tied.alias("b"), F.expr("a.rank + 1 = b.rank")).where("a.score < b.score OR (a.score = b.score AND a.ord > b.ord)")
    assert wrong.isEmpty()
