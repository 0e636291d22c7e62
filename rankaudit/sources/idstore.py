"""Which ids a corpus has.

Ids lie in ``BUCKETS`` folders by their hash, with the batch that brought them.  A lookup
reads the folders that its own ids fall into and no others, so a small batch costs a few
folders, however large the corpus.  Writing a batch again is harmless: its ids are there
already, and its own lookups leave out what it brought itself.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

BUCKETS = 128
_SCHEMA = "id string, batch string, bucket int"


def bucket_of(c: str | Column) -> Column:
    return F.pmod(F.xxhash64(F.col(c) if isinstance(c, str) else c), F.lit(BUCKETS)).cast("int")


def folder_exists(spark: SparkSession, path: str) -> bool:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)


class IdStore:
    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def ids(self, buckets: list[int] | None = None, without_batch: str | None = None) -> DataFrame:
        """``id`` of the store, of some buckets only, without those that a batch brought."""
        if not folder_exists(self.spark, self.path):
            return self.spark.createDataFrame([], "id string")
        found = self.spark.read.schema(_SCHEMA).parquet(self.path)
        if buckets is not None:
            found = found.where(F.col("bucket").isin(buckets))
        if without_batch is not None:
            found = found.where(F.col("batch") != without_batch)
        return found.select("id")

    def missing(self, rows: DataFrame, id_col: str = "id", batch: str | None = None) -> DataFrame:
        """The rows whose id the store does not have (from another batch than ``batch``)."""
        key = F.col(id_col).cast("string")
        touched = [r[0] for r in rows.select(bucket_of(key)).distinct().collect()]  # BUCKETS numbers at most
        known = self.ids(touched, batch).select(F.col("id").alias("_known"))
        return rows.join(known, key == F.col("_known"), "left_anti")

    def add(self, ids: DataFrame, id_col: str, batch: str) -> None:
        rows = ids.select(F.col(id_col).cast("string").alias("id"), F.lit(batch).alias("batch")).distinct()
        rows.withColumn("bucket", bucket_of("id")).repartition("bucket").write.mode("append").partitionBy("bucket").parquet(self.path)
