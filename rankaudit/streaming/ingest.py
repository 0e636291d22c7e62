"""Incremental corpus ingest as a Structured Streaming job.

The reference appends newly fetched judged documents to its jsonl corpus and
skips ids already present.  Here landed API responses arrive as files
(``doc_id, status_code, body`` json lines, written by any fetcher); each
micro-batch is routed (B6), reshaped (B5) and appended (A10) after a lookup of its
ids in the id store (B3), which reads only the buckets that they fall into; retry
and error responses go to their own sinks for the fetcher to pick up.  Each batch
has a folder of its own in all three, which a replay overwrites, so a batch
replayed after a failure adds nothing.  Progress is tracked in a checkpoint
under the cluster's shared checkpoint directory.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import shared_dir
from ..sources.idstore import IdStore
from ..sources.ingest import reshape_api_records, route_responses
from ..sources.schemas import CORPUS, LANDED


def ingest_batch(batch: DataFrame, batch_id: int, *, corpus_dir: str, retry_dir: str, error_dir: str, citations_to: str = "in") -> None:
    spark, name = batch.sparkSession, f"stream-{batch_id}"
    store = IdStore(spark, f"{corpus_dir.rstrip('/')}.ids")
    routed = route_responses(batch).persist()
    try:
        new = reshape_api_records(routed.where(F.col("route") == "corpus"), citations_to=citations_to)
        new = store.missing(new.dropDuplicates(["id"]), "id", name)
        folder = f"{corpus_dir.rstrip('/')}/batch_id={batch_id}"
        new.write.mode("overwrite").parquet(folder)
        store.add(spark.read.schema(CORPUS).parquet(folder), "id", name)
        for route, to in (("retry", retry_dir), ("error", error_dir)):
            routed.where(F.col("route") == route).drop("route").write.mode("overwrite").parquet(f"{to.rstrip('/')}/batch_id={batch_id}")
    finally:
        routed.unpersist()


def start_corpus_ingest(
    spark: SparkSession,
    landed_dir: str,
    corpus_dir: str,
    *,
    retry_dir: str | None = None,
    error_dir: str | None = None,
    checkpoint: str | None = None,
    available_now: bool = False,
    processing_time: str = "30 seconds",
    max_files_per_trigger: int = 1000,
    citations_to: str = "in",
):
    """Start the stream; returns the ``StreamingQuery``."""
    retry_dir = retry_dir or corpus_dir.rstrip("/") + "_retry"
    error_dir = error_dir or corpus_dir.rstrip("/") + "_errors"
    checkpoint = checkpoint or shared_dir(spark, "rankaudit-ingest-checkpoint")
    stream = (
        spark.readStream.schema(LANDED)
        .option("maxFilesPerTrigger", max_files_per_trigger)
        .option("recursiveFileLookup", "true")
        .json(landed_dir)
    )
    w = stream.writeStream.foreachBatch(
        lambda df, bid: ingest_batch(df, bid, corpus_dir=corpus_dir, retry_dir=retry_dir, error_dir=error_dir, citations_to=citations_to)
    ).option("checkpointLocation", checkpoint)
    w = w.trigger(availableNow=True) if available_now else w.trigger(processingTime=processing_time)
    return w.start()
