"""Span files as a stream: each micro-batch keeps its spans, then renews the traces that it touched.

A trace may grow until its last span, and a parent may come late, so nothing is appended to a finished
result: a touched trace is resolved again from all its spans. The store is split by a hash of the trace, and
only the parts that a batch touched are read again.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from causeway.schema import TraceSet
from causeway.sources import spans


#: Parts of the store.
BUCKETS = 256


def follow(spark: SparkSession, source: str, store: str, checkpoint: str, renew, **trigger):
    """Starts the query. source: folder of span documents; store: folder for decoded spans (by batch and bucket of traces; a repeated batch
    replaces itself); renew(traces: TraceSet, batch_id): what to do with the touched traces. A span id that comes twice is an error, as in any document."""
    texts = spark.readStream.schema("value string").option("wholetext", "true").text(source)

    def batch(new: DataFrame, batch_id: int) -> None:
        decoded = spans.decode(spans.documents(new)).withColumn("bucket", F.pmod(F.xxhash64("trace_id"), F.lit(BUCKETS)).cast("int"))
        path = f"{store}/batch={batch_id}"
        decoded.repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(path)
        own = spark.read.option("basePath", store).schema(f"{spans.DECODED}, batch bigint, bucket int").parquet(path)
        buckets = [r.bucket for r in own.select("bucket").distinct().collect()]  # BUCKETS at most
        if not buckets:
            return
        every = spark.read.schema(own.schema).parquet(store).where(F.col("bucket").isin(buckets))
        whole = every.join(own.select("trace_id").distinct(), "trace_id", "left_semi").drop("batch", "bucket")
        renew(spans.ingest(whole), batch_id)

    return texts.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def failures_per_trace(ts: TraceSet) -> DataFrame:
    """trace_id, n_failed: a small renewing aggregate for ``renew``."""
    return ts.steps.groupBy("trace_id").agg(F.count_if(F.col("status") == "error").alias("n_failed"))
