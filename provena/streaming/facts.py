"""Observations as a stream: each micro-batch is merged into the ledger of facts, exactly once in effect."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from provena.operators import ledger
from provena.sources.versioned import Store

FACTS = "company_id long, source_id string, field_name string, value string, observed_at timestamp"
KEYS = ["company_id", "source_id", "field_name"]
BUCKETS = 64
#: After so many micro-batches crowded buckets are put together and parts that nobody reads are deleted.
COMPACT_EVERY = 16


def current_facts(spark: SparkSession, folder: str) -> DataFrame:
    """Open facts of the newest committed version, with the time they were last seen."""
    store = Store(spark, folder)
    version = store.latest()
    if "facts" not in version.tables:
        return spark.createDataFrame([], FACTS)
    return ledger.current(store, "facts", KEYS, ["value"], version).select(*KEYS, "value", F.col("last_seen").alias("observed_at"))


def merge_batch(batch: DataFrame, batch_id: int, folder: str) -> bool:
    """Append what a batch changes to the facts, reading the buckets of its companies only; a batch that is committed already is not applied again.

    Of several observations of a fact within the batch the latest counts, of equal times the least value.
    """
    store, run = Store(batch.sparkSession, folder), f"batch-{batch_id}"
    if run in store.latest().runs:
        return False
    order = F.struct((-F.unix_micros("observed_at")).alias("newest"), "value")
    rows = batch.select(*KEYS, "value", "observed_at", order.alias("row"))
    ledger.load(store, run, {"facts": ledger.Batch(rows, KEYS, ["value"], buckets=BUCKETS, by=["company_id"])})
    if batch_id % COMPACT_EVERY == COMPACT_EVERY - 1:
        ledger.compact(store, f"compact-{batch_id}", "facts", KEYS, ["value"])
        store.vacuum(keep=2)
    return True


def start(observations: DataFrame, folder: str, checkpoint: str, late: str = "7 days") -> StreamingQuery:
    """Run over all available observations of a streaming DataFrame; repeats within the watermark count once."""
    once = observations.withWatermark("observed_at", late).dropDuplicatesWithinWatermark([*KEYS, "value", "observed_at"])
    return once.writeStream.foreachBatch(lambda df, k: merge_batch(df, k, folder)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def recent_counts(observations: DataFrame, width: str = "540 days", step: str = "30 days", late: str = "7 days") -> DataFrame:
    """Observations per field in sliding windows; works on a batch or a stream."""
    return observations.withWatermark("observed_at", late).groupBy(F.window("observed_at", width, step), "field_name").agg(F.count("*").alias("n"))
