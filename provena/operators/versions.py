"""Versioned facts: interval histories, merges of a batch, idempotent snapshots, retention, contacts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def current(df: DataFrame, keys: list[str], *order: Column) -> DataFrame:
    """The first row of each key by the given order."""
    return df.withColumn("_k", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("_k = 1").drop("_k")


def history(observed: DataFrame, keys: list[str], value: str, at: str, tie: str) -> DataFrame:
    """Intervals (valid_from, valid_to, last_seen) of unchanged values; a value that returns is a new version."""
    w = Window.partitionBy(*keys).orderBy(at, tie)
    changed = F.coalesce(~F.col(value).eqNullSafe(F.lag(value).over(w)) | (F.row_number().over(w) == 1), F.lit(True))
    numbered = observed.withColumn("_v", F.sum(changed.cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    spans = numbered.groupBy(*keys, "_v").agg(F.min(at).alias("valid_from"), F.max(at).alias("last_seen"), F.first(value).alias(value))
    after = F.lead("valid_from").over(Window.partitionBy(*keys).orderBy("_v"))
    return spans.withColumn("valid_to", after).withColumnRenamed("_v", "version")


def versions_once(observed: DataFrame, keys: list[str], value: str, at: str) -> DataFrame:
    """Versions where a value seen at any time before is unchanged, so a return to it adds nothing."""
    firsts = observed.groupBy(*keys, value).agg(F.min(at).alias("valid_from"))
    return firsts.withColumn("valid_to", F.lead("valid_from").over(Window.partitionBy(*keys).orderBy("valid_from", value)))


def merge(stored: DataFrame, incoming: DataFrame, keys: list[str], value: str, at: str) -> DataFrame:
    """Outcome of a batch against the open facts, one row a key.

    unchanged: equal value, the later time counts; changed: the old one closes when the new one opens;
    new; kept: not in the batch, stays open.
    """
    a = stored.select(*keys, F.col(value).alias("old"), F.col(at).alias("old_at"), F.lit(True).alias("_a"))
    b = incoming.select(*keys, F.col(value).alias("new"), F.col(at).alias("new_at"), F.lit(True).alias("_b"))
    both = a.join(b, keys, "full_outer")
    outcome = (
        F.when(F.col("_a").isNull(), "new").when(F.col("_b").isNull(), "kept").when(F.col("old").eqNullSafe(F.col("new")), "unchanged").otherwise("changed")
    )
    return both.select(
        *keys,
        outcome.alias("outcome"),
        F.when(outcome == "kept", F.col("old")).otherwise(F.col("new")).alias(value),
        F.when(outcome == "unchanged", F.greatest("old_at", "new_at")).when(outcome == "kept", F.col("old_at")).otherwise(F.col("new_at")).alias(at),
        F.when(outcome == "changed", F.col("new_at")).alias("closes_old_at"),
    )


def add_snapshots(stored: DataFrame, incoming: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of incoming that are not stored yet; rows that repeat within the batch count once."""
    return incoming.dropDuplicates(keys).join(stored.select(*keys), keys, "left_anti")


def set_versions(rows: DataFrame, key: str, *columns: str) -> DataFrame:
    """(key, n, set_hash): a hash of the key's whole ordered set of rows."""
    packed = F.sort_array(F.collect_list(F.to_json(F.struct(*columns))))
    return rows.groupBy(key).agg(F.count("*").alias("n"), F.sha2(F.array_join(packed, "\n"), 256).alias("set_hash"))


def expire(snapshots: DataFrame, payload: str, due: Column) -> DataFrame:
    """Payloads of due snapshots are dropped; hash and metadata stay."""
    return snapshots.withColumn("expired", F.coalesce(due, F.lit(False))).withColumn(payload, F.when(~F.col("expired"), F.col(payload)))


def upsert(stored: DataFrame, incoming: DataFrame, keys: list[str], values: list[str], at: str) -> DataFrame:
    """Values that the batch gives overwrite; those it leaves null stay; the later time counts."""
    a = stored.select(*keys, *[F.col(v).alias(f"_{v}") for v in values], F.col(at).alias("_at"))
    both = a.join(incoming.select(*keys, *values, at), keys, "full_outer")
    return both.select(*keys, *[F.coalesce(v, f"_{v}").alias(v) for v in values], F.greatest(at, "_at").alias(at))
