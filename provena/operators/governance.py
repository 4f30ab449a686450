"""Which sources may run and supply what: gates, allowed fields, retention, suppression, registry sync."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


INTERNAL = "internal"


def ingestion_gate(
    sources: DataFrame, policy: dict[str, tuple[list[str], list[str]]], connectors: list[str], modes: list[str], active: list[str] | None = None, live: bool | None = None,
    internal_modes: list[str] | None = None,
) -> DataFrame:
    """sources with `reasons`, why ingestion is denied; empty means allowed.

    policy: region -> (countries, modes). active: countries of this deployment. live: whether network runs are enabled. Where
    internal_modes are given, sources of the internal region may cover the countries of all regions, in these modes.
    """
    if internal_modes is not None:
        policy = policy | {INTERNAL: (sorted({c for countries, _ in policy.values() for c in countries}), internal_modes)}
    region, mode = F.col("region"), F.col("source_mode")

    def within(k: int) -> Column:
        return reduce(lambda c, r: c.when(region == r, F.array(*map(F.lit, policy[r][k]))), policy, F.when(F.lit(False), F.array().cast("array<string>")))

    outside = F.array_except("countries", within(0))
    not_active = F.array_except("countries", F.array(*map(F.lit, active))) if active is not None else F.array().cast("array<string>")
    ok = lambda c: F.coalesce(c, F.lit(False))
    known = ok(region.isin(list(policy)))
    reasons = F.array_compact(
        F.array(
            F.when(~ok(F.col("permission_status") == "approved"), F.concat(F.lit("permission status is "), F.coalesce("permission_status", F.lit("?")), F.lit(", not approved"))),
            F.when(~ok(F.col("enabled")), F.lit("connector is disabled")),
            F.when(~ok(F.col("connector_type").isin(connectors)), F.concat(F.lit("connector type "), F.coalesce("connector_type", F.lit("?")), F.lit(" cannot run ingestion jobs"))),
            F.when(~ok(mode.isin(modes)), F.concat(F.lit("mode "), F.coalesce(mode, F.lit("?")), F.lit(" is not an approved mode"))),
            F.when(~known, F.concat(F.lit("region "), F.coalesce(region, F.lit("?")), F.lit(" has no policy"))),
            F.when(known & ~ok(F.array_contains(within(1), mode)), F.concat(F.lit("mode "), mode, F.lit(" is not allowed in region "), region)),
            F.when(known & (F.size(outside) > 0), F.concat(F.lit("coverage outside region "), region)),
            F.when(known & (F.size(not_active) > 0), F.concat(F.lit("countries not active in this deployment: "), F.array_join(F.sort_array(not_active), ", "))),
            F.when(F.lit(live is False), F.lit("live network connectors are disabled")),
        )
    )
    return sources.withColumn("reasons", reasons)


def gate_runs(asked: DataFrame, gated: DataFrame) -> DataFrame:
    """asked(source_id) with the reasons of gated sources; a source that is not registered is denied."""
    known = asked.join(gated.select("source_id", "reasons"), "source_id", "left")
    return known.withColumn("reasons", F.coalesce("reasons", F.array(F.lit("source is not registered"))))


def enable_gate(sources: DataFrame) -> DataFrame:
    reasons = F.array_compact(
        F.array(
            F.when(~F.coalesce(F.col("permission_status") == "approved", F.lit(False)), F.lit("cannot enable: not approved")),
            F.when(F.coalesce(F.size("allowed_fields"), F.lit(0)) < 1, F.lit("cannot enable: no allowed fields")),
        )
    )
    return sources.withColumn("enable_reasons", reasons)


def enforce_allowed(rows: DataFrame, fields: list[str], allowed: str) -> DataFrame:
    """Blank what a source may not supply, with a warning per field that had a value."""
    may = lambda f: F.coalesce(F.array_contains(allowed, f), F.lit(False))
    warn = [F.when(~may(f) & F.col(f).isNotNull(), F.lit(f"field {f} is not allowed for this source and was dropped")) for f in fields]
    rows = rows.withColumn("warnings", F.array_compact(F.array(*warn)))
    return rows.withColumns({f: F.when(may(f), F.col(f)) for f in fields})


def due_snapshots(snapshots: DataFrame, now: Column, register: str) -> DataFrame:
    """Snapshots to expire; company rows of the register stay."""
    spared = (F.col("source_id") == register) & F.col("source_key").startswith("company:")
    return snapshots.where((F.col("expires_at") <= now) & ~F.coalesce(spared, F.lit(False)))


def not_suppressed(contacts: DataFrame, tombstones: DataFrame) -> DataFrame:
    """Contacts whose identity and email hashes are both not among tombstones(hash)."""
    gone = tombstones.select("hash").distinct()
    kept = contacts.join(gone.withColumnRenamed("hash", "identity_hash"), "identity_hash", "left_anti")
    return kept.join(gone.withColumnRenamed("hash", "email_hash"), "email_hash", "left_anti")


def sync_sources(catalog: DataFrame, registry: DataFrame) -> DataFrame:
    """Catalog against registry: unlisted sources are disabled, a catalog downgrade wins, enabling is never automatic."""
    c = catalog.select("source_id", F.col("permission_status").alias("listed"))
    r = registry.select("source_id", F.col("permission_status").alias("stored"), "enabled", F.lit(True).alias("_r"))
    both = c.join(r, "source_id", "full_outer")
    status = F.when(F.col("listed").isNull(), F.col("stored")).when(F.col("stored").isNull() | (F.col("listed") != "approved"), F.col("listed")).otherwise(F.col("stored"))
    enabled = F.coalesce(F.col("enabled"), F.lit(False)) & F.col("listed").isNotNull() & (status == "approved")
    return both.select("source_id", status.alias("permission_status"), enabled.alias("enabled"), F.when(F.col("_r").isNull(), "added").when(F.col("listed").isNull(), "unlisted").otherwise("kept").alias("outcome"))
