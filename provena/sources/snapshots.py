"""Portable snapshots of current signals: JSON out, versioned and idempotent in; report as Markdown."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from provena.operators import versions

FORMAT = 1


def export(signals: DataFrame, path: str) -> None:
    """Current signals(registry_code, observed_at, signal) as JSON Lines with a format number."""
    signals.select(F.lit(FORMAT).alias("format"), "registry_code", F.date_format("observed_at", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("observed_at"), "signal").write.mode("errorifexists").json(path)


def load(spark: SparkSession, path: str) -> DataFrame:
    rows = spark.read.schema("format int, registry_code string, observed_at string, signal string").json(path)
    other = rows.where(F.coalesce(F.col("format") != FORMAT, F.lit(True))).limit(1).count()
    if other:
        raise ValueError("a snapshot of another format")
    return rows.select("registry_code", F.to_timestamp("observed_at").alias("observed_at"), "signal")


def import_signals(stored: DataFrame, incoming: DataFrame, companies: DataFrame) -> DataFrame:
    """Outcome per company of companies(company_id, registry_code); codes that are not known are reported as unknown."""
    matched = incoming.join(companies.select("company_id", "registry_code"), "registry_code", "left")
    known = matched.where("company_id is not null")
    merged = versions.merge(stored, known, ["company_id"], "signal", "observed_at")
    unknown = matched.where("company_id is null").select("company_id", F.lit("unknown_code").alias("outcome"), "signal", "observed_at", F.lit(None).cast("timestamp").alias("closes_old_at"))
    return merged.unionByName(unknown)


def to_markdown(report: DataFrame, limit: int = 1000) -> str:
    """A small report table as Markdown; more than `limit` rows is an error, not a cut."""
    rows = report.limit(limit + 1).collect()
    if len(rows) > limit:
        raise ValueError(f"a report of over {limit} rows is no report")
    lines = ["| " + " | ".join(report.columns) + " |", "|" + " --- |" * len(report.columns)]
    return "\n".join(lines + ["| " + " | ".join("" if v is None else str(v) for v in r) + " |" for r in rows])
