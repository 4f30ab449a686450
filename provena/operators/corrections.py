"""Manual corrections, erasure and the company view that facts add up to."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from provena.operators import confidence, versions

CORRECTABLE = ["legal_name", "trading_name", "city", "sector", "description", "employees", "website", "ownership_type"]


def accepted(corrections: DataFrame, allowed: list[str] | None = None) -> DataFrame:
    """corrections with `problem` where the field may not be corrected or the value is blank."""
    blank = F.coalesce(F.trim(F.col("value").cast("string")) == "", F.lit(True))
    problem = F.when(~F.col("field_name").isin(allowed or CORRECTABLE), F.lit("field cannot be corrected")).when(blank, F.lit("empty value"))
    return corrections.withColumn("problem", problem)


def apply(facts: DataFrame, corrections: DataFrame) -> DataFrame:
    """facts with the newest correction of each (company_id, field_name) added, older ones closed, source facts marked.

    facts: company_id, field_name, value, observed_at, is_correction, valid_to, review_status.
    """
    keys = ["company_id", "field_name"]
    newest = versions.current(corrections, keys, F.desc("observed_at"), F.col("value")).select(*keys, "value", "observed_at")
    mark = newest.select(*keys, F.col("observed_at").alias("_at"))
    old = facts.join(mark, keys, "left")
    hit, open_ = F.col("_at").isNotNull(), F.col("valid_to").isNull()
    old = old.withColumn("valid_to", F.when(hit & open_ & F.col("is_correction"), F.col("_at")).otherwise(F.col("valid_to")))
    old = old.withColumn("review_status", F.when(hit & open_ & ~F.col("is_correction"), "corrected").otherwise(F.col("review_status"))).drop("_at")
    added = newest.withColumns({"is_correction": F.lit(True), "valid_to": F.lit(None).cast("timestamp"), "review_status": F.lit("accepted")})
    return old.unionByName(added, allowMissingColumns=True)


def erase(contacts: DataFrame, hashes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(contacts left, tombstones) after erasing the contacts whose identity hash is listed."""
    gone = contacts.join(hashes.select("identity_hash").distinct(), "identity_hash", "left_semi")
    tombs = gone.select(F.explode(F.array_compact(F.array("identity_hash", "email_hash"))).alias("hash")).distinct()
    return contacts.join(hashes.select("identity_hash").distinct(), "identity_hash", "left_anti"), tombs


def redact(text: Column, values: Column) -> Column:
    """text with every literal value of an array replaced."""
    return F.aggregate(F.coalesce(values, F.array().cast("array<string>")), text, lambda acc, v: F.when(v != "", F.replace(acc, v, F.lit("[erased]"))).otherwise(acc))


def company_view(evidence: DataFrame, now: Column, fields: list[str]) -> DataFrame:
    """One row a company: per field its value and status."""
    resolved = confidence.resolve(evidence, now)
    columns = [c for f in fields for c in (F.max(F.when(F.col("field_name") == f, F.col("lo"))).alias(f), F.max(F.when(F.col("field_name") == f, F.col("status"))).alias(f"{f}_status"))]
    return resolved.groupBy("company_id").agg(*columns, F.count_if(F.col("status") == "conflicting").alias("n_conflicts"), F.count_if(F.col("status") == "multi-source").alias("n_multi_source"))
