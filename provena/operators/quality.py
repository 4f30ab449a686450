"""Lists, pages and data-quality reports about companies and their facts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from provena.functions import numbers as m


def company_list(
    companies: DataFrame, countries: list[str] | None = None, region: str | None = None, min_employees: int | None = None, max_employees: int | None = None,
    status: str | None = None, qualifications: list[str] | None = None, search: str | None = None, with_source: DataFrame | None = None,
) -> DataFrame:
    """Companies that are not merged away and meet every given condition; unknown headcount meets no bound."""
    df = companies.where("merged_into_id is null")
    df = df.where(F.col("country").isin(countries)) if countries else df
    df = df.where(F.col("region") == region) if region else df
    df = df.where(F.col("employee_min") >= min_employees) if min_employees else df
    df = df.where(F.col("employee_min") <= max_employees) if max_employees is not None else df
    df = df.where(F.col("review_status") == status) if status else df
    df = df.where(m.qualification(F.col("employee_min"), F.col("employee_max")).isin(qualifications)) if qualifications else df
    if search:
        hit = F.lower("legal_name").contains(search.lower())
        df = df.where(hit | F.lower("trading_name").contains(search.lower()) if "trading_name" in df.columns else hit)
    return df.join(with_source.select("company_id"), "company_id", "left_semi") if with_source is not None else df


def page(df: DataFrame, key: str, descending: bool, offset: int, limit: int, name: str = "legal_name", row_id: str = "company_id") -> DataFrame:
    order = F.desc_nulls_last(key) if descending else F.asc_nulls_last(key)
    return df.orderBy(order, name, row_id).offset(offset).limit(limit)


def domain_counts(companies: DataFrame) -> DataFrame:
    return companies.where("domain is not null").groupBy("domain").agg(F.count_distinct("company_id").alias("n_companies"))


def active_fields(companies: DataFrame, facts: DataFrame, fields: list[str]) -> DataFrame:
    """(company_id, have): which of the fields each company has; empty where it has none."""
    have = facts.where(F.col("field_name").isin(fields)).groupBy("company_id").agg(F.collect_set("field_name").alias("have"))
    return companies.join(have, "company_id", "left").withColumn("have", F.coalesce("have", F.array().cast("array<string>")))


def completeness(companies: DataFrame, facts: DataFrame, fields: list[str]) -> DataFrame:
    share = F.round(100 * F.size("have") / len(fields)).cast("bigint")
    return active_fields(companies, facts, fields).select("company_id", share.alias("completeness"))


def missing_fields(companies: DataFrame, facts: DataFrame, fields: list[str], examples: int = 25) -> DataFrame:
    """(field_name, n, first_companies): companies that lack a field, and the first of them by id."""
    lacking = active_fields(companies, facts, fields).select("company_id", F.explode(F.array_except(F.array(*map(F.lit, fields)), "have")).alias("field_name"))
    counts = lacking.groupBy("field_name").agg(F.count("*").alias("n"))
    rank = F.row_number().over(Window.partitionBy("field_name").orderBy("company_id"))
    first = lacking.withColumn("k", rank).where(F.col("k") <= examples).groupBy("field_name").agg(F.sort_array(F.collect_list("company_id")).alias("first_companies"))
    return counts.join(first, "field_name")


def totals(companies: DataFrame, now: Column, stale_days: int = 365) -> DataFrame:
    fresh = m.freshness(F.col("verified_on").cast("timestamp"), now, stale=stale_days)
    kind = m.qualification(F.col("employee_min"), F.col("employee_max"))
    return companies.where("merged_into_id is null").agg(
        F.count("*").alias("n"), F.count_if(fresh.isin("stale", "unknown")).alias("stale"), F.count_if(kind == "qualified").alias("qualified"),
        F.count_if(kind == "unknown_headcount").alias("unknown_headcount"),
    )


def conflicts(current: DataFrame) -> DataFrame:
    """Fields of a company whose current facts disagree, with all values."""
    found = current.groupBy("company_id", "field_name").agg(
        F.count_distinct("value").alias("n_values"), F.transform(F.sort_array(F.collect_list(F.struct("value", "source_id"))), lambda x: x["value"]).alias("all_values")
    )
    return found.where("n_values > 1")


def top_warnings(records: DataFrame, limit: int = 15) -> DataFrame:
    """Most frequent warnings of records(warnings array), each cut at its first quoted value."""
    text = records.select(F.explode("warnings").alias("w")).select(F.trim(F.substring_index("w", "'", 1)).alias("message"))
    return text.groupBy("message").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "message").limit(limit)
