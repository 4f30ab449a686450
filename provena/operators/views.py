"""Lists and small joins over companies, facts, runs and sources, as the screens and reports ask for them."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from provena.sources.shared import materialise


def current_value(facts: DataFrame, field: str) -> DataFrame:
    """(company_id, value, fact_id): of each company the newest fact of one field; of equal times the larger id."""
    newest = F.max_by(F.struct("value", "fact_id"), F.struct("observed_at", "fact_id"))
    return facts.where(F.col("field_name") == field).groupBy("company_id").agg(newest.alias("x")).select("company_id", "x.*")


def with_count(companies: DataFrame, rows: DataFrame, name: str, key: str = "company_id") -> DataFrame:
    """companies with how many rows each has; none is zero."""
    n = rows.groupBy(key).agg(F.count("*").alias(name))
    return companies.join(n, key, "left").withColumn(name, F.coalesce(name, F.lit(0)))


def having_source(companies: DataFrame, facts: DataFrame, source: str) -> DataFrame:
    """Companies with any fact of a source."""
    return companies.join(facts.where(F.col("source_id") == source).select("company_id"), "company_id", "left_semi")


def resolve_report(rows: DataFrame, by_id: DataFrame, by_document: DataFrame, id_key: str, document_key: str) -> DataFrame:
    """rows with `matched` and `via`: the report of by_id(key) with the row's id, else that of by_document(key) with its document."""
    a, b = by_id.select(F.col("key").alias("_id")), by_document.select(F.col("key").alias("_document"))
    both = rows.join(a, F.col(id_key) == F.col("_id"), "left").join(b, F.col(document_key) == F.col("_document"), "left")
    via = F.when(F.col("_id").isNotNull(), "id").when(F.col("_document").isNotNull(), "document")
    return both.withColumn("matched", F.coalesce("_id", "_document")).withColumn("via", via).drop("_id", "_document")


def orphans(rows: DataFrame, known: DataFrame, key: str) -> DataFrame:
    """Distinct keys of rows that `known` lacks."""
    return rows.select(key).distinct().join(known.select(key), key, "left_anti")


def union_of_codes(*columns: DataFrame) -> DataFrame:
    """Distinct values of one-column frames."""
    return reduce(DataFrame.union, columns).distinct()


def with_codes_in(rows: DataFrame, key: str, *columns: DataFrame) -> DataFrame:
    """Rows whose key is in any of the one-column frames."""
    codes = union_of_codes(*columns)
    return rows.join(codes.toDF(key), key, "left_semi")


def missing(required: DataFrame, present: DataFrame) -> DataFrame:
    """Distinct values of the one-column frame `required` that `present` lacks."""
    key = required.columns[0]
    return required.distinct().join(present.toDF(key), key, "left_anti")


def newest(rows: DataFrame, time: str | Column, row_id: str, limit: int, offset: int = 0) -> DataFrame:
    """A page of rows, newest first, by id within a time."""
    return rows.orderBy(F.desc(time) if isinstance(time, str) else time.desc(), row_id).offset(offset).limit(limit)


def audit_list(events: DataFrame, kind_prefix: str | None, status: str | None, limit: int, offset: int = 0) -> DataFrame:
    """A page of audit events(id, kind, status, at), filtered by what is given."""
    found = events if kind_prefix is None else events.where(F.col("kind").startswith(kind_prefix))
    found = found if status is None else found.where(F.col("status") == status)
    return newest(found, "at", "id", limit, offset)


def rejected_records(records: DataFrame, runs: DataFrame, limit: int) -> DataFrame:
    """Rejected records(run_id, status, ...) of the newest runs(run_id, started)."""
    both = records.where(F.col("status") == "rejected").join(runs.select("run_id", "started"), "run_id")
    return newest(both, "started", "run_id", limit)


def sources_list(sources: DataFrame, regions: list[str] | None = None) -> DataFrame:
    """Sources by region and id, of the given regions."""
    found = sources if regions is None else sources.where(F.col("region").isin(regions))
    return found.orderBy("region", "source_id")


def with_source_names(rows: DataFrame, sources: DataFrame) -> DataFrame:
    return rows.join(sources.select("source_id", "source_name"), "source_id", "left")


def outcome_counts(outcomes: DataFrame) -> DataFrame:
    """How often each source had each outcome."""
    return outcomes.groupBy("source_id", "outcome").agg(F.count("*").alias("n"))


def fact_summary(facts: DataFrame, trusted: str) -> DataFrame:
    """Sources, fields, and fields that the trusted source gives, of each company."""
    given = F.when(F.col("source_id") == trusted, F.col("field_name"))
    return facts.groupBy("company_id").agg(F.count_distinct("source_id").alias("n_sources"), F.count_distinct("field_name").alias("n_fields"), F.count_distinct(given).alias("n_trusted"))


def last_verified(facts: DataFrame, counts: Column) -> DataFrame:
    """(company_id, last_verified): the newest observation for which `counts` holds; null if there is none."""
    return facts.groupBy("company_id").agg(F.max(F.when(counts, F.col("observed_at"))).alias("last_verified"))


def active_fields(facts: DataFrame) -> DataFrame:
    """(company_id, fields): the sorted names of the fields that have facts."""
    return facts.groupBy("company_id").agg(F.sort_array(F.collect_set("field_name")).alias("fields"))


def summaries(companies: DataFrame) -> DataFrame:
    """What lists show of a company."""
    return companies.select("company_id", F.col("legal_name").alias("name"), F.concat_ws(":", "country", "company_id").alias("reference"), F.coalesce("sector", F.lit("")).alias("sector"))


def timeline(*kinds: DataFrame) -> DataFrame:
    """Frames of (company_id, t, kind, id) as one timeline, newest first."""
    return reduce(DataFrame.unionByName, kinds).orderBy(F.desc("t"), "kind", "id")


def duplicates_list(candidates: DataFrame, status: str | None = "open") -> DataFrame:
    """Duplicate candidates(a, b, score, status), the likeliest first."""
    found = candidates if status is None else candidates.where(F.col("status") == status)
    return found.orderBy(F.desc("score"), "a", "b")


def in_file_duplicates(rows: DataFrame, row_id: str, *key: Column) -> DataFrame:
    """rows with first_row, the least id with the same key (null parts count as equal), and whether a row repeats it.

    The first row of each key is aggregated and written, then joined, so a key with most of the rows is no single task.
    """
    keyed = rows.select("*", F.struct(*key).alias("_key"))
    first = materialise(keyed.groupBy("_key").agg(F.min(row_id).alias("first_row")), "first-rows")
    both = keyed.join(first.withColumnRenamed("_key", "_same"), F.col("_key").eqNullSafe(F.col("_same")))
    return both.drop("_key", "_same").withColumn("duplicate", F.col(row_id) != F.col("first_row"))
