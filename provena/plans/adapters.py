"""The driver's tables in the shape of company data, as DataFrames and as the same thing in DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

COUNTRIES = ["FI", "SE", "NO", "DK", "IS", "DE", "AT", "CH", "EE"]
FORMS = ["OÜ", "AS", "GmbH", "Oy", "AB (publ)"]
STATUSES = ["R", " Registered ", "L", "n", "Registrisse kantud"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _pick(values: list[str], at) -> F.Column:
    return F.element_at(F.array(*map(F.lit, values)), (at + 1).cast("int"))


def companies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """customer as companies: key, name with a legal form, country, status, headcount range, domain, activity code."""
    nation = table(spark, sf_dir, "nation").select("n_nationkey", F.col("n_name").alias("city"))
    k, n = F.col("c_custkey"), F.col("c_nationkey")
    lo = F.when(k % 11 != 0, k % 60)
    code = F.concat((10 + 3 * n).cast("string"), F.lpad((k % 100).cast("string"), 2, "0"), F.lit("1"))
    return (
        table(spark, sf_dir, "customer")
        .join(F.broadcast(nation), F.col("c_nationkey") == F.col("n_nationkey"))
        .select(
            k.alias("company_id"),
            F.concat("c_name", F.lit(" "), _pick(FORMS, k % 5)).alias("legal_name"),
            _pick(COUNTRIES, n % 9).alias("country"),
            "city",
            F.when(k % 6 != 5, _pick(STATUSES, k % 5)).alias("registry_status"),
            F.when(k % 17 == 0, F.lit("7010")).when(k % 23 != 0, code).alias("industry_code"),
            F.col("c_mktsegment").alias("sector"),
            lo.cast("bigint").alias("employee_min"),
            F.when(k % 7 != 0, lo + k % 40).cast("bigint").alias("employee_max"),
            F.concat(F.lit("firm"), (k % 400).cast("string"), F.lit(".ee")).alias("domain"),
            F.date_add(F.lit("2024-01-01").cast("date"), (k % 700).cast("int")).alias("verified_on"),
            F.when(k % 97 == 0, k - 1).alias("merged_into_id"),
            F.col("c_acctbal").cast("decimal(20,2)").alias("balance"),
        )
    )


COMPANIES = """companies as (
  select c_custkey as company_id,
    c_name || ' ' || ['OÜ', 'AS', 'GmbH', 'Oy', 'AB (publ)'][c_custkey % 5 + 1] as legal_name,
    ['FI', 'SE', 'NO', 'DK', 'IS', 'DE', 'AT', 'CH', 'EE'][c_nationkey % 9 + 1] as country,
    n_name as city,
    case when c_custkey % 6 <> 5 then ['R', ' Registered ', 'L', 'n', 'Registrisse kantud'][c_custkey % 5 + 1] end as registry_status,
    case when c_custkey % 17 = 0 then '7010' when c_custkey % 23 <> 0 then (10 + 3 * c_nationkey)::varchar || lpad((c_custkey % 100)::varchar, 2, '0') || '1' end as industry_code,
    c_mktsegment as sector,
    case when c_custkey % 11 <> 0 then c_custkey % 60 end as employee_min,
    case when c_custkey % 7 <> 0 and c_custkey % 11 <> 0 then c_custkey % 60 + c_custkey % 40 end as employee_max,
    'firm' || (c_custkey % 400)::varchar || '.ee' as domain,
    date '2024-01-01' + (c_custkey % 700)::int as verified_on,
    case when c_custkey % 97 = 0 then c_custkey - 1 end as merged_into_id,
    c_acctbal::decimal(20,2) as balance
  from customer join nation on c_nationkey = n_nationkey
)"""


def statements(spark: SparkSession, sf_dir: str) -> DataFrame:
    """orders as annual statements: one a customer and year, with figures derived from the year's orders."""
    k, y = F.col("o_custkey"), F.col("fiscal_year")
    price = F.col("o_totalprice").cast("decimal(20,2)")
    share = F.when(F.col("o_orderstatus") == "F", 30).when(F.col("o_orderstatus") == "O", 20).otherwise(-10)
    yearly = (
        table(spark, sf_dir, "orders")
        .select("o_custkey", F.year("o_orderdate").alias("fiscal_year"), price.alias("price"), (price * share).alias("profit"))
        .groupBy("o_custkey", "fiscal_year")
        .agg(F.sum("price").alias("revenue"), F.sum("profit").alias("profit"), F.count("*").alias("n"))
    )
    profit = (F.col("profit") / 100).cast("decimal(20,2)")
    odd = (k + y) % 19
    return yearly.select(
        k.alias("company_id"),
        y.alias("fiscal_year"),
        F.make_date(y, F.lit(1), F.lit(1)).alias("period_start"),
        F.make_date(y, F.when(odd == 3, 6).otherwise(12), F.when(odd == 3, 30).otherwise(31)).alias("period_end"),
        F.when(odd == 7, "USD").otherwise("EUR").alias("currency"),
        F.lit("EUR").alias("unit"),
        F.when(k % 29 == 0, "consolidated").otherwise("standalone").alias("statement_scope"),
        F.col("revenue").cast("decimal(20,2)").alias("revenue"),
        F.when(odd != 5, profit).alias("operating_profit"),
        F.when(k % 4 != 0, (F.col("profit") / 100 + F.col("revenue") / 20).cast("decimal(20,2)")).alias("ebitda"),
        (F.col("revenue") * 2).cast("decimal(20,2)").alias("total_assets"),
        (F.col("revenue") * (k % 9) / 10).cast("decimal(20,2)").alias("equity"),
        (F.col("n") * 4 + k % 3).cast("decimal(12,2)").alias("employees_fte"),
        F.concat(F.lit("R"), k.cast("string"), F.lit("-"), y.cast("string")).alias("filing_id"),
        F.when((k + y) % 31 == 0, "superseded").otherwise("current").alias("review_status"),
    )


STATEMENTS = """statements as (
  select *, (company_id + fiscal_year) % 19 as odd from (
    select o_custkey as company_id, year(o_orderdate)::int as fiscal_year, sum(o_totalprice::decimal(20,2))::decimal(20,2) as revenue,
      sum(round(o_totalprice::decimal(20,2) * 100)::bigint * case o_orderstatus when 'F' then 30 when 'O' then 20 else -10 end) as profit_hundredths,
      count(*) as n
    from orders group by all)
), financials as (
  select company_id, fiscal_year, make_date(fiscal_year, 1, 1) as period_start,
    case when odd = 3 then make_date(fiscal_year, 6, 30) else make_date(fiscal_year, 12, 31) end as period_end,
    case when odd = 7 then 'USD' else 'EUR' end as currency, 'EUR' as unit,
    case when company_id % 29 = 0 then 'consolidated' else 'standalone' end as statement_scope,
    revenue,
    case when odd <> 5 then round(profit_hundredths::decimal(30,0) * 0.0001, 2)::decimal(20,2) end as operating_profit,
    case when company_id % 4 <> 0 then round(profit_hundredths::decimal(30,0) * 0.0001 + revenue * 0.05, 2)::decimal(20,2) end as ebitda,
    (revenue * 2)::decimal(20,2) as total_assets,
    round(revenue * (company_id % 9) * 0.1, 2)::decimal(20,2) as equity,
    (n * 4 + company_id % 3)::decimal(12,2) as employees_fte,
    'R' || company_id || '-' || fiscal_year as filing_id,
    case when (company_id + fiscal_year) % 31 = 0 then 'superseded' else 'current' end as review_status
  from statements
)"""


def facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events as source facts: company, source, field, value, observed time."""
    return table(spark, sf_dir, "events").select(
        F.col("event_id").alias("fact_id"),
        F.col("user_id").alias("company_id"),
        F.concat(F.lit("src"), (F.col("event_id") % 3).cast("string")).alias("source_id"),
        F.col("event_type").alias("field_name"),
        F.floor(F.col("value") / 20).cast("bigint").alias("value"),
        F.col("ts").cast("timestamp").alias("observed_at"),
        (F.col("event_id") % 3).cast("int").alias("trust_rank"),
    )


FACTS = """facts as (
  select event_id as fact_id, user_id as company_id, 'src' || (event_id % 3)::varchar as source_id, event_type as field_name,
    floor(value / 20)::bigint as value, ts as observed_at, (event_id % 3)::int as trust_rank from events
)"""
