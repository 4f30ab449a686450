"""Registered queries of searches, pages and ordered lists, with their SQL twins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from provena.functions import numbers as m
from provena.operators import quality, records, register, search, views
from provena.plans.adapters import COMPANIES, FACTS, companies, facts, table

QUERIES: dict = {}
ORACLES: dict[str, str] = {}
FIELDS = ["click", "purchase", "view", "signup", "refund", "logout"]
ASKED = ["gmbh", "#000000042", "7", "oy", "AB (P", "nothing like it", "99 as", "r#0", "é", ""]


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return add


@query(
    "F02_search_by_grams",
    f"""with {COMPANIES}, asked as (select unnest(range({len(ASKED)})) as query, unnest({ASKED}) as q)
  select query::int as query, company_id as id from asked, companies where q <> '' and merged_into_id is null and (contains(lower(legal_name), lower(q)) or contains(lower(city), lower(q)))""",
)
def f02(spark: SparkSession, d: str) -> DataFrame:
    c = companies(spark, d).where("merged_into_id is null")
    asked = spark.createDataFrame(list(enumerate(ASKED)), "query int, q string")
    return search.search(search.postings(c, "company_id", "legal_name", "city"), c, asked, "company_id", "legal_name", "city")


@query(
    "O01_page_by_key",
    f"""with {COMPANIES} select company_id, employee_min, legal_name from companies where merged_into_id is null order by employee_min desc nulls last, legal_name, company_id limit 50 offset 100""",
)
def o01(spark: SparkSession, d: str) -> DataFrame:
    c = companies(spark, d).where("merged_into_id is null").select("company_id", "employee_min", "legal_name")
    indexed = search.page_index(c, F.col("employee_min").isNull(), -F.col("employee_min"), F.col("legal_name"), F.col("company_id"))
    return search.page(indexed, 3)


@query(
    "O02_page_with_completeness",
    f"""with {COMPANIES}, {FACTS}, p as (select company_id, legal_name from companies where merged_into_id is null order by legal_name, company_id limit 50 offset 50
), n as (select company_id, count(distinct field_name) filter (where field_name in {tuple(FIELDS)}) as n from facts group by all)
  select company_id, legal_name, round(100 * coalesce(n, 0) / 6)::bigint as completeness from p left join n using (company_id)""",
)
def o02(spark: SparkSession, d: str) -> DataFrame:
    """The page is cut by name, and its rows are ordered by completeness."""
    c = companies(spark, d).where("merged_into_id is null").select("company_id", "legal_name")
    second = search.page(search.page_index(c, F.col("legal_name"), F.col("company_id")), 2)
    return second.join(quality.completeness(second, facts(spark, d), FIELDS), "company_id").orderBy(F.desc("completeness"), "legal_name", "company_id")


@query(
    "O10_shareholders_in_order",
    """with h as (select o_custkey as company_id, o_orderpriority as holder_name, case when o_orderpriority <> '5-LOW' then count(*) * 0.5 end as holding_percent, max(o_orderdate) >= timestamp '1997-01-01' as current from orders group by o_custkey, o_orderpriority)
  select company_id, holder_name, holding_percent::decimal(10,1) as holding_percent, current, row_number() over (order by company_id, current desc, holding_percent desc nulls last, holder_name) as nth from h order by nth limit 500""",
)
def o10(spark: SparkSession, d: str) -> DataFrame:
    h = table(spark, d, "orders").groupBy(F.col("o_custkey").alias("company_id"), F.col("o_orderpriority").alias("holder_name")).agg(
        (F.count("*") * 0.5).cast("decimal(10,1)").alias("half"), (F.max("o_orderdate") >= F.lit("1997-01-01").cast("timestamp")).alias("current")
    )
    held = h.select("company_id", "holder_name", F.when(F.col("holder_name") != "5-LOW", F.col("half")).alias("holding_percent"), "current")
    first = register.in_order(held).limit(500)
    return first.withColumn("nth", (F.monotonically_increasing_id() + 1).cast("long"))


@query(
    "O11_duplicates_list",
    "select c_custkey as a, c_custkey + 1 as b, c_custkey % 60 + 40 as score from customer where c_custkey % 11 = 0 and c_custkey % 3 = 0 order by score desc, a, b limit 40",
)
def o11(spark: SparkSession, d: str) -> DataFrame:
    n = F.col("c_custkey")
    pairs = table(spark, d, "customer").where(n % 11 == 0).select(n.alias("a"), (n + 1).alias("b"), (n % 60 + 40).alias("score"), F.when(n % 3 == 0, "open").otherwise("dismissed").alias("status"))
    return views.duplicates_list(pairs).select("a", "b", "score").limit(40)


@query("M05_round", "select o_orderkey, round_even(o_orderkey / 8.0::double, 2) as two, round_even(o_orderkey / 4.0::double, 1) as one, round_even(-(o_orderkey::double) / 2, 0) + 0.0::double as none from orders")
def m05(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("o_orderkey")
    return table(spark, d, "orders").select("o_orderkey", m.round_half_even(k / 8, 2).alias("two"), m.round_half_even(k / 4, 1).alias("one"), m.round_half_even(-k / 2).alias("none"))


@query(
    "K10_contact_basis",
    """select event_id, case when event_type in ('view', 'click') then event_type else 'unknown' end as basis, case when event_type not in ('view', 'click') then 'contact basis not known: ' || event_type end as warning
  from (select event_id, case when event_id % 5 = 0 then 'unknown' else event_type end as event_type from events) where event_type <> 'unknown' union all select event_id, 'unknown', null from events where event_id % 5 = 0""",
)
def k10(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events")
    basis = F.when(F.col("event_id") % 10 == 0, F.lit(None)).when(F.col("event_id") % 5 == 0, " ").otherwise(F.initcap("event_type"))
    return e.select("event_id", records.contact_basis(basis, ["view", "click"]).alias("b")).select("event_id", "b.*")
