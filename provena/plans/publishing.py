"""Registered queries about whole imports and about what they keep up: several tables in one version, views by change."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from provena.operators import importing, ledger
from provena.plans.adapters import FACTS, facts, table
from provena.sources.shared import new_path
from provena.sources.versioned import Store

QUERIES: dict = {}
ORACLES: dict[str, str] = {}
COVERED = ["EE", "FI"]


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return add


def load_of(spark: SparkSession, d: str, second: bool) -> dict[str, DataFrame]:
    """Input of an import: customers of seven in ten with addresses, reports by year and holders, some of them renamed, moved or revised in the second load."""
    c, o = table(spark, d, "customer"), table(spark, d, "orders")
    k = F.col("c_custkey")
    mine = c.where(k % 10 >= 3 if second else k % 10 < 7).join(table(spark, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    seen = F.lit("2025-02-01" if second else "2025-01-01").cast("timestamp").alias("observed_at")
    code, again = k.cast("string").alias("registry_code"), F.lit(second)
    name = F.when(F.col("c_acctbal") >= -900, F.concat("c_name", F.when(again & (k % 5 == 0), " new").otherwise("")))
    firms = mine.select(k.alias("row"), code, name.alias("legal_name"), F.when(k % 13 == 0, "US").when(k % 2 == 0, "EE").otherwise("FI").alias("country"), F.lit("R").alias("status"), seen)
    repeated = firms.where(F.col("row") % 50 == 3).withColumn("row", F.col("row") + 1_000_000_000)
    addresses = mine.select(k.alias("row"), code, F.when(k % 11 != 0, F.concat("n_name", F.when(again & (k % 7 == 0), " 2").otherwise(" 1"))).alias("address"), F.col("n_name").alias("city"), seen)
    placed = o if second else o.where("o_orderkey % 4 <> 3")
    own, year = F.col("o_custkey").cast("string").alias("registry_code"), F.year("o_orderdate").alias("fiscal_year")
    price = F.sum(F.col("o_totalprice").cast("decimal(20,2)")).cast("decimal(20,2)")
    yearly = placed.groupBy("o_custkey", year).agg(price.alias("revenue"), F.count("*").alias("n"))
    reports = yearly.select(
        (F.col("o_custkey") * 10_000 + F.col("fiscal_year")).alias("row"), own, F.concat_ws("-", F.lit("R"), "o_custkey", "fiscal_year").alias("report_id"), "fiscal_year", F.lit("standalone").alias("scope"),
        F.make_date("fiscal_year", F.lit(1), F.lit(1)).alias("period_start"), F.when(F.col("o_custkey") % 17 != 0, F.make_date("fiscal_year", F.lit(12), F.lit(31))).alias("period_end"), "revenue",
        F.lit(None).cast("decimal(20,2)").alias("operating_profit"), F.col("n").alias("employees_fte"), seen,
    )
    holders = placed.select(own, F.col("o_orderpriority").alias("name"), F.lit("owner").alias("role"), F.lit(1).alias("share"), seen).distinct()
    return {"companies": firms.unionByName(repeated), "addresses": addresses, "reports": reports, "holders": holders}


def _load_sql(n: int) -> str:
    """SQL tables of the loads' rows: t<n>(name, key, value, bad) with a row for each row of the input."""
    mine, of = ("c_custkey % 10 >= 3", "true") if n == 2 else ("c_custkey % 10 < 7", "o_orderkey % 4 <> 3")
    new, moved = ("case when c_custkey % 5 = 0 then ' new' else '' end", "case when c_custkey % 7 = 0 then ' 2' else ' 1' end") if n == 2 else ("''", "' 1'")
    return f"""c{n} as (select c_custkey, c_acctbal < -900 or c_custkey % 13 = 0 as bad, c_name || {new} as legal_name, n_name || {moved} as address from customer join nation on n_nationkey = c_nationkey where {mine}
), ok{n} as (select c_custkey as k from c{n} where not bad
), y{n} as (select o_custkey as k, year(o_orderdate) as y, sum(o_totalprice::decimal(20,2)) as revenue, count(*) as n from orders where {of} group by all
), t{n} as (select 'companies' as name, c_custkey::varchar as key, legal_name as value, bad, 0 as repeats from c{n}
  union all select 'companies', c_custkey::varchar, legal_name, bad, 1 from c{n} where c_custkey % 50 = 3
  union all select 'addresses', c_custkey::varchar, address, bad or c_custkey % 11 = 0, 0 from c{n}
  union all select 'financials', y{n}.k || '/' || y, revenue || '/' || n, ok{n}.k is null or y{n}.k % 17 = 0, 0 from y{n} left join ok{n} on ok{n}.k = y{n}.k
  union all select 'shareholders', o_custkey::varchar, string_agg(distinct o_orderpriority, ',' order by o_orderpriority), false, 0 from orders join ok{n} on k = o_custkey where {of} group by all)"""


IMPORTED = f"""with {_load_sql(1)}, {_load_sql(2)}, g1 as (select name, key, value from t1 where not bad and repeats = 0
), both_loads as (select 'first' as run, t1.name, case when bad then 'rejected' when repeats = 1 then 'duplicate' else 'new' end as outcome from t1
  union all select 'second', t2.name, case when bad then 'rejected' when repeats = 1 then 'duplicate' when g1.key is null then 'new' when g1.value = t2.value then 'unchanged' else 'changed' end
    from t2 left join g1 on g1.name = t2.name and g1.key = t2.key
  union all select 'second once more', name, case when bad then 'rejected' when repeats = 1 then 'duplicate' else 'unchanged' end from t2)"""


def _imported(spark: SparkSession, d: str) -> Store:
    """Two loads, the second one sent twice and retried from its stored input, and one cut off before its commit."""
    store, plan = Store(spark, new_path(spark, "register")), lambda inputs: importing.register_plan(inputs, COVERED)
    importing.import_run(store, "first", load_of(spark, d, False), plan)
    for _ in range(2):
        importing.import_run(store, "second", load_of(spark, d, True), plan)
    lost = ledger.Batch(plan(load_of(spark, d, False))["companies"].rows.withColumn("legal_name", F.lit("lost")), *importing.TABLES["companies"], errors="errors")
    base = store.latest()
    store.prepared(base, "cut off", ledger.changes_of(store, base, "cut off", {"companies": lost})[0], {})
    importing.retry(store, "second", "second once more", plan)
    return store


@query("V33_versioned_import", f"{IMPORTED} select run, name, outcome, count(*) as n from both_loads group by all")
def v33(spark: SparkSession, d: str) -> DataFrame:
    return importing.outcome_counts(_imported(spark, d))


@query(
    "V22_state_after_retry",
    f"""{IMPORTED}, g2 as (select name, key, value from t2 where not bad and repeats = 0), v as (select coalesce(g1.name, g2.name) as name, g1.key is not null as a, g2.key is not null as b, g1.value is distinct from g2.value as differs
    from g1 full join g2 on g1.name = g2.name and g1.key = g2.key)
  select name, count(*) as n_keys, sum(case when a and b and differs then 2 else 1 end)::bigint as n_versions, count(*) filter (where a and b and differs) as n_ended, count(*) filter (where b) as n_seen_again from v group by all""",
)
def v22(spark: SparkSession, d: str) -> DataFrame:
    """Keys, versions, versions that have ended and keys last seen in the second load, after all runs."""
    store = _imported(spark, d)
    out = None
    for name, (keys, values) in importing.TABLES.items():
        h = ledger.history(store, name, keys, values)
        open_again = F.col("valid_to").isNull() & (F.col("last_seen") == F.lit("2025-02-01").cast("timestamp"))
        one = h.agg(
            F.count_if(F.col("version") == 1).alias("n_keys"), F.count("*").alias("n_versions"), F.count_if(F.col("valid_to").isNotNull()).alias("n_ended"), F.count_if(open_again).alias("n_seen_again")
        ).select(F.lit(name).alias("name"), "*")
        out = one if out is None else out.unionByName(one)
    return out


@query(
    "V14_view_by_change",
    f"""with {FACTS}, b as (select *, case when company_id % 10 = 3 then fact_id % 4 else 0 end as load from facts where company_id % 10 = 3 or fact_id % 2 = 0
), l as (select company_id, source_id, field_name, load, arg_min(value, fact_id) as value from b group by all
), s as (select *, lag(value) over (partition by company_id, source_id, field_name order by load) as before, lag(load) over (partition by company_id, source_id, field_name order by load) as earlier from l
), n as (select company_id, source_id, field_name, arg_max(value, load) as value, count(*) filter (where earlier is null or value <> before) as versions from s group by all)
  select company_id, count(distinct source_id) as n_sources, count(distinct field_name) as n_fields, sum(value)::bigint as total, sum(versions)::bigint as n_versions from n group by all""",
)
def v14_by_change(spark: SparkSession, d: str) -> DataFrame:
    """Company figures kept up over four loads, of which three touch a tenth of the companies only."""
    store, keys = Store(spark, new_path(spark, "kept-up")), ["company_id", "source_id", "field_name"]
    f = facts(spark, d).where("company_id % 10 = 3 or fact_id % 2 = 0")
    f = f.withColumn("load", F.when(F.col("company_id") % 10 == 3, F.col("fact_id") % 4).otherwise(0))

    def summary(log: DataFrame) -> DataFrame:
        now = ledger.newest(log, keys, ["value"])
        return now.groupBy("company_id").agg(F.count_distinct("source_id").alias("n_sources"), F.count_distinct("field_name").alias("n_fields"), F.sum("value").alias("total"), F.sum("version").alias("n_versions"))

    for n in range(4):
        rows = f.where(F.col("load") == n).select(*keys, "value", "observed_at", F.col("fact_id").alias("row"))
        ledger.load(store, f"load {n}", {"facts": ledger.Batch(rows, keys, ["value"], by=["company_id"])})
        importing.maintain(store, str(n), "summaries", "facts", ["company_id"], summary)
    return importing.view_rows(store, "summaries", ["company_id"])


DOMAINS = """x as (select c_custkey as k, case when c_custkey % 2 = 0 then 'shop' || c_custkey % 5 || '.ee' end as www, 'f' || c_custkey || '.ee' as mail,
    case when c_custkey % 2 = 0 then 'shop' || (c_custkey % 5 + case when c_custkey % 3 = 0 then 1 else 0 end) || '.ee' end as www2, case when c_custkey % 7 <> 0 then 'f' || c_custkey || '.ee' end as mail2 from customer
), v as (select k, concat_ws(',', mail, www) as a, concat_ws(',', mail2, www2) as b from x)"""


@query(
    "V34_domains_as_facts",
    f"""with {DOMAINS} select 'load 1' as run, case when k % 10 = 0 then 'rejected' else 'new' end as outcome, count(*) as n from v group by all
  union all select 'load 2', case when k % 10 = 0 then 'rejected' when a = b then 'unchanged' else 'changed' end, count(*) from v where b <> '' group by all
  union all select 'open', case when b <> '' then b else a end, count(*) from v where k % 10 <> 0 group by all having count(*) > 1""",
)
def v34(spark: SparkSession, d: str) -> DataFrame:
    """Contact entries of the register through the ledger in two loads, and the open values that several companies share."""
    store, c, k = Store(spark, new_path(spark, "domains")), table(spark, d, "customer"), F.col("c_custkey")
    known = c.where(k % 10 != 0).select(k.alias("company_id"), k.cast("string").alias("registry_code"))
    entry = lambda kind, value, ends: F.struct(F.lit(kind).alias("kind"), value.alias("value"), ends.alias("ends"))
    for n in (1, 2):
        shop = F.concat(F.lit("http://www.shop"), (k % 5 + F.when(F.lit(n == 2) & (k % 3 == 0), 1).otherwise(0)).cast("string"), F.lit(".ee/"))
        gone = F.when(F.lit(n == 2) & (k % 7 == 0), "2025-01-01")
        entries = F.array(entry("EMAIL", F.concat(F.lit("Info@f"), k.cast("string"), F.lit(".ee")), gone), entry("WWW", F.when(k % 2 == 1, "gmail.com").otherwise(shop), F.lit(None).cast("string")))
        general = c.select(k.alias("row"), k.cast("string").alias("registry_code"), entries.alias("entries"), F.lit(f"2025-0{n}-01").cast("timestamp").alias("observed_at"))
        ledger.load(store, f"load {n}", {"facts": importing.domain_batch(general, known, "register")})
    outcomes = importing.outcome_counts(store).select("run", "outcome", "n")
    now = ledger.current(store, "facts", importing.FACT_KEYS, ["value"]).groupBy(F.lit("open").alias("run"), F.col("value").alias("outcome")).agg(F.count("*").alias("n")).where("n > 1")
    return outcomes.unionByName(now)
