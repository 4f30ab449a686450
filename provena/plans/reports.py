"""Registered queries of whole reports with their SQL twins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from provena.operators import register, reports
from provena.plans.adapters import COMPANIES, FACTS, companies, facts, statements, table
from provena.plans.imports import FIELDS as MONEY
from provena.plans.screening import FUNNEL, items
from provena.plans.sourcing import EVIDENCE, worded
from provena.plans.sourcing import FIELDS as WORDED
from provena.plans.sourcing import NOW as THEN

NOW = "2025-06-30"
QUERIES: dict = {}
ORACLES: dict[str, str] = {}
FIELDS = ["click", "purchase", "view", "signup", "refund", "logout"]


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return add


_BUCKET = "case when latest_revenue_eur < 0 then 'negative' " + " ".join(f"when latest_revenue_eur >= {lo}" + (f" and latest_revenue_eur < {hi} then '{lo}-{hi}'" if hi else f" then '{lo}+'") for lo, hi in register.BUCKETS) + " end"
_GIVEN = " union all ".join(f"select 'given', y || ' {f}', count({f}) from current_rows group by y having count({f}) > 0" for f in MONEY)


@query(
    "V29_coverage_report",
    FUNNEL + f""", i as (select *, coalesce(lower(trim(registry_status)) in ('r', 'registrisse kantud', 'registered'), false) as reg, focus_band = 'core' as band, evidence_status = 'complete' as complete from items
), e as (select * from i where reg and band and complete and not holding
), gaps as (select regexp_replace(issues[1], '\\b(19|20)[0-9][0-9]\\b', 'YYYY', 'g') as key, count(*) as n from i where reg and band and not complete and len(issues) > 0 group by all order by n desc, key limit 10
), current_rows as (select *, fiscal_year || ' ' || coalesce(statement_scope, 'unproven') as y from financials where review_status <> 'superseded'
), lines(section, key, n) as (select 'companies', '', count(*) from i union all select 'status', coalesce(registry_status, 'none'), count(*) from i group by all
  union all select 'step', 'registered', count(*) from i where reg having count(*) > 0 union all select 'step', 'in_band', count(*) from i where reg and band having count(*) > 0
  union all select 'step', 'complete', count(*) from i where reg and band and complete having count(*) > 0 union all select 'action', next_action, count(*) from i group by all
  union all select 'revenue', {_BUCKET}, count(*) from i where reg and latest_revenue_eur is not null group by all union all select 'gap', key, n from gaps
  union all select 'verdict', verdict, count(*) from i where next_action = 'advisor_review' and verdict is not null group by all union all select 'peer_group', coalesce(peer_group, 'none'), count(*) from e group by all
  union all select 'eligible', '', count(*) from e having count(*) > 0 union all select 'eligible', 'with index', count(*) from e where peer_group is not null and peer_count is not null having count(*) > 0
  union all select 'latest_year', latest_year::varchar, count(*) from i where reg and latest_year is not null group by all
  union all select 'flag', 'group_parent', count(*) from i where group_parent having count(*) > 0 union all select 'flag', 'holding_activity', count(*) from i where holding having count(*) > 0
  union all select 'flag', 'cash_harvesting_candidate', count(*) from i where cash having count(*) > 0
  union all select 'peer_groups_indexed', '', count(*) from (select 1 from e where peer_group is not null group by peer_group having count(*) >= 8) having count(*) > 0
  union all select 'rows', y, count(*) from current_rows group by all union all select 'period', case when period_end - period_start + 1 between 330 and 400 then '12 months' else 'other length' end, count(*) from current_rows group by all
  union all {_GIVEN})
  select section, key, n::bigint as n from lines""",
)
def v29(spark: SparkSession, d: str) -> DataFrame:
    return reports.coverage(items(spark, d), statements(spark, d), MONEY)


OPEN_FACTS = """open_facts as (select company_id, field_name, value % 4 = 1 as conflicting, fact_id % 97 = 0 as is_correction from facts where fact_id % 10 <> 0)"""


def _facts(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("fact_id")
    return facts(spark, d).where(k % 10 != 0).select("company_id", "field_name", (F.col("value") % 4 == 1).alias("conflicting"), (k % 97 == 0).alias("is_correction"))


def _companies(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("company_id")
    return companies(spark, d).withColumn("review_status", F.when(k % 3 == 0, "reviewed").when(k % 3 == 1, "open"))


@query(
    "V30_whole_report",
    f"""with {COMPANIES}, {FACTS}, {OPEN_FACTS}, c as (select *, case when company_id % 3 = 0 then 'reviewed' when company_id % 3 = 1 then 'open' end as review_status from companies where merged_into_id is null
), per_field as (select company_id, field_name, bool_or(conflicting) as conflicting, bool_or(is_correction) as resolved from open_facts group by all
), mine as (select c.company_id, f.field_name, f.conflicting, f.resolved from c join per_field f using (company_id)
), shares as (select c.company_id, round_even(100.0 * count(field_name) filter (where field_name in {tuple(FIELDS)}) / {len(FIELDS)}, 0)::bigint as share from c left join mine using (company_id) group by all
), words as (select case when event_type = 'click' then 'unknown type' else 'value of ' || event_type end as key from events
), lines(section, key, n) as (select 'companies', '', count(*) from c
  union all select 'qualification', case when employee_min is null then 'unknown_headcount' when employee_min >= 20 then 'qualified' when employee_max is null or employee_max >= 20 then 'borderline' when employee_max <= 2 then 'sub_scale' else 'below_threshold' end, count(*) from c group by all
  union all select 'review_status', coalesce(review_status, 'none'), count(*) from c group by all
  union all select 'stale', '', count(*) from c where verified_on is null or timestamp '{NOW}' - verified_on::timestamp > interval 365 day having count(*) > 0
  union all select 'completeness', 'average', round_even(sum(share) / count(*), 0) from shares
  union all select 'conflicts', '', count(*) from mine where conflicting having count(*) > 0 union all select 'conflicts', 'not settled', count(*) from mine where conflicting and not resolved having count(*) > 0
  union all select 'missing', f, count(*) from (select c.company_id, unnest({FIELDS}) as f from c) x where not exists (select 1 from mine where mine.company_id = x.company_id and field_name = f) group by all
  union all select 'records', case when o_orderstatus = 'P' then 'rejected' else 'accepted' end, count(*) from orders group by all
  union all select * from (select 'warning', key, count(*) as n from words group by all order by n desc, key limit 15)
  union all select 'duplicates', case when o_orderkey % 3 = 0 then 'open' else 'dismissed' end, count(*) from orders where o_orderkey % 7 = 0 group by all
  union all select 'snapshots', 'expired', count(*) from orders where o_orderkey % 5 = 0 having count(*) > 0 union all select 'snapshots', 'due', count(*) from orders where o_orderkey % 5 <> 0 and o_orderdate <= timestamp '1998-01-01' having count(*) > 0
  union all select 'snapshots', 'all', count(*) from orders)
  select section, key, n::bigint as n from lines""",
)
def v30(spark: SparkSession, d: str) -> DataFrame:
    o, k = table(spark, d, "orders"), F.col("o_orderkey")
    kind = F.col("event_type")
    text = F.when(kind == "click", F.concat(F.lit("unknown type '"), kind, F.lit("' dropped"))).otherwise(F.concat(F.lit("value of "), kind, F.lit(" '"), F.col("value").cast("string"), F.lit("'")))
    warned = table(spark, d, "events").select(F.lit(None).cast("string").alias("status"), F.array(text).alias("warnings"))
    records = o.select(F.when(F.col("o_orderstatus") == "P", "rejected").otherwise("accepted").alias("status"), F.lit(None).cast("array<string>").alias("warnings"))
    candidates = o.where(k % 7 == 0).select(F.when(k % 3 == 0, "open").otherwise("dismissed").alias("status"))
    # Snapshots of orders: a fifth has expired, the others are due from the order's date on.
    early = F.col("o_orderdate").cast("timestamp")
    due = F.when(early <= F.lit("1998-01-01").cast("timestamp"), F.lit(NOW)).otherwise("2999-01-01").cast("timestamp")
    snapshots = o.select(F.when(k % 5 == 0, early).alias("expired_at"), due.alias("expires_at"))
    return reports.quality(_companies(spark, d), _facts(spark, d), records.unionByName(warned), candidates, snapshots, F.lit(NOW).cast("timestamp"), FIELDS)


@query(
    "A15_conflicts_settled",
    f"""with {COMPANIES}, {FACTS}, {OPEN_FACTS} select company_id, field_name, count(*) filter (where conflicting) as n_values, bool_or(is_correction) as resolved from open_facts
  where company_id in (select company_id from companies) group by all having count(*) filter (where conflicting) > 0""",
)
def a15_settled(spark: SparkSession, d: str) -> DataFrame:
    return reports.conflicts(_facts(spark, d), companies(spark, d))


PAGES = f"""with {EVIDENCE}, {COMPANIES}, c as (select *, case when company_id % 9 <> 0 then 'EE:' || company_id end as registry_id from companies
), labels as (select e.company_id, e.field_name, e.fact_id, e.value, e.ts, e.fix, e.source,
    case when e.fix then case when e.fact_id = f.fact_id then 'manually-corrected' else 'old' end when not e.fresh then 'old' when kind = 'conflicting' then 'conflicting'
      when kind = 'multi-source' and e.v = k.v then 'multi-source' when e.trust = 0 then 'verified' else 'estimated' end as label,
    coalesce(case when f.fact_id is not null then e.fact_id = f.fact_id when kind = 'old' then not e.fix and e.fact_id = o.fact_id else not e.fix and e.fresh and e.v = k.v end, false) as supporting
  from e join kinds k using (company_id, field_name) left join fixes f using (company_id, field_name) left join olds o using (company_id, field_name) where company_id in (select company_id from c)
), support as (select company_id, field_name, count(*) as n, string_agg(distinct source, ',' order by source) as sources from labels where supporting group by all
), resolved as (select k.company_id, k.field_name, case when f.fact_id is not null then 'manually-corrected' when kind = 'single' then base else kind end as status,
    case when f.fact_id is not null then f.value when n_clusters > 0 then k.value else o.value end as value, n_clusters
  from kinds k left join fixes f using (company_id, field_name) left join olds o using (company_id, field_name)
), view as (select c.company_id, x.pos, x.field_name, coalesce(r.status, 'unknown') as status, r.value, r.n_clusters, coalesce(s.n, 0) as n, coalesce(s.sources, '') as sources
  from c, (select unnest(range({len(WORDED)})) as pos, unnest({WORDED}) as field_name) x left join resolved r on r.company_id = c.company_id and r.field_name = x.field_name left join support s on s.company_id = c.company_id and s.field_name = x.field_name
), cand as (select c_custkey as a, c_custkey + 1 as b, c_custkey % 60 + 40 as score, case when c_custkey % 3 = 0 then 'open' else 'dismissed' end as status from customer where c_custkey % 11 = 0
), dup as (select x.* from (select a as company_id, b as other, score, status from cand union all select b, a, score, status from cand) x where company_id in (select company_id from c)
), n_open as (select company_id, count(*) as n from dup where status = 'open' group by all
), yearly as (select o_custkey as company_id, year(o_orderdate) as y, sum(o_totalprice::decimal(20,2))::decimal(20,2) as revenue from orders group by all
), holders as (select o_custkey as company_id, o_orderpriority as name, case when o_orderpriority <> '5-LOW' then count(*) * 0.5 end as percent from orders group by o_custkey, o_orderpriority
), lines(company_id, section, place, key, value, note) as (select company_id, 'field', pos, field_name, value, status || '|' || n || '|' || sources from view
  union all select company_id, 'fact', -epoch_us(ts), fact_id::varchar, value, field_name || '|' || label from labels
  union all select company_id, 'timeline', -epoch_us(ts), case when fix then 'correction' else 'fact' end, field_name, source from labels
  union all select o_custkey, 'timeline', -epoch_us(o_orderdate), 'audit', o_orderpriority, null from orders where o_orderkey % 5 = 0
  union all select company_id, 'financial', -y, y::varchar, revenue::varchar, 'standalone' from yearly
  union all select company_id, 'shareholder', coalesce(-round(percent * 10000), 1), name, percent::decimal(10,1)::varchar, null from holders
  union all select company_id, 'duplicate', -score, other::varchar, score::varchar, status from dup
  union all select company_id, 'warning', 0, field_name, status, case when status = 'conflicting' then n_clusters::varchar end from view where status in ('conflicting', 'old')
  union all select company_id, 'warning', 1, 'headcount', case when employee_min is null then 'unknown_headcount' when employee_max <= 2 then 'sub_scale' else 'borderline' end, null from c
    where employee_min is null or employee_min < 20 and (employee_max is null or employee_max >= 20 or employee_max <= 2)
  union all select company_id, 'warning', 1, 'freshness', 'stale', null from c where timestamp '{THEN}' - verified_on::timestamp > interval 365 day
  union all select company_id, 'warning', 1, 'registry_id', 'missing', null from c where registry_id is null union all select company_id, 'warning', 1, 'duplicates', n || ' open', null from n_open)"""


@query("V31_company_pages", f"{PAGES} select company_id, section, place::bigint as place, key, value, note from lines")
def v31(spark: SparkSession, d: str) -> DataFrame:
    k, o = F.col("company_id"), table(spark, d, "orders")
    c = companies(spark, d).withColumn("registry_id", F.when(k % 9 != 0, F.concat(F.lit("EE:"), k.cast("string"))))
    own = F.col("o_custkey").alias("company_id")
    yearly = o.groupBy(own, F.year("o_orderdate").alias("fiscal_year")).agg(F.sum(F.col("o_totalprice").cast("decimal(20,2)")).cast("decimal(20,2)").alias("revenue")).withColumn("scope", F.lit("standalone"))
    half = (F.count("*") * 0.5).cast("decimal(10,1)")
    holders = o.groupBy(own, F.col("o_orderpriority").alias("name")).agg(half.alias("half")).select("company_id", "name", F.when(F.col("name") != "5-LOW", F.col("half")).alias("percent"))
    audits = o.where("o_orderkey % 5 = 0").select(own, F.col("o_orderpriority").alias("action"), F.col("o_orderdate").cast("timestamp").alias("at"))
    n = F.col("c_custkey")
    pairs = table(spark, d, "customer").where(n % 11 == 0).select(n.alias("a"), (n + 1).alias("b"), (n % 60 + 40).alias("score"), F.when(n % 3 == 0, "open").otherwise("dismissed").alias("status"))
    return reports.company_pages(c, worded(spark, d), F.lit(THEN).cast("timestamp"), WORDED, yearly, holders, pairs, audits)
