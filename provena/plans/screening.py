"""Registered queries about signals and the screening funnel, with their SQL twins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from provena.functions import text as t
from provena.operators import funnel, signals
from provena.plans.adapters import COMPANIES, STATEMENTS, companies, statements, table

BAND = (100_000, 900_000)
YEAR = 2002


def with_codes(df: DataFrame) -> DataFrame:
    return df.withColumn("industry_codes", F.when(F.col("industry_code").isNotNull(), F.array("industry_code")))


def verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("c_custkey")
    v = F.element_at(F.array(*map(F.lit, ["coasting", "decaying", "watch", "active", "insufficient_evidence"])), (k % 5 + 1).cast("int"))
    return table(spark, sf_dir, "customer").where(k % 3 == 0).select(k.alias("company_id"), v.alias("verdict"))


def items(spark: SparkSession, sf_dir: str) -> DataFrame:
    return funnel.prospects(with_codes(companies(spark, sf_dir)), statements(spark, sf_dir), *BAND, YEAR, verdicts(spark, sf_dir))


def _r(c: str) -> F.Column:
    return F.round(F.col(c), 6).alias(c)


SIGNAL = f"""{STATEMENTS}, cur as (
  select *, period_end - period_start + 1 as days from financials where review_status <> 'superseded'
), tested as (
  select *, statement_scope = 'standalone' and currency = 'EUR' and unit = 'EUR' and days between 330 and 400 and revenue > 0 as rev_ok from cur
), years as (
  select company_id, fiscal_year, sum((rev_ok and operating_profit is not null)::int) as n_op, sum(rev_ok::int) as n_rev,
    any_value(revenue) as revenue, any_value(operating_profit) as op, any_value(ebitda) as ebitda, any_value(total_assets) as assets, any_value(equity) as equity,
    any_value(employees_fte) as fte, any_value(filing_id) as filing_id
  from tested group by all
), filed as (select company_id, max(fiscal_year) as filed, count(*) as n from years group by all
), once as (
  select *, lead(fiscal_year, 1) over w as y1, lead(fiscal_year, 2) over w as y2, lead(revenue, 2) over w as rev2,
    lead(op, 1) over w as op1, lead(op, 2) over w as op2, lead(revenue, 1) over w as rev1, row_number() over w as k,
    lead(filing_id, 1) over w as f1, lead(filing_id, 2) over w as f2
  from years where n_op = 1 window w as (partition by company_id order by fiscal_year desc)
), last as (select *, coalesce(y1 = fiscal_year - 1 and y2 = fiscal_year - 2, false) as three from once where k = 1
), signal as (
  select f.company_id, l.fiscal_year as latest_year, l.revenue::double as latest_revenue_eur, l.op::double / l.revenue::double as latest_operating_margin,
    case when three then list_sort([l.op::double / l.revenue::double, op1::double / rev1::double, op2::double / rev2::double])[2] end as three_year_median_margin,
    case when three then pow(l.revenue::double / rev2::double, 0.5) - 1 end as three_year_revenue_cagr,
    case when three then (l.op > 0)::int + (op1 > 0)::int + (op2 > 0)::int end as positive_profit_years,
    case when l.assets > 0 then l.equity::double / l.assets::double end as latest_equity_ratio, l.fte::double as latest_employees_fte,
    case when l.company_id is null then 'unknown' when l.revenue::double between {BAND[0]} and {BAND[1]} then 'core' else 'adjacent' end as focus_band,
    coalesce(three, false) as three, l.op,
    list_filter([case when y.n_op <> 1 then 'Latest fiscal year lacks one unique comparable standalone EUR report' end,
      case when l.company_id is null then 'No comparable annual revenue and operating profit' when not three then 'Three consecutive comparable fiscal years unavailable' end,
      case when three and l.fiscal_year < {YEAR} - 2 then 'Latest comparable fiscal year is older than two years' end], lambda x: x is not null) as issues,
    f.filed, case when l.company_id is null then '' when three then (l.fiscal_year - 2) || ':' || f2 || ',' || (l.fiscal_year - 1) || ':' || f1 || ',' || l.fiscal_year || ':' || l.filing_id
      else l.fiscal_year || ':' || l.filing_id end as filing_ids
  from filed f left join last l using (company_id) join years y on y.company_id = f.company_id and y.fiscal_year = f.filed
), financial as (
  select *, case when not three then 'unknown' when positive_profit_years = 3 then 'core' when positive_profit_years = 2 and op > 0 then 'borderline' else 'weak' end as quality_band,
    case when three and latest_year = filed and len(issues) = 0 then 'complete' else 'needs_data' end as evidence_status,
    three_year_revenue_cagr between -0.02 and 0.03 as stable_revenue
  from signal
), c_once as (
  select *, lead(fiscal_year, 1) over w as y1, lead(fiscal_year, 2) over w as y2, lead(revenue, 2) over w as rev2, row_number() over w as k
  from years where n_rev = 1 window w as (partition by company_id order by fiscal_year desc)
), cash as (
  select f.company_id, fiscal_year as cash_year, ebitda::double / revenue::double as latest_ebitda_margin,
    case when y1 = fiscal_year - 1 and y2 = fiscal_year - 2 then pow(revenue::double / rev2::double, 0.5) - 1 end as cash_revenue_cagr,
    list_filter([case when c.company_id is null then 'No comparable standalone EUR revenue reported' end,
      case when c.company_id is not null and ebitda is null then 'EBITDA is not available for FY' || fiscal_year || ', the latest comparable year' end,
      case when c.company_id is not null and not coalesce(y1 = fiscal_year - 1 and y2 = fiscal_year - 2, false) then 'Three consecutive comparable fiscal years unavailable for revenue CAGR' end], lambda x: x is not null) as cash_issues
  from filed f left join (select * from c_once where k = 1) c using (company_id)
), harvest as (
  select *, coalesce(latest_ebitda_margin is not null and cash_revenue_cagr between -0.02 and 0.03 and latest_ebitda_margin > 0.15, false) as cash_harvesting_candidate,
    case when latest_ebitda_margin is not null and cash_revenue_cagr is not null then 'evaluated' else 'insufficient_evidence' end as cash_evidence_status
  from cash
)"""

FUNNEL = f"""with {COMPANIES}, {SIGNAL}, grp as (
  select company_id, fiscal_year, bool_or(statement_scope = 'consolidated') as parent,
    case when count(*) filter (where statement_scope = 'consolidated' and currency = 'EUR' and revenue is not null) = 1
      then max(revenue) filter (where statement_scope = 'consolidated' and currency = 'EUR') end::double as consolidated_revenue
  from cur group by all
), base as (
  select c.company_id, c.legal_name, c.registry_status, left(c.industry_code, 2) as peer_group,
    coalesce(f.focus_band, 'unknown') as focus_band, coalesce(f.quality_band, 'unknown') as quality_band, coalesce(f.evidence_status, 'needs_data') as evidence_status,
    f.latest_year, f.latest_revenue_eur, f.latest_operating_margin, f.three_year_median_margin, f.three_year_revenue_cagr, f.positive_profit_years, f.latest_equity_ratio, f.latest_employees_fte,
    coalesce(h.cash_harvesting_candidate, false) as cash, coalesce(g.parent, false) as group_parent, g.consolidated_revenue,
    coalesce(c.industry_code like '642%' or c.industry_code like '7010%', false) as holding,
    coalesce(lower(trim(c.registry_status)) in ('r', 'registered', 'registrisse kantud'), false) as registered,
    coalesce(lower(trim(c.registry_status)) in ('l', 'n', 'k'), false) as inactive,
    case when c.company_id % 3 = 0 then ['coasting', 'decaying', 'watch', 'active', 'insufficient_evidence'][c.company_id % 5 + 1] end as verdict,
    list_concat(coalesce(f.issues, ['No current annual financial rows']), case when c.registry_status is null then ['Current registry status unavailable'] else [] end) as issues
  from companies c left join financial f using (company_id) left join harvest h using (company_id) left join grp g on g.company_id = c.company_id and g.fiscal_year = f.latest_year
), acted as (
  select *, case when inactive then 'exclude' when focus_band = 'adjacent' then 'outside_size_band'
      when focus_band = 'core' and quality_band = 'core' and evidence_status = 'complete' and registered and not holding then 'advisor_review' else 'research' end as next_action,
    peer_group is not null and focus_band = 'core' and evidence_status = 'complete' and three_year_median_margin is not null and latest_equity_ratio is not null and registered and not holding as is_peer,
    case when verdict = 'coasting' then 0 when verdict = 'decaying' then 1 when verdict = 'watch' then 2 when verdict = 'active' then 4 else 3 end as tier
  from base
), centre as (
  select peer_group, count(*) as peer_count, median(three_year_median_margin) as mm, median(latest_equity_ratio) as em from acted where is_peer group by all having count(*) >= 8
), spread as (
  select a.peer_group, 1.4826 * median(abs(three_year_median_margin - mm)) as ms, 1.4826 * median(abs(latest_equity_ratio - em)) as es
  from acted a join centre using (peer_group) where is_peer group by all
), z as (
  select a.*, c.peer_count, case when ms <> 0 then greatest(-3, least(3, (three_year_median_margin - mm) / ms)) end as mz,
    case when es <> 0 then greatest(-3, least(3, (latest_equity_ratio - em) / es)) end as ez
  from acted a left join centre c on a.is_peer and a.peer_group = c.peer_group left join spread s on a.is_peer and a.peer_group = s.peer_group
), items as (
  select *, 0.7 * mz + 0.3 * ez as raw_index, round(0.7 * mz + 0.3 * ez, 2) as idx from z
)"""


def v23(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = signals.financial_signal(statements(spark, sf_dir), *BAND, YEAR)
    doubles = ["latest_revenue_eur", "latest_operating_margin", "three_year_median_margin", "three_year_revenue_cagr", "latest_equity_ratio", "latest_employees_fte"]
    return df.select(
        "company_id", "latest_year", *map(_r, doubles), "positive_profit_years", "stable_revenue", "focus_band", "quality_band", "evidence_status",
        F.array_join("filing_ids", ",").alias("filing_ids"), F.array_join("issues", "|").alias("issues"),
    )


V23 = f"""with {SIGNAL} select company_id, latest_year, round(latest_revenue_eur, 6) as latest_revenue_eur, round(latest_operating_margin, 6) as latest_operating_margin,
  round(three_year_median_margin, 6) as three_year_median_margin, round(three_year_revenue_cagr, 6) as three_year_revenue_cagr, round(latest_equity_ratio, 6) as latest_equity_ratio,
  round(latest_employees_fte, 6) as latest_employees_fte, positive_profit_years, stable_revenue, focus_band, quality_band, evidence_status, filing_ids, array_to_string(issues, '|') as issues from financial"""


def v24(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = signals.cash_harvesting(statements(spark, sf_dir))
    return df.select("company_id", "cash_year", _r("latest_ebitda_margin"), _r("cash_revenue_cagr"), "cash_evidence_status", "cash_harvesting_candidate", F.array_join("cash_issues", "|").alias("cash_issues"))


V24 = f"""with {SIGNAL} select company_id, cash_year, round(latest_ebitda_margin, 6) as latest_ebitda_margin, round(cash_revenue_cagr, 6) as cash_revenue_cagr,
  cash_evidence_status, cash_harvesting_candidate, array_to_string(cash_issues, '|') as cash_issues from harvest"""


def v28(spark: SparkSession, sf_dir: str, view: str = "all") -> DataFrame:
    df = items(spark, sf_dir)
    df = df.where(funnel.is_listed_cash()) if view == "cash_harvesting" else df
    return df.select(
        "company_id", "legal_name", "registry_status", "peer_group", "focus_band", "quality_band", "evidence_status", "next_action", "latest_year", "positive_profit_years", "peer_count",
        _r("latest_revenue_eur"), _r("three_year_median_margin"), _r("three_year_revenue_cagr"), _r("margin_peer_z"), _r("equity_peer_z"), _r("consolidated_revenue"),
        F.array_join("flags", ",").alias("flags"), F.array_join("issues", "|").alias("issues"), funnel.decay_tier(F.col("verdict")).alias("tier"),
    ).orderBy("company_id")


V28 = FUNNEL + """ select company_id, legal_name, registry_status, peer_group, focus_band, quality_band, evidence_status, next_action, latest_year, positive_profit_years, peer_count,
  round(latest_revenue_eur, 6) as latest_revenue_eur, round(three_year_median_margin, 6) as three_year_median_margin, round(three_year_revenue_cagr, 6) as three_year_revenue_cagr,
  round(mz, 6) as margin_peer_z, round(ez, 6) as equity_peer_z, round(consolidated_revenue, 6) as consolidated_revenue,
  array_to_string(list_filter([case when group_parent then 'group_parent' end, case when holding then 'holding_activity' end, case when cash then 'cash_harvesting_candidate' end], lambda x: x is not null), ',') as flags,
  array_to_string(issues, '|') as issues, tier from items"""


def o03(spark: SparkSession, sf_dir: str, view: str = "all") -> DataFrame:
    top = funnel.listed(items(spark, sf_dir), view)
    return top.select("company_id", "legal_name", "next_action", funnel.decay_tier(F.col("verdict")).alias("tier"))


def _o03(keys: str, where: str) -> str:
    return f"{FUNNEL} select company_id, legal_name, next_action, tier from items where {where} order by {keys}, coalesce(idx, -99) desc, lower(legal_name), company_id"


ACTION = "case next_action when 'advisor_review' then 0 when 'research' then 1 when 'outside_size_band' then 2 else 3 end"


def a05(spark: SparkSession, sf_dir: str, view: str) -> DataFrame:
    return funnel.stages(items(spark, sf_dir), view, hide_active=True)


def _stages(rules: list[tuple[str, str]]) -> str:
    rows, so_far = [], "true"
    for k, (name, rule) in enumerate(rules):
        so_far += f" and {rule}"
        rows.append(f"select {k} as position, '{name}' as stage, count(*) filter (where {so_far}) as n from items")
    return FUNNEL + " " + " union all ".join(rows)


A05 = _stages([
    ("imported", "true"), ("registered", "registered"), ("in_size_band", "focus_band = 'core'"), ("complete_evidence", "evidence_status = 'complete'"),
    ("profitable", "coalesce(positive_profit_years = 3, false)"), ("advisor_review", "next_action = 'advisor_review'"), ("decay_flagged", "tier < 3"),
])
A05_CASH = _stages([
    ("imported", "true"), ("not_inactive", "not inactive"), ("cash_harvesting", "cash"), ("website_not_active", "coalesce(verdict <> 'active', true)"), ("decay_flagged", "tier < 3"),
])

A06 = FUNNEL + """ select count(*) as total_companies, count(*) filter (where focus_band = 'core') as core_size,
  count(*) filter (where focus_band = 'core' and positive_profit_years = 3 and evidence_status = 'complete') as three_year_profitable,
  count(*) filter (where next_action = 'advisor_review') as advisor_review, count(*) filter (where next_action = 'advisor_review' and verdict is not null) as advisor_review_decay_checked,
  count(*) filter (where next_action = 'advisor_review' and tier < 3) as advisor_review_decay_flagged, count(*) filter (where cash and not inactive) as listed_companies,
  count(*) filter (where cash and not inactive) as cash_harvesting_candidates, count(*) filter (where cash and not inactive and verdict is not null) as listed_decay_checked,
  count(*) filter (where cash and not inactive and tier < 3) as listed_decay_flagged from items"""

A01 = f"""with {COMPANIES}, sizes as (select left(industry_code, 2) as code, count(*) as n from companies group by all),
  folded as (select case when n >= 10 and code is not null then code else 'others' end as code, n from sizes union all select 'others', 0)
  select code, sum(n)::bigint as n from folded group by all"""


def a02(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = companies(spark, sf_dir).select("sector", F.col("balance").cast("double").alias("b"))
    return signals.robust_reference(df, "sector", "b").select("sector", "peer_count", _r("b_median"), _r("b_spread"))


A02 = f"""with {COMPANIES}, m as (select sector, count(*) as peer_count, median(balance::double) as b_median from companies group by all)
  select sector, peer_count, round(b_median, 6) as b_median, round(1.4826 * median(abs(balance::double - b_median)), 6) as b_spread from companies join m using (sector) group by all"""


def a04(spark: SparkSession, sf_dir: str) -> DataFrame:
    three = signals.financial_signal(statements(spark, sf_dir), *BAND, YEAR)
    return three.where("three_year_median_margin is not null").select("company_id", _r("three_year_median_margin"))


def w01(spark: SparkSession, sf_dir: str) -> DataFrame:
    return signals.unique_years(statements(spark, sf_dir), signals.comparable()).select("company_id", "fiscal_year", F.col("revenue").cast("double").alias("revenue"))


def w03(spark: SparkSession, sf_dir: str) -> DataFrame:
    three = signals.financial_signal(statements(spark, sf_dir), *BAND, YEAR)
    return three.where("three_year_revenue_cagr is not null").select("company_id", "latest_year", _r("three_year_revenue_cagr"), "stable_revenue", "positive_profit_years")


def w08(spark: SparkSession, sf_dir: str) -> DataFrame:
    return items(spark, sf_dir).where("peer_count is not null").select("company_id", "peer_group", "peer_count", _r("margin_peer_z"), _r("equity_peer_z"))


def m07(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = 0.7 * F.col("margin_peer_z") + 0.3 * F.col("equity_peer_z")
    return items(spark, sf_dir).where("peer_count is not null").select("company_id", F.round(raw, 6).alias("raw_index"))


def a17(spark: SparkSession, sf_dir: str) -> DataFrame:
    return signals.headcount_trend(statements(spark, sf_dir))


A17 = f"""with {STATEMENTS}, ok as (
  select company_id, fiscal_year, max(employees_fte) as fte from financials where review_status <> 'superseded' and period_end - period_start between 364 and 365 and employees_fte is not null
    and statement_scope <> 'consolidated' group by all
), r as (select *, row_number() over (partition by company_id order by fiscal_year desc) as k from ok
), l as (select company_id, list(struct_pack(y := fiscal_year, f := fte) order by fiscal_year desc) as p from r where k <= 4 group by all
), b as (select company_id, p[1].y as latest_year, p[1].f as lf, coalesce(list_filter(p, lambda x: x.y = p[1].y - 3)[1], case when len(p) >= 3 then p[-1] end) as base from l
), c as (select *, round(100 * (lf - base.f)::double / nullif(base.f, 0)::double, 1) as change_pct from b)
  select company_id, latest_year, base.y as base_year, lf::double as latest_fte, base.f::double as base_fte, change_pct,
    case when change_pct is null then 'unknown' when change_pct >= 10 then 'growing' when change_pct <= -10 then 'shrinking' else 'flat' end as state from c"""


def a18(spark: SparkSession, sf_dir: str) -> DataFrame:
    return signals.latest_revenue(statements(spark, sf_dir))


A18 = f"""with {STATEMENTS}, ok as (select *, row_number() over (partition by company_id order by fiscal_year desc, filing_id desc) as k from financials
  where review_status <> 'superseded' and revenue is not null and currency = 'EUR' and period_end - period_start between 364 and 365)
  select company_id, fiscal_year, floor(revenue)::bigint as amount, statement_scope from ok where k = 1"""


def m13(spark: SparkSession, sf_dir: str) -> DataFrame:
    return signals.consolidated(statements(spark, sf_dir)).where("files_consolidated")


M13 = f"""with {STATEMENTS} select company_id, fiscal_year, true as files_consolidated,
  case when count(*) filter (where currency = 'EUR' and revenue is not null) = 1 then max(revenue) filter (where currency = 'EUR') end::double as consolidated_revenue
  from financials where review_status <> 'superseded' and statement_scope = 'consolidated' group by all"""


def f05(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = statements(spark, sf_dir).withColumn("f05", signals.comparable()).withColumn("f06", signals.comparable_revenue())
    return df.groupBy("fiscal_year", "f05", "f06").agg(F.count("*").alias("n"))


F05 = f"""with {STATEMENTS}, t as (select *, statement_scope = 'standalone' and currency = 'EUR' and unit = 'EUR' and period_end - period_start + 1 between 330 and 400 and revenue > 0 as f06 from financials)
  select fiscal_year, f06 and operating_profit is not null as f05, f06, count(*) as n from t group by all"""


def n30(spark: SparkSession, sf_dir: str) -> DataFrame:
    return funnel.brief(items(spark, sf_dir), *BAND).select("company_id", F.array_join("review_reasons", "; ").alias("review_reasons"))


def v27(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = items(spark, sf_dir)
    options = funnel.sector_options(with_codes(companies(spark, sf_dir)))
    return funnel.in_sector(found, options, "others").select("company_id", "peer_group")


V27 = f"""with {COMPANIES}, sizes as (select left(industry_code, 2) as g, count(*) as n from companies group by all having count(*) >= 10)
  select company_id, left(industry_code, 2) as peer_group from companies where left(industry_code, 2) is null or left(industry_code, 2) not in (select g from sizes where g is not null)"""

COLLECT = "select company_id, {cols} from financial where {where}"

QUERIES = {
    "F05_comparable": f05,
    "W01_unique_years": w01,
    "W03_cagr": w03,
    "W08_peer_z": w08,
    "A01_sector_options": lambda s, d: funnel.sector_options(with_codes(companies(s, d))),
    "A02_robust_reference": a02,
    "A03_peer_groups": lambda s, d: funnel.peer_groups(items(s, d)).select("peer_group", "peer_count", _r("median_margin"), _r("median_equity_ratio")),
    "A04_median_margin": a04,
    "A05_funnel_stages": lambda s, d: a05(s, d, "all"),
    "A05_funnel_stages_cash": lambda s, d: a05(s, d, "cash_harvesting"),
    "A06_header_counts": lambda s, d: funnel.header_counts(items(s, d), "cash_harvesting"),
    "A17_headcount_trend": a17,
    "A18_latest_revenue": a18,
    "M07_peer_index": m07,
    "M13_consolidated": m13,
    "O03_ranking_all": lambda s, d: o03(s, d, "all"),
    "O04_ranking_cash": lambda s, d: o03(s, d, "cash_harvesting"),
    "V23_financial_signal": v23,
    "V24_cash_harvesting": v24,
    "V27_sector_filter": v27,
    "V28_seller_funnel": v28,
    "N30_brief": n30,
}
ORACLES = {
    "F05_comparable": F05,
    "W01_unique_years": f"with {SIGNAL} select company_id, fiscal_year, revenue::double as revenue from years where n_op = 1",
    "W03_cagr": f"with {SIGNAL} select company_id, latest_year, round(three_year_revenue_cagr, 6) as three_year_revenue_cagr, stable_revenue, positive_profit_years from financial where three",
    "W08_peer_z": FUNNEL + " select company_id, peer_group, peer_count, round(mz, 6) as margin_peer_z, round(ez, 6) as equity_peer_z from items where peer_count is not null",
    "A01_sector_options": A01,
    "A02_robust_reference": A02,
    "A03_peer_groups": FUNNEL + " select peer_group, peer_count, round(mm, 6) as median_margin, round(em, 6) as median_equity_ratio from centre",
    "A04_median_margin": f"with {SIGNAL} select company_id, round(three_year_median_margin, 6) as three_year_median_margin from financial where three",
    "A05_funnel_stages": A05,
    "A05_funnel_stages_cash": A05_CASH,
    "A06_header_counts": A06,
    "A17_headcount_trend": A17,
    "A18_latest_revenue": A18,
    "M07_peer_index": FUNNEL + " select company_id, round(raw_index, 6) as raw_index from items where peer_count is not null",
    "M13_consolidated": M13,
    "O03_ranking_all": _o03(f"{ACTION}, tier", "true"),
    "O04_ranking_cash": _o03(f"tier, {ACTION}", "cash and not inactive"),
    "V23_financial_signal": V23,
    "V24_cash_harvesting": V24,
    "V27_sector_filter": V27,
    "V28_seller_funnel": V28,
}
