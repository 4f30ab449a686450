"""Registered queries about records, facts, identity and quality, with their SQL twins."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from provena.functions import numbers as m
from provena.functions import text as t
from provena.operators import confidence, governance, identity, quality, versions, views
from provena.operators.graph import canonical
from provena.plans.adapters import COMPANIES, FACTS, companies, facts, table

NOW = "2025-06-30"
QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return add


# --- filters and scalar functions over companies --------------------------------------------------


@query(
    "F01_company_list",
    f"""with {COMPANIES} select company_id, legal_name, country, employee_min from companies
  where merged_into_id is null and country in ('EE', 'FI', 'SE') and employee_min >= 5 and employee_min <= 50
    and (contains(lower(legal_name), '1') or false)""",
)
def f01(spark: SparkSession, d: str) -> DataFrame:
    found = quality.company_list(companies(spark, d), countries=["EE", "FI", "SE"], min_employees=5, max_employees=50, search="1")
    return found.select("company_id", "legal_name", "country", "employee_min")


@query("F02_text_search", f"with {COMPANIES} select company_id from companies where merged_into_id is null and contains(lower(legal_name), '42')")
def f02(spark: SparkSession, d: str) -> DataFrame:
    return quality.company_list(companies(spark, d), search="42").select("company_id")


@query(
    "F03_freshness",
    f"""with {COMPANIES} select company_id, case when verified_on is null then 'unknown' when timestamp '{NOW}' - verified_on::timestamp > interval 365 day then 'stale'
  when timestamp '{NOW}' - verified_on::timestamp > interval 180 day then 'aging' else 'fresh' end as freshness from companies""",
)
def f03(spark: SparkSession, d: str) -> DataFrame:
    seen = F.col("verified_on").cast("timestamp")
    return companies(spark, d).select("company_id", m.freshness(seen, F.lit(NOW).cast("timestamp")).alias("freshness"))


@query(
    "F04_status",
    f"""with {COMPANIES} select company_id, coalesce(lower(trim(registry_status)) in ('r', 'registrisse kantud', 'registered'), false) as registered,
  coalesce(lower(trim(registry_status)) in ('l', 'n', 'k'), false) as inactive from companies""",
)
def f04(spark: SparkSession, d: str) -> DataFrame:
    status = F.col("registry_status")
    return companies(spark, d).select("company_id", t.is_registered(status).alias("registered"), t.is_inactive(status).alias("inactive"))


SPELT = [(name, code) for code, names in t.COUNTRY_NAMES.items() for name in names] + [("atlantis", None), ("", None)]


@query("N02_country", f"select c_custkey as company_id, [{', '.join(repr(c) if c else 'null' for _, c in SPELT)}][c_custkey % {len(SPELT)} + 1] as code from customer")
def n02(spark: SparkSession, d: str) -> DataFrame:
    """Every name and code of a country, in capitals or with white space around, and names of none."""
    k = F.col("c_custkey")
    name = F.element_at(F.array(*[F.lit(n) for n, _ in SPELT]), (k % len(SPELT) + 1).cast("int"))
    return table(spark, d, "customer").select(k.alias("company_id"), t.country_code(F.when(k % 2 == 0, F.initcap(name)).otherwise(F.concat(F.lit(" "), F.upper(name), F.lit(" ")))).alias("code"))


@query(
    "N03_region",
    f"""with {COMPANIES} select country, case when country in ('FI', 'SE', 'NO', 'DK', 'IS') then 'nordics' when country in ('DE', 'AT', 'CH') then 'dach' when country = 'EE' then 'baltics' end as region,
  count(*) as n from companies group by all""",
)
def n03(spark: SparkSession, d: str) -> DataFrame:
    return companies(spark, d).groupBy("country").agg(F.count("*").alias("n")).withColumn("region", t.region_of(F.col("country")))


@query(
    "N04_name_key",
    f"""with {COMPANIES} select company_id, trim(regexp_replace(regexp_replace(lower(strip_accents(legal_name)), ' (ou|as|gmbh|oy|ab \\(publ\\))$', ''), '[^a-z0-9 ]', ' ', 'g')) as name_key from companies""",
)
def n04(spark: SparkSession, d: str) -> DataFrame:
    return companies(spark, d).select("company_id", t.name_key(F.col("legal_name")).alias("name_key"))


@query(
    "N05_domain",
    """select page_id, host as domain, 'https://' || host as website, coalesce(host like '%.example.com', false) as on_example
  from (select page_id, regexp_replace(regexp_extract(lower(url), '^[a-z]+://([^/?#:]*)', 1), '^www\\.', '') as host from pages)""",
)
def n05(spark: SparkSession, d: str) -> DataFrame:
    url = F.col("url")
    return table(spark, d, "pages").select("page_id", t.domain_of(url).alias("domain"), t.website_of(url).alias("website"), t.domain_of(url).endswith(".example.com").alias("on_example"))


@query(
    "N06_shared_host",
    f"with {COMPANIES} select company_id, company_id % 4 in (0, 1) as shared from companies",
)
def n06(spark: SparkSession, d: str) -> DataFrame:
    """Every shared host, hosts below them, hosts that end like them, and companies' own."""
    k, n = F.col("company_id"), len(t.SHARED_HOSTS)
    host = F.element_at(F.array(*map(F.lit, t.SHARED_HOSTS)), (F.floor(k / 4) % n + 1).cast("int"))
    own = F.when(k % 4 == 0, host).when(k % 4 == 1, F.concat(F.lit("m"), k.cast("string"), F.lit("."), host)).when(k % 4 == 2, F.concat(F.lit("x"), F.col("domain"))).otherwise(F.concat(host, F.lit(".example")))
    return companies(spark, d).select("company_id", t.is_shared_host(own).alias("shared"))


CHECKED = """with n as (select c_custkey as k, ['EE', 'FI', 'SE', 'NO', 'DK'][c_custkey % 5 + 1] as country, lpad((c_custkey * 7919 % 100000000)::varchar, 8, '0') as d8 from customer
), p as (select *, case country when 'SE' then '55' || d8 when 'NO' then d8 || (k % 10)::varchar else d8 end as d from n
), g as (select *, list_transform(range(len(d)), lambda i: d[i + 1]::int) as x from p
), s as (select *,
  (11 - (x[1]*7 + x[2]*9 + x[3]*10 + x[4]*5 + x[5]*8 + x[6]*4 + x[7]*2) % 11) as fi, (x[1]*1 + x[2]*2 + x[3]*3 + x[4]*4 + x[5]*5 + x[6]*6 + x[7]*7) % 11 as e1,
  (x[1]*3 + x[2]*4 + x[3]*5 + x[4]*6 + x[5]*7 + x[6]*8 + x[7]*9) % 11 as e2,
  (11 - (x[1]*3 + x[2]*2 + x[3]*7 + x[4]*6 + x[5]*5 + x[6]*4 + x[7]*3 + x[8]*2) % 11) as no,
  list_sum(list_transform(range(10), lambda i: case when i % 2 = 0 then case when x[i+1] * 2 > 9 then x[i+1] * 2 - 9 else x[i+1] * 2 end else x[i+1] end)) % 10 as luhn from g)
select k as company_id, country, case country
  when 'EE' then case when x[8] = case when e1 <> 10 then e1 when e2 <> 10 then e2 else 0 end then 'EE:' || d end
  when 'FI' then case when fi <> 10 and x[8] = fi % 11 then 'FI:' || d[1:7] || '-' || d[8] end
  when 'SE' then case when luhn = 0 then 'SE:' || d[1:6] || '-' || d[7:10] end
  when 'NO' then case when no <> 10 and x[9] = no % 11 then 'NO:' || d end
  when 'DK' then 'DK:' || d end as registry_key from s"""


def _numbers(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("c_custkey")
    country = F.element_at(F.array(*map(F.lit, ["EE", "FI", "SE", "NO", "DK"])), (k % 5 + 1).cast("int"))
    d8 = F.lpad((k * 7919 % 100000000).cast("string"), 8, "0")
    number = F.when(country == "SE", F.concat(F.lit("55"), d8)).when(country == "NO", F.concat(d8, (k % 10).cast("string"))).otherwise(d8)
    return table(spark, d, "customer").select(k.alias("company_id"), country.alias("country"), number.alias("number"))


@query("N08_registry_key", CHECKED)
def n08(spark: SparkSession, d: str) -> DataFrame:
    return _numbers(spark, d).select("company_id", "country", t.registry_key(F.col("country"), F.col("number"))["canonical"].alias("registry_key"))


@query(
    "N09_vat_key",
    """select c_custkey as company_id, case when c_custkey % 3 = 0 then 'DE' || lpad((c_custkey * 31 % 1000000000)::varchar, 9, '0') when c_custkey % 3 = 1 then 'CHE' || lpad((c_custkey * 31 % 1000000000)::varchar, 9, '0') end as vat_key from customer""",
)
def n09(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("c_custkey")
    number = F.lpad((k * 31 % 1000000000).cast("string"), 9, "0")
    raw = F.when(k % 3 == 0, F.concat(F.lit("de "), number)).when(k % 3 == 1, F.concat(F.lit("CHE-"), number, F.lit(" MWST"))).otherwise(F.concat(F.lit("AT"), number))
    country = F.element_at(F.array(*map(F.lit, ["DE", "CH", "AT"])), (k % 3 + 1).cast("int"))
    return table(spark, d, "customer").select(k.alias("company_id"), t.vat_key(country, raw).alias("vat_key"))


@query(
    "N11_contacts",
    """select c_custkey as company_id, case when c_custkey % 2 = 0 then 'info' || c_custkey || '@firm.ee' end as email,
  case when c_custkey % 3 = 0 then '+3725' || lpad(c_custkey::varchar, 6, '0') when c_custkey % 3 = 1 then '+5' || lpad(c_custkey::varchar, 6, '0') end as phone from customer""",
)
def n11(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("c_custkey")
    mail = F.concat(F.lit(" Info"), k.cast("string"), F.when(k % 2 == 0, "@Firm.ee ").otherwise("@firm"))
    six = F.lpad(k.cast("string"), 6, "0")
    phone = F.when(k % 3 == 0, F.concat(F.lit("00372 5"), six)).when(k % 3 == 1, F.concat(F.lit("+5 "), six)).otherwise("12-34")
    return table(spark, d, "customer").select(k.alias("company_id"), t.email_of(mail).alias("email"), t.phone_of(phone).alias("phone"))


OWNED = [(w, w) for w in t.OWNERSHIP] + list(t.OWNERSHIP_ALIASES.items()) + [("owned by nobody", None)]


@query("N12_ownership", f"select c_custkey as company_id, [{', '.join(repr(v) if v else 'null' for _, v in OWNED)}][c_custkey % {len(OWNED)} + 1] as ownership from customer")
def n12(spark: SparkSession, d: str) -> DataFrame:
    """Every ownership type and alias, in capitals, with spaces or underscores, or with white space around."""
    k = F.col("c_custkey")
    raw = F.element_at(F.array(*[F.lit(w) for w, _ in OWNED]), (k % len(OWNED) + 1).cast("int"))
    spelt = F.when(k % 3 == 0, F.upper(raw)).when(k % 3 == 1, F.replace(raw, F.lit("-"), F.lit("_"))).otherwise(F.concat(F.lit(" "), F.replace(raw, F.lit("-"), F.lit(" ")), F.lit("  ")))
    return table(spark, d, "customer").select(k.alias("company_id"), t.ownership_of(spelt).alias("ownership"))


@query("N15_division", f"with {COMPANIES} select company_id, left(industry_code, 2) as division, coalesce(industry_code like '642%' or industry_code like '7010%', false) as holding from companies")
def n15(spark: SparkSession, d: str) -> DataFrame:
    codes = F.when(F.col("industry_code").isNotNull(), F.array(F.lit("A"), F.col("industry_code")))
    return companies(spark, d).select("company_id", t.industry_division(codes).alias("division"), t.is_holding(codes).alias("holding"))


@query(
    "M01_employee_range",
    """select c_custkey as company_id, case c_custkey % 6 when 0 then c_custkey when 1 then c_custkey when 2 then 250 when 3 then 1200 when 4 then c_custkey end as lo,
  case c_custkey % 6 when 0 then c_custkey when 1 then c_custkey + 29 when 3 then 1200 when 4 then c_custkey + 1 end as hi from customer""",
)
def m01(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("c_custkey")
    text = (
        F.when(k % 6 == 0, k.cast("string")).when(k % 6 == 1, F.concat_ws(" – ", k, k + 29)).when(k % 6 == 2, "250+").when(k % 6 == 3, "ca 1 200 inimest")
        .when(k % 6 == 4, F.concat(k.cast("string"), F.lit(",5"))).otherwise("unknown")
    )
    return table(spark, d, "customer").select(k.alias("company_id"), m.employee_range(text).alias("r")).select("company_id", "r.*")


@query(
    "M02_money",
    """select c_custkey as company_id, case c_custkey % 5 when 0 then c_custkey * 1000000 when 1 then c_custkey * 1000 when 2 then c_custkey when 3 then c_custkey * 1000000 end as lo,
  case c_custkey % 5 when 0 then c_custkey * 1000000 when 1 then c_custkey * 1000 when 2 then c_custkey when 3 then (c_custkey + 2) * 1000000 end as hi from customer""",
)
def m02(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("c_custkey")
    s = k.cast("string")
    text = F.when(k % 5 == 0, F.concat(s, F.lit(" Mio"))).when(k % 5 == 1, F.concat(s, F.lit("k"))).when(k % 5 == 2, s).when(k % 5 == 3, F.concat(s, F.lit("-"), (k + 2).cast("string"), F.lit("m"))).otherwise("n/a")
    return table(spark, d, "customer").select(k.alias("company_id"), m.money(text).alias("r")).select("company_id", "r.*")


@query(
    "M03_parsing",
    """select o_orderkey, o_orderdate::date::varchar as day, o_totalprice::decimal(20,2)::double as amount, case o_orderstatus when 'F' then true when 'O' then false end as flag from orders""",
)
def m03(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("o_orderkey")
    day = F.when(k % 2 == 0, F.date_format("o_orderdate", "dd.MM.yyyy")).otherwise(F.date_format("o_orderdate", "yyyy-MM-dd"))
    amount = F.replace(F.col("o_totalprice").cast("decimal(20,2)").cast("string"), F.lit("."), F.lit(","))
    flag = F.when(F.col("o_orderstatus") == "F", " Jah").when(F.col("o_orderstatus") == "O", "EI").otherwise("?")
    return table(spark, d, "orders").select(
        "o_orderkey", m.date_of(day).cast("string").alias("day"), m.decimal_of(amount).cast("double").alias("amount"), m.yes_no(flag).alias("flag")
    )


@query(
    "M04_period_class",
    """with p as (select o_orderkey, (o_orderkey % 500 - 10)::bigint as days from orders)
  select o_orderkey, days, case when days <= 0 then 'invalid' when days < 365 then 'short' when days <= 366 then 'standard_12_month' else 'long' end as kind from p""",
)
def m04(spark: SparkSession, d: str) -> DataFrame:
    start = F.col("o_orderdate").cast("date")
    end = F.date_add(start, (F.col("o_orderkey") % 500 - 11).cast("int"))
    return table(spark, d, "orders").select("o_orderkey", m.period_days(start, end).cast("bigint").alias("days"), m.period_class(start, end).alias("kind"))


@query(
    "M09_months_between",
    """select o_orderkey, ((2002 - year(o_orderdate)) * 12 + 3 - month(o_orderdate) - case when 15 < day(o_orderdate) then 1 else 0 end)::bigint as months from orders""",
)
def m09(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "orders").select("o_orderkey", m.months_between(F.col("o_orderdate").cast("date"), F.lit("2002-03-15").cast("date")).cast("bigint").alias("months"))


@query(
    "M12_qualification",
    f"""with {COMPANIES} select company_id, case when employee_min is null then 'unknown_headcount' when employee_min >= 20 then 'qualified' when employee_max is null or employee_max >= 20 then 'borderline'
  when employee_max <= 2 then 'sub_scale' else 'below_threshold' end as qualification from companies""",
)
def m12(spark: SparkSession, d: str) -> DataFrame:
    return companies(spark, d).select("company_id", m.qualification(F.col("employee_min"), F.col("employee_max")).alias("qualification"))


@query("N27_redact", "select event_id, 'user [redacted] called [redacted]' as line from events")
def n27(spark: SparkSession, d: str) -> DataFrame:
    line = F.concat(F.lit("user u"), F.col("user_id").cast("string"), F.lit("@firm.ee called +372 5"), F.lpad(F.col("event_id").cast("string"), 7, "0"))
    return table(spark, d, "events").select("event_id", t.redact(line).alias("line"))


# --- joins, windows, sorting, sets -----------------------------------------------------------------


@query(
    "J02_current_status",
    f"with {FACTS}, r as (select *, row_number() over (partition by company_id order by observed_at desc, fact_id desc) as k from facts where field_name = 'click') select company_id, value, fact_id from r where k = 1",
)
def j02(spark: SparkSession, d: str) -> DataFrame:
    return views.current_value(facts(spark, d), "click")


@query("J07_has_source", f"with {COMPANIES}, {FACTS} select company_id from companies where company_id in (select company_id from facts where source_id = 'src1')")
def j07(spark: SparkSession, d: str) -> DataFrame:
    return views.having_source(companies(spark, d), facts(spark, d), "src1").select("company_id")


@query(
    "J09_latest_year_band",
    """with y as (select o_custkey, year(o_orderdate) as y, sum(o_totalprice::decimal(20,2)) as r from orders group by all), l as (select o_custkey, max(y) as y from y group by all)
  select o_custkey as company_id, y::int as fiscal_year, r::double as revenue from y join l using (o_custkey, y) where r between 100000 and 600000""",
)
def j09(spark: SparkSession, d: str) -> DataFrame:
    y = table(spark, d, "orders").groupBy(F.col("o_custkey").alias("company_id"), F.year("o_orderdate").alias("fiscal_year")).agg(F.sum(F.col("o_totalprice").cast("decimal(20,2)")).alias("revenue"))
    latest = versions.current(y, ["company_id"], F.desc("fiscal_year"))
    return latest.where(F.col("revenue").between(100_000, 600_000)).withColumn("revenue", F.col("revenue").cast("double"))


@query(
    "J10_two_key_lookup",
    """select l.l_orderkey, l.l_linenumber, coalesce(a.p_partkey, b.p_partkey) as matched, case when a.p_partkey is not null then 'id' when b.p_partkey is not null then 'document' end as via
  from lineitem l left join part a on a.p_partkey = l.l_partkey and a.p_size > 25 left join part b on b.p_partkey = l.l_suppkey""",
)
def j10(spark: SparkSession, d: str) -> DataFrame:
    part = table(spark, d, "part").select(F.col("p_partkey").alias("key"), "p_size")
    line = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")
    return views.resolve_report(line, part.where("p_size > 25"), part, "l_partkey", "l_suppkey").select("l_orderkey", "l_linenumber", "matched", "via")


@query("J12_orphans", "select distinct o_custkey as company_id from orders where o_custkey not in (select c_custkey from customer where c_custkey % 10 <> 0)")
def j12(spark: SparkSession, d: str) -> DataFrame:
    known = table(spark, d, "customer").where("c_custkey % 10 <> 0").select(F.col("c_custkey").alias("company_id"))
    return views.orphans(table(spark, d, "orders").select(F.col("o_custkey").alias("company_id")), known, "company_id")


@query("J22_merge_chain", "select c_custkey as company_id, case when c_custkey % 97 = 0 then c_custkey - 1 else c_custkey end as root from customer")
def j22(spark: SparkSession, d: str) -> DataFrame:
    return canonical(companies(spark, d).select(F.col("company_id").alias("id"), F.col("merged_into_id").alias("to"))).select(F.col("id").alias("company_id"), "root")


@query("J23_shared_domains", f"with {COMPANIES}, n as (select domain, count(distinct company_id) as n_companies from companies group by all) select company_id, domain, n_companies from companies join n using (domain) where n_companies > 1")
def j23(spark: SparkSession, d: str) -> DataFrame:
    c = companies(spark, d).select("company_id", "domain")
    return c.join(quality.domain_counts(c).where("n_companies > 1"), "domain")


@query("A25_domain_counts", f"with {COMPANIES} select domain, count(distinct company_id) as n_companies from companies group by all")
def a25(spark: SparkSession, d: str) -> DataFrame:
    return quality.domain_counts(companies(spark, d))


@query(
    "W05_in_file_duplicates",
    """with r as (select *, min(event_id) over (partition by user_id, event_type, floor(value)::bigint) as first_row from events)
  select event_id, first_row, event_id <> first_row as duplicate from r""",
)
def w05(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events").select("event_id", "user_id", "event_type", "value")
    return views.in_file_duplicates(e, "event_id", F.col("user_id"), F.col("event_type"), F.floor("value")).select("event_id", "first_row", "duplicate")


@query(
    "W06_current_row",
    f"with {FACTS}, r as (select *, row_number() over (partition by company_id, source_id, field_name order by observed_at desc, fact_id) as k from facts) select company_id, source_id, field_name, value, fact_id from r where k = 1",
)
def w06(spark: SparkSession, d: str) -> DataFrame:
    now = versions.current(facts(spark, d), ["company_id", "source_id", "field_name"], F.desc("observed_at"), F.col("fact_id"))
    return now.select("company_id", "source_id", "field_name", "value", "fact_id")


@query(
    "O01_page",
    f"with {COMPANIES} select company_id, legal_name, employee_min from companies where merged_into_id is null order by employee_min desc nulls last, legal_name, company_id limit 50 offset 100",
)
def o01(spark: SparkSession, d: str) -> DataFrame:
    return quality.page(quality.company_list(companies(spark, d)), "employee_min", True, 100, 50).select("company_id", "legal_name", "employee_min")


@query("O07_batch", "select o_orderkey, year(o_orderdate)::int as y from orders order by year(o_orderdate) desc, o_totalprice desc, o_orderkey limit 200")
def o07(spark: SparkSession, d: str) -> DataFrame:
    y = F.year("o_orderdate")
    return table(spark, d, "orders").orderBy(y.desc(), F.desc("o_totalprice"), "o_orderkey").limit(200).select("o_orderkey", y.alias("y"))


@query(
    "O12_timeline",
    """select user_id as company_id, strftime(ts, '%Y-%m-%d %H:%M:%S') as at, 'fact' as kind, event_id as id from events union all
  select o_custkey, strftime(o_orderdate, '%Y-%m-%d %H:%M:%S'), 'audit', o_orderkey from orders""",
)
def o12(spark: SparkSession, d: str) -> DataFrame:
    a = table(spark, d, "events").select(F.col("user_id").alias("company_id"), F.col("ts").alias("t"), F.lit("fact").alias("kind"), F.col("event_id").alias("id"))
    b = table(spark, d, "orders").select(F.col("o_custkey").alias("company_id"), F.col("o_orderdate").alias("t"), F.lit("audit").alias("kind"), F.col("o_orderkey").alias("id"))
    return views.timeline(a, b).select("company_id", F.date_format("t", "yyyy-MM-dd HH:mm:ss").alias("at"), "kind", "id")


@query("U01_union_of_codes", "select o_custkey as code from orders union select user_id from events")
def u01(spark: SparkSession, d: str) -> DataFrame:
    return views.union_of_codes(table(spark, d, "orders").select(F.col("o_custkey").alias("code")), table(spark, d, "events").select("user_id"))


@query("U04_missing", "select distinct c_custkey as code from customer except select o_custkey from orders")
def u04(spark: SparkSession, d: str) -> DataFrame:
    return views.missing(table(spark, d, "customer").select(F.col("c_custkey").alias("code")), table(spark, d, "orders").select("o_custkey"))


# --- facts over time -------------------------------------------------------------------------------

KEYS = ["company_id", "source_id", "field_name"]


def _batches(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    f = facts(spark, d)
    newest = lambda x: versions.current(x, KEYS, F.desc("observed_at"), F.col("fact_id"))
    return newest(f.where("fact_id % 2 = 0")), newest(f.where("fact_id % 2 = 1"))


@query(
    "V01_scd2_merge",
    f"""with {FACTS}, r as (select *, fact_id % 2 as half, row_number() over (partition by company_id, source_id, field_name, fact_id % 2 order by observed_at desc, fact_id) as k from facts
), a as (select company_id, source_id, field_name, value as old, observed_at as old_at from r where k = 1 and half = 0
), b as (select company_id, source_id, field_name, value as new, observed_at as new_at from r where k = 1 and half = 1
), j as (select company_id, source_id, field_name, old, new, old_at, new_at, case when old_at is null then 'new' when new_at is null then 'kept' when old is not distinct from new then 'unchanged' else 'changed' end as outcome
  from a full outer join b using (company_id, source_id, field_name))
  select company_id, source_id, field_name, outcome, case when outcome = 'kept' then old else new end as value,
    strftime(case outcome when 'unchanged' then greatest(old_at, new_at) when 'kept' then old_at else new_at end, '%Y-%m-%d %H:%M:%S') as observed_at,
    strftime(case when outcome = 'changed' then new_at end, '%Y-%m-%d %H:%M:%S') as closes_old_at from j""",
)
def v01(spark: SparkSession, d: str) -> DataFrame:
    stored, incoming = _batches(spark, d)
    stamp = lambda c: F.date_format(c, "yyyy-MM-dd HH:mm:ss").alias(c)
    return versions.merge(stored, incoming, KEYS, "value", "observed_at").select(*KEYS, "outcome", "value", stamp("observed_at"), stamp("closes_old_at"))


@query(
    "A24_outcome_counts",
    None,
)
def a24(spark: SparkSession, d: str) -> DataFrame:
    return views.outcome_counts(v01(spark, d))


ORACLES["A24_outcome_counts"] = f"select source_id, outcome, count(*) as n from ({ORACLES['V01_scd2_merge']}) group by all"


@query(
    "V02_versions",
    f"""with {FACTS}, l as (select *, row_number() over w as k, lag(value) over w as before from facts window w as (partition by company_id, source_id, field_name order by observed_at, fact_id)
), g as (select *, sum(case when k = 1 or value is distinct from before then 1 else 0 end) over (partition by company_id, source_id, field_name order by observed_at, fact_id rows unbounded preceding) as version from l
), s as (select company_id, source_id, field_name, version::bigint as version, any_value(value) as value, min(observed_at) as f, max(observed_at) as l from g group by all)
  select company_id, source_id, field_name, version, value, strftime(f, '%Y-%m-%d %H:%M:%S') as valid_from, strftime(l, '%Y-%m-%d %H:%M:%S') as last_seen,
    strftime(lead(f) over (partition by company_id, source_id, field_name order by version), '%Y-%m-%d %H:%M:%S') as valid_to from s""",
)
def v02(spark: SparkSession, d: str) -> DataFrame:
    stamp = lambda c: F.date_format(c, "yyyy-MM-dd HH:mm:ss").alias(c)
    h = versions.history(facts(spark, d), KEYS, "value", "observed_at", "fact_id")
    return h.select(*KEYS, F.col("version").cast("bigint").alias("version"), "value", stamp("valid_from"), stamp("last_seen"), stamp("valid_to"))


@query(
    "V04_versions_once",
    f"""with {FACTS}, s as (select company_id, field_name, value, min(observed_at) as f from facts group by all)
  select company_id, field_name, value, strftime(f, '%Y-%m-%d %H:%M:%S') as valid_from, strftime(lead(f) over (partition by company_id, field_name order by f, value), '%Y-%m-%d %H:%M:%S') as valid_to from s""",
)
def v04(spark: SparkSession, d: str) -> DataFrame:
    stamp = lambda c: F.date_format(c, "yyyy-MM-dd HH:mm:ss").alias(c)
    return versions.versions_once(facts(spark, d), ["company_id", "field_name"], "value", "observed_at").select("company_id", "field_name", "value", stamp("valid_from"), stamp("valid_to"))


@query("V05_snapshots", "select distinct user_id, event_type, floor(value)::bigint as v from events where event_id % 3 = 0 except select user_id, event_type, floor(value)::bigint from events where event_id % 3 = 1")
def v05(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events").select("event_id", "user_id", "event_type", F.floor("value").alias("v"))
    return versions.add_snapshots(e.where("event_id % 3 = 1"), e.where("event_id % 3 = 0"), ["user_id", "event_type", "v"]).select("user_id", "event_type", "v")


@query("V20_expire", "select event_id, ts <= timestamp '2024-01-10' and event_id % 2 = 0 as expired, case when not (ts <= timestamp '2024-01-10' and event_id % 2 = 0) then props end as props from events")
def v20(spark: SparkSession, d: str) -> DataFrame:
    due = (F.col("ts") <= F.lit("2024-01-10").cast("timestamp")) & (F.col("event_id") % 2 == 0)
    return versions.expire(table(spark, d, "events").select("event_id", "ts", "props"), "props", due).select("event_id", "expired", "props")


@query(
    "V21_contact_upsert",
    f"""with {FACTS}, r as (select *, row_number() over (partition by company_id, fact_id % 2 order by observed_at desc, fact_id) as k from facts
), a as (select company_id, value as old, observed_at as t from r where k = 1 and fact_id % 2 = 0), b as (select company_id, case when value % 2 = 0 then value end as new, observed_at as u from r where k = 1 and fact_id % 2 = 1)
  select company_id, coalesce(new, old) as value, strftime(greatest(t, u), '%Y-%m-%d %H:%M:%S') as observed_at from a full outer join b using (company_id)""",
)
def v21(spark: SparkSession, d: str) -> DataFrame:
    f = facts(spark, d)
    newest = lambda x: versions.current(x, ["company_id"], F.desc("observed_at"), F.col("fact_id"))
    a, b = newest(f.where("fact_id % 2 = 0")), newest(f.where("fact_id % 2 = 1")).withColumn("value", F.when(F.col("value") % 2 == 0, F.col("value")))
    return versions.upsert(a, b, ["company_id"], ["value"], "observed_at").withColumn("observed_at", F.date_format("observed_at", "yyyy-MM-dd HH:mm:ss"))


def _evidence(spark: SparkSession, d: str) -> DataFrame:
    f = versions.current(facts(spark, d), KEYS, F.desc("observed_at"), F.col("fact_id"))
    return f.select(
        "company_id", "field_name", "source_id", F.col("value").alias("lo"), F.when(F.col("value") % 5 != 0, F.col("value") + F.col("trust_rank") * 2).alias("hi"), "observed_at",
        "trust_rank", F.when(F.col("trust_rank") == 0, "verified").otherwise("estimated").alias("base_confidence"), F.lit(False).alias("is_correction"),
    )


@query("V13_confidence")
def v13(spark: SparkSession, d: str) -> DataFrame:
    return confidence.resolve(_evidence(spark, d), F.lit("2024-06-30").cast("timestamp"))


@query(
    "A27_last_verified",
    f"with {FACTS} select company_id, strftime(max(observed_at) filter (where not (source_id = 'src2' and field_name = 'view')), '%Y-%m-%d %H:%M:%S') as last_verified from facts group by all",
)
def a27(spark: SparkSession, d: str) -> DataFrame:
    counts = ~((F.col("source_id") == "src2") & (F.col("field_name") == "view"))
    return views.last_verified(facts(spark, d), counts).select("company_id", F.date_format("last_verified", "yyyy-MM-dd HH:mm:ss").alias("last_verified"))


@query(
    "A26_summary",
    f"with {FACTS} select company_id, count(distinct source_id) as n_sources, count(distinct field_name) as n_fields, count(distinct case when source_id = 'src0' then field_name end) as n_trusted from facts group by all",
)
def a26(spark: SparkSession, d: str) -> DataFrame:
    return views.fact_summary(facts(spark, d), "src0")


# --- identity --------------------------------------------------------------------------------------


def profiles(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("company_id")
    return companies(spark, d).where("merged_into_id is null").select(
        k.alias("id"), F.concat(F.lit("firm"), F.floor(k / 20).cast("string"), F.lit(" "), F.lower("sector")).alias("name"), "country", "city",
        F.when(k % 4 == 0, F.array(F.concat_ws(":", "country", k.cast("string")))).alias("registry_keys"),
        F.when(k % 6 == 0, F.array(F.concat(F.lit("V"), F.floor(k / 50).cast("string")))).alias("vat_keys"), F.array("domain").alias("domains"), "industry_code",
    )


@query(
    "J16_candidate_pairs",
    f"""with {COMPANIES}, p as (select company_id as id, country, 'firm' || (company_id // 20)::varchar as w, case when company_id % 6 = 0 then company_id // 50 end as vat, domain from companies where merged_into_id is null
), b as (select id, country || '|n' || w as k from p union select id, country || '|d' || domain from p union select id, country || '|v' || vat from p where vat is not null)
  select distinct x.id as a, y.id as b from b x join b y on x.k = y.k and x.id < y.id""",
)
def j16(spark: SparkSession, d: str) -> DataFrame:
    return identity.candidate_pairs(profiles(spark, d))


def best_block(p: str, q: str) -> str:
    """SQL for the longest substring that p and q share, of equal ones the first in p, then in q: its length and negated places."""
    longest = f"len(list_filter(range(1, least(len({p}) - i, len({q}) - j) + 2), lambda k: {p}[i:i + k - 1] = {q}[j:j + k - 1]))"
    return f"list_max(flatten(list_transform(range(1, len({p}) + 1), lambda i: list_transform(range(1, len({q}) + 1), lambda j: {{'l': {longest}, 'i': -i, 'j': -j}}))))"


#: SQL tables (need `with recursive`): the share of matching blocks of the names of name_pairs(x, y), split at the longest block again and again.
RATIOS = f"""blocks_of(x, y, p, q, b) as (select x, y, x, y, {best_block('x', 'y')} from name_pairs where x <> '' and y <> ''
  union all select x, y, s.p, s.q, {best_block('s.p', 's.q')} from (select x, y, unnest([{{'p': p[:-b.i - 1], 'q': q[:-b.j - 1]}}, {{'p': p[-b.i + b.l:], 'q': q[-b.j + b.l:]}}]) as s
    from blocks_of where b.l > 0) where s.p <> '' and s.q <> ''
), ratios as (select x, y, 2 * sum(b.l) / (len(x) + len(y)) as ratio, len(list_intersect(list_distinct(string_split(x, ' ')), list_distinct(string_split(y, ' '))))
    / len(list_distinct(list_concat(string_split(x, ' '), string_split(y, ' ')))) as words from blocks_of group by x, y
), similarities as (select x, y, case when x = y then 1 else greatest(ratio, words) end as s from ratios)"""
SCORED = f"""{COMPANIES}, p as (select company_id as id, 'firm' || (company_id // 20)::varchar || ' ' || lower(sector) as name, 'firm' || (company_id // 20)::varchar as w, country, city, domain,
    case when company_id % 4 = 0 then country || ':' || company_id end as reg, case when company_id % 6 = 0 then 'V' || (company_id // 50)::varchar end as vat, industry_code[:2] as division
    from companies where merged_into_id is null
), k as (select id, country || '|n' || w as k from p union select id, country || '|d' || domain from p union select id, country || '|v' || vat from p where vat is not null
), pairs as (select distinct x.id as a, y.id as b from k x join k y on x.k = y.k and x.id < y.id
), name_pairs as (select distinct x.name as x, y.name as y from pairs join p x on x.id = a join p y on y.id = b
), {RATIOS}, judged as (select a, b, v.reg is not null and w.reg is not null as apart, v.vat = w.vat as same_vat, v.domain = w.domain as same_domain, s, v.city = w.city as same_city, v.division = w.division as same_division,
    struct_pack(reg := v.reg, vat := v.vat, domain := v.domain, name := v.name, city := v.city, division := v.division) as x, struct_pack(reg := w.reg, name := w.name, city := w.city) as y
    from pairs join p v on v.id = a join p w on w.id = b join similarities n on n.x = v.name and n.y = w.name
), scored as (select a, b, greatest(0, least(100, case when apart then -60 else 0 end + case when same_vat then 60 else 0 end + case when same_domain then 45 else 0 end
    + case when s >= 0.999 then 50 when s >= 0.85 then 35 else 0 end + case when same_city then 15 else -10 end + case when same_division then 5 else 0 end)) as score,
    concat_ws('; ', case when apart then 'registry_id against ' || x.reg || ' / ' || y.reg end, case when same_vat then 'vat_id for ' || x.vat end, case when same_domain then 'domain for ' || x.domain end,
      case when s >= 0.999 then 'name for same: ' || x.name when s >= 0.85 then 'name for alike: ' || x.name || ' / ' || y.name else 'name neutral differ: ' || x.name || ' / ' || y.name end,
      case when same_city then 'city for ' || x.city else 'city against ' || x.city || ' / ' || y.city end, case when same_division then 'industry for ' || x.division end) as reasons from judged)"""
BAND = "case when score >= 80 then 'likely' when score >= 55 then 'possible' else 'none' end"


def _told(scored: DataFrame) -> DataFrame:
    return scored.withColumn("reasons", F.array_join(F.transform("reasons", lambda r: F.concat_ws(" ", r["signal"], r["effect"], r["detail"])), "; "))


@query("V15_score_pairs", f"with recursive {SCORED} select a, b, score, {BAND} as band, reasons from scored")
def v15(spark: SparkSession, d: str) -> DataFrame:
    return _told(identity.score_candidates(profiles(spark, d)))


@query("V16_new_candidates", f"with recursive {SCORED} select a, b, score, {BAND} as band, reasons from scored where score >= 55 and b <> a + 9")
def v16(spark: SparkSession, d: str) -> DataFrame:
    p = profiles(spark, d)
    known = p.select(F.col("id").alias("a"), (F.col("id") + 9).alias("b"))
    return _told(identity.new_candidates(p, known))


def records(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("o_orderkey")
    code = F.lpad((F.col("o_custkey") * 7919 % 100000000).cast("string"), 8, "0")
    number = t.registry_key(F.lit("DK"), code)
    return table(spark, d, "orders").select(
        k.alias("row"), F.concat(F.lit("s"), (k % 3).cast("string")).alias("source_id"), F.concat(F.lit("k"), (F.floor(k / 2)).cast("string")).alias("source_key"), F.lit("DK").alias("country"),
        F.when(k % 3 == 0, number["canonical"]).alias("registry_key"), F.when(k % 3 == 1, number["vat"]).alias("vat_key"), F.when(k % 3 == 0, number["vat"]).alias("derived_vat"),
        F.when(k % 5 == 0, F.concat(F.lit("firm"), F.col("o_custkey").cast("string"), F.lit(".dk"))).alias("domain"), F.lit(False).alias("enrichment"),
    )


@query(
    "V08_identity_keys",
    """with r as (select o_orderkey as row, 's' || (o_orderkey % 3) || '|k' || (o_orderkey // 2) as sk, lpad((o_custkey * 7919 % 100000000)::varchar, 8, '0') as d, o_custkey from orders)
  select row, 'source_key' as kind, sk as value, false as derived from r union all select row, 'registry_id', 'DK:' || d, false from r where row % 3 = 0
  union all select row, 'vat_id', 'DK' || d, false from r where row % 3 = 1 union all select row, 'registry_id', 'DK:' || d, true from r where row % 3 = 1
  union all select row, 'vat_id', 'DK' || d, true from r where row % 3 = 0 union all select row, 'domain', 'firm' || o_custkey || '.dk', false from r where row % 5 = 0""",
)
def v08(spark: SparkSession, d: str) -> DataFrame:
    return identity.identity_keys(records(spark, d))


def resolved_sql(keys: str, rounds: int = 12) -> str:
    """SQL of ordered resolution over the table k(row, kind, value, derived) that `keys` ends with: every company guessed, then chosen again in rounds."""
    return f"""with recursive {keys}, f as (select kind, value, min(row) as first from k group by all
), kf as (select k.*, first, case kind when 'source_key' then 0 when 'registry_id' then 1 when 'vat_id' then 2 else 3 end as priority from k join f using (kind, value)
), mine as (select distinct row, value[:3] as prefix from k where kind = 'registry_id' and not derived
), rounds(turn, row, company, links) as (select 0, row, row, 0::hugeint from (select distinct row from k)
  union all select turn + 1, row, company, links from (
    with taken as (select kf.row, c.company as c, min((priority, kind, value)) as best, bool_or(kind = 'registry_id' and not derived) as own, count(*) as n
        from kf join rounds c on c.row = first where first < kf.row group by kf.row, c.company),
      numbers as (select company as c, value[:3] as prefix, min(first) as since from f join rounds on row = first where kind = 'registry_id' group by all),
      blocked as (select distinct t.row, t.c from taken t join mine m on m.row = t.row join numbers r on r.c = t.c and r.prefix = m.prefix and since < t.row where not own),
      chosen as (select t.row, arg_min(t.c, best) filter (where b.c is null) as company, sum(n) as n from taken t left join blocked b on b.row = t.row and b.c = t.c group by t.row)
    select r.turn, r.row, coalesce(h.company, r.row) as company, coalesce(h.n - coalesce(t.n, 0), 0) as links from rounds r left join chosen h on h.row = r.row left join taken t on t.row = r.row and t.c = h.company
  ) where turn < {rounds})
  select row, company, case when company = row then 'new' else 'matched' end as outcome, links::int as links from rounds where turn = {rounds}"""


KEYS_SQL = """r as (select o_orderkey as row, 's' || (o_orderkey % 3) || '|k' || (o_orderkey // 2) as sk, lpad((o_custkey * 7919 % 100000000)::varchar, 8, '0') as d, o_custkey from orders
), k as (select row, 'source_key' as kind, sk as value, false as derived from r union all select row, 'registry_id', 'DK:' || d, false from r where row % 3 = 0
  union all select row, 'vat_id', 'DK' || d, false from r where row % 3 = 1 union all select row, 'registry_id', 'DK:' || d, true from r where row % 3 = 1
  union all select row, 'vat_id', 'DK' || d, true from r where row % 3 = 0 union all select row, 'domain', 'firm' || o_custkey || '.dk', false from r where row % 5 = 0)"""


@query("V09_resolve", resolved_sql(KEYS_SQL))
def v09(spark: SparkSession, d: str) -> DataFrame:
    return identity.resolve(identity.identity_keys(records(spark, d)))


@query(
    "V09_resolve_disputed",
    resolved_sql("""k as (select o_orderkey as row, 'registry_id' as kind, ['EE:', 'FI:'][o_orderkey % 2 + 1] || (o_custkey // 4)::varchar as value, o_orderkey % 3 = 1 as derived from orders where o_orderkey % 4 <> 3
  union all select o_orderkey, 'vat_id', 'V' || (o_custkey // 3)::varchar, false from orders where o_orderkey % 5 < 2
  union all select o_orderkey, 'domain', case when o_orderkey % 3 = 0 then 'all.ee' else 'd' || (o_custkey // 7)::varchar end, false from orders where o_orderkey % 2 = 0)"""),
)
def v09_disputed(spark: SparkSession, d: str) -> DataFrame:
    """Keys that contradict each other, and a domain that about a third of the rows have."""
    o = table(spark, d, "orders").select(F.col("o_orderkey").alias("row"), F.col("o_custkey").alias("c"))
    part = lambda n: F.floor(F.col("c") / n).cast("string")
    country = F.when(F.col("row") % 2 == 0, "EE:").otherwise("FI:")
    kinds = [
        ("registry_id", "row % 4 <> 3", F.concat(country, part(4)), F.col("row") % 3 == 1), ("vat_id", "row % 5 < 2", F.concat(F.lit("V"), part(3)), F.lit(False)),
        ("domain", "row % 2 = 0", F.when(F.col("row") % 3 == 0, "all.ee").otherwise(F.concat(F.lit("d"), part(7))), F.lit(False)),
    ]
    keys = [o.where(when).select("row", F.lit(kind).alias("kind"), value.alias("value"), derived.alias("derived")) for kind, when, value, derived in kinds]
    return identity.resolve(reduce(DataFrame.unionByName, keys))


@query("V17_merge", f"with {FACTS} select case when company_id % 97 = 0 then company_id - 1 else company_id end as company_id, count(*) as n from facts group by all")
def v17(spark: SparkSession, d: str) -> DataFrame:
    merges = companies(spark, d).select(F.col("company_id").alias("id"), F.col("merged_into_id").alias("to"))
    return identity.apply_merges(facts(spark, d), merges).groupBy("company_id").agg(F.count("*").alias("n"))


# --- quality and governance ---------------------------------------------------------------------------

FIELDS = ["click", "purchase", "view", "signup", "refund", "logout"]


@query(
    "A13_missing_fields",
    f"""with {COMPANIES}, {FACTS}, f as (select unnest({FIELDS}) as field_name), m as (select f.field_name, c.company_id, row_number() over (partition by f.field_name order by c.company_id) as k
  from companies c, f where c.merged_into_id is null and not exists (select 1 from facts x where x.company_id = c.company_id and x.field_name = f.field_name))
  select field_name, count(*) as n, string_agg(company_id::varchar, ',' order by company_id) filter (where k <= 25) as first_companies from m group by all""",
)
def a13(spark: SparkSession, d: str) -> DataFrame:
    c = companies(spark, d).where("merged_into_id is null").select("company_id")
    found = quality.missing_fields(c, facts(spark, d), FIELDS)
    return found.withColumn("first_companies", F.array_join("first_companies", ","))


@query(
    "A14_completeness",
    f"""with {COMPANIES}, {FACTS}, n as (select company_id, count(distinct field_name) filter (where field_name in {tuple(FIELDS)}) as n from facts group by all)
  select c.company_id, round(100 * coalesce(n, 0) / 6)::bigint as completeness from companies c left join n using (company_id)""",
)
def a14(spark: SparkSession, d: str) -> DataFrame:
    return quality.completeness(companies(spark, d).select("company_id"), facts(spark, d), FIELDS)


@query(
    "A12_totals",
    f"""with {COMPANIES} select count(*) as n, count(*) filter (where verified_on is null or timestamp '{NOW}' - verified_on::timestamp > interval 365 day) as stale,
  count(*) filter (where employee_min >= 20) as qualified, count(*) filter (where employee_min is null) as unknown_headcount from companies where merged_into_id is null""",
)
def a12(spark: SparkSession, d: str) -> DataFrame:
    return quality.totals(companies(spark, d), F.lit(NOW).cast("timestamp"))


@query(
    "A15_conflicts",
    f"""with {FACTS}, r as (select *, row_number() over (partition by company_id, source_id, field_name order by observed_at desc, fact_id) as k from facts), c as (select * from r where k = 1)
  select company_id, field_name, count(distinct value) as n_values, string_agg(value::varchar, ',' order by value, source_id) as all_values from c group by all having count(distinct value) > 1""",
)
def a15(spark: SparkSession, d: str) -> DataFrame:
    now = versions.current(facts(spark, d), KEYS, F.desc("observed_at"), F.col("fact_id"))
    return quality.conflicts(now).withColumn("all_values", F.array_join("all_values", ","))


@query(
    "A16_top_warnings",
    "select 'unknown type' as message, count(*) as n from events where event_type = 'click' union all select 'value of ' || event_type, count(*) from events where event_type <> 'click' group by all order by n desc, message limit 15",
)
def a16(spark: SparkSession, d: str) -> DataFrame:
    kind = F.col("event_type")
    text = F.when(kind == "click", F.concat(F.lit("unknown type '"), kind, F.lit("' dropped"))).otherwise(F.concat(F.lit("value of "), kind, F.lit(" '"), F.col("value").cast("string"), F.lit("'")))
    return quality.top_warnings(table(spark, d, "events").select(F.array(text).alias("warnings")))


@query(
    "F12_ingestion_gate",
    """select s_suppkey as source_id, concat_ws('; ', case when s_suppkey % 3 = 1 then 'permission status is pending, not approved' end, case when s_suppkey % 4 = 0 then 'connector is disabled' end,
  case when s_suppkey % 5 = 0 then 'connector type api cannot run ingestion jobs' end, case when s_suppkey % 2 = 1 and s_suppkey % 7 = 0 then 'mode licensed is not allowed in region nordics' end,
  case when s_nationkey % 9 >= 5 then 'coverage outside region nordics' end) as reasons from supplier""",
)
def f12(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("s_suppkey")
    countries = F.array(F.element_at(F.array(*map(F.lit, ["FI", "SE", "NO", "DK", "IS", "DE", "AT", "CH", "EE"])), (F.col("s_nationkey") % 9 + 1).cast("int")))
    sources = table(spark, d, "supplier").select(
        k.alias("source_id"), F.when(k % 3 == 1, "pending").otherwise("approved").alias("permission_status"), (k % 4 != 0).alias("enabled"), F.when(k % 5 == 0, "api").otherwise("csv").alias("connector_type"),
        F.when((k % 2 == 1) & (k % 7 == 0), "licensed").otherwise("official-open-data").alias("source_mode"), F.lit("nordics").alias("region"), countries.alias("countries"),
    )
    policy = {"nordics": (["FI", "SE", "NO", "DK", "IS"], ["official-open-data"])}
    return governance.ingestion_gate(sources, policy, ["csv"], ["official-open-data", "licensed"]).select("source_id", F.array_join("reasons", "; ").alias("reasons"))


@query("F08_allowed_fields", "select s_suppkey, case when s_suppkey % 2 = 0 then s_name end as legal_name, case when s_suppkey % 2 = 1 then 'field legal_name is not allowed for this source and was dropped' else '' end as warnings from supplier")
def f08(spark: SparkSession, d: str) -> DataFrame:
    allowed = F.when(F.col("s_suppkey") % 2 == 0, F.array(F.lit("legal_name"), F.lit("city"))).otherwise(F.array(F.lit("city")))
    rows = table(spark, d, "supplier").select("s_suppkey", F.col("s_name").alias("legal_name"), allowed.alias("allowed"))
    return governance.enforce_allowed(rows, ["legal_name"], "allowed").select("s_suppkey", "legal_name", F.array_join("warnings", "; ").alias("warnings"))


@query("F14_audit_list", "select o_orderkey, o_orderpriority from orders where starts_with(o_orderpriority, '1') and o_orderstatus = 'F' order by o_orderdate desc, o_orderkey limit 100 offset 20")
def f14(spark: SparkSession, d: str) -> DataFrame:
    events = table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_orderpriority").alias("kind"), F.col("o_orderstatus").alias("status"), F.col("o_orderdate").alias("at"))
    return views.audit_list(events, "1", "F", limit=100, offset=20).select(F.col("id").alias("o_orderkey"), F.col("kind").alias("o_orderpriority"))


@query("F17_retention", "select event_id from events where ts <= timestamp '2024-01-15' and not (event_type = 'click' and user_id % 2 = 0)")
def f17(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events").select("event_id", F.col("ts").alias("expires_at"), F.col("event_type").alias("source_id"), F.when(F.col("user_id") % 2 == 0, "company:1").otherwise("row").alias("source_key"))
    return governance.due_snapshots(e, F.lit("2024-01-15").cast("timestamp"), "click").select("event_id")


@query("J21_suppression", "select event_id from events where user_id % 10 <> 3 and event_id % 11 <> 5")
def j21(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events").select("event_id", F.sha2(F.col("user_id").cast("string"), 256).alias("identity_hash"), F.sha2(F.concat(F.lit("m"), F.col("event_id").cast("string")), 256).alias("email_hash"))
    users = table(spark, d, "events").where("user_id % 10 = 3").select(F.sha2(F.col("user_id").cast("string"), 256).alias("hash"))
    mails = table(spark, d, "events").where("event_id % 11 = 5").select(F.sha2(F.concat(F.lit("m"), F.col("event_id").cast("string")), 256).alias("hash"))
    return governance.not_suppressed(e, users.union(mails)).select("event_id")
