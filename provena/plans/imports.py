"""Registered queries about web pages, register imports and coverage, with their SQL twins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from provena.functions import html as h
from provena.functions import text as t
from provena.operators import corrections, records, register, versions, website
from provena.plans.adapters import COMPANIES, FACTS, STATEMENTS, companies, facts, statements, table
from provena.plans.evidence import _evidence
from provena.plans.screening import FUNNEL, items

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return add


TODAY = "2025-06-30"
_strip = "regexp_replace(html, '(?s)<!--.*?-->', '', 'g')"
for _tag in h.SKIPPED:
    _strip = f"regexp_replace({_strip}, '(?is)<{_tag}\\b.*?</{_tag}>', '', 'g')"
_strip = f"regexp_replace(regexp_replace({_strip}, '(?i)</?(?:{'|'.join(h.BLOCKS)})\\b[^>]*>', chr(10), 'g'), '<[^>]*>', '', 'g')"
for _e, _c in h.ENTITIES.items():
    _strip = f"replace({_strip}, '{_e}', '{_c.replace(chr(39), chr(39) * 2)}')"
TEXT = f"""array_to_string(list_filter(list_transform(string_split(regexp_replace({_strip}, '[­​‌‍﻿]', '', 'g'), chr(10)),
  lambda x: trim(regexp_replace(x, '[ \\t\\r\\x0b\\f]+', ' ', 'g'))), lambda x: x <> ''), chr(10))"""


@query("D01_visible_text", f"with t as (select page_id, {TEXT} as text from pages) select page_id, length(text)::bigint as n, sha256(text) as text_sha256 from t")
def d01(spark: SparkSession, d: str) -> DataFrame:
    text = table(spark, d, "pages").select("page_id", h.visible_text(F.col("html")).alias("text"))
    return text.select("page_id", F.length("text").cast("bigint").alias("n"), F.sha2(F.col("text").cast("binary"), 256).alias("text_sha256"))


LINKS = """with a as (select page_id, regexp_extract(lower(url), '^([a-z]+://[^/?#]+)', 1) as root, regexp_extract(lower(url), '^[a-z]+://([^/?#:]*)', 1) as domain,
  unnest(regexp_extract_all(html, '(?is)<a\\b[^>]*?href="([^"]*)"[^>]*>(.*?)</a>', 1)) as href from pages)"""


@query("D02_same_site_links", LINKS + " select page_id, count(*) as n, count(*) filter (where starts_with(href, '/') or starts_with(href, root)) as same_site from a where href <> '' and not starts_with(href, '#') group by all")
def d02(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "pages").select("page_id", h.host(F.col("url")).alias("domain"), F.explode(h.links(F.col("html"), F.lower("url"))).alias("a"))
    return p.groupBy("page_id").agg(F.count("*").alias("n"), F.count_if(h.same_site(F.col("a.url"), F.col("domain"))).alias("same_site"))


@query("D03_footer")
def d03(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "pages").select("page_id", h.footer(F.col("html")).alias("footer"))


@query("D06_copyright")
def d06(spark: SparkSession, d: str) -> DataFrame:
    today = F.lit(TODAY).cast("date")
    return table(spark, d, "pages").select("page_id", h.copyright_year(h.footer(F.col("html")), h.visible_text(F.col("html")), today).alias("year"))


@query("D07_latest_date")
def d07(spark: SparkSession, d: str) -> DataFrame:
    found = h.dates(F.col("html"), h.visible_text(F.col("html")), F.lit(TODAY).cast("date"))
    return table(spark, d, "pages").select("page_id", h.date_summary(found).alias("s")).select("page_id", "s.n_dates", "s.latest")


@query("D09_section_links")
def d09(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "pages").select("page_id", h.host(F.col("url")).alias("domain"), h.links(F.col("html"), F.lower("url")).alias("links"))
    return p.select("page_id", *[h.section_link(F.col("links"), F.col("domain"), words).alias(name) for name, words in h.SECTIONS.items()])


@query("D11_post_key")
def d11(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "pages").select("page_id", h.post_key(F.col("url")).alias("post_key"))


@query(
    "D04_domain_candidates",
    """with n as (select c_custkey, lower(replace(c_name, '#', '')) as a, lower(c_mktsegment) as b from customer)
  select c_custkey as company_id, case when c_custkey % 2 = 0 then a || '.ee,' || a || '.com' else a || b || '.ee,' || a || b || '.com,' || a || '-' || b || '.ee,' || a || '-' || b || '.com,' || a || '.ee,' || a || '.com' end as hosts from n""",
)
def d04(spark: SparkSession, d: str) -> DataFrame:
    """Names of one and of two words."""
    first = F.lower(F.replace("c_name", F.lit("#"), F.lit("")))
    key = F.when(F.col("c_custkey") % 2 == 0, first).otherwise(F.concat_ws(" ", first, F.lower("c_mktsegment")))
    return table(spark, d, "customer").select(F.col("c_custkey").alias("company_id"), F.array_join(h.domain_candidates(key, (".ee", ".com")), ",").alias("hosts"))


@query(
    "D14_activity_verdict",
    """with p as (select c_custkey as k, case when c_custkey % 4 = 0 then 'unverified' else 'registry_code' end as v, case when c_custkey % 3 <> 0 then 2018 + c_custkey % 8 end as y,
  case when c_custkey % 5 <> 0 then date '2025-06-30' - (c_custkey % 1000)::int end as news, c_custkey % 6 as posts, ['hiring', 'zero_roles', 'unknown'][c_custkey % 3 + 1] as hiring,
  c_custkey * 20000 as revenue, ['flat', 'growing', 'shrinking'][c_custkey % 7 % 3 + 1] as head from customer
), c as (select *, case when y is null then 'unknown' when 2025 - y >= 2 then 'stale' else 'fresh' end as copyright,
  case when news is null then 'unknown' when (2025 - year(news)) * 12 + 6 - month(news) - case when 30 < day(news) then 1 else 0 end >= 18 or posts < 3 then 'stale' else 'fresh' end as n from p
), s as (select *, (copyright = 'stale')::int + (n = 'stale')::int + (hiring = 'zero_roles')::int as stale_count, (copyright <> 'unknown')::int + (n <> 'unknown')::int + (hiring <> 'unknown')::int as determinable_count from c)
  select k as company_id, copyright, n as news, hiring, stale_count, determinable_count, case when v = 'unverified' or determinable_count < 2 then 'insufficient_evidence'
    when stale_count >= 2 and hiring = 'zero_roles' and revenue >= 5000000 then 'coasting' when stale_count >= 2 then 'decaying'
    when revenue >= 5000000 and hiring = 'zero_roles' and head in ('flat', 'shrinking') then 'watch' else 'active' end as verdict from s""",
)
def d14(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("c_custkey")
    pick = lambda xs, at: F.element_at(F.array(*map(F.lit, xs)), (at + 1).cast("int"))
    today = F.lit(TODAY).cast("date")
    v = h.activity_verdict(
        F.when(k % 4 == 0, "unverified").otherwise("registry_code"), F.when(k % 3 != 0, 2018 + k % 8), F.when(k % 5 != 0, F.date_sub(today, (k % 1000).cast("int"))), k % 6,
        pick(["hiring", "zero_roles", "unknown"], k % 3), k * 20000, pick(["flat", "growing", "shrinking"], k % 7 % 3), today,
    )
    return table(spark, d, "customer").select(k.alias("company_id"), v.alias("v")).select("company_id", "v.*")


FIELDS = ["revenue", "operating_profit", "ebitda", "total_assets", "equity", "employees_fte"]


@query(
    "A07_field_coverage",
    f"with {STATEMENTS} select fiscal_year, statement_scope as scope, count(*) as n, {', '.join(f'count({f}) as {f}' for f in FIELDS)} from financials where review_status <> 'superseded' group by all",
)
def a07(spark: SparkSession, d: str) -> DataFrame:
    return register.field_coverage(statements(spark, d), FIELDS)


@query(
    "A08_period_buckets",
    f"with {STATEMENTS} select case when period_end - period_start + 1 between 330 and 400 then '12 months' else 'other length' end as period, count(*) as n from financials where review_status <> 'superseded' group by all",
)
def a08(spark: SparkSession, d: str) -> DataFrame:
    return register.period_buckets(statements(spark, d))


_CASES = " ".join(f"when revenue >= {lo}" + (f" and revenue < {hi} then '{lo}-{hi}'" if hi else f" then '{lo}+'") for lo, hi in register.BUCKETS)
_NAMES = ", ".join(f"('{lo}-{hi}')" if hi else f"('{lo}+')" for lo, hi in register.BUCKETS) + ", ('negative')"


@query(
    "A09_revenue_histogram",
    f"""with {STATEMENTS}, c as (select case when revenue < 0 then 'negative' {_CASES} end as bucket, count(*) as n from financials where review_status <> 'superseded' and revenue is not null group by all)
  select b.bucket, coalesce(n, 0)::bigint as n from (values {_NAMES}) as b(bucket) left join c using (bucket)""",
)
def a09(spark: SparkSession, d: str) -> DataFrame:
    return register.revenue_histogram(statements(spark, d))


@query(
    "A10_first_issues",
    FUNNEL + " select regexp_replace(issues[1], '\\b(19|20)[0-9][0-9]\\b', 'YYYY', 'g') as issue, count(*) as n from items where len(issues) > 0 group by all order by n desc, issue limit 10",
)
def a10(spark: SparkSession, d: str) -> DataFrame:
    return register.first_issues(items(spark, d))


@query(
    "A11_counters",
    FUNNEL + """ select 'status' as kind, coalesce(registry_status, 'none') as value, count(*) as n from items group by all union all select 'verdict', coalesce(verdict, 'none'), count(*) from items group by all
  union all select 'year', coalesce(latest_year::varchar, 'none'), count(*) from items group by all union all select 'flag', 'group_parent', count(*) from items where group_parent having count(*) > 0
  union all select 'flag', 'holding_activity', count(*) from items where holding having count(*) > 0 union all select 'flag', 'cash_harvesting_candidate', count(*) from items where cash having count(*) > 0""",
)
def a11(spark: SparkSession, d: str) -> DataFrame:
    return register.counters(items(spark, d))


@query(
    "A19_latest_row",
    "with r as (select *, row_number() over (partition by o_custkey order by year(o_orderdate) desc, o_orderkey desc) as k from orders) select o_custkey as company_id, year(o_orderdate)::int as fiscal_year, o_orderkey, o_orderpriority as activity from r where k = 1",
)
def a19(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "orders").select(F.col("o_custkey").alias("company_id"), F.year("o_orderdate").alias("fiscal_year"), "o_orderkey", F.col("o_orderpriority").alias("activity"))
    return register.latest_by_year(rows, "company_id", "fiscal_year", ["o_orderkey"])


METRICS = {"A": "revenue", "N": "operating_profit", "R": "depreciation"}


@query(
    "A23_choose_metrics",
    """with i as (select l_orderkey as report_id, case when l_linestatus = 'O' then 'standalone' else 'consolidated' end as scope, case l_returnflag when 'A' then 'revenue' when 'N' then 'operating_profit' when 'R' then 'depreciation' end as metric,
  l_quantity::int as raw, l_linenumber % 2 as det, 'T' || (l_suppkey % 3) as tn, l_linenumber as line_no, l_partkey from lineitem
), c as (select report_id, scope, metric, first(raw order by det, length(tn), tn, line_no, raw) as raw, count(distinct raw) as nv from i group by all
) select report_id, scope, max(case when metric = 'revenue' then raw end)::double as revenue, max(case when metric = 'operating_profit' then raw end)::double as operating_profit,
  max(case when metric = 'depreciation' then raw end)::double as depreciation, count(*) filter (where nv > 1) as differing from c group by all""",
)
def a23(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "lineitem").select(
        F.col("l_orderkey").alias("report_id"), F.when(F.col("l_linestatus") == "O", "standalone").otherwise("consolidated").alias("scope"), F.col("l_returnflag").alias("element"),
        F.col("l_quantity").cast("int").cast("string").alias("raw"), (F.col("l_linenumber") % 2).alias("is_detail"), F.concat(F.lit("T"), (F.col("l_suppkey") % 3).cast("string")).alias("table_name"),
        F.struct("l_linenumber", F.col("l_quantity").cast("int").alias("q")).alias("line_no"),
    )
    found = register.choose_metrics(rows, METRICS)
    return found.select("report_id", "scope", *[F.col(c).cast("double").alias(c) for c in METRICS.values()], "differing")


@query("M08_derived_ebitda", f"with {STATEMENTS} select company_id, fiscal_year, coalesce(ebitda, operating_profit - 100)::double as ebitda, case when ebitda is not null then 'reported' when operating_profit is not null then 'derived' end as ebitda_type from financials")
def m08(spark: SparkSession, d: str) -> DataFrame:
    found = register.derived_ebitda(statements(spark, d).withColumn("depreciation", F.lit(100).cast("decimal(20,2)")))
    return found.select("company_id", "fiscal_year", F.col("ebitda").cast("double").alias("ebitda"), "ebitda_type")


@query(
    "N20_address",
    """select c_custkey as company_id, case when c_custkey % 4 <> 3 then c_mktsegment || ' maakond' end as county, ['Tallinn', c_name || ' vald', c_name || ' linn', null][c_custkey % 4 + 1] as municipality,
  ['Tallinn', null, c_name, null][c_custkey % 4 + 1] as city, ['', '', '', 'unrecognised units: ' || c_name || '; no county; municipality ambiguous'][c_custkey % 4 + 1] as warnings from customer""",
)
def n20(spark: SparkSession, d: str) -> DataFrame:
    k, name = F.col("c_custkey"), F.col("c_name")
    county = F.concat("c_mktsegment", F.lit(" maakond"))
    units = (
        F.when(k % 4 == 0, F.concat(county, F.lit(", Tallinn,  Kesklinna linnaosa"))).when(k % 4 == 1, F.concat(county, F.lit(","), name, F.lit(" vald, "), name, F.lit(" alevik")))
        .when(k % 4 == 2, F.concat(county, F.lit(", "), name, F.lit(" linn"))).otherwise(name)
    )
    return table(spark, d, "customer").select(k.alias("company_id"), register.address_parts(units).alias("p")).select("company_id", "p.county", "p.municipality", "p.city", F.array_join("p.warnings", "; ").alias("warnings"))


@query(
    "N21_scope",
    """select l_orderkey, l_linenumber, case l_linenumber % 4 when 0 then 'standalone' when 1 then 'consolidated' when 2 then case when l_returnflag = 'A' then 'consolidated' when l_linestatus = 'O' then 'standalone' end
  else case when l_returnflag = 'A' then 'consolidated' when l_linestatus = 'O' then 'standalone' end end as scope from lineitem""",
)
def n21(spark: SparkSession, d: str) -> DataFrame:
    name = F.element_at(F.array(F.lit("Konsolideerimata bilanss"), F.lit("Konsolideeritud bilanss"), F.lit("Bilanss"), F.lit("Kasumiaruanne")), (F.col("l_linenumber") % 4 + 1).cast("int"))
    element = F.when(F.col("l_returnflag") == "A", "RevenueConsolidated").otherwise("Revenue")
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", register.statement_scope(name, element, F.col("l_linestatus") != "O").alias("scope"))


@query("F11_eligible_reports", "select o_orderkey from orders where o_custkey % 3 <> 0 and o_orderkey % 5 <> 0")
def f11(spark: SparkSession, d: str) -> DataFrame:
    form = F.when(F.col("o_custkey") % 3 == 0, "FIE").otherwise("OÜ")
    year = F.when(F.col("o_orderkey") % 5 == 0, "n/a").otherwise(F.year("o_orderdate").cast("string"))
    rows = table(spark, d, "orders").select("o_orderkey", F.col("o_orderkey").cast("string").alias("report_id"), F.col("o_custkey").cast("string").alias("registry_code"), form.alias("legal_form"), year.alias("fiscal_year"))
    return register.eligible_reports(rows).select("o_orderkey")


@query("D16_domain_share", f"with {COMPANIES}, n as (select domain, count(*) as n from companies group by all) select company_id, domain, n > 1 as shared from companies join n using (domain)")
def d16(spark: SparkSession, d: str) -> DataFrame:
    c = companies(spark, d).select("company_id", "domain")
    return c.join(c.groupBy("domain").agg(F.count("*").alias("n")), "domain").select("company_id", "domain", (F.col("n") > 1).alias("shared"))


@query(
    "D12_post_history",
    """with m as (select user_id as site, 'https://x.ee/en/news/post-' || (event_id % 40) as loc, ts::date as d, 'post-' || (event_id % 40) as k from events where event_id % 4 <> 0
), f as (select site, k as key, min(d) as day, min(loc) as url from m group by all), b as (select *, count(*) over (partition by site, day) as n from f
), p as (select user_id as site, 'post-' || (event_id % 40) as key, max(ts::date) as day, 'https://x.ee/blogi/post-' || (event_id % 40) as url from events where event_id % 4 = 0 group by all
) select site, key, day::varchar as day, url, 'page' as source from p union all select site, key, day::varchar, url, 'sitemap' from b where n < 4 and not exists (select 1 from p where p.site = b.site and p.key = b.key)""",
)
def d12(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events").select(F.col("user_id").alias("site"), (F.col("event_id") % 40).cast("string").alias("k"), F.col("ts").cast("date").alias("day"), "event_id")
    sitemap = e.where("event_id % 4 <> 0").select("site", F.concat(F.lit("https://x.ee/en/news/post-"), "k").alias("loc"), F.col("day").alias("lastmod"))
    pages = e.where("event_id % 4 = 0").select("site", F.concat(F.lit("https://x.ee/blogi/post-"), "k").alias("url"), "day")
    return website.post_history(sitemap, pages, F.lit(TODAY).cast("date")).withColumn("day", F.col("day").cast("string"))


@query("D13_hiring")
def d13(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "pages")
    links, domain = h.links(F.col("html"), F.lower("url")), h.host(F.col("url"))
    careers = p.select(F.col("page_id").alias("site"), domain.alias("domain"), links.alias("links"), h.visible_text(F.col("html")).alias("text"))
    careers = careers.withColumn("careers_url", h.section_link(F.col("links"), F.col("domain"), h.SECTIONS["careers"]))
    return website.hiring(careers)


@query(
    "D15_choose_domain",
    """with c as (select c_custkey as k, 'w' || c_custkey || '.ee' as domain, 2 as r, true as ok from customer where c_custkey % 3 <> 0 union all
  select c_custkey, 'm' || (c_custkey % 50) || '.ee', 3, c_custkey % 4 = 0 from customer union all select c_custkey, 'g' || c_custkey || '.ee', 4, c_custkey % 5 <> 0 from customer
), r as (select *, row_number() over (partition by k order by r, domain) as n from c where ok) select k as company_id, domain, ['', 'register_www', 'register_email', 'guess'][r] as origin from r where n = 1""",
)
def d15(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("c_custkey")
    c = table(spark, d, "customer")
    one = lambda name, origin, verified, shared, named: c.select(k.alias("company_id"), F.concat(name, F.lit(".ee")).alias("domain"), F.lit(origin).alias("origin"), verified.alias("verification"), shared.alias("shared"), named.alias("names_company"))
    no, text = F.lit(False), F.lit("unverified")
    www = one(F.concat(F.lit("w"), k.cast("string")), "register_www", text, no, no).where("company_id % 3 <> 0")
    mail = one(F.concat(F.lit("m"), (k % 50).cast("string")), "register_email", text, F.lit(True), k % 4 == 0)
    guess = one(F.concat(F.lit("g"), k.cast("string")), "guess", F.when(k % 5 != 0, "registry_code").otherwise("unverified"), no, no)
    return website.choose_domain(www.union(mail).union(guess))


@query("D17_contact_domains", "select c_custkey as company_id, 'firm' || c_custkey || '.ee,shop.com' as domains from customer")
def d17(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("c_custkey").cast("string")
    entry = lambda kind, value, ends=None: F.struct(F.lit(kind).alias("kind"), value.alias("value"), F.lit(ends).cast("string").alias("ends"))
    entries = F.array(
        entry("WWW", F.concat(F.lit("http://www.firm"), k, F.lit(".ee/"))), entry("EMAIL", F.concat(F.lit("info@firm"), k, F.lit(".ee"))), entry("EMAIL", F.lit("x@gmail.com")),
        entry("WWW", F.lit("old.ee"), "2020-01-01"), entry("TEL", F.lit("tel.ee")), entry("WWW", F.lit("shop.com")),
    )
    return table(spark, d, "customer").select(F.col("c_custkey").alias("company_id"), F.array_join(website.contact_domains(entries), ",").alias("domains"))


@query("F10_ignored_tables", "select l_orderkey, l_linenumber from lineitem where l_linenumber % 3 <> 0")
def f10(spark: SparkSession, d: str) -> DataFrame:
    name = F.when(F.col("l_linenumber") % 3 == 0, "Rahavoogude aruanne").otherwise("Bilanss")
    return table(spark, d, "lineitem").where(~register.is_ignored_table(name)).select("l_orderkey", "l_linenumber")


@query("N14_legal_form", "select c_custkey as company_id, ['ou', 'as', 'tuh', 'fie'][c_custkey % 4 + 1] as form from customer")
def n14(spark: SparkSession, d: str) -> DataFrame:
    raw = F.element_at(F.array(F.lit("Osaühing"), F.lit("AS"), F.lit("Tulundusühistu"), F.lit("FIE")), (F.col("c_custkey") % 4 + 1).cast("int"))
    return table(spark, d, "customer").select(F.col("c_custkey").alias("company_id"), register.legal_form(raw).alias("form"))


@query(
    "V03_set_versions",
    """with j as (select l_orderkey, '{"l_partkey":' || l_partkey || ',"l_linenumber":' || l_linenumber || '}' as row from lineitem)
  select l_orderkey, count(*) as n, sha256(string_agg(row, chr(10) order by row)) as set_hash from j group by all""",
)
def v03(spark: SparkSession, d: str) -> DataFrame:
    return versions.set_versions(table(spark, d, "lineitem").select("l_orderkey", "l_partkey", "l_linenumber"), "l_orderkey", "l_partkey", "l_linenumber").select("l_orderkey", "n", "set_hash")


@query(
    "V06_build_record",
    f"""with {COMPANIES} select company_id, case when company_id % 10 = 7 then null else country end as country, case when company_id % 10 = 7 then 1 when country not in ('EE', 'FI', 'SE', 'DE') then 1 else 0 end::bigint as n_errors,
  case when company_id % 10 <> 7 and country in ('EE', 'FI', 'SE', 'DE') then 'https://' || domain end as website, case when company_id % 10 <> 7 and country in ('EE', 'FI', 'SE', 'DE') and employee_min is not null then employee_min end as staff from companies""",
)
def v06(spark: SparkSession, d: str) -> DataFrame:
    c = companies(spark, d)
    rows = c.select(
        "company_id", F.col("company_id").cast("string").alias("source_key"), "legal_name", F.when(F.col("company_id") % 10 == 7, "Atlantis").otherwise(F.col("country")).alias("country"), "city",
        F.concat(F.lit("http://www."), "domain").alias("website"), F.col("employee_min").cast("string").alias("employees"), "industry_code",
    )
    built = records.build(rows, ["EE", "FI", "SE", "DE"], ["EE", "FI", "SE", "DE"])
    fact = lambda f, k: F.get_json_object(F.try_element_at("facts", F.lit(f)), f"$.{k}")
    return built.select("company_id", "country", F.size("errors").cast("bigint").alias("n_errors"), fact("website", "v").alias("website"), fact("employees", "min").cast("bigint").alias("staff"))


@query("V14_company_view")
def v14(spark: SparkSession, d: str) -> DataFrame:
    return corrections.company_view(_evidence(spark, d), F.lit("2024-06-30").cast("timestamp"), ["click", "purchase", "view"])


@query(
    "V18_corrections",
    f"""with {FACTS}, c as (select company_id, field_name from facts where fact_id % 50 = 0 group by all)
  select count(*) filter (where fixed) as n_corrections, count(*) filter (where not fixed and marked) as n_marked, count(*) as n from (
    select false as fixed, c.company_id is not null as marked from facts f left join c using (company_id, field_name) union all select true, false from c)""",
)
def v18(spark: SparkSession, d: str) -> DataFrame:
    f = facts(spark, d).select("company_id", "field_name", "value", "observed_at", F.lit(False).alias("is_correction"), F.lit(None).cast("timestamp").alias("valid_to"), F.lit("open").alias("review_status"))
    fixes = facts(spark, d).where("fact_id % 50 = 0").select("company_id", "field_name", "value", "observed_at")
    out = corrections.apply(f, fixes)
    return out.agg(F.count_if("is_correction").alias("n_corrections"), F.count_if(F.col("review_status") == "corrected").alias("n_marked"), F.count("*").alias("n"))


@query("V19_erase_contacts", "select count(*) filter (where user_id % 7 <> 0) as n_left, count(distinct case when user_id % 7 = 0 then user_id end) as n_tombstones from events")
def v19(spark: SparkSession, d: str) -> DataFrame:
    hashed = F.sha2(F.col("user_id").cast("string"), 256)
    contacts = table(spark, d, "events").select("user_id", hashed.alias("identity_hash"), F.lit(None).cast("string").alias("email_hash"))
    left, tombs = corrections.erase(contacts, contacts.where("user_id % 7 = 0").select("identity_hash"))
    both = left.select(F.lit("left").alias("kind")).unionByName(tombs.select(F.lit("tomb").alias("kind")))
    return both.agg(F.count_if(F.col("kind") == "left").alias("n_left"), F.count_if(F.col("kind") == "tomb").alias("n_tombstones"))


@query("N28_redact", "select event_id, 'a [erased] b [erased]' as line from events")
def n28(spark: SparkSession, d: str) -> DataFrame:
    k = F.concat(F.lit("<"), F.col("event_id").cast("string"), F.lit(">"))
    line = F.concat(F.lit("a "), k, F.lit(" b "), F.lit("Mari Maasikas"))
    return table(spark, d, "events").select("event_id", corrections.redact(line, F.array(k, F.lit("Mari Maasikas"))).alias("line"))
