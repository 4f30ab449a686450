"""Registered queries: the remaining filters, joins, windows, orders and compositions, with their SQL twins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from provena.functions import html as h
from provena.functions import numbers as m
from provena.functions import text as t
from provena.operators import confidence, funnel, governance, identity, quality, register, signals, versions, views, website
from provena.plans.adapters import COMPANIES, FACTS, STATEMENTS, companies, facts, statements, table
from provena.plans.evidence import SCORED, _evidence, profiles, records
from provena.plans.screening import BAND, FUNNEL, SIGNAL, YEAR, items, with_codes

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return add


def pick(values: list[str], at: F.Column) -> F.Column:
    return F.element_at(F.array(*map(F.lit, values)), (at + 1).cast("int"))


# --- filters -----------------------------------------------------------------------------------------


@query(
    "F07_revenue_candidates",
    f"with {STATEMENTS} select company_id, fiscal_year from financials where revenue is not null and review_status <> 'superseded' and currency = 'EUR' and period_end - period_start + 1 between 365 and 366",
)
def f07(spark: SparkSession, d: str) -> DataFrame:
    standard = m.period_class(F.col("period_start"), F.col("period_end")) == "standard_12_month"
    return statements(spark, d).where(F.col("revenue").isNotNull() & signals.is_current() & (F.col("currency") == "EUR") & standard).select("company_id", "fiscal_year")


@query("F13_enable_gate", "select s_suppkey, concat_ws('; ', case when s_suppkey % 3 = 0 then 'cannot enable: not approved' end, case when s_suppkey % 4 = 0 then 'cannot enable: no allowed fields' end) as reasons from supplier")
def f13(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("s_suppkey")
    s = table(spark, d, "supplier").select("s_suppkey", F.when(k % 3 == 0, "pending").otherwise("approved").alias("permission_status"), F.when(k % 4 != 0, F.array(F.lit("city"))).otherwise(F.array().cast("array<string>")).alias("allowed_fields"))
    return governance.enable_gate(s).select("s_suppkey", F.array_join("enable_reasons", "; ").alias("reasons"))


@query("F15_runs_list", "select o_orderkey, o_orderstatus from orders where o_orderpriority like '2%' and o_orderstatus = 'F' order by o_orderdate desc, o_orderkey limit 50")
def f15(spark: SparkSession, d: str) -> DataFrame:
    runs = table(spark, d, "orders").where("o_orderpriority like '2%' and o_orderstatus = 'F'")
    return views.newest(runs, "o_orderdate", "o_orderkey", 50).select("o_orderkey", "o_orderstatus")


@query("F16_sources_list", "select s_suppkey, n_name as region from supplier join nation on s_nationkey = n_nationkey where n_regionkey = 3 order by n_name, s_suppkey")
def f16(spark: SparkSession, d: str) -> DataFrame:
    n = table(spark, d, "nation").where("n_regionkey = 3").select("n_nationkey", F.col("n_name").alias("region"))
    sources = table(spark, d, "supplier").join(F.broadcast(n), F.col("s_nationkey") == F.col("n_nationkey")).select(F.col("s_suppkey").alias("source_id"), "region")
    return views.sources_list(sources).select(F.col("source_id").alias("s_suppkey"), "region")


@query("F19_projection", f"with {COMPANIES} select company_id, legal_name as name, country || ':' || company_id as reference, coalesce(sector, '') as sector from companies")
def f19(spark: SparkSession, d: str) -> DataFrame:
    return views.summaries(companies(spark, d))


@query("S13_source_sync", "select s_suppkey as source_id, case when s_suppkey % 5 = 0 then 'approved' when s_suppkey % 5 = 1 then 'denied' when s_suppkey % 5 in (2, 3) then 'approved' else 'pending' end as permission_status, s_suppkey % 5 = 2 as enabled, case s_suppkey % 5 when 0 then 'added' when 4 then 'unlisted' else 'kept' end as outcome from supplier")
def s13(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("source_id")
    s = table(spark, d, "supplier").select(F.col("s_suppkey").alias("source_id"))
    catalog = s.where(k % 5 != 4).withColumn("permission_status", F.when(k % 5 == 1, "denied").otherwise("approved"))
    registry = s.where(k % 5 != 0).withColumn("permission_status", F.when(k % 5 == 4, "pending").otherwise("approved")).withColumn("enabled", k % 5 != 3)
    return governance.sync_sources(catalog, registry)


# --- joins ---------------------------------------------------------------------------------------------


@query("J01_statements_of_companies", f"with {COMPANIES}, {STATEMENTS} select company_id, count(*) as n, max(fiscal_year) as latest from companies join financials using (company_id) where country = 'EE' and merged_into_id is null and review_status <> 'superseded' group by all")
def j01(spark: SparkSession, d: str) -> DataFrame:
    c = companies(spark, d).where("country = 'EE' and merged_into_id is null").select("company_id")
    return statements(spark, d).where(signals.is_current()).join(c, "company_id").groupBy("company_id").agg(F.count("*").alias("n"), F.max("fiscal_year").alias("latest"))


@query("J03_registry_ids", f"with {COMPANIES} select company_id, 'EE:' || lpad(company_id::varchar, 8, '0') as registry_id, 'https://ariregister.rik.ee/eng/company/' || lpad(company_id::varchar, 8, '0') as url from companies where company_id % 3 <> 0")
def j03(spark: SparkSession, d: str) -> DataFrame:
    ids = table(spark, d, "customer").select(F.col("c_custkey").alias("company_id"), F.concat(F.lit("EE:"), F.lpad(F.col("c_custkey").cast("string"), 8, "0")).alias("registry_id"), (F.col("c_custkey") % 3 == 0).alias("derived"))
    return companies(spark, d).select("company_id").join(ids.where("not derived"), "company_id").select("company_id", "registry_id", t.register_url(F.col("registry_id")).alias("url"))


@query("J05_left_context", f"with {COMPANIES}, {FACTS}, n as (select company_id, count(*) as n from facts group by all) select company_id, coalesce(n, 0)::bigint as n_facts from companies left join n using (company_id)")
def j05(spark: SparkSession, d: str) -> DataFrame:
    return views.with_count(companies(spark, d).select("company_id"), facts(spark, d), "n_facts")


@query("J13_known_codes", f"with {COMPANIES} select o_orderkey from orders where o_custkey in (select company_id from companies where country = 'EE') or o_custkey in (select user_id from events)")
def j13(spark: SparkSession, d: str) -> DataFrame:
    scope, known = companies(spark, d).where("country = 'EE'").select("company_id"), table(spark, d, "events").select("user_id")
    return views.with_codes_in(table(spark, d, "orders"), "o_custkey", scope, known).select("o_orderkey")


@query("J15_identifier_lookup", """with k as (select o_orderkey as row, 'DK:' || lpad((o_custkey * 7919 % 100000000)::varchar, 8, '0') as v from orders where o_orderkey % 3 <> 2)
  select distinct row, c_custkey as company_id from k join customer on v = 'DK:' || lpad((c_custkey * 7919 % 100000000)::varchar, 8, '0')""")
def j15(spark: SparkSession, d: str) -> DataFrame:
    own = F.concat(F.lit("DK:"), F.lpad((F.col("c_custkey") * 7919 % 100000000).cast("string"), 8, "0"))
    ids = table(spark, d, "customer").select(F.lit("registry_id").alias("kind"), own.alias("value"), F.col("c_custkey").alias("company_id"))
    return identity.identity_keys(records(spark, d)).join(ids, ["kind", "value"]).select("row", "company_id").distinct()


@query("J17_rejected_records", "select event_id, user_id from events where event_type = 'click' order by ts desc, event_id limit 100")
def j17(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events")
    records = e.select(F.col("event_id").alias("run_id"), "user_id", F.when(F.col("event_type") == "click", "rejected").otherwise("ok").alias("status"))
    runs = e.select(F.col("event_id").alias("run_id"), F.col("ts").alias("started"))
    return views.rejected_records(records, runs, 100).select(F.col("run_id").alias("event_id"), "user_id")


@query("J19_source_names", f"with {FACTS} select source_id, s_name as source_name, count(*) as n from facts left join supplier on s_suppkey = substr(source_id, 4)::int group by all")
def j19(spark: SparkSession, d: str) -> DataFrame:
    s = table(spark, d, "supplier").select(F.concat(F.lit("src"), F.col("s_suppkey").cast("string")).alias("source_id"), F.col("s_name").alias("source_name"))
    return views.with_source_names(facts(spark, d).groupBy("source_id").agg(F.count("*").alias("n")), s)


# --- aggregates and windows -------------------------------------------------------------------------------


@query("A21_share_capital", "select o_custkey as company_id, max(o_orderkey) as entry_no, arg_max(o_totalprice, o_orderkey) as amount from orders where o_orderstatus <> 'F' group by all")
def a21(spark: SparkSession, d: str) -> DataFrame:
    entry = F.struct(F.col("o_orderkey").alias("entry_no"), F.col("o_totalprice").alias("amount"), F.lit("EUR").alias("currency"), F.when(F.col("o_orderstatus") == "F", "2020").alias("ends"))
    g = table(spark, d, "orders").groupBy(F.col("o_custkey").alias("company_id")).agg(F.collect_list(entry).alias("e"))
    return g.select("company_id", register.current_capital(F.col("e")).alias("c")).where("c is not null").select("company_id", "c.entry_no", "c.amount")


@query("A28_active_fields", f"with {FACTS} select company_id, string_agg(distinct field_name, ',' order by field_name) as fields from facts group by all")
def a28(spark: SparkSession, d: str) -> DataFrame:
    return views.active_fields(facts(spark, d)).select("company_id", F.array_join("fields", ",").alias("fields"))


@query("W02_three_years", f"with {SIGNAL} select company_id, latest_year from financial where three")
def w02(spark: SparkSession, d: str) -> DataFrame:
    one = signals.unique_years(statements(spark, d), signals.comparable())
    w = Window.partitionBy("company_id").orderBy("fiscal_year")
    latest = Window.partitionBy("company_id")
    lagged = one.select("company_id", "fiscal_year", F.lag("fiscal_year", 1).over(w).alias("y1"), F.lag("fiscal_year", 2).over(w).alias("y2"), F.max("fiscal_year").over(latest).alias("latest_year"))
    return lagged.where("fiscal_year = latest_year and y1 = fiscal_year - 1 and y2 = fiscal_year - 2").select("company_id", "latest_year")


@query("W07_status_precedence", f"with {FACTS}, r as (select *, row_number() over (partition by company_id order by (fact_id % 10 = 0) desc, observed_at desc, fact_id) as k from facts) select company_id, fact_id, value from r where k = 1")
def w07(spark: SparkSession, d: str) -> DataFrame:
    return versions.current(facts(spark, d), ["company_id"], (F.col("fact_id") % 10 == 0).desc(), F.desc("observed_at"), F.col("fact_id")).select("company_id", "fact_id", "value")


@query("O05_decay_tier", "select c_custkey as company_id, [0, 1, 2, 4, 3, 3][c_custkey % 6 + 1] as tier from customer")
def o05(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("c_custkey")
    verdict = F.when(k % 6 != 5, pick(["coasting", "decaying", "watch", "active", "insufficient_evidence"], F.least(k % 6, F.lit(4))))
    return table(spark, d, "customer").select(k.alias("company_id"), funnel.decay_tier(verdict).alias("tier"))


@query("O08_recheck_batch", f"{FUNNEL} select company_id from items where registered and not (company_id % 3 = 0 and company_id % 2 = 0) order by tier, case next_action when 'advisor_review' then 0 when 'research' then 1 when 'outside_size_band' then 2 else 3 end, coalesce(idx, -99) desc, lower(legal_name), company_id limit 50")
def o08(spark: SparkSession, d: str) -> DataFrame:
    checked = table(spark, d, "customer").where("c_custkey % 3 = 0 and c_custkey % 2 = 0").select(F.col("c_custkey").alias("company_id"))
    due = items(spark, d).where(t.is_registered(F.col("registry_status"))).join(checked, "company_id", "left_anti")
    return due.orderBy(*funnel.ranking("cash_harvesting")).limit(50).select("company_id")


@query("O09_financial_series", f"with {STATEMENTS} select company_id, fiscal_year, revenue::double as revenue from financials order by company_id, fiscal_year desc, statement_scope nulls last")
def o09(spark: SparkSession, d: str) -> DataFrame:
    series = statements(spark, d).orderBy("company_id", F.desc("fiscal_year"), F.asc_nulls_last("statement_scope"))
    return series.select("company_id", "fiscal_year", F.col("revenue").cast("double").alias("revenue"))


@query("O13_disambiguation", """with s as (select p_partkey, p_type, (p_brand = 'Brand#1')::int * 2 + (p_size > 25)::int + (p_name like '%1%')::int as score from part
), r as (select *, rank() over (partition by p_type order by score desc) as k from s), u as (select *, count(*) filter (where k = 1) over (partition by p_type) as firsts, max(score) over (partition by p_type) as best from r)
  select p_type, p_partkey, score from u where not (firsts = 1 and best > 0) or k = 1""")
def o13(spark: SparkSession, d: str) -> DataFrame:
    flag = lambda c: c.cast("int")
    score = flag(F.col("p_brand") == "Brand#1") * 2 + flag(F.col("p_size") > 25) + flag(F.col("p_name").contains("1"))
    best = single_best(table(spark, d, "part").select("p_type", "p_partkey", score.alias("score")), "p_type")
    return best.select("p_type", "p_partkey", "score")


def single_best(scored: DataFrame, key: str) -> DataFrame:
    """Of each key's candidates the single best one if it scores at all, else all of them.

    The best score and how many reach it are aggregated first, so a key with most of the rows is no single task.
    """
    tops = scored.groupBy(key, "score").agg(F.count("*").alias("n")).groupBy(key).agg(F.max(F.struct("score", "n")).alias("top"))
    clear = (F.col("top.n") == 1) & (F.col("top.score") > 0)
    return scored.join(tops, key).where(~clear | (F.col("score") == F.col("top.score")))


# --- scalar functions ----------------------------------------------------------------------------------------


@query("N01_strip_accents", f"with {COMPANIES} select company_id, strip_accents(legal_name) as plain from companies")
def n01(spark: SparkSession, d: str) -> DataFrame:
    return companies(spark, d).select("company_id", t.strip_accents(F.col("legal_name")).alias("plain"))


@query("N10_registry_from_vat", "select c_custkey as company_id, 'DK:' || lpad(c_custkey::varchar, 8, '0') as registry_key from customer")
def n10(spark: SparkSession, d: str) -> DataFrame:
    vat = F.concat(F.lit("DK"), F.lpad(F.col("c_custkey").cast("string"), 8, "0"))
    return table(spark, d, "customer").select(F.col("c_custkey").alias("company_id"), t.registry_from_vat(F.lit("DK"), vat).alias("registry_key"))


@query("N13_collapse", "select event_id, 'a b ' || event_type as text from events")
def n13(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").select("event_id", t.collapse(F.concat(F.lit("  a \t\n b  "), "event_type", F.lit("  "))).alias("text"))


@query("N19_unit_type", "select c_custkey as company_id, ['county', 'rural_municipality', 'tallinn', 'city_district', 'town', 'borough', 'village', 'unknown'][c_custkey % 8 + 1] as kind from customer")
def n19(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("c_custkey")
    ending = pick([" maakond", " vald", "", " linnaosa", " linn", " alevik", "küla / Village", ""], k % 8)
    unit = F.when(k % 8 == 2, "Tallinn").otherwise(F.concat("c_name", ending))
    return table(spark, d, "customer").select(k.alias("company_id"), register.unit_type(unit).alias("kind"))


ELEMENTS = [*register.ELEMENTS.items(), ("Other", None)]


@query("N22_element_metric", f"select l_orderkey, l_linenumber, [{', '.join(repr(v) if v else 'null' for _, v in ELEMENTS)}][(l_orderkey + l_linenumber) % {len(ELEMENTS)} + 1] as metric from lineitem")
def n22(spark: SparkSession, d: str) -> DataFrame:
    element = pick([e for e, _ in ELEMENTS], (F.col("l_orderkey") + F.col("l_linenumber")) % len(ELEMENTS))
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", t.lookup(register.ELEMENTS, element).alias("metric"))


@query("N23_code_version", "select o_orderkey, case when o_orderkey % 3 < 2 then year(o_orderdate)::varchar end as version from orders")
def n23(spark: SparkSession, d: str) -> DataFrame:
    k, year = F.col("o_orderkey"), F.year("o_orderdate").cast("string")
    raw = F.when(k % 3 == 0, F.concat(F.lit(" EMTAK "), year)).when(k % 3 == 1, year).otherwise("  ")
    return table(spark, d, "orders").select("o_orderkey", register.code_version(raw).alias("version"))


@query("N24_content_hash", "select count(*) as n_rows, count(distinct (user_id, event_type)) as n_hashes from events")
def n24(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").select(t.content_hash(F.col("user_id"), F.col("event_type")).alias("h")).agg(F.count("*").alias("n_rows"), F.count_distinct("h").alias("n_hashes"))


@query("N25_contact_hash", f"with {COMPANIES} select company_id, sha256('contact|' || lower(legal_name) || '|' || country || '|' || company_id) as contact_hash, sha256('email|info@' || domain) as email_hash from companies")
def n25(spark: SparkSession, d: str) -> DataFrame:
    contact = t.contact_hash(F.col("legal_name"), F.col("country"), F.col("company_id"))
    return companies(spark, d).select("company_id", contact.alias("contact_hash"), t.email_hash(F.concat(F.lit(" Info@"), "domain")).alias("email_hash"))


@query("N26_name_similarity", f"with recursive {SCORED} select a, b, s as similarity from judged")
def n26(spark: SparkSession, d: str) -> DataFrame:
    p = profiles(spark, d)
    pairs = identity.block_pairs(identity.blocks(p), p.select("id", "name"))
    return pairs.select("a", "b", identity.name_similarity(F.col("x_name"), F.col("y_name")).alias("similarity"))


@query("N29_scrub", "select event_id, left('mail a' || event_type || ' call  done' || repeat('x', 100), 80) as snippet from events")
def n29(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").select("event_id", t.scrub(F.concat(F.lit("mail a@"), "event_type", F.lit(" call 1234567 done"), F.repeat(F.lit("x"), 100))).alias("snippet"))


@query("M06_margins", f"with {STATEMENTS} select company_id, fiscal_year, case when revenue > 0 then round(operating_profit::double / revenue::double, 6) end as margin, case when revenue > 0 then round(ebitda::double / revenue::double, 6) end as ebitda_margin from financials")
def m06(spark: SparkSession, d: str) -> DataFrame:
    r = F.col("revenue")
    return statements(spark, d).select("company_id", "fiscal_year", F.round(m.ratio(F.col("operating_profit"), r), 6).alias("margin"), F.round(m.ratio(F.col("ebitda"), r), 6).alias("ebitda_margin"))


@query("M10_observed_at", "select event_id, strftime(ts, '%Y-%m-%d %H:%M:%S') as at from events")
def m10(spark: SparkSession, d: str) -> DataFrame:
    text = F.when(F.col("event_id") % 2 == 0, F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'")).otherwise(F.date_format("ts", "yyyy-MM-dd HH:mm:ss"))
    return table(spark, d, "events").select("event_id", F.date_format(m.observed_at(text), "yyyy-MM-dd HH:mm:ss").alias("at"))


@query("U03_key_sets", "select c_custkey as company_id, c_custkey % 3 = 0 as shared, case when c_custkey % 3 = 0 then '' else 'r' || (c_custkey % 3) end as only_a from customer")
def u03(spark: SparkSession, d: str) -> DataFrame:
    a, b = F.array(F.concat(F.lit("r"), (F.col("c_custkey") % 3).cast("string"))), F.array(F.lit("r0"))
    return table(spark, d, "customer").select(F.col("c_custkey").alias("company_id"), F.arrays_overlap(a, b).alias("shared"), F.array_join(F.array_except(a, b), ",").alias("only_a"))


@query("U05_ordered_distinct", "select c_custkey as company_id, case when c_custkey % 2 = 0 then 'b,a' else 'b,c,a' end as parts from customer")
def u05(spark: SparkSession, d: str) -> DataFrame:
    middle = F.when(F.col("c_custkey") % 2 == 0, "b").otherwise("c")
    return table(spark, d, "customer").select(F.col("c_custkey").alias("company_id"), F.array_join(F.array_distinct(F.array(F.lit("b"), middle, F.lit("a"), F.lit("b"))), ",").alias("parts"))


# --- websites and compositions ---------------------------------------------------------------------------------


@query("D05_verify_identity", "select c_custkey as company_id, ['registry_code', 'name_and_address', 'unverified', 'unverified'][c_custkey % 4 + 1] as who from customer")
def d05(spark: SparkSession, d: str) -> DataFrame:
    """Pages with the company's code in groups, its name and postal code, its name alone, and another company's code."""
    k, name = F.col("c_custkey"), F.replace("c_name", F.lit("#"), F.lit(""))
    code, postal = F.lpad(k.cast("string"), 8, "1"), F.lpad((k % 90000).cast("string"), 5, "1")
    text = (
        F.when(k % 4 == 0, F.concat(F.lit("Reg "), F.substring(code, 1, 4), F.lit(" "), F.substring(code, 5, 4))).when(k % 4 == 1, F.concat(F.upper(name), F.lit(" OÜ, "), postal, F.lit(" Tallinn")))
        .when(k % 4 == 2, F.concat(name, F.lit(" OÜ"))).otherwise(F.concat(F.lit("Reg 9"), F.substring(code, 2, 7), F.lit(", "), postal))
    )
    return table(spark, d, "customer").select(k.alias("company_id"), h.verify_identity(text, code, F.lower(name), postal).alias("who"))


@query("D10_sitemap", "select user_id as site, count(*) as n, max(ts::date)::varchar as latest from events group by all")
def d10(spark: SparkSession, d: str) -> DataFrame:
    one = F.concat(F.lit("<url><loc>https://x.ee/"), F.col("event_id").cast("string"), F.lit("</loc><lastmod>"), F.date_format("ts", "yyyy-MM-dd'T'HH:mm"), F.lit("</lastmod></url>"))
    xml = table(spark, d, "events").groupBy(F.col("user_id").alias("site")).agg(F.array_join(F.collect_list(one), "").alias("xml"))
    found = xml.select("site", h.sitemap_entries(F.col("xml")).alias("e"))
    return found.select("site", F.size("e").cast("bigint").alias("n"), F.array_max(F.transform("e", lambda x: x["lastmod"])).cast("string").alias("latest"))


@query("V07_source_key", "select c_custkey as company_id, case c_custkey % 4 when 0 then 'k' || c_custkey when 1 then 'vat:V' || c_custkey when 2 then 'domain:d.ee' else 'row:' || substr(sha256(c_name), 1, 16) end as key from customer")
def v07(spark: SparkSession, d: str) -> DataFrame:
    k, s = F.col("c_custkey"), F.col("c_custkey").cast("string")
    own = identity.source_key(F.when(k % 4 == 0, F.concat(F.lit("k"), s)), F.lit(None).cast("string"), F.when(k % 4 == 1, F.concat(F.lit("V"), s)), F.when(k % 4 == 2, F.lit("d.ee")), F.col("c_name"))
    return table(spark, d, "customer").select(k.alias("company_id"), own.alias("key"))


@query("V10_new_identifiers", "select distinct 'DK:' || lpad((o_custkey * 7919 % 100000000)::varchar, 8, '0') as value from orders where o_orderkey % 3 <> 2 and o_custkey % 2 = 0")
def v10(spark: SparkSession, d: str) -> DataFrame:
    keys = identity.identity_keys(records(spark, d)).where("kind = 'registry_id'")
    stored = table(spark, d, "customer").where("c_custkey % 2 = 1").select(F.concat(F.lit("DK:"), F.lpad((F.col("c_custkey") * 7919 % 100000000).cast("string"), 8, "0")).alias("value"))
    return versions.add_snapshots(stored, keys.select("value"), ["value"])


@query("V12_values_agree", "select c_custkey as company_id, 10 <= coalesce(case when c_custkey % 5 <> 0 then c_custkey % 30 + 5 end, 1000000000000) and c_custkey % 30 <= 20 as agree from customer")
def v12(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("c_custkey")
    a = F.struct(F.lit(10).cast("bigint").alias("lo"), F.lit(20).cast("bigint").alias("hi"))
    b = F.struct((k % 30).alias("lo"), F.when(k % 5 != 0, k % 30 + 5).alias("hi"))
    return table(spark, d, "customer").select(k.alias("company_id"), a.alias("a"), b.alias("b")).select("company_id", confidence.agree(F.col("a"), F.col("b")).alias("agree"))


@query("V25_next_action", FUNNEL + " select next_action, count(*) as n from items group by all")
def v25(spark: SparkSession, d: str) -> DataFrame:
    return items(spark, d).groupBy("next_action").agg(F.count("*").alias("n"))


@query("V26_flags", FUNNEL + " select company_id, group_parent, holding, cash as cash_harvesting_candidate from items")
def v26(spark: SparkSession, d: str) -> DataFrame:
    return items(spark, d).select("company_id", "group_parent", "holding", "cash_harvesting_candidate")


@query("V29_coverage", FUNNEL + " select focus_band, quality_band, evidence_status, count(*) as n, count(*) filter (where cash) as n_cash from items group by all")
def v29(spark: SparkSession, d: str) -> DataFrame:
    return items(spark, d).groupBy("focus_band", "quality_band", "evidence_status").agg(F.count("*").alias("n"), F.count_if("cash_harvesting_candidate").alias("n_cash"))


@query("V31_company_detail")
def v31(spark: SparkSession, d: str) -> DataFrame:
    """All fields of all companies with their resolved value, the current facts behind it, and the statements' span."""
    resolved = confidence.resolve(_evidence(spark, d), F.lit("2024-06-30").cast("timestamp"))
    span = statements(spark, d).groupBy("company_id").agg(F.min("fiscal_year").alias("first_year"), F.max("fiscal_year").alias("last_year"))
    names = companies(spark, d).select("company_id", "legal_name", "registry_status")
    return names.join(resolved, "company_id").join(span, "company_id", "left")


@query("V32_check_targets", f"""with {COMPANIES}, {STATEMENTS}, ok as (select *, row_number() over (partition by company_id order by fiscal_year desc, filing_id desc) as k from financials where review_status <> 'superseded' and revenue is not null and currency = 'EUR' and period_end - period_start between 364 and 365
), n as (select domain, count(*) as n from companies group by all) select company_id, c.domain, n.n > 1 as domain_shared, floor(o.revenue)::bigint as amount from companies c join n using (domain) left join (select * from ok where k = 1) o using (company_id) where c.merged_into_id is null""")
def v32(spark: SparkSession, d: str) -> DataFrame:
    c = companies(spark, d)
    counts = quality.domain_counts(c)
    base = c.where("merged_into_id is null").select("company_id", "domain").join(counts, "domain")
    return base.join(signals.latest_revenue(statements(spark, d)), "company_id", "left").select("company_id", "domain", (F.col("n_companies") > 1).alias("domain_shared"), "amount")


@query("V33_register_import", """with r as (select o_custkey, year(o_orderdate)::int as y, o_orderkey from orders where o_custkey % 3 <> 0 and o_orderkey % 5 <> 0), l as (select l_orderkey, max(case when l_returnflag = 'A' then l_quantity::int end) as a from lineitem group by all)
  select o_custkey as company_id, y as fiscal_year, count(*) as n_reports, count(a) as n_with_revenue from r left join l on l_orderkey = o_orderkey group by all""")
def v33(spark: SparkSession, d: str) -> DataFrame:
    """Eligible reports joined with the metrics chosen from their indicators, per company and year."""
    form, year = F.when(F.col("o_custkey") % 3 == 0, "FIE").otherwise("OÜ"), F.when(F.col("o_orderkey") % 5 == 0, "n/a").otherwise(F.year("o_orderdate").cast("string"))
    o = table(spark, d, "orders").select("o_custkey", F.col("o_orderkey").cast("string").alias("report_id"), F.col("o_custkey").cast("string").alias("registry_code"), form.alias("legal_form"), year.alias("fiscal_year"))
    rows = table(spark, d, "lineitem").select(
        F.col("l_orderkey").cast("string").alias("report_id"), F.lit("standalone").alias("scope"), F.col("l_returnflag").alias("element"), F.col("l_quantity").cast("int").cast("string").alias("raw"),
        F.lit(0).alias("is_detail"), F.lit("T").alias("table_name"), F.struct("l_linenumber", F.col("l_quantity").alias("q")).alias("line_no"),
    )
    metrics = register.choose_metrics(rows, {"A": "revenue"})
    return register.eligible_reports(o).join(metrics, "report_id", "left").groupBy(F.col("o_custkey").alias("company_id"), "fiscal_year").agg(F.count("*").alias("n_reports"), F.count("revenue").alias("n_with_revenue"))


@query("V30_quality_report", f"""with {COMPANIES}, {FACTS}, h as (select company_id, count(distinct field_name) filter (where field_name in ('click', 'purchase', 'view', 'signup', 'refund', 'logout')) as n from facts group by all), c as (select company_id, round(100 * coalesce(n, 0) / 6)::bigint as p from companies left join h using (company_id) where merged_into_id is null)
  select p as completeness, count(*) as n from c group by all""")
def v30(spark: SparkSession, d: str) -> DataFrame:
    c = companies(spark, d).where("merged_into_id is null").select("company_id")
    return quality.completeness(c, facts(spark, d), ["click", "purchase", "view", "signup", "refund", "logout"]).groupBy("completeness").agg(F.count("*").alias("n"))


@query("V34_register_domains", "select c_custkey % 2 as kind, count(*) as n from customer group by all")
def v34(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("c_custkey")
    entry = lambda kind, value: F.struct(F.lit(kind).alias("kind"), value.alias("value"), F.lit(None).cast("string").alias("ends"))
    entries = F.array(entry("EMAIL", F.concat(F.lit("a@f"), k.cast("string"), F.lit(".ee"))), entry("WWW", F.when(k % 2 == 1, F.lit("gmail.com")).otherwise(F.lit("x.ee"))))
    return table(spark, d, "customer").select(website.contact_domains(entries).alias("domains")).groupBy((F.lit(2) - F.size("domains")).cast("bigint").alias("kind")).agg(F.count("*").alias("n"))


@query("V35_website_check")
def v35(spark: SparkSession, d: str) -> DataFrame:
    """Verdict over pages as fetched: notices, dates and roles of each page, with the company of the same number as its owner."""
    today = F.lit("2025-06-30").cast("date")
    p = table(spark, d, "pages").select("page_id", "url", "html", h.visible_text(F.col("html")).alias("text"), h.links(F.col("html"), F.lower("url")).alias("links"), h.host(F.col("url")).alias("domain"))
    p = p.withColumn("careers_url", h.section_link(F.col("links"), F.col("domain"), h.SECTIONS["careers"]))
    roles = website.hiring(p.withColumnRenamed("page_id", "site"))
    facts_of = p.select("page_id", h.copyright_year(h.footer(F.col("html")), F.col("text"), today).alias("year"), h.latest_date(h.dates(F.col("html"), F.col("text"), today))["day"].alias("news"))
    both = facts_of.join(roles.withColumnRenamed("state", "roles"), F.col("page_id") == F.col("site"))
    owners = companies(spark, d).select(F.col("company_id").alias("page_id"), t.name_key(F.col("legal_name")).alias("name"), F.lpad(F.col("company_id").cast("string"), 8, "0").alias("code"))
    named = p.join(owners, "page_id", "left").select("page_id", h.verify_identity(F.col("text"), F.col("code"), F.col("name"), F.lit("10111")).alias("verification"))
    revenue = signals.latest_revenue(statements(spark, d)).select(F.col("company_id").alias("page_id"), "amount")
    staff = signals.headcount_trend(statements(spark, d)).select(F.col("company_id").alias("page_id"), F.col("state").alias("staff"))
    both = both.join(named, "page_id").join(revenue, "page_id", "left").join(staff, "page_id", "left")
    verdict = h.activity_verdict(F.col("verification"), F.col("year"), F.col("news"), F.lit(None).cast("int"), F.col("roles"), F.col("amount"), F.col("staff"), today)
    return both.select("page_id", verdict.alias("v")).select("page_id", "v.*")


@query("K04_address_line", f"with {COMPANIES} select company_id, concat_ws(', ', case when company_id % 3 <> 0 then 'Street ' || company_id end, city, country) as line from companies")
def k04(spark: SparkSession, d: str) -> DataFrame:
    street = F.when(F.col("company_id") % 3 != 0, F.concat(F.lit("Street "), F.col("company_id").cast("string")))
    return companies(spark, d).select("company_id", t.address_line(street, F.col("city"), F.col("country")).alias("line"))


@query("K05_latest_signal", f"with {FACTS}, r as (select *, row_number() over (partition by company_id order by observed_at desc, fact_id) as k from facts where field_name = 'view') select company_id, value from r where k = 1")
def k05(spark: SparkSession, d: str) -> DataFrame:
    signal = facts(spark, d).where("field_name = 'view'").withColumn("json", F.to_json(F.struct("value")))
    newest = versions.current(signal, ["company_id"], F.desc("observed_at"), F.col("fact_id"))
    return newest.select("company_id", F.from_json("json", "value bigint")["value"].alias("value"))


@query("K13_known_codes", "select distinct 'DK:' || lpad((o_custkey * 7919 % 100000000)::varchar, 8, '0') as value, o_orderkey % 3 = 1 as derived from orders where o_orderkey % 3 in (0, 1)")
def k13(spark: SparkSession, d: str) -> DataFrame:
    return identity.identity_keys(records(spark, d)).where("kind = 'registry_id'").select("value", "derived").distinct()


@query(
    "N16_division_label",
    FUNNEL + " select peer_group, case peer_group when '70' then '70 · Head offices' else 'EMTAK ' || peer_group end as label, count(*) as n from items where peer_group is not null group by all",
)
def n16(spark: SparkSession, d: str) -> DataFrame:
    sizes = with_codes(companies(spark, d)).groupBy(t.industry_division(F.col("industry_codes")).alias("peer_group")).agg(F.count("*").alias("n")).where("peer_group is not null")
    return sizes.select("peer_group", t.division_label(F.col("peer_group"), {"70": "Head offices"}).alias("label"), "n")


__all__ = ["BAND", "ORACLES", "QUERIES", "YEAR"]
