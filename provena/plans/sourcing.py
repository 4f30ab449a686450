"""Registered queries that go through files and whole assemblies: register files, extracts, sinks, evidence, merges, warnings."""

from __future__ import annotations

import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from provena.operators import confidence, governance, identity, records, register, website
from provena.plans.adapters import COMPANIES, companies, table
from provena.sources import extracts, register_files, sink, snapshots
from provena.sources.shared import new_path

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return add


# --- files --------------------------------------------------------------------------------------------


@query("S01_csv_zips", """select c_custkey as code, '"' || c_name || '"' || chr(10) || c_mktsegment || ';' as name from customer""")
def s01(spark: SparkSession, d: str) -> DataFrame:
    """customer written as ZIPs of CSV, with quotes, delimiters and line breaks in a field, and read back."""
    name = F.concat(F.lit('"'), "c_name", F.lit('"\n'), "c_mktsegment", F.lit(";"))
    rows = table(spark, d, "customer").select(F.col("c_custkey").alias("ariregistri_kood"), name.alias("nimi"), F.lit("x").alias("muu"))
    paths = register_files.export_zips(rows, new_path(spark, "csv-zips"), "csv")
    return register_files.read_csv_zip(spark, paths, ["ariregistri_kood", "nimi"]).select(F.col("ariregistri_kood").cast("long").alias("code"), F.col("nimi").alias("name"))


@query("S02_json_zips", "select o_orderkey, o_custkey, o_orderpriority as priority from orders")
def s02(spark: SparkSession, d: str) -> DataFrame:
    """orders written as ZIPs of one JSON array each, and read back."""
    rows = table(spark, d, "orders").select("o_orderkey", F.struct("o_custkey", F.col("o_orderpriority").alias("priority")).alias("aruanne"), F.lit('], "[').alias("muu"))
    paths = register_files.export_zips(rows, new_path(spark, "json-zips"), "json")
    return register_files.read_json_zip(spark, paths, "o_orderkey long, aruanne struct<o_custkey: long, priority: string>").select("o_orderkey", "aruanne.*")


@query("S05_extract", "select s_suppkey as source_key, 'Äri ' || s_name || ', OÜ' as legal_name from supplier")
def s05(spark: SparkSession, d: str) -> DataFrame:
    """supplier written as Latin-1 CSV, which Windows-1252 extends, and read as extracts whose encoding and delimiter are found."""
    folder = new_path(spark, "extracts")
    rows = table(spark, d, "supplier").select(F.col("s_suppkey").alias("Kood"), F.concat(F.lit("Äri "), "s_name", F.lit(", OÜ")).alias("Ärinimi"), F.lit("x").alias("Muu"))
    rows.write.option("header", True).option("sep", ";").option("encoding", "iso-8859-1").csv(folder)
    fs, root = pafs.FileSystem.from_uri(folder)
    paths = [f.path for f in fs.get_file_info(pafs.FileSelector(root)) if f.is_file and f.path.endswith(".csv") and f.size]
    found, _ = extracts.read_extract(spark, paths, {"kood": "source_key", "ärinimi": "legal_name"}, ["source_key", "legal_name"])
    return found.select(F.col("source_key").cast("long").alias("source_key"), "legal_name")


LINKS = """links as (select distinct case o_orderstatus when 'F' then '/4.' || year(o_orderdate) || '_aruannete_elemendid_kuni_' || strftime(o_orderdate, '%Y%m%d') || '.zip'
    else '/1.aruannete_yldandmed_kuni_' || strftime(o_orderdate, '%Y%m%d') || '.zip' end as url, case o_orderstatus when 'F' then 'indicators' else 'reports' end as kind,
    case o_orderstatus when 'F' then year(o_orderdate)::int end as year from orders where o_orderstatus <> 'P')"""


def links(spark: SparkSession, d: str) -> DataFrame:
    day, status = F.date_format("o_orderdate", "yyyyMMdd"), F.col("o_orderstatus")
    name = (
        F.when(status == "F", F.concat(F.lit("/4."), F.year("o_orderdate").cast("string"), F.lit("_aruannete_elemendid_kuni_"), day, F.lit(".zip")))
        .when(status == "P", F.lit("/other.zip")).otherwise(F.concat(F.lit("/1.aruannete_yldandmed_kuni_"), day, F.lit(".zip")))
    )
    return register_files.discover_links(table(spark, d, "orders").select(F.concat(F.lit('<p><a class="x" href="'), name, F.lit('">file</a>')).alias("html")))


@query("S09_links", f"with {LINKS} select * from links")
def s09(spark: SparkSession, d: str) -> DataFrame:
    return links(spark, d)


@query("S06_wanted_files", f"with {LINKS} select kind, year, max(url) as url from links where kind <> 'indicators' or year in (1996, 1998, 2000) group by all")
def s06(spark: SparkSession, d: str) -> DataFrame:
    return register_files.wanted_files(links(spark, d), [1996, 1998], always=(1998, 2000))


@query(
    "S14_publish",
    f"""with {COMPANIES}, b as (select *, case when country in ('EE', 'FI', 'SE', 'DE') then 'accepted' else 'rejected' end as kind from companies)
  select kind, country, count(*) as n, sum(company_id)::bigint as ids from b group by all""",
)
def s14(spark: SparkSession, d: str) -> DataFrame:
    """Records of all companies published as accepted and rejected rows, a run repeated, and both kinds read back."""
    rows = companies(spark, d).select("company_id", F.col("company_id").cast("string").alias("source_key"), "legal_name", "country", "city")
    built = records.build(rows, ["EE", "FI", "SE", "DE"], ["EE", "FI", "SE", "DE"]).select("company_id", "country", "errors")
    store = new_path(spark, "store")
    for _ in range(2):
        sink.publish(built, store, "load")
    kinds = [sink.rows_of(spark, store, kind, built).withColumn("kind", F.lit(kind)) for kind in ("accepted", "rejected")]
    return kinds[0].unionByName(kinds[1]).groupBy("kind", "country").agg(F.count("*").alias("n"), F.sum("company_id").alias("ids"))


@query("S15_snapshot", "select case when c_acctbal >= 0 then c_custkey end as company_id, case when c_acctbal >= 0 then 'new' else 'unknown_code' end as outcome from customer")
def s15(spark: SparkSession, d: str) -> DataFrame:
    """Signals exported to a portable snapshot and imported into a store that knows the companies with a balance."""
    c = table(spark, d, "customer")
    signals = c.select(F.col("c_custkey").cast("string").alias("registry_code"), F.lit("2025-01-02").cast("timestamp").alias("observed_at"), F.to_json(F.struct("c_mktsegment")).alias("signal"))
    path = new_path(spark, "signals")
    snapshots.export(signals, path)
    known = c.where("c_acctbal >= 0").select(F.col("c_custkey").alias("company_id"), F.col("c_custkey").cast("string").alias("registry_code"))
    stored = spark.createDataFrame([], "company_id long, signal string, observed_at timestamp")
    return snapshots.import_signals(stored, snapshots.load(spark, path), known).select("company_id", "outcome")


# --- evidence in words ------------------------------------------------------------------------------------

NOW = "2025-01-15"
FIELDS = ["legal_name", "industry_code", "website", "sector"]
EVIDENCE = f"""e as (
  select event_id as fact_id, user_id as company_id, {FIELDS}[event_id % 4 + 1] as field_name, event_id % 3 as trust, 'src' || (event_id % 3) as source, ts, event_id % 97 = 0 as fix,
    floor(value / 8)::int as v, ts >= timestamp '{NOW}' - interval 365 day as fresh, case event_id % 8 when 0 then 'Firm ' || floor(value / 8)::int || ' OÜ' when 4 then 'FIRM ' || floor(value / 8)::int
      when 1 then '62.' || floor(value / 8)::int when 5 then '62' || floor(value / 8)::int when 2 then ' WWW' || floor(value / 8)::int || '.ee' when 6 then 'www' || floor(value / 8)::int || '.ee '
      when 3 then 'Food ' || floor(value / 8)::int else 'food ' || floor(value / 8)::int end as value from events
), firsts as (
  select *, row_number() over (partition by company_id, field_name, v order by trust, ts desc, fact_id) as nth from e where not fix and fresh
), sources as (
  select company_id, field_name, v, count(distinct source) as n_sources from e where not fix and fresh group by all
), ranked as (
  select f.*, s.n_sources, row_number() over w as k, count(*) over (partition by f.company_id, f.field_name) as n_clusters from firsts f join sources s using (company_id, field_name, v)
  where nth = 1 window w as (partition by f.company_id, f.field_name order by trust, ts desc, fact_id)
), top as (select * from ranked where k = 1
), others as (select company_id, field_name, string_agg(value, '|' order by k) as conflicting from ranked where k > 1 group by all
), olds as (select * from (select *, row_number() over (partition by company_id, field_name order by trust, ts desc, fact_id) as nth from e where not fix) where nth = 1
), fixes as (select * from (select *, row_number() over (partition by company_id, field_name order by ts desc, fact_id) as nth from e where fix) where nth = 1
), kinds as (
  select company_id, field_name, case when n_clusters > 1 and field_name <> 'sector' then 'conflicting' when n_sources > 1 then 'multi-source' when n_clusters > 0 then 'single' else 'old' end as kind,
    coalesce(n_clusters, 0) as n_clusters, coalesce(n_sources, 0) as n_sources, t.v as v, t.value as value, case t.trust when 0 then 'verified' else 'estimated' end as base
  from (select distinct company_id, field_name from e) left join top t using (company_id, field_name)
)"""


def worded(spark: SparkSession, d: str) -> DataFrame:
    """events as evidence in words: two spellings of each name, code, address and label."""
    k, v = F.col("event_id"), F.floor(F.col("value") / 8).cast("int").cast("string")
    spelling = [(0, "Firm ", " OÜ"), (1, "62.", ""), (2, " WWW", ".ee"), (3, "Food ", ""), (4, "FIRM ", ""), (5, "62", ""), (6, "www", ".ee "), (7, "food ", "")]
    value = F.when(F.lit(False), "")
    for at, before, after in spelling:
        value = value.when(k % 8 == at, F.concat(F.lit(before), v, F.lit(after)))
    return table(spark, d, "events").select(
        k.alias("fact_id"), F.col("user_id").alias("company_id"), F.element_at(F.array(*map(F.lit, FIELDS)), (k % 4 + 1).cast("int")).alias("field_name"), F.concat(F.lit("src"), (k % 3).cast("string")).alias("source_id"),
        value.alias("value"), F.col("ts").cast("timestamp").alias("observed_at"), (k % 3).cast("int").alias("trust_rank"), F.when(k % 3 == 0, "verified").otherwise("estimated").alias("base_confidence"),
        (k % 97 == 0).alias("is_correction"),
    )


@query(
    "V13_worded_evidence",
    f"""with {EVIDENCE} select k.company_id, k.field_name, case when f.fact_id is not null then 'manually-corrected' when kind = 'single' then base else kind end as status,
  case when f.fact_id is not null then f.value when n_clusters > 0 then k.value else o.value end as value, n_clusters::bigint as n_clusters, n_sources::bigint as n_sources,
  case when k.field_name = 'sector' then '' else coalesce(conflicting, '') end as conflicting
  from kinds k left join fixes f using (company_id, field_name) left join olds o using (company_id, field_name) left join others using (company_id, field_name)""",
)
def v13_worded(spark: SparkSession, d: str) -> DataFrame:
    found = confidence.resolve(worded(spark, d), F.lit(NOW).cast("timestamp"))
    return found.select("company_id", "field_name", "status", "value", "n_clusters", "n_sources", F.array_join("conflicting", "|").alias("conflicting"))


@query(
    "V13_fact_labels",
    f"""with {EVIDENCE} select e.company_id, e.field_name, e.fact_id,
  case when e.fix then case when e.fact_id = f.fact_id then 'manually-corrected' else 'old' end when not e.fresh then 'old' when kind = 'conflicting' then 'conflicting'
    when kind = 'multi-source' and e.v = k.v then 'multi-source' when e.trust = 0 then 'verified' else 'estimated' end as label,
  coalesce(case when f.fact_id is not null then e.fact_id = f.fact_id when kind = 'old' then not e.fix and e.fact_id = o.fact_id else not e.fix and e.fresh and e.v = k.v end, false) as supporting
  from e join kinds k using (company_id, field_name) left join fixes f using (company_id, field_name) left join olds o using (company_id, field_name)""",
)
def v13_labels(spark: SparkSession, d: str) -> DataFrame:
    return confidence.label_facts(worded(spark, d), F.lit(NOW).cast("timestamp"))


@query(
    "V12_texts_agree",
    """select event_id, case event_id % 4 when 0 then props = event_type when 1 then true when 2 then lower(event_type) = 'view' else false end as agree from
  (select event_id, event_type, case when event_id % 8 = 0 then event_type else 'other' end as props from events)""",
)
def v12_texts(spark: SparkSession, d: str) -> DataFrame:
    """Names that differ in form, codes that differ in dots, texts that differ in case, and texts that differ."""
    k, kind = F.col("event_id"), F.col("event_type")
    field = F.element_at(F.array(*map(F.lit, ["legal_name", "industry_code", "website", "city"])), (k % 4 + 1).cast("int"))
    a = F.when(k % 4 == 0, F.concat(F.upper(kind), F.lit(" OÜ"))).when(k % 4 == 1, F.concat(F.lit("62.0"), (k % 10).cast("string"))).when(k % 4 == 2, F.concat(F.lit(" "), kind)).otherwise(kind)
    b = (
        F.when(k % 4 == 0, F.when(k % 8 == 0, kind).otherwise("other")).when(k % 4 == 1, F.concat(F.lit("620"), (k % 10).cast("string"))).when(k % 4 == 2, F.lit("VIEW "))
        .otherwise(F.concat(kind, F.lit(".")))
    )
    return table(spark, d, "events").select("event_id", confidence.texts_agree(field, a, b).alias("agree"))


# --- identity and governance ---------------------------------------------------------------------------


@query(
    "V17_merge_guards",
    f"""with {COMPANIES}, p as (select company_id as a, company_id + 25 as b, case company_id % 5 when 4 then 0 when 3 then company_id + 25 else company_id end as survivor, case when company_id % 11 = 0 then 'merged' else 'open' end as status from companies)
  select p.a, p.b, concat_ws('; ', case when status <> 'open' then 'already merged' end, case when survivor = 0 and p.a <> 0 and p.b <> 0 then 'survivor is neither of the two' end, case when y.company_id is null then 'unknown company' end,
    case when x.country <> y.country then 'different countries' end, case when p.a % 2 = 0 and p.a % 3 = 0 and y.company_id is not null then 'different register numbers' end) as problems
  from p join companies x on x.company_id = p.a left join companies y on y.company_id = p.b""",
)
def v17_guards(spark: SparkSession, d: str) -> DataFrame:
    """Pairs of companies 25 apart, some closed, some with a foreign survivor, some with register numbers of their own."""
    c = companies(spark, d)
    k = F.col("company_id")
    survivor = F.when(k % 5 == 4, 0).when(k % 5 == 3, k + 25).otherwise(k).cast("long")
    pairs = c.select(k.alias("a"), (k + 25).alias("b"), survivor.alias("survivor"), F.when(k % 11 == 0, "merged").otherwise("open").alias("status"))
    numbers = c.where(k % 2 == 0).select(k, F.lit("registry_id").alias("kind"), k.cast("string").alias("value"), F.lit(False).alias("derived"))
    shared = pairs.where("a % 3 <> 0 and a % 2 = 0 or a % 2 = 1").select(F.explode(F.array("a", "b")).alias("company_id"), F.lit("registry_id").alias("kind"), F.concat(F.lit("s"), "a").alias("value"), F.lit(False).alias("derived"))
    checked = identity.merge_problems(pairs, c, numbers.unionByName(shared))
    return checked.select("a", "b", F.array_join("problems", "; ").alias("problems"))


@query(
    "F12_gate_of_runs",
    """select o_orderkey, case when s_suppkey is null then 'source is not registered' else concat_ws('; ', case when s_suppkey % 2 = 0 and s_suppkey % 3 <> 0 then 'mode open is not allowed in region internal' end,
    case when s_suppkey % 2 = 1 and s_nationkey % 2 = 0 then 'coverage outside region north' end) end as reasons from orders left join supplier on s_suppkey = o_custkey""",
)
def f12_runs(spark: SparkSession, d: str) -> DataFrame:
    """Runs of sources, of which some are not registered; internal sources may cover all regions in their own modes."""
    k = F.col("s_suppkey")
    sources = table(spark, d, "supplier").select(
        k.alias("source_id"), F.lit("approved").alias("permission_status"), F.lit(True).alias("enabled"), F.lit("csv").alias("connector_type"),
        F.when((k % 2 == 0) & (k % 3 == 0), "supplied").otherwise("open").alias("source_mode"), F.when(k % 2 == 0, "internal").otherwise("north").alias("region"),
        F.array(F.when(F.col("s_nationkey") % 2 == 0, "DE").otherwise("FI")).alias("countries"),
    )
    gated = governance.ingestion_gate(sources, {"north": (["FI"], ["open"]), "middle": (["DE"], ["open"])}, ["csv"], ["open", "supplied"], internal_modes=["supplied"])
    asked = table(spark, d, "orders").select("o_orderkey", F.col("o_custkey").alias("source_id"))
    return governance.gate_runs(asked, gated).select("o_orderkey", F.array_join("reasons", "; ").alias("reasons"))


# --- the register import ----------------------------------------------------------------------------------


@query(
    "J14_shareholders",
    """select o_custkey as company_id, case o_orderstatus when 'F' then 'person' when 'O' then 'legal_entity' else 'unknown' end as holder_type,
  case when o_orderstatus = 'F' then concat_ws(' ', 'Mari', case when o_orderkey % 7 <> 0 then o_orderpriority end) else o_orderpriority end as holder_name,
  case when o_orderstatus = 'O' then case when o_orderkey % 2 = 0 then '1' || o_orderkey else 'X' || o_orderkey end end as holder_registry_code, (o_orderkey % 101)::double as holding_percent,
  o_orderkey % 3 <> 0 as current, strftime(o_orderdate, '%Y-%m-%d') as effective_from from orders where o_orderstatus = 'F' or o_orderkey % 7 <> 0""",
)
def j14(spark: SparkSession, d: str) -> DataFrame:
    """Shareholder lists of companies, made of their orders, with what must never be kept."""
    k, status = F.col("o_orderkey"), F.col("o_orderstatus")
    s = lambda c: c.cast("string")
    day = F.date_format("o_orderdate", "dd.MM.yyyy")
    entry = F.struct(
        F.when(status == "F", "F").when(status == "O", "J").otherwise("?").alias("isiku_tyyp"), F.lit(" Mari ").alias("eesnimi"), F.when(k % 7 != 0, F.col("o_orderpriority")).otherwise(" ").alias("nimi_arinimi"),
        F.when((k % 2 == 0) | (status == "F"), F.concat(F.lit("1"), s(k))).alias("isikukood_registrikood"), F.concat(F.lit("X"), s(k)).alias("valis_kood"), F.lit("FI").alias("valis_kood_riik"),
        F.lit("osanik").alias("isiku_roll_tekstina"), F.lit("2500").alias("osaluse_suurus"), F.lit("EUR").alias("osaluse_valuuta"), s(k % 101).alias("osaluse_protsent"),
        F.lit(None).cast("string").alias("osaluse_omandiliik_tekstina"), day.alias("algus_kpv"), F.when(k % 3 == 0, day).alias("lopp_kpv"),
    )
    lists = table(spark, d, "orders").groupBy(s(F.col("o_custkey")).alias("registry_code")).agg(F.collect_list(entry).alias("osanikud"))
    known = table(spark, d, "orders").select(F.col("o_custkey").alias("company_id"), s(F.col("o_custkey")).alias("registry_code")).distinct()
    held = register.company_shareholders(lists, known)
    return held.select(
        "company_id", "holder_type", "holder_name", "holder_registry_code", F.col("holding_percent").cast("double").alias("holding_percent"), "current", F.date_format("effective_from", "yyyy-MM-dd").alias("effective_from")
    )


@query(
    "J11_register_assembly",
    """with r as (select o_custkey as code, o_orderkey::varchar as rid, year(o_orderdate)::int as y from orders where o_orderkey % 5 <> 0
), f as (select code, y, rid, max(l_quantity::int) as n from r join lineitem on l_orderkey::varchar = rid and l_linenumber = 1 group by all
), fte as (select * from (select *, row_number() over (partition by code order by y desc, rid desc) as k from f) where k = 1
), a as (select * from (select o_custkey as code, lpad((o_orderkey % 100000)::varchar, 5, '0') as industry_code, row_number() over (partition by o_custkey order by year(o_orderdate) desc, o_totalprice::decimal(20,2) desc, lpad((o_orderkey % 100000)::varchar, 5, '0') desc) as k
  from orders where o_orderstatus = 'F') where k = 1
), latest as (select * from (select *, row_number() over (partition by code order by y desc, rid desc) as k from r) where k = 1)
  select c_custkey as code, case when c_custkey % 2 = 0 then 'Tallinn' else 'Tartu' end as city, industry_code, n::double as employees_fte, fte.y as fte_year, case when c_custkey % 4 <> 0 then c_acctbal::decimal(20,2)::double end as share_capital,
    latest.rid as report_id, latest.y as report_year
  from customer left join fte on fte.code = c_custkey left join a on a.code = c_custkey left join latest on latest.code = c_custkey where c_custkey % 5 <> 0 and (c_mktsegment = 'BUILDING' or latest.code is not null)""",
)
def j11(spark: SparkSession, d: str) -> DataFrame:
    """Companies of the register put together from the basic file, reports, indicators, activities and capital."""
    s = lambda c: c.cast("string")
    k = F.col("c_custkey")
    c, o = table(spark, d, "customer"), table(spark, d, "orders")
    basic = c.select(
        s(k).alias("registry_code"), F.col("c_name").alias("legal_name"), F.when(k % 5 == 0, "FIE").otherwise("OÜ").alias("legal_form"), F.lit("R").alias("registry_status"), F.lit(None).cast("string").alias("vat_id"),
        F.when(k % 2 == 0, "Harju maakond, Tallinn").otherwise("Tartu maakond, Tartu linn").alias("units"),
    )
    year = F.year("o_orderdate")
    reports = o.select(
        s(F.col("o_custkey")).alias("registry_code"), s(F.col("o_orderkey")).alias("report_id"), F.lit("osaühing").alias("legal_form"), F.when(F.col("o_orderkey") % 5 == 0, "n/a").otherwise(s(year)).alias("fiscal_year")
    )
    staff = "AverageNumberOfEmployeesInFullTimeEquivalentUnits"
    indicators = table(spark, d, "lineitem").select(s(F.col("l_orderkey")).alias("report_id"), F.when(F.col("l_linenumber") == 1, staff).otherwise("Other").alias("element"), s(F.col("l_quantity").cast("int")).alias("raw"))
    activities = o.select(
        s(F.col("o_custkey")).alias("registry_code"), s(year).alias("fiscal_year"), (F.col("o_orderstatus") == "F").alias("is_main"), F.lpad(s(F.col("o_orderkey") % 100000), 5, "0").alias("industry_code"),
        F.lit("2008").alias("code_version"), s(F.col("o_totalprice").cast("decimal(20,2)")).alias("raw"),
    )
    entry = lambda n, amount, ends: F.struct(F.lit(n).alias("entry_no"), amount.alias("amount"), F.lit("EUR").alias("currency"), ends.alias("ends"))
    balance = s(F.col("c_acctbal").cast("decimal(20,2)"))
    general = c.select(s(k).alias("registry_code"), F.array(entry(2, balance, F.when(k % 4 == 0, F.lit("2020-01-01"))), entry(9, F.lit("1"), F.lit("2019-01-01"))).alias("entries"))
    known = c.where("c_mktsegment = 'BUILDING'").select(s(k).alias("registry_code"))
    found = register.assemble(basic, known, reports, indicators, activities, general)
    return found.select(
        F.col("registry_code").cast("long").alias("code"), "city", "industry_code", F.col("employees_fte").cast("double").alias("employees_fte"), "fte_year", F.col("share_capital").cast("double").alias("share_capital"),
        F.col("latest_report_id").alias("report_id"), F.col("latest_report_year").alias("report_year"),
    )


@query(
    "K06_decay_view",
    """with n as (select s_suppkey % 3 as k, min(s_name) as name from supplier group by all), s as (select c_custkey as id, c_custkey % 5 as v, c_custkey % 4 as stale, case c_custkey % 3 when 0 then 'flat' when 1 then 'shrinking' end as staff,
    case when c_custkey % 7 <> 0 then (c_custkey % 41 - 20) / 2.0 end as change, case when c_custkey % 2 = 0 then 'not reviewed' else 'reviewed' end as note from customer)
  select id as company_id, 'b' || id || '.ee' as domain_identifier, n.name as source_name, case v
    when 0 then 'website coasting: ' || stale || ' of 3 activity checks out of date, no open roles, revenue of 5.0 million euros or more (website estimate, ' || note || ')'
    when 1 then 'website on watch: no open roles, staff ' || coalesce(staff, 'flat or shrinking') || ', ' || case when change is null then 'change not known' else case when change >= 0 then '+' else '' end || printf('%.1f', change) || '%' end
      || ', revenue of 5.0 million euros or more (website estimate, ' || note || ')'
    when 2 then 'website decaying: ' || stale || ' of 3 activity checks out of date (website estimate, ' || note || ')' end as warning
  from s left join n on n.k = s.id % 3""",
)
def k06(spark: SparkSession, d: str) -> DataFrame:
    """The newest website signal of each company with its warning, source and first domain."""
    c, k = table(spark, d, "customer"), F.col("c_custkey")
    verdict = F.element_at(F.array(*map(F.lit, ["coasting", "watch", "decaying", "active", "insufficient_evidence"])), (k % 5 + 1).cast("int"))
    signal = F.struct(
        verdict.alias("verdict"), (k % 4).alias("stale_count"), F.when(k % 3 == 0, "flat").when(k % 3 == 1, "shrinking").alias("headcount"), F.when(k % 7 != 0, (k % 41 - 20).cast("double") / 2).alias("change_pct")
    )
    review = F.when(k % 2 == 0, "unreviewed").otherwise("accepted")
    newest = c.select(k.alias("company_id"), signal.alias("signal"), F.concat(F.lit("src"), (k % 3).cast("string")).alias("source_id"), F.lit("2025-02-01").cast("timestamp").alias("observed_at"), review.alias("review_status"))
    older = newest.withColumns({"observed_at": F.lit("2024-02-01").cast("timestamp"), "source_id": F.lit("gone")})
    name = lambda letter, day: c.select(k.alias("company_id"), F.lit("domain").alias("kind"), F.concat(F.lit(letter), k.cast("string"), F.lit(".ee")).alias("value"), F.lit(day).cast("date").alias("created_at"))
    sources = table(spark, d, "supplier").groupBy(F.concat(F.lit("src"), (F.col("s_suppkey") % 3).cast("string")).alias("source_id")).agg(F.min("s_name").alias("name"))
    return website.decay_view(newest.unionByName(older), name("a", "2024-05-05").unionByName(name("b", "2024-01-01")), sources).select("company_id", "domain_identifier", "source_name", "warning")
