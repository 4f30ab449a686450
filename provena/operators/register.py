"""Importing an official register: reports, indicators, activities, capital, addresses, coverage."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from provena.functions import numbers as m
from provena.functions import text as t
from provena.operators import signals
from provena.functions.text import let

# Fixed values ---------------------------------------------------------------------------------

LEGAL_FORMS = ["ou", "as", "uu", "tu", "tuh", "se"]
FORM_NAMES = {"osauhing": "ou", "aktsiaselts": "as", "usaldusuhing": "uu", "taisuhing": "tu", "tulundusuhistu": "tuh", "euroopaariuhing": "se"}
IGNORED_TABLES = ["likvideerimise", "loppbilanss", "rahavoog", "rahavoogude", "kasumi jaot", "kasumijaot", "pdf"]
ELEMENTS = {
    "Revenue": "revenue", "EBITDA": "ebitda", "TotalAnnualPeriodProfitLoss": "net_income", "TotalProfitLoss": "operating_profit", "TotalProfitLossBeforeTax": "profit_before_tax",
    "EmployeeExpense": "labour_cost", "DepreciationAndImpairmentLossReversal": "depreciation_and_impairment", "Assets": "total_assets", "Equity": "equity",
    "AverageNumberOfEmployeesInFullTimeEquivalentUnits": "employees_fte",
}
UNIT_ENDINGS = {"county": " maakond", "rural_municipality": " vald", "city_district": " linnaosa", "town": " linn"}
BUCKETS = [(0, 1_000_000), (1_000_000, 2_000_000), (2_000_000, 5_000_000), (5_000_000, 10_000_000), (10_000_000, 20_000_000), (20_000_000, 50_000_000), (50_000_000, None)]


def legal_form(c: Column) -> Column:
    """Folded letters and digits of a legal form, long names abbreviated."""
    compact = F.regexp_replace(t.fold(c), "[^a-z0-9]", "")
    return F.coalesce(t.lookup(FORM_NAMES, F.coalesce(compact, F.lit(""))), compact)


def code_version(c: Column) -> Column:
    """Version of the activity code list, without the list's name; null for a blank."""
    return t.blank_to_null(F.regexp_replace(F.trim(c), "^EMTAK ", ""))


def is_ignored_table(name: Column) -> Column:
    """Statement tables that hold no comparable figures."""
    return F.coalesce(t.fold(t.collapse(name)).rlike("|".join(IGNORED_TABLES)), F.lit(False))


def eligible_reports(reports: DataFrame) -> DataFrame:
    """Reports with ids, an integer year and a legal form that files comparable accounts."""
    year = F.col("fiscal_year").try_cast("int")
    form = legal_form(F.col("legal_form"))
    there = lambda c: F.coalesce(F.trim(c) != "", F.lit(False))
    return reports.withColumn("fiscal_year", year).where(there(F.col("report_id")) & there(F.col("registry_code")) & year.isNotNull() & form.isin(LEGAL_FORMS))


def latest_by_year(rows: DataFrame, key: str, year: str, order: list[str]) -> DataFrame:
    """Last row of the newest year of each key; later rows win within a year."""
    rest = [c for c in rows.columns if c != key]
    return rows.groupBy(key).agg(F.max_by(F.struct(*rest), F.struct(year, *order)).alias("r")).select(key, "r.*")


def statement_scope(table_name: Column, element: Column, consolidated: Column) -> Column:
    """standalone, consolidated or null, by the table's name, the element's ending, then the report's flag."""
    name = t.fold(table_name)
    return (
        F.when(name.startswith("konsolideerimata"), "standalone").when(name.startswith("konsolideeritud") | element.endswith("Consolidated"), "consolidated")
        .when(~consolidated, "standalone")
    )


def choose_metrics(indicators: DataFrame, metrics: dict[str, str]) -> DataFrame:
    """One row a (report_id, scope) with a column a metric, and how many alternates differ.

    indicators: report_id, scope, table_name, element, raw, is_detail, line_no. The main table goes before a detail table,
    then the shorter name, the name, the line; if the chosen value does not parse, the metric is missing.
    """
    metric = t.lookup(metrics, F.col("element"))
    known = indicators.withColumn("metric", metric).where("metric is not null")
    order = F.struct("is_detail", F.length("table_name").alias("n"), "table_name", "line_no")
    picked = known.groupBy("report_id", "scope", "metric").agg(F.min_by("raw", order).alias("raw"), F.count_distinct("raw").alias("n_values"))
    value = m.decimal_of(F.col("raw"))
    wanted = sorted(set(metrics.values()))
    columns = [F.max(F.when(F.col("metric") == w, value)).alias(w) for w in wanted]
    return picked.groupBy("report_id", "scope").agg(*columns, F.count_if(F.col("n_values") > 1).alias("differing"))


def derived_ebitda(statements: DataFrame) -> DataFrame:
    """EBITDA where reported, else operating profit less depreciation where both are; and which of the two it is."""
    sum_of = F.col("operating_profit") - F.col("depreciation")
    kind = F.when(F.col("ebitda").isNotNull(), "reported").when(sum_of.isNotNull(), "derived")
    return statements.withColumn("ebitda_type", kind).withColumn("ebitda", F.coalesce("ebitda", sum_of))


def current_capital(entries: Column) -> Column:
    """Of an array of (entry_no, amount, currency, ends) the open entry with the highest number."""
    return F.array_max(F.filter(entries, lambda e: e["ends"].isNull()))


def unit_type(part: Column) -> Column:
    c = F.when(part == "Tallinn", "tallinn")
    for kind, ending in UNIT_ENDINGS.items():
        c = c.when(part.endswith(ending), kind)
    return c.when(part.rlike("( alevik| alev)$"), "borough").when(F.regexp_extract(part, "^(.*?)(?: / .*)?$", 1).endswith("küla"), "village").otherwise("unknown")


def address_parts(units: Column) -> Column:
    """struct(county, municipality, city, warnings) of comma-separated administrative units; ambiguous parts stay null."""
    parts = F.filter(F.transform(F.split(units, ","), lambda p: F.trim(p)), lambda p: p != "")

    def parse(p: Column) -> Column:
        of = lambda kind: F.array_distinct(F.filter(p, lambda x: unit_type(x) == kind))
        county, rural, town, tallinn, unknown = of("county"), of("rural_municipality"), of("town"), of("tallinn"), of("unknown")
        settled = F.exists(p, lambda x: unit_type(x).isin("village", "borough"))
        n = F.size
        municipality = (
            F.when((n(rural) == 1) & (n(tallinn) == 0), F.get(rural, 0)).when((n(tallinn) == 1) & (n(rural) == 0) & (n(town) == 0), "Tallinn")
            .when((n(rural) == 0) & (n(tallinn) == 0) & (n(town) == 1), F.get(town, 0))
        )
        in_tallinn = (n(tallinn) == 1) & (n(rural) == 0) & (n(town) == 0) & ~settled
        city = F.when(in_tallinn, "Tallinn").when(settled, None).when((n(town) == 1) & (n(tallinn) == 0), F.regexp_replace(F.get(town, 0), " linn$", ""))
        warnings = F.array_compact(
            F.array(
                F.when(n(unknown) > 0, F.concat(F.lit("unrecognised units: "), F.array_join(unknown, ", "))),
                F.when(n(county) > 1, F.lit("several counties")).when(n(county) == 0, F.lit("no county")),
                F.when(municipality.isNull(), F.lit("municipality ambiguous")),
                F.when(~in_tallinn & ~settled & city.isNull() & (n(tallinn) + n(town) > 0), F.lit("city ambiguous")),
            )
        )
        return F.struct(F.when(n(county) == 1, F.get(county, 0)).alias("county"), municipality.alias("municipality"), city.alias("city"), warnings.alias("warnings"))

    return let(parts, parse)


# Coverage ---------------------------------------------------------------------------------------


def field_coverage(statements: DataFrame, fields: list[str]) -> DataFrame:
    """Rows and given values per fiscal year and scope."""
    scope = F.coalesce("statement_scope", F.lit("unproven"))
    return statements.where(signals.is_current()).groupBy("fiscal_year", scope.alias("scope")).agg(F.count("*").alias("n"), *[F.count(f).alias(f) for f in fields])


def period_buckets(statements: DataFrame) -> DataFrame:
    days = m.period_days(F.col("period_start"), F.col("period_end"))
    kind = F.when(days.isNull(), "dates missing").when(days.between(330, 400), "12 months").otherwise("other length")
    return statements.where(signals.is_current()).groupBy(kind.alias("period")).agg(F.count("*").alias("n"))


def revenue_histogram(statements: DataFrame, buckets: list = BUCKETS) -> DataFrame:
    """Half-open revenue buckets, each there even when empty, and negative revenue."""
    name = lambda lo, hi: f"{lo}-{hi}" if hi else f"{lo}+"
    r = F.col("revenue")
    kind = F.when(r < 0, "negative")
    for lo, hi in buckets:
        kind = kind.when((r >= lo) & (r < hi) if hi else r >= lo, name(lo, hi))
    counts = statements.where(signals.is_current() & r.isNotNull()).groupBy(kind.alias("bucket")).agg(F.count("*").alias("n"))
    all_names = statements.sparkSession.createDataFrame([(name(*b),) for b in buckets] + [("negative",)], "bucket string")
    return all_names.join(counts, "bucket", "left").select("bucket", F.coalesce("n", F.lit(0)).alias("n"))


def first_issues(items: DataFrame, limit: int = 10) -> DataFrame:
    """Most frequent first issue, with years masked."""
    text = F.regexp_replace(F.get("issues", 0), r"\b(19|20)[0-9]{2}\b", "YYYY")
    return items.where(F.size("issues") > 0).groupBy(text.alias("issue")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "issue").limit(limit)


def counters(items: DataFrame) -> DataFrame:
    """(kind, value, n): statuses, verdicts, flags and latest years."""
    long = items.select(
        F.explode(
            F.concat(
                F.array(F.struct(F.lit("status").alias("kind"), F.coalesce("registry_status", F.lit("none")).alias("value"))),
                F.array(F.struct(F.lit("verdict").alias("kind"), F.coalesce("verdict", F.lit("none")).alias("value"))),
                F.array(F.struct(F.lit("year").alias("kind"), F.coalesce(F.col("latest_year").cast("string"), F.lit("none")).alias("value"))),
                F.transform("flags", lambda f: F.struct(F.lit("flag").alias("kind"), f.alias("value"))),
            )
        ).alias("x")
    )
    return long.groupBy("x.kind", "x.value").agg(F.count("*").alias("n"))


# Assembly -----------------------------------------------------------------------------------------

#: What an official shareholder entry may give. Everything else it carries (personal codes, birth dates, home addresses) is never read.
SHAREHOLDER = (
    "array<struct<isiku_tyyp: string, eesnimi: string, nimi_arinimi: string, isikukood_registrikood: string, valis_kood: string, valis_kood_riik: string, isiku_roll_tekstina: string, "
    "osaluse_suurus: string, osaluse_valuuta: string, osaluse_protsent: string, osaluse_omandiliik_tekstina: string, algus_kpv: string, lopp_kpv: string>>"
)


def shareholders(records: DataFrame) -> DataFrame:
    """One row a holder of records(registry_code, osanikud SHAREHOLDER); entries without a name go.

    The register number of a person is never kept, only that of a legal entity.
    """
    own = lambda c: t.blank_to_null(F.col(f"h.{c}"))
    kind = F.when(own("isiku_tyyp") == "F", "person").when(own("isiku_tyyp") == "J", "legal_entity").otherwise("unknown")
    entity = kind == "legal_entity"
    name = F.when(kind == "person", F.nullif(F.concat_ws(" ", own("eesnimi"), own("nimi_arinimi")), F.lit(""))).otherwise(own("nimi_arinimi"))
    rows = records.select("registry_code", F.explode("osanikud").alias("h"))
    found = rows.select(
        "registry_code", kind.alias("holder_type"), name.alias("holder_name"), F.when(entity, F.coalesce(own("isikukood_registrikood"), own("valis_kood"))).alias("holder_registry_code"),
        F.when(entity, own("valis_kood_riik")).alias("holder_country"), own("isiku_roll_tekstina").alias("role"), m.decimal_of(F.col("h.osaluse_suurus")).alias("holding_amount"),
        own("osaluse_valuuta").alias("holding_currency"), m.decimal_of(F.col("h.osaluse_protsent")).alias("holding_percent"), own("osaluse_omandiliik_tekstina").alias("holding_type"),
        m.date_of(F.col("h.algus_kpv")).alias("effective_from"), m.date_of(F.col("h.lopp_kpv")).alias("effective_to"),
    )
    return found.where("holder_name is not null")


def company_shareholders(records: DataFrame, companies: DataFrame) -> DataFrame:
    """Shareholders of the known companies(company_id, registry_code), the current and largest first within a company."""
    held = shareholders(records).join(companies.select("company_id", "registry_code"), "registry_code")
    return held.withColumn("current", F.col("effective_to").isNull())


def in_order(holders: DataFrame) -> DataFrame:
    """Current holders before former ones, then by share, then by name."""
    return holders.orderBy("company_id", F.desc("current"), F.desc_nulls_last("holding_percent"), "holder_name")


def latest_fte(reports: DataFrame, indicators: DataFrame) -> DataFrame:
    """(registry_code, fte_year, employees_fte): full-time staff in the newest eligible report that gives it; later report ids win."""
    given = indicators.where(t.lookup(ELEMENTS, F.col("element")) == "employees_fte").select("report_id", m.decimal_of(F.col("raw")).alias("employees_fte")).where("employees_fte is not null")
    best = given.groupBy("report_id").agg(F.max("employees_fte").alias("employees_fte"))
    both = eligible_reports(reports).select("registry_code", "report_id", "fiscal_year").join(best, "report_id")
    return latest_by_year(both, "registry_code", "fiscal_year", ["report_id"]).select("registry_code", F.col("fiscal_year").alias("fte_year"), "employees_fte")


def latest_activity(activities: DataFrame) -> DataFrame:
    """(registry_code, activity_year, industry_code, code_version) of the main activity of the newest year; of equal years the larger revenue, then the code."""
    main = activities.where("is_main").select("registry_code", F.col("fiscal_year").try_cast("int").alias("activity_year"), "industry_code", "code_version", m.decimal_of(F.col("raw")).alias("r"))
    order = F.struct("activity_year", F.coalesce("r", F.lit(-1)).alias("r"), "industry_code")
    best = main.where("activity_year is not null").groupBy("registry_code").agg(F.max_by(F.struct("activity_year", "industry_code", "code_version"), order).alias("a"))
    return best.select("registry_code", "a.*")


def assemble(basic: DataFrame, known: DataFrame, reports: DataFrame, indicators: DataFrame, activities: DataFrame, general: DataFrame, forms: list[str] = LEGAL_FORMS) -> DataFrame:
    """One row a company of the basic file that is in scope (a known registry_code or an eligible report) with an accepted legal form.

    basic: registry_code, legal_name, legal_form, registry_status, vat_id, units (comma-separated administrative units). general:
    registry_code, entries as current_capital takes them. Staff, activity and capital are joined by code, each reduced to one row a code first.
    Rows of a code are one company: the last by name and status.
    """
    scope = known.select("registry_code").union(eligible_reports(reports).select("registry_code")).distinct()
    code = t.blank_to_null(F.col("registry_code"))
    own = basic.withColumn("registry_code", code).where(code.isNotNull() & legal_form(F.col("legal_form")).isin(forms))
    rest = [c for c in own.columns if c != "registry_code"]
    one = own.groupBy("registry_code").agg(F.max(F.struct("legal_name", "registry_status", *[c for c in rest if c not in ("legal_name", "registry_status")])).alias("b")).select("registry_code", "b.*")
    capital = general.select("registry_code", current_capital(F.col("entries")).alias("c")).where("c is not null").groupBy("registry_code").agg(F.max("c").alias("c"))
    latest = eligible_reports(reports).groupBy("registry_code").agg(F.max(F.struct("fiscal_year", "report_id")).alias("report"))
    df = one.join(scope, "registry_code", "left_semi")
    for part in (latest_fte(reports, indicators), latest_activity(activities), capital, latest):
        df = df.join(part, "registry_code", "left")
    place = let(address_parts(F.col("units")), lambda a: a)
    return df.withColumn("place", place).select(
        F.concat(F.lit("EE:"), "registry_code").alias("source_key"), "registry_code", "legal_name", F.lit("EE").alias("country"), F.col("place.city").alias("city"), F.col("place.county").alias("county"),
        F.col("place.municipality").alias("municipality"), "vat_id", "registry_status", "industry_code", "code_version", "employees_fte", "fte_year", F.col("c.amount").alias("share_capital"), F.col("c.currency").alias("currency"),
        F.col("report.report_id").alias("latest_report_id"), F.col("report.fiscal_year").alias("latest_report_year"), F.col("place.warnings").alias("warnings"),
    )
