"""Whole reports from one pass over each input: quality of the data, coverage of the register, a company's page.

A row of the input says all that it counts for as an array of (section, key, n), which is summed once: totals, bands, years, gaps and flags come out of one scan
and one exchange of as many rows as the report has lines. A company's page is a table of lines with an order, not an array: a company
may have any share of the facts.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from provena.functions import numbers as m
from provena.functions import text as t
from provena.operators import confidence, signals
from provena.operators.register import BUCKETS
from provena.sources.shared import materialise

#: Words of a company's page for the states of a field.
UNKNOWN = "unknown"
LINE = ["company_id", "section", "place", "key", "value", "note"]


def entry(section: str, key: Column | str = "", when: Column | None = None, n: Column | int = 1) -> Column:
    """An entry of a report, null unless `when` holds."""
    key = F.lit(key) if isinstance(key, str) else key
    found = F.struct(F.lit(section).alias("section"), key.cast("string").alias("key"), (F.lit(n) if isinstance(n, int) else n).cast("long").alias("n"))
    return found if when is None else F.when(F.coalesce(when, F.lit(False)), found)


def each(section: str, values: Column) -> Column:
    """An entry for every value of an array of strings."""
    return F.transform(F.coalesce(values, F.array().cast("array<string>")), lambda v: F.struct(F.lit(section).alias("section"), v.alias("key"), F.lit(1).cast("long").alias("n")))


def _entries(df: DataFrame, *single: Column, arrays: tuple[Column, ...] = ()) -> DataFrame:
    return df.select(F.explode(F.concat(F.array_compact(F.array(*single)), *arrays)).alias("e")).select("e.*")


def summed(*entries: DataFrame) -> DataFrame:
    """(section, key, n) of all entries."""
    return reduce(DataFrame.unionByName, entries).groupBy("section", "key").agg(F.sum("n").alias("n"))


def _bucket(revenue: Column, buckets: list = BUCKETS) -> Column:
    name = lambda lo, hi: f"{lo}-{hi}" if hi else f"{lo}+"
    return reduce(lambda c, b: c.when((revenue >= b[0]) & (revenue < b[1]) if b[1] else revenue >= b[0], name(*b)), buckets, F.when(revenue < 0, "negative"))


def coverage(items: DataFrame, statements: DataFrame, fields: list[str], gaps: int = 10) -> DataFrame:
    """(section, key, n): companies, statuses, funnel steps, revenue of registered companies, why companies in the band lack evidence (the `gaps` most
    frequent reasons, years masked), flags, verdicts of companies for review, peer groups of eligible companies and how many have an index, latest
    years; rows and given fields of current statements by year and scope, and the lengths of their periods.

    items as funnel.prospects, read once; statements read once.
    """
    registered, band = t.is_registered(F.col("registry_status")), F.col("focus_band") == "core"
    complete, review = F.col("evidence_status") == "complete", F.col("next_action") == "advisor_review"
    eligible = registered & band & complete & ~F.col("holding")
    first = F.regexp_replace(F.get("issues", 0), r"\b(19|20)[0-9]{2}\b", "YYYY")
    of_items = _entries(
        items, entry("companies"), entry("status", F.coalesce("registry_status", F.lit("none"))), entry("step", "registered", registered), entry("step", "in_band", registered & band),
        entry("step", "complete", registered & band & complete), entry("action", F.col("next_action")), entry("revenue", _bucket(F.col("latest_revenue_eur")), registered & F.col("latest_revenue_eur").isNotNull()),
        entry("gap", first, registered & band & ~complete & first.isNotNull()), entry("verdict", F.col("verdict"), review & F.col("verdict").isNotNull()),
        entry("peer_group", F.coalesce("peer_group", F.lit("none")), eligible), entry("eligible", "", eligible), entry("eligible", "with index", eligible & F.col("peer_group").isNotNull() & F.col("peer_count").isNotNull()),
        entry("latest_year", F.col("latest_year"), registered & F.col("latest_year").isNotNull()), arrays=(each("flag", F.col("flags")),),
    )
    days, scope = m.period_days(F.col("period_start"), F.col("period_end")), F.coalesce("statement_scope", F.lit("unproven"))
    year = F.concat_ws(" ", "fiscal_year", scope)
    period = F.when(days.isNull(), "dates missing").when(days.between(330, 400), "12 months").otherwise("other length")
    given = [entry("given", F.concat_ws(" ", year, F.lit(f)), F.col(f).isNotNull()) for f in fields]
    of_statements = _entries(statements.where(signals.is_current()), entry("rows", year), entry("period", period), *given)
    counts = materialise(summed(of_items, of_statements), "coverage")
    # A few lines by now: as many as there are different reasons.
    top = counts.where("section = 'gap'").orderBy(F.desc("n"), "key").limit(gaps)
    groups = counts.where(f"section = 'peer_group' and key <> 'none' and n >= {signals.MIN_PEERS}").select(F.lit("peer_groups_indexed").alias("section"), F.lit("").alias("key"), F.lit(1).cast("long").alias("n"))
    return counts.where("section <> 'gap'").unionByName(top).unionByName(groups.groupBy("section", "key").agg(F.sum("n").alias("n")))


def conflicts(facts: DataFrame, companies: DataFrame) -> DataFrame:
    """(company_id, field_name, n_values, resolved): fields with conflicting open facts of companies, and whether a correction settles them."""
    per_field = facts.groupBy("company_id", "field_name").agg(F.count_if("conflicting").alias("n_values"), F.max("is_correction").alias("resolved"))
    return per_field.where("n_values > 0").join(companies.select("company_id"), "company_id", "left_semi")


def quality(
    companies: DataFrame, facts: DataFrame, records: DataFrame, candidates: DataFrame, snapshots: DataFrame, now: Column, fields: list[str], stale_days: int = 365, warnings: int = 15
) -> DataFrame:
    """(section, key, n): totals of companies that are not merged away by qualification and review status, stale ones, average completeness in percent, fields missing,
    conflicts (all and not settled by a correction), open duplicate candidates, records that failed, the most frequent warnings, snapshots expired and due.

    companies: company_id, merged_into_id, employee_min, employee_max, review_status, verified_on. facts: open ones with company_id, field_name, conflicting, is_correction.
    records: status, warnings. candidates: status. snapshots: expired_at, expires_at. Each is read once.
    """
    own = companies.where("merged_into_id is null")
    per_field = facts.groupBy("company_id", "field_name").agg(F.max("conflicting").alias("conflicting"), F.max("is_correction").alias("resolved"))
    # One row a field that a company has: as many as there are field names.
    field = F.struct("field_name", "conflicting", "resolved")
    have = materialise(per_field.groupBy("company_id").agg(F.collect_list(field).alias("have")), "fields")
    joined = own.join(have, "company_id", "left").withColumn("have", F.coalesce("have", F.expr("cast(array() as array<struct<field_name: string, conflicting: boolean, resolved: boolean>>)")))
    named, required = F.transform("have", lambda f: f["field_name"]), F.array(*map(F.lit, fields))
    share = F.bround(100 * F.size(F.array_intersect(named, required)) / len(fields)).cast("long")
    fresh = m.freshness(F.col("verified_on").cast("timestamp"), now, stale=stale_days)
    open_fields = F.filter("have", lambda f: f["conflicting"])
    of_companies = _entries(
        joined, entry("companies"), entry("qualification", m.qualification(F.col("employee_min"), F.col("employee_max"))), entry("review_status", F.coalesce("review_status", F.lit("none"))),
        entry("stale", "", fresh.isin("stale", "unknown")), entry("completeness", "", n=share), entry("conflicts", "", F.size(open_fields) > 0, F.size(open_fields)),
        entry("conflicts", "not settled", F.exists(open_fields, lambda f: ~f["resolved"]), F.size(F.filter(open_fields, lambda f: ~f["resolved"]))), arrays=(each("missing", F.array_except(required, named)),),
    )
    cut = F.transform(F.coalesce("warnings", F.array().cast("array<string>")), lambda w: F.trim(F.substring_index(w, "'", 1)))
    of_records = _entries(records, entry("records", F.col("status"), F.col("status").isNotNull()), arrays=(each("warning", cut),))
    of_candidates = _entries(candidates, entry("duplicates", F.col("status")))
    gone = F.col("expired_at").isNotNull()
    of_snapshots = _entries(snapshots, entry("snapshots", "expired", gone), entry("snapshots", "due", ~gone & (F.col("expires_at") <= now)), entry("snapshots", "all"))
    counts = materialise(summed(of_companies, of_records, of_candidates, of_snapshots), "quality")
    of = lambda section: F.max(F.when(F.col("section") == section, F.col("n")))
    average = counts.agg(F.bround(of("completeness") / of("companies")).cast("long").alias("n")).select(F.lit("completeness").alias("section"), F.lit("average").alias("key"), "n").where("n is not null")
    top = counts.where("section = 'warning'").orderBy(F.desc("n"), "key").limit(warnings)
    return counts.where("section not in ('completeness', 'warning')").unionByName(average).unionByName(top)


def _lines(df: DataFrame, section: str, place: Column, key: Column, value: Column, note: Column) -> DataFrame:
    text = [c.cast("string").alias(n) for n, c in zip(LINE[3:], (key, value, note), strict=True)]
    return df.select("company_id", F.lit(section).alias("section"), place.cast("long").alias("place"), *text)


def company_pages(
    companies: DataFrame, evidence: DataFrame, now: Column, fields: list[str], financials: DataFrame, shareholders: DataFrame, candidates: DataFrame, audits: DataFrame, stale_days: int = 365
) -> DataFrame:
    """(company_id, section, place, key, value, note): the page of every company as lines, which a reader sorts by section and place.

    `field`: every one of `fields`, with its value, and its state, number of supporting facts and their sources. `fact`: every fact with its value and label, newest
    first. `timeline`: facts, corrections and audit events, newest first. `financial`: current statements, newest year first. `shareholder`: the largest first, those without a
    share last. `duplicate`: candidates by falling score. `warning`: what a reader should know. A company without evidence has unknown fields.

    companies: company_id, employee_min, employee_max, verified_on, registry_id. evidence as confidence.label_facts. financials: company_id, fiscal_year, scope, revenue.
    shareholders: company_id, name, percent. candidates: a, b, score, status. audits: company_id, action, at. A company may have any share of the facts: nothing of
    a company is gathered, but the sources and figures of its fields.
    """
    evidence = materialise(evidence, "evidence")
    resolved = materialise(confidence.resolve(evidence, now, stale_days), "resolved")
    labels = materialise(confidence.label_facts(evidence, now, stale_days, "source_id", "value", "observed_at", "is_correction"), "labels")
    support = labels.where("supporting").groupBy("company_id", "field_name").agg(F.count("*").alias("n_support"), F.array_join(F.sort_array(F.collect_set("source_id")), ",").alias("sources"))
    asked = companies.select("company_id", F.posexplode(F.array(*map(F.lit, fields))).alias("at", "field_name"))
    keys = ["company_id", "field_name"]
    view = materialise(asked.join(resolved, keys, "left").join(support, keys, "left").withColumn("status", F.coalesce("status", F.lit(UNKNOWN))), "fields")
    state = F.concat_ws("|", "status", F.coalesce("n_support", F.lit(0)).cast("string"), F.coalesce("sources", F.lit("")))
    newest = -F.unix_micros("observed_at")
    mine = labels.join(companies.select("company_id"), "company_id", "left_semi")
    event = F.when(F.col("is_correction"), "correction").otherwise("fact")
    seen = audits.join(companies.select("company_id"), "company_id", "left_semi")
    both = candidates.select(F.col("a").alias("company_id"), F.col("b").alias("other"), "score", "status").unionByName(candidates.select(F.col("b").alias("company_id"), F.col("a").alias("other"), "score", "status"))
    both = materialise(both.join(companies.select("company_id"), "company_id", "left_semi"), "candidates")
    open_ones = both.where("status = 'open'").groupBy("company_id").agg(F.count("*").alias("n_open"))

    kind, fresh = m.qualification(F.col("employee_min"), F.col("employee_max")), m.freshness(F.col("verified_on").cast("timestamp"), now, stale=stale_days)
    told = companies.join(open_ones, "company_id", "left").select(
        "company_id",
        F.explode(
            F.array_compact(
                F.array(
                    F.when(kind.isin("sub_scale", "unknown_headcount", "borderline"), F.struct(F.lit("headcount").alias("key"), kind.alias("value"))),
                    F.when(fresh == "stale", F.struct(F.lit("freshness").alias("key"), fresh.alias("value"))),
                    F.when(F.col("registry_id").isNull(), F.struct(F.lit("registry_id").alias("key"), F.lit("missing").alias("value"))),
                    F.when(F.col("n_open") > 0, F.struct(F.lit("duplicates").alias("key"), F.concat(F.col("n_open").cast("string"), F.lit(" open")).alias("value"))),
                )
            )
        ).alias("w"),
    )
    doubtful = view.where(F.col("status").isin("conflicting", "old"))
    nothing = F.lit(None)
    return reduce(
        DataFrame.unionByName,
        [
            _lines(view, "field", F.col("at"), F.col("field_name"), F.col("value"), state),
            _lines(mine, "fact", newest, F.col("fact_id"), F.col("value"), F.concat_ws("|", "field_name", "label")),
            _lines(mine, "timeline", newest, event, F.col("field_name"), F.col("source_id")),
            _lines(seen, "timeline", -F.unix_micros("at"), F.lit("audit"), F.col("action"), nothing),
            _lines(financials, "financial", -F.col("fiscal_year"), F.col("fiscal_year"), F.col("revenue"), F.col("scope")),
            _lines(shareholders, "shareholder", F.coalesce(-F.round(F.col("percent") * 10_000), F.lit(1)), F.col("name"), F.col("percent"), nothing),
            _lines(both, "duplicate", -F.col("score"), F.col("other"), F.col("score"), F.col("status")),
            _lines(doubtful, "warning", F.lit(0), F.col("field_name"), F.col("status"), F.when(F.col("status") == "conflicting", F.col("n_clusters"))),
            _lines(told, "warning", F.lit(1), F.col("w.key"), F.col("w.value"), nothing),
        ],
    )
