"""A register import as one version of all its tables, with its input kept so that the run can be repeated, and views kept up by change.

`import_run` keeps the input rows of a run, merges companies, addresses, financials and shareholders into their ledgers and commits all of it at
once: readers see the whole import or nothing of it. Every row has one outcome (`ledger`). `retry` runs a stored run's input
again under another name; what is stored already comes out unchanged. `maintain` recomputes a view for the keys that changed since
it was last kept up, from the buckets of these keys only.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from provena.operators import ledger, versions, website
from provena.sources.shared import materialise
from provena.sources.versioned import Change, Store, Version

#: Keys and values of an import's ledgers.
TABLES = {
    "companies": (["registry_code"], ["legal_name", "country", "status"]),
    "addresses": (["registry_code"], ["address", "city"]),
    "financials": (["registry_code", "fiscal_year", "scope"], ["report_id", "revenue", "operating_profit", "employees_fte"]),
    "shareholders": (["registry_code"], ["n", "set_hash"]),
}
FACT_KEYS = ["company_id", "source_id", "field_name"]
INPUTS = ["companies", "addresses", "reports", "holders"]


def _problems(**checks: Column) -> Column:
    return F.array_compact(F.array(*[F.when(F.coalesce(bad, F.lit(True)), F.lit(text.replace("_", " "))) for text, bad in checks.items()]))


def register_plan(inputs: dict[str, DataFrame], countries: list[str]) -> dict[str, ledger.Batch]:
    """Batches of the four ledgers from an import's input.

    companies(row, registry_code, legal_name, country, status), addresses(row, registry_code, address, city), reports(row, registry_code, report_id,
    fiscal_year, scope, period_start, period_end, revenue, operating_profit, employees_fte), holders(registry_code, name, role, share): all with observed_at. Of
    addresses, reports and holders those of companies that the import accepts count; others are rejected, and holders left out. A company's
    shareholders are one row: their number and a hash of the whole ordered set.
    """
    companies = inputs["companies"].withColumn(
        "errors",
        _problems(registry_code_is_missing=F.trim("registry_code") == "", legal_name_is_missing=F.trim("legal_name") == "", country_is_not_covered=~F.col("country").isin(countries)),
    )
    accepted = materialise(companies.where(F.size("errors") == 0).select("registry_code").distinct(), "accepted").withColumn("known", F.lit(True))
    known = lambda df: df.join(accepted, "registry_code", "left").withColumn("known", F.coalesce("known", F.lit(False)))
    addresses = known(inputs["addresses"]).withColumn("errors", _problems(unknown_company=~F.col("known"), address_is_missing=F.trim("address") == ""))
    period = F.datediff("period_end", "period_start")
    reports = known(inputs["reports"]).withColumn("errors", _problems(unknown_company=~F.col("known"), fiscal_year_is_missing=F.col("fiscal_year").isNull(), period_is_not_valid=~F.coalesce(period > 0, F.lit(False))))
    holders = inputs["holders"].join(accepted, "registry_code", "left_semi")
    sets = versions.set_versions(holders, "registry_code", "name", "role", "share")
    seen = holders.groupBy("registry_code").agg(F.max("observed_at").alias("observed_at"))
    rows = {"companies": companies, "addresses": addresses, "financials": reports, "shareholders": sets.join(seen, "registry_code").withColumn("row", F.col("registry_code")).withColumn("errors", F.array().cast("array<string>"))}
    return {
        name: ledger.Batch(df.select(*dict.fromkeys([*TABLES[name][0], *TABLES[name][1], "row", "observed_at", "errors"])), *TABLES[name], errors="errors")
        for name, df in rows.items()
    }


Plan = Callable[[dict[str, DataFrame]], dict[str, ledger.Batch]]


def import_run(store: Store, run: str, inputs: dict[str, DataFrame], plan: Plan, details: dict | None = None) -> Version:
    """Keep the run's input and merge what plan(inputs) makes of it, all in one version; a run that is committed is not applied again."""
    last = store.latest()
    if run in last.runs:
        return store.kept(last.runs[run]) or last
    # Read by the plan and by the store.
    inputs = {name: materialise(df, f"input-{name}") for name, df in inputs.items()}
    kept = {f"input_{name}": Change(df.withColumn("run", F.lit(run)), ["run"]) for name, df in inputs.items()}
    return ledger.load(store, run, plan(inputs), details, kept)


def stored_inputs(store: Store, run: str, names: list[str]) -> dict[str, DataFrame]:
    """The input of a committed run, as it was."""
    last = store.latest()
    if run not in last.runs:
        raise LookupError(run)
    bucket = ledger.touched(store.spark.range(1).select(F.lit(run).alias("run")), ["run"], 32)
    return {name: store.read(f"input_{name}", last, bucket).where(F.col("run") == run).drop("run") for name in names}


def retry(store: Store, run: str, again: str, plan: Plan, names: list[str] = INPUTS) -> Version:
    """Run the stored input of `run` once more, as `again`."""
    return ledger.load(store, again, plan(stored_inputs(store, run, names)), {"retry_of": run})


def outcome_counts(store: Store, version: Version | None = None) -> DataFrame:
    """(run, name, outcome, n) of all committed runs."""
    return store.read("outcomes", version).groupBy("run", "name", "outcome").agg(F.count("*").alias("n"))


def changed_keys(store: Store, source: str, keys: list[str], since: Version, until: Version) -> DataFrame:
    """Keys of rows that versions after `since` have appended to a ledger; only these parts are read."""
    known = {n for names in since.parts.get(source, {}).values() for n in names}
    fresh = {b: [n for n in names if n not in known] for b, names in until.parts.get(source, {}).items()}
    return store.read(source, Version(until.number, tables=until.tables, parts={source: {b: names for b, names in fresh.items() if names}})).select(*keys).distinct()


def maintain(store: Store, run: str, view: str, source: str, by: list[str], compute: Callable[[DataFrame], DataFrame], buckets: int = 32) -> Version:
    """Keep `view` up with the ledger `source`: compute(log rows) again for the keys `by` that changed since the view's last run.

    The ledger must be laid out by `by` (its own keys or their first). compute gives a row a key; the newest row of a key counts
    (`view_rows`). Reads the changed parts, then the ledger's buckets of changed keys.
    """

    def build(base: Version) -> tuple[dict[str, Change], dict]:
        last = max((n for r, n in base.runs.items() if r.startswith(f"{view}@")), default=0)
        since = store.kept(last) if last else None
        changed = materialise(changed_keys(store, source, by, since or Version(), base), "changed-keys")
        at = ledger.touched(changed, by, base.tables[source].buckets)
        log = store.read(source, base, at)
        match = F.lit(True)
        for k in by:
            match &= log[k].eqNullSafe(changed[k])
        rows = compute(log.join(changed, match, "left_semi")).withColumn("_made", F.lit(base.number + 1).cast("long"))
        return {view: Change(materialise(rows, "view"), by, buckets)}, {"buckets_read": len(at), "buckets_of_source": base.tables[source].buckets}

    return store.commit(f"{view}@{run}", build)


def view_rows(store: Store, view: str, by: list[str], version: Version | None = None) -> DataFrame:
    """The newest row of each key of a maintained view."""
    rows = store.read(view, version)
    rest = [c for c in rows.columns if c not in (*by, "_made")]
    return rows.groupBy(*by).agg(F.max_by(F.struct(*rest), "_made").alias("r")).select(*by, "r.*")


def domain_batch(general: DataFrame, companies: DataFrame, source: str) -> ledger.Batch:
    """The batch of facts that a register's contact entries make: one `registry_domains` fact a company, its active web and mail domains in their order.

    general(row, registry_code, entries array of (kind, value, ends), observed_at), companies(company_id, registry_code). Entries of unknown companies are
    rejected; those without a domain of their own make no fact.
    """
    found = general.select("row", "registry_code", "observed_at", F.array_join(website.contact_domains(F.col("entries")), ",").alias("value")).where("value <> ''")
    rows = found.join(companies.select("company_id", "registry_code"), "registry_code", "left")
    rows = rows.withColumn("errors", _problems(unknown_company=F.col("company_id").isNull())).withColumns({"source_id": F.lit(source), "field_name": F.lit("registry_domains")})
    return ledger.Batch(rows.select("company_id", "source_id", "field_name", "value", "row", "observed_at", "errors"), FACT_KEYS, ["value"], errors="errors", by=["company_id"])
