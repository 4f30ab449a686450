"""Versioned rows as a log: what a batch changes is appended, what it leaves alone is neither read nor written again.

A ledger table has a row for each version of a key that began, and one more whenever a version was seen again: (keys, values, version,
valid_from, last_seen). The state of a key is its newest version with the latest time it was seen; a version ends when the next begins. A batch reads only
the buckets that its keys fall into, appends to these, and is committed once under its run's name, for any number of tables together
(`versioned.Store`). `compact` puts the parts of crowded buckets into one, which changes no result.

Outcomes of a batch's rows: `rejected` (they carry errors), `duplicate` (an earlier row of the batch has the key), `new` (no version yet), `changed`
(another value: a new version), `unchanged` (seen again). Null parts of a key or value equal each other.
"""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from provena.sources.shared import materialise
from provena.sources.versioned import Change, Store, Version, bucket_of

STATE = ["version", "valid_from", "last_seen"]


@dataclass
class Batch:
    """Rows for one ledger table: keys and values by name, `row` orders rows of one key, `at` is the time they were observed, `errors` an array."""

    rows: DataFrame
    keys: list[str]
    values: list[str]
    row: str = "row"
    at: str = "observed_at"
    errors: str | None = None
    buckets: int = 32
    by: list[str] | None = None  # what rows are laid out by, the keys unless given

    @property
    def layout(self) -> list[str]:
        return self.by or self.keys


def touched(rows: DataFrame, keys: list[str], buckets: int) -> list[int]:
    """Buckets of the rows' keys: as many numbers as there are buckets at most."""
    return sorted(r[0] for r in rows.select(bucket_of(keys, buckets)).distinct().collect())


def _same(a: str, b: str, columns: list[str]) -> Column:
    out = F.lit(True)
    for c in columns:
        out &= F.col(f"{a}.{c}").eqNullSafe(F.col(f"{b}.{c}"))
    return out


def newest(log: DataFrame, keys: list[str], values: list[str]) -> DataFrame:
    """The open version of each key of a log."""
    state = F.max(F.struct("version", "last_seen", "valid_from", *values))
    return log.groupBy(*keys).agg(state.alias("_s")).select(*keys, *[f"_s.{c}" for c in [*values, *STATE]])


def merged(stored: DataFrame, batch: Batch) -> tuple[DataFrame, DataFrame]:
    """(outcomes, delta): row and outcome of each row of the batch, whose rows are a written table, and the log rows to append; stored is the log of the buckets touched."""
    bad = F.size(batch.errors) > 0 if batch.errors else F.lit(False)
    rows = batch.rows.withColumn("_bad", F.coalesce(bad, F.lit(False)))
    entry = F.min(F.struct(F.col(batch.row).alias("_row"), F.col(batch.at).alias("_at"), *batch.values))
    # Reduced before anything is joined: a key with most of the batch's rows is one row here.
    first = rows.where("not _bad").groupBy(*batch.keys).agg(entry.alias("_n")).alias("b")
    open_now = newest(stored, batch.keys, batch.values).alias("a")
    both = first.join(open_now, _same("a", "b", batch.keys), "left")
    outcome = F.when(F.col("a.version").isNull(), "new").when(_same("a", "_n", batch.values), "unchanged").otherwise("changed")
    told = materialise(
        both.select(
            *[F.col(f"b.{k}").alias(k) for k in batch.keys], F.col("_n._row").alias("_row"), outcome.alias("_outcome"), *[F.col(f"_n.{v}").alias(v) for v in batch.values],
            (F.coalesce("a.version", F.lit(0)) + F.when(outcome == "unchanged", 0).otherwise(1)).cast("int").alias("version"),
            F.when(outcome == "unchanged", F.col("a.valid_from")).otherwise(F.col("_n._at")).alias("valid_from"),
            F.when(outcome == "unchanged", F.greatest("a.last_seen", "_n._at")).otherwise(F.col("_n._at")).alias("last_seen"),
            F.col("a.last_seen").alias("_seen"),
        ), "told",
    )
    of_row = told.select(*batch.keys, "_row", "_outcome").alias("t")
    joined = rows.alias("r").join(of_row, _same("r", "t", batch.keys) & ~F.col("r._bad"), "left")
    found = F.when(F.col("r._bad"), "rejected").when(F.col(f"r.{batch.row}") == F.col("t._row"), F.col("t._outcome")).otherwise("duplicate")
    outcomes = joined.select(F.col(f"r.{batch.row}").alias("row"), found.alias("outcome"))
    again = (F.col("_outcome") != "unchanged") | (F.col("last_seen") > F.col("_seen"))
    return outcomes, told.where(again).select(*batch.keys, *batch.values, *STATE)


def changes_of(store: Store, base: Version, run: str, batches: dict[str, Batch]) -> tuple[dict[str, Change], dict]:
    """What merging the batches appends to a version's tables, and counts by table and outcome."""
    changes, counts, told = {}, {}, None
    for name, batch in batches.items():
        # Written before its buckets are asked for: rows that a plan makes are made once.
        batch = replace(batch, rows=materialise(batch.rows, "batch"))
        if name in base.tables:
            stored = store.read(name, base, touched(batch.rows, batch.layout, batch.buckets))
        else:
            stored = batch.rows.select(*batch.keys, *batch.values, F.lit(0).alias("version"), F.col(batch.at).alias("valid_from"), F.col(batch.at).alias("last_seen")).limit(0)
        outcomes, delta = merged(stored, batch)
        changes[name] = Change(materialise(delta, "delta"), batch.layout, batch.buckets)
        rows = outcomes.select(F.lit(run).alias("run"), F.lit(name).alias("name"), F.col("row").cast("string").alias("row"), "outcome")
        told = rows if told is None else told.unionByName(rows)
    told = materialise(told, "outcomes")
    for r in told.groupBy("name", "outcome").count().collect():
        counts.setdefault(r["name"], {})[r["outcome"]] = r["count"]
    return changes | {"outcomes": Change(told, ["run", "name", "row"], 32)}, counts


def load(store: Store, run: str, batches: dict[str, Batch], details: dict | None = None, also: dict[str, Change] | None = None) -> Version:
    """Merge a batch of rows into each table and commit all of it, and other changes, as one version; a run that is committed is not applied again.

    The version's details hold counts by table and outcome. Outcomes of all rows go to the table `outcomes` (run, name, row, outcome).
    """

    def build(base: Version) -> tuple[dict[str, Change], dict]:
        changes, counts = changes_of(store, base, run, batches)
        return changes | (also or {}), {"counts": counts, **(details or {})}

    return store.commit(run, build)


def current(store: Store, name: str, keys: list[str], values: list[str], version: Version | None = None, buckets: list[int] | None = None) -> DataFrame:
    return newest(store.read(name, version, buckets), keys, values)


def history(store: Store, name: str, keys: list[str], values: list[str], version: Version | None = None) -> DataFrame:
    """Every version of every key, with the time the next one began."""
    log = store.read(name, version)
    spans = log.groupBy(*keys, "version").agg(F.max(F.struct("last_seen", "valid_from", *values)).alias("_s")).select(*keys, "version", "_s.*")
    # The next version of a key is a join of the key and the number, not a window over the key.
    after = spans.select(*[F.col(k).alias(f"_{k}") for k in keys], (F.col("version") - 1).alias("_before"), F.col("valid_from").alias("valid_to"))
    same = F.col("version") == F.col("_before")
    for k in keys:
        same &= F.col(k).eqNullSafe(F.col(f"_{k}"))
    return spans.join(after, same, "left").select(*keys, *values, *STATE, "valid_to")


def compact(store: Store, run: str, name: str, keys: list[str], values: list[str], parts: int = 4) -> Version:
    """Put the parts of buckets with over `parts` of them into one part each, one row a version: results stay as they are."""

    def build(base: Version) -> tuple[dict[str, Change], dict]:
        crowded = [b for b, names in base.parts.get(name, {}).items() if len(names) > parts]
        if not crowded:
            return {}, {"compacted": 0}
        rows = store.read(name, base, crowded).groupBy(*keys, "version").agg(F.max(F.struct("last_seen", "valid_from", *values)).alias("_s"))
        rows = rows.select(*keys, *[f"_s.{v}" for v in values], "version", "_s.valid_from", "_s.last_seen")
        return {name: Change(rows, base.tables[name].keys, base.tables[name].buckets, crowded)}, {"compacted": len(crowded)}

    return store.commit(run, build)
