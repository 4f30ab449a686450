"""Agreement of several sources on one field: clusters, status, the value to show, and a label for every fact.

Evidence: company_id, field_name, source_id, observed_at, trust_rank, base_confidence, is_correction, and the claim: lo and hi of a
range (equal for exact numbers, hi null when open) or value, a text. fact_id is needed for labels only.

Per field the evidence is sorted by trust, width and recency and folded into clusters whose first member each later one is compared
with. Facts that agree in all that the fold looks at are reduced to the newest of them before they are gathered: what is
held of a field is its different claims, not its facts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from provena.functions import text as t
from provena.sources.shared import materialise

OPEN = 10**12
#: Fields whose texts are names of companies.
NAMES = ["legal_name", "trading_name"]
#: Different wordings of these fields are variants, not conflicts.
DESCRIPTIVE = ["sector", "description"]
CLAIM = ["value", "lo", "hi"]


def agree(a: Column, b: Column) -> Column:
    """Ranges agree when they overlap; a range without a lower end agrees with none."""
    overlap = (a["lo"] <= F.coalesce(b["hi"], F.lit(OPEN))) & (b["lo"] <= F.coalesce(a["hi"], F.lit(OPEN)))
    return F.coalesce(overlap, F.lit(False))


def agreement_key(field: Column, value: Column) -> Column:
    """What texts that agree have in common: the company's name key, a code without dots, else the text without case and outer space."""
    plain = F.replace(F.lower(F.trim(value)), F.lit("ß"), F.lit("ss"))
    return F.when(field.isin(NAMES), t.name_key(value)).when(field == "industry_code", F.replace(value, F.lit("."), F.lit(""))).otherwise(plain)


def texts_agree(field: Column, a: Column, b: Column) -> Column:
    return F.coalesce(agreement_key(field, a) == agreement_key(field, b), F.lit(False))


def _claims(evidence: DataFrame) -> DataFrame:
    """Evidence with all its columns, key and width."""
    kinds = {"value": "string", "lo": "bigint", "hi": "bigint", "fact_id": "bigint"}
    missing = {c: F.lit(None).cast(kind) for c, kind in kinds.items() if c not in evidence.columns}
    e = evidence.withColumns(missing) if missing else evidence
    width = F.when(F.col("lo").isNotNull(), F.coalesce("hi", F.lit(OPEN)) - F.col("lo")).otherwise(0)
    return e.withColumn("key", agreement_key(F.col("field_name"), F.col("value"))).withColumn("width", width.cast("bigint"))


ITEM = {"key": "string", "value": "string", "lo": "bigint", "hi": "bigint", "width": "bigint", "trust": "int", "base": "string"}


def clusters(sorted_evidence: str) -> Column:
    """Greedy clusters of an array of structs with ITEM's fields and source."""
    fields = ", ".join(f"'{k}', e.{k}" for k in ITEM)
    item, kind = f"named_struct({fields})", "struct<" + ", ".join(f"{k}: {v}" for k, v in ITEM.items()) + ">"
    joins = f"coalesce(c.first.key = e.key, c.first.lo <= coalesce(e.hi, {OPEN}) and e.lo <= coalesce(c.first.hi, {OPEN}), false)"
    grown = f"named_struct('first', c.first, 'best', case when e.width < c.best.width then {item} else c.best end, 'sources', array_union(c.sources, array(e.source)))"
    hit = f"array_position(transform(acc, c -> {joins}), true)"
    return F.expr(
        f"aggregate({sorted_evidence}, cast(array() as array<struct<first: {kind}, best: {kind}, sources: array<string>>>), "
        f"(acc, e) -> case when {hit} = 0 then concat(acc, array(named_struct('first', {item}, 'best', {item}, 'sources', array(e.source)))) "
        f"else transform(acc, (c, i) -> case when i = {hit} - 1 then {grown} else c end) end)"
    )


def _is_fresh(now: Column, stale_days: int) -> Column:
    return F.col("observed_at") >= now - F.make_dt_interval(F.lit(stale_days))


def _resolved(claims: DataFrame, now: Column, stale_days: int) -> DataFrame:
    """resolve with what labels need besides: the clusters, the deciding correction and old fact, and the kind of the result."""
    age = -F.unix_micros("observed_at")
    parts = ["company_id", "field_name", "is_correction", F.when(~F.col("is_correction"), _is_fresh(now, stale_days)).alias("fresh")]
    same = ["trust_rank", "width", "key", "lo", "hi", "source_id", "base_confidence"]
    newest = F.min(F.struct(age.alias("age"), F.col("fact_id"), F.col("value"))).alias("newest")
    different = claims.select(*parts, *same, "observed_at", "fact_id", "value").groupBy("company_id", "field_name", "is_correction", "fresh", *same).agg(newest)
    different = different.select("company_id", "field_name", "is_correction", "fresh", *same, "newest.*")
    entry = F.struct(
        F.col("trust_rank").alias("trust"), "width", "age", "key", "lo", "hi", F.col("source_id").alias("source"), F.col("base_confidence").alias("base"), "value", "fact_id"
    )
    source = ~F.col("is_correction")
    grouped = different.groupBy("company_id", "field_name").agg(
        F.sort_array(F.collect_list(F.when(source & F.col("fresh"), entry))).alias("current"),
        F.min(F.when(source, F.struct("trust_rank", "age", "lo", "hi", "value", "fact_id"))).alias("old"),
        F.min(F.when(F.col("is_correction"), F.struct("age", "lo", "hi", "value", "fact_id"))).alias("fixed"),
    )
    c = grouped.withColumn("clusters", clusters("current")).drop("current")
    first, several = F.get("clusters", 0), F.size("clusters") > 1
    descriptive = F.col("field_name").isin(DESCRIPTIVE)
    kind = F.when(several & ~descriptive, "conflicting").when(F.size(first["sources"]) > 1, "multi-source").when(F.size("clusters") > 0, "single").when(F.col("old").isNotNull(), "old").otherwise("unknown")
    return c.withColumn("kind", kind).withColumn("first", first["first"])


def resolve(evidence: DataFrame, now: Column, stale_days: int = 365) -> DataFrame:
    """(company_id, field_name, status, value, lo, hi, n_clusters, n_sources, conflicting) of each field.

    A correction wins. Else: two sources that agree are multi-source; disagreeing clusters conflict unless
    the field is descriptive; one source gives its own confidence; only old evidence is old. conflicting has the first
    claim of every further cluster, a range as lo-hi.
    """
    c = _resolved(_claims(evidence), now, stale_days)
    first = F.get("clusters", 0)
    status = F.when(F.col("fixed").isNotNull(), "manually-corrected").when(F.col("kind") == "single", first["first"]["base"]).otherwise(F.col("kind"))
    pick = lambda k: F.when(F.col("fixed").isNotNull(), F.col("fixed")[k]).when(F.size("clusters") > 0, first["best"][k]).otherwise(F.col("old")[k])
    shown = F.transform(F.slice("clusters", 2, F.greatest(F.size("clusters") - 1, F.lit(0))), lambda x: F.coalesce(x["first"]["value"], F.concat_ws("-", x["first"]["lo"], x["first"]["hi"])))
    return c.select(
        "company_id", "field_name", status.alias("status"), *[pick(k).alias(k) for k in CLAIM], F.size("clusters").cast("bigint").alias("n_clusters"),
        F.coalesce(F.size(first["sources"]), F.lit(0)).cast("bigint").alias("n_sources"), F.when(F.col("field_name").isin(DESCRIPTIVE), F.array().cast("array<string>")).otherwise(shown).alias("conflicting"),
    )


def label_facts(evidence: DataFrame, now: Column, stale_days: int = 365, *keep: str) -> DataFrame:
    """(company_id, field_name, fact_id, label, supporting) of every fact, and columns to keep: its own confidence, and whether it carries the shown value."""
    claims = _claims(evidence)
    # Written first: a join of facts with a table is one that AQE may split where a field has many facts.
    c = materialise(_resolved(claims, now, stale_days).select(F.col("company_id").alias("c"), F.col("field_name").alias("f"), "kind", "first", "fixed", "old"), "resolved")
    e = claims.join(c, (F.col("company_id") == F.col("c")) & (F.col("field_name") == F.col("f")))
    fresh, correction = _is_fresh(now, stale_days), F.col("is_correction")
    top = F.col("fact_id").eqNullSafe(F.col("fixed.fact_id"))
    chosen = F.coalesce(F.col("first.key") == F.col("key"), agree(F.col("first"), F.struct("lo", "hi")), F.lit(False))
    own_cluster = chosen | F.col("fact_id").eqNullSafe(F.col("old.fact_id"))
    label = (
        F.when(correction, F.when(top, "manually-corrected").otherwise("old")).when(~fresh, "old").when(F.col("kind") == "conflicting", "conflicting")
        .when((F.col("kind") == "multi-source") & chosen, "multi-source").otherwise(F.col("base_confidence"))
    )
    supporting = F.when(F.col("fixed").isNotNull(), correction & top).when(F.col("kind") == "old", ~correction & own_cluster).otherwise(~correction & fresh & chosen)
    return e.select("company_id", "field_name", "fact_id", label.alias("label"), F.coalesce(supporting, F.lit(False)).alias("supporting"), *keep)
