"""Mixing sources to target weights by weighted fair queueing.

Documents of a source are shuffled by a hash of their id and offered in that order, up to `repeats`
times over. The virtual finish time of an offer is the source's words up to and including it,
divided by the source's target. All offers are then ordered by finish time and taken until the total
budget is spent, so every source stops near its target. Both running totals are distributed
(range partitions and offsets): a source with most of the rows is no single task.

Targets: sources in code-point order, null last, weigh 1, 2, 3, 1, 2, 3, ...; they share the budget
(the total size) by weight; a target stops at `repeats` times its source's size and the excess is
shared anew by weight among the others. In closed form the target is min(repeats * size, level *
weight), with the level at which targets add up to the budget.

Defined results: a null or empty text has size 0 and takes 0; repeated rows are documents of their
own; null ids and sources are allowed; a text may have any length; an empty table gives no rows; other columns do not matter
to `mix` and pass through `mixed` under any name.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from provena.llm.common import materialise, n_words, row_key, running_total

REPEATS = 3
WEIGHTS = (1, 2, 3)
SEED = "mix-1"


def shuffle_key(doc_id: Column, seed: str = SEED) -> Column:
    """60 bits of MD5 over the id and a seed: the same order in every run."""
    digest = F.md5(F.concat(F.coalesce(doc_id.cast("string"), F.lit("")), F.lit(f"|{seed}")).cast("binary"))
    return F.conv(F.substring(digest, 1, 15), 16, 10).cast("long")


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, repeats: int = REPEATS) -> DataFrame:
    """(no_source, source, source_size, target) of sizes(no_source int, source not null, size); one row a source.

    Ranks and sums over the sources are distributed running totals: there may be as many sources as hosts of a crawl.
    """
    one = F.lit(1).cast("long")
    totals = sizes.groupBy("no_source", "source").agg(F.sum("size").cast("long").alias("source_size")).withColumn("one", one)
    rank = (F.col("rank") - 1) % len(weights) + 1
    ranked = running_total(totals, [], ["no_source", "source"], "one", "rank").drop("one").withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), rank.cast("int")).cast("long"))
    most = (repeats * F.col("source_size")).cast("double")
    by_ratio = running_total(ranked.withColumn("ratio", most / F.col("weight")), [], ["ratio", "rank"], "source_size", "size_so_far")
    summed = materialise(running_total(by_ratio, [], ["ratio", "rank"], "weight", "weight_so_far"), "by-ratio")
    whole = summed.agg(F.sum("source_size").alias("size"), F.sum("weight").alias("weight")).first()
    left_size = F.lit(whole["size"]) - repeats * (F.col("size_so_far") - F.col("source_size"))
    left_weight = F.lit(whole["weight"]) - (F.col("weight_so_far") - F.col("weight"))
    level = left_size.cast("double") / left_weight
    at = summed.select("ratio", "rank", level.alias("level")).where("level <= ratio").agg(F.min(F.struct("ratio", "rank", "level"))["level"].alias("at")).first()["at"]
    return summed.select("no_source", "source", "source_size", F.least(most, F.lit(at).cast("double") * F.col("weight")).alias("target"))


def mix(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source",
    weights: tuple[int, ...] = WEIGHTS, repeats: int = REPEATS, seed: str = SEED, carry: tuple[str, ...] = (),
) -> DataFrame:
    """(doc_id, source, size, source_size, target, taken) for every row of docs, and the columns in `carry`."""
    sized = materialise(
        docs.select(
            F.col(doc_id).alias("doc_id"), F.col(source).alias("raw_source"), F.col(source).isNull().cast("int").alias("no_source"),
            F.coalesce(F.col(source).cast("string"), F.lit("")).alias("source"), n_words(F.col(text)).alias("size"),
            shuffle_key(F.col(doc_id), seed).alias("key"), *carry,
        ),
        "sized",
    )
    group = ["no_source", "source"]
    ordered = running_total(sized, group, ["key", "doc_id", "size"], "size", "so_far")
    shares = materialise(ordered.join(targets(sized, weights, repeats), group), "shares")

    def finish(turn: int) -> Column:
        return F.when(F.col("target") > 0, (turn * F.col("source_size") + F.col("so_far")).cast("double") / F.col("target"))

    def place(turn: int) -> Column:
        return F.struct(finish(turn).alias("finish"), F.lit(turn).alias("turn"), "key", "no_source", "source", "doc_id", "so_far")

    offers = shares.where("size > 0").select("size", F.explode(F.array(*map(place, range(repeats)))).alias("at")).select("size", "at.*")
    budget = sized.agg(F.coalesce(F.sum("size"), F.lit(0)).alias("n")).first()["n"]
    order = ["finish", "turn", "key", "no_source", "source", "doc_id", "so_far"]
    spent = running_total(offers, [], order, "size", "spent")
    last = spent.where(F.col("spent") <= budget).agg(F.max(F.struct(*order)).alias("last")).first()["last"]
    if last is None:
        taken = F.lit(0).cast("long")
    else:
        # Nulls sort first in both comparisons, as they do in the running total.
        stop = F.struct(*[F.lit(last[c]).cast(offers.schema[c].dataType).alias(c) for c in order])
        turns = sum((F.when(place(k) <= stop, 1).otherwise(0) for k in range(repeats)), F.lit(0))
        taken = F.when(F.col("size") > 0, F.col("size") * turns).otherwise(F.lit(0)).cast("long")
    return shares.select("doc_id", F.col("raw_source").alias("source"), "size", "source_size", "target", taken.alias("taken"), *carry)


def mixed(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source", **options) -> DataFrame:
    """The rows of docs that the mix takes, with _size, _source_size, _target and _taken (which replace columns named so).

    Rows that repeat id, text and source are copies: they have one size and target, and how often the mix takes them is counted and then dealt
    out to them in the order of a hash of the whole row, so a row that a third of the table repeats is no single task.
    """
    repeats = options.get("repeats", REPEATS)
    whose = row_key(F.col(doc_id), F.concat(F.when(F.col(source).isNull(), "-").otherwise(F.concat(F.lit("+"), F.col(source).cast("string"))), F.lit("|"), F.coalesce(F.concat(F.lit("+"), F.col(text).cast("string")), F.lit("-"))))
    keyed = docs.select(F.struct("*").alias("row"), whose.alias("key"))
    found = mix(docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"), F.col(source).alias("source"), whose.alias("row_key")), carry=("row_key",), **options)
    times = [F.count_if(F.col("taken") >= F.greatest(F.col("size"), F.lit(1)) * k).alias(f"at_least_{k}") for k in range(1, repeats + 1)]
    figures = found.groupBy("row_key").agg(F.max("size").alias("size"), F.max("source_size").alias("source_size"), F.max("target").alias("target"), F.count("*").alias("copies"), *times)
    figures = materialise(figures.where("at_least_1 > 0"), "figures")
    own = ["size", "source_size", "target", "taken"]
    kept = [F.col("row")[c].alias(c) for c in docs.columns if c not in {f"_{x}" for x in own}]

    def dealt(rows: DataFrame) -> DataFrame:
        """Copy number n is taken k times if the mix takes at least n copies k times."""
        taken = F.col("size") * sum((F.when(F.col(f"at_least_{k}") >= F.col("nth"), 1).otherwise(0) for k in range(1, repeats + 1)), F.lit(0))
        return rows.withColumn("taken", taken.cast("long")).where("taken > 0").select(*kept, *[F.col(c).alias(f"_{c}") for c in own])

    joined = keyed.withColumnRenamed("key", "row_key").join(figures, "row_key")
    single = dealt(joined.where("copies = 1").withColumn("nth", F.lit(1)))
    if figures.where("copies > 1").isEmpty():
        return single
    several = joined.where("copies > 1").select("*", F.lit(1).cast("long").alias("one"), F.xxhash64("row").alias("place"))
    return single.unionByName(dealt(running_total(several, ["row_key"], ["place"], "one", "nth")))


ORACLE = r"""
with sized as (
  select row_number() over () as rid, doc_id, source is null as no_source, coalesce(source, '') as source,
    coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::bigint as size,
    ('0x' || substr(md5(coalesce(doc_id::varchar, '') || '|mix-1'), 1, 15))::bigint as key from documents
), totals as (
  select no_source, source, sum(size)::bigint as source_size from sized group by all
), weighed as (
  select *, row_number() over (order by no_source, source) - 1 as rank, [1, 2, 3][(row_number() over (order by no_source, source) - 1) % 3 + 1] as weight from totals
), ratios as (
  select *, (3 * source_size)::double / weight as ratio from weighed
), levels as (
  select *, (sum(source_size) over () - 3 * coalesce(sum(source_size) over e, 0))::double / (sum(weight) over () - coalesce(sum(weight) over e, 0)) as level
  from ratios window e as (order by ratio, rank rows between unbounded preceding and 1 preceding)
), targets as (
  select no_source, source, source_size, least((3 * source_size)::double, (select first(level order by ratio, rank) from levels where level <= ratio) * weight) as target from levels
), shares as (
  select s.*, t.source_size, t.target, sum(s.size) over (partition by s.no_source, s.source order by s.key, s.doc_id nulls first, s.size rows unbounded preceding) as so_far
  from sized s join targets t using (no_source, source)
), offers as (
  select rid, size, key, no_source, source, doc_id, so_far, turn, (turn * source_size + so_far)::double / target as finish
  from shares, (select unnest([0, 1, 2]) as turn) where size > 0 and target > 0
), spent as (
  select *, sum(size) over (order by finish, turn, key, no_source, source, doc_id nulls first, so_far rows unbounded preceding) as spent from offers
), taken as (
  select rid, count(*) as n from spent where spent <= (select sum(size) from sized) group by rid
)
select doc_id, size, source_size, target, (size * coalesce(n, 0))::bigint as taken from shares left join taken using (rid)
"""
