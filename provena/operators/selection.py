"""Exact medians of groups of any size: values are counted in ranges, and the range that holds the rank is counted again, finer."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from provena.sources.shared import materialise

#: Ranges that a group is counted in at a time, and the rows of the largest group up to which Spark's own median holds it in one task.
RANGES = 4096
GATHERED = 1 << 18


def _same(a: str, b: str, keys: list[str]) -> Column:
    return reduce(Column.__and__, [F.col(f"{a}.{k}").eqNullSafe(F.col(f"{b}.{k}")) for k in keys])


def ranked(values: DataFrame, targets: DataFrame, ranges: int = RANGES) -> DataFrame:
    """targets(g, m, t, rank) with `v`, the value of that rank (from 0) among values(g, m, v double, not null nor NaN) of the same g and m.

    Every round cuts what is left of a target, from its least to its greatest value, into equal ranges, counts them, and keeps the one that holds the
    rank. Only counts by range are gathered, so a group may hold all rows. The least and the greatest value never share a range, so the rounds end;
    a few do for values that spread evenly, one more for each power of `ranges` by which outliers exceed the rest.
    """
    values = materialise(values, "values")
    bounds = values.groupBy("g", "m").agg(F.min("v").alias("lo"), F.max("v").alias("hi")).alias("b")
    now = targets.alias("a").join(bounds, _same("a", "b", ["g", "m"])).select("a.*", "b.lo", "b.hi")
    found = None
    while True:
        now = materialise(now, "ranks")
        done = now.where("lo = hi").select("g", "m", "t", F.col("lo").alias("v"))
        found = done if found is None else found.unionByName(done)
        left = now.where("lo < hi")
        if left.isEmpty():
            return found
        near = values.alias("x").join(left.alias("a"), _same("x", "a", ["g", "m"]) & F.col("x.v").between(F.col("a.lo"), F.col("a.hi"))).select("a.*", "x.v")
        # Halved before they are subtracted: the range of two doubles may be more than a double holds.
        at = F.floor((F.col("v") / 2 - F.col("lo") / 2) / (F.col("hi") / 2 - F.col("lo") / 2) * ranges)
        part = F.when(F.col("v") == F.col("hi"), ranges).otherwise(F.least(at, F.lit(ranges - 1))).cast("int")
        counts = near.groupBy("g", "m", "t", "rank", part.alias("part")).agg(F.count("*").alias("n"), F.min("v").alias("lo"), F.max("v").alias("hi"))
        upto = F.sum("n").over(Window.partitionBy("g", "m", "t").orderBy("part"))  # ranges + 1 rows at most
        held = counts.withColumn("upto", upto).where((F.col("upto") > F.col("rank")) & (F.col("upto") - F.col("n") <= F.col("rank")))
        now = held.select("g", "m", "t", (F.col("rank") - F.col("upto") + F.col("n")).alias("rank"), "lo", "hi")


def medians(df: DataFrame, group: str, *values: str, gathered: int = GATHERED) -> DataFrame:
    """(group, n, <value>_median of each value): number of rows and medians of the values that are not null, as doubles; null if there is none."""
    counted = materialise(df.groupBy(group).agg(F.count("*").alias("n"), *[F.count(v).alias(f"_n_{v}") for v in values]), "group-sizes")
    largest = counted.agg(F.max("n")).first()[0] or 0
    if largest <= gathered:
        return df.groupBy(group).agg(F.count("*").alias("n"), *[F.median(v).alias(f"{v}_median") for v in values])
    pairs = F.explode(F.array(*[F.struct(F.lit(v).alias("m"), F.col(v).cast("double").alias("v")) for v in values]))
    long = df.select(F.col(group).alias("g"), pairs.alias("p")).select("g", "p.*").where("v is not null")
    sizes = counted.select(F.col(group).alias("g"), F.explode(F.array(*[F.struct(F.lit(v).alias("m"), F.col(f"_n_{v}").alias("n")) for v in values])).alias("p")).select("g", "p.*").where("n > 0")
    sides = F.posexplode(F.array(F.floor((F.col("n") - 1) / 2), F.floor(F.col("n") / 2))).alias("t", "rank")
    at = materialise(ranked(long, sizes.select("g", "m", sides)), "values-at-ranks")
    of = lambda v: F.when(F.col("m") == v, F.col("v"))
    wide = at.groupBy("g").agg(*[(0.5 * F.min(of(v)) + 0.5 * F.max(of(v))).alias(f"{v}_median") for v in values])
    joined = counted.alias("c").join(wide.alias("w"), F.col(f"c.{group}").eqNullSafe(F.col("w.g")), "left")
    return joined.select(F.col(f"c.{group}").alias(group), F.col("c.n").alias("n"), *[F.col(f"w.{v}_median").alias(f"{v}_median") for v in values])
