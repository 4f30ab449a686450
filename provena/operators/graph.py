"""Graphs as edge tables: connected components and pointer chains."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from provena.sources.shared import drop, materialise


def _both_ways(edges: DataFrame) -> DataFrame:
    return edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))


def _state(edges: DataFrame) -> tuple:
    row = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
    return tuple(row)


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """(id, label) for each end of an edge (a long, b long); label is the smallest id of the component.

    Each round links the neighbours of a node to their least one: only minima are gathered, and they are written before they
    are joined, so that AQE may split the rows of a hub: a join with an aggregation is not split. Joins are by merging: no table goes through the driver.
    Rounds stop when the edges no longer change.
    """
    star = materialise(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    last = _state(star)
    for _ in range(rounds):
        if not last[0]:
            break
        both, before = _both_ways(star), star
        least = materialise(both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m")), "least")
        large = both.join(least.hint("merge"), "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b")
        large = materialise(large.distinct(), "large")
        lower = materialise(large.groupBy("a").agg(F.min("b").alias("m")), "lower")
        small = large.join(lower.hint("merge"), "a").select(F.explode(F.array(F.struct("b", "m"), F.struct(F.col("a").alias("b"), "m"))).alias("e"))
        star = materialise(small.select(F.col("e.b").alias("a"), F.col("e.m").alias("b")).where("a <> b").distinct(), "small")
        drop(before, least, large, lower)
        now = _state(star)
        if now == last:
            break
        last = now
    else:
        raise RuntimeError(f"components did not settle in {rounds} rounds")
    labels = star.groupBy("a").agg(F.min("b").alias("label")).select(F.col("a").alias("id"), "label")
    return labels.unionByName(labels.select(F.col("label").alias("id"), "label").distinct())


def canonical(pointers: DataFrame, rounds: int = 64) -> DataFrame:
    """(id, root) for pointers(id long, to long or null): follow `to` until it ends; a cycle stops at its least id.

    Pointer jumping: every round doubles the length of the chains that are already followed. `low` is the
    least id on the way; on a cycle it settles at the cycle's least id. Rounds join by merging: no table goes through the driver.
    """
    now = materialise(pointers.select("id", F.coalesce("to", "id").alias("root"), F.col("id").alias("low")), "pointers")
    last = None
    for _ in range(rounds):
        ahead = now.select(F.col("id").alias("root"), F.col("root").alias("next"), F.col("low").alias("then"))
        now = now.join(ahead.hint("merge"), "root", "left").select("id", F.coalesce("next", "root").alias("next"), "root", F.least("low", "then").alias("low"))
        now = materialise(now, "pointers")
        going = now.where("next <> root")
        state = tuple(going.agg(F.count("*"), F.sum(F.col("low").cast("decimal(38,0)"))).first())
        now = now.select("id", F.col("next").alias("root"), "low")
        if state[0] == 0 or state == last:
            break
        last = state
    ends = now.select(F.col("id").alias("root"), F.when(F.col("root") == F.col("id"), F.col("id")).otherwise(F.col("low")).alias("end"))
    return now.join(ends.hint("merge"), "root", "left").select("id", F.coalesce("end", "root").alias("root"))
