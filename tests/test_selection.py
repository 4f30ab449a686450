"""Medians by counting against sorted lists, on groups of all sizes and one with all rows."""

import random
import statistics

import pytest

from provena.operators import selection, signals

SCHEMA = "g string, a double, b double, n long"


def table(spark, rows):
    return spark.createDataFrame([(*r, 0) for r in rows], SCHEMA)


def expected(rows):
    out = {}
    for g in {r[0] for r in rows}:
        mine = [[r[c] for r in rows if r[0] == g and r[c] is not None] for c in (1, 2)]
        out[g] = (sum(r[0] == g for r in rows), *[statistics.median(v) if v else None for v in mine])
    return out


def found(df):
    return {r["g"]: (r["n"], r["a_median"], r["b_median"]) for r in df.collect()}


@pytest.mark.parametrize("gathered", [0, 10**6])
def test_random_groups(spark, gathered):
    r = random.Random(3)
    value = lambda: r.choice([None, 0.0, -1.5, 1e-300, 1e300, -1e307, 1e307, r.random(), r.gauss(0, 1e6), float(r.randrange(5))])
    rows = [(r.choice(["x", "y", "z", None]), value(), value()) for _ in range(300)] + [("one", 2.5, None), ("two", 1.0, 3.0), ("two", 2.0, 3.0)]
    assert found(selection.medians(table(spark, rows), "g", "a", "b", gathered=gathered)) == expected(rows)


def test_one_group_with_all_rows_and_few_ranges(spark):
    r = random.Random(4)
    rows = [("all", r.lognormvariate(0, 3), float(r.randrange(3))) for _ in range(3001)]
    assert found(selection.medians(table(spark, rows), "g", "a", "b", gathered=0)) == expected(rows)
    values = table(spark, rows).selectExpr("g", "'a' as m", "a as v")
    ranks = spark.createDataFrame([("all", "a", k, rank) for k, rank in enumerate((0, 1, 1500, 2999, 3000))], "g string, m string, t int, rank long")
    ordered = sorted(x[1] for x in rows)
    assert {x["t"]: x["v"] for x in selection.ranked(values, ranks, ranges=7).collect()} == {k: ordered[i] for k, i in enumerate((0, 1, 1500, 2999, 3000))}


def test_reference_is_the_same_both_ways(spark):
    r = random.Random(5)
    rows = [(r.choice("xy"), r.gauss(1, 2), r.random()) for _ in range(200)]
    ways = [sorted(map(tuple, signals.robust_reference(table(spark, rows), "g", "a", "b", gathered=n).select("g", "peer_count", "a_median", "b_median", "a_spread", "b_spread").collect())) for n in (0, 10**6)]
    assert ways[0] == ways[1] and len(ways[0]) == 2


def test_empty(spark):
    assert found(selection.medians(table(spark, []), "g", "a", "b", gathered=0)) == {}
