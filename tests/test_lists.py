"""Search against scans, pages against offsets, and rounding against Python's own."""

import random

import pytest
from pyspark.sql import functions as F

from provena.functions import numbers
from provena.operators import search
from provena.sources import register_files


def test_search_equals_a_scan(spark):
    r = random.Random(1)
    rows = [(i, "".join(r.choices("abcAB é%_", k=r.randint(0, 7))), r.choice([None, "", "Tallinn", "tal"])) for i in range(200)]
    asked = ["a", "AB", "abc", "cab", "é", "% ", "tal", "TALL", "linn", "n", "zzz", "", None, "abcab"]
    df = spark.createDataFrame(rows, "k long, name string, city string")
    queries = spark.createDataFrame(list(enumerate(asked)), "query int, q string")
    found = search.search(search.postings(df, "k", "name", "city"), df, queries, "k", "name", "city").collect()
    want = {(n, k) for n, q in enumerate(asked) if q for k, name, city in rows if q.lower() in name.lower() or q.lower() in (city or "").lower()}
    assert sorted(map(tuple, found)) == sorted(want)
    assert search.search(search.postings(df.limit(0), "k", "name"), df.limit(0), queries, "k", "name").collect() == []


@pytest.mark.parametrize("size", [1, 7, 500])
def test_pages_equal_offsets(spark, size):
    r = random.Random(2)
    rows = [(i, r.choice([None, *range(6)]), r.choice("xyz")) for i in range(60)]
    df = spark.createDataFrame(rows, "k long, n int, name string")
    ordered = sorted(rows, key=lambda x: (x[1] is None, -(x[1] or 0), x[2], x[0]))
    indexed = search.page_index(df, F.col("n").isNull(), -F.col("n"), F.col("name"), F.col("k"), size=size)
    for number in {1, 2, (59 // size) + 1, 59 // size + 2}:
        assert [tuple(x) for x in search.page(indexed, number).collect()] == ordered[(number - 1) * size : number * size]
    assert indexed[1].count() == -(-60 // size)


def test_no_pages(spark):
    indexed = search.page_index(spark.createDataFrame([], "k long"), F.col("k"))
    assert search.page(indexed, 1).collect() == []


def test_rounding_is_pythons(spark):
    r = random.Random(3)
    values = [0.5, 1.5, 2.5, -0.5, -1.5, 2.675, 1.005, 0.125, 0.375, 1e-9, -2.5, 0.285, 1.115, 1e12 + 0.5, None, 0.0, *[r.uniform(-1e6, 1e6) for _ in range(200)], *[r.randrange(-10**6, 10**6) / 1000 for _ in range(400)]]
    df = spark.createDataFrame([(v,) for v in values], "x double")
    for digits in (0, 1, 2, 4):
        found = [x["y"] for x in df.select(numbers.round_half_even(F.col("x"), digits).alias("y")).collect()]
        assert found == [None if v is None else float(round(v, digits)) for v in values]


def test_years():
    assert register_files.indicator_years(None, [2019, 2020]) == [2019, 2020]
    assert register_files.indicator_years(["2020", 2019, 2020], [2019, 2020]) == [2019, 2020]
    with pytest.raises(ValueError, match="2030"):
        register_files.indicator_years([2030], [2019, 2020])
