"""Lists that do not read everything: text search by trigram postings, and pages by seek key instead of offset."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from provena.sources.shared import materialise

GRAM = 3
#: Stands after the end of a text, so that every letter begins a gram.
END = "\x00"
PAGE = 50


def _grams(text: Column) -> Column:
    """The different grams that the letters of a text begin, the last ones filled up."""
    filled = F.concat(text, F.lit(END * (GRAM - 1)))
    return F.when(F.length(text) > 0, F.array_distinct(F.transform(F.sequence(F.lit(1), F.length(text)), lambda i: F.substring(filled, i, F.lit(GRAM))))).otherwise(F.array().cast("array<string>"))


def postings(rows: DataFrame, row_id: str, *texts: str) -> tuple[DataFrame, DataFrame]:
    """(gram, id) of every gram of the lower-cased texts, and (gram, n), in how many rows a gram is: two written tables."""
    grams = F.array_distinct(F.concat(*[_grams(F.lower(F.coalesce(F.col(t), F.lit("")))) for t in texts]))
    found = materialise(rows.select(F.col(row_id).alias("id"), F.explode(grams).alias("gram")), "postings")
    return found, materialise(found.groupBy("gram").agg(F.count("*").alias("n")), "gram-counts")


def search(index: tuple[DataFrame, DataFrame], rows: DataFrame, queries: DataFrame, row_id: str, *texts: str) -> DataFrame:
    """(query, id): the rows whose texts hold each query (query id, q), in any case; an empty or null query finds nothing.

    Only rows of the query's rarest gram are looked at, and verified. A query of fewer letters than a gram stands at the beginning of some grams:
    the rows of all of these are found.
    """
    posted, counts = index
    asked = queries.select(F.col("query"), F.lower("q").alias("q")).where("q <> ''")
    asked = materialise(asked, "queries")
    # All grams of a query of full length; the filled-up ones at its end are no grams of a text that goes on.
    long = asked.where(F.length("q") >= GRAM).select("query", "q", F.explode(F.filter(_grams(F.col("q")), lambda g: ~g.endswith(END))).alias("gram"))
    known = long.join(counts, "gram", "left")
    rarest = known.groupBy("query", "q").agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "gram")).alias("g")).select("query", "q", "g.gram")
    starts = reduce(DataFrame.unionByName, [counts.select("gram", F.substring("gram", 1, k).alias("q")) for k in range(1, GRAM)])
    short = asked.where(F.length("q") < GRAM).join(starts, "q").select("query", "q", "gram")
    wanted = materialise(rarest.unionByName(short), "wanted-grams")
    candidates = posted.join(wanted, "gram").select("query", "q", "id").distinct()
    both = candidates.join(rows.select(F.col(row_id).alias("id"), *[F.lower(t).alias(f"_{k}") for k, t in enumerate(texts)]), "id")
    holds = reduce(Column.__or__, [F.coalesce(F.contains(F.col(f"_{k}"), F.col("q")), F.lit(False)) for k in range(len(texts))])
    return both.where(holds).select("query", "id")


def page_index(df: DataFrame, *order: Column, size: int = PAGE) -> tuple[DataFrame, DataFrame]:
    """(rows, index): df written in the order of the columns, which must tell all rows apart, and (page, key), the key that each page begins with, from page 1.

    Rows are dealt by range and counted by partition; a row's rank is its place in the partition and the counts of those before. A null
    sorts first: give `column is null` before a column for nulls last, and negate a number for falling order.
    """
    spark = df.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    names = [f"_k{k}" for k in range(len(order))]
    keyed = df.select("*", *[c.alias(name) for name, c in zip(names, order, strict=True)])
    rows = materialise(keyed.repartitionByRange(n, *names).sortWithinPartitions(*names).withColumn("_pid", F.spark_partition_id()), "pages")
    # As many rows as there are partitions.
    before = Window.orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    offsets = rows.groupBy("_pid").agg(F.count("*").alias("n")).withColumn("before", F.coalesce(F.sum("n").over(before), F.lit(0))).drop("n")
    rank = F.row_number().over(Window.partitionBy("_pid").orderBy(*names)) + F.col("before")
    first = rows.join(F.broadcast(offsets), "_pid").withColumn("_rank", rank).where((F.col("_rank") - 1) % size == 0)
    index = first.select(((F.col("_rank") - 1) / size + 1).cast("long").alias("page"), F.struct(*names).alias("key"))
    return rows, materialise(index, "page-index")


def page(indexed: tuple[DataFrame, DataFrame], number: int) -> DataFrame:
    """The rows of one page: a range of keys, whatever the page's number; none beyond the last page."""
    rows, index = indexed
    bounds = {r["page"]: r["key"] for r in index.where(F.col("page").isin(number, number + 1)).collect()}
    names = [c for c in rows.columns if c.startswith("_k")]
    own = rows.drop(*names, "_pid")
    if number not in bounds:
        return own.limit(0)
    key = F.struct(*names)

    def at(bound) -> Column:
        return F.struct(*[F.lit(bound[n]).cast(rows.schema[n].dataType).alias(n) for n in names])

    found = rows.where(key >= at(bounds[number]))
    # The first column alone may be pushed down to the scan, whose row groups are in this order.
    lead = bounds[number][names[0]]
    found = found if lead is None else found.where(F.col(names[0]) >= F.lit(lead).cast(rows.schema[names[0]].dataType))
    if number + 1 in bounds:
        found = found.where(key < at(bounds[number + 1]))
        lead = bounds[number + 1][names[0]]
        found = found if lead is None else found.where(F.col(names[0]).isNull() | (F.col(names[0]) <= F.lit(lead).cast(rows.schema[names[0]].dataType)))
    return found.orderBy(*names).drop(*names, "_pid")
