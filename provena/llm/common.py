"""Helpers that several operators share: words, shared tables, distributed running totals."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from provena.sources.shared import materialise, new_path, shared_dir

__all__ = ["as_bytes", "materialise", "n_words", "new_path", "partitions", "row_key", "running_total", "shared_dir"]

#: A word is a maximal run of characters other than ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
WHITE = b" \t\n\r\x0b\x0c"
#: UTF-8 continuation bytes; without them one byte stands for one code point.
CONTINUATION = bytes(range(0x80, 0xC0))

def as_bytes(texts: pa.Array) -> list[bytes]:
    """UTF-8 bytes of each text of an Arrow batch; null counts as empty."""
    return [b or b"" for b in texts.cast(pa.binary()).to_pylist()]


def n_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def row_key(doc_id: Column, text: Column) -> Column:
    """128 bits of MD5 over id and text: rows share it only if they repeat both."""
    own = F.coalesce(doc_id.cast("string"), F.lit("-"))
    return F.md5(F.concat(own, F.when(text.isNull(), F.lit("-")).otherwise(F.concat(F.lit("+"), text.cast("string")))).cast("binary"))


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def running_total(df: DataFrame, groups: list[str], order: list[str], value: str, out: str) -> DataFrame:
    """Inclusive running sum of `value` by `order`, within each combination of `groups` (not null).

    A group may hold any share of the rows: rows are range-partitioned by (groups, order), each
    partition sums its own share, and the shares of earlier partitions are added. Rows that agree on
    all of `order` are interchangeable.
    """
    spark = df.sparkSession
    ranged = materialise(
        df.repartitionByRange(partitions(spark), *groups, *order).withColumn("_pid", F.spark_partition_id()), "ranged"
    )
    share = ranged.groupBy("_pid", *groups).agg(F.sum(value).alias("_share"))
    before = Window.partitionBy(*(groups or [F.lit(0)])).orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    offset = share.select("_pid", *groups, F.coalesce(F.sum("_share").over(before), F.lit(0)).alias("_before"))
    within = Window.partitionBy("_pid", *groups).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return (
        ranged.withColumn("_within", F.sum(value).over(within))
        .join(offset, ["_pid", *groups])
        .withColumn(out, F.col("_within") + F.col("_before"))
        .drop("_pid", "_within", "_before")
    )
