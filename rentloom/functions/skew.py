"""Exact results for keys that may hold a large share of all rows."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

Stage = Callable[[DataFrame], DataFrame]


def numbered(df: DataFrame, keys: list[str], bucket: Column, order: list[Column], name: str) -> DataFrame:
    """1..n per key in (bucket, order) order, without sorting a whole key in one task.

    ``bucket`` must rise with the wanted order (a day, an hour, a leading sort column). Rows are numbered inside
    (key, bucket); the count of the earlier buckets is added from a small table of bucket sizes.
    """
    marked = df.withColumn("_bucket", bucket)
    local = marked.withColumn("_local", F.row_number().over(Window.partitionBy(*keys, "_bucket").orderBy(*order)))
    before = Window.partitionBy(*keys).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    sizes = (
        marked.groupBy(*keys, "_bucket")
        .count()
        .withColumn("_before", F.coalesce(F.sum("count").over(before), F.lit(0)))
        .drop("count")
    )
    out = local.join(sizes, [*keys, "_bucket"])
    return out.withColumn(name, F.col("_before") + F.col("_local")).drop("_bucket", "_local", "_before")


def carry_forward(df: DataFrame, keys: list[str], row: str, value: Column, name: str, chunk: int = 10_000) -> DataFrame:
    """Last non-null ``value`` at or above each row of a key, in ``row`` order.

    Keys are cut into chunks of row numbers. Inside a chunk a window carries the value; the last value of every
    chunk is carried over the short list of chunks. One huge key therefore never sits in a single task.
    """
    marked = df.withColumn("_chunk", F.floor(F.col(row) / chunk)).withColumn("_value", value)
    inside = Window.partitionBy(*keys, "_chunk").orderBy(row)
    local = marked.withColumn("_local", F.last("_value", ignorenulls=True).over(inside))
    ends = marked.groupBy(*keys, "_chunk").agg(
        F.max_by("_value", F.when(F.col("_value").isNotNull(), F.col(row))).alias("_end")
    )
    earlier = Window.partitionBy(*keys).orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    ends = ends.withColumn("_carried", F.last("_end", ignorenulls=True).over(earlier)).drop("_end")
    out = local.join(ends, [*keys, "_chunk"])
    return out.withColumn(name, F.coalesce("_local", "_carried")).drop("_chunk", "_value", "_local", "_carried")


def previous(
    df: DataFrame, keys: list[str], row: str, value: Column, name: str, chunk: int = 10_000, stage: Stage = lambda df: df
) -> DataFrame:
    """``value`` of the row just before, in ``row`` order and across chunks; NULL on the first row of a key.

    Each chunk of row numbers is scanned once by itself. Only its first row can miss its neighbour, which is the last row
    of an earlier chunk: a second scan over the first and last rows of all chunks finds it, and the mended first rows
    take the place of the others. Nothing is joined. ``stage`` may write the scanned rows, which are read twice."""
    marked = df.withColumn("_value", F.struct(value.alias("v")))
    inside = Window.partitionBy(*keys, "_chunk").orderBy(row)
    local = marked.withColumn("_chunk", F.floor(F.col(row) / chunk)).withColumns(
        {"_before": F.lag("_value").over(inside), "_last": F.lead("_value").over(inside).isNull()}
    )
    local = stage(local.drop("_chunk"))
    first = F.col("_before").isNull()
    over_ends = Window.partitionBy(*keys).orderBy(row, "_last")
    ends = local.filter(first | F.col("_last")).withColumn("_end", F.lag("_value").over(over_ends))
    mended = ends.filter(first).withColumn("_before", F.col("_end")).drop("_end")
    out = local.filter(~first).unionByName(mended)
    return out.withColumn(name, F.col("_before")["v"]).drop("_value", "_before", "_last")


def join_present(left: DataFrame, right: DataFrame, key: str, spread: list[str], scope: Sequence[str] = ()) -> DataFrame:
    """Left join on ``scope`` and on a key that may be NULL in most rows of ``left``.

    A NULL key matches nothing, but all of them (of one scope) would hash to one partition. Each gets a number made from the
    columns ``spread`` as one more key, so they are dealt out evenly; rows with a key join as ever.
    """
    number = F.when(F.col(key).isNull(), F.pmod(F.xxhash64(*spread), F.lit(1 << 20))).otherwise(F.lit(0))
    # Zero as well, but no literal: Spark takes a literal out of the join's keys, and the NULLs meet in one task again.
    zero = F.pmod(F.xxhash64(key), F.lit(1))
    marked = right.filter(F.col(key).isNotNull()).withColumn("_spread", zero.cast("bigint"))
    return left.withColumn("_spread", number.cast("bigint")).join(marked, [*scope, key, "_spread"], "left").drop("_spread")
