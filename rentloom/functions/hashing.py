"""Canonical JSON and SHA-256 digests."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def canonical_json(**fields: Column) -> Column:
    """Compact JSON object with sorted keys; missing values are written as null."""
    return F.to_json(
        F.struct(*[fields[k].alias(k) for k in sorted(fields)]), {"ignoreNullFields": "false"}
    )


def canonical_sha256(**fields: Column) -> Column:
    return F.sha2(canonical_json(**fields), 256)


def prefixed_id(prefix: str, length: int = 64, **fields: Column) -> Column:
    """Opaque identifier made from a record's own locator."""
    return F.concat(F.lit(prefix + "_"), F.substring(canonical_sha256(**fields), 1, length))


def group_digest(df: DataFrame, keys: list[str], row: Column, name: str) -> DataFrame:
    """Order-free SHA-256 over all rows of each group, and their number.

    Each row's hash is cut into eight 32-bit words; the count and the eight sums are hashed. Sums combine before the
    shuffle, so a group sends one row per task however many rows it has, and nothing is gathered.
    """
    hashed = df.select(*keys, F.sha2(row, 256).alias("_h"))
    word = lambda i: F.conv(F.substring("_h", 1 + 8 * i, 8), 16, 10).cast("bigint")
    words = hashed.select(*keys, *[word(i).alias(f"_w{i}") for i in range(8)])
    # Both halves of a word are summed apart as whole numbers: exact up to 2^47 rows, and cheaper than decimals.
    halves = [F.sum(half).alias(f"{name}{i}") for i in range(8) for name, half in (("_hi", F.shiftright(f"_w{i}", 16)), ("_lo", F.col(f"_w{i}").bitwiseAND(65535)))]
    sums = words.groupBy(*keys).agg(F.count("*").alias("row_count"), *halves)
    total = lambda i: F.col(f"_hi{i}").cast("decimal(38,0)") * 65536 + F.col(f"_lo{i}")
    parts = [F.col("row_count").cast("string"), *(total(i).cast("decimal(38,0)").cast("string") for i in range(8))]
    return sums.select(*keys, F.sha2(F.concat_ws(",", *parts), 256).alias(name), "row_count")
