"""A refusal is a value: typed codes in columns instead of exceptions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

Check = tuple[Column, str]


def failed(condition: Column) -> Column:
    """True where a requirement is not met; NULL counts as not met."""
    return ~F.coalesce(condition, F.lit(False))


def first_failure(*checks: Check) -> Column:
    """Code of the first failing check in order, else NULL. Each check is (is_bad, code)."""
    expr = F.lit(None).cast("string")
    for bad, code in reversed(checks):
        expr = F.when(F.coalesce(bad, F.lit(False)), F.lit(code)).otherwise(expr)
    return expr


def all_failures(*checks: Check) -> Column:
    """Array with the code of every failing check, in order."""
    return F.array_compact(
        F.array(*[F.when(F.coalesce(bad, F.lit(False)), F.lit(code)) for bad, code in checks])
    )


def all_issues(*issues: tuple[Column, str, str, Column | None]) -> Column:
    """Array of (code, field, detail) structs for every issue whose condition holds."""
    return F.array_compact(
        F.array(
            *[
                F.when(
                    F.coalesce(bad, F.lit(False)),
                    F.struct(
                        F.lit(code).alias("code"),
                        F.lit(field).alias("field"),
                        (F.lit(None) if detail is None else detail).cast("string").alias("detail"),
                    ),
                )
                for bad, code, field, detail in issues
            ]
        )
    )


def any_of(*conditions: Column) -> Column:
    return reduce(lambda a, b: a | b, [F.coalesce(c, F.lit(False)) for c in conditions])


def clean_text(c: Column, limit: int) -> Column:
    """Non-empty text of at most ``limit`` characters."""
    return c.isNotNull() & (F.length(c) > 0) & (F.length(c) <= limit)


def top_n(df: DataFrame, keys: list[str], order: list[Column], n: int) -> DataFrame:
    """First n rows per key. Spark's group limit keeps n rows per key and task before the shuffle."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_rn", F.row_number().over(w)).filter(F.col("_rn") <= n).drop("_rn")


def capped_list(
    df: DataFrame, keys: list[str], order: list[str], item: Column, n: int, name: str
) -> DataFrame:
    """Per key: the first n items in order, and whether more existed. Never gathers a whole group."""
    limited = top_n(df, keys, [F.col(c) for c in order], n + 1)
    picked = F.sort_array(F.collect_list(F.struct(*[F.col(c) for c in order], item.alias("_item"))))
    return (
        limited.groupBy(*keys)
        .agg(picked.alias("_all"))
        .select(
            *keys,
            F.transform(F.slice("_all", 1, n), lambda s: s["_item"]).alias(name),
            (F.size("_all") > n).alias(f"{name}_truncated"),
        )
    )
