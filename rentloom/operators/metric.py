"""Certified metrics: the glossary, which definition a request may use, and the value behind it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rentloom.functions.refusal import first_failure
from rentloom.operators.requests import UNCERTIFIED_CONTEXTS

STATUSES = ["CERTIFIED", "CONFLICT", "DIRTY", "UNSTRUCTURED", "UNKNOWN"]
BACKED = ["physical_occupancy", "t12_repairs_and_maintenance", "millage_rate"]
GLOSSARY = "metric_id string, term string, status string, context string, owner string, money string"


def load_glossary(spark: SparkSession, glossary: dict) -> DataFrame:
    """One row per (metric, definition). Unknown statuses become UNKNOWN; definitions without context are dropped;
    a metric without definitions keeps one row with a NULL context. The glossary is a short, hand-kept list."""
    rows = []
    for metric_id, body in (glossary.get("metrics") or {}).items():
        if not isinstance(body, dict):
            continue
        status = body.get("status") if body.get("status") in STATUSES else "UNKNOWN"
        head = (str(metric_id), str(body.get("term") or metric_id), status)
        kept = [x for x in body.get("definitions") or [] if isinstance(x, dict) and x.get("context")]
        rows += [(*head, x["context"], x.get("owner"), x.get("money")) for x in kept] or [(*head, None, None, None)]
    return spark.createDataFrame(rows, GLOSSARY)


def resolve_metric(requests: DataFrame, glossary: DataFrame) -> DataFrame:
    """Requests(metric_id, context, …) with owner, certification and ``error_code``.

    Competing definitions are never averaged: without a context a conflicting metric refuses."""
    metrics = glossary.groupBy("metric_id").agg(
        F.when(F.min("status") == F.max("status"), F.min("status")).otherwise("CONFLICT").alias("certification"),
        F.count_distinct("context").alias("definitions"),
        F.min("context").alias("only_context"),
        F.min("owner").alias("only_owner"),
    )
    by_context = glossary.filter("context is not null").groupBy("metric_id", "context").agg(
        F.min("owner").alias("context_owner"),
        F.lit(True).alias("defined"),
        (F.min(F.struct("owner", "money")) != F.max(F.struct("owner", "money"))).alias("competing"),
    )
    joined = requests.join(metrics, "metric_id", "left").join(by_context, ["metric_id", "context"], "left")
    asked = F.col("context").isNotNull()
    error = first_failure(
        (F.col("certification").isNull(), "NOT_FOUND"),
        (F.col("certification") == "UNKNOWN", "UNCERTIFIED_METRIC"),
        (F.col("context").isin(UNCERTIFIED_CONTEXTS), "UNCERTIFIED_METRIC"),
        (((F.col("certification") == "CONFLICT") | (F.col("definitions") > 1)) & ~asked, "CONFLICT_UNRESOLVED"),
        (asked & (F.col("definitions") > 0) & F.col("defined").isNull(), "CONFLICT_UNRESOLVED"),
        (F.col("competing"), "CONFLICT_UNRESOLVED"),
        (~F.col("metric_id").isin(BACKED), "UNCERTIFIED_METRIC"),
    )
    single = ~asked & (F.col("definitions") == 1)
    return joined.select(
        *requests.columns,
        "certification",
        F.when(single, F.col("only_context")).otherwise(F.col("context")).alias("resolved_context"),
        F.when(single, F.col("only_owner")).otherwise(F.col("context_owner")).alias("formula_owner"),
        error.alias("error_code"),
    )


def certified_metric(
    requests: DataFrame, glossary: DataFrame, occupancy: DataFrame, t12: DataFrame, millage: DataFrame
) -> DataFrame:
    """Value and unit per request(subject, metric_id, context), or the reason there is none.

    ``occupancy(subject, rate, error_code)``, ``t12(subject, value, error_code)``, ``millage(subject, millage,
    error_code)`` each hold at most one row per subject; they are stacked so the requests are joined once."""

    def backend(df: DataFrame, metric: str, value: str, unit: str) -> DataFrame:
        return df.select(
            "subject",
            F.lit(metric).alias("metric_id"),
            F.col(value).cast("decimal(38,10)").alias("value"),
            F.lit(unit).alias("unit"),
            F.col("error_code").alias("backend_error"),
        )

    values = (
        backend(occupancy, "physical_occupancy", "rate", "ratio")
        .unionByName(backend(t12, "t12_repairs_and_maintenance", "value", "usd"))
        .unionByName(backend(millage, "millage_rate", "millage", "mills_per_1000"))
    )
    resolved = resolve_metric(requests, glossary)
    joined = resolved.join(values, ["subject", "metric_id"], "left")
    absent = (
        F.when(F.col("metric_id") == "physical_occupancy", "OCCUPANCY_COUNTS_REQUIRED")
        .when(F.col("metric_id") == "millage_rate", "MISSING_MILLAGE")
        .otherwise("NOT_FOUND")
    )
    code = F.coalesce("error_code", "backend_error", F.when(F.col("value").isNull(), absent))
    return (
        joined.withColumn("error_code", code)
        .withColumn("value", F.when(F.col("error_code").isNull(), F.col("value")))
        .drop("backend_error")
    )
