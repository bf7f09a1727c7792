"""Report-shaped outputs over one review."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rentloom.operators.ops import REVIEW_KEY, bridge_results, bridge_sums
from rentloom.plans.review import Review, exceptions


def explain_variance(r: Review) -> DataFrame:
    """Actual against budget per covered account, ranked inside its month, beside the month's NOI variance.

    Accounts whose labels disagree keep a NULL variance. The bridge is one row per month, so it is joined back to at
    most a chart of accounts per month."""
    covered = r.accounts.filter("coverage = 'covered'")
    bridge = bridge_results(covered.groupBy(*REVIEW_KEY).agg(*bridge_sums(F.lit(True))))
    rows = covered.select(
        *REVIEW_KEY, "account_code", "account_name", "category", "actual", "budget", "variance", "rank", "is_material"
    )
    return rows.join(bridge.select(*REVIEW_KEY, "actual_noi", "budget_noi", "noi_variance"), REVIEW_KEY)


def list_exceptions(r: Review, severities: list[str] | None = None, codes: list[str] | None = None) -> DataFrame:
    """Gaps, unmapped accounts, stale feeds and the rest, blockers first."""
    out = exceptions(r)
    if severities is not None:
        out = out.filter(F.col("severity").isin(severities))
    if codes is not None:
        out = out.filter(F.col("code").isin(codes))
    order = F.when(F.col("severity") == "blocker", 0).when(F.col("severity") == "material", 1).otherwise(2)
    return out.withColumn("severity_rank", order)
