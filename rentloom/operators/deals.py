"""Deal screening for all deals at once. Every rule is row-local, so no step shuffles."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rentloom.functions import metrics


def screen(deals: DataFrame) -> DataFrame:
    """Add breaches, present_as_bid and bid to deal rows that carry the seven figures."""
    names = ["strike", "units", "price_per_unit", "going_in_cap", "exit_cap", "min_dscr", "year1_noi"]
    result = metrics.reasonability(*[F.col(n) for n in names])
    return deals.withColumns(
        {
            "breaches": result["breaches"],
            "present_as_bid": result["present_as_bid"],
            "bid": result["bid"],
        }
    )


def present_results(results: DataFrame, json_column: str = "result_json") -> DataFrame:
    """The same from issued result JSON; flags and ranks ride along but never restore a bid."""
    keep = [c for c in results.columns if c != json_column]
    return screen(results.select(*keep, *metrics.engine_figures(F.col(json_column))))


def record_thesis(deals: DataFrame) -> DataFrame:
    """Original thesis: price, year-2 NOI, capex, the computed yield and present_as_bid; nothing may be missing."""
    result = metrics.yield_on_cost(F.col("year_2_noi"), F.col("purchase_price"), F.col("capex"))
    return deals.select(
        "deal_id",
        "purchase_price",
        "year_2_noi",
        "capex",
        "present_as_bid",
        result["ratio"].alias("yield_on_cost"),
        result["in_band"].alias("in_band"),
        result["error_code"].alias("error_code"),
    )


@dataclass(frozen=True)
class BuyBox:
    """Policy values; None means the value is not set and the rule is not a certified hurdle."""

    min_units: int | None = None
    max_units: int | None = None
    in_place_cap_kill: str | None = None
    millage_required: bool = True


def check_buy_box(deals: DataFrame, policy: BuyBox) -> DataFrame:
    """pass / fail / not_certified per rule, with MISSING_MILLAGE where a rate is required and absent."""

    def rule(name: str, bound, value: str, bad):
        if bound is None:
            return F.lit("not_certified").alias(name)
        return F.when(F.col(value).isNull(), "missing").when(bad, "fail").otherwise("pass").alias(name)

    kill = None if policy.in_place_cap_kill is None else metrics.dec(policy.in_place_cap_kill)
    millage = metrics.parse_millage(F.col("millage"))
    checked = deals.select(
        "deal_id",
        rule("min_units", policy.min_units, "units", F.col("units") < F.lit(policy.min_units)),
        rule("max_units", policy.max_units, "units", F.col("units") > F.lit(policy.max_units)),
        rule("cap_kill", kill, "going_in_cap", F.col("going_in_cap") < (kill if kill is not None else F.lit(None))),
        F.when(F.lit(policy.millage_required), millage["error_code"]).alias("millage_error"),
    )
    fail = (F.col("min_units") == "fail") | (F.col("max_units") == "fail") | (F.col("cap_kill") == "fail")
    return checked.withColumn(
        "error_code", F.coalesce("millage_error", F.when(fail, F.lit("BUY_BOX_FAIL")))
    )
