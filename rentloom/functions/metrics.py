"""Portfolio metrics as Column expressions. A missing input gives NULL plus a code, never a zero."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from rentloom.functions.refusal import any_of, first_failure

# Bands and floors that decide presentation.
LEASE_UP_BELOW = "0.85"
YIELD_BAND = ("0.07", "0.08")
CAP_BAND = ("0.06", "0.12")
PRICE_PER_UNIT_BAND = ("25000", "750000")
DSCR_FLOOR = "1.10"
STALE_AFTER_DAYS = 45


def dec(text: str, kind: str = "decimal(18,8)") -> Column:
    return F.lit(text).cast(kind)


def ratio(num: Column, den: Column, scale: int = 10) -> Column:
    """Exact division to a stated scale; NULL when the denominator is zero or anything is missing."""
    wide = num.cast("decimal(28,8)") / F.when(den != 0, den).cast("decimal(28,8)")
    return F.round(wide, scale).cast(f"decimal(28,{scale})")


def occupancy_check(occupied: Column, vacant: Column, down: Column, denominator: Column) -> Column:
    """Struct(rate, error_code). A rate needs all four counts, none negative, and a positive denominator."""
    counts = [occupied, vacant, down, denominator]
    error = first_failure(
        (any_of(*[c.isNull() for c in counts]), "OCCUPANCY_COUNTS_REQUIRED"),
        (any_of(*[c < 0 for c in counts]), "OCCUPANCY_COUNTS_REQUIRED"),
        (denominator == 0, "IMPLICIT_ZERO_FORBIDDEN"),
    )
    return F.struct(F.when(error.isNull(), ratio(occupied, denominator)).alias("rate"), error.alias("error_code"))


def parse_millage(text: Column) -> Column:
    """Struct(millage, error_code): a positive finite number of mills per 1,000, else MISSING_MILLAGE."""
    value = F.trim(text).try_cast("decimal(28,10)")
    error = first_failure((value.isNull() | (value <= 0), "MISSING_MILLAGE"))
    return F.struct(F.when(error.isNull(), value).alias("millage"), error.alias("error_code"))


def physical_position(
    occupied: Column, vacant: Column, down: Column, denominator: Column, noi: Column, deferred: Column
) -> Column:
    """lease_up, distressed or stabilized; NULL while any count is missing or refused."""
    checked = occupancy_check(occupied, vacant, down, denominator)
    distressed = any_of(down > 0, deferred, noi < 0)
    return F.when(
        checked["error_code"].isNull(),
        F.when(distressed, "distressed")
        .when(occupied.cast("decimal(20,2)") < denominator * dec(LEASE_UP_BELOW, "decimal(4,2)"), "lease_up")
        .otherwise("stabilized"),
    )


def yield_on_cost(noi: Column, price: Column, capex: Column) -> Column:
    """Struct(ratio, in_band, error_code): year-2 NOI / (price + capex); nothing may be missing."""
    basis = price + capex
    error = first_failure(
        (noi.isNull() | price.isNull() | capex.isNull(), "IMPLICIT_ZERO_FORBIDDEN"),
        (basis <= 0, "IMPLICIT_ZERO_FORBIDDEN"),
    )
    low, high = (dec(b) for b in YIELD_BAND)
    value = F.when(error.isNull(), ratio(noi, basis))
    inside = (noi >= basis * low) & (noi <= basis * high)
    return F.struct(
        value.alias("ratio"), F.when(error.isNull(), inside).alias("in_band"), error.alias("error_code")
    )


def reasonability(
    strike: Column,
    units: Column,
    price_per_unit: Column,
    going_in_cap: Column,
    exit_cap: Column,
    min_dscr: Column,
    year1_noi: Column,
) -> Column:
    """Struct(breaches[field,value,band], present_as_bid, bid). A bid needs a strike and no breach."""
    per_unit = F.coalesce(price_per_unit, ratio(strike, F.when(units != 0, units)))
    priced = strike.isNotNull() | price_per_unit.isNotNull()
    cap_low, cap_high = (dec(b) for b in CAP_BAND)
    unit_low, unit_high = (dec(b, "decimal(28,8)") for b in PRICE_PER_UNIT_BAND)

    def breach(bad: Column, field: str, value: Column, band: str) -> Column:
        row = F.struct(
            F.lit(field).alias("field"), value.cast("string").alias("value"), F.lit(band).alias("band")
        )
        return F.when(F.coalesce(bad, F.lit(False)), row)

    breaches = F.array_compact(
        F.array(
            breach((going_in_cap < cap_low) | (going_in_cap > cap_high), "going_in_cap", going_in_cap, "[0.06, 0.12]"),
            breach((exit_cap < cap_low) | (exit_cap > cap_high), "exit_cap", exit_cap, "[0.06, 0.12]"),
            breach((per_unit < unit_low) | (per_unit > unit_high), "price_per_unit", per_unit, "[25000, 750000]"),
            breach(min_dscr < dec(DSCR_FLOOR), "min_dscr", min_dscr, ">=1.10"),
            breach((year1_noi < 0) & priced, "year1_noi", year1_noi, "non_negative_on_a_price"),
        )
    )
    as_bid = strike.isNotNull() & (F.size(breaches) == 0)
    return F.struct(breaches.alias("breaches"), as_bid.alias("present_as_bid"), F.when(as_bid, strike).alias("bid"))


def feed_age(as_of: Column, review_day: Column, bound: int = STALE_AFTER_DAYS) -> Column:
    """Struct(age_days, freshness): current, stale, or unknown without a review day or a feed."""
    age = F.datediff(review_day, as_of)
    freshness = F.when(age.isNull(), "unknown").when(age > bound, "stale").otherwise("current")
    return F.struct(age.alias("age_days"), freshness.alias("freshness"))


def lookup_first(result: Column, keys: list[str]) -> Column:
    """First non-null of the keys at the top level of a JSON result, then under ``policy_summary``;
    a minimum DSCR may also sit at ``dscr.minimum``."""
    paths = [f"$.{k}" for k in keys] + [f"$.policy_summary.{k}" for k in keys]
    if {"min_dscr", "minimum_dscr"} & set(keys):
        paths.append("$.dscr.minimum")
    found = F.coalesce(*[F.get_json_object(result, p) for p in paths])
    return F.when(F.trim(found) != "", found)


# Accepted spellings of each engine figure.
ENGINE_FIGURES = {
    "units": ["units"],
    "strike": ["strike", "solved_purchase_price", "purchase_price"],
    "going_in_cap": ["going_in_cap", "going_in_cap_rate"],
    "exit_cap": ["exit_cap", "exit_cap_rate"],
    "price_per_unit": ["price_per_unit"],
    "min_dscr": ["min_dscr", "minimum_dscr"],
    "year1_noi": ["year1_noi", "year_1_noi", "projected_noi_used_for_sizing"],
}


def engine_figures(result: Column) -> list[Column]:
    """The seven figures of an issued result as exact decimals (units as an integer)."""
    return [
        lookup_first(result, keys).try_cast("int" if name == "units" else "decimal(28,8)").alias(name)
        for name, keys in ENGINE_FIGURES.items()
    ]
