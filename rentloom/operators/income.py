"""Income review: booked other income, tie-outs and the NOI bridge of each case.

A case is one row with twelve-month arrays and an array of other-income lines, so the whole review is row-local: no
shuffle, and a case can never be split from its months.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rentloom.functions.metrics import ratio
from rentloom.functions.money import display_cents
from rentloom.functions.period import month_idx, overlap_months
from rentloom.functions.refusal import all_failures, any_of

WIDE = "decimal(32,6)"
MONEY = "decimal(18,2)"
LINE = "struct<code:string,kind:string,evidence:string,monthly:array<decimal(18,2)>,credit_rate:decimal(9,6),paired_expense:decimal(18,2),paired_expense_evidence:string>"


def _sum(array: Column) -> Column:
    """Sum of money; NULL as soon as one amount is missing or the sum leaves 16 digits. Small decimals add as longs."""
    return F.aggregate(array, F.lit("0").cast(MONEY), lambda acc, x: (acc + x).try_cast(MONEY))


def _total(lines: Column, value) -> Column:
    """Sum of an expression over summed lines."""
    return F.aggregate(lines, F.lit("0").cast(WIDE), lambda acc, x: (acc + value(x)).cast(WIDE))


def _last(array: Column, n: int, times: int) -> Column:
    return (_sum(F.slice(array, -n, n)) * times).cast(WIDE)


def _summed(lines: Column) -> Column:
    """Each other-income line with its annual sum in place of its months, so the months are added once."""
    return F.transform(
        lines,
        lambda x: F.struct(
            x["code"].alias("code"),
            x["kind"].alias("kind"),
            x["evidence"].alias("evidence"),
            F.size(x["monthly"]).alias("months"),
            _sum(x["monthly"]).alias("annual"),
            x["credit_rate"].alias("credit"),
            x["paired_expense"].alias("cost"),
            x["paired_expense_evidence"].alias("cost_evidence"),
        ),
    )


def annualize_trailing(months: DataFrame, keys: list[str], n: int) -> DataFrame:
    """Long-form months(keys, month_no, amount): sum of the last n months × 12/n at every month."""
    w = Window.partitionBy(*keys).orderBy("month_no").rowsBetween(-(n - 1), 0)
    return months.withColumn(f"last_{n}_annualized", (F.sum("amount").over(w) * (12 // n)).cast("decimal(38,2)"))


def other_income_lines(cases: DataFrame) -> DataFrame:
    """One row per (case, code): annual, credit, month signs, annualized tails, paired expense and rule failures."""
    lines = cases.select("case_id", F.explode("other_income").alias("l"), F.col("other_income").alias("all_lines"))
    annual = _sum(F.col("l.monthly"))
    credit = F.col("l.credit_rate")
    same_code = F.size(F.filter("all_lines", lambda x: x["code"] == F.col("l.code")))
    cost = F.col("l.paired_expense")
    return lines.select(
        "case_id",
        F.col("l.code").alias("code"),
        F.col("l.kind").alias("kind"),
        display_cents(annual).alias("annual"),
        display_cents((annual * credit).cast(WIDE)).alias("house_credit"),
        F.size(F.filter("l.monthly", lambda x: x > 0)).alias("positive_months"),
        F.size(F.filter("l.monthly", lambda x: x < 0)).alias("negative_months"),
        display_cents(_last(F.col("l.monthly"), 3, 4)).alias("last_3_annualized"),
        display_cents(_last(F.col("l.monthly"), 6, 2)).alias("last_6_annualized"),
        cost.alias("paired_expense"),
        all_failures(
            (same_code > 1, "DUPLICATE_CODE"),
            (~F.col("l.evidence").eqNullSafe("booked_gl"), "EVIDENCE_NOT_BOOKED_GL"),
            (F.size("l.monthly") != 12, "TWELVE_MONTHS_REQUIRED"),
            ((credit < 0) | (credit > 1) | credit.isNull(), "CREDIT_RATE_RANGE"),
            ((F.col("l.kind") == "bad_debt") & (annual >= 0), "BAD_DEBT_SIGN"),
            ((annual < 0) & (credit != 1), "NEGATIVE_LINE_CREDIT"),
            (cost < 0, "PAIRED_EXPENSE_NEGATIVE"),
            (
                (cost != 0) & ~F.col("l.paired_expense_evidence").eqNullSafe("included_in_t12_opex"),
                "PAIRED_EXPENSE_EVIDENCE",
            ),
        ).alias("issues"),
    )


def _line_is_bad(line: Column) -> Column:
    annual, credit, cost = line["annual"], line["credit"], line["cost"]
    return any_of(
        ~line["evidence"].eqNullSafe("booked_gl"),
        line["months"] != 12,
        annual.isNull(),
        credit.isNull() | (credit < 0) | (credit > 1),
        (line["kind"] == "bad_debt") & (annual >= 0),
        (annual < 0) & (credit != 1),
        cost.isNull() | (cost < 0),
        (cost != 0) & ~line["cost_evidence"].eqNullSafe("included_in_t12_opex"),
    )


def tie_out(cases: DataFrame) -> DataFrame:
    """Add sums and ``issues``: every reported total must equal its months, counts must add to the units."""
    c = F.col
    lines = c("lines")
    with_sums = cases.withColumns(
        {
            "lines": _summed(c("other_income")),
            "rent": _sum(c("net_rent_monthly")),
            "tax_sum": _sum(c("tax_monthly")),
        }
    ).withColumns(
        {
            "other": _total(lines, lambda x: x["annual"]),
            "other_credited": _total(lines, lambda x: x["annual"] * x["credit"]),
            "paired": _total(lines, lambda x: x["cost"]),
        }
    )
    codes = F.transform(lines, lambda x: x["code"])
    verified = c("tax_status") == "verified_post_sale"
    negatives = ["tax", "insurance", "operating_expenses"]
    issues = all_failures(
        (
            month_idx(c("period_end")).isNull() | month_idx(c("prior_period_end")).isNull()
            | (month_idx(c("period_end")) <= month_idx(c("prior_period_end"))),
            "INVALID_PERIOD",
        ),
        (
            (c("units") <= 0) | any_of(*[c(n) < 0 for n in ("occupied", "vacant", "down")])
            | (c("occupied") + c("vacant") + c("down") != c("units")),
            "UNIT_COUNTS",
        ),
        ((c("recent_moveins") < 0) | (c("recent_moveins") > c("occupied")), "RECENT_MOVEINS"),
        ((F.size("net_rent_monthly") != 12) | (F.size("tax_monthly") != 12), "TWELVE_MONTHS_REQUIRED"),
        (c("rent").isNull() | (c("rent") != c("reported_net_rent")), "RENT_TIE_OUT"),
        (c("tax_sum").isNull() | (c("tax_sum") != c("tax")), "TAX_TIE_OUT"),
        (
            any_of(*[c(n) < 0 for n in negatives]) | (c("operating_expenses") < c("tax") + c("insurance")),
            "OPEX_BELOW_TAX_INSURANCE",
        ),
        (
            F.exists(lines, _line_is_bad) | (F.size(F.array_distinct(codes)) != F.size(codes)),
            "OTHER_INCOME_LINE",
        ),
        (c("other") != c("reported_other_income"), "OTHER_INCOME_TIE_OUT"),
        ((c("house_tax") < 0) | (c("house_insurance") < 0), "HOUSE_TAX_INSURANCE"),
        (
            any_of(
                *[
                    c(n) < 0
                    for n in ("concession_floor", "upfront_concessions", "arrears_writeoffs", "reserve_per_unit")
                ]
            ),
            "NEGATIVE_INPUT",
        ),
        (c("rent") + c("other") - c("operating_expenses") != c("reported_noi"), "NOI_TIE_OUT"),
        (c("occupied_base_rent_monthly") < 0, "NEGATIVE_INPUT"),
        (~F.coalesce(c("tax_status").isin("verified_post_sale", "interim_assumption"), F.lit(False)), "TAX_STATUS"),
        (verified & (F.coalesce(c("tax_source"), F.lit("")) == ""), "TAX_SOURCE"),
    )
    return with_sums.withColumn("issues", issues)


def income_bridge(cases: DataFrame) -> DataFrame:
    """One row per case: NOI figures, blockers, and ``error_code`` (first failed tie-out) with all figures NULL."""
    t = tie_out(cases)
    c = F.col
    house_opex = c("operating_expenses") - c("tax") - c("insurance") + c("house_tax") + c("house_insurance")
    topup = F.greatest(F.lit("0").cast("decimal(18,2)"), c("concession_floor") - c("upfront_concessions"))
    base = (c("rent") + c("other_credited") - topup - house_opex).cast(WIDE)
    spot = (
        c("occupied_base_rent_monthly") * 12
        + c("other_credited")
        - c("arrears_writeoffs")
        - F.greatest("concession_floor", "upfront_concessions")
        - house_opex
    )
    rent_last3 = _last(c("net_rent_monthly"), 3, 4)
    drop = F.greatest(F.lit("0").cast(WIDE), (c("rent") - rent_last3).cast(WIDE))
    reserve = c("reserve_per_unit") * c("units")
    positive = F.filter("lines", lambda x: x["annual"] > 0)
    figures = {
        "net_rent": c("rent"),
        "last_3_net_rent": rent_last3,
        "other_income": c("other"),
        "credited_other_income": c("other_credited"),
        "positive_other_income": _total(positive, lambda x: x["annual"]),
        "paired_expense": c("paired"),
        "concession_topup": topup,
        "t12_noi": c("rent") + c("other") - c("operating_expenses"),
        "house_opex": house_opex,
        "base_noi": base,
        "base_after_reserve": base - reserve,
        "spot_noi": spot,
        "stress_noi": base - drop,
    }
    ok = F.size("issues") == 0
    blockers = F.array_compact(
        F.array(
            F.when(c("tax_status") != "verified_post_sale", "POST_SALE_TAX_UNVERIFIED"),
            F.when(F.exists("tax_monthly", lambda x: x < 0), "NEGATIVE_TAX_MONTH_REQUIRES_GL_BRIDGE"),
            F.lit("FEE_CASH_COLLECTIONS_UNVERIFIED"),
        )
    )
    return t.select(
        "case_id",
        *[F.when(ok, display_cents(v.cast(WIDE))).alias(k) for k, v in figures.items()],
        F.when(ok, overlap_months(c("period_end"), c("prior_period_end"))).alias("shared_months"),
        F.when(ok, F.bround(ratio(c("recent_moveins"), c("occupied")), 2).cast("decimal(9,2)")).alias("movein_share"),
        F.when(ok, blockers).alias("blockers"),
        F.get("issues", F.lit(0)).alias("error_code"),
        "issues",
    )
