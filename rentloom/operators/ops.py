"""Ledger review: budget variance, NOI bridge, coverage, mappings and duplicate imports for every property-month.

The raw ledger is shuffled once, on the full import key. Everything after works on one row per
(property, period, account), so no step depends on how many postings a single property has.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rentloom.functions.period import month_idx, month_label, period_window
from rentloom.functions.refusal import all_failures, capped_list, clean_text, failed

# Limits, category names and evidence bound of the review contract.
MAX_EVIDENCE = 50
MAX_GL_ROWS = 100_000
REVENUE_CATEGORIES = ["rental income", "concessions", "bad debt", "other income"]
UNMAPPED_CATEGORY = "unmapped"
IMPORT_KEY = ["property_id", "period", "kind", "source_file", "source_row", "account_code"]
REVIEW_KEY = ["property_id", "period"]
ACCOUNT_KEY = ["property_id", "period", "account_code"]
EVIDENCE_ORDER = ["kind", "source_file", "source_row", "id"]


@dataclass(frozen=True)
class Materiality:
    """Threshold in money, its currency, and the age in days after which a feed is stale."""

    variance_abs: str = "50000.00"
    currency: str = "USD"
    stale_after_days: int = 45

    def __post_init__(self) -> None:
        if self.currency != "USD" or float(self.variance_abs) <= 0 or not 1 <= self.stale_after_days <= 365:
            raise ValueError("INVALID_INPUT")


def gl_with_period(gl: DataFrame, periods: DataFrame) -> DataFrame:
    """Attach the period label by period id."""
    labels = periods.select(F.col("id").alias("period_id"), F.col("label").alias("period"))
    return gl.join(labels, "period_id").drop("period_id")


def union_kinds(actuals: DataFrame, budgets: DataFrame) -> DataFrame:
    """Actual and budget rows in one table, tagged with their kind."""
    return actuals.withColumn("kind", F.lit("actual")).unionByName(budgets.withColumn("kind", F.lit("budget")))


def validate_gl(gl: DataFrame) -> DataFrame:
    """Add ``issues``: the code of every row rule that fails."""
    c = F.col
    return gl.withColumn(
        "issues",
        all_failures(
            (c("property_id").isNull(), "SCOPE_MISMATCH"),
            (month_idx(c("period")).isNull(), "SCOPE_MISMATCH_PERIOD"),
            (failed(c("kind").isin("actual", "budget")), "INVALID_KIND"),
            (failed(clean_text(c("account_code"), 64)), "INVALID_ACCOUNT_CODE"),
            (failed(clean_text(c("account_name"), 128)), "INVALID_ACCOUNT_NAME"),
            (failed(clean_text(c("category"), 128)), "INVALID_CATEGORY"),
            (c("amount").isNull(), "INVALID_AMOUNT"),
            (failed(clean_text(c("source_file"), 256)), "INVALID_SOURCE_FILE"),
            (failed(c("source_row") >= 0), "INVALID_SOURCE_ROW"),
            (failed(clean_text(c("created_at"), 64)), "INVALID_CREATED_AT"),
            (failed(clean_text(c("id"), 128)), "INVALID_ID"),
        ),
    )


def dedupe_gl(gl: DataFrame) -> DataFrame:
    """First import by (created_at, id) wins per import key; ``copies`` and ``amounts_differ`` disclose the rest.

    A minimum over a struct combines before the shuffle, unlike a window, so a row imported a million times costs
    one row per task. Of rows with ``issues`` (``validate_gl``), ``refused_rows`` counts those with a fault other than a
    missing amount, copies that go included.
    """
    kept = F.min(F.struct("created_at", "id", "amount", "account_name", "category")).alias("k")
    faults = F.array_remove("issues", "INVALID_AMOUNT")
    refused = [F.count_if(F.size(faults) > 0).alias("refused_rows")] if "issues" in gl.columns else []
    return (
        gl.groupBy(*IMPORT_KEY)
        .agg(kept, F.count("*").alias("copies"), (F.min("amount") != F.max("amount")).alias("amounts_differ"), *refused)
        .select(*IMPORT_KEY, "k.*", "copies", "amounts_differ", *["refused_rows" for _ in refused])
    )


def duplicate_imports(clean: DataFrame) -> DataFrame:
    """Import keys that arrived more than once, with the row that was kept."""
    return clean.filter(F.col("copies") > 1)


def whole_sum(amount: Column, which: Column) -> Column:
    """Sum of the chosen rows of a group; NULL if one of them has no amount, because missing is never zero."""
    total = F.sum(F.when(which, amount)).cast("decimal(38,2)")
    return F.when(F.count_if(which & amount.isNull()) == 0, total)


def account_rollup(clean: DataFrame) -> DataFrame:
    """One row per (property, period, account): row counts, sums and labels of both kinds.

    Presence is counted, never inferred from an amount: an explicit 0.00 budget is a budget. A side with one missing
    amount has no sum, and ``invalid_rows`` counts such rows.
    """
    is_actual, is_budget = F.col("kind") == "actual", F.col("kind") == "budget"
    return clean.groupBy(*ACCOUNT_KEY).agg(
        F.count_if(is_actual).alias("actual_rows"),
        F.count_if(is_budget).alias("budget_rows"),
        whole_sum(F.col("amount"), is_actual).alias("actual"),
        whole_sum(F.col("amount"), is_budget).alias("budget"),
        F.count_if(F.col("amount").isNull()).alias("invalid_rows"),
        F.min("account_name").alias("account_name"),
        F.min("category").alias("category"),
        F.collect_set("category").alias("categories"),
        F.size(F.collect_set(F.struct("account_name", "category"))).alias("labels"),
        F.count_if(F.col("copies") > 1).alias("duplicate_groups"),
        F.sum(F.col("copies") - 1).alias("duplicate_rows"),
        *[F.sum(c).alias(c) for c in ("refused_rows",) if c in clean.columns],
    )


def actual_budget_coverage(rollup: DataFrame) -> DataFrame:
    """Add ``coverage``: covered, MISSING_BUDGET or BUDGET_WITHOUT_ACTUAL per account."""
    has_actual, has_budget = F.col("actual_rows") > 0, F.col("budget_rows") > 0
    return rollup.withColumn(
        "coverage",
        F.when(has_actual & has_budget, "covered")
        .when(has_actual, "MISSING_BUDGET")
        .otherwise("BUDGET_WITHOUT_ACTUAL"),
    )


def variance_expr() -> Column:
    """actual − budget where both exist and the account carries one name and category; else NULL."""
    ok = (F.col("coverage") == "covered") & (F.col("labels") == 1)
    return F.when(ok, F.col("actual") - F.col("budget")).cast("decimal(38,2)")


def account_variance(rollup: DataFrame) -> DataFrame:
    """actual − budget per covered account. Accounts that carry several names or categories refuse."""
    covered = actual_budget_coverage(rollup).filter(F.col("coverage") == "covered")
    return covered.select(
        *ACCOUNT_KEY,
        "account_name",
        "category",
        "actual",
        "budget",
        variance_expr().alias("variance"),
        F.when(F.col("labels") > 1, F.lit("INVALID_CONTRACT")).alias("error_code"),
    )


def bridge_sums(covered: Column) -> list[Column]:
    """Aggregates of revenue, expense and unmapped money over the covered accounts of a group.

    A group without covered accounts gives NULL, not zero; inside a covered group an empty class is a true zero, and a
    class in which one account has no sum has none itself.
    """
    revenue = F.lower("category").isin(REVENUE_CATEGORIES)
    unmapped = F.lower("category") == UNMAPPED_CATEGORY
    zero = F.lit("0").cast("decimal(38,2)")

    def total(side: str, which: Column) -> Column:
        summed = F.sum(F.when(covered, F.when(which, F.col(side)).otherwise(zero))).cast("decimal(38,2)")
        return F.when(F.count_if(covered & which & F.col(side).isNull()) == 0, summed)

    return [
        *[
            total(side, which).alias(f"{side}_{name}")
            for side in ("actual", "budget")
            for name, which in (("revenue", revenue), ("expenses", ~revenue & ~unmapped))
        ],
        total("actual", unmapped).alias("unmapped_actual"),
        total("budget", unmapped).alias("unmapped_budget"),
        F.count_if(covered).alias("covered_accounts"),
    ]


def bridge_results(sums: DataFrame) -> DataFrame:
    """NOI = revenue − expenses, and the three variances."""
    c = F.col
    actual_noi, budget_noi = c("actual_revenue") - c("actual_expenses"), c("budget_revenue") - c("budget_expenses")
    return sums.withColumns(
        {
            "revenue_variance": c("actual_revenue") - c("budget_revenue"),
            "expense_variance": c("actual_expenses") - c("budget_expenses"),
            "actual_noi": actual_noi,
            "budget_noi": budget_noi,
            "noi_variance": actual_noi - budget_noi,
        }
    )


def noi_bridge(variance: DataFrame) -> DataFrame:
    """Revenue, expense, NOI and unmapped totals per (property, period) over covered accounts."""
    return bridge_results(variance.groupBy(*REVIEW_KEY).agg(*bridge_sums(F.lit(True))))


VarianceFn = Callable[[DataFrame], DataFrame]


def bound_variance(rollup: DataFrame, fn: VarianceFn) -> DataFrame:
    """Run the caller's variance function and hold its result to the by-account contract."""
    by_account = fn(rollup)
    if not {*ACCOUNT_KEY, "account_name", "category", "actual", "budget", "variance"} <= set(by_account.columns):
        raise ValueError("INVALID_CONTRACT")
    return by_account


def material_variances(variance: DataFrame, threshold: str) -> DataFrame:
    """Accounts with |variance| at or over the threshold, ranked by size then code within the property-month."""
    w = Window.partitionBy(*REVIEW_KEY).orderBy(F.abs("variance").desc(), F.col("account_code"))
    return variance.filter(F.abs("variance") >= F.lit(threshold).cast("decimal(38,8)")).withColumn(
        "rank", F.row_number().over(w)
    )


def review_counts(rollup: DataFrame) -> DataFrame:
    return rollup.groupBy(*REVIEW_KEY).agg(
        F.sum("actual_rows").alias("actual_rows"),
        F.sum("budget_rows").alias("budget_rows"),
        F.count("*").alias("distinct_accounts"),
        F.sum("duplicate_groups").alias("duplicate_groups"),
        F.sum("duplicate_rows").alias("duplicate_rows"),
    )


def account_evidence(clean: DataFrame) -> DataFrame:
    """First 50 source rows per (property, period, account) in (kind, file, row, id) order."""
    item = F.struct(*EVIDENCE_ORDER)
    return capped_list(clean, ACCOUNT_KEY, EVIDENCE_ORDER, item, MAX_EVIDENCE, "evidence")


def merge_evidence(lists: Column) -> Column:
    """First 50 rows over several lists that are each already their own first 50."""
    return F.slice(F.sort_array(F.flatten(lists)), 1, MAX_EVIDENCE)


def citations(evidence: Column, period: Column) -> Column:
    """Source rows as (artifact, row, table, period)."""
    return F.transform(
        evidence,
        lambda e: F.struct(
            e["source_file"].alias("artifact"),
            e["source_row"].alias("row"),
            F.when(e["kind"] == "actual", "gl_actuals").otherwise("gl_budgets").alias("table"),
            period.alias("period"),
        ),
    )


# ---------------------------------------------------------------- account mappings


def mapping_states(mappings: DataFrame) -> DataFrame:
    """Distinct (category, status) states per account and scope; '', '*' and NULL scopes are the wildcard."""
    scope = F.lower(F.trim("property_scope"))
    return (
        mappings.withColumn("scope", F.when(scope.isNull() | scope.isin("", "*"), "*").otherwise(scope))
        .groupBy("account_code", "scope")
        .agg(F.sort_array(F.collect_set(F.struct("noi_category", "status"))).alias("states"))
    )


def with_mapping_state(rollup: DataFrame, mappings: DataFrame) -> DataFrame:
    """Add the review state of each account's mapping: gl_categories, mapped_category, statuses, reason and
    mapping_error. A property's own row hides the wildcard row for that account."""
    states = mapping_states(mappings)
    scoped = states.filter("scope <> '*'").select(
        "account_code", F.col("scope").alias("property_id"), F.col("states").alias("own")
    )
    shared = states.filter("scope = '*'").select("account_code", F.col("states").alias("shared"))
    joined = (
        rollup.withColumn("gl_categories", F.sort_array("categories"))
        .join(scoped, ["property_id", "account_code"], "left")
        .join(shared, "account_code", "left")
        .withColumn("states", F.coalesce("own", "shared"))
    )
    single = F.get("states", F.lit(0))
    reason = (
        F.when(F.col("states").isNull(), "absent")
        .when(F.size("states") > 1, "conflicting")
        .when(single["status"] != "approved", "status")
    )
    changed = (F.size("gl_categories") != 1) | (F.get("gl_categories", F.lit(0)) != single["noi_category"])
    return joined.withColumns(
        {
            "mapped_category": F.when(F.size("states") == 1, single["noi_category"]),
            "statuses": F.array_sort(F.array_distinct(F.transform("states", lambda s: s["status"]))),
            "reason": reason,
            "mapping_error": F.when(reason.isNotNull(), "UNREVIEWED_ACCOUNT_MAPPING").when(
                changed, "CHANGED_ACCOUNT_MAPPING"
            ),
        }
    ).drop("own", "shared", "states")


def map_accounts(rollup: DataFrame, mappings: DataFrame) -> DataFrame:
    """Review state of each account's mapping, one row per (property, period, account)."""
    return with_mapping_state(rollup, mappings).select(
        *ACCOUNT_KEY, "gl_categories", "mapped_category", "statuses", "reason", F.col("mapping_error").alias("error_code")
    )


def mapping_codes(mappings: DataFrame, category: str) -> DataFrame:
    """Account codes whose reviewed, else current, else suggested, else NOI category is the given one."""
    present = [
        F.when(F.col(c) != "", F.col(c))
        for c in ("reviewed_category", "current_category", "suggested_category", "noi_category")
        if c in mappings.columns
    ]
    code = F.trim("account_code")
    return (
        mappings.filter((F.trim(F.coalesce(*present)) == category) & (code != ""))
        .select(code.alias("account_code"))
        .distinct()
    )


# ---------------------------------------------------------------- trailing twelve months


def t12_category_sum(gl: DataFrame, category: str, end: DataFrame | None = None) -> DataFrame:
    """Twelve-month sum of one category per property, ending at ``end(property_id, end_period)`` or at the
    property's latest actual month. Equal (period, code, name, source row, amount) rows count once. No row in the
    window gives NOT_FOUND with a NULL value, a row without amount INVALID_AMOUNT.
    """
    actual = gl.filter(F.col("kind") == "actual")
    if end is None:
        end = actual.groupBy("property_id").agg(F.max("period").alias("end_period"))
    rows = (
        actual.filter(F.col("category") == category)
        .select("property_id", "period", "account_code", "account_name", "source_row", "amount")
        .dropDuplicates()
    )
    return _window_sum(_monthly(rows), end)


def _monthly(rows: DataFrame) -> DataFrame:
    """Sums per (property, period, account), and how many of the rows have no amount."""
    invalid = F.count_if(F.col("amount").isNull()).alias("invalid")
    return rows.groupBy("property_id", "period", "account_code").agg(F.sum("amount").alias("amount"), invalid)


def _window_sum(monthly: DataFrame, end: DataFrame) -> DataFrame:
    last, at = month_idx(F.col("end_period")), month_idx(F.col("period"))
    inside = (at <= last) & (at > last - 12)
    summed = F.sum(F.when(inside, F.col("amount"))).cast("decimal(38,2)")
    invalid = F.coalesce(F.sum(F.when(inside, F.col("invalid"))), F.lit(0))
    return (
        end.join(monthly, "property_id", "left")
        .groupBy("property_id", "end_period")
        .agg(
            F.when(invalid == 0, summed).alias("value"),
            (invalid > 0).alias("invalid"),
            F.array_sort(F.collect_set(F.when(inside, F.col("account_code")))).alias("account_codes"),
        )
        .select(
            "property_id",
            F.col("end_period").alias("as_of"),
            F.element_at(period_window(F.col("end_period")), 1).alias("window_start"),
            "value",
            F.when(F.col("value").isNotNull(), "usd").alias("unit"),
            "account_codes",
            F.when(F.col("invalid"), "INVALID_AMOUNT").when(F.col("value").isNull(), "NOT_FOUND").alias("error_code"),
        )
    )


def t12_from_budget_comparison(feed: DataFrame, codes: DataFrame, end: DataFrame | None = None) -> DataFrame:
    """The same sum from a budget-comparison feed (property_id, period text, account_code, ptd_actual text)."""
    from rentloom.functions.money import parse_amount_lenient
    from rentloom.functions.period import parse_period

    # Amounts are summed by the period's text, which has few values; periods are parsed once for each, not for each row.
    text = F.col("period").alias("text")
    if end is None:
        spans = feed.select("property_id", text).distinct().select("property_id", parse_period(F.col("text")).alias("period"))
        end = spans.filter(F.length("period") == 7).groupBy("property_id").agg(F.max("period").alias("end_period"))
    coded = feed.withColumn("account_code", F.trim("account_code")).join(codes, "account_code", "left_semi")
    amount = parse_amount_lenient(F.col("ptd_actual"))
    rows = coded.select("property_id", text, "account_code", amount.alias("amount")).groupBy("property_id", "text", "account_code")
    rows = rows.agg(F.sum("amount").alias("amount"), F.count_if(F.col("amount").isNull()).alias("invalid"))
    monthly = rows.groupBy("property_id", parse_period(F.col("text")).alias("period"), "account_code")
    return _window_sum(monthly.agg(F.sum("amount").alias("amount"), F.sum("invalid").alias("invalid")), end)


def trailing_12(gl: DataFrame, keys: list[str]) -> DataFrame:
    """Running twelve-month sum at every month that has rows; calendar gaps count as months without rows.

    A month with a missing amount has no sum, nor has a window that holds such a month."""
    monthly = (
        gl.groupBy(*keys, "period")
        .agg(whole_sum(F.col("amount"), F.lit(True)).alias("amount"))
        .withColumn("month_idx", month_idx(F.col("period")))
    )
    w = Window.partitionBy(*keys).orderBy("month_idx").rangeBetween(-11, 0)
    return monthly.withColumns(
        {
            "t12": F.when(F.count("amount").over(w) == F.count("*").over(w), F.sum("amount").over(w)).cast("decimal(38,2)"),
            "months_present": F.count("*").over(w),
            "window_start": month_label(F.col("month_idx") - 11),
        }
    ).drop("month_idx")


def get_t12(gl: DataFrame, end: str) -> DataFrame:
    """Trailing statement: one row per (property, account), one column per month of the window."""
    year, month = int(end[:4]), int(end[5:7])
    last = year * 12 + month - 1
    labels = [f"{i // 12:04d}-{i % 12 + 1:02d}" for i in range(last - 11, last + 1)]
    return (
        gl.filter((F.col("kind") == "actual") & F.col("period").isin(labels))
        .groupBy("property_id", "account_code", "account_name", "category")
        .pivot("period", labels)
        .agg(whole_sum(F.col("amount"), F.lit(True)))
    )


# ---------------------------------------------------------------- backends and limits


def prefer_backend(primary: DataFrame, fallback: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    """Primary rows for a key if it has any, else fallback rows, else one NOT_FOUND row per requested key."""
    have = primary.select(key).distinct()
    chosen = primary.withColumn("backend", F.lit("primary")).unionByName(
        fallback.join(have, key, "left_anti").withColumn("backend", F.lit("fallback"))
    )
    return keys.join(chosen, key, "left").withColumn(
        "error_code", F.when(F.col("backend").isNull(), F.lit("NOT_FOUND"))
    )


def enforce_limits(df: DataFrame, keys: list[str], max_rows: int = MAX_GL_ROWS) -> DataFrame:
    """Row count per group and INPUT_LIMIT_EXCEEDED where it passes the limit. Counting combines before shuffling."""
    return (
        df.groupBy(*keys)
        .agg(F.count("*").alias("row_count"))
        .withColumn("error_code", F.when(F.col("row_count") > max_rows, F.lit("INPUT_LIMIT_EXCEEDED")))
    )
