"""The period review: every (property, month) at once, with exceptions, measured facts and one summary row."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rentloom.functions.metrics import feed_age
from rentloom.functions.period import month_end
from rentloom.functions.refusal import top_n
from rentloom.operators import occupancy, ops
from rentloom.operators.ops import ACCOUNT_KEY, REVIEW_KEY, Materiality

# Severity and message of each exception code.
EXCEPTIONS = {
    "MISSING_ACTUALS": ("blocker", "No GL actual rows for the requested period; missing actuals are not zero."),
    "INVALID_AMOUNT": ("blocker", "Ledger rows have no readable amount; sums that would need them are not given."),
    "MISSING_BUDGET": ("blocker", "Accounts have actuals but no budget rows; missing budget is not zero budget."),
    "VARIANCE_NOT_IMPLEMENTED": (
        "blocker",
        "No deterministic variance oracle is bound; variance is not fabricated.",
    ),
    "OCCUPANCY_COUNT_MISMATCH": ("blocker", "Snapshot count does not match the stated property unit count."),
    "OCCUPANCY_UNIT_COUNT_UNKNOWN": (
        "flag",
        "Property unit count is absent or not credible; mismatch cannot be assessed.",
    ),
    "OCCUPANCY_CHANGE_UNKNOWN": ("flag", "No prior occupancy snapshot exists; change is unknown, not zero."),
    "OCCUPANCY_SNAPSHOT_MISSING": ("flag", "No occupancy snapshot at or before the review bound."),
    "FEED_STALE": ("flag", "The occupancy snapshot feed is older than the configured staleness bound."),
    "FEED_FRESHNESS_UNKNOWN": (
        "flag",
        "Feed freshness cannot be assessed without an explicit review as-of date.",
    ),
    "DUPLICATE_GL_IMPORT": (
        "material",
        "The same GL source row was imported more than once; duplicates were deduplicated before variance and are "
        "disclosed here.",
    ),
    "CHANGED_ACCOUNT_MAPPING": ("material", "A GL account category differs from its reviewed mapping."),
    "UNREVIEWED_ACCOUNT_MAPPING": ("material", "A GL account has no single approved account mapping."),
    "MATERIAL_VARIANCE": ("material", "Actual-versus-budget variance meets the configured materiality threshold."),
    "BUDGET_WITHOUT_ACTUAL": ("flag", "Accounts have budget rows but no actual rows; missing actuals are not zero."),
}


@dataclass
class Review:
    """Tables of one review run. ``accounts`` holds one row per (property, period, account)."""

    clean: DataFrame
    accounts: DataFrame
    occupancy: DataFrame
    policy: Materiality
    has_variance_fn: bool = True


def review(
    gl: DataFrame,
    properties: DataFrame,
    snapshots: DataFrame,
    mappings: DataFrame,
    policy: Materiality | None = None,
    review_days: DataFrame | None = None,
    variance_fn: ops.VarianceFn | None = ops.account_variance,
    stage: Callable[[DataFrame], DataFrame] | None = None,
    requests: DataFrame | None = None,
) -> Review:
    """Build the review tables. ``review_days(property_id, period, review_day)`` is optional; without a day the
    snapshot bound is the month end and freshness stays unknown. ``requests(property_id, period)`` names what is asked:
    months without ledger rows then come out as MISSING_ACTUALS, and nothing else is answered.

    ``summary`` reads the ledger once and needs no staging. Outputs that read several tables (``exceptions``,
    ``measured_facts``) should pass ``stage=cut_lineage`` so the ledger is cleaned once and not once per rule.
    """
    policy = policy or Materiality()
    stage = stage or (lambda df: df)
    if requests is not None:
        requests = requests.select(*REVIEW_KEY).distinct()
        gl = gl.join(requests, REVIEW_KEY, "left_semi")
    clean = stage(ops.dedupe_gl(gl))
    accounts = ops.actual_budget_coverage(ops.account_rollup(clean))
    accounts = with_variance(ops.with_mapping_state(accounts, mappings), variance_fn)
    by_size = Window.partitionBy(*REVIEW_KEY).orderBy(F.abs("variance").desc_nulls_last(), "account_code")
    threshold = F.lit(policy.variance_abs).cast("decimal(38,8)")
    accounts = stage(
        accounts.withColumns(
            {
                "is_material": F.coalesce(F.abs("variance") >= threshold, F.lit(False)),
                "rank": F.row_number().over(by_size),
            }
        )
    )
    days = accounts.select(*REVIEW_KEY).distinct() if requests is None else requests
    if review_days is None:
        days = days.withColumn("review_day", F.lit(None).cast("date"))
    else:
        days = days.join(review_days, REVIEW_KEY, "left")
    days = days.withColumn("bound", F.coalesce("review_day", month_end(F.col("period"))))
    return Review(
        clean, accounts, stage(occupancy_review(days, snapshots, properties, policy)), policy, variance_fn is not None
    )


def with_variance(accounts: DataFrame, fn: ops.VarianceFn | None) -> DataFrame:
    """Add ``variance``. The built-in rule is an expression; a caller's function is run and held to the contract;
    no function leaves NULL."""
    if fn is None:
        return accounts.withColumn("variance", F.lit(None).cast("decimal(38,2)"))
    if fn is ops.account_variance:
        return accounts.withColumn("variance", ops.variance_expr())
    by_account = ops.bound_variance(accounts, fn).select(*ACCOUNT_KEY, "variance")
    return accounts.join(by_account, ACCOUNT_KEY, "left")


def occupancy_review(
    requests: DataFrame,
    snapshots: DataFrame,
    properties: DataFrame,
    policy: Materiality,
    keep: list[str] | None = None,
) -> DataFrame:
    """Current and prior snapshot, deltas, freshness and unit-count match per (property, period) request."""
    found = occupancy.as_of_snapshot(requests, snapshots, monthly=True).join(
        properties.select(F.col("id").alias("property_id"), "unit_count"), "property_id", "left"
    )
    den = sum((F.col(f"current.{c}") for c in ("vacant", "down")), F.col("current.occupied"))
    prior_den = sum((F.col(f"current.prior.{c}") for c in ("vacant", "down")), F.col("current.prior.occupied"))
    age = feed_age(F.col("current.as_of_date"), F.col("review_day"), policy.stale_after_days)
    units = F.col("unit_count")
    match = (
        F.when(F.col("current").isNull() | units.isNull() | (units <= 0), "unknown")
        .when(units != den, "mismatch")
        .otherwise("match")
    )
    return found.select(
        *(keep or [*REVIEW_KEY, "review_day"]),
        "bound",
        "current",
        den.alias("denominator"),
        prior_den.alias("prior_denominator"),
        age["age_days"].alias("age_days"),
        age["freshness"].alias("freshness"),
        units.alias("unit_count"),
        match.alias("mismatch_status"),
    )


def _text_map(**values: Column) -> Column:
    return F.create_map(*[x for k, v in values.items() for x in (F.lit(k), v.cast("string"))])


def _exception(df: DataFrame, code: str | Column, details: Column, evidence: Column, subject: Column) -> DataFrame:
    truncated = F.col("evidence_truncated") if "evidence_truncated" in df.columns else F.lit(False)
    return df.select(
        *REVIEW_KEY,
        (F.lit(code) if isinstance(code, str) else code).alias("code"),
        subject.cast("string").alias("subject"),
        details.alias("details"),
        evidence.alias("evidence"),
        truncated.alias("evidence_truncated"),
    )


def exceptions(r: Review) -> DataFrame:
    """One long table of typed exceptions: code, severity, fixed message, subject, details, at most 50 evidence rows and whether
    there were more."""
    none = F.lit(None).cast("string")
    no_rows = F.expr("cast(array() as array<struct<artifact:string,row:int,table:string,period:string>>)")
    account_rows = ops.account_evidence(r.clean)
    cited = ops.citations(F.col("evidence"), F.col("period"))
    accounts = r.accounts.join(account_rows, ACCOUNT_KEY)

    # Evidence is merged per coverage class, so one grouping serves both coverage codes and the missing actuals.
    merged = accounts.groupBy(*REVIEW_KEY, "coverage").agg(
        F.array_sort(F.collect_list("account_code")).alias("accounts"),
        ops.merge_evidence(F.collect_list("evidence")).alias("evidence"),
        (F.bool_or("evidence_truncated") | (F.sum(F.size("evidence")) > ops.MAX_EVIDENCE)).alias("evidence_truncated"),
    )
    coverage = _exception(
        merged.filter("coverage <> 'covered'"),
        F.col("coverage"),
        _text_map(accounts=F.array_join("accounts", ",")),
        cited,
        F.array_join("accounts", ","),
    )
    counted = r.accounts.groupBy(*REVIEW_KEY).agg(
        F.sum("actual_rows").alias("actual_rows"), F.count_if(F.col("budget_rows") > 0).alias("budget_accounts")
    )
    asked = r.occupancy.select(*REVIEW_KEY).join(counted, REVIEW_KEY, "left").fillna(0, ["actual_rows", "budget_accounts"])
    no_actuals = _exception(
        asked.filter("actual_rows = 0"),
        "MISSING_ACTUALS",
        _text_map(actual_rows=F.lit(0), budget_rows=F.col("budget_accounts")),
        no_rows,
        none,
    )

    o = r.occupancy
    snap = F.col("current")
    snap_cite = F.array(
        F.struct(
            snap["source_file"].alias("artifact"),
            snap["source_row"].cast("int").alias("row"),
            F.lit("rent_roll_snapshots").alias("table"),
            snap["as_of_date"].cast("string").alias("period"),
        )
    )
    present = snap.isNotNull()
    occupancy_codes = F.array_compact(
        F.array(
            F.when(~present, "OCCUPANCY_SNAPSHOT_MISSING"),
            F.when(present & F.col("review_day").isNull(), "FEED_FRESHNESS_UNKNOWN"),
            F.when(present & (F.col("freshness") == "stale"), "FEED_STALE"),
            F.when(present & snap["prior"].isNull(), "OCCUPANCY_CHANGE_UNKNOWN"),
            F.when(
                present & (F.col("unit_count").isNull() | (F.col("unit_count") <= 0)), "OCCUPANCY_UNIT_COUNT_UNKNOWN"
            ),
            F.when(present & (F.col("mismatch_status") == "mismatch"), "OCCUPANCY_COUNT_MISMATCH"),
        )
    )
    occ = o.withColumn("code", F.explode(occupancy_codes))
    occ = _exception(
        occ,
        F.col("code"),
        F.map_filter(
            _text_map(
                bound=F.when(F.col("code") == "OCCUPANCY_SNAPSHOT_MISSING", F.col("bound").cast("string")),
                age_days=F.when(F.col("code") == "FEED_STALE", F.col("age_days")),
                stale_after_days=F.when(F.col("code") == "FEED_STALE", F.lit(r.policy.stale_after_days)),
                unit_count=F.when(F.col("code").startswith("OCCUPANCY_"), F.col("unit_count")),
                snapshot_denominator=F.when(F.col("code") == "OCCUPANCY_COUNT_MISMATCH", F.col("denominator")),
            ),
            lambda k, v: v.isNotNull(),
        ),
        F.when(present, snap_cite).otherwise(no_rows),
        none,
    )

    dup = ops.duplicate_imports(r.clean)
    dup = _exception(
        dup,
        "DUPLICATE_GL_IMPORT",
        _text_map(
            kind=F.col("kind"),
            source_file=F.col("source_file"),
            source_row=F.col("source_row"),
            copies=F.col("copies"),
            amounts_differ=F.col("amounts_differ"),
            kept_amount=F.col("amount"),
        ),
        ops.citations(F.array(F.struct(*ops.EVIDENCE_ORDER)), F.col("period")),
        F.concat_ws("|", "kind", "source_file", "source_row", "account_code"),
    )

    keep = lambda m: F.map_filter(m, lambda k, v: v.isNotNull())
    reviewed = F.col("reason").isNull()
    mapping_details = keep(
        _text_map(
            account_code=F.col("account_code"),
            reason=F.col("reason"),
            status=F.array_join("statuses", ","),
            gl_categories=F.when(reviewed, F.array_join("gl_categories", ",")),
            mapped_category=F.when(reviewed, F.col("mapped_category")),
        )
    )
    material_details = keep(
        _text_map(
            account_code=F.col("account_code"),
            category=F.col("category"),
            actual=F.col("actual"),
            budget=F.col("budget"),
            variance=F.col("variance"),
            threshold=F.lit(r.policy.variance_abs),
            rank=F.col("rank"),
        )
    )
    found = F.array_compact(
        F.array(
            F.when(
                F.col("invalid_rows") > 0,
                F.struct(
                    F.lit("INVALID_AMOUNT").alias("code"),
                    _text_map(account_code=F.col("account_code"), invalid_rows=F.col("invalid_rows")).alias("details"),
                ),
            ),
            F.when(
                F.col("mapping_error").isNotNull(),
                F.struct(F.col("mapping_error").alias("code"), mapping_details.alias("details")),
            ),
            F.when(
                F.col("is_material"),
                F.struct(F.lit("MATERIAL_VARIANCE").alias("code"), material_details.alias("details")),
            ),
        )
    )
    per_account = accounts.withColumn("found", F.explode(found))
    per_account = _exception(
        per_account, F.col("found.code"), F.col("found.details"), cited, F.col("account_code")
    )
    parts = [coverage, no_actuals, occ, dup, per_account]
    if not r.has_variance_fn:
        keys = r.occupancy.select(*REVIEW_KEY)
        parts.append(_exception(keys, "VARIANCE_NOT_IMPLEMENTED", keep(_text_map(fn=none)), no_rows, none))
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    severity = F.create_map(*[F.lit(x) for code, (sev, _) in EXCEPTIONS.items() for x in (code, sev)])
    message = F.create_map(*[F.lit(x) for code, (_, msg) in EXCEPTIONS.items() for x in (code, msg)])
    return out.withColumns({"severity": severity[F.col("code")], "message": message[F.col("code")]})


def review_rollup(accounts: DataFrame) -> DataFrame:
    """Counts, mapping and materiality tallies and the NOI bridge per (property, period), in one grouping."""
    covered = F.col("coverage") == "covered"
    return accounts.groupBy(*REVIEW_KEY).agg(
        F.count_if(F.col("coverage") == "MISSING_BUDGET").alias("missing_budget_accounts"),
        F.count_if(F.col("coverage") == "BUDGET_WITHOUT_ACTUAL").alias("budget_only_accounts"),
        F.sum("actual_rows").alias("actual_rows"),
        F.sum("budget_rows").alias("budget_rows"),
        F.count_if(F.col("invalid_rows") > 0).alias("invalid_accounts"),
        F.count("*").alias("distinct_accounts"),
        F.sum("duplicate_groups").alias("duplicate_groups"),
        F.sum("duplicate_rows").alias("duplicate_rows"),
        F.count_if("is_material").alias("material_variances"),
        F.count_if(F.col("mapping_error").isNotNull()).alias("mapping_exceptions"),
        *[F.sum(c).alias(c) for c in ("refused_rows",) if c in accounts.columns],
        *ops.bridge_sums(covered),
    )


def summary_table(
    gl: DataFrame,
    properties: DataFrame,
    snapshots: DataFrame,
    mappings: DataFrame,
    policy: Materiality | None = None,
    months_to_review: int | None = None,
    variance_fn: ops.VarianceFn | None = ops.account_variance,
    requests: DataFrame | None = None,
    check_rows: bool = False,
) -> DataFrame:
    """One row per (property, period): status, blocker codes, counts, occupancy and the NOI bridge.

    A straight pipeline: one ledger scan, one shuffle on the import key, one on the account key, one on the review
    key and one on the property for the snapshot look-up. ``months_to_review`` dates each review that many months
    after its period starts; without it the snapshot bound is the month end and freshness is unknown.
    ``requests(property_id, period)`` names the months to answer: one without ledger rows comes out blocked with
    MISSING_ACTUALS, with counts of zero and sums of NULL.

    With ``check_rows`` each ledger row is held to the row contract (``validate_gl``) in the same pass. A month with a row
    that breaks it is blocked with INVALID_CONTRACT: ``refused_rows`` counts these rows, and no amount of that month and no
    number made from one is given. Rows without a property, or with a period that is no month, form such months of
    their own.
    """
    policy = policy or Materiality()
    if requests is not None:
        requests = requests.select(*REVIEW_KEY).distinct()
        gl = gl.join(requests, REVIEW_KEY, "left_semi")
    if check_rows:
        gl = ops.validate_gl(gl)
    accounts = ops.actual_budget_coverage(ops.account_rollup(ops.dedupe_gl(gl)))
    accounts = with_variance(ops.with_mapping_state(accounts, mappings), variance_fn)
    threshold = F.lit(policy.variance_abs).cast("decimal(38,8)")
    accounts = accounts.withColumn("is_material", F.coalesce(F.abs("variance") >= threshold, F.lit(False)))
    rows = review_rollup(accounts)
    if requests is not None:
        counts = [c for c, kind in rows.dtypes if kind == "bigint"]
        rows = requests.join(rows, REVIEW_KEY, "left").fillna(0, counts)
    if check_rows:
        sums = [f"{side}_{name}" for side in ("actual", "budget") for name in ("revenue", "expenses")]
        held = ["material_variances", *sums, "unmapped_actual", "unmapped_budget"]
        rows = rows.withColumns({c: F.when(F.col("refused_rows") == 0, F.col(c)) for c in held})
    rows = ops.bridge_results(rows)
    start = F.concat("period", F.lit("-01")).try_cast("date")
    day = F.lit(None).cast("date") if months_to_review is None else F.add_months(start, months_to_review)
    rows = rows.withColumn("review_day", day)
    rows = rows.withColumn("bound", F.coalesce("review_day", month_end(F.col("period"))))
    out = occupancy_review(rows, snapshots, properties, policy, keep=[c for c in rows.columns if c != "bound"])
    no_fn = F.lit(variance_fn is None)
    blockers = F.array_compact(
        F.array(
            *[F.when(F.col("refused_rows") > 0, "INVALID_CONTRACT") for _ in range(check_rows)],
            F.when(F.col("actual_rows") == 0, "MISSING_ACTUALS"),
            F.when(F.col("invalid_accounts") > 0, "INVALID_AMOUNT"),
            F.when(F.col("missing_budget_accounts") > 0, "MISSING_BUDGET"),
            F.when(F.col("mismatch_status") == "mismatch", "OCCUPANCY_COUNT_MISMATCH"),
            F.when(no_fn, "VARIANCE_NOT_IMPLEMENTED"),
        )
    )
    out = out.withColumn("blockers", blockers)
    return out.withColumns(
        {
            "status": F.when(F.size("blockers") > 0, "blocked").otherwise("reviewed"),
            "variance_status": F.when(no_fn, "not_implemented")
            .when(F.col("covered_accounts") > 0, "provided")
            .otherwise("not_available"),
        }
    )


def measured_facts(r: Review, limit: int = 100) -> DataFrame:
    """Sentences that restate measured values, in a fixed order and at most 100 per review. No hypotheses.

    ``facts`` counts all facts of the review and ``facts_truncated`` says whether some were left out."""
    o, snap = r.occupancy.filter("current is not null"), F.col("current")

    def say(df: DataFrame, order: Column, template: str, *args: Column | str) -> DataFrame:
        return df.select(*REVIEW_KEY, order.alias("fact_order"), F.format_string(template, *args).alias("statement"))

    first = lambda n: F.lit(f"{n}")
    parts = [
        say(
            o.filter("freshness = 'stale'"),
            first(1),
            f"Occupancy snapshot feed is %d days old (bound {r.policy.stale_after_days} days).",
            "age_days",
        ),
        say(
            o,
            first(2),
            "occupied %d of %d units as of %s.",
            snap["occupied"],
            F.col("denominator"),
            snap["as_of_date"].cast("string"),
        ),
        say(
            o.filter("current.prior is not null"),
            first(3),
            "Occupied units changed by %d since %s.",
            snap["occupied"] - snap["prior"]["occupied"],
            snap["prior"]["as_of_date"].cast("string"),
        ),
        say(
            o.filter("mismatch_status = 'mismatch'"),
            first(4),
            "OCCUPANCY_COUNT_MISMATCH: snapshot denominator %d differs from stated unit count %d.",
            "denominator",
            "unit_count",
        ),
        say(
            ops.review_counts(r.accounts).filter("duplicate_groups > 0"),
            first(5),
            "%d duplicate GL import group(s) deduplicated before variance.",
            "duplicate_groups",
        ),
        say(
            r.accounts.filter("is_material"),
            F.concat(F.lit("6"), F.lpad(F.col("rank").cast("string"), 9, "0")),
            f"Account %s variance %s {r.policy.currency} meets the materiality threshold {r.policy.variance_abs}.",
            "account_code",
            F.col("variance").cast("string"),
        ),
    ]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    totals = out.groupBy(*REVIEW_KEY).agg(F.count("*").alias("facts"))
    kept = top_n(out, REVIEW_KEY, [F.col("fact_order")], limit).join(totals, REVIEW_KEY)
    return kept.withColumn("facts_truncated", F.col("facts") > limit)


def review_status(exception_rows: DataFrame) -> DataFrame:
    """Status and distinct codes by severity per (property, period); blocked as soon as one blocker exists."""

    def codes(severity: str) -> Column:
        return F.array_sort(F.collect_set(F.when(F.col("severity") == severity, F.col("code"))))

    return exception_rows.groupBy(*REVIEW_KEY).agg(
        F.when(F.bool_or(F.col("severity") == "blocker"), "blocked").otherwise("reviewed").alias("status"),
        codes("blocker").alias("blockers"),
        codes("material").alias("material"),
        codes("flag").alias("flags"),
        F.count("*").alias("exception_count"),
    )
