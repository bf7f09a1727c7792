"""Sources, manifests, registers, decisions, workflow runs and readiness, as tables over all subjects."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rentloom.functions.hashing import canonical_json, prefixed_id
from rentloom.functions.jsonx import flatten_json
from rentloom.functions.money import PLAIN_DECIMAL, parse_money
from rentloom.functions.refusal import all_failures, any_of, failed, first_failure
from rentloom.functions.skew import Stage, carry_forward, join_present, previous
from rentloom.operators.evidence import worst_state

# Money kinds with their basis, periods, gates, blocker actions, buckets, workflow rules.
KIND_BASIS = {
    "unit_rent": "unit",
    "charge_rent": "charge",
    "report_total": "report",
    "deposit": "deposit",
    "concession": "concession",
    "arrears": "arrears",
    "scheduled_charge": "scheduled_charge",
    "collected_cash": "collected_cash",
}
MONEY_PERIODS = ["month", "year", "day", "one_time", "as_of"]
GATES = [
    "source_validity", "canonical_readiness", "analysis_approval", "tax_approval", "policy_approval",
    "engine_eligibility", "reconciliation", "certification",
]
ACTION_KINDS = {
    "T12_REPAIRS_NOT_IMPLEMENTED": "engineering_permission",
    "CANONICAL_TARGET_RENT_GATE_NOT_IMPLEMENTED": "engineering_permission",
    "UNVERIFIED_MONTH_COVERAGE": "source_and_engineering",
    "OPEX_BOUNDARY_AND_MAPPING_REVIEW_REQUIRED": "source_and_engineering",
    "AMBIGUOUS_FLOORPLAN": "source_evidence",
    "MISSING_INPLACE_RENT": "source_evidence",
    "MISSING_MILLAGE": "source_evidence_then_human",
    "NEEDS_ANALYSIS_WINDOW": "human_analytical_approval",
    "MIXED_USE_REVENUE_AND_TRANSACTION_SCOPE_REVIEW_REQUIRED": "source_evidence_then_human",
    "COMMERCIAL_SCOPE_REVIEW_REQUIRED": "source_evidence_then_human",
    "PORTFOLIO_ASSET_SCOPE_REVIEW_REQUIRED": "source_evidence_then_human",
}
BUCKETS = [
    "gross_potential_rent", "vacancy_loss", "concessions", "employee_model", "bad_debt", "loss_to_lease",
    "commercial_income", "utility_reimbursements", "other_income", "insurance", "real_estate_taxes", "payroll",
    "utilities", "repairs_maintenance", "make_ready", "contract_services", "marketing", "general_administrative",
    "management_fees", "replacement_reserves", "noi",
]
SIDES = ["actual", "broker", "house"]
NEXT_STAGES = {
    "inspected": ["normalized"],
    "normalized": ["review_required", "reconciled"],
    "review_required": ["reconciled"],
    "reconciled": ["canonical_ready"],
    "execution_authorized": ["engine_executed"],
    "engine_executed": ["report_ready"],
}
# Only the event of that name authorises, and only from this stage; a plain stage event never does.
AUTHORIZED_FROM = "canonical_ready"
EVENT_KINDS = ["created", "stage", "execution_authorized", "review", "engine_error", "inputs_repinned"]
REQUIRED_INPUTS = ["om", "rr", "t12", "debt"]
REQUIRED_VALUES = ["millage", "horizon"]
FORMATS = ["pdf", "xlsx", "csv"]
SHA = r"^[0-9a-f]{64}$"


def _literals(values: list[str]) -> Column:
    return F.array(*[F.lit(v) for v in values])


# ---------------------------------------------------------------- sources, citations, money


def validate_sources(sources: DataFrame) -> DataFrame:
    """Source rows (source_id, sha256, role, parents) with failing rules: unique id and hash, known role, parents
    only on derivatives, and every parent an original."""
    ids = sources.groupBy("source_id").agg(F.count("*").alias("id_copies"))
    shas = sources.groupBy("sha256").agg(F.count("*").alias("sha_copies"))
    originals = sources.filter("role = 'original'").select(F.col("source_id").alias("parent")).distinct()
    bad_parents = (
        sources.select("source_id", F.explode("parents").alias("parent"))
        .join(originals, "parent", "left_anti")
        .groupBy("source_id")
        .agg(F.count("*").alias("bad_parents"))
    )
    joined = sources.join(ids, "source_id").join(shas, "sha256").join(bad_parents, "source_id", "left")
    issues = all_failures(
        (failed(F.col("sha256").rlike(SHA)), "INVALID_HASH"),
        (F.col("id_copies") > 1, "DUPLICATE_ID"),
        (F.col("sha_copies") > 1, "DUPLICATE_SHA"),
        (failed(F.col("role").isin("original", "derivative")), "INVALID_ROLE"),
        ((F.size("parents") > 0) != (F.col("role") == "derivative"), "PARENTS_ROLE_MISMATCH"),
        (F.col("bad_parents") > 0, "PARENT_NOT_ORIGINAL"),
    )
    return joined.withColumn("issues", issues).drop("id_copies", "sha_copies", "bad_parents")


def locator_error() -> Column:
    """INVALID_LOCATOR unless exactly one arm is given and in bounds: a grid cell, or a page with a box."""
    grid = (
        F.col("sheet").between(1, 1024)
        & F.col("row").between(1, 1_000_000)
        & (F.col("row_end") >= F.col("row"))
        & F.col("column").between(1, 16384)
        & F.col("page").isNull()
    )
    box = F.col("bounds")
    page = (
        F.col("page").between(1, 100_000)
        & (F.size(box) == 4)
        & (F.get(box, F.lit(0)) < F.get(box, F.lit(2)))
        & (F.get(box, F.lit(1)) < F.get(box, F.lit(3)))
        & F.col("sheet").isNull()
    )
    return F.when(~(F.coalesce(grid, F.lit(False)) | F.coalesce(page, F.lit(False))), F.lit("INVALID_LOCATOR"))


def validate_citations(citations: DataFrame, sources: DataFrame) -> DataFrame:
    """Citations (cited_id, cited_sha256, by_source_id and a locator) against declared sources: the cited source is an
    original with that hash, and a derivative cites only its parents."""
    cited = sources.select(
        F.col("source_id").alias("cited_id"), F.col("sha256").alias("c_sha"), F.col("role").alias("c_role")
    )
    citing = sources.select(
        F.col("source_id").alias("by_source_id"), F.col("role").alias("b_role"), F.col("parents").alias("b_parents")
    )
    joined = citations.join(cited, "cited_id", "left").join(citing, "by_source_id", "left")
    allowed = F.when(F.col("b_role") == "original", F.col("cited_id") == F.col("by_source_id")).otherwise(
        F.array_contains("b_parents", F.col("cited_id"))
    )
    error = F.coalesce(
        locator_error(),
        first_failure(
            (F.col("c_sha").isNull() | F.col("b_role").isNull(), "UNKNOWN_SOURCE"),
            (F.col("c_role") != "original", "NOT_ORIGINAL"),
            (F.col("c_sha") != F.col("cited_sha256"), "HASH_MISMATCH"),
            (failed(allowed), "SCOPE_MISMATCH"),
        ),
    )
    return joined.withColumn("error_code", error).drop("c_sha", "c_role", "b_role", "b_parents")


def money_citation_id() -> Column:
    return prefixed_id(
        "mny",
        64,
        **{n: F.col(n) for n in ("source_id", "source_sha256", "sheet", "row", "row_end", "column")},
    )


def validate_money_observations(rows: DataFrame) -> DataFrame:
    """Money observations with the first failing rule. Kinds are never added together anywhere."""
    parsed = parse_money(F.col("source_text"), F.col("currency"))
    basis = F.try_element_at(F.create_map(*[F.lit(x) for kv in KIND_BASIS.items() for x in kv]), F.col("kind"))
    given = F.col("decimal").isNotNull()
    rows = rows.withColumn("parsed", parsed)
    unknown = F.col("parsed.error_code") == "UNKNOWN_AMOUNT_NOT_ZERO"
    error = first_failure(
        (basis.isNull(), "INVALID_OBSERVATIONS"),
        (basis != F.col("measurement_basis"), "MIXED_MEASUREMENT_BASIS"),
        (F.col("cell_origin").isin("formula", "formula_cache", "cached_value", "data_only_cache"), "FORMULA_CACHE_NOT_ORIGINAL"),
        (failed(F.col("cell_origin") == "typed"), "INVALID_OBSERVATIONS"),
        (failed(F.col("period").isin(MONEY_PERIODS)), "INVALID_OBSERVATIONS"),
        (F.col("observation_id") != money_citation_id(), "INVALID_OBSERVATIONS"),
        (given & unknown, "UNKNOWN_AMOUNT_NOT_ZERO"),
        (given & F.col("parsed.error_code").isNotNull(), "AMBIGUOUS_NUMERIC_FORMAT"),
        (given & (F.col("parsed.amount_text") != F.col("decimal")), "INVALID_OBSERVATIONS"),
    )
    return rows.withColumn("error_code", error).drop("parsed")


# ---------------------------------------------------------------- manifest and acceptance


def duplicate_sources(entries: DataFrame) -> DataFrame:
    """Selected entries with DUPLICATE_SOURCE (same hash or path) or AMBIGUOUS_SNAPSHOT (same subject and date)."""
    run = entries.filter("selection = 'run'")
    by_sha = run.groupBy("source_sha256").agg(F.count("*").alias("same_sha"))
    by_path = run.groupBy("path").agg(F.count("*").alias("same_path"))
    # Entries that share a subject and date but neither hash nor path: compare the group with its own duplicates.
    by_day = (
        run.filter("subject_id is not null and as_of is not null")
        .groupBy("subject_id", "as_of", "source_sha256", "path")
        .agg(F.count("*").alias("n"))
        .groupBy("subject_id", "as_of")
        .agg(F.sum("n").alias("same_day"))
    )
    joined = (
        run.join(by_sha, "source_sha256").join(by_path, "path").join(by_day, ["subject_id", "as_of"], "left")
    )
    sha_in_day = run.groupBy("subject_id", "as_of", "source_sha256").agg(F.count("*").alias("day_sha"))
    path_in_day = run.groupBy("subject_id", "as_of", "path").agg(F.count("*").alias("day_path"))
    both_in_day = run.groupBy("subject_id", "as_of", "source_sha256", "path").agg(F.count("*").alias("day_both"))
    joined = (
        joined.join(sha_in_day, ["subject_id", "as_of", "source_sha256"], "left")
        .join(path_in_day, ["subject_id", "as_of", "path"], "left")
        .join(both_in_day, ["subject_id", "as_of", "source_sha256", "path"], "left")
    )
    others = F.col("same_day") - (F.col("day_sha") + F.col("day_path") - F.col("day_both"))
    return joined.select(
        *entries.columns,
        ((F.col("same_sha") > 1) | (F.col("same_path") > 1)).alias("duplicate_source"),
        F.coalesce(others > 0, F.lit(False)).alias("ambiguous_snapshot"),
    )


SAME_AS_TARGET = ["source_sha256", "snapshot_id", "subject_id", "as_of", "entity_kind", "corpus_use"]


def validate_manifest(entries: DataFrame) -> DataFrame:
    """Manifest entries with failing rules; a declared duplicate must repeat its target's attributes."""
    target = entries.select(
        F.col("entry_id").alias("duplicate_of"),
        F.struct(*SAME_AS_TARGET).alias("t_same"),
        F.col("selection").alias("t_selection"),
    )
    joined = join_present(entries, target, "duplicate_of", ["entry_id"])
    portfolio = F.col("entity_kind") == "portfolio"
    reconcile = F.col("requested_stage") == "reconcile"
    duplicate = F.col("selection") == "declared_duplicate"
    issues = all_failures(
        (
            portfolio
            & (F.col("subject_id").isNotNull() | (F.col("corpus_use") != "comparison_only") | reconcile),
            "PORTFOLIO_NOT_COMPARISON",
        ),
        (reconcile & failed(F.col("decisions_sha256").rlike(SHA)), "DECISIONS_REQUIRED"),
        (~reconcile & F.col("decisions_sha256").isNotNull(), "DECISIONS_WITHOUT_RECONCILE"),
        (reconcile & ((F.col("entity_kind") != "property") | (F.col("corpus_use") != "inventory")), "RECONCILE_SCOPE"),
        ((F.col("selection") == "run") & F.col("exclusion_code").isNotNull(), "RUN_WITH_EXCLUSION"),
        ((F.col("selection") == "excluded") & F.col("exclusion_code").isNull(), "EXCLUSION_REQUIRED"),
        (duplicate & (F.col("t_selection").isNull() | (F.col("t_selection") == "declared_duplicate")), "DUPLICATE_TARGET"),
        (duplicate & (F.col("t_same") != F.struct(*SAME_AS_TARGET)), "DUPLICATE_DIFFERS"),
    )
    return joined.withColumn("issues", issues).drop("t_same", "t_selection")


ROW_STATES = ["excluded", "declared_duplicate", "refused", "parsed_with_blockers", "observed_unvalidated", "reconciled"]


def acceptance_totals(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Totals per run: rows by state, properties selected, properties with every row reconciled, and the verdict."""
    state = F.col("state")
    by_state = rows.groupBy(*keys).agg(
        *[F.count_if(state == s).alias(s) for s in ROW_STATES],
        F.count("*").alias("declared"),
        F.count_if(F.col("selection") == "run").alias("selected"),
        F.count_if("parser_started").alias("parser_started"),
        F.count_if(F.col("entity_kind") == "portfolio").alias("portfolio_entries"),
    )
    inventory = rows.filter(
        (F.col("selection") == "run")
        & (F.col("entity_kind") == "property")
        & (F.col("corpus_use") == "inventory")
        & F.col("subject_id").isNotNull()
        & ~F.col("duplicate_source")
    )
    subjects = inventory.groupBy(*keys, "subject_id").agg(F.bool_and(state == "reconciled").alias("full"))
    subjects = subjects.groupBy(*keys).agg(
        F.count("*").alias("distinct_selected_properties"), F.count_if("full").alias("distinct_reconciled_properties")
    )
    out = by_state.join(subjects, keys, "left").fillna(
        0, subset=["distinct_selected_properties", "distinct_reconciled_properties"]
    )
    verdict = (
        F.when(F.col("parser_started") == 0, "no_sources_ran")
        .when((F.col("refused") > 0) | (F.col("parsed_with_blockers") > 0), "blocked")
        .when(
            (F.col("reconciled") == F.col("selected")) & (F.col("distinct_reconciled_properties") > 0),
            "reconciled_selected",
        )
        .otherwise("observed_unvalidated")
    )
    return out.withColumn("assessment", verdict)


def compat_totals(readers: DataFrame, coverage: DataFrame, published: DataFrame, key: str) -> DataFrame:
    """Totals recomputed from reader and coverage rows beside the published ones; any difference refuses."""
    a = readers.groupBy(key).agg(
        F.count("*").alias("readers"),
        F.count_if(F.col("source_test_status") == "synthetic_only").alias("synthetic_only"),
        F.count_if(F.col("source_test_status") == "real_export_verified").alias("real_export_verified"),
    )
    b = coverage.groupBy(key).agg(
        F.count("*").alias("coverage_declared"),
        F.count_if("accounted").alias("coverage_accounted"),
        F.count_if(F.col("status") == "acquisition_gap").alias("acquisition_gaps"),
    )
    names = [c for c in (*a.columns, *b.columns) if c != key]
    ours = a.join(b, key, "full_outer").fillna(0, subset=names)
    theirs = published.select(key, *[F.col(n).alias(f"p_{n}") for n in names])
    joined = ours.join(theirs, key, "left")
    differs = any_of(*[~F.col(n).eqNullSafe(F.col(f"p_{n}")) for n in names])
    return joined.withColumn("error_code", F.when(differs, "TOTALS_MISMATCH")).drop(*[f"p_{n}" for n in names])


# ---------------------------------------------------------------- readiness and registers


def validate_readiness(gates: DataFrame, assets: DataFrame, package: DataFrame) -> DataFrame:
    """One row per subject with failing rules. ``gates(subject, gate, value)`` holds literal true/false text,
    ``assets`` and ``package`` hold (subject, asset_id)."""
    seen = gates.groupBy("subject").agg(
        F.size(F.array_except(_literals(GATES), F.collect_set("gate"))).alias("missing_gates"),
        F.count("*").alias("gate_rows"),
        F.count_if(failed(F.col("value").isin("true", "false"))).alias("not_literal"),
    )
    sides = assets.withColumn("side", F.lit(1)).unionByName(package.withColumn("side", F.lit(2))).distinct()
    differ = (
        sides.groupBy("subject", "asset_id")
        .agg((F.count("*") != 2).alias("one_sided"))
        .groupBy("subject")
        .agg(F.count_if("one_sided").alias("asset_differences"))
    )
    out = seen.join(differ, "subject", "left")
    return out.select(
        "subject",
        all_failures(
            (F.col("missing_gates") > 0, "GATE_MISSING"),
            (F.col("gate_rows") > len(GATES), "DUPLICATE_SUBJECT"),
            (F.col("not_literal") > 0, "LITERAL_BOOLEAN_REQUIRED"),
            (F.coalesce("asset_differences", F.lit(1)) > 0, "SUBJECT_MISMATCH"),
        ).alias("issues"),
    )


def stray_gates(deals: DataFrame, gates: DataFrame, key: str = "subject") -> DataFrame:
    """Gate rows of subjects outside the snapshot."""
    return gates.join(deals.select(key).distinct(), key, "left_anti")


def readiness_state(references: DataFrame) -> DataFrame:
    """Worst reference state per subject."""
    return references.groupBy("subject").agg(
        worst_state(F.col("state")).alias("integrity"),
        F.count_if(F.col("state") != "VERIFIED").alias("problems"),
    )


def next_actions(blockers: DataFrame) -> DataFrame:
    """Kind of next action per (subject, code); a code that is not listed is an unclassified blocker."""
    kinds = F.create_map(*[F.lit(x) for kv in ACTION_KINDS.items() for x in kv])
    return blockers.withColumn(
        "action_kind", F.coalesce(F.try_element_at(kinds, F.col("code")), F.lit("unclassified_blocker"))
    )


def register_diff(before: DataFrame, after: DataFrame) -> DataFrame:
    """ADDED, REMOVED, CHANGED or UNCHANGED per decision with the JSON pointers that differ.

    Registers hold decision_id, subject, asset_id, field, record (JSON) and the bindings tax_year, period, units. A
    moved id, a changed field or a changed binding refuses. Lists count as one value; below a differing pointer
    nothing is listed again."""
    bind = ["tax_year", "period", "units"]
    cols = ["subject", "asset_id", "field", *bind, "record"]
    left = before.select("decision_id", *[F.col(c).alias(f"b_{c}") for c in cols], F.lit(True).alias("in_b"))
    right = after.select("decision_id", *[F.col(c).alias(f"a_{c}") for c in cols], F.lit(True).alias("in_a"))
    j = left.join(right, "decision_id", "full_outer").withColumns(
        {"b_nodes": flatten_json("b_record", True), "a_nodes": flatten_json("a_record", True)}
    )
    empty = F.expr("cast(array() as array<struct<pointer:string,kind:string,value:string>>)")
    b, a = F.coalesce("b_nodes", empty), F.coalesce("a_nodes", empty)
    changed = F.array_distinct(
        F.transform(F.concat(F.array_except(b, a), F.array_except(a, b)), lambda n: n["pointer"])
    )
    j = j.withColumn("changed", F.array_sort(changed))
    top = F.filter("changed", lambda p: ~F.exists("changed", lambda q: (q != p) & p.startswith(F.concat(q, F.lit("/")))))
    both = F.col("in_a") & F.col("in_b")
    differ = lambda n: F.col(f"b_{n}").isNotNull() & F.col(f"a_{n}").isNotNull() & (F.col(f"b_{n}") != F.col(f"a_{n}"))
    error = first_failure(
        (both & ((F.col("b_subject") != F.col("a_subject")) | (F.col("b_asset_id") != F.col("a_asset_id"))), "SUBJECT_MISMATCH"),
        (both & (F.col("b_field") != F.col("a_field")), "SCOPE_MISMATCH"),
        (both & differ("units"), "UNIT_MISMATCH"),
        (both & (differ("tax_year") | differ("period")), "PERIOD_MISMATCH"),
    )
    change = (
        F.when(F.col("in_b").isNull(), "ADDED")
        .when(F.col("in_a").isNull(), "REMOVED")
        .when(F.size("changed") > 0, "CHANGED")
        .otherwise("UNCHANGED")
    )
    return j.select(
        "decision_id",
        F.when(error.isNull(), change).alias("change"),
        F.when(error.isNull() & both, top).alias("pointers"),
        error.alias("error_code"),
    )


# ---------------------------------------------------------------- three-way reconciliation


def reconcile_sources(rows: DataFrame) -> DataFrame:
    """Long rows (deal_id, bucket, side, amount) as one row per bucket with both differences to the actuals.

    A side with any missing amount is NULL, and so are its differences; it never counts as the sum of the others."""

    def total(side: str) -> Column:
        here = F.col("side") == side
        missing = F.count_if(here & F.col("amount").isNull())
        return F.when(missing == 0, F.sum(F.when(here, F.col("amount")))).cast("decimal(38,2)").alias(side)

    wide = rows.groupBy("deal_id", "bucket").agg(*map(total, SIDES))
    return wide.withColumns(
        {"broker_vs_actual": F.col("broker") - F.col("actual"), "house_vs_actual": F.col("house") - F.col("actual")}
    )


def reconciliation_coverage(wide: DataFrame, scope: list[str]) -> DataFrame:
    """Missing (bucket, side) cells of the scope, uncovered buckets, and the status ladder, per deal.

    The wanted cells are a fixed list of at most 63, so they are compared as arrays and never cross-joined."""
    wanted = F.array(*[F.lit(f"{b}/{s}") for b in scope for s in SIDES])
    cells = F.array_compact(
        F.array(*[F.when(F.col(s).isNotNull(), F.concat(F.col("bucket"), F.lit(f"/{s}"))) for s in SIDES])
    )
    have = wide.groupBy("deal_id").agg(F.array_distinct(F.flatten(F.collect_set(cells))).alias("have"))
    uncovered = sorted(set(BUCKETS) - set(scope))
    missing = F.array_except(wanted, F.col("have"))
    status = F.when(F.size(missing) > 0, "REFUSED").otherwise(
        F.lit("SYNTHETIC_SCOPED_PASS" if uncovered else "SYNTHETIC_REVIEWED_PASS")
    )
    blocker = F.when(F.size(missing) > 0, "RECON_EVIDENCE_INCOMPLETE").otherwise(
        F.lit("RECON_COVERAGE_INCOMPLETE" if uncovered else "LIVE_CERTIFICATION_NOT_IMPLEMENTED")
    )
    return have.select(
        "deal_id",
        missing.alias("missing_cells"),
        F.lit(len(uncovered)).alias("uncovered_buckets"),
        status.alias("review_status"),
        blocker.alias("blocker"),
    )


# ---------------------------------------------------------------- decisions


def check_hash_chain(decisions: DataFrame, stage: Stage = lambda df: df) -> DataFrame:
    """Decisions (chain, seq, decision_id, sha256, predecessor_sha256, supersedes array, cells array) with codes.

    An identical replay is ignored; the same id with other bytes refuses. Each predecessor must be the hash before,
    and a superseded decision must be earlier, still active and about the same cells. Decisions with their neighbour's hash
    are scanned six times; ``stage=cut_lineage`` writes them once."""
    first = decisions.groupBy("chain", "decision_id").agg(
        F.min_by(F.struct(*[c for c in decisions.columns if c not in ("chain", "decision_id")]), "seq").alias("d"),
        (F.min("sha256") != F.max("sha256")).alias("rewritten"),
        F.count("*").alias("copies"),
    )
    kept = first.select("chain", "decision_id", "d.*", "rewritten", "copies")
    chained = previous(kept, ["chain"], "seq", F.col("sha256"), "head", stage=stage)
    edges = chained.select("chain", "sha256", "seq", F.sort_array("cells").alias("cells"), F.explode("supersedes").alias("prior"))
    prior = chained.select(
        "chain", F.col("sha256").alias("prior"), F.col("seq").alias("p_seq"), F.sort_array("cells").alias("p_cells")
    )
    first_by = F.min("seq").over(Window.partitionBy("chain", "prior"))
    judged = edges.join(prior, ["chain", "prior"], "left").withColumn("first_by", first_by)
    # Each edge says something about both its decisions: what is wrong with the later one, that the earlier one is replaced.
    later = F.struct(
        "sha256",
        (F.col("p_seq").isNull() | (F.col("p_seq") >= F.col("seq"))).alias("unknown"),
        (F.col("first_by") < F.col("seq")).alias("inactive"),
        (F.col("p_cells") != F.col("cells")).alias("other_cells"),
        F.lit(False).alias("superseded"),
    )
    no = F.lit(False)
    earlier = F.struct(F.col("prior").alias("sha256"), no.alias("unknown"), no.alias("inactive"), no.alias("other_cells"), F.lit(True).alias("superseded"))
    said = judged.select("chain", F.inline(F.array(later, earlier)))
    flags = ("unknown", "inactive", "other_cells", "superseded")
    marks = said.groupBy("chain", "sha256").agg(*[F.bool_or(c).alias(c) for c in flags])
    out = chained.join(marks, ["chain", "sha256"], "left")
    error = first_failure(
        (F.col("rewritten"), "DECISION_REWRITTEN"),
        (~F.col("predecessor_sha256").eqNullSafe(F.col("head")), "BROKEN_CHAIN"),
        (F.col("unknown"), "SUPERSEDES_UNKNOWN"),
        (F.col("inactive"), "SUPERSEDES_INACTIVE"),
        (F.col("other_cells"), "SUPERSEDES_OTHER_CELLS"),
    )
    return out.select(
        "chain",
        "seq",
        "decision_id",
        "sha256",
        "copies",
        F.coalesce("superseded", F.lit(False)).alias("superseded"),
        error.alias("error_code"),
    )


def active_decisions(changes: DataFrame, chain: DataFrame) -> DataFrame:
    """One proposal per (chain, unit, field) from decisions that stand; different values give DECISION_CONFLICT."""
    standing = chain.filter("not superseded and error_code is null").select("chain", "sha256")
    live = changes.join(standing, ["chain", "sha256"], "left_semi")
    conflict = F.min("after") != F.max("after")
    return live.groupBy("chain", "unit_id", "field").agg(
        F.count("*").alias("proposals"),
        F.when(~conflict, F.min("after")).alias("after"),
        F.when(conflict, "DECISION_CONFLICT").alias("error_code"),
    )


def open_requests(units: DataFrame, proposals: DataFrame, consistency: DataFrame) -> DataFrame:
    """Per source: evidence requests by code, and final counts only when none is open.

    ``units(source_id, unit_id, status, unit_use)`` with NULL for open fields, ``proposals`` from
    ``active_decisions`` keyed by source, ``consistency`` from ``unit_consistency``."""
    fields = ["status", "unit_use"]
    long = units.select(
        "source_id",
        "unit_id",
        F.inline(F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).alias("value")) for f in fields])),
    )
    decided = proposals.select("source_id", "unit_id", "field", "after", F.col("error_code").alias("decision_error"))
    facts = long.join(decided, ["source_id", "unit_id", "field"], "left").withColumn(
        "resolved", F.when(F.col("decision_error").isNull(), F.coalesce("after", "value"))
    )
    asks = F.array_compact(
        F.array(
            F.col("decision_error"),
            F.when(F.col("resolved").isNull(), "FIELD_EVIDENCE_REQUIRED"),
        )
    )
    per_unit = facts.groupBy("source_id", "unit_id").agg(
        *[F.max(F.when(F.col("field") == f, F.col("resolved"))).alias(f) for f in fields],
        F.sum(F.size(asks)).alias("requests"),
        F.count_if(F.col("decision_error").isNotNull()).alias("conflicts"),
    )
    checked = consistency.filter("error_code = 'INCONSISTENT_UNIT'").select(
        "source_id", "unit_id", F.lit(1).alias("inconsistent")
    )
    per_unit = per_unit.join(checked, ["source_id", "unit_id"], "left")
    out = per_unit.groupBy("source_id").agg(
        (F.sum("requests") + F.count("inconsistent")).alias("open_requests"),
        F.sum("conflicts").alias("decision_conflicts"),
        *[F.count_if(F.col("status") == s).alias(s) for s in ("occupied", "vacant", "down")],
        F.count("*").alias("total"),
    )
    done = F.col("open_requests") == 0
    return out.select(
        "source_id",
        "open_requests",
        "decision_conflicts",
        *[F.when(done, F.col(c)).alias(c) for c in ("occupied", "vacant", "down", "total")],
        F.when(done, "reconciled").otherwise("review_required").alias("state"),
    )


# ---------------------------------------------------------------- workflow runs


def workflow_state(events: DataFrame) -> DataFrame:
    """Latest stage, resolved fields and refusals per run from events(run_id, n, kind, stage, decision_id, field, value).

    A step that the current stage does not allow, an event of an unknown kind, or a decision id used twice is CORRUPT_INPUT.
    The first recorded value of a field stands; another value later is CONFLICT_UNRESOLVED. With a column
    ``decision_status``, only approved decisions resolve a field."""
    run = ["run_id"]
    becomes = (
        F.when(F.col("kind") == "created", "inspected")
        .when(F.col("kind") == "stage", F.col("stage"))
        .when(F.col("kind") == "execution_authorized", "execution_authorized")
    )
    staged = events.withColumn("becomes", becomes)
    moves = previous(staged.filter("becomes is not null"), run, "n", F.col("becomes"), "before")
    allowed = F.create_map(*[x for s, nxt in NEXT_STAGES.items() for x in (F.lit(s), _literals(nxt))])
    legal = (
        F.when(F.col("before").isNull(), F.col("kind") == "created")
        .when(F.col("kind") == "execution_authorized", F.col("before") == AUTHORIZED_FROM)
        .otherwise(F.array_contains(F.try_element_at(allowed, F.col("before")), F.col("becomes")))
    )
    stages = moves.groupBy(*run).agg(
        F.max_by("becomes", "n").alias("stage"), F.count_if(failed(legal)).alias("illegal_moves")
    )
    current = carry_forward(staged, run, "n", F.col("becomes"), "current")
    needs = F.when(F.col("kind") == "review", "review_required").when(F.col("kind") == "engine_error", "execution_authorized")
    misplaced = current.groupBy(*run).agg(
        F.count("*").alias("event_count"),
        F.count_if(needs.isNotNull() & ~F.col("current").eqNullSafe(needs)).alias("misplaced"),
        F.count_if(failed(F.col("kind").isin(EVENT_KINDS))).alias("unknown"),
        F.max_by("kind", "n").alias("last_kind"),
    )
    reviews = events.filter("kind = 'review'")
    twice = reviews.groupBy(*run, "decision_id").agg((F.count("*") > 1).alias("again")).groupBy(*run).agg(
        F.count_if("again").alias("repeated_decisions")
    )
    standing = reviews.filter("decision_status = 'approved'") if "decision_status" in events.columns else reviews
    fields = standing.groupBy(*run, "field").agg(
        F.min_by("value", "n").alias("value"), (F.min("value") != F.max("value")).alias("conflict")
    )
    fields = fields.groupBy(*run).agg(
        F.array_sort(F.collect_list(F.concat_ws("=", "field", "value"))).alias("resolutions"),
        F.count_if("conflict").alias("conflicts"),
    )
    out = stages.join(misplaced, run).join(twice, run, "left").join(fields, run, "left")
    error = first_failure(
        (any_of(*[F.col(c) > 0 for c in ("illegal_moves", "misplaced", "unknown", "repeated_decisions")]), "CORRUPT_INPUT"),
        (F.col("conflicts") > 0, "CONFLICT_UNRESOLVED"),
    )
    return out.select(
        "run_id",
        F.when(~F.coalesce(error == "CORRUPT_INPUT", F.lit(False)), F.col("stage")).alias("stage"),
        "event_count",
        F.coalesce("resolutions", F.expr("cast(array() as array<string>)")).alias("resolutions"),
        error.alias("error_code"),
    )


def workflow_blockers(runs: DataFrame) -> DataFrame:
    """Blockers and outcome per run(run_id, inputs array<struct<name,format,intact>>, value_names, resolved_names,
    execution_error)."""
    names = F.transform("inputs", lambda i: i["name"])
    corrupt = F.transform(
        F.filter("inputs", lambda i: ~F.coalesce(i["intact"], F.lit(False))),
        lambda i: F.struct(i["name"].alias("field"), F.lit("corrupt_input").alias("kind")),
    )
    unsupported = F.transform(
        F.filter("inputs", lambda i: F.coalesce(i["intact"], F.lit(False)) & ~i["format"].isin(FORMATS)),
        lambda i: F.struct(i["name"].alias("field"), F.lit("unsupported_engineering").alias("kind")),
    )
    absent = F.transform(
        F.array_except(_literals(REQUIRED_INPUTS), names),
        lambda n: F.struct(n.alias("field"), F.lit("pending_human_action").alias("kind")),
    )
    given = F.concat(F.col("value_names"), F.col("resolved_names"))
    unset = F.transform(
        F.array_except(_literals(REQUIRED_VALUES), given),
        lambda n: F.struct(n.alias("field"), F.lit("pending_human_action").alias("kind")),
    )
    out = runs.withColumn("blockers", F.concat(corrupt, unsupported, absent, unset))
    outcome = (
        F.when(F.col("execution_error"), "execution_error")
        .when(F.exists("blockers", lambda b: b["kind"] == "unsupported_engineering"), "unsupported_input")
        .when(F.size("blockers") > 0, "needs_review_or_data")
        .otherwise("complete")
    )
    return out.withColumn("outcome", outcome)


# ---------------------------------------------------------------- observation migration


def _unit_v2(unit: Column) -> Column:
    anchor = canonical_json(
        source_id=F.col("source_id"),
        source_sha256=F.col("source_sha256"),
        sheet=unit["sheet"],
        row=unit["row"],
        row_end=unit["row"],
        column=unit["column"],
    )
    return F.struct(
        F.concat(F.lit("unit_"), F.sha2(anchor, 256)).alias("observation_id"),
        unit["unit_type"].alias("unit_type"),
        unit["status"].alias("status"),
        unit["row"].alias("row"),
    )


def migrate_observations(old: DataFrame) -> DataFrame:
    """Version 1 envelopes to version 2: stable ids from the cited cell, one unit list, units of unknown use taken
    from their issues, completeness per scope. Unit names and person fields are left behind.

    ``old``: source_id, source_sha256, residential_units, commercial_units, unresolved_units (arrays of
    struct<unit_id,status,unit_type,sheet,row,column>), counts per scope, status."""

    def scope(name: str) -> Column:
        counts = F.col(f"{name}_counts")
        parts = [counts[n] for n in ("occupied", "vacant", "down", "total")]
        known = sum((p.isNotNull().cast("int") for p in parts), F.lit(0))
        enumeration = F.when(known == 0, "unknown").when(known == 4, "complete").otherwise("partial")
        return F.struct(enumeration.alias("enumeration"), F.lit("unknown").alias("coverage"), counts.alias("counts"))

    return old.select(
        F.lit("ingest-observation/2.0.0").alias("contract_version"),
        "source_id",
        "source_sha256",
        F.concat(F.transform("residential_units", _unit_v2), F.transform("commercial_units", _unit_v2)).alias("units"),
        F.transform("unresolved_units", _unit_v2).alias("unknown_use_units"),
        F.struct(scope("residential").alias("residential"), scope("commercial").alias("commercial")).alias("completeness"),
        F.when(F.col("status") == "blocked", "blocked").otherwise("observed_unvalidated").alias("status"),
    )


def preservation(old: DataFrame, new: DataFrame) -> DataFrame:
    """Unit facts that were lost or invented by a migration; empty means every fact survived unchanged."""
    from rentloom.operators.ledger import same_rows

    def facts(df: DataFrame, *lists: str) -> DataFrame:
        both = F.concat(*[F.transform(x, lambda u: F.struct(u["row"].alias("row"), u["status"].alias("status"), u["unit_type"].alias("unit_type"))) for x in lists])
        return df.select("source_id", F.inline(both))

    return same_rows(
        facts(old, "residential_units", "commercial_units", "unresolved_units"), facts(new, "units", "unknown_use_units")
    )


# ---------------------------------------------------------------- report records


def validate_report(records: DataFrame) -> DataFrame:
    """Report records (subject, period, tool, run_id, metrics map<string, struct<amount,currency,unit,period>>,
    citations map, blockers) with failing rules: exact decimal text, full labels, cited exactly when present."""
    entries = F.map_entries("metrics")
    valued = F.filter(entries, lambda e: e["value"].isNotNull())
    cited = F.map_filter("citations", lambda k, v: v.isNotNull() & (v != ""))
    bad_amount = F.exists(valued, lambda e: ~F.coalesce(e["value"]["amount"].rlike(PLAIN_DECIMAL), F.lit(False)))
    bad_label = F.exists(
        valued,
        lambda e: any_of(*[e["value"][k].isNull() | (e["value"][k] == "") for k in ("currency", "unit", "period")]),
    )
    names = F.transform(valued, lambda e: e["key"])
    return records.withColumn(
        "issues",
        all_failures(
            (any_of(*[F.col(k).isNull() | (F.col(k) == "") for k in ("subject", "period", "tool", "run_id")]), "INVALID_INPUT"),
            (failed(F.col("subject").rlike(r"^[A-Za-z0-9][A-Za-z0-9_.\- ]{0,119}$")), "INVALID_SUBJECT"),
            (bad_amount | bad_label, "INVALID_MONEY"),
            (F.size(F.array_except(names, F.map_keys(cited))) > 0, "CITATION_REQUIRED"),
            (F.size(F.array_except(F.map_keys("citations"), names)) > 0, "CITATION_WITHOUT_METRIC"),
        ),
    )
