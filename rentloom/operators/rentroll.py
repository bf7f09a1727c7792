"""Rent-roll intake over a cell grid (source_id, sheet, row, column, text), for all sources at once.

Headers, sections and continuations are found with groupings that combine before the shuffle, and values are carried
down in chunks of rows, so one very long roll does not end up in a single task.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rentloom.functions.refusal import capped_list, first_failure
from rentloom.functions.skew import carry_forward
from rentloom.functions.tokens import FUTURE_STATUS, header_key, status_token, use_token, valid_unit_id

SHEET = ["source_id", "sheet"]
REDACTED = "[REDACTED]"
EVIDENCE_ROWS = 50
PII_COLUMNS = ["tenant_name", "resident", "resident_name", "name", "payee", "phone", "email"]
# Header words per field, and the markers that switch sections.
FIELDS = {
    "unit_id": ["unit", "unit number", "unit #"],
    "status": ["status", "unit status", "occupancy status", "occupancy"],
    "unit_type": ["unit type", "space type", "property type", "unit category"],
    "tenant_name": ["resident", "resident name", "tenant", "tenant name"],
    "phone": ["phone", "phone number", "telephone"],
    "email": ["email", "email address", "e-mail"],
    "record_type": ["record type", "row type"],
    "charge": ["charge", "charge code"],
    "amount": ["amount", "scheduled charges", "scheduled"],
}
REQUIRED = ["unit_id", "status", "unit_type"]
CURRENT_SECTIONS = ["current residents", "current units", "current tenants", "units"]
EXCLUDED_SECTIONS = [
    "future residents", "future tenants", "applicants", "future/applicants", "pending renewals", "former residents",
]
# Record types of rows that add to the unit above or of the same id.
CONTINUATIONS = ["charge", "co-tenant", "cotenant"]
TOTALS = ["total", "totals", "grand total", "report total"]
SPLIT_HEADER_WORDS = {
    "unit": "^(unit|unit number|unit #)$",
    "unit_type": "^(unit type|type|unit category)$",
    "sq_ft": "sq ft|sqft|square feet",
    "market_rent": "market",
    "charge_code": "charge|^code$",
    "amount": "^amount$|charge amount",
    "deposit": "deposit",
    "move_in": "move in|movein",
    "lease_expiration": "expiration|lease expire",
    "move_out": "move out|moveout",
    "balance": "balance",
    "resident_name": "resident|name|tenant",
}


def redact_pii(df: DataFrame) -> DataFrame:
    """Replace every person column by the constant; the original text is not readable downstream."""
    return df.withColumns({c: F.lit(REDACTED) for c in df.columns if c in PII_COLUMNS})


def drop_pii(df: DataFrame) -> DataFrame:
    return df.drop(*[c for c in df.columns if c in PII_COLUMNS])


def field_of(text: Column) -> Column:
    """Field named by a header cell, else NULL."""
    pairs = [F.lit(x) for field, words in FIELDS.items() for word in words for x in (word, field)]
    return F.try_element_at(F.create_map(*pairs), header_key(text))


def header_row(cells: DataFrame, required: list[str] = REQUIRED) -> DataFrame:
    """First row per sheet that names all required fields, and whether a field is named twice on it."""
    named = cells.withColumn("field", field_of(F.col("text"))).filter(F.col("field").isNotNull())
    rows = named.groupBy(*SHEET, "row").agg(F.collect_set("field").alias("fields"), F.count("*").alias("named"))
    full = rows.filter(F.size(F.array_intersect("fields", F.array(*[F.lit(r) for r in required]))) == len(required))
    return (
        full.groupBy(*SHEET)
        .agg(F.min(F.struct("row", (F.col("named") > F.size("fields")).alias("ambiguous"))).alias("h"))
        .select(*SHEET, F.col("h.row").alias("header_row"), F.when(F.col("h.ambiguous"), "AMBIGUOUS_HEADER").alias("error_code"))
    )


def fold_split_header(cells: DataFrame, upper: int, lower: int) -> DataFrame:
    """Two header rows joined per column, matched to a field; the first column wins where a field repeats."""
    # The cells of a sheet are dealt out by sheet once and both groupings run there: nothing combines before a shuffle, as a
    # column has two cells, and grouping in the task that reads or makes the cells would sort all of them in it.
    header = cells.filter(F.col("row").isin(upper, lower)).select(*SHEET, "row", "column", "text").repartition(*SHEET)
    pair = header.groupBy(*SHEET, "column").agg(
        F.max(F.when(F.col("row") == upper, F.col("text"))).alias("a"),
        F.max(F.when(F.col("row") == lower, F.col("text"))).alias("b"),
    )
    folded = header_key(F.concat_ws(" ", F.coalesce("a", F.lit("")), F.coalesce("b", F.lit(""))), "punctuation")
    # Words that fit several fields take the first still-free one, column by column, so the fold stays an ordered
    # walk over the handful of header columns of one sheet.
    columns = pair.select(*SHEET, "column", folded.alias("header")).filter("header <> ''")
    ordered = columns.groupBy(*SHEET).agg(F.sort_array(F.collect_list(F.struct("column", "header"))).alias("cols"))
    empty = F.expr("cast(map() as map<string,int>)")

    def take(found: Column, cell: Column) -> Column:
        choice = F.coalesce(
            *[
                F.when(cell["header"].rlike(pattern) & ~F.map_contains_key(found, field), F.lit(field))
                for field, pattern in SPLIT_HEADER_WORDS.items()
            ]
        )
        return F.when(choice.isNull(), found).otherwise(
            F.map_concat(found, F.create_map(F.coalesce(choice, F.lit("")), cell["column"].cast("int")))
        )

    found = ordered.withColumn("found", F.aggregate("cols", empty, take))
    need = ["unit", "unit_type", "sq_ft", "resident_name", "market_rent", "charge_code", "amount"]
    missing = F.filter(F.array(*[F.lit(n) for n in need]), lambda n: ~F.map_contains_key(F.col("found"), n))
    return found.select(
        *SHEET,
        F.explode("found").alias("field", "column"),
        F.when(F.size(missing) > 0, "UNSUPPORTED_XLSX_LAYOUT").alias("error_code"),
    )


def records(cells: DataFrame, headers: DataFrame) -> DataFrame:
    """One row per sheet row below the header with a column per field, plus the first cell and the filled-cell count."""
    top = headers.select(*SHEET, "header_row")
    at = cells.join(top, SHEET)
    columns = (
        at.filter(F.col("row") == F.col("header_row"))
        .select(*SHEET, "column", field_of(F.col("text")).alias("field"))
        .filter(F.col("field").isNotNull())
    )
    body = at.filter((F.col("row") > F.col("header_row")) & (F.trim("text") != "")).drop("header_row")
    return (
        body.join(columns, [*SHEET, "column"], "left")
        .groupBy(*SHEET, "row")
        .agg(
            *[F.max(F.when(F.col("field") == f, F.trim("text"))).alias(f) for f in FIELDS],
            F.min_by(header_key(F.col("text")), "column").alias("first_key"),
            F.count("*").alias("filled"),
        )
    )


def section_state(rows: DataFrame) -> DataFrame:
    """Add ``section`` (current or excluded) from the last marker row above, and ``after_total``.

    Marker rows are removed; a sheet without a marker starts in the current section."""
    marker = F.when(
        F.col("filled") == 1,
        F.when(F.col("first_key").isin(EXCLUDED_SECTIONS), "excluded").when(
            F.col("first_key").isin(CURRENT_SECTIONS), "current"
        ),
    )
    marked = rows.withColumn("marker", marker)
    carried = carry_forward(marked, SHEET, "row", F.col("marker"), "section")
    ends = rows.filter(F.col("first_key").isin(TOTALS)).groupBy(*SHEET).agg(F.min("row").alias("total_row"))
    out = carried.join(ends, SHEET, "left").filter("marker is null")
    return out.select(
        *rows.columns,
        F.coalesce("section", F.lit("current")).alias("section"),
        F.coalesce(F.col("row") >= F.col("total_row"), F.lit(False)).alias("after_total"),
    )


def current_rows(rows: DataFrame) -> DataFrame:
    """Rows of the current section above the first totals row that are not future or applicant rows."""
    future = F.lower("status").isin(FUTURE_STATUS) | F.lower("record_type").isin(FUTURE_STATUS)
    return rows.filter((F.col("section") == "current") & ~F.col("after_total") & ~F.coalesce(future, F.lit(False)))


def carry_parent_unit(rows: DataFrame) -> DataFrame:
    """Rows without a unit but with a charge belong to the unit above; with no unit above, ORPHAN_CONTINUATION."""
    has_detail = F.col("charge").isNotNull() | F.col("amount").isNotNull()
    continuation = F.col("unit_id").isNull() & has_detail
    out = carry_forward(rows, SHEET, "row", F.col("unit_id"), "parent_unit")
    out = out.withColumn("is_continuation", continuation)
    orphan = continuation & F.col("parent_unit").isNull()
    return out.withColumn("error_code", F.when(orphan, F.lit("ORPHAN_CONTINUATION")))


def unit_rows(rows: DataFrame, layout: str = "standard") -> DataFrame:
    """Unit rows with recognised status and use and the first failing rule.

    A continuation (record type charge or co-tenant) may leave its status or type blank; it then takes the unit's."""
    status, use = status_token(F.col("status"), layout), use_token(F.col("unit_type"))
    continues = F.coalesce(F.lower(F.trim("record_type")).isin(CONTINUATIONS), F.lit(False))
    units = rows.filter(F.col("unit_id").isNotNull()).withColumns(
        {"unit_status": status, "unit_use": use, "is_extra": continues}
    )

    def unreadable(token: str, text: str) -> Column:
        blank = F.length(F.trim(F.coalesce(F.col(text), F.lit("")))) == 0
        return F.col(token).isNull() & ~(F.col("is_extra") & blank)

    error = first_failure(
        (~valid_unit_id(F.col("unit_id")), "INVALID_UNIT_ID"),
        (unreadable("unit_status", "status"), "UNSUPPORTED_STATUS"),
        (unreadable("unit_use", "unit_type"), "UNSUPPORTED_UNIT_TYPE"),
    )
    return units.withColumn("error_code", error)


def _without_orphans(units: DataFrame) -> DataFrame:
    """Continuations with no full row of their unit above them are refused. Only units with continuations are looked up."""
    key = ["source_id", "unit_id"]
    full = units.filter(F.col("error_code").isNull() & ~F.col("is_extra"))
    extra = units.filter("is_extra").select(*key).distinct()
    first = full.join(extra, key, "left_semi").groupBy(*key).agg(F.min(F.struct("sheet", "row")).alias("first_full"))
    joined = units.join(first, key, "left")
    early = F.col("first_full").isNull() | (F.struct("sheet", "row") < F.col("first_full"))
    orphan = F.col("is_extra") & F.col("error_code").isNull() & early
    code = F.when(orphan, "ORPHAN_CONTINUATION").otherwise(F.col("error_code"))
    return joined.withColumn("error_code", code).drop("first_full")


def _merged(units: DataFrame) -> DataFrame:
    """Facts of each (source, unit) from its good rows, and what was skipped. Combines before the shuffle."""
    fine = F.col("error_code").isNull()

    def of(fn, column: str) -> Column:
        return fn(F.when(fine, F.col(column)))

    merged = units.groupBy("source_id", "unit_id").agg(
        F.coalesce(of(F.min, "row"), F.min("row")).alias("first_row"),
        F.count_if(fine).alias("evidence_rows"),
        F.count_if(~fine).alias("skipped_rows"),
        of(F.max, "unit_status").alias("status"),
        of(F.max, "unit_use").alias("unit_use"),
        ((of(F.min, "unit_status") != of(F.max, "unit_status")) | (of(F.min, "unit_use") != of(F.max, "unit_use"))).alias("differ"),
        F.max("error_code").alias("row_error"),
    )
    conflict = F.coalesce("differ", F.lit(False))
    error = F.when(conflict, "DUPLICATE_UNIT_CONFLICT").when(F.col("evidence_rows") == 0, F.col("row_error"))
    return merged.select(
        "source_id",
        "unit_id",
        "first_row",
        "evidence_rows",
        "skipped_rows",
        F.when(~conflict, F.col("status")).alias("status"),
        F.when(~conflict, F.col("unit_use")).alias("unit_use"),
        error.alias("error_code"),
    )


def unit_dedupe(units: DataFrame) -> DataFrame:
    """One row per (source, unit): equal facts add evidence, different status or use is a conflict with NULL facts.

    Rows that are refused themselves are counted as skipped and leave the unit's good rows standing; a unit without a
    good row has the code of its rows. Once two good rows differ, no row of the unit counts. ``units`` come from
    ``unit_rows``; without its columns ``sheet`` and ``is_extra`` all rows are taken as full ones."""
    return _merged(_without_orphans(units) if {"is_extra", "sheet"} <= set(units.columns) else units)


def unit_evidence(units: DataFrame, n: int = EVIDENCE_ROWS) -> DataFrame:
    """``unit_dedupe`` with the first ``n`` good rows (sheet, row) and refused rows (sheet, row, code) of each unit, in sheet
    order, each list with a flag that tells whether more existed."""
    key, order = ["source_id", "unit_id"], ["sheet", "row"]
    judged = _without_orphans(units)
    good = capped_list(judged.filter("error_code is null"), key, order, F.struct(*order), n, "evidence")
    refused = capped_list(judged.filter("error_code is not null"), key, order, F.struct(*order, "error_code"), n, "issues")
    return _merged(judged).join(good, key, "left").join(refused, key, "left")


def unit_counts(units: DataFrame) -> DataFrame:
    """Occupied, vacant, down and total per (source, use) and per source (use ``unknown`` = all units).

    Counts of a scope are NULL while any of its units has no recognised status, or a source holds a refused unit or row."""
    status = F.col("status")
    skipped = F.col("skipped_rows") > 0 if "skipped_rows" in units.columns else F.lit(False)
    known = units.withColumn("bad", status.isNull() | F.col("error_code").isNotNull() | skipped)
    # One row per (source, use) first, so the two groupings below never see raw units twice.
    by_use = known.groupBy("source_id", "unit_use").agg(
        *[F.count_if(status == s).alias(s) for s in ("occupied", "vacant", "down")],
        F.count("*").alias("total"),
        F.bool_or("bad").alias("bad"),
    )
    flagged = by_use.groupBy("source_id").agg(
        *[F.sum(c).alias(c) for c in ("occupied", "vacant", "down", "total")], F.bool_or("bad").alias("bad")
    )
    scoped = (
        by_use.filter(F.col("unit_use").isNotNull())
        .drop("bad")
        .join(flagged.select("source_id", "bad"), "source_id")
        .unionByName(flagged.withColumn("unit_use", F.lit("unknown")))
    )
    return scoped.select(
        "source_id",
        F.col("unit_use").alias("scope"),
        *[F.when(~F.col("bad"), F.col(c)).alias(c) for c in ("occupied", "vacant", "down", "total")],
        F.when(F.col("bad"), "INVENTORY_INVALID").alias("error_code"),
    )


COUNTS = ["occupied", "vacant", "down", "total"]


def reconcile_summary(reported: DataFrame, derived: DataFrame) -> DataFrame:
    """Status of the reported counts per (source, scope): absent, invalid, unresolved, mismatch or reconciled.

    A reported scope for which nothing was derived stays in the result as ``unsupported``."""
    row = F.struct(*COUNTS)
    merged = reported.groupBy("source_id", "scope").agg(
        F.size(F.collect_set(row)).alias("variants"),
        F.count("*").alias("copies"),
        F.bool_or(sum((F.col(c).isNull().cast("int") for c in COUNTS), F.lit(0)) > 0).alias("incomplete"),
        F.min(row).alias("reported"),
    )
    joined = derived.withColumn("_derived", F.lit(True)).join(merged, ["source_id", "scope"], "full_outer")
    same = F.col("reported") == F.struct(*[F.col(c).cast("bigint") for c in COUNTS])
    status = (
        F.when(F.col("copies").isNull(), "absent")
        .when(F.col("_derived").isNull(), "unsupported")
        .when(F.col("incomplete") | (F.col("variants") > 1), "invalid")
        .when(F.col("total").isNull(), "unresolved")
        .when(same, "reconciled")
        .otherwise("mismatch")
    )
    code = (
        F.when(F.col("_derived").isNull(), "UNSUPPORTED_SUMMARY_SCOPE")
        .when(F.col("incomplete"), "INVALID_SUMMARY")
        .when(F.col("variants") > 1, "SUMMARY_CONFLICT")
        .when((status == "mismatch"), "SUMMARY_MISMATCH")
    )
    return joined.select(
        "source_id",
        "scope",
        *COUNTS,
        status.alias("summary_status"),
        code.alias("error_code"),
        F.when((F.col("copies") > 1) & (F.col("variants") == 1), "DUPLICATE_SUMMARY_EVIDENCE").alias("warning"),
    )


VENDOR_OCCUPIED = ["occupied_no_ntv", "occupied_ntv", "occupied_ntv_leased"]
VENDOR_VACANT = ["vacant_leased", "vacant_not_leased"]
VENDOR_LABELS = [*VENDOR_OCCUPIED, *VENDOR_VACANT, "admin_down", "totals"]


def vendor_summary(rows: DataFrame) -> DataFrame:
    """Vendor status rows (source_id, label, units) as counts. Admin/down is kept apart and never becomes down."""

    def of(labels: list[str]) -> Column:
        return F.sum(F.when(F.col("label").isin(labels), F.col("units")))

    wide = rows.groupBy("source_id").agg(
        of(VENDOR_OCCUPIED).alias("occupied"),
        of(VENDOR_VACANT).alias("vacant"),
        of(["admin_down"]).alias("admin_down"),
        of(["totals"]).alias("total"),
        F.count("*").alias("rows"),
        F.size(F.collect_set(F.when(F.col("label").isin(VENDOR_LABELS), F.col("label")))).alias("labels"),
        F.count_if(F.col("units").isNull() | (F.col("units") < 0)).alias("bad_values"),
    )
    n = len(VENDOR_LABELS)
    parts = F.col("occupied") + F.col("vacant") + F.col("admin_down")
    error = first_failure(
        (F.col("labels") < n, "INCOMPLETE_VENDOR_SUMMARY"),
        ((F.col("rows") != n) | (F.col("bad_values") > 0), "INVALID_VENDOR_SUMMARY"),
        (parts != F.col("total"), "SUMMARY_MISMATCH"),
    )
    shown = F.col("error_code").isNull() | (F.col("error_code") == "SUMMARY_MISMATCH")
    return wide.withColumn("error_code", error).select(
        "source_id",
        *[F.when(shown, F.col(c)).alias(c) for c in ("occupied", "vacant", "admin_down", "total")],
        F.lit(None).cast("bigint").alias("down"),
        "error_code",
    )


def completeness(units: DataFrame, coverage: DataFrame) -> DataFrame:
    """complete / partial / unknown enumeration per source. ``coverage(source_id, expected_units, citations)``: without
    citations nothing is established; the unit rows must add up to the cited count."""
    listed = units.groupBy("source_id").agg(
        F.count("*").alias("listed"), F.count_if(F.col("error_code").isNotNull()).alias("refused")
    )
    joined = listed.join(coverage, "source_id", "left")
    cited = F.coalesce(F.col("citations"), F.lit(0)) > 0
    state = (
        F.when(~cited | F.col("expected_units").isNull(), "unknown")
        .when((F.col("listed") == F.col("expected_units")) & (F.col("refused") == 0), "complete")
        .otherwise("partial")
    )
    bad = cited & (F.col("listed") > F.col("expected_units"))
    return joined.select(
        "source_id", "listed", "refused", state.alias("enumeration"), F.when(bad, "COUNTS_EXCEED_COVERAGE").alias("error_code")
    )


def unit_consistency(rows: DataFrame) -> DataFrame:
    """Per (source, unit): all recognised values of status and use over the relied-on rows must agree.

    ``rows`` hold (source_id, unit_id, unit_status, unit_use, supplemental); an unrecognised word on a supplemental
    row refuses, and a field with no recognised value stays open."""
    sets = rows.groupBy("source_id", "unit_id").agg(
        F.collect_set("unit_status").alias("statuses"),
        F.collect_set("unit_use").alias("uses"),
        F.bool_or(F.col("supplemental") & (F.col("unit_status").isNull() | F.col("unit_use").isNull())).alias("unsupported"),
    )
    error = first_failure(
        (F.col("unsupported"), "UNSUPPORTED_TOKEN"),
        ((F.size("statuses") > 1) | (F.size("uses") > 1), "INCONSISTENT_UNIT"),
        ((F.size("statuses") == 0) | (F.size("uses") == 0), "OPEN_FIELD"),
    )
    return sets.select(
        "source_id",
        "unit_id",
        F.when(error.isNull(), F.get("statuses", F.lit(0))).alias("status"),
        F.when(error.isNull(), F.get("uses", F.lit(0))).alias("unit_use"),
        error.alias("error_code"),
    )


def normalize_rent_roll(
    cells: DataFrame, layout: str = "standard", stage: Callable[[DataFrame], DataFrame] | None = None
) -> DataFrame:
    """Cells to deduplicated units: header, section, continuation, words, one row per unit.

    Carrying values down reads the sheet rows twice; ``stage=cut_lineage`` keeps the cells from being read twice."""
    rows = records(cells, header_row(cells))
    rows = section_state(stage(rows) if stage else rows)
    return unit_dedupe(unit_rows(current_rows(rows), layout))


def get_rent_roll(units: DataFrame, snapshots_as_of: str | None = None, status: str | None = None) -> DataFrame:
    """Cohort or status slice; with a date, the newest roll of each source at or before it. People never appear."""
    out = drop_pii(units)
    if snapshots_as_of is not None:
        dated = out.filter(F.col("as_of_date") <= F.to_date(F.lit(snapshots_as_of)))
        newest = dated.groupBy("source_id").agg(F.max("as_of_date").alias("as_of_date"))
        out = dated.join(newest, ["source_id", "as_of_date"], "left_semi")
    return out if status is None else out.filter(F.col("status") == status)
