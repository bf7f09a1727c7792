"""Trailing-twelve statements over a cell grid: column roles, row kinds, months, money and issues for every source.

``cells``: source_id, row, column, text. ``statements``: one row per source with header_row, label_column,
first_month, last_month. Nothing is ever summed here; amounts stay single observations.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rentloom.functions.hashing import canonical_json
from rentloom.functions.money import parse_money
from rentloom.functions.period import month_range
from rentloom.functions.refusal import first_failure
from rentloom.functions.tokens import column_role, row_kind

# The canonical accounts a label may be mapped to.
CANONICAL_ACCOUNTS = [
    "residential_rental_income", "commercial_rental_income", "other_income", "ancillary_income_recurring",
    "ancillary_income_transactional", "property_taxes", "property_insurance", "employee_benefits", "payroll",
    "utilities", "repairs_and_maintenance", "marketing", "administrative", "management_fees", "legal_professional",
    "turnover",
]


def validate_mapping(mapping: DataFrame) -> DataFrame:
    """Mapping rows with ``error_code``: blank or repeated labels and unknown accounts refuse."""
    repeats = mapping.groupBy("source_label").agg(F.count("*").alias("copies"))
    error = first_failure(
        (F.trim("source_label") == "", "INVALID_MAPPING"),
        (F.col("copies") > 1, "INVALID_MAPPING"),
        (~F.coalesce(F.col("canonical_account").isin(CANONICAL_ACCOUNTS), F.lit(False)), "INVALID_MAPPING"),
    )
    return mapping.join(repeats, "source_label").withColumn("error_code", error).drop("copies")


def column_roles(cells: DataFrame, statements: DataFrame, overrides: DataFrame | None = None) -> DataFrame:
    """Role and month of every column of every source. ``overrides(source_id, column, role)`` may mark a column as
    descriptor or excluded."""
    at = cells.join(statements, "source_id")
    columns = at.groupBy(
        "source_id", "column", "label_column", "first_month", "last_month"
    ).agg(
        F.max(F.when(F.col("row") == F.col("header_row"), F.col("text"))).alias("header"),
        F.count_if((F.col("row") > F.col("header_row")) & F.col("text").isNotNull()).alias("data_cells"),
    )
    if overrides is None:
        columns = columns.withColumn("override", F.lit(None).cast("string"))
    else:
        columns = columns.join(
            overrides.select("source_id", "column", F.col("role").alias("override")), ["source_id", "column"], "left"
        )
    role = column_role(
        F.col("header"),
        F.col("column") == F.col("label_column"),
        F.col("first_month"),
        F.col("last_month"),
        F.col("override"),
        F.col("data_cells") > 0,
    )
    return columns.select(
        "source_id",
        "column",
        F.trim("header").alias("header"),
        role["role"].alias("role"),
        role["month"].alias("month"),
        (F.col("data_cells") > 0).alias("has_data"),
        role["error_code"].alias("error_code"),
    )


def month_coverage(columns: DataFrame, statements: DataFrame) -> DataFrame:
    """Expected, present and missing months per source; complete only with twelve months and none missing.

    Also the source-level refusals: a column refusal, a month twice, no month column, no data under any month."""
    found = columns.groupBy("source_id").agg(
        F.array_sort(F.collect_set("month")).alias("present_months"),
        F.count("month").alias("month_columns"),
        F.bool_or(F.col("month").isNotNull() & F.col("has_data")).alias("any_data"),
        F.min("error_code").alias("column_error"),
    )
    expected = month_range(F.col("first_month"), F.col("last_month"))
    joined = statements.join(found, "source_id", "left").withColumn("expected_months", expected)
    missing = F.array_except("expected_months", "present_months")
    error = first_failure(
        (F.col("expected_months").isNull(), "INVALID_WINDOW"),
        (F.col("column_error").isNotNull() & (F.col("column_error") == "EXCLUDED_MONTH_COLUMN"), "EXCLUDED_MONTH_COLUMN"),
        (F.col("column_error").isNotNull(), "MONTH_OUTSIDE_WINDOW"),
        (F.col("month_columns") > F.size("present_months"), "DUPLICATE_MONTH"),
        (F.coalesce(F.col("month_columns"), F.lit(0)) == 0, "NO_MONTH_COLUMNS"),
        (~F.coalesce(F.col("any_data"), F.lit(False)), "EMPTY_STATEMENT"),
    )
    complete = (F.size(missing) == 0) & (F.size("present_months") == 12)
    return joined.select(
        "source_id",
        "expected_months",
        "present_months",
        missing.alias("missing_months"),
        F.when(complete, "complete").otherwise("partial").alias("coverage"),
        error.alias("error_code"),
    )


LABEL_PARTS = 16


def mapping_entries(mapping: DataFrame) -> DataFrame:
    """(source_id, source_label, canonical_account, mapping_ref, error_code): one row per scope and label.

    ``mapping`` may name a ``source_id``; NULL, or no such column, is for every statement. A label given twice in one scope
    is refused, whatever it says, so it never multiplies rows; blank labels and accounts are refused too."""
    scope = F.col("source_id") if "source_id" in mapping.columns else F.lit(None).cast("string")
    named = mapping.select(scope.alias("source_id"), "source_label", "canonical_account", "mapping_ref")
    once = named.groupBy("source_id", "source_label").agg(
        F.count("*").alias("copies"),
        F.min("canonical_account").alias("canonical_account"),
        F.min("mapping_ref").alias("mapping_ref"),
    )
    blank = lambda c: F.length(F.trim(F.coalesce(F.col(c), F.lit("")))) == 0
    bad = (F.col("copies") > 1) | blank("source_label") | blank("canonical_account")
    return once.select(
        "source_id",
        "source_label",
        *(F.when(~bad, F.col(c)).alias(c) for c in ("canonical_account", "mapping_ref")),
        F.when(bad, "INVALID_MAPPING").alias("error_code"),
    )


def map_labels(rows: DataFrame, mapping: DataFrame) -> DataFrame:
    """Rows (source_id, source_label, …) with canonical_account, mapping_ref and mapping_error.

    The entry of the row's own statement stands before the one for all; labels match by exact text. A refused entry maps
    nothing and gives its code, and a refused own entry is not replaced by the one for all. Labels that every statement
    has are dealt to ``LABEL_PARTS`` parts, each of which has the entries for all; row counts never change."""
    entries = mapping_entries(mapping).filter("source_label is not null")
    own = entries.filter("source_id is not null")
    own = own.select("source_id", "source_label", F.struct("canonical_account", "mapping_ref", "error_code").alias("_own"))
    shared = entries.filter("source_id is null")
    shared = shared.select("source_label", F.struct("canonical_account", "mapping_ref", "error_code").alias("_all"))
    shared = shared.withColumn("_part", F.explode(F.sequence(F.lit(0), F.lit(LABEL_PARTS - 1))))
    part = F.pmod(F.xxhash64("source_id", "source_label"), F.lit(LABEL_PARTS)).cast("int")
    out = rows.join(own, ["source_id", "source_label"], "left").withColumn("_part", part)
    out = out.join(shared, ["source_label", "_part"], "left").withColumn("_m", F.coalesce("_own", "_all"))
    named = {"canonical_account": "canonical_account", "mapping_ref": "mapping_ref", "mapping_error": "error_code"}
    return out.select(*rows.columns, *(F.col(f"_m.{c}").alias(name) for name, c in named.items()))


def statement_rows(cells: DataFrame, statements: DataFrame, columns: DataFrame, mapping: DataFrame) -> DataFrame:
    """One row per statement row: label, kind, mapping, and its month cells as an array of parsed amounts.

    The label joins its mapping by exact text, without case folding (see ``map_labels``). Every month column of the source yields a cell;
    an absent or blank one is an unknown amount, not zero."""
    top = statements.select("source_id", "header_row", "label_column")
    months = columns.filter(F.col("month").isNotNull()).select("source_id", "column", "month")
    per_source = months.groupBy("source_id").agg(F.array_sort(F.collect_set("month")).alias("months"))
    body = cells.join(top, "source_id").filter(F.col("row") > F.col("header_row"))
    tagged = body.join(months, ["source_id", "column"], "left")
    rows = tagged.groupBy("source_id", "row").agg(
        F.max(F.when(F.col("column") == F.col("label_column"), F.col("text"))).alias("raw_label"),
        F.sort_array(
            F.collect_list(
                F.when(F.col("month").isNotNull() & F.col("text").isNotNull(), F.struct("month", "text"))
            )
        ).alias("texts"),
    )
    label = F.when(F.trim("raw_label") != "", F.col("raw_label"))
    rows = rows.join(per_source, "source_id").withColumn("source_label", label)
    rows = map_labels(rows, mapping)
    kind = row_kind(F.col("source_label"), F.size("texts") > 0, F.col("canonical_account").isNotNull())
    # A month that heads two columns refuses its source in ``month_coverage``; here its first cell is shown.
    cell = lambda m: F.get(F.filter("texts", lambda t: t["month"] == m), F.lit(0))["text"]
    amounts = F.transform(
        F.transform("months", lambda m: F.struct(m.alias("month"), cell(m).alias("text"))),
        lambda c: F.struct(
            c["month"].alias("month"), c["text"].alias("source_text"), parse_money(c["text"]).alias("money")
        ),
    )
    out = rows.withColumn("row_kind", kind)
    valued = F.col("row_kind").isin("line_item", "total", "unlabeled")
    is_line = F.col("row_kind") == "line_item"
    state = (
        F.when(~valued | (F.col("row_kind") == "total"), "not_applicable")
        .when(is_line & F.col("canonical_account").isNotNull(), "mapped")
        .otherwise("unmapped")
    )
    return out.select(
        "source_id",
        "row",
        "row_kind",
        "source_label",
        F.when(state == "mapped", F.col("canonical_account")).alias("canonical_account"),
        state.alias("mapping_state"),
        F.when(state == "mapped", F.col("mapping_ref")).alias("mapping_ref"),
        F.when(valued, amounts).otherwise(F.array()).alias("monthly"),
    )


def t12_cells(rows: DataFrame) -> DataFrame:
    """Long form: one row per (source, statement row, month) with amount or reason."""
    return rows.select("source_id", "row", "row_kind", "canonical_account", F.explode("monthly").alias("m")).select(
        "source_id",
        "row",
        "row_kind",
        "canonical_account",
        "m.month",
        "m.source_text",
        F.col("m.money.amount").alias("amount"),
        F.col("m.money.error_code").alias("error_code"),
    )


def row_census(rows: DataFrame) -> DataFrame:
    """Row counts by kind per source."""
    kinds = ["blank", "section", "line_item", "total", "unlabeled"]
    return rows.groupBy("source_id").agg(*[F.count_if(F.col("row_kind") == k).alias(k) for k in kinds])


def statement_issues(rows: DataFrame, columns: DataFrame, coverage: DataFrame) -> DataFrame:
    """All issues of every source, one per row: code, severity, row and column, number of observations, stable id."""
    unknown = F.size(F.filter("monthly", lambda m: m["money"]["error_code"] == "UNKNOWN_AMOUNT_NOT_ZERO"))
    material = F.exists("monthly", lambda m: m["money"]["amount"] != 0)
    n = F.size("monthly")
    per_row = F.array_compact(
        F.array(
            F.when(
                (F.col("row_kind") == "line_item") & (F.col("mapping_state") == "unmapped"),
                F.struct(
                    F.lit("UNMAPPED_ACCOUNT").alias("code"),
                    F.when(material, "blocker").otherwise("warning").alias("severity"),
                    n.alias("observations"),
                ),
            ),
            F.when(
                F.col("row_kind") == "unlabeled",
                F.struct(
                    F.lit("UNLABELED_ROW").alias("code"), F.lit("blocker").alias("severity"), n.alias("observations")
                ),
            ),
            F.when(
                unknown > 0,
                F.struct(
                    F.lit("MISSING_MONTH_CELL").alias("code"),
                    F.lit("blocker").alias("severity"),
                    unknown.alias("observations"),
                ),
            ),
        )
    )
    no_int = F.lit(None).cast("int")
    row_issues = rows.select(
        "source_id", F.col("row").cast("int").alias("row"), no_int.alias("column"), F.inline(per_row)
    )
    column_issues = columns.filter("role = 'unrecognized'").select(
        "source_id",
        no_int.alias("row"),
        F.col("column").cast("int").alias("column"),
        F.lit("UNRECOGNIZED_COLUMN").alias("code"),
        F.when(F.col("has_data"), "blocker").otherwise("warning").alias("severity"),
        F.lit(0).alias("observations"),
    )
    partial = coverage.filter("coverage = 'partial'").select(
        "source_id",
        no_int.alias("row"),
        no_int.alias("column"),
        F.lit("PARTIAL_MONTH_COVERAGE").alias("code"),
        F.lit("blocker").alias("severity"),
        F.lit(0).alias("observations"),
    )
    out = row_issues.unionByName(column_issues).unionByName(partial)
    locator = canonical_json(code=F.col("code"), source_id=F.col("source_id"), row=F.col("row"), column=F.col("column"))
    return out.withColumn("issue_id", F.concat(F.lit("iss_"), F.substring(F.sha2(locator, 256), 1, 32)))


def t12_status(issues: DataFrame, coverage: DataFrame) -> DataFrame:
    """refused / blocked / observed_unvalidated per source."""
    blocked = issues.groupBy("source_id").agg(
        F.bool_or(F.col("severity") == "blocker").alias("blocked"), F.count("*").alias("issues")
    )
    return coverage.join(blocked, "source_id", "left").select(
        "source_id",
        "coverage",
        F.coalesce("issues", F.lit(0)).alias("issues"),
        F.when(F.col("error_code").isNotNull(), "refused")
        .when(F.col("blocked"), "blocked")
        .otherwise("observed_unvalidated")
        .alias("status"),
        "error_code",
    )
