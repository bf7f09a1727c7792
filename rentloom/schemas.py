"""Contracts of the input tables. Schemas are always given, never inferred."""

from __future__ import annotations

from pyspark.sql import types as T


def contract(ddl: str) -> T.StructType:
    """StructType from ``name type, …`` with all columns nullable."""
    return T._parse_datatype_string(ddl)


PROPERTIES = "id string, name string, market string, unit_count int"
PERIODS = "id string, year int, month int, label string"
GL = (
    "id string, property_id string, period_id string, account_code string, account_name string, category string, "
    "amount double, source_file string, source_row int, created_at string"
)
SNAPSHOTS = (
    "id string, property_id string, as_of_date string, occupied_units int, vacant_units int, down_units int, "
    "source_file string, source_row int, created_at string"
)
MAPPINGS = "account_code string, account_name string, noi_category string, status string, property_scope string, source_system string"
REVISIONS = "id string, property string, period string, revision int, unit_count int, created_at string, input_sha256 string"
EXACT_GL = "revision_id string, kind string, ordinal int, account_code string, account_name string, category string, amount_cents bigint"
EXACT_SNAPSHOTS = "revision_id string, as_of_date string, occupied_units int, vacant_units int, down_units int"
RENT_ROLL_CSV = (
    "unit_id string, floorplan_code string, bed_type string, bath_count string, sqft string, market_rent string, "
    "lease_rent string, status string, as_of_date string"
)
BUDGET_COMPARISON_CSV = "property_id string, period string, account_code string, account_name string, ptd_actual string"
MAPPINGS_CSV = "account_code string, account_name string, noi_category string, status string"
CELLS = "source_id string, sheet int, row int, column int, text string"
OPENING = (
    "sequence bigint, source_property_id string, source_record_id string, revision string, period string, "
    "account string, unit_category string, amount string, deleted boolean"
)
ASSERTIONS = (
    "workspace_id string, aggregate_id string, key string, value decimal(18,2), valid_from date, valid_to date, "
    "recorded_at timestamp, event_id bigint, source_system string, source_record string, source_revision int, "
    "supersedes_event_id bigint"
)
SNAPSHOT_STREAM = "property_id string, as_of_date date, occupied int, vacant int, down int"
JOURNAL = "run_id string, n bigint, kind string, stage string, decision_id string, field string, value string"
