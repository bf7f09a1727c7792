"""The review fed by the tables as they are read, and rows that break the ledger contract."""

import pytest
from pyspark.sql import functions as F

from rentloom import schemas
from rentloom.plans import review as plan
from rentloom.sources import tables

LEDGER = "id string, property_id string, period string, kind string, account_code string, account_name string, category string, amount decimal(18,2), source_file string, source_row int, created_at string"


def line(i, **changed):
    row = dict(id=f"r{i}", property_id="p1", period="2026-01", kind="actual", account_code="4000", account_name="Rent", category="Rental Income", amount=10, source_file="f", source_row=i, created_at="2026-02-01")
    return tuple({**row, **changed}.values())


def summary(spark, rows, **kw):
    from decimal import Decimal

    rows = [tuple(Decimal(x) if i == 7 and x is not None else x for i, x in enumerate(r)) for r in rows]
    gl = spark.createDataFrame(rows, LEDGER)
    properties = spark.createDataFrame([("p1", "One", 100)], "id string, name string, unit_count int")
    snapshots = spark.createDataFrame([], "id string, property_id string, as_of_date date, occupied int, vacant int, down int, source_file string, source_row int, created_at string")
    mappings = spark.createDataFrame([], schemas.MAPPINGS)
    out = plan.summary_table(gl, properties, snapshots, mappings, check_rows=True, **kw).collect()
    return {(r.property_id, r.period): r for r in out}


GOOD = [line(1), line(2, kind="budget", amount=7)]
FAULTS = [
    {"account_code": ""}, {"account_code": "x" * 65}, {"account_name": None}, {"account_name": ""}, {"category": "y" * 129},
    {"source_file": ""}, {"source_row": -1}, {"source_row": None}, {"created_at": None}, {"id": ""}, {"kind": "forecast"},
]


def test_a_whole_month_is_reviewed(spark):
    r = summary(spark, GOOD)["p1", "2026-01"]
    assert r.refused_rows == 0 and "INVALID_CONTRACT" not in r.blockers and r.actual_noi == 10 and r.noi_variance == 3


def test_each_fault_refuses_its_month_only(spark):
    rows = []
    for n, fault in enumerate(FAULTS):
        period = f"20{30 + n}-01"
        rows += [line(1, period=period), line(2, period=period, kind="budget", amount=7), line(3, **{"period": period, **fault})]
    got = summary(spark, rows + GOOD)
    for n, fault in enumerate(FAULTS):
        r = got["p1", f"20{30 + n}-01"]
        assert r.refused_rows == 1 and r.blockers[0] == "INVALID_CONTRACT" and r.status == "blocked", fault
        assert r.actual_noi is None and r.budget_noi is None and r.material_variances is None
    assert got["p1", "2026-01"].actual_noi == 10


def test_a_bad_copy_of_a_kept_row_still_refuses(spark):
    rows = [*GOOD, line(1, id="late", created_at="2026-03-01", category="")]
    r = summary(spark, rows)["p1", "2026-01"]
    assert r.refused_rows == 1 and r.duplicate_rows == 1 and r.actual_noi is None


def test_rows_without_scope_and_missing_amounts(spark):
    got = summary(spark, [*GOOD, line(3, property_id=None), line(4, period="2026-13"), line(5, period=None)])
    assert got["p1", "2026-01"].refused_rows == 0
    assert {k for k, r in got.items() if r.refused_rows} == {(None, "2026-01"), ("p1", "2026-13"), ("p1", None)}
    r = summary(spark, [*GOOD, line(3, amount=None)])["p1", "2026-01"]
    assert r.refused_rows == 0 and "INVALID_AMOUNT" in r.blockers and "INVALID_CONTRACT" not in r.blockers


def test_asked_month_without_rows_is_not_refused(spark):
    asked = spark.createDataFrame([("p1", "2026-01"), ("p1", "2026-02")], "property_id string, period string")
    got = summary(spark, GOOD, requests=asked)
    assert got["p1", "2026-02"].refused_rows == 0 and "MISSING_ACTUALS" in got["p1", "2026-02"].blockers


@pytest.mark.parametrize("text, day", [("2026-01-31", "2026-01-31"), ("2026-1-31", None), ("2026-02-30", None), ("", None), (None, None)])
def test_snapshot_dates_are_days_or_null(spark, text, day):
    read = {n: spark.createDataFrame([], schemas.contract(ddl)) for n, ddl in tables.OPS_TABLES.items()}
    read["rent_roll_snapshots"] = spark.createDataFrame([("s", "p1", text, 8, 1, 1, "f", 1, "2026")], schemas.SNAPSHOTS)
    _, _, snapshots, _ = tables.review_inputs(read)
    row = snapshots.withColumn("as_of_date", F.col("as_of_date").cast("string")).collect()[0]
    assert row.as_of_date == day and (row.occupied, row.vacant, row.down) == (8, 1, 1)
