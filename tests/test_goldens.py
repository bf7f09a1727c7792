"""Small goldens: the review, deals, income, ledger and intake on inputs with known answers."""

import json
from datetime import date, datetime
from decimal import Decimal

from pyspark.sql import functions as F

from rentloom.functions import metrics
from rentloom.operators import deals, governance, income, ledger, occupancy, ops, rentroll, statements
from rentloom.plans import review as plan

GL = "property_id string, period string, kind string, account_code string, account_name string, category string, amount decimal(18,2), source_file string, source_row int, created_at string, id string"


def gl_rows(spark, rows):
    full = [("p1", "2026-04", k, c, n, g, Decimal(a), f"{k}.csv", r, "2026-05-01", f"{k}{c}") for k, c, n, g, a, r in rows]
    return spark.createDataFrame(full, GL)


CLEAN = [
    ("actual", "4000", "Rent", "rental income", "5000.00", 2),
    ("actual", "6100", "R&M", "repairs & maintenance", "1200.50", 3),
    ("budget", "4000", "Rent", "rental income", "4400.00", 2),
    ("budget", "6100", "R&M", "repairs & maintenance", "1100.00", 3),
]


def dims(spark):
    props = spark.createDataFrame([("p1", "P One", 10)], "id string, name string, unit_count int")
    snaps = spark.createDataFrame(
        [
            ("p1", date(2026, 3, 31), 7, 2, 1, "2026-04-01", "s1", "roll.csv", 1),
            ("p1", date(2026, 4, 30), 8, 1, 1, "2026-05-01", "s2", "roll.csv", 1),
        ],
        "property_id string, as_of_date date, occupied int, vacant int, down int, created_at string, id string, source_file string, source_row int",
    )
    maps = spark.createDataFrame(
        [("4000", "Rent", "rental income", "approved", "*"), ("6100", "R&M", "repairs & maintenance", "approved", None)],
        "account_code string, account_name string, noi_category string, status string, property_scope string",
    )
    return props, snaps, maps


def test_review_clean_month(spark):
    s = plan.summary_table(gl_rows(spark, CLEAN), *dims(spark), ops.Materiality("500.00")).collect()[0]
    assert s.status == "reviewed" and s.mismatch_status == "match" and s.material_variances == 1
    assert (s.actual_noi, s.noi_variance) == (Decimal("3799.50"), Decimal("499.50"))
    assert s.mapping_exceptions == 0


def test_review_exceptions_and_refusals(spark):
    rows = [*CLEAN[:3], ("actual", "9999", "Odd", "other", "0.00", 9)]
    twice = gl_rows(spark, rows).union(gl_rows(spark, rows[:1]).withColumn("id", F.lit("zz")))
    props, snaps, maps = dims(spark)
    r = plan.review(twice, props.withColumn("unit_count", F.lit(12)), snaps, maps, ops.Materiality("500.00"))
    found = {(x.code, x.severity) for x in plan.exceptions(r).collect()}
    assert found == {
        ("MISSING_BUDGET", "blocker"),
        ("DUPLICATE_GL_IMPORT", "material"),
        ("MATERIAL_VARIANCE", "material"),
        ("UNREVIEWED_ACCOUNT_MAPPING", "material"),
        ("FEED_FRESHNESS_UNKNOWN", "flag"),
        ("OCCUPANCY_COUNT_MISMATCH", "blocker"),
    }
    gap = [x for x in plan.exceptions(r).collect() if x.code == "MISSING_BUDGET"][0]
    assert gap.details["accounts"] == "6100,9999"
    assert [e.artifact for e in gap.evidence] == ["actual.csv", "actual.csv"]
    status = plan.review_status(plan.exceptions(r)).collect()[0]
    assert status.status == "blocked" and status.blockers == ["MISSING_BUDGET", "OCCUPANCY_COUNT_MISMATCH"]


def test_explicit_zero_budget_is_a_budget(spark):
    rows = [CLEAN[0], ("budget", "4000", "Rent", "rental income", "0.00", 2)]
    roll = ops.actual_budget_coverage(ops.account_rollup(ops.dedupe_gl(gl_rows(spark, rows))))
    assert [r.coverage for r in roll.collect()] == ["covered"]


def test_bridge_of_two_accounts(spark):
    rows = [
        ("actual", "1", "R", "rental income", "192950", 1), ("actual", "2", "E", "payroll", "146200", 2),
        ("budget", "1", "R", "rental income", "220900", 1), ("budget", "2", "E", "payroll", "132300", 2),
    ]
    b = ops.noi_bridge(ops.account_variance(ops.account_rollup(ops.dedupe_gl(gl_rows(spark, rows))))).collect()[0]
    assert (b.actual_noi, b.budget_noi, b.noi_variance) == (Decimal(46750), Decimal(88600), Decimal(-41850))


def test_occupancy_change(spark):
    last = occupancy.occupancy_change(dims(spark)[1]).orderBy("as_of_date").collect()
    assert last[0].error_code == "OCCUPANCY_CHANGE_UNKNOWN"
    assert [last[1][f"{c}_change"] for c in ("occupied", "vacant", "down", "denominator")] == [1, -1, 0, 0]


def test_t12_repairs_collapse(spark):
    months = [f"2025-{m:02d}" for m in range(6, 13)] + [f"2026-{m:02d}" for m in range(1, 6)]
    rows = [
        ("p1", m, "actual", "52100", "Plumbing Repairs", "Repairs & Maintenance", Decimal(100), "bc.csv", 10, "c", f"{m}{x}")
        for m in months
        for x in "ab"
    ]
    got = ops.t12_category_sum(spark.createDataFrame(rows, GL), "Repairs & Maintenance").collect()[0]
    assert (got.value, got.account_codes, got.window_start, got.as_of) == (Decimal(1200), ["52100"], "2025-06", "2026-05")
    none = ops.t12_category_sum(spark.createDataFrame(rows, GL), "Payroll").collect()[0]
    assert none.value is None and none.error_code == "NOT_FOUND"


def test_reasonability_golden(spark):
    body = {"strike": "3902842", "units": 408, "price_per_unit": "9566", "going_in_cap": "0.3067", "exit_cap": "0.0725", "dscr": {"minimum": "4.82"}, "year1_noi": "915293"}
    df = spark.createDataFrame([(1, json.dumps(body))], "deal_id int, result_json string")
    got = deals.present_results(df).collect()[0]
    assert [b.field for b in got.breaches] == ["going_in_cap", "price_per_unit"]
    assert got.present_as_bid is False and got.bid is None


def test_thesis_needs_capex(spark):
    rows = [(1, "1000", "75", "0"), (2, "1000", "75", None), (3, "0", "75", "0")]
    df = spark.createDataFrame(rows, "deal_id int, p string, n string, c string").select(
        "deal_id",
        F.col("p").cast("decimal(18,2)").alias("purchase_price"),
        F.col("n").cast("decimal(18,2)").alias("year_2_noi"),
        F.col("c").cast("decimal(18,2)").alias("capex"),
        F.lit(True).alias("present_as_bid"),
    )
    got = deals.record_thesis(df).orderBy("deal_id").collect()
    assert got[0].yield_on_cost == Decimal("0.075") and got[0].in_band
    assert [g.error_code for g in got] == [None, "IMPLICIT_ZERO_FORBIDDEN", "IMPLICIT_ZERO_FORBIDDEN"]


def income_case(spark, termination="0.50", rent_off=0):
    def months(*parts):
        return [Decimal(v) for n, v in parts for _ in range(n)]

    lines = [
        ("water", "utility_reimbursement", "booked_gl", months((12, 9000)), Decimal("0.90"), Decimal(132000), "included_in_t12_opex"),
        ("termination", "turnover_fee", "booked_gl", months((10, 8000), (1, 0), (1, 16000)), Decimal(termination), Decimal(0), None),
        ("cleaning", "turnover_fee", "booked_gl", months((12, 3000)), Decimal("0.60"), Decimal(0), None),
        ("admin", "leasing_fee", "booked_gl", months((12, 1200)), Decimal("0.70"), Decimal(0), None),
        ("bad_debt", "bad_debt", "booked_gl", months((12, -4000)), Decimal("1.00"), Decimal(0), None),
    ]
    case = dict(
        case_id="garden", units=160, occupied=144, vacant=16, down=0, recent_moveins=72, period_end="2026-08",
        prior_period_end="2026-07", net_rent_monthly=months((9, 160000), (3, 155000)),
        tax_monthly=months((3, 20000), (1, -20000), (8, 20000)), reported_net_rent=Decimal(1905000 + rent_off),
        reported_other_income=Decimal(206400), reported_noi=Decimal(1011400), tax=Decimal(200000), insurance=Decimal(100000),
        operating_expenses=Decimal(1100000), arrears_writeoffs=Decimal(12000), upfront_concessions=Decimal(14000),
        other_income=lines, occupied_base_rent_monthly=Decimal(150000), house_tax=Decimal(240000),
        tax_status="interim_assumption", tax_source=None, house_insurance=Decimal(112000), reserve_per_unit=Decimal(1000),
        concession_floor=Decimal(18000),
    )
    types = {str: "string", int: "int", Decimal: "decimal(18,2)", type(None): "string"}
    ddl = ", ".join(
        f"{k} " + (f"array<{income.LINE}>" if k == "other_income" else "array<decimal(18,2)>" if isinstance(v, list) else types[type(v)])
        for k, v in case.items()
    )
    return spark.createDataFrame([tuple(case.values())], ddl)


def test_income_bridge_golden(spark):
    b = income.income_bridge(income_case(spark)).collect()[0]
    want = dict(
        net_rent="1905000.00", other_income="206400.00", credited_other_income="128880.00", paired_expense="132000.00",
        concession_topup="4000.00", t12_noi="1011400.00", base_noi="877880.00", base_after_reserve="717880.00",
        spot_noi="746880.00", stress_noi="832880.00",
    )
    assert {k: str(b[k]) for k in want} == want
    assert b.shared_months == 11 and str(b.movein_share) == "0.50" and len(b.blockers) == 3 and b.error_code is None
    less = income.income_bridge(income_case(spark, "0.25")).collect()[0]
    assert b.base_noi - less.base_noi == 24000
    bad = income.income_bridge(income_case(spark, rent_off=1)).collect()[0]
    assert bad.error_code == "RENT_TIE_OUT" and bad.base_noi is None


ASSERT = "workspace_id string, aggregate_id string, key string, value decimal(18,2), valid_from date, valid_to date, recorded_at timestamp, event_id string, supersedes_event_id string"


def test_late_expense_and_as_known_noi(spark):
    d = date(2026, 8, 1)
    rows = [
        ("w", "deal", "operations_noi_base", Decimal(100000), d, None, datetime(2026, 9, 1), "a", None),
        ("w", "deal", "expense:invoice-1", Decimal(15000), d, None, datetime(2026, 9, 20), "b", None),
    ]
    points = [("day10", date(2026, 8, 31), datetime(2026, 9, 10)), ("day20", date(2026, 8, 31), datetime(2026, 9, 20))]
    known = ledger.as_known(spark.createDataFrame(rows, ASSERT), points)
    got = {r.point: r.noi for r in ledger.operations_noi_as_known(known).collect()}
    assert got == {"day10": Decimal(100000), "day20": Decimal(85000)}


def test_future_correction_does_not_hide_the_present(spark):
    rows = [
        ("w", "d", "unit:101", Decimal(0), date(2026, 9, 1), None, datetime(2026, 9, 1), "a", None),
        ("w", "d", "unit:101", Decimal(1), date(2026, 10, 1), None, datetime(2026, 9, 6), "b", "a"),
    ]
    now = datetime(2026, 9, 6)
    known = ledger.as_known(spark.createDataFrame(rows, ASSERT), [("sep", date(2026, 9, 15), now), ("oct", date(2026, 10, 15), now)])
    assert {r.point: (r.value, r.error_code) for r in known.collect()} == {"sep": (Decimal(0), None), "oct": (Decimal(1), None)}


def test_september_trial_balance(spark):
    opening = {"cash": 100000, "receivables": 20000, "payables": -30000, "deposits": -10000, "equity": -80000}
    tx = [
        {"cash": 50000, "rental_revenue": -50000}, {"operating_expense": 18000, "cash": -18000}, {"cash": 5000, "deposits": -5000},
        {"cash": 20000, "rental_revenue": -20000}, {"cash": 5000, "deposits": -5000}, {"operating_expense": 7000, "cash": -7000},
    ]
    o = spark.createDataFrame([("tc", a, Decimal(v)) for a, v in opening.items()], "property_id string, account string, amount decimal(18,2)")
    t = spark.createDataFrame(
        [("tc", i, {a: Decimal(v) for a, v in p.items()}) for i, p in enumerate(tx)], "property_id string, tx int, postings map<string,decimal(18,2)>"
    )
    rows = ledger.explode_postings(t)
    assert all(r.error_code is None for r in ledger.balanced_postings(rows, ["tx"]).collect())
    balances = ledger.trial_balance(o, rows)
    noi = ledger.trial_balance_noi(balances).collect()[0]
    assert (noi.noi, noi.total, noi.error_code) == (Decimal(45000), Decimal(0), None)
    assert {r.account: r.balance for r in balances.collect()}["cash"] == Decimal(155000)


def test_opening_totals(spark):
    rows = [
        (1, "A", "rev-1", "1", "2026-08", "revenue", "residential", "200000.00", False),
        (2, "A", "exp-1", "1", "2026-08", "expense", "residential", "-100000.00", False),
        (3, "B", "rev-1", "1", "2026-08", "revenue", "commercial", "30000.00", False),
        (4, "B", "void-1", "1", "2026-08", "expense", "commercial", None, True),
    ]
    from rentloom import schemas

    raw = spark.createDataFrame(rows, schemas.OPENING)
    ok = ledger.validate_opening(raw, [])
    assert [r.error_code for r in ok.collect()] == [None] * 4
    totals = ledger.opening_totals(ok.drop("amount").withColumnsRenamed({"parsed_amount": "amount", "source_property_id": "property_id"}))
    assert sorted((r.property_id, r.account, r.amount) for r in totals.collect()) == [
        ("A", "expense", Decimal(-100000)), ("A", "revenue", Decimal(200000)), ("B", "revenue", Decimal(30000)),
    ]


MONTHS = ["Sep 2025", "Oct 2025", "Nov 2025", "Dec 2025"] + [f"{m} 2026" for m in "Jan Feb Mar Apr May Jun Jul Aug".split()]
GRID = [
    ["Account", *MONTHS],
    ["INCOME"],
    ["Residential Rental Income", *["41000.00"] * 12],
    ["Parking Income", *["1500.00"] * 12],
    ["TOTAL REVENUE", *["99000.00"] * 12],
    ["EXPENSES"],
    ["Property Insurance", *["(890.00)"] * 12],
    ["Repairs & Maintenance", *["3,450.00"] * 12],
    ["NET OPERATING INCOME", *["50000.00"] * 12],
]
MAPPING = {
    "Residential Rental Income": "residential_rental_income", "Parking Income": "ancillary_income_recurring",
    "Property Insurance": "property_insurance", "Repairs & Maintenance": "repairs_and_maintenance",
}


def t12(spark, grid, mapping=MAPPING):
    cells = spark.createDataFrame(
        [("s", r, c, v) for r, row in enumerate(grid, 10) for c, v in enumerate(row, 3) if v is not None],
        "source_id string, row int, column int, text string",
    )
    st = spark.createDataFrame([("s", 10, 3, "2025-09", "2026-08")], "source_id string, header_row int, label_column int, first_month string, last_month string")
    mp = spark.createDataFrame([(k, v, "map_" + k) for k, v in mapping.items()], "source_label string, canonical_account string, mapping_ref string")
    columns = statements.column_roles(cells, st)
    rows = statements.statement_rows(cells, st, columns, mp)
    cover = statements.month_coverage(columns, st)
    return rows, cover, statements.statement_issues(rows, columns, cover)


def test_t12_happy_grid(spark):
    rows, cover, issues = t12(spark, GRID)
    census = statements.row_census(rows).collect()[0]
    assert (census.section, census.line_item, census.total, census.blank, census.unlabeled) == (2, 4, 2, 0, 0)
    c = cover.collect()[0]
    assert c.coverage == "complete" and c.missing_months == [] and c.error_code is None
    assert issues.count() == 0
    assert statements.t12_status(issues, cover).collect()[0].status == "observed_unvalidated"
    amounts = {(r.canonical_account, r.month): r.amount for r in statements.t12_cells(rows).collect()}
    assert amounts["property_insurance", "2026-08"] == Decimal("-890") and amounts["repairs_and_maintenance", "2025-09"] == Decimal(3450)


def test_t12_issues(spark):
    grid = [list(r) for r in GRID]
    grid[0] = [*grid[0][:-1], "Aug Budget"]
    grid[2][3] = "n/a"
    rows, cover, issues = t12(spark, grid, {k: v for k, v in MAPPING.items() if k != "Parking Income"})
    codes = sorted((i.code, i.severity) for i in issues.collect())
    assert codes == [
        ("MISSING_MONTH_CELL", "blocker"), ("PARTIAL_MONTH_COVERAGE", "blocker"), ("UNMAPPED_ACCOUNT", "blocker"), ("UNRECOGNIZED_COLUMN", "blocker"),
    ]
    assert cover.collect()[0].missing_months == ["2026-08"]


def test_four_counts(spark):
    rows = [("p", "occupied", "x")] * 72 + [("p", "Vacant", "")] * 6 + [("p", "down", "x")] * 2
    got = occupancy.four_counts(spark.createDataFrame(rows, "property_id string, status string, resident string"), resident="resident").collect()[0]
    assert (got.occupied, got.vacant, got.down, got.denominator, got.rate) == (72, 6, 2, 80, Decimal("0.9"))


def test_rent_roll_sections_and_conflicts(spark):
    sheet = [
        ["Roll"], ["Unit", "Status", "Unit Type", "Charge"], ["101", "Occupied", "Apartment", "rent"], [None, None, None, "pet"],
        ["102", "Vacant", "Retail", None], ["101", "Vacant", "Apartment", None], ["Future Residents"], ["103", "Occupied", "Apartment", None],
        ["Current Residents"], ["104", "Down", "Apartment", None], ["Total"], ["105", "Occupied", "Apartment", None],
    ]
    cells = spark.createDataFrame(
        [("s", 1, r, c, v) for r, row in enumerate(sheet, 1) for c, v in enumerate(row, 1) if v],
        "source_id string, sheet int, row int, column int, text string",
    )
    units = {u.unit_id: (u.status, u.unit_use, u.error_code) for u in rentroll.normalize_rent_roll(cells).collect()}
    assert units == {
        "101": (None, None, "DUPLICATE_UNIT_CONFLICT"),
        "102": ("vacant", "commercial", None),
        "104": ("down", "residential", None),
    }


def test_journal_golden(spark):
    ok = [("r", i, *x) for i, x in enumerate([("created", None), ("stage", "normalized"), ("stage", "reconciled"), ("stage", "canonical_ready"), ("execution_authorized", None)], 1)]
    bad = [("q", 1, "created", None), ("q", 2, "stage", "report_ready")]
    df = spark.createDataFrame(ok + bad, "run_id string, n int, kind string, stage string")
    df = df.withColumns({c: F.lit(None).cast("string") for c in ("decision_id", "field", "value")})
    got = {r.run_id: (r.stage, r.error_code) for r in governance.workflow_state(df).collect()}
    assert got == {"r": ("execution_authorized", None), "q": (None, "CORRUPT_INPUT")}


def test_feed_age(spark):
    df = spark.sql("select date'2026-01-01' as a, date'2026-02-15' as b")
    for bound, want in ((45, "current"), (44, "stale")):
        assert df.select(metrics.feed_age(F.col("a"), F.col("b"), bound)["freshness"]).first()[0] == want
    assert df.select(metrics.feed_age(F.col("a"), F.lit(None).cast("date"))["freshness"]).first()[0] == "unknown"
