"""What one task, one row or one call holds does not grow with the table: plans and streams against their old shapes."""

import json
import time
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from rentloom import schemas
from rentloom.operators import ops, rentroll, workflow
from rentloom.sources import files, reports
from rentloom.streaming import monitor, runs


def optimized(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def planned(df):
    return df._jdf.queryExecution().executedPlan().toString()


JOURNEY = ["created", "stage:normalized", "stage:review_required", "review:d1", "review:d2", "stage:reconciled"]


def journal_rows(run, steps, first=1):
    rows = []
    for n, step in enumerate(steps, first):
        kind, _, rest = step.partition(":")
        rows.append((run, n, kind, rest if kind == "stage" else None, rest if kind == "review" else None, None, None))
    return rows


def test_journal_state_over_batches(spark, tmp_path):
    twice = [*JOURNEY[:4], "review:d1"]
    batches = [
        journal_rows("good", JOURNEY[:4]) + journal_rows("late", JOURNEY[2:4], 3) + journal_rows("again", JOURNEY[:2]) + journal_rows("twice", twice),
        journal_rows("good", JOURNEY[4:], 5) + journal_rows("late", JOURNEY[:2]) + journal_rows("again", JOURNEY[1:3], 2),
        journal_rows("new", ["created", "stage:engine_executed"]) + [("odd", 1, "unheard", None, None, None, None), (None, 1, "created", None, None, None, None)],
    ]
    for rows in batches:
        spark.createDataFrame(rows, schemas.JOURNAL).repartition(3).write.mode("append").parquet(f"{tmp_path}/in")
        stream = spark.readStream.schema(schemas.contract(schemas.JOURNAL)).parquet(f"{tmp_path}/in")
        runs.write_states(monitor.journal_state(stream), f"{tmp_path}/out", f"{tmp_path}/checkpoint", "update").awaitTermination()
    written = spark.read.parquet(f"{tmp_path}/out")
    assert {(r.run_id, r.stage, r.events) for r in written.filter("batch = 0").collect()} == {
        ("good", "review_required", 4), ("late", None, 2), ("again", "normalized", 2), ("twice", None, 5),
    }
    got = {r.run_id: (r.stage, r.events, r.error_code) for r in runs.last_states(written).collect()}
    assert got == {
        "good": ("reconciled", 6, None), "late": (None, 4, "CORRUPT_INPUT"), "again": (None, 4, "CORRUPT_INPUT"),
        "twice": (None, 5, "CORRUPT_INPUT"), "new": (None, 2, "CORRUPT_INPUT"), "odd": (None, 1, "CORRUPT_INPUT"), None: ("inspected", 1, None),
    }


@pytest.mark.parametrize("name", ["journal", "runs"])
def test_streams_make_no_python_call_a_run(spark, tmp_path, name):
    ddl = schemas.JOURNAL if name == "journal" else workflow.EVENTS
    stream = spark.readStream.schema(schemas.contract(ddl)).parquet(str(tmp_path))
    states = monitor.journal_state(stream) if name == "journal" else runs.run_states(stream)
    plan = states._jdf.queryExecution().analyzed().toString()
    assert "MapInArrow" in plan and "WithState" not in plan


def test_states_leave_no_local_files(spark, tmp_path):
    local = Path(spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirs()[0].getPath()).parent
    left = lambda: {p for kind in ("StateStore*", "blockmgr-*/*/shuffle_*") for p in local.glob(kind)}
    before, settings = left(), [spark.conf.get(name, None) for name in runs.STORE]
    for part in ([("a", 1, "created"), ("b", 1, "created")], [("a", 2, "stage"), ("b", 2, "unheard")]):
        rows = [(run, n, kind, "normalized" if n == 2 else None, "c", {"om": None}, None, None, None, None) for run, n, kind in part]
        spark.createDataFrame(rows, workflow.EVENTS).write.mode("append").parquet(f"{tmp_path}/in")
        stream = spark.readStream.schema(schemas.contract(workflow.EVENTS)).parquet(f"{tmp_path}/in")
        runs.write_states(runs.run_states(stream), f"{tmp_path}/out", f"{tmp_path}/checkpoint", "update").awaitTermination()
        until = time.time() + 20
        while left() - before and time.time() < until:
            time.sleep(0.2)
        assert not left() - before
    assert settings == [spark.conf.get(name, None) for name in runs.STORE]
    got = {(r.run_id, r.stage, r.event_count, r.error_code) for r in runs.last_states(spark.read.parquet(f"{tmp_path}/out")).collect()}
    assert got == {("a", "normalized", 2, None), ("b", None, 2, "CORRUPT_INPUT")}


def test_events_without_their_null_fields_are_the_same():
    whole = dict.fromkeys(["kind", "stage", "content_sha256", "inputs", "values", "resolutions", "decision_id", "decision_status"])
    first = {"kind": "created", "inputs": {"om": None}}
    entries = [{"n": 1, "event": json.dumps(e)} for e in (first, whole | first)] + [{"n": 2, "event": '{"kind":"stage","stage":"normalized"}'}]
    told = runs.journal_told("a", entries)
    assert (told["stage"], told["event_count"], told["inputs"], told["error_code"]) == ("normalized", 2, '{"om": null}', None)
    other = {"n": 1, "event": json.dumps(first | {"inputs": {}})}
    assert runs.journal_told("a", [*entries, other])["error_code"] == "CORRUPT_INPUT"


def test_cells_are_handed_on_before_the_file_ends(spark, tmp_path):
    lines = "".join(f"{i},x\n" for i in range(60_000))
    (tmp_path / "grid.csv").write_text(lines + 'a,"b"c\n')
    cells = files.read_cells(spark, str(tmp_path))
    assert [(r.row, r.column, r.text) for r in cells.limit(3).collect()] == [(1, 1, "0"), (1, 2, "x"), (2, 1, "1")]
    with pytest.raises(Exception, match="expected after"):
        cells.count()


def test_files_grow_with_the_rows():
    assert [reports.files_for(n, 6) for n in (0, 600_000, 36_000_000)] == [6, 6, 72]


def test_headers_are_dealt_out_by_sheet_once(spark):
    cells = spark.createDataFrame([("a", 1, 5, 1, "Unit"), ("a", 1, 6, 1, "")], "source_id string, sheet int, row int, column int, text string")
    plan = planned(rentroll.fold_split_header(cells, 5, 6))
    assert plan.count("Exchange") == 1 and "Aggregate" not in plan[plan.index("Exchange") :]


def test_periods_are_parsed_once_for_each_text(spark):
    rows = [("p", "Mar 2026", " 1 ", "$1,000.50"), ("p", "2026-03", "1", "(0.50)"), ("p", "2026-02", "1", "-"), ("p", "2026-04", "2", "9"), ("p", "2025-05", "1", "x"), ("q", "?", "1", "5")]
    feed = spark.createDataFrame(rows, "property_id string, period string, account_code string, ptd_actual string")
    out = ops.t12_from_budget_comparison(feed, spark.createDataFrame([("1",)], "account_code string"))
    assert [(r.property_id, r.as_of, r.value) for r in out.collect()] == [("p", "2026-04", None)]
    good = ops.t12_from_budget_comparison(feed.filter("ptd_actual <> 'x'"), spark.createDataFrame([("1",)], "account_code string"))
    assert [(r.as_of, str(r.value), r.error_code) for r in good.collect()] == [("2026-04", "1000.00", None)]
    lines = optimized(out).splitlines()
    for at, line in enumerate(lines):
        if "RLIKE" in line:
            assert any("Aggregate" in below for below in lines[at:])


def test_events_are_shuffled_once(spark):
    events = spark.createDataFrame([("a", 1, "created", None, "c", {"om": "1"}, None, None, None, None)], workflow.EVENTS)
    assert planned(workflow.run_records(events)).count("Exchange") == 1


def test_blockers_read_the_records_from_one_stage(spark):
    staged = []
    events = spark.createDataFrame([("a", 1, "created", None, "c", {"om": "1"}, None, None, None, None)], workflow.EVENTS)
    live = spark.createDataFrame([("a", "om", "1", "pdf")], "run_id string, name string, sha256 string, format string")
    out = workflow.run_blockers(workflow.run_records(events), live, lambda df: staged.append(df) or df)
    assert len(staged) == 1 and [r.outcome for r in out.select("outcome").collect()] == ["needs_review_or_data"]
    assert out.filter(F.size("blockers") > 0).count() == 1
