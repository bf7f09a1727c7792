"""Keyed stream state: feed freshness per property and the state of workflow runs."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from rentloom import schemas
from rentloom.functions.metrics import feed_age
from rentloom.operators.governance import AUTHORIZED_FROM, EVENT_KINDS, NEXT_STAGES

#: Runs whose events are in Python's memory at once.
RUNS_AT_ONCE = 1000
RUN_OUTPUT = "run_id string, stage string, events bigint, error_code string"


def feed_monitor(stream: DataFrame, review_day: str | None, bound: int = 45) -> DataFrame:
    """Newest snapshot date per property and its freshness, for update or complete output.

    The state is one date per property, and partial maxima are taken before the shuffle."""
    day = F.to_date(F.lit(review_day)) if review_day else F.lit(None).cast("date")
    latest = stream.groupBy("property_id").agg(F.max("as_of_date").alias("as_of"))
    age = feed_age(F.col("as_of"), day, bound)
    return latest.select("property_id", "as_of", age["age_days"].alias("age_days"), age["freshness"].alias("freshness"))


def _journal_told(run_id: str | None, entries: list[dict]) -> dict:
    """The row of ``RUN_OUTPUT`` for all events of a run so far, batch after batch and by number inside a batch."""
    stage, last, count, used, corrupt = None, 0, 0, set(), False
    for e in sorted(entries, key=lambda e: (e["arrived"], e["n"] is None, e["n"] or 0)):
        kind, n = e["kind"], e["n"]
        count += 1
        target = {"created": "inspected", "execution_authorized": "execution_authorized"}.get(kind)
        target = e["stage"] if kind == "stage" else target
        if kind not in EVENT_KINDS or (n is not None and n <= last):
            corrupt = True
        last = last if n is None else max(last, n)
        if target is not None:
            if not stage:
                legal = kind == "created"
            elif kind == "execution_authorized":
                legal = stage == AUTHORIZED_FROM
            else:
                legal = target in NEXT_STAGES.get(stage, [])
            corrupt = corrupt or not legal
            stage = target
        elif kind == "review":
            corrupt = corrupt or stage != "review_required" or e["decision_id"] in used
            used.add(e["decision_id"])
        elif kind == "engine_error":
            corrupt = corrupt or stage != "execution_authorized"
    return {"run_id": run_id, "stage": None if corrupt else stage, "events": count, "error_code": "CORRUPT_INPUT" if corrupt else None}


def journal_state(stream: DataFrame) -> DataFrame:
    """State machine per run over journal events, emitting the new state after every batch.

    A step that the stage does not allow, an event of an unknown kind, a step out of order or a decision id used twice makes
    the run CORRUPT_INPUT for good. The state store keeps a run's events with the time of the batch that brought them, as one
    aggregate that combines before the shuffle; the walk over the runs of a batch runs on Arrow batches of runs, not in a
    Python call a run. State is a run's own events, so it grows with the journal and not with the number of batches."""
    event = F.struct(F.current_timestamp().alias("arrived"), F.col("n").cast("bigint").alias("n"), "kind", "stage", "decision_id")
    runs = stream.select("run_id", event.alias("e")).groupBy("run_id").agg(F.collect_list("e").alias("events"))
    schema = schemas.contract(RUN_OUTPUT)

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        arrow = to_arrow_schema(schema)
        for batch in batches:
            for at in range(0, batch.num_rows, RUNS_AT_ONCE):
                told = [_journal_told(r["run_id"], r["events"]) for r in batch.slice(at, RUNS_AT_ONCE).to_pylist()]
                yield pa.RecordBatch.from_pylist(told, schema=arrow)

    return runs.mapInArrow(walk, schema)
