"""Workflow runs and feeds as stateful streams: events that wait for a gap to fill, and feeds that turn stale in silence."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from rentloom import schemas
from rentloom.operators.governance import AUTHORIZED_FROM, NEXT_STAGES, REQUIRED_VALUES
from rentloom.operators.workflow import LAST_NUMBER, REVIEW_STATUSES
from rentloom.streaming.commands import PROVIDER, ROCKS

RUN = (
    "run_id string, stage string, event_count bigint, waiting bigint, inputs map<string,string>, "
    "resolutions map<string,string>, resolved_by map<string,string>, approved boolean, error_code string"
)
MAPS = ["inputs", "values", "resolutions"]
#: What the state keeps of an event besides its number; fields that are null are left out.
FIELDS = ["kind", "stage", "content_sha256", *MAPS, "decision_id", "decision_status"]
#: Disk that a stream of states takes: stores are closed, and their local files deleted, when the task that wrote their state
#: ends, shuffled rows go with their batch, and the checkpoint holds compressed logs of what a batch wrote.
STORE = {
    PROVIDER: ROCKS,
    "spark.sql.streaming.stateStore.unloadOnCommit": "true",
    "spark.sql.streaming.stateStore.compression.codec": "zstd",
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
    "spark.sql.streaming.stateStore.rocksdb.compression": "zstd",
    "spark.sql.streaming.stateStore.rocksdb.blockSizeKB": "32",
    "spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true",
}
DAY_MS = 86_400_000
#: Runs whose events are in Python's memory at once.
RUNS_AT_ONCE = 200


def applied(state: dict, event: dict) -> bool:
    """Move a run by its next event; False if the run's state does not allow it."""
    kind, stage = event["kind"], state["stage"]
    if state["count"] == 0:
        if kind != "created":
            return False
        state |= {"stage": "inspected", "inputs": event["inputs"] or {}, "content": event["content_sha256"]}
    elif kind == "stage":
        if event["stage"] not in NEXT_STAGES.get(stage, []):
            return False
        state["stage"] = event["stage"]
    elif kind == "engine_error":
        return stage == "execution_authorized"
    elif kind == "review":
        decision, status = event["decision_id"], event["decision_status"]
        given = event["resolutions"] or {}
        if stage != "review_required" or decision is None or decision in state["decisions"] or status not in REVIEW_STATUSES:
            return False
        state["decisions"].append(decision)
        if status == "approved":
            if any(field not in REQUIRED_VALUES for field in given):
                return False
            state["resolutions"] |= given
            state["resolved_by"] |= dict.fromkeys(given, decision)
    elif kind == "execution_authorized":
        same = event["content_sha256"] is not None and event["content_sha256"] == state["content"]
        if stage != AUTHORIZED_FROM or not same or event["inputs"] != state["inputs"]:
            return False
        state |= {"stage": "execution_authorized", "approved": True}
    elif kind == "inputs_repinned":
        if event["inputs"] is None or any(state["inputs"].get(k) != v for k, v in event["inputs"].items()):
            return False
        state["inputs"] = event["inputs"]
    else:
        return False
    return True


def _event(text: str) -> dict:
    """An event with all of its fields. Older checkpoints hold texts that name the null fields too."""
    return dict.fromkeys(FIELDS) | json.loads(text)


def journal_told(run_id: str | None, entries: list[dict]) -> dict:
    """The row of ``RUN`` for the events a run has so far, one entry (n, event) for each number and content."""
    state = {"stage": None, "count": 0, "inputs": {}, "content": None, "resolutions": {}, "resolved_by": {}}
    state |= {"approved": False, "decisions": []}
    slots, rewritten, corrupt = {}, set(), False
    for entry in entries:
        known = slots.setdefault(entry["n"], entry["event"])
        if known != entry["event"] and _event(known) != _event(entry["event"]):
            rewritten.add(entry["n"])
    while (n := state["count"] + 1) in slots:
        corrupt = corrupt or n in rewritten or not applied(state, _event(slots[n]))
        state["count"] = n
    corrupt = corrupt or state["count"] == 0
    told = {"stage": state["stage"], "approved": state["approved"]}
    told |= {name: json.dumps(state[name]) for name in ("inputs", "resolutions", "resolved_by")}
    counts = {"event_count": state["count"], "waiting": len(slots) - state["count"], "error_code": "CORRUPT_INPUT" if corrupt else None}
    return {"run_id": run_id} | {name: None if corrupt else value for name, value in told.items()} | counts


def run_states(stream: DataFrame) -> DataFrame:
    """The state of every run after each batch that brought it events, from a stream of ``workflow.EVENTS`` in any order.

    The state store keeps the set of a run's (number, content) as one aggregate that combines before the shuffle, so events
    wait there for a gap to fill and the same event again changes nothing. A run has at most 9,999 numbers. The walk over
    the events of the runs of a batch is a function of that set and runs on Arrow batches of runs, so no event is a call
    to the state store; whatever the order of arrival the last state of a run is that of ``workflow.run_records`` over all
    its events. Events without a run or with a number outside 1 … 9,999 are not read.
    """
    text = F.to_json(F.struct(*(_sorted_map(c).alias(c) if c in MAPS else c for c in FIELDS)))
    read = stream.filter(F.col("run_id").isNotNull() & F.col("n").between(1, LAST_NUMBER))
    rows = read.select("run_id", F.struct(F.col("n").cast("bigint").alias("n"), text.alias("event")).alias("e"))
    sets = rows.groupBy("run_id").agg(F.array_sort(F.collect_set("e")).alias("events"))
    plain = RUN.replace("map<string,string>", "string")
    schema = schemas.contract(plain)

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        arrow = to_arrow_schema(schema)
        for batch in batches:
            for at in range(0, batch.num_rows, RUNS_AT_ONCE):
                part = batch.slice(at, RUNS_AT_ONCE)
                told = [journal_told(r["run_id"], r["events"]) for r in part.to_pylist()]
                yield pa.RecordBatch.from_pylist(told, schema=arrow)

    out = sets.mapInArrow(walk, schema)
    maps = {c: F.from_json(c, "map<string,string>") for c in ("inputs", "resolutions", "resolved_by")}
    return out.withColumns(maps)


def _sorted_map(name: str):
    return F.map_from_entries(F.array_sort(F.map_entries(name)))


class FeedClock(StatefulProcessor):
    """Newest snapshot of one feed, and a timer for the moment at which it is too old."""

    def __init__(self, bound: int, grace: int):
        self.bound, self.grace = bound, grace

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.newest = handle.getValueState("newest", "day_ms bigint")

    def _expiry(self, day_ms: int) -> int:
        # The watermark runs behind the newest day of all feeds by the grace.
        return day_ms + (self.bound + 1 - self.grace) * DAY_MS

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        held = self.newest.get()[0] if self.newest.exists() else None
        newest = max(int(frame["day_ms"].max()) for frame in rows)
        if held is not None and held >= newest:
            return
        if held is not None:
            self.handle.deleteTimer(self._expiry(held))
        self.newest.update((newest,))
        self.handle.registerTimer(self._expiry(newest))
        yield pd.DataFrame({"property_id": [key[0]], "day_ms": [newest], "freshness": ["current"]})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        held = self.newest.get()[0]
        if self._expiry(held) <= timerValues.getCurrentWatermarkInMs():
            yield pd.DataFrame({"property_id": [key[0]], "day_ms": [held], "freshness": ["stale"]})

    def close(self) -> None:
        pass


def feed_alerts(stream: DataFrame, bound: int = 45, grace: int = 3650) -> DataFrame:
    """(property_id, as_of, freshness): ``current`` when a feed brings a newer day, ``stale`` once the newest day of all feeds
    is more than ``bound`` days ahead of it, though the feed itself stays silent.

    Time is the newest ``as_of_date`` seen, so a run over the same files gives the same alerts whenever it is made. Days more than
    ``grace`` days behind it are too late to count. One number and one timer are kept per property.
    """
    day = F.to_timestamp("as_of_date")
    rows = stream.filter(F.col("property_id").isNotNull() & F.col("as_of_date").isNotNull()).withColumn("day", day)
    rows = rows.withWatermark("day", f"{grace} days").select("property_id", "day", F.unix_millis("day").alias("day_ms"))
    out = rows.groupBy("property_id").transformWithStateInPandas(
        FeedClock(bound, grace), "property_id string, day_ms bigint, freshness string", "append", "eventTime"
    )
    return out.select("property_id", F.to_date(F.timestamp_millis("day_ms")).alias("as_of"), "freshness")


def write_states(states: DataFrame, target: str, checkpoint: str, mode: str = "append") -> StreamingQuery:
    """All available input; ``target`` has one folder per batch, and a batch that runs again replaces its own.

    A batch is executed once, by the write, so its shuffled rows may be deleted after it."""
    spark = states.sparkSession

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{target}/batch={number}")

    before = {name: spark.conf.get(name, None) for name in STORE}
    for name, value in STORE.items():
        spark.conf.set(name, value)
    try:
        query = states.writeStream.outputMode(mode).foreachBatch(write).option("checkpointLocation", checkpoint)
        return query.trigger(availableNow=True).start()
    finally:
        for name, value in before.items():
            spark.conf.unset(name) if value is None else spark.conf.set(name, value)


def last_states(written: DataFrame, key: str = "run_id") -> DataFrame:
    """The newest row of each key of a folder that ``write_states`` fills."""
    columns = [c for c in written.columns if c not in (key, "batch")]
    last = written.groupBy(key).agg(F.max_by(F.struct(*columns), "batch").alias("s"))
    return last.select(key, *(F.col(f"s.{c}").alias(c) for c in columns))
