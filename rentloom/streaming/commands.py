"""Append commands under the ledger's rules as a stateful stream, one state per aggregate.

What a command needs to be judged is kept where it is used: the aggregate's version and last record time, its accepted
source keys and the facts that may be corrected. They lie in the state store in pages of some 64 facts, dealt by the hash
of their name. A batch reads and writes the pages its own commands name, each once, so its cost does not grow with the
ledger, a usual aggregate is one read and one write a batch, and no accepted row is read again. Aggregates are dealt to
slots, and Spark calls the rules once for a slot and not for each aggregate.
"""

from __future__ import annotations

import json
from binascii import crc32
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from rentloom import schemas
from rentloom.functions.refusal import failed, first_failure
from rentloom.operators.ledger import command_hash

COMMANDS = schemas.ASSERTIONS + ", expected_version bigint"
DECIDED = "version bigint, verdict string, error_code string"
PROVIDER = "spark.sql.streaming.stateStore.providerClass"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
DECISION = Row("row_json", "version", "verdict", "error_code")
#: Groups that aggregates are dealt to by hash; a checkpoint belongs to one such number.
SLOTS = 4096
#: Accepted facts a page of state holds on average.
PAGE_FACTS = 64
#: Pages of an aggregate that may be in memory at once; a batch of many commands may hold one for each ROWS_A_PAGE of them.
PAGES_AT_ONCE = 512
ROWS_A_PAGE = 16


def refusal() -> Column:
    """Why a command is refused whatever the ledger holds; NULL if it can be judged."""
    needed = ["workspace_id", "aggregate_id", "key", "source_system", "source_record"]
    return first_failure(
        *[(failed(F.length(F.trim(F.col(c))) > 0), "INVALID_SCOPE") for c in needed],
        (F.col("source_revision").isNull() | F.col("event_id").isNull() | F.col("recorded_at").isNull(), "INVALID_SCOPE"),
        (F.col("expected_version") < 0, "INVALID_VERSION"),
        (F.col("valid_from").isNull() | (F.col("valid_to") <= F.col("valid_from")), "INVALID_INTERVAL"),
    )


def page_of(name: str, pages: int) -> int:
    """The page of an entry. One page more takes entries of one page only, so pages are added one at a time."""
    slots = 1 << (pages - 1).bit_length()
    at = crc32(name.encode()) % slots
    return at if at < pages else at - slots // 2


class Pages:
    """Named entries of one aggregate; page 0 comes with its head, the others are read when one of their names is asked for."""

    def __init__(self, state, aggregate: tuple[str, str], version: int, first: str, rows: int) -> None:
        self.state, self.aggregate, self.count = state, aggregate, self.needed(version)
        self.most = max(PAGES_AT_ONCE, rows // ROWS_A_PAGE)
        self.first = json.loads(first)
        self.held, self.changed = {}, set()

    @staticmethod
    def needed(version: int) -> int:
        return max(1, -(-version // PAGE_FACTS))

    def page(self, at: int) -> dict:
        if at == 0:
            return self.first
        if at not in self.held:
            if len(self.held) >= self.most:
                self.write()
            found = self.state.getValue((*self.aggregate, at))
            self.held[at] = json.loads(found[0]) if found else {}
        return self.held[at]

    def get(self, name: str) -> list | None:
        return self.page(page_of(name, self.count)).get(name)

    def put(self, name: str, value: list) -> None:
        at = page_of(name, self.count)
        self.page(at)[name] = value
        self.changed.add(at)

    def grow(self, version: int) -> None:
        while self.count < self.needed(version):
            self.count += 1
            fresh = self.count - 1
            old = fresh - (1 << fresh.bit_length()) // 2
            entries = self.page(old)
            moved = {name: entries.pop(name) for name in list(entries) if page_of(name, self.count) == fresh}
            self.changed.add(old)
            self.page(fresh).update(moved)
            self.changed.add(fresh)

    def write(self) -> None:
        for at in sorted(self.changed & self.held.keys()):
            self.state.updateValue((*self.aggregate, at), (json.dumps(self.held[at]),))
        self.held, self.changed = {}, set()


class AppendRules(StatefulProcessor):
    """Judges the commands of a slot's aggregates, those of an aggregate in (recorded_at, event_id) order."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        aggregate = "workspace_id string, aggregate_id string"
        self.heads = handle.getMapState("heads", aggregate, "version bigint, recorded_us bigint, page string")
        self.pages = handle.getMapState("pages", f"{aggregate}, page int", "entries string")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        streams = {}
        for r in rows:
            c = json.loads(r.row_json)
            mark = c["_mark"]
            if mark.get("refusal"):
                yield DECISION(r.row_json, None, "refused", mark["refusal"])
                continue
            source = "s" + json.dumps([c["source_system"], c["source_record"], c["source_revision"]])
            command = (mark["recorded_us"], c["event_id"], mark["sha256"], source, c["key"], c.get("supersedes_event_id"), c.get("expected_version"), r.row_json)
            streams.setdefault((c["workspace_id"], c["aggregate_id"]), []).append(command)
        while streams:
            yield from self._judged(*streams.popitem())

    def _judged(self, aggregate: tuple[str, str], commands: list[tuple]) -> Iterator[Row]:
        commands.sort(key=lambda c: c[:3])
        version, last, first = self.heads.getValue(aggregate) or (0, None, "{}")
        before, entries = version, Pages(self.pages, aggregate, version, first, len(commands))
        for at, event, sha, source, name, prior, expected, row_json in commands:
            held = entries.get(source)
            if held is not None:
                same = held[0] == sha
                yield DECISION(row_json, *((held[1], "replay", None) if same else (None, "conflict", "SOURCE_REVISION_CHANGED")))
                continue
            prior, error = -1 if prior is None else prior, None
            if expected is not None and expected != version:
                error = "OBSOLETE_VERSION"
            elif entries.get(f"f{event}") is not None:
                error = "EVENT_ID_REUSED"
            elif prior >= 0:
                error = self._correction_error(entries.get(f"f{prior}"), name)
            if error is None and last is not None and at < last:
                error = "CLOCK_BACKWARD"
            if error is not None:
                yield DECISION(row_json, None, "conflict", error)
                continue
            version, last = version + 1, at
            entries.put(source, [sha, version])
            entries.put(f"f{event}", [name, False])
            if prior >= 0:
                entries.put(f"f{prior}", [name, True])
            entries.grow(version)
            yield DECISION(row_json, version, "new", None)
        if version != before:
            entries.write()
            self.heads.updateValue(aggregate, (version, last, json.dumps(entries.first)))

    def _correction_error(self, target: list | None, name: str) -> str | None:
        if target is None:
            return "UNKNOWN_TARGET"
        if target[0] != name:
            return "KEY_CHANGED"
        return "SECOND_CORRECTION" if target[1] else None

    def close(self) -> None:
        pass


def judged_commands(commands: DataFrame) -> DataFrame:
    """A stream of ``COMMANDS`` with version, verdict and error_code, every command exactly once.

    new: accepted, with the next version of its aggregate. replay: the same source key and content as an accepted fact,
    with that fact's version. conflict: SOURCE_REVISION_CHANGED, OBSOLETE_VERSION (an expected version is given and is
    not the current one), EVENT_ID_REUSED, UNKNOWN_TARGET, KEY_CHANGED, SECOND_CORRECTION or CLOCK_BACKWARD, in this order.
    refused: the command itself is incomplete. Inside a batch commands are taken in (recorded_at, event_id) order; a
    batch is what bounds the rows of one aggregate in memory. Target events must be numbers of 0 or more.
    """
    why = refusal()
    # Refused commands touch no state and are dealt out, so rows without a key do not meet in one group.
    aggregate, row = F.struct("workspace_id", "aggregate_id"), F.struct("*")
    slot = F.pmod(F.when(why.isNull(), F.xxhash64(aggregate)).otherwise(F.xxhash64(row)), F.lit(SLOTS))
    mark = F.struct(why.alias("refusal"), command_hash().alias("sha256"), F.unix_micros("recorded_at").alias("recorded_us"))
    rows = commands.select(
        slot.cast("int").alias("slot"), F.to_json(F.struct(*commands.columns, mark.alias("_mark"))).alias("row_json")
    )
    decided = rows.groupBy("slot").transformWithState(AppendRules(), f"row_json string, {DECIDED}", "append", "none")
    kept = F.from_json("row_json", commands.schema.simpleString())
    return decided.select(F.inline(F.array(kept)), "version", "verdict", "error_code")


def append_commands(stream: DataFrame, target: str, checkpoint: str) -> StreamingQuery:
    """Run the import over all available input; ``target`` holds one folder for each verdict, written exactly once.

    The file sink commits a batch's files by its number, so a batch that runs again after a failure adds nothing.
    """
    spark = stream.sparkSession
    before = spark.conf.get(PROVIDER)
    spark.conf.set(PROVIDER, ROCKS)
    try:
        decided = judged_commands(stream).writeStream.format("parquet").partitionBy("verdict").outputMode("append")
        return decided.option("path", target).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    finally:
        spark.conf.set(PROVIDER, before)


def read_commands(spark: SparkSession, path: str, files_per_batch: int = 100) -> DataFrame:
    stream = spark.readStream.schema(schemas.contract(COMMANDS)).option("maxFilesPerTrigger", str(files_per_batch))
    return stream.parquet(path)


def accepted(spark: SparkSession, target: str) -> DataFrame:
    """Accepted facts with their versions."""
    return spark.read.parquet(target).filter("verdict = 'new'").drop("verdict", "error_code", "expected_version")
