"""Workflow runs folded from their journals, with approvals that bind hashes and inputs that are pinned again.

A journal is a run's events numbered 1, 2, 3 …; what follows a gap is not read. Numbers have at most four digits, so a
run has at most 9,999 events once repeated deliveries of one number are merged, and a window per run is bounded.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rentloom.functions.refusal import any_of, failed
from rentloom.functions.skew import Stage
from rentloom.operators.governance import AUTHORIZED_FROM, FORMATS, NEXT_STAGES, REQUIRED_INPUTS, REQUIRED_VALUES, _literals

EVENTS = (
    "run_id string, n bigint, kind string, stage string, content_sha256 string, inputs map<string,string>, "
    "`values` map<string,string>, decision_id string, decision_status string, resolutions map<string,string>"
)
LAST_NUMBER = 9999
REVIEW_STATUSES = ["approved", "cancelled"]
NO_TEXTS = "cast(map() as map<string,string>)"


def entries(of: Column) -> Column:
    """A map's entries in one order, so that maps can be compared."""
    return F.array_sort(F.map_entries(of))


def numbered_events(events: DataFrame) -> DataFrame:
    """One row for each number of a run, with ``rewritten`` where deliveries of it differ.

    Events are dealt out by run once; this grouping, and whatever follows by run, needs no other shuffle."""
    columns = [c for c in events.columns if c not in ("run_id", "n")]
    canonical = F.struct(*[entries(F.col(c)) if c in ("inputs", "values", "resolutions") else F.col(c) for c in columns])
    digest = F.sha2(F.to_json(canonical, {"ignoreNullFields": "false"}), 256)
    read = events.filter(F.col("run_id").isNotNull() & F.col("n").between(1, LAST_NUMBER)).repartition("run_id").withColumn("digest", digest)
    merged = read.groupBy("run_id", "n").agg(
        F.min_by(F.struct(*columns), "digest").alias("e"), (F.min("digest") != F.max("digest")).alias("rewritten")
    )
    return merged.select("run_id", "n", "e.*", "rewritten")


def run_records(events: DataFrame) -> DataFrame:
    """One record per run from ``EVENTS``: the state after all events up to the first gap.

    stage; event_count, and waiting, the events behind a gap; content_sha256 and values as created; inputs as last pinned;
    resolutions and resolved_by of approved reviews, the latest for each field; approved; execution; error_code.

    CORRUPT_INPUT: no first event, or a first one that is not ``created``; a kind, stage or review the current stage does
    not allow; a decision id used twice; a resolution of a field that is not resolvable; an approval whose content or
    input hashes are not the run's current ones; inputs pinned again under another name or hash; an event delivered with
    two contents. Of such a run only the counts are told. Pinning inputs again keeps those it names and drops the others.
    """
    e = numbered_events(events)
    by_run = Window.partitionBy("run_id").orderBy("n")
    earlier = by_run.rowsBetween(Window.unboundedPreceding, -1)

    def before(value: Column) -> Column:
        return F.last(value, ignorenulls=True).over(earlier)

    kind = F.col("kind")
    becomes = (
        F.when(kind == "created", "inspected").when(kind == "stage", F.col("stage")).when(kind == "execution_authorized", kind)
    )
    pins = F.when(kind.isin("created", "inputs_repinned"), F.coalesce("inputs", F.expr(NO_TEXTS)))
    e = e.withColumns(
        {
            "last_n": F.coalesce(F.lag("n").over(by_run), F.lit(0)),
            "stage_before": before(becomes),
            "pinned": before(pins),
            "identity": before(F.when(kind == "created", F.col("content_sha256"))),
        }
    )
    gap = F.min(F.when(F.col("n") != F.col("last_n") + 1, F.col("n"))).over(Window.partitionBy("run_id"))
    e = e.withColumns({"becomes": becomes, "gap": F.coalesce(gap, F.lit(LAST_NUMBER + 1))})
    allowed = F.create_map(*[x for s, nxt in NEXT_STAGES.items() for x in (F.lit(s), _literals(nxt))])
    known_fields = F.forall(F.map_keys(F.coalesce("resolutions", F.expr(NO_TEXTS))), lambda f: f.isin(REQUIRED_VALUES))
    review = (F.col("stage_before") == "review_required") & F.col("decision_id").isNotNull() & F.col("decision_status").isin(REVIEW_STATUSES)
    approval = (
        (F.col("stage_before") == AUTHORIZED_FROM)
        & (F.col("content_sha256") == F.col("identity"))
        & (entries(F.col("inputs")) == entries(F.col("pinned")))
    )
    repinned = F.size(F.array_except(F.map_entries("inputs"), F.map_entries("pinned"))) == 0
    legal = (
        F.when(F.col("n") == 1, kind == "created")
        .when(kind == "stage", F.array_contains(F.try_element_at(allowed, F.col("stage_before")), F.col("stage")))
        .when(kind == "engine_error", F.col("stage_before") == "execution_authorized")
        .when(kind == "review", review & ((F.col("decision_status") != "approved") | known_fields))
        .when(kind == "execution_authorized", approval)
        .when(kind == "inputs_repinned", repinned & F.col("inputs").isNotNull())
    )
    read = F.col("n") < F.col("gap")
    resolved = F.when(
        read & (kind == "review") & (F.col("decision_status") == "approved"),
        F.transform(
            F.map_entries(F.coalesce("resolutions", F.expr(NO_TEXTS))),
            lambda x: F.struct(x["key"].alias("field"), F.col("n").alias("n"), x["value"].alias("value"), F.col("decision_id").alias("by")),
        ),
    )
    last_of = lambda value: F.max_by(value, F.when(read & value.isNotNull(), F.col("n")))
    decisions = F.collect_list(F.when(read & (kind == "review"), F.col("decision_id")))
    execution = F.when(kind == "engine_error", "error").when((kind == "stage") & (F.col("stage") == "engine_executed"), "executed")
    runs = e.groupBy("run_id").agg(
        last_of(F.col("becomes")).alias("stage"),
        F.count_if(read).alias("event_count"),
        F.count_if(~read).alias("waiting"),
        last_of(F.when(kind == "created", F.col("content_sha256"))).alias("content_sha256"),
        last_of(pins).alias("inputs"),
        last_of(F.when(kind == "created", F.coalesce("values", F.expr(NO_TEXTS)))).alias("values"),
        F.array_sort(F.flatten(F.collect_list(resolved))).alias("all_resolved"),
        (F.count_if(read & (kind == "execution_authorized")) > 0).alias("approved"),
        last_of(execution).alias("execution"),
        F.count_if(read & (failed(legal) | F.col("rewritten"))).alias("bad"),
        decisions.alias("decisions"),
    )
    corrupt = any_of(F.col("bad") > 0, F.col("event_count") == 0, F.size("decisions") != F.size(F.array_distinct("decisions")))
    # Sorted by field, then number: the last entry of a field stands.
    standing = F.filter(
        "all_resolved", lambda x, i: F.coalesce(F.get("all_resolved", i + 1)["field"] != x["field"], F.lit(True))
    )

    def as_map(name: str) -> Column:
        return F.map_from_entries(F.transform(standing, lambda x: F.struct(x["field"], x[name])))

    told = {c: F.col(c) for c in ("stage", "content_sha256", "inputs", "values")}
    told |= {"resolutions": as_map("value"), "resolved_by": as_map("by"), "approved": F.col("approved"), "execution": F.col("execution")}
    return runs.select(
        "run_id",
        "event_count",
        "waiting",
        *(F.when(~corrupt, value).alias(name) for name, value in told.items()),
        F.when(corrupt, "CORRUPT_INPUT").alias("error_code"),
    )


def run_blockers(records: DataFrame, live: DataFrame, stage: Stage = lambda df: df) -> DataFrame:
    """Records with ``blockers`` (field, kind, resolved_by), ``outcome`` and STALE.

    ``live(run_id, name, sha256, format)`` says what the pinned sources hold now. One that is gone or has other bytes is
    corrupt_input, and makes an approved run STALE. An input of another format is unsupported_engineering; an input or
    value that is not there is pending_human_action. A value given by an approved review stays listed with the decision
    that resolved it and blocks nothing. A refused run has neither blockers nor outcome. ``stage`` may write the records,
    which are read twice.
    """
    records = stage(records)
    pinned = records.select("run_id", F.explode("inputs").alias("name", "pinned"))
    # Sources that nobody pinned do not travel further, so a run keeps at most its own inputs.
    found = pinned.join(live.groupBy("run_id", "name").agg(F.min("sha256").alias("low"), F.max("sha256").alias("high"), F.min("format").alias("format")), ["run_id", "name"], "left")
    intact = F.coalesce((F.col("low") == F.col("pinned")) & (F.col("high") == F.col("pinned")), F.lit(False))
    state = F.struct("name", intact.alias("intact"), F.coalesce(F.col("format").isin(FORMATS), F.lit(False)).alias("known"))
    states = found.groupBy("run_id").agg(F.array_sort(F.collect_list(state)).alias("sources"))
    nobody = F.lit(None).cast("string").alias("resolved_by")

    def listed(names: Column, kind: str, by: Column | None = None) -> Column:
        return F.transform(names, lambda x: F.struct(x.alias("field"), F.lit(kind).alias("kind"), nobody if by is None else by[x].alias("resolved_by")))

    out = records.join(states, "run_id", "left")
    sources = F.coalesce("sources", F.expr("cast(array() as array<struct<name:string,intact:boolean,known:boolean>>)"))
    out = out.withColumn("sources", sources)
    corrupt = F.transform(F.filter("sources", lambda s: ~s["intact"]), lambda s: s["name"])
    unsupported = F.transform(F.filter("sources", lambda s: s["intact"] & ~s["known"]), lambda s: s["name"])
    absent = F.filter(_literals(REQUIRED_INPUTS), lambda n: ~F.map_contains_key("inputs", n))
    unset = F.filter(_literals(REQUIRED_VALUES), lambda n: F.col("values")[n].isNull())
    blockers = F.concat(
        listed(corrupt, "corrupt_input"),
        listed(unsupported, "unsupported_engineering"),
        listed(absent, "pending_human_action"),
        listed(unset, "pending_human_action", F.col("resolved_by")),
    )
    stale = F.coalesce(F.col("approved") & (F.size(corrupt) > 0), F.lit(False))
    error = F.coalesce("error_code", F.when(stale, "STALE"))
    out = out.withColumn("error_code", error).withColumn("blockers", F.when(F.col("error_code").isNull(), blockers))
    still = F.filter("blockers", lambda b: b["resolved_by"].isNull())
    outcome = (
        F.when(F.col("execution") == "error", "execution_error")
        .when(F.exists(still, lambda b: b["kind"] == "unsupported_engineering"), "unsupported_input")
        .when(F.size(still) > 0, "needs_review_or_data")
        .otherwise("complete")
    )
    return out.drop("sources").withColumn("outcome", F.when(F.col("error_code").isNull(), outcome))
