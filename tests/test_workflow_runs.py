"""Run records in batch and as a stream against a walk in Python; feeds that turn stale by time alone."""

import random
from datetime import date, timedelta

import pytest

from rentloom import schemas
from rentloom.operators import workflow
from rentloom.streaming import runs

PINS = {"om": "1", "rr": "2", "t12": "3", "debt": "4"}
ALLOWED = {
    "normalized": ["inspected"], "review_required": ["normalized"], "reconciled": ["normalized", "review_required"],
    "canonical_ready": ["reconciled"], "engine_executed": ["execution_authorized"], "report_ready": ["engine_executed"],
}


def event(run, n, kind, stage=None, content=None, inputs=None, values=None, decision=None, status=None, resolutions=None):
    return (run, n, kind, stage, content, inputs, values, decision, status, resolutions)


def created(run, inputs=PINS, content="c", values=None):
    return event(run, 1, "created", content=content, inputs=inputs, values=values or {"millage": None})


def walk(events):
    """stage, applied events, waiting, inputs, resolutions, resolved_by, approved, corrupt of one run."""
    slots, rewritten = {}, set()
    for e in events:
        if e[1] is None or not 1 <= e[1] <= 9999:
            continue
        if e[1] in slots and slots[e[1]] != e:
            rewritten.add(e[1])
        slots.setdefault(e[1], e)
    stage, inputs, content, resolutions, by, approved, used, n = None, None, None, {}, {}, False, set(), 0
    corrupt = 1 not in slots
    while n + 1 in slots:
        n += 1
        _, _, kind, target, sha, pins, _, decision, status, given = slots[n]
        corrupt |= n in rewritten
        if n == 1:
            corrupt |= kind != "created"
            stage, inputs, content = "inspected", dict(pins or {}), sha
        elif kind == "stage" and stage in ALLOWED.get(target, []):
            stage = target
        elif kind == "engine_error" and stage == "execution_authorized":
            pass
        elif kind == "review" and stage == "review_required" and decision and decision not in used and status in ("approved", "cancelled"):
            used.add(decision)
            if status == "approved":
                corrupt |= any(f not in ("millage", "horizon") for f in given or {})
                resolutions |= given or {}
                by |= dict.fromkeys(given or {}, decision)
        elif kind == "execution_authorized" and stage == "canonical_ready" and sha is not None and sha == content and pins == inputs:
            stage, approved = "execution_authorized", True
        elif kind == "inputs_repinned" and pins is not None and all(inputs.get(k) == v for k, v in pins.items()):
            inputs = dict(pins)
        else:
            corrupt = True
        if corrupt:
            return None, None, None, None, None, None, None, True
    return (None,) * 7 + (True,) if corrupt else (stage, n, len(slots) - n, inputs, resolutions, by, approved, False)


def made(seed, count=60):
    rng = random.Random(seed)
    out = {}
    for r in range(count):
        run, events = f"r{r}", [created(f"r{r}", content=rng.choice(["c", "c", None]))]
        pins = dict(PINS)
        path = ["normalized", "review_required", "review", "review", "reconciled", "repin", "canonical_ready", "authorize", rng.choice(["engine_executed", "engine_error"]), "report_ready"]
        for step in path[: rng.randint(0, 10)]:
            n = len(events) + 1
            if step == "review":
                fields = {rng.choice(["millage", "horizon", "horizon", "rent" if rng.random() < 0.1 else "millage"]): str(n)}
                events.append(event(run, n, "review", decision=rng.choice([f"d{n}", f"d{n}", "d"]), status=rng.choice(["approved", "cancelled"]), resolutions=fields))
            elif step == "repin":
                pins = {k: v for k, v in pins.items() if rng.random() < 0.9} | ({"om": "9"} if rng.random() < 0.1 else {})
                events.append(event(run, n, "inputs_repinned", inputs=dict(pins)))
            elif step == "authorize":
                events.append(event(run, n, "execution_authorized", content=rng.choice(["c", "c", "c", "d"]), inputs=rng.choice([pins, pins, PINS])))
            elif step == "engine_error":
                events.append(event(run, n, "engine_error"))
            else:
                events.append(event(run, n, "stage", stage=step))
        dice = rng.random()
        if dice < 0.15 and len(events) > 2:
            events.pop(rng.randrange(len(events)))
        elif dice < 0.25:
            events.append(rng.choice(events))
        elif dice < 0.32:
            e = rng.choice(events)
            events.append((*e[:3], "other", *e[4:]))
        elif dice < 0.36:
            events.append(event(run, 20_000, "stage", stage="x"))
        elif dice < 0.4:
            events.append(event(run, len(events) + 1, rng.choice(["unheard", "created"])))
        out[run] = events
    return out


def rows_of(df):
    out = {}
    for r in df.collect():
        assert r.run_id not in out
        bad = r.error_code == "CORRUPT_INPUT"
        maps = [dict(m or {}) for m in (r.inputs, r.resolutions, r.resolved_by)]
        out[r.run_id] = (None,) * 7 + (True,) if bad else (r.stage, r.event_count, r.waiting, *maps, r.approved, False)
    return out


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_records_equal_a_walk(spark, seed):
    all_runs = made(seed)
    want = {run: walk(events) for run, events in all_runs.items() if any(1 <= e[1] <= 9999 for e in events)}
    events = [e for own in all_runs.values() for e in own] + [event(None, 1, "created"), event("x", None, "created")]
    df = spark.createDataFrame(events, workflow.EVENTS).repartition(5)
    got = rows_of(workflow.run_records(df))
    assert {r: got[r] for r in want} == want and set(got) == set(want)
    assert {w[7] for w in want.values()} == {True, False} and any(w[2] for w in want.values())
    assert workflow.run_records(df.limit(0)).collect() == []


@pytest.mark.parametrize("seed", [4, 5])
def test_shuffled_arrival_gives_the_batch_records(spark, tmp_path, seed):
    all_runs = made(seed, 40)
    events = [e for own in all_runs.values() for e in own]
    random.Random(seed).shuffle(events)
    target, checkpoint = f"{tmp_path}/out", f"{tmp_path}/checkpoint"
    for at in range(0, len(events), -(-len(events) // 4)):
        part = events[at : at + -(-len(events) // 4)]
        spark.createDataFrame(part, workflow.EVENTS).repartition(2).write.mode("append").parquet(f"{tmp_path}/in")
        stream = spark.readStream.schema(schemas.contract(workflow.EVENTS)).parquet(f"{tmp_path}/in")
        runs.write_states(runs.run_states(stream), target, checkpoint, "update").awaitTermination()
    got = rows_of(runs.last_states(spark.read.parquet(target)))
    assert got == rows_of(workflow.run_records(spark.createDataFrame(events, workflow.EVENTS)))


def test_blockers_keep_who_resolved_them(spark):
    review = [event("a", 2, "stage", stage="normalized"), event("a", 3, "stage", stage="review_required")]
    review += [event("a", 4, "review", decision="d1", status="approved", resolutions={"millage": "2"}), event("a", 5, "review", decision="d2", status="cancelled", resolutions={"horizon": "9"})]
    ready = [event("b", n + 2, "stage", stage=s) for n, s in enumerate(["normalized", "reconciled", "canonical_ready"])]
    ready += [event("b", 5, "execution_authorized", content="c", inputs=PINS)]
    few = {k: PINS[k] for k in ("om", "rr", "t12")}
    events = [created("a"), *review, created("b", values={"millage": "1", "horizon": "5"}), *ready]
    events += [created("c", inputs=few, values={"millage": "1", "horizon": "5"}), created("d", values={"millage": "1", "horizon": "5"}), event("e", 1, "stage", stage="normalized")]
    live = [(r, k, v, "pdf") for r in "abcd" for k, v in PINS.items() if (r, k) not in {("b", "rr"), ("d", "om")}]
    live += [("b", "rr", "changed", "pdf"), ("d", "om", "1", "docx"), ("d", "unpinned", "x", "docx"), (None, "om", "1", "pdf")]
    records = workflow.run_records(spark.createDataFrame(events, workflow.EVENTS))
    out = workflow.run_blockers(records, spark.createDataFrame(live, "run_id string, name string, sha256 string, format string"))
    got = {r.run_id: (r.outcome, r.error_code, None if r.blockers is None else [tuple(b) for b in r.blockers]) for r in out.collect()}
    assert got == {
        "a": ("needs_review_or_data", None, [("millage", "pending_human_action", "d1"), ("horizon", "pending_human_action", None)]),
        "b": (None, "STALE", None),
        "c": ("needs_review_or_data", None, [("debt", "pending_human_action", None)]),
        "d": ("unsupported_input", None, [("om", "unsupported_engineering", None)]),
        "e": (None, "CORRUPT_INPUT", None),
    }


def test_a_silent_feed_turns_stale(spark, tmp_path):
    start = date(2024, 1, 1)
    parts = [
        [("a", start), ("b", start), ("c", start - timedelta(80))],
        [("a", start + timedelta(45)), ("a", start)],
        [("a", start + timedelta(46)), (None, start), ("x", None)],
        [("b", start + timedelta(40)), ("a", start + timedelta(60))],
    ]
    seen = []
    for part in parts:
        spark.createDataFrame([(*x, 1, 1, 1) for x in part], schemas.SNAPSHOT_STREAM).write.mode("append").parquet(f"{tmp_path}/in")
        stream = spark.readStream.schema(schemas.contract(schemas.SNAPSHOT_STREAM)).parquet(f"{tmp_path}/in")
        runs.write_states(runs.feed_alerts(stream), f"{tmp_path}/out", f"{tmp_path}/checkpoint").awaitTermination()
        rows = {(r.property_id, (r.as_of - start).days, r.freshness) for r in spark.read.parquet(f"{tmp_path}/out").collect()}
        seen.append(rows - set().union(*seen))
    assert seen[0] == {("a", 0, "current"), ("b", 0, "current"), ("c", -80, "current"), ("c", -80, "stale")}
    assert seen[1] == {("a", 45, "current")}
    assert seen[2] == {("a", 46, "current"), ("b", 0, "stale")}
    assert seen[3] == {("a", 60, "current"), ("b", 40, "current")}
