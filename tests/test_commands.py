"""Append commands as a stream against a walk over the same commands in Python."""

import random
from datetime import date, datetime, timedelta
from decimal import Decimal

import pytest

from rentloom import schemas
from rentloom.streaming import commands

START = datetime(2026, 1, 1)


def command(event, agg="a", key="k", value=1, source=None, at=0, prior=None, expected=None, revision=1, start=date(2026, 1, 1), end=None, space="w"):
    at = None if at is None else START + timedelta(minutes=at)
    return (space, agg, key, Decimal(value), start, end, at, event, "s", source or f"r{event}", revision, prior, expected)


def walk(batches):
    """event id, verdict, error and version of every command, in the rules' own words."""
    streams, out = {}, []
    for batch in batches:
        for c in sorted(batch, key=lambda c: (str(c[1]), c[6] or START, -1 if c[7] is None else c[7])):
            space, agg, key, value, start, end, at, event, system, record, revision, prior, expected = c
            if not all((space, agg, key, system, record)) or None in (revision, event, at):
                out.append((event, "refused", "INVALID_SCOPE", None))
                continue
            if expected is not None and expected < 0 or start is None or end is not None and end <= start:
                out.append((event, "refused", "INVALID_VERSION" if expected is not None and expected < 0 else "INVALID_INTERVAL", None))
                continue
            s = streams.setdefault((space, agg), {"version": 0, "last": None, "sources": {}, "facts": {}})
            content = (key, value, start, end, prior)
            held = s["sources"].get((system, record, revision))
            if held:
                out.append((event, "replay", None, held[1]) if held[0] == content else (event, "conflict", "SOURCE_REVISION_CHANGED", None))
                continue
            error = None
            if expected is not None and expected != s["version"]:
                error = "OBSOLETE_VERSION"
            elif event in s["facts"]:
                error = "EVENT_ID_REUSED"
            elif prior is not None and prior not in s["facts"]:
                error = "UNKNOWN_TARGET"
            elif prior is not None and s["facts"][prior][0] != key:
                error = "KEY_CHANGED"
            elif prior is not None and s["facts"][prior][1]:
                error = "SECOND_CORRECTION"
            elif s["last"] is not None and at < s["last"]:
                error = "CLOCK_BACKWARD"
            if error:
                out.append((event, "conflict", error, None))
                continue
            s["version"] += 1
            s["last"] = at
            s["sources"][system, record, revision] = (content, s["version"])
            s["facts"][event] = [key, False]
            if prior is not None:
                s["facts"][prior][1] = True
            out.append((event, "new", None, s["version"]))
    return sorted(map(str, out))


def run(spark, path, batches):
    for batch in batches:
        spark.createDataFrame(batch, commands.COMMANDS).repartition(3).write.mode("append").parquet(f"{path}/in")
        commands.append_commands(commands.read_commands(spark, f"{path}/in"), f"{path}/out", f"{path}/checkpoint").awaitTermination()
    rows = spark.read.parquet(f"{path}/out").collect()
    return sorted(str((r.event_id, r.verdict, r.error_code, r.version)) for r in rows), rows


def test_each_rule_has_its_row(spark, tmp_path):
    first = [command(1, at=1, expected=0), command(2, at=2, expected=1), command(3, at=3, expected=1), command(4, agg="b", at=9)]
    second = [
        command(1, at=1, expected=0), command(5, source="r2", value=7, at=3), command(6, prior=99, at=4), command(7, key="other", prior=1, at=4),
        command(8, prior=1, at=5, expected=2), command(9, prior=1, at=6), command(10, agg="b", at=8), command(2, source="x", at=7), command(11, agg="b", prior=4, at=9),
    ]
    third = [
        command(12, agg=None), command(13, agg=""), command(14, key=None), command(15, expected=-1), command(16, end=date(2026, 1, 1)),
        command(17, at=None), command(None), command(18, start=None), command(19, agg="c", prior=1), command(20, revision=None), command(8, prior=1, at=5),
    ]
    got, rows = run(spark, str(tmp_path), [first, second, third])
    assert got == walk([first, second, third])
    assert {r.error_code for r in rows} == {
        None, "OBSOLETE_VERSION", "SOURCE_REVISION_CHANGED", "UNKNOWN_TARGET", "KEY_CHANGED", "SECOND_CORRECTION", "CLOCK_BACKWARD",
        "EVENT_ID_REUSED", "INVALID_SCOPE", "INVALID_VERSION", "INVALID_INTERVAL",
    }
    assert {r.event_id for r in commands.accepted(spark, f"{tmp_path}/out").collect()} == {1, 2, 4, 8, 11}
    kept = {r.event_id: r for r in rows if r.verdict == "new"}
    assert kept[8].value == Decimal(1) and kept[8].supersedes_event_id == 1 and kept[8].recorded_at == START + timedelta(minutes=5)


@pytest.mark.parametrize("seed", [1, 2])
def test_random_commands_equal_a_walk(spark, tmp_path, seed):
    rng = random.Random(seed)
    batches, event = [], 0
    for b in range(4):
        batch = []
        for _ in range(60):
            event += 1
            agg = "big" if rng.random() < 0.6 else f"a{rng.randrange(4)}"
            prior = rng.randint(1, event) if rng.random() < 0.3 else None
            expected = rng.randint(0, 30) if rng.random() < 0.2 else None
            batch.append(command(event, agg, f"k{rng.randrange(2)}", rng.randrange(3), f"r{rng.randint(1, 150)}", 50 * b + rng.randint(-10, 60), prior, expected))
        batches.append(batch)
    assert run(spark, str(tmp_path), batches)[0] == walk(batches)


def test_a_second_run_over_the_same_input_adds_nothing(spark, tmp_path):
    got, _ = run(spark, str(tmp_path), [[command(1), command(2, at=1)]])
    commands.append_commands(commands.read_commands(spark, f"{tmp_path}/in"), f"{tmp_path}/out", f"{tmp_path}/checkpoint").awaitTermination()
    assert spark.read.parquet(f"{tmp_path}/out").count() == len(got) == 2


def test_contract_has_all_fact_columns():
    assert commands.COMMANDS.startswith(schemas.ASSERTIONS)
