"""The append rules keep state in pages: calls to the state store against a walk, with pages that split and are written early."""

import json
import random
from datetime import timedelta

import pytest
from pyspark.sql import Row

from rentloom.streaming import commands
from tests.test_commands import START, command, walk

IN = Row("slot", "row_json")


class Store:
    """Stands for the state store of one slot and counts its calls."""

    def __init__(self):
        self.entries, self.calls = {}, 0

    def getMapState(self, name, key, value):
        return self

    def head(self, aggregate="a"):
        return self.entries.get(("w", aggregate))

    def pages(self, aggregate="a"):
        return [json.loads(value[0]) for key, value in self.entries.items() if len(key) == 3 and key[:2] == ("w", aggregate)]

    def getValue(self, key):
        self.calls += 1
        return self.entries.get(key)

    def updateValue(self, key, value):
        self.calls += 1
        self.entries[key] = value


def told(c):
    space, agg, key, value, start, end, at, event, system, record, revision, prior, expected = c
    row = {"workspace_id": space, "aggregate_id": agg, "key": key, "event_id": event, "source_system": system, "source_record": record, "source_revision": revision}
    row |= {k: v for k, v in (("supersedes_event_id", prior), ("expected_version", expected)) if v is not None}
    row["_mark"] = {"sha256": str((key, value, start, end, prior)), "recorded_us": int((at - START).total_seconds())}
    return IN(0, json.dumps(row))


def judge(store, batches):
    rules, out = commands.AppendRules(), []
    rules.init(store)
    for batch in batches:
        for d in rules.handleInputRows((0,), iter([told(c) for c in batch]), None):
            out.append((json.loads(d.row_json)["event_id"], d.verdict, d.error_code, d.version))
    return sorted(map(str, out))


@pytest.mark.parametrize("facts, at_once", [(1, 1), (3, 2), (5, 512), (64, 512)])
def test_pages_of_any_size_judge_like_the_walk(monkeypatch, facts, at_once):
    monkeypatch.setattr(commands, "PAGE_FACTS", facts)
    monkeypatch.setattr(commands, "PAGES_AT_ONCE", at_once)
    monkeypatch.setattr(commands, "ROWS_A_PAGE", 1 << 30)
    rng, batches, event = random.Random(facts), [], 0
    for b in range(6):
        batch = []
        for _ in range(80):
            event += 1
            number = rng.randint(1, event) if rng.random() < 0.1 else event
            at = 60 * b + rng.randint(-5, 60)
            # Two commands with one time and one number are taken by content, which the walk does not know.
            if any((c[6], c[7]) == (START + timedelta(minutes=at), number) for c in sum(batches, batch)):
                continue
            prior = rng.randint(1, event) if rng.random() < 0.4 else None
            expected = rng.randint(0, 60) if rng.random() < 0.1 else None
            batch.append(command(number, rng.choice("aaab"), f"k{rng.randrange(2)}", rng.randrange(3), f"r{rng.randint(1, 400)}", at, prior, expected))
        batches.append(batch)
    store = Store()
    got = judge(store, batches)
    assert got == walk(batches)
    for agg in "ab":
        version, _, first = store.head(agg)
        assert len(json.loads(first)) + sum(map(len, store.pages(agg))) == 2 * version
        assert len(store.pages(agg)) == -(-version // facts) - 1


def test_a_batch_is_few_calls_to_the_state_store():
    store = Store()
    first = [command(n, at=n) for n in range(1, 61)]
    judge(store, [first])
    assert store.head()[0] == 60 and store.calls == 2
    judge(store, [[command(n, at=n) for n in range(1, 61)]])  # all of them again: nothing is written
    assert store.head()[0] == 60 and store.calls == 3


def test_refused_commands_touch_no_state():
    store, rules = Store(), commands.AppendRules()
    rules.init(store)
    row = json.dumps({"aggregate_id": "a", "_mark": {"refusal": "INVALID_SCOPE"}})
    assert [tuple(d) for d in rules.handleInputRows((3,), iter([IN(3, row)]), None)] == [(row, None, "refused", "INVALID_SCOPE")]
    assert store.calls == 0


def test_one_page_more_moves_entries_of_one_page_only():
    names = [f"f{n}" for n in range(2000)]
    for pages in range(1, 40):
        moved = {(commands.page_of(x, pages), commands.page_of(x, pages + 1)) for x in names}
        moved = {(old, new) for old, new in moved if old != new}
        assert len(moved) <= 1 and all(new == pages for _, new in moved)
        assert {commands.page_of(x, pages) for x in names} == set(range(pages))
