"""Facts as known at a table of queries against brute force: nulls, open ends, corrections, one huge aggregate."""

import random
from datetime import date, datetime, timedelta
from decimal import Decimal

import pytest

from rentloom.operators import ledger

SCHEMA = (
    "event_id long, workspace_id string, aggregate_id string, key string, value decimal(18,2), valid_from date, valid_to date, "
    "recorded_at timestamp, supersedes_event_id long, part string, level int, query_id string"
)
ASKED = "query_id long, workspace_id string, aggregate_id string, effective_at date, known_at timestamp, key string"
DAY = date(2023, 12, 25)


def made(seed, n, queries, span):
    rng = random.Random(seed)
    facts = []
    for i in range(n):
        start = DAY + timedelta(rng.randrange(span))
        end = rng.choice([None, start + timedelta(rng.randint(1, span)), start + timedelta(1), start, start - timedelta(3)])
        at = datetime(2024, 1, 1) + timedelta(hours=rng.randrange(24 * span))
        prior = rng.randrange(i) if i and rng.random() < 0.3 else None
        owner = "big" if rng.random() < 0.5 else f"a{rng.randrange(5)}"
        facts.append((i, "w", owner, f"k{rng.randrange(3)}", rng.randrange(100), start, end, at, prior, "x", 1, "y"))
    facts += [(n, "w", "big", "k0", 1, None, None, datetime(2024, 1, 1), None, "", 0, ""), (n + 1, "w", "big", "k0", 1, DAY, None, None, None, "", 0, "")]
    asked = []
    for q in range(queries):
        day = DAY + timedelta(rng.randint(-2, span + 2)) if rng.random() < 0.97 else None
        at = datetime(2024, 1, 1) + timedelta(hours=rng.randrange(24 * span)) if rng.random() < 0.97 else None
        asked.append((q, rng.choice(["w", "w", "other"]), rng.choice(["big", "a0", "a1", "a2", None, "nobody"]), day, at, "z"))
    return facts, asked


def brute(facts, asked):
    out = set()
    for q, space, owner, day, at, _ in asked:
        if day is None or at is None:
            continue
        seen = [f for f in facts if f[1] == space and f[2] == owner and f[5] and f[7] and f[7] <= at and f[5] <= day and (f[6] is None or day < f[6])]
        gone = {f[8] for f in seen}
        kept = [f for f in seen if f[0] not in gone]
        for key in {f[3] for f in kept}:
            own = [f for f in kept if f[3] == key]
            out.add((q, space, owner, key, len(own), str(own[0][4]) if len(own) == 1 else None, "CONFLICT" if len(own) > 1 else None))
    return out


def answer(df):
    rows = df.collect()
    got = {(r.query_id, r.workspace_id, r.aggregate_id, r.key, r.facts, None if r.value is None else str(int(r.value)), r.error_code) for r in rows}
    assert len(got) == len(rows)
    return got


@pytest.mark.parametrize("span", [1, 2, 3, 40, 400])
@pytest.mark.parametrize("hot", [50_000, 25])
def test_query_table_equals_brute_force(spark, monkeypatch, span, hot):
    monkeypatch.setattr(ledger, "HOT_FACTS", hot)
    facts, asked = made(span, 220, 160, span)
    rows = spark.createDataFrame([(*f[:4], None if f[4] is None else Decimal(f[4]), *f[5:]) for f in facts], SCHEMA)
    got = answer(ledger.as_known_at(rows.repartition(5), spark.createDataFrame(asked, ASKED)))
    want = brute(facts, asked)
    assert want and got == want


def test_points_and_queries_agree(spark):
    facts, _ = made(9, 200, 0, 30)
    rows = spark.createDataFrame([(*f[:4], Decimal(f[4]), *f[5:]) for f in facts], SCHEMA).drop("part", "level", "query_id")
    day, at = date(2024, 1, 8), datetime(2024, 1, 20)
    owners = [("w", "big"), *(("w", f"a{i}") for i in range(5))]
    asked = spark.createDataFrame([(i, *o, day, at, "") for i, o in enumerate(owners)], ASKED)
    by_point = ledger.as_known(rows, [("p", day, at)]).drop("point")
    by_query = ledger.as_known_at(rows, asked).drop("query_id")
    assert ledger.same_rows(by_point, by_query.select(by_point.columns)).isEmpty() and by_query.count()


def test_empty_tables(spark):
    facts, asked = made(2, 5, 3, 10)
    rows = spark.createDataFrame([(*f[:4], Decimal(f[4]), *f[5:]) for f in facts], SCHEMA)
    queries = spark.createDataFrame(asked, ASKED)
    assert ledger.as_known_at(rows, queries.limit(0)).collect() == []
    assert ledger.as_known_at(rows.limit(0), queries).collect() == []


def test_join_is_an_equality(spark):
    facts, asked = made(3, 60, 40, 30)
    rows = spark.createDataFrame([(*f[:4], Decimal(f[4]), *f[5:]) for f in facts], SCHEMA)
    plan = ledger.as_known_at(rows, spark.createDataFrame(asked, ASKED))._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_multiplied_queries_are_never_broadcast(spark):
    """A query becomes one row a level and part; the estimate of its table does not tell, so the join must not trust it."""
    facts, asked = made(4, 60, 40, 400)
    rows = spark.createDataFrame([(*f[:4], Decimal(f[4]), *f[5:]) for f in facts], SCHEMA)
    plan = ledger.as_known_at(rows, spark.createDataFrame(asked, ASKED))._jdf.queryExecution().optimizedPlan().toString()
    met = [line for line in plan.splitlines() if "Join Inner" in line]
    assert met and all("rightHint=(strategy=merge)" in line for line in met)
