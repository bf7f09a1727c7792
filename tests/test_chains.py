"""Hash chains: a walk over each chain as brute force, any number of partitions, and the shape of the plan."""

import random

import pytest
from pyspark.sql import functions as F

from rentloom.functions.skew import previous
from rentloom.operators import governance
from rentloom.session import cut_lineage

SCHEMA = "chain string, seq bigint, decision_id string, sha256 string, predecessor_sha256 string, supersedes array<string>, cells array<string>"


def planted(chains=4, length=60):
    rng, rows = random.Random(8), []
    for c in range(chains):
        head, made = None, []
        for n in range(length if c else 6 * length):
            seq, sha = 7 * n, f"{c}-{n}"
            supersedes, cells = [], [rng.choice("xyz")]
            if made and rng.random() < 0.3:
                prior = rng.choice(made)
                supersedes, cells = [prior[0]], prior[1] if rng.random() < 0.8 else ["other"]
            if rng.random() < 0.03:
                supersedes = ["nowhere"]
            rows.append((f"c{c}", seq, f"d{n}", sha, head if rng.random() > 0.05 else "broken", supersedes, cells))
            made.append((sha, cells))
            head = sha
        for n in range(0, length, 9):
            again = list(rows[-1 - n])
            again[1] += 100_000
            if n == 18:
                again[3] = "rewritten"
            rows.append(tuple(again))
    return rows


def walk(rows):
    first, out = {}, {}
    for r in sorted(rows, key=lambda r: r[1]):
        first.setdefault((r[0], r[2]), []).append(r)
    by_chain = {}
    for (chain, _), copies in first.items():
        by_chain.setdefault(chain, []).append((copies[0], len({x[3] for x in copies}) > 1, len(copies)))
    for chain, kept in by_chain.items():
        kept.sort(key=lambda x: x[0][1])
        known = {x[0][3]: x[0] for x in kept}
        first_by = {}
        for r, _, _ in kept:
            for p in r[5]:
                first_by.setdefault(p, r[1])
        head = None
        for r, rewritten, copies in kept:
            priors = [known.get(p) for p in r[5]]
            code = (
                "DECISION_REWRITTEN" if rewritten
                else "BROKEN_CHAIN" if r[4] != head
                else "SUPERSEDES_UNKNOWN" if any(p is None or p[1] >= r[1] for p in priors)
                else "SUPERSEDES_INACTIVE" if any(first_by[p] < r[1] for p in r[5])
                else "SUPERSEDES_OTHER_CELLS" if any(sorted(p[6]) != sorted(r[6]) for p in priors)
                else None
            )
            out[chain, r[2]] = (r[1], r[3], copies, r[3] in first_by, code)
            head = r[3]
    return out


@pytest.mark.parametrize("parts", [1, 7, 200])
def test_chains_equal_a_walk_whatever_the_partitions(spark, parts):
    rows = planted()
    df = spark.createDataFrame(rows, SCHEMA).repartition(parts)
    got = governance.check_hash_chain(df, stage=cut_lineage).collect()
    want = walk(rows)
    assert {(r.chain, r.decision_id): (r.seq, r.sha256, r.copies, r.superseded, r.error_code) for r in got} == want
    assert len(got) == len(want)
    assert {x[4] for x in want.values()} == {
        None, "DECISION_REWRITTEN", "BROKEN_CHAIN", "SUPERSEDES_UNKNOWN", "SUPERSEDES_INACTIVE", "SUPERSEDES_OTHER_CELLS",
    }


def test_plan_of_a_staged_chain_is_short(spark):
    df = cut_lineage(spark.createDataFrame(planted(2, 20), SCHEMA))
    plan = governance.check_hash_chain(df, stage=cut_lineage)._jdf.queryExecution().sparkPlan().toString()
    plan += governance.check_hash_chain(df, stage=cut_lineage)._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
    assert plan.count("Exchange hashpartitioning") + plan.count("Exchange rangepartitioning") <= 6


def test_previous_over_many_small_chunks_and_sparse_rows(spark):
    rng = random.Random(5)
    rows = [(k, r, rng.choice([None, "a", "b"])) for k in "hhk" for r in rng.sample(range(10**6), 150)]
    rows = list({(k, r): (k, r, v) for k, r, v in rows}.values())
    df = spark.createDataFrame(rows, "k string, r bigint, v string").repartition(5)
    got = {(x.k, x.r): x.p for x in previous(df, ["k"], "r", F.col("v"), "p", chunk=5_000).collect()}
    assert len(got) == len(rows)
    for k in "hk":
        before = None
        for _, r, v in sorted(x for x in rows if x[0] == k):
            assert got[k, r] == before
            before = v


def test_empty_and_null_chains(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert governance.check_hash_chain(empty).isEmpty()
    one = spark.createDataFrame([("c", 1, "d", "s", None, None, None)], SCHEMA)
    assert [(r.error_code, r.superseded) for r in governance.check_hash_chain(one).collect()] == [(None, False)]
