"""Chunked helpers against brute force, with one key that holds most rows and chunks far smaller than it."""

import random

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from rentloom.functions.hashing import group_digest
from rentloom.functions.skew import carry_forward, join_present, numbered, previous
from rentloom.operators import documents, ledger

rows_strategy = st.lists(
    st.tuples(st.sampled_from(["hot", "hot", "hot", "b"]), st.integers(0, 60), st.one_of(st.none(), st.sampled_from("xyz"))),
    min_size=1,
    max_size=40,
    unique_by=lambda r: (r[0], r[1]),
)
slow = settings(max_examples=6, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])


@slow
@given(rows=rows_strategy)
def test_carry_previous_and_numbering(spark, rows):
    df = spark.createDataFrame(rows, "k string, r int, v string").repartition(3)
    got = {(x.k, x.r): x.c for x in carry_forward(df, ["k"], "r", F.col("v"), "c", chunk=7).collect()}
    prev = {(x.k, x.r): x.c for x in previous(df, ["k"], "r", F.col("v"), "c", chunk=7).collect()}
    nums = {(x.k, x.r): x.n for x in numbered(df, ["k"], F.floor(F.col("r") / 7), [F.col("r")], "n").collect()}
    for k in {r[0] for r in rows}:
        last, before = None, None
        for i, (_, r, v) in enumerate(sorted(x for x in rows if x[0] == k), 1):
            last = v if v is not None else last
            assert got[k, r] == last and prev[k, r] == before and nums[k, r] == i
            before = v


def test_digest_ignores_order_and_partitions(spark):
    rows = [("hot", i) for i in range(3000)] + [("b", i) for i in range(10)]
    random.Random(4).shuffle(rows)
    df = spark.createDataFrame(rows, "k string, v int")
    one = {r.k: (r.d, r.row_count) for r in group_digest(df.coalesce(1), ["k"], F.col("v").cast("string"), "d").collect()}
    many = {r.k: (r.d, r.row_count) for r in group_digest(df.repartition(9), ["k"], F.col("v").cast("string"), "d").collect()}
    assert one == many and one["hot"][1] == 3000
    changed = df.withColumn("v", F.when((F.col("k") == "hot") & (F.col("v") == 7), 8).otherwise(F.col("v")))
    assert {r.k: r.d for r in group_digest(changed, ["k"], F.col("v").cast("string"), "d").collect()}["hot"] != one["hot"][0]


@slow
@given(lines=st.lists(st.text("abc ", max_size=12), min_size=1, max_size=15), budget=st.integers(0, 40))
def test_greedy_budget_matches_a_loop(spark, lines, budget):
    text = "\n".join(lines)
    df = spark.createDataFrame([(1, text)], "doc_id int, text string")
    got = [r.state for r in documents.packet_lines(df, budget).orderBy("line_no").collect()]
    used, want = 0, []
    body = text.splitlines()
    for line in body:
        ok = used + len(line) <= budget
        used += len(line) if ok else 0
        want.append("kept" if ok else "local_only")
    assert got == want


@slow
@given(codes=st.lists(st.sampled_from([None, None, "Rent Roll", "T12", "Loan Summary"]), min_size=1, max_size=25))
def test_section_spans_match_a_loop(spark, codes):
    pages = spark.createDataFrame([(1, i, (c or "x") + "\nbody") for i, c in enumerate(codes, 1)], "doc_id int, page int, text string")
    totals = spark.createDataFrame([(1, len(codes))], "doc_id int, total_pages int")
    got = {r.code: (r.page_start, r.page_end) for r in documents.section_spans(documents.first_heading(pages), totals).collect()}
    names = {"Rent Roll": "rent_roll", "T12": "t12", "Loan Summary": "debt_structure"}
    heads = [(i, names[c]) for i, c in enumerate(codes, 1) if c]
    want = {}
    for j, (page, code) in enumerate(heads):
        nxt = next((p for p, c in heads[j + 1 :] if c != code), None)
        end = max(page, (nxt - 1) if nxt else len(codes))
        a, b = want.get(code, (page, end))
        want[code] = (min(a, page), max(b, end))
    assert got == want


def test_null_keys_are_dealt_out_whatever_spark_folds(spark):
    hot = F.when(F.col("id") >= 0, "hot").alias("s")
    left = spark.range(2000).select(hot, "id", F.when(F.col("id") % 10 == 0, F.col("id") / 10).cast("bigint").alias("k"))
    right = left.select("s", F.col("id").alias("k"), (F.col("id") * 3).alias("found")).filter("k <> 7").hint("merge")
    coalesce = "spark.sql.adaptive.coalescePartitions.enabled"
    spark.conf.set(coalesce, "false")
    try:
        for scope in ([], ["s"]):
            other = right if scope else right.drop("s")
            out = join_present(left, other, "k", ["id"], scope)
            rows = out.select("id", "k", "found").collect()
            assert len(rows) == 2000 and all(r.found == (None if r.k is None or r.k == 7 else 3 * r.k) for r in rows)
            sizes = [r["count"] for r in out.groupBy(F.spark_partition_id()).count().collect()]
            assert sum(sizes) == 2000 and max(sizes) < 1000
    finally:
        spark.conf.unset(coalesce)


def test_events_of_a_hot_aggregate_that_correct_nothing_are_dealt_out(spark):
    fields = ["'w' as workspace_id", "if(id >= 0, 'hot', 'b') as aggregate_id", "id as event_id", "id + 1 as version", "'k' as key"]
    prior = "case when id in (8, 9) then 1L when id = 20 then 5000L end as supersedes_event_id"
    events = spark.range(2000).selectExpr(*fields, prior, "timestamp_seconds(id) as recorded_at")
    out = ledger.check_stream_version(events.filter("version <> 30"))
    assert {(r.event_id, *r.issues) for r in out.filter(F.size("issues") > 0).collect()} == {
        (8, "SECOND_CORRECTION"), (9, "SECOND_CORRECTION"), (20, "UNKNOWN_TARGET"), (30, "VERSION_GAP"),
    }
    joins = [x for x in out._jdf.queryExecution().optimizedPlan().toString().splitlines() if "Join LeftOuter" in x and "supersedes_event_id" in x]
    assert len(joins) == 2 and all(x.count("_spread#") == 2 for x in joins)
