"""Unit facts with skipped rows, continuations and bounded evidence; the greedy packet walk against Python."""

import random

import pytest
from pyspark.sql import functions as F

from rentloom.operators import documents, rentroll

COLUMNS = "source_id string, sheet int, row int, unit_id string, status string, unit_type string, record_type string"


def unit(row, unit_id, status="Occupied", kind="Apartment", record=None, source="s", sheet=1):
    return (source, sheet, row, unit_id, status, kind, record)


ROWS = [
    unit(1, "101"), unit(2, "101", "who knows"), unit(3, "101"),
    unit(1, "102"), unit(2, "102", "Vacant"), unit(3, "102"),
    unit(1, "103", "who knows"), unit(2, "103", kind="castle"),
    unit(2, "104", "Vacant", "Retail"), unit(3, "104", None, "", "Charge"), unit(4, "104", None, "Retail", "co-tenant"), unit(5, "104", "who", None, "charge"),
    unit(1, "105", None, None, "charge"), unit(2, "105"), unit(9, "106", None, None, "charge"), unit(3, "106", sheet=2),
    unit(2, "107"), unit(3, "107", "Vacant", None, "charge"), unit(1, "bad unit"),
]


def facts(spark, rows=ROWS, parts=3):
    return rentroll.unit_rows(spark.createDataFrame(rows, COLUMNS).repartition(parts))


@pytest.mark.parametrize("parts", [1, 7])
def test_good_rows_stand_beside_refused_ones(spark, parts):
    got = {r.unit_id: (r.status, r.unit_use, r.evidence_rows, r.skipped_rows, r.error_code) for r in rentroll.unit_dedupe(facts(spark, parts=parts)).collect()}
    assert got == {
        "101": ("occupied", "residential", 2, 1, None),
        "102": (None, None, 3, 0, "DUPLICATE_UNIT_CONFLICT"),
        "103": (None, None, 0, 2, "UNSUPPORTED_UNIT_TYPE"),
        "104": ("vacant", "commercial", 3, 1, None),
        "105": ("occupied", "residential", 1, 1, None),
        "106": ("occupied", "residential", 1, 1, None),
        "107": (None, None, 2, 0, "DUPLICATE_UNIT_CONFLICT"),
        "bad unit": (None, None, 0, 1, "INVALID_UNIT_ID"),
    }


def test_a_skipped_row_keeps_the_inventory_open(spark):
    good = rentroll.unit_counts(rentroll.unit_dedupe(facts(spark, [unit(1, "101"), unit(2, "102", "Vacant")])))
    open_ = rentroll.unit_counts(rentroll.unit_dedupe(facts(spark, [unit(1, "101"), unit(2, "101", "who knows")])))
    assert {(r.scope, r.total, r.error_code) for r in good.collect()} == {("residential", 2, None), ("unknown", 2, None)}
    assert {(r.total, r.error_code) for r in open_.collect()} == {(None, "INVENTORY_INVALID")}


def test_evidence_is_bounded_and_flagged(spark):
    got = {r.unit_id: r for r in rentroll.unit_evidence(facts(spark), 1).collect()}
    assert [tuple(x) for x in got["101"].evidence] == [(1, 1)] and got["101"].evidence_truncated
    assert [tuple(x) for x in got["101"].issues] == [(1, 2, "UNSUPPORTED_STATUS")] and not got["101"].issues_truncated
    assert [tuple(x) for x in got["105"].issues] == [(1, 1, "ORPHAN_CONTINUATION")]
    assert got["103"].evidence is None and got["103"].issues_truncated
    assert rentroll.unit_evidence(facts(spark).limit(0)).collect() == []


def greedy(sizes, budget):
    out = []
    for n in sizes:
        fits = n is not None and n <= budget
        budget -= n if fits else 0
        out.append(fits)
    return out


@pytest.mark.parametrize("block", [1, 3, 256])
def test_packet_walk_equals_python(spark, monkeypatch, block):
    monkeypatch.setattr(documents, "FIT_BLOCK", block)
    rng = random.Random(block)
    texts = [[None if rng.random() < 0.1 else "x" * rng.choice([0, 1, 5, 40]) for _ in range(rng.choice([0, 1, 2, 30, 300]))] for _ in range(40)]
    df = spark.createDataFrame(list(enumerate(texts)), "id int, lines array<string>")
    got = {r.id: r.fit for r in df.select("id", documents._fits(F.col("lines"), 100).alias("fit")).collect()}
    assert got == {i: greedy([None if x is None else len(x) for x in t], 100) for i, t in enumerate(texts)}


def test_no_document_goes_to_python(spark):
    docs = spark.createDataFrame([(1, "a\nb")], "doc_id long, text string")
    assert "Python" not in documents.packet_lines(docs)._jdf.queryExecution().executedPlan().toString()
