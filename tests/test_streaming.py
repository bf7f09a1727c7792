from datetime import date, datetime
from decimal import Decimal

from pyspark.sql import functions as F

from rentloom import schemas
from rentloom.operators import ledger
from rentloom.streaming import ledger as stream


def fact(i, value, source="s", at=1, revision=1, agg="a"):
    return ("w", agg, f"k{i}", Decimal(value), date(2026, 1, 1), None, datetime(2026, 1, at), i, source, f"r{i}", revision, None)


def put(spark, path, rows):
    spark.createDataFrame(rows, schemas.ASSERTIONS).coalesce(1).write.mode("append").parquet(path)


def test_replay_conflict_and_late_facts(spark, tmp_path):
    src, target, clash, ck = (str(tmp_path / n) for n in ("in", "ledger", "clash", "ck"))
    put(spark, src, [fact(1, 10), fact(2, 20)])
    assert stream.resume_import(spark, src, target, clash, ck)
    put(spark, src, [fact(1, 10), fact(2, 21, at=9), fact(3, 20, source="other", at=2)])
    assert stream.resume_import(spark, src, target, clash, ck)
    rows = {r.event_id: (r.value, r.version) for r in spark.read.parquet(target).collect()}
    assert rows == {1: (Decimal(10), 1), 2: (Decimal(20), 2), 3: (Decimal(20), 3)}
    assert [r.event_id for r in spark.read.parquet(clash).collect()] == [2]
    before = spark.read.parquet(target).count()
    put(spark, src, [fact(4, 5, at=1)])
    assert stream.resume_import(spark, src, target, clash, ck)
    known = ledger.as_known(spark.read.parquet(target), [("p", date(2026, 1, 2), datetime(2026, 1, 1))])
    assert known.count() == 3 and before == 3


def test_same_batch_twice_appends_nothing(spark, tmp_path):
    target, clash = str(tmp_path / "t"), str(tmp_path / "c")
    batch = spark.createDataFrame([fact(1, 10), fact(1, 10), fact(2, 5)], schemas.ASSERTIONS)
    write = stream.append_batch(target, clash)
    write(batch, 0)
    write(batch, 0)
    assert spark.read.parquet(target).count() == 2


def test_reports_are_frozen_once(spark, tmp_path):
    src, target, ck = (str(tmp_path / n) for n in ("in", "out", "ck"))
    ddl = "workspace_id string, report_id string, aggregate_id string, content_json string"

    def issue(content):
        spark.createDataFrame([("w", "r1", "d", content)], ddl).write.mode("append").parquet(src)
        stream.freeze_reports(spark.readStream.schema(schemas.contract(ddl)).parquet(src), target, ck).awaitTermination()

    issue('{"noi":"100000"}')
    issue('{"noi":"85000"}')
    rows = ledger.read_report(spark.read.parquet(target)).collect()
    assert [(r.content_json, r.error_code) for r in rows] == [('{"noi":"100000"}', None)]
    refused = spark.read.parquet(f"{target}-refused").collect()
    assert [(r.report_id, r.content_json, r.error_code) for r in refused] == [("r1", '{"noi":"85000"}', "REPORT_ALREADY_ISSUED")]
    touched = spark.read.parquet(target).withColumn("content_json", F.lit("{}"))
    assert ledger.read_report(touched).collect()[0].error_code == "INTEGRITY_FAILED"
