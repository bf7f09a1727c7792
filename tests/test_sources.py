import pytest
from pyspark.errors import AnalysisException
from pyspark.sql import functions as F

from rentloom import schemas
from rentloom.operators import requests
from rentloom.sources import files, reports


def test_standardized_csv_and_cells(spark, tmp_path):
    folder = tmp_path / "oak park" / "Standardized"
    folder.mkdir(parents=True)
    head = "unit_id,floorplan_code,bed_type,bath_count,sqft,market_rent,lease_rent,status,as_of_date"
    (folder / "rent_roll.csv").write_text(f"{head}\nU1,A,1,1,700,1,1,occupied,2026-06-30\n")
    rows = files.read_standardized_csv(spark, str(tmp_path), "rent_roll").collect()
    assert [(r.asset_id, r.unit_id, r.status) for r in rows] == [("oak park", "U1", "occupied")]
    grid = tmp_path / "grid"
    grid.mkdir()
    (grid / "a.csv").write_text('Unit,"two\nlines"\n\n101,x\n')
    cells = {(c.row, c.row_end, c.column): c.text for c in files.read_cells(spark, str(grid)).collect()}
    assert cells == {(1, 2, 1): "Unit", (1, 2, 2): "two\nlines", (4, 4, 1): "101", (4, 4, 2): "x"}


def test_inventory(spark, tmp_path):
    deal = tmp_path / "d1"
    deal.mkdir()
    for name, data in {"a.pdf": b"%PDF-1.4", "b.xlsx": b"PK\x03\x04", "c.xls": bytes.fromhex("d0cf11e0a1b11ae1"), "d.csv": b"a,b\n", "e": b"\x00\x01"}.items():
        (deal / name).write_bytes(data)
    got = {r.container: r["count"] for r in files.inventory_files(files.read_binary(spark, str(tmp_path))).collect()}
    assert got == {"pdf": 1, "xlsx": 1, "xls": 1, "csv": 1, "unknown": 1}


def test_heads_read_the_first_bytes_only(spark, tmp_path):
    for deal in ("d1", "deal two"):
        (tmp_path / deal / "deeper").mkdir(parents=True)
        (tmp_path / deal / "a.pdf").write_bytes(b"%PDF-1.4" + bytes(500_000))
        (tmp_path / deal / "deeper" / "b é.csv").write_bytes(b"a,b\n" * 100)
        (tmp_path / deal / "none").write_bytes(b"")
    heads = files.read_heads(spark, str(tmp_path))
    got = {(r.deal, r.path.rsplit("/", 1)[1]): (r.length, bytes(r.content)) for r in heads.collect()}
    for deal in ("d1", "deal two"):
        assert got[deal, "a.pdf"] == (500_008, b"%PDF-1.4" + bytes(56))
        assert got[deal, "b é.csv"] == (400, b"a,b\n" * 16)
    assert len(got) == 4
    counts = {(r.deal, r.container): r["count"] for r in files.inventory_files(heads).collect()}
    assert counts == {(d, c): 1 for d in ("d1", "deal two") for c in ("pdf", "csv")}
    plan = heads._jdf.queryExecution().executedPlan().toString()
    scan = plan[plan.index("FileScan binaryFile") :].splitlines()[0]
    assert "length" in scan and "content" not in scan.split("ReadSchema: ")[1]


def test_opening_snapshot_is_strict(spark, tmp_path):
    path = tmp_path / "o.json"
    path.write_text('{"sequence":"x"}\n')
    with pytest.raises(Exception):
        files.read_opening_snapshot(spark, str(path)).collect()


def test_publish_once(spark, tmp_path):
    df = spark.range(3)
    reports.publish_once(df, str(tmp_path / "x"), "parquet")
    with pytest.raises(AnalysisException):
        reports.publish_once(df, str(tmp_path / "x"), "parquet")


def test_schema_contract_refuses(spark):
    df = spark.createDataFrame([("a", 1)], "id string, extra int")
    with pytest.raises(ValueError, match="extra"):
        requests.require_schema(df, schemas.contract("id string"))


def test_resident_columns_never_leave(spark):
    df = spark.createDataFrame([("PRIVATE_CANARY", "4000", "Rent")], "payee string, account_code string, account_name string")
    out = requests.search_transactions(df, "4000")
    assert "payee" not in out.columns and "PRIVATE_CANARY" not in str(out.collect())


def test_markdown_marks_missing_values(spark):
    money = F.struct(F.lit("1.00").alias("amount"), F.lit("USD").alias("currency"), F.lit("usd").alias("unit"), F.lit("p").alias("period"))
    df = spark.range(1).select(
        F.lit("deal").alias("subject"), F.lit("2026-01").alias("period"), F.lit("t").alias("tool"), F.lit("r").alias("run_id"),
        F.create_map(F.lit("noi"), money, F.lit("egi"), F.when(F.lit(False), money)).alias("metrics"),
        F.create_map(F.lit("noi"), F.lit("gl!1")).alias("citations"), F.expr("cast(array() as array<string>)").alias("blockers"),
    )
    text = reports.render_markdown(df).collect()[0].value
    assert "- egi: blocked (no value; missing is not zero)" in text and "- noi: 1.00 USD (source: gl!1)" in text
    assert reports.WATERMARK in text
