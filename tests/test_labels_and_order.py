"""Label mappings by scope, and tables whose order can be proved."""

from pathlib import Path

import pytest
from pyspark.sql import functions as F

from rentloom.operators import statements
from rentloom.sources import reports

MAPPING = "source_id string, source_label string, canonical_account string, mapping_ref string"


def test_own_entries_stand_before_shared_ones_and_repeats_are_refused(spark):
    mapping = [
        (None, "Rent", "rent", "m1"), ("s1", "Rent", "own_rent", "m2"), (None, "Tax", "tax", "m3"), (None, "Tax", "tax", "m3"),
        ("s2", "Tax", "own_tax", "m4"), ("s1", "Fee", "a", "m5"), ("s1", "Fee", "b", "m6"), (None, "Fee", "fee", "m7"), (None, " ", "x", "m8"), (None, None, "x", "m9"), (None, "Blank", "", "m"),
    ]
    rows = [(s, label, i) for i, (s, label) in enumerate((s, n) for s in ("s1", "s2", None) for n in ("Rent", "rent", "Tax", "Fee", " ", None, "Blank"))]
    df = spark.createDataFrame(rows, "source_id string, source_label string, n int")
    got = {(r.source_id, r.source_label): (r.canonical_account, r.mapping_error) for r in statements.map_labels(df, spark.createDataFrame(mapping, MAPPING)).collect()}
    bad = (None, "INVALID_MAPPING")
    assert got == {
        ("s1", "Rent"): ("own_rent", None), ("s1", "rent"): (None, None), ("s1", "Tax"): bad, ("s1", "Fee"): bad, ("s1", " "): bad, ("s1", None): (None, None), ("s1", "Blank"): bad,
        ("s2", "Rent"): ("rent", None), ("s2", "rent"): (None, None), ("s2", "Tax"): ("own_tax", None), ("s2", "Fee"): ("fee", None), ("s2", " "): bad, ("s2", None): (None, None), ("s2", "Blank"): bad,
        (None, "Rent"): ("rent", None), (None, "rent"): (None, None), (None, "Tax"): bad, (None, "Fee"): ("fee", None), (None, " "): bad, (None, None): (None, None), (None, "Blank"): bad,
    }
    plain = spark.createDataFrame(mapping, MAPPING).drop("source_id").filter("source_label = 'Rent'")
    assert statements.map_labels(df, plain).count() == len(rows)


@pytest.mark.parametrize("files", [1, 4])
def test_order_is_proved_from_the_manifest(spark, tmp_path, files):
    path = str(tmp_path / "t")
    df = spark.range(500).select((F.col("id") * 37 % 101).alias("k"), F.when(F.col("id") % 9 > 0, F.col("id").cast("string")).alias("v"))
    reports.write_ordered(df, ["k", "v"], path, files)
    assert reports.order_faults(spark, path, ["k", "v"]).isEmpty()
    assert spark.read.parquet(f"{path}/data").count() == 500
    with pytest.raises(Exception, match="(?i)exist"):
        reports.write_ordered(df, ["k", "v"], path)
    parts = sorted(Path(path, "data").glob("part-*"))
    assert len(parts) == files
    if files > 1:
        held = parts[0].with_name("held")
        parts[0].rename(held), parts[1].rename(parts[0]), held.rename(parts[1])
        for crc in Path(path, "data").glob(".*.crc"):
            crc.rename(crc.with_suffix(".old"))
        codes = {r.error_code for r in reports.order_faults(spark, path, ["k", "v"]).collect()}
        assert codes == {"FILE_CHANGED", "FILES_OVERLAP"}
    extra = df.filter("k > 50").orderBy(F.desc("k")).coalesce(1)
    extra.write.mode("append").parquet(f"{path}/data")
    assert {"FILE_UNKNOWN", "FILE_UNSORTED"} <= {r.error_code for r in reports.order_faults(spark, path, ["k", "v"]).collect()}
