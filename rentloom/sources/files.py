"""Standardized CSV folders, cell grids, opening snapshots and file inventories."""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from rentloom import schemas

STANDARDIZED = {
    "rent_roll": schemas.RENT_ROLL_CSV,
    "budget_comparison": schemas.BUDGET_COMPARISON_CSV,
    "account_mappings_derived": schemas.MAPPINGS_CSV,
}
# First bytes of the known containers, as hex.
MAGIC = {"xls": "D0CF11E0A1B11AE1", "xlsx": "504B", "pdf": "255044462D"}

#: Cells, or characters of them, after which a task hands on what it has cut.
CELLS_AT_ONCE, CHARS_AT_ONCE = 20_000, 1 << 22


def read_standardized_csv(spark: SparkSession, root: str, name: str) -> DataFrame:
    """``{root}/<asset>/Standardized/{name}.csv`` of every asset; the asset comes from the path."""
    rows = (
        spark.read.schema(schemas.contract(STANDARDIZED[name]))
        .option("header", "true")
        .option("enforceSchema", "false")
        .csv(f"{root}/*/Standardized/{name}.csv")
    )
    asset = F.regexp_extract(F.col("_metadata.file_path"), r"/([^/]+)/Standardized/", 1)
    return rows.select(F.url_decode(asset).alias("asset_id"), "*")


def read_cells(spark: SparkSession, path: str, fmt: str = "csv") -> DataFrame:
    """Cell grid (source_id, sheet, row, row_end, column, text) with physical line numbers.

    Spark lists the CSV files and deals them out; each task reads its files as streams and cuts them into cells by the
    standard CSV reader, a bounded number of cells at a time, so quoted line breaks keep their lines and a file of any size
    fits. Parquet input already is a grid."""
    if fmt == "parquet":
        return spark.read.schema(schemas.contract(schemas.CELLS)).parquet(path)
    listed = spark.read.format("binaryFile").load(path)
    listed = listed.select(F.regexp_extract(F.col("_metadata.file_path"), r"([^/]+)$", 1).alias("source_id"), "path")
    schema = schemas.contract("source_id string, sheet int, row int, row_end int, column int, text string")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import csv
        import io

        arrow = to_arrow_schema(schema)

        def batch_of(cells: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*cells, strict=True), arrow.types, strict=True)], schema=arrow)

        for batch in batches:
            for source, at in zip(*(batch.column(c).to_pylist() for c in ("source_id", "path")), strict=True):
                base, full = _opened(at)
                with base.open_input_stream(full, compression="detect") as raw:
                    reader = csv.reader(io.TextIOWrapper(raw, encoding="utf-8-sig", newline=""), strict=True)
                    start, cells, size = 1, [], 0
                    for row in reader:
                        cells += [(source, 1, start, reader.line_num, i, c.strip()) for i, c in enumerate(row, 1)]
                        start, size = reader.line_num + 1, size + sum(map(len, row))
                        if len(cells) >= CELLS_AT_ONCE or size >= CHARS_AT_ONCE:
                            yield batch_of(cells)
                            cells, size = [], 0
                    if cells:
                        yield batch_of(cells)

    return listed.mapInArrow(cut, schema)


def _opened(path: str) -> tuple[fs.FileSystem, str]:
    """File system and path there of a file that Spark has listed."""
    scheme, _, rest = path.partition(":")
    host, at = rest[2:].split("/", 1) if rest.startswith("//") else ("", rest.lstrip("/"))
    return _system(scheme, host), f"{host}/{at}" if scheme in ("s3", "s3a", "gs") else f"/{at}"


@cache
def _system(scheme: str, host: str) -> fs.FileSystem:
    return fs.LocalFileSystem() if scheme == "file" else fs.FileSystem.from_uri(f"{scheme}://{host}/")[0]


def read_opening_snapshot(spark: SparkSession, path: str) -> DataFrame:
    """Opening rows from JSON lines with the exact schema; a malformed line stops the read."""
    return spark.read.schema(schemas.contract(schemas.OPENING)).option("mode", "FAILFAST").json(path)


def read_binary(spark: SparkSession, root: str) -> DataFrame:
    """Files below ``root`` as (deal, path, length, content); the deal is the first folder below the root."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    return files.select(
        F.regexp_extract("path", root.rstrip("/") + r"/([^/]+)/", 1).alias("deal"), "path", "length", "content"
    )


def read_heads(spark: SparkSession, root: str, size: int = 64) -> DataFrame:
    """Files below ``root`` as (deal, path, length, content), content being the first ``size`` bytes only.

    Spark lists the files and deals them out; their contents are no column of that scan. Each task then opens its files
    and reads the heads, so a file of gigabytes costs no more than a small one. Spark lists no empty files."""
    listed = read_binary(spark, root).select("deal", "path", "length")

    def heads(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for path in batch.column("path").to_pylist():
                base, full = _opened(path)
                with base.open_input_file(full) as file:
                    found.append(file.read(size))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found, pa.binary())], [*batch.schema.names, "content"])

    return listed.mapInArrow(heads, "deal string, path string, length bigint, content binary")


def container_of(content):
    """xls, xlsx, pdf or csv by the first bytes; anything else is unknown."""
    head = F.hex(F.substring(content, 1, 8))
    text = F.decode(F.substring(content, 1, 64), "ISO-8859-1")
    expr = F.when(F.lit(False), "")
    for name, magic in MAGIC.items():
        expr = expr.when(head.startswith(magic), name)
    return expr.when(text.contains(",") & ~text.rlike(r"[\x00-\x08]"), "csv").otherwise("unknown")


def inventory_files(files: DataFrame) -> DataFrame:
    """File counts per deal and container."""
    return files.select("deal", container_of(F.col("content")).alias("container")).groupBy("deal", "container").count()
