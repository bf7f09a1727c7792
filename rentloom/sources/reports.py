"""Deterministic report exports. Records hold subject, period, tool, run_id, metrics, citations and blockers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rentloom.functions.refusal import any_of
from rentloom.functions.text import formula_unsafe
from rentloom.operators.governance import validate_report

WATERMARK = "<<BLOCKED: results are not complete; see blockers>>"
ROWS_PER_FILE = 500_000
CSV_COLUMNS = ["subject", "period", "metric", "amount", "currency", "citation", "watermark"]


def _watermark() -> Column:
    incomplete = F.exists(F.map_values("metrics"), lambda v: v.isNull())
    open_items = F.size(F.array_compact("blockers")) > 0
    return F.when(incomplete | open_items, WATERMARK)


def _sorted_metrics() -> Column:
    return F.array_sort(
        F.transform(
            F.map_entries("metrics"),
            lambda e: F.struct(
                e["key"].alias("metric"),
                e["value"]["amount"].alias("amount"),
                e["value"]["currency"].alias("currency"),
                F.try_element_at("citations", e["key"]).alias("citation"),
            ),
        )
    )


def report_rows(records: DataFrame) -> DataFrame:
    """One row per metric in name order. A refused record or a cell that would run as a formula gives a code and no
    figures; a metric without a value keeps empty cells and the watermark."""
    checked = validate_report(records).withColumns({"watermark": _watermark(), "m": F.explode(_sorted_metrics())})
    cells = [F.col("subject"), F.col("period"), F.col("m.metric"), F.col("m.citation")]
    code = F.when(F.size("issues") > 0, F.get("issues", F.lit(0))).when(
        any_of(*[formula_unsafe(c) for c in cells]), "INVALID_INPUT"
    )
    ok = F.col("error_code").isNull()
    return checked.withColumn("error_code", code).select(
        "subject",
        "period",
        "m.metric",
        F.when(ok, F.col("m.amount")).alias("amount"),
        F.when(ok, F.col("m.currency")).alias("currency"),
        F.when(ok, F.col("m.citation")).alias("citation"),
        "watermark",
        "error_code",
    )


def render_json(records: DataFrame) -> DataFrame:
    """One canonical JSON text per valid record, pinned to the record by its hash."""
    ok = validate_report(records).filter(F.size("issues") == 0).drop("issues")
    pin = F.sha2(F.to_json(F.struct(*sorted(ok.columns))), 256)
    rows = ok.withColumns({"source_record_sha256": pin, "watermark": _watermark(), "sorted": _sorted_metrics()})
    body = F.struct(
        F.col("sorted").alias("metrics"),
        "period",
        "run_id",
        "source_record_sha256",
        "subject",
        "tool",
        "watermark",
    )
    return rows.select("subject", "period", F.to_json(body, {"ignoreNullFields": "false"}).alias("value"))


def render_markdown(records: DataFrame) -> DataFrame:
    """One cited Markdown summary per valid record; a missing value reads as blocked, never as zero."""
    ok = validate_report(records).filter(F.size("issues") == 0)
    lines = F.transform(
        _sorted_metrics(),
        lambda m: F.when(
            m["amount"].isNull(), F.concat(F.lit("- "), m["metric"], F.lit(": blocked (no value; missing is not zero)"))
        ).otherwise(
            F.concat(
                F.lit("- "), m["metric"], F.lit(": "), m["amount"], F.lit(" "), m["currency"], F.lit(" (source: "),
                m["citation"], F.lit(")"),
            )
        ),
    )
    text = F.concat_ws(
        "\n",
        F.concat(F.lit("# Report: "), F.col("subject")),
        F.concat(F.lit("Period: "), F.col("period")),
        _watermark(),
        F.lit("## Metrics"),
        F.array_join(lines, "\n"),
        F.lit("Report generation is not permission to publish."),
    )
    return ok.select("subject", "period", text.alias("value"))


def publish_once(df: DataFrame, path: str, fmt: str, **options: str) -> None:
    """Write a deliverable; an output that already exists refuses."""
    df.write.mode("errorifexists").options(**options).format(fmt).save(path)


def write_report(records: DataFrame, path: str) -> None:
    """report (JSON lines), summary (Markdown text) and metrics (CSV), each globally ordered by subject and period."""
    for frame, name, fmt in (
        (render_json(records), "report", "text"),
        (render_markdown(records), "summary", "text"),
    ):
        publish_once(frame.orderBy("subject", "period").select("value"), f"{path}/{name}", fmt)
    rows = report_rows(records).filter("error_code is null").select(*CSV_COLUMNS)
    publish_once(rows.orderBy("subject", "period", "metric"), f"{path}/metrics", "csv", header="true")


# ---------------------------------------------------------------- ordered tables


def _file_keys(spark, path: str, keys: list[str]) -> DataFrame:
    """(file, rows, first_key, last_key, unsorted) of each data file as it is now, keys in the files' own row order."""
    key = F.struct(*keys)
    rows = spark.read.parquet(f"{path}/data").select(
        F.element_at(F.split("_metadata.file_path", "/"), -1).alias("file"), F.col("_metadata.row_index").alias("at"), key.alias("key")
    )
    # A file was written by one task, so its rows fit a window; they are compared with the row before.
    before = F.lag("key").over(Window.partitionBy("file").orderBy("at"))
    rows = rows.withColumn("falls", F.coalesce(F.col("key") < before, F.lit(False)))
    return rows.groupBy("file").agg(
        F.count("*").alias("rows"), F.min("key").alias("first_key"), F.max("key").alias("last_key"), F.count_if("falls").alias("unsorted")
    )


def files_for(rows: int, least: int = 1) -> int:
    """How many files an ordered table of so many rows takes, so that the rows one task sorts do not grow with the table."""
    return max(least, -(-rows // ROWS_PER_FILE))


def write_ordered(df: DataFrame, keys: list[str], path: str, files: int | None = None) -> None:
    """A table in global key order: ranges of keys, one sorted file each, and a manifest of every file's number, first and
    last key and row count. An output that already exists refuses."""
    ranged = df.repartitionByRange(files, *keys) if files else df.repartitionByRange(*keys)
    publish_once(ranged.sortWithinPartitions(*keys), f"{path}/data", "parquet")
    publish_once(_file_keys(df.sparkSession, path, keys).drop("unsorted"), f"{path}/manifest", "parquet")


def order_faults(spark, path: str, keys: list[str]) -> DataFrame:
    """(file, error_code) of everything that keeps ``path`` from being the ordered table its manifest describes.

    FILE_MISSING and FILE_UNKNOWN: files and manifest differ. FILE_CHANGED: other rows or keys than written, as after two
    files were swapped. FILE_UNSORTED: rows fall inside the file. FILES_OVERLAP: a file begins before the one in front ends.
    Empty means that reading the files by name gives the rows in key order."""
    told = spark.read.parquet(f"{path}/manifest").select("file", F.struct("rows", "first_key", "last_key").alias("told"))
    found = _file_keys(spark, path, keys)
    now = found.select("file", F.struct("rows", "first_key", "last_key").alias("now"), "unsorted")
    both = told.join(now, "file", "full_outer")
    # One row per file: the number of files is what the writing tasks were.
    ended = F.max("now.last_key").over(Window.orderBy("file").rowsBetween(Window.unboundedPreceding, -1))
    codes = F.array_compact(
        F.array(
            F.when(F.col("now").isNull(), "FILE_MISSING"),
            F.when(F.col("told").isNull(), "FILE_UNKNOWN"),
            F.when(F.col("told") != F.col("now"), "FILE_CHANGED"),
            F.when(F.col("unsorted") > 0, "FILE_UNSORTED"),
            F.when(F.col("now.first_key") < F.col("ended"), "FILES_OVERLAP"),
        )
    )
    return both.withColumn("ended", ended).select("file", F.explode(codes).alias("error_code"))
