"""The append-only ledger as streams. Facts are never dropped for lateness, so no watermark is set: an old fact is
appended with its own record time and only changes what is known from then on."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from rentloom import schemas
from rentloom.functions.skew import numbered
from rentloom.operators.ledger import SOURCE_KEY, command_hash, freeze_report

AGGREGATE = ["workspace_id", "aggregate_id"]


def _existing(spark: SparkSession, path: str) -> DataFrame | None:
    """The table at a path, or None where the path does not exist yet. Any other fault is raised, never taken for "new"."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not place.getFileSystem(spark._jsc.hadoopConfiguration()).exists(place):
        return None
    return spark.read.parquet(path)


def classify_batch(batch: DataFrame, accepted: DataFrame | None) -> DataFrame:
    """Rows of a batch as ``new``, ``replay`` or ``conflict`` by source key and content hash.

    Inside the batch the first (recorded_at, event_id) of a key stands. Equal amounts from another source are other
    facts. Only accepted keys that occur in the batch are looked at."""
    rows = batch.withColumn("command_sha256", command_hash())
    rows = rows.dropDuplicates([*SOURCE_KEY, "command_sha256", "recorded_at", "event_id"])
    first = rows.groupBy(*SOURCE_KEY).agg(
        F.min(F.struct("recorded_at", "event_id", "command_sha256")).alias("first")
    )
    marked = rows.join(first, SOURCE_KEY)
    if accepted is None:
        known = F.lit(None).cast("string")
    else:
        held = accepted.join(first.select(*SOURCE_KEY), SOURCE_KEY, "left_semi")
        marked = marked.join(held.select(*SOURCE_KEY, F.col("command_sha256").alias("held")), SOURCE_KEY, "left")
        known = F.col("held")
    is_first = F.struct("recorded_at", "event_id", "command_sha256") == F.col("first")
    standing = F.coalesce(known, F.col("first.command_sha256"))
    verdict = (
        F.when(F.col("command_sha256") != standing, "conflict")
        .when(known.isNull() & is_first, "new")
        .otherwise("replay")
    )
    return marked.withColumn("verdict", verdict).select(*rows.columns, "verdict")


def assign_version(new: DataFrame, accepted: DataFrame | None) -> DataFrame:
    """Next version numbers per aggregate for new facts, after the highest version accepted so far."""
    minute = F.date_trunc("minute", "recorded_at")
    rows = numbered(new, AGGREGATE, minute, [F.col("recorded_at"), F.col("event_id")], "step")
    if accepted is None:
        return rows.withColumn("version", F.col("step")).drop("step")
    top = accepted.groupBy(*AGGREGATE).agg(F.max("version").alias("top"))
    rows = rows.join(top, AGGREGATE, "left")
    return rows.withColumn("version", F.coalesce("top", F.lit(0)) + F.col("step")).drop("step", "top")


def stale_versions(commands: DataFrame, accepted: DataFrame) -> DataFrame:
    """Commands whose expected version is no longer the aggregate's highest."""
    top = accepted.groupBy(*AGGREGATE).agg(F.max("version").alias("top"))
    joined = commands.join(top, AGGREGATE, "left").withColumn("top", F.coalesce("top", F.lit(0)))
    return joined.withColumn("error_code", F.when(F.col("expected_version") != F.col("top"), "OBSOLETE_VERSION")).drop("top")


def append_batch(target: str, conflicts: str) -> Callable[[DataFrame, int], None]:
    """foreachBatch writer. A batch that runs again finds its own rows accepted and appends nothing.

    The decided batch is kept once for its two outputs; conflicts carry the batch number and replace only that
    number's folder."""

    def write(batch: DataFrame, number: int) -> None:
        accepted = _existing(batch.sparkSession, target)
        decided = classify_batch(batch, accepted).persist()
        try:
            clash = decided.filter("verdict = 'conflict'").drop("verdict")
            clash.write.mode("overwrite").parquet(f"{conflicts}/batch={number}")
            fresh = decided.filter("verdict = 'new'").drop("verdict")
            assign_version(fresh, accepted).write.mode("append").parquet(target)
        finally:
            decided.unpersist()

    return write


def read_assertion_stream(spark: SparkSession, path: str, files_per_batch: int = 100) -> DataFrame:
    return (
        spark.readStream.schema(schemas.contract(schemas.ASSERTIONS))
        .option("maxFilesPerTrigger", str(files_per_batch))
        .parquet(path)
    )


def ingest_assertions(stream: DataFrame, target: str, conflicts: str, checkpoint: str) -> StreamingQuery:
    """Run the ledger import over all available input in bounded batches; start again at any time to go on."""
    return (
        stream.writeStream.foreachBatch(append_batch(target, conflicts))
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def resume_import(
    spark: SparkSession, source: str, target: str, conflicts: str, checkpoint: str, files_per_batch: int = 1
) -> bool:
    """Import what is left, wait, and say whether every planned fact arrived exactly once."""
    ingest_assertions(read_assertion_stream(spark, source, files_per_batch), target, conflicts, checkpoint).awaitTermination()
    planned = spark.read.schema(schemas.contract(schemas.ASSERTIONS)).parquet(source).select(*SOURCE_KEY).distinct()
    stored = spark.read.parquet(target).groupBy(*SOURCE_KEY).agg(F.count("*").alias("copies"))
    bad = planned.join(stored, SOURCE_KEY, "full_outer").filter(F.col("copies").isNull() | (F.col("copies") > 1))
    return bad.isEmpty()


def freeze_reports(stream: DataFrame, target: str, checkpoint: str, refused: str | None = None) -> StreamingQuery:
    """Append each (workspace, report) once and refuse other content under an issued id.

    The same content again is a replay and changes nothing. Where one batch brings several contents for a new id, the
    one with the smallest hash is issued whatever the row order, and the others are refused. ``refused`` is the folder
    for refusals, one subfolder per batch; without it they go beside the target.
    """
    refused = refused or f"{target.rstrip('/')}-refused"
    key = ["workspace_id", "report_id"]

    def write(batch: DataFrame, number: int) -> None:
        issued = _existing(batch.sparkSession, target)
        contents = freeze_report(batch).dropDuplicates([*key, "content_sha256"])
        first = contents.groupBy(*key).agg(F.min("content_sha256").alias("standing"))
        if issued is not None:
            held = issued.select(*key, F.col("content_sha256").alias("held"))
            first = first.join(held, key, "left").select(*key, "held", F.coalesce("held", "standing").alias("standing"))
        else:
            first = first.withColumn("held", F.lit(None).cast("string"))
        decided = contents.join(first, key).persist()
        try:
            other = decided.filter(F.col("content_sha256") != F.col("standing")).drop("standing", "held")
            other = other.withColumn("error_code", F.lit("REPORT_ALREADY_ISSUED"))
            other.write.mode("overwrite").parquet(f"{refused}/batch={number}")
            new = decided.filter(F.col("held").isNull() & (F.col("content_sha256") == F.col("standing")))
            new.drop("standing", "held").write.mode("append").parquet(target)
        finally:
            decided.unpersist()

    return (
        stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    )
