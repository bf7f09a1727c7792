"""Session settings. On a cluster the submitter's settings win; nothing here overrides them."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def get_session(app_name: str = "rentloom", master: str | None = None, **conf: str) -> SparkSession:
    """Build (or reuse) a session with UTC time and adaptive execution."""
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    for key, value in {**DEFAULTS, **conf}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


class SharedFolderMissing(RuntimeError):
    """Staged tables need a folder that the driver and all executors see."""


def shared_folder(spark: SparkSession) -> str:
    """The folder that ``spark.checkpoint.dir`` names. Unset, a temporary one serves a local master only."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    local = spark.sparkContext.master.startswith("local[") or spark.sparkContext.master == "local"
    if base is None:
        if not local:
            raise SharedFolderMissing("SHARED_FOLDER_MISSING: set spark.checkpoint.dir to a folder all executors share")
        base = tempfile.mkdtemp(prefix="rentloom-")
        spark.conf.set("spark.checkpoint.dir", base)
    return base.rstrip("/")


def cut_lineage(df: DataFrame) -> DataFrame:
    """The table written once as Parquet to the shared folder and read again; columns can be pruned by later reads."""
    path = scratch_dir(df.sparkSession, "stage")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def scratch_dir(spark: SparkSession, name: str) -> str:
    """A new folder below the shared one the cluster names."""
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
