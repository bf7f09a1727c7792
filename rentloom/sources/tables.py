"""Operating tables and hash-pinned cents revisions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rentloom import schemas
from rentloom.functions.hashing import canonical_json
from rentloom.functions.money import canonical_amount, cents_to_decimal, money_text

# The tables that are read. Resident transactions are not among them and are never opened.
OPS_TABLES = {
    "properties": schemas.PROPERTIES,
    "periods": schemas.PERIODS,
    "gl_actuals": schemas.GL,
    "gl_budgets": schemas.GL,
    "rent_roll_snapshots": schemas.SNAPSHOTS,
    "account_mappings": schemas.MAPPINGS,
}


def read_ops_tables(spark: SparkSession, root: str, fmt: str = "parquet", **options: str) -> dict[str, DataFrame]:
    """The operating tables with fixed schemas; only the columns of the contract are read."""
    out = {}
    for name, ddl in OPS_TABLES.items():
        schema = schemas.contract(ddl)
        reader = spark.read.format(fmt).options(**options)
        df = reader.schema(schema).load(f"{root}/{name}") if fmt != "jdbc" else reader.option("dbtable", name).load()
        out[name] = df.select(*schema.fieldNames())
    return out


def ledger(tables: dict[str, DataFrame]) -> DataFrame:
    """Actuals and budgets as one ledger with period labels and exact amounts; unusable amounts keep their code."""
    from rentloom.operators.ops import gl_with_period, union_kinds

    rows = gl_with_period(union_kinds(tables["gl_actuals"], tables["gl_budgets"]), tables["periods"])
    parsed = canonical_amount(F.col("amount"), "double")
    return rows.withColumns({"amount": parsed["amount"].cast("decimal(18,2)"), "amount_error": parsed["error_code"]})


def review_inputs(tables: dict[str, DataFrame]) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """Ledger, properties, snapshots and mappings in the form the review takes, from the tables as they are read.

    Snapshot dates are text there; one that is no ``yyyy-mm-dd`` day becomes NULL, which the snapshot rules refuse.
    """
    day = F.col("as_of_date")
    snapshots = tables["rent_roll_snapshots"].select(
        "id",
        "property_id",
        F.when(day.rlike(r"^\d{4}-\d{2}-\d{2}$"), day.try_cast("date")).alias("as_of_date"),
        *[F.col(f"{c}_units").alias(c) for c in ("occupied", "vacant", "down")],
        "source_file",
        "source_row",
        "created_at",
    )
    return ledger(tables), tables["properties"].select("id", "name", "unit_count"), snapshots, tables["account_mappings"]


def latest_revision(revisions: DataFrame) -> DataFrame:
    """Highest revision per (property, period)."""
    rest = [c for c in revisions.columns if c not in ("property", "period", "revision")]
    best = F.max_by(F.struct("revision", *rest), "revision")
    return revisions.groupBy("property", "period").agg(best.alias("r")).select("property", "period", "r.*")


def read_exact_revisions(revisions: DataFrame, gl: DataFrame) -> DataFrame:
    """Ledger rows of the latest revisions with cents as exact dollars; a missing cent value keeps a code."""
    newest = latest_revision(revisions).select(
        F.col("id").alias("revision_id"), F.col("property").alias("property_id"), "period", "created_at", "input_sha256"
    )
    rows = gl.join(newest, "revision_id")
    return rows.select(
        "property_id",
        "period",
        "kind",
        "account_code",
        "account_name",
        "category",
        cents_to_decimal(F.col("amount_cents")).cast("decimal(18,2)").alias("amount"),
        F.concat_ws(":", F.lit("exact"), "revision_id", "kind", "input_sha256").alias("source_file"),
        (F.col("ordinal") + 1).alias("source_row"),
        "created_at",
        F.concat_ws(":", "revision_id", "kind", F.col("ordinal").cast("string")).alias("id"),
        F.when(F.col("amount_cents").isNull(), "INVALID_CONTRACT").alias("error_code"),
    )


def _line() -> Column:
    return canonical_json(
        account_code=F.col("account_code"),
        account_name=F.col("account_name"),
        amount=money_text(cents_to_decimal(F.col("amount_cents"))),
        category=F.col("category"),
        kind=F.col("kind"),
        ordinal=F.lpad(F.col("ordinal").cast("string"), 9, "0"),
    )


def revision_digest(revisions: DataFrame, gl: DataFrame, snapshots: DataFrame) -> DataFrame:
    """SHA-256 per revision over its header, its snapshot and the digest of all its ledger lines.

    Lines are digested by sums of hash words (see ``group_digest``), so a revision of any length is safe."""
    from rentloom.functions.hashing import group_digest

    lines = group_digest(gl, ["revision_id"], _line(), "lines_sha256").drop("row_count")
    snap = snapshots.select(
        "revision_id",
        canonical_json(**{c: F.col(c) for c in ("as_of_date", "occupied_units", "vacant_units", "down_units")}).alias("snapshot"),
    )
    head = revisions.select(F.col("id").alias("revision_id"), "property", "period", "unit_count")
    body = head.join(lines, "revision_id", "left").join(snap, "revision_id", "left")
    names = ("property", "period", "unit_count", "lines_sha256", "snapshot")
    return body.select("revision_id", F.sha2(canonical_json(**{n: F.col(n) for n in names}), 256).alias("digest"))


def verify_revision_hash(revisions: DataFrame, gl: DataFrame, snapshots: DataFrame) -> DataFrame:
    """Revisions with INVALID_CONTRACT where the stored hash no longer matches. To be applied before any date filter,
    so that a moved or deleted snapshot cannot hide."""
    rebuilt = revision_digest(revisions, gl, snapshots)
    joined = revisions.join(rebuilt, revisions["id"] == rebuilt["revision_id"]).drop("revision_id")
    bad = ~F.col("digest").eqNullSafe(F.col("input_sha256"))
    return joined.withColumn("error_code", F.when(bad, F.lit("INVALID_CONTRACT"))).drop("digest")
