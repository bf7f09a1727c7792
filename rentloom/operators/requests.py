"""Requests against properties: names, periods, schemas and contexts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rentloom.functions.period import PERIOD
from rentloom.functions.refusal import failed, first_failure

# Words that ask for many properties at once, and contexts that never back a figure.
AGGREGATE_TOKENS = ["all", "*", "portfolio", "total", "all_properties"]
UNCERTIFIED_CONTEXTS = ["forge"]
ASSET = r"^[A-Za-z0-9][A-Za-z0-9_.-]{0,119}$"


def normalize_asset(name: Column) -> Column:
    """Trimmed, lower case, spaces as underscores."""
    return F.regexp_replace(F.lower(F.trim(name)), " ", "_")


def validate_requests(requests: DataFrame) -> DataFrame:
    """Add ``error_code`` for requests(asset_id, period, as_of): one explicit asset, one month, no day before it."""
    start = F.try_to_date(F.concat("period", F.lit("-01")), "yyyy-MM-dd")
    bad = first_failure(
        (failed(F.col("asset_id").rlike(ASSET)), "INVALID_INPUT"),
        (F.lower("asset_id").isin(AGGREGATE_TOKENS), "INVALID_INPUT"),
        (failed(F.col("period").rlike(PERIOD)), "INVALID_INPUT"),
        (F.col("as_of") < start, "INVALID_INPUT"),
    )
    return requests.withColumn("error_code", bad)


def resolve_property(requests: DataFrame, properties: DataFrame) -> DataFrame:
    """Property id per requested asset: the exact id first, else the one property of that name or slug.

    None gives NOT_FOUND, several AMBIGUOUS_PROPERTY. Names are reduced to one row per spelling before the join."""
    ids = properties.select(F.col("id").alias("asset_id"), F.col("id").alias("by_id")).distinct()
    spellings = F.array_distinct(F.array(F.lower("name"), F.lower(F.regexp_replace("name", " ", "_"))))
    names = (
        properties.select("id", F.explode(spellings).alias("spelling"))
        .groupBy("spelling")
        .agg(F.min("id").alias("first_id"), F.max("id").alias("last_id"))
    )
    # The least and greatest id of a name tell one match from several; the ids are never gathered. A request is looked up
    # by both of its spellings in place, so equal requests stay separate rows.
    found = requests
    for n, spelling in enumerate((F.lower("asset_id"), normalize_asset(F.col("asset_id")))):
        side = names.select(F.col("spelling").alias(f"_s{n}"), F.col("first_id").alias(f"_f{n}"), F.col("last_id").alias(f"_l{n}"))
        found = found.withColumn(f"_k{n}", spelling).join(side, F.col(f"_k{n}") == F.col(f"_s{n}"), "left")
    found = found.withColumn("first_id", F.least("_f0", "_f1")).withColumn("last_id", F.greatest("_l0", "_l1"))
    found = found.join(ids, "asset_id", "left")
    exact, several = F.col("by_id").isNotNull(), F.col("first_id") != F.col("last_id")
    code = F.when(~exact, F.when(F.col("first_id").isNull(), "NOT_FOUND").when(several, "AMBIGUOUS_PROPERTY"))
    key = F.coalesce("by_id", F.when(~several, F.col("first_id")))
    return found.select(*requests.columns, key.alias("property_id"), code.alias("error_code"))


def require_schema(df: DataFrame, contract: T.StructType) -> DataFrame:
    """The frame in contract order; missing, extra or differently typed columns refuse before any job runs."""
    have = {f.name: f.dataType for f in df.schema}
    want = {f.name: f.dataType for f in contract}
    if have != want:
        extra, missing = sorted(set(have) - set(want)), sorted(set(want) - set(have))
        wrong = sorted(n for n in set(have) & set(want) if have[n] != want[n])
        raise ValueError(f"INVALID_CONTRACT: extra={extra} missing={missing} type={wrong}")
    return df.select(*contract.fieldNames())


def filter_uncertified(df: DataFrame, context: str = "context") -> DataFrame:
    return df.filter(F.col(context).isNull() | ~F.col(context).isin(UNCERTIFIED_CONTEXTS))


def duplicate_keys(df: DataFrame, keys: list[str]) -> DataFrame:
    """Keys that occur more than once."""
    return df.groupBy(*keys).agg(F.count("*").alias("copies")).filter("copies > 1")


def search_transactions(gl: DataFrame, account: str | None = None, text: str | None = None) -> DataFrame:
    """Ledger lines by account and words in the account name, without person columns."""
    from rentloom.operators.rentroll import drop_pii

    out = drop_pii(gl)
    if account is not None:
        out = out.filter(F.col("account_code") == account)
    if text is not None:
        out = out.filter(F.lower("account_name").contains(text.lower()))
    return out
