"""Occupancy: snapshots, as-of lookup, change against the previous date, and counts from unit rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from rentloom.functions.metrics import feed_age, occupancy_check
from rentloom.functions.refusal import all_failures, any_of, clean_text, failed

# Words that mark a unit as vacant in the standardized feed.
VACANCY_MARKERS = ["vacant", "vacancy", "available", "model", "admin", "down"]
COUNTS = ["occupied", "vacant", "down"]


def validate_snapshots(snaps: DataFrame, bound: str) -> DataFrame:
    """Add ``issues``: missing dates, dates after the bound, negative or missing counts, unusable source fields."""
    c = F.col
    return snaps.withColumn(
        "issues",
        all_failures(
            (c("as_of_date").isNull(), "INVALID_DATE"),
            (c("as_of_date") > F.to_date(F.lit(bound)), "AFTER_BOUND"),
            *[(failed(c(n) >= 0), f"INVALID_{n.upper()}") for n in COUNTS],
            (failed(clean_text(c("source_file"), 256)), "INVALID_SOURCE_FILE"),
            (failed(c("source_row") >= 0), "INVALID_SOURCE_ROW"),
            (failed(clean_text(c("id"), 128)), "INVALID_ID"),
        ),
    )


def daily_snapshots(snaps: DataFrame) -> DataFrame:
    """Newest snapshot per (property, date) by (created_at, id), with the previous date's snapshot beside it.

    The maximum over a struct combines before the shuffle; afterwards a property has at most one row per calendar
    day, which bounds every later window.
    """
    newest = (
        snaps.groupBy("property_id", "as_of_date")
        .agg(F.max(F.struct("created_at", "id", *COUNTS, "source_file", "source_row")).alias("s"))
        .select("property_id", "as_of_date", "s.*")
    )
    w = Window.partitionBy("property_id").orderBy("as_of_date")
    fields = F.struct("as_of_date", *COUNTS)
    return newest.withColumn("prior", F.lag(fields).over(w))


def latest_snapshot(snaps: DataFrame) -> DataFrame:
    """Newest snapshot per property by (as_of, created_at, id)."""
    newest = F.max(F.struct("as_of_date", "created_at", "id", *COUNTS, "source_file", "source_row"))
    return snaps.groupBy("property_id").agg(newest.alias("s")).select("property_id", "s.*")


def newest_snapshots(snaps: DataFrame, n: int = 1000) -> DataFrame:
    """Newest n snapshots per property, and ``truncated``: whether the property has older ones than these."""
    order = [F.col("as_of_date").desc(), F.col("created_at").desc(), F.col("id").desc()]
    mine = Window.partitionBy("property_id")
    ranked = snaps.withColumn("_rn", F.row_number().over(mine.orderBy(*order))).filter(F.col("_rn") <= n + 1)
    flagged = ranked.withColumn("truncated", F.max("_rn").over(mine) > n)
    return flagged.filter(F.col("_rn") <= n).drop("_rn")


def as_of_snapshot(requests: DataFrame, snaps: DataFrame, monthly: bool = False) -> DataFrame:
    """For each request (property_id, bound, …): the newest snapshot dated at or before the bound.

    Requests and daily snapshots are laid on one time line per property and the last snapshot is carried forward:
    one shuffle and no range join. Snapshots are first reduced to one row per (property, day), and so are the
    requests, so a line never has more rows than the calendar has days. ``monthly=True`` says the requests already
    are at most one per property and month; their columns then ride along and the join back is saved.
    """
    daily = daily_snapshots(snaps)
    current = F.struct("as_of_date", *COUNTS, "source_file", "source_row", "prior")
    line = daily.select(
        "property_id", F.col("as_of_date").alias("day"), F.lit(0).alias("turn"), current.alias("current")
    )
    asked = requests.select("property_id", F.col("bound").alias("day"), F.lit(1).alias("turn"))
    payload = [c for c in requests.columns if c not in ("property_id", "bound")]
    if monthly:
        asked = requests.select(
            "property_id", F.col("bound").alias("day"), F.lit(1).alias("turn"), F.struct(*payload).alias("asked")
        )
    line = line.unionByName(asked if monthly else asked.distinct(), allowMissingColumns=True)
    w = Window.partitionBy("property_id").orderBy("day", "turn").rowsBetween(Window.unboundedPreceding, 0)
    found = line.withColumn("current", F.last("current", ignorenulls=True).over(w)).filter("turn = 1")
    found = found.withColumnRenamed("day", "bound").drop("turn")
    if monthly:
        return found.select("property_id", "bound", "asked.*", "current")
    return requests.join(found, ["property_id", "bound"], "left")


def with_denominator(df: DataFrame, prefix: str = "") -> DataFrame:
    """Denominator = occupied + vacant + down, and the checked rate."""
    den = F.col(f"{prefix}occupied") + F.col(f"{prefix}vacant") + F.col(f"{prefix}down")
    checked = occupancy_check(
        F.col(f"{prefix}occupied"), F.col(f"{prefix}vacant"), F.col(f"{prefix}down"), den
    )
    return df.withColumns(
        {
            f"{prefix}denominator": den,
            f"{prefix}rate": checked["rate"],
            f"{prefix}error_code": checked["error_code"],
        }
    )


def occupancy_change(snaps: DataFrame) -> DataFrame:
    """Four deltas of each dated snapshot against the newest strictly older date; none is a code, not zero."""
    d = daily_snapshots(snaps)
    den = F.col("occupied") + F.col("vacant") + F.col("down")
    prior_den = F.col("prior.occupied") + F.col("prior.vacant") + F.col("prior.down")
    return d.select(
        "property_id",
        "as_of_date",
        *COUNTS,
        den.alias("denominator"),
        F.col("prior.as_of_date").alias("prior_as_of"),
        *[(F.col(c) - F.col(f"prior.{c}")).alias(f"{c}_change") for c in COUNTS],
        (den - prior_den).alias("denominator_change"),
        F.when(F.col("prior").isNull(), "OCCUPANCY_CHANGE_UNKNOWN").alias("error_code"),
    )


def latest_feed_age(snaps: DataFrame, review_day: str | None, bound: int = 45) -> DataFrame:
    """Newest snapshot date per property and its freshness on the review day."""
    day = F.to_date(F.lit(review_day)) if review_day else F.lit(None).cast("date")
    latest = snaps.groupBy("property_id").agg(F.max("as_of_date").alias("as_of"))
    age = feed_age(F.col("as_of"), day, bound)
    return latest.select("property_id", "as_of", age["age_days"].alias("age_days"), age["freshness"].alias("freshness"))


def unit_state(status: str = "status", resident: str | None = None, name: str | None = None):
    """occupied, vacant or down for one feed row; down wins, and no occupant with no status is vacant."""
    state = F.lower(F.trim(F.coalesce(F.col(status), F.lit(""))))
    blank = F.lit("")
    who = F.lower(F.trim(F.coalesce(F.col(resident), blank))) if resident else blank
    person = F.lower(F.trim(F.coalesce(F.col(name), blank))) if name else blank
    nobody = (who == "") & (person == "") & state.isin("", "vacant")
    return (
        F.when(any_of(state == "down", who == "down", person == "down"), "down")
        .when(
            any_of(
                state.isin(VACANCY_MARKERS), nobody, who.isin(VACANCY_MARKERS), person.isin(VACANCY_MARKERS)
            ),
            "vacant",
        )
        .otherwise("occupied")
    )


def four_counts(units: DataFrame, key: str = "property_id", **columns: str) -> DataFrame:
    """Occupied, vacant, down and their sum per property from unit rows; resident columns never leave."""
    state = unit_state(**columns)
    counted = units.select(key, state.alias("_state")).groupBy(key).agg(
        *[F.count_if(F.col("_state") == s).alias(s) for s in COUNTS]
    )
    return with_denominator(counted)
