"""Bitemporal assertions, opening imports and double-entry postings.

Joins run on event ids or on (aggregate, version), which are unique, and groupings combine before they shuffle, so a
property with a third of all facts is spread like any other.
"""

from __future__ import annotations

from datetime import date, datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rentloom.functions.hashing import canonical_json
from rentloom.functions.money import opening_amount
from rentloom.functions.period import PERIOD
from rentloom.functions.refusal import clean_text, failed, first_failure
from rentloom.functions.skew import join_present

FACT_KEY = ["workspace_id", "aggregate_id", "key"]
SOURCE_KEY = ["workspace_id", "aggregate_id", "source_system", "source_record", "source_revision"]
Point = tuple[str, date, datetime]


def _points(points: list[Point]) -> Column:
    return F.array(
        *[
            F.struct(
                F.lit(name).alias("point"),
                F.lit(day).cast("date").alias("effective_at"),
                F.lit(instant).cast("timestamp").alias("known_at"),
            )
            for name, day, instant in points
        ]
    )


def active_facts(assertions: DataFrame, points: list[Point]) -> DataFrame:
    """Facts in force at each point (name, effective date, knowledge instant), corrections already applied.

    A correction hides the fact it names only while the correction itself is in force at the date, so the
    supersession is taken from the active rows, never from the whole stream.
    """
    inside = F.filter(
        _points(points),
        lambda p: (F.col("recorded_at") <= p["known_at"])
        & (F.col("valid_from") <= p["effective_at"])
        & (F.col("valid_to").isNull() | (p["effective_at"] < F.col("valid_to"))),
    )
    active = assertions.withColumn("p", F.explode(inside)).select("p.point", "p.effective_at", *assertions.columns)
    hidden = (
        active.filter(F.col("supersedes_event_id").isNotNull())
        .select("point", F.col("supersedes_event_id").alias("event_id"))
        .distinct()
    )
    return active.join(hidden, ["point", "event_id"], "left_anti")


def as_known(assertions: DataFrame, points: list[Point]) -> DataFrame:
    """One row per (point, workspace, aggregate, key): the value, or CONFLICT when sources compete."""
    facts = active_facts(assertions, points)
    many = F.count("*") > 1
    return facts.groupBy("point", *FACT_KEY).agg(
        F.count("*").alias("facts"),
        F.when(~many, F.min("value")).alias("value"),
        F.when(many, F.lit("CONFLICT")).alias("error_code"),
    )


#: Facts of one aggregate above which its rows are dealt to several tasks, one part for each such number of facts.
HOT_FACTS = 50_000
NO_END = 1 << 22  # days; beyond every date


def _days(date_column: Column, origin: Column) -> Column:
    return F.datediff(date_column, origin).cast("bigint")


def _interval_pairs(assertions: DataFrame, queries: DataFrame, span: tuple[date, int], parts: DataFrame, *columns: str) -> DataFrame:
    """(query_id, columns) of assertions in force at a query's date and recorded by its instant, each once.

    The days between the first and the last asked date form a binary tree. An assertion is filed under the few blocks that
    make up its validity; a query looks into the one block of each level that holds its date. So the join is an equality
    on (workspace, aggregate, level, place), an open-ended fact is a few rows, and nothing is joined that is not in
    force. A huge aggregate is dealt to parts by event; its queries look into all of them.
    """
    first, days = span
    origin, levels = F.lit(first).cast("date"), max(days - 1, 0).bit_length()
    scope = ["workspace_id", "aggregate_id"]
    begin = F.greatest(_days(F.col("valid_from"), origin), F.lit(0))
    end = F.least(F.coalesce(_days(F.col("valid_to"), origin), F.lit(NO_END)), F.lit(1 << levels))
    facts = assertions.filter(F.col("valid_from").isNotNull() & F.col("recorded_at").isNotNull())
    # Dealt out before they are multiplied: a small file would be one task for all its blocks.
    facts = facts.repartition("event_id").join(parts, scope, "left")
    part = F.pmod(F.xxhash64("event_id"), F.coalesce("parts", F.lit(1)))
    # Bounds are columns of their own, so that the steps of every level work on short expressions.
    facts = facts.select(*scope, "recorded_at", *columns, part.alias("part"), begin.alias("_begin"), end.alias("_end"))
    facts = facts.filter("_begin < _end").withColumn("_b", F.explode(_tree_blocks("_begin", "_end", levels)))
    facts = facts.select(*scope, "part", F.col("_b.level").alias("level"), F.col("_b.place").alias("place"), "recorded_at", *columns)
    day = _days(F.col("effective_at"), origin)
    asked = queries.repartition("query_id").join(parts, scope, "left").select(
        *scope, "query_id", "known_at", day.alias("_day"), F.explode(F.sequence(F.lit(0), F.coalesce("parts", F.lit(1)) - 1)).alias("part")
    )
    level = F.explode(F.array(*(F.lit(n) for n in range(levels + 1))))
    asked = asked.withColumn("level", level).withColumn("place", F.expr("shiftright(_day, level)")).drop("_day")
    asked = asked.withColumn("part", F.col("part").cast("bigint"))
    # Spark's estimates know nothing of the levels and parts a query is multiplied by, so both sides are always shuffled.
    met = facts.join(asked.hint("merge"), [*scope, "part", "level", "place"])
    return met.filter("recorded_at <= known_at").select("query_id", *scope, *columns)


def _tree_blocks(begin: str, end: str, levels: int) -> Column:
    """Dyadic blocks (level, place) that cover the days begin … end - 1 exactly once, at most two a level.

    A fold over the levels: on each, a block is cut off at either end where the rest does not begin or stop at a block of
    twice the size.
    """
    block = "array<struct<level:int,place:bigint>>"
    start = F.struct(F.col(begin).alias("a"), F.col(end).alias("b"), F.expr(f"cast(array() as {block})").alias("found"))

    def step(state: Column, level: Column) -> Column:
        a, b = state["a"], state["b"]
        inner = a + a % 2
        left = F.when((a < b) & (a % 2 == 1), F.struct(level.alias("level"), a.alias("place")))
        right = F.when((inner < b) & (b % 2 == 1), F.struct(level.alias("level"), (b - 1).alias("place")))
        found = F.concat(state["found"], F.array_compact(F.array(left, right)).cast(block))
        return F.struct(F.shiftright(inner, 1).alias("a"), F.shiftright(b, 1).alias("b"), found.alias("found"))

    return F.aggregate(F.array(*(F.lit(n) for n in range(levels + 1))), start, step, lambda x: x["found"])


def active_facts_at(assertions: DataFrame, queries: DataFrame) -> DataFrame:
    """(query_id, workspace_id, aggregate_id, key, value, event_id) of every fact a query sees.

    ``queries(query_id, workspace_id, aggregate_id, effective_at, known_at)`` is a table of any size; an id names one
    query. A fact is seen if it is in force on the date (its end excluded) and was recorded at or before the instant, and
    no correction that the query sees in the same way names it. A query or fact with a null it needs is not matched.
    """
    asked = queries.select("query_id", "workspace_id", "aggregate_id", "effective_at", "known_at")
    asked = asked.filter(F.col("effective_at").isNotNull() & F.col("known_at").isNotNull())
    ends = asked.agg(F.min("effective_at").alias("first"), F.max("effective_at").alias("last")).first()
    span = (ends["first"] or date(1970, 1, 1), (ends["last"] - ends["first"]).days + 1 if ends["first"] else 1)
    sizes = assertions.groupBy("workspace_id", "aggregate_id").agg(F.count("*").alias("n")).filter(F.col("n") > HOT_FACTS)
    parts = sizes.select("workspace_id", "aggregate_id", F.ceil(F.col("n") / HOT_FACTS).cast("int").alias("parts"))
    seen = _interval_pairs(assertions, asked, span, parts, "event_id", "key", "value")
    corrections = assertions.filter(F.col("supersedes_event_id").isNotNull())
    hidden = _interval_pairs(corrections, asked, span, parts, "event_id", "supersedes_event_id")
    hidden = hidden.select("query_id", F.col("supersedes_event_id").alias("event_id"))
    return seen.join(hidden, ["query_id", "event_id"], "left_anti")


def as_known_at(assertions: DataFrame, queries: DataFrame) -> DataFrame:
    """One row per (query, key) in ``as_known``'s terms: the value, or CONFLICT when sources compete."""
    facts = active_facts_at(assertions, queries)
    many = F.count("*") > 1
    return facts.groupBy("query_id", *FACT_KEY).agg(
        F.count("*").alias("facts"),
        F.when(~many, F.min("value")).alias("value"),
        F.when(many, F.lit("CONFLICT")).alias("error_code"),
    )


def operations_noi_as_known(
    known: DataFrame, base_key: str = "operations_noi_base", expense_prefix: str = "expense:"
) -> DataFrame:
    """base − Σ expenses per aggregate; a conflict anywhere or a missing base refuses."""
    is_base = F.col("key") == base_key
    base = F.max(F.when(is_base, F.col("value")))
    expenses = F.sum(F.when(F.col("key").startswith(expense_prefix), F.col("value")))
    # No expense fact at all is a true zero deduction, as the base is already a net figure.
    zero = F.lit("0").cast("decimal(38,2)")
    out = known.groupBy("point", "workspace_id", "aggregate_id").agg(
        base.alias("base"),
        F.coalesce(expenses.cast("decimal(38,2)"), zero).alias("expenses"),
        F.count_if(F.col("error_code").isNotNull()).alias("conflicts"),
        F.count_if(is_base).alias("bases"),
    )
    error = first_failure((F.col("conflicts") > 0, "CONFLICT"), (F.col("bases") == 0, "NOI_BASE_MISSING"))
    return out.select(
        "point",
        "workspace_id",
        "aggregate_id",
        F.when(error.isNull(), F.col("base") - F.col("expenses")).cast("decimal(38,2)").alias("noi"),
        error.alias("error_code"),
    )


def thesis_to_actual(thesis: DataFrame, noi: DataFrame) -> DataFrame:
    """Frozen thesis rows with the later operations NOI beside them; no thesis column changes."""
    later = noi.select(F.col("aggregate_id").alias("deal_id"), F.col("noi").alias("operations_actual_noi"))
    return thesis.join(later, "deal_id", "left")


def check_stream_version(events: DataFrame) -> DataFrame:
    """Events with ``issues``: a missing predecessor version, a record clock that moved backward, a second
    correction of one fact, a correction of an unknown fact or of another key."""
    stream = ["workspace_id", "aggregate_id"]
    before = events.select(
        *stream, (F.col("version") + 1).alias("version"), F.col("recorded_at").alias("before_at"), F.lit(1).alias("has")
    )
    target = events.select(
        *stream, F.col("event_id").alias("supersedes_event_id"), F.col("key").alias("target_key")
    )
    repeats = (
        events.filter(F.col("supersedes_event_id").isNotNull()).groupBy("supersedes_event_id").agg(
            F.count("*").alias("corrections")
        )
    )
    # Most events correct nothing: their NULL keys are spread, so they never meet in one task, and those of one aggregate
    # do not either.
    row = [*stream, "version", "event_id"]
    joined = events.join(before, [*stream, "version"], "left")
    joined = join_present(joined, target, "supersedes_event_id", row, stream)
    joined = join_present(joined, repeats, "supersedes_event_id", row)
    corrects = F.col("supersedes_event_id").isNotNull()
    bad = F.array_compact(
        F.array(
            F.when((F.col("version") > 1) & F.col("has").isNull(), "VERSION_GAP"),
            F.when(F.col("recorded_at") < F.col("before_at"), "CLOCK_BACKWARD"),
            F.when(F.col("corrections") > 1, "SECOND_CORRECTION"),
            F.when(corrects & F.col("target_key").isNull(), "UNKNOWN_TARGET"),
            F.when(F.col("target_key") != F.col("key"), "KEY_CHANGED"),
        )
    )
    return joined.select(*events.columns, bad.alias("issues"))


def command_hash() -> Column:
    """Content hash of one assertion; equal source keys with different hashes conflict."""
    fields = [*FACT_KEY, "value", "valid_from", "valid_to", "source_system", "source_record", "source_revision"]
    return F.sha2(
        canonical_json(**{f: F.col(f).cast("string") for f in [*fields, "supersedes_event_id"]}), 256
    )


# ---------------------------------------------------------------- opening imports


def validate_opening(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Snapshot rows with parsed amount and ``error_code``. ``keys`` name the snapshot."""
    parsed = opening_amount(F.col("amount"), F.col("deleted"))
    texts = ["source_property_id", "source_record_id", "revision", "account", "unit_category"]
    error = first_failure(
        *[(failed(clean_text(F.col(t), 128)), "INVALID_IDENTITY") for t in texts],
        (failed(F.col("period").rlike(PERIOD)), "INVALID_PERIOD"),
        (F.col("deleted").isNull(), "INVALID_CONTRACT"),
    )
    return rows.withColumns(
        {"parsed_amount": parsed["amount"], "error_code": F.coalesce(error, parsed["error_code"])}
    )


def check_sequence(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Per snapshot: sequence is exactly 1..n, and no source record comes in several revisions.

    Exact without ordering the rows: 1..n holds when the minimum is 1, the maximum is n and no number repeats.
    """
    repeated = rows.groupBy(*keys, "sequence").agg((F.count("*") - 1).alias("extra"))
    numbers = repeated.groupBy(*keys).agg(
        F.min("sequence").alias("first"),
        F.max("sequence").alias("last"),
        F.sum("extra").alias("repeated_numbers"),
        (F.count("*") + F.sum("extra")).alias("row_count"),
    )
    records = (
        rows.groupBy(*keys, "source_property_id", "source_record_id")
        .agg((F.count("*") > 1).alias("again"))
        .groupBy(*keys)
        .agg(F.count_if("again").alias("repeated_records"))
    )
    error = first_failure(
        (
            (F.col("first") != 1) | (F.col("last") != F.col("row_count")) | (F.col("repeated_numbers") > 0),
            "SEQUENCE_GAP_OR_DUPLICATE",
        ),
        (F.col("repeated_records") > 0, "MULTIPLE_REVISIONS"),
    )
    return numbers.join(records, keys).withColumn("error_code", error)


def sequence_gaps(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Sequence numbers whose predecessor is missing."""
    following = rows.select(*keys, (F.col("sequence") + 1).alias("sequence"))
    return rows.filter("sequence > 1").join(following, [*keys, "sequence"], "left_anti")


def map_identity(rows: DataFrame, identities: DataFrame) -> DataFrame:
    """Attach the stable property id. Unmapped sources and targets claimed by several sources refuse."""
    claimed = identities.groupBy("stable_id").agg(F.count_distinct("source_property_id").alias("claims"))
    table = identities.join(claimed, "stable_id").select("source_property_id", "stable_id", "claims")
    error = first_failure(
        (F.col("stable_id").isNull(), "UNMAPPED_PROPERTY"), (F.col("claims") > 1, "IMPLICIT_MERGE")
    )
    return (
        rows.join(table, "source_property_id", "left")
        .withColumn("identity_error", error)
        .withColumn("stable_id", F.when(error.isNull(), F.col("stable_id")))
        .drop("claims")
    )


def opening_totals(rows: DataFrame) -> DataFrame:
    """Σ amount by (property, period, account, unit category) without tombstones."""
    return (
        rows.filter(~F.col("deleted"))
        .groupBy("property_id", "period", "account", "unit_category")
        .agg(F.sum("amount").cast("decimal(38,2)").alias("amount"))
    )


def same_rows(left: DataFrame, right: DataFrame, name: str = "side") -> DataFrame:
    """Rows that occur more often on one side, tagged ``left`` or ``right``. Empty means equal as multisets.

    One grouping over the signed union replaces two set differences, and equal rows meet before the shuffle.
    """
    columns = left.columns
    signed = left.withColumn("_n", F.lit(1)).unionByName(right.withColumn("_n", F.lit(-1)))
    diff = signed.groupBy(*columns).agg(F.sum("_n").alias("excess")).filter("excess <> 0")
    return diff.select(
        *columns, F.when(F.col("excess") > 0, "left").otherwise("right").alias(name), F.abs("excess").alias("excess")
    )


# ---------------------------------------------------------------- postings


def cutover_source(transactions: DataFrame, properties: DataFrame) -> DataFrame:
    """Feed ``before`` is authoritative until the cutover date and ``after`` from it on; anything else refuses."""
    joined = transactions.join(properties.select("property_id", "cutover_on"), "property_id", "left")
    wanted = F.when(F.col("effective_on") < F.col("cutover_on"), "before").when(
        F.col("effective_on") >= F.col("cutover_on"), "after"
    )
    return joined.withColumn(
        "error_code", F.when(~F.coalesce(F.col("feed") == wanted, F.lit(False)), "FEED_NOT_AUTHORITATIVE")
    )


def explode_postings(transactions: DataFrame) -> DataFrame:
    """One row per (transaction, account) from a map of account to amount."""
    keep = [c for c in transactions.columns if c != "postings"]
    return transactions.select(*keep, F.explode("postings").alias("account", "amount"))


def balanced_postings(postings: DataFrame, keys: list[str]) -> DataFrame:
    """Sum per transaction; anything but zero refuses."""
    return (
        postings.groupBy(*keys)
        .agg(F.sum("amount").cast("decimal(38,2)").alias("total"))
        .withColumn("error_code", F.when(F.col("total") != 0, "UNBALANCED"))
    )


def trial_balance(opening: DataFrame, postings: DataFrame) -> DataFrame:
    """Closing balance per (property, account): opening balance plus all postings."""
    rows = opening.select("property_id", "account", "amount").unionByName(
        postings.select("property_id", "account", "amount")
    )
    return rows.groupBy("property_id", "account").agg(F.sum("amount").cast("decimal(38,2)").alias("balance"))


def trial_balance_noi(
    balances: DataFrame, revenue: str = "rental_revenue", expense: str = "operating_expense"
) -> DataFrame:
    """NOI = −revenue − expense, and whether the books close to zero."""

    def of(account: str) -> Column:
        return F.sum(F.when(F.col("account") == account, F.col("balance")))

    zero = F.lit("0").cast("decimal(38,2)")
    return balances.groupBy("property_id").agg(
        (-F.coalesce(of(revenue), zero) - F.coalesce(of(expense), zero)).cast("decimal(38,2)").alias("noi"),
        F.sum("balance").cast("decimal(38,2)").alias("total"),
        F.when(F.sum("balance") != 0, "UNBALANCED").alias("error_code"),
    )


def authorized(df: DataFrame, grants: DataFrame, actor_id: str, capability: str = "read") -> DataFrame:
    """Rows of aggregates the actor currently holds a grant for. Grants are a table, never old events."""
    held = grants.filter((F.col("actor_id") == actor_id) & (F.col("capability") == capability))
    return df.join(held.select("workspace_id", "aggregate_id").distinct(), ["workspace_id", "aggregate_id"], "left_semi")


# ---------------------------------------------------------------- frozen reports


def freeze_report(reports: DataFrame) -> DataFrame:
    """Content as canonical text with its hash, ready to be appended once."""
    return reports.withColumn("content_sha256", F.sha2("content_json", 256))


def new_reports(batch: DataFrame, issued: DataFrame) -> DataFrame:
    """Reports whose (workspace, report) id is not issued yet; an issued report is never replaced."""
    return freeze_report(batch).join(
        issued.select("workspace_id", "report_id"), ["workspace_id", "report_id"], "left_anti"
    )


def read_report(issued: DataFrame) -> DataFrame:
    """Issued reports with their hash and scope checked again on every read."""
    bad_hash = F.sha2("content_json", 256) != F.col("content_sha256")
    is_thesis = F.get_json_object("content_json", "$.type") == "original_thesis/1"
    bad_scope = is_thesis & ~F.col("aggregate_id").eqNullSafe(F.get_json_object("content_json", "$.deal_id"))
    error = first_failure((bad_hash, "INTEGRITY_FAILED"), (bad_scope, "SCOPE_MISMATCH"))
    return issued.withColumn("error_code", error).withColumn(
        "content_json", F.when(F.col("error_code").isNull(), F.col("content_json"))
    )
