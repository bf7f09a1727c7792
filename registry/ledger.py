"""Bitemporal ledger, opening imports and postings, with SQL twins."""

from __future__ import annotations

from datetime import date, datetime

from pyspark.sql import functions as F

from registry.common import Register, m, texts
from registry.sqltext import K, load, view
from rentloom import schemas
from rentloom.functions.hashing import group_digest
from rentloom.functions.skew import numbered
from rentloom.operators import ledger
from rentloom.session import scratch_dir
from rentloom.sources import files

ENTRIES = Register()
entry = ENTRIES.entry
POINTS = [
    ("early", date(2024, 1, 15), datetime(2024, 1, 16)),
    ("late", date(2024, 1, 15), datetime(2024, 2, 20)),
    ("end", date(2024, 1, 25), datetime(2024, 2, 20)),
]
view(
    "v_o_points",
    "select * from (values "
    + ", ".join(f"('{n}', date '{d}', timestamp '{k}')" for n, d, k in POINTS)
    + ") p(point, effective_at, known_at)",
)
view(
    "v_o_active",
    """
    select p.point, p.effective_at, a.* from v_assertions a join v_o_points p on a.recorded_at <= p.known_at
      and a.valid_from <= p.effective_at and (a.valid_to is null or p.effective_at < a.valid_to)""",
)
view(
    "v_o_known",
    """
    select point, workspace_id, aggregate_id, key, count(*) as facts, case when count(*) = 1 then min(value) end as value, case when count(*) > 1 then 'CONFLICT' end as error_code
    from v_o_active a where not exists (select 1 from v_o_active b where b.point = a.point and b.supersedes_event_id = a.event_id) group by 1, 2, 3, 4""",
)


def assertions(spark, d):
    return load(spark, d, "v_assertions")


@entry("as_known_j6", f"select point, aggregate_id, key, facts, {m('value', 'value')}, error_code from v_o_known")
def as_known_j6(spark, d):
    return texts(ledger.as_known(assertions(spark, d), POINTS).drop("workspace_id"), "value")


# A question for every event: what its aggregate's facts were on a day near it, as known some days later or earlier.
view(
    "v_queries",
    f"""
    select event_id as query_id, 'w' as workspace_id, cast(case when {K} % 3 = 0 then user_id % 7 else user_id end as string) as aggregate_id,
           cast(cast(ts as date) + {K} % 23 - 6 as date) as effective_at, ts + ({K} % 31 - 3) * interval '1' day as known_at
    from events""",
)


@entry(
    "as_known_at_j6",
    f"""
    with seen as (
      select q.query_id, a.* from v_queries q join v_assertions a on a.aggregate_id = q.aggregate_id and a.workspace_id = q.workspace_id
        and a.recorded_at <= q.known_at and a.valid_from <= q.effective_at and (a.valid_to is null or q.effective_at < a.valid_to)
    ),
    known as (
      select query_id, aggregate_id, key, count(*) as facts, case when count(*) = 1 then min(value) end as value from seen
      where not exists (select 1 from seen h where h.query_id = seen.query_id and h.supersedes_event_id = seen.event_id) group by 1, 2, 3
    )
    select query_id, aggregate_id, count(*) as keys, sum(facts)::bigint as facts, count(*) filter (where facts > 1) as conflicts, {m('sum(value)', 'value')}
    from known group by 1, 2""",
)
def as_known_at_j6(spark, d):
    known = ledger.as_known_at(assertions(spark, d), load(spark, d, "v_queries"))
    out = known.groupBy("query_id", "aggregate_id").agg(
        F.count("*").alias("keys"), F.sum("facts").alias("facts"), F.count("error_code").alias("conflicts"), F.sum("value").alias("value")
    )
    return texts(out, "value")


@entry(
    "operations_noi_as_known_a16",
    f"""select point, aggregate_id, case when conflicts > 0 then 'CONFLICT' when bases = 0 then 'NOI_BASE_MISSING' end as error_code,
        {m('case when conflicts = 0 and bases > 0 then base - expenses end', 'noi')} from (
        select point, aggregate_id, max(case when key = 'view:0' then value end) as base, sum(case when key like 'error:%' then value else 0 end) as expenses,
               count(error_code) as conflicts, count(*) filter (where key = 'view:0') as bases from v_o_known group by 1, 2) x""",
)
def operations_noi_as_known_a16(spark, d):
    known = ledger.as_known(assertions(spark, d), POINTS)
    return texts(ledger.operations_noi_as_known(known, "view:0", "error:").drop("workspace_id"), "noi")


view(
    "v_o_events",
    """
    select *, row_number() over (partition by workspace_id, aggregate_id order by ts, event_id) as version from v_assertions""",
)


def versioned(spark, d):
    day = F.col("ts").cast("date")
    order = [F.col("ts"), F.col("event_id")]
    return numbered(assertions(spark, d), ["workspace_id", "aggregate_id"], day, order, "version")


@entry("numbered_versions_t2", "select event_id, aggregate_id, version from v_o_events")
def numbered_versions_t2(spark, d):
    return versioned(spark, d).select("event_id", "aggregate_id", "version")


@entry(
    "check_stream_version_w8",
    """select issues, count(*) as n, sum(event_id)::bigint as ids from (select event_id, concat_ws(',', case when b.version is null and e.version > 1 then 'VERSION_GAP' end,
         case when e.recorded_at < b.recorded_at then 'CLOCK_BACKWARD' end, case when c.n > 1 then 'SECOND_CORRECTION' end,
         case when e.supersedes_event_id is not null and t.key is null then 'UNKNOWN_TARGET' end, case when t.key <> e.key then 'KEY_CHANGED' end) as issues
         from (select * from v_o_events where version <> 3) e
         left join (select aggregate_id, version, recorded_at from v_o_events where version <> 3) b on b.aggregate_id = e.aggregate_id and b.version = e.version - 1
         left join (select aggregate_id, event_id as target, key from v_o_events where version <> 3) t on t.aggregate_id = e.aggregate_id and t.target = e.supersedes_event_id
         left join (select supersedes_event_id as s, count(*) as n from v_o_events where version <> 3 and supersedes_event_id is not null group by 1) c on c.s = e.supersedes_event_id) x group by 1""",
)
def check_stream_version_w8(spark, d):
    out = ledger.check_stream_version(versioned(spark, d).filter("version <> 3"))
    out = out.groupBy(F.array_join("issues", ",").alias("issues"))
    return out.agg(F.count("*").alias("n"), F.sum("event_id").alias("ids"))


view(
    "v_opening",
    """
    select cast(o_custkey % 30 as string) as snapshot, o_orderkey as ok, 'prop' || cast(o_custkey % 12 as string) as source_property_id,
           case when o_orderkey % 997 = 5 then 'r5' else 'r' || cast(o_orderkey as string) end as source_record_id, '1' as revision,
           substr(cast(o_orderdate as string), 1, 7) as period, o_orderpriority as account, case when o_custkey % 5 = 0 then 'commercial' else 'residential' end as unit_category,
           case when o_orderkey % 10 = 3 then cast(null as string) else cast(cast(o_totalprice as decimal(18,2)) as string) end as amount, o_orderkey % 10 = 3 as deleted
    from orders""",
)
view("v_o_opening", "select *, row_number() over (partition by snapshot order by ok) as rn from v_opening")


def opening(spark, d):
    block = F.floor(F.col("ok") / 100000)
    rows = numbered(load(spark, d, "v_opening"), ["snapshot"], block, [F.col("ok")], "rn")
    late = F.col("snapshot").isin("4", "9") & (F.col("rn") > 5)
    return rows.withColumn("sequence", F.when(late, F.col("rn") + 1).otherwise(F.col("rn")))


@entry(
    "check_sequence_w7",
    """select snapshot, n as row_count, case when snapshot in ('4', '9') and n > 5 then 'SEQUENCE_GAP_OR_DUPLICATE' when again > 0 then 'MULTIPLE_REVISIONS' end as error_code
       from (select snapshot, sum(c)::bigint as n, count(*) filter (where c > 1) as again from (
             select snapshot, source_property_id, source_record_id, count(*) as c from v_o_opening group by 1, 2, 3) x group by 1) y""",
)
def check_sequence_w7(spark, d):
    return ledger.check_sequence(opening(spark, d), ["snapshot"]).select("snapshot", "row_count", "error_code")


@entry(
    "sequence_gaps_w7",
    "select snapshot, 7 as sequence from v_o_opening where snapshot in ('4', '9') and rn = 6",
)
def sequence_gaps_w7(spark, d):
    return ledger.sequence_gaps(opening(spark, d), ["snapshot"]).select("snapshot", F.col("sequence").cast("int").alias("sequence"))


@entry(
    "map_identity_j13",
    """select source_property_id, case when source_property_id in ('prop1', 'prop2') then null when source_property_id = 'prop3' then null else 'stable_' || source_property_id end as stable_id,
        case when source_property_id = 'prop3' then 'UNMAPPED_PROPERTY' when source_property_id in ('prop1', 'prop2') then 'IMPLICIT_MERGE' end as error_code, count(*) as n
        from v_opening group by 1, 2, 3""",
)
def map_identity_j13(spark, d):
    out = ledger.map_identity(load(spark, d, "v_opening"), identities(spark, d))
    out = out.groupBy("source_property_id", "stable_id", F.col("identity_error").alias("error_code"))
    return out.agg(F.count("*").alias("n"))


def identities(spark, d):
    s = F.col("source_property_id")
    ids = load(spark, d, "v_opening").select(s).distinct().filter(s != "prop3")
    return ids.select(s, F.when(s.isin("prop1", "prop2"), "same").otherwise(F.concat(F.lit("stable_"), s)).alias("stable_id"))


@entry(
    "opening_totals_a17",
    f"""select source_property_id as property_id, period, account, unit_category, {m('sum(cast(amount as decimal(18,2)))', 'amount')} from v_opening where not deleted group by 1, 2, 3, 4""",
)
def opening_totals_a17(spark, d):
    rows = ledger.validate_opening(load(spark, d, "v_opening"), ["snapshot"]).filter("error_code is null")
    rows = rows.drop("amount").withColumnsRenamed({"parsed_amount": "amount", "source_property_id": "property_id"})
    return texts(ledger.opening_totals(rows), "amount")


@entry(
    "read_opening_snapshot_s9",
    """select code as error_code, count(*) as n from (select case when ok % 50 = 7 then 'INVALID_PERIOD' when deleted and ok % 20 = 3 then 'INVALID_CONTRACT' end as code from v_opening) x group by 1""",
)
def read_opening_snapshot_s9(spark, d):
    rows = load(spark, d, "v_opening").withColumns(
        {
            "period": F.when(F.col("ok") % 50 == 7, "2000-13").otherwise(F.col("period")),
            "amount": F.when(F.col("deleted") & (F.col("ok") % 20 == 3), "0").otherwise(F.col("amount")),
        }
    )
    root = scratch_dir(spark, "opening")
    columns = [c.split()[0] for c in schemas.OPENING.split(", ")]
    rows.withColumn("sequence", F.col("ok")).select("snapshot", *columns).write.partitionBy("snapshot").json(root)
    out = ledger.validate_opening(files.read_opening_snapshot(spark, root), ["snapshot"])
    return out.groupBy("error_code").agg(F.count("*").alias("n"))


@entry(
    "same_rows_u5",
    """select source_record_id, snapshot, case when ok % 40 = 1 then 'left' else 'right' end as side, 1::bigint as excess from v_opening where ok % 40 in (1, 2)""",
)
def same_rows_u5(spark, d):
    planned = load(spark, d, "v_opening").select("source_record_id", "snapshot", "period", "amount", "ok")
    k = F.col("ok") % 40
    imported = planned.filter(k != 1).unionByName(planned.filter(k == 2))
    out = ledger.same_rows(planned, imported)
    return out.select("source_record_id", "snapshot", "side", "excess")


view(
    "v_tx",
    """
    select l_orderkey as tx, 'p' || lpad(cast(l_orderkey % 20 as string), 3, '0') as property_id, cast(min(o_orderdate) as date) as effective_on,
           case when l_orderkey % 9 = 0 then 'after' when cast(min(o_orderdate) as date) < date '1998-06-01' then 'before' else 'after' end as feed,
           sum(case when l_linenumber <= 2 then cast(l_extendedprice as decimal(18,2)) else 0 end) as revenue,
           sum(case when l_linenumber > 2 then cast(l_extendedprice as decimal(18,2)) else 0 end) as expense
    from lineitem join orders on l_orderkey = o_orderkey group by 1, 2""",
)


def transactions(spark, d):
    cash = F.col("revenue") - F.col("expense") + F.when(F.col("tx") % 11 == 0, F.lit(1)).otherwise(F.lit(0))
    money = lambda c: c.cast("decimal(38,2)")
    postings = F.create_map(
        F.lit("rental_revenue"), money(-F.col("revenue")), F.lit("operating_expense"), money(F.col("expense")), F.lit("cash"), money(cash)
    )
    return load(spark, d, "v_tx").select("tx", "property_id", "effective_on", "feed", postings.alias("postings"))


@entry(
    "cutover_source_j7",
    """select property_id, feed, case when tx % 9 = 0 and effective_on < date '1998-06-01' then 'FEED_NOT_AUTHORITATIVE' end as error_code, count(*) as n from v_tx group by 1, 2, 3""",
)
def cutover_source_j7(spark, d):
    props = load(spark, d, "v_tx").select("property_id", F.to_date(F.lit("1998-06-01")).alias("cutover_on")).distinct()
    out = ledger.cutover_source(transactions(spark, d), props)
    return out.groupBy("property_id", "feed", "error_code").agg(F.count("*").alias("n"))


@entry(
    "balanced_postings_a18",
    f"""select tx, {m('case when tx % 11 = 0 then 1 else 0 end', 'total')}, case when tx % 11 = 0 then 'UNBALANCED' end as error_code from v_tx""",
)
def balanced_postings_a18(spark, d):
    rows = ledger.explode_postings(transactions(spark, d))
    return texts(ledger.balanced_postings(rows, ["tx"]), "total")


def opening_balance(spark, d):
    p = load(spark, d, "v_properties").select(F.col("id").alias("property_id"))
    lines = F.array(
        *[F.struct(F.lit(a).alias("account"), F.lit(v).cast("decimal(38,2)").alias("amount")) for a, v in (("cash", "100000"), ("equity", "-100000"))]
    )
    return p.select("property_id", F.inline(lines))


@entry(
    "trial_balance_a18",
    f"""select property_id, account, {m('sum(amount)', 'balance')} from (
        select property_id, 'cash' as account, revenue - expense + case when tx % 11 = 0 then 1 else 0 end as amount from v_tx
        union all select property_id, 'rental_revenue', -revenue from v_tx union all select property_id, 'operating_expense', expense from v_tx
        union all select id, 'cash', 100000 from v_properties union all select id, 'equity', -100000 from v_properties) x group by 1, 2""",
)
def trial_balance_a18(spark, d):
    return texts(ledger.trial_balance(opening_balance(spark, d), ledger.explode_postings(transactions(spark, d))), "balance")


@entry(
    "trial_balance_noi_a18",
    f"""select property_id, {m('sum(revenue) - sum(expense)', 'noi')}, {m('sum(case when tx % 11 = 0 then 1 else 0 end)', 'total')},
        case when sum(case when tx % 11 = 0 then 1 else 0 end) <> 0 then 'UNBALANCED' end as error_code from v_tx group by 1""",
)
def trial_balance_noi_a18(spark, d):
    balances = ledger.trial_balance(opening_balance(spark, d), ledger.explode_postings(transactions(spark, d)))
    return texts(ledger.trial_balance_noi(balances), "noi", "total")


@entry(
    "authorized_j19",
    """select aggregate_id, count(*) as n from v_assertions where cast(aggregate_id as bigint) % 3 = 0 group by 1""",
)
def authorized_j19(spark, d):
    a = assertions(spark, d)
    n = F.col("aggregate_id").cast("bigint")
    grants = a.select(
        "workspace_id",
        "aggregate_id",
        F.when(n % 2 == 0, "ann").otherwise("bob").alias("actor_id"),
        F.lit("read").alias("capability"),
    ).distinct()
    grants = grants.filter((n % 3 == 0) | (F.col("actor_id") == "bob")).withColumn("actor_id", F.when(n % 3 == 0, "ann").otherwise(F.col("actor_id")))
    return ledger.authorized(a, grants, "ann").groupBy("aggregate_id").agg(F.count("*").alias("n"))


@entry(
    "evidence_digest_a29",
    f"""select property_id, kind, count(*) as row_count,
         sha256(count(*)::varchar || ',' || {" || ',' || ".join(f"sum(cast('0x' || substr(h, {1 + 8 * i}, 8) as bigint))::varchar" for i in range(8))}) as digest from (
           select property_id, kind, sha256('{{"account_code":"' || account_code || '","amount":"' || cast(amount as varchar) || '","id":"' || id || '"}}') as h from v_gl) x group by 1, 2""",
)
def evidence_digest_a29(spark, d):
    from rentloom.functions.hashing import canonical_json

    row = canonical_json(account_code=F.col("account_code"), amount=F.col("amount").cast("string"), id=F.col("id"))
    return group_digest(load(spark, d, "v_gl"), ["property_id", "kind"], row, "digest")


@entry(
    "canonical_ids_f24",
    """select event_id, 'mny_' || sha256('{"column":' || (event_id % 5 + 1) || ',"row":' || event_id || ',"row_end":' || event_id || ',"sheet":1}') as observation_id,
        'iss_' || substr(sha256('{"code":"' || event_type || '","row":null}'), 1, 32) as issue_id from events""",
)
def canonical_ids_f24(spark, d):
    from rentloom.functions.hashing import prefixed_id

    e = load(spark, d, "events")
    k = F.col("event_id")
    place = {"sheet": F.lit(1), "row": k, "row_end": k, "column": k % 5 + 1}
    issue = prefixed_id("iss", 32, code=F.col("event_type"), row=F.lit(None).cast("int"))
    return e.select("event_id", prefixed_id("mny", 64, **place).alias("observation_id"), issue.alias("issue_id"))


@entry(
    "canonical_sha256_f25",
    """select o_orderkey, sha256('{"actual":"' || cast(cast(o_totalprice as decimal(18,2)) as varchar) || '","missing":null,"tags":["' || o_orderstatus || '","x"]}') as sha from orders""",
)
def canonical_sha256_f25(spark, d):
    from rentloom.functions.hashing import canonical_sha256

    o = load(spark, d, "orders")
    sha = canonical_sha256(
        tags=F.array(F.col("o_orderstatus"), F.lit("x")),
        missing=F.lit(None).cast("string"),
        actual=F.col("o_totalprice").cast("decimal(18,2)").cast("string"),
    )
    return o.select("o_orderkey", sha.alias("sha"))


@entry(
    "freeze_report_t5",
    """select report_id, aggregate_id, case when k % 8 = 1 then 'INTEGRITY_FAILED' when k % 8 = 2 then 'SCOPE_MISMATCH' end as error_code from (
        select cast(o_orderkey as varchar) as report_id, cast(o_custkey as varchar) as aggregate_id, o_orderkey as k from orders) x""",
)
def freeze_report_t5(spark, d):
    o = load(spark, d, "orders")
    k = F.col("o_orderkey")
    deal = F.when(k % 8 == 2, "other").otherwise(F.col("o_custkey").cast("string"))
    body = F.to_json(F.struct(F.lit("original_thesis/1").alias("type"), deal.alias("deal_id"), F.col("o_totalprice").cast("decimal(18,2)").alias("price")))
    batch = o.select(
        F.lit("w").alias("workspace_id"), k.cast("string").alias("report_id"), F.col("o_custkey").cast("string").alias("aggregate_id"), body.alias("content_json")
    )
    issued = ledger.freeze_report(batch)
    touched = F.when(F.col("report_id").cast("bigint") % 8 == 1, F.concat("content_json", F.lit(" "))).otherwise(F.col("content_json"))
    return ledger.read_report(issued.withColumn("content_json", touched)).select("report_id", "aggregate_id", "error_code")


@entry(
    "grants_and_clock_x3",
    """select aggregate_id, count(*) as n, max(recorded_at) <= timestamp '2024-01-20' as within_clock from v_assertions
       where recorded_at <= timestamp '2024-01-20' and cast(aggregate_id as bigint) % 4 <> 1 group by 1""",
)
def grants_and_clock_x3(spark, d):
    """Who may read comes from the host's current grants, and what is known from the instant the host supplies."""
    a = assertions(spark, d)
    n = F.col("aggregate_id").cast("bigint")
    grants = a.select("workspace_id", "aggregate_id").distinct()
    grants = grants.withColumns({"actor_id": F.lit("ann"), "capability": F.when(n % 4 == 1, "write").otherwise("read")})
    clock = F.lit(datetime(2024, 1, 20))
    seen = ledger.authorized(a.filter(F.col("recorded_at") <= clock), grants, "ann").groupBy("aggregate_id")
    return seen.agg(F.count("*").alias("n"), (F.max("recorded_at") <= clock).alias("within_clock"))
