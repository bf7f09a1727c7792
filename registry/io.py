"""Sources, sinks and streams over data derived from the given tables, with SQL twins."""

from __future__ import annotations

from datetime import date, datetime

from pyspark.sql import functions as F

from registry.common import Register, m, texts
from registry.governance import RECORDS_SQL, record_counts, report_records, run_journal
from registry.ops import REVIEW_SUMMARY, THRESHOLD, dimensions, gl, summary_columns
from registry.sqltext import load, view
from rentloom import schemas
from rentloom.operators import ledger, ops, rentroll, workflow
from rentloom.plans import review as plan
from rentloom.session import scratch_dir
from rentloom.sources import files, reports, tables
from rentloom.streaming import commands as stream_commands
from rentloom.streaming import ledger as stream_ledger
from rentloom.streaming import monitor, runs

ENTRIES = Register()
entry = ENTRIES.entry


def put(df, path, fmt="parquet", **options):
    df.write.mode("append").options(**options).format(fmt).save(path)
    return path


# ---------------------------------------------------------------- sources


@entry(
    "read_ops_tables_s1",
    f"select property_id, period, kind, count(*) as n, {m('sum(amount)', 'amount')} from v_gl group by 1, 2, 3",
)
def read_ops_tables_s1(spark, d):
    root = scratch_dir(spark, "ops")
    li = spark.read.parquet(f"{d}/lineitem.parquet")
    rows = li.select(
        F.concat_ws("-", "l_partkey", "l_suppkey").alias("id"),
        F.format_string("p%03d", F.col("l_orderkey") % 20).alias("property_id"),
        F.col("l_orderkey").cast("string").alias("period_id"),
        (4000 + 100 * F.col("l_linenumber")).cast("string").alias("account_code"),
        F.lit("Account").alias("account_name"),
        F.lit("Payroll").alias("category"),
        F.col("l_extendedprice").alias("amount"),
        F.lit("f").alias("source_file"),
        F.col("l_linenumber").alias("source_row"),
        F.lit("2026").alias("created_at"),
        "l_linestatus",
    )
    put(rows.filter("l_linestatus = 'F'").drop("l_linestatus"), f"{root}/gl_actuals")
    put(rows.filter("l_linestatus <> 'F'").drop("l_linestatus"), f"{root}/gl_budgets")
    o = F.col("o_orderdate")
    periods = spark.read.parquet(f"{d}/orders.parquet").select(
        F.col("o_orderkey").cast("string").alias("id"), F.year(o).alias("year"), F.month(o).alias("month"), F.date_format(o, "yyyy-MM").alias("label")
    )
    put(periods, f"{root}/periods")
    empty = {"properties": schemas.PROPERTIES, "rent_roll_snapshots": schemas.SNAPSHOTS, "account_mappings": schemas.MAPPINGS}
    for name, ddl in empty.items():
        put(spark.createDataFrame([], schemas.contract(ddl)), f"{root}/{name}")
    rows = tables.ledger(tables.read_ops_tables(spark, root)).groupBy("property_id", "period", "kind")
    return texts(rows.agg(F.count("*").alias("n"), F.sum("amount").alias("amount")), "amount")


def stored_tables(spark, d):
    """The six operating tables, filled from the ledger, supplier and event views and written to the shared folder."""
    root = scratch_dir(spark, "tables")
    rows = gl(spark, d)
    lines = rows.withColumns({"period_id": F.concat(F.lit("per-"), "period"), "amount": F.col("amount").cast("double")})
    for kind in ("actual", "budget"):
        put(lines.filter(F.col("kind") == kind).drop("kind", "period"), f"{root}/gl_{kind}s")
    month = F.to_date(F.concat("period", F.lit("-01")))
    periods = rows.select("period").distinct()
    periods = periods.select(F.concat(F.lit("per-"), "period").alias("id"), F.year(month).alias("year"), F.month(month).alias("month"), F.col("period").alias("label"))
    put(periods, f"{root}/periods")
    properties, snapshots, mappings, _ = dimensions(spark, d)
    put(properties.withColumn("market", F.lit(None).cast("string")), f"{root}/properties")
    counts = {c: f"{c}_units" for c in ("occupied", "vacant", "down")}
    as_text = {c: F.col(c).cast("string") for c in ("as_of_date", "created_at")}
    numbers = {c: F.col(c).cast("int") for c in ("occupied", "vacant", "down", "source_row")}
    put(snapshots.withColumns({**as_text, **numbers}).withColumnsRenamed(counts), f"{root}/rent_roll_snapshots")
    put(mappings.withColumn("source_system", F.lit("ledger")), f"{root}/account_mappings")
    return root


@entry("review_from_tables_s1", REVIEW_SUMMARY)
def review_from_tables_s1(spark, d):
    inputs = tables.review_inputs(tables.read_ops_tables(spark, stored_tables(spark, d)))
    return summary_columns(plan.summary_table(*inputs, ops.Materiality(THRESHOLD), months_to_review=312, check_rows=True))


# Rows of account 4400 shipped on the first of a month lose their row number's sign, those of 4500 on the second their
# account's name, those of 4200 on the third have a category that is too long.
view(
    "v_gl_faults",
    """
    select * exclude (source_row, account_name, category),
           case when account_code = '4400' and created_at like '%-01' then -source_row else source_row end as source_row,
           case when account_code = '4500' and created_at like '%-02' then '' else account_name end as account_name,
           case when account_code = '4200' and created_at like '%-03' then repeat('x', 129) else category end as category,
           case when account_code = '4400' and created_at like '%-01' or account_code = '4500' and created_at like '%-02'
                  or account_code = '4200' and created_at like '%-03' then 1 else 0 end as planted
    from v_gl""",
)


@entry(
    "review_row_contract_p5",
    f"""select f.property_id, f.period, f.refused_rows, f.refused_rows > 0 as refused,
        {', '.join(m(f'case when f.refused_rows = 0 then b.{c} end', c) for c in ('actual_noi', 'budget_noi'))}
        from (select property_id, period, sum(planted)::bigint as refused_rows from v_gl_faults group by 1, 2) f
        left join v_o_bridge b on b.property_id = f.property_id and b.period = f.period""",
)
def review_row_contract_p5(spark, d):
    rows, fault = gl(spark, d), lambda code, day: (F.col("account_code") == code) & F.col("created_at").endswith(day)
    rows = rows.withColumns(
        {
            "source_row": F.when(fault("4400", "-01"), -F.col("source_row")).otherwise(F.col("source_row")),
            "account_name": F.when(fault("4500", "-02"), "").otherwise(F.col("account_name")),
            "category": F.when(fault("4200", "-03"), F.repeat(F.lit("x"), F.lit(129))).otherwise(F.col("category")),
        }
    )
    out = plan.summary_table(rows, *dimensions(spark, d), months_to_review=312, check_rows=True)
    out = out.withColumn("refused", F.array_contains("blockers", "INVALID_CONTRACT"))
    return texts(out.select("property_id", "period", "refused_rows", "refused", "actual_noi", "budget_noi"), "actual_noi", "budget_noi")


view(
    "v_revisions",
    """
    select 'rev' || cast(o_orderkey as string) as id, 'prop' || cast(o_custkey as string) as property, '2026-' || lpad(cast(o_orderkey % 3 + 1 as string), 2, '0') as period,
           cast(o_orderkey as int) as revision, cast(10 + o_orderkey % 90 as int) as unit_count, substr(cast(o_orderdate as string), 1, 10) as created_at
    from orders""",
)


def revisions(spark, d):
    rev = load(spark, d, "v_revisions")
    li = load(spark, d, "lineitem")
    lines = li.select(
        F.concat(F.lit("rev"), F.col("l_orderkey").cast("string")).alias("revision_id"),
        F.when(F.col("l_linestatus") == "F", "actual").otherwise("budget").alias("kind"),
        (F.col("l_linenumber") * 100000 + F.col("l_partkey")).cast("int").alias("ordinal"),
        F.col("l_linenumber").cast("string").alias("account_code"),
        F.lit("a").alias("account_name"),
        F.lit("c").alias("category"),
        F.round(F.col("l_extendedprice") * 100).cast("bigint").alias("amount_cents"),
    )
    snaps = rev.select(
        F.col("id").alias("revision_id"), F.col("created_at").alias("as_of_date"), F.lit(8).alias("occupied_units"), F.lit(1).alias("vacant_units"), F.lit(1).alias("down_units")
    )
    return rev, lines, snaps


@entry(
    "latest_revision_w4",
    "select property, period, max(revision) as revision, 'rev' || max(revision) as id from v_revisions group by 1, 2",
)
def latest_revision_w4(spark, d):
    return tables.latest_revision(load(spark, d, "v_revisions")).select("property", "period", "revision", "id")


@entry(
    "read_exact_revisions_s2",
    f"""select r.property as property_id, r.period, count(*) as n, {m('sum(cast(l_extendedprice as decimal(18,2)))', 'amount')}
        from (select property, period, max(revision) as k from v_revisions group by 1, 2) r join lineitem on l_orderkey = r.k group by 1, 2""",
)
def read_exact_revisions_s2(spark, d):
    rev, lines, _ = revisions(spark, d)
    out = tables.read_exact_revisions(rev.withColumn("input_sha256", F.lit("x")), lines).groupBy("property_id", "period")
    return texts(out.agg(F.count("*").alias("n"), F.sum("amount").alias("amount")), "amount")


@entry(
    "verify_revision_hash_s3",
    """select id, case when revision % 50 = 3 and exists (select 1 from lineitem where l_orderkey = revision) then 'INVALID_CONTRACT' when revision % 50 = 7 then 'INVALID_CONTRACT' end as error_code from v_revisions""",
)
def verify_revision_hash_s3(spark, d):
    """Stored hashes are rebuilt; then one cent is added to some ledgers and some snapshots are moved."""
    rev, lines, snaps = revisions(spark, d)
    stored = rev.join(tables.revision_digest(rev, lines, snaps).withColumnRenamed("revision_id", "id"), "id")
    stored = stored.withColumnRenamed("digest", "input_sha256")
    n = F.substring("revision_id", 4, 12).cast("bigint") % 50
    lines = lines.withColumn("amount_cents", F.col("amount_cents") + F.when(n == 3, 1).otherwise(0))
    snaps = snaps.withColumn("as_of_date", F.when(n == 7, "2030-01-01").otherwise(F.col("as_of_date")))
    return tables.verify_revision_hash(stored, lines, snaps).select("id", "error_code")


@entry(
    "read_standardized_csv_s4",
    """select 'asset_' || (c_nationkey % 5) as asset_id, count(*) filter (where c_mktsegment = 'FURNITURE') as vacant, count(*) filter (where c_mktsegment = 'AUTOMOBILE') as down, count(*) as units from customer group by 1""",
)
def read_standardized_csv_s4(spark, d):
    from rentloom.operators.occupancy import four_counts

    root = scratch_dir(spark, "standardized")
    c = load(spark, d, "customer")
    status = F.when(F.col("c_mktsegment") == "FURNITURE", " Vacant ").when(F.col("c_mktsegment") == "AUTOMOBILE", "DOWN").otherwise("Occupied")
    empty = [F.lit("").alias(n) for n in ("floorplan_code", "bed_type", "bath_count", "sqft", "market_rent", "lease_rent")]
    rolls = c.select("c_nationkey", F.col("c_custkey").cast("string").alias("unit_id"), *empty, status.alias("status"), F.lit("2026-05-31").alias("as_of_date"))
    for i in range(5):
        part = rolls.filter(F.col("c_nationkey") % 5 == i).drop("c_nationkey")
        put(part, f"{root}/asset_{i}/Standardized/rent_roll.csv", "csv", header="true")
    units = files.read_standardized_csv(spark, root, "rent_roll")
    return four_counts(units, "asset_id").select("asset_id", "vacant", "down", F.col("denominator").alias("units"))


@entry(
    "read_cells_s7",
    """select c::int as "column", count(*) as n, sum(length(regexp_replace(t, '[ \\t\\r\\n\\f\\v]', '', 'g')))::bigint as chars from (
         select 1 as c, cast(doc_id as varchar) as t from documents union all select 2, lang from documents union all select 3, text from documents) x group by 1""",
)
def read_cells_s7(spark, d):
    root = scratch_dir(spark, "cells")
    docs = load(spark, d, "documents").select("doc_id", "lang", "text")
    options = {"quoteAll": "true", "escape": '"', "ignoreLeadingWhiteSpace": "false", "ignoreTrailingWhiteSpace": "false"}
    put(docs, root, "csv", maxRecordsPerFile="20000", **options)
    cells = files.read_cells(spark, root)
    packed = F.length(F.regexp_replace("text", r"[ \t\r\n\f\x0b]", ""))
    return cells.groupBy("column").agg(F.count("*").alias("n"), F.sum(packed).alias("chars"))


@entry(
    "inventory_files_s10",
    """select deal, case k when 0 then 'pdf' when 1 then 'xls' when 2 then 'xlsx' when 3 then 'csv' else 'unknown' end as container, count(*) as count
       from (select 'deal' || (page_id % 7) as deal, page_id % 5 as k from pages) x group by 1, 2""",
)
def inventory_files_s10(spark, d):
    p, k = load(spark, d, "pages"), F.col("page_id") % 5
    head = F.when(k == 0, F.lit("255044462D312E34")).when(k == 1, "D0CF11E0A1B11AE1").when(k == 2, "504B0304").when(k == 3, F.hex(F.lit("a,b\n1,2\n"))).otherwise("00010203")
    binary = p.select(
        F.concat(F.lit("deal"), (F.col("page_id") % 7).cast("string")).alias("deal"),
        F.col("url").alias("path"),
        F.concat(F.unhex(head), F.encode("html", "UTF-8")).alias("content"),
    )
    return files.inventory_files(binary)


@entry(
    "fold_split_header_w12",
    """select 's' || c_custkey as source_id, f as field, p as "column", case when c_custkey % 6 = 1 then 'UNSUPPORTED_XLSX_LAYOUT' end as error_code
       from customer, (values ('unit', 1), ('unit_type', 2), ('sq_ft', 3), ('resident_name', 4), ('market_rent', 5), ('charge_code', 6), ('amount', 7), ('move_in', 8)) v(f, p)
       where not (c_custkey % 6 = 1 and f = 'amount')""",
)
def fold_split_header_w12(spark, d):
    c = load(spark, d, "customer")
    upper = ["Unit", "Unit", "Sq", "Resident", "Market", "Charge", "", "Move"]
    lower = ["", "Type", "Ft", "Name", "Rent", "Code", "Amount", "In"]
    no_amount = F.col("c_custkey") % 6 == 1
    items = [
        F.struct(F.lit(row).alias("row"), F.lit(i).alias("column"), (F.when(no_amount, "Notes").otherwise(t) if t == "Amount" else F.lit(t)).alias("text"))
        for row, line in ((5, upper), (6, lower))
        for i, t in enumerate(line, 1)
    ]
    cells = c.select(F.concat(F.lit("s"), F.col("c_custkey").cast("string")).alias("source_id"), F.lit(1).alias("sheet"), F.inline(F.array(*items)))
    return rentroll.fold_split_header(cells, 5, 6).drop("sheet")


# ---------------------------------------------------------------- sinks


@entry(
    "write_report_s11",
    """select 'deal ' || o_orderkey as subject, metric, case when metric = 'noi' then cast(cast(o_totalprice as decimal(18,2)) as varchar) end as amount,
        '<<BLOCKED: results are not complete; see blockers>>' as watermark from orders, (values ('noi'), ('egi')) v(metric) where o_orderkey % 7 in (0, 6)""",
)
def write_report_s11(spark, d):
    path = scratch_dir(spark, "report")
    reports.write_report(report_records(spark, d), path)
    out = spark.read.schema(schemas.contract(", ".join(f"{c} string" for c in reports.CSV_COLUMNS)))
    return out.option("header", "true").csv(f"{path}/metrics").select("subject", "metric", "amount", "watermark")


@entry(
    "ordered_report_rows_o2",
    """select k, metric, code as error_code, count(*) as n from (select o_orderkey % 7 as k, metric, case o_orderkey % 7 when 1 then 'INVALID_MONEY' when 2 then 'INVALID_MONEY' when 3 then 'CITATION_REQUIRED'
         when 4 then 'CITATION_WITHOUT_METRIC' when 5 then 'INVALID_SUBJECT' end as code from orders, (values ('noi'), ('egi')) v(metric)) x group by 1, 2, 3""",
)
def ordered_report_rows_o2(spark, d):
    records = report_records(spark, d)
    rows = reports.report_rows(records.withColumn("run_id", F.col("k").cast("string")))
    styled = records.select("subject", "k").distinct().groupBy("subject").agg(F.min("k").alias("k"))
    return rows.join(styled, "subject").groupBy("k", "metric", "error_code").agg(F.count("*").alias("n"))


@entry(
    "ordered_sink_o2",
    """select step, count(*) as rows, step = 'written' as in_order from v_gl, (values ('written'), ('swapped')) s(step) group by 1""",
)
def ordered_sink_o2(spark, d):
    """The ledger in (property, period, account) order over several files; with two of them swapped the order is gone."""
    path, keys = scratch_dir(spark, "ordered"), ["property_id", "period", "account_code"]
    files = reports.files_for(load(spark, d, "lineitem").count(), 6)
    reports.write_ordered(gl(spark, d), keys, path, files)
    written = reports.order_faults(spark, path, keys).isEmpty()
    of = spark._jvm.org.apache.hadoop.fs.Path
    fs = of(path).getFileSystem(spark._jsc.hadoopConfiguration())
    first, second = sorted(f.getPath().getName() for f in fs.listStatus(of(f"{path}/data")) if f.getPath().getName().startswith("part-"))[:2]
    for a, b in ((first, "held"), (second, first), ("held", second)):
        fs.rename(of(f"{path}/data/{a}"), of(f"{path}/data/{b}"))
    swapped = reports.order_faults(spark, path, keys).isEmpty()
    rows = spark.read.parquet(f"{path}/data").agg(F.count("*").alias("rows"))
    steps = F.array(*[F.struct(F.lit(n).alias("step"), F.lit(v).alias("in_order")) for n, v in (("written", written), ("swapped", swapped))])
    return rows.select("rows", F.inline(steps)).select("step", "rows", "in_order")


@entry(
    "publish_once_s12",
    f"select property_id, kind, {m('sum(amount)', 'amount')} from v_gl group by 1, 2",
)
def publish_once_s12(spark, d):
    path = scratch_dir(spark, "published")
    sums = gl(spark, d).groupBy("property_id", "kind").agg(F.sum("amount").cast("decimal(38,2)").alias("amount"))
    reports.publish_once(sums, path, "parquet")
    return texts(spark.read.parquet(path), "amount")


# ---------------------------------------------------------------- bound variance function


@entry(
    "bound_variance_x1",
    f"""select v.property_id, v.period, count(*) filter (where abs(case when category in ('Rental Income', 'Other Income') then variance else -variance end) >= {THRESHOLD}) as material_variances,
        count(*) filter (where case when category in ('Rental Income', 'Other Income') then variance else -variance end < 0) as unfavourable from v_o_variance v group by 1, 2""",
)
def bound_variance_x1(spark, d):
    """A caller's variance function: expenses count with the opposite sign, so negative is always unfavourable."""

    def favourable(accounts):
        v = ops.account_variance(accounts)
        revenue = F.lower("category").isin(ops.REVENUE_CATEGORIES)
        return v.withColumn("variance", F.when(revenue, F.col("variance")).otherwise(-F.col("variance")))

    r = plan.review(gl(spark, d), *dimensions(spark, d), variance_fn=favourable)
    rows = r.accounts.filter("variance is not null").groupBy("property_id", "period")
    return rows.agg(
        F.count_if("is_material").alias("material_variances"), F.count_if(F.col("variance") < 0).alias("unfavourable")
    )


@entry(
    "variance_not_bound_x1",
    "select distinct property_id, period, 'VARIANCE_NOT_IMPLEMENTED' as code, 'blocker' as severity from v_gl",
)
def variance_not_bound_x1(spark, d):
    from rentloom.session import cut_lineage

    r = plan.review(gl(spark, d), *dimensions(spark, d), variance_fn=None, stage=cut_lineage)
    out = plan.exceptions(r).filter("code = 'VARIANCE_NOT_IMPLEMENTED'")
    return out.select("property_id", "period", "code", "severity")


# ---------------------------------------------------------------- streams


def facts(spark, d):
    """Assertions without corrections, one per event."""
    a = load(spark, d, "v_assertions").drop("ts").withColumn("supersedes_event_id", F.lit(None).cast("bigint"))
    return a.select(*schemas.contract(schemas.ASSERTIONS).fieldNames())


def streamed(spark, d):
    """The ledger after a stream of all facts, replays of every fourth and altered copies of every tenth."""
    root = scratch_dir(spark, "stream")
    base, k = facts(spark, d), F.col("event_id")
    altered = base.filter(k % 10 == 3).withColumns(
        {"value": (F.col("value") + 1).cast("decimal(18,2)"), "recorded_at": F.col("recorded_at") + F.expr("interval 400 days")}
    )
    whole = False
    for rows in (base, base.filter(k % 4 == 0), altered):
        put(rows, f"{root}/in")
        whole = stream_ledger.resume_import(spark, f"{root}/in", f"{root}/ledger", f"{root}/conflicts", f"{root}/checkpoint", 100)
    return root, whole


@entry(
    "ingest_assertions_t1",
    f"""select cast(user_id as varchar) as aggregate_id, count(*) as facts, count(*) as top_version, count(distinct event_id) as versions, count(*) filter (where event_id % 10 = 3) as conflicts,
        {m('sum(cast(value as decimal(18,2)))', 'value')} from events group by 1""",
)
def ingest_assertions_t1(spark, d):
    root, _ = streamed(spark, d)
    kept = spark.read.parquet(f"{root}/ledger").groupBy("aggregate_id")
    kept = kept.agg(F.count("*").alias("facts"), F.max("version").alias("top_version"), F.count_distinct("version").alias("versions"), F.sum("value").alias("value"))
    clash = spark.read.parquet(f"{root}/conflicts").groupBy("aggregate_id").agg(F.count("*").alias("conflicts"))
    out = kept.join(clash, "aggregate_id", "left").withColumn("conflicts", F.coalesce("conflicts", F.lit(0)))
    return texts(out, "value")


# Three deliveries of commands, one for each event, and repeats of a fifth of them. The first holds all but
# 4 and 6 of ten: some expect another version, some correct an unknown fact. The second holds old facts with their old
# record times (4 of 10) and corrections of each aggregate's first accepted fact (6 of 10). The third repeats commands,
# some unchanged (1 of 10), some with another value (2 of 10).
view(
    "v_command_anchor",
    """
    select aggregate_id, max(ts) as last_at, max(case when n = 1 then event_id end) as anchor, max(case when n = 1 then key end) as anchor_key from (
      select aggregate_id, key, event_id, ts, row_number() over (partition by aggregate_id order by ts, event_id) as n from v_assertions
      where event_id % 10 not in (3, 4, 5, 6)) f group by 1""",
)


@entry(
    "append_rules_t1",
    f"""
    with first as (
      select a.*, event_id % 10 as d, c.last_at, c.anchor from v_assertions a left join v_command_anchor c on c.aggregate_id = a.aggregate_id
    ),
    judged as (
      select aggregate_id, event_id, value, case
          when d = 3 then 'OBSOLETE_VERSION' when d = 5 then 'UNKNOWN_TARGET' when d = 4 and ts < last_at then 'CLOCK_BACKWARD'
          when d = 6 and anchor is null then 'UNKNOWN_TARGET'
          when d = 6 and row_number() over (partition by aggregate_id, d order by ts, event_id) > 1 then 'SECOND_CORRECTION' end as error_code, 'new' as good from first
      union all
      select aggregate_id, event_id, value + d - 1, case when d = 2 then 'SOURCE_REVISION_CHANGED' end, 'replay' from first where d in (1, 2)
    )
    select aggregate_id, case when error_code is null then good else 'conflict' end as verdict, error_code, count(*) as commands,
           sum(event_id)::bigint as events, {m('sum(value)', 'value')},
           case when error_code is null and good = 'new' then count(*) end as top_version
    from judged group by aggregate_id, good, error_code""",
)
def append_rules_t1(spark, d):
    root, k = scratch_dir(spark, "commands"), F.col("event_id") % 10
    facts = load(spark, d, "v_assertions").withColumns({"recorded_at": F.col("ts"), "supersedes_event_id": F.lit(None).cast("bigint")})
    anchors = load(spark, d, "v_command_anchor").select("aggregate_id", "anchor", "anchor_key")
    corrections = facts.filter(k == 6).join(anchors, "aggregate_id", "left").withColumns(
        {
            "supersedes_event_id": F.coalesce("anchor", F.lit(1 << 60)),
            "key": F.coalesce("anchor_key", "key"),
            "recorded_at": F.col("ts") + F.expr("interval 1000 days"),
        }
    )
    first = facts.filter(~k.isin(4, 6)).withColumn("supersedes_event_id", F.when(k == 5, F.lit(1 << 60)))
    first = first.withColumn("expected_version", F.when(k == 3, F.lit(1 << 40)))
    second = facts.filter(k == 4).unionByName(corrections.select(facts.columns))
    third = facts.filter(k.isin(1, 2)).withColumn("value", (F.col("value") + F.when(k == 2, 1).otherwise(0)).cast("decimal(18,2)"))
    columns = [f.name for f in schemas.contract(stream_commands.COMMANDS)]
    for rows in (first, second, third):
        if "expected_version" not in rows.columns:
            rows = rows.withColumn("expected_version", F.lit(None).cast("bigint"))
        put(rows.select(columns), f"{root}/in")
        stream = stream_commands.read_commands(spark, f"{root}/in")
        stream_commands.append_commands(stream, f"{root}/judged", f"{root}/checkpoint").awaitTermination()
    judged = spark.read.parquet(f"{root}/judged").groupBy("aggregate_id", "verdict", "error_code")
    top = F.max(F.when(F.col("verdict") == "new", F.col("version")))
    out = judged.agg(F.count("*").alias("commands"), F.sum("event_id").alias("events"), F.sum("value").alias("value"), top.alias("top_version"))
    return texts(out, "value")


@entry(
    "resume_import_t4",
    "select count(*) as facts, true as validated from events",
)
def resume_import_t4(spark, d):
    """The import is run twice over the same checkpoint; the second run finds nothing to do."""
    root, _ = streamed(spark, d)
    again = stream_ledger.resume_import(spark, f"{root}/in", f"{root}/ledger", f"{root}/conflicts", f"{root}/checkpoint", 2)
    return spark.read.parquet(f"{root}/ledger").agg(F.count("*").alias("facts")).withColumn("validated", F.lit(again))


@entry(
    "freeze_reports_t5",
    """select 'issued' as state, cast(user_id as varchar) as report_id, null as error_code from events group by 2
       union all select 'refused', cast(user_id as varchar), 'REPORT_ALREADY_ISSUED' from events where user_id % 3 = 0 group by 2""",
)
def freeze_reports_t5(spark, d):
    """One report per user, issued again unchanged for every second and with other content for every third."""
    root, n = scratch_dir(spark, "reports"), F.col("report_id").cast("bigint")
    users = spark.read.parquet(f"{d}/events.parquet").groupBy(F.col("user_id").cast("string").alias("report_id")).agg(F.sum("value").cast("decimal(18,2)").alias("v"))
    content = F.to_json(F.struct(F.lit("original_thesis/1").alias("type"), F.col("report_id").alias("deal_id"), "v"))
    first = users.select(F.lit("w").alias("workspace_id"), "report_id", F.col("report_id").alias("aggregate_id"), content.alias("content_json"))
    other = first.filter(n % 3 == 0).withColumn("content_json", F.concat("content_json", F.lit(" ")))
    for rows in (first, first.filter(n % 2 == 0), other):
        put(rows, f"{root}/in")
        stream = spark.readStream.schema(first.schema).parquet(f"{root}/in")
        stream_ledger.freeze_reports(stream, f"{root}/issued", f"{root}/checkpoint", f"{root}/refused").awaitTermination()
    issued = ledger.read_report(spark.read.parquet(f"{root}/issued")).select(F.lit("issued").alias("state"), "report_id", "error_code")
    refused = spark.read.option("basePath", f"{root}/refused").parquet(f"{root}/refused")
    return issued.unionByName(refused.select(F.lit("refused").alias("state"), "report_id", "error_code"))


@entry(
    "late_facts_t3",
    """select p.point, count(*) as facts from v_assertions a join (values ('early', date '2024-01-10', timestamp '2024-01-11'), ('late', date '2024-01-10', timestamp '2024-06-01')) p(point, effective_at, known_at)
       on a.recorded_at <= p.known_at and a.valid_from <= p.effective_at and (a.valid_to is null or p.effective_at < a.valid_to) group by 1""",
)
def late_facts_t3(spark, d):
    root, _ = streamed(spark, d)
    points = [("early", date(2024, 1, 10), datetime(2024, 1, 11)), ("late", date(2024, 1, 10), datetime(2024, 6, 1))]
    known = ledger.as_known(spark.read.parquet(f"{root}/ledger"), points)
    return known.groupBy("point").agg(F.sum("facts").alias("facts"))


@entry(
    "stale_versions_t2",
    """select cast(user_id as varchar) as aggregate_id, case when user_id % 3 = 0 then 'OBSOLETE_VERSION' end as error_code from events group by 1, 2""",
)
def stale_versions_t2(spark, d):
    root, _ = streamed(spark, d)
    accepted = spark.read.parquet(f"{root}/ledger")
    top = accepted.groupBy("workspace_id", "aggregate_id").agg(F.max("version").alias("expected_version"))
    behind = F.when(F.col("aggregate_id").cast("bigint") % 3 == 0, 1).otherwise(0)
    commands = top.withColumn("expected_version", F.col("expected_version") - behind)
    return stream_ledger.stale_versions(commands, accepted).select("aggregate_id", "error_code")


@entry(
    "feed_monitor_t6",
    """select property_id, cast(max(as_of_date) as varchar) as as_of, case when date_diff('day', max(as_of_date), date '2024-03-01') > 31 then 'stale' else 'current' end as freshness from v_snapshots group by 1""",
)
def feed_monitor_t6(spark, d):
    root = scratch_dir(spark, "monitor")
    snaps = load(spark, d, "v_snapshots").select("property_id", "as_of_date", "occupied", "vacant", "down")

    def publish(batch, number):
        batch.write.mode("overwrite").parquet(f"{root}/out")

    for half in (0, 1):
        put(snaps.filter(F.pmod(F.xxhash64("as_of_date"), F.lit(2)) == half), f"{root}/in")
        stream = spark.readStream.schema(schemas.contract(schemas.SNAPSHOT_STREAM)).parquet(f"{root}/in")
        q = monitor.feed_monitor(stream, "2024-03-01", 31).writeStream.outputMode("complete").foreachBatch(publish)
        q.option("checkpointLocation", f"{root}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(f"{root}/out").select("property_id", F.col("as_of").cast("string").alias("as_of"), "freshness")


@entry(
    "journal_state_t7",
    """select k as run_id, len + case when twice then 1 else 0 end as events, case when (k % 23 = 5 and len >= 2) or (twice and k % 4 = 0) then 'CORRUPT_INPUT' end as error_code,
        case when not ((k % 23 = 5 and len >= 2) or (twice and k % 4 = 0)) then case len when 1 then 'inspected' when 2 then 'normalized' when 3 then 'review_required' when 4 then 'review_required' when 5 then 'reconciled'
          when 6 then 'canonical_ready' when 7 then 'execution_authorized' when 8 then 'engine_executed' else 'report_ready' end end as stage
       from (select o_orderkey as k, o_orderkey % 9 + 1 as len, o_orderkey % 9 = 3 and o_orderkey % 2 = 0 as twice from orders) a""",
)
def journal_state_t7(spark, d):
    from registry.governance import journal

    root = scratch_dir(spark, "journal")
    events = journal(spark, d).withColumns({"run_id": F.col("run_id").cast("string"), "n": F.col("n").cast("bigint")})

    for rows in (events.filter("n <= 4"), events.filter("n > 4")):
        put(rows, f"{root}/in")
        stream = spark.readStream.schema(schemas.contract(schemas.JOURNAL)).parquet(f"{root}/in")
        runs.write_states(monitor.journal_state(stream), f"{root}/out", f"{root}/checkpoint", "update").awaitTermination()
    last = F.max_by(F.struct("stage", "events", "error_code"), "batch").alias("s")
    out = spark.read.parquet(f"{root}/out").groupBy("run_id").agg(last)
    return out.select(F.col("run_id").cast("bigint").alias("run_id"), "s.stage", "s.events", "s.error_code")


@entry("run_states_t7", RECORDS_SQL)
def run_states_t7(spark, d):
    """The events of all runs in two deliveries, each with about half of the numbers of every run, in no order."""
    root, events = scratch_dir(spark, "runs"), run_journal(spark, d)
    columns = [f.name for f in schemas.contract(workflow.EVENTS)]
    for half in (0, 1):
        put(events.filter(F.pmod(F.xxhash64("run_id", "n"), F.lit(2)) == half).select(columns), f"{root}/in", compression="zstd")
        stream = spark.readStream.schema(schemas.contract(workflow.EVENTS)).parquet(f"{root}/in")
        runs.write_states(runs.run_states(stream), f"{root}/out", f"{root}/checkpoint", "update").awaitTermination()
    return record_counts(runs.last_states(spark.read.parquet(f"{root}/out")))


@entry(
    "feed_alerts_t6",
    """
    with fed as (
      select property_id, max(cast(as_of_date - case when cast(substr(property_id, 2) as int) % 7 = 3 then 60 else 0 end as date)) as as_of from v_snapshots group by 1
    )
    select property_id, cast(as_of as varchar) as as_of, case when date_diff('day', as_of, (select max(as_of) from fed)) > 45 then 'stale' else 'current' end as freshness from fed""",
)
def feed_alerts_t6(spark, d):
    """Feeds of every seventh property are sixty days behind; nothing tells so but the days of the others."""
    root = scratch_dir(spark, "alerts")
    late = F.col("property_id").substr(2, 9).cast("int") % 7 == 3
    snaps = load(spark, d, "v_snapshots").withColumn("as_of_date", F.date_sub("as_of_date", F.when(late, 60).otherwise(0)))
    snaps = snaps.select("property_id", "as_of_date", "occupied", "vacant", "down")
    for part in range(3):
        put(snaps.filter(F.pmod(F.xxhash64("as_of_date"), F.lit(3)) == part), f"{root}/in")
        stream = spark.readStream.schema(schemas.contract(schemas.SNAPSHOT_STREAM)).parquet(f"{root}/in")
        runs.write_states(runs.feed_alerts(stream), f"{root}/out", f"{root}/checkpoint").awaitTermination()
    alerts = spark.read.parquet(f"{root}/out").groupBy("property_id", "as_of").agg(F.max("freshness").alias("freshness"))
    last = alerts.groupBy("property_id").agg(F.max_by(F.struct("as_of", "freshness"), "as_of").alias("s"))
    return last.select("property_id", F.col("s.as_of").cast("string").alias("as_of"), "s.freshness")
