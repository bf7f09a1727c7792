"""Ledger review and occupancy queries with their SQL twins."""

from __future__ import annotations

from pyspark.sql import functions as F

from registry.common import Register, m, texts
from registry.sqltext import load, view
from rentloom.functions.money import money_text
from rentloom.functions.period import month_end
from rentloom.operators import occupancy, ops
from rentloom.plans import review as plan
from rentloom.session import cut_lineage

ENTRIES = Register()
entry = ENTRIES.entry
THRESHOLD = "50000.00"
REVIEW_DAY = "2024-03-01"

view(
    "v_o_clean",
    """
    select * from (
      select *, row_number() over (partition by property_id, period, kind, source_file, source_row, account_code
                                   order by created_at, id, amount, account_name, category) as rn,
             count(*) over (partition by property_id, period, kind, source_file, source_row, account_code) as copies,
             min(amount) over (partition by property_id, period, kind, source_file, source_row, account_code) <>
             max(amount) over (partition by property_id, period, kind, source_file, source_row, account_code) as amounts_differ
      from v_gl) x where rn = 1""",
)
view(
    "v_o_rollup",
    """
    select property_id, period, account_code, min(account_name) as account_name, min(category) as category,
           count(*) filter (where kind = 'actual') as actual_rows, count(*) filter (where kind = 'budget') as budget_rows,
           sum(amount) filter (where kind = 'actual') as actual, sum(amount) filter (where kind = 'budget') as budget,
           count(*) filter (where copies > 1) as duplicate_groups, sum(copies - 1) as duplicate_rows
    from v_o_clean group by 1, 2, 3""",
)
view(
    "v_o_variance",
    """
    select a.property_id, a.period, a.account_code, a.account_name, a.category, a.actual, b.budget, a.actual - b.budget as variance
    from (select property_id, period, account_code, min(account_name) as account_name, min(category) as category, sum(amount) as actual
          from v_o_clean where kind = 'actual' group by 1, 2, 3) a
    join (select property_id, period, account_code, sum(amount) as budget from v_o_clean where kind = 'budget' group by 1, 2, 3) b
    using (property_id, period, account_code)""",
)
view(
    "v_o_bridge",
    """
    select *, actual_revenue - actual_expenses as actual_noi, budget_revenue - budget_expenses as budget_noi from (
      select property_id, period, count(*) as covered_accounts,
             sum(case when category in ('Rental Income','Other Income') then actual else 0 end) as actual_revenue,
             sum(case when category in ('Rental Income','Other Income') then budget else 0 end) as budget_revenue,
             sum(case when category not in ('Rental Income','Other Income','Unmapped') then actual else 0 end) as actual_expenses,
             sum(case when category not in ('Rental Income','Other Income','Unmapped') then budget else 0 end) as budget_expenses,
             sum(case when category = 'Unmapped' then actual else 0 end) as unmapped_actual,
             sum(case when category = 'Unmapped' then budget else 0 end) as unmapped_budget
      from v_o_variance group by 1, 2) x""",
)
view(
    "v_o_daily",
    """
    select *, lag(as_of_date) over w as p_as_of, lag(occupied) over w as p_occupied, lag(vacant) over w as p_vacant, lag(down) over w as p_down
    from (select * from (select *, row_number() over (partition by property_id, as_of_date order by created_at desc, id desc) as rn
                         from v_snapshots) s where rn = 1) d
    window w as (partition by property_id order by as_of_date)""",
)
view(
    "v_o_states",
    """
    select account_code, case when coalesce(lower(trim(property_scope)), '') in ('', '*') then '*' else lower(trim(property_scope)) end as scope,
           count(distinct noi_category || '/' || status) as n, min(noi_category) as noi_category, min(status) as status
    from v_mappings group by 1, 2""",
)
view(
    "v_o_mapped",
    """
    select r.property_id, r.period, r.account_code, coalesce(o.n, w.n) as n,
           case when o.n is not null then o.noi_category else w.noi_category end as noi_category,
           case when o.n is not null then o.status else w.status end as status, r.ncat, r.cat
    from (select property_id, period, account_code, count(distinct category) as ncat, min(category) as cat from v_o_clean group by 1, 2, 3) r
    left join v_o_states o on o.account_code = r.account_code and o.scope = r.property_id
    left join v_o_states w on w.account_code = r.account_code and w.scope = '*'""",
)
view(
    "v_o_reasons",
    """
    select *, case when n is null then 'absent' when n > 1 then 'conflicting' when status <> 'approved' then 'status' end as reason,
           case when n is null or n > 1 or status <> 'approved' then 'UNREVIEWED_ACCOUNT_MAPPING'
                when ncat <> 1 or cat <> noi_category then 'CHANGED_ACCOUNT_MAPPING' end as error_code
    from v_o_mapped""",
)
view(
    "v_o_bounds",
    """
    select distinct property_id, period,
           cast(cast(period || '-01' as date) + interval 1 month - interval 1 day as date) as month_close from v_gl""",
)
# Each review of the ledger is dated 300 months after its period so that the event snapshots of 2024 are in reach.
view(
    "v_o_occ",
    """
    select b.property_id, b.period, b.bound, d.as_of_date, d.occupied, d.vacant, d.down, d.occupied + d.vacant + d.down as denominator,
           d.p_as_of, d.p_occupied, p.unit_count, date_diff('day', d.as_of_date, b.bound) as age_days
    from (select property_id, period, cast(cast(period || '-01' as date) + interval 312 month as date) as bound from v_o_bounds) b
    asof left join v_o_daily d on d.property_id = b.property_id and d.as_of_date <= b.bound
    left join v_properties p on p.id = b.property_id""",
)


def gl(spark, d):
    return load(spark, d, "v_gl")


def rollup(spark, d):
    return ops.actual_budget_coverage(ops.account_rollup(ops.dedupe_gl(gl(spark, d))))


def full_review(spark, d, stage=cut_lineage):
    ledger = gl(spark, d)
    days = ledger.select("property_id", "period").distinct()
    days = days.withColumn("review_day", F.add_months(F.to_date(F.concat("period", F.lit("-01"))), 312))
    return plan.review(ledger, *dimensions(spark, d), days, stage=stage)


def dimensions(spark, d):
    names = ("v_properties", "v_snapshots", "v_mappings")
    return *(load(spark, d, n) for n in names), ops.Materiality(THRESHOLD)


BRIDGE = ["actual_revenue", "budget_revenue", "actual_expenses", "budget_expenses", "actual_noi", "budget_noi"]


@entry(
    "gl_with_period_j1",
    f"select property_id, period, count(*) as n, {m('sum(amount)', 'amount')} from v_gl group by 1, 2",
)
def gl_with_period_j1(spark, d):
    from registry.sqltext import pid

    li = spark.read.parquet(f"{d}/lineitem.parquet").select(
        F.expr(pid("l_orderkey")).alias("property_id"),
        F.col("l_orderkey").alias("period_id"),
        F.col("l_extendedprice").cast("decimal(18,2)").alias("amount"),
    )
    periods = spark.read.parquet(f"{d}/orders.parquet").select(
        F.col("o_orderkey").alias("id"), F.date_format("o_orderdate", "yyyy-MM").alias("label")
    )
    df = ops.gl_with_period(li, periods).groupBy("property_id", "period")
    return texts(df.agg(F.count("*").alias("n"), F.sum("amount").alias("amount")), "amount")


@entry(
    "dedupe_gl_w3",
    f"""select property_id, period, kind, source_file, source_row, account_code, id, created_at, {m('amount', 'amount')},
        copies, amounts_differ from v_o_clean""",
)
def dedupe_gl_w3(spark, d):
    return texts(ops.dedupe_gl(gl(spark, d)).drop("account_name", "category"), "amount")


@entry(
    "duplicate_imports_a10",
    f"""select property_id, period, count(*) as groups, sum(copies - 1)::bigint as extra_rows,
        count(*) filter (where amounts_differ) as differing, {m('sum(amount)', 'kept_amount')}
        from v_o_clean where copies > 1 group by 1, 2""",
)
def duplicate_imports_a10(spark, d):
    dup = ops.duplicate_imports(ops.dedupe_gl(gl(spark, d))).groupBy("property_id", "period")
    return texts(
        dup.agg(
            F.count("*").alias("groups"),
            F.sum(F.col("copies") - 1).alias("extra_rows"),
            F.count_if("amounts_differ").alias("differing"),
            F.sum("amount").alias("kept_amount"),
        ),
        "kept_amount",
    )


@entry(
    "actual_budget_coverage_j2",
    """select coalesce(a.property_id, b.property_id) as property_id, coalesce(a.period, b.period) as period,
        coalesce(a.account_code, b.account_code) as account_code,
        case when a.n is not null and b.n is not null then 'covered' when a.n is not null then 'MISSING_BUDGET' else 'BUDGET_WITHOUT_ACTUAL' end as coverage
        from (select property_id, period, account_code, count(*) as n from v_o_clean where kind = 'actual' group by 1, 2, 3) a
        full outer join (select property_id, period, account_code, count(*) as n from v_o_clean where kind = 'budget' group by 1, 2, 3) b
        on a.property_id = b.property_id and a.period = b.period and a.account_code = b.account_code""",
)
def actual_budget_coverage_j2(spark, d):
    return rollup(spark, d).select("property_id", "period", "account_code", "coverage")


@entry(
    "account_variance_a7",
    f"""select property_id, period, account_code, account_name, category, {m('actual', 'actual')}, {m('budget', 'budget')},
        {m('variance', 'variance')}, cast(null as varchar) as error_code from v_o_variance""",
)
def account_variance_a7(spark, d):
    return texts(ops.account_variance(rollup(spark, d)), "actual", "budget", "variance")


@entry(
    "noi_bridge_a8",
    f"""select property_id, period, covered_accounts, {', '.join(m(c, c) for c in BRIDGE)}, {m('unmapped_actual', 'unmapped_actual')},
        {m('unmapped_budget', 'unmapped_budget')}, {m('actual_revenue - budget_revenue', 'revenue_variance')},
        {m('actual_expenses - budget_expenses', 'expense_variance')}, {m('actual_noi - budget_noi', 'noi_variance')} from v_o_bridge""",
)
def noi_bridge_a8(spark, d):
    b = ops.noi_bridge(ops.account_variance(rollup(spark, d))).drop("bridge_error")
    return texts(b, *[c for c in b.columns if c not in ("property_id", "period", "covered_accounts")])


@entry(
    "material_variances_a9",
    f"""select property_id, period, account_code, {m('variance', 'variance')},
        row_number() over (partition by property_id, period order by abs(variance) desc, account_code) as rank
        from v_o_variance where abs(variance) >= {THRESHOLD}""",
)
def material_variances_a9(spark, d):
    v = ops.material_variances(ops.account_variance(rollup(spark, d)), THRESHOLD)
    return texts(v.select("property_id", "period", "account_code", "variance", "rank"), "variance")


@entry(
    "review_counts_a11",
    """select property_id, period, sum(actual_rows)::bigint as actual_rows, sum(budget_rows)::bigint as budget_rows,
        count(*) as distinct_accounts, sum(duplicate_groups)::bigint as duplicate_groups, sum(duplicate_rows)::bigint as duplicate_rows
        from v_o_rollup group by 1, 2""",
)
def review_counts_a11(spark, d):
    return ops.review_counts(rollup(spark, d))


@entry(
    "map_accounts_j3",
    "select property_id, period, account_code, reason, error_code from v_o_reasons",
)
def map_accounts_j3(spark, d):
    out = ops.map_accounts(rollup(spark, d), load(spark, d, "v_mappings"))
    return out.select("property_id", "period", "account_code", "reason", "error_code")


@entry(
    "mapping_codes_j4",
    f"""select property_id, account_code, count(*) as n, {m('sum(amount)', 'amount')} from v_gl
        where account_code in (select account_code from v_mappings where noi_category = 'Repairs & Maintenance') group by 1, 2""",
)
def mapping_codes_j4(spark, d):
    codes = ops.mapping_codes(load(spark, d, "v_mappings"), "Repairs & Maintenance")
    rows = gl(spark, d).join(codes, "account_code", "left_semi").groupBy("property_id", "account_code")
    return texts(rows.agg(F.count("*").alias("n"), F.sum("amount").alias("amount")), "amount")


view(
    "v_o_t12",
    """
    select e.property_id, e.end_period, sum(r.amount) as value, string_agg(distinct r.account_code, ',' order by r.account_code) as codes
    from (select property_id, max(period) as end_period from v_gl where kind = 'actual' group by 1) e
    left join (select distinct property_id, period, account_code, account_name, source_row, amount from v_gl
               where kind = 'actual' and category = 'Repairs & Maintenance') r
      on r.property_id = e.property_id
     and date_diff('month', cast(r.period || '-01' as date), cast(e.end_period || '-01' as date)) between 0 and 11
    group by 1, 2""",
)


@entry(
    "t12_category_sum_a1",
    f"""select property_id, end_period as as_of, strftime(cast(end_period || '-01' as date) - interval 11 month, '%Y-%m') as window_start,
        {m('value', 'value')}, case when value is not null then 'usd' end as unit, coalesce(codes, '') as account_codes,
        case when value is null then 'NOT_FOUND' end as error_code from v_o_t12""",
)
def t12_category_sum_a1(spark, d):
    out = ops.t12_category_sum(gl(spark, d), "Repairs & Maintenance")
    return texts(out, "value").withColumn("account_codes", F.array_join("account_codes", ","))


@entry(
    "t12_from_budget_comparison_a2",
    f"""select e.property_id, e.end_period as as_of, {m('sum(r.amount)', 'value')}
        from (select property_id, max(period) as end_period from v_gl group by 1) e
        left join v_gl r on r.property_id = e.property_id and r.account_code = '4300'
          and date_diff('month', cast(r.period || '-01' as date), cast(e.end_period || '-01' as date)) between 0 and 11
        group by 1, 2""",
)
def t12_from_budget_comparison_a2(spark, d):
    stamp = F.to_date(F.concat("period", F.lit("-01")))
    feed = gl(spark, d).select(
        "property_id",
        F.when(F.col("source_row") % 2 == 1, F.date_format(stamp, "MMM yyyy")).otherwise(F.col("period")).alias("period"),
        "account_code",
        F.concat(F.lit("$"), F.format_number(F.col("amount"), 2)).alias("ptd_actual"),
    )
    codes = ops.mapping_codes(load(spark, d, "v_mappings"), "Repairs & Maintenance")
    return texts(ops.t12_from_budget_comparison(feed, codes), "value").select("property_id", "as_of", "value")


@entry(
    "trailing_12_w5",
    f"""select property_id, account_code, period, {m('amount', 'amount')},
        {m("sum(amount) over w", 't12')}, count(*) over w as months_present
        from (select property_id, account_code, period, cast(period || '-01' as date) as d, sum(amount) as amount from v_gl where kind = 'actual' group by 1, 2, 3) x
        window w as (partition by property_id, account_code order by d range between interval 11 month preceding and current row)""",
)
def trailing_12_w5(spark, d):
    out = ops.trailing_12(gl(spark, d).filter("kind = 'actual'"), ["property_id", "account_code"])
    return texts(out.drop("window_start"), "amount", "t12")


@entry(
    "get_t12_c2",
    "select property_id, account_code, "
    + ", ".join(m(f"sum(amount) filter (where period = '1997-{i:02d}')", f"m_1997_{i:02d}") for i in range(1, 13))
    + " from v_gl where kind = 'actual' and period like '1997-%' group by 1, 2",
)
def get_t12_c2(spark, d):
    out = ops.get_t12(gl(spark, d), "1997-12")
    months = [c for c in out.columns if c.startswith("1997")]
    return out.select(
        "property_id",
        "account_code",
        *[money_text(F.col(f"`{c}`")).alias("m_" + c.replace("-", "_")) for c in months],
    )


@entry(
    "prefer_backend_s5",
    f"""select p.id as property_id, case when a.n > 0 then 'primary' when b.n > 0 then 'fallback' end as backend,
        {m('case when a.n > 0 then a.amount when b.n > 0 then b.amount end', 'amount')},
        case when a.n is null and b.n is null then 'NOT_FOUND' end as error_code
        from v_properties p
        left join (select property_id, count(*) as n, sum(amount) as amount from v_gl where kind = 'actual' and property_id < 'p010' group by 1) a on a.property_id = p.id
        left join (select property_id, count(*) as n, sum(amount) as amount from v_gl where kind = 'budget' and property_id < 'p015' group by 1) b on b.property_id = p.id""",
)
def prefer_backend_s5(spark, d):
    rows = gl(spark, d).select("property_id", "kind", "amount")
    primary = rows.filter("kind = 'actual' and property_id < 'p010'").drop("kind")
    fallback = rows.filter("kind = 'budget' and property_id < 'p015'").drop("kind")
    keys = load(spark, d, "v_properties").select(F.col("id").alias("property_id"))
    out = ops.prefer_backend(primary, fallback, keys, "property_id").groupBy("property_id", "backend", "error_code")
    return texts(out.agg(F.sum("amount").alias("amount")), "amount")


@entry(
    "enforce_limits_s13",
    """select property_id, kind, count(*) as row_count, case when count(*) > 1000 then 'INPUT_LIMIT_EXCEEDED' end as error_code
        from v_gl group by 1, 2""",
)
def enforce_limits_s13(spark, d):
    return ops.enforce_limits(gl(spark, d), ["property_id", "kind"], 1000)


@entry(
    "validate_gl_p5",
    """select kind, issues, count(*) as n from (
        select kind, concat_ws(',', case when category is null or category = '' then 'INVALID_CATEGORY' end,
               case when amount is null then 'INVALID_AMOUNT' end, case when source_row is null or source_row < 0 then 'INVALID_SOURCE_ROW' end) as issues
        from (select kind, case when source_row = 6 then '' else category end as category,
                     case when amount > 60000 then cast(null as decimal(18,2)) else amount end as amount,
                     case when source_row = 7 then -1 else source_row end as source_row from v_gl) x) y group by 1, 2""",
)
def validate_gl_p5(spark, d):
    dirty = gl(spark, d).withColumns(
        {
            "category": F.when(F.col("source_row") == 6, "").otherwise(F.col("category")),
            "amount": F.when(F.col("amount") <= 60000, F.col("amount")),
            "source_row": F.when(F.col("source_row") == 7, -1).otherwise(F.col("source_row")),
        }
    )
    checked = ops.validate_gl(dirty).withColumn("issues", F.array_join("issues", ","))
    return checked.groupBy("kind", "issues").agg(F.count("*").alias("n"))


@entry(
    "cap_evidence_o1",
    """select property_id, period, account_code, least(count(*), 5)::int as kept, count(*) > 5 as truncated,
        string_agg(kind || ':' || source_file || ':' || cast(source_row as varchar), '|' order by kind, source_file, source_row, id) filter (where rn <= 5) as evidence
        from (select *, row_number() over (partition by property_id, period, account_code order by kind, source_file, source_row, id) as rn from
              (select property_id, period, account_code, kind, source_file, source_row, id from v_o_clean) c) x
        group by 1, 2, 3""",
)
def cap_evidence_o1(spark, d):
    from rentloom.functions.refusal import capped_list

    clean = ops.dedupe_gl(gl(spark, d))
    item = F.concat_ws(":", "kind", "source_file", F.col("source_row").cast("string"))
    out = capped_list(clean, ops.ACCOUNT_KEY, ops.EVIDENCE_ORDER, item, 5, "evidence")
    return out.select(
        *ops.ACCOUNT_KEY,
        F.size("evidence").alias("kept"),
        F.col("evidence_truncated").alias("truncated"),
        F.array_join("evidence", "|").alias("evidence"),
    )


# ---------------------------------------------------------------- occupancy


@entry(
    "latest_snapshot_w1",
    """select property_id, id, cast(as_of_date as varchar) as as_of, occupied, vacant, down from (
        select *, row_number() over (partition by property_id order by as_of_date desc, created_at desc, id desc) as rn from v_snapshots) x where rn = 1""",
)
def latest_snapshot_w1(spark, d):
    s = occupancy.latest_snapshot(load(spark, d, "v_snapshots"))
    return s.select("property_id", "id", F.col("as_of_date").cast("string").alias("as_of"), "occupied", "vacant", "down")


@entry(
    "newest_snapshots_o4",
    """select property_id, id, cast(as_of_date as varchar) as as_of, n > 25 as truncated from (
        select *, row_number() over (partition by property_id order by as_of_date desc, created_at desc, id desc) as rn, count(*) over (partition by property_id) as n from v_snapshots) x where rn <= 25""",
)
def newest_snapshots_o4(spark, d):
    s = occupancy.newest_snapshots(load(spark, d, "v_snapshots"), 25)
    return s.select("property_id", "id", F.col("as_of_date").cast("string").alias("as_of"), "truncated")


@entry(
    "latest_period_o5",
    "select property_id, max(period) as period from v_gl where kind = 'actual' group by 1",
)
def latest_period_o5(spark, d):
    return gl(spark, d).filter("kind = 'actual'").groupBy("property_id").agg(F.max("period").alias("period"))


@entry(
    "occupancy_change_w2",
    """select property_id, cast(as_of_date as varchar) as as_of, occupied, vacant, down, occupied + vacant + down as denominator,
        cast(p_as_of as varchar) as prior_as_of, occupied - p_occupied as occupied_change, vacant - p_vacant as vacant_change,
        down - p_down as down_change, (occupied + vacant + down) - (p_occupied + p_vacant + p_down) as denominator_change,
        case when p_as_of is null then 'OCCUPANCY_CHANGE_UNKNOWN' end as error_code from v_o_daily""",
)
def occupancy_change_w2(spark, d):
    out = occupancy.occupancy_change(load(spark, d, "v_snapshots"))
    return out.withColumns(
        {"as_of": F.col("as_of_date").cast("string"), "prior_as_of": F.col("prior_as_of").cast("string")}
    ).drop("as_of_date")


view(
    "v_requests",
    """
    select property_id, cast(cast(created_at as date) as date) as bound, count(*) as n from (
      select property_id, cast(as_of_date as date) + 3 as created_at from v_snapshots where down = 3
      union all select distinct property_id, cast('2023-12-31' as date) as created_at from v_snapshots) r group by 1, 2""",
)


@entry(
    "as_of_snapshot_j5",
    """select r.property_id, cast(r.bound as varchar) as bound, cast(s.as_of_date as varchar) as as_of, s.occupied, s.vacant, s.down
        from v_requests r asof left join v_o_daily s on s.property_id = r.property_id and s.as_of_date <= r.bound""",
)
def as_of_snapshot_j5(spark, d):
    out = occupancy.as_of_snapshot(load(spark, d, "v_requests"), load(spark, d, "v_snapshots"))
    return out.select(
        "property_id",
        F.col("bound").cast("string").alias("bound"),
        F.col("current.as_of_date").cast("string").alias("as_of"),
        "current.occupied",
        "current.vacant",
        "current.down",
    )


@entry(
    "validate_snapshots_p6",
    """select property_id, issues, count(*) as n from (
        select property_id, concat_ws(',', case when as_of_date > date '2024-01-20' then 'AFTER_BOUND' end,
               case when down - 1 < 0 then 'INVALID_DOWN' end) as issues from v_snapshots) x group by 1, 2""",
)
def validate_snapshots_p6(spark, d):
    s = load(spark, d, "v_snapshots").withColumn("down", F.col("down") - 1)
    out = occupancy.validate_snapshots(s, "2024-01-20").withColumn("issues", F.array_join("issues", ","))
    return out.groupBy("property_id", "issues").agg(F.count("*").alias("n"))


@entry(
    "feed_age_f36",
    f"""select property_id, cast(max(as_of_date) as varchar) as as_of, date_diff('day', max(as_of_date), date '{REVIEW_DAY}')::int as age_days,
        case when date_diff('day', max(as_of_date), date '{REVIEW_DAY}') > 30 then 'stale' else 'current' end as freshness from v_snapshots group by 1""",
)
def feed_age_f36(spark, d):
    out = occupancy.latest_feed_age(load(spark, d, "v_snapshots"), REVIEW_DAY, 30)
    return out.withColumn("as_of", F.col("as_of").cast("string"))


@entry(
    "four_counts_a3",
    """select property_id, count(*) filter (where s = 'occupied') as occupied, count(*) filter (where s = 'vacant') as vacant,
        count(*) filter (where s = 'down') as down, count(*) as denominator,
        cast(cast(count(*) filter (where s = 'occupied') * 10000000000 // count(*) as bigint) as varchar) as rate_e10
        from (select property_id, case when status = 'down' or resident = 'down' then 'down'
                  when status in ('vacant','available') or resident in ('vacant','model') or (resident = '' and status = '') then 'vacant'
                  else 'occupied' end as s from (
              select property_id, case when cast(unit_id as int) % 9 = 0 then '' when cast(unit_id as int) % 10 = 0 then 'available' else status end as status,
                     case when cast(unit_id as int) % 4 = 0 then '' when cast(unit_id as int) % 23 = 0 then 'model' when cast(unit_id as int) % 29 = 0 then 'down' else 'res' end as resident from v_units) a) b
        group by 1""",
)
def four_counts_a3(spark, d):
    n = F.col("unit_id").cast("int")
    u = load(spark, d, "v_units").select(
        "property_id",
        F.when(n % 9 == 0, "").when(n % 10 == 0, " Available ").otherwise(F.col("status")).alias("status"),
        F.when(n % 4 == 0, "").when(n % 23 == 0, "MODEL").when(n % 29 == 0, "Down").otherwise("res").alias("resident"),
    )
    out = occupancy.four_counts(u, resident="resident")
    exact = F.floor(F.col("occupied").cast("decimal(20,0)") * 10000000000 / F.col("denominator"))
    return out.select(
        "property_id", "occupied", "vacant", "down", "denominator", exact.cast("bigint").cast("string").alias("rate_e10")
    )


# ---------------------------------------------------------------- the review


REVIEW_SUMMARY = f"""select r.property_id, r.period, r.actual_rows, r.budget_rows, r.missing_budget_accounts, r.budget_only_accounts,
        coalesce(v.material_variances, 0) as material_variances, mp.mapping_exceptions, o.mismatch_status, o.freshness,
        {', '.join(m('b.' + c, c) for c in BRIDGE)},
        case when r.actual_rows = 0 or r.missing_budget_accounts > 0 or o.mismatch_status = 'mismatch' then 'blocked' else 'reviewed' end as status
        from (select property_id, period, sum(actual_rows)::bigint as actual_rows, sum(budget_rows)::bigint as budget_rows,
                     count(*) filter (where actual_rows > 0 and budget_rows = 0) as missing_budget_accounts,
                     count(*) filter (where actual_rows = 0 and budget_rows > 0) as budget_only_accounts from v_o_rollup group by 1, 2) r
        left join (select property_id, period, count(*) as material_variances from v_o_variance where abs(variance) >= {THRESHOLD} group by 1, 2) v
          on v.property_id = r.property_id and v.period = r.period
        left join v_o_bridge b on b.property_id = r.property_id and b.period = r.period
        left join (select property_id, period, count(*) filter (where error_code is not null) as mapping_exceptions from v_o_reasons group by 1, 2) mp
          on mp.property_id = r.property_id and mp.period = r.period
        left join (select property_id, period, case when as_of_date is null or unit_count is null or unit_count <= 0 then 'unknown'
                          when unit_count <> denominator then 'mismatch' else 'match' end as mismatch_status,
                          case when age_days is null then 'unknown' when age_days > 45 then 'stale' else 'current' end as freshness from v_o_occ) o
          on o.property_id = r.property_id and o.period = r.period"""


def summary_columns(s):
    keep = "actual_rows budget_rows missing_budget_accounts budget_only_accounts material_variances".split()
    s = s.select(
        "property_id", "period", *keep, "mapping_exceptions", "mismatch_status", "freshness", *BRIDGE, "status"
    )
    return texts(s, *BRIDGE)


@entry("review_summary_a12", REVIEW_SUMMARY)
def review_summary_a12(spark, d):
    return summary_columns(plan.summary_table(gl(spark, d), *dimensions(spark, d), months_to_review=312))


@entry(
    "exceptions_a33",
    f"""select property_id, period, code, severity, count(*) as n from (
        select property_id, period, 'MISSING_BUDGET' as code, 'blocker' as severity from v_o_rollup where actual_rows > 0 and budget_rows = 0 group by 1, 2
        union all select property_id, period, 'BUDGET_WITHOUT_ACTUAL', 'flag' from v_o_rollup where actual_rows = 0 group by 1, 2
        union all select property_id, period, 'MISSING_ACTUALS', 'blocker' from v_o_rollup group by 1, 2 having sum(actual_rows) = 0
        union all select property_id, period, 'DUPLICATE_GL_IMPORT', 'material' from v_o_clean where copies > 1
        union all select property_id, period, error_code, 'material' from v_o_reasons where error_code is not null
        union all select property_id, period, 'MATERIAL_VARIANCE', 'material' from v_o_variance where abs(variance) >= {THRESHOLD}
        union all select property_id, period, 'OCCUPANCY_SNAPSHOT_MISSING', 'flag' from v_o_occ where as_of_date is null
        union all select property_id, period, 'FEED_STALE', 'flag' from v_o_occ where age_days > 45
        union all select property_id, period, 'OCCUPANCY_CHANGE_UNKNOWN', 'flag' from v_o_occ where as_of_date is not null and p_as_of is null
        union all select property_id, period, 'OCCUPANCY_UNIT_COUNT_UNKNOWN', 'flag' from v_o_occ where as_of_date is not null and coalesce(unit_count, 0) <= 0
        union all select property_id, period, 'OCCUPANCY_COUNT_MISMATCH', 'blocker' from v_o_occ where as_of_date is not null and unit_count > 0 and unit_count <> denominator
        ) x group by 1, 2, 3, 4""",
)
def exceptions_a33(spark, d):
    x = plan.exceptions(full_review(spark, d))
    return x.groupBy("property_id", "period", "code", "severity").agg(F.count("*").alias("n"))


@entry(
    "missing_budget_evidence_a33",
    """select property_id, period, string_agg(kind || ':' || source_file || ':' || cast(source_row as varchar), '|' order by kind, source_file, source_row, id) as evidence
        from (select c.*, row_number() over (partition by c.property_id, c.period order by c.kind, c.source_file, c.source_row, c.id) as ev
              from v_o_clean c join v_o_rollup r on r.property_id = c.property_id and r.period = c.period and r.account_code = c.account_code
              where r.actual_rows > 0 and r.budget_rows = 0) x where ev <= 50 group by 1, 2""",
)
def missing_budget_evidence_a33(spark, d):
    x = plan.exceptions(full_review(spark, d)).filter("code = 'MISSING_BUDGET'")
    kind = lambda e: F.when(e["table"] == "gl_actuals", "actual").otherwise("budget")
    cited = F.transform(
        "evidence", lambda e: F.concat_ws(":", kind(e), e["artifact"], e["row"].cast("string"))
    )
    return x.select("property_id", "period", F.array_join(cited, "|").alias("evidence"))


@entry(
    "measured_facts_a34",
    f"""select property_id, period, statement from (
        select property_id, period, 'Occupancy snapshot feed is ' || age_days || ' days old (bound 45 days).' as statement from v_o_occ where age_days > 45
        union all select property_id, period, 'occupied ' || occupied || ' of ' || denominator || ' units as of ' || as_of_date || '.' from v_o_occ where as_of_date is not null
        union all select property_id, period, 'Occupied units changed by ' || (occupied - p_occupied) || ' since ' || p_as_of || '.' from v_o_occ where p_as_of is not null
        union all select property_id, period, 'OCCUPANCY_COUNT_MISMATCH: snapshot denominator ' || denominator || ' differs from stated unit count ' || unit_count || '.'
          from v_o_occ where as_of_date is not null and unit_count > 0 and unit_count <> denominator
        union all select property_id, period, sum(duplicate_groups)::bigint || ' duplicate GL import group(s) deduplicated before variance.' from v_o_rollup group by 1, 2 having sum(duplicate_groups) > 0
        union all select property_id, period, 'Account ' || account_code || ' variance ' || cast(variance as decimal(38,2)) || ' USD meets the materiality threshold {THRESHOLD}.'
          from v_o_variance where abs(variance) >= {THRESHOLD}) x""",
)
def measured_facts_a34(spark, d):
    return plan.measured_facts(full_review(spark, d)).select("property_id", "period", "statement")


@entry(
    "review_status_by_code_a12",
    """select property_id, period, count(*) as exceptions, max(case when sev = 'blocker' then 1 else 0 end) as blocked from (
        select property_id, period, 'material' as sev from v_o_clean where copies > 1
        union all select property_id, period, 'material' from v_o_reasons where error_code is not null) x group by 1, 2""",
)
def review_status_by_code_a12(spark, d):
    r = full_review(spark, d)
    x = plan.exceptions(r).filter(F.col("code").isin("DUPLICATE_GL_IMPORT", "UNREVIEWED_ACCOUNT_MAPPING", "CHANGED_ACCOUNT_MAPPING"))
    s = plan.review_status(x)
    blocked = (F.col("status") == "blocked").cast("int")
    return s.select("property_id", "period", F.col("exception_count").alias("exceptions"), blocked.alias("blocked"))


@entry(
    "month_end_as_of_j5",
    """select b.property_id, b.period, cast(s.as_of_date as varchar) as as_of from
        (select property_id, strftime(as_of_date, '%Y-%m') as period from v_snapshots group by 1, 2) b
        asof left join (select property_id, as_of_date from v_o_daily) s
          on s.property_id = b.property_id and s.as_of_date <= cast(cast(b.period || '-01' as date) + interval 1 month - interval 1 day as date)""",
)
def month_end_as_of(spark, d):
    s = load(spark, d, "v_snapshots")
    req = s.select("property_id", F.date_format("as_of_date", "yyyy-MM").alias("period")).distinct()
    out = occupancy.as_of_snapshot(req.withColumn("bound", month_end(F.col("period"))), s)
    return out.select("property_id", "period", F.col("current.as_of_date").cast("string").alias("as_of"))


# ---------------------------------------------------------------- report shapes


@entry(
    "rank_variances_o3",
    f"""select property_id, period, rank, account_code, {m('variance', 'variance')} from (
        select *, row_number() over (partition by property_id, period order by abs(variance) desc, account_code) as rank from v_o_variance) x""",
)
def rank_variances_o3(spark, d):
    v = ops.material_variances(ops.account_variance(rollup(spark, d)), "0")
    return texts(v.select("property_id", "period", "rank", "account_code", "variance"), "variance")


@entry(
    "cap_facts_o6",
    f"""select property_id, period, least(count(*), 2) as facts from (
        select property_id, period from v_o_occ where as_of_date is not null
        union all select property_id, period from v_o_occ where age_days > 45
        union all select property_id, period from v_o_occ where p_as_of is not null
        union all select property_id, period from v_o_occ where as_of_date is not null and unit_count > 0 and unit_count <> denominator
        union all select property_id, period from v_o_rollup group by 1, 2 having sum(duplicate_groups) > 0
        union all select property_id, period from v_o_variance where abs(variance) >= {THRESHOLD}) x group by 1, 2""",
)
def cap_facts_o6(spark, d):
    facts = plan.measured_facts(full_review(spark, d), limit=2)
    return facts.groupBy("property_id", "period").agg(F.count("*").alias("facts"))


@entry(
    "explain_variance_c4",
    f"""select v.property_id, v.period, v.account_code, v.category, {m('v.actual', 'actual')}, {m('v.budget', 'budget')}, {m('v.variance', 'variance')},
        row_number() over (partition by v.property_id, v.period order by abs(variance) desc, account_code) as rank, abs(variance) >= {THRESHOLD} as is_material,
        {m('b.actual_noi - b.budget_noi', 'noi_variance')} from v_o_variance v join v_o_bridge b on b.property_id = v.property_id and b.period = v.period""",
)
def explain_variance_c4(spark, d):
    from rentloom.plans.catalogue import explain_variance

    out = texts(explain_variance(full_review(spark, d)), "actual", "budget", "variance", "noi_variance")
    return out.drop("account_name", "actual_noi", "budget_noi")


@entry(
    "list_exceptions_c5",
    """select property_id, period, code, severity, count(*) as n from (
        select property_id, period, 'MISSING_BUDGET' as code, 'blocker' as severity from v_o_rollup where actual_rows > 0 and budget_rows = 0 group by 1, 2
        union all select property_id, period, 'UNREVIEWED_ACCOUNT_MAPPING', 'material' from v_o_reasons where error_code = 'UNREVIEWED_ACCOUNT_MAPPING'
        union all select property_id, period, 'FEED_STALE', 'flag' from v_o_occ where age_days > 45) x group by 1, 2, 3, 4""",
)
def list_exceptions_c5(spark, d):
    from rentloom.plans.catalogue import list_exceptions

    codes = ["MISSING_BUDGET", "UNREVIEWED_ACCOUNT_MAPPING", "FEED_STALE"]
    x = list_exceptions(full_review(spark, d), codes=codes)
    return x.groupBy("property_id", "period", "code", "severity").agg(F.count("*").alias("n"))


# ---------------------------------------------------------------- missing amounts and months that were asked for

# Two accounts of two properties lose their amounts in March and August.
view(
    "v_gl_gaps",
    """
    select id, property_id, period, kind, account_code, account_name, category,
           case when property_id in ('p003', 'p011') and account_code in ('4100', '4400') and substr(period, 6, 2) in ('03', '08')
                then cast(null as decimal(18,2)) else amount end as amount, source_file, source_row, created_at
    from v_gl""",
)
view(
    "v_gap_accounts",
    """
    select property_id, period, account_code, min(category) as category,
           count(*) filter (where kind = 'actual') as actual_rows, count(*) filter (where kind = 'budget') as budget_rows,
           case when count(*) filter (where kind = 'actual' and amount is null) = 0 then sum(amount) filter (where kind = 'actual') end as actual,
           case when count(*) filter (where kind = 'budget' and amount is null) = 0 then sum(amount) filter (where kind = 'budget') end as budget,
           count(*) filter (where amount is null) as invalid_rows
    from (select *, row_number() over (partition by property_id, period, kind, source_file, source_row, account_code
                                       order by created_at, id, amount, account_name, category) as rn from v_gl_gaps) x
    where rn = 1 group by 1, 2, 3""",
)
REVENUE, EXPENSES = "category in ('Rental Income','Other Income')", "category not in ('Rental Income','Other Income','Unmapped')"


def whole(side: str, which: str, name: str) -> str:
    """SQL: a sum that is NULL as soon as one of its accounts has none."""
    gap = f"count(*) filter (where {which} and {side} is null) = 0"
    return f"case when {gap} then sum(case when {which} then {side} else 0 end) end as {name}"


view(
    "v_gap_bridge",
    f"""
    select *, actual_revenue - actual_expenses as actual_noi, budget_revenue - budget_expenses as budget_noi from (
      select property_id, period, count(*) as covered_accounts, {whole('actual', REVENUE, 'actual_revenue')},
             {whole('budget', REVENUE, 'budget_revenue')}, {whole('actual', EXPENSES, 'actual_expenses')},
             {whole('budget', EXPENSES, 'budget_expenses')}
      from v_gap_accounts where actual_rows > 0 and budget_rows > 0 group by 1, 2) x""",
)


@entry(
    "requested_months_a12",
    f"""select a.property_id, a.period, coalesce(r.actual_rows, 0)::bigint as actual_rows, coalesce(r.budget_rows, 0)::bigint as budget_rows,
        coalesce(r.invalid_accounts, 0)::bigint as invalid_accounts, {', '.join(m('b.' + c, c) for c in BRIDGE)},
        coalesce(r.actual_rows, 0) = 0 as missing_actuals, coalesce(r.invalid_accounts, 0) > 0 as invalid_amount
        from (select distinct 'p' || lpad(cast(s_suppkey % 25 as string), 3, '0') as property_id, strftime(month, '%Y-%m') as period
              from supplier, (select unnest(generate_series(date '1992-01-01', date '1998-12-01', interval 1 month)) as month) months) a
        left join (select property_id, period, sum(actual_rows) as actual_rows, sum(budget_rows) as budget_rows,
                          count(*) filter (where invalid_rows > 0) as invalid_accounts from v_gap_accounts group by 1, 2) r
          on r.property_id = a.property_id and r.period = a.period
        left join v_gap_bridge b on b.property_id = a.property_id and b.period = a.period""",
)
def requested_months_a12(spark, d):
    """Every property of the supplier list and every month of seven years: no month vanishes, no missing amount is zero."""
    months = F.expr("sequence(date '1992-01-01', date '1998-12-01', interval 1 month)")
    names = F.concat(F.lit("p"), F.lpad((F.col("s_suppkey") % 25).cast("string"), 3, "0"))
    asked = load(spark, d, "supplier").select(names.alias("property_id")).distinct()
    asked = asked.select("property_id", F.explode(F.transform(months, lambda x: F.date_format(x, "yyyy-MM"))).alias("period"))
    s = plan.summary_table(load(spark, d, "v_gl_gaps"), *dimensions(spark, d), requests=asked)
    has = lambda code: F.array_contains("blockers", code)
    keep = s.withColumns({"missing_actuals": has("MISSING_ACTUALS"), "invalid_amount": has("INVALID_AMOUNT")})
    columns = ["actual_rows", "budget_rows", "invalid_accounts", *BRIDGE, "missing_actuals", "invalid_amount"]
    return texts(keep.select("property_id", "period", *columns), *BRIDGE)


@entry(
    "noi_bridge_gaps_a8",
    f"select property_id, period, covered_accounts, {', '.join(m(c, c) for c in BRIDGE)} from v_gap_bridge",
)
def noi_bridge_gaps_a8(spark, d):
    accounts = ops.actual_budget_coverage(ops.account_rollup(ops.dedupe_gl(load(spark, d, "v_gl_gaps"))))
    b = ops.noi_bridge(ops.account_variance(accounts))
    return texts(b.select("property_id", "period", "covered_accounts", *BRIDGE), *BRIDGE)


@entry(
    "t12_category_gaps_a1",
    f"""select property_id, as_of, {m('case when invalid = 0 then value end', 'value')},
        case when invalid > 0 then 'INVALID_AMOUNT' when value is null then 'NOT_FOUND' end as error_code from (
          select e.property_id, e.end_period as as_of, sum(r.amount) as value,
                 count(*) filter (where r.property_id is not null and r.amount is null) as invalid
          from (select property_id, max(period) as end_period from v_gl_gaps where kind = 'actual' group by 1) e
          left join (select distinct property_id, period, account_code, account_name, source_row, amount
                     from v_gl_gaps where kind = 'actual' and category = 'Payroll') r
            on r.property_id = e.property_id
           and date_diff('month', cast(r.period || '-01' as date), cast(e.end_period || '-01' as date)) between 0 and 11
          group by 1, 2) x""",
)
def t12_category_gaps_a1(spark, d):
    out = ops.t12_category_sum(load(spark, d, "v_gl_gaps"), "Payroll")
    return texts(out, "value").select("property_id", "as_of", "value", "error_code")


@entry(
    "trailing_12_gaps_w5",
    f"""select property_id, account_code, period, {m('amount', 'amount')},
        {m('case when count(amount) over w = count(*) over w then sum(amount) over w end', 't12')}, count(*) over w as months_present
        from (select property_id, account_code, period, date_diff('month', date '1990-01-01', cast(period || '-01' as date)) as i,
                     case when count(amount) = count(*) then sum(amount) end as amount from v_gl_gaps group by 1, 2, 3, 4) x
        window w as (partition by property_id, account_code order by i range between 11 preceding and current row)""",
)
def trailing_12_gaps_w5(spark, d):
    out = ops.trailing_12(load(spark, d, "v_gl_gaps"), ["property_id", "account_code"])
    return texts(out, "amount", "t12").select("property_id", "account_code", "period", "amount", "t12", "months_present")
