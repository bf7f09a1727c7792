"""Scalars, deal screening and the income bridge, with their SQL twins."""

from __future__ import annotations

from pyspark.sql import functions as F

from registry.common import Register, m, texts
from registry.sqltext import load, view
from rentloom.functions import metrics, money, period
from rentloom.operators import deals as deal_ops
from rentloom.operators import income

ENTRIES = Register()
entry = ENTRIES.entry

# Ledger amounts written the way statements write them; the style changes with the line number and order key.
view(
    "v_money_text",
    """
    select l_orderkey as k, l_linenumber as ln, l_partkey as pk, cast(l_extendedprice as decimal(18,2)) as amount,
      case l_orderkey % 11 when 0 then '$' || a when 1 then '(' || a || ')' when 2 then a || ' USD' when 3 then '-' || a
        when 4 then '€' || a when 5 then 'n/a' when 6 then w || ',' || f when 7 then w || '.' || f || '0' when 8 then ' ' || a || ' '
        when 9 then '1,' || substr('000' || f, 4, 2) || '0.' || f else substr(w, 1, 1) || ' ' || a end as raw
    from (select l_orderkey, l_linenumber, l_partkey, l_extendedprice, cast(cast(l_extendedprice as decimal(18,2)) as string) as a,
                 cast(cast(floor(l_extendedprice) as bigint) as string) as w,
                 substr(cast(cast(l_extendedprice as decimal(18,2)) as string), length(cast(cast(l_extendedprice as decimal(18,2)) as string)) - 1, 2) as f
          from lineitem) x""",
)


@entry(
    "parse_money_f1",
    """select style, code, count(*) as n, cast(sum(v) as varchar) as total from (
      select k % 11 as style,
        case when k % 11 = 4 then 'INVALID_OBSERVATIONS' when k % 11 = 5 then 'UNKNOWN_AMOUNT_NOT_ZERO'
             when k % 11 in (7, 10) then 'AMBIGUOUS_NUMERIC_FORMAT'
             when k % 11 = 9 and not regexp_full_match(trim(raw), '1,[0-9]{3}\\.[0-9]{2}') then 'AMBIGUOUS_NUMERIC_FORMAT' end as code,
        cast(case k % 11 when 0 then amount when 1 then -amount when 2 then amount when 3 then -amount when 6 then amount when 8 then amount
             when 9 then case when regexp_full_match(trim(raw), '1,[0-9]{3}\\.[0-9]{2}') then cast(replace(raw, ',', '') as decimal(18,2)) end end as decimal(38,8)) as v
      from v_money_text) y group by 1, 2""",
)
def parse_money_f1(spark, d):
    t = load(spark, d, "v_money_text").select((F.col("k") % 11).alias("style"), money.parse_money(F.col("raw")).alias("p"))
    out = t.groupBy("style", F.col("p.error_code").alias("code"))
    return texts(out.agg(F.count("*").alias("n"), F.sum("p.amount").alias("total")), "total", scale=8)


@entry(
    "parse_amount_lenient_f2",
    f"""select k % 4 as style, count(*) as n, {m("sum(case k % 4 when 0 then amount when 1 then -amount when 2 then amount else 0 end)", 'total')}
        from v_money_text group by 1""",
)
def parse_amount_lenient_f2(spark, d):
    t = load(spark, d, "v_money_text")
    style, amount = F.col("k") % 4, F.format_number("amount", 2)
    raw = (
        F.when(style == 0, F.concat(F.lit("$"), amount))
        .when(style == 1, F.concat(F.lit("("), amount, F.lit(")")))
        .when(style == 2, amount)
        .otherwise("—")
    )
    out = t.select(style.alias("style"), money.parse_amount_lenient(raw).alias("v")).groupBy("style")
    return texts(out.agg(F.count("*").alias("n"), F.sum("v").alias("total")), "total")


@entry(
    "canonical_amount_f3",
    f"""select l_linenumber as ln, code, count(*) as n, {m('sum(case when code is null then v end)', 'total')} from (
        select l_linenumber, cast(l_extendedprice as decimal(18,2)) as v,
               case when l_linenumber = 7 then 'INPUT_LIMIT_EXCEEDED' when l_linenumber = 6 then 'INVALID_INPUT' end as code from lineitem) x group by 1, 2""",
)
def canonical_amount_f3(spark, d):
    li = spark.read.parquet(f"{d}/lineitem.parquet")
    ln, price = F.col("l_linenumber"), F.col("l_extendedprice")
    value = F.when(ln == 7, price * 1e15).when(ln == 6, F.lit(float("nan"))).otherwise(price)
    out = li.select(ln.alias("ln"), money.canonical_amount(value, "double").alias("c"))
    out = out.groupBy("ln", F.col("c.error_code").alias("code"))
    return texts(out.agg(F.count("*").alias("n"), F.sum("c.amount").alias("total")), "total")


@entry(
    "cents_to_decimal_f4",
    f"select o_orderkey, {m('o_totalprice * case when o_orderkey % 2 = 0 then -1 else 1 end', 'amount')} from orders",
)
def cents_to_decimal_f4(spark, d):
    o = spark.read.parquet(f"{d}/orders.parquet")
    cents = F.round(F.col("o_totalprice") * 100).cast("bigint") * F.when(F.col("o_orderkey") % 2 == 0, -1).otherwise(1)
    return texts(o.select("o_orderkey", money.cents_to_decimal(cents).alias("amount")), "amount")


@entry(
    "opening_amount_f5",
    f"""select s as style, case when s in (1, 3) then 'INVALID_CONTRACT' when s = 4 then 'INPUT_LIMIT_EXCEEDED' end as code, count(*) as n,
        {m('sum(case when s = 0 then amount end)', 'total')} from (select o_orderkey % 5 as s, cast(o_totalprice as decimal(18,2)) as amount from orders) x group by 1, 2""",
)
def opening_amount_f5(spark, d):
    o = spark.read.parquet(f"{d}/orders.parquet").withColumn("s", F.col("o_orderkey") % 5)
    text = F.col("o_totalprice").cast("decimal(18,2)").cast("string")
    raw = (
        F.when(F.col("s") == 1, F.concat(text, F.lit("0")))
        .when(F.col("s") == 2, F.lit(None).cast("string"))
        .when(F.col("s") == 4, F.concat(F.lit("9000000"), text))
        .otherwise(text)
    )
    raw = F.when(F.col("s") == 4, F.concat(F.lit("9000000000000"), F.lit(".00"))).otherwise(raw)
    deleted = F.col("s").isin(2, 3)
    out = o.select(F.col("s").alias("style"), money.opening_amount(raw, deleted).alias("p"))
    out = out.groupBy("style", F.col("p.error_code").alias("code"))
    return texts(out.agg(F.count("*").alias("n"), F.sum("p.amount").alias("total")), "total")


@entry(
    "month_key_f6",
    """select s as style, key, count(*) as n from (select o_orderkey % 7 as s,
         case when o_orderkey % 7 in (5, 6) or extract(year from o_orderdate) < 2000 then null else strftime(o_orderdate, '%Y-%m') end as key
         from orders) x group by 1, 2""",
)
def month_key_f6(spark, d):
    o = spark.read.parquet(f"{d}/orders.parquet").withColumn("s", F.col("o_orderkey") % 7)
    dt = F.col("o_orderdate")
    raw = F.lit("Total")
    styles = ["MMM yyyy", "MMMM-yyyy", "yyyy-MM", "yyyy-MM-dd", "M/d/yyyy"]
    for i, pattern in enumerate(styles):
        raw = F.when(F.col("s") == i, F.date_format(dt, pattern)).otherwise(raw)
    raw = F.when(F.col("s") == 5, F.date_format(dt, "'Foo' yyyy")).otherwise(raw)
    out = o.select(F.col("s").alias("style"), period.month_key(raw).alias("key"))
    return out.groupBy("style", "key").agg(F.count("*").alias("n"))


@entry(
    "parse_period_f7",
    """select case when o_orderkey % 3 = 2 then 'YTD' else strftime(o_orderdate, '%Y-%m') end as period, count(*) as n from orders group by 1""",
)
def parse_period_f7(spark, d):
    o = spark.read.parquet(f"{d}/orders.parquet")
    s = F.col("o_orderkey") % 3
    raw = F.when(s == 0, F.date_format("o_orderdate", "MMMM, yyyy")).when(s == 1, F.date_format("o_orderdate", "yyyy-MM-dd"))
    return o.select(period.parse_period(raw.otherwise(" YTD")).alias("period")).groupBy("period").agg(F.count("*").alias("n"))


@entry(
    "period_window_f8",
    """select period, string_agg(strftime(cast(period || '-01' as date) - to_months(11 - i::int), '%Y-%m'), ',' order by i) as labels,
        string_agg(case when i >= 9 then strftime(cast(period || '-01' as date) - to_months(11 - i::int), '%Y-%m') end, ',' order by i) as tail
        from (select distinct period from v_gl) p, range(12) r(i) group by 1""",
)
def period_window_f8(spark, d):
    p = load(spark, d, "v_gl").select("period").distinct()
    window = period.period_window(F.col("period"), 12)
    first = period.month_label(period.month_idx(F.col("period")) - 2)
    return p.select(
        "period",
        F.array_join(window, ",").alias("labels"),
        F.array_join(period.month_range(first, F.col("period")), ",").alias("tail"),
    )


@entry(
    "overlap_months_f9",
    """select o_custkey, sum(greatest(0, 12 - abs(date_diff('month', date_trunc('month', lo), date_trunc('month', hi)))))::bigint as overlap
        from (select o_custkey, min(o_orderdate) as lo, min(o_orderdate) + to_days((o_custkey % 500)::int) as hi from orders group by 1) x group by 1""",
)
def overlap_months_f9(spark, d):
    o = spark.read.parquet(f"{d}/orders.parquet").groupBy("o_custkey").agg(F.min("o_orderdate").alias("lo"))
    fmt = lambda c: F.date_format(c, "yyyy-MM")
    hi = F.date_add(F.col("lo").cast("date"), (F.col("o_custkey") % 500).cast("int"))
    return o.select("o_custkey", period.overlap_months(fmt(hi), fmt(F.col("lo"))).cast("bigint").alias("overlap"))


@entry(
    "occupancy_check_f18",
    """select id, case when k % 10 = 0 or k % 8 = 3 then 'OCCUPANCY_COUNTS_REQUIRED' when k % 10 = 1 then 'IMPLICIT_ZERO_FORBIDDEN' end as code,
        case when not (k % 10 in (0, 1) or k % 8 = 3) then cast(occupied * 1000000 // (occupied + vacant + down) as bigint) end as rate_e6
        from (select *, source_row as k from v_snapshots) s""",
)
def occupancy_check_f18(spark, d):
    k = F.col("source_row")
    s = load(spark, d, "v_snapshots").withColumns(
        {
            "vacant": F.when(k % 10 != 0, F.col("vacant")),
            "den": F.when(k % 10 == 1, 0).otherwise(F.col("occupied") + F.col("vacant") + F.col("down")),
            "down": F.when(k % 8 == 3, -1).otherwise(F.col("down")),
        }
    )
    c = metrics.occupancy_check(F.col("occupied"), F.col("vacant"), F.col("down"), F.col("den"))
    return s.select(
        "id", c["error_code"].alias("code"), F.floor(c["rate"] * 1000000).cast("bigint").alias("rate_e6")
    )


@entry(
    "parse_millage_f19",
    f"""select s as style, v > 0 as positive, count(*) as n, case when s <> 0 or v <= 0 then 'MISSING_MILLAGE' end as code,
        {m('sum(case when s = 0 and v > 0 then v end)', 'total')}
        from (select c_custkey % 4 as s, cast(c_acctbal as decimal(18,2)) as v from customer) x group by 1, 2, 4""",
)
def parse_millage_f19(spark, d):
    c = spark.read.parquet(f"{d}/customer.parquet").withColumn("s", F.col("c_custkey") % 4)
    value = F.col("c_acctbal").cast("decimal(18,2)")
    raw = value.cast("string")
    raw = (
        F.when(F.col("s") == 1, F.concat(F.lit("-"), F.abs(value).cast("string"))).when(F.col("s") == 2, " ").when(F.col("s") == 3, "25 mills").otherwise(raw)
    )
    positive = (value > 0).alias("positive")
    out = c.select(F.col("s").alias("style"), positive, metrics.parse_millage(raw).alias("p")).groupBy("style", "positive")
    return texts(
        out.agg(F.count("*").alias("n"), F.max("p.error_code").alias("code"), F.sum("p.millage").alias("total")), "total"
    )


@entry(
    "physical_position_f20",
    """select id, case when k % 9 = 0 then null when down > 0 or k % 12 = 5 or k % 14 = 3 then 'distressed'
        when occupied * 100 < (occupied + vacant + down) * 85 then 'lease_up' else 'stabilized' end as position
        from (select *, source_row as k from v_snapshots) s""",
)
def physical_position_f20(spark, d):
    k = F.col("source_row")
    s = load(spark, d, "v_snapshots")
    noi = F.when(k % 12 == 5, -1).when(k % 3 == 0, 100).cast("decimal(18,2)")
    position = metrics.physical_position(
        F.when(k % 9 != 0, F.col("occupied")),
        F.col("vacant"),
        F.col("down"),
        F.col("occupied") + F.col("vacant") + F.col("down"),
        noi,
        k % 14 == 3,
    )
    return s.select("id", position.alias("position"))


@entry(
    "yield_on_cost_f21",
    """select deal_id, case when code is null and year1_noi >= 0 then cast((cast(year1_noi * 100 as hugeint) * 100000000000 // cast(basis * 100 as hugeint) + 5) // 10 // 1000 as bigint) end as ratio_e7,
        case when code is null then year1_noi >= basis * 0.07 and year1_noi <= basis * 0.08 end as in_band, code
        from (select *, strike / 20 * 30 + capex as basis, case when strike is null or capex is null then 'IMPLICIT_ZERO_FORBIDDEN' end as code
              from (select deal_id, year1_noi, capex, cast(strike / 20 as decimal(18,2)) * 20 as strike from v_deals) a) x""",
)
def yield_on_cost_f21(spark, d):
    deals = load(spark, d, "v_deals")
    price = (F.col("strike") / 20 * 30).cast("decimal(20,2)")
    y = metrics.yield_on_cost(F.col("year1_noi"), price, F.col("capex"))
    return deals.select(
        "deal_id",
        F.when(y["ratio"] >= 0, F.floor(y["ratio"] * 10000000)).cast("bigint").alias("ratio_e7"),
        y["in_band"].alias("in_band"),
        y["error_code"].alias("code"),
    )


view(
    "v_o_breach",
    """
    select *, concat_ws(',', case when going_in_cap < 0.06 or going_in_cap > 0.12 then 'going_in_cap' end,
             case when exit_cap < 0.06 or exit_cap > 0.12 then 'exit_cap' end,
             case when coalesce(price_per_unit, strike / units) < 25000 or coalesce(price_per_unit, strike / units) > 750000 then 'price_per_unit' end,
             case when min_dscr < 1.10 then 'min_dscr' end,
             case when year1_noi < 0 and (strike is not null or price_per_unit is not null) then 'year1_noi' end) as fields
    from v_deals""",
)
SCREEN_SQL = f"""select deal_id, fields, strike is not null and fields = '' as present_as_bid,
    {m("case when strike is not null and fields = '' then strike end", 'bid')} from v_o_breach"""


def screened(df):
    fields = F.array_join(F.transform("breaches", lambda b: b["field"]), ",")
    return texts(df.select("deal_id", fields.alias("fields"), "present_as_bid", "bid"), "bid")


@entry("reasonability_f22", SCREEN_SQL)
def reasonability_f22(spark, d):
    return screened(deal_ops.screen(load(spark, d, "v_deals")))


@entry("lookup_first_f23", SCREEN_SQL)
def lookup_first_f23(spark, d):
    """The same screen from issued JSON with every accepted spelling and nesting of the figures."""
    deals = load(spark, d, "v_deals")
    odd = F.col("deal_id") % 2 == 1
    c = F.col
    top = F.struct(
        c("units"),
        F.when(odd, c("strike")).alias("strike"),
        F.when(~odd, c("strike")).alias("solved_purchase_price"),
        F.when(odd, c("going_in_cap")).alias("going_in_cap_rate"),
        F.struct(
            F.when(~odd, c("going_in_cap")).alias("going_in_cap"), c("exit_cap").alias("exit_cap_rate"), c("price_per_unit")
        ).alias("policy_summary"),
        F.struct(c("min_dscr").alias("minimum")).alias("dscr"),
        c("year1_noi").alias("projected_noi_used_for_sizing"),
    )
    return screened(deal_ops.present_results(deals.select("deal_id", F.to_json(top).alias("result_json"))))


@entry(
    "record_thesis_j17",
    f"""select deal_id, {m('strike', 'purchase_price')}, {m('year1_noi', 'year_2_noi')}, {m('noi', 'operations_actual_noi')},
        case when strike is null or capex is null then 'IMPLICIT_ZERO_FORBIDDEN' end as code
        from v_deals left join (select l_orderkey, sum(cast(l_extendedprice as decimal(18,2))) as noi from lineitem where l_linestatus = 'F' group by 1) a on l_orderkey = deal_id""",
)
def record_thesis_j17(spark, d):
    from rentloom.operators.ledger import thesis_to_actual

    deals = load(spark, d, "v_deals").select(
        "deal_id",
        F.col("strike").alias("purchase_price"),
        F.col("year1_noi").alias("year_2_noi"),
        "capex",
        F.lit(False).alias("present_as_bid"),
    )
    noi = (
        spark.read.parquet(f"{d}/lineitem.parquet")
        .filter("l_linestatus = 'F'")
        .groupBy(F.col("l_orderkey").alias("aggregate_id"))
        .agg(F.sum(F.col("l_extendedprice").cast("decimal(18,2)")).alias("noi"))
    )
    out = thesis_to_actual(deal_ops.record_thesis(deals), noi)
    out = out.select("deal_id", "purchase_price", "year_2_noi", "operations_actual_noi", F.col("error_code").alias("code"))
    return texts(out, "purchase_price", "year_2_noi", "operations_actual_noi")


@entry(
    "check_buy_box_c8",
    """select deal_id, case when units < 30 then 'fail' else 'pass' end as min_units, 'not_certified' as max_units,
        case when going_in_cap < 0.05 then 'fail' else 'pass' end as cap_kill,
        case when deal_id % 10 = 0 then 'MISSING_MILLAGE' when units < 30 or going_in_cap < 0.05 then 'BUY_BOX_FAIL' end as error_code from v_deals""",
)
def check_buy_box_c8(spark, d):
    deals = load(spark, d, "v_deals").withColumn("millage", F.when(F.col("deal_id") % 10 != 0, F.lit("25.31")))
    return deal_ops.check_buy_box(deals, deal_ops.BuyBox(min_units=30, in_place_cap_kill="0.05")).drop("millage_error")


# ---------------------------------------------------------------- income bridge

view(
    "v_o_months",
    """
    select o_orderkey as k, i, 50 + o_orderkey % 150 as u, (50 + o_orderkey % 150) * 1000 + (i * 7 + o_orderkey) % 5 * 100 as rent,
           case when i = 3 and o_orderkey % 6 = 0 then -200 else 200 end * (50 + o_orderkey % 150) as tax,
           (50 + o_orderkey % 150) * 50 as water, (i % 4) * 30 * (50 + o_orderkey % 150) as term,
           case when o_orderkey % 17 = 0 then 20 else -20 end * (50 + o_orderkey % 150) as bad
    from orders, range(12) r(i)""",
)
view(
    "v_o_cases",
    """
    select *, rent + other - opex as noi, opex - tax - ins + 240 * 12 * u + 110 * u as house_opex,
      case when k % 23 = 0 then 'UNIT_COUNTS' when k % 13 = 0 then 'RENT_TIE_OUT' when k % 17 = 0 or k % 19 = 0 then 'OTHER_INCOME_LINE' end as err
    from (select k, u, sum(rent) as rent, sum(tax) as tax, sum(water) + sum(term) + sum(bad) as other, 4 * sum(rent) filter (where i >= 9) as last3,
                 sum(water) * 0.90 + sum(term) * 0.50 + sum(bad) as credited, sum(water) + sum(term) as positive, 100 * u as ins,
                 sum(tax) + 100 * u + 3000 * u as opex, min(tax) < 0 as neg_tax
          from v_o_months group by 1, 2) x""",
)


def cases(spark, d):
    """Income cases derived from orders: twelve-month arrays and three other-income lines each."""
    k = F.col("o_orderkey")
    o = spark.read.parquet(f"{d}/orders.parquet").select(k, (50 + k % 150).alias("u"))
    u = F.col("u")
    dec = lambda c: c.cast("decimal(18,2)")

    def months(fn):
        return F.array(*[dec(fn(i)) for i in range(12)])

    def total(fn):
        return dec(sum((fn(i) for i in range(1, 12)), fn(0)))

    rent = lambda i: u * 1000 + (k + i * 7) % 5 * 100
    tax = lambda i: u * (F.when(k % 6 == 0, -200).otherwise(200) if i == 3 else F.lit(200))
    water = lambda i: u * 50
    term = lambda i: u * (i % 4 * 30)
    bad = lambda i: u * F.when(k % 17 == 0, 20).otherwise(-20)

    def line(code, kind, fn, credit, cost):
        return F.struct(
            F.lit(code).alias("code"),
            F.lit(kind).alias("kind"),
            F.lit("booked_gl").alias("evidence"),
            months(fn).alias("monthly"),
            credit.cast("decimal(9,6)").alias("credit_rate"),
            dec(cost).alias("paired_expense"),
            F.when(cost > 0, "included_in_t12_opex").alias("paired_expense_evidence"),
        )

    opex = total(tax) + dec(u * 3100)
    other = total(water) + total(term) + total(bad)
    one_off = F.when(k % 13 == 0, 1).otherwise(0)
    return o.select(
        k.alias("case_id"),
        u.cast("int").alias("units"),
        (u - k % 9 - k % 4 + F.when(k % 23 == 0, 1).otherwise(0)).cast("int").alias("occupied"),
        (k % 9).cast("int").alias("vacant"),
        (k % 4).cast("int").alias("down"),
        (k % 20).cast("int").alias("recent_moveins"),
        F.lit("2026-08").alias("period_end"),
        F.when(k % 2 == 0, "2026-07").otherwise("2025-11").alias("prior_period_end"),
        months(rent).alias("net_rent_monthly"),
        months(tax).alias("tax_monthly"),
        dec(total(rent) + one_off).alias("reported_net_rent"),
        dec(other).alias("reported_other_income"),
        dec(total(rent) + other - opex).alias("reported_noi"),
        total(tax).alias("tax"),
        dec(u * 100).alias("insurance"),
        dec(opex).alias("operating_expenses"),
        dec(u * 10).alias("arrears_writeoffs"),
        dec(u * 12).alias("upfront_concessions"),
        F.array(
            line("water", "utility_reimbursement", water, F.lit("0.90"), u * 40),
            line("termination", "turnover_fee", term, F.lit("0.50"), u * 0),
            line("bad_debt", "bad_debt", bad, F.when(k % 19 == 0, "0.50").otherwise("1.00"), u * 0),
        ).alias("other_income"),
        dec(u * 900).alias("occupied_base_rent_monthly"),
        dec(u * 2880).alias("house_tax"),
        F.when(k % 3 == 0, "verified_post_sale").otherwise("interim_assumption").alias("tax_status"),
        F.lit("assessor roll").alias("tax_source"),
        dec(u * 110).alias("house_insurance"),
        dec(F.lit(1000)).alias("reserve_per_unit"),
        dec(u * (10 + k % 5)).alias("concession_floor"),
    )


@entry(
    "income_bridge_a14",
    "select k as case_id, err as error_code, "
    + ", ".join(
        m(f"case when err is null then {e} end", n)
        for n, e in {
            "net_rent": "rent",
            "last_3_net_rent": "last3",
            "other_income": "other",
            "credited_other_income": "credited",
            "positive_other_income": "positive",
            "t12_noi": "noi",
            "house_opex": "house_opex",
            "concession_topup": "greatest(0, u * (10 + k % 5) - u * 12)",
            "base_noi": "rent + credited - greatest(0, u * (10 + k % 5) - u * 12) - house_opex",
            "base_after_reserve": "rent + credited - greatest(0, u * (10 + k % 5) - u * 12) - house_opex - 1000 * u",
            "spot_noi": "u * 900 * 12 + credited - u * 10 - greatest(u * (10 + k % 5), u * 12) - house_opex",
            "stress_noi": "rent + credited - greatest(0, u * (10 + k % 5) - u * 12) - house_opex - greatest(0, rent - last3)",
        }.items()
    )
    + """, case when err is null then case when k % 2 = 0 then 11 else 3 end end as shared_months,
        case when err is null then concat_ws(',', case when k % 3 <> 0 then 'POST_SALE_TAX_UNVERIFIED' end,
          case when neg_tax then 'NEGATIVE_TAX_MONTH_REQUIRES_GL_BRIDGE' end, 'FEE_CASH_COLLECTIONS_UNVERIFIED') end as blockers from v_o_cases""",
)
def income_bridge_a14(spark, d):
    out = income.income_bridge(cases(spark, d)).drop("issues", "movein_share", "paired_expense")
    amounts = [c for c in out.columns if c not in ("case_id", "error_code", "shared_months", "blockers")]
    return texts(out, *amounts).withColumn("blockers", F.array_join("blockers", ","))


@entry(
    "other_income_lines_a13",
    f"""select code, issues, count(*) as n, {m('sum(annual)', 'annual')}, {m('sum(annual * credit)', 'house_credit')}, {m('sum(l3)', 'last_3_annualized')},
        {m('sum(l6)', 'last_6_annualized')}, sum(pos)::bigint as positive_months, sum(neg)::bigint as negative_months from (
        select k, 'water' as code, '' as issues, sum(water) as annual, 0.90 as credit, 4 * sum(water) filter (where i >= 9) as l3, 2 * sum(water) filter (where i >= 6) as l6,
               count(*) filter (where water > 0) as pos, count(*) filter (where water < 0) as neg from v_o_months group by k
        union all select k, 'termination', '', sum(term), 0.50, 4 * sum(term) filter (where i >= 9), 2 * sum(term) filter (where i >= 6),
               count(*) filter (where term > 0), count(*) filter (where term < 0) from v_o_months group by k
        union all select k, 'bad_debt', case when k % 17 = 0 then 'BAD_DEBT_SIGN' when k % 19 = 0 then 'NEGATIVE_LINE_CREDIT' else '' end, sum(bad),
               case when k % 19 = 0 then 0.50 else 1.00 end, 4 * sum(bad) filter (where i >= 9), 2 * sum(bad) filter (where i >= 6),
               count(*) filter (where bad > 0), count(*) filter (where bad < 0) from v_o_months group by k) x group by 1, 2""",
)
def other_income_lines_a13(spark, d):
    lines = income.other_income_lines(cases(spark, d)).withColumn("issues", F.array_join("issues", ","))
    sums = ["annual", "house_credit", "last_3_annualized", "last_6_annualized"]
    out = lines.groupBy("code", "issues").agg(
        F.count("*").alias("n"),
        *[F.sum(c).alias(c) for c in sums],
        F.sum("positive_months").alias("positive_months"),
        F.sum("negative_months").alias("negative_months"),
    )
    return texts(out, *sums)


@entry(
    "tie_out_a15",
    """select issues, count(*) as n from (select concat_ws(',', case when k % 23 = 0 then 'UNIT_COUNTS' end, case when k % 13 = 0 then 'RENT_TIE_OUT' end,
        case when k % 17 = 0 or k % 19 = 0 then 'OTHER_INCOME_LINE' end) as issues from v_o_cases) x group by 1""",
)
def tie_out_a15(spark, d):
    out = income.tie_out(cases(spark, d)).select(F.array_join("issues", ",").alias("issues"))
    return out.groupBy("issues").agg(F.count("*").alias("n"))


@entry(
    "annualize_trailing_w6",
    f"""select l_suppkey, month_no, {m('4 * sum(amount) over w', 'last_3_annualized')} from (
          select l_suppkey, extract(month from l_shipdate)::int as month_no, sum(cast(l_extendedprice as decimal(18,2))) as amount
          from lineitem where l_shipdate >= timestamp '1998-01-01' and l_shipdate < timestamp '1999-01-01' group by 1, 2) x
        window w as (partition by l_suppkey order by month_no rows between 2 preceding and current row)""",
)
def annualize_trailing_w6(spark, d):
    li = spark.read.parquet(f"{d}/lineitem.parquet").filter("l_shipdate >= '1998-01-01' and l_shipdate < '1999-01-01'")
    months = li.groupBy("l_suppkey", F.month("l_shipdate").alias("month_no")).agg(
        F.sum(F.col("l_extendedprice").cast("decimal(18,2)")).alias("amount")
    )
    return texts(income.annualize_trailing(months, ["l_suppkey"], 3).drop("amount"), "last_3_annualized")
