"""Views over the given tables, in SQL that Spark and DuckDB both accept, so both sides see the same rows."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels "
    "conversations"
).split()

K = "cast(regexp_extract(props, '([0-9]+)', 1) as int)"


def pid(expr: str) -> str:
    return f"'p' || lpad(cast({expr} % 20 as string), 3, '0')"


VIEWS: dict[str, str] = {}
# Views that Spark builds with its own functions (explode and the like) instead of the SQL text.
SPARK_VIEWS: dict = {}


def view(name: str, sql: str) -> None:
    VIEWS[name] = sql


def _needs(sql: str) -> list[str]:
    words = set(re.findall(r"\bv_[a-z0-9_]+\b", sql))
    return [v for v in VIEWS if v in words]


def _closure(sql: str) -> list[str]:
    seen: list[str] = []

    def visit(text: str) -> None:
        for name in _needs(text):
            if name not in seen:
                visit(VIEWS[name])
                if name not in seen:
                    seen.append(name)

    visit(sql)
    return seen


def with_views(sql: str) -> str:
    """DuckDB text: the query with every view it mentions as a CTE."""
    names = _closure(sql)
    body = sql.strip()
    if not names:
        return body
    heads = ",\n".join(f"{n} as ({VIEWS[n].strip()})" for n in names)
    opening = re.match(r"(?i)with(\s+recursive)?\b", body)
    if opening:
        return f"{opening[0]} {heads},\n{body[opening.end():].strip()}"
    return f"with {heads}\n{body}"


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A given table, or a view over the given tables, as a DataFrame."""
    if name in TABLES:
        return spark.read.parquet(f"{sf_dir}/{name}.parquet")
    if name in SPARK_VIEWS:
        return SPARK_VIEWS[name](spark, sf_dir)
    sql = VIEWS[name]
    used = {t: load(spark, sf_dir, t) for t in TABLES if re.search(rf"\b(from|join)\s+{t}\b", sql)}
    used |= {v: load(spark, sf_dir, v) for v in _needs(sql)}
    text = re.sub(r"\b(from|join)\s+([a-z_0-9]+)\b", lambda m: f"{m[1]} {{{m[2]}}}" if m[2] in used else m[0], sql)
    return spark.sql(text, **used)


view(
    "v_gl",
    f"""
    select cast(l_partkey as string) || '-' || cast(l_suppkey as string) || '-' || cast(cast(l_quantity as int) as string) as id,
           {pid('l_orderkey')} as property_id,
           substr(cast(o_orderdate as string), 1, 7) as period,
           case when l_linestatus = 'F' then 'actual' else 'budget' end as kind,
           cast(4000 + 100 * l_linenumber as string) as account_code,
           'Account ' || cast(l_linenumber as string) as account_name,
           case l_linenumber when 1 then 'Rental Income' when 2 then 'Other Income' when 3 then 'Repairs & Maintenance'
                when 4 then 'Payroll' when 5 then 'Utilities' when 6 then 'Unmapped' else 'Insurance' end as category,
           cast(l_extendedprice as decimal(18,2)) as amount,
           'order_' || cast(l_orderkey as string) as source_file,
           l_linenumber as source_row,
           substr(cast(l_shipdate as string), 1, 10) as created_at
    from lineitem join orders on l_orderkey = o_orderkey""",
)
view(
    "v_properties",
    f"""
    select {pid('s_suppkey')} as id, min(s_name) as name,
           max(case when s_suppkey % 20 = 3 then cast(null as int) when s_suppkey % 20 = 4 then 0 else 100 end) as unit_count
    from supplier group by 1""",
)
view(
    "v_snapshots",
    f"""
    select cast(event_id as string) as id, {pid('user_id')} as property_id, cast(ts as date) as as_of_date,
           60 + {K} % 30 as occupied, 10 + {K} % 7 as vacant, {K} % 4 as down,
           'feed_' || event_type as source_file, {K} as source_row, ts as created_at
    from events""",
)
# Seven account codes taken from the ledger: 4600 has no row, 4500 is only suggested, 4400 has two states,
# 4300 has a property-scoped row for p001 that hides the wildcard one.
view(
    "v_mappings",
    """
    select account_code, account_name, noi_category, status, property_scope from (
      select distinct account_code, account_name, category as noi_category,
             case when account_code = '4500' then 'suggested' else 'approved' end as status, '*' as property_scope
      from v_gl where account_code <> '4600'
      union all
      select distinct account_code, account_name, 'Payroll' as noi_category, 'rejected' as status, '' as property_scope
      from v_gl where account_code = '4400'
      union all
      select distinct account_code, account_name, 'Capital' as noi_category, 'approved' as status, 'p001' as property_scope
      from v_gl where account_code = '4300' and property_id = 'p001') m""",
)
view(
    "v_units",
    f"""
    select 'src_' || cast(c_nationkey as string) as source_id, {pid('c_nationkey')} as property_id,
           cast(c_custkey as string) as unit_id,
           case c_mktsegment when 'FURNITURE' then 'vacant' when 'AUTOMOBILE' then 'down' else 'occupied' end as status,
           case when c_custkey % 11 = 0 then 'commercial' when c_custkey % 13 = 0 then cast(null as string) else 'residential' end as unit_use,
           cast(c_acctbal as decimal(18,2)) as rent
    from customer""",
)
view(
    "v_assertions",
    f"""
    select 'w' as workspace_id, cast(user_id as string) as aggregate_id, event_type || ':' || cast({K} % 4 as string) as key,
           cast(value as decimal(18,2)) as value, cast(ts as date) as valid_from,
           case when {K} % 10 = 9 then cast(null as date) else cast(cast(ts as date) + {K} % 10 + 1 as date) end as valid_to,
           ts + {K} * interval '1' hour as recorded_at, event_id, ts,
           's' || cast({K} % 3 as string) as source_system, cast(event_id as string) as source_record, 1 as source_revision,
           case when {K} % 5 = 0 then lag(event_id) over (partition by user_id, event_type, {K} % 4 order by ts, event_id)
                else cast(null as bigint) end as supersedes_event_id
    from events""",
)
view(
    "v_deals",
    """
    select o_orderkey as deal_id,
           case when o_orderstatus = 'P' and o_orderkey % 7 = 0 then cast(null as decimal(18,2))
                else cast(cast(o_totalprice as decimal(18,2)) * 20 as decimal(18,2)) end as strike,
           cast(10 + o_orderkey % 90 as int) as units,
           case when o_orderkey % 17 = 0 then cast(null as decimal(18,2))
                when o_orderkey % 5 = 0 then cast(5000 + o_orderkey % 60000 as decimal(18,2)) else cast(null as decimal(18,2)) end as price_per_unit,
           cast(cast(400 + o_orderkey % 1000 as decimal(18,4)) * cast(0.0001 as decimal(5,4)) as decimal(18,4)) as going_in_cap,
           cast(cast(550 + o_orderkey % 700 as decimal(18,4)) * cast(0.0001 as decimal(5,4)) as decimal(18,4)) as exit_cap,
           cast(cast(90 + o_orderkey % 60 as decimal(18,2)) * cast(0.01 as decimal(3,2)) as decimal(18,2)) as min_dscr,
           cast(o_orderkey % 900 * 1000 - 50000 as decimal(18,2)) as year1_noi,
           case when o_orderkey % 19 = 0 then cast(null as decimal(18,2)) else cast(o_orderkey % 400 * 1000 as decimal(18,2)) end as capex
    from orders""",
)
view(
    "v_doc_lines",
    """
    select doc_id, cast(pos as int) as line_no, line from (
      select doc_id, generate_subscripts(string_split(text, chr(10)), 1) as pos, unnest(string_split(text, chr(10))) as line
      from documents) x""",
)
