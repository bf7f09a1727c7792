"""Rent-roll and statement intake over cell grids, with SQL twins."""

from __future__ import annotations

from pyspark.sql import functions as F

from registry.common import Register, m, texts
from registry.sqltext import SPARK_VIEWS, load, view
from rentloom.functions import tokens
from rentloom.operators import rentroll, statements
from rentloom.session import cut_lineage

ENTRIES = Register()
entry = ENTRIES.entry

# A rent-roll sheet per nation: title, header, one row per customer with section markers and charge lines between,
# and a total row with one stray row after it.
SEG = "case c_mktsegment when 'FURNITURE' then 'Vacant Rented' when 'AUTOMOBILE' then 'Out of Service' when 'MACHINERY' then 'model' else 'Current' end"
view(
    "v_roll",
    f"""
    select c_custkey as k, 'src_' || cast(c_nationkey as string) as source_id, cast(10 * c_custkey + 20 as int) as row,
           case when c_custkey % 37 = 5 then 'bad id' when c_custkey % 3 = 1 and c_custkey % 29 = 4 then 'U-7' else 'A' || cast(c_custkey % 9000 as string) end as unit_id,
           {SEG} as status_text, case when c_custkey % 8 = 1 then 'Retail' when c_custkey % 31 = 6 then '1BR' else 'Residential' end as use_text,
           case when c_custkey % 40 = 7 then 'Future Residents' when c_custkey % 40 = 27 then 'CURRENT  RESIDENTS' end as marker,
           c_custkey % 5 = 2 as has_charge, max(c_custkey) over (partition by c_nationkey) as last_k
    from customer""",
)
view(
    "v_cells",
    """
    select source_id, 1 as sheet, row, col, text from (
      select distinct source_id, 1 as row, 1 as col, 'Rent Roll' as text from v_roll
      union all select distinct source_id, 3, 1, 'Unit #' from v_roll
      union all select distinct source_id, 3, 2, 'Unit Type' from v_roll
      union all select distinct source_id, 3, 3, 'Occupancy Status' from v_roll
      union all select distinct source_id, 3, 4, 'Charge Code' from v_roll
      union all select source_id, row, 1, unit_id from v_roll
      union all select source_id, row, 2, use_text from v_roll
      union all select source_id, row, 3, status_text from v_roll
      union all select source_id, row + 1, 4, 'pet rent' from v_roll where has_charge
      union all select source_id, row + 2, 1, marker from v_roll where marker is not null
      union all select source_id, row + 3, 1, 'Total' from v_roll where k = last_k
      union all select source_id, row + 4, 4, 'parking' from v_roll where k = last_k) c""",
)
# What the rules make of it, computed without windows over cells: the last marker at or above each row.
view(
    "v_o_roll",
    """
    select r.*, coalesce((select case when lower(x.marker) like 'future%' then 'excluded' else 'current' end from v_roll x
                          where x.source_id = r.source_id and x.marker is not null and x.row + 2 <= r.row order by x.row desc limit 1), 'current') as section,
      case status_text when 'Vacant Rented' then 'vacant' when 'Out of Service' then 'down' when 'Current' then 'occupied' end as st,
      case use_text when 'Retail' then 'commercial' when 'Residential' then 'residential' end as us
    from v_roll r""",
)
view(
    "v_o_units",
    """
    select source_id, unit_id, count(*) filter (where code is null) as evidence_rows, count(*) filter (where code is not null) as skipped_rows,
           min(st) filter (where code is null) as low_st, max(st) filter (where code is null) as st, min(us) filter (where code is null) as low_us,
           max(us) filter (where code is null) as us, coalesce(min(row) filter (where code is null), min(row)) as first_row, max(code) as row_error
    from (select *, case when unit_id = 'bad id' or not regexp_full_match(unit_id, '([A-Z]{1,3}-?)?[0-9]{1,4}[A-Z]?') then 'INVALID_UNIT_ID'
                         when st is null then 'UNSUPPORTED_STATUS' when us is null then 'UNSUPPORTED_UNIT_TYPE' end as code
          from v_o_roll where section = 'current') r group by 1, 2""",
)
view(
    "v_o_units2",
    """
    select source_id, unit_id, first_row, evidence_rows, skipped_rows, case when not differ then st end as status, case when not differ then us end as unit_use,
           case when differ then 'DUPLICATE_UNIT_CONFLICT' when evidence_rows = 0 then row_error end as error_code
    from (select *, coalesce(low_st <> st or low_us <> us, false) as differ from v_o_units) u""",
)


def exploded(df, source, *lists):
    """Cells of several (row, column, text, keep) groups per input row, without reading the input again per group."""
    items = F.filter(F.concat(*lists), lambda x: x["keep"])
    return df.select(F.col(source).alias("source_id"), F.explode(items).alias("c")).select("source_id", "c.row", "c.col", "c.text")


def cell(row, col, text, keep=True):
    text = F.lit(text) if isinstance(text, str) else text
    keep = F.lit(keep) if isinstance(keep, bool) else F.coalesce(keep, F.lit(False))
    return F.struct(row.cast("int").alias("row"), F.lit(col).alias("col") if isinstance(col, int) else col.cast("int").alias("col"), text.alias("text"), keep.alias("keep"))


def roll_cells(spark, d):
    r, row, last = load(spark, d, "v_roll"), F.col("row"), F.col("k") == F.col("last_k")
    body = F.array(
        cell(row, 1, F.col("unit_id")),
        cell(row, 2, F.col("use_text")),
        cell(row, 3, F.col("status_text")),
        cell(row + 1, 4, "pet rent", F.col("has_charge")),
        cell(row + 2, 1, F.col("marker"), F.col("marker").isNotNull()),
        cell(row + 3, 1, "Total", last),
        cell(row + 4, 4, "parking", last),
        cell(F.lit(1), 1, "Rent Roll", last),
        *[cell(F.lit(3), i, t, last) for i, t in enumerate(["Unit #", "Unit Type", "Occupancy Status", "Charge Code"], 1)],
    )
    return exploded(r, "source_id", body).withColumn("sheet", F.lit(1))


SPARK_VIEWS["v_cells"] = roll_cells


def cells(spark, d):
    return load(spark, d, "v_cells").withColumnRenamed("col", "column")


def rows(spark, d):
    c = cells(spark, d)
    return rentroll.section_state(cut_lineage(rentroll.records(c, rentroll.header_row(c))))


@entry(
    "header_row_w11",
    "select distinct source_id, 1 as sheet, 3 as header_row, cast(null as varchar) as error_code from v_roll",
)
def header_row_w11(spark, d):
    return rentroll.header_row(cells(spark, d))


@entry(
    "section_state_w10",
    """select source_id, section, after_total, count(*) as n, sum(row)::bigint as row_sum from (
         select source_id, section, false as after_total, row from v_o_roll
         union all select source_id, section, false, row + 1 from v_o_roll where has_charge
         union all select source_id, case when marker is null then section when lower(marker) like 'future%' then 'excluded' else 'current' end, true, row + 3 from v_o_roll where k = last_k
         union all select source_id, case when marker is null then section when lower(marker) like 'future%' then 'excluded' else 'current' end, true, row + 4 from v_o_roll where k = last_k) x
       group by 1, 2, 3""",
)
def section_state_w10(spark, d):
    out = rows(spark, d).groupBy("source_id", "section", "after_total")
    return out.agg(F.count("*").alias("n"), F.sum("row").alias("row_sum"))


@entry(
    "carry_parent_unit_w9",
    "select source_id, row + 1 as row, unit_id as parent_unit, cast(null as varchar) as error_code from v_o_roll where has_charge",
)
def carry_parent_unit_w9(spark, d):
    out = rentroll.carry_parent_unit(rows(spark, d).filter("not after_total")).filter("is_continuation")
    return out.select("source_id", "row", "parent_unit", "error_code")


@entry(
    "orphan_continuation_w9",
    """select source_id, count(*) as n from (select source_id, row, min(row) over (partition by source_id) as first_unit from v_o_roll) x
       where row = first_unit group by 1""",
)
def orphan_continuation_w9(spark, d):
    """A charge line put above the first unit of each roll has no unit to continue."""
    c = cells(spark, d)
    stray = c.filter("row = 3").select("source_id", "sheet", F.lit(4).alias("row"), F.lit(4).alias("column"), F.lit("storage").alias("text"))
    c = c.unionByName(stray.distinct())
    r = rentroll.section_state(rentroll.records(c, rentroll.header_row(c)))
    out = rentroll.carry_parent_unit(r).filter("error_code = 'ORPHAN_CONTINUATION'")
    return out.groupBy("source_id").agg(F.count("*").alias("n"))


@entry(
    "unit_dedupe_w13",
    "select source_id, unit_id, first_row, evidence_rows, skipped_rows, status, unit_use, error_code from v_o_units2",
)
def unit_dedupe_w13(spark, d):
    return rentroll.normalize_rent_roll(cells(spark, d), stage=cut_lineage)


@entry(
    "unit_evidence_w13",
    """select source_id, unit_id, status, unit_use, error_code, evidence_rows, skipped_rows, least(evidence_rows, 2) as listed, least(skipped_rows, 2) as refused,
        coalesce(evidence_rows > 2, false) as more_evidence, coalesce(skipped_rows > 2, false) as more_refused, first_row from v_o_units2""",
)
def unit_evidence_w13(spark, d):
    """Two rows of evidence a unit, so that the flags are seen; refused rows are listed with their codes."""
    out = rentroll.unit_evidence(rentroll.unit_rows(rentroll.current_rows(rows(spark, d))), 2)
    size = lambda c: F.coalesce(F.size(F.filter(c, lambda x: x["row"] >= 1)), F.lit(0)).cast("bigint")
    return out.select(
        "source_id", "unit_id", "status", "unit_use", "error_code", "evidence_rows", "skipped_rows",
        F.greatest(size("evidence"), F.lit(0)).alias("listed"), F.greatest(size("issues"), F.lit(0)).alias("refused"),
        F.coalesce("evidence_truncated", F.lit(False)).alias("more_evidence"), F.coalesce("issues_truncated", F.lit(False)).alias("more_refused"),
        F.coalesce(F.get("evidence", F.lit(0))["row"], F.get("issues", F.lit(0))["row"]).alias("first_row"),
    )


view(
    "v_o_counts",
    """
    select source_id, unit_use as scope, count(*) filter (where status = 'occupied') as occupied, count(*) filter (where status = 'vacant') as vacant,
           count(*) filter (where status = 'down') as down, count(*) as total from v_units where unit_use is not null group by 1, 2
    union all
    select source_id, 'unknown', count(*) filter (where status = 'occupied'), count(*) filter (where status = 'vacant'),
           count(*) filter (where status = 'down'), count(*) from v_units group by 1""",
)


def plain_units(spark, d):
    return load(spark, d, "v_units").withColumn("error_code", F.lit(None).cast("string"))


@entry(
    "unit_counts_a4",
    """select c.source_id, scope, case when b.bad = 0 then occupied end as occupied, case when b.bad = 0 then vacant end as vacant,
        case when b.bad = 0 then down end as down, case when b.bad = 0 then total end as total, case when b.bad > 0 then 'INVENTORY_INVALID' end as error_code
        from v_o_counts c join (select source_id, count(*) filter (where source_id in ('src_3', 'src_7') and unit_use = 'commercial') as bad from v_units group by 1) b on b.source_id = c.source_id""",
)
def unit_counts_a4(spark, d):
    bad = F.col("source_id").isin("src_3", "src_7") & (F.col("unit_use") == "commercial")
    u = plain_units(spark, d).withColumn("error_code", F.when(bad, F.lit("UNSUPPORTED_STATUS")))
    return rentroll.unit_counts(u)


@entry(
    "reconcile_summary_a5",
    """select source_id, scope, case when s % 5 = 0 then 'absent' when s % 5 in (1, 4) then 'invalid' when s % 5 = 2 then 'mismatch' else 'reconciled' end as summary_status,
        case when s % 5 = 1 then 'INVALID_SUMMARY' when s % 5 = 4 then 'SUMMARY_CONFLICT' when s % 5 = 2 then 'SUMMARY_MISMATCH' end as error_code,
        case when s % 5 = 3 then 'DUPLICATE_SUMMARY_EVIDENCE' end as warning
        from (select source_id, scope, cast(substr(source_id, 5) as int) as s from v_o_counts) x""",
)
def reconcile_summary_a5(spark, d):
    derived = rentroll.unit_counts(plain_units(spark, d))
    s = F.substring("source_id", 5, 9).cast("int") % 5
    once = derived.drop("error_code").filter(s != 0).withColumns(
        {
            "vacant": F.when(s != 1, F.col("vacant")),
            "total": F.when(s == 2, F.col("total") + 1).otherwise(F.col("total")),
        }
    )
    again = once.filter(s.isin(3, 4)).withColumn("down", F.when(s == 4, F.col("down") + 1).otherwise(F.col("down")))
    out = rentroll.reconcile_summary(once.unionByName(again), derived.drop("error_code"))
    return out.select("source_id", "scope", "summary_status", "error_code", "warning")


view(
    "v_vendor",
    """
    select 's' || cast(o_custkey as string) as source_id, case o_orderkey % 7 when 0 then 'occupied_no_ntv' when 1 then 'occupied_ntv' when 2 then 'occupied_ntv_leased'
      when 3 then 'vacant_leased' when 4 then 'vacant_not_leased' when 5 then 'admin_down' else 'totals' end as label, cast(count(*) as bigint) as units
    from orders group by 1, 2""",
)


@entry(
    "vendor_summary_a6",
    """select source_id, case when code is null or code = 'SUMMARY_MISMATCH' then occ end as occupied, case when code is null or code = 'SUMMARY_MISMATCH' then vac end as vacant,
        case when code is null or code = 'SUMMARY_MISMATCH' then adm end as admin_down, case when code is null or code = 'SUMMARY_MISMATCH' then tot end as total, cast(null as bigint) as down, code as error_code
        from (select *, case when n < 7 then 'INCOMPLETE_VENDOR_SUMMARY' when occ + vac + adm <> tot then 'SUMMARY_MISMATCH' end as code from (
          select source_id, sum(units) filter (where label like 'occupied%')::bigint as occ, sum(units) filter (where label like 'vacant%')::bigint as vac,
                 sum(units) filter (where label = 'admin_down')::bigint as adm, sum(units) filter (where label = 'totals')::bigint as tot, count(*) as n from v_vendor group by 1) x) y""",
)
def vendor_summary_a6(spark, d):
    return rentroll.vendor_summary(load(spark, d, "v_vendor"))


@entry(
    "completeness_a32",
    """select source_id, n as listed, r as refused, case when s % 4 = 0 then 'unknown' when r = 0 and s % 4 <> 1 then 'complete' else 'partial' end as enumeration,
        case when s % 4 = 3 and r < 0 then 'x' when s % 4 = 1 then 'COUNTS_EXCEED_COVERAGE' end as error_code
        from (select source_id, cast(substr(source_id, 5) as int) as s, count(*) as n, count(*) filter (where unit_use is null) as r from v_units group by 1) x""",
)
def completeness_a32(spark, d):
    u = plain_units(spark, d).withColumn("error_code", F.when(F.col("unit_use").isNull(), F.lit("UNRESOLVED_UNIT_USE")))
    s = F.substring("source_id", 5, 9).cast("int") % 4
    n = u.groupBy("source_id").agg(F.count("*").alias("n"))
    cov = n.select(
        "source_id",
        F.when(s == 1, F.col("n") - 1).otherwise(F.col("n")).alias("expected_units"),
        F.when(s == 0, 0).otherwise(2).alias("citations"),
    )
    return rentroll.completeness(u, cov)


@entry(
    "unit_consistency_j18",
    """select source_id, unit_id, case when code is null then st end as status, case when code is null then us end as unit_use, code as error_code from (
        select source_id, unit_id, max(st) as st, max(us) as us, case when max(bad) = 1 then 'UNSUPPORTED_TOKEN' when count(distinct st) > 1 or count(distinct us) > 1 then 'INCONSISTENT_UNIT'
               when count(st) = 0 or count(us) = 0 then 'OPEN_FIELD' end as code from (
          select source_id, unit_id, status as st, unit_use as us, 0 as bad from v_units
          union all select source_id, unit_id, case when cast(unit_id as int) % 6 = 0 then 'vacant' when cast(unit_id as int) % 15 = 4 then null else status end, coalesce(unit_use, 'residential'),
                 case when cast(unit_id as int) % 15 = 4 and cast(unit_id as int) % 6 <> 0 then 1 else 0 end from v_units where cast(unit_id as int) % 3 <> 2) x group by 1, 2) y""",
)
def unit_consistency_j18(spark, d):
    n = F.col("unit_id").cast("int")
    u = load(spark, d, "v_units").select("source_id", "unit_id", F.col("status").alias("unit_status"), "unit_use")
    more = u.filter(n % 3 != 2).withColumns(
        {
            "unit_status": F.when(n % 6 == 0, "vacant").when(n % 15 == 4, F.lit(None)).otherwise(F.col("unit_status")),
            "unit_use": F.coalesce("unit_use", F.lit("residential")),
        }
    )
    rows_ = u.withColumn("supplemental", F.lit(False)).unionByName(more.withColumn("supplemental", F.lit(True)))
    return rentroll.unit_consistency(rows_)


@entry(
    "redact_pii_p8",
    """select source_id, '[REDACTED]' as tenant_name, count(*) as n from v_units group by 1""",
)
def redact_pii_p8(spark, d):
    u = spark.read.parquet(f"{d}/customer.parquet").select(
        F.concat(F.lit("src_"), F.col("c_nationkey").cast("string")).alias("source_id"), F.col("c_name").alias("tenant_name")
    )
    return rentroll.redact_pii(u).groupBy("source_id", "tenant_name").agg(F.count("*").alias("n"))


@entry(
    "get_rent_roll_c1",
    f"""select property_id, unit_id, {m('rent', 'rent')} from v_units where status = 'vacant'""",
)
def get_rent_roll_c1(spark, d):
    u = load(spark, d, "v_units").withColumn("resident_name", F.lit("x"))
    return texts(rentroll.get_rent_roll(u, status="vacant").select("property_id", "unit_id", "rent"), "rent")


# ---------------------------------------------------------------- words


@entry(
    "status_token_f11",
    """select s as style, layout, token, count(*) as n from (
      select c_custkey % 6 as s, 'standard' as layout, case c_custkey % 6 when 0 then 'occupied' when 1 then 'vacant' when 2 then 'down' end as token from customer
      union all select c_custkey % 6, 'ledger', case c_custkey % 6 when 0 then 'occupied' when 1 then 'vacant' when 2 then 'down' when 3 then 'vacant' end from customer
      union all select c_custkey % 6, 'onesite', case c_custkey % 6 when 4 then 'occupied' end from customer
      union all select c_custkey % 6, 'lease_charge', case c_custkey % 6 when 1 then 'vacant' when 2 then 'down' when 5 then null else 'occupied' end from customer
      union all select c_custkey % 6, 'pdf', case c_custkey % 6 when 1 then 'vacant' when 2 then 'down' when 3 then 'vacant' when 5 then null else 'occupied' end from customer) x
    group by 1, 2, 3""",
)
def status_token_f11(spark, d):
    c = spark.read.parquet(f"{d}/customer.parquet").withColumn("s", F.col("c_custkey") % 6)
    words = ["Notice  Rented", "vacant unrented", "Out of Service", "Vacant-Leased", "occupied ntv", "Model"]
    text = F.element_at(F.array(*[F.lit(w) for w in words]), (F.col("s") + 1).cast("int"))
    layouts = ["standard", "ledger", "onesite", "lease_charge", "pdf"]
    tagged = F.array(*[F.struct(F.lit(n).alias("layout"), tokens.status_token(text, n).alias("token")) for n in layouts])
    out = c.select(F.col("s").alias("style"), F.inline(tagged))
    return out.groupBy("style", "layout", "token").agg(F.count("*").alias("n"))


@entry(
    "use_token_f12",
    """select s as style, case s when 0 then 'residential' when 1 then 'commercial' when 2 then 'commercial' end as token, count(*) as n
       from (select c_custkey % 4 as s from customer) x group by 1, 2""",
)
def use_token_f12(spark, d):
    c = spark.read.parquet(f"{d}/customer.parquet").withColumn("s", F.col("c_custkey") % 4)
    words = [" Apartment ", "RETAIL", "office", "2BR/2BA"]
    text = F.element_at(F.array(*[F.lit(w) for w in words]), (F.col("s") + 1).cast("int"))
    return c.select(F.col("s").alias("style"), tokens.use_token(text).alias("token")).groupBy("style", "token").agg(F.count("*").alias("n"))


CHARGE_WORDS = ["Pet Rent", "Rent", "Garage - 12", "lease", "cam", "Damage Waiver", "Balance", "Base Rent Adj", "Free Rent", "xyz", "", "Model Concession"]
CHARGE_EXPECTED = {
    "lease_charge": "pet base_rent parking base_rent other_ancillary other_ancillary other_ancillary other_ancillary concessions other_ancillary unknown concessions",
    "ledger": "pet base_rent parking unknown utilities unknown unknown base_rent concessions unknown unknown concessions",
    "compact": "pet base_rent parking unknown unknown insurance unknown base_rent concessions unknown unknown concessions",
    "pdf": "pet base_rent parking unknown unknown unknown unknown base_rent concessions unknown unknown concessions",
}


@entry(
    "classify_charge_f13",
    "select s as style, layout, charge, count(*) as n from ("
    + " union all ".join(
        f"select o_orderkey % 12 as s, '{layout}' as layout, list_extract(['"
        + "','".join(words.split())
        + "'], (o_orderkey % 12 + 1)::int) as charge from orders"
        for layout, words in CHARGE_EXPECTED.items()
    )
    + ") x group by 1, 2, 3",
)
def classify_charge_f13(spark, d):
    o = spark.read.parquet(f"{d}/orders.parquet").withColumn("s", F.col("o_orderkey") % 12)
    text = F.element_at(F.array(*[F.lit(w) for w in CHARGE_WORDS]), (F.col("s") + 1).cast("int"))
    tagged = F.array(
        *[F.struct(F.lit(n).alias("layout"), tokens.classify_charge(text, n).alias("charge")) for n in CHARGE_EXPECTED]
    )
    return o.select(F.col("s").alias("style"), F.inline(tagged)).groupBy("style", "layout", "charge").agg(F.count("*").alias("n"))


@entry(
    "valid_unit_id_f14",
    """select unit_id, regexp_full_match(unit_id, '([A-Z]{1,3}-?)?[0-9]{1,4}[A-Z]?') as valid, count(*) as n from v_roll group by 1, 2""",
)
def valid_unit_id_f14(spark, d):
    r = load(spark, d, "v_roll").select("unit_id", tokens.valid_unit_id(F.col("unit_id")).alias("valid"))
    return r.groupBy("unit_id", "valid").agg(F.count("*").alias("n"))


@entry(
    "header_key_f10",
    """select n_nationkey, lower(n_name) as spaced, 'region ' || n_regionkey || ' ' || lower(replace(n_name, '_', ' ')) as folded from nation""",
)
def header_key_f10(spark, d):
    n = spark.read.parquet(f"{d}/nation.parquet")
    raw = F.concat(F.lit("\u00a0 Region:\u00a0"), F.col("n_regionkey").cast("string"), F.lit(" / "), F.col("n_name"))
    return n.select(
        "n_nationkey",
        tokens.header_key(F.concat(F.lit(" \u00a0"), F.col("n_name"), F.lit("\u2003 "))).alias("spaced"),
        tokens.header_key(raw, "punctuation").alias("folded"),
    )


@entry(
    "parse_rent_line_f38",
    f"""select o_orderkey, 'A' || o_orderkey as unit_id, 'Name ' || o_custkey || ' X' as resident_name,
        {m('o_totalprice', 'resident_rent')}, case when o_orderkey % 3 = 0 then 0 when o_orderkey % 3 = 1 then 1 else 2 end as dates, '-12.50' as balance
        from orders where o_orderkey % 5 <> 4""",
)
def parse_rent_line_f38(spark, d):
    k = F.col("o_orderkey")
    rent = F.col("o_totalprice").cast("decimal(18,2)").cast("string")
    dates = F.when(k % 3 == 0, "").when(k % 3 == 1, " 1/5/2026").otherwise(" 01/05/2026 2027-01-04")
    line = F.concat(
        F.lit("  A"), k.cast("string"), F.lit("  1BR 1,050 Name "), F.col("o_custkey").cast("string"), F.lit(" X  900.00 "),
        rent, F.lit(" 35"), dates, F.when(k % 5 == 4, " n/a").otherwise(" -12.50"),
    )
    o = spark.read.parquet(f"{d}/orders.parquet").select(k, tokens.parse_rent_line(line).alias("p")).filter("p is not null")
    return o.select(k, "p.unit_id", "p.resident_name", "p.resident_rent", F.size("p.dates").alias("dates"), "p.balance")


# ---------------------------------------------------------------- statements

# A statement for every property and year of actuals: months across, one line per (account, supplier group), with gaps,
# dashes, blank rows, section rows, totals, a cumulative and an unknown column. The last year of the ledger is a part of one.
# Statement headers know months of 2000 to 2099 only, so every year of the ledger stands twenty years later.
view(
    "v_stmt_lines",
    """
    select property_id, property_id || '-' || year as source_id, year, case when source_row = 6 and seq = 1 then '  ' else case source_row when 1 then 'Total Income ' when 7 then 'Section ' else account_name || ' ' end || cast(seq as string) end as label,
           cast(10 + source_row * 10 + seq as int) as row, substr(period, 6, 2) as mm, source_row as line, seq, sum(amount) as amount, max(source_row) as x
    from (select property_id, cast(cast(substr(period, 1, 4) as int) + 20 as string) as year, account_name, period, source_row, amount, cast(substr(source_file, length(source_file), 1) as int) % 3 as seq from v_gl where kind = 'actual') g
    group by 1, 2, 3, 4, 5, 6, 7, 8""",
)
view(
    "v_stmt_cells",
    """
    select source_id, row, col, text from (
      select distinct source_id, 4 as row, 1 as col, 'Account' as text from v_stmt_lines
      union all select distinct source_id, 4, 1 + cast(mm as int), case mm when '01' then 'Jan ' || year else year || '-' || mm end from v_stmt_lines where property_id <> 'p005' or mm <> '07'
      union all select distinct source_id, 4, 14, 'YTD Total' from v_stmt_lines
      union all select distinct source_id, 4, 15, 'Variance' from v_stmt_lines
      union all select distinct source_id, row, 1, label from v_stmt_lines
      union all select source_id, row, 1 + cast(mm as int), case when (line + seq) % 4 = 3 then '-' else cast(amount as string) end from v_stmt_lines where line <> 7
      union all select source_id, row, 14, cast(amount as string) from v_stmt_lines where mm = '12'
      union all select source_id, row, 15, 'x' from v_stmt_lines where mm = '12' and property_id = 'p002') c""",
)
MAPPING_SQL = """select label as source_label, case line when 2 then 'other_income' when 3 then 'repairs_and_maintenance' when 4 then 'payroll' else 'utilities' end as canonical_account,
                 'map_' || label as mapping_ref from (select distinct label, line from v_stmt_lines where line in (2, 3, 4, 5) and seq <> 2) m"""
view("v_stmt_mapping", MAPPING_SQL)


def stmt_cells(spark, d):
    x = load(spark, d, "v_stmt_lines")
    month, row = F.col("mm").cast("int") + 1, F.col("row")
    december, amount = F.col("mm") == "12", F.col("amount").cast("string")
    title = F.when(F.col("mm") == "01", F.concat(F.lit("Jan "), "year")).otherwise(F.concat("year", F.lit("-"), F.col("mm")))
    top = F.lit(4)
    body = F.array(
        cell(row, month, F.when((F.col("line") + F.col("seq")) % 4 == 3, "-").otherwise(amount), F.col("line") != 7),
        cell(row, 14, amount, december),
        cell(row, 15, "x", december & (F.col("property_id") == "p002")),
    )
    heads = F.array(
        cell(top, 1, "Account"),
        cell(top, month, title, (F.col("property_id") != "p005") | (F.col("mm") != "07")),
        cell(top, 14, "YTD Total"),
        cell(top, 15, "Variance"),
        cell(row, 1, F.col("label")),
    )
    return exploded(x, "source_id", body).unionByName(exploded(x, "source_id", heads).distinct())


SPARK_VIEWS["v_stmt_cells"] = stmt_cells


def stmt(spark, d):
    c = load(spark, d, "v_stmt_cells").withColumnRenamed("col", "column")
    year = F.substring_index("source_id", "-", -1)
    s = c.select("source_id").distinct().select(
        "source_id",
        F.lit(4).alias("header_row"),
        F.lit(1).alias("label_column"),
        F.concat(year, F.when(F.col("source_id").startswith("p007-"), "-02").otherwise("-01")).alias("first_month"),
        F.concat(year, F.lit("-12")).alias("last_month"),
    )
    return c, s


def stmt_rows(spark, d):
    c, s = stmt(spark, d)
    columns = statements.column_roles(c, s)
    return statements.statement_rows(c, s, columns, load(spark, d, "v_stmt_mapping")), columns, s


view(
    "v_o_stmt_cols",
    """
    select source_id, col, header, case when col = 1 then 'label' when col between 2 and 13 and header is not null then case when source_id like 'p007-%' and col = 2 then 'excluded' else 'month' end
             when col = 14 then 'cumulative' else 'unrecognized' end as role,
           case when col between 2 and 13 and header is not null and not (source_id like 'p007-%' and col = 2) then split_part(source_id, '-', 2) || '-' || lpad(cast(col - 1 as varchar), 2, '0') end as month,
           case when source_id like 'p007-%' and col = 2 then 'MONTH_OUTSIDE_WINDOW' end as error_code, has_data
    from (select source_id, col, max(case when row = 4 then text end) as header, max(case when row > 4 then 1 else 0 end) = 1 as has_data from v_stmt_cells group by 1, 2) x""",
)


@entry("column_role_f16", "select source_id, col, header, role, month, has_data, error_code from v_o_stmt_cols")
def column_role_f16(spark, d):
    return statements.column_roles(*stmt(spark, d)).withColumnRenamed("column", "col")


view(
    "v_o_stmt_cover",
    """
    select s.source_id, string_agg(case when k.month is null then s.mth end, ',' order by s.mth) as missing, count(k.month) as present,
           coalesce(max(b.error_code), case when count(k.month) = 0 then 'NO_MONTH_COLUMNS' when max(case when k.has_data then 1 else 0 end) = 0 then 'EMPTY_STATEMENT' end) as error_code
    from (select x.source_id, split_part(x.source_id, '-', 2) || '-' || lpad(cast(r.i as varchar), 2, '0') as mth from (select distinct source_id from v_stmt_cells) x
          join range(1, 13) r(i) on not (x.source_id like 'p007-%' and r.i = 1)) s
    left join v_o_stmt_cols k on k.source_id = s.source_id and k.month = s.mth
    left join (select source_id, max(error_code) as error_code from v_o_stmt_cols group by 1) b on b.source_id = s.source_id group by 1""",
)


@entry(
    "month_coverage_a20",
    "select source_id, case when present = 12 then 'complete' else 'partial' end as coverage, coalesce(missing, '') as missing_months, error_code from v_o_stmt_cover",
)
def month_coverage_a20(spark, d):
    c, s = stmt(spark, d)
    out = statements.month_coverage(statements.column_roles(c, s), s)
    return out.select("source_id", "coverage", F.array_join("missing_months", ",").alias("missing_months"), "error_code")


view(
    "v_o_stmt_rows",
    """
    select r.*, case when trim(coalesce(label, '')) = '' and n = 0 then 'blank' when trim(coalesce(label, '')) = '' then 'unlabeled' when label like 'Total%' then 'total'
             when n = 0 and mp.source_label is null then 'section' else 'line_item' end as row_kind, mp.canonical_account, mp.source_label is not null as is_mapped
    from (select c.source_id, c.row, max(case when c.col = 1 then text end) as label, count(*) filter (where month is not null) as n,
                 count(*) filter (where month is not null and text = '-') as dashes, count(*) filter (where month is not null and text <> '-' and cast(try_cast(text as double) as double) <> 0) as nonzero
          from v_stmt_cells c left join v_o_stmt_cols k on k.source_id = c.source_id and k.col = c.col where c.row > 4 group by 1, 2) r
    left join v_stmt_mapping mp on mp.source_label = r.label""",
)


@entry(
    "statement_rows_f15",
    """select source_id, row, row_kind, case when row_kind = 'line_item' then canonical_account end as canonical_account,
        case when row_kind in ('blank', 'section', 'total') then 'not_applicable' when row_kind = 'line_item' and is_mapped then 'mapped' else 'unmapped' end as mapping_state from v_o_stmt_rows""",
)
def statement_rows_f15(spark, d):
    return stmt_rows(spark, d)[0].select("source_id", "row", "row_kind", "canonical_account", "mapping_state")


@entry(
    "row_census_a19",
    "select source_id, "
    + ", ".join(f"count(*) filter (where row_kind = '{k}') as {k}" for k in ("blank", "section", "line_item", "total", "unlabeled"))
    + " from v_o_stmt_rows group by 1",
)
def row_census_a19(spark, d):
    return statements.row_census(stmt_rows(spark, d)[0])


@entry(
    "map_t12_labels_j10",
    f"""select r.source_id, r.canonical_account, k.month, count(*) as n, {m("sum(try_cast(c.text as decimal(18,2)))", 'amount', 8)}
        from v_o_stmt_rows r join v_o_stmt_cols k on k.source_id = r.source_id and k.month is not null
        left join v_stmt_cells c on c.source_id = r.source_id and c.row = r.row and c.col = k.col
        where r.row_kind = 'line_item' and r.canonical_account is not null group by 1, 2, 3""",
)
def map_t12_labels_j10(spark, d):
    long = statements.t12_cells(stmt_rows(spark, d)[0]).filter("canonical_account is not null")
    out = long.groupBy("source_id", "canonical_account", "month")
    return texts(out.agg(F.count("*").alias("n"), F.sum("amount").alias("amount")), "amount", scale=8)


# A statement for every property and year. Account 4300 has an entry of its own in some statements, 4400 two of them in
# others; 4500 is mapped twice for all, and once more in a few statements.
view("v_labels", "select distinct property_id || '-' || substr(period, 1, 4) as source_id, account_name as source_label, account_code as code, cast(substr(property_id, 2) as int) as p from v_gl")


@entry(
    "map_labels_j10",
    """select source_id, source_label, case when own then 'own_' || code when not bad then 'acct_' || code end as canonical_account,
        case when own then 'map_own' when not bad then 'map_all' end as mapping_ref, case when bad and not own then 'INVALID_MAPPING' end as mapping_error
        from (select *, (code = '4300' and p % 3 = 1) or (code = '4500' and p % 7 = 3) as own, (code = '4400' and p % 5 = 2) or code = '4500' as bad from v_labels) x""",
)
def map_labels_j10(spark, d):
    rows = load(spark, d, "v_labels")
    code, p = F.col("code"), F.col("p")

    def entry_of(source, account, ref):
        return F.struct(source.cast("string").alias("source_id"), "source_label", account.alias("canonical_account"), F.lit(ref).alias("mapping_ref"))

    everywhere = rows.select("source_label", "code").distinct()
    shared = entry_of(F.lit(None), F.concat(F.lit("acct_"), code), "map_all")
    again = entry_of(F.lit(None), F.lit("another"), "map_all")
    shared = everywhere.select(F.inline(F.when(code == "4500", F.array(shared, again)).otherwise(F.array(shared))))
    own = entry_of(F.col("source_id"), F.concat(F.lit("own_"), code), "map_own")
    single = ((code == "4300") & (p % 3 == 1)) | ((code == "4500") & (p % 7 == 3))
    owned = rows.filter(single | ((code == "4400") & (p % 5 == 2)))
    owned = owned.select(F.inline(F.when(code == "4400", F.array(own, own)).otherwise(F.array(own))))
    return statements.map_labels(rows.drop("code", "p"), shared.unionByName(owned))


@entry(
    "missing_months_u3",
    """select property_id, account_code, year, string_agg(mth, ',' order by mth) as missing from (
        select a.property_id, a.account_code, a.year, p.mth from (select distinct property_id, account_code, substr(period, 1, 4) as year from v_gl where kind = 'actual') a
        join (select cast(y as varchar) as year, y || '-' || lpad(cast(i as varchar), 2, '0') as mth from range(1900, 2100) q(y), range(1, 13) r(i)) p on p.year = a.year
        left join (select distinct property_id, account_code, period from v_gl where kind = 'actual') g on g.property_id = a.property_id and g.account_code = a.account_code and g.period = p.mth
        where g.period is null) x group by 1, 2, 3""",
)
def missing_months_u3(spark, d):
    """The months of every year in which a property's account has actuals, less those it has."""
    from rentloom.functions.period import month_range

    g = load(spark, d, "v_gl").filter("kind = 'actual'")
    have = g.groupBy("property_id", "account_code", F.substring("period", 1, 4).alias("year")).agg(F.collect_set("period").alias("have"))
    wanted = month_range(F.concat("year", F.lit("-01")), F.concat("year", F.lit("-12")))
    missing = F.array_except(wanted, F.col("have"))
    return have.select("property_id", "account_code", "year", F.array_join(missing, ",").alias("missing")).filter("missing <> ''")


ISSUE_SQL = """select source_id, code, severity, count(*) as n from (
    select source_id, 'UNMAPPED_ACCOUNT' as code, case when nonzero > 0 then 'blocker' else 'warning' end as severity from v_o_stmt_rows where row_kind = 'line_item' and not is_mapped
    union all select source_id, 'UNLABELED_ROW', 'blocker' from v_o_stmt_rows where row_kind = 'unlabeled'
    union all select r.source_id, 'MISSING_MONTH_CELL', 'blocker' from v_o_stmt_rows r join (select source_id, count(month) as months from v_o_stmt_cols group by 1) k on k.source_id = r.source_id
        where row_kind in ('line_item', 'total', 'unlabeled') and n - dashes < months
    union all select source_id, 'UNRECOGNIZED_COLUMN', case when has_data then 'blocker' else 'warning' end from v_o_stmt_cols where role = 'unrecognized'
    union all select source_id, 'PARTIAL_MONTH_COVERAGE', 'blocker' from v_o_stmt_cover where present < 12) x group by 1, 2, 3"""
view("v_o_stmt_issues", ISSUE_SQL)


def issues(spark, d):
    r, columns, s = stmt_rows(spark, d)
    coverage = statements.month_coverage(columns, s)
    return statements.statement_issues(r, columns, coverage), coverage


@entry("t12_issues_a21", "select source_id, code, severity, n from v_o_stmt_issues")
def t12_issues_a21(spark, d):
    return issues(spark, d)[0].groupBy("source_id", "code", "severity").agg(F.count("*").alias("n"))


@entry(
    "t12_status_a21",
    """select source_id, sum(n)::bigint as issues, case when max(e) is not null then 'refused' when max(case when severity = 'blocker' then 1 else 0 end) = 1 then 'blocked' else 'observed_unvalidated' end as status
       from (select i.*, c.error_code as e from v_o_stmt_issues i join v_o_stmt_cover c using (source_id)) y group by 1""",
)
def t12_status_a21(spark, d):
    return statements.t12_status(*issues(spark, d)).select("source_id", "issues", "status")


@entry(
    "column_overrides_x4",
    """select source_id, col, case when col = 15 then 'descriptor' else role end as role, cast(null as varchar) as error_code from v_o_stmt_cols""",
)
def column_overrides_x4(spark, d):
    """The caller marks the stray month of p007 as excluded and the unknown column as a descriptor."""
    c, s = stmt(spark, d)
    marks = s.select(
        "source_id",
        F.inline(
            F.filter(
                F.array(
                    F.struct(F.lit(15).alias("column"), F.lit("descriptor").alias("role")),
                    F.struct(F.when(F.col("source_id").startswith("p007-"), 2).alias("column"), F.lit("excluded").alias("role")),
                ),
                lambda x: x["column"].isNotNull(),
            )
        ),
    )
    out = statements.column_roles(c, s, marks)
    return out.select("source_id", F.col("column").alias("col"), "role", "error_code")


@entry(
    "is_nonzero_f17",
    """select source_id, count(*) filter (where nonzero > 0) as material_rows from v_o_stmt_rows where row_kind = 'line_item' group by 1""",
)
def is_nonzero_f17(spark, d):
    from rentloom.functions.money import is_nonzero

    cells = statements.t12_cells(stmt_rows(spark, d)[0]).filter("row_kind = 'line_item'")
    rows = cells.groupBy("source_id", "row").agg(F.bool_or(is_nonzero(F.col("amount"))).alias("material"))
    return rows.groupBy("source_id").agg(F.count_if("material").alias("material_rows"))
