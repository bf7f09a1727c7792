"""Policy, governance, request and metric queries with their SQL twins."""

from __future__ import annotations

from pyspark.sql import functions as F

from registry.common import Register, m, texts
from registry.sqltext import load, view
from rentloom.operators import governance as gov
from rentloom.operators import ledger, metric, occupancy, ops, policy, requests, workflow
from rentloom.session import cut_lineage

ENTRIES = Register()
entry = ENTRIES.entry


def orders(spark, d):
    return load(spark, d, "orders").withColumn("k", F.col("o_orderkey"))


def hex64(c):
    return F.sha2(c.cast("string"), 256)


def joined(df, name="issues"):
    return df.withColumn(name, F.array_join(name, ","))


# ---------------------------------------------------------------- requests


@entry(
    "normalize_asset_p1",
    "select s_suppkey, lower(replace(s_name, '#', '_')) as slug from supplier",
)
def normalize_asset_p1(spark, d):
    s = load(spark, d, "supplier")
    raw = F.concat(F.lit("  "), F.regexp_replace("s_name", "#", " "), F.lit(" "))
    return s.select("s_suppkey", requests.normalize_asset(raw).alias("slug"))


@entry(
    "resolve_property_p2",
    """select s_suppkey, case s_suppkey % 5 when 0 then 'S' || s_suppkey when 1 then 'S' || s_suppkey when 2 then 'S' || s_suppkey end as property_id,
        case s_suppkey % 5 when 3 then 'AMBIGUOUS_PROPERTY' when 4 then 'NOT_FOUND' end as error_code from supplier""",
)
def resolve_property_p2(spark, d):
    s, k = load(spark, d, "supplier"), F.col("s_suppkey")
    name = F.concat(F.lit("Oak Park "), k.cast("string"))
    one = F.struct(F.concat(F.lit("S"), k.cast("string")).alias("id"), name.alias("name"))
    two = F.struct(F.concat(F.lit("T"), k.cast("string")).alias("id"), F.upper(name).alias("name"))
    props = s.select(F.inline(F.when(k % 5 == 3, F.array(one, two)).otherwise(F.array(one))))
    ask = (
        F.when(k % 5 == 0, F.concat(F.lit("S"), k.cast("string")))
        .when(k % 5 == 1, F.upper(name))
        .when(k % 5 == 4, F.lit("nobody"))
        .otherwise(F.concat(F.lit("oak_park_"), k.cast("string")))
    )
    return requests.resolve_property(s.select("s_suppkey", ask.alias("asset_id")), props).drop("asset_id")


@entry(
    "validate_requests_p3",
    "select k as style, case when k <> 0 then 'INVALID_INPUT' end as error_code, count(*) as n from (select o_orderkey % 6 as k from orders) x group by 1, 2",
)
def validate_requests_p3(spark, d):
    o, s = orders(spark, d), F.col("k") % 6
    month = F.date_format("o_orderdate", "yyyy-MM")
    asked = o.select(
        s.alias("style"),
        F.when(s == 1, "Portfolio").when(s == 2, "two words").otherwise(F.concat(F.lit("p-"), F.col("k").cast("string"))).alias("asset_id"),
        F.when(s == 3, F.date_format("o_orderdate", "yyyy-13")).when(s == 4, F.lit(None)).otherwise(month).alias("period"),
        F.when(s == 5, F.date_sub(F.trunc("o_orderdate", "month"), 1)).otherwise(F.col("o_orderdate").cast("date")).alias("as_of"),
    )
    return requests.validate_requests(asked).groupBy("style", "error_code").agg(F.count("*").alias("n"))


@entry("require_schema_p4", "select n_nationkey, n_name, n_regionkey from nation")
def require_schema_p4(spark, d):
    from rentloom.schemas import contract

    return requests.require_schema(load(spark, d, "nation"), contract("n_regionkey int, n_name string, n_nationkey int"))


@entry("filter_uncertified_p22", "select event_type, count(*) as n from events where event_id % 3 <> 0 group by 1")
def filter_uncertified_p22(spark, d):
    k = F.col("event_id") % 3
    e = load(spark, d, "events").withColumn("context", F.when(k == 0, "forge").when(k == 1, "ops_actuals"))
    return requests.filter_uncertified(e).groupBy("event_type").agg(F.count("*").alias("n"))


@entry("duplicate_keys_u8", "select o_custkey, o_orderpriority, count(*) as copies from orders group by 1, 2 having count(*) > 1")
def duplicate_keys_u8(spark, d):
    return requests.duplicate_keys(load(spark, d, "orders"), ["o_custkey", "o_orderpriority"])


@entry(
    "search_transactions_c7",
    f"select property_id, period, count(*) as n, {m('sum(amount)', 'amount')} from v_gl where account_code = '4300' group by 1, 2",
)
def search_transactions_c7(spark, d):
    g = load(spark, d, "v_gl").withColumn("payee", F.lit("someone"))
    out = requests.search_transactions(g, "4300", "ACCOUNT").groupBy("property_id", "period")
    return texts(out.agg(F.count("*").alias("n"), F.sum("amount").alias("amount")), "amount")


@entry(
    "union_kinds_u2",
    f"select kind, count(*) as n, {m('sum(amount)', 'amount')} from v_gl group by 1",
)
def union_kinds_u2(spark, d):
    g = load(spark, d, "v_gl")
    both = ops.union_kinds(g.filter("kind = 'actual'").drop("kind"), g.filter("kind = 'budget'").drop("kind"))
    return texts(both.groupBy("kind").agg(F.count("*").alias("n"), F.sum("amount").alias("amount")), "amount")


@entry(
    "covered_accounts_u1",
    """select property_id, count(*) filter (where a and b) as covered, count(*) filter (where a and not b) as missing_budget, count(*) filter (where b and not a) as missing_actual
       from (select property_id, period, account_code, bool_or(kind = 'actual') as a, bool_or(kind = 'budget') as b from v_gl group by 1, 2, 3) x group by 1""",
)
def covered_accounts_u1(spark, d):
    r = ops.actual_budget_coverage(ops.account_rollup(ops.dedupe_gl(load(spark, d, "v_gl"))))
    c = F.col("coverage")
    return r.groupBy("property_id").agg(
        F.count_if(c == "covered").alias("covered"),
        F.count_if(c == "MISSING_BUDGET").alias("missing_budget"),
        F.count_if(c == "BUDGET_WITHOUT_ACTUAL").alias("missing_actual"),
    )


@entry(
    "inventory_equality_u4",
    "select source_id, unit_id, 'left' as side, 1::bigint as excess from v_units where cast(unit_id as int) % 50 = 9",
)
def inventory_equality_u4(spark, d):
    rows = load(spark, d, "v_units").select("source_id", "unit_id")
    return ledger.same_rows(rows, rows.filter(F.col("unit_id").cast("int") % 50 != 9))


# ---------------------------------------------------------------- sources, citations, money

view(
    "v_sources",
    """
    select 'src_' || cast(doc_id as string) as source_id, text, doc_id as k, case when doc_id % 5 = 4 then 'derivative' else 'original' end as role,
           case when doc_id % 5 = 4 then doc_id - 1 - doc_id % 3 when doc_id % 50 = 10 then doc_id - 1 end as parent
    from documents""",
)


def sources(spark, d):
    s = load(spark, d, "v_sources")
    none = F.expr("cast(array() as array<string>)")
    parents = F.when(F.col("parent").isNotNull(), F.array(F.concat(F.lit("src_"), F.col("parent").cast("string")))).otherwise(none)
    return s.select("source_id", F.sha2("text", 256).alias("sha256"), "role", parents.alias("parents"), "k")


@entry(
    "validate_sources_p11",
    """select source_id, concat_ws(',', case when count(*) over (partition by text) > 1 then 'DUPLICATE_SHA' end,
         case when (parent is not null) <> (role = 'derivative') then 'PARENTS_ROLE_MISMATCH' end,
         case when parent is not null and parent % 5 = 4 then 'PARENT_NOT_ORIGINAL' when parent < 0 then 'PARENT_NOT_ORIGINAL' end) as issues from v_sources""",
)
def validate_sources_p11(spark, d):
    return joined(gov.validate_sources(sources(spark, d))).select("source_id", "issues")


@entry(
    "validate_citations_p10",
    """select source_id, case when k % 7 = 1 then 'INVALID_LOCATOR' when k % 7 = 2 then 'UNKNOWN_SOURCE' when k % 5 = 4 then 'NOT_ORIGINAL'
         when k % 7 = 3 then 'HASH_MISMATCH' when k % 7 = 4 then 'SCOPE_MISMATCH' end as error_code from v_sources""",
)
def validate_citations_p10(spark, d):
    s = sources(spark, d)
    k = F.col("k") % 7
    cites = s.select(
        F.col("source_id").alias("for_id"),
        F.when(k == 2, "src_none").otherwise(F.col("source_id")).alias("cited_id"),
        F.when(k == 3, "0").otherwise(F.col("sha256")).alias("cited_sha256"),
        F.when(k == 4, "src_0").otherwise(F.col("source_id")).alias("by_source_id"),
        F.when(k != 5, 1).alias("sheet"),
        F.when(k != 5, 4).alias("row"),
        F.when(k != 5, F.when(k == 1, 3).otherwise(4)).alias("row_end"),
        F.when(k != 5, 2).alias("column"),
        F.when(k == 5, 9).alias("page"),
        F.when(k == 5, F.array(F.lit(0), F.lit(0), F.lit(10), F.lit(10))).alias("bounds"),
    )
    out = gov.validate_citations(cites, s.drop("k"))
    return out.select(F.col("for_id").alias("source_id"), "error_code")


@entry(
    "validate_money_observations_p9",
    """select k, case k when 1 then 'MIXED_MEASUREMENT_BASIS' when 2 then 'FORMULA_CACHE_NOT_ORIGINAL' when 3 then 'INVALID_OBSERVATIONS' when 4 then 'INVALID_OBSERVATIONS'
         when 5 then 'UNKNOWN_AMOUNT_NOT_ZERO' when 6 then 'AMBIGUOUS_NUMERIC_FORMAT' when 7 then 'INVALID_OBSERVATIONS' end as error_code, count(*) as n
       from (select o_orderkey % 9 as k from orders) x group by 1, 2""",
)
def validate_money_observations_p9(spark, d):
    o, k = orders(spark, d), F.col("k") % 9
    text = F.col("o_totalprice").cast("decimal(18,2)").cast("string")
    rows = o.select(
        k.alias("k"),
        F.concat(F.lit("src_"), F.col("o_custkey").cast("string")).alias("source_id"),
        hex64(F.col("o_custkey")).alias("source_sha256"),
        F.lit(1).alias("sheet"),
        F.col("o_orderkey").alias("row"),
        F.col("o_orderkey").alias("row_end"),
        F.lit(3).alias("column"),
        F.lit("unit_rent").alias("kind"),
        F.when(k == 1, "charge").otherwise("unit").alias("measurement_basis"),
        F.when(k == 2, "formula_cache").otherwise("typed").alias("cell_origin"),
        F.when(k == 3, "weekly").otherwise("month").alias("period"),
        F.lit("USD").alias("currency"),
        F.when(k == 5, "n/a").when(k == 6, F.concat(F.substring(text, 1, 1), F.lit(",500"))).otherwise(F.concat(F.lit("$"), text)).alias("source_text"),
        F.when(k == 8, F.lit(None)).when(k == 7, F.concat(text, F.lit("0"))).otherwise(text).alias("decimal"),
    )
    rows = rows.withColumn("observation_id", F.when(F.col("k") == 4, "mny_0").otherwise(gov.money_citation_id()))
    return gov.validate_money_observations(rows).groupBy("k", "error_code").agg(F.count("*").alias("n"))


# ---------------------------------------------------------------- policy


@entry(
    "validate_policy_pack_p12",
    """select k, case k when 1 then 'UNKNOWN_ASSUMPTION_OR_UNIT' when 2 then 'INVALID_VALUE' when 3 then 'DUPLICATE_ASSUMPTION' when 4 then 'EVIDENCE_REQUIRED'
         when 5 then 'APPROVAL_REQUIRED' when 6 then 'INVALID_VERSION,DRAFT_WITH_APPROVAL' else '' end as issues, count(*) as n from (select o_orderkey % 8 as k from orders) x group by 1, 2""",
)
def validate_policy_pack_p12(spark, d):
    o, k = orders(spark, d), F.col("k") % 8
    text = F.col("o_totalprice").cast("decimal(18,2)").cast("string")

    def item(name, unit, value, cites):
        return F.struct(name.alias("name"), value.alias("value"), unit.alias("unit"), cites.alias("evidence"))

    price = item(F.lit("price_basis"), F.when(k == 1, "ratio").otherwise("currency"), F.when(k == 2, "-5").otherwise(text), F.when(k == 4, 0).otherwise(1))
    hold = item(F.lit("hold_months"), F.lit("months"), F.lit(None).cast("string"), F.lit(0))
    packs = o.select(
        k.alias("k"),
        F.when(k == 6, "1.0").otherwise("1.0.0").alias("version"),
        F.when(k == 5, "approved").otherwise("draft").alias("status"),
        F.when(k == 6, "a1").alias("approval_id"),
        F.when(k == 3, F.array(price, price, hold)).otherwise(F.array(price, hold)).alias("assumptions"),
    )
    return joined(policy.validate_policy_pack(packs)).groupBy("k", "issues").agg(F.count("*").alias("n"))


CLASS_SQL = """case k when 1 then 'UNCERTIFIED_CLASSIFICATION' when 2 then 'INVALID_CONTRACT' when 3 then 'INVALID_CONTRACT' when 4 then 'SUBJECT_MISMATCH'
    when 5 then 'INVALID_CONTRACT' when 6 then 'CLASSIFICATION_REVIEW_REQUIRED' when 7 then 'CLASSIFICATION_REVIEW_REQUIRED' when 8 then 'INVALID_CONTRACT' end"""


def classifications(spark, d):
    o, k = orders(spark, d), F.col("k") % 10
    subject = F.concat(F.lit("d"), F.col("o_custkey").cast("string"))
    evidence = F.struct(
        F.when(k == 4, "other").otherwise(subject).alias("subject_id"),
        F.when(k == 7, "broker_claim").otherwise("reviewed_evidence").alias("source_kind"),
    )
    empty = F.expr("cast(array() as array<string>)")
    return o.select(
        "o_orderkey",
        k.alias("k"),
        subject.alias("subject_id"),
        F.when(k == 2, "luxury").when(k != 5, "core").alias("deal_type"),
        F.array(F.lit("core")).alias("candidates"),
        F.when(k == 3, 1.5).when(k == 6, 0.5).otherwise(0.9).alias("confidence"),
        empty.alias("ambiguity"),
        empty.alias("conflicting_signals"),
        F.array(evidence).alias("evidence"),
        F.when(k == 8, "review_required").otherwise("evidence_reviewed").alias("state"),
        F.lit("r1").alias("review_id"),
        F.when(k == 1, "certified").otherwise(policy.UNCERTIFIED).alias("certification"),
        F.concat(F.lit("pol"), (F.col("o_orderkey") % 6).cast("string")).alias("policy_id"),
        F.lit("1.0.0").alias("policy_version"),
    )


@entry(
    "validate_classification_p13",
    f"select k, {CLASS_SQL} as error_code, count(*) as n from (select o_orderkey % 10 as k from orders) x group by 1, 2",
)
def validate_classification_p13(spark, d):
    out = policy.validate_classification(classifications(spark, d))
    return out.groupBy("k", "error_code").agg(F.count("*").alias("n"))


@entry(
    "require_approved_policy_p14",
    """select o_orderkey, case p when 1 then 'NOT_FOUND' else case when c <> 1 then 'SUBJECT_MISMATCH' when p = 2 then 'POLICY_VERSION_MISMATCH' when p = 3 then 'APPROVAL_REQUIRED'
         when o_orderkey % 10 = 8 then 'CLASSIFICATION_REVIEW_REQUIRED' end end as policy_error from (select o_orderkey, o_orderkey % 6 as p, o_custkey as c from orders) x""",
)
def require_approved_policy_p14(spark, d):
    p = F.col("o_orderkey") % 6
    packs = load(spark, d, "orders").filter(p != 1).select(p.alias("p")).distinct()
    packs = packs.select(
        F.concat(F.lit("pol"), F.col("p").cast("string")).alias("policy_id"),
        F.when(F.col("p") == 2, "2.0.0").otherwise("1.0.0").alias("version"),
        F.lit("d1").alias("subject_id"),
        F.when(F.col("p") == 3, "draft").otherwise("approved").alias("status"),
    )
    return policy.require_approved_policy(classifications(spark, d), packs).select("o_orderkey", "policy_error")


@entry(
    "approval_check_j12",
    """select o_orderkey, case k when 1 then 'APPROVAL_REQUIRED' when 2 then 'INVALID_CONTRACT' when 3 then 'APPROVAL_MISMATCH' when 4 then 'APPROVAL_REQUIRED' when 5 then 'APPROVAL_REQUIRED' end as error_code
       from (select o_orderkey, o_orderkey % 7 as k from orders) x""",
)
def approval_check_j12(spark, d):
    o, k = orders(spark, d), F.col("k") % 7
    sha, whole = hex64(F.col("o_orderkey")), hex64(F.col("o_orderkey") + 1)
    rows = o.select(
        "o_orderkey",
        F.col("o_orderkey").cast("string").alias("approval_id"),
        F.lit("ann").alias("actor_id"),
        F.when(k == 1, "model").otherwise("human").alias("actor_type"),
        F.when(k == 2, "2026-01-01T00:00:00").otherwise("2026-01-01T00:00:00Z").alias("approved_at"),
        F.when(k == 3, "x").otherwise(sha).alias("payload_sha256"),
        whole.alias("approval_sha256"),
        sha.alias("expected_sha256"),
    )
    registry = o.filter(k != 4).select(
        F.col("o_orderkey").cast("string").alias("approval_id"),
        F.when(k == 5, "bob").otherwise("ann").alias("actor_id"),
        sha.alias("payload_sha256"),
        whole.alias("approval_sha256"),
    )
    return policy.approval_check(rows, registry).select("o_orderkey", "error_code")


GATE_CODES = [
    None, "INVALID_INPUT", "SCOPE_MISMATCH", "UNSUPPORTED_TAX_REGIME", "POLICY_DRIFT", "T12_NOT_POLICY_EVIDENCE",
    "RATE_UNIT_INCONSISTENT", "RATE_UNIT_INCONSISTENT", "MILLAGE_MISSING", "INFERRED_BASIS_FORBIDDEN", "APPROVAL_REQUIRED",
]


def tax_policies(spark, d):
    o, k = orders(spark, d), F.col("k") % 11
    rate = F.struct(F.lit("County").alias("unit"), F.lit("0.5").alias("rate"))
    mills = F.struct(F.lit(" Mills ").alias("unit"), F.lit("0.5").alias("rate"))
    rows = o.select(
        "o_orderkey",
        k.alias("k"),
        F.col("o_orderkey").cast("string").alias("policy_id"),
        F.concat(F.lit("s"), F.col("o_custkey").cast("string")).alias("subject_id"),
        F.lit("P-1").alias("parcel_id"),
        F.when(k == 3, "NY").otherwise("TX").alias("state"),
        F.year("o_orderdate").alias("tax_year"),
        F.when(k == 1, "2026-02-30").otherwise("2026-01-01").alias("effective_date"),
        F.lit(True).alias("human_review"),
        F.lit("1").alias("assessment_ratio"),
        F.when(k == 8, " ").otherwise("21.5").alias("millage_rate_mills"),
        F.when(k == 5, "broker Trailing-Twelve").otherwise("county roll").alias("source"),
        F.lit("p. 4").alias("source_locator"),
        F.when(k == 6, "mills_per_1000_of_taxable_value").otherwise("dollars_per_100_of_taxable_value").alias("levy_unit"),
        F.lit(None).cast("string").alias("declared_unit"),
        F.when(k == 7, F.array(rate, mills)).otherwise(F.array(rate)).alias("taxing_units"),
        F.when(k == 9, "purchase_price").otherwise("just_value").alias("price_basis"),
        (k == 10).alias("analyst_override"),
        F.lit("APPROVAL_REQUIRED").alias("override_error"),
        hex64(F.col("o_orderkey")).alias("policy_sha256"),
        F.to_json(F.struct(F.col("o_custkey"), F.lit("TX").alias("state"))).alias("inputs"),
    )
    asked = o.select(
        F.col("o_orderkey").cast("string").alias("policy_id"),
        F.lit(None).cast("string").alias("want_subject"),
        F.when(k == 2, "P-2").alias("want_parcel"),
        F.lit(None).cast("int").alias("want_year"),
        F.when(k == 4, "0").otherwise(hex64(F.col("o_orderkey"))).alias("want_sha256"),
    )
    return policy.tax_policy_gates(rows, asked)


@entry(
    "tax_policy_gates_p15",
    "select o_orderkey, case o_orderkey % 11 " + " ".join(f"when {i} then '{c}'" for i, c in enumerate(GATE_CODES) if c) + " end as error_code from orders",
)
def tax_policy_gates_p15(spark, d):
    return tax_policies(spark, d).select("o_orderkey", "error_code")


@entry(
    "levy_unit_check_j11",
    "select k, case when k in (6, 7) or k = 3 then 'RATE_UNIT_INCONSISTENT' end as error_code, count(*) as n from (select o_orderkey % 11 as k from orders) x group by 1, 2",
)
def levy_unit_check_j11(spark, d):
    rows = tax_policies(spark, d).drop("error_code").withColumn("error_code", policy.levy_unit_check())
    return rows.groupBy("k", "error_code").agg(F.count("*").alias("n"))


@entry(
    "millage_t12_evidence_f37",
    "select doc_id, regexp_matches(text, 't12|trailing[ _-]?twelve', 'i') as names_t12 from documents",
)
def millage_t12_evidence_f37(spark, d):
    from rentloom.functions.text import millage_t12_evidence

    return load(spark, d, "documents").select("doc_id", millage_t12_evidence(F.col("text")).alias("names_t12"))


@entry(
    "validate_research_p16",
    """select s, case s when 1 then 'UNSUPPORTED_REGIME' when 2 then 'UNSUPPORTED_RULE_FAMILY' when 3 then 'UNCERTAINTY_BLOCK' end as error_code, count(*) as n from (select o_orderkey % 4 as s from orders) x group by 1, 2""",
)
def validate_research_p16(spark, d):
    o, s = orders(spark, d), F.col("k") % 4
    asked = o.select(
        s.alias("s"),
        F.when(s == 1, "NY").when(s == 2, "FL").otherwise("TX").alias("state"),
        F.when(s == 3, "circuit_breaker").otherwise("levy_per_100").alias("family"),
    )
    return policy.validate_research(asked).groupBy("s", "error_code").agg(F.count("*").alias("n"))


@entry(
    "bind_tax_schedule_x2",
    """select o_orderkey, y::int as tax_year, '{"levy":' || (o_custkey * 10 + (y - extract(year from o_orderdate))) || '}' as schedule
       from orders, range(1990, 2010) r(y) where o_orderkey % 11 = 0 and y between extract(year from o_orderdate) and extract(year from o_orderdate) + 2""",
)
def bind_tax_schedule_x2(spark, d):
    def schedule(pdf):
        import json

        given = pdf["inputs"].map(json.loads)
        levy = given.map(lambda x: x["o_custkey"] * 10 - x["base"]) + pdf["tax_year"]
        return levy.map(lambda v: f'{{"levy":{v}}}')

    rows = tax_policies(spark, d)
    inputs = F.to_json(F.struct(F.col("subject_id").substr(2, 20).cast("bigint").alias("o_custkey"), F.col("tax_year").alias("base")))
    out = policy.bind_tax_schedule(rows.withColumn("inputs", inputs), schedule, 3)
    return out.select(F.col("policy_id").cast("bigint").alias("o_orderkey"), "tax_year", "schedule")


# ---------------------------------------------------------------- intake eligibility


@entry(
    "resolve_rents_j9",
    f"""select o_orderkey, case when k % 6 not in (0, 1, 2, 3) then {m('o_totalprice', 'x')[:-5]} end as inplace_rent,
        case k % 6 when 0 then 'INPLACE_RENT_MISSING' when 1 then 'INPLACE_RENT_MISSING' when 2 then 'INVALID_INPUT' when 3 then 'INPLACE_RENT_MISSING' end as inplace_error,
        case when k % 6 not in (0, 2, 3) then {m('o_totalprice', 'x')[:-5]} end as market_rent from (select *, o_orderkey as k from orders) o""",
)
def resolve_rents_j9(spark, d):
    o, k = orders(spark, d), F.col("k") % 6
    obs_id = F.col("o_orderkey").cast("string")
    cohorts = o.select(
        "o_orderkey",
        F.when(k == 1, "gone").when(k != 0, obs_id).alias("inplace_observation_id"),
        F.when(k != 0, obs_id).alias("market_observation_id"),
    )
    obs = o.select(
        obs_id.alias("observation_id"),
        F.when(k == 2, "deposit").otherwise("unit_rent").alias("kind"),
        F.when(k != 3, F.col("o_totalprice").cast("decimal(18,2)")).alias("amount"),
    )
    out = policy.resolve_rents(cohorts, obs)
    return texts(out, "inplace_rent", "market_rent").select("o_orderkey", "inplace_rent", "inplace_error", "market_rent")


def intake(spark, d):
    o, k = orders(spark, d), F.col("k") % 12
    amount = F.col("o_totalprice").cast("decimal(18,2)")
    cohort = F.struct(
        F.lit("c1").alias("cohort_id"), F.when(k != 5, amount).alias("inplace_rent"), F.when(k != 6, amount).alias("market_rent")
    )
    omitted = lambda why: F.struct(F.lit("omitted").alias("status"), why.alias("explanation"), F.lit(None).cast("decimal(18,2)").alias("price"))
    present = F.struct(F.lit("present").alias("status"), F.lit(None).cast("string").alias("explanation"), amount.alias("price"))
    curve = F.array(F.lit("Rent"))
    deals = o.select(
        "o_orderkey",
        k.alias("k"),
        F.when(k == 2, "2026-12").when(k != 1, "2026-01").alias("window_start"),
        F.lit("2026-11").alias("window_end"),
        F.lit("r").alias("run_id"),
        F.when(k != 3, "ann").alias("analyst"),
        F.lit("p").alias("purpose"),
        F.when(k != 4, F.struct(F.lit(8).alias("occupied"), F.lit(1).alias("vacant"), F.when(k != 7, 1).alias("down"), F.lit(10).alias("total"))).alias("occupancy"),
        F.when(k == 7, 2).otherwise(0).alias("unknown_use_units"),
        F.lit(True).alias("has_accounting"),
        F.when(k != 8, F.struct(F.lit("21.5").alias("rate"))).alias("millage"),
        F.array(cohort, cohort).alias("cohorts"),
        F.when(k != 9, F.struct(curve.alias("loss_to_lease"), curve.alias("physical_vacancy"), curve.alias("collection_loss"))).alias("curves"),
        F.when(k == 10, omitted(F.lit(" "))).otherwise(omitted(F.lit("none leased"))).alias("commercial_income"),
        F.when(k == 11, present).otherwise(omitted(F.lit("none"))).alias("other_income"),
    )
    return policy.intake_blockers(deals)


@entry(
    "intake_blockers_p17",
    """select k, case k when 1 then 'ANALYSIS_WINDOW_INCOMPLETE' when 2 then 'ANALYSIS_WINDOW_INCOMPLETE' when 3 then 'MISSING_INPUT' when 4 then 'MISSING_INPUT'
         when 5 then 'INPLACE_RENT_MISSING,INPLACE_RENT_MISSING' when 6 then 'MARKET_RENT_MISSING,MARKET_RENT_MISSING' when 7 then 'OCCUPANCY_COUNTS_INCOMPLETE,UNRESOLVED_UNIT_USE'
         when 8 then 'MILLAGE_MISSING' when 9 then 'MISSING_INPUT,MISSING_INPUT,MISSING_INPUT' when 10 then 'COMMERCIAL_INCOME_OMISSION_UNEXPLAINED' when 11 then 'MISSING_INPUT' else '' end as codes, count(*) as n
       from (select o_orderkey % 12 as k from orders) x group by 1, 2""",
)
def intake_blockers_p17(spark, d):
    out = intake(spark, d).groupBy("k", F.array_join(F.transform("blockers", lambda b: b["code"]), ",").alias("codes"))
    return out.agg(F.count("*").alias("n"))


@entry(
    "eligible_only_p18",
    """select o_orderkey, case when o_orderkey % 12 = 0 then 'eligible' else 'blocked' end as status,
        case when o_orderkey % 12 = 0 then sha256('{"o_orderkey":' || o_orderkey || ',"run_id":"r","window_end":"2026-11","window_start":"2026-01"}') end as canonical_sha256 from orders""",
)
def eligible_only_p18(spark, d):
    out = policy.eligible_only(intake(spark, d), ["o_orderkey", "run_id", "window_start", "window_end"])
    return out.select("o_orderkey", "status", "canonical_sha256")


# ---------------------------------------------------------------- manifest, acceptance, readiness

view(
    "v_entries",
    """
    select 'e' || cast(o_orderkey as string) as entry_id, o_orderkey as k, 'run' || cast(o_custkey % 9 as string) as run_id,
           cast(o_custkey as string) as sha, 'path' || cast(o_orderkey % 4001 as string) as path,
           case when o_orderkey % 13 = 0 then cast(null as string) else 's' || cast(o_custkey % 40 as string) end as subject_id,
           substr(cast(o_orderdate as string), 1, 10) as as_of, case when o_orderkey % 10 = 7 then 'excluded' else 'run' end as selection
    from orders""",
)


@entry(
    "duplicate_sources_j14",
    """select entry_id, same_sha > 1 or same_path > 1 as duplicate_source,
         coalesce((select count(*) from r o where o.subject_id = r.subject_id and o.as_of = r.as_of and o.sha <> r.sha and o.path <> r.path), 0) > 0 as ambiguous_snapshot
       from (select *, count(*) over (partition by sha) as same_sha, count(*) over (partition by path) as same_path from v_entries where selection = 'run') r""".replace(
        "from r o", "from (select * from v_entries where selection = 'run') o"
    ),
)
def duplicate_sources_j14(spark, d):
    e = load(spark, d, "v_entries").withColumnRenamed("sha", "source_sha256")
    return gov.duplicate_sources(e).select("entry_id", "duplicate_source", "ambiguous_snapshot")


@entry(
    "validate_manifest_p20",
    """select s, issues, count(*) as n from (select o_orderkey % 8 as s, case o_orderkey % 8 when 1 then 'PORTFOLIO_NOT_COMPARISON' when 2 then 'DECISIONS_REQUIRED' when 3 then 'DECISIONS_WITHOUT_RECONCILE'
         when 4 then 'EXCLUSION_REQUIRED' when 5 then 'DUPLICATE_DIFFERS' when 6 then 'DUPLICATE_TARGET,DUPLICATE_DIFFERS' else '' end as issues from orders) x group by 1, 2""",
)
def validate_manifest_p20(spark, d):
    o, s = orders(spark, d), F.col("k") % 8
    entry_id = F.concat(F.lit("e"), F.col("k").cast("string"))
    back = F.when(s == 5, F.col("k") - 5).when(s == 6, F.col("k") - 1).when(s == 7, F.col("k") - 7)
    entries = o.select(
        s.alias("s"),
        entry_id.alias("entry_id"),
        hex64(F.when(s == 5, F.lit(-1)).otherwise(F.floor(F.col("k") / 8))).alias("source_sha256"),
        F.lit("snap").alias("snapshot_id"),
        F.lit("subject").alias("subject_id"),
        F.lit("2026-01-01").alias("as_of"),
        F.when(s == 1, "portfolio").otherwise("property").alias("entity_kind"),
        F.lit("inventory").alias("corpus_use"),
        F.when(s == 2, "reconcile").otherwise("observe").alias("requested_stage"),
        F.when(s == 3, hex64(F.lit(1))).alias("decisions_sha256"),
        F.when(s == 4, "excluded").when(s.isin(5, 6, 7), "declared_duplicate").otherwise("run").alias("selection"),
        F.lit(None).cast("string").alias("exclusion_code"),
        F.concat(F.lit("e"), back.cast("string")).alias("duplicate_of"),
    )
    return joined(gov.validate_manifest(entries)).groupBy("s", "issues").agg(F.count("*").alias("n"))


@entry(
    "acceptance_totals_a22",
    """select run_id, declared, selected, reconciled, distinct_selected_properties, distinct_reconciled_properties, case when refused > 0 then 'blocked' when reconciled = selected and distinct_reconciled_properties > 0 then 'reconciled_selected' else 'observed_unvalidated' end as assessment from (
       select run_id, count(*) as declared, count(*) filter (where selection = 'run') as selected, count(*) filter (where selection = 'run' and k % 97 <> 5 and k % 5 <> 0) as reconciled,
         count(*) filter (where selection = 'run' and k % 97 = 5) as refused from v_entries group by 1) a
       join (select run_id, count(*) as distinct_selected_properties, count(*) filter (where f) as distinct_reconciled_properties from (
         select run_id, subject_id, bool_and(k % 97 <> 5 and k % 5 <> 0) as f from v_entries where selection = 'run' and subject_id is not null and k % 3 <> 0 group by 1, 2) x group by 1) b using (run_id)""",
)
def acceptance_totals_a22(spark, d):
    e, k = load(spark, d, "v_entries"), F.col("k")
    run = F.col("selection") == "run"
    rows = e.select(
        "run_id",
        "subject_id",
        "selection",
        F.when(~run, "excluded").when(k % 97 == 5, "refused").when(k % 5 == 0, "observed_unvalidated").otherwise("reconciled").alias("state"),
        run.alias("parser_started"),
        F.lit("property").alias("entity_kind"),
        F.lit("inventory").alias("corpus_use"),
        (k % 3 == 0).alias("duplicate_source"),
    )
    keep = ["run_id", "declared", "selected", "reconciled", "distinct_selected_properties", "distinct_reconciled_properties", "assessment"]
    return gov.acceptance_totals(rows, ["run_id"]).select(*keep)


@entry(
    "compat_totals_a23",
    """select c_nationkey, count(*) filter (where c_custkey % 2 = 0) as readers, count(*) as coverage_declared, count(*) filter (where c_custkey % 3 = 0) as coverage_accounted,
        case when c_nationkey % 5 = 2 then 'TOTALS_MISMATCH' end as error_code from customer group by 1""",
)
def compat_totals_a23(spark, d):
    c, k = load(spark, d, "customer"), F.col("c_custkey")
    readers = c.filter(k % 2 == 0).select(
        "c_nationkey", F.when(k % 4 == 0, "synthetic_only").otherwise("real_export_verified").alias("source_test_status")
    )
    coverage = c.select("c_nationkey", (k % 3 == 0).alias("accounted"), F.when(k % 7 == 0, "acquisition_gap").otherwise("ok").alias("status"))
    published = c.groupBy("c_nationkey").agg(
        F.count_if(k % 2 == 0).alias("readers"),
        F.count_if(k % 4 == 0).alias("synthetic_only"),
        F.count_if(k % 4 == 2).alias("real_export_verified"),
        (F.count("*") + F.when(F.col("c_nationkey") % 5 == 2, 1).otherwise(0)).alias("coverage_declared"),
        F.count_if(k % 3 == 0).alias("coverage_accounted"),
        F.count_if(k % 7 == 0).alias("acquisition_gaps"),
    )
    out = gov.compat_totals(readers, coverage, published, "c_nationkey")
    return out.select("c_nationkey", "readers", "coverage_declared", "coverage_accounted", "error_code")


@entry(
    "validate_readiness_p21",
    """select subject, case s when 1 then 'GATE_MISSING' when 2 then 'LITERAL_BOOLEAN_REQUIRED' when 3 then 'SUBJECT_MISMATCH' when 4 then 'DUPLICATE_SUBJECT' else '' end as issues from (select c_custkey as subject, c_custkey % 6 as s from customer) x""",
)
def validate_readiness_p21(spark, d):
    c = load(spark, d, "customer").select(F.col("c_custkey").alias("subject"), (F.col("c_custkey") % 6).alias("s"))
    gates = F.array(*[F.lit(g) for g in gov.GATES])
    listed = F.when(F.col("s") == 1, F.slice(gates, 1, 7)).when(F.col("s") == 4, F.concat(gates, F.array(F.lit(gov.GATES[0])))).otherwise(gates)
    long = c.select("subject", "s", F.explode(listed).alias("gate"))
    long = long.withColumn("value", F.when((F.col("s") == 2) & (F.col("gate") == "certification"), "1").otherwise("true"))
    assets = c.select("subject", F.concat(F.lit("a"), F.col("subject").cast("string")).alias("asset_id"))
    package = c.select("subject", F.concat(F.when(F.col("s") == 3, "b").otherwise("a"), F.col("subject").cast("string")).alias("asset_id"))
    return joined(gov.validate_readiness(long.drop("s"), assets, package))


@entry("stray_gates_j20", "select c_custkey as subject from customer where c_custkey not in (select o_custkey from orders where o_orderdate >= timestamp '2001-01-01')")
def stray_gates_j20(spark, d):
    deals = load(spark, d, "orders").filter("o_orderdate >= '2001-01-01'").select(F.col("o_custkey").alias("subject"))
    return gov.stray_gates(deals, load(spark, d, "customer").select(F.col("c_custkey").alias("subject")))


@entry(
    "readiness_state_a27",
    """select o_custkey as subject, case when bool_or(k = 0) then 'CONFLICTING' when bool_or(k = 1) then 'STALE' when bool_or(k = 2) then 'MISSING' else 'VERIFIED' end as integrity,
        count(*) filter (where k in (0, 1, 2)) as problems from (select o_custkey, o_orderkey % 40 as k from orders) x group by 1""",
)
def readiness_state_a27(spark, d):
    k = F.col("k") % 40
    state = F.when(k == 0, "CONFLICTING").when(k == 1, "STALE").when(k == 2, "MISSING").otherwise("VERIFIED")
    return gov.readiness_state(orders(spark, d).select(F.col("o_custkey").alias("subject"), state.alias("state")))


@entry(
    "next_actions_a27",
    """select case k when 0 then 'MISSING_MILLAGE' when 1 then 'AMBIGUOUS_FLOORPLAN' else 'OTHER' end as code, case k when 0 then 'source_evidence_then_human' when 1 then 'source_evidence' else 'unclassified_blocker' end as action_kind, count(*) as n
       from (select o_orderkey % 3 as k from orders) x group by 1, 2""",
)
def next_actions_a27(spark, d):
    k = F.col("k") % 3
    b = orders(spark, d).select(F.when(k == 0, "MISSING_MILLAGE").when(k == 1, "AMBIGUOUS_FLOORPLAN").otherwise("OTHER").alias("code"))
    return gov.next_actions(b).groupBy("code", "action_kind").agg(F.count("*").alias("n"))


@entry(
    "register_diff_j15",
    """select o_orderkey as decision_id, case k when 0 then 'REMOVED' when 1 then 'ADDED' when 2 then 'CHANGED' when 3 then 'CHANGED' when 6 then 'CHANGED' when 7 then 'UNCHANGED' when 8 then 'UNCHANGED' end as change,
        case k when 2 then '/value' when 3 then '/list,/note' when 6 then '/nested' when 7 then '' when 8 then '' end as pointers, case k when 4 then 'SCOPE_MISMATCH' when 5 then 'PERIOD_MISMATCH' end as error_code
       from (select o_orderkey, o_orderkey % 9 as k from orders) x""",
)
def register_diff_j15(spark, d):
    o, k = orders(spark, d), F.col("k") % 9

    def side(new: bool):
        n = lambda v: F.when(F.lit(new) & (k == v), F.lit(1)).otherwise(F.lit(0)) == 1
        record = F.concat(
            F.lit('{"value":'),
            F.when(n(2), F.lit("2")).otherwise(F.lit("1")),
            F.lit(',"list":['),
            F.when(n(3), F.lit("1,3")).otherwise(F.lit("1,2")),
            F.lit("]"),
            F.when(n(3), F.lit(',"note":null')).otherwise(F.lit("")),
            F.lit(',"nested":'),
            F.when(n(6), F.lit("7")).otherwise(F.lit('{"a":{"b":1}}')),
            F.lit("}"),
        )
        return o.filter(k != (0 if new else 1)).select(
            F.col("o_orderkey").alias("decision_id"),
            F.lit("s").alias("subject"),
            F.lit("a").alias("asset_id"),
            F.when(n(4), "rent").otherwise("tax").alias("field"),
            F.when(n(5), 2027).otherwise(2026).alias("tax_year"),
            F.lit("2026-01").alias("period"),
            F.lit(None).cast("string").alias("units"),
            record.alias("record"),
        )

    return gov.register_diff(side(False), side(True)).withColumn("pointers", F.array_join("pointers", ","))


# ---------------------------------------------------------------- reconciliation and decisions

view(
    "v_recon",
    """
    select l_orderkey as deal_id, case l_linenumber when 1 then 'gross_potential_rent' when 2 then 'insurance' when 3 then 'real_estate_taxes' when 4 then 'payroll' else 'noi' end as bucket,
           case l_partkey % 3 when 0 then 'actual' when 1 then 'broker' else 'house' end as side,
           case when l_suppkey % 7 <> 3 then cast(l_extendedprice as decimal(18,2)) end as amount
    from lineitem""",
)
# A side of a bucket with any missing amount has no sum.
view(
    "v_recon_cells",
    "select deal_id, bucket, side, case when count(*) = count(amount) then sum(amount) end as amount from v_recon group by 1, 2, 3",
)


@entry(
    "reconcile_sources_c3",
    f"""select deal_id, bucket, {m("actual", 'actual')}, {m("broker", 'broker')}, {m("house", 'house')}, {m("broker - actual", 'broker_vs_actual')}, {m("house - actual", 'house_vs_actual')} from (
        select deal_id, bucket, sum(amount) filter (where side = 'actual') as actual, sum(amount) filter (where side = 'broker') as broker, sum(amount) filter (where side = 'house') as house from v_recon_cells group by 1, 2) x""",
)
def reconcile_sources_c3(spark, d):
    out = gov.reconcile_sources(load(spark, d, "v_recon"))
    return texts(out, "actual", "broker", "house", "broker_vs_actual", "house_vs_actual")


@entry(
    "reconciliation_coverage_a25",
    """select deal_id, 6 - count(amount) filter (where bucket in ('gross_potential_rent', 'insurance')) as missing,
        case when count(amount) filter (where bucket in ('gross_potential_rent', 'insurance')) < 6 then 'REFUSED' else 'SYNTHETIC_SCOPED_PASS' end as review_status from v_recon_cells group by 1""",
)
def reconciliation_coverage_a25(spark, d):
    wide = gov.reconcile_sources(load(spark, d, "v_recon"))
    out = gov.reconciliation_coverage(wide, ["gross_potential_rent", "insurance"])
    return out.select("deal_id", F.size("missing_cells").cast("bigint").alias("missing"), "review_status")


@entry(
    "missing_cells_u9",
    """select d.deal_id, b.bucket || '/' || s.side as cell from (select distinct deal_id from v_recon) d, (values ('insurance'), ('payroll')) b(bucket), (values ('actual'), ('broker'), ('house')) s(side)
       where not exists (select 1 from v_recon_cells r where r.deal_id = d.deal_id and r.bucket = b.bucket and r.side = s.side and r.amount is not null)""",
)
def missing_cells_u9(spark, d):
    wide = gov.reconcile_sources(load(spark, d, "v_recon"))
    out = gov.reconciliation_coverage(wide, ["insurance", "payroll"])
    return out.select("deal_id", F.explode("missing_cells").alias("cell"))


view(
    "v_chain",
    """
    select chain, seq, k, sha, lag(sha) over (partition by chain order by seq) as head, lag(k) over (partition by chain order by seq) as before_k from (
      select 'c' || cast(o_custkey % 50 as string) as chain, o_orderkey as k, cast(row_number() over (partition by o_custkey % 50 order by o_orderkey) as int) as seq, 'h' || cast(o_orderkey as string) as sha from orders) x""",
)


def chain(spark, d):
    c, k = load(spark, d, "v_chain"), F.col("k")
    none = F.expr("cast(array() as array<string>)")
    cells = F.array(F.concat(F.lit("u"), (k % 3).cast("string")))
    return c.select(
        "chain",
        "seq",
        "k",
        F.concat(F.lit("d"), k.cast("string")).alias("decision_id"),
        F.col("sha").alias("sha256"),
        F.when(k % 101 == 7, "wrong").otherwise(F.col("head")).alias("predecessor_sha256"),
        F.when(F.col("before_k").isNotNull() & (k % 4 == 1), F.array(F.concat(F.lit("h"), F.col("before_k").cast("string")))).otherwise(none).alias("supersedes"),
        cells.alias("cells"),
    )


@entry(
    "check_hash_chain_w18",
    """select chain, seq, case when k % 101 = 7 then 'BROKEN_CHAIN' when k % 4 = 1 and before_k is not null and before_k % 3 <> k % 3 then 'SUPERSEDES_OTHER_CELLS' end as error_code,
        coalesce(lead(k) over (partition by chain order by seq) % 4 = 1, false) as superseded from v_chain""",
)
def check_hash_chain_w18(spark, d):
    c = chain(spark, d).drop("k")
    replay = c.withColumn("seq", F.col("seq") + 1000000).filter("seq % 5 = 0")
    out = gov.check_hash_chain(c.unionByName(replay), stage=cut_lineage)
    return out.select("chain", "seq", "error_code", "superseded")


@entry(
    "active_decisions_w19",
    """select chain, 'u' || (k % 3) as unit_id, count(*) as proposals, case when min(k % 7) = max(k % 7) then 'v' || min(k % 7) end as after, case when min(k % 7) <> max(k % 7) then 'DECISION_CONFLICT' end as error_code from (
         select *, case when k % 101 = 7 or (k % 4 = 1 and before_k is not null and before_k % 3 <> k % 3) then 1 end as bad, coalesce(lead(k) over (partition by chain order by seq) % 4 = 1, false) as superseded from v_chain) x
       where bad is null and not superseded group by 1, 2""",
)
def active_decisions_w19(spark, d):
    c = chain(spark, d)
    changes = c.select(
        "chain",
        "sha256",
        F.get("cells", F.lit(0)).alias("unit_id"),
        F.lit("status").alias("field"),
        F.concat(F.lit("v"), (F.col("k") % 7).cast("string")).alias("after"),
    )
    return gov.active_decisions(changes, gov.check_hash_chain(c.drop("k"), stage=cut_lineage)).drop("field")


@entry(
    "open_requests_f44",
    """select source_id, open_requests, decision_conflicts, case when open_requests = 0 then total end as total, case when open_requests = 0 then 'reconciled' else 'review_required' end as state from (
         select source_id, sum(case when unit_use is null and n % 2 = 0 then 1 else 0 end + case when n % 97 = 3 then 2 else 0 end + case when n % 89 = 4 then 1 else 0 end)::bigint as open_requests,
                count(*) filter (where n % 97 = 3) as decision_conflicts, count(*) as total from (select *, cast(unit_id as int) as n from v_units) u group by 1) x""",
)
def open_requests_f44(spark, d):
    u, n = load(spark, d, "v_units"), F.col("unit_id").cast("int")
    key = ["source_id", "unit_id"]
    uses = u.filter(F.col("unit_use").isNull() & (n % 2 == 1)).select(
        *key, F.lit("unit_use").alias("field"), F.lit("residential").alias("after"), F.lit(None).cast("string").alias("error_code")
    )
    fights = u.filter(n % 97 == 3).select(
        *key, F.lit("status").alias("field"), F.lit(None).cast("string").alias("after"), F.lit("DECISION_CONFLICT").alias("error_code")
    )
    odd = u.filter(n % 89 == 4).select(*key, F.lit("INCONSISTENT_UNIT").alias("error_code"))
    out = gov.open_requests(u.select(*key, "status", "unit_use"), uses.unionByName(fights), odd)
    return out.select("source_id", "open_requests", "decision_conflicts", "total", "state")


# ---------------------------------------------------------------- workflow

STAGES = "created,stage:normalized,stage:review_required,review,stage:reconciled,stage:canonical_ready,execution_authorized,stage:engine_executed,stage:report_ready".split(",")


def journal(spark, d):
    """Nine workflow steps per order; some runs stop early, jump a stage, repeat a decision or change their mind."""
    o, k = orders(spark, d), F.col("k")
    steps = F.array(*[F.lit(s) for s in STAGES])
    upto = F.slice(steps, 1, (k % 9 + 1).cast("int"))
    e = o.select(F.col("k").alias("run_id"), "k", F.posexplode(upto).alias("pos", "step"))
    again = o.filter((k % 9 == 3) & (k % 2 == 0)).select(F.col("k").alias("run_id"), "k", F.lit(9).alias("pos"), F.lit("review").alias("step"))
    e = e.unionByName(again).withColumn("n", F.col("pos") + 1)
    kind = F.split("step", ":")
    stage = F.get(kind, F.lit(1))
    jump = (k % 23 == 5) & (F.col("step") == "stage:normalized")
    return e.select(
        "run_id",
        "n",
        F.get(kind, F.lit(0)).alias("kind"),
        F.when(jump, "engine_executed").otherwise(stage).alias("stage"),
        F.when(F.col("step") == "review", F.when(k % 4 == 0, F.lit("d")).otherwise(F.concat(F.lit("d"), F.col("n").cast("string")))).alias("decision_id"),
        F.when(F.col("step") == "review", "millage").alias("field"),
        F.when(F.col("step") == "review", F.when(k % 3 == 0, F.lit("21.5")).otherwise(F.concat(F.lit("2"), F.col("n").cast("string")))).alias("value"),
    )


WORKFLOW_SQL = """select k as run_id, len + case when twice then 1 else 0 end as event_count, err as error_code,
    case when coalesce(err, '') <> 'CORRUPT_INPUT' then case len when 1 then 'inspected' when 2 then 'normalized' when 3 then 'review_required' when 4 then 'review_required' when 5 then 'reconciled'
      when 6 then 'canonical_ready' when 7 then 'execution_authorized' when 8 then 'engine_executed' else 'report_ready' end end as stage
    from (select *, case when (k % 23 = 5 and len >= 2) or (twice and k % 4 = 0) then 'CORRUPT_INPUT' when twice and k % 3 <> 0 then 'CONFLICT_UNRESOLVED' end as err
          from (select o_orderkey as k, o_orderkey % 9 + 1 as len, o_orderkey % 9 = 3 and o_orderkey % 2 = 0 as twice from orders) a) x"""


@entry("workflow_state_w20", WORKFLOW_SQL)
def workflow_state_w20(spark, d):
    return gov.workflow_state(journal(spark, d)).drop("resolutions")


@entry(
    "workflow_blockers_f42",
    """select k, case k when 1 then 'needs_review_or_data' when 2 then 'needs_review_or_data' when 3 then 'unsupported_input' when 4 then 'needs_review_or_data' when 5 then 'execution_error' else 'complete' end as outcome,
        case k when 1 then 'rr:corrupt_input' when 2 then 'debt:pending_human_action' when 3 then 't12:unsupported_engineering' when 4 then 'horizon:pending_human_action' else '' end as blockers, count(*) as n from (select o_orderkey % 7 as k from orders) x group by 1, 2, 3""",
)
def workflow_blockers_f42(spark, d):
    o, k = orders(spark, d), F.col("k") % 7

    def pinned(name):
        fmt = F.when((k == 3) & F.lit(name == "t12"), "docx").otherwise("pdf")
        return F.struct(F.lit(name).alias("name"), fmt.alias("format"), (~((k == 1) & F.lit(name == "rr"))).alias("intact"))

    inputs = F.filter(F.array(*[pinned(n) for n in gov.REQUIRED_INPUTS]), lambda i: ~((i["name"] == "debt") & (k == 2)))
    runs = o.select(
        k.alias("k"),
        inputs.alias("inputs"),
        F.array(F.lit("millage")).alias("value_names"),
        F.when(k == 4, F.expr("cast(array() as array<string>)")).otherwise(F.array(F.lit("horizon"))).alias("resolved_names"),
        (k == 5).alias("execution_error"),
    )
    out = gov.workflow_blockers(runs)
    text = F.array_join(F.transform("blockers", lambda b: F.concat_ws(":", b["field"], b["kind"])), ",")
    return out.groupBy("k", "outcome", text.alias("blockers")).agg(F.count("*").alias("n"))


# Runs of twelve kinds over the same eleven steps: 1 leaves an input out when it pins again, 2 pins another hash, 3 approves
# other content, 4 approves other inputs, 5 ends in an engine error, 6 has a gap, 7 uses a decision twice, 8 repeats an
# event, 9 delivers one number with two contents, 10 resolves a foreign field unless the review is cancelled, 11 has no beginning.
view("v_runs", "select o_orderkey as k, o_orderkey % 12 as c, o_orderkey % 3 = 0 as cancelled from orders")
view(
    "v_run_truth",
    """
    select *, case when bad then null when c = 5 then 'execution_authorized' when c = 6 then 'review_required' else 'report_ready' end as stage,
           case c when 6 then 6 when 11 then 0 when 5 then 10 else 11 end as event_count, case c when 6 then 4 when 11 then 10 else 0 end as waiting,
           case when not bad then c <> 6 end as approved, case when bad then null when c = 1 then 3 else 4 end as inputs,
           case when bad then null when cancelled then 'd1' else 'd2' end as millage_by, case when not bad and not cancelled then 'd2' end as horizon_by,
           case when bad then 'CORRUPT_INPUT' end as error_code
    from (select *, c in (2, 3, 4, 7, 9, 11) or (c = 10 and not cancelled) as bad from v_runs) r""",
)
RECORDS_SQL = """select stage, event_count, waiting, approved, inputs, millage_by, horizon_by, error_code, count(*) as runs, sum(k)::bigint as ids
    from v_run_truth group by 1, 2, 3, 4, 5, 6, 7, 8"""


def run_journal(spark, d):
    r, c = load(spark, d, "v_runs"), F.col("c")
    names = gov.REQUIRED_INPUTS

    def pins(but=None, other=None):
        """Name → hash of a run's inputs, without ``but`` in runs of kind 1, another hash for ``other`` (name, kind)."""
        sha = {n: F.concat(F.lit(n), F.col("k").cast("string")) for n in names}
        if other is not None:
            sha[other[0]] = F.when(c == other[1], "other").otherwise(sha[other[0]])
        whole = F.create_map(*[x for n in names for x in (F.lit(n), sha[n])])
        return F.when(c == 1, F.map_filter(whole, lambda n, _: n != but)).otherwise(whole) if but else whole

    def text(value):
        return F.lit(value).cast("string") if not hasattr(value, "alias") else value

    def step(n, kind, **columns):
        none = "cast(null as map<string,string>)"
        out = {"n": F.lit(n).cast("bigint"), "kind": F.lit(kind)}
        for name in ("stage", "content_sha256", "decision_id", "decision_status"):
            out[name] = text(columns.get(name))
        for name in ("inputs", "values", "resolutions"):
            out[name] = columns[name] if name in columns else F.expr(none)
        return F.struct(*[v.alias(k) for k, v in out.items()])

    content = F.concat(F.lit("c"), (F.col("k") % 5).cast("string"))
    unset = F.create_map(F.lit("millage"), F.lit(None).cast("string"))
    second = F.create_map(F.lit("millage"), F.lit("2"), F.when(c == 10, "rent").otherwise("horizon"), F.lit("9"))
    steps = [
        step(1, "created", content_sha256=content, inputs=pins(), values=unset),
        step(2, "stage", stage="normalized"),
        step(3, "stage", stage="review_required"),
        step(4, "review", decision_id="d1", decision_status="approved", resolutions=F.create_map(F.lit("millage"), F.lit("1"))),
        step(5, "review", decision_id=F.when(c == 7, "d1").otherwise("d2"), decision_status=F.when(F.col("cancelled"), "cancelled").otherwise("approved"), resolutions=second),
        step(6, "inputs_repinned", inputs=pins("debt", ("om", 2))),
        step(7, "stage", stage="reconciled"),
        step(8, "stage", stage="canonical_ready"),
        step(9, "execution_authorized", content_sha256=F.when(c == 3, "x").otherwise(content), inputs=pins("debt", ("rr", 4))),
        F.when(c == 5, step(10, "engine_error")).otherwise(step(10, "stage", stage="engine_executed")),
        step(11, "stage", stage="report_ready"),
    ]
    again = F.when(c == 8, F.array(steps[4])).when(
        c == 9, F.array(step(4, "review", decision_id="d1", decision_status="approved", resolutions=F.create_map(F.lit("millage"), F.lit("7"))))
    )
    told = F.concat(F.array(*steps), F.coalesce(again, F.expr("array()").cast(f"array<{r.select(steps[1].alias('s')).schema['s'].dataType.simpleString()}>")))
    gone = ((c == 6) & (F.col("e.n") == 7)) | ((c == 11) & (F.col("e.n") == 1)) | ((c == 5) & (F.col("e.n") == 11))
    e = r.select("k", "c", F.explode(told).alias("e")).filter(~gone)
    names_of = [f.split()[0].strip("`") for f in workflow.EVENTS.replace("map<string,string>", "map").split(", ")]
    return e.select(F.col("k").cast("string").alias("run_id"), *(F.col(f"e.{n}").alias(n) for n in names_of[1:]))


def record_counts(records):
    by = {f"{f}_by": F.col("resolved_by")[f] for f in gov.REQUIRED_VALUES}
    out = records.withColumns({"inputs": F.when(F.col("inputs").isNotNull(), F.size("inputs"))} | by)
    out = out.groupBy("stage", "event_count", "waiting", "approved", "inputs", "millage_by", "horizon_by", "error_code")
    return out.agg(F.count("*").alias("runs"), F.sum(F.col("run_id").cast("bigint")).alias("ids"))


@entry("run_records_w20", RECORDS_SQL)
def run_records_w20(spark, d):
    return record_counts(workflow.run_records(run_journal(spark, d)))


@entry(
    "run_blockers_f42",
    """
    select error_code, outcome, blockers, count(*) as runs, sum(k)::bigint as ids from (
      select k, coalesce(error_code, case when approved and k % 7 = 2 then 'STALE' end) as error_code,
        case when error_code is null and not (approved and k % 7 = 2) then
          case when c = 5 then 'execution_error' when k % 7 = 3 then 'unsupported_input' when k % 7 = 2 or c = 1 or cancelled then 'needs_review_or_data' else 'complete' end end as outcome,
        case when error_code is null and not (approved and k % 7 = 2) then
          case when k % 7 = 2 then 'om:corrupt_input:,' else '' end || case when k % 7 = 3 then 't12:unsupported_engineering:,' else '' end ||
          case when c = 1 then 'debt:pending_human_action:,' else '' end || 'millage:pending_human_action:' || millage_by || ',horizon:pending_human_action:' || coalesce(horizon_by, '') end as blockers
      from v_run_truth) x group by 1, 2, 3""",
)
def run_blockers_f42(spark, d):
    k = F.col("k")
    live = load(spark, d, "v_runs").select("k", F.explode(gov._literals(gov.REQUIRED_INPUTS)).alias("name"))
    name = F.col("name")
    sha = F.when((k % 7 == 2) & (name == "om"), "changed").otherwise(F.concat(name, k.cast("string")))
    kind = F.when((k % 7 == 3) & (name == "t12"), "docx").otherwise("pdf")
    live = live.select(k.cast("string").alias("run_id"), "name", sha.alias("sha256"), kind.alias("format"))
    out = workflow.run_blockers(workflow.run_records(run_journal(spark, d)), live, cut_lineage)
    text = F.array_join(F.transform("blockers", lambda b: F.concat(b["field"], F.lit(":"), b["kind"], F.lit(":"), F.coalesce(b["resolved_by"], F.lit("")))), ",")
    out = out.groupBy("error_code", "outcome", text.alias("blockers"))
    return out.agg(F.count("*").alias("runs"), F.sum(F.col("run_id").cast("bigint")).alias("ids"))


# ---------------------------------------------------------------- migration


def envelopes(spark, d):
    li = load(spark, d, "lineitem")
    n = F.col("l_linenumber")
    unit = F.struct(
        F.concat(F.lit("A"), F.col("l_suppkey").cast("string")).alias("unit_id"),
        F.when(F.col("l_returnflag") == "A", "vacant").otherwise("occupied").alias("status"),
        F.when(n % 3 == 0, "commercial").when(n % 3 == 1, "residential").alias("unit_type"),
        F.lit(1).alias("sheet"),
        (n + F.lit(4)).alias("row"),
        F.lit(2).alias("column"),
        F.col("l_partkey").alias("tie"),
    )
    rows = li.groupBy(F.col("l_orderkey").cast("string").alias("source_id")).agg(F.sort_array(F.collect_list(unit)).alias("u"))
    pick = lambda cond: F.filter("u", cond)
    counts = lambda c: F.struct(*[c.cast("int").alias(x) for x in ("occupied", "vacant", "down", "total")])
    return rows.select(
        "source_id",
        F.sha2("source_id", 256).alias("source_sha256"),
        pick(lambda x: x["unit_type"] == "residential").alias("residential_units"),
        pick(lambda x: x["unit_type"] == "commercial").alias("commercial_units"),
        pick(lambda x: x["unit_type"].isNull()).alias("unresolved_units"),
        counts(F.lit(1)).alias("residential_counts"),
        counts(F.lit(None)).alias("commercial_counts"),
        F.when(F.size(pick(lambda x: x["unit_type"].isNull())) > 0, "blocked").otherwise("normalized_unvalidated").alias("status"),
    )


@entry(
    "migrate_observations_f41",
    """select l_orderkey as source_id, count(*) filter (where l_linenumber % 3 <> 2) as units, count(*) filter (where l_linenumber % 3 = 2) as unknown_use_units,
        case when count(*) filter (where l_linenumber % 3 = 2) > 0 then 'blocked' else 'observed_unvalidated' end as status,
        min('unit_' || sha256('{"column":2,"row":' || (l_linenumber + 4) || ',"row_end":' || (l_linenumber + 4) || ',"sheet":1,"source_id":"' || l_orderkey || '","source_sha256":"' || sha256(cast(l_orderkey as varchar)) || '"}')) filter (where l_linenumber % 3 <> 2) as first_id
       from lineitem group by 1""",
)
def migrate_observations_f41(spark, d):
    out = gov.migrate_observations(envelopes(spark, d))
    ids = F.array_min(F.transform("units", lambda u: u["observation_id"]))
    return out.select(
        F.col("source_id").cast("bigint").alias("source_id"),
        F.size("units").cast("bigint").alias("units"),
        F.size("unknown_use_units").cast("bigint").alias("unknown_use_units"),
        "status",
        ids.alias("first_id"),
    )


@entry(
    "preservation_u6",
    """select l_orderkey as source_id, l_linenumber + 4 as row, 'left' as side, count(*) as excess from lineitem where l_orderkey % 100 = 3 and l_linenumber % 3 = 2 group by 1, 2""",
)
def preservation_u6(spark, d):
    """Sources ending in 03 lose their unresolved units on purpose; everything else must survive."""
    old = envelopes(spark, d)
    new = gov.migrate_observations(old)
    lost = F.col("source_id").cast("bigint") % 100 == 3
    new = new.withColumn("unknown_use_units", F.when(lost, F.filter("unknown_use_units", lambda u: F.lit(False))).otherwise(F.col("unknown_use_units")))
    out = gov.preservation(old, new).groupBy(F.col("source_id").cast("bigint").alias("source_id"), "row", "side")
    return out.agg(F.sum("excess").alias("excess"))


# ---------------------------------------------------------------- reports and metrics


def report_records(spark, d):
    o, k = orders(spark, d), F.col("k") % 7
    amount = F.when(k == 1, "1,000.00").otherwise(F.col("o_totalprice").cast("decimal(18,2)").cast("string"))
    money = F.struct(amount.alias("amount"), F.when(k != 2, "USD").alias("currency"), F.lit("usd").alias("unit"), F.lit("2026-01").alias("period"))
    none = F.lit(None).cast("string")
    cites = F.create_map(F.lit("noi"), F.when(k != 3, F.lit("gl!4")))
    more = F.create_map(F.lit("noi"), F.lit("gl!4"), F.lit("egi"), F.lit("gl!5"))
    return o.select(
        k.alias("k"),
        F.when(k == 5, "=cmd()").otherwise(F.concat(F.lit("deal "), F.col("k").cast("string"))).alias("subject"),
        F.lit("2026-01").alias("period"),
        F.lit("review").alias("tool"),
        F.lit("r1").alias("run_id"),
        F.create_map(F.lit("noi"), money, F.lit("egi"), F.when(F.lit(False), money)).alias("metrics"),
        F.when(k == 4, more).otherwise(cites).alias("citations"),
        F.when(k == 6, F.array(F.lit("MILLAGE_MISSING"))).otherwise(F.array(none).cast("array<string>")).alias("blockers"),
    )


@entry(
    "validate_report_p19",
    """select k, case k when 1 then 'INVALID_MONEY' when 2 then 'INVALID_MONEY' when 3 then 'CITATION_REQUIRED' when 4 then 'CITATION_WITHOUT_METRIC' when 5 then 'INVALID_SUBJECT' else '' end as issues, count(*) as n
       from (select o_orderkey % 7 as k from orders) x group by 1, 2""",
)
def validate_report_p19(spark, d):
    return joined(gov.validate_report(report_records(spark, d))).groupBy("k", "issues").agg(F.count("*").alias("n"))


@entry(
    "formula_unsafe_f34",
    "select doc_id, regexp_matches(text, '^[=+@\\t\\r]') as unsafe from documents union all select -1 - o_orderkey, o_orderkey % 6 < 4 from orders",
)
def formula_unsafe_f34(spark, d):
    from rentloom.functions.text import formula_unsafe

    o = load(spark, d, "orders")
    starts = F.element_at(F.array(*[F.lit(x) for x in ("=", "+", "@", "\t", "-", " =")]), (F.col("o_orderkey") % 6 + 1).cast("int"))
    cells = o.select((-1 - F.col("o_orderkey")).alias("doc_id"), F.concat(starts, F.col("o_orderstatus")).alias("text"))
    both = load(spark, d, "documents").select("doc_id", "text").unionByName(cells)
    return both.select("doc_id", formula_unsafe(F.col("text")).alias("unsafe"))


GLOSSARY = {
    "metrics": {
        "physical_occupancy": {
            "term": "physical occupancy",
            "status": "CONFLICT",
            "definitions": [
                {"context": "ops_actuals", "owner": "occupancy four-counts"},
                {"context": "governance", "owner": "metric dashboard"},
            ],
        },
        "t12_repairs_and_maintenance": {"status": "CERTIFIED", "definitions": [{"context": "ops_actuals", "owner": "ops t12"}]},
        "millage_rate": {"status": "CERTIFIED", "definitions": [{"context": "uw_proforma", "owner": "tax policy"}]},
        "crime_index": {"status": "no such status", "definitions": [{"owner": "nobody"}]},
        "egi": {"status": "CERTIFIED", "definitions": [{"context": "uw_proforma", "owner": "cashflow"}]},
    }
}
ASKED = [
    ("physical_occupancy", "ops_actuals"), ("physical_occupancy", None), ("physical_occupancy", "forge"), ("physical_occupancy", "standards"),
    ("t12_repairs_and_maintenance", None), ("millage_rate", "uw_proforma"), ("crime_index", None), ("egi", "uw_proforma"), ("unheard_of", None),
]
EXPECTED = [
    None, "CONFLICT_UNRESOLVED", "UNCERTIFIED_METRIC", "CONFLICT_UNRESOLVED", None, None, "UNCERTIFIED_METRIC", "UNCERTIFIED_METRIC", "NOT_FOUND",
]


def asked(spark, d):
    p = load(spark, d, "v_properties").select(F.col("id").alias("subject"))
    items = F.array(*[F.struct(F.lit(i).alias("q"), F.lit(a).alias("metric_id"), F.lit(c).cast("string").alias("context")) for i, (a, c) in enumerate(ASKED)])
    return p.select("subject", F.inline(items))


QUESTIONS = "(values " + ", ".join(f"({i}, '{a}', {'null' if e is None else repr(e)})" for i, ((a, _), e) in enumerate(zip(ASKED, EXPECTED))) + ") q(q, metric_id, err)"


@entry("resolve_metric_f39", f"select p.id as subject, q.q, q.metric_id, q.err as error_code from v_properties p, {QUESTIONS}")
def resolve_metric_f39(spark, d):
    out = metric.resolve_metric(asked(spark, d), metric.load_glossary(spark, GLOSSARY))
    return out.select("subject", "q", "metric_id", "error_code")


def certified(spark, d):
    counts = occupancy.with_denominator(occupancy.latest_snapshot(load(spark, d, "v_snapshots")))
    occ = counts.select(F.col("property_id").alias("subject"), "rate", "error_code").filter("subject <> 'p007'")
    t12 = ops.t12_category_sum(load(spark, d, "v_gl"), "Repairs & Maintenance")
    t12 = t12.select(F.col("property_id").alias("subject"), "value", "error_code")
    n = F.substring("id", 2, 3).cast("int")
    mill = load(spark, d, "v_properties").filter(n % 2 == 0).select(
        F.col("id").alias("subject"), n.cast("decimal(18,2)").alias("millage"), F.when(n == 4, "MISSING_MILLAGE").alias("error_code")
    )
    return metric.certified_metric(asked(spark, d), metric.load_glossary(spark, GLOSSARY), occ, t12, mill)


CERTIFIED_SQL = f"""select p.id as subject, q.q, q.metric_id, coalesce(q.err, case q.q when 0 then case when p.id = 'p007' then 'OCCUPANCY_COUNTS_REQUIRED' end when 4 then case when t.value is null then 'NOT_FOUND' end
      when 5 then case when cast(substr(p.id, 2) as int) % 2 = 1 or p.id = 'p004' then 'MISSING_MILLAGE' end end) as error_code,
    case when q.err is null then case q.q when 0 then case when p.id <> 'p007' then s.occupied * 1000000 // (s.occupied + s.vacant + s.down) end when 4 then (t.value * 1000000)::hugeint when 5 then case when cast(substr(p.id, 2) as int) % 2 = 0 and p.id <> 'p004' then cast(substr(p.id, 2) as int) * 1000000 end end end as v
    from v_properties p cross join {QUESTIONS}
    left join v_o_t12 t on t.property_id = p.id
    left join (select * from (select *, row_number() over (partition by property_id order by as_of_date desc, created_at desc, id desc) as rn from v_snapshots) x where rn = 1) s on s.property_id = p.id"""


@entry("certified_metric_f40", f"select subject, q, metric_id, error_code, cast(v as varchar) as value_e6 from ({CERTIFIED_SQL}) c")
def certified_metric_f40(spark, d):
    out = certified(spark, d)
    scaled = F.floor(F.col("value") * 1000000).cast("decimal(38,0)").cast("string")
    return out.select("subject", "q", "metric_id", "error_code", scaled.alias("value_e6"))


@entry(
    "scoreboard_a30",
    f"""select subject, count(*) filter (where error_code is null) as metrics, string_agg(metric_id || ':' || error_code, ',' order by metric_id) filter (where error_code is not null) as gaps,
        case when count(*) filter (where error_code is null) > 0 then 'certified_partial' else 'uncertified_empty' end as status from ({CERTIFIED_SQL}) c where q in (0, 4, 5) group by 1""",
)
def scoreboard_a30(spark, d):
    from rentloom.operators.evidence import scoreboard

    rows = certified(spark, d).filter("q in (0, 4, 5)").withColumn("value", F.col("value").cast("string"))
    out = scoreboard(rows)
    gaps = F.array_join(F.transform("gaps", lambda g: F.concat_ws(":", g["metric_id"], g["error_code"])), ",")
    return out.select("subject", F.size("metrics").cast("bigint").alias("metrics"), F.when(gaps != "", gaps).alias("gaps"), "status")


@entry(
    "load_glossary_s6",
    f"""select e.event_type, q.metric_id, count(*) as n from events e join {QUESTIONS} on q.q = e.event_id % 9 where q.err is null group by 1, 2""",
)
def load_glossary_s6(spark, d):
    items = F.array(*[F.struct(F.lit(a).alias("metric_id"), F.lit(c).cast("string").alias("context")) for a, c in ASKED])
    e = load(spark, d, "events").withColumn("q", F.element_at(items, (F.col("event_id") % 9 + 1).cast("int")))
    ask = e.select("event_type", "q.metric_id", "q.context")
    out = metric.resolve_metric(ask, metric.load_glossary(spark, GLOSSARY)).filter("error_code is null")
    return out.groupBy("event_type", "metric_id").agg(F.count("*").alias("n"))
