"""Document, claim and scoring queries with their SQL twins."""

from __future__ import annotations

from pyspark.sql import functions as F

from registry.common import Register
from registry.sqltext import SPARK_VIEWS, load, view
from rentloom.functions import jsonx, text
from rentloom.operators import documents, evidence
from rentloom.session import cut_lineage

ENTRIES = Register()
entry = ENTRIES.entry

# Five documents make one brochure; some pages open with a section heading or a contents list.
view(
    "v_pages",
    """
    select cast(floor(doc_id / 5) as bigint) as doc_id, cast(doc_id % 5 + 1 as int) as page,
           case doc_id % 13 when 0 then 'Rent Roll: Summary' || chr(10) when 1 then 'T-12  Statement' || chr(10) when 2 then 'RENT ROLL' || chr(10)
             when 4 then 'Table of Contents' || chr(10) || 'Rent Roll ...... 3' || chr(10) || 'Taxes ..... 9' || chr(10)
             when 6 then 'Broker Tax Assumptions 2026' || chr(10) when 7 then 'Loan Summary' || chr(10) else '' end || text as text
    from documents""",
)
view(
    "v_lines",
    """
    select doc_id, cast(pos as int) as line_no, line from (
      select doc_id, generate_subscripts(string_split(text, chr(10)), 1) as pos, unnest(string_split(text, chr(10))) as line
      from (select doc_id, case when text like '%' || chr(10) then substr(text, 1, length(text) - 1) else text end as text from documents) d) x""",
)
SPARK_VIEWS["v_lines"] = lambda spark, d: documents.explode_lines(
    load(spark, d, "documents").select("doc_id", "text")
).select("doc_id", "line_no", "line")

W = r"[^\p{L}\p{N}_]"
EMAIL = text.EMAIL
PHONE = r"(^|[^0-9,.])(?:\+?1[\s.-]?)?(?:\([0-9]{3}\)|[0-9]{3})[\s.-]?[0-9]{3}[\s.-]?[0-9]{4}($|[^0-9])"
SSN = r"(^|[^0-9])[0-9]{3}-[0-9]{2}-[0-9]{4}($|[^0-9])"
NAME = r"\s*[A-Za-z][A-Za-z'']+(?:\s+[A-Za-z][A-Za-z'']+){0,3}"
LABEL = rf"(^|{W})((?:resident|tenant|lessee|occupant|applicant)\s*)"
INJ = rf"(^|{W})(?:(?:ignore|disregard)\s+(?:all\s+|any\s+)?(?:previous|prior|above)\s+instructions|approve\s+the\s+(?:following|deal))($|{W})"


def twice(expr: str, pattern: str, to: str, flags: str = "g") -> str:
    """Boundaries are consumed here, so neighbours need a second pass."""
    once = f"regexp_replace({expr}, '{pattern}', '{to}', '{flags}')"
    return f"regexp_replace({once}, '{pattern}', '{to}', '{flags}')"


view(
    "v_o_red",
    f"""
    select *, case when regexp_matches(line, '{INJ}', 'i') then 'PROMPT_INJECTION_SUSPECT'
                   when len(list_filter(regexp_extract_all(l4, '[0-9]+(?:[.,][0-9]+)*'), lambda t: not regexp_matches(t, '[.,]') and length(t) > 2 and not regexp_full_match(t, '(19|20)[0-9]{{2}}'))) > 0 then 'UNSAFE_PII_LOCAL_ONLY'
                   when l1 <> line then 'email' when l2 <> l1 then 'phone' when l3 <> l2 then 'pii' when l4 <> l3 then 'person_name' end as reason,
           regexp_matches(line, '{INJ}', 'i') or len(list_filter(regexp_extract_all(l4, '[0-9]+(?:[.,][0-9]+)*'), lambda t: not regexp_matches(t, '[.,]') and length(t) > 2 and not regexp_full_match(t, '(19|20)[0-9]{{2}}'))) > 0 as is_local
    from (select *, {twice(twice('l3', LABEL + ':' + NAME, chr(92) + '1' + chr(92) + '2: [REDACTED:person_name]', 'gi'), '(' + LABEL + '-' + NAME + ')', chr(92) + '1: [REDACTED:person_name]', 'gi')} as l4
      from (select *, {twice('l2', SSN, chr(92) + '1[REDACTED:pii]' + chr(92) + '2')} as l3
        from (select *, {twice('l1', PHONE, chr(92) + '1[REDACTED:phone]' + chr(92) + '2')} as l2
          from (select *, regexp_replace(line, '{EMAIL}', '[REDACTED:email]', 'g') as l1 from v_lines) a) b) c) d""",
)


@entry("explode_lines_s8", "select doc_id, count(*) as lines, sum(length(line))::bigint as chars from v_lines group by 1")
def explode_lines_s8(spark, d):
    lines = load(spark, d, "v_lines").groupBy("doc_id")
    return lines.agg(F.count("*").alias("lines"), F.sum(F.length("line")).alias("chars"))


@entry(
    "redact_line_f26",
    "select doc_id, line_no, reason, case when not is_local then l4 end as redacted from v_o_red where reason is not null",
)
def redact_line_f26(spark, d):
    r = load(spark, d, "v_lines").withColumn("r", text.redact_line(F.col("line")))
    return r.select("doc_id", "line_no", "r.reason", "r.redacted").filter("reason is not null")


@entry(
    "metadata_allowlist_f27",
    """select doc_id, lang as title, case when doc_id % 4 = 0 then null else 'a [REDACTED:email]' end as subject, cast(null as varchar) as author from documents""",
)
def metadata_allowlist_f27(spark, d):
    docs = load(spark, d, "documents")
    subject = F.when(F.col("doc_id") % 4 == 0, "room 12345").otherwise("a bob@example.com")
    meta = F.create_map(
        F.lit("title"), F.col("lang"), F.lit("subject"), subject, F.lit("author"), F.lit("Someone"), F.lit("custom"), F.col("source")
    )
    out = docs.select("doc_id", text.metadata_allowlist(meta).alias("m"))
    return out.select("doc_id", *[F.try_element_at("m", F.lit(k)).alias(k) for k in ("title", "subject", "author")])


view(
    "v_o_heads",
    r"""
    select *, case when regexp_matches(key, '^(tax assumptions?( and projections)?|broker tax assumptions)( |$)') then 'tax_assumptions'
         when regexp_matches(key, '^(operating statements?|trailing twelve month operating statement|trailing twelve operating statement|profit and loss statement|p&l statement|income and expense statements?)( |$)') then 'operating_statements'
         when regexp_matches(key, '^(t12|t 12|trailing twelve|trailing 12|twelve month operating statement)( |$)') then 't12'
         when regexp_matches(key, '^(rent roll summary|rent roll|rentroll)( |$)') then 'rent_roll'
         when regexp_matches(key, '^(debt structure|financing assumptions|loan summary|current debt)( |$)') then 'debt_structure'
         when regexp_matches(key, '^(lease summary|lease terms|lease abstracts|rent schedule|commercial lease summary)( |$)') then 'lease_terms' end as code
    from (select doc_id, page, pos as line_no, line, trim(regexp_replace(lower(trim(line)), '[\s/,:\-_….]+', ' ', 'g')) as key from (
      select doc_id, page, generate_subscripts(string_split(text, chr(10)), 1) as pos, unnest(string_split(text, chr(10))) as line from v_pages) a) b""",
)
view(
    "v_o_toc",
    r"""
    select doc_id, page, contains(string_agg(lower(t), ' ' order by line_no) filter (where rk <= 12), 'contents')
           and (count(*) filter (where dotted) >= 2 or count(*) filter (where dotted and regexp_matches(lower(t), 'overview|summary|introduction|appendix')) > 0) as toc
    from (select *, trim(line) as t, regexp_matches(line, '\.{3,}|…') as dotted, row_number() over (partition by doc_id, page order by line_no) as rk
          from v_o_heads where trim(line) <> '') x group by 1, 2""",
)
view(
    "v_o_first",
    """
    select doc_id, page, line_no, code, trim(line) as heading_text from (
      select h.*, row_number() over (partition by h.doc_id, h.page order by line_no) as rn from v_o_heads h
      left join v_o_toc t on t.doc_id = h.doc_id and t.page = h.page where code is not null and not coalesce(t.toc, false)) x where rn = 1""",
)
view(
    "v_o_spans",
    """
    select doc_id, code, min(page)::int as page_start, max(greatest(page, coalesce(next_start - 1, total_pages)))::int as page_end from (
      select s.*, lead(page) over (partition by doc_id order by page) as next_start, tp.total_pages
      from (select *, lag(code) over (partition by doc_id order by page) as before from v_o_first) s
      join (select doc_id as d, max(page) as total_pages from v_pages group by 1) tp on tp.d = s.doc_id
      where before is null or before <> code) x group by 1, 2""",
)


def spans(spark, d):
    pages = load(spark, d, "v_pages")
    totals = pages.groupBy("doc_id").agg(F.max("page").alias("total_pages"))
    return documents.section_spans(documents.first_heading(pages), totals, cut_lineage)


@entry(
    "is_toc_f33",
    "select p.doc_id, p.page, coalesce(toc, false) as toc from v_pages p left join v_o_toc t on t.doc_id = p.doc_id and t.page = p.page",
)
def is_toc_f33(spark, d):
    return load(spark, d, "v_pages").select("doc_id", "page", text.is_toc(text.lines_of(F.col("text"))).alias("toc"))


@entry("first_heading_w14", "select doc_id, page, line_no::int as line_no, code, heading_text from v_o_first")
def first_heading_w14(spark, d):
    return documents.first_heading(load(spark, d, "v_pages"))


@entry("section_spans_w15", "select doc_id, code, page_start, page_end from v_o_spans")
def section_spans_w15(spark, d):
    return spans(spark, d)


@entry(
    "page_budget_w16",
    """select doc_id, count(*) as candidate_pages, string_agg(cast(page as varchar), ',' order by page) filter (where rk <= 2) as selected_pages,
        greatest(count(*) - 2, 0) as overflow_pages, case when count(*) > 2 then 'PAGE_BUDGET_OVERFLOW' end as error_code
       from (select *, row_number() over (partition by doc_id order by page) as rk from (
         select distinct s.doc_id, p.page from v_o_spans s join v_pages p on p.doc_id = s.doc_id and p.page between s.page_start and s.page_end) a) b group by 1""",
)
def page_budget_w16(spark, d):
    out = documents.page_budget(spans(spark, d), 2)
    return out.withColumn("selected_pages", F.array_join("selected_pages", ","))


BUDGET, LONG = 3000, 400


FOLD = f"""with recursive j as (select doc_id, line_no, case when length(line) > {LONG} then 'LINE_BUDGET_EXCEEDED' else reason end as reason,
                     case when length(line) <= {LONG} and not is_local then length(l4) end as sz from v_o_red),
        fold as (
          select doc_id, 0::bigint as n, 0::bigint as used, false as kept from (select distinct doc_id from v_lines) s
          union all
          select f.doc_id, f.n + 1, case when j.sz is not null and f.used + j.sz <= {BUDGET} then f.used + j.sz else f.used end,
                 j.sz is not null and f.used + j.sz <= {BUDGET}
          from fold f join j on j.doc_id = f.doc_id and j.line_no = f.n + 1)"""


def packet(spark, d):
    docs = load(spark, d, "documents").select("doc_id", "text")
    return documents.packet_lines(docs, BUDGET, LONG)


@entry(
    "packet_accounting_a31",
    f"""{FOLD}
        select j.doc_id, count(*) filter (where kept) as kept_lines, count(*) filter (where kept and reason is not null) as redacted_lines,
               count(*) filter (where not kept) as local_only_lines, sum(sz) filter (where kept)::bigint as kept_chars,
               count(*) filter (where sz is not null and not kept) as packet_budget_exceeded,
               count(*) filter (where reason = 'UNSAFE_PII_LOCAL_ONLY') as unsafe_pii_local_only
        from j join fold f on f.doc_id = j.doc_id and f.n = j.line_no group by 1""",
)
def packet_accounting_a31(spark, d):
    out = documents.packet_accounting(packet(spark, d))
    return out.select(
        "doc_id", "kept_lines", "redacted_lines", "local_only_lines", "kept_chars", "packet_budget_exceeded", "unsafe_pii_local_only"
    )


@entry(
    "packet_budget_w17",
    f"""{FOLD}
        select j.doc_id, count(*) as lines, count(*) filter (where kept) as kept, sum(case when kept then j.line_no else 0 end)::bigint as kept_positions, max(used)::bigint as used
        from j join fold f on f.doc_id = j.doc_id and f.n = j.line_no group by 1""",
)
def packet_budget_w17(spark, d):
    """Greedy packing: a line that does not fit is left out whole and a later, shorter one may still go in."""
    out = packet(spark, d)
    kept = F.col("state") != "local_only"
    return out.groupBy("doc_id").agg(
        F.count("*").alias("lines"),
        F.count_if(kept).alias("kept"),
        F.sum(F.when(kept, F.col("line_no")).otherwise(0)).alias("kept_positions"),
        F.coalesce(F.sum(F.when(kept, F.length("text"))), F.lit(0)).alias("used"),
    )


@entry(
    "search_unstructured_c6",
    "select doc_id, line_no, l4 as line from v_o_red where contains(lower(line), 'license') and not is_local",
)
def search_unstructured_c6(spark, d):
    return documents.search_unstructured(load(spark, d, "v_lines"), "License")


SENT = "list_filter(regexp_split_to_array(regexp_replace(trim(text, ' ' || chr(10)), '([.!?])\\s+', '\\1' || chr(1), 'g'), chr(1)), lambda s: trim(s) <> '')"
NUM = r"\$\s*[0-9]{1,3}(?:,[0-9]{3})*(?:\.[0-9]+)?|\b[0-9]{1,3}(?:,[0-9]{3})+(?:\.[0-9]+)?\b|\b[0-9]+\.[0-9]+\b|\b[0-9]+%"


@entry(
    "uncited_numbers_f32",
    f"""select doc_id, case when doc_id % 3 = 0 then 0 else len(list_filter({SENT}, lambda s: regexp_matches(regexp_replace(s, '\\b(?:19|20)[0-9]{{2}}\\b', ' ', 'g'), '{NUM}'))) end as uncited from documents""",
)
def uncited_numbers_f32(spark, d):
    docs = load(spark, d, "documents")
    cited = F.when(F.col("doc_id") % 3 == 0, 1).otherwise(0)
    return docs.select("doc_id", F.size(text.uncited_numbers(F.col("text"), cited)).cast("bigint").alias("uncited"))


# ---------------------------------------------------------------- claims

# What stands in the middle of the line, or the same in capitals, or with something before it.
PIECE = "substr(line, 1 + cast(floor(length(line) / 2) as int), 12)"
CLAIM = f"case line_no % 5 when 0 then 'zz' || {PIECE} when 1 then upper({PIECE}) else {PIECE} end"


@entry(
    "anchor_claims_j8",
    f"""select doc_id, line_no, case when line_no % 11 = 0 then 'PROMPT_INJECTED_TOOL_ACTION' when line_no % 7 = 0 then 'CITATION_NOT_IN_SOURCE'
          when regexp_matches(line, '{INJ}', 'i') then 'PROMPT_INJECTION_SUSPECT_CITATION' when not contains(line, v) then 'VALUE_NOT_IN_CITED_CONTENT' else
            concat_ws(',', case when not contains(line, substr(line, 3, 5)) then 'LABEL_NOT_IN_CITED_CONTENT' end, case when line_no % 3 = 0 and not contains(line, '2026') then 'PERIOD_MISMATCH_REVIEW' end) end as issues
        from (select *, {CLAIM} as v from v_lines where trim(line) <> '') x""",
)
def anchor_claims_j8(spark, d):
    out = claims(spark, d)
    return out.select("doc_id", "line_no", F.array_join("issues", ",").alias("issues"))


def claims(spark, d):
    lines = load(spark, d, "v_lines").withColumns(
        {
            "source_sha256": F.sha2(F.col("doc_id").cast("string"), 256),
            "section_code": F.lit("t12"),
            "sheet": F.lit(1),
            "row": F.col("line_no"),
            "row_end": F.col("line_no"),
            "column": F.lit(1),
        }
    )
    n, value = F.col("line_no"), F.expr(CLAIM)
    missing = F.when(n % 7 == 0, n + 1000000).otherwise(n)
    asked = lines.filter("trim(line) <> ''").select(
        "doc_id",
        "line_no",
        "source_sha256",
        "section_code",
        "sheet",
        missing.alias("row"),
        missing.alias("row_end"),
        "column",
        F.lit("fact").alias("kind"),
        F.substring("line", 3, 5).alias("label"),
        value.alias("value"),
        F.when(n % 3 == 0, "2026").alias("period"),
        F.lit(None).cast("string").alias("unit"),
        F.when(n % 11 == 0, "pay").alias("tool_action"),
        F.lit(None).cast("string").alias("approval"),
    )
    return evidence.anchor_claims(asked, lines.withColumnRenamed("line", "content"))


@entry(
    "claim_status_a26",
    f"""select doc_id, case when max(case when bad then 1 else 0 end) = 1 then 'invalid' when max(case when rev then 1 else 0 end) = 1 then 'needs_review' else 'verified' end as document_status,
        count(*) as claims, count(*) filter (where not bad and not rev) as verified
        from (select doc_id, line_no % 11 = 0 or line_no % 7 = 0 or regexp_matches(line, '{INJ}', 'i') or not contains(line, v) as bad,
                     line_no % 3 = 0 and not contains(line, '2026') as rev from (select *, {CLAIM} as v from v_lines where trim(line) <> '') x) y group by 1""",
)
def claim_status_a26(spark, d):
    return evidence.claim_status(claims(spark, d), "doc_id")


@entry(
    "citation_totals_a24",
    """select source_id, count(*) filter (where k % 10 <> 3 and k % 10 <> 4 and k % 10 <> 5) as located, count(*) filter (where k % 10 = 3) as empty,
        count(*) filter (where k % 10 = 4) as missing, count(*) filter (where k % 10 = 5) as unsupported from v_roll group by 1""",
)
def citation_totals_a24(spark, d):
    r, k = load(spark, d, "v_roll"), F.col("k") % 10
    cells = r.select(
        "source_id", F.lit(1).alias("sheet"), "row", F.lit(1).alias("column"), F.when(k == 3, " ").otherwise(F.col("unit_id")).alias("text")
    )
    cites = r.select(
        "source_id",
        F.lit(1).alias("sheet"),
        F.when(k == 4, -F.col("row")).otherwise(F.col("row")).alias("row"),
        F.when(k != 5, 1).alias("column"),
    )
    return evidence.citation_totals(cites, cells)


@entry(
    "capture_evidence_j16",
    """select page_id, case when k = 1 then 'UNREVIEWED' when k in (2, 3, 4) then 'MISSING' when k = 5 then 'CONFLICTING' else 'VERIFIED' end as state,
        case when k = 1 then 'LOCATOR_NOT_SUPPORTED' when k = 2 then 'NOT_FOUND' when k in (3, 4) then 'EVIDENCE_INCOMPLETE' when k = 5 then 'LOCATOR_CONFLICT' else 'PINNED_LOCATOR_RESOLVED' end as code
        from (select page_id, page_id % 8 as k from pages) p""",
)
def capture_evidence_j16(spark, d):
    p, k = load(spark, d, "pages"), F.col("page_id") % 8
    sha = F.sha2("html", 256)
    where = F.concat(F.lit("page:"), F.col("page_id").cast("string"))
    path = F.concat(F.col("url"), where)
    one = F.struct(path.alias("path"), sha.alias("sha256"), where.alias("locator"), F.when(k != 4, F.lit("Rent")).alias("value"))
    copies = F.when(k == 2, F.array()).when(k == 3, F.array(one, one)).otherwise(F.array(one))
    captures = p.select(F.inline(F.when(k == 2, F.filter(F.array(one), lambda x: F.lit(False))).otherwise(copies)))
    asked = p.select(
        "page_id",
        path.alias("path"),
        sha.alias("sha256"),
        F.when(k != 1, where).alias("locator"),
        F.when(k == 5, "Total").when(k == 6, "Rent").alias("label"),
    )
    return evidence.capture_evidence(asked, captures).select("page_id", "state", "code")


# ---------------------------------------------------------------- JSON


@entry(
    "flatten_json_f29",
    """select event_id, 3 as numeric_leaves, cast(json_extract(props, '$.k') as varchar) as k from events""",
)
def flatten_json_f29(spark, d):
    e = load(spark, d, "events")
    body = F.concat(F.lit('{"a":['), F.col("value").cast("string"), F.lit(',null,"12.5"],"b":{"p":'), F.col("props"), F.lit(',"s":"x1"}}'))
    nodes = e.select("event_id", jsonx.flatten_json(body).alias("n"))
    k = F.get(F.filter("n", lambda x: x["pointer"] == "/b/p/k"), F.lit(0))["value"]
    return nodes.select("event_id", F.size(jsonx.numeric_leaves(F.col("n"))).alias("numeric_leaves"), k.alias("k"))


@entry(
    "json_pointer_f30",
    """select event_id, case event_id % 5 when 0 then cast(json_extract(props, '$.k') as varchar) when 1 then '7' when 4 then event_type end as value,
        case event_id % 5 when 2 then 'EVIDENCE_INCOMPLETE' when 3 then 'INVALID_LOCATOR' end as error_code from events""",
)
def json_pointer_f30(spark, d):
    e, s = load(spark, d, "events"), F.col("event_id") % 5
    body = F.concat(
        F.lit('{"p":'), F.col("props"), F.lit(',"l":[5,7],"n":null,"a/b":"'), F.col("event_type"), F.lit('"}')
    )
    pointer = (
        F.when(s == 0, "/p/k").when(s == 1, "/l/1").when(s == 2, "/n").when(s == 3, "p~2").otherwise("/a~1b")
    )
    p = jsonx.json_pointer(body, pointer)
    return e.select("event_id", p["value"].alias("value"), p["error_code"].alias("error_code"))


@entry(
    "spoofed_authority_f31",
    "select event_id, event_id % 6 in (1, 3, 4) as spoofed from events",
)
def spoofed_authority_f31(spark, d):
    e, s = load(spark, d, "events"), F.col("event_id") % 6
    claim = (
        F.when(s == 0, '{"approved":false}')
        .when(s == 1, '[{"x":{"approved":true}}]')
        .when(s == 2, '{"status":"draft","certified":null}')
        .when(s == 3, '{"state":"PASS"}')
        .when(s == 4, '{"approval":{"id":1}}')
        .otherwise('{"note":"approved"}')
    )
    body = F.concat(F.lit('{"props":'), F.col("props"), F.lit(',"r":'), claim, F.lit("}"))
    return e.select("event_id", jsonx.spoofed_authority(jsonx.flatten_json(body)).alias("spoofed"))


def scored(spark, d):
    e, s = load(spark, d, "events"), F.col("event_id") % 7
    v = F.col("value").cast("string")
    cases = e.select(
        F.col("event_id").alias("id"),
        F.col("event_type").alias("family"),
        F.concat(F.lit('{"noi":'), v, F.lit(',"codes":["a","b"]}')).alias("expected"),
    )
    observed = (
        F.when(s == 1, F.concat(F.lit('{"noi":"'), v, F.lit('","codes":["a","b"]}')))
        .when(s == 2, F.concat(F.lit('{"noi":'), v, F.lit(',"codes":["b","a"]}')))
        .when(s == 3, F.concat(F.lit('{"noi":'), v, F.lit(',"codes":["a","b"],"zero_filled":true}')))
        .otherwise(F.concat(F.lit('{"more":1,"codes":["a","b"],"noi":'), v, F.lit("}")))
    )
    observations = e.select(
        F.when(s == 5, -F.col("event_id") - 1).otherwise(F.col("event_id")).alias("id"),
        observed.alias("observed"),
        (s != 4).alias("complete"),
        F.when(s == 6, F.array(F.lit("leak"))).otherwise(F.expr("cast(array() as array<string>)")).alias("critical_violations"),
    )
    return cases, observations


@entry(
    "score_cases_a28",
    """select event_id as id, s in (0, 3, 4, 6) as matched, s = 0 as passed, case when s = 5 then 'MISSING_OBSERVATION' end as error_code from (select event_id, event_id % 7 as s from events) x
       union all select -event_id - 1, false, false, 'EXTRA_OBSERVATION' from events where event_id % 7 = 5""",
)
def score_cases_a28(spark, d):
    return evidence.score_cases(*scored(spark, d)).select("id", "matched", "passed", "error_code")


@entry(
    "subset_match_f28",
    "select event_type as family, count(*) filter (where event_id % 7 = 0) as passed, count(*) as cases, false as safety_passed from events group by 1",
)
def subset_match_f28(spark, d):
    return evidence.score_totals(evidence.score_cases(*scored(spark, d)).filter("family is not null"))


@entry(
    "id_parity_u7",
    """select event_id as id, 'MISSING' as reason from events where event_id % 7 = 5 union all select -event_id - 1, 'EXTRA' from events where event_id % 7 = 5""",
)
def id_parity_u7(spark, d):
    cases, observations = scored(spark, d)
    return evidence.id_parity(cases, observations, "id")
