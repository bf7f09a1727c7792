"""Document jobs over pages(doc_id, page, text): lines, sections, redacted packets, search.

A page is one row, so headings, contents pages and redaction are row-local; only spans and budgets look across pages.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rentloom.functions.money import bind
from rentloom.functions.refusal import top_n
from rentloom.functions.skew import previous
from rentloom.functions.text import (
    contains_pii,
    is_toc,
    lines_of,
    redact_line,
    section_code,
)

MAX_LINE_CHARS = 2_000
MAX_PACKET_CHARS = 200_000
PAGE_BUDGET = 40
Stage = Callable[[DataFrame], DataFrame]


def explode_lines(pages: DataFrame, text: str = "text") -> DataFrame:
    """One row per line, numbered from 1. A page without a text layer gives one row with ``needs_ocr``."""
    keep = [c for c in pages.columns if c != text]
    lines = pages.select(*keep, F.posexplode_outer(lines_of(F.col(text))).alias("pos", "line"))
    return lines.select(
        *keep, (F.coalesce("pos", F.lit(0)) + 1).alias("line_no"), "line", F.col("line").isNull().alias("needs_ocr")
    )


def first_heading(pages: DataFrame) -> DataFrame:
    """First section heading of each page that is not a contents page: (doc_id, page, line_no, code, heading_text)."""

    def found(lines: Column) -> Column:
        marked = F.transform(
            F.transform(lines, section_code),
            lambda code, i: F.struct(
                (i + 1).alias("line_no"), code.alias("code"), F.trim(F.get(lines, i)).alias("heading_text")
            ),
        )
        hits = F.slice(F.filter(marked, lambda m: m["code"].isNotNull()), 1, 1)
        return F.when(~is_toc(lines), hits)

    # One generator instead of filters: a filter on the result would evaluate the whole chain again.
    return pages.select("doc_id", "page", F.inline(bind(lines_of(F.col("text")), found)))


def section_spans(headings: DataFrame, doc_pages: DataFrame, stage: Stage | None = None) -> DataFrame:
    """Page span per (document, section). A heading of another code ends the span; the same code extends it.

    ``doc_pages(doc_id, total_pages)``. Neighbouring headings are looked up in chunks of pages, which reads the
    headings several times; pass ``stage=cut_lineage`` so the document text behind them is read once."""
    key = ["doc_id"]
    headings = stage(headings) if stage else headings
    seen = previous(headings.select("doc_id", "page", "code"), key, "page", F.col("code"), "before")
    starts = seen.filter(F.col("before").isNull() | (F.col("before") != F.col("code"))).drop("before")
    starts = starts.withColumn("back", -F.col("page"))
    starts = previous(starts, key, "back", F.col("page"), "next_start")
    spans = starts.join(doc_pages, "doc_id").withColumn(
        "span_end", F.greatest(F.coalesce(F.col("next_start") - 1, F.col("total_pages")), F.col("page"))
    )
    return spans.groupBy("doc_id", "code").agg(
        F.min("page").cast("int").alias("page_start"), F.max("span_end").cast("int").alias("page_end")
    )


def page_budget(spans: DataFrame, n: int = PAGE_BUDGET) -> DataFrame:
    """First n candidate pages per document in page order; the overflow is counted, never dropped silently."""
    candidates = spans.select("doc_id", F.explode(F.sequence("page_start", "page_end")).alias("page")).distinct()
    totals = candidates.groupBy("doc_id").agg(F.count("*").alias("candidate_pages"))
    selected = top_n(candidates, ["doc_id"], [F.col("page")], n).groupBy("doc_id").agg(
        F.array_sort(F.collect_list("page")).alias("selected_pages")
    )
    out = totals.join(selected, "doc_id")
    over = F.greatest(F.col("candidate_pages") - n, F.lit(0))
    return out.withColumns(
        {"overflow_pages": over, "error_code": F.when(over > 0, F.lit("PAGE_BUDGET_OVERFLOW"))}
    )


FIT_BLOCK = 256


def _fits(lines: Column, budget: int) -> Column:
    """Which lines a greedy packer keeps: a line that does not fit is left out whole and uses no budget.

    A document whose lines all fit needs no walk. The walk is a fold in the JVM over blocks of lines, so that the verdicts
    that are appended one by one stay short; it only runs for documents that do not fit."""
    sizes = F.transform(lines, lambda x: F.coalesce(F.length(x), F.lit(-1)))
    total = F.aggregate(lines, F.lit(0).cast("bigint"), lambda acc, x: acc + F.coalesce(F.length(x), F.lit(0)))
    nothing = F.expr("cast(array() as array<boolean>)")

    def state(left: Column, out: Column) -> Column:
        return F.struct(left.cast("bigint").alias("left"), out.alias("out"))

    def line(acc: Column, n: Column) -> Column:
        fits = (n >= 0) & (n <= acc["left"])
        return state(acc["left"] - F.when(fits, n).otherwise(0), F.concat(acc["out"], F.array(fits)))

    def walk(all_sizes: Column) -> Column:
        blocks = F.sequence(F.lit(0), F.floor((F.size(all_sizes) - 1) / FIT_BLOCK).cast("int"))

        def block(acc: Column, i: Column) -> Column:
            own = F.slice(all_sizes, i * FIT_BLOCK + 1, F.lit(FIT_BLOCK))
            inner = F.aggregate(own, state(acc["left"], nothing), line)
            return bind(inner, lambda x: state(x["left"], F.concat(acc["out"], x["out"])))

        return F.aggregate(blocks, state(F.lit(budget), nothing), block, lambda acc: acc["out"])

    return F.when(total <= budget, F.transform(lines, lambda x: x.isNotNull())).otherwise(bind(sizes, walk))


def packet_lines(docs: DataFrame, max_chars: int = MAX_PACKET_CHARS, max_line: int = MAX_LINE_CHARS) -> DataFrame:
    """Every line of every document with its fate: kept, redacted, or local-only with a reason.

    ``docs(doc_id, text)``. Lines over the line limit are excluded whole; nothing is ever cut."""
    lines = lines_of(F.col("text"))

    def judge(line: Column) -> Column:
        r = redact_line(line)
        long = F.length(line) > max_line
        return F.struct(
            F.when(~long, r["redacted"]).alias("redacted"),
            F.when(long, "LINE_BUDGET_EXCEEDED").otherwise(r["reason"]).alias("reason"),
        )

    judged = docs.select("doc_id", F.transform(lines, judge).alias("judged"))
    fit = _fits(F.transform("judged", lambda j: j["redacted"]), max_chars)
    packed = judged.withColumn("fit", fit)
    rows = packed.select(
        "doc_id", F.posexplode(F.arrays_zip("judged", "fit")).alias("pos", "z")
    ).select("doc_id", (F.col("pos") + 1).alias("line_no"), "z.judged.redacted", "z.judged.reason", "z.fit")
    state = (
        F.when(F.col("redacted").isNull(), "local_only")
        .when(~F.col("fit"), "local_only")
        .when(F.col("reason").isNotNull(), "redacted")
        .otherwise("kept")
    )
    over = F.col("redacted").isNotNull() & ~F.col("fit")
    return rows.select(
        "doc_id",
        "line_no",
        state.alias("state"),
        F.when(over, "PACKET_BUDGET_EXCEEDED").otherwise(F.col("reason")).alias("reason"),
        F.when(F.col("fit") & ~contains_pii(F.col("redacted")), F.col("redacted")).alias("text"),
        (F.col("fit") & contains_pii(F.col("redacted"))).alias("leak"),
    )


def packet_accounting(lines: DataFrame, approved: Column | None = None) -> DataFrame:
    """Counts per document by fate and reason, blockers, and whether the packet may leave."""
    reasons = ["LINE_BUDGET_EXCEEDED", "UNSAFE_PII_LOCAL_ONLY", "PROMPT_INJECTION_SUSPECT", "PACKET_BUDGET_EXCEEDED"]
    out = lines.groupBy("doc_id").agg(
        F.count_if(F.col("state") != "local_only").alias("kept_lines"),
        F.count_if(F.col("state") == "redacted").alias("redacted_lines"),
        F.count_if(F.col("state") == "local_only").alias("local_only_lines"),
        F.sum(F.when(F.col("state") != "local_only", F.coalesce(F.length("text"), F.lit(0)))).alias("kept_chars"),
        *[F.count_if(F.col("reason") == r).alias(r.lower()) for r in reasons],
        F.coalesce(F.bool_or("leak"), F.lit(False)).alias("leak"),
    )
    approved = F.lit(True) if approved is None else approved
    overflow = F.col("packet_budget_exceeded") > 0
    status = (
        F.when(F.col("leak"), "refused")
        .when(F.col("kept_lines") == 0, "blocked")
        .when(overflow, "needs_review")
        .otherwise("ok")
    )
    return out.withColumns(
        {
            "status": status,
            "error_code": F.when(F.col("leak"), "REDACTION_FAILURE"),
            "egress_ready": approved & (status == "ok"),
        }
    )


def search_unstructured(lines: DataFrame, needle: str) -> DataFrame:
    """Lines whose redacted text contains the words (case folded); a line that must stay local never matches.

    The raw text is never searched, so nobody can test for a number or name that redaction hides."""
    redacted = lines.withColumn("line", redact_line(F.col("line"))["redacted"])
    return redacted.filter(F.lower("line").contains(needle.lower()))
