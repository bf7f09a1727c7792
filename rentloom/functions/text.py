"""Document text: redaction, section headings, contents pages, and numbers that need a citation."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from rentloom.functions.money import bind

# Patterns of typed personal data and of text that tries to give orders.
EMAIL = r"[\p{L}\p{N}_.+-]+@[\p{L}\p{N}_-]+(?:\.[\p{L}\p{N}_-]+)+"
DIGIT = r"\p{Nd}"  # digits of every script: a number in other digits is still a number
SPACE = r"[\s\p{Z}\x1c-\x1f\x85]"
_SEP = r"[\s\p{Z}\x1c-\x1f\x85.-]?"
PHONE = rf"(?<![{DIGIT},.])(?:\+?1{_SEP})?(?:\({DIGIT}{{3}}\)|{DIGIT}{{3}}){_SEP}{DIGIT}{{3}}{_SEP}{DIGIT}{{4}}(?!{DIGIT})"
SSN = rf"(?<!{DIGIT}){DIGIT}{{3}}-{DIGIT}{{2}}-{DIGIT}{{4}}(?!{DIGIT})"
_LABEL = rf"(?<![\p{{L}}\p{{N}}_])(resident|tenant|lessee|occupant|applicant)({SPACE}*)"
_NAME = rf"{SPACE}*[A-Z][A-Z']+(?:{SPACE}+[A-Z][A-Z']+){{0,3}}"
PERSON = f"(?i){_LABEL}[:-]{_NAME}"
PERSON_COLON = f"(?i){_LABEL}:{_NAME}"
PERSON_DASH = f"(?i)({_LABEL}-{_NAME})"
INJECTION = (
    rf"(?i)(?<![\p{{L}}\p{{N}}_])(?:(?:ignore|disregard){SPACE}+(?:all{SPACE}+|any{SPACE}+)?(?:previous|prior|above){SPACE}+instructions"
    rf"|approve{SPACE}+the{SPACE}+(?:following|deal))(?![\p{{L}}\p{{N}}_])"
)
PERSON_WORDS = ["resident", "tenant", "lessee", "occupant", "applicant"]
METADATA_KEYS = ["title", "subject", "producer", "creator", "pages"]
DIGITS = r"(\p{Nd}+(?:[.,]\p{Nd}+)*)"
YEAR = r"^(19|20)[0-9]{2}$"
LINE_BREAK = r"\r\n|[\n\r\x0b\f\x1c-\x1e\x85\u2028\u2029]"

# Section headings in the order they are tried.
SECTIONS = {
    "tax_assumptions": [
        "tax assumption", "tax assumptions", "tax assumptions and projections", "broker tax assumptions",
    ],
    "operating_statements": [
        "operating statement", "operating statements", "trailing twelve month operating statement",
        "trailing twelve operating statement", "profit and loss statement", "p&l statement",
        "income and expense statement", "income and expense statements",
    ],
    "t12": ["t12", "t 12", "t.12", "trailing twelve", "trailing 12", "twelve month operating statement"],
    "rent_roll": ["rent roll summary", "rent roll", "rentroll"],
    "debt_structure": ["debt structure", "financing assumptions", "loan summary", "current debt"],
    "lease_terms": ["lease summary", "lease terms", "lease abstracts", "rent schedule", "commercial lease summary"],
}


def lines_of(text: Column) -> Column:
    """Array of lines; a final line break does not start another line."""
    empty = F.expr("cast(array() as array<string>)")
    whole = bind(
        F.split(text, LINE_BREAK),
        lambda x: F.when(F.element_at(x, -1) == "", F.slice(x, 1, F.size(x) - 1)).otherwise(x),
    )
    return F.when(text.isNull(), empty).otherwise(whole)


def _mentions(lowered: Column, words: list[str]) -> Column:
    """Plain substring test; much cheaper than the pattern it guards."""
    found = lowered.contains(words[0])
    for word in words[1:]:
        found = found | lowered.contains(word)
    return found


def redact_value(text: Column) -> Column:
    """Typed personal data replaced by typed placeholders."""
    out = F.regexp_replace(text, EMAIL, "[REDACTED:email]")
    out = F.regexp_replace(out, PHONE, "[REDACTED:phone]")
    out = F.regexp_replace(out, SSN, "[REDACTED:pii]")
    out = F.regexp_replace(out, PERSON_COLON, "$1$2: [REDACTED:person_name]")
    return F.regexp_replace(out, PERSON_DASH, "$1: [REDACTED:person_name]")


def contains_pii(text: Column) -> Column:
    return text.rlike(EMAIL) | text.rlike(PHONE) | text.rlike(SSN) | text.rlike(PERSON)


def _has_loose_digits(text: Column) -> Column:
    """A digit run of three or more that is neither grouped nor a year reads like an address or a contact."""
    return F.exists(
        F.regexp_extract_all(text, F.lit(DIGITS), F.lit(1)),
        lambda t: ~t.rlike("[.,]") & (F.length(t) > 2) & ~t.rlike(YEAR),
    )


def redact_line(text: Column) -> Column:
    """Struct(redacted, reason). ``redacted`` is NULL when the line has to stay local.

    The reason is the first personal-data type found. Lines without digits, ``@`` or a person label skip the
    replacement chain."""
    lowered = F.lower(text)
    person = _mentions(lowered, PERSON_WORDS) & text.rlike(PERSON)
    injected_text = _mentions(lowered, ["instructions", "approve"]) & text.rlike(INJECTION)
    plain = ~text.rlike(r"[\p{Nd}@]") & ~person
    no_mail = F.regexp_replace(text, EMAIL, "[REDACTED:email]")
    no_phone = F.regexp_replace(no_mail, PHONE, "[REDACTED:phone]")
    no_ssn = F.regexp_replace(no_phone, SSN, "[REDACTED:pii]")
    clean = redact_value(text)
    reason = (
        F.when(no_mail != text, "email")
        .when(no_phone != no_mail, "phone")
        .when(no_ssn != no_phone, "pii")
        .when(clean != no_ssn, "person_name")
    )
    local = F.struct(F.lit(None).cast("string").alias("redacted"), F.lit("UNSAFE_PII_LOCAL_ONLY").alias("reason"))
    injected = F.struct(F.lit(None).cast("string").alias("redacted"), F.lit("PROMPT_INJECTION_SUSPECT").alias("reason"))
    kept = F.struct(clean.alias("redacted"), reason.alias("reason"))
    untouched = F.struct(text.alias("redacted"), F.lit(None).cast("string").alias("reason"))
    return (
        F.when(injected_text, injected)
        .when(plain, untouched)
        .when(_has_loose_digits(clean), local)
        .otherwise(kept)
    )


def _metadata_reason(value: Column, max_chars: int) -> Column:
    """Why a redacted metadata value has to stay local; NULL if it may leave."""
    return F.when(F.length(value) > max_chars, "METADATA_TOO_LONG").when(
        contains_pii(value) | _has_loose_digits(value), "UNSAFE_PII_LOCAL_ONLY"
    )


def _redacted_metadata(metadata: Column) -> Column:
    kept = F.map_filter(metadata, lambda k, v: k.isin(METADATA_KEYS) & v.isNotNull())
    return F.transform_values(kept, lambda k, v: redact_value(v))


def metadata_allowlist(metadata: Column, max_chars: int = 200) -> Column:
    """Allow-listed document metadata only, redacted; long values and values that may still hold personal data stay local
    (``metadata_local_only`` says which and why)."""
    return F.map_filter(_redacted_metadata(metadata), lambda k, v: _metadata_reason(v, max_chars).isNull())


def metadata_local_only(metadata: Column, max_chars: int = 200) -> Column:
    """Key → reason of every allow-listed metadata value that has to stay local."""
    reasons = F.transform_values(_redacted_metadata(metadata), lambda k, v: _metadata_reason(v, max_chars))
    return F.map_filter(reasons, lambda k, v: v.isNotNull())


_GAP = r"[\s\p{Z}\x1c-\x1f\x85/,:\-_….]"


def _heading(aliases: list[str]) -> str:
    """Pattern for any alias with its words apart by white space or punctuation of any length."""
    spaced = [f"{_GAP}+".join(re.escape(w) for w in re.split(r"[ .]", a)) for a in aliases]
    return f"{_GAP}*(?:{'|'.join(spaced)})(?:{_GAP}|$)"


def section_code(line: Column) -> Column:
    """Code of the first section, in registry order, whose alias starts the line; else NULL."""
    expr = F.lit(None).cast("string")
    for code, aliases in reversed(SECTIONS.items()):
        expr = F.when(line.rlike(f"(?i)^{_heading(aliases)}"), F.lit(code)).otherwise(expr)
    return expr


def is_toc(lines: Column) -> Column:
    """A contents page: its title within the first twelve lines, and dotted leaders (two, or one with a usual word)."""
    filled = F.filter(F.transform(lines, lambda x: F.trim(x)), lambda x: x != "")
    head = F.lower(F.array_join(F.slice(filled, 1, 12), " "))
    dotted = F.filter(filled, lambda x: x.rlike(r"\.{3,}|…"))
    usual = F.exists(dotted, lambda x: F.lower(x).rlike("overview|summary|introduction|appendix"))
    return head.contains("contents") & ((F.size(dotted) >= 2) | usual)


NUMBER = (
    r"\$\s*[0-9]{1,3}(?:,[0-9]{3})*(?:\.[0-9]+)?|\b[0-9]{1,3}(?:,[0-9]{3})+(?:\.[0-9]+)?\b|\b[0-9]+\.[0-9]+\b|\b[0-9]+%"
)


def has_number(sentence: Column) -> Column:
    """Money, grouped, decimal or percent figures; plain years do not count."""
    return F.regexp_replace(sentence, r"\b(?:19|20)[0-9]{2}\b", " ").rlike(NUMBER)


def sentences(text: Column) -> Column:
    return F.filter(F.split(F.trim(text), r"(?<=[.!?])\s+"), lambda s: F.trim(s) != "")


def uncited_numbers(text: Column, complete_citations: Column) -> Column:
    """Sentences that state a number while no complete citation (artifact and row or period) exists."""
    empty = F.expr("cast(array() as array<string>)")
    return F.when(complete_citations > 0, empty).otherwise(F.filter(sentences(text), has_number))


def formula_unsafe(cell: Column) -> Column:
    """Text that a spreadsheet would run as a formula."""
    return F.coalesce(cell.rlike("^[=+@\t\r]"), F.lit(False))


def millage_t12_evidence(source: Column) -> Column:
    """A millage whose source names a T12 is not policy evidence."""
    return F.coalesce(source.rlike(r"(?i)t12|trailing[ _-]?twelve"), F.lit(False))
