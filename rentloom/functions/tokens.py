"""Vocabulary of rent rolls and statements: header keys, status, use and charge words, unit ids, row and column roles."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from rentloom.functions.period import month_key

# Status words of each layout.
BASE_STATUS = {
    "occupied": ["occupied", "current", "notice", "notice rented", "notice unrented"],
    "vacant": ["vacant", "vacant rented", "vacant unrented"],
    "down": ["down", "offline", "out of service"],
}
STATUS = {
    "standard": BASE_STATUS,
    "ledger": {**BASE_STATUS, "vacant": [*BASE_STATUS["vacant"], "vacant leased", "vacant not leased"]},
    "onesite": {"occupied": ["occupied", "occupied ntv", "occupied ntvl"], "vacant": ["vacant", "vacant leased"]},
    "supplement": {
        "occupied": ["occupied", "current", "notice"],
        "vacant": ["vacant"],
        "down": ["down", "offline", "out of service"],
    },
}
USE = {"residential": ["residential", "apartment"], "commercial": ["commercial", "retail", "office"]}
FUTURE_STATUS = ["applicant", "future", "future resident", "future tenant"]

# Charge words by category, with what single layouts add.
CHARGES = {
    "parking": ["park", "parking", "garage", "carport", "space", "lot", "covered parking", "reserved parking"],
    "pet": ["pet", "pet rent", "petrent", "pet fee", "animal", "dog", "cat"],
    "storage": ["stor", "storage", "locker", "storage locker"],
    "utilities": [
        "util", "utility", "water", "sewer", "trash", "electric", "gas", "rubs", "cable", "tech", "valet trash", "pest",
    ],
    "washer_dryer": ["washer", "dryer", "w/d", "wd", "w d", "laundry", "appliance"],
    "concessions": ["conc", "concession", "discount", "free rent", "credit"],
}
MORE_CHARGES = {
    "ledger": {"utilities": ["cam"]},
    "compact": {
        "storage": ["bike storage"],
        "concessions": ["model concession"],
        "insurance": ["damage waiver", "damage waiver program", "insurance", "renters insurance", "liability"],
    },
}
RENT_WORDS = [
    "rent", "base", "base rent", "baserent", "mrent", "market rent", "apt rent", "aptr", "lease rent", "resrent",
    "contract rent",
]
BASE_RENT = {
    "lease_charge": [*RENT_WORDS, "lease"],
    "ledger": RENT_WORDS,
    "compact": [*[w for w in RENT_WORDS if w != "base"], "market + addl.", "market addl"],
    "pdf": [*RENT_WORDS, "actual rent", "resident rent"],
}
NOT_A_CHARGE = {
    "ledger": [
        "lease", "lease id", "lease start", "lease end", "lease term", "resh id", "resident id", "tenant id", "move in",
        "move out", "expected move out", "balance", "deposit", "deposit held", "bldg unit", "unit type", "unit status",
        "resident", "ledger", "total", "totals", "totals:", "grand total", "report total", "summary",
    ],
    "compact": [
        "lease id", "lease start", "lease end", "lease term", "resh id", "resident id", "tenant id", "move in",
        "move out", "balance", "required deposit", "dep on hand", "deposit", "total", "totals", "grand total",
        "report total", "summary",
    ],
    "pdf": [
        "lease id", "lease start", "lease end", "lease term", "move in", "move out", "balance", "deposit", "expiration",
    ],
}
TOTAL_LABELS = ["TOTAL", "SUBTOTAL", "NET OPERATING INCOME", "NET INCOME", "EFFECTIVE GROSS INCOME"]
DESCRIPTORS = [
    "notes", "note", "comments", "comment", "memo", "description", "descr", "gl account", "gl", "account code",
    "acct code", "account", "code", "property", "property id", "property name", "portfolio", "region", "floor", "suite",
    "wing", "category", "type",
]
CUMULATIVE = r"(?i)\b(ytd|year[\s-]*to[\s-]*date|totals?|cumulative|annual|yearly)\b"
UNIT_ID = r"^([A-Z]{1,3}-?)?[0-9]{1,4}[A-Z]?$"


def header_key(text: Column, variant: str = "space") -> Column:
    """Comparable header text: lower case, with white space (``space``) or also punctuation collapsed.

    ``ledger`` also collapses dots and backslashes; ``punctuation`` does not. Spaces of every script count."""
    more = {"space": "", "punctuation": "/,:_-", "ledger": r"/,:\\_.-"}[variant]
    return F.trim(F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), rf"[\s\p{{Z}}\x1c-\x1f\x85{more}]+", " "))


def _word_map(groups: dict[str, list[str]], key: Column) -> Column:
    pairs = [F.lit(x) for value, words in groups.items() for word in words for x in (word, value)]
    return F.try_element_at(F.create_map(*pairs), key)


def _starts_as(key: Column, words: list[str]) -> Column:
    return key.rlike("^(" + "|".join(re.escape(w) for w in words) + ")( |$)")


def status_token(text: Column, layout: str = "standard") -> Column:
    """occupied / vacant / down, or NULL for a word the layout does not know (model and admin included)."""
    if layout == "lease_charge":
        key = header_key(text, "punctuation")
        return (
            F.when((key == "") | key.isin("vacant", "vacant rented", "vacant unrented"), "vacant")
            .when(key.isin("down", "offline", "out of service"), "down")
            .when(~key.isin("model", "admin"), "occupied")
        )
    if layout == "pdf":
        key = header_key(text, "punctuation")
        return (
            F.when(key == "", "vacant")
            .when(_starts_as(key, ["model", "admin"]), F.lit(None))
            .when(_starts_as(key, ["vacant", "unrented", "vac"]), "vacant")
            .when(_starts_as(key, ["down", "offline", "out of service"]), "down")
            .otherwise("occupied")
        )
    return _word_map(STATUS[layout], header_key(text, "ledger" if layout == "ledger" else "space"))


def use_token(text: Column) -> Column:
    """residential / commercial from an explicit use word; a floor plan never decides use."""
    return _word_map(USE, header_key(text))


def classify_charge(code: Column, layout: str) -> Column:
    """Charge category by layout. Lease-charge rolls test base rent first and exactly, and end in
    ``other_ancillary``; the others test ancillary words first and end in ``unknown``."""
    key = header_key(code, "ledger" if layout == "ledger" else "punctuation")
    more = MORE_CHARGES.get(layout, {})
    categories = {c: [*CHARGES.get(c, []), *more.get(c, [])] for c in [*CHARGES, *[m for m in more if m not in CHARGES]]}

    def mentions(words: list[str]) -> Column:
        alternatives = "|".join(re.escape(w) for w in words)
        return key.rlike(f"^({alternatives})( |$)| ({alternatives})$")

    base = BASE_RENT[layout]
    if layout == "lease_charge":
        expr = F.when(F.coalesce(code, F.lit("")) == "", "unknown").when(key.isin(base), "base_rent")
        for category, words in categories.items():
            expr = expr.when(mentions(words), category)
        return expr.otherwise("other_ancillary")
    expr = F.when((key == "") | key.isin(NOT_A_CHARGE[layout]), "unknown")
    for category, words in categories.items():
        expr = expr.when(mentions(words), category)
    is_base = key.isin(base) | mentions([w for w in base if layout != "pdf" or " " in w])
    return expr.when(is_base, "base_rent").otherwise("unknown")


def valid_unit_id(text: Column) -> Column:
    return F.coalesce(text.rlike(UNIT_ID), F.lit(False))


def row_kind(label: Column, has_month_cells: Column, is_mapped: Column) -> Column:
    """blank / unlabeled / total / section / line_item."""
    blank = label.isNull() | (F.trim(label) == "")
    upper = F.upper(label)
    total = upper.rlike("^(" + "|".join(TOTAL_LABELS) + ")")
    return (
        F.when(blank & ~has_month_cells, "blank")
        .when(blank, "unlabeled")
        .when(total, "total")
        .when(~has_month_cells & ~is_mapped, "section")
        .otherwise("line_item")
    )


def column_role(
    header: Column, is_label: Column, first_month: Column, last_month: Column, override: Column, has_data: Column
) -> Column:
    """Struct(role, month, error_code) of one statement column."""
    text = F.trim(header)
    month = month_key(header)
    inside = (month >= first_month) & (month <= last_month)
    error = F.when(
        ~is_label & month.isNotNull(),
        F.when(inside & override.isNotNull(), "EXCLUDED_MONTH_COLUMN").when(
            ~inside & ~override.eqNullSafe(F.lit("excluded")), "MONTH_OUTSIDE_WINDOW"
        ),
    )
    role = (
        F.when(is_label, "label")
        .when(month.isNotNull() & inside, "month")
        .when(month.isNotNull(), "excluded")
        .when(override.isNotNull(), override)
        .when(text.rlike(CUMULATIVE), "cumulative")
        .when(F.lower(text).isin(DESCRIPTORS), "descriptor")
        .when(has_data | text.isNotNull(), "unrecognized")
        .otherwise("empty")
    )
    return F.struct(role.alias("role"), F.when(role == "month", month).alias("month"), error.alias("error_code"))


NUMBER = r"^-?[0-9,]+(\.[0-9]+)?$"
DATE = r"^([0-9]{1,2}/[0-9]{1,2}/[0-9]{2,4}|[0-9]{4}-[0-9]{2}-[0-9]{2})$"


def parse_rent_line(text: Column) -> Column:
    """One printed rent-roll line as a struct, read from the right: balance, dates, amounts, then the name.

    NULL when the line has fewer than four words, or its third or last word is not a number."""
    from rentloom.functions.money import bind

    def leading(words: Column, pattern: str) -> Column:
        stop = F.array_position(F.transform(words, lambda w: ~w.rlike(pattern)), True)
        return F.when(stop == 0, F.size(words)).otherwise(stop - 1).cast("int")

    def rest(words: Column, start: Column) -> Column:
        return F.slice(words, start + 1, F.greatest(F.size(words) - start, F.lit(0)))

    def tail(words: Column) -> Column:
        back = F.reverse(F.slice(words, 4, F.greatest(F.size(words) - 3, F.lit(0))))
        return F.struct(words.alias("words"), rest(back, F.lit(1)).alias("after"))

    def dated(t: Column) -> Column:
        n = leading(t["after"], DATE)
        return F.struct(
            t["words"].alias("words"), F.slice(t["after"], 1, n).alias("dates"), rest(t["after"], n).alias("after")
        )

    def paid(t: Column) -> Column:
        n = leading(t["after"], NUMBER)
        amounts = F.reverse(F.slice(t["after"], 1, n))
        words = t["words"]
        return F.struct(
            F.get(words, F.lit(0)).alias("unit_id"),
            F.get(words, F.lit(1)).alias("unit_type"),
            F.get(words, F.lit(2)).alias("sq_ft"),
            F.array_join(F.reverse(rest(t["after"], n)), " ").alias("resident_name"),
            F.coalesce(F.get(amounts, F.lit(1)), F.get(amounts, F.lit(0)), F.lit("0.00")).alias("resident_rent"),
            amounts.alias("amounts"),
            F.reverse(t["dates"]).alias("dates"),
            F.element_at(words, -1).alias("balance"),
        )

    clean = F.trim(F.regexp_replace(text, r"\s+", " "))
    looks = clean.rlike(r"^\S+ \S+ -?[0-9,]+(\.[0-9]+)? ") & F.element_at(F.split(clean, " "), -1).rlike(NUMBER)
    return F.when(looks, bind(F.split(clean, " "), lambda w: bind(tail(w), lambda t: bind(dated(t), paid))))
