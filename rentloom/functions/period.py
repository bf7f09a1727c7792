"""Month arithmetic on ``YYYY-MM`` labels, through one integer per month."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# English month names as they occur in statement headers.
MONTHS = [
    "january", "february", "march", "april", "may", "june",
    "july", "august", "september", "october", "november", "december",
]
_BY_NAME = {
    **{name[:3]: f"{i:02d}" for i, name in enumerate(MONTHS, 1)},
    **{name: f"{i:02d}" for i, name in enumerate(MONTHS, 1)},
}
PERIOD = r"^[0-9]{4}-(0[1-9]|1[0-2])$"


def _lookup(table: dict[str, str], key: Column) -> Column:
    pairs = [F.lit(x) for kv in table.items() for x in kv]
    return F.try_element_at(F.create_map(*pairs), key)


def month_idx(label: Column) -> Column:
    """Months since year 0 for a ``YYYY-MM`` label; NULL for anything else."""
    ok = label.rlike(PERIOD)
    return F.when(
        ok,
        F.substring(label, 1, 4).try_cast("int") * 12 + F.substring(label, 6, 2).try_cast("int") - 1,
    )


def month_label(idx: Column) -> Column:
    year = F.lpad(F.floor(idx / 12).cast("int").cast("string"), 4, "0")
    return F.concat(year, F.lit("-"), F.lpad((idx % 12 + 1).cast("string"), 2, "0"))


def period_window(end: Column, n: int = 12) -> Column:
    """Array of the n month labels that end with ``end``."""
    last = month_idx(end)
    return F.transform(F.sequence(last - (n - 1), last), month_label)


def month_range(first: Column, last: Column) -> Column:
    """Array of labels from first to last; NULL if reversed, malformed or longer than 12 months."""
    a, b = month_idx(first), month_idx(last)
    ok = (a <= b) & (b - a <= 11)
    return F.when(ok, F.transform(F.sequence(a, F.greatest(a, b)), month_label))


def overlap_months(end: Column, prior_end: Column) -> Column:
    return F.when(
        month_idx(end).isNotNull() & month_idx(prior_end).isNotNull(),
        F.greatest(F.lit(0), 12 - F.abs(month_idx(end) - month_idx(prior_end))),
    )


def month_key(header: Column) -> Column:
    """``Jan 2026``, ``Sept-2026``, ``2026-01``, ``2026-01-31`` or ``1/31/2026`` to ``2026-01``; else NULL."""
    text = F.trim(header)
    named = r"^([A-Za-z]{3,9})[\s-]+(20[0-9]{2})$"
    iso = r"^(20[0-9]{2})-(0[1-9]|1[0-2])(-(0[1-9]|[12][0-9]|3[01]))?$"
    us = r"^(0?[1-9]|1[0-2])/(0?[1-9]|[12][0-9]|3[01])/(20[0-9]{2})$"
    month = _lookup({**_BY_NAME, "sept": "09"}, F.lower(F.regexp_extract(text, named, 1)))
    return (
        F.when(text.rlike(named), F.concat(F.regexp_extract(text, named, 2), F.lit("-"), month))
        .when(text.rlike(iso), F.substring(text, 1, 7))
        .when(
            text.rlike(us),
            F.concat(
                F.regexp_extract(text, us, 3), F.lit("-"), F.lpad(F.regexp_extract(text, us, 1), 2, "0")
            ),
        )
    )


def parse_period(text: Column) -> Column:
    """Feed periods: text with a dash in fifth place keeps its first seven characters; ``Mon YYYY`` is read;
    anything else stays as it is."""
    trimmed = F.trim(text)
    spaced = F.trim(F.regexp_replace(F.translate(trimmed, ",", " "), r"\s+", " "))
    worded = r"^(\S+) ([0-9]+)$"
    month = _lookup(
        {k: v for k, v in _BY_NAME.items() if len(k) == 3},
        F.lower(F.substring(F.regexp_extract(spaced, worded, 1), 1, 3)),
    )
    year = F.regexp_extract(spaced, worded, 2)
    return (
        F.when((F.length(trimmed) >= 7) & (F.substring(trimmed, 5, 1) == "-"), F.substring(trimmed, 1, 7))
        .when(
            spaced.rlike(worded) & month.isNotNull(),
            F.concat(F.when(F.length(year) < 4, F.lpad(year, 4, "0")).otherwise(year), F.lit("-"), month),
        )
        .otherwise(trimmed)
    )


def month_end(label: Column) -> Column:
    """Last calendar day of the month."""
    return F.last_day(F.try_to_date(F.concat(label, F.lit("-01")), "yyyy-MM-dd"))
