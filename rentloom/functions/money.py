"""Money: text to exact decimal, with typed reasons when the text is not one amount."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from rentloom.functions.refusal import first_failure

# Texts that mean "no amount known", and the currency marks that are understood.
UNKNOWN_TEXT = ["", "n/a", "na", "unknown", "none", "null", "-", "--", "—"]
CURRENCY_SYMBOLS = {"$": "USD", "€": "EUR", "£": "GBP"}
CURRENCY_CODES = ["USD", "EUR", "GBP"]

PLAIN_DECIMAL = r"^-?(0|[1-9][0-9]{0,15})(\.[0-9]{1,8})?$"
GL_DECIMAL = r"^-?(0|[1-9][0-9]{0,16})(\.[0-9]{1,8})?$"

_NEGATIVE = r"^\((.+)\)$|^-(.+)$"
_WHOLE = r"^[0-9]+$"
_US_GROUPED = r"^[1-9][0-9]{0,2}(,[0-9]{3})+\.[0-9]+$"
_EU_GROUPED = r"^[1-9][0-9]{0,2}(\.[0-9]{3})+,[0-9]+$"
_DOT_FRACTION = r"^[0-9]+\.([0-9]{1,2}|[0-9]{4,})$"
# Most amounts are plain; they need no further step.
_SIMPLE = r"^-?(0|[1-9][0-9]{0,15})(\.([0-9]{1,2}|[0-9]{4,8}))?$"
_COMMA_FRACTION = r"^[0-9]+,[0-9]{1,2}$"


def is_unknown_text(text: Column) -> Column:
    return text.isNull() | F.lower(F.trim(text)).isin(UNKNOWN_TEXT)


def _currency_mark(body: Column) -> tuple[Column, Column]:
    """(currency code or NULL, body without the mark). One mark at either end, symbols first."""
    code = F.lit(None).cast("string")
    rest = body
    for iso in reversed(CURRENCY_CODES):
        at_start = body.rlike(rf"^{iso}( |$)")
        at_end = body.rlike(rf"(^| ){iso}$")
        code = F.when(at_start | at_end, F.lit(iso)).otherwise(code)
        rest = (
            F.when(at_start, F.trim(F.regexp_replace(body, rf"^{iso}", "")))
            .when(at_end, F.trim(F.regexp_replace(body, rf"{iso}$", "")))
            .otherwise(rest)
        )
    for symbol, iso in reversed(CURRENCY_SYMBOLS.items()):
        at_start, at_end = body.startswith(symbol), body.endswith(symbol)
        code = F.when(at_start | at_end, F.lit(iso)).otherwise(code)
        rest = (
            F.when(at_start, F.trim(F.substring(body, 2, 1_000_000)))
            .when(at_end, F.trim(F.regexp_replace(body, rf"\Q{symbol}\E$", "")))
            .otherwise(rest)
        )
    return code, rest


def bind(value: Column, body) -> Column:
    """Evaluate ``value`` once and hand it to ``body``; keeps deep expressions from being copied at every use."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _unsigned(text: Column) -> Column:
    trimmed = F.trim(text)
    return F.struct(
        trimmed.rlike(_NEGATIVE).alias("negative"),
        F.trim(F.regexp_replace(trimmed, _NEGATIVE, "$1$2")).alias("body"),
    )


def _unmarked(part: Column) -> Column:
    code, number = _currency_mark(part["body"])
    bare = F.struct(
        part["negative"].alias("negative"), F.lit(None).cast("string").alias("code"), part["body"].alias("number")
    )
    marked = F.struct(part["negative"].alias("negative"), code.alias("code"), number.alias("number"))
    return F.when(part["body"].rlike("^[0-9.,]+$"), bare).otherwise(marked)


def _plain(part: Column) -> Column:
    number = part["number"]
    plain = (
        F.when(number.rlike(_US_GROUPED), F.regexp_replace(number, ",", ""))
        .when(number.rlike(_EU_GROUPED), F.regexp_replace(F.regexp_replace(number, r"\.", ""), ",", "."))
        .when(number.rlike(f"{_WHOLE}|{_DOT_FRACTION}|{_COMMA_FRACTION}"), F.regexp_replace(number, ",", "."))
    )
    return F.struct(
        part["negative"].alias("negative"), part["code"].alias("code"), number.alias("number"), plain.alias("plain")
    )


def _judged(part: Column, unknown: Column, wanted: Column) -> Column:
    number, plain, found = part["number"], part["plain"], part["code"]
    error = first_failure(
        (unknown, "UNKNOWN_AMOUNT_NOT_ZERO"),
        (~F.coalesce(wanted.rlike("^[A-Z]{3}$"), F.lit(False)), "INVALID_OBSERVATIONS"),
        (found.isNotNull() & (found != wanted), "INVALID_OBSERVATIONS"),
        ((number == "") | number.rlike(r"\s"), "AMBIGUOUS_NUMERIC_FORMAT"),
        (number.rlike(r"(?i)[ex]|inf|nan"), "INVALID_OBSERVATIONS"),
        (plain.isNull() | plain.rlike(r"^0[0-9]"), "AMBIGUOUS_NUMERIC_FORMAT"),
        (plain.rlike(r"^[0-9]{17}|\.[0-9]{9}"), "INVALID_OBSERVATIONS"),
    )
    signed = F.when(error.isNull(), F.concat(F.when(part["negative"], F.lit("-")).otherwise(F.lit("")), plain))
    return F.struct(
        signed.try_cast("decimal(24,8)").alias("amount"),
        signed.alias("amount_text"),
        F.when(error.isNull(), wanted).alias("currency"),
        error.alias("error_code"),
    )


def parse_money(text: Column, currency: Column | str = "USD") -> Column:
    """Struct(amount DECIMAL(24,8), amount_text, currency, error_code).

    Blank-like text is an unknown amount (UNKNOWN_AMOUNT_NOT_ZERO), never zero. One separator followed by
    exactly three digits could be a thousands or a decimal mark and is refused as ambiguous.
    """
    wanted = F.lit(currency) if isinstance(currency, str) else currency
    unknown = is_unknown_text(text)
    trimmed = F.trim(text)
    direct = F.struct(
        trimmed.try_cast("decimal(24,8)").alias("amount"),
        trimmed.alias("amount_text"),
        wanted.alias("currency"),
        F.lit(None).cast("string").alias("error_code"),
    )
    steps = bind(
        _unsigned(text),
        lambda a: bind(_unmarked(a), lambda b: bind(_plain(b), lambda c: _judged(c, unknown, wanted))),
    )
    simple = trimmed.rlike(_SIMPLE) & wanted.rlike("^[A-Z]{3}$")
    return F.when(F.coalesce(simple, F.lit(False)), direct).otherwise(steps)


def parse_amount_lenient(text: Column) -> Column:
    """Feed amounts: drop ``$`` and ``,``, parentheses mean minus; blank or dash is 0 (the one such place)."""
    bare = F.translate(F.trim(text), "($,)", "-")
    return F.when(bare.isin("", "-", "—"), F.lit("0")).otherwise(bare).try_cast("decimal(18,2)")


def canonical_amount(value: Column, kind: str) -> Column:
    """Struct(amount DECIMAL(38,8), error_code) for a backend amount of kind int, double or text."""
    if kind == "int":
        return F.struct(value.cast("decimal(38,8)").alias("amount"), F.lit(None).cast("string").alias("error_code"))
    if kind == "double":
        magnitude = F.abs(value)
        error = first_failure(
            (value.isNull(), "INVALID_INPUT"),
            (F.isnan(value) | (magnitude == float("inf")), "INVALID_INPUT"),
            ((magnitude >= 1e16) | ((magnitude < 1e-15) & (magnitude > 0)), "INPUT_LIMIT_EXCEEDED"),
        )
        parsed = value.cast("string").try_cast("decimal(38,18)")
    else:
        error = first_failure((value.isNull() | ~value.rlike(GL_DECIMAL), "INVALID_INPUT"))
        parsed = value.try_cast("decimal(38,18)")
    return F.struct(F.when(error.isNull(), parsed).alias("amount"), error.alias("error_code"))


def cents_to_decimal(cents: Column) -> Column:
    """Integer cents to exact dollars."""
    return (cents.cast("decimal(36,0)") * F.lit("0.01").cast("decimal(3,2)")).cast("decimal(38,2)")


def opening_amount(text: Column, deleted: Column) -> Column:
    """Struct(amount DECIMAL(18,2), error_code): at most two decimals, |x| ≤ 1e12; a tombstone carries none."""
    parsed = text.try_cast("decimal(30,2)")
    error = first_failure(
        (deleted & text.isNotNull(), "INVALID_CONTRACT"),
        (~deleted & text.isNull(), "INVALID_CONTRACT"),
        (~deleted & ~text.rlike(r"^-?(0|[1-9][0-9]*)(\.[0-9]{1,2})?$"), "INVALID_CONTRACT"),
        (~deleted & (parsed.isNull() | (F.abs(parsed) > F.lit(10**12))), "INPUT_LIMIT_EXCEEDED"),
    )
    return F.struct(F.when(error.isNull(), parsed.try_cast("decimal(18,2)")).alias("amount"), error.alias("error_code"))


def is_nonzero(amount: Column) -> Column:
    return F.coalesce(amount != 0, F.lit(False))


def money_text(amount: Column, scale: int = 2) -> Column:
    """Decimal text with a fixed number of decimals."""
    return amount.cast(f"decimal(38,{scale})").cast("string")


def display_cents(amount: Column) -> Column:
    """Round to cents, half to even."""
    return F.bround(amount, 2).cast("decimal(38,2)")
