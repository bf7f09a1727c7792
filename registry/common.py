"""Small helpers shared by the query registers."""

from __future__ import annotations

from pyspark.sql import functions as F

from registry.sqltext import with_views
from rentloom.functions.money import money_text


class Register(dict):
    """name → (Spark callable, SQL or None)."""

    def entry(self, name: str, sql: str | None = None):
        def add(fn):
            self[name] = (fn, None if sql is None else with_views(sql))
            return fn

        return add


def m(expr: str, alias: str, scale: int = 2) -> str:
    """SQL: exact decimal text."""
    return f"cast(cast({expr} as decimal(38,{scale})) as varchar) as {alias}"


def texts(df, *names, scale=2):
    """Decimal columns as exact decimal text."""
    return df.withColumns({n: money_text(F.col(n), scale) for n in names})
