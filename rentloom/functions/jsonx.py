"""JSON trees as flat rows: pointers, types and values; subset matching; authority claims."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

LEAF = "array<struct<pointer:string,kind:string,value:string>>"


def flatten_json(text: Column | str, whole_lists: bool = False) -> Column:
    """Every node of a JSON value as (pointer, kind, value); NULL for text that is not JSON, and one node of kind
    ``refused`` for a value nested too deep to read. With ``whole_lists`` a
    list is one node holding its own text.

    Nesting has no fixed depth, which SQL functions cannot follow, so this runs in Arrow batches. The function is
    built here so that executors receive it by value and need no copy of this package."""

    def walk(node: object, at: str):
        if isinstance(node, dict):
            yield at, "object", None
            for key, child in node.items():
                yield from walk(child, at + "/" + str(key).replace("~", "~0").replace("/", "~1"))
        elif isinstance(node, list) and whole_lists:
            yield at, "array", json.dumps(node, sort_keys=True, separators=(",", ":"), ensure_ascii=False)
        elif isinstance(node, list):
            yield at, "array", str(len(node))
            for i, child in enumerate(node):
                yield from walk(child, f"{at}/{i}")
        elif isinstance(node, bool):
            yield at, "boolean", "true" if node else "false"
        elif node is None:
            yield at, "null", None
        elif isinstance(node, str):
            yield at, "string", node
        else:
            yield at, "integer" if isinstance(node, int) else "number", repr(node)

    def one(text: str | None):
        try:
            return [{"pointer": p, "kind": k, "value": v} for p, k, v in walk(json.loads(text), "")]
        except (TypeError, ValueError):
            return None
        except RecursionError:
            return [{"pointer": "", "kind": "refused", "value": "JSON_TOO_DEEP"}]

    def flatten(texts: pd.Series) -> pd.Series:
        return texts.map(one)

    return F.pandas_udf(flatten, LEAF)(text)


def numeric_leaves(nodes: Column) -> Column:
    """Nodes that are numbers, or text made of digits with at most one dot."""
    return F.filter(
        nodes,
        lambda n: n["kind"].isin("integer", "number")
        | ((n["kind"] == "string") & n["value"].rlike(r"^([0-9]+\.?[0-9]*|\.[0-9]+)$")),
    )


def subset_match(expected: Column, observed: Column) -> Column:
    """Every expected node occurs in the observed tree with the same kind and value; lists keep order and length."""
    missing = F.array_except(expected, observed)
    return F.coalesce(F.size(missing) == 0, F.lit(False))


def json_pointer(text: Column, pointer: Column) -> Column:
    """Struct(value, error_code) at an RFC 6901 pointer. A null or absent leaf is missing evidence."""
    bad = ~((pointer == "") | pointer.startswith("/")) | pointer.rlike("~(?![01])")
    parts = F.filter(F.split(pointer, "/"), lambda t: t.isNotNull())
    tokens = F.transform(
        F.slice(parts, 2, F.greatest(F.size(parts) - 1, F.lit(0))),
        lambda t: F.regexp_replace(F.regexp_replace(t, "~1", "/"), "~0", "~"),
    )

    def path(by_index: bool) -> Column:
        steps = F.transform(
            tokens,
            lambda t: F.when(t.rlike("^(0|[1-9][0-9]*)$") & F.lit(by_index), F.concat(F.lit("["), t, F.lit("]"))).otherwise(
                F.concat(F.lit("['"), t, F.lit("']"))
            ),
        )
        return F.concat(F.lit("$"), F.array_join(steps, ""))

    found = F.coalesce(*[F.call_function("get_json_object", text, path(by)) for by in (True, False)])
    value = F.when(pointer == "", text).otherwise(found)
    code = F.when(bad, "INVALID_LOCATOR").when(value.isNull(), "EVIDENCE_INCOMPLETE")
    return F.struct(F.when(code.isNull(), value).alias("value"), code.alias("error_code"))


# Keys and words that claim an authority a snapshot cannot have.
CLAIM_KEYS = ["approved", "scope_approved", "certified", "eligible", "live_authorized", "reviewed_pass"]
CLAIM_WORDS = ["approved", "APPROVED", "certified", "CERTIFIED", "PASS"]


def spoofed_authority(nodes: Column) -> Column:
    """Any nested approval, certification or eligibility claim."""

    def claims(n: Column) -> Column:
        key = F.element_at(F.split(n["pointer"], "/"), -1)
        given = n["kind"] != "null"
        denied = (n["kind"] == "boolean") & (n["value"] == "false")
        return (
            (key.isin(CLAIM_KEYS) & given & ~F.coalesce(denied, F.lit(False)))
            | (key.isin("status", "state") & (n["kind"] == "string") & n["value"].isin(CLAIM_WORDS))
            | (key.isin("approval", "human_approval") & given)
        )

    return F.coalesce(F.exists(nodes, lambda n: F.coalesce(claims(n), F.lit(False))), F.lit(False))
