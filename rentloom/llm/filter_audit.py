"""How five text filters act on each other in every order, counted with wide packed counters.

A document is reduced to a mask: which of the filters it fails, and whether it is good or toxic. For every mask there
is one big integer. Its fields of 64 bits hold what becomes of such a document at each of the 600 steps of the 120
orders (kept, removed, failed but removed earlier, good and lost, toxic and lost), what each filter alone catches, and
what each filter removes over all orders. The integers of a part are added up, each as often as its mask occurs, and
the sum is cut into its fields again. No field can run over: it is at most 120 times the rows of the part.

Masks need no text after the first pass. Whether a smaller id has the same text is told by 16-byte digests: rows are
counted per (digest, part, labels) before they move, so a text that a third of all rows repeat is a few rows per task.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache
from hashlib import blake2b
from itertools import permutations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from rentloom.llm.common import bounded_batches, own_columns, text_slices

LETTERS = "ABCDE"
ORDERS = ["".join(p) for p in permutations(LETTERS)]
STEPS = [(order, step) for order in ORDERS for step in range(1, len(LETTERS) + 1)]
DUPLICATE, GOOD, TOXIC = 16, 32, 64  # the bits of E and of both labels in a mask
MEASURES = ["kept", "removed", "redundant", "good_lost", "toxic_lost"]
FIELDS = len(MEASURES) * len(STEPS) + 2 * len(LETTERS)
FIELD_BYTES = 8
PIECE = 1 << 20

_SPACE = re.compile(rb"[\x20\x09-\x0d]")
_NOT_UPPER = bytes(c for c in range(256) if not 65 <= c <= 90)
_CONTINUATION = bytes(range(0x80, 0xC0))
_MARK = re.compile(rb"[#$%&*|]")


def _word_counts(text: bytes) -> tuple[int, int]:
    """Words and distinct words; a very long text is cut at white space, so its words are never all in memory."""
    if len(text) <= PIECE:
        words = text.split()
        return len(words), len(set(words))
    count, seen, start = 0, set(), 0
    while start < len(text):
        gap = _SPACE.search(text, start + PIECE)
        end = gap.start() if gap else len(text)
        words = text[start:end].split()
        count += len(words)
        seen.update(words)
        start = end
    return count, len(seen)


def failures(text: bytes) -> int:
    """The bits of filters A to D that a text fails: short, repetitive, shouting, holding marks."""
    words, distinct = _word_counts(text)
    upper = len(text.translate(None, _NOT_UPPER))
    points = len(text.translate(None, _CONTINUATION))
    return (
        (words < 50)
        | (100 * distinct < 65 * words) << 1
        | (100 * upper > 5 * points) << 2
        | (_MARK.search(text) is not None) << 3
    )


@lru_cache(maxsize=None)
def packed_outcomes(mask: int) -> int:
    """The big integer of a mask: 1 in each field whose outcome such a document has, and the orders in which each filter removes it."""
    fails = [bool(mask >> i & 1) for i in range(len(LETTERS))]
    good, toxic = bool(mask & GOOD), bool(mask & TOXIC)
    table = np.zeros((len(MEASURES), len(STEPS)), np.uint64)
    alone, shapley = np.zeros(len(LETTERS), np.uint64), np.zeros(len(LETTERS), np.uint64)
    for at, (order, step) in enumerate(STEPS):
        here = LETTERS.index(order[step - 1])
        earlier = any(fails[LETTERS.index(x)] for x in order[: step - 1])
        removed = fails[here] and not earlier
        table[:, at] = (not earlier and not removed, removed, fails[here] and earlier, removed and good, removed and toxic)
        shapley[here] += removed
    if sum(fails) == 1:
        alone[fails.index(True)] = 1
    return int.from_bytes(np.concatenate([table.ravel(), alone, shapley]).astype("<u8").tobytes(), "little")


def unpacked(total: int) -> dict[str, np.ndarray]:
    """The 600 values of every measure from a sum of big integers."""
    fields = np.frombuffer(total.to_bytes(FIELDS * FIELD_BYTES, "little"), "<u8").astype(np.int64)
    out = dict(zip(MEASURES, fields[: len(MEASURES) * len(STEPS)].reshape(len(MEASURES), -1)))
    filters = np.array([LETTERS.index(order[step - 1]) for order, step in STEPS])
    alone, shapley = fields[-2 * len(LETTERS) :].reshape(2, -1)
    return out | {"unique_fails": alone[filters], "shapley": shapley[filters]}


def marked(docs: DataFrame, part: str) -> DataFrame:
    """doc_id, part, mask of A to D and digest of each text; texts end here."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, texts in text_slices(batch, "text"):
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("doc_id").slice(a, b - a),
                        batch.column("part").slice(a, b - a),
                        pa.array([failures(t) for t in texts], pa.int32()),
                        pa.array([blake2b(t, digest_size=16).digest() for t in texts], pa.binary()),
                    ],
                    ["doc_id", "part", "mask", "digest"],
                )

    named = own_columns(docs, "doc_id", "text", part).toDF("doc_id", "text", "part")
    rows = named.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text", F.coalesce(F.col("part").cast("string"), F.lit("")).alias("part"))
    return rows.mapInArrow(run, "doc_id bigint, part string, mask int, digest binary")


def masks(docs: DataFrame, labels: DataFrame, part: str = "source") -> DataFrame:
    """(part, mask, n): how many rows of a part have each mask, at most 128 rows a part."""
    known = labels.filter("doc_id is not null").groupBy(F.col("doc_id").cast("bigint").alias("id"))
    known = known.agg(
        F.coalesce(F.max((F.col("quality") == 1).cast("int")), F.lit(0)).alias("good"),
        F.coalesce(F.max((F.col("toxic") == 1).cast("int")), F.lit(0)).alias("toxic"),
    ).withColumn("present", F.lit(True))
    rows = marked(docs, part)
    # Rows without an id have no label; they are dealt by their text so that they do not meet in one task.
    rows = rows.withColumn("present", F.col("doc_id").isNotNull()).withColumn("id", F.coalesce("doc_id", F.xxhash64("digest")))
    flags = F.col("mask") + F.coalesce(F.col("good") * GOOD + F.col("toxic") * TOXIC, F.lit(0))
    rows = rows.join(known, ["id", "present"], "left").select("id", "present", "part", "digest", flags.alias("mask"))
    # Counted per id first: those with the smallest id of their text do not fail E, however often they repeat.
    rows = rows.groupBy("id", "present", "part", "digest", "mask").agg(F.count("*").alias("n"))
    own = F.when(F.col("present"), F.col("id"))
    texts = rows.groupBy("digest", "part", "mask").agg(
        F.sum("n").alias("n"),
        F.sum(F.when(~F.col("present"), F.col("n")).otherwise(F.lit(0))).alias("without_id"),
        F.min(own).alias("least"),
        F.min_by("n", own).alias("at_least"),
    )
    first = F.min("least").over(Window.partitionBy("digest"))
    texts = texts.withColumn("first", F.coalesce(F.when(F.col("least") == first, F.col("at_least")), F.lit(0)) + F.col("without_id"))
    split = F.array(
        F.struct(F.col("mask").alias("mask"), F.col("first").alias("n")),
        F.struct((F.col("mask") + DUPLICATE).alias("mask"), (F.col("n") - F.col("first")).alias("n")),
    )
    counted = texts.select("part", F.explode(split).alias("_s")).filter("_s.n > 0")
    return counted.groupBy("part", F.col("_s.mask").alias("mask")).agg(F.sum("_s.n").alias("n"))


def audit(docs: DataFrame, labels: DataFrame, part: str = "source") -> DataFrame:
    """part, filter_order, step and counts of five filters in all 120 orders: 600 rows for each value of ``part``.

    A text fails A with under 50 words, B if 100 · distinct words < 65 · words, C if 100 · upper-case A-Z > 5 · code
    points, D if it holds any of ``#$%&*|``, E if a row with a smaller doc_id has the same text. kept counts the rows
    left after the step, removed those it removes, redundant those that fail its filter but went earlier, unique_fails
    those that fail its filter only, good_lost and toxic_lost those of removed with label quality = 1 and toxic = 1,
    shapley what its filter removes in all 120 orders together.

    A null text is empty, a null part the empty string. Repeated rows count each and do not make each other fail E. A
    row with a null id has no label, does not fail E and makes nobody fail it. An id labelled twice is good or toxic if
    one of its labels says so; null labels say nothing. No rows give no parts. Other columns are not read.
    """
    bounded_batches(docs.sparkSession)

    def run(table: pa.Table) -> pa.Table:
        total = sum(packed_outcomes(mask) * n for mask, n in zip(table.column("mask").to_pylist(), table.column("n").to_pylist()))
        counts = unpacked(total)
        orders, steps = zip(*STEPS)
        columns = {"part": [table.column("part")[0].as_py()] * len(STEPS), "filter_order": orders, "step": pa.array(steps, pa.int32())}
        return pa.table(columns | {name: counts[name] for name in RESULT})

    schema = ", ".join(["part string, filter_order string, step int", *(f"{name} bigint" for name in RESULT)])
    return masks(docs, labels, part).groupBy("part").applyInArrow(run, schema)


RESULT = ["kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]
