"""Sequence packing by non-negative least squares over the histogram of piece lengths.

Documents are cut at multiples of the window, so only one piece of each is shorter than it. Shallow combinations of
lengths that fill a window are enumerated, their repeat counts solved against the histogram, rounded down, and what is
left is packed greedily on counts. The histogram has at most ``window`` rows and the plan a number of rows bounded by
the window, however large the corpus; pieces find their place by rank within their length.
"""

from __future__ import annotations

import os
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from rentloom.llm.bpe import Encoder
from rentloom.llm.common import Stages, bounded_batches, giving_back, own_columns, text_slices

WINDOW = 1024


def library_words(path: str, at_once: int = 1000):
    """words → ids by the tokenizers library, a few at a time; special strings in a text are ordinary text."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark's tasks are the parallelism; threads would only hold memory
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    tokenizer.encode_special_tokens = True

    def of(words: list[bytes]) -> list[list[int]]:
        out: list[list[int]] = []
        for at in range(0, len(words), at_once):
            some = [w.decode() for w in words[at : at + at_once]]
            out += [e.ids for e in tokenizer.encode_batch_fast(some, add_special_tokens=False)]
        return out

    return of


def cut(df: DataFrame, tokenizer_path: str, window: int = WINDOW, key: str = "doc_id", text: str = "text", last_id: int = 0) -> DataFrame:
    """Pieces of every whole text: key, start, length, doc_tokens, ids (packed little-endian unsigned 32-bit), part, nth.

    ``last_id`` ends each document; a null or empty text is that id alone. ``nth`` counts the pieces of one length in the
    task ``part``. Repeated rows give repeated pieces, a null key stays null, other columns are left out. Texts are
    tokenized in slices of many; equal words are tokenized once by the library.
    """
    bounded_batches(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(library_words(tokenizer_path))
        seen: Counter = Counter()
        part = TaskContext.get().partitionId()
        for batch in batches:
            for a, b, texts in text_slices(batch, text, 1 << 19):
                ids, counts = encoder.encode(texts)
                at, rows, packed = 0, [], []
                for row, n in enumerate(counts.tolist()):
                    own = np.append(ids[at : at + n], last_id).astype("<u4").tobytes()
                    at += n
                    for start in range(0, n + 1, window):
                        length = min(window, n + 1 - start)
                        rows.append((a + row, start, length, n + 1, seen[length]))
                        packed.append(own[4 * start : 4 * (start + length)])
                        seen[length] += 1
                row, start, length, tokens, nth = (pa.array(x, pa.int64()) for x in zip(*rows))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(key).take(row), start, length, tokens, pa.array(packed, pa.binary()), pa.array([part] * len(rows), pa.int64()), nth],
                    [key, "start", "length", "doc_tokens", "ids", "part", "nth"],
                )

    kind = df.schema[key].dataType.simpleString()
    schema = f"`{key}` {kind}, start bigint, length bigint, doc_tokens bigint, ids binary, part bigint, nth bigint"
    return own_columns(df, key, text).mapInArrow(giving_back(run), schema)


def combinations(lengths: np.ndarray, window: int, most: int = 6000) -> np.ndarray:
    """Combinations of up to three lengths that fill the window, as rows padded with 0; triples on an even grid if there are too many."""
    present = np.zeros(window + 1, bool)
    present[lengths] = True
    rows = [np.array([[window, 0, 0]])] if present[window] else []
    one = lengths[(2 * lengths <= window) & (lengths < window)]
    one = one[present[window - one]]
    rows.append(np.stack([one, window - one, np.zeros_like(one)], axis=1))
    a, b = np.meshgrid(lengths, lengths, indexing="ij")
    c = window - a - b
    fits = (a <= b) & (b <= c)
    fits[fits] = present[c[fits]]
    triples = np.stack([a[fits], b[fits], c[fits]], axis=1)
    rows.append(triples[np.unique(np.linspace(0, len(triples) - 1, min(most, len(triples))).astype(int))] if len(triples) else triples)
    return np.concatenate(rows).astype(np.int64)


def solve(rows: np.ndarray, histogram: np.ndarray, rounds: int = 400) -> np.ndarray:
    """Repeat counts x ≥ 0 that make the combinations' lengths come nearest to the histogram in least squares.

    Accelerated projected gradient. A row's entries fall on at most three lengths, so products are gathers and counts.
    """
    if not len(rows):
        return np.zeros(0)
    size = len(histogram)
    used = rows > 0

    def lengths_of(x):
        return np.bincount(rows[used], weights=np.repeat(x, used.sum(1)), minlength=size)

    def back(residual):
        return (residual[rows] * used).sum(1)

    probe = np.ones(len(rows))
    for _ in range(20):
        probe = back(lengths_of(probe))
        norm = np.linalg.norm(probe)
        probe /= norm
    x = y = np.zeros(len(rows))
    t = 1.0
    for _ in range(rounds):
        new = np.maximum(y - back(lengths_of(y) - histogram) / norm, 0)
        t_new = (1 + np.sqrt(1 + 4 * t * t)) / 2
        y = new + (t - 1) / t_new * (new - x)
        x, t = new, t_new
    return x


def greedy(left: np.ndarray, window: int) -> Iterator[tuple[list[int], int]]:
    """Patterns for what rounding left: the longest piece first, filled exactly if one or two lengths can, else by the longest that fits."""
    while (longest := np.flatnonzero(left)).size:
        pattern, free = [int(longest[-1])], window - int(longest[-1])
        rest = left.copy()
        rest[pattern[0]] -= 1
        while free and (fit := np.flatnonzero(rest[: free + 1])).size:
            take = int(fit[-1])
            if take < free and len(fit) > 1:
                pairs = fit[(rest[free - fit] > 0) & ((2 * fit != free) | (rest[fit] > 1))]
                take = int(pairs[-1]) if len(pairs) else take
            pattern.append(take)
            rest[take] -= 1
            free -= take
        kinds, many = np.unique(pattern, return_counts=True)
        repeat = int((left[kinds] // many).min())
        left[kinds] -= many * repeat
        yield pattern, repeat


def plan(counts: dict[int, int], window: int = WINDOW) -> list[tuple[list[int], int]]:
    """(pattern of lengths, repeats) that use each counted length exactly as often as it occurs."""
    left = np.zeros(window + 1, np.int64)
    for length, n in counts.items():
        left[length] = n
    rows = combinations(np.flatnonzero(left), window)
    wanted = np.floor(solve(rows, left.astype(float)) + 1e-6).astype(np.int64)
    out = []
    for at in np.argsort(-wanted, kind="stable"):
        if wanted[at] < 1:
            break
        pattern = rows[at][rows[at] > 0]
        kinds, many = np.unique(pattern, return_counts=True)
        repeat = int(min(wanted[at], (left[kinds] // many).min()))
        if repeat:
            left[kinds] -= many * repeat
            out.append((pattern.tolist(), repeat))
    return out + list(greedy(left, window))


def slots(patterns: list[tuple[list[int], int]]) -> list[tuple[int, int, int, int, int]]:
    """(length, first rank, rank behind the last, sequence of the first, offset) of every place of every pattern."""
    used: Counter = Counter()
    out, sequence = [], 0
    for pattern, repeat in patterns:
        offset = 0
        for length in pattern:
            out.append((length, used[length], used[length] + repeat, sequence, offset))
            used[length] += repeat
            offset += length
        sequence += repeat
    return out


def place(pieces: DataFrame, window: int = WINDOW) -> DataFrame:
    """Staged pieces with sequence_id and offset. An empty table gives an empty one.

    Only the histogram (at most ``window`` rows) comes to the driver, and only the plan is broadcast. Ranks are counted
    per task and length, then over tasks, so a length that most pieces share never meets in one task.
    """
    spark = pieces.sparkSession
    groups = pieces.groupBy("length", "part").agg(F.count("*").alias("n"))
    histogram = groups.groupBy("length").agg(F.sum("n").alias("n")).collect()
    rows = slots(plan({r["length"]: r["n"] for r in histogram}, window))
    names = ["length", "low", "high", "first_sequence", "offset"]
    # An Arrow table: from Python rows Spark would start a further Python worker on each core, which then stays for a minute.
    arrow = pa.table({name: pa.array([r[i] for r in rows], pa.int64()) for i, name in enumerate(names)})
    table = spark.createDataFrame(arrow, "length bigint, low bigint, high bigint, first_sequence bigint, `offset` bigint")
    earlier = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    before = groups.select("length", "part", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("before"))
    ranked = pieces.join(before, ["length", "part"]).withColumn("rank", F.col("before") + F.col("nth"))
    inside = (F.col("rank") >= F.col("low")) & (F.col("rank") < F.col("high"))
    found = ranked.join(F.broadcast(table.withColumnRenamed("length", "_length")), (F.col("length") == F.col("_length")) & inside)
    return found.withColumn("sequence_id", F.col("first_sequence") + F.col("rank") - F.col("low")).drop(
        "_length", "low", "high", "first_sequence", "rank", "before", "part", "nth"
    )


def pack(docs: DataFrame, tokenizer_path: str, window: int = WINDOW) -> DataFrame:
    """Pieces of all documents with their sequence and offset, and the digest of their ids instead of the ids."""
    stages = Stages(docs.sparkSession, "packing")
    pieces = cut(docs, tokenizer_path, window).withColumn("ids_crc32", F.crc32("ids")).drop("ids")
    return place(stages.write(pieces, "pieces"), window).select(
        "doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"
    )
