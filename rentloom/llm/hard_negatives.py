"""Hard negatives of anchors by slot-decomposed selection.

An anchor's positives each ask for the best rows of another label whose scores lie in a window below that positive's
score. The windows overlap: what differs are their upper limits. The limits cut the scores into slots that do not
overlap, and the best k of every slot answer all windows: merged from the lowest slot upwards, the suffix that begins
at a positive's slot holds the best k rows below its upper limit.

Anchors are the stated query set and meet all rows in blocks. Rows are dealt to shards by a hash of their id; a shard's
rows are sent to one task once, and packed blocks of anchors pass by it. Two such passes find the positives and then
the slots. Each keeps only the best k of a slot per shard, so what is merged is small.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rentloom.llm.common import Stages, bounded_batches
from rentloom.llm.vectors import PACKED, every_shard, exact_products, fits_long, meet, one_row_each, packed, scaled, usable

SHARD_ROWS, SHARD_BYTES = 65_536, 32 << 20  # most rows and bytes of vectors in a shard
LEAST_SHARD_ROWS, FEW_SHARDS = 4096, 64  # smaller tables are cut finer, so that tasks have work
BLOCK_ROWS = 1024  # anchors that pass a shard at a time
ROWS_AT_ONCE, FIRST_COLUMNS = 128, 256
LOWEST = -(1 << 63)


@dataclass
class Shard:
    """Rows sorted by label, then id; ``spans`` has first and last place of each label."""

    ids: np.ndarray
    points: np.ndarray
    spans: dict[int, tuple[int, int]]


def _shard(ids: np.ndarray, labels: np.ndarray, points: np.ndarray) -> Shard:
    order = np.lexsort((ids, labels))
    values, starts = np.unique(labels[order], return_index=True)
    ends = np.append(starts[1:], len(order))
    return Shard(ids[order], points[order], {int(v): (int(a), int(b)) for v, a, b in zip(values, starts, ends)})


def best_of_label(shard: Shard, ids: np.ndarray, labels: np.ndarray, points: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(anchor id, row id, score): the best k other rows of each anchor's own label, ties to the smaller id."""
    found = []
    for label in np.unique(labels).tolist():
        own, (a, b) = np.flatnonzero(labels == label), shard.spans.get(label, (0, 0))
        for at in range(0, len(own), ROWS_AT_ONCE):
            rows = own[at : at + ROWS_AT_ONCE]
            state = (np.zeros(0, np.int64),) * 3
            for columns in _columns([(a, b)]):
                score = exact_products(points[rows], shard.points[columns])
                take = ids[rows][:, None] != shard.ids[columns]
                full = _kth(state, len(rows), k)
                row, column = np.nonzero(take & (score >= full[:, None]))
                state = _merged(state, row, shard.ids[columns][column], score[row, column], k)
            found.append((ids[rows[state[0]]], state[1], state[2]))
    return tuple(np.concatenate(c) for c in zip(*found)) if found else (np.zeros(0, np.int64),) * 3


def best_of_slots(
    shard: Shard, labels: np.ndarray, points: np.ndarray, uppers: np.ndarray, lower: np.ndarray, k: int
) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(anchor's place, slot, row id, score): the best k rows of other labels in each slot, ties to the smaller id.

    ``uppers`` has an anchor's upper limits in falling order, LOWEST where it has fewer. Slot j holds scores of at most
    limit j and above limit j + 1; none below ``lower`` count.
    """
    slots = uppers.shape[1]
    found = []
    below = np.concatenate([uppers[:, 1:], np.full((len(uppers), 1), LOWEST)], axis=1)
    for label in np.unique(labels).tolist():
        own, (a, b) = np.flatnonzero(labels == label), shard.spans.get(label, (0, 0))
        for at in range(0, len(own), ROWS_AT_ONCE):
            rows = own[at : at + ROWS_AT_ONCE]
            state = (np.zeros(0, np.int64),) * 3
            for columns in _columns([(0, a), (b, len(shard.ids))]):
                score = exact_products(points[rows], shard.points[columns])
                full = _kth(state, len(rows) * slots, k).reshape(-1, slots)
                inside = score >= lower[rows][:, None]
                for slot in range(slots):
                    fits = inside & (score <= uppers[rows, slot][:, None]) & (score > below[rows, slot][:, None])
                    row, column = np.nonzero(fits & (score >= full[:, slot][:, None]))
                    state = _merged(state, row * slots + slot, shard.ids[columns][column], score[row, column], k)
            found.append((rows[state[0] // slots], state[0] % slots, state[1], state[2]))
    return tuple(np.concatenate(c) for c in zip(*found)) if found else (np.zeros(0, np.int64),) * 4


def _columns(spans: list[tuple[int, int]]) -> Iterator[slice]:
    """Pieces of the spans, the first ones short: they give the limits that keep the candidates of later ones few."""
    size = FIRST_COLUMNS
    for a, b in spans:
        while a < b:
            yield slice(a, min(b, a + size))
            a, size = a + size, min(4 * size, 4096)


def _kth(state: tuple, groups: int, k: int) -> np.ndarray:
    """The kth score each group has so far, LOWEST while it has fewer."""
    group, _, score = state
    out = np.full(groups, LOWEST)
    counts = np.bincount(group, minlength=groups)
    least = np.full(groups, (1 << 63) - 1)
    np.minimum.at(least, group, score)
    out[counts >= k] = least[counts >= k]
    return out


def _merged(state: tuple, group: np.ndarray, ids: np.ndarray, score: np.ndarray, k: int) -> tuple:
    if not len(group):
        return state
    group, ids, score = (np.concatenate(c) for c in zip(state, (group, ids, score)))
    # Scores of -2^63 cannot be negated; ~ reverses the order of all.
    order = np.lexsort((ids, ~score, group))
    new = np.append(True, group[order][1:] != group[order][:-1])
    place = np.arange(len(order)) - np.maximum.accumulate(np.where(new, np.arange(len(order)), 0))
    order = order[place < k]
    return group[order], ids[order], score[order]


def windows(slots: list[list[tuple[int, int]]], limits: list[int], asked: list[tuple[int, int]], k: int) -> list[list[tuple[int, int]]]:
    """The best k (score, id) in each asked (upper limit, lower limit): suffixes of the slots, merged from the lowest up."""
    suffix: list[tuple[int, int]] = []
    at: dict[int, list[tuple[int, int]]] = {}
    for limit, own in sorted(zip(limits, slots)):
        suffix = (own + suffix)[:k]  # every score of a slot is above those of the slots below it
        at[limit] = suffix
    return [[x for x in at.get(upper, []) if x[0] >= lower] for upper, lower in asked]


def limits_of(score: int, low: int, high: int) -> tuple[int, int]:
    """(upper, lower): the integers n with low · score ≤ 100 · n ≤ high · score lie between them; none if upper < lower."""
    return high * score // 100, -(-low * score // 100)


def _shards(rows: DataFrame, count: int, scale: int) -> DataFrame:
    """(width, shard, ids, points, tags: labels): the rows of each shard, packed."""

    def run(table: pa.Table) -> pa.Table:
        width, shard = table.column("width")[0].as_py(), table.column("shard")[0].as_py()
        ids, labels = (table.column(c).to_numpy() for c in ("vec_id", "label"))
        return pa.table({"shard": [shard]} | packed(width, ids, scaled(table.column("embedding"), width, scale), labels))

    dealt = rows.withColumn("shard", F.pmod(F.xxhash64("vec_id"), F.lit(count)))
    return dealt.groupBy("width", "shard").applyInArrow(run, f"shard bigint, width int, {PACKED}")


def _blocks(anchors: DataFrame, count: int, scale: int) -> DataFrame:
    """(width, ids, points, tags: labels, limits) of anchors, packed; limits are the upper ones and the least lower one."""

    def run(table: pa.Table) -> pa.Table:
        width = table.column("width")[0].as_py()
        ids, labels = (table.column(c).to_numpy() for c in ("vec_id", "label"))
        limits = np.array(table.column("limits").to_pylist(), "<i8") if "limits" in table.column_names else None
        return pa.table(packed(width, ids, scaled(table.column("embedding"), width, scale), labels, limits))

    dealt = anchors.withColumn("block", F.pmod(F.xxhash64("vec_id", F.lit(1)), F.lit(count)))
    return dealt.groupBy("width", "block").applyInArrow(run, f"width int, {PACKED}")


def _sorted(x: dict) -> Shard:
    if "sorted" not in x:
        x["sorted"] = _shard(x["ids"], x["tags"], x["points"])
    return x["sorted"]


def _columns_of(names: list[str], arrays: tuple) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(a.astype(np.int64)) for a in arrays], names)


def mine(
    rows: DataFrame, is_anchor: Column, positives: int = 5, k: int = 10, low: int = 30, high: int = 90, scale: int = 256
) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score over ``rows`` (vec_id, embedding, label).

    Scores are inner products of floor(scale · component). An anchor's positives are its best other rows of the same
    label; for each, the best k rows of other labels come whose score n satisfies low · p ≤ 100 · n ≤ high · p for the
    positive's score p. All ties go to the smaller vec_id. Where fewer exist, all come; a positive below 0 has none.

    Rows with a null id, label or vector, or with null or non-finite components, or with components that do not fit 62
    bits after scaling, take no part. Vectors meet vectors of their own width only; those without components score 0.
    Rows that repeat an id count once, with the label and vector that sort first. A score beyond 64 bits counts as the
    nearest long. An empty table gives an empty result. Other columns are not read.
    """
    spark = rows.sparkSession
    bounded_batches(spark)
    stages = Stages(spark, "negatives")
    fine = rows.filter(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & usable() & fits_long("embedding", scale))
    fine = fine.select(F.col("vec_id").cast("bigint").alias("vec_id"), F.col("label").cast("bigint").alias("label"), "embedding")
    fine = one_row_each(fine, stages).withColumn("width", F.size("embedding"))
    size = fine.agg(F.count("*").alias("n"), F.max("width").alias("width"), F.count(F.when(is_anchor, 1)).alias("anchors")).first()
    most = max(1, min(SHARD_ROWS, SHARD_BYTES // (8 * max(size["width"] or 0, 1))))
    count = max(1, -(-size["n"] // most), min(FEW_SHARDS, -(-size["n"] // LEAST_SHARD_ROWS)))
    blocks = max(1, -(-size["anchors"] // min(BLOCK_ROWS, most)))
    shards = stages.write(_shards(fine, count, scale), "shards")
    anchors = stages.write(fine.filter(is_anchor), "anchors")

    names = ["anchor_id", "positive_id", "score"]

    def same(shard, block):
        return _columns_of(names, best_of_label(_sorted(shard), block["ids"], block["tags"], block["points"], positives))

    near = meet(shards, every_shard(_blocks(anchors, blocks, scale), count), same, ", ".join(f"{n} bigint" for n in names))
    order = Window.partitionBy("anchor_id").orderBy(F.desc("score"), "positive_id")
    near = near.withColumn("place", F.row_number().over(order)).filter(F.col("place") <= positives).drop("place")
    chosen = stages.write(near.groupBy("anchor_id").agg(F.collect_list(F.struct("score", "positive_id")).alias("positives")), "positives")

    asked = anchors.join(chosen.select(F.col("anchor_id").alias("vec_id"), "positives"), "vec_id")
    asked = _with_limits(asked, positives, low, high)
    found_names = ["anchor_id", "slot", "negative_id", "score"]

    def other(shard, block):
        limits = block["limits"].reshape(-1, positives + 1)
        place, *rest = best_of_slots(_sorted(shard), block["tags"], block["points"], limits[:, :-1], limits[:, -1], k)
        return _columns_of(found_names, (block["ids"][place], *rest))

    found = meet(shards, every_shard(_blocks(asked, blocks, scale), count), other, ", ".join(f"{n} bigint" for n in found_names))
    order = Window.partitionBy("anchor_id", "slot").orderBy(F.desc("score"), "negative_id")
    found = found.withColumn("place", F.row_number().over(order)).filter(F.col("place") <= k)
    found = found.groupBy("anchor_id").agg(F.collect_list(F.struct("score", "negative_id")).alias("negatives"))
    return _answered(found.join(chosen, "anchor_id"), k, low, high)


def _distinct_limits(scores: list[int], low: int, high: int) -> list[tuple[int, int]]:
    """Upper limits that windows have, falling, each with the least lower limit of its windows."""
    out: dict[int, int] = {}
    for upper, lower in (limits_of(s, low, high) for s in scores):
        if upper >= lower:
            out[upper] = min(lower, out.get(upper, lower))
    return sorted(out.items(), reverse=True)


def _with_limits(anchors: DataFrame, positives: int, low: int, high: int) -> DataFrame:
    """Anchors whose positives have windows, with their upper limits and the least lower limit of them all."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, limits = [], []
            for at, scores in enumerate(batch.column("scores").to_pylist()):
                own = _distinct_limits(scores, low, high)
                if own:
                    rows.append(at)
                    limits.append([u for u, _ in own] + [LOWEST] * (positives - len(own)) + [min(b for _, b in own)])
            kept = batch.take(pa.array(rows, pa.int64()))
            columns = [kept.column(c) for c in ("vec_id", "label", "embedding", "width")]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(limits, pa.list_(pa.int64()))], ["vec_id", "label", "embedding", "width", "limits"])

    kind = anchors.schema["embedding"].dataType.simpleString()
    named = anchors.select("vec_id", "label", "embedding", "width", F.col("positives.score").alias("scores"))
    return named.mapInArrow(run, f"vec_id bigint, label bigint, embedding {kind}, width int, limits array<bigint>")


def _answered(found: DataFrame, k: int, low: int, high: int) -> DataFrame:
    """The rows of every window, from an anchor's positives and the best rows of its slots (at most k a slot)."""
    names = ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple] = []
            for x in batch.to_pylist():
                asked = [limits_of(p["score"], low, high) for p in x["positives"]]
                limits = [u for u, _ in _distinct_limits([p["score"] for p in x["positives"]], low, high)]
                slots: list[list[tuple[int, int]]] = [[] for _ in limits]
                for n in sorted(x["negatives"], key=lambda n: (-n["score"], n["negative_id"])):
                    slots[max(i for i, u in enumerate(limits) if u >= n["score"])].append((n["score"], n["negative_id"]))
                for p, window in zip(x["positives"], windows(slots, limits, asked, k)):
                    out += [(x["anchor_id"], p["positive_id"], i + 1, v, p["score"], s) for i, (s, v) in enumerate(window)]
            columns = zip(*out) if out else [()] * 6
            kinds = [pa.int32() if n == "rank" else pa.int64() for n in names]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds)], names)

    schema = ", ".join(f"{n} {'int' if n == 'rank' else 'bigint'}" for n in names)
    return found.mapInArrow(run, schema)
