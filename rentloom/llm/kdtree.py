"""Exact top-k inner products with one KD-tree per shard.

Rows are dealt to shards of bounded size by a hash of their id. Each shard is split at medians of its widest dimension
down to small leaves with tight bounding boxes. A query goes down best-first: the box with the largest possible inner
product is opened first, until no open box can reach the kth score found so far. Queries first search the shard they
live in; the kth score found there travels with them to all other shards.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rentloom.llm.common import Stages, bounded_batches
from rentloom.llm.vectors import PACKED, every_shard, exact_products, fits_long, meet, one_row_each, packed, ranked, scaled, usable

SHARD_ROWS, LEAF_ROWS, BLOCK_QUERIES = 4096, 64, 1024
NOTHING = -(1 << 62)


@dataclass
class Tree:
    low: np.ndarray
    high: np.ndarray
    children: list[tuple[int, int] | None]
    spans: list[tuple[int, int]]
    ids: np.ndarray
    points: np.ndarray


def build(ids: np.ndarray, points: np.ndarray) -> Tree:
    """Median splits of the widest dimension; equal points stay in one leaf, however many they are."""
    order = np.argsort(ids, kind="stable")
    low, high, children, spans = [], [], [], []

    def add(start: int, end: int) -> int:
        node = len(spans)
        own = points[order[start:end]]
        low.append(own.min(0))
        high.append(own.max(0))
        children.append(None)
        spans.append((start, end))
        return node

    todo = [add(0, len(ids))] if len(ids) else []
    while todo:
        node = todo.pop()
        start, end = spans[node]
        spread = high[node].astype(float) - low[node]
        if end - start <= LEAF_ROWS or not spread.any():
            continue
        own = order[start:end]
        own = own[np.argsort(points[own, int(spread.argmax())], kind="stable")]
        order[start:end] = own
        middle = (start + end) // 2
        children[node] = (add(start, middle), add(middle, end))
        todo += children[node]
    return Tree(np.array(low), np.array(high), children, spans, ids[order], points[order])


def search(tree: Tree, query_ids: np.ndarray, queries: np.ndarray, kth: np.ndarray, k: int) -> Iterator[tuple[int, list[tuple[int, int]]]]:
    """(row of the query, its best (score, vec_id)); rows that cannot be among the best k everywhere may be left out."""
    if not len(tree.ids):
        return
    numbers, floats = queries.astype(np.float64), tree.points.astype(np.float64)
    low, high = tree.low.astype(np.float64), tree.high.astype(np.float64)
    bounds = np.maximum(numbers, 0) @ high.T + np.minimum(numbers, 0) @ low.T
    # Both sides decide together whether doubles are exact; if not, bounds give way by more than they can be wrong.
    exact = queries.shape[1] * _largest(queries) * max(_largest(tree.low), _largest(tree.high)) <= 1 << 53
    if not exact:
        bounds += 1 + 1e-9 * (np.abs(numbers) @ np.maximum(np.abs(high), np.abs(low)).T)
    for row, own in enumerate(query_ids.tolist()):
        best: list[tuple[int, int]] = []  # a heap of (score, -vec_id), the worst on top
        reach = bounds[row]
        heap = [(-reach[0], 0)]
        while heap:
            bound, node = heapq.heappop(heap)
            floor = max(kth[row], best[0][0] if len(best) == k else NOTHING)
            if -bound < floor:
                break
            if tree.children[node]:
                for child in tree.children[node]:
                    heapq.heappush(heap, (-reach[child], child))
                continue
            start, end = tree.spans[node]
            if exact:
                scores = floats[start:end] @ numbers[row]
            else:
                scores = exact_products(tree.points[start:end], queries[row : row + 1])[:, 0]
            near = np.flatnonzero(scores >= floor)
            if len(near) > 4 * k:  # a leaf of equal points can be long
                near = near[np.lexsort((tree.ids[start + near], -scores[near].astype(float) if exact else ~scores[near]))[: k + 1]]
            for place in near.tolist():
                vec = int(tree.ids[start + place])
                if vec == own:
                    continue
                item = (int(scores[place]), -vec)
                if len(best) < k:
                    heapq.heappush(best, item)
                elif item > best[0]:
                    heapq.heapreplace(best, item)
        if best:
            yield row, [(s, -v) for s, v in best]


def _largest(points: np.ndarray) -> int:
    return max(int(points.max(initial=0)), -int(points.min(initial=0)))


def shards(rows: DataFrame, scale: int) -> DataFrame:
    """(width, shard, ids, points) of rows that carry their shard."""

    def run(table: pa.Table) -> pa.Table:
        width = table.column("width")[0].as_py()
        points = scaled(table.column("embedding"), width, scale)
        return pa.table({"shard": [table.column("shard")[0].as_py()]} | packed(width, table.column("vec_id").to_numpy(), points))

    return rows.groupBy("width", "shard").applyInArrow(run, f"shard bigint, width int, {PACKED}")


def blocks(rows: DataFrame, count: int, scale: int) -> DataFrame:
    """(width, ids, points, tags: home shards, limits: kth scores) of queries from many shards."""

    def run(table: pa.Table) -> pa.Table:
        width = table.column("width")[0].as_py()
        columns = (table.column(c).to_numpy() for c in ("shard", "kth"))
        return pa.table(packed(width, table.column("vec_id").to_numpy(), scaled(table.column("embedding"), width, scale), *columns))

    dealt = rows.withColumn("block", F.pmod(F.xxhash64("vec_id", F.lit(1)), F.lit(count)))
    return dealt.groupBy("width", "block").applyInArrow(run, f"width int, {PACKED}")


FOUND = "query_id bigint, vec_id bigint, score bigint"


def _searched(k: int):
    """What a block of queries finds in a shard; those that live there are left out once they carry a home."""

    def find(shard: dict, block: dict) -> pa.RecordBatch:
        if "tree" not in shard:
            shard["tree"] = build(shard["ids"], shard["points"])
        away = np.flatnonzero(block["tags"] != shard["shard"]) if "tags" in block else np.arange(len(block["ids"]))
        ids, queries = block["ids"][away], block["points"][away]
        kth = block["limits"][away] if "limits" in block else np.full(len(ids), NOTHING)
        found = [(ids[r], v, s) for r, best in search(shard["tree"], ids, queries, kth, k) for s, v in best]
        columns = zip(*found) if found else [()] * 3
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], ["query_id", "vec_id", "score"])

    return find


def top_k(rows: DataFrame, is_query: Column, k: int = 5, scale: int = 256) -> DataFrame:
    """query_id, rank, vec_id, score: the k largest inner products of floor(scale · component), ties to the smaller vec_id.

    Candidates are all rows but those with the query's own id; with fewer than k of them, all come. Vectors meet vectors
    of their own width only. Vectors that are null or empty or hold null or non-finite components, or components that do
    not fit 62 bits after scaling, and rows with a null id take no part. Rows that repeat an id count once, with the
    vector that sorts first. A score beyond 64 bits counts as the nearest long. An empty table gives an empty result;
    other columns are not read.
    """
    spark = rows.sparkSession
    bounded_batches(spark)
    stages = Stages(spark, "kdtree")
    fine = rows.filter(F.col("vec_id").isNotNull() & usable() & fits_long("embedding", scale) & (F.size("embedding") > 0))
    fine = one_row_each(fine.select("vec_id", "embedding"), stages).withColumn("width", F.size("embedding"))
    size = fine.agg(F.count("*").alias("n"), F.count(F.when(is_query, 1)).alias("queries")).first()
    count, groups = max(1, -(-size["n"] // SHARD_ROWS)), max(1, -(-size["queries"] // BLOCK_QUERIES))
    fine = fine.withColumn("shard", F.pmod(F.xxhash64("vec_id"), F.lit(count)))
    trees = stages.write(shards(fine, scale), "shards")
    queries = stages.write(fine.filter(is_query), "queries")
    first = stages.write(meet(trees, shards(queries, scale), _searched(k), FOUND), "first")
    known = first.groupBy("query_id").agg(F.count("*").alias("n"), F.min("score").alias("low"))
    known = known.filter(F.col("n") >= k).select(F.col("query_id").alias("vec_id"), F.col("low").alias("kth"))
    travelling = queries.join(known, "vec_id", "left").withColumn("kth", F.coalesce("kth", F.lit(NOTHING)))
    second = meet(trees, every_shard(blocks(travelling, groups, scale), count), _searched(k), FOUND)
    return ranked(first.unionByName(second), k)
