"""Approximate nearest neighbours with a hierarchical k-means tree and best-bin-first traversal.

Vectors get one more component so that the largest inner product is the least distance. A tree of k-means splits is fitted
on a bounded sample; every row is then filed under the leaf it reaches. A query opens nodes from a priority queue, the
nearest centre first, and reads leaves in that order. How many leaves are read is calibrated: for some queries the true
neighbours are found by a full scan, and leaves are added until the wanted share of them is reached.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rentloom.llm.common import Stages, bounded_batches
from rentloom.llm.vectors import best_rows, by_width, matrix, one_row_each, ranked, usable

SAMPLE = 20_000  # rows that the tree is fitted on
PROBES = 200  # queries that calibrate the traversal
RECALL = 0.98  # share of their true neighbours to reach
BRANCHES, LEAF_SHARE, MOST_LEAVES = 8, 200, 1024
TREE_ROWS = 2048  # vectors of a width with fewer rows are one leaf
LEAF_BITS = 20  # of a leaf's number; the width stands above them
BLOCK_ROWS, BLOCK_QUERIES = 2048, 256
HELD_ROWS = 400_000  # found rows that a task holds before it hands some on


@dataclass
class Tree:
    reach: float  # the largest norm
    centres: list[np.ndarray] = field(default_factory=list)
    children: list[list[int]] = field(default_factory=list)
    leaf: list[int] = field(default_factory=list)
    leaves: int = 0

    def lifted(self, points: np.ndarray) -> np.ndarray:
        rest = np.sqrt(np.maximum(self.reach**2 - (points * points).sum(1), 0))
        return np.column_stack([points, rest])


def kmeans(points: np.ndarray, k: int, rng, rounds: int = 12) -> tuple[np.ndarray, np.ndarray]:
    centres = points[rng.choice(len(points), min(k, len(points)), replace=False)]
    for _ in range(rounds):
        nearest = ((centres * centres).sum(1) - 2 * points @ centres.T).argmin(1)
        used = np.unique(nearest)
        centres = np.stack([points[nearest == c].mean(0) for c in used])
    return centres, ((centres * centres).sum(1) - 2 * points @ centres.T).argmin(1)


def fit(sample: np.ndarray, reach: float, leaves: int, seed: int = 3) -> Tree:
    """Split the largest node until there are ``leaves`` leaves or nothing can be split."""
    rng = np.random.default_rng(seed)
    tree = Tree(reach)
    points = tree.lifted(sample) if len(sample) else np.zeros((0, 1))

    def add(own: np.ndarray, centre: np.ndarray) -> int:
        tree.centres.append(centre)
        tree.children.append([])
        heapq.heappush(todo, (-len(own), len(tree.centres) - 1, own))
        return len(tree.centres) - 1

    todo: list = []
    add(np.arange(len(points)), points.mean(0) if len(points) else np.zeros(1))
    count = 1
    while todo and count < leaves:
        _, node, own = heapq.heappop(todo)
        if len(own) < 2 or (points[own] == points[own[0]]).all():
            continue
        centres, nearest = kmeans(points[own], min(BRANCHES, leaves - count + 1), rng)
        if len(centres) < 2:
            continue
        tree.children[node] = [add(own[nearest == c], centre) for c, centre in enumerate(centres)]
        count += len(centres) - 1
    tree.leaf = [-1] * len(tree.centres)
    for node, below in enumerate(tree.children):
        if not below:
            tree.leaf[node] = tree.leaves
            tree.leaves += 1
    return tree


def file_rows(tree: Tree, points: np.ndarray) -> np.ndarray:
    """The leaf that each row reaches by the nearest centre at every split."""
    lifted = tree.lifted(points)
    out = np.zeros(len(points), np.int64)
    todo = [(0, np.arange(len(points)))]
    while todo:
        node, own = todo.pop()
        below = tree.children[node]
        if not below or not len(own):
            out[own] = tree.leaf[node]
            continue
        centres = np.stack([tree.centres[c] for c in below])
        nearest = ((centres * centres).sum(1) - 2 * lifted[own] @ centres.T).argmin(1)
        todo += [(child, own[nearest == i]) for i, child in enumerate(below)]
    return out


def visit(tree: Tree, query: np.ndarray, leaves: int) -> list[int]:
    """The first ``leaves`` leaves in best-bin-first order."""
    target = np.append(query, 0.0)
    heap, out = [(0.0, 0)], []
    while heap and len(out) < leaves:
        _, node = heapq.heappop(heap)
        below = tree.children[node]
        if not below:
            out.append(tree.leaf[node])
            continue
        away = np.stack([tree.centres[c] for c in below]) - target
        for distance, child in zip((away * away).sum(1).tolist(), below):
            heapq.heappush(heap, (distance, child))
    return out


def products(queries: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Inner products in doubles, each summed in component order, so that equal vectors have equal scores."""
    total = np.zeros((len(queries), len(rows)))
    for x, y in zip(queries.T, rows.T):
        total += x[:, None] * y
    return total


def _pairs(query_ids: np.ndarray, queries: np.ndarray, ids: np.ndarray, rows: np.ndarray, k: int) -> tuple[np.ndarray, ...]:
    """Best k rows of each query among these rows, but its own."""
    score = products(queries, rows)
    score[query_ids[:, None] == ids] = -np.inf
    if len(ids) > 4 * k:  # everything at or above the kth score stays, ties as well
        floor = np.partition(score, len(ids) - k, axis=1)[:, len(ids) - k]
    else:
        floor = np.full(len(query_ids), -np.inf)
    q, r = np.nonzero((score >= floor[:, None]) & (score > -np.inf))
    best = best_rows(q, ids[r], score[q, r], k)
    return query_ids[q[best]], ids[r[best]], score[q[best], r[best]]


FOUND = "query_id bigint, vec_id bigint, score double"


def _found(query: np.ndarray, vec: np.ndarray, score: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(query, pa.int64()), pa.array(vec, pa.int64()), pa.array(score, pa.float64())], ["query_id", "vec_id", "score"])


def _best(held: list[tuple[np.ndarray, ...]], k: int) -> tuple[np.ndarray, ...]:
    query, vec, score = (np.concatenate(x) for x in zip(*held))
    best = best_rows(query, vec, score, k)
    return query[best], vec[best], score[best]


def full_scan(rows: DataFrame, query_ids: np.ndarray, queries: np.ndarray, k: int) -> DataFrame:
    """True neighbours of a bounded number of queries of one width: every batch of rows gives its best k, which are merged."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for width, own, points in by_width(batch):
                if width == queries.shape[1]:
                    yield _found(*_pairs(query_ids, queries, own.column("vec_id").to_numpy(), points, k))

    return ranked(rows.mapInArrow(run, FOUND), k)


def calibrate(tree: Tree, filed: DataFrame, probes: list, k: int) -> int:
    """Leaves to visit so that ``RECALL`` of the probes' true neighbours lie in them."""
    if not probes or tree.leaves == 1:
        return max(tree.leaves, 1)
    ids, queries = np.array([p["vec_id"] for p in probes]), np.array([p["embedding"] for p in probes], float)
    true = full_scan(filed, ids, queries, k).join(filed.select("vec_id", "leaf"), "vec_id").select("query_id", "leaf").collect()
    order = {i: {leaf: n for n, leaf in enumerate(visit(tree, q, tree.leaves), 1)} for i, q in zip(ids.tolist(), queries)}
    depths = sorted(order[r["query_id"]][r["leaf"] & (1 << LEAF_BITS) - 1] for r in true)
    return depths[min(int(np.ceil(RECALL * len(depths))), len(depths)) - 1] if depths else 1


def _numbered(width: int, leaf: np.ndarray) -> np.ndarray:
    return (width << LEAF_BITS) + leaf


def search(rows: DataFrame, is_query: Column, k: int = 20) -> DataFrame:
    """query_id, rank, vec_id, score: the k largest inner products found, ties to the smaller vec_id.

    Candidates are all rows but those with the query's own id. Vectors that are null, empty, zero or hold null or
    non-finite components, and rows with a null id take no part; vectors meet vectors of their own width only. Rows that
    repeat an id count once, with the vector that sorts first. An empty table gives an empty result; other columns are
    not read. Each width with more than TREE_ROWS rows has a tree, all rows of a rarer one are one leaf. The sample for a
    tree (SAMPLE rows with the smallest hashes) and the probes (PROBES queries) are bounded; every row is filed and
    every query searched. Leaves and their queries are split into blocks, so a leaf may hold any share of the rows.
    """
    spark = rows.sparkSession
    bounded_batches(spark)
    stages = Stages(spark, "kmeans")
    fine = rows.filter(F.col("vec_id").isNotNull() & usable(zero=False)).select("vec_id", "embedding")
    fine = one_row_each(fine, stages).withColumn("asked", F.coalesce(is_query, F.lit(False)))
    norm = F.sqrt(F.aggregate("embedding", F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))
    fine = stages.write(fine, "rows")
    # One row for each width that has a tree; there are at most rows / TREE_ROWS of them, and one in common tables.
    widths = fine.groupBy(F.size("embedding").alias("width")).agg(F.count("*").alias("n"), F.max(norm).alias("reach"))
    trees: dict[int, Tree] = {}
    for about in widths.filter(F.col("n") > TREE_ROWS).collect():
        own = fine.filter(F.size("embedding") == about["width"])
        sample = own.orderBy(F.xxhash64("vec_id")).limit(SAMPLE).select("embedding").toArrow()
        leaves = int(min(max(about["n"] // LEAF_SHARE, 1), MOST_LEAVES))
        trees[about["width"]] = fit(matrix(sample.column("embedding")), about["reach"], leaves)

    def file(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for width, own, points in by_width(batch):
                leaf = file_rows(trees[width], points) if width in trees else np.zeros(len(points), np.int64)
                yield pa.RecordBatch.from_arrays([*own.columns, pa.array(_numbered(width, leaf))], [*own.schema.names, "leaf"])

    kind = fine.schema["embedding"].dataType.simpleString()
    filed = stages.write(fine.mapInArrow(file, f"vec_id bigint, embedding {kind}, asked boolean, leaf bigint"), "filed")
    queries = filed.filter("asked").select("vec_id", "embedding")
    depths = {}
    for width, tree in trees.items():
        probes = queries.filter(F.size("embedding") == width).orderBy(F.xxhash64("vec_id", F.lit(1))).limit(PROBES).collect()
        depths[width] = calibrate(tree, filed, probes, k)

    def leaves_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for width, own, points in by_width(batch):
                lists = [visit(trees[width], q, depths[width]) for q in points] if width in trees else [[0]] * len(points)
                row = pa.array(np.repeat(np.arange(len(lists)), [len(x) for x in lists]))
                leaf = _numbered(width, np.concatenate(lists).astype(np.int64))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(leaf), own.column("vec_id").take(row), own.column("embedding").take(row)], ["leaf", "vec_id", "embedding"]
                )

    asked = queries.mapInArrow(leaves_of, f"leaf bigint, vec_id bigint, embedding {kind}")
    pairs = _blocks(asked, BLOCK_QUERIES, "query").join(_blocks(filed.select("leaf", "vec_id", "embedding"), BLOCK_ROWS, "row"), "leaf")

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, ...]] = []
        count = 0
        for batch in batches:
            for x in batch.to_pylist():
                width = x["leaf"] >> LEAF_BITS
                query_ids, ids = (np.frombuffer(x[c], "<i8") for c in ("query_ids", "row_ids"))
                points = [np.frombuffer(x[c], "<f8").reshape(-1, width) for c in ("query_points", "row_points")]
                held.append(_pairs(query_ids, points[0], ids, points[1], k))
                count += len(held[-1][0])
                if count > HELD_ROWS:  # keep each query's best of all leaves seen in this task
                    held = [_best(held, k)]
                    count = len(held[0][0])
                    if count > HELD_ROWS // 2:
                        yield _found(*held[0])
                        held, count = [], 0
        if held:
            yield _found(*_best(held, k))

    return ranked(pairs.mapInArrow(score, FOUND), k)


def _blocks(rows: DataFrame, most: int, name: str) -> DataFrame:
    """(leaf, ids, points): rows of each leaf packed into blocks of about ``most`` rows, by a hash of their ids."""
    sizes = rows.groupBy("leaf").agg(F.ceil(F.count("*") / most).alias("parts"))
    dealt = rows.join(sizes, "leaf").withColumn("part", F.pmod(F.xxhash64("vec_id"), F.col("parts"))).drop("parts")

    def pack(table: pa.Table) -> pa.Table:
        return pa.table(
            {
                "leaf": [table.column("leaf")[0].as_py()],
                f"{name}_ids": [table.column("vec_id").to_numpy().astype("<i8").tobytes()],
                f"{name}_points": [matrix(table.column("embedding")).astype("<f8").tobytes()],
            }
        )

    return dealt.groupBy("leaf", "part").applyInArrow(pack, f"leaf bigint, {name}_ids binary, {name}_points binary")
