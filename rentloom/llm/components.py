"""Connected components of a link table: blocks of links are contracted, large-star and small-star steps join the blocks."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rentloom.llm.common import Stages


SALTS = 2
BLOCK = 1 << 16  # links that are contracted at a time


def least_reachable(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each linked node but the smallest of its component, and that smallest node."""
    nodes, place = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = place[: len(a)], place[len(a) :]
    label = np.arange(len(nodes))
    while (label[x] != label[y]).any():
        low, high = np.minimum(label[x], label[y]), np.maximum(label[x], label[y])
        np.minimum.at(label, high, low)
        while (label[label] != label).any():
            label = label[label]
    rest = label != np.arange(len(nodes))
    return nodes[rest], nodes[label[rest]]


def _contracted(edges: DataFrame, block: int) -> DataFrame:
    """Stars with the same components as the links of each task, found for some ``block`` links at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a = b = np.zeros(0, np.int64)
        for batch in batches:
            for start in range(0, batch.num_rows, block):
                x, y = (batch.column(c).slice(start, block).to_numpy() for c in ("a", "b"))
                a, b = np.concatenate([a, x]), np.concatenate([b, y])
                if len(a) > block:
                    a, b = least_reachable(a, b)
                    if len(a) > block // 2:
                        yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])
                        a = b = a[:0]
        a, b = least_reachable(a, b)
        yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])

    return edges.mapInArrow(run, "a bigint, b bigint")


def _are_stars(edges: DataFrame) -> bool:
    """Whether every node has one smaller neighbour or larger ones only."""
    role = F.struct(F.col("a").alias("id"), F.lit(1).alias("up")), F.struct(F.col("b").alias("id"), F.lit(0).alias("up"))
    ends = edges.select(F.explode(F.array(*role)).alias("end")).select("end.*")
    seen = ends.groupBy("id").agg(F.sum("up").alias("ups"), F.min("up").alias("least"))
    return seen.filter("ups > 1 or ups = 1 and least = 0").isEmpty()


def _with_least(rows: DataFrame, least: DataFrame) -> DataFrame:
    """Rows with the least neighbour of their node. Both sides are dealt by node and salt, apart from the aggregation that
    found the least, so that adaptive execution can split a node with very many rows."""
    salted = least.withColumn("salt", F.explode(F.array(*(F.lit(i) for i in range(SALTS)))))
    return rows.withColumn("salt", F.pmod(F.col("b"), F.lit(SALTS)).cast("int")).join(salted, ["a", "salt"]).drop("salt")


def _large(edges: DataFrame) -> DataFrame:
    """Every node hands the smallest node it knows to its larger neighbours."""
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.least("a", F.min("b")).alias("m"))
    return _with_least(both.filter("b > a"), least).select(F.col("b").alias("a"), F.col("m").alias("b"))


def _small(edges: DataFrame) -> DataFrame:
    """Every node links itself and its smaller neighbours with the smallest of them."""
    least = edges.groupBy("a").agg(F.min("b").alias("m"))
    inner = _with_least(edges, least).filter("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return inner.unionByName(least.select("a", F.col("m").alias("b"))).distinct()


def components(links: DataFrame, stages: Stages) -> DataFrame:
    """(a, b): each linked node but the smallest of its component, and that smallest node. Loops and repeats do no harm.

    Links that fit one block of ``BLOCK`` are finished in it. More of them are contracted in as many blocks as they fill, for
    as long as that halves them; then star steps over all of them follow, each contracted again, until every node knows the
    smallest of its component. Only counts come to the driver. A node with very many links is read once per link in a
    join whose other side has one row for it and each salt, so adaptive execution can split it.
    """
    edges, (found,) = stages.measured(_contracted(links.select("a", "b"), BLOCK), "links", F.count("*"))
    while found:
        last, before = edges, found
        edges, (found,) = stages.measured(_contracted(last.coalesce(-(-before // BLOCK)), BLOCK), "blocks", F.count("*"))
        stages.drop(last)
        if before <= BLOCK:
            break
        if 2 * found <= before:
            continue
        if _are_stars(edges):
            break
        last = edges
        edges, (found,) = stages.measured(_small(_large(last)), "stars", F.count("*"))
        stages.drop(last)
    return edges
