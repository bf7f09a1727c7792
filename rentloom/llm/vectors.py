"""What both vector searches share."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def usable(column: str = "embedding", zero: bool = True) -> Column:
    """Vectors that take part: not null, without null or non-finite components, and non-zero unless ``zero``."""
    x = F.col(column)
    bad = F.exists(x, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == F.lit(float("inf"))))
    fine = x.isNotNull() & ~bad
    return F.coalesce(fine if zero else fine & F.exists(x, lambda v: v != 0), F.lit(False))


def matrix(column: pa.Array, kind=np.float64) -> np.ndarray:
    """Rows of a list column as one matrix; all rows have one length."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    n = len(column)
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(n, -1).astype(kind) if n else np.zeros((0, 0), kind)


def by_width(batch: pa.RecordBatch, column: str = "embedding") -> Iterator[tuple[int, pa.RecordBatch, np.ndarray]]:
    """(width, rows of that width, their matrix) of a batch whose vectors may differ in length."""
    sizes = pc.list_value_length(batch.column(column)).to_numpy(zero_copy_only=False)
    for width in np.unique(sizes).tolist():
        rows = batch if (sizes == width).all() else batch.take(pa.array(np.flatnonzero(sizes == width)))
        flat = rows.column(column).flatten().to_numpy(zero_copy_only=False).astype(np.float64)
        yield width, rows, flat.reshape(rows.num_rows, width)


def meet(shards: DataFrame, asked: DataFrame, find: Callable, schema: str) -> DataFrame:
    """Blocks of queries meet the shards they name; ``find(shard, block)`` gives a record batch.

    Both tables are (width, shard, ids, points, tags, limits), packed 64-bit integers; both are dealt by (width, shard).
    In a task a shard's rows come before its blocks, so they are sent and unpacked once however many blocks pass by.
    ``find`` gets dictionaries of arrays, the same one for a shard each time, so that it may keep what it derives there.
    """
    columns = ["width", "shard", "kind", "ids", "points", "tags", "limits"]
    met = shards.withColumn("kind", F.lit(0)).select(columns).unionByName(asked.withColumn("kind", F.lit(1)).select(columns))
    met = met.repartition("width", "shard").sortWithinPartitions("width", "shard", "kind")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        here, shard = None, {}
        for batch in batches:
            for place in range(batch.num_rows):
                at = (batch.column("width")[place].as_py(), batch.column("shard")[place].as_py())
                packed = {name: batch.column(name)[place] for name in columns[3:]}
                own = {name: np.frombuffer(x.as_buffer(), "<i8") for name, x in packed.items() if x.is_valid}
                own["points"] = own["points"].reshape(len(own["ids"]), at[0])
                if batch.column("kind")[place].as_py() == 0:
                    here, shard = at, own | {"shard": at[1]}
                elif here == at:  # a shard without rows has nothing to give
                    yield find(shard, own)

    return met.mapInArrow(run, schema)


PACKED = "ids binary, points binary, tags binary, limits binary"


def packed(width: int, ids: np.ndarray, points: np.ndarray, tags: np.ndarray | None = None, limits: np.ndarray | None = None) -> dict:
    """The packed columns of a shard or block."""
    arrays = {"ids": ids, "points": points, "tags": tags, "limits": limits}
    blobs = {k: pa.array([None if v is None else v.astype("<i8").tobytes()], pa.binary()) for k, v in arrays.items()}
    return {"width": pa.array([width], pa.int32())} | blobs


def every_shard(blocks: DataFrame, count: int) -> DataFrame:
    """Blocks once for each shard: the stated query set against all rows."""
    return blocks.withColumn("shard", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(count - 1).cast("bigint"))))


def best_rows(query: np.ndarray, vec: np.ndarray, score: np.ndarray, k: int) -> np.ndarray:
    """Places of the ``k`` best rows of each query, ties to the smaller vec_id."""
    order = np.lexsort((vec, -score, query))
    if not len(order):
        return order
    new = np.append(True, query[order][1:] != query[order][:-1])
    place = np.arange(len(order)) - np.maximum.accumulate(np.where(new, np.arange(len(order)), 0))
    return order[place < k]


def ranked(found: DataFrame, k: int) -> DataFrame:
    """query_id, rank, vec_id, score: the ``k`` best of each query, ties to the smaller vec_id.

    A query has at most ``k`` rows from each block it met, so its group is bounded by the number of blocks.
    """
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    best = found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
    return best.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def exact_products(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Inner products of the rows of two 64-bit integer matrices, exact; one beyond 64 bits becomes the nearest long.

    Both sides decide together: doubles serve while no sum can pass 2^53.
    """
    most = [max(int(x.max(initial=0)), -int(x.min(initial=0))) for x in (left, right)]
    rough = left.astype(np.float64) @ right.astype(np.float64).T
    if left.shape[1] * most[0] * most[1] <= 1 << 53:
        return rough.astype(np.int64)
    out = left @ right.T
    for i, j in np.argwhere(np.abs(rough) >= 2.0**62).tolist():
        exact = sum(a * b for a, b in zip(left[i].tolist(), right[j].tolist()))
        out[i, j] = min(max(exact, -(1 << 63)), (1 << 63) - 1)
    return out


def scaled(column: pa.Array, width: int, scale: int) -> np.ndarray:
    """floor(scale · component) of the rows of a list column of one width, as 64-bit integers."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return np.floor(scale * flat).astype(np.int64).reshape(len(column), width)


def fits_long(column: str, scale: int) -> Column:
    """Whether scale · component fits a 62-bit integer for all components."""
    return ~F.exists(F.col(column), lambda v: F.abs(v.cast("double")) * scale >= float(1 << 62))


def one_row_each(rows: DataFrame, stages) -> DataFrame:
    """One row per vec_id, the one whose other columns sort first. Only ids that do repeat are grouped."""
    others = [c for c in rows.columns if c != "vec_id"]
    again = stages.write(rows.groupBy("vec_id").agg(F.count("*").alias("_n")).filter("_n > 1").select("vec_id"), "repeated")
    if again.isEmpty():
        return rows
    first = rows.join(again, "vec_id", "left_semi").groupBy("vec_id").agg(F.min(F.struct(*others)).alias("_r"))
    return rows.join(again, "vec_id", "left_anti").unionByName(first.select("vec_id", *(F.col(f"_r.{c}").alias(c) for c in others)))
