"""Helpers shared by the corpus operators: Arrow slices of bounded size, staged tables, word hashes, ragged arrays."""

from __future__ import annotations

import ctypes
import gc
import tempfile
import uuid
from collections.abc import Callable, Iterator
from pathlib import Path
from zipfile import ZipFile

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from xxhash import xxh3_64_intdigest

WORD = "[^\x20\x09-\x0d]+"
ARROW_BATCH_BYTES = 8 << 20


def bounded_batches(spark: SparkSession) -> None:
    """Bound the Arrow batches that go to Python by bytes, so that very long texts cannot fill a worker."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(ARROW_BATCH_BYTES))
    ship_package(spark)


def ship_package(spark: SparkSession) -> None:
    """Send this package's modules to the executors once per application; they need no installed copy."""
    context = spark.sparkContext
    if getattr(context, "_llm_shipped", False):
        return
    top = Path(__file__).resolve().parents[1]
    target = Path(tempfile.mkdtemp(prefix="llm-code-")) / "llm_code.zip"
    with ZipFile(target, "w") as out:
        for file in sorted(top.rglob("*.py")):
            out.write(file, file.relative_to(top.parent))
    context.addPyFile(str(target))
    context._llm_shipped = True


def shared_folder(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``; a temporary one only where that is unset and the master is local."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if base is None:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a shared folder on a cluster")
        base = tempfile.mkdtemp(prefix="llm-stage-")
        spark.conf.set("spark.checkpoint.dir", base)
    return base.rstrip("/")


class Stages:
    """Tables written once to the shared folder and read again: a cut in the lineage that survives lost executors."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.root = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
        self.count = 0

    def write(self, df: DataFrame, name: str) -> DataFrame:
        self.count += 1
        path = f"{self.root}/{self.count:03d}-{name}"
        df.write.parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        out._stage_path = path
        return out

    def measured(self, df: DataFrame, name: str, *sums: Column) -> tuple[DataFrame, tuple]:
        """The written table and what ``sums`` come to, taken while it is written, so that it is not read again for them."""
        seen = Observation()
        named = [x.alias(f"m{i}") for i, x in enumerate(sums)]
        out = self.write(df.observe(seen, *named), name)
        return out, tuple(seen.get[f"m{i}"] for i in range(len(sums)))

    def together(self, *tables: DataFrame) -> DataFrame:
        """Staged tables of one schema as a single scan."""
        paths = [p for t in tables for p in (t._stage_path if isinstance(t._stage_path, list) else [t._stage_path])]
        out = self.spark.read.schema(tables[0].schema).parquet(*paths)
        out._stage_path = paths
        return out

    def drop(self, *tables: DataFrame) -> None:
        """Delete staged tables that no later step reads."""
        jvm = self.spark._jvm
        conf = self.spark._jsc.hadoopConfiguration()
        for df in tables:
            for name in df._stage_path if isinstance(df._stage_path, list) else [df._stage_path]:
                path = jvm.org.apache.hadoop.fs.Path(name)
                path.getFileSystem(conf).delete(path, True)


def give_back() -> None:
    """Return the memory of freed arrays and collected batches to the system; a driver runs many stages one after the other."""
    gc.collect()
    _trim()


def _trim() -> None:
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def giving_back(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """``run``, returning a task's memory when it ends: Spark keeps Python workers for later tasks and stages, and what they hold counts with theirs."""

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            _trim()

    return whole


def text_slices(batch: pa.RecordBatch, column: str, limit: int = 1 << 20) -> Iterator[tuple[int, int, list[bytes]]]:
    """(first row, row after the last, UTF-8 texts) of neighbouring rows whose texts hold about ``limit`` bytes; null is empty.

    A single longer text is a slice of its own, whole.
    """
    texts = batch.column(column).cast(pa.large_binary()).fill_null(b"")
    sizes = np.diff(np.frombuffer(texts.buffers()[1], np.int64, len(texts) + 1, texts.offset * 8))
    start, held = 0, 0
    for row, size in enumerate(sizes.tolist()):
        if held and held + size > limit:
            yield start, row, texts.slice(start, row - start).to_pylist()
            start, held = row, 0
        held += size
    if start < len(texts):
        yield start, len(texts), texts.slice(start).to_pylist()


def ragged_index(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Positions start, start + 1, … of every (start, length) run, one run after the other."""
    total = int(lengths.sum())
    ends = np.cumsum(lengths)
    return np.arange(total, dtype=np.int64) + np.repeat(starts - (ends - lengths), lengths)


def mix32(x: np.ndarray) -> np.ndarray:
    """A bijection of 32-bit numbers that spreads every input bit."""
    x = x ^ (x >> np.uint32(16))
    x *= np.uint32(0x7FEB352D)
    x ^= x >> np.uint32(15)
    x *= np.uint32(0x846CA68B)
    x ^= x >> np.uint32(16)
    return x


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every input bit."""
    x = x ^ (x >> np.uint64(33))
    x *= np.uint64(0xFF51AFD7ED558CCD)
    x ^= x >> np.uint64(33)
    x *= np.uint64(0xC4CEB9FE1A85EC53)
    x ^= x >> np.uint64(33)
    return x


class HashCache(dict):
    """word → 64-bit hash; emptied when it holds ``most`` words, so a worker's memory stays bounded."""

    def __init__(self, most: int = 400_000):
        super().__init__()
        self.most = most

    def __missing__(self, word: bytes) -> int:
        value = xxh3_64_intdigest(word)
        if len(self) >= self.most:
            self.clear()
        self[word] = value
        return value

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


def documents(spark: SparkSession, sf_dir: str, name: str = "documents") -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def own_columns(df: DataFrame, *columns: str) -> DataFrame:
    """Only the named columns, so that extra ones with clashing names cannot meet an operator's own."""
    return df.select(*[F.col(c) for c in columns])


def fresh(df: DataFrame, name: str) -> str:
    """A column name that ``df`` does not have."""
    while name in df.columns:
        name += "_"
    return name
