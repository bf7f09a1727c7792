"""What both text classifiers share: the bounded training sample, word slots and scoring over whole texts."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rentloom.llm.common import bounded_batches, giving_back, own_columns, text_slices


def held_out(key: str = "doc_id") -> Column:
    """Rows that training never sees: crc32 of the key as text is a multiple of 5. False for a null key."""
    return F.coalesce(F.crc32(F.col(key).cast("string").cast("binary")) % 5 == 0, F.lit(False))


def training_rows(docs: DataFrame, labels: DataFrame, label: str, most: int) -> DataFrame:
    """(doc_id, text, label) of at most ``most`` labelled documents outside the held-out fifth.

    ``most`` is the documented bound of the sample: the labelled ids with the smallest hashes. It also bounds the
    broadcast. A document labelled twice counts once, with its larger label; null ids and labels do not count.
    """
    known = labels.filter(F.col("doc_id").isNotNull() & F.col(label).isNotNull() & ~held_out())
    chosen = known.groupBy("doc_id").agg(F.max(label).alias("_label")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)
    texts = own_columns(docs, "doc_id", "text")
    return texts.join(F.broadcast(chosen), "doc_id").withColumnRenamed("_label", "label")


class Slots(dict):
    """word → slot; new words wait in ``pending`` until the owner has computed their rows."""

    def __init__(self):
        super().__init__()
        self.pending: list[bytes] = []

    def __missing__(self, word: bytes) -> int:
        slot = self[word] = len(self)
        self.pending.append(word)
        return slot

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.int64, len(words))

    def new(self) -> list[bytes]:
        out, self.pending = self.pending, []
        return out


class Rows:
    """One row per slot, in an array that doubles when it is full."""

    def __init__(self, *shape: int, kind=np.float64):
        self.shape, self.kind = shape, kind
        self.clear()

    def clear(self) -> None:
        self.data, self.used = np.zeros((1024, *self.shape), self.kind), 0

    def add(self, rows: np.ndarray) -> None:
        end = self.used + len(rows)
        if end > len(self.data):
            wider = np.zeros((max(end, 2 * len(self.data)), *self.shape), self.kind)
            wider[: self.used] = self.data[: self.used]
            self.data = wider
        self.data[self.used : end] = rows
        self.used = end


def score(docs: DataFrame, make: Callable[[], Callable[[list[bytes]], np.ndarray]], threshold: float) -> DataFrame:
    """doc_id, held_out, score and predicted of every row. ``make`` builds, once per task, the function that scores texts."""
    bounded_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = make()
        for batch in batches:
            for a, b, texts in text_slices(batch, "text"):
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id").slice(a, b - a), pa.array(of(texts).astype(np.float64))], ["doc_id", "score"]
                )

    kind = docs.schema["doc_id"].dataType.simpleString()
    scored = own_columns(docs, "doc_id", "text").mapInArrow(giving_back(run), f"doc_id {kind}, score double")
    predicted = (F.col("score") >= threshold).cast("int").alias("predicted")
    return scored.select("doc_id", held_out().alias("held_out"), "score", predicted)


def keep(docs: DataFrame, make: Callable, threshold: float, above: bool) -> DataFrame:
    """The rows of ``docs``, with all their columns, whose score lies on the kept side of the threshold.

    The score is added while rows pass through Python once, so no join by id is needed and rows with equal or null ids
    are each judged by their own text.
    """
    bounded_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = make()
        for batch in batches:
            scores = np.concatenate([of(texts) for _, _, texts in text_slices(batch, "text")] or [np.zeros(0)])
            yield batch.filter(pa.array((scores >= threshold) == above))

    return docs.mapInArrow(giving_back(run), docs.schema)
