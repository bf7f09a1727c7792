"""Substring removal by content-defined chunking.

A gear hash rolls over the bytes of every text; a chunk ends where its high bits are zero, so boundaries depend on the
bytes just before them and come back in step soon after an insertion. Chunks are known by digest. The first occurrence
of a chunk in the corpus stays; runs of neighbouring repeated chunks are removed when they are long enough to be a
passage and not a common phrase. Runs can first be extended byte by byte against the text of the chunks' first owners, so
that a passage goes whole although its first and last chunks differ with what stands around it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from xxhash import xxh3_128_digest

from rentloom.llm.common import Stages, bounded_batches, fresh, giving_back, own_columns, text_slices

GEAR_BYTES = 16  # bytes that a boundary looks at
MEAN, LEAST, MOST = 40, 16, 96
RUN = 100  # bytes of the shortest removed run
AROUND = 1024  # bytes of the owner's text on either side of a chunk that a run is extended against


def gear_table(seed: int = 41) -> np.ndarray:
    return np.random.default_rng(seed).integers(0, 1 << 32, 256, dtype=np.uint32)


GEAR = gear_table()


def gear(data: np.ndarray) -> np.ndarray:
    """Gear hash at every byte: each earlier byte's number shifted once more to the left, in 32 bits, so that only the last
    ``GEAR_BYTES`` reach the bits that decide. Doubling adds the shifted hash of ever longer spans."""
    total = GEAR[data]
    span = 1
    while span < GEAR_BYTES:
        total[span:] = total[span:] + (total[:-span] << np.uint32(span))
        span *= 2
    return total


def cuts(text: bytes) -> list[int]:
    """Ends of a text's chunks: at code point boundaries, LEAST to MOST bytes apart but for the last one."""
    n = len(text)
    if n <= LEAST:
        return [n] if n else []
    data = np.frombuffer(text, np.uint8)
    code = gear(data)
    low = np.uint32((1 << GEAR_BYTES) - 1)
    marks = np.flatnonzero((code & low) < np.uint32((1 << GEAR_BYTES) // (MEAN - LEAST))) + 1
    head = (data & 0xC0) != 0x80
    ends, last = [], 0
    for mark in [*marks.tolist(), n]:
        while mark - last > MOST:
            last += MOST
            while not head[last]:
                last -= 1
            ends.append(last)
        if mark == n or (mark - last >= LEAST and head[mark]):
            if mark > last:
                ends.append(mark)
                last = mark
    return ends


def digests(text: bytes, ends: list[int]) -> list[bytes]:
    return [xxh3_128_digest(text[a:b]) for a, b in zip([0, *ends], ends)]


def chunks(docs: DataFrame) -> DataFrame:
    """(doc_id, place, high, low): the first occurrence of each chunk in each row's whole text, its digest in two halves."""
    bounded_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, _, texts in text_slices(batch, "text"):
                rows, places, found = [], [], []
                for row, text in enumerate(texts, a):
                    first: dict[bytes, int] = {}
                    for place, digest in enumerate(digests(text, cuts(text))):
                        first.setdefault(digest, place)
                    rows += [row] * len(first)
                    places += first.values()
                    found += first
                halves = np.frombuffer(b"".join(found), np.int64).reshape(-1, 2)
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id").take(pa.array(rows, pa.int64())), pa.array(places, pa.int32()), pa.array(halves[:, 0].copy()), pa.array(halves[:, 1].copy())],
                    ["doc_id", "place", "high", "low"],
                )

    kind = docs.schema["doc_id"].dataType.simpleString()
    return own_columns(docs, "doc_id", "text").mapInArrow(giving_back(run), f"doc_id {kind}, place int, high bigint, low bigint")


def repeated_chunks(docs: DataFrame) -> DataFrame:
    """(doc_id, place, high, low, first): chunks that a document with a smaller id has too, the least of these ids first.

    A chunk shared by very many documents is reduced to one row by partial aggregation before it is joined.
    """
    table = chunks(docs.filter("doc_id is not null"))
    shared = table.groupBy("high", "low").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last")).filter("first < last")
    # Written, so that the join below is a plain one whose hot keys adaptive execution can split.
    shared = Stages(docs.sparkSession, "chunks").write(shared.drop("last"), "shared")
    return table.join(shared, ["high", "low"]).filter("doc_id > first").select("doc_id", "place", "high", "low", "first")


def repeated_places(docs: DataFrame) -> DataFrame:
    """(doc_id, places): chunks of each document that a document with a smaller id has too; other documents are left out."""
    return repeated_chunks(docs).groupBy("doc_id").agg(F.collect_set("place").alias("places"))


def run_ends(runs: DataFrame) -> DataFrame:
    """(doc_id, place, high, low, first, opens, closes): the first and the last chunk of each stretch of places with one owner."""
    near = "i {0} 0 or c[i {1} 1].place <> x.place {1} 1 or c[i {1} 1].first <> x.first"
    opens, closes = near.format("=", "-"), near.format("= size(c) - 1 +", "+")
    return (
        runs.selectExpr("doc_id", "array_sort(chunks) as c")
        .selectExpr("doc_id", f"inline(filter(transform(c, (x, i) -> struct(x.place, x.high, x.low, x.first, {opens} as opens, {closes} as closes)), y -> y.opens or y.closes))")
    )


def surroundings(docs: DataFrame, ends: DataFrame) -> DataFrame:
    """(high, low, before, after): AROUND bytes on either side of the wanted chunks in the text of their first owner."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for text, wanted in zip(batch.column("text").to_pylist(), batch.column("wanted").to_pylist()):
                raw = (text or "").encode()
                bounds = [0, *cuts(raw)]
                first: dict[bytes, int] = {}
                for place, digest in enumerate(digests(raw, bounds[1:])):
                    first.setdefault(digest, place)
                for x in wanted:
                    place = first.get(np.array([x["high"], x["low"]], np.int64).tobytes())
                    if place is not None:
                        start, end = bounds[place], bounds[place + 1]
                        rows.append((x["high"], x["low"], raw[max(0, start - AROUND) : start] if x["opens"] else b"", raw[end : end + AROUND] if x["closes"] else b""))
            types = [pa.int64(), pa.int64(), pa.binary(), pa.binary()]
            columns = zip(*rows) if rows else [[]] * 4
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], ["high", "low", "before", "after"])

    wanted = ends.groupBy("first", "high", "low").agg(F.max("opens").alias("opens"), F.max("closes").alias("closes"))
    wanted = wanted.groupBy(F.col("first").alias("doc_id")).agg(F.collect_list(F.struct("high", "low", "opens", "closes")).alias("wanted"))
    found = own_columns(docs, "doc_id", "text").join(wanted, "doc_id").select("text", "wanted")
    return found.mapInArrow(giving_back(run), "high bigint, low bigint, before binary, after binary").groupBy("high", "low").agg(F.min(F.struct("before", "after")).alias("x")).select("high", "low", "x.*")


def repeated_places_and_edges(docs: DataFrame) -> DataFrame:
    """(doc_id, places, edges): as repeated_places, with what stands around the ends of runs in their owners' texts."""
    stages = Stages(docs.sparkSession, "edges")
    runs = stages.write(repeated_chunks(docs).groupBy("doc_id").agg(F.collect_set(F.struct("place", "high", "low", "first")).alias("chunks")), "runs")
    # Written, so that the joins are plain ones whose hot keys adaptive execution can split.
    around = stages.write(surroundings(docs, run_ends(runs)), "around")
    sides = [F.when(F.col(flag), F.col(side)).otherwise(F.lit(b"")).alias(side) for flag, side in (("opens", "before"), ("closes", "after"))]
    edges = run_ends(runs).join(around, ["high", "low"]).groupBy("doc_id").agg(F.collect_list(F.struct("place", *sides)).alias("edges"))
    return runs.selectExpr("doc_id", "chunks.place as places").join(edges, "doc_id", "left")


def same_bytes(a: bytes, b: bytes) -> int:
    """Length of the longest common prefix."""
    low, high = 0, min(len(a), len(b))
    while low < high:
        middle = (low + high + 1) // 2
        if a[:middle] == b[:middle]:
            low = middle
        else:
            high = middle - 1
    return low


def whole_spans(text: bytes, places: list[int], edges: list[dict]) -> list[tuple[int, int]]:
    """As spans, with every run first extended as far as the text agrees with its owner's, or with its own earlier place."""
    bounds = [0, *cuts(text)]
    first: dict[bytes, int] = {}
    found, own = [], []
    for place, digest in enumerate(digests(text, bounds[1:])):
        earlier = first.setdefault(digest, place)
        if earlier < place:
            own.append((place, earlier))
            found.append((bounds[place], bounds[place + 1]))
    found += [(bounds[p], bounds[p + 1]) for p in places if p + 1 < len(bounds)]

    def add(start: int, end: int, left: int, right: int) -> None:
        start, end = start - left, end + right
        while text[start] & 0xC0 == 0x80:
            start += 1
        while end < len(text) and text[end] & 0xC0 == 0x80:
            end -= 1
        found.append((start, end))

    for x in edges:
        if x["place"] + 1 < len(bounds):
            start, end = bounds[x["place"]], bounds[x["place"] + 1]
            left = same_bytes(text[max(0, start - AROUND) : start][::-1], x["before"][::-1])
            add(start, end, left, same_bytes(text[end : end + AROUND], x["after"]))
    pairs = set(own)
    for place, earlier in own:
        if (place - 1, earlier - 1) not in pairs or (place + 1, earlier + 1) not in pairs:
            (s, e), (t, f) = bounds[place : place + 2], bounds[earlier : earlier + 2]
            left = same_bytes(text[max(0, s - AROUND) : s][::-1], text[max(0, t - AROUND) : t][::-1])
            add(s, e, left, same_bytes(text[e : e + AROUND], text[f : f + AROUND]))
    merged: list[list[int]] = []
    for start, end in sorted(found):
        if merged and start <= merged[-1][1]:
            merged[-1][1] = max(merged[-1][1], end)
        else:
            merged.append([start, end])
    return [(s, e) for s, e in merged if e - s >= RUN]


def spans(text: bytes, places: list[int]) -> list[tuple[int, int]]:
    """Byte spans of runs of repeated chunks with at least RUN bytes: the given places, and repeats inside the text."""
    ends = cuts(text)
    known = digests(text, ends)
    seen: set[bytes] = set()
    again = np.zeros(len(ends) + 2, bool)
    for place, digest in enumerate(known):
        again[place + 1] = digest in seen
        seen.add(digest)
    again[[p + 1 for p in places if p < len(ends)]] = True
    bounds = np.array([0, *ends])
    begin = np.flatnonzero(again[1:] & ~again[:-1])
    stop = np.flatnonzero(again[:-1] & ~again[1:])
    return [(s, e) for s, e in zip(bounds[begin].tolist(), bounds[stop].tolist()) if e - s >= RUN]


def without_spans(text: bytes, found: list[tuple[int, int]]) -> bytes:
    at, out = 0, []
    for start, end in found:
        out.append(text[at:start])
        at = end
    return b"".join([*out, text[at:]])


def remove_repeats(docs: DataFrame, spans_column: str | None = None, whole: bool = False) -> DataFrame:
    """All rows and columns of ``docs`` with repeated passages cut out of ``text``; optionally their byte spans as a column.

    With ``whole``, runs are extended byte by byte before they are measured; else they end where chunks end.
    The first occurrence in (doc_id, place) order stays. A null or empty text and a row with a null id stay as they are;
    a text of repeated passages only becomes empty. Rows with the same id are one document with one set of repeated
    places. An empty table stays empty.
    """
    bounded_batches(docs.sparkSession)
    names, again = docs.columns, fresh(docs, "places")
    own = own_columns(docs, "doc_id", "text")
    repeats = repeated_places_and_edges(own) if whole else repeated_places(own)
    repeats = repeats.select("doc_id", F.struct(*[x for x in repeats.columns if x != "doc_id"]).alias(again))
    joined = docs.join(repeats, "doc_id", "left").select(*names, again)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at = names.index("text")
        for batch in batches:
            texts, found = [], []
            for text, repeats in zip(batch.column("text").to_pylist(), batch.column(again).to_pylist()):
                raw, repeats = (text or "").encode(), repeats or {}
                places = repeats.get("places") or []
                own = whole_spans(raw, places, repeats.get("edges") or []) if whole else spans(raw, places)
                texts.append(without_spans(raw, own).decode() if own else text)
                found.append([{"start": s, "end": e} for s, e in own])
            columns = [*batch.columns[: len(names)]]
            columns[at] = pa.array(texts, columns[at].type)
            if spans_column:
                columns.append(pa.array(found, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))))
            yield pa.RecordBatch.from_arrays(columns, [*names, *([spans_column] if spans_column else [])])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema)
    if spans_column:
        schema += f", `{spans_column}` array<struct<start:bigint,end:bigint>>"
    return joined.mapInArrow(giving_back(run), schema)
