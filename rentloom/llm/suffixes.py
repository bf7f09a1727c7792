"""Exact substring removal with sorted suffixes.

A byte goes if a string of ``LENGTH`` bytes over it also starts somewhere else. Sorting every suffix of a corpus is not
needed for that: every window of LENGTH bytes is filed under an anchor, the position in it whose k-gram has the least
hash. Equal windows have equal anchors at equal offsets, so only anchors whose k-gram occurs twice matter. An anchor's
context (all windows filed under it) that occurs twice is decided at once by its hash. What is left are the edges of repeated
passages: their contexts are fetched, and in each group of one k-gram the suffixes that start at the anchors, and the
reversed prefixes that end there, are sorted deep-shallow: multikey quicksort over eight-byte characters to a shallow
depth, then blind tries for suffixes that still agree. Longest common prefixes of neighbours then tell for every offset
which windows are equal.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from xxhash import xxh3_64_intdigest, xxh3_128_digest

from rentloom.llm.common import Stages, bounded_batches, mix64, own_columns, ragged_index, text_slices

LENGTH, GRAM = 200, 32
WINDOW = LENGTH - GRAM + 1  # k-grams in a window
SECTION = 1 << 20
SHALLOW = 8  # eight-byte characters that multikey quicksort looks at
GROUP_CONTEXTS = 20_000  # larger groups go by the hashes of their windows
BATCH_CONTEXTS = 40_000
EMPTY = np.zeros(0, np.int64)

_rng = np.random.default_rng(20190731)
BYTE = _rng.integers(1, 1 << 63, 256, dtype=np.uint64)
BASE = int(_rng.integers(1, 1 << 62)) * 4 + 3


def powers(n: int, base: int) -> np.ndarray:
    factors = np.full(n, base & (1 << 64) - 1, np.uint64)
    factors[0] = 1
    return np.multiply.accumulate(factors)


class Anchors:
    """Anchors of all windows in joined texts."""

    def __init__(self):
        self.up = powers(SECTION + LENGTH + 1, BASE)
        self.down = powers(SECTION + LENGTH + 1, pow(BASE, -1, 1 << 64))

    def of(self, data: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, ...]:
        """(k-gram hash, anchor, first and last window start) in the joined bytes; ``ends`` closes each text."""
        out = []
        stop_of = np.repeat(ends, np.diff(np.append(0, ends)))
        for begin in range(0, max(len(data) - LENGTH + 1, 0), SECTION):
            part = data[begin : begin + SECTION + LENGTH - 1]
            sums = np.zeros(len(part) + 1, np.uint64)
            np.cumsum(BYTE[part] * self.up[: len(part)], out=sums[1:])
            grams = mix64((sums[GRAM:] - sums[:-GRAM]) * self.down[: len(part) - GRAM + 1])
            least = (grams & ~np.uint64(0xFFFFFF)) | np.arange(len(grams), dtype=np.uint64)
            span = 1
            while 2 * span <= WINDOW:
                least = np.minimum(least[:-span], least[span:])
                span *= 2
            if WINDOW > span:
                least = np.minimum(least[: span - WINDOW], least[WINDOW - span :])
            starts = np.arange(begin, begin + len(least))
            valid = starts + LENGTH <= stop_of[begin : begin + len(least)]
            starts = starts[valid]
            if not len(starts):
                continue
            anchor = (least[valid] & np.uint64(0xFFFFFF)).astype(np.int64)
            new = np.empty(len(starts), bool)
            new[0] = True
            new[1:] = (anchor[1:] != anchor[:-1]) | (starts[1:] != starts[:-1] + 1)
            first = np.flatnonzero(new)
            last = np.append(first[1:], len(starts)) - 1
            out.append((grams[anchor[first]], anchor[first] + begin, starts[first], starts[last]))
        if not out:
            return np.zeros(0, np.uint64), EMPTY, EMPTY, EMPTY
        return tuple(np.concatenate(x) for x in zip(*out))


def anchors(docs: DataFrame) -> DataFrame:
    """(gram, context, doc_id, place): each anchor of each whole text; place packs anchor, its distance from the first window
    start, and the number of further window starts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        finder = Anchors()
        for batch in batches:
            for a, _, texts in text_slices(batch, "text"):
                raw = b"".join(texts)
                ends = np.cumsum(np.fromiter(map(len, texts), np.int64, len(texts)))
                gram, anchor, low, high = finder.of(np.frombuffer(raw, np.uint8), ends)
                row = np.searchsorted(ends, anchor, side="right")
                context = np.fromiter(
                    (xxh3_64_intdigest(raw[x : y + LENGTH], z) for x, y, z in zip(low.tolist(), high.tolist(), (anchor - low).tolist())), np.uint64, len(low)
                )
                place = (anchor - (ends - np.diff(np.append(0, ends)))[row]) << 16 | (anchor - low) << 8 | (high - low)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(gram.astype(np.int64)), pa.array(context.astype(np.int64)), batch.column("doc_id").take(pa.array(row + a)), pa.array(place)],
                    ["gram", "context", "doc_id", "place"],
                )

    kind = docs.schema["doc_id"].dataType.simpleString()
    return own_columns(docs, "doc_id", "text").mapInArrow(run, f"gram bigint, context bigint, doc_id {kind}, place bigint")


def bytes_at(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """Rows of ``wanted`` (gram, copies, doc_id, place) with ``bytes``, the context of each anchor."""
    own = wanted.groupBy("doc_id").agg(F.collect_list(F.struct("gram", "copies", "place")).alias("wanted"))
    joined = own_columns(docs, "doc_id", "text").join(own, "doc_id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column("text").cast(pa.large_binary()).to_pylist()
            lists = batch.column("wanted")
            rows = np.repeat(np.arange(len(lists)), np.diff(lists.offsets.to_numpy()))
            flat = lists.flatten()
            places = flat.field("place").to_numpy()
            low, extra = (places >> 16) - ((places >> 8) & 0xFF), places & 0xFF
            found = [texts[r][x : x + n + LENGTH] for r, x, n in zip(rows.tolist(), low.tolist(), extra.tolist())]
            for at in range(0, len(found), 20_000):
                cut = slice(at, at + 20_000)
                yield pa.RecordBatch.from_arrays(
                    [flat.field("gram").slice(at, 20_000), flat.field("copies").slice(at, 20_000), batch.column("doc_id").take(pa.array(rows[cut])), pa.array(places[cut]), pa.array(found[cut], pa.binary())],
                    ["gram", "copies", "doc_id", "place", "bytes"],
                )

    kind = docs.schema["doc_id"].dataType.simpleString()
    return joined.mapInArrow(run, f"gram bigint, copies bigint, doc_id {kind}, place bigint, bytes binary")


def blind_order(rows: list[bytes]) -> list[int]:
    """Order of byte strings through a blind trie.

    A node is [depth, {byte: child}, one string below]. A string goes down by the branch bytes alone, is compared once with
    the string found there, and is inserted where the two part. Equal strings share a leaf.
    """
    if not rows:
        return []
    root: list | tuple = (0,)  # a leaf is a tuple of equal strings' numbers
    for new in range(1, len(rows)):
        text, node = rows[new], root
        while isinstance(node, list):
            depth, children, sample = node
            key = text[depth] if depth < len(text) else -1
            node = children.get(key) or rows_leaf(sample)
            if key not in children:
                break
        other = rows[node[0]]
        if other == text:
            depth = -1
        else:
            most = min(len(text), len(other))
            low, high = 0, most
            while low < high:
                middle = (low + high + 1) // 2
                if text[:middle] == other[:middle]:
                    low = middle
                else:
                    high = middle - 1
            depth = low
        root = _insert(root, text, new, depth, rows)
    out: list[int] = []
    stack = [root]
    while stack:
        node = stack.pop()
        if isinstance(node, tuple):
            out += node
        else:
            stack += [node[1][k] for k in sorted(node[1], reverse=True)]
    return out


def rows_leaf(sample: int) -> tuple:
    return (sample,)


def _insert(root, text: bytes, new: int, depth: int, rows: list[bytes]):
    """Put string ``new`` below ``root``, parting from its likest string at ``depth``; -1: it equals one."""
    parent, key, node = None, None, root
    while isinstance(node, list) and (depth < 0 or node[0] < depth):
        parent, key = node, text[node[0]] if node[0] < len(text) else -1
        node = node[1][key]
    if depth < 0:
        made = node + (new,)
    elif isinstance(node, list) and node[0] == depth:
        node[1][text[depth] if depth < len(text) else -1] = (new,)
        return root
    else:
        sample = node[0] if isinstance(node, tuple) else node[2]
        other = rows[sample]
        made = [depth, {other[depth] if depth < len(other) else -1: node, text[depth] if depth < len(text) else -1: (new,)}, sample]
    if parent is None:
        return made
    parent[1][key] = made
    return root


def deep_shallow(groups: np.ndarray, rows: list[bytes], width: int) -> tuple[np.ndarray, np.ndarray]:
    """(order, common): rows sorted within their groups, and the common prefix of each with the one before it (-1 at a group's first)."""
    n = len(rows)
    words = -(-width // 8)
    sizes = np.fromiter(map(len, rows), np.int64, n)
    table = np.zeros((n, words * 8), np.uint8)
    data = np.frombuffer(b"".join(rows), np.uint8)
    owner = np.repeat(np.arange(n), sizes)
    table[owner, ragged_index(np.zeros(n, np.int64), sizes)] = data
    characters = table.view(">u8")
    order = np.argsort(groups, kind="stable")
    bounds = np.flatnonzero(np.append(True, groups[order][1:] != groups[order][:-1]))
    label = np.cumsum(np.append(True, groups[order][1:] != groups[order][:-1])) - 1  # ties of the place, by position
    firsts = bounds
    for depth in range(min(SHALLOW, words)):
        counts = np.diff(np.append(firsts, n))
        open_places = np.flatnonzero(counts[label] > 1)
        if not len(open_places):
            break
        values = characters[order[open_places], depth].astype(np.uint64)
        inner = np.lexsort((values, label[open_places]))
        order[open_places] = order[open_places][inner]
        values = values[inner]
        starts = np.zeros(n, bool)
        starts[firsts] = True
        same = np.flatnonzero((values[1:] != values[:-1]) & (label[open_places][1:] == label[open_places][:-1]))
        starts[open_places[same + 1]] = True
        firsts = np.flatnonzero(starts)
        label = np.cumsum(starts) - 1
    counts = np.diff(np.append(firsts, n))
    for first, many in zip(firsts[counts > 1].tolist(), counts[counts > 1].tolist()):
        own = order[first : first + many]
        order[first : first + many] = own[blind_order([rows[i] for i in own.tolist()])]
    common = np.full(n, -1, np.int64)
    before, after = order[:-1], order[1:]
    together = groups[before] == groups[after]
    most = np.minimum(sizes[before], sizes[after])
    differ = table[before] != table[after]
    first_difference = np.where(differ.any(1), differ.argmax(1), words * 8)
    common[1:] = np.where(together, np.minimum(first_difference, most), -1)
    return order, common


def repeated_windows(groups: np.ndarray, copies: np.ndarray, places: np.ndarray, found: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(context, window start counted from the context's first byte) of windows that occur in another context of the group."""
    before = (places >> 8) & 0xFF
    extra = places & 0xFF
    right_order, right_common = deep_shallow(groups, [c[b:] for c, b in zip(found, before.tolist())], LENGTH)
    left_order, left_common = deep_shallow(groups, [c[:b][::-1] for c, b in zip(found, before.tolist())], WINDOW + 7)
    n = len(found)
    single = copies == 1
    contexts, starts = [], []
    right, left = np.empty(n, np.int64), np.empty(n, np.int64)
    for back in range(WINDOW):
        eligible = np.flatnonzero((before >= back) & (before - back <= extra))
        if not len(eligible):
            continue
        right[right_order] = np.cumsum(right_common < LENGTH - back)
        left[left_order] = np.cumsum(left_common < back)
        code = right[eligible] * (n + 1) + left[eligible]
        _, which, many = np.unique(code, return_inverse=True, return_counts=True)
        hit = eligible[(many[which] > 1) & single[eligible]]
        contexts.append(hit)
        starts.append(before[hit] - back)
    return np.concatenate(contexts or [EMPTY]), np.concatenate(starts or [EMPTY])


def _spans(doc_ids: pa.Array, low: np.ndarray, contexts: np.ndarray, starts: np.ndarray) -> pa.RecordBatch:
    """Joined spans (doc_id, start, end) of the repeated windows of each context."""
    order = np.lexsort((starts, contexts))
    contexts, starts = contexts[order], starts[order]
    new = np.append(True, (contexts[1:] != contexts[:-1]) | (starts[1:] != starts[:-1] + 1)) if len(starts) else np.zeros(0, bool)
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(starts)) - 1 if len(first) else first
    base = low[contexts[first]]
    return pa.RecordBatch.from_arrays(
        [doc_ids.take(pa.array(contexts[first])), pa.array(base + starts[first]), pa.array(base + starts[last] + LENGTH)], ["doc_id", "start", "end"]
    )


def sorted_groups(contexts: DataFrame, kind: str) -> DataFrame:
    """Spans found by sorting the suffixes of whole groups; a task takes several groups at a time, each of bounded size."""

    def solve(table: pa.Table) -> pa.RecordBatch:
        groups, copies, places = (table.column(c).to_numpy() for c in ("gram", "copies", "place"))
        hit, starts = repeated_windows(groups, copies, places, table.column("bytes").to_pylist())
        low = (places >> 16) - ((places >> 8) & 0xFF)
        return _spans(table.column("doc_id").combine_chunks(), low, hit, starts)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            held.append(batch)
            if sum(b.num_rows for b in held) >= BATCH_CONTEXTS:
                table = pa.Table.from_batches(held)
                grams = table.column("gram").to_numpy()
                cut = int(np.searchsorted(grams, grams[-1]))  # the last group may go on
                if cut:
                    yield solve(table.slice(0, cut))
                held = table.slice(cut).to_batches()
        if held:
            yield solve(pa.Table.from_batches(held))

    together = contexts.repartition("gram").sortWithinPartitions("gram")
    return together.mapInArrow(run, f"doc_id {kind}, start bigint, end bigint")


def hashed_groups(contexts: DataFrame, kind: str) -> DataFrame:
    """Spans in groups of any size: windows meet by their digests, summed before they are shuffled."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                place = part.column("place").to_numpy()
                low, many = (place >> 16) - ((place >> 8) & 0xFF), (place & 0xFF) + 1
                rows = np.repeat(np.arange(part.num_rows), many)
                start = ragged_index(np.zeros(len(many), np.int64), many)
                found = part.column("bytes").to_pylist()
                digest = b"".join(xxh3_128_digest(found[r][s : s + LENGTH]) for r, s in zip(rows.tolist(), start.tolist()))
                halves = np.frombuffer(digest, np.int64).reshape(-1, 2)
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id").take(pa.array(rows)), part.column("copies").take(pa.array(rows)), pa.array(low[rows] + start), pa.array(halves[:, 0].copy()), pa.array(halves[:, 1].copy())],
                    ["doc_id", "copies", "start", "high", "low"],
                )

    windows = contexts.mapInArrow(run, f"doc_id {kind}, copies bigint, start bigint, high bigint, low bigint")
    repeated = windows.groupBy("high", "low").agg(F.sum("copies").alias("c")).filter("c > 1").drop("c")
    hit = windows.filter("copies = 1").join(repeated, ["high", "low"])
    return hit.select("doc_id", "start", (F.col("start") + LENGTH).alias("end"))


def repeated_spans(docs: DataFrame, stages: Stages) -> DataFrame:
    """(doc_id, start, end): byte spans, possibly overlapping, that together cover all repeated windows."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    named = docs.filter("doc_id is not null")
    table = stages.write(anchors(named), "anchors")
    # Written, so that the join below is a plain one whose hot keys adaptive execution can split.
    again = stages.write(table.groupBy("gram").agg(F.count("*").alias("c")).filter("c > 1").select("gram"), "again")
    shared = stages.write(table.join(again, "gram"), "shared")
    stages.drop(table)
    kinds = shared.groupBy("gram", "context").agg(F.count("*").alias("copies"), F.min(F.struct("doc_id", "place")).alias("one"))
    kinds = stages.write(kinds, "kinds")
    known = shared.join(kinds.filter("copies > 1").select("gram", "context"), ["gram", "context"])
    low = F.shiftright("place", 16) - F.shiftright("place", 8).bitwiseAND(F.lit(255))
    whole = known.select("doc_id", low.alias("start"), (low + F.col("place").bitwiseAND(F.lit(255)) + LENGTH).alias("end"))
    groups = kinds.groupBy("gram").agg(F.count("*").alias("kinds")).filter("kinds > 1")
    edges = kinds.join(groups, "gram").select("gram", "copies", "kinds", "one.doc_id", "one.place")
    contexts = stages.write(bytes_at(named, edges.drop("kinds")).join(groups, "gram"), "contexts")
    small, large = contexts.filter(F.col("kinds") <= GROUP_CONTEXTS), contexts.filter(F.col("kinds") > GROUP_CONTEXTS)
    return whole.unionByName(sorted_groups(small.drop("kinds"), kind)).unionByName(hashed_groups(large.drop("kinds"), kind))


def remove_repeats(docs: DataFrame) -> DataFrame:
    """(doc_id, n_bytes, kept, spans) of every row: the bytes that stay, joined, and the maximal removed byte spans.

    A null text is empty; a text shorter than LENGTH loses nothing. Rows with a null id take no part and keep their text.
    Repeated rows repeat each other, so their long strings go from both. An empty table gives an empty result; other
    columns are not read. Ids name one text each.
    """
    bounded_batches(docs.sparkSession)
    stages = Stages(docs.sparkSession, "suffixes")
    kind = docs.schema["doc_id"].dataType.simpleString()
    found = repeated_spans(docs, stages).groupBy("doc_id").agg(F.collect_list(F.struct("start", "end")).alias("found"))
    joined = own_columns(docs, "doc_id", "text").join(found, "doc_id", "left")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, kept, spans = [], [], []
            lists = batch.column("found")
            flat = lists.flatten()
            starts, ends = (flat.field(i).to_numpy() for i in (0, 1))
            offsets = np.append(0, np.cumsum(np.array([0 if x is None else x for x in lists.value_lengths().to_pylist()], np.int64)))
            for row, text in enumerate(batch.column("text").cast(pa.large_binary()).fill_null(b"").to_pylist()):
                sizes.append(len(text))
                own = slice(offsets[row], offsets[row + 1])
                if own.start == own.stop:
                    kept.append(text)
                    spans.append([])
                    continue
                change = np.zeros(len(text) + 1, np.int64)
                np.add.at(change, starts[own], 1)
                np.add.at(change, ends[own], -1)
                gone = np.cumsum(change)[:-1] > 0
                edges = np.flatnonzero(np.diff(np.concatenate([[False], gone, [False]]).astype(np.int8)))
                spans.append([{"start": a, "end": b} for a, b in edges.reshape(-1, 2).tolist()])
                kept.append(np.frombuffer(text, np.uint8)[~gone].tobytes())
            span = pa.struct([("start", pa.int64()), ("end", pa.int64())])
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(sizes, pa.int64()), pa.array(kept, pa.binary()), pa.array(spans, pa.list_(span))], ["doc_id", "n_bytes", "kept", "spans"]
            )

    return joined.mapInArrow(run, f"doc_id {kind}, n_bytes bigint, kept binary, spans array<struct<start:bigint,end:bigint>>")
