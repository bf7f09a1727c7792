"""Byte-level BPE with vectorised pre-tokenisation.

Words of the pre-tokenizer are found without regular expressions. Every code point gets a symbol from class arrays and
two code points of look-ahead; an automaton over these symbols says where a word starts. Its transition functions
compose associatively, so blocks of text are scanned for all start states at once, the block functions are composed
by doubling, and a last pass reads the word starts. Equal slices are merged once and kept in a bounded cache.
"""

from __future__ import annotations

import base64
import sys
import unicodedata
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rentloom.llm.common import bounded_batches, giving_back, own_columns, ragged_index, text_slices

LETTER, NUMBER, OTHER, SHORT, LONG, PREFIX, SPACE, LAST, END = range(9)
FRESH, IN_LETTERS, IN_NUMBERS, IN_OTHERS, IN_SPACES, PREFIXED, TWO_MORE, ONE_MORE = range(8)
SYMBOLS, STATES, BLOCK = 9, 8, 64

# Code points of Unicode's White_Space property.
WHITE_SPACE = [*range(0x09, 0x0E), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]


def automaton() -> tuple[np.ndarray, np.ndarray]:
    """Next state and "a word starts here", by state · SYMBOLS + symbol."""
    step = np.zeros((STATES, SYMBOLS), np.uint8)
    starts = np.ones((STATES, SYMBOLS), bool)
    run_of = {LETTER: IN_LETTERS, NUMBER: IN_NUMBERS, OTHER: IN_OTHERS, SPACE: IN_SPACES}
    for state in range(STATES):
        for symbol, run in run_of.items():
            step[state, symbol] = run
            starts[state, symbol] = state != run
        step[state, SHORT], step[state, LONG] = ONE_MORE, TWO_MORE
        step[state, PREFIX], step[state, LAST], step[state, END] = PREFIXED, FRESH, FRESH
    for apostrophe in (SHORT, LONG):  # inside a run of signs, or behind a prefix space, it is a plain sign
        step[[IN_OTHERS, PREFIXED], apostrophe] = IN_OTHERS
        starts[[IN_OTHERS, PREFIXED], apostrophe] = False
    starts[PREFIXED, [LETTER, NUMBER, OTHER]] = False
    step[TWO_MORE, LETTER], step[ONE_MORE, LETTER] = ONE_MORE, FRESH
    starts[[TWO_MORE, ONE_MORE], LETTER] = False
    return step.ravel(), starts.ravel()


STEP, STARTS = automaton()


@lru_cache(1)
def class_table() -> np.ndarray:
    """Code point → LETTER, NUMBER, SPACE or OTHER, from the Unicode categories."""
    kinds = {"L": LETTER, "N": NUMBER}
    table = np.fromiter((kinds.get(unicodedata.category(chr(c))[0], OTHER) for c in range(sys.maxunicode + 1)), np.uint8)
    table[WHITE_SPACE] = SPACE
    return table


def symbols_of(points: np.ndarray, end: int) -> np.ndarray:
    """Symbols of code points; ``end`` marks the end of each text."""
    classes = class_table()[np.minimum(points, sys.maxunicode)]
    classes[points == end] = END
    after = np.append(classes[1:], np.uint8(END))
    out = classes.copy()
    last = (classes == SPACE) & (after != SPACE) & (after != END)
    out[last] = LAST
    out[last & (points == 0x20)] = PREFIX
    marks = np.flatnonzero(points == 0x27)
    marks = marks[marks + 2 < len(points)]
    one, two = points[marks + 1], points[marks + 2]
    out[marks[np.isin(one, [ord(c) for c in "stmd"])]] = SHORT
    pairs = np.zeros(len(marks), bool)
    for a, b in ("re", "ve", "ll"):
        pairs |= (one == ord(a)) & (two == ord(b))
    out[marks[pairs]] = LONG
    return out


def scan(symbols: np.ndarray) -> np.ndarray:
    """True where a word starts: block functions for all states, composed by doubling, then one pass with known states."""
    n = len(symbols)
    blocks = -(-n // BLOCK)
    padded = np.full(blocks * BLOCK, END, np.uint8)
    padded[:n] = symbols
    columns = np.ascontiguousarray(padded.reshape(blocks, BLOCK).T)
    reach = np.repeat(np.arange(STATES, dtype=np.uint8)[:, None], blocks, axis=1)
    for column in columns:
        reach = STEP[reach * np.uint8(SYMBOLS) + column]
    span = 1
    while span < blocks:
        reach[:, span:] = np.take_along_axis(reach[:, span:], reach[:, :-span].copy(), axis=0)
        span *= 2
    state = np.empty(blocks, np.uint8)
    state[0] = FRESH
    state[1:] = reach[FRESH, :-1]
    out = np.empty((BLOCK, blocks), bool)
    for row, column in enumerate(columns):
        at = state * np.uint8(SYMBOLS) + column
        out[row] = STARTS[at]
        state = STEP[at]
    return out.T.ravel()[:n]


END_POINT = 0x110000


def word_starts(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(all bytes with one zero byte behind each text, starts of words and ends of texts in them, which of these are ends)."""
    decoded = [t.decode() for t in texts]
    points = np.frombuffer("\x00".join([*decoded, ""]).encode("utf-32-le"), np.uint32).copy()
    data = np.frombuffer(b"\x00".join([*texts, b""]), np.uint8)
    ends = np.cumsum(np.fromiter(map(len, decoded), np.int64, len(texts)) + 1) - 1
    points[ends] = END_POINT
    starts = scan(symbols_of(points, END_POINT))
    widths = (1 + (points >= 0x80) + (points >= 0x800) + (points >= 0x10000)).astype(np.int64)
    widths[ends] = 1
    at = np.cumsum(widths) - widths
    marks = np.flatnonzero(starts)
    return data, at[marks], points[marks] == END_POINT


class Merger:
    """Byte pairs merged by rank, the lowest first."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks

    def __call__(self, words: list[bytes]) -> list[list[int]]:
        return [self.one(w) for w in words]

    def one(self, word: bytes) -> list[int]:
        ranks = self.ranks
        if word in ranks:
            return [ranks[word]]
        if len(word) > 256:
            return self.long(word)
        parts = [word[i : i + 1] for i in range(len(word))]
        none = len(ranks) + 1
        pairs = [ranks.get(a + b, none) for a, b in zip(parts, parts[1:])]
        while pairs:
            best = min(pairs)
            if best == none:
                break
            i = pairs.index(best)
            parts[i] += parts.pop(i + 1)
            pairs.pop(i)
            if i < len(pairs):
                pairs[i] = ranks.get(parts[i] + parts[i + 1], none)
            if i:
                pairs[i - 1] = ranks.get(parts[i - 1] + parts[i], none)
        return [ranks[p] for p in parts]

    def long(self, word: bytes) -> list[int]:
        """The same merges for long words, through a heap over a linked list of parts."""
        from heapq import heapify, heappop, heappush

        ranks, n = self.ranks, len(word)
        end = list(range(1, n + 1))  # end of the part that starts at i; 0: i starts no part
        before = list(range(-1, n - 1))
        heap = [(r, i, i + 2) for i in range(n - 1) if (r := ranks.get(word[i : i + 2])) is not None]
        heapify(heap)
        while heap:
            rank, i, stop = heappop(heap)
            middle = end[i]
            if not middle or middle >= n or end[middle] != stop:
                continue
            end[i], end[middle] = stop, 0
            if stop < n:
                before[stop] = i
                if (r := ranks.get(word[i : end[stop]])) is not None:
                    heappush(heap, (r, i, end[stop]))
            if (left := before[i]) >= 0 and (r := ranks.get(word[left:stop])) is not None:
                heappush(heap, (r, left, stop))
        out, i = [], 0
        while i < n:
            out.append(ranks[word[i : end[i]]])
            i = end[i]
        return out


@lru_cache(2)
def load_ranks(path: str) -> dict[bytes, int]:
    """token bytes → id of a ranks file; the path must be readable on every executor."""
    with open(path, "rb") as file:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, file)}


HEAD_MASKS = np.array([(1 << 8 * n) - 1 for n in range(9)], np.uint64)


def heads(data: np.ndarray, begin: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The first eight bytes of each word as one number; shorter words are filled up with zero bytes."""
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    windows = np.lib.stride_tricks.sliding_window_view(padded, 8)[begin]
    return windows.view("<u8").ravel() & HEAD_MASKS[np.minimum(lengths, 8)]


class Encoder:
    """Texts → ids, in slices of many texts at once. ``merge`` turns words into ids.

    Merged words are kept in arrays sorted by a 64-bit hash of their bytes and length. The hash only finds a word: its
    bytes are compared with the kept ones, and words that share a hash with another are merged on their own. The arrays
    are emptied beyond ``most`` words or ``MOST_BYTES`` bytes.
    """

    MOST_BYTES = 32 << 20

    def __init__(self, merge: Callable[[list[bytes]], list[list[int]]], most: int = 500_000):
        self.merge = merge
        self.most = most
        self.forget()
        rng = np.random.default_rng(20240229)
        self.byte = rng.integers(1, 1 << 63, 256, dtype=np.uint64)
        self.base = int(rng.integers(1, 1 << 62)) * 4 + 3
        self.powers = self.inverse = np.ones(0, np.uint64)

    def forget(self) -> None:
        self.keys, self.entry = np.zeros(0, np.uint64), np.zeros(0, np.int32)  # sorted; the entry of each key
        self.places, self.sizes, self.begins, self.lengths = (np.zeros(1 << 12, np.int32) for _ in range(4))
        self.heads = np.zeros(1 << 12, np.uint64)
        self.ids, self.used = np.zeros(1 << 16, np.uint32), 0
        self.text, self.held = np.zeros(1 << 18, np.uint8), 0

    def _grow(self, n: int) -> None:
        if len(self.powers) < n:
            size = max(n, 1 << 20)
            for name, base in (("powers", self.base), ("inverse", pow(self.base, -1, 1 << 64))):
                factors = np.full(size, base & (1 << 64) - 1, np.uint64)
                factors[0] = 1
                setattr(self, name, np.multiply.accumulate(factors))

    def _merged(self, words: list[bytes]) -> tuple[list[int], np.ndarray]:
        """(ids of all words, number of ids of each)."""
        rows = self.merge(words)
        flat: list[int] = []
        for row in rows:
            flat += row
        return flat, np.fromiter(map(len, rows), np.int32, len(rows))

    def _learn(self, keys: np.ndarray, words: list[bytes]) -> None:
        """Merge words that are new and put them where their keys sort."""
        flat, sizes = self._merged(words)
        lengths = np.fromiter(map(len, words), np.int64, len(words))
        places = self.used + np.cumsum(sizes, dtype=np.int64) - sizes
        begins = self.held + np.cumsum(lengths) - lengths
        self._append("ids", self.used, flat)
        joined = np.frombuffer(b"".join(words), np.uint8)
        self._append("text", self.held, joined)
        known = len(self.keys)
        first = heads(joined, begins - self.held, lengths)
        for name, values in {"places": places, "sizes": sizes, "begins": begins, "lengths": lengths, "heads": first}.items():
            self._append(name, known, values)
        self.used, self.held = self.used + len(flat), self.held + int(lengths.sum())
        at = np.searchsorted(self.keys, keys)
        self.keys = np.insert(self.keys, at, keys)
        self.entry = np.insert(self.entry, at, np.arange(known, known + len(keys), dtype=np.int32))

    def _append(self, name: str, start: int, more) -> None:
        """Put values behind the first ``start`` of an array that doubles when it is full."""
        own = getattr(self, name)
        if start + len(more) > len(own):
            own = np.concatenate([own, np.zeros(max(len(more), len(own)), own.dtype)])
            setattr(self, name, own)
        own[start : start + len(more)] = more

    def _strangers(self, data: np.ndarray, begin: np.ndarray, stop: np.ndarray, entry: np.ndarray) -> np.ndarray:
        """Words whose length or bytes are not those kept in their entries. Up to eight bytes are compared as one number."""
        lengths = stop - begin
        strange = (self.lengths[entry] != lengths) | (self.heads[entry] != heads(data, begin, lengths))
        long = np.flatnonzero(~strange & (lengths > 8))
        if len(long):
            rest = lengths[long] - 8
            unlike = data[ragged_index(begin[long] + 8, rest)] != self.text[ragged_index(self.begins[entry[long]] + 8, rest)]
            if unlike.any():
                strange[long] = np.logical_or.reduceat(unlike, np.cumsum(rest) - rest)
        return np.flatnonzero(strange)

    def encode(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts, number of ids of each text)."""
        data, marks, ends = word_starts(texts)
        self._grow(len(data) + 1)
        sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(self.byte[data] * self.powers[: len(data)], out=sums[1:])
        words = np.flatnonzero(~ends)
        begin, stop = marks[words], np.append(marks, len(data))[words + 1]
        keys = (sums[stop] - sums[begin]) * self.inverse[begin]
        keys ^= (stop - begin).astype(np.uint64)
        unique, first, which = np.unique(keys, return_index=True, return_inverse=True)
        if len(self.keys) > self.most or self.held > self.MOST_BYTES:
            self.forget()
        at = np.minimum(np.searchsorted(self.keys, unique), max(len(self.keys) - 1, 0))
        known = self.keys[at] == unique if len(self.keys) else np.zeros(len(unique), bool)
        new = np.flatnonzero(~known)
        if len(new):
            raw = data.tobytes()
            self._learn(unique[new], [raw[a:b] for a, b in zip(begin[first[new]].tolist(), stop[first[new]].tolist())])
            at = np.searchsorted(self.keys, unique)
        entry = self.entry[at][which]
        lengths, places, table = self.sizes[entry].astype(np.int64), self.places[entry].astype(np.int64), self.ids
        strange = self._strangers(data, begin, stop, entry)
        if len(strange):
            raw = data.tobytes()
            flat, sizes = self._merged([raw[a:b] for a, b in zip(begin[strange].tolist(), stop[strange].tolist())])
            lengths[strange], places[strange] = sizes, self.used + np.cumsum(sizes, dtype=np.int64) - sizes
            table = np.concatenate([self.ids[: self.used], np.array(flat, np.uint32)])
        ids = table[ragged_index(places, lengths)]
        text_of_mark = np.cumsum(ends) - ends
        counts = np.bincount(text_of_mark[words], weights=lengths, minlength=len(texts)).astype(np.int64)
        return ids, counts


class Decoder:
    """ids → bytes, by one gather over all tokens of a slice."""

    def __init__(self, ranks: dict[bytes, int]):
        tokens = sorted(ranks.items(), key=lambda x: x[1])
        size = tokens[-1][1] + 1 if tokens else 0
        self.lengths = np.zeros(size, np.int64)
        for token, i in tokens:
            self.lengths[i] = len(token)
        self.bytes = np.frombuffer(b"".join(t for t, _ in tokens), np.uint8)
        self.starts = np.cumsum(self.lengths) - self.lengths

    def offsets(self, ids: np.ndarray) -> np.ndarray:
        """Byte offset of each id, were the ids one text."""
        lengths = self.lengths[ids]
        return np.cumsum(lengths) - lengths

    def decode(self, ids: np.ndarray) -> bytes:
        return self.bytes[ragged_index(self.starts[ids], self.lengths[ids])].tobytes()


def encode(df: DataFrame, ranks_path: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, n_tokens, ids, offsets): ids of every whole text as little-endian unsigned 32-bit numbers, and where in the
    text's bytes each id starts (64-bit numbers, packed the same way).

    A null or empty text has no ids. Rows are neither merged nor dropped: repeated rows and null keys come back as they
    are. Columns other than ``key`` and ``text`` are left out, whatever their names.
    """
    bounded_batches(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ranks = load_ranks(ranks_path)
        encoder, decoder = Encoder(Merger(ranks)), Decoder(ranks)
        for batch in batches:
            for a, b, texts in text_slices(batch, text):
                ids, counts = encoder.encode(texts)
                offsets = decoder.offsets(ids)
                ends = np.cumsum(counts)
                packed, places = [], []
                for n, end in zip(counts.tolist(), ends.tolist()):
                    own = ids[end - n : end]
                    at = offsets[end - n : end]
                    packed.append(own.astype("<u4").tobytes())
                    places.append((at - at[:1]).astype("<u8").tobytes())
                yield pa.RecordBatch.from_arrays(
                    [batch.column(key).slice(a, b - a), pa.array(counts), pa.array(packed, pa.binary()), pa.array(places, pa.binary())],
                    [key, "n_tokens", "ids", "offsets"],
                )

    kind = df.schema[key].dataType.simpleString()
    return own_columns(df, key, text).mapInArrow(giving_back(run), f"`{key}` {kind}, n_tokens bigint, ids binary, offsets binary")


def decode(df: DataFrame, ranks_path: str, ids: str = "ids", name: str = "decoded") -> DataFrame:
    """All columns and ``name``: the bytes that the packed ids stand for; null for null ids, empty for none."""
    bounded_batches(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decoder = Decoder(load_ranks(ranks_path))
        for batch in batches:
            out = [None if x is None else decoder.decode(np.frombuffer(x, "<u4")) for x in batch.column(ids).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, pa.binary())], [*batch.schema.names, name])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema)
    return df.mapInArrow(giving_back(run), f"{schema}, `{name}` binary")


def token_digests(df: DataFrame, ranks_path: str) -> DataFrame:
    """doc_id, n_tokens and digests of the packed ids and of what they decode to."""
    encoded = encode(df, ranks_path).select("doc_id", "n_tokens", "ids")
    return decode(encoded, ranks_path).select(
        "doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256")
    )
