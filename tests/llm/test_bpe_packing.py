"""Byte-level BPE and packing against the tokenizer libraries, and the packing contract."""

import hashlib
import random
import zlib

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from tokenizers import Tokenizer

from rentloom.llm import bpe, packing

RANKS, JSON = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.path("byte_bpe_50k.json")
PARTS = ["'", "s", "t", "re", "ve", "ll", "d", "m", " ", "  ", "\n", "\t", "a", "B", "é", "漢", "1", "٣", "!", "?", "_", "😀", "'s", "'re", "́", "\x1c", "\x85", "　", "<|endoftext|>", "ſ", "ꙮ"]
EDGES = [None, "", " ", "\n", "a", "'", "'s", "it's we'll 've 'x", "x" * 5000, "ab" * 3000, " \n\n  tail  ", "é" * 3000 + "!" * 700]
SCHEMA = "doc_id long, text string, ids int, length string"


@pytest.fixture(scope="module")
def library():
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.load_ranks(RANKS), special_tokens={})


def test_encoder_equals_library_on_random_texts(library):
    rng = random.Random(1)
    texts = ["".join(rng.choice(PARTS) for _ in range(rng.randint(0, 30))) for _ in range(5000)]
    ids, counts = bpe.Encoder(bpe.Merger(bpe.load_ranks(RANKS))).encode([t.encode() for t in texts])
    ends = np.cumsum(counts)
    for text, n, end in zip(texts, counts, ends):
        assert ids[end - n : end].tolist() == library.encode_ordinary(text), text


def test_scan_equals_a_walk():
    rng = np.random.default_rng(2)
    for n in (0, 1, 63, 64, 65, 5000):
        symbols = rng.integers(0, 9, n).astype(np.uint8)
        state, want = bpe.FRESH, []
        for s in symbols.tolist():
            want.append(bool(bpe.STARTS[state * bpe.SYMBOLS + s]))
            state = int(bpe.STEP[state * bpe.SYMBOLS + s])
        assert (bpe.scan(symbols).tolist() if n else []) == want


def test_forgetting_words_changes_nothing():
    texts = [b"one two three", b"four five one", b"two"] * 5
    small, large = (bpe.Encoder(bpe.Merger(bpe.load_ranks(RANKS)), most=m) for m in (0, 1000))
    for _ in range(3):
        assert small.encode(texts)[0].tolist() == large.encode(texts)[0].tolist()


@pytest.mark.parametrize("letters", [512, 1024, 2048])
def test_words_with_one_hash_keep_their_own_ids(letters, library):
    """The word of Thue and Morse and its complement share every polynomial hash modulo 2^64."""
    word = "".join("ab"[bin(i).count("1") % 2] for i in range(letters))
    other = word.translate(str.maketrans("ab", "ba"))
    for texts in ([word, other], [f"{word} {other} {word} x"], [f"x {other}", f"{other} {word}"], [word, other, "", word + " " + other]):
        encoder = bpe.Encoder(bpe.Merger(bpe.load_ranks(RANKS)))
        for _ in range(2):
            ids, counts = encoder.encode([t.encode() for t in texts])
            ends = np.cumsum(counts)
            assert [ids[e - n : e].tolist() for n, e in zip(counts, ends)] == [library.encode_ordinary(t) for t in texts]


def test_edges_and_round_trip(spark, library):
    rows = [(i, t, i, "x") for i, t in enumerate(EDGES)] + [(None, "null id", 0, "x"), (3, "\n", 0, "x")]
    df = spark.createDataFrame(rows, SCHEMA)
    got = bpe.token_digests(df, RANKS).collect()
    assert len(got) == len(rows)
    key = lambda r: (r[0] is None, r[0] or 0, r[1])
    want = []
    for i, t, _, _ in rows:
        ids = library.encode_ordinary(t or "")
        want.append((i, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()))
    assert sorted(map(tuple, got), key=key) == sorted(want, key=key)
    assert bpe.token_digests(df.limit(0), RANKS).collect() == []


def test_offsets(spark, library):
    text = "it's a test — ünïcode 123"
    row = bpe.encode(spark.createDataFrame([(1, text)], "doc_id long, text string"), RANKS).first()
    ids, at = np.frombuffer(row.ids, "<u4"), np.frombuffer(row.offsets, "<u8").tolist()
    raw = text.encode()
    assert [raw[a:b] for a, b in zip(at, [*at[1:], len(raw)])] == [library.decode_single_token_bytes(int(i)) for i in ids]


def check_packing(pieces, texts, window=1024):
    tokenizer = Tokenizer.from_file(JSON)
    tokenizer.encode_special_tokens = True
    by_doc, by_sequence = {}, {}
    for p in pieces:
        by_doc.setdefault(p.doc_id, []).append(p)
        by_sequence.setdefault(p.sequence_id, []).append(p)
    for doc, text in texts.items():
        ids = [*tokenizer.encode(text or "", add_special_tokens=False).ids, 0]
        own = sorted(by_doc[doc], key=lambda p: p.start)
        at = 0
        for p in own:
            assert p.start == at and p.doc_tokens == len(ids) and 0 < p.length <= window
            assert p.ids_crc32 == zlib.crc32(np.array(ids[at : at + p.length], "<u4").tobytes())
            at += p.length
        assert at == len(ids)
    for own in by_sequence.values():
        at = 0
        for p in sorted(own, key=lambda p: p.offset):
            assert p.offset == at
            at += p.length
        assert at <= window


def test_packing(spark):
    rng = random.Random(4)
    texts = {i: " ".join(rng.choice(["alpha", "beta", "gamma", "ünï"]) for _ in range(int(rng.paretovariate(0.7)) % 4000)) for i in range(300)}
    texts |= {1000: None, 1001: "", 1002: "word " * 9000}
    df = spark.createDataFrame([(i, t, 0, "x") for i, t in texts.items()], SCHEMA).repartition(5)
    pieces = packing.pack(df, JSON).collect()
    check_packing(pieces, texts)
    fill = {}
    for p in pieces:
        fill[p.sequence_id] = fill.get(p.sequence_id, 0) + p.length
    padded = sum(n if n & (n - 1) == 0 else 1024 for n in fill.values())
    assert 1 - sum(fill.values()) / padded < 0.02
    assert packing.pack(df.limit(0), JSON).collect() == []


def test_repeated_rows_and_null_ids_are_packed_each(spark):
    df = spark.createDataFrame([(1, "a b c"), (1, "a b c"), (None, "a")], "doc_id long, text string")
    pieces = packing.pack(df, JSON).collect()
    assert sorted((p.doc_id or 0, p.length) for p in pieces) == [(0, 2), (1, 4), (1, 4)]
    assert len({(p.sequence_id, p.offset) for p in pieces}) == 3


@pytest.mark.parametrize("seed", range(8))
def test_plan_uses_each_length_as_often_as_it_occurs(seed):
    rng = np.random.default_rng(seed)
    lengths, many = np.unique(rng.integers(1, 1025, 2000) if seed % 2 else rng.choice([1000, 24, 512, 300], 2000), return_counts=True)
    counts = dict(zip(lengths.tolist(), many.tolist()))
    used = {}
    for pattern, repeat in packing.plan(dict(counts)):
        assert sum(pattern) <= 1024 and repeat > 0
        for length in pattern:
            used[length] = used.get(length, 0) + repeat
    assert used == counts


def test_least_squares_comes_near_the_best():
    rows = np.array([[1024, 0, 0], [1000, 24, 0], [512, 512, 0], [500, 500, 24]])
    histogram = np.zeros(1025)
    for x, row in zip((7, 5, 0, 3), rows):
        for length in row[row > 0]:
            histogram[length] += x
    assert np.allclose(packing.solve(rows, histogram), [7, 5, 0, 3], atol=1e-3)


def test_the_plan_reaches_spark_without_python_workers(spark, monkeypatch):
    docs = spark.range(30).selectExpr("id as doc_id", "repeat('some words ', cast(id as int)) as text")
    monkeypatch.setattr(type(spark.sparkContext), "parallelize", lambda *a, **b: pytest.fail("Python rows start workers"))
    rows = packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json")).collect()
    assert {r.doc_id for r in rows} == set(range(30))
