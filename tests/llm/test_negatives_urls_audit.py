"""Hard negatives, URL rules and the filter audit against brute force, with nulls, ties, repeats, odd rows and empty tables."""

import random
from itertools import permutations

import numpy as np
import pytest
from pyspark.sql import functions as F

from rentloom.llm import filter_audit, hard_negatives, url_filter
from rentloom.llm.vectors import exact_products

NAN, INF = float("nan"), float("inf")
VECTORS = "vec_id long, embedding array<double>, label int, score string, shard long"


def labelled_vectors(seed, n=600, width=6, hot=200):
    rng = np.random.default_rng(seed)
    points = rng.normal(size=(n, width)) + 0.7
    points[rng.choice(n, hot, replace=False)] = points[0]
    return [(i, [float(x) for x in p], int(rng.integers(4)), "x", 1) for i, p in enumerate(points)]


ODD = [
    (9000, None, 1, "x", 1), (9100, [NAN] * 6, 1, "x", 1), (9200, [None] + [1.0] * 5, 1, "x", 1), (9300, [INF] * 6, 1, "x", 1),
    (9400, [1.0] * 6, None, "x", 1), (None, [1.0] * 6, 1, "x", 1), (9500, [1e300] * 6, 1, "x", 1),
    (9600, [1.0] * 3, 1, "x", 1), (9601, [2.0] * 3, 1, "x", 1), (9602, [1.5] * 3, 2, "x", 1), (9603, [0.9] * 3, 2, "x", 1),
    (9700, [], 1, "x", 1), (9701, [], 1, "x", 1), (9702, [], 2, "x", 1),
]


def brute_negatives(rows, k=10, positives=5):
    fine = {}
    for i, v, label, *_ in rows:
        if i is not None and label is not None and v is not None and all(x is not None and np.isfinite(x) and abs(x) < 1e15 for x in v):
            own = (label, v)
            fine[i] = min(fine.get(i, own), own)
    whole = {i: (label, [int(np.floor(256 * x)) for x in v]) for i, (label, v) in fine.items()}
    out = set()
    for a in (i for i in whole if i % 100 == 0):
        score = {i: sum(x * y for x, y in zip(v, whole[a][1])) for i, (_, v) in whole.items() if i != a and len(v) == len(whole[a][1])}
        order = sorted(score, key=lambda i: (-score[i], i))
        for p in [i for i in order if whole[i][0] == whole[a][0]][:positives]:
            fits = [i for i in order if whole[i][0] != whole[a][0] and 30 * score[p] <= 100 * score[i] <= 90 * score[p]]
            out |= {(a, p, r + 1, i, score[p], score[i]) for r, i in enumerate(fits[:k])}
    return out


@pytest.mark.parametrize("shard", [65_536, 70])
def test_negatives_equal_brute_force(spark, monkeypatch, shard):
    monkeypatch.setattr(hard_negatives, "SHARD_ROWS", shard)
    monkeypatch.setattr(hard_negatives, "FIRST_COLUMNS", 16)
    monkeypatch.setattr(hard_negatives, "ROWS_AT_ONCE", 3)
    rows = labelled_vectors(5) + ODD
    df = spark.createDataFrame(rows + rows[40:60] + [(100, [9.0] * 6, 3, "x", 1)], VECTORS).repartition(3)
    got = hard_negatives.mine(df, F.col("vec_id") % 100 == 0)
    assert got.columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    want = brute_negatives(rows + [(100, [9.0] * 6, 3)])
    assert want and {tuple(r) for r in got.collect()} == want
    assert got.count() == len(want)


def test_negatives_of_few_rows(spark):
    df = spark.createDataFrame(labelled_vectors(6, n=3, hot=1), VECTORS)
    assert hard_negatives.mine(df.limit(0), F.col("vec_id") % 100 == 0).collect() == []
    assert hard_negatives.mine(df.filter("vec_id = 0"), F.col("vec_id") % 100 == 0).collect() == []
    assert hard_negatives.mine(df, F.lit(False)).collect() == []


def test_negative_positives_and_zero(spark):
    rows = [(0, [1.0], 1), (1, [-1.0], 1), (2, [0.0], 1), (3, [0.0], 2), (4, [-0.5], 2), (5, [0.5], 2)]
    df = spark.createDataFrame([(*r, "", 0) for r in rows], VECTORS)
    got = {tuple(r) for r in hard_negatives.mine(df, F.col("vec_id") % 100 == 0).collect()}
    assert got == brute_negatives(rows) == {(0, 2, 1, 3, 0, 0)}


def test_products_stay_exact():
    rng = np.random.default_rng(1)
    big, small = rng.integers(-(1 << 31), 1 << 31, (5, 8)), rng.integers(-(1 << 24), 1 << 24, (7, 8))
    want = [[sum(int(a) * int(b) for a, b in zip(x, y)) for y in small] for x in big]
    assert exact_products(big, small).tolist() == want
    edge = np.full((1, 2), 1 << 40)
    assert exact_products(edge, edge).tolist() == [[(1 << 63) - 1]] and exact_products(edge, -edge).tolist() == [[-(1 << 63)]]
    assert exact_products(np.zeros((2, 0), np.int64), np.zeros((3, 0), np.int64)).tolist() == [[0] * 3] * 2


RULES = [
    ("com", "/", "allow"), ("example.com", "/en/", "block"), ("WWW.example.com", "/en/", "allow"), ("net", "/es/", "block"),
    ("net", "/fr/", "block"), ("org", "", "block"), ("a.org", "/x", "allow"), ("a.org", "/x", "block"), ("b.org", "/ü", "allow"),
    (None, "/", "block"), ("info", None, "block"), ("info", "/", "ask"), ("c.org", "x", "block"),
]
URLS = [
    None, "", "no scheme", "http://", "http://com", "http://com/", "HTTP://Example.COM/en/1", "https://www.example.com/en/?q=/fr/",
    "https://m.www.example.com/en/2#top", "https://notexample.com/en/", "http://x.net/fr", "http://x.net/fr/", "http://x.net/es/a://b/",
    "http://net/es/", "http://a.org/xyz", "http://b.org/üx", "http://org?x", "http://c.org/x", "http://info/", "http://com:80/en/",
    "http://.com/", "http://com./", "x://y://com/", "http://a.b.c.d.e.f.org", "http://x.net/" + "fr/" * 40_000, "http://a\nb.com/en/\n?",
]


def brute_verdict(url):
    host = path = ""
    if url and "://" in url:
        rest = url.split("://", 1)[1]
        end = min([rest.find(c) for c in "/?#" if c in rest] or [len(rest)])
        host = "".join(c.lower() if "A" <= c <= "Z" else c for c in rest[:end])
        path = rest[end:].split("?")[0].split("#")[0]
    best = None
    for h, p, verdict in RULES:
        if h is None or p is None or verdict == "ask":
            continue
        h = h.lower()
        if (host == h or host.endswith("." + h)) and path.startswith(p):
            best = max(best or (), (len(h + p), len(h), verdict, h + p))
    return host, path, best[3] if best else None, best[2] if best else "otherwise"


@pytest.mark.parametrize("blocks", [1 << 20, 1])
def test_rules_equal_brute_force(spark, monkeypatch, blocks):
    monkeypatch.setattr(url_filter, "MOST_BLOCKS", blocks)
    monkeypatch.setattr(url_filter, "KEYS_A_BLOCK", 4 if blocks > 1 else 32)
    rng = random.Random(3)
    made = [f"http://{rng.choice(['m.', ''])}{rng.choice('abc')}.{rng.choice(['com', 'net', 'org', 'example.com'])}/{rng.choice(['en', 'fr', 'es', 'x'])}/{i}" for i in range(300)]
    urls = URLS + made + URLS[:5]
    rows = spark.createDataFrame([(i // 2 if i % 9 else None, u, "x", "y", 1) for i, u in enumerate(urls)], "page_id long, url string, host string, rule string, row long")
    got = url_filter.judge(rows.repartition(3), spark.createDataFrame(RULES, "host string, path string, verdict string"), "otherwise")
    want = [(i // 2 if i % 9 else None, *brute_verdict(u)) for i, u in enumerate(urls)]
    assert sorted(map(str, map(tuple, got.collect()))) == sorted(map(str, want))


def test_rules_of_empty_tables(spark):
    pages = spark.createDataFrame([(1, "http://a.com/")], "page_id long, url string")
    rules = spark.createDataFrame(RULES, "host string, path string, verdict string")
    assert url_filter.judge(pages.limit(0), rules).collect() == []
    assert [tuple(r) for r in url_filter.judge(pages, rules.limit(0)).collect()] == [(1, "a.com", "/", None, "allow")]


def test_bloom_filter_forgets_nothing_and_passes_little():
    rng = np.random.default_rng(2)
    held, other = (rng.integers(0, 1 << 63, 20_000).astype(np.uint64) * np.uint64(2) + np.uint64(i) for i in range(2))
    blocks = 20_000 // url_filter.KEYS_A_BLOCK
    words = np.zeros((blocks, url_filter.WORDS), np.uint64)
    block, bits = url_filter.places(held, blocks)
    np.bitwise_or.at(words, block, bits)
    assert url_filter.may_hold(words, held).all()
    assert url_filter.may_hold(words, other).mean() < 0.01


def test_many_rules(spark):
    rules = [(f"h{i}.com", f"/p{i % 50}/", "block" if i % 2 else "allow") for i in range(3000)]
    urls = [(i, f"http://www.h{i}.com/p{i % 50 if i % 3 else 'q'}/x") for i in range(0, 4000, 7)]
    got = url_filter.judge(spark.createDataFrame(urls, "page_id long, url string"), spark.createDataFrame(rules, "host string, path string, verdict string"))
    want = {i: (None, "allow") if i % 3 == 0 or i >= 3000 else (f"h{i}.com/p{i % 50}/", "block" if i % 2 else "allow") for i, _ in urls}
    assert {r.page_id: (r.rule, r.verdict) for r in got.collect()} == want


DOCS = "doc_id long, text string, source string, mask string, part int, digest string"
LONG = " ".join(f"w{i % 700_000}" for i in range(1_000_000)) + "\x0b\x0c \u00a0"


def audit_rows():
    rng = random.Random(11)
    texts = [None, "", " \t\n", "a # b", "SHOUT NOW", "word " * 80, " ".join(f"w{i}" for i in range(60)), "ünï çödé " * 40, "x|y", LONG, "\u00a0".join("ab" * 60)]
    texts += [" ".join(rng.choice(["Alpha", "beta", "gamma$", "delta", "eps", f"n{rng.random()}"]) for _ in range(rng.choice([20, 49, 50, 90]))) for _ in range(60)]
    rows = [(i, t, rng.choice([None, "", "a", "b"])) for i, t in enumerate(texts)]
    rows += [(100 + i, rng.choice(texts), rng.choice(["a", "b"])) for i in range(120)]
    rows += [(300 + i, "the same text", "a") for i in range(200)] + rows[3:9] + [(None, texts[3], "a"), (None, "alone", "c"), (305, "another text", "b"), (300, "the same text", "b")]
    labels = [(i, rng.choice([0, 1, None]), rng.choice([0, 1, None])) for i in range(0, 400, 2)] + [(4, 1, 1), (4, 0, 0), (None, 1, 1)]
    return rows, labels


def brute_audit(rows, labels):
    least = {}
    for i, t, _ in rows:
        if i is not None:
            least[t or ""] = min(i, least.get(t or "", i))
    good = {i for i, q, _ in labels if i is not None and q == 1}
    toxic = {i for i, _, x in labels if i is not None and x == 1}
    parts = {}
    for i, t, source in rows:
        t = t or ""
        words = [w for w in t.replace("\t", " ").replace("\n", " ").replace("\x0b", " ").replace("\x0c", " ").replace("\r", " ").split(" ") if w]
        fails = {"A": len(words) < 50, "B": 100 * len(set(words)) < 65 * len(words), "C": 100 * sum("A" <= c <= "Z" for c in t) > 5 * len(t)}
        fails |= {"D": any(c in "#$%&*|" for c in t), "E": i is not None and i > least[t]}
        parts.setdefault(source or "", []).append((frozenset(f for f in fails if fails[f]), i in good, i in toxic))
    out = {}
    for part, docs in parts.items():
        shapley = dict.fromkeys("ABCDE", 0)
        for order in permutations("ABCDE"):
            left = docs
            for step, f in enumerate(order, 1):
                gone = [d for d in left if f in d[0]]
                shapley[f] += len(gone)
                redundant = sum(f in d[0] for d in docs) - len(gone)
                left = [d for d in left if f not in d[0]]
                out[part, "".join(order), step] = [len(left), len(gone), redundant, sum(d[0] == {f} for d in docs), sum(d[1] for d in gone), sum(d[2] for d in gone)]
        for (p, order, step), counts in out.items():
            if p == part:
                counts.append(shapley[order[step - 1]])
    return out


def test_audit_equals_brute_force(spark):
    rows, labels = audit_rows()
    df = spark.createDataFrame([(*r, "x", 1, "y") for r in rows], DOCS).repartition(5)
    known = spark.createDataFrame([(*x, "z") for x in labels], "doc_id long, quality int, toxic int, present string")
    got = {(r.part, r.filter_order, r.step): [r[m] for m in filter_audit.RESULT] for r in filter_audit.audit(df, known).collect()}
    want = brute_audit(rows, labels)
    assert len(want) == 600 * 4 and got == want
    empty = filter_audit.audit(df.limit(0), known)
    assert empty.collect() == [] and empty.columns == ["part", "filter_order", "step", *filter_audit.RESULT]
    unlabelled = filter_audit.audit(df, known.limit(0))
    assert unlabelled.agg(F.sum("good_lost"), F.sum("toxic_lost")).first() == (0, 0)


def test_wide_counters_do_not_run_over():
    huge = (1 << 48) + 7
    total = sum(filter_audit.packed_outcomes(m) * huge for m in range(128))
    counts = filter_audit.unpacked(total)
    assert (counts["kept"][::5] == 64 * huge).all()
    assert (counts["kept"] >= 0).all() and (counts["removed"] + counts["redundant"] == 64 * huge).all()
    assert (counts["unique_fails"] == 4 * huge).all()


@pytest.mark.parametrize("piece", [1, 7, 1 << 20])
def test_words_of_long_texts_are_counted_in_pieces(monkeypatch, piece):
    monkeypatch.setattr(filter_audit, "PIECE", piece)
    for text in (b"", b" ", b"a b\ta\x0bb", b"abcdefghij" * 5, b" x  yy \r\n x" * 20):
        assert filter_audit._word_counts(text) == (len(text.split()), len(set(text.split())))
