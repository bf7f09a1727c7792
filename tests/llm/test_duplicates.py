"""MinHash, gear chunks, sorted suffixes and components against brute force."""

import random
from collections import Counter

import numpy as np
import pytest

from rentloom.llm import chunks, minhash, suffixes
from rentloom.llm import components as linking
from rentloom.llm.common import HashCache, Stages
from rentloom.llm.components import components

SCHEMA = "doc_id long, text string, digest string, bands int, places string"


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "x", 1, "y") for i, t in rows], SCHEMA)


def brute_sets(rows, words):
    out = {}
    for i, text in rows:
        w = (text or "").encode().lower().split()
        n = min(words, len(w))
        out[i] = {tuple(w[j : j + n]) for j in range(len(w) - n + 1)} if n else set()
    return out


def brute_components(sets, percent=80):
    parent = {i: i for i in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(i for i in sets if sets[i])
    for k, a in enumerate(ids):
        for b in ids[k + 1 :]:
            common = len(sets[a] & sets[b])
            if 100 * common >= percent * (len(sets[a]) + len(sets[b]) - common):
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
    return {i: find(i) for i in sets}


def near_corpus(seed):
    """Chains and stars of copies near the threshold, exact copies, and unrelated texts."""
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(300)]
    rows, text = [], None
    for i in range(220):
        kind = i % 11
        if kind == 0 or text is None:
            text = base = [rng.choice(words) for _ in range(rng.randint(30, 90))]
        elif kind < 5:
            text = text[:]
            text[rng.randrange(len(text))] = rng.choice(words)
        elif kind < 9:
            text = base[:]
            for _ in range(rng.randint(1, 6)):
                text[rng.randrange(len(text))] = rng.choice(words)
        elif kind == 9:
            text = [w.upper() for w in base]
        else:
            text = [rng.choice(words) for _ in range(rng.randint(1, 4))]
        rows.append((i * 7 % 1009, " ".join(text)))
    return rows


@pytest.mark.parametrize(("seed", "words"), [(1, 2), (2, 5)])
def test_near_duplicates_equal_brute_force(spark, seed, words):
    rows = near_corpus(seed)
    sets = brute_sets(rows, words)
    want = brute_components(sets)
    got = minhash.near_duplicates(frame(spark, rows).repartition(4), words).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in got} == {i: (len(sets[i]), want[i], want[i] == i) for i in sets}
    assert len(set(want.values())) < len(rows) - 20


def test_near_duplicate_edges(spark):
    rows = [(9, "One two"), (4, "one  TWO\n"), (5, "one"), (6, "ONE"), (7, None), (8, ""), (10, " \t"), (11, "éa b"), (12, "Éa b"), (11, "éa b"), (None, "one two"), (None, None), (3, "x " * 40000)]
    got = minhash.near_duplicates(frame(spark, rows), 2).collect()
    assert len(got) == len(rows)
    by = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in got if r.doc_id is not None}
    assert by == {9: (1, 4, False), 4: (1, 4, True), 5: (1, 5, True), 6: (1, 5, False), 7: (0, 7, True), 8: (0, 8, True), 10: (0, 10, True), 11: (1, 11, True), 12: (1, 12, True), 3: (1, 3, True)}
    assert all(r.kept for r in got if r.doc_id is None)
    kept = minhash.one_of_each(frame(spark, rows), 2)
    assert kept.columns == frame(spark, []).columns and kept.count() == len(rows) - 2
    assert minhash.near_duplicates(frame(spark, []), 2).collect() == []


def test_a_group_of_many_copies_is_one_component(spark):
    rows = [(i, "same words in every copy of this text again and again") for i in range(1, 3000)]
    rows += [(5000 + i, f"same words in every copy of this text again and again {'tail ' * (i % 2)}{'more' * (i % 3 == 0)}") for i in range(900)]
    assert {r.component_id for r in minhash.near_duplicates(frame(spark, rows), 2).collect()} == set(brute_components(brute_sets({t: (i, t) for i, t in reversed(rows)}.values(), 2)).values())


def test_leader_rounds_leave_nothing_open(spark, monkeypatch):
    monkeypatch.setattr(minhash, "LEADER_ROUNDS", 0)
    rows = near_corpus(3)[:120]
    want = brute_components(brute_sets(rows, 2))
    assert {r.doc_id: r.component_id for r in minhash.near_duplicates(frame(spark, rows), 2).collect()} == want


def test_signature_agreement_is_near_the_similarity():
    rng = np.random.default_rng(1)
    whole = rng.integers(0, 1 << 63, 1500, dtype=np.uint64)
    a, b = np.sort(whole[:1200]), np.sort(whole[300:])
    signature = minhash.signatures([a, b])
    assert abs((signature[0] != 0).mean() - 1) < 0.1
    assert abs((signature[:, 0] == signature[:, 1]).mean() - 0.6) < 0.1
    assert minhash.shingle_sets([b"a b a b"], 2, HashCache())[0].shape == (2,)


@pytest.mark.parametrize("seed", range(3))
def test_components(spark, seed):
    rng = random.Random(seed)
    links = [(rng.randrange(60), rng.randrange(60)) for _ in range(45)] + [(i, i + 1) for i in range(100, 140)] + [(200, i) for i in range(201, 260)]
    parent = {x: x for link in links for x in link}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        x, y = find(a), find(b)
        parent[max(x, y)] = min(x, y)
    got = {r.a: r.b for r in components(spark.createDataFrame(links, "a long, b long"), Stages(spark, "test")).collect()}
    assert got == {x: find(x) for x in parent if find(x) != x}


@pytest.mark.parametrize("parts", [1, 5])
def test_components_of_many_blocks(spark, monkeypatch, parts):
    monkeypatch.setattr(linking, "BLOCK", 16)
    rng = random.Random(parts)
    chain = rng.sample(range(100), 100)
    links = list(zip(chain, chain[1:])) + [(500, i) for i in range(400, 500)] + [(i, i) for i in range(600, 610)] + [(7, chain[0])] * 3
    frame = spark.createDataFrame(links, "a long, b long").repartition(parts)
    got = sorted(tuple(r) for r in components(frame, Stages(spark, "test")).collect())
    assert got == [(i, 0) for i in range(1, 100)] + [(i, 400) for i in range(401, 501)]
    assert components(spark.createDataFrame([], "a long, b long"), Stages(spark, "test")).collect() == []


def test_links_of_one_block_take_no_star_steps(spark, monkeypatch):
    names, write = [], Stages.write
    monkeypatch.setattr(Stages, "write", lambda self, df, name: names.append(name) or write(self, df, name))
    links = spark.createDataFrame([(i, i + 1) for i in range(300)], "a long, b long").repartition(6)
    assert {tuple(r) for r in components(links, Stages(spark, "test")).collect()} == {(i, 0) for i in range(1, 301)}
    assert names == ["links", "blocks"]
    names.clear()
    rows = near_corpus(1)
    assert {r.doc_id: r.component_id for r in minhash.near_duplicates(frame(spark, rows), 2).collect()} == brute_components(brute_sets(rows, 2))
    assert names.count("classes") == 1 and "stars" not in names and len(names) <= 30


def test_families_of_many_blocks(spark, monkeypatch):
    monkeypatch.setattr(minhash, "LEADER_ROUNDS", 0)
    monkeypatch.setattr(minhash, "FAMILY_BLOCK", 8)
    monkeypatch.setattr(minhash, "SET_BLOCK", 3)
    tables, write = {}, Stages.write

    def kept(self, df, name):
        tables[name] = write(self, df, name)
        return tables[name]

    monkeypatch.setattr(Stages, "write", kept)
    rng = random.Random(4)
    base = [f"w{i}" for i in range(80)]
    rows = [(i, " ".join(w if rng.random() < 0.985 else f"x{rng.randrange(999)}" for w in base)) for i in range(90)] + near_corpus(5)[:40]
    rows = [(i, text) for i, (_, text) in enumerate(rows)]
    want = brute_components(brute_sets(rows, 2))
    assert {r.doc_id: r.component_id for r in minhash.near_duplicates(frame(spark, rows), 2).collect()} == want
    blocks = tables["set-blocks"].select("family", "main", "part").collect()
    assert len(set(blocks)) == len(blocks) and len({b.family for b in blocks}) < len(blocks) // 5


def windows_removed(rows, n=200):
    seen = Counter(t[i : i + n] for t in rows.values() for i in range(len(t) - n + 1))
    out = {}
    for key, t in rows.items():
        gone = np.zeros(len(t), bool)
        for i in range(len(t) - n + 1):
            if seen[t[i : i + n]] > 1:
                gone[i : i + n] = True
        out[key] = gone
    return out


def passage_corpus(seed):
    rng = random.Random(seed)
    letters = "abcdefghij é"
    passages = ["".join(rng.choice(letters) for _ in range(n)) for n in (150, 199, 200, 201, 230, 400, 900, 260)]
    rows = {}
    for i in range(90):
        parts = []
        for _ in range(rng.randint(0, 4)):
            parts.append("".join(rng.choice(letters) for _ in range(rng.randint(0, 150))))
            p = rng.choice(passages)
            cut = rng.choice([0, 0, 30, 60])
            parts.append(p[cut:])
        rows[i] = "".join(parts)
    return rows | {200: "xy" * 300, 201: "z" * 400, 202: None, 203: "", 204: "q" * 199, 205: "r" * 200, 206: "long tail " * 4000}


@pytest.mark.parametrize("group", [20_000, 2])
def test_suffix_removal_equals_brute_force(spark, monkeypatch, group):
    monkeypatch.setattr(suffixes, "GROUP_CONTEXTS", group)
    rows = passage_corpus(group)
    raw = {i: (t or "").encode() for i, t in rows.items()}
    want = windows_removed(raw)
    got = suffixes.remove_repeats(frame(spark, rows.items()).repartition(5)).collect()
    assert len(got) == len(rows)
    for r in got:
        gone = want[r.doc_id]
        assert r.n_bytes == len(gone) and bytes(r.kept) == np.frombuffer(raw[r.doc_id], np.uint8)[~gone].tobytes()
        edges = np.flatnonzero(np.diff(np.concatenate([[0], gone.astype(int), [0]])))
        assert [(s.start, s.end) for s in r.spans] == list(map(tuple, edges.reshape(-1, 2)))


def test_suffix_removal_edges(spark):
    text = "".join(random.Random(5).choice("abcdef") for _ in range(500))
    got = suffixes.remove_repeats(frame(spark, [(1, text), (1, text), (None, text), (2, None)])).collect()
    assert sorted((r.doc_id or 0, r.n_bytes, len(r.kept)) for r in got) == [(0, 500, 500), (1, 500, 0), (1, 500, 0), (2, 0, 0)]
    assert suffixes.remove_repeats(frame(spark, [])).collect() == []


@pytest.mark.parametrize("seed", range(4))
def test_deep_shallow_order_and_common_prefixes(seed):
    rng = random.Random(seed)
    rows = [bytes(rng.choice(b"ab\x00") for _ in range(rng.randint(0, 40))) + b"x" * rng.randint(0, 100) for _ in range(120)]
    groups = np.array([rng.randint(0, 3) for _ in rows])
    order, common = suffixes.deep_shallow(groups, rows, 200)
    assert [(groups[i], rows[i]) for i in order] == sorted(zip(groups, rows))
    for a, b, n in zip(order, order[1:], common[1:]):
        same = next((i for i, (x, y) in enumerate(zip(rows[a], rows[b])) if x != y), min(len(rows[a]), len(rows[b])))
        assert n == (same if groups[a] == groups[b] else -1)
    assert [rows[i] for i in suffixes.blind_order(rows)] == sorted(rows)


def test_anchors_file_every_window_once(monkeypatch):
    monkeypatch.setattr(suffixes, "SECTION", 300)
    rng = random.Random(1)
    texts = [bytes(rng.choice(b"abc") for _ in range(n)) for n in (0, 199, 200, 201, 1000, 350)]
    ends = np.cumsum([len(t) for t in texts])
    _, anchor, low, high = suffixes.Anchors().of(np.frombuffer(b"".join(texts), np.uint8), ends)
    starts = sorted(s for a, b in zip(low, high) for s in range(a, b + 1))
    assert starts == [s for t, e in zip(texts, ends) for s in range(e - len(t), e - 199)]
    assert ((anchor >= high) & (anchor - low < suffixes.WINDOW)).all()


def test_chunks_resist_insertions_and_keep_characters():
    rng = random.Random(2)
    text = "".join(rng.choice("abcdefé 漢😀") for _ in range(4000)).encode()
    ends = chunks.cuts(text)
    assert ends[-1] == len(text) and all(0 < b - a <= chunks.MOST for a, b in zip([0, *ends], ends))
    for a, b in zip([0, *ends], ends):
        text[a:b].decode()
    moved = "inserted words ".encode() + text
    assert len(set(chunks.digests(moved, chunks.cuts(moved))) & set(chunks.digests(text, ends))) > 0.95 * len(ends)
    assert chunks.cuts(b"") == [] and chunks.cuts(b"short") == [5]


def brute_chunk_removal(rows):
    first = {}
    for i, text in sorted(rows):
        for d in chunks.digests(text, chunks.cuts(text)):
            first.setdefault(d, i)
    out = {}
    for i, text in rows:
        ends, seen, run, kept = chunks.cuts(text), set(), [], b""
        pieces = [text[a:b] for a, b in zip([0, *ends], ends)]
        for piece, d in [*zip(pieces, chunks.digests(text, ends)), (b"", None)]:
            if d is not None and (first[d] < i or d in seen):
                run.append(piece)
            else:
                whole = b"".join(run)
                kept += (whole if len(whole) < chunks.RUN else b"") + piece
                run = []
            seen.add(d)
        out[i] = kept.decode()
    return out


def test_chunk_removal_equals_brute_force(spark):
    rows = [(i, t or "") for i, t in passage_corpus(7).items()]
    df = frame(spark, rows).repartition(4)
    got = chunks.remove_repeats(df)
    assert got.columns == df.columns
    assert {r.doc_id: r.text for r in got.collect()} == brute_chunk_removal([(i, t.encode()) for i, t in rows])


def test_chunk_removal_edges(spark):
    passage = " ".join(f"word{i}" for i in range(80))
    rows = [(1, passage), (2, "before it " + passage + " and after"), (3, None), (4, ""), (None, passage), (2, "before it " + passage + " and after")]
    got = chunks.remove_repeats(frame(spark, rows), "spans").collect()
    by = {r.doc_id: r for r in got}
    assert len(got) == 6 and by[1].text == passage and by[3].text is None and by[4].text == "" and by[None].text == passage
    assert passage[150:350] not in by[2].text and len(by[2].spans) == 1
    assert chunks.remove_repeats(frame(spark, [])).collect() == []


def test_whole_passages_go_up_to_their_last_byte(spark):
    rng = random.Random(3)

    def words(n):
        return " ".join("".join(rng.choice("abcdeféß") for _ in range(rng.randint(2, 8))) for _ in range(n))

    passages = [words(51) for _ in range(60)]
    rows = [(i, f"{words(40)}.{x}.{words(40)}") for i, x in enumerate(passages)]
    later = [(words(40), words(40)) for _ in passages]
    rows += [(100 + i, f"{a}|{x}|{b}") for i, (x, (a, b)) in enumerate(zip(passages, later))]
    rows.append((500, f"{later[0][0]} {words(30)}\n{rows[-1][1][:40]} {words(60)} {(again := words(51))} {words(9)} {again} {words(9)}"))
    by = {r.doc_id: r for r in chunks.remove_repeats(frame(spark, rows), "spans", whole=True).collect()}
    texts = dict(rows)
    for i in range(60):
        assert by[i].text == texts[i] and by[i].spans == []
        a, b = later[i]
        assert by[100 + i].text == f"{a}||{b}" and len(by[100 + i].spans) == 1
    assert by[500].text.count(again) == 1 and by[500].text.count(again[:40]) == 1 and by[500].text.count(again[-40:]) == 1
