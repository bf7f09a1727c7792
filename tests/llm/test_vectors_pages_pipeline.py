"""Vector searches against brute force, page differencing, the pipeline and the registered queries."""

import random
from pathlib import Path

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
import corpus_pipeline
from rentloom.llm import kdtree, kmeans_tree, pages, queries
from tests.llm.test_duplicates import brute_components, brute_sets

SF = "/root/testdata/sf0.001"
tables = pytest.mark.skipif(not Path(SF).exists(), reason="test tables are not there")
SCHEMA = "vec_id long, embedding array<float>, score int, leaf string"
NAN, INF = float("nan"), float("inf")


def vectors(seed, n=700, width=8, hot=200):
    rng = np.random.default_rng(seed)
    points = rng.normal(size=(n, width)).astype(np.float32)
    points[rng.choice(n, hot, replace=False)] = points[0]
    return [(i, [float(x) for x in p], 1, "x") for i, p in enumerate(points)]


ODD = [(9000, None, 1, "x"), (9020, [NAN] * 8, 1, "x"), (9040, [INF] + [0.0] * 7, 1, "x"), (9060, [None] + [1.0] * 7, 1, "x"), (None, [1.0] * 8, 1, "x"), (9100, [1.0] * 3, 1, "x"), (9200, [], 1, "x")]
ODD += [(9210, [2.0] * 9, 1, "x"), (9220, [1.0] * 9, 1, "x"), (9400, [0.5] * 9, 1, "x")]


def brute(rows, every, k, whole):
    fine = {i: np.array(v, np.float32).astype(float) for i, v, *_ in rows if i is not None and v and None not in v and np.isfinite(v).all()}
    out = {}
    for width in {len(v) for v in fine.values()}:
        out |= _brute({i: v for i, v in fine.items() if len(v) == width}, every, k, whole)
    return {q: found for q, found in out.items() if found}


def _brute(fine, every, k, whole):
    ids = np.array(sorted(fine))
    points = np.stack([fine[i] for i in ids])
    if whole:
        points = np.floor(256 * points).astype(np.int64)
    out = {}
    for i in ids[ids % every == 0].tolist():
        score = (points * points[ids == i]).sum(1) if whole else kmeans_tree.products(points[ids == i], points)[0]
        others = ids != i
        best = np.lexsort((ids[others], -score[others]))[:k]
        out[i] = list(zip(ids[others][best].tolist(), score[others][best].tolist()))
    return out


def answers(df):
    out = {}
    for r in df.orderBy("query_id", "rank").collect():
        out.setdefault(r.query_id, []).append((r.vec_id, r.score))
        assert r["rank"] == len(out[r.query_id])
    return out


@pytest.mark.parametrize("shard", [4096, 100])
def test_kd_trees_equal_brute_force(spark, monkeypatch, shard):
    monkeypatch.setattr(kdtree, "SHARD_ROWS", shard)
    rows = vectors(1) + ODD
    df = spark.createDataFrame(rows + rows[40:60], SCHEMA).repartition(3)
    assert answers(kdtree.top_k(df, F.col("vec_id") % 50 == 0)) == brute(rows, 50, 5, True)


def test_one_longer_vector_hides_nothing(spark):
    rows = vectors(7, n=300) + [(9001, [1.0] * 9, 1, "x")]
    df = spark.createDataFrame(rows, SCHEMA)
    assert kmeans_tree.search(df, F.col("vec_id") % 20 == 0).count() == 15 * 20
    assert kdtree.top_k(df, F.col("vec_id") % 50 == 0).count() == 6 * 5


def test_kd_trees_are_exact_where_doubles_are_not(spark):
    rng = np.random.default_rng(8)
    large, small = rng.integers(-(1 << 31), 1 << 31, (120, 8)), rng.integers(-(1 << 23), 1 << 23, (120, 8))
    rows = [(i, [float(x) for x in (large if i % 50 else small)[i]], 1, "x") for i in range(120)]
    df = spark.createDataFrame(rows, SCHEMA.replace("float", "double"))
    want = {}
    for q in range(0, 120, 50):
        scores = [(sum(int(a) * int(b) for a, b in zip(rows[q][1], v)), i) for i, v, *_ in rows if i != q]
        want[q] = [(i, s) for s, i in sorted(scores, key=lambda x: (-x[0], x[1]))[:5]]
    assert answers(kdtree.top_k(df, F.col("vec_id") % 50 == 0, scale=1)) == want


def test_few_vectors(spark):
    df = spark.createDataFrame(vectors(2, n=3, hot=1), SCHEMA)
    assert {q: len(a) for q, a in answers(kdtree.top_k(df, F.col("vec_id") % 50 == 0)).items()} == {0: 2}
    assert {q: len(a) for q, a in answers(kmeans_tree.search(df, F.col("vec_id") % 20 == 0)).items()} == {0: 2}
    for of in (kdtree.top_k, kmeans_tree.search):
        assert of(df.limit(0), F.col("vec_id") % 20 == 0).collect() == []
        assert of(df.limit(1), F.col("vec_id") % 20 == 0).collect() == []


def test_kmeans_tree_recall_and_scores(spark):
    rows = vectors(3, n=4000, hot=1200) + ODD + [(9300, [0.0] * 8, 1, "x")]
    want = brute(rows[:-1], 20, 20, False)
    got = answers(kmeans_tree.search(spark.createDataFrame(rows + rows[40:60], SCHEMA).repartition(3), F.col("vec_id") % 20 == 0))
    assert set(got) == set(want)
    hits = sum(len(set(got[q]) & set(want[q])) for q in want)
    assert hits / sum(map(len, want.values())) >= 0.9
    assert all(len(a) == len(want[q]) and a == sorted(a, key=lambda x: (-x[1], x[0])) for q, a in got.items())


def test_tree_files_rows_where_all_leaves_end():
    rng = np.random.default_rng(1)
    points = rng.normal(size=(500, 6))
    tree = kmeans_tree.fit(points, float(np.linalg.norm(points, axis=1).max()), 20)
    assert tree.leaves == 20 and set(kmeans_tree.file_rows(tree, points)) == set(range(20))
    assert sorted(kmeans_tree.visit(tree, points[0], 99)) == list(range(20))
    assert kmeans_tree.visit(tree, points[0], 3) == kmeans_tree.visit(tree, points[0], 99)[:3]


SITE = """<html><head><title>T</title><script>var a = "<p>no</p>";</script><style>p{}</style></head><body>
<header><h1>Site</h1></header><nav><ul><li><a href=/x>Menu</a><li>More</ul></nav><div class="cookie-notice">We use <b>cookies</b></div>
<article><header><h2>Head &amp; line</h2></header><p><b>One  two<br>three.<p>Next&nbsp;para &lt;x&gt;</p><div class="ad">Buy</div>
<ul><li>item 1<li>item <i>2</i></ul><form><label>Email</label><input name=q></form><!-- gone --><p>last</article>
<section id="comments"><p>Nice!</p></section><aside>Side</aside><footer>&copy; 1</footer></body></html>"""


def plain(body, i):
    return f"<html><body><div>Welcome to the site</div><div>{body}</div><p>Fixed line {i % 1}</p></body></html>"


def test_pages(spark):
    rows = [(1, "http://a.org/x/1", SITE), (2, None, None), (3, "http://a.org/", ""), (4, "not [a url", "<p>only"), (5, "http://a.org/x/2", "<p>" + "word " * 50000)]
    rows += [(10 + i, f"http://b.org/p/{i}", plain(f"own text of page {i} " * 5, i)) for i in range(6)] + [(10, "http://b.org/p/0", plain("own text of page 0 " * 5, 0))]
    df = spark.createDataFrame([(*r, "clash", "clash") for r in rows], "page_id long, url string, html string, text string, host string")
    got = pages.extract(df.coalesce(1)).collect()
    assert len(got) == len(rows) and all(r.n_chars == len(r.text) for r in got)
    by = {r.page_id: r.text for r in got}
    assert by[1] == "Head & line\nOne two three.\nNext para <x>\nitem 1\nitem 2\nlast"
    assert by[2] == by[3] == "" and by[4] == "only" and by[5] == ("word " * 50000).strip()
    for i in range(1, 6):
        assert by[10 + i] == (f"own text of page {i} " * 5).strip()
    assert pages.extract(df.limit(0)).collect() == []


def test_differencing_acts_inside_articles(spark):
    body = "<html><body><article><p>Subscribe today</p><p>{0}</p></article></body></html>"
    teaser = "<html><body><div>{0}</div><div><article><p>Read on {1}</p></article></div></body></html>"
    own = [f"own words of page {i} " * 4 for i in range(6)]
    rows = [(i, f"http://c.org/{i}", body.format(own[i])) for i in range(3)]
    rows += [(i, f"http://d.org/{i}", teaser.format(own[i], i)) for i in range(3, 6)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    by = {r.page_id: r.text for r in pages.extract(df.coalesce(1)).collect()}
    assert [by[i] for i in range(3)] == [x.strip() for x in own[:3]]
    assert [by[i] for i in range(3, 6)] == [f"{own[i].strip()}\nRead on {i}" for i in range(3, 6)]


def body_of(opening, i):
    close = "</" + opening[1:].split()[0].split(">")[0] + ">"
    return f"<body><div>Menu of the site</div>{opening}" + "".join(f"<p>sentence {i} {j} of its own</p>" for j in range(4)) + close + "</body>"


OPENINGS = ['<div class="content with-sidebar">', '<div id="content" class="post comments-open">', '<div class="social-science">', '<section class="page with-comments">']


def test_layout_classes_do_not_empty_pages(spark):
    rows = [(10 * k + i, f"http://l{k}.org/{i}", body_of(opening, i)) for k, opening in enumerate(OPENINGS) for i in range(4)]
    got = {r.page_id: r.text for r in pages.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got == {i: "\n".join(f"sentence {i % 10} {j} of its own" for j in range(4)) for i, _, _ in rows}


def test_marked_elements_go():
    text = "<p>" + "the text of the page " * 9 + "</p>"
    for inside in ('<div class="comments">', '<div id="comment-list">', '<div class="x cookie-banner">', '<ul class="share-buttons">', '<div role="search">', "<aside>", '<div class="ad">'):
        found = pages.lines_of(f"<body>{text}{inside}something else</div></aside></ul>{text}")
        assert [t for t, kind in found if kind == pages.SITE_LINE] == ["something else"], inside
    assert not any(kind == pages.SITE_LINE for _, kind in pages.lines_of(f'<p class="social-science">{text}'))


def test_what_one_neighbour_happens_to_share_stays_in_the_article(spark):
    def page(i):
        own = "".join(f"<p>{x}</p>" for x in (f"sentence {i} a of page", "Same title" if i < 2 else f"Title {i}", f"sentence {i} b of page", f"sentence {i} c of page"))
        return f"<body><article><p>Notice on every page</p>{own}</article></body>"

    df = spark.createDataFrame([(i, f"http://t.org/{i}", page(i)) for i in range(5)], "page_id long, url string, html string")
    for r in pages.extract(df).collect():
        assert ("Same title" in r.text) == (r.page_id < 2) and "Notice" not in r.text and r.text.count("\n") == 3


@pytest.mark.parametrize("piece", ["<a ", "<a '", '<a ">', "<div><article>", "</div>", "<ul>", "<ul></li>", "<!", "<!-- ", "<p", '<div class="a-menu">', "<script", "<b></i>"])
def test_hostile_pages_take_linear_time(piece):
    import time

    def seconds(n):
        start = time.perf_counter()
        pages.lines_of(piece * n + "text")
        return time.perf_counter() - start

    seconds(1000)
    assert seconds(100_000) < 5


def brute_kept(pages_of_host, at):
    """The rule for one page, with a table for each alignment; partners by order and path."""
    def common(a, b):
        table = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i in range(len(a) - 1, -1, -1):
            for j in range(len(b) - 1, -1, -1):
                table[i][j] = 1 + table[i + 1][j + 1] if a[i] == b[j] else max(table[i + 1][j], table[i][j + 1])
        return table[0][0]

    own = pages_of_host[at]
    return [x for x in own if sum(x in p for k, p in enumerate(pages_of_host) if k != at) < 2], common


def test_sites_lines_equal_brute_force(spark):
    """Pages of unlike texts with site lines in the same order: what at least two other pages have goes, the rest stays."""
    rng = random.Random(4)
    site = [f"site line {k}" for k in range(5)]
    host = []
    for i in range(9):
        own = [f"own {i} {j} " + "w" * rng.randint(20, 60) for j in range(6)]
        host.append(sorted(site) [:2] + own[:3] + site[2:4] + own[3:] + site[4:])
    rows = [(i, f"http://q.org/{i}", "".join(f"<p>{x}</p>" for x in lines)) for i, lines in enumerate(host)]
    got = {r.page_id: r.text for r in pages.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got == {i: "\n".join(brute_kept(host, i)[0]) for i in range(9)}
    _, length = brute_kept(host, 0)
    for _ in range(50):
        a, b = ([rng.randrange(5) for _ in range(rng.randint(0, 12))] for _ in range(2))
        assert len(pages.common_places(a, b)) == length(a, b)


def test_copies_short_pages_and_task_edges_keep_their_partners(spark):
    menu = "<div>Unmarked menu of this site, longer than the own text of its pages</div>"
    rows = [(i, f"http://e.org/{i:02}", f"<body>{menu}<p>own text {i // 5} of five copies</p></body>") for i in range(20)]
    rows += [(20 + i, f"http://f.org/{i}", f"<body>{menu}<p>short page {i}</p></body>") for i in range(6)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    expected = {i: f"own text {i // 5} of five copies" for i in range(20)} | {20 + i: f"short page {i}" for i in range(6)}
    before = spark.conf.get("spark.sql.shuffle.partitions")
    adaptive = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    try:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
        for n in (1, 13):
            spark.conf.set("spark.sql.shuffle.partitions", str(n))
            assert {r.page_id: r.text for r in pages.extract(df).collect()} == expected
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", adaptive)


def test_common_places_are_a_longest_common_subsequence():
    rng = random.Random(1)
    for _ in range(200):
        a, b = ([rng.randint(0, 4) for _ in range(rng.randint(0, 14))] for _ in range(2))
        table = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                table[i + 1][j + 1] = table[i][j] + 1 if x == y else max(table[i][j + 1], table[i + 1][j])
        found = pages.common_places(a, b)
        rest = iter(b)
        assert len(found) == table[-1][-1] and found == sorted(set(found)) and all(any(x == y for y in rest) for x in (a[i] for i in found))


@tables
def test_pipeline_stage_by_stage(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").cache()
    staged = []
    for name, stage in corpus_pipeline.STAGES:
        before, docs = docs, stage(spark, docs, SF).cache()
        staged.append((name, before, docs))
    for name, before, after in staged[:-1]:
        assert after.columns == before.columns and after.schema == before.schema, name
        assert {r.doc_id for r in after.collect()} <= {r.doc_id for r in before.collect()}
    _, before, after = staged[2]
    rows = [(r.doc_id, r.text) for r in before.collect()]
    want = brute_components(brute_sets(rows, 5))
    assert {r.doc_id for r in after.collect()} == {i for i, c in want.items() if i == c}
    last = {tuple(r) for r in staged[-1][2].select("doc_id", "start", "length", "ids_crc32").collect()}
    assert last == {tuple(r) for r in corpus_pipeline.run(spark, SF).select("doc_id", "start", "length", "ids_crc32").collect()}


@tables
def test_pipeline_takes_empty_and_repeated_rows(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    for odd in (docs.limit(0), docs.limit(20).unionByName(docs.limit(3)).unionByName(spark.createDataFrame([(None, None, None, None, None), (99999, "", None, None, 0)], docs.schema))):
        for _, stage in corpus_pipeline.STAGES:
            odd = stage(spark, odd, SF)
        odd.collect()


@tables
@pytest.mark.parametrize("name", list(queries.ENTRIES))
def test_registered_queries(spark, name):
    assert name in entry.queries()
    rows = queries.ENTRIES[name][0](spark, SF)
    got = rows.collect()
    assert got
    sql = queries.ENTRIES[name][1]
    if sql:
        con = duckdb.connect()
        for table in ("documents", "embeddings", "pages", "labels"):
            con.execute(f"create view {table} as select * from '{SF}/{table}.parquet'")
        want = con.execute(sql)
        assert sorted(c[0] for c in want.description) == sorted(rows.columns)
        order = [c[0] for c in want.description]
        assert sorted(want.fetchall()) == sorted(tuple(r[c] for c in order) for r in got)
