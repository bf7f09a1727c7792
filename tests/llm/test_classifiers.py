"""Toxicity and quality: held-out accuracy, what a score may depend on, and edges."""

import random
import tracemalloc
import zlib
from pathlib import Path

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from rentloom.llm import common, labelled, quality, toxicity

SF = "/root/testdata/sf0.01"


def corpus(spark, label, bad):
    """Documents of random words; documents with label 1 (toxic) or 0 (quality) hold ``bad`` words."""
    rng = random.Random(9)
    words = ["".join(rng.choice("abcdefgh") for _ in range(4)) for _ in range(400)]
    docs, labels = [], []
    for i in range(900):
        marked = i % 4 == 0
        text = [rng.choice(words) for _ in range(rng.randint(20, 80))]
        if marked:
            for _ in range(4):
                text[rng.randrange(len(text))] = rng.choice(bad)
        docs.append((i, " ".join(text), "xx", 1.0))
        labels.append((i, int(marked) if label == "toxic" else int(not marked), "clash"))
    return spark.createDataFrame(docs, "doc_id long, text string, lang string, score double"), spark.createDataFrame(labels, f"doc_id long, {label} int, text string")


CASES = {
    "toxic": (toxicity.toxicity, toxicity.without_toxic, ["zzidiot", "zzmoron", "zzscum"], 0.5),
    "quality": (quality.quality, quality.without_poor, ["$$%%&&", "!!##!!", "@@@@"], 0.3),
}


@pytest.mark.parametrize("label", list(CASES))
def test_held_out_accuracy_and_kept_rows(spark, label):
    of, kept, bad, threshold = CASES[label]
    docs, labels = corpus(spark, label, bad)
    rows = of(docs, labels).join(labels.select("doc_id", label), "doc_id").collect()
    assert len(rows) == 900
    for r in rows:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0)
        assert 0 <= r.score <= 1 and r.predicted == int(r.score >= threshold)
    out = [r for r in rows if r.held_out]
    assert np.mean([r.predicted == r[label] for r in out]) > 0.95
    stays = {r.doc_id for r in kept(docs, labels).collect()}
    assert stays == {r.doc_id for r in rows if r.predicted == (1 if label == "quality" else 0)}
    assert kept(docs, labels).columns == docs.columns


@pytest.mark.parametrize("label", list(CASES))
def test_edges(spark, label):
    of, kept, bad, _ = CASES[label]
    docs, labels = corpus(spark, label, bad)
    odd = spark.createDataFrame([(None, "some text", None, None), (2000, None, None, None), (2001, "", None, None), (2001, "", None, None), (2002, " \n", None, None), (2003, "word " * 30000, None, None)], docs.schema)
    extra = spark.createDataFrame([(None, 1, "x"), (5, None, "x"), (7, 1, "x"), (7, 0, "x")], labels.schema)
    rows = of(docs.unionByName(odd), labels.unionByName(extra)).filter("doc_id is null or doc_id >= 2000").collect()
    assert len(rows) == 6 and all(0 <= r.score <= 1 for r in rows)
    empty = {r.score for r in rows if r.doc_id in (2000, 2001, 2002)}
    assert len(empty) == 1
    assert of(docs.limit(0), labels).collect() == [] and kept(docs.limit(0), labels).collect() == []
    assert len({r.score for r in of(docs.limit(20), labels.limit(0)).collect()}) == 1
    one = labels.filter(F.col(label) == 1)
    assert {r.predicted for r in of(docs.limit(20), one).collect()} == {1}


def test_held_out_rows_and_other_columns_do_not_reach_the_model(spark):
    docs, labels = corpus(spark, "toxic", ["zzidiot"])
    chosen = labelled.training_rows(docs, labels, "toxic", 50)
    ids = [r.doc_id for r in chosen.collect()]
    assert len(ids) == 50 and all(zlib.crc32(str(i).encode()) % 5 for i in ids)
    flipped = labels.withColumn("toxic", F.when(labelled.held_out(), 1 - F.col("toxic")).otherwise(F.col("toxic")))
    a = toxicity.toxicity(docs, labels).orderBy("doc_id").collect()
    b = toxicity.toxicity(docs.withColumn("lang", F.lit("q")).repartition(3), flipped).orderBy("doc_id").collect()
    assert [r[:2] for r in a] == [r[:2] for r in b]
    assert np.allclose([r.score for r in a], [r.score for r in b], atol=1e-6)  # sums in 32 bits depend on what shares a slice


def test_scorer_equals_the_plain_network():
    rng = np.random.default_rng(3)
    samples = [(rng.integers(0, 1 << 32, n, dtype=np.uint64).astype(np.uint32), 0, n % 2) for n in range(1, 60)]
    model = toxicity.train(samples)
    texts = [b"", b"one", b"one two three", b"the of and der", b"word " * 500]
    want = [toxicity.sigmoid(toxicity.logit(model, b) - model.shift[toxicity.language(t)]) for b, t in (toxicity.packed(toxicity.words_of(x)) for x in texts)]
    assert np.allclose(toxicity.scorer(model)(texts), want, atol=1e-5)


def test_quality_scorer_equals_the_average():
    rng = np.random.default_rng(3)
    shares = rng.normal(size=quality.BUCKETS + 1)
    for text in (b"", b"one two two three", b"a a a"):
        words = text.split()
        ids = [quality.features([w])[0] for w in words]
        again = quality.REPEAT_WEIGHT * sum(a == b for a, b in zip(words, words[1:]))
        total = sum(map(len, ids)) + again
        mean = (sum(shares[i].sum() for i in ids) + again * shares[quality.REPEATED]) / total if total else 0
        assert np.isclose(quality.scorer(shares, 0.2)([text])[0], 1 / (1 + np.exp(-mean - 0.2)))


@pytest.mark.skipif(not Path(SF).exists(), reason="test tables are not there")
@pytest.mark.parametrize("label", list(CASES))
def test_accuracy_on_the_tables(spark, label):
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    rows = CASES[label][0](docs, labels).join(labels, "doc_id").filter("held_out").collect()
    assert np.mean([r.predicted == r[label] for r in rows]) > 0.9


def test_quality_grams_are_of_characters():
    ids, sizes = quality.features(["naïve".encode(), "日本語".encode(), b"plain", b""])
    # The word itself, and windows of 3 and 4 over its characters and two edge marks.
    assert sizes.tolist() == [1 + 5 + 4, 1 + 3 + 2, 1 + 5 + 4, 1]
    first, other = (set(quality.features([w.encode()])[0].tolist()) for w in ("日本語", "は日本語だ"))
    assert len(first & other) == 1  # the trigram both hold; edges and words differ
    assert quality.features([b"\xff\xfe"])[1].tolist() == [1 + 2 + 1]


def test_scoring_memory_of_a_megabyte():
    rng = np.random.default_rng(3)
    model = toxicity.train([(rng.integers(0, 1 << 32, n, dtype=np.uint64).astype(np.uint32), 0, n % 2) for n in range(1, 60)])
    words = [b"%04d" % i for i in range(1000)]
    texts = [b" ".join(words[i % 1000] for i in range(k, k + 2000)) for k in range(105)]  # 210,000 words
    of = toxicity.scorer(model)
    of([b" ".join(words)])
    tracemalloc.start()
    of(texts)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 60e6  # the rows of the words, and as much twice for the answers of one width: 13 MB each


@pytest.mark.parametrize("rows", [3, 0])
def test_a_task_gives_its_memory_back_when_it_ends(monkeypatch, rows):
    given = []
    monkeypatch.setattr(common, "_trim", lambda: given.append(1))
    monkeypatch.setattr(labelled, "bounded_batches", lambda spark: None)

    class Docs:  # hands out the task's function
        sparkSession = schema = None

        def mapInArrow(self, run, schema):
            return run

    run = labelled.keep(Docs(), lambda: lambda texts: np.zeros(len(texts)), 0.5, above=False)
    batch = pa.record_batch({"doc_id": list(range(rows)), "text": pa.array(["a"] * rows, pa.string())})
    assert [b.num_rows for b in run(iter([batch, batch]))] == [rows, rows] and len(given) == 1
    stopped = run(iter([batch, batch]))
    next(stopped)
    stopped.close()  # a limit ends a task early
    assert len(given) == 2
