"""Quality by learned subword embeddings: hashed word and character n-gram vectors, averaged per document, softmax output.

Words and the character n-grams inside them share one hashed table; a word that repeats the one before it adds a feature of
its own. Vectors and output are trained together by stochastic gradient descent (Adagrad steps) in numpy on a bounded
sample. When scoring, each feature's share of the logit is one number, so a word's share is a sum that is kept per word.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from xxhash import xxh3_64_intdigest

from rentloom.llm.common import bounded_batches, give_back, giving_back, mix32, ragged_index, text_slices
from rentloom.llm.labelled import Rows, Slots, keep, score, training_rows

BUCKETS, DIM, GRAMS = 1 << 17, 8, (3, 4)
SAMPLE, EPOCHS, RATE, BATCH, MOST_WORDS = 6000, 8, 0.3, 64, 300_000
STEPS, MOST_EPOCHS = 700, 80  # small samples are gone through more often, to take about as many steps
THRESHOLD = 0.3
REPEAT_WEIGHT = 10
REPEATED = BUCKETS  # the feature of a word that repeats the one before it


def features(words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(features of all words, number of features of each): the word and its n-grams of code points, edges marked."""
    marked = [f"<{w.decode(errors='replace')}>" for w in words]
    data = np.frombuffer("".join(marked).encode("utf-32-le"), np.uint32)
    sizes = np.fromiter(map(len, marked), np.int64, len(words))
    starts = np.cumsum(sizes) - sizes
    parts = [np.fromiter((xxh3_64_intdigest(w) & 0xFFFFFFFF for w in words), np.uint32, len(words))]
    owners = [np.arange(len(words))]
    for n in GRAMS:
        many = np.maximum(sizes - n + 1, 0)
        at = ragged_index(starts, many)
        code = np.full(len(at), n, np.uint32)
        for j in range(n):
            code = code * np.uint32(0x01000193) + data[at + j]
        parts.append(mix32(code))
        owners.append(np.repeat(np.arange(len(words)), many))
    owner = np.concatenate(owners)
    order = np.argsort(owner, kind="stable")
    ids = (np.concatenate(parts) & np.uint32(BUCKETS - 1)).astype(np.int64)[order]
    return ids, np.bincount(owner, minlength=len(words))


def repeats(slots: np.ndarray) -> int:
    """Weight of the words that repeat the one before them; each weighs as much as a word with its n-grams."""
    return REPEAT_WEIGHT * int((slots[1:] == slots[:-1]).sum())


def collect_samples(rows: DataFrame) -> list[tuple[np.ndarray, np.ndarray, int]]:
    """(features, counts, label) of the bounded training rows; only hashed features come to the driver."""
    bounded_batches(rows.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, texts in text_slices(batch, "text"):
                ids, counts = [], []
                for text in texts:
                    slots = Slots()
                    own = slots.of(text.split())
                    flat, many = features(slots.new())
                    times = np.repeat(np.bincount(own, minlength=len(many)), many)
                    total = np.bincount(np.append(flat, REPEATED), weights=np.append(times, repeats(own)))
                    kinds = np.flatnonzero(total)
                    ids.append(kinds.astype(np.int32).tobytes())
                    counts.append(total[kinds].astype(np.float32).tobytes())
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("doc_id").slice(a, b - a).cast(pa.string()),
                        pa.array(ids, pa.binary()),
                        pa.array(counts, pa.binary()),
                        batch.column("label").slice(a, b - a).cast(pa.int32()),
                    ],
                    ["doc_id", "ids", "counts", "label"],
                )

    got = rows.mapInArrow(giving_back(run), "doc_id string, ids binary, counts binary, label int").toArrow()
    columns = {name: got.column(name).to_pylist() for name in got.column_names}
    order = sorted(range(got.num_rows), key=lambda i: (columns["doc_id"][i], columns["ids"][i]))
    return [
        (np.frombuffer(columns["ids"][i], np.int32), np.frombuffer(columns["counts"][i], np.float32), columns["label"][i])
        for i in order
    ]


def train(samples: list[tuple[np.ndarray, np.ndarray, int]], seed: int = 5) -> tuple[np.ndarray, float]:
    """(share of each feature in the logit of label 1, base logit). Without both labels every text scores the same."""
    labels = np.array([y for _, _, y in samples], int)
    if not len(labels) or labels.all() or not labels.any():
        return np.zeros(BUCKETS + 1), -5.0 if len(labels) and not labels.any() else 5.0
    rng = np.random.default_rng(seed)
    vectors = rng.uniform(-1 / DIM, 1 / DIM, (BUCKETS + 1, DIM))
    out, bias = rng.normal(0, 0.1, (DIM, 2)), np.zeros(2)
    seen_vectors, seen_out, seen_bias = np.full(BUCKETS + 1, 1e-6), np.full((DIM, 2), 1e-4), np.full(2, 1e-4)
    share = labels.mean()
    weight = np.where(labels == 1, 0.5 / share, 0.5 / (1 - share)) ** 0.5
    epochs = min(max(EPOCHS, -(-STEPS * BATCH // len(samples))), MOST_EPOCHS)
    for epoch in range(epochs):
        rate = RATE * (1 - epoch / epochs)
        order = rng.permutation(len(samples))
        for at in range(0, len(order), BATCH):
            rows = order[at : at + BATCH]
            sizes = np.array([len(samples[i][0]) for i in rows])
            rows, sizes = rows[sizes > 0], sizes[sizes > 0]
            if not len(rows):
                continue
            ids = np.concatenate([samples[i][0] for i in rows])
            shares = np.concatenate([samples[i][1] / samples[i][1].sum() for i in rows])
            doc = np.repeat(np.arange(len(rows)), sizes)
            mean = np.add.reduceat(vectors[ids] * shares[:, None], np.cumsum(sizes) - sizes)
            z = mean @ out + bias
            p = np.exp(z - z.max(1, keepdims=True))
            p /= p.sum(1, keepdims=True)
            p[np.arange(len(rows)), labels[rows]] -= 1
            p *= weight[rows, None]
            back = p @ out.T
            kinds, place = np.unique(ids, return_inverse=True)
            change = np.stack([np.bincount(place, weights=shares * back[doc, d], minlength=len(kinds)) for d in range(DIM)], axis=1)
            seen_vectors[kinds] += (change * change).mean(1)
            vectors[kinds] -= rate * change / np.sqrt(seen_vectors[kinds])[:, None]
            for value, seen, grad in ((out, seen_out, mean.T @ p), (bias, seen_bias, p.sum(0))):
                seen += grad * grad
                value -= rate * grad / np.sqrt(seen)
    return vectors @ (out[:, 1] - out[:, 0]), float(bias[1] - bias[0])


def scorer(shares: np.ndarray, base: float):
    """Texts → scores; a word's share and number of features are kept per word, within a bound."""
    slots = Slots()
    share, many = Rows(), Rows()

    def of(texts: list[bytes]) -> np.ndarray:
        if len(slots) > MOST_WORDS:
            for kept in (slots, share, many):
                kept.clear()
        each = [slots.of(t.split()) for t in texts]
        if new := slots.new():
            ids, sizes = features(new)
            owner = np.repeat(np.arange(len(new)), sizes)
            share.add(np.bincount(owner, weights=shares[ids], minlength=len(new)))
            many.add(sizes)
        out = np.empty(len(texts))
        for i, own in enumerate(each):
            again = repeats(own)
            total = many.data[own].sum() + again
            out[i] = (share.data[own].sum() + again * shares[REPEATED]) / total if total else 0
        return 1 / (1 + np.exp(-np.clip(out + base, -30, 30)))

    return of


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality", sample: int = SAMPLE) -> tuple[np.ndarray, float]:
    model = train(collect_samples(training_rows(docs, labels, label, sample)))
    give_back()
    return model


def quality(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """doc_id, held_out, score and predicted of every whole text.

    A null or empty text has no features and gets the base score. Repeated rows are scored each; an empty table gives an
    empty result; without labels of both kinds every text gets the same score. Other columns are never read.
    """
    shares, base = fit(docs, labels, sample=sample)
    return score(docs, lambda: scorer(shares, base), THRESHOLD)


def without_poor(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """The documents, with all their columns, that the classifier does not reject."""
    shares, base = fit(docs, labels, sample=sample)
    return keep(docs, lambda: scorer(shares, base), THRESHOLD, above=True)
