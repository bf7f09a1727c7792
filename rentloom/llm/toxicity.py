"""Toxicity by a convolutional text classifier, trained in numpy.

Every word is the sum of two hashed embeddings (the word and its first four bytes). Filters of several widths slide over
the whole text; each keeps its largest answer, and a logistic output reads these. Online Adagrad trains all parts on a
bounded sample. Thresholds are chosen per language, guessed from frequent words of the text, on rows kept out of
training, and moved to 0.5 by a shift of the logit.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from xxhash import xxh3_64_intdigest

from rentloom.llm.common import bounded_batches, give_back, giving_back, ragged_index, text_slices
from rentloom.llm.labelled import Rows, Slots, keep, score, training_rows

BUCKETS, DIM, FILTERS, WIDTHS = 1 << 16, 16, 16, (1, 2, 3)
SAMPLE, EPOCHS, RATE, MOST_WORDS = 8000, 6, 0.08, 100_000
PAD = max(WIDTHS) - 1
GATHERED = 1 << 16  # words whose vectors are copied at a time
EDGES = b".,;:!?\"'()[]"

# Frequent short words that tell the languages of the corpus apart.
LANGUAGE_WORDS = {
    "en": ["the", "of", "and", "to", "that", "is", "with", "was", "for", "this"],
    "fr": ["le", "et", "des", "les", "est", "une", "du", "dans", "pour", "pas"],
    "de": ["der", "und", "das", "ist", "nicht", "den", "von", "mit", "auf", "sich"],
    "es": ["el", "los", "y", "por", "las", "que", "con", "una", "del", "para"],
}
LANGUAGE_OF = {w.encode(): i for i, words in enumerate(LANGUAGE_WORDS.values()) for w in words}
LANGUAGES = len(LANGUAGE_WORDS) + 1  # the last one: none of these words occurs


def words_of(text: bytes) -> list[bytes]:
    return text.lower().split()


def packed(words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(both buckets of each word in one number, language of each word or -1). Signs at a word's edges do not count."""
    bare = [w.strip(EDGES) or w for w in words]
    buckets = np.fromiter(
        ((xxh3_64_intdigest(w) & 0xFFFF) | (xxh3_64_intdigest(w[:4], 7) & 0xFFFF) << 16 for w in bare), np.uint32, len(bare)
    )
    return buckets, np.fromiter((LANGUAGE_OF.get(w, -1) for w in bare), np.int8, len(bare))


def language(found: np.ndarray) -> int:
    """The language most of whose words occur in a text; the first of those that tie."""
    counts = np.bincount(found[found >= 0], minlength=LANGUAGES - 1)
    return int(counts.argmax()) if counts.any() else LANGUAGES - 1


@dataclass
class Model:
    table: np.ndarray
    filters: list[np.ndarray]
    bias: np.ndarray
    out: np.ndarray
    base: float
    shift: np.ndarray

    def embed(self, buckets: np.ndarray) -> np.ndarray:
        return self.table[buckets & 0xFFFF] + self.table[buckets >> 16]


def answers(model: Model, rows: np.ndarray) -> Iterator[np.ndarray]:
    """Answers of the filters of each width at every row, one width at a time in one array; the last PAD rows of ``rows`` are padding and get none."""
    n = len(rows) - PAD
    total, more = np.empty((n, FILTERS), np.float32), np.empty((n, FILTERS), np.float32)
    for parts in model.filters:
        np.matmul(rows[:n], parts[0], out=total)
        for j, part in enumerate(parts[1:], 1):
            total += np.matmul(rows[j : j + n], part, out=more)
        yield total


def sigmoid(z):
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def train(samples: list[tuple[np.ndarray, int, int]], seed: int = 11) -> Model:
    """Fit on (buckets of the words, language, label). Without both labels the score is the same for every text."""
    rng = np.random.default_rng(seed)
    labels = np.array([y for _, _, y in samples], float)
    model = Model(
        rng.normal(0, 0.1, (BUCKETS, DIM)).astype(np.float32),
        [rng.normal(0, 0.3, (w, DIM, FILTERS)).astype(np.float32) for w in WIDTHS],
        np.zeros(len(WIDTHS) * FILTERS, np.float32),
        np.abs(rng.normal(0, 0.3, len(WIDTHS) * FILTERS)).astype(np.float32),
        0.0,
        np.zeros(LANGUAGES),
    )
    if not labels.any() or labels.all():
        model.out[:] = 0
        model.base = 0.0 if not len(labels) else (5.0 if labels[0] else -5.0)
        if not len(labels):
            model.base = -5.0
        return model
    order = rng.permutation(len(samples))
    fit, check = (order[len(order) // 5 :], order[: len(order) // 5]) if len(order) >= 200 else (order, order)
    weight = np.where(labels > 0, min(4.0, (1 - labels.mean()) / labels.mean()), 1.0)
    seen_table = np.full(BUCKETS, 1e-2, np.float32)
    seen = [np.full_like(f, 1e-2) for f in model.filters]
    seen_bias, seen_out, seen_base = np.full_like(model.bias, 1e-2), np.full_like(model.out, 1e-2), 1e-2
    pad = np.zeros((PAD, DIM), np.float32)
    for _ in range(EPOCHS):
        for at in rng.permutation(fit):
            buckets, _, y = samples[at]
            rows = np.concatenate([model.embed(buckets), pad]) if len(buckets) else np.zeros((PAD + 1, DIM), np.float32)
            best, top = [], []
            for a in answers(model, rows):
                best.append(a.argmax(0))
                top.append(a[best[-1], np.arange(FILTERS)])
            top = np.concatenate(top) + model.bias
            live = np.maximum(top, 0)
            error = float(sigmoid(live @ model.out + model.base) - y) * float(weight[at])
            if abs(error) < 1e-3:
                continue
            down = np.where(top > 0, error * model.out, 0).astype(np.float32)
            step = error * live
            seen_out += step * step
            model.out -= RATE * step / np.sqrt(seen_out)
            seen_bias += down * down
            model.bias -= RATE * down / np.sqrt(seen_bias)
            seen_base += error * error
            model.base -= RATE * error / seen_base**0.5
            hit, moved = [], []
            for k, place in enumerate(best):
                own = down[k * FILTERS : (k + 1) * FILTERS]
                for j in range(WIDTHS[k]):
                    at_rows = place + j
                    moved.append((model.filters[k][j] * own).T)
                    hit.append(at_rows)
                    change = (rows[at_rows] * own[:, None]).T
                    seen[k][j] += change * change
                    model.filters[k][j] -= RATE * change / np.sqrt(seen[k][j])
            hit, moved = np.concatenate(hit), np.concatenate(moved)
            inside = (hit < len(buckets)) & moved.any(1)
            hit, moved = hit[inside], moved[inside]
            for bucket in (buckets[hit] & 0xFFFF, buckets[hit] >> 16):
                np.add.at(seen_table, bucket, (moved * moved).mean(1))
                np.subtract.at(model.table, bucket, RATE * moved / np.sqrt(seen_table[bucket])[:, None])
    logits = np.array([logit(model, samples[i][0]) for i in check])
    spoken = np.array([samples[i][1] for i in check])
    common = best_cut(logits, labels[check])
    for lang in range(LANGUAGES):
        own = spoken == lang
        enough = labels[check][own].sum() >= 15 and (1 - labels[check][own]).sum() >= 15
        model.shift[lang] = best_cut(logits[own], labels[check][own]) if enough else common
    return model


def logit(model: Model, buckets: np.ndarray) -> float:
    rows = np.concatenate([model.embed(buckets), np.zeros((PAD, DIM), np.float32)]) if len(buckets) else np.zeros((PAD + 1, DIM), np.float32)
    top = np.concatenate([a.max(0) for a in answers(model, rows)]) + model.bias
    return float(np.maximum(top, 0) @ model.out + model.base)


def best_cut(logits: np.ndarray, labels: np.ndarray) -> float:
    """The cut with the best F1, in the middle of the gap where it lies."""
    order = np.argsort(-logits, kind="stable")
    x, y = logits[order], labels[order]
    hits = np.cumsum(y)
    f1 = 2 * hits / (np.arange(1, len(y) + 1) + y.sum())
    at = int(f1.argmax())
    return float((x[at] + x[at + 1]) / 2) if at + 1 < len(x) else float(x[at] - 1)


def collect_samples(rows: DataFrame) -> list[tuple[np.ndarray, int, int]]:
    """Hashed words of the bounded training rows; words are hashed on the executors, only buckets come to the driver."""
    bounded_batches(rows.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, texts in text_slices(batch, "text"):
                each = [packed(words_of(t)) for t in texts]
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("doc_id").slice(a, b - a).cast(pa.string()),
                        pa.array([x.tobytes() for x, _ in each], pa.binary()),
                        pa.array([language(found) for _, found in each], pa.int32()),
                        batch.column("label").slice(a, b - a).cast(pa.int32()),
                    ],
                    ["doc_id", "words", "language", "label"],
                )

    got = rows.mapInArrow(giving_back(run), "doc_id string, words binary, language int, label int").toArrow().to_pydict()
    order = sorted(range(len(got["doc_id"])), key=lambda i: (got["doc_id"][i], got["words"][i]))
    return [(np.frombuffer(got["words"][i], np.uint32), got["language"][i], got["label"][i]) for i in order]


def scorer(model: Model):
    """Texts → scores, many texts in one pass over their joined rows."""
    slots = Slots()
    embedded, tongues = Rows(DIM, kind=np.float32), Rows(kind=np.int8)

    def of(texts: list[bytes]) -> np.ndarray:
        if len(slots) > MOST_WORDS:
            for kept in (slots, embedded, tongues):
                kept.clear()
        each = [slots.of(words_of(t)) for t in texts]
        if new := slots.new():
            buckets, spoken = packed(new)
            embedded.add(model.embed(buckets))
            tongues.add(spoken)
        sizes = np.array([len(e) for e in each])
        held = np.maximum(sizes, 1)
        spans = held + PAD
        starts = np.cumsum(spans) - spans
        rows = np.zeros((int(spans.sum()) + PAD + 1, DIM), np.float32)  # PAD + 1 at the end so that every cut has an answer
        place = ragged_index(starts, sizes)
        flat = np.concatenate(each) if each else np.zeros(0, np.int64)
        del each
        for at in range(0, len(flat), GATHERED):
            rows[place[at : at + GATHERED]] = embedded.data[flat[at : at + GATHERED]]
        cuts = np.stack([starts, starts + held], axis=1).ravel()
        top = np.concatenate([np.maximum.reduceat(a, cuts, axis=0)[::2] for a in answers(model, rows)], axis=1)
        found = tongues.data[flat]
        doc = np.repeat(np.arange(len(texts)), sizes)[found >= 0]
        counts = np.bincount(doc * LANGUAGES + found[found >= 0], minlength=len(texts) * LANGUAGES).reshape(len(texts), LANGUAGES)
        tongue = np.where(counts.any(1), counts.argmax(1), LANGUAGES - 1)
        return sigmoid(np.maximum(top + model.bias, 0) @ model.out + model.base - model.shift[tongue])

    return of


def fit(docs: DataFrame, labels: DataFrame, label: str = "toxic", sample: int = SAMPLE) -> Model:
    model = train(collect_samples(training_rows(docs, labels, label, sample)))
    give_back()
    return model


def toxicity(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """doc_id, held_out, score and predicted of every whole text.

    A null or empty text has the score of a text without words. Repeated rows are scored each; an empty table gives an
    empty result; without labels of both kinds every text gets the same score. Other columns are never read.
    """
    model = fit(docs, labels, sample=sample)
    return score(docs, lambda: scorer(model), 0.5)


def without_toxic(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """The documents, with all their columns, that the classifier does not reject."""
    model = fit(docs, labels, sample=sample)
    return keep(docs, lambda: scorer(model), 0.5, above=False)
