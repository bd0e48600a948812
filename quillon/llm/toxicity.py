"""Toxicity: a support vector machine on a gapped subsequence string kernel, with Nystroem landmarks.

The kernel of two words is the inner product of their weighted subsequences: every three characters
in order within SPAN places count DECAY to the number of places skipped, ends of words are marked,
and vectors are divided by the norm for the word's length. So `idxiot` stays near `idiot`; the words
found most often are also given to the training with a character inserted. Words with other
characters among their letters are read without them too (`i.d.i.o.t`), and runs of single characters
(`i d i o t`) as one word.

Labels are of documents, while an insult stands in one sentence. Training works on sentences: all those
of clean documents are clean; in a toxic document the sentences that score highest under the present
model are toxic, which starts from how much more often subsequences occur in toxic documents, and
is repeated (multiple-instance SVM). A sentence's score is that of its highest word.

With landmarks l and their kernel matrix K, a word is mapped to K^(-1/2) k(l, word), on which a linear
squared-hinge SVM is fitted by Newton steps. The decision is then a weighted sum of the landmarks'
kernels, and as the kernel is an inner product of subsequence vectors this sum is one weight per
subsequence: scoring is an exact evaluation without touching the landmarks again.

Scoring reads whole texts: each distinct word of a batch once, with a bounded cache per worker. A
document's score is a logistic function of its highest words, fitted on the same training documents.

Defined cases: null, empty and blank texts get the score of no word found; without usable labels of
both classes every score is the prior; repeated rows and null doc_ids keep one row each; an empty table
gives an empty table; other columns are ignored.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import batches_of, give_back, read_table, small_batches
from .labelled import fold_of, training_texts

MODULUS, HELD_OUT = 4, 2
PER_CLASS = 1500
THRESHOLD = 0.3
LANDMARKS = 192
NEGATIVES = 12_000
ROUNDS = 3
AUGMENTED = 40
DECAY = 0.8
SPAN = 5
MAX_WORD = 24
CACHE_WORDS = 200_000

_tuples = [(a, b) for b in range(2, SPAN) for a in range(1, b)]
_weights = np.array([DECAY ** (b - 2) for _, b in _tuples], np.float32)
DIMENSIONS = 1 << 18
_spaced = re.compile(r"(?<!\S)\S(?: \S){3,}(?!\S)")
_sentence = re.compile(r"[.!?\n]+")
_strip = "\"'()[]{}<>,.;:!?*#$%&|-_~`"


def words_of(text: str) -> set[str]:
    """The distinct words of a text, lower-cased and without punctuation at their ends."""
    text = text.lower()
    words = {w.strip(_strip) for w in set(text.split())}
    words.update(m[0].replace(" ", "") for m in _spaced.finditer(text))
    words.update("".join(filter(str.isalpha, w)) for w in [w for w in words if not w.isalpha()])
    words.discard("")
    long = [w for w in words if len(w) > MAX_WORD]
    for w in long:  # whole, in overlapping pieces
        words.discard(w)
        words.update(w[k : k + MAX_WORD] for k in range(0, len(w) - MAX_WORD // 2, MAX_WORD // 2))
    return words


def _codes(words: list[str], length: int) -> np.ndarray:
    """Characters of words of one length as 6-bit codes, with a start and an end mark."""
    raw = np.array(words, dtype=f"<U{length}").view(np.uint32).reshape(len(words), length)
    letters = (raw >= 97) & (raw <= 122)
    codes = np.where(letters, raw - 96, 28 + (raw * np.uint32(2654435761) >> np.uint32(16)) % 36)
    return np.pad(codes, ((0, 0), (1, 1)), constant_values=((0, 0), (0, 27))).astype(np.int32)


def subsequences(words: list[str], length: int) -> tuple[np.ndarray, np.ndarray]:
    """Subsequence numbers (word, entry), and the entries' weights divided by their norm."""
    codes = _codes(words, length)
    size, found, weights = length + 2, [], []
    for (a, b), w in zip(_tuples, _weights, strict=True):
        if size > b:
            found.append((codes[:, : size - b] << 12) | (codes[:, a : size - b + a] << 6) | codes[:, b:])
            weights.append(np.full(size - b, w, np.float32))
    value = np.concatenate(weights)
    return np.concatenate(found, axis=1), value / np.sqrt((value**2).sum())


def by_length(words: list[str]) -> dict[int, list[int]]:
    out: dict[int, list[int]] = {}
    for i, w in enumerate(words):
        out.setdefault(len(w), []).append(i)
    return out


def weighted(words: list[str], weight: np.ndarray) -> np.ndarray:
    """Sum of the weights of each word's subsequences."""
    out = np.zeros(len(words))
    for length, places in by_length(words).items():
        for at in range(0, len(places), 20_000):
            part = places[at : at + 20_000]
            entries, value = subsequences([words[i] for i in part], length)
            out[part] = weight[entries] @ value
    return out


@dataclass(frozen=True)
class Model:
    weight: np.ndarray  # by subsequence
    bias: float
    scale: np.ndarray  # of the highest and second highest word, and a constant

    def words(self, words: list[str]) -> np.ndarray:
        return weighted(words, self.weight) + self.bias

    def probability(self, highest: np.ndarray) -> np.ndarray:
        z = highest[:, 0] * self.scale[0] + highest[:, 1] * self.scale[1] + self.scale[2]
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


#: The value of a place in `highest` for which a text has no word.
NONE = -2.0


def highest_words(scores: list[float]) -> tuple[float, float]:
    top = sorted(scores)[-2:]
    return (max(NONE, top[-1]) if top else NONE, max(NONE, top[-2]) if len(top) > 1 else NONE)


def kernel(words: list[str], landmarks: list[str]) -> np.ndarray:
    places, rows, values = [], [], []
    for length, own in by_length(landmarks).items():
        entries, value = subsequences([landmarks[i] for i in own], length)
        places.append(entries.ravel())
        rows.append(np.repeat(own, entries.shape[1]))
        values.append(np.tile(value, len(own)))
    place, row, value = np.concatenate(places), np.concatenate(rows), np.concatenate(values)
    used, at = np.unique(place, return_inverse=True)
    dense = np.zeros((len(used) + 1, len(landmarks)), np.float32)
    np.add.at(dense, (at, row), value)
    index = np.full(DIMENSIONS, len(used))
    index[used] = np.arange(len(used))
    out = np.zeros((len(words), len(landmarks)), np.float32)
    for length, own in by_length(words).items():
        for k in range(0, len(own), 256):
            part = own[k : k + 256]
            entries, value = subsequences([words[i] for i in part], length)
            out[part] = np.einsum("nek,e->nk", dense[index[entries]], value)
    return out


def fit_svm(x: np.ndarray, y: np.ndarray, cost: np.ndarray, l2: float = 1.0, steps: int = 25) -> np.ndarray:
    """Squared hinge loss; the last weight is the bias. y is -1 or 1."""
    x = np.column_stack([x, np.ones(len(x))])
    w = np.zeros(x.shape[1])
    ridge = np.diag([l2] * (x.shape[1] - 1) + [1e-6])
    for _ in range(steps):
        inside = y * (x @ w) < 1
        a = x[inside] * cost[inside, None]
        new = np.linalg.solve(a.T @ x[inside] + ridge, a.T @ y[inside])
        if np.abs(new - w).max() < 1e-6:
            break
        w = new
    return w


def _svm(positive: list[str], weights: list[float], negative: list[str], landmarks: list[str]) -> tuple[np.ndarray, float]:
    """Weights by subsequence, and the bias."""
    own = kernel(landmarks, landmarks).astype(float)
    value, vector = np.linalg.eigh(own + 1e-6 * np.eye(len(landmarks)))
    root = vector / np.sqrt(np.maximum(value, 1e-6)) @ vector.T
    x = kernel(positive + negative, landmarks) @ root
    y = np.array([1.0] * len(positive) + [-1.0] * len(negative))
    total = sum(weights)
    cost = np.concatenate([np.array(weights) * (2000 / total), np.full(len(negative), 4000 / len(negative))])
    w = fit_svm(x, y, cost)
    beta = root @ w[:-1]
    weight = np.zeros(DIMENSIONS)
    for length, places in by_length(landmarks).items():
        entries, value = subsequences([landmarks[i] for i in places], length)
        np.add.at(weight, entries, beta[places][:, None] * value[None, :])
    return weight, float(w[-1])


def _document_share(documents: list[set[str]]) -> np.ndarray:
    """For each subsequence, in how many documents it occurs."""
    counts = np.zeros(DIMENSIONS, np.int32)
    for words in documents:
        present = [np.unique(subsequences(sorted(group), length)[0]) for length, group in _groups(words).items()]
        if present:
            counts[np.unique(np.concatenate(present))] += 1
    return counts


def _groups(words: set[str]) -> dict[int, list[str]]:
    out: dict[int, list[str]] = {}
    for w in words:
        out.setdefault(len(w), []).append(w)
    return out


def fit(texts: list[str], labels: list[int], rounds: int = ROUNDS) -> Model:
    """Deterministic for the order of the examples."""
    same: dict[str, str] = {}  # each word is held once
    shared = lambda words: {same.setdefault(w, w) for w in words}
    toxic = [[shared(words) for s in _sentence.split(t) if (words := words_of(s))] or [shared(words_of(t))] for t, y in zip(texts, labels, strict=True) if y]
    clean = [shared(words_of(t)) for t, y in zip(texts, labels, strict=True) if not y]
    prior = (len(toxic) + 0.5) / (len(texts) + 1)
    if not toxic or not clean:
        return Model(np.zeros(DIMENSIONS), 0.0, np.array([0.0, 0.0, np.log(prior / (1 - prior))]))
    known_clean = set().union(*clean)
    rng = np.random.Generator(np.random.PCG64(7))
    # words of toxic documents that no clean one has, by sentence: only these can be what is toxic
    suspects = [[sorted(s - known_clean) for s in x] for x in toxic]
    suspects = [[s for s in x if s] for x in suspects]
    unique = sorted({w for x in suspects for s in x for w in s})
    if not unique:
        return Model(np.zeros(DIMENSIONS), 0.0, np.array([0.0, 0.0, np.log(prior / (1 - prior))]))
    pos = _document_share([{w for s in x for w in s} for x in suspects])
    neg = _document_share(clean)
    odds = np.log((pos + 0.2) / (len(toxic) + 1)) - np.log((neg + 0.5) / (len(clean) + 1))
    odds = np.where(pos >= min(3, len(toxic)), np.maximum(odds, 0.0), 0.0)
    found = Counter(w for x in suspects for w in {w for s in x for w in s})
    # words that return in many toxic documents count for more
    scores = dict(zip(unique, weighted(unique, odds**2) * np.sqrt([found[w] for w in unique]), strict=True))
    pool = sorted(known_clean)
    negative = [pool[i] for i in np.sort(rng.permutation(len(pool))[:NEGATIVES])]
    weight, bias = np.zeros(DIMENSIONS), 0.0
    for k in range(rounds + 1):
        chosen: Counter[str] = Counter()
        for x in suspects:
            best = [max(s, key=lambda w: (scores[w], w)) for s in x]
            if not best:
                continue
            best.sort(key=lambda w: (-scores[w], w))
            chosen.update({best[0]} | ({w for w in best[1:] if scores[w] > 0.5} if k else set()))
        positive = sorted(chosen)
        frequent = sorted(positive, key=lambda w: (-chosen[w], w))
        half = LANDMARKS // 2
        landmarks = list(dict.fromkeys(frequent[: half // 2] + [frequent[i] for i in np.linspace(0, len(frequent) - 1, half).astype(int)] + negative[:: max(1, len(negative) // half)]))[: LANDMARKS + half // 2]
        strength = {w: float(np.sqrt(chosen[w])) for w in positive}
        for w in frequent[:AUGMENTED]:  # gapped forms of the words that are certain
            for at in range(1, len(w)):
                strength.setdefault(w[:at] + "x*.q"[at % 4] + w[at:], 0.3 * strength[w])
        weight, bias = _svm(list(strength), list(strength.values()), negative, landmarks)
        if k < rounds:
            scores = dict(zip(unique, weighted(unique, weight) + bias, strict=True))
            # the hardest clean words join the negatives
            hard = weighted(pool, weight)
            negative = sorted(set(negative[: NEGATIVES]) | {pool[i] for i in np.argsort(-hard, kind="stable")[:1500]})
    model = Model(weight, bias, np.zeros(3))
    everything = sorted(known_clean | {w for x in toxic for s in x for w in s})
    score = dict(zip(everything, model.words(everything).tolist(), strict=True))
    top = np.array([highest_words([score[w] for w in words]) for words in [set().union(*x) for x in toxic] + clean])
    return Model(weight, bias, _logistic(top, np.array([1.0] * len(toxic) + [0.0] * len(clean))))


def _logistic(top: np.ndarray, y: np.ndarray) -> np.ndarray:
    x = np.column_stack([top, np.ones(len(top))])
    # classes weigh the same, so that 0.5 is between them whatever the sample's shares
    cost = np.where(y == 1, 0.5 / max(1, y.sum()), 0.5 / max(1, (1 - y).sum())) * len(y)
    w = np.zeros(3)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        gradient = x.T @ (cost * (p - y)) + np.array([0.05, 0.05, 0.0]) * w
        curve = (x * (cost * np.maximum(p * (1 - p), 1e-6))[:, None]).T @ x + np.diag([0.05, 0.05, 1e-6])
        step = np.linalg.solve(curve, gradient)
        w = w - step * min(1.0, 5.0 / max(1e-9, np.abs(step).max()))
        if np.abs(step).max() < 1e-8:
            break
    return w


def _fit_sample(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    parts = list(batches)
    if parts:
        sample = pd.concat(parts)
        sample = sample.assign(text=sample["text"].fillna("")).sort_values(["doc_id", "text"]).drop_duplicates()
        model = fit(sample["text"].tolist(), sample["y"].tolist())
        del parts, sample
        give_back()
        yield pd.DataFrame({"weight": [model.weight.tobytes()], "bias": [model.bias], "scale": [model.scale.tolist()]})


def train(docs: DataFrame, labels: DataFrame, modulus: int = MODULUS, held_out: int = HELD_OUT, per_class: int = PER_CLASS) -> Model:
    """Fitted by one task on at most 2 * per_class texts; only the weights come to the driver."""
    small_batches(docs.sparkSession)
    sample = training_texts(docs, labels, "toxic", modulus, held_out, per_class)
    sample = sample.select(F.col("doc_id").cast("long"), F.col("text").cast("string"), F.col("y").cast("int")).repartition(1)
    found = sample.mapInPandas(_fit_sample, "weight binary, bias double, scale array<double>").collect()
    if not found:
        return fit([], [])
    return Model(np.frombuffer(found[0].weight, float), found[0].bias, np.array(found[0].scale))


def _scores(batches: Iterable[pa.RecordBatch], model: Model) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    known: dict[str, float] = {}
    for batch in batches_of(batches, 256):
        documents = [words_of(t or "") for t in batch.column("text").to_pylist()]
        if len(known) > CACHE_WORDS:
            known = {}
        if new := sorted(set().union(*documents).difference(known)):
            known.update(zip(new, model.words(new).tolist(), strict=True))
        yield batch, model.probability(np.array([highest_words([known[w] for w in words]) for words in documents]).reshape(-1, 2))
    known.clear()
    give_back()


def score(docs: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, text -> doc_id, score, predicted."""
    small_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)  # of fixed size: one weight per subsequence

    def scored(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, p in _scores(batches, shared.value):
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(p), pa.array((p >= threshold).astype(np.int32))], names=["doc_id", "score", "predicted"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(scored, "doc_id long, score double, predicted int")


def filtered(docs: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of docs that score below the threshold, with their columns as they are."""
    small_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def clean(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, p in _scores(batches, shared.value):
            kept = batch.filter(pa.array(p < threshold))
            yield pa.RecordBatch.from_arrays(kept.columns[:1], names=["row"])

    packed = docs.select(F.struct(*docs.columns).alias("row"), F.col("text").cast("string").alias("text"))
    return packed.mapInArrow(clean, packed.select("row").schema).select("row.*")


def op8_toxicity(spark, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    model = train(docs, read_table(spark, sf_dir, "labels"))
    return score(docs, model).select("doc_id", (fold_of(MODULUS) == HELD_OUT).alias("held_out"), "score", "predicted")
