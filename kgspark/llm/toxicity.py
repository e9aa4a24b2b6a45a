"""Toxicity scores from an FTRL-proximal logistic regression over hashed word n-grams and skip-grams.

Method: a document has a feature for each distinct word, pair of neighbours and pair of words with one
between (lower case, without the marks around words).  Weights are learnt one document at a time by
FTRL-proximal: each feature has its own rate, which falls with its gradients so far, and an L1 term that
keeps weights at 0 until the evidence exceeds it.  What is sent to executors is the list of non-zero
weights (bounded by the training sample, not by the input).

Labels are learnt from at most `max_rows` documents among those that held_out() leaves, none of them longer than
quality.LONGEST bytes; the features are the text alone.

Cases: null, empty or blank text: the score of the bias.  Null doc_id: scored, never learnt from.  No usable label: 0.5
for every text.  Rows without a label are scored only.  Repeated labels: each counts.  Repeated rows: a row each.  Ties: a
score equal to the threshold is predicted 1.  Empty table: no rows.  Very long texts: whole.  Columns but doc_id and
text, whatever their names, are not read.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

from kgspark.llm.common import MIX, documents, hash_words, mix, sums_by, words_of
from kgspark.llm.quality import decided, labelled, scored

FEATURES = 1 << 20
MAX_ROWS = 12000
THRESHOLD = 0.5
MARKS = re.compile(r"^[\W_]+|[\W_]+$")


def features(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(row, feature) of every place; repeats are still there."""
    flat, row = words_of(texts)
    coded = flat.dictionary_encode()
    words = [MARKS.sub("", w).lower() or w for w in coded.dictionary.to_pylist()]
    if not words:
        return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
    h = hash_words(words)[coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)]
    rows, found = [row], [h]
    for gap in (1, 2):
        same = row[:-gap] == row[gap:]
        rows.append(row[:-gap][same])
        found.append(mix(h[:-gap][same] * MIX[gap - 1] + h[gap:][same] + np.uint64(gap)))
    return np.concatenate(rows), (np.concatenate(found) & np.uint64(FEATURES - 1)).astype(np.int64)


@dataclass
class Model:
    feature: np.ndarray
    weight: np.ndarray
    bias: float

    def __post_init__(self):
        self._dense = None

    def __getstate__(self):
        return {"feature": self.feature, "weight": self.weight, "bias": self.bias, "_dense": None}

    def score(self, texts: pa.Array) -> np.ndarray:
        if self._dense is None:
            self._dense = np.zeros(FEATURES, dtype=np.float32)
            self._dense[self.feature] = self.weight
        row, feature = features(texts)
        hit = self._dense[feature] != 0
        pairs = np.unique(row[hit] * FEATURES + feature[hit])
        z = self.bias + sums_by(pairs // FEATURES, self._dense[pairs % FEATURES], len(texts))
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def train(texts: list[str], labels: list[int], epochs: int = 10, alpha: float = 2.0, beta: float = 1.0, l1: float = 8.0, l2: float = 0.1, positive: float = 4.0, seed: int = 7) -> Model:
    """positive: how many times a toxic document counts, as there are far fewer of them."""
    if not len(labels):
        return Model(np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.float32), 0.0)
    z, n = np.zeros(FEATURES + 1), np.zeros(FEATURES + 1)
    docs = []
    for at in range(0, len(texts), 256):
        row, feature = features(pa.array(texts[at : at + 256], pa.large_string()))
        pairs = np.unique(row * FEATURES + feature)
        cuts = np.searchsorted(pairs, np.arange(1, len(texts[at : at + 256])) * FEATURES)
        docs += [np.append(p % FEATURES, FEATURES) for p in np.split(pairs, cuts)]  # the last is the bias

    def weights(zi, ni, penalty):
        return np.where(np.abs(zi) <= penalty, 0.0, -(zi - np.sign(zi) * penalty) / ((beta + np.sqrt(ni)) / alpha + l2))

    rng = np.random.default_rng(seed)
    for _ in range(epochs):
        for i in rng.permutation(len(docs)):
            x = docs[i]
            penalty = np.full(len(x), l1)
            penalty[-1] = 0.0
            w = weights(z[x], n[x], penalty)
            g = (1 / (1 + np.exp(-np.clip(w.sum(), -30, 30))) - labels[i]) * (positive if labels[i] else 1.0)
            sigma = (np.sqrt(n[x] + g * g) - np.sqrt(n[x])) / alpha
            z[x] += g - sigma * w
            n[x] += g * g
    w = weights(z, n, np.append(np.full(FEATURES, l1), 0.0))
    kept = np.flatnonzero(w[:-1])
    return Model(kept, w[kept].astype(np.float32), float(w[-1]))


def fit(docs, labels, max_rows: int = MAX_ROWS) -> Model:
    return train(*labelled(docs, labels, "toxic", max_rows))


def op6_toxicity(spark, sf_dir):
    docs = documents(spark, sf_dir)
    return decided(scored(docs, fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))), THRESHOLD)
