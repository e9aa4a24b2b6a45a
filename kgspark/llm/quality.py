"""Quality scores from supervised subword embeddings.

Method: every word, every pair of neighbouring words (all pairs of a word with itself are one, a feature made by hand for
one kind of junk) and every run of 3 or 4 code points of a word (with its ends marked) has a learned vector, found by
hash.  A document is the mean of its vectors; a softmax
layer gives the probability of label 1.  Trained by numpy stochastic gradient descent.  Since a mean and
a softmax layer for two labels are linear up to the last step, the trained model is folded into one
number for each hash before it is sent to executors (FEATURES floats: 1 MB, whatever the input).

Labels are learnt from at most `max_rows` documents (chosen by hash of doc_id) among those that
held_out() leaves, none of them longer than LONGEST bytes; so what reaches the driver is bounded.  The features are
the text alone.

Cases: null, empty or blank text: the score of the bias alone.  Null doc_id: scored, never learnt from.  Rows without a
label, or with a null one, are scored only.  No usable label at all: 0.5 for every text.  Repeated labels: each counts.
Repeated rows: a row each.  Ties: a score equal to the threshold is predicted 1.  Empty table: no rows.  Very long
texts: whole, in one chunk.  Columns but doc_id and text, whatever their names, are not read.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kgspark.llm.common import MIX, ODD, arrow_rows, chunks, code_points, documents, give_back, hash_words, held_out, mix, sums_by, texts_of, words_of

FEATURES = 1 << 18
DIMENSIONS = 8
RUNS = (3, 4)
MAX_ROWS = 4000
#: Bytes of the longest text that is learnt from.
LONGEST = 1 << 17
#: The feature that all pairs of one word with itself share.
REPEAT = 0
THRESHOLD = 0.3


def fold(h: np.ndarray) -> np.ndarray:
    return (h & np.uint64(FEATURES - 1)).astype(np.int64)


def subwords(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Feature numbers of each word (itself and its runs) as (word's number, feature)."""
    codes, starts = code_points([f"<{w}>" for w in words])
    owner = np.repeat(np.arange(len(words)), np.diff(starts))
    left = np.repeat(starts[1:], np.diff(starts)) - np.arange(len(codes))
    owners, features = [np.arange(len(words))], [fold(hash_words(words))]
    for n in RUNS:
        at = np.flatnonzero(left >= n)
        h = np.full(len(at), n, dtype=np.uint64)
        for k in range(n):
            h = (h ^ codes[at + k]) * ODD
            h ^= h >> np.uint64(29)
        owners.append(owner[at])
        features.append(fold(mix(h)))
    return np.concatenate(owners), np.concatenate(features)


@dataclass
class Text:
    """A chunk of texts: distinct words, the word and the row of each place, pairs of neighbours."""

    words: list[str]
    word: np.ndarray
    row: np.ndarray
    pair: np.ndarray
    pair_row: np.ndarray
    rows: int

    @classmethod
    def of(cls, texts: pa.Array) -> Text:
        flat, row = words_of(texts)
        coded = flat.dictionary_encode()
        words = coded.dictionary.to_pylist()
        word = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        h = hash_words(words)[word] if words else np.zeros(0, dtype=np.uint64)
        same = row[:-1] == row[1:]
        pair = np.where(word[:-1] == word[1:], REPEAT, fold(mix(h[:-1] * MIX[0] + h[1:])))[same]
        return cls(words, word, row, pair, row[:-1][same], len(texts))


@dataclass
class Model:
    weights: np.ndarray  #: one number for each feature
    bias: float

    def score(self, texts: pa.Array) -> np.ndarray:
        t = Text.of(texts)
        if not t.words:
            return np.full(t.rows, 1 / (1 + np.exp(-self.bias)))
        owner, feature = subwords(t.words)
        sums, sizes = sums_by(owner, self.weights[feature], len(t.words)), np.bincount(owner, minlength=len(t.words))
        total = sums_by(t.row, sums[t.word], t.rows) + sums_by(t.pair_row, self.weights[t.pair], t.rows)
        count = sums_by(t.row, sizes[t.word], t.rows) + sums_by(t.pair_row, np.ones(len(t.pair)), t.rows)
        return 1 / (1 + np.exp(-np.clip(self.bias + total / np.maximum(count, 1), -30, 30)))


def counted(texts: list[str]) -> list[tuple[np.ndarray, np.ndarray]]:
    """(distinct features, how often each occurs) of every text."""
    out = []
    for at in range(0, len(texts), 64):
        t = Text.of(pa.array(texts[at : at + 64], pa.large_string()))
        keys = [t.pair_row * FEATURES + t.pair]
        if t.words:
            owner, feature = subwords(t.words)
            feature = feature[np.argsort(owner, kind="stable")]
            sizes = np.bincount(owner, minlength=len(t.words))
            first = np.cumsum(sizes) - sizes
            each = sizes[t.word]
            place = np.arange(each.sum()) - np.repeat(np.cumsum(each) - each, each)
            keys.append(np.repeat(t.row, each) * FEATURES + feature[np.repeat(first[t.word], each) + place])
        found, n = np.unique(np.concatenate(keys), return_counts=True)
        cuts = np.searchsorted(found, np.arange(1, t.rows) * FEATURES)
        # what is kept for all epochs: two arrays of 32 bits for each 64 texts, and views of them
        out += list(zip(np.split((found % FEATURES).astype(np.int32), cuts), np.split(n.astype(np.int32), cuts)))
    return out


def train(texts: list[str], labels: list[int], epochs: int = 6, least_steps: int = 500, batch: int = 32, rate: float = 20.0, seed: int = 7) -> Model:
    """Stochastic gradient descent on the cross entropy; the rate falls to 0 in proportion.  Small samples get
    more epochs, up to least_steps batches."""
    y = np.asarray(labels, dtype=np.float64)
    epochs = max(epochs, -(-least_steps * batch // max(len(y), batch)))
    if not len(y):
        return Model(np.zeros(FEATURES, dtype=np.float32), 0.0)
    rng = np.random.default_rng(seed)
    vectors = rng.uniform(-1 / DIMENSIONS, 1 / DIMENSIONS, (FEATURES, DIMENSIONS))
    layer, bias = rng.normal(0, 0.1, (DIMENSIONS, 2)), np.log(np.array([(y == 0).sum() + 1.0, (y == 1).sum() + 1.0]) / (len(y) + 2))
    one_hot = np.eye(2)[y.astype(int)]
    documents = counted(texts)
    steps, step = epochs * -(-len(y) // batch), 0
    for _ in range(epochs):
        order = rng.permutation(len(y))
        for at in range(0, len(y), batch):
            rows = order[at : at + batch]
            sizes = [len(documents[i][0]) for i in rows]
            if not sum(sizes):
                continue
            row = np.repeat(np.arange(len(rows)), sizes)
            used, own = np.unique(np.concatenate([documents[i][0] for i in rows]), return_inverse=True)
            times = np.concatenate([documents[i][1] for i in rows]).astype(np.float64)
            share = times / np.maximum(sums_by(row, times, len(rows)), 1)[row]
            v = vectors[used]
            mean = np.stack([sums_by(row, v[own, d] * share, len(rows)) for d in range(DIMENSIONS)], axis=1)
            z = mean @ layer + bias
            p = np.exp(z - z.max(axis=1, keepdims=True))
            p /= p.sum(axis=1, keepdims=True)
            error = (p - one_hot[rows]) / len(rows)
            now = rate * (1 - step / steps)
            back = error @ layer.T
            grad = np.stack([sums_by(own, back[row, d] * share, len(used)) for d in range(DIMENSIONS)], axis=1)
            layer -= now * 0.1 * mean.T @ error
            bias -= now * 0.01 * error.sum(axis=0)
            vectors[used] = v - now * grad
            step += 1
    return Model((vectors @ (layer[:, 1] - layer[:, 0])).astype(np.float32), float(bias[1] - bias[0]))


def chosen_rows(docs: DataFrame, labels: DataFrame, label: str, max_rows: int) -> DataFrame:
    """text and __y of at most max_rows labelled documents that are not held out and are no longer than LONGEST bytes.  Labels
    are chosen first, by hash of doc_id, so only texts of chosen ids travel; of rows that repeat an id no more than max_rows in all stay."""
    ids = (
        labels.select(F.col("doc_id").cast("long"), F.col(label).cast("int").alias("__y"))
        .filter(F.col("__y").isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
        .orderBy(F.xxhash64("doc_id"), "doc_id", "__y")
        .limit(max_rows)
        .collect()
    )
    known = docs.sparkSession.createDataFrame([tuple(r) for r in ids], "doc_id long, __y int")
    rows = docs.select(F.col("doc_id").cast("long"), F.coalesce("text", F.lit("")).alias("text")).filter(F.octet_length("text") <= LONGEST)
    # at most max_rows ids are broadcast
    return rows.join(F.broadcast(known), "doc_id").orderBy(F.xxhash64("doc_id"), "doc_id", "__y", F.xxhash64("text")).limit(max_rows).select("text", "__y")


def labelled(docs: DataFrame, labels: DataFrame, label: str, max_rows: int) -> tuple[list[str], list[int]]:
    """The texts and labels of chosen_rows() on the driver."""
    found = chosen_rows(docs, labels, label, max_rows).toArrow()
    return found.column("text").to_pylist(), found.column("__y").to_pylist()


def fit(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_ROWS) -> Model:
    model = train(*labelled(docs, labels, "quality", max_rows))
    give_back()
    return model


SCHEMA = pa.schema([("doc_id", pa.int64()), ("score", pa.float64())])


def scored(docs: DataFrame, model) -> DataFrame:
    """doc_id and score of every document: one pass, no shuffle."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        for batch in batches:
            for part in chunks(batch, "text"):
                yield arrow_rows(SCHEMA, doc_id=part.column("doc_id"), score=sent.value.score(texts_of(part)))

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, score double")


def decided(scores: DataFrame, threshold: float) -> DataFrame:
    return scores.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def op5_quality_classifier(spark, sf_dir):
    docs = documents(spark, sf_dir)
    return decided(scored(docs, fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))), THRESHOLD)
