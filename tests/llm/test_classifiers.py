import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from kgspark.llm import quality, toxicity
from pyspark.sql import functions as F

SF = "/root/testdata/sf0.01"


def area(y, s):
    order = np.argsort(s)
    ranks = np.empty(len(s))
    ranks[order] = np.arange(1, len(s) + 1)
    p = np.asarray(y) == 1
    return (ranks[p].sum() - p.sum() * (p.sum() + 1) / 2) / (p.sum() * (~p).sum())


@pytest.mark.parametrize(("module", "query", "label", "least"), [(quality, "op5_quality_classifier", "quality", 0.9), (toxicity, "op6_toxicity", "toxic", 0.75)])
def test_held_out_accuracy(spark, module, query, label, least):
    out = getattr(module, query)(spark, SF)
    rows = out.join(spark.read.parquet(f"{SF}/labels.parquet"), "doc_id").filter("held_out").select("score", label).collect()
    assert len(rows) > 30 and area([r[1] for r in rows], np.array([r[0] for r in rows])) > least
    first = out.first()
    assert first["held_out"] == (zlib.crc32(str(first["doc_id"]).encode()) % 5 == 0)


@pytest.mark.parametrize(("module", "label"), [(quality, "quality"), (toxicity, "toxic")])
def test_held_out_labels_are_not_read(spark, module, label):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    held = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0
    turned = labels.withColumn(label, F.when(held, 1 - F.col(label)).otherwise(F.col(label)).cast("int"))
    a, b = module.fit(docs, labels, 60), module.fit(docs, turned, 60)
    texts = pa.array(["some text", "idiot stupid", ""], pa.large_string())
    assert (a.score(texts) == b.score(texts)).all()


@pytest.mark.parametrize(("module", "label"), [(quality, "quality"), (toxicity, "toxic")])
def test_odd_rows(spark, odd, none, module, label):
    labels = spark.createDataFrame([(1, 1), (2, 0), (3, None), (None, 1), (200, 1), (400, 0), (500, 1), (500, 0), (99999, 1)], f"doc_id long, {label} int")
    out = quality.decided(quality.scored(odd, module.fit(odd, labels)), 0.5).collect()
    assert len(out) == odd.count() and all(0 <= r["score"] <= 1 for r in out)
    assert all(r["predicted"] == (r["score"] >= 0.5) for r in out)
    empty = labels.limit(0)
    assert {r["score"] for r in quality.scored(odd, module.fit(odd, empty)).collect()} == {0.5}
    assert quality.scored(none, module.fit(none, labels)).collect() == []


def test_ftrl_finds_the_words_and_is_sparse():
    rng = np.random.default_rng(0)
    texts = [" ".join(rng.choice(["the", "of", "and", "on", "in"], 30)) for _ in range(600)]
    labels = (rng.random(600) < 0.3).astype(int).tolist()
    texts = [t + " Idiot, " if y else t for t, y in zip(texts, labels)]
    model = toxicity.train(texts, labels)
    s = model.score(pa.array(["the of and idiot", "the of and on"], pa.large_string()))
    assert s[0] > 0.5 > s[1] and len(model.feature) < 500


def test_features_are_counted():
    """Distinct features of each text with their numbers, against one word and one run after another."""
    texts = ["ab Ab cde ab ab", "", "x", "cde ab"]
    for text, (feature, n) in zip(texts, quality.counted(texts)):
        words, want = text.split(), {}
        for w in words:
            marked = f"<{w}>"
            found = [quality.fold(quality.hash_words([w]))[0]]
            for size in quality.RUNS:
                for at in range(len(marked) - size + 1):
                    h = np.array([size], dtype=np.uint64)
                    for c in marked[at : at + size]:
                        h = (h ^ np.uint64(ord(c))) * quality.ODD
                        h ^= h >> np.uint64(29)
                    found.append(quality.fold(quality.mix(h))[0])
            for f in found:
                want[int(f)] = want.get(int(f), 0) + 1
        for a, b in zip(words, words[1:]):
            ha, hb = quality.hash_words([a]), quality.hash_words([b])
            f = quality.REPEAT if a == b else int(quality.fold(quality.mix(ha * quality.MIX[0] + hb))[0])
            want[f] = want.get(f, 0) + 1
        assert dict(zip(feature.tolist(), n.tolist())) == want


def plain_quality(model, text):
    """The score of one text, feature by feature."""
    ((feature, n),) = quality.counted([text])
    z = model.bias + (float((model.weights[feature].astype(float) * n).sum()) / n.sum() if len(n) else 0.0)
    return 1 / (1 + np.exp(-z))


def plain_toxicity(model, text):
    """The score of one text from the set of its words, pairs and pairs over a gap."""
    words = [toxicity.MARKS.sub("", w).lower() or w for w in re.findall(r"[^\x20\x09-\x0D]+", text)]
    weight = dict(zip(model.feature.tolist(), model.weight.tolist()))
    h = [toxicity.hash_words([w]) for w in words]
    found = {int(x[0]) for x in h}
    for gap in (1, 2):
        found |= {int(toxicity.mix(a * toxicity.MIX[gap - 1] + b + np.uint64(gap))[0]) for a, b in zip(h, h[gap:])}
    features = {f & (toxicity.FEATURES - 1) for f in found}
    return 1 / (1 + np.exp(-np.clip(model.bias + sum(weight.get(f, 0.0) for f in features), -30, 30)))


@pytest.mark.parametrize(("module", "query", "plain"), [(quality, "op5_quality_classifier", plain_quality), (toxicity, "op6_toxicity", plain_toxicity)])
def test_query_against_brute_force(spark, module, query, plain):
    """Every score of the query recomputed, text by text, from the trained weights."""
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    model = module.fit(docs, spark.read.parquet(f"{sf}/labels.parquet"))
    texts = {r["doc_id"]: r["text"] or "" for r in docs.select("doc_id", "text").collect()}
    rows = getattr(module, query)(spark, sf).collect()
    assert {r["doc_id"] for r in rows} == set(texts)
    for r in rows:
        assert abs(r["score"] - plain(model, texts[r["doc_id"]])) < 1e-5
        assert r["predicted"] == (r["score"] >= module.THRESHOLD) and r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0)


@pytest.mark.parametrize("label", ["quality", "toxic"])
def test_long_and_repeated_documents_are_bounded(spark, monkeypatch, label):
    """What leaves the executors: rows of labelled ids that aren't held out, no text longer than the limit (long ones have the lowest
    ids here), no more rows than the bound though ids repeat."""
    monkeypatch.setattr(quality, "LONGEST", 50)
    ids = [i for i in range(60) if zlib.crc32(str(i).encode()) % 5]
    held = [i for i in range(60) if zlib.crc32(str(i).encode()) % 5 == 0]
    rows = [(i, "w" * (51 + i)) for i in ids[:15]] + [(i, f"some words {i}") for i in ids[15:] for _ in range(20)] + [(i, "held out") for i in held] + [(ids[15], None), (None, "no id")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(60)] + [(ids[20], None), (None, 1)], f"doc_id long, {label} int")
    gathered = quality.chosen_rows(docs, labels, label, 30).collect()
    assert len(gathered) == 30 and all(len(r["text"].encode()) <= 50 for r in gathered)
    assert all(r["text"] == "" or r["text"] == f"some words {r['text'].split()[-1]}" and int(r["text"].split()[-1]) % 2 == r["__y"] for r in gathered)
    every = quality.chosen_rows(docs, labels, label, 10_000).collect()
    assert len(every) == 20 * len(ids[15:]) + 1 and not any(r["text"].startswith("held") for r in every)
    texts, y = quality.labelled(docs, labels, label, 30)
    assert list(zip(texts, y)) == [tuple(r) for r in gathered]
    assert quality.labelled(docs, labels.limit(0), label, 30) == ([], [])


def test_folded_model_equals_the_mean_of_vectors():
    model = quality.Model(np.random.default_rng(1).normal(size=quality.FEATURES).astype(np.float32), 0.3)
    text = "ab Ab cde ab"
    words = text.split()
    owner, feature = quality.subwords(words)
    t = quality.Text.of(pa.array([text], pa.large_string()))
    values = np.concatenate([model.weights[feature], model.weights[t.pair]])
    assert np.isclose(model.score(pa.array([text], pa.large_string()))[0], 1 / (1 + np.exp(-(0.3 + values.astype(float).mean()))))
