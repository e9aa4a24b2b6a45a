import numpy as np
import pytest
from kgspark.operators import checkpoints, training
from kgspark.operators.score import ConvScorer


def test_gradient_by_differences():
    w = training.initial_weights(7, 3, 2, 3, channels=2, seed=1)
    for k in w:
        w[k] = w[k] + np.random.default_rng(2).normal(0, 0.3, w[k].shape)
    h, r, t, y = np.array([0, 1, 1]), np.array([0, 2, 1]), np.array([3, 4, 0]), np.array([1.0, 0.0, 0.9])
    scorer = ConvScorer(w, 2, 3)
    _, g = training.gradient(scorer, h, r, t, y)
    step = 1e-6
    for name in w:
        for at in list(np.ndindex(w[name].shape))[:12]:
            old = w[name][at]
            w[name][at] = old + step
            up = training.gradient(scorer, h, r, t, y)[0]
            w[name][at] = old - step
            down = training.gradient(scorer, h, r, t, y)[0]
            w[name][at] = old
            got = g[name].get(at[0], np.zeros(w[name].shape[1]))[at[1]] if name in training.ROWS else g[name][at]
            assert got == pytest.approx((up - down) / (2 * step), abs=1e-4), (name, at)


def test_training_lowers_the_loss_and_checkpoints_return(spark, tmp_path):
    rng = np.random.default_rng(0)
    rows = [(int(a), int(a % 2), int((a + 1) % 20)) for a in rng.integers(0, 20, 120)]
    df = spark.createDataFrame(rows, "h long, r long, t long").repartition(3)
    w, losses = training.train(df, training.initial_weights(20, 2, 2, 4), 2, 4, epochs=4, rounds=2, rate=0.03)
    assert losses[-1] < losses[0] - 0.02
    renamed = {"conv": "conv2d.weight"}
    training.weights_table(spark, w, renamed).write.parquet(str(tmp_path / "w"))
    back = training.weights_of(spark.read.parquet(str(tmp_path / "w")), {v: k for k, v in renamed.items()})
    assert back.keys() == w.keys() and all(np.allclose(back[k], w[k]) for k in w)


def links(spark):
    rng = np.random.default_rng(0)
    rows = [(int(a), int(a % 2), int((a + 1) % 20)) for a in rng.integers(0, 20, 90)]
    return spark.createDataFrame(rows, "h long, r long, t long").repartition(2)


def test_stopped_and_resumed_training_equals_an_unbroken_one(spark, tmp_path):
    df, options = links(spark), {"rounds": 2, "rate": 0.03, "every": 2, "block_rows": 7}
    start = lambda: training.initial_weights(20, 2, 2, 4)
    whole = checkpoints.train_versions(df, start(), 2, 4, str(tmp_path / "whole"), 4, **options)
    path = str(tmp_path / "cut")
    checkpoints.train_versions(df, start(), 2, 4, path, 2, **options)
    resumed = checkpoints.train_versions(df, {k: v * 0 for k, v in start().items()}, 2, 4, path, 4, **options)
    assert resumed.keys() == whole.keys() and all(np.allclose(resumed[k], whole[k], atol=1e-8) for k in whole)
    assert [r["epoch"] for r in checkpoints.versions(spark, path).orderBy("epoch").collect()] == [2, 4]
    saved = checkpoints.tensors_of(checkpoints.blocks_of(spark, path, checkpoints.last_version(spark, path)["folder"]))
    assert all(np.allclose(saved["weight"][k], resumed[k]) for k in resumed)


def test_best_version_and_its_architecture(spark, tmp_path):
    path, values = str(tmp_path / "best"), iter([0.1, 0.4, 0.3, 0.4])
    checkpoints.train_versions(links(spark), training.initial_weights(20, 2, 2, 4), 2, 4, path, 4, every=10, metric=lambda *_: next(values), rounds=1)
    rows = checkpoints.versions(spark, path).orderBy("epoch").collect()
    assert [(r["epoch"], r["metric"]) for r in rows] == [(1, 0.1), (2, 0.4), (4, 0.4)]
    best = checkpoints.best_version(spark, path)
    assert best["epoch"] == 2 and checkpoints.best_version(spark, str(tmp_path / "none")) is None
    found = checkpoints.architecture_of(checkpoints.blocks_of(spark, path, best["folder"]))
    assert (found.entities, found.relations, found.dimension, found.height, found.width) == (20, 2, 8, 2, 4)
    with pytest.raises(ValueError):
        checkpoints.architecture({"entities": (5, 8), "relations": (2, 8), "conv": (2, 1, 2, 2), "fc": (7, 8)})
    cut = checkpoints.blocks_table(spark, {"weight": {"a": np.zeros((10, 2))}}, 4).filter("first <> 4")
    with pytest.raises(ValueError):
        checkpoints.tensors_of(cut)


def test_reciprocal_rank_of_the_model(spark):
    w = training.initial_weights(9, 2, 2, 3, channels=2, seed=3)
    scorer = ConvScorer(w, 2, 3)
    rows = [(0, 0, 1), (0, 0, 2), (3, 1, 4), (5, 1, 5)]
    want = 0.0
    for h, r, t in rows:
        line = scorer.score(np.full(9, h), np.full(9, r), np.arange(9)).round(6)
        out = {x[2] for x in rows if x[:2] == (h, r)}
        want += 1 / (1 + sum(line[e] > line[t] for e in range(9) if e not in out))
    metric = checkpoints.reciprocal_rank(spark.createDataFrame(rows, "h long, r long, t long"))
    assert metric(w, 2, 3) == pytest.approx(want / 4, abs=1e-9)
