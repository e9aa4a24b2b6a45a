"""Training of the convolutional link predictor by synchronous gradient rounds, and tables of its weights.

Each round broadcasts the weights, lets every task sum the gradient of its share of the round's triples, adds the sums
up in SLOTS groups and applies one Adam step on the driver, which holds the weights anyway.  Entity gradients
travel as the rows that occurred.  The triples of a round and their negative tails come from hashes, so a
repeated task gives the same sums.
"""

from __future__ import annotations

import pickle

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kgspark.operators.score import ConvScorer

SLOTS = 8
ROWS = ("entities", "relations")


def initial_weights(entities: int, relations: int, height: int, width: int, channels: int = 8, kernel: tuple[int, int] = (2, 2), seed: int = 42) -> dict[str, np.ndarray]:
    rng = np.random.default_rng(seed)
    dim = height * width
    flat = channels * (height - kernel[0] + 1) * (2 * width - kernel[1] + 1)

    def uniform(*shape: int, fan: int) -> np.ndarray:
        return rng.uniform(-1, 1, shape) * np.sqrt(6 / fan)

    w = {
        "entities": uniform(entities, dim, fan=entities + dim),
        "relations": uniform(relations, dim, fan=relations + dim),
        "conv": uniform(channels, 1, *kernel, fan=kernel[0] * kernel[1] * (1 + channels)),
        "conv_bias": np.zeros(channels),
        "fc": uniform(flat, dim, fan=flat + dim),
        "fc_bias": np.zeros(dim),
    }
    for name, size in (("bn0", 1), ("bn1", channels), ("bn2", dim)):
        w |= {f"{name}_scale": np.ones(size), f"{name}_shift": np.zeros(size)}
    return w


def gradient(scorer: ConvScorer, h: np.ndarray, r: np.ndarray, t: np.ndarray, label: np.ndarray) -> tuple[float, dict]:
    """(sum of losses, sums of gradients) of binary cross entropy; entities and relations as {row: gradient}."""
    w, n = scorer.w, len(h)
    raw = np.concatenate([w["entities"][h].reshape(n, scorer.height, scorer.width), w["relations"][r].reshape(n, scorer.height, scorer.width)], axis=2)
    image = raw * w["bn0_scale"] + w["bn0_shift"]
    kernel = w["conv"][:, 0]
    windows = np.lib.stride_tricks.sliding_window_view(image, kernel.shape[1:], axis=(1, 2))
    maps = np.einsum("nijkl,ckl->ncij", windows, kernel) + w["conv_bias"][None, :, None, None]
    mapped = maps * w["bn1_scale"][None, :, None, None] + w["bn1_shift"][None, :, None, None]
    flat = np.maximum(mapped, 0).reshape(n, -1)
    z = flat @ w["fc"] + w["fc_bias"]
    out = z * w["bn2_scale"] + w["bn2_shift"]
    y = np.maximum(out, 0)
    score = (y * w["entities"][t]).sum(axis=1)
    loss = float((np.maximum(score, 0) - label * score + np.log1p(np.exp(-np.abs(score)))).sum())

    d_score = 1 / (1 + np.exp(-score)) - label
    d_out = d_score[:, None] * w["entities"][t] * (out > 0)
    d_z = d_out * w["bn2_scale"]
    d_mapped = (d_z @ w["fc"].T).reshape(maps.shape) * (mapped > 0)
    d_maps = d_mapped * w["bn1_scale"][None, :, None, None]
    d_image = np.zeros_like(image)
    high, wide = maps.shape[2:]
    for k in range(kernel.shape[1]):
        for m in range(kernel.shape[2]):
            d_image[:, k : k + high, m : m + wide] += np.einsum("ncij,c->nij", d_maps, kernel[:, k, m])
    d_raw = d_image * w["bn0_scale"]
    g = {
        "bn0_scale": np.array([(d_image * raw).sum()]), "bn0_shift": np.array([d_image.sum()]),
        "conv": np.einsum("ncij,nijkl->ckl", d_maps, windows)[:, None], "conv_bias": d_maps.sum(axis=(0, 2, 3)),
        "bn1_scale": (d_mapped * maps).sum(axis=(0, 2, 3)), "bn1_shift": d_mapped.sum(axis=(0, 2, 3)),
        "fc": flat.T @ d_z, "fc_bias": d_z.sum(axis=0), "bn2_scale": (d_out * z).sum(axis=0), "bn2_shift": d_out.sum(axis=0),
    }

    def by_row(ids: np.ndarray, values: np.ndarray) -> dict[int, np.ndarray]:
        rows, of = np.unique(ids, return_inverse=True)
        sums = np.zeros((len(rows), values.shape[1]))
        np.add.at(sums, of, values)
        return dict(zip(rows.tolist(), sums))

    g["entities"] = by_row(np.r_[h, t], np.r_[d_raw[:, :, : scorer.width].reshape(n, -1), d_score[:, None] * y])
    g["relations"] = by_row(r, d_raw[:, :, scorer.width :].reshape(n, -1))
    return loss, g


def add(a: dict, b: dict) -> dict:
    """Sum of two gradients."""
    for name, v in b.items():
        if name in ROWS:
            for row, x in v.items():
                a[name][row] = a[name][row] + x if row in a[name] else x
        else:
            a[name] = a[name] + v
    return a


class Adam:
    def __init__(self, weights: dict[str, np.ndarray], rate: float = 0.01):
        self.w, self.rate, self.n = weights, rate, 0
        self.m = {k: np.zeros_like(v) for k, v in weights.items()}
        self.v = {k: np.zeros_like(v) for k, v in weights.items()}

    def step(self, g: dict, count: int) -> None:
        self.n += 1
        for name, w in self.w.items():
            if name in ROWS:
                at = np.array(list(g[name]), dtype=np.int64)
                d = np.array(list(g[name].values())) / count
            else:
                at, d = slice(None), g[name] / count
            self.m[name][at] = 0.9 * self.m[name][at] + 0.1 * d
            self.v[name][at] = 0.999 * self.v[name][at] + 0.001 * d * d
            w[at] -= self.rate * (self.m[name][at] / (1 - 0.9**self.n)) / (np.sqrt(self.v[name][at] / (1 - 0.999**self.n)) + 1e-8)


def train(triples: DataFrame, weights: dict[str, np.ndarray], height: int, width: int, epochs: int = 5, rounds: int = 4, negatives: int = 2, rate: float = 0.01, seed: int = 42, smoothing: float = 0.1, adam: Adam | None = None, first_epoch: int = 0) -> tuple[dict[str, np.ndarray], list[float]]:
    """Weights after `epochs` passes over triples (h, r, t), each in `rounds` steps, and the mean loss of each epoch.  With adam, and
    the number of epochs so far, training goes on where it was."""
    spark = triples.sparkSession
    entities = len(weights["entities"])
    adam = adam or Adam(weights, rate)
    false = [F.pmod(F.xxhash64("h", "r", "t", F.lit(seed), F.lit(j)), F.lit(entities)).alias("x") for j in range(negatives)]
    labelled = triples.select("h", "r", "t", F.xxhash64("h", "r", "t", F.lit(seed)).alias("__h"), F.array("t", *false).alias("tails")).persist()
    losses = []
    for epoch in range(first_epoch, first_epoch + epochs):
        total, seen = 0.0, 0
        for step in range(rounds):
            sent = spark.sparkContext.broadcast(ConvScorer({k: v.copy() for k, v in weights.items()}, height, width))

            def share(parts, sent=sent):
                loss, g, n = 0.0, None, 0
                for p in parts:
                    if not len(p):
                        continue
                    tails = np.stack(p["tails"].to_numpy())
                    label = np.zeros(tails.shape)
                    label[:, 0] = 1
                    label = label * (1 - smoothing) + smoothing / 2
                    h, r = (np.repeat(p[c].to_numpy(), tails.shape[1]) for c in "hr")
                    part, d = gradient(sent.value, h, r, tails.ravel(), label.ravel())
                    loss, n, g = loss + part, n + len(h), d if g is None else add(g, d)
                if g is not None:
                    yield pd.DataFrame({"slot": [n % SLOTS], "n": [n], "loss": [loss], "g": [pickle.dumps(g)]})

            def merge(pdf: pd.DataFrame) -> pd.DataFrame:
                g = None
                for blob in pdf["g"]:
                    g = pickle.loads(blob) if g is None else add(g, pickle.loads(blob))
                return pd.DataFrame({"slot": [pdf["slot"].iloc[0]], "n": [pdf["n"].sum()], "loss": [pdf["loss"].sum()], "g": [pickle.dumps(g)]})

            schema = "slot int, n long, loss double, g binary"
            now = labelled.filter(F.pmod(F.col("__h") + epoch, F.lit(rounds)) == step).select("h", "r", "tails")
            rows = now.mapInPandas(share, schema).groupBy("slot").applyInPandas(merge, schema).collect()
            sent.unpersist()
            if rows:
                g = None
                for row in rows:
                    g = pickle.loads(row["g"]) if g is None else add(g, pickle.loads(row["g"]))
                n = sum(row["n"] for row in rows)
                adam.step(g, n)
                total, seen = total + sum(row["loss"] for row in rows), seen + n
        losses.append(total / max(seen, 1))
    labelled.unpersist()
    return weights, losses


def weights_table(spark: SparkSession, weights: dict[str, np.ndarray], names: dict[str, str] | None = None) -> DataFrame:
    """name, shape, values: a checkpoint as a table; `names` renames tensors for another framework."""
    rows = [((names or {}).get(k, k), list(v.shape), v.ravel().astype(float).tolist()) for k, v in weights.items()]
    return spark.createDataFrame(rows, "name string, shape array<int>, values array<double>")


def weights_of(table: DataFrame, names: dict[str, str] | None = None) -> dict[str, np.ndarray]:
    """A checkpoint read back; sizes are checked against shapes."""
    out = {}
    for r in table.collect():
        values = np.array(r["values"])
        if values.size != int(np.prod(r["shape"])):
            raise ValueError(f"{r['name']}: {values.size} values for shape {r['shape']}")
        out[(names or {}).get(r["name"], r["name"])] = values.reshape(r["shape"])
    return out
