"""Gradients of a convolutional link predictor's loss for each single triple, over chosen layers.

The forward and backward passes of a batch run in Arrow batches; entity vectors come by join and go nowhere whole, relations and layers are
broadcast.  A row keeps its gradient in the form that inner products need (operators/influence.py): the small layers one after
another (`dense`), the linear layer as the two factors of its outer product (x, delta), embeddings as the rows that the triple touches.
sketched() gives the same inner products in expectation from a fixed number of values a row, whatever the layers.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kgspark.operators.blocks import matrix
from kgspark.operators.score import ConvScorer

#: Layers in the order of the forward pass.
LAYERS = ("entities", "relations", "bn0_scale", "bn0_shift", "conv", "conv_bias", "bn1_scale", "bn1_shift", "fc", "fc_bias", "bn2_scale", "bn2_shift")
EMBEDDINGS = ("entities", "relations")
LINEAR = ("fc", "fc_bias")


def last_layers(n: int = 2) -> tuple[str, ...]:
    """The linear layer's two, and, for n > 2, the n - 2 before them, embeddings left out."""
    first = LAYERS.index("fc")
    return tuple(x for x in LAYERS[max(0, first - max(n - len(LINEAR), 0)) : first] if x not in EMBEDDINGS) + LINEAR


def row_gradients(scorer: ConvScorer, head: np.ndarray, relation: np.ndarray, tail: np.ndarray, label: np.ndarray | float = 1.0) -> dict[str, np.ndarray]:
    """Gradients of the cross entropy of every row (vectors of head, relation and tail), a row each: by layer, of the linear layer
    the factors x (rows x inputs) and delta (rows x outputs), of the embeddings head, relation and tail."""
    w, n = scorer.w, len(head)
    kernel = w["conv"][:, 0]
    image = np.concatenate([head.reshape(n, scorer.height, scorer.width), relation.reshape(n, scorer.height, scorer.width)], axis=2)
    scaled = image * w["bn0_scale"] + w["bn0_shift"]
    windows = np.lib.stride_tricks.sliding_window_view(scaled, kernel.shape[1:], axis=(1, 2))
    maps = np.einsum("nijkl,ckl->ncij", windows, kernel) + w["conv_bias"][None, :, None, None]
    normed = maps * w["bn1_scale"][None, :, None, None] + w["bn1_shift"][None, :, None, None]
    x = np.maximum(normed, 0).reshape(n, -1)
    linear = x @ w["fc"] + w["fc_bias"]
    out = linear * w["bn2_scale"] + w["bn2_shift"]
    ramp = np.maximum(out, 0)
    score = (ramp * tail).sum(axis=1)
    error = 1 / (1 + np.exp(-score)) - label
    d_out = error[:, None] * tail * (out > 0)
    delta = d_out * w["bn2_scale"]
    d_normed = (delta @ w["fc"].T).reshape(normed.shape) * (normed > 0)
    d_maps = d_normed * w["bn1_scale"][None, :, None, None]
    d_scaled = np.zeros_like(scaled)
    for k, j in np.ndindex(*kernel.shape[1:]):
        d_scaled[:, k : k + maps.shape[2], j : j + maps.shape[3]] += np.einsum("ncij,c->nij", d_maps, kernel[:, k, j])
    d_image = d_scaled * w["bn0_scale"]
    return {
        "head": d_image[:, :, : scorer.width].reshape(n, -1),
        "relation": d_image[:, :, scorer.width :].reshape(n, -1),
        "tail": error[:, None] * ramp,
        "bn0_scale": (d_scaled * image).sum(axis=(1, 2))[:, None],
        "bn0_shift": d_scaled.sum(axis=(1, 2))[:, None],
        "conv": np.einsum("ncij,nijkl->nckl", d_maps, windows).reshape(n, -1),
        "conv_bias": d_maps.sum(axis=(2, 3)),
        "bn1_scale": (d_normed * maps).sum(axis=(2, 3)),
        "bn1_shift": d_normed.sum(axis=(2, 3)),
        "x": x,
        "delta": delta,
        "fc_bias": delta,
        "bn2_scale": d_out * linear,
        "bn2_shift": d_out,
    }


def columns_of(found: dict[str, np.ndarray], h: np.ndarray, r: np.ndarray, t: np.ndarray, layers: tuple[str, ...]) -> dict[str, np.ndarray]:
    """What best_influences() reads: dense, x and delta, h, t, r with grad_h, grad_t, grad_r, as far as the layers ask for it; and norm."""
    dense = [found[x] for x in LAYERS if x in layers and x not in (*EMBEDDINGS, "fc")]
    out = {"dense": np.concatenate(dense, axis=1)} if dense else {}
    norm2 = (out["dense"] ** 2).sum(axis=1) if dense else np.zeros(len(h))
    if "fc" in layers:
        out |= {"x": found["x"], "delta": found["delta"]}
        norm2 = norm2 + (found["x"] ** 2).sum(axis=1) * (found["delta"] ** 2).sum(axis=1)
    if "entities" in layers:
        out |= {"h": h, "grad_h": found["head"], "t": t, "grad_t": found["tail"]}
        both = np.where((h == t)[:, None], found["head"] + found["tail"], 0.0)
        apart = (found["head"] ** 2).sum(axis=1) + (found["tail"] ** 2).sum(axis=1)
        norm2 = norm2 + np.where(h == t, (both**2).sum(axis=1), apart)
    if "relations" in layers:
        out |= {"r": r, "grad_r": found["relation"]}
        norm2 = norm2 + (found["relation"] ** 2).sum(axis=1)
    return out | {"norm": np.sqrt(norm2)}


def with_vectors(triples: DataFrame, entities: DataFrame) -> DataFrame:
    """triples (id, h, r, t, ...) with the vectors of both ends."""
    side = lambda c, name: entities.select(F.col("id").alias(c), F.col("vector").alias(name))
    return triples.join(side("h", "__hv"), "h").join(side("t", "__tv"), "t")


def check(layers: tuple[str, ...]) -> None:
    if unknown := set(layers) - set(LAYERS):
        raise ValueError(f"no such layers: {sorted(unknown)}")
    if not layers:
        raise ValueError("no layer is chosen")


def made_in_parts(rows: pa.Table, scorer: ConvScorer, make, label: float) -> dict[str, np.ndarray]:
    """make(gradients of up to 1,000 rows, h, r, t) -> columns, over rows (h, r, t, __hv, __tv)."""
    made = []
    for at in range(0, max(len(rows), 1), 1000):
        part = rows.slice(at, 1000)
        h, r, t = (part[c].to_numpy() for c in "hrt")
        made.append(make(row_gradients(scorer, matrix(part["__hv"]), scorer.w["relations"][r], matrix(part["__tv"]), label), h, r, t))
    return {c: np.concatenate([x[c] for x in made]) for c in made[0]}


def arrow(column: np.ndarray) -> pa.Array:
    return pa.array(column) if column.ndim == 1 else pa.FixedSizeListArray.from_arrays(pa.array(np.ascontiguousarray(column).ravel()), column.shape[1]).cast(pa.list_(pa.float64()))


def inputs_of(triples: DataFrame, entities: DataFrame) -> DataFrame:
    return with_vectors(triples, entities).select(*(F.col(c).cast("long").alias(c) for c in ("id", "h", "r", "t")), "__hv", "__tv")


def in_batches(triples: DataFrame, entities: DataFrame, scorer: ConvScorer, make, ddl: str, label: float) -> DataFrame:
    """make(gradients of a batch, h, r, t) -> columns, over triples (id, h, r, t), in batches of 1,000 rows."""
    sent = triples.sparkSession.sparkContext.broadcast(scorer.without_entities())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 1000):
                part = pa.Table.from_batches([batch.slice(at, 1000)])
                made = made_in_parts(part, sent.value, make, label)
                yield pa.RecordBatch.from_arrays([part["id"].combine_chunks(), *map(arrow, made.values())], names=["id", *made])

    return inputs_of(triples, entities).mapInArrow(run, ddl)


def late_gradients(triples: DataFrame, scorer: ConvScorer, layers: tuple[str, ...] = last_layers(), label: float = 1.0) -> Callable[[pa.Table], pa.Table]:
    """What makes of a block of rows of inputs_of() the rows of gradients(): the passes run again in each task that takes the block, but what
    is sent there is two vectors a row, not a gradient many times as long."""
    check(layers)
    sent = triples.sparkSession.sparkContext.broadcast(scorer.without_entities())

    def made(rows: pa.Table) -> pa.Table:
        found = made_in_parts(rows, sent.value, lambda found, h, r, t: columns_of(found, h, r, t, layers), label)
        return pa.table([rows["id"], *map(arrow, found.values())], names=["id", *found])

    return made


def gradients(triples: DataFrame, entities: DataFrame, scorer: ConvScorer, layers: tuple[str, ...] = last_layers(), label: float = 1.0) -> DataFrame:
    """A row for each triple (id, h, r, t; entities: id, vector) with its gradient over the layers, as columns_of() says."""
    check(layers)
    arrays = "array<double>"
    types = {"dense": arrays, "x": arrays, "delta": arrays, "h": "long", "grad_h": arrays, "t": "long", "grad_t": arrays, "r": "long", "grad_r": arrays, "norm": "double"}
    used = set()
    if set(layers) - {*EMBEDDINGS, "fc"}:
        used |= {"dense"}
    for layer, own in (("fc", ("x", "delta")), ("entities", ("h", "grad_h", "t", "grad_t")), ("relations", ("r", "grad_r"))):
        used |= set(own) if layer in layers else set()
    order = [c for c in types if c in used or c == "norm"]
    ddl = ", ".join(["id long", *(f"{c} {types[c]}" for c in order)])
    return in_batches(triples, entities, scorer, lambda found, h, r, t: {c: columns_of(found, h, r, t, layers)[c] for c in order}, ddl, label)


def hashed(places: np.ndarray, seed: int, width: int) -> tuple[np.ndarray, np.ndarray]:
    """A bucket and a sign for each place."""
    h = (places.astype(np.uint64) + np.uint64(seed * 0x9E3779B97F4A7C15 % 2**64)) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0x94D049BB133111EB)
    h ^= h >> np.uint64(29)
    return (h % np.uint64(width)).astype(np.int64), np.where(h >> np.uint64(63), -1.0, 1.0)


def count_sketch(values: np.ndarray, bucket: np.ndarray, sign: np.ndarray, width: int) -> np.ndarray:
    """Sums of signed values by bucket, for each row; bucket and sign by column, or by row and column."""
    n, m = values.shape
    at = np.arange(n)[:, None] * width + np.broadcast_to(bucket, (n, m))
    return np.bincount(at.ravel(), weights=(values * sign).ravel(), minlength=n * width).reshape(n, width)


def sketch(found: dict[str, np.ndarray], h: np.ndarray, r: np.ndarray, t: np.ndarray, layers: tuple[str, ...], width: int, seed: int) -> np.ndarray:
    """A row of `width` values for each triple whose inner products are those of the gradients in expectation.  The linear layer's outer
    product is never made: the sketch of x times that of delta, in the frequency domain."""
    n = len(h)
    out = np.zeros((n, width))
    for place, layer in enumerate(LAYERS):
        if layer not in layers:
            continue
        own = seed * 100 + place
        if layer == "fc":
            x, d = (count_sketch(found[c], *hashed(np.arange(found[c].shape[1]), own * 10 + i, width), width) for i, c in enumerate(("x", "delta")))
            out += np.fft.irfft(np.fft.rfft(x, axis=1) * np.fft.rfft(d, axis=1), n=width, axis=1)
        elif layer in EMBEDDINGS:
            for ids, grad in ((h, "head"), (t, "tail")) if layer == "entities" else ((r, "relation"),):
                size = found[grad].shape[1]
                out += count_sketch(found[grad], *hashed(ids[:, None] * size + np.arange(size)[None], own, width), width)
        else:
            out += count_sketch(found[layer], *hashed(np.arange(found[layer].shape[1]), own, width), width)
    return out


def sketched(triples: DataFrame, entities: DataFrame, scorer: ConvScorer, layers: tuple[str, ...] = LAYERS, width: int = 256, seed: int = 42, label: float = 1.0) -> DataFrame:
    """id, dense (width values), norm (of these): gradients over the layers as sketches, for best_influences()."""
    check(layers)

    def make(found, h, r, t):
        s = sketch(found, h, r, t, layers, width, seed)
        return {"dense": s, "norm": np.sqrt((s**2).sum(axis=1))}

    return in_batches(triples, entities, scorer, make, "id long, dense array<double>, norm double", label)
