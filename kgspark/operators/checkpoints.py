"""Versions of a model in training: tables of parameter blocks, the best and the periodic ones, and going on from the last.

A version is a folder of rows (name, kind, shape, first, values): a tensor is cut into blocks of rows, so no row grows with the number of entities.
kind tells weights from the optimizer's two moments.  The list of versions is appended to when a version is complete; folders that it
doesn't name don't count.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kgspark.operators import score
from kgspark.operators.training import Adam, train

BLOCK_ROWS = 4096
BLOCKS = "name string, kind string, shape array<int>, first long, values array<double>"
VERSIONS = "epoch int, folder string, loss double, metric double, step int"


def blocks_table(spark: SparkSession, tensors: dict[str, dict[str, np.ndarray]], block_rows: int = BLOCK_ROWS) -> DataFrame:
    """{kind: {name: tensor}} as rows of blocks."""
    rows = []
    for kind, named in tensors.items():
        for name, tensor in named.items():
            for first in range(0, max(len(tensor), 1), block_rows):
                rows.append((name, kind, list(tensor.shape), first, tensor[first : first + block_rows].ravel().astype(float).tolist()))
    return spark.createDataFrame(rows, BLOCKS)


def tensors_of(table: DataFrame, names: dict[str, str] | None = None) -> dict[str, dict[str, np.ndarray]]:
    """{kind: {name: tensor}} of a table of blocks; names renames tensors of another framework.  Missing blocks, and blocks of
    another size than their shape asks for, are errors."""
    parts: dict[tuple[str, str], list] = {}
    for r in table.toLocalIterator(prefetchPartitions=True):
        parts.setdefault((r["kind"], (names or {}).get(r["name"], r["name"])), []).append((r["first"], r["shape"], r["values"]))
    out: dict[str, dict[str, np.ndarray]] = {}
    for (kind, name), found in parts.items():
        found.sort(key=lambda x: x[0])
        shape = found[0][1]
        values = np.concatenate([np.array(v, dtype=float) for _, _, v in found])
        if values.size != int(np.prod(shape)):
            raise ValueError(f"{name}: {values.size} values for shape {shape}")
        out.setdefault(kind, {})[name] = values.reshape(shape)
    return out


@dataclass
class Architecture:
    entities: int
    relations: int
    dimension: int
    channels: int
    kernel: tuple[int, int]
    height: int
    width: int


def architecture(shapes: dict[str, tuple[int, ...]]) -> Architecture:
    """What a checkpoint's tensors say about the model.  Height and width of the images follow from the linear layer's inputs; of two that fit the
    flatter one is taken."""
    (entities, dimension), (channels, _, *kernel), inputs = shapes["entities"], shapes["conv"], shapes["fc"][0]
    for height in range(1, dimension + 1):
        width = dimension // height
        if height * width == dimension and height >= kernel[0] and channels * (height - kernel[0] + 1) * (2 * width - kernel[1] + 1) == inputs:
            return Architecture(entities, shapes["relations"][0], dimension, channels, tuple(kernel), height, width)
    raise ValueError(f"no image of {dimension} values gives {inputs} inputs to the linear layer")


def architecture_of(table: DataFrame, names: dict[str, str] | None = None) -> Architecture:
    """The same from a table of blocks, by the shapes alone."""
    rows = table.filter(F.col("kind") == "weight").select("name", "shape").distinct().collect()
    return architecture({(names or {}).get(r["name"], r["name"]): tuple(r["shape"]) for r in rows})


def versions(spark: SparkSession, path: str) -> DataFrame:
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}/versions")
    there = folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(folder)
    return spark.read.schema(VERSIONS).parquet(f"{path}/versions") if there else spark.createDataFrame([], VERSIONS)


def blocks_of(spark: SparkSession, path: str, folder: str) -> DataFrame:
    return spark.read.schema(BLOCKS).parquet(f"{path}/{folder}")


def last_version(spark: SparkSession, path: str):
    """The row of the latest version; None if there is none."""
    return versions(spark, path).orderBy(F.col("epoch").desc()).first()


def best_version(spark: SparkSession, path: str):
    """The row of the version with the greatest metric, the earliest of equal ones."""
    return versions(spark, path).filter("metric IS NOT NULL").orderBy(F.col("metric").desc(), "epoch").first()


def reciprocal_rank(valid: DataFrame) -> Callable[[dict[str, np.ndarray], int, int], float]:
    """A metric: mean reciprocal rank of the tails of valid (h, r, t) among all entities, other true tails of (h, r) in valid left out."""
    rows = valid.select("h", "r", "t").distinct().withColumn("query_id", F.xxhash64("h", "r", "t")).persist()

    def metric(weights: dict[str, np.ndarray], height: int, width: int) -> float:
        scorer = score.ConvScorer(weights, height, width)
        entities = rows.sparkSession.createDataFrame([(i, v.tolist()) for i, v in enumerate(weights["entities"])], "id long, vector array<double>")
        known = rows.select("query_id", "h", "r").join(rows.select("h", "r", F.col("t").alias("tail")), ["h", "r"]).select("query_id", "tail")
        ranks = score.count_ranks(score.conv_queries(rows, entities, scorer), entities, score.conv_truth(rows, entities, scorer), known)
        return ranks.agg(F.avg(1.0 / F.col("rank"))).first()[0] or 0.0

    return metric


def train_versions(triples: DataFrame, weights: dict[str, np.ndarray], height: int, width: int, path: str, epochs: int, every: int = 5, metric: Callable[[dict[str, np.ndarray], int, int], float] | None = None, rate: float = 0.01, block_rows: int = BLOCK_ROWS, **options) -> dict[str, np.ndarray]:
    """Train up to `epochs` in all, from the last version in path if there is one.  A version is written after every `every` epochs, after
    the last, and whenever the metric (of weights, height, width) is greater than that of all versions before."""
    spark = triples.sparkSession
    last, best = last_version(spark, path), best_version(spark, path)
    greatest = best["metric"] if best else -np.inf
    adam = Adam(weights, rate)
    if last:
        found = tensors_of(blocks_of(spark, path, last["folder"]))
        weights = found["weight"]
        adam = Adam(weights, rate)
        adam.m, adam.v, adam.n = found["first moment"], found["second moment"], last["step"]
    for epoch in range(last["epoch"] if last else 0, epochs):
        weights, (loss,) = train(triples, weights, height, width, epochs=1, rate=rate, adam=adam, first_epoch=epoch, **options)
        now = metric(weights, height, width) if metric else None
        if (epoch + 1) % every == 0 or epoch + 1 == epochs or (now is not None and now > greatest):
            folder = f"version-{epoch + 1}-{uuid.uuid4().hex}"
            blocks_table(spark, {"weight": weights, "first moment": adam.m, "second moment": adam.v}, block_rows).write.parquet(f"{path}/{folder}")
            spark.createDataFrame([(epoch + 1, folder, float(loss), None if now is None else float(now), adam.n)], VERSIONS).coalesce(1).write.mode("append").parquet(f"{path}/versions")
        greatest = max(greatest, now if now is not None else -np.inf)
    return weights
