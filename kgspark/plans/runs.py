"""Runs over many tests that can be cut off and go on: results by batch, and a manifest of the tests that are done.

A run has a key made of the contents of its inputs and of its parameters, so changed inputs are another run and equal ones are the same.  A batch's rows
are written to a folder of its own; when that is complete, its tests (those without results too) are appended to the manifest, in one commit of
Spark's.  What no manifest row names doesn't count, so a batch that was cut off is done again.
"""

from __future__ import annotations

import hashlib
import json
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

MANIFEST = "key string, test_id string, batch string"


def content_hash(df: DataFrame) -> str:
    """A hash of the rows (and the schema) that doesn't depend on their order: sums of two row hashes, and the number of rows."""
    columns = sorted(df.columns)
    rows = [F.to_json(F.struct(*[F.col(f"`{c}`") for c in columns]), {"ignoreNullFields": "false"})]
    sums = [F.sum(F.xxhash64(*seed, *rows).cast("decimal(38,0)")) for seed in ([], [F.lit(1)])]
    n, a, b = df.agg(F.count("*"), *sums).first()
    return hashlib.md5(f"{[(c, df.schema[c].dataType.simpleString()) for c in columns]}|{n}|{a}|{b}".encode()).hexdigest()


def run_key(inputs: dict[str, DataFrame], parameters: dict) -> str:
    parts = {name: content_hash(df) for name, df in sorted(inputs.items())}
    return hashlib.md5(json.dumps([parts, parameters], sort_keys=True).encode()).hexdigest()


def manifest(spark: SparkSession, path: str, key: str) -> DataFrame:
    """key, test_id, batch of the tests of a run that are done; several runs may share a folder."""
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}/manifest")
    there = folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(folder)
    found = spark.read.schema(MANIFEST).parquet(f"{path}/manifest") if there else spark.createDataFrame([], MANIFEST)
    return found.filter(F.col("key") == key)


def results(spark: SparkSession, path: str, key: str) -> DataFrame | None:
    """The rows of all complete batches of a run; None if there is none."""
    batches = sorted(r["batch"] for r in manifest(spark, path, key).select("batch").distinct().collect())
    return spark.read.parquet(*[f"{path}/batches/{b}" for b in batches]) if batches else None


def resume(tests: DataFrame, path: str, key: str, compute: Callable[[DataFrame], DataFrame], batches: int = 1) -> DataFrame | None:
    """compute(tests of a batch) -> rows, for the tests (test_id, ...) that the run hasn't done; then the results of all.  Batches are
    dealt by hash of test_id."""
    spark = tests.sparkSession
    for n in range(batches):
        part = tests.filter(F.pmod(F.xxhash64("test_id"), F.lit(batches)) == n)
        left = part.join(manifest(spark, path, key).select("test_id"), "test_id", "left_anti").select(tests.columns)
        if left.isEmpty():
            continue
        batch = uuid.uuid4().hex
        compute(left).write.parquet(f"{path}/batches/{batch}")
        done = left.select(F.lit(key).alias("key"), F.col("test_id").cast("string").alias("test_id"), F.lit(batch).alias("batch")).distinct()
        done.coalesce(1).write.mode("append").parquet(f"{path}/manifest")
    return results(spark, path, key)
