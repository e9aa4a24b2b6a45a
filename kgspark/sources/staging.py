"""Intermediate tables in the folder that driver and executors share."""

from __future__ import annotations

import atexit
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

_own_dirs: dict[str, str] = {}
_staged: list[tuple[SparkSession, str]] = []


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir, else the folder given to SparkContext.setCheckpointDir, else, on a single machine, a folder
    of our own.  On a cluster there must be one that all machines share."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if base:
        return base.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
    app = spark.sparkContext.applicationId
    if app not in _own_dirs:
        _own_dirs[app] = "file://" + tempfile.mkdtemp(prefix="kgspark-")
    return _own_dirs[app]


def new_path(spark: SparkSession, name: str) -> str:
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    _staged.append((spark, path))
    return path


def stage(df: DataFrame, name: str) -> DataFrame:
    """Write df once as Parquet in the shared folder and read it back: lineage ends here, and a lost
    executor costs a re-read instead of the work above."""
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def stage_tidily(df: DataFrame, name: str) -> DataFrame:
    """stage(), after which the shuffle files of the job are deleted: nothing reads them once its rows are written."""
    with tidy(df.sparkSession):
        return stage(df, name)


def stage_buckets(df: DataFrame, name: str, keys: list[str], n: int) -> DataFrame:
    """stage_tidily() in n buckets by the keys, so that joins on these leave df where it is.  The catalog knows the table only while it is
    written."""
    spark = df.sparkSession
    path, table = new_path(spark, name), f"kgspark_{uuid.uuid4().hex}"
    with tidy(spark):
        df.write.format("parquet").bucketBy(n, *keys).option("path", path).saveAsTable(table)
    found = spark.table(table)
    spark.sql(f"DROP TABLE {table}")  # of an external table the files stay
    return found


@contextmanager
def setting(spark: SparkSession, key: str, value: str) -> Iterator[None]:
    before = spark.conf.get(key, None)
    spark.conf.set(key, value)
    try:
        yield
    finally:
        spark.conf.unset(key) if before is None else spark.conf.set(key, before)


def tidy(spark: SparkSession):
    """Spark deletes the shuffle files of a job when it has ended."""
    return setting(spark, "spark.sql.classic.shuffleDependency.fileCleanup.enabled", "true")


def buckets_joined(spark: SparkSession):
    """A join leaves a table in place that is in buckets by a part of its keys."""
    return setting(spark, "spark.sql.requireAllClusterKeysForCoPartition", "false")


def unstage(*frames: DataFrame) -> None:
    """Delete the files of staged frames that no result will read again."""
    for df in frames:
        files = df.inputFiles()
        paths = [p for owner, p in _staged if any(f"/{p.rsplit('/', 1)[-1]}/" in f for f in files[:1])]
        drop_staged(df.sparkSession, paths)


def staged_paths(spark: SparkSession) -> list[str]:
    return [p for owner, p in _staged if owner is spark]


def drop_staged(spark: SparkSession, paths: list[str] | None = None) -> None:
    """Delete what stage() has written for this session, or these paths of it; results that still read them become
    unusable."""
    jvm = spark.sparkContext._jvm
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    for owner, path in [x for x in _staged if x[0] is spark and (paths is None or x[1] in paths)]:
        p = jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(conf).delete(p, True)
        _staged.remove((owner, path))


@atexit.register
def _drop_all() -> None:
    for spark in {id(s): s for s, _ in _staged}.values():
        try:
            drop_staged(spark)
        except Exception:  # noqa: BLE001  the session has already been stopped
            return
