"""Structured Streaming forms: filtering arriving edges, scoring as they come, windowed counts with late data."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery

from kgspark.operators.filters import STYLES, keep, with_types
from kgspark.sources.readers import EDGES


def edge_stream(spark: SparkSession, folder: str) -> DataFrame:
    """JSON-lines files as they arrive in a folder."""
    return spark.readStream.schema(EDGES).json(folder)


def filter_stream(edges: DataFrame, nodes: DataFrame, style: str) -> DataFrame:
    """A style over a stream; the node table is the static side of two stream-static joins."""
    assert style in STYLES, style
    if style in ("original", "keepall"):
        return edges.filter(keep(style))
    return with_types(edges, nodes).filter(keep(style)).select(edges.columns)


def distinct_edges(edges: DataFrame, event_time: str, late: str = "1 hour") -> DataFrame:
    """First arrivals of each triple; keys older than the watermark leave the state."""
    return edges.withWatermark(event_time, late).dropDuplicatesWithinWatermark(["subject", "predicate", "object"])


def windowed_counts(events: DataFrame, event_time: str, key: str, width: str = "1 hour", late: str = "1 hour") -> DataFrame:
    return events.withWatermark(event_time, late).groupBy(F.window(event_time, width), key).agg(F.count("*").alias("n"))


def write_scored(triples: DataFrame, score: Callable[[DataFrame], DataFrame], path: str, checkpoint: str) -> StreamingQuery:
    """Score each micro-batch and append it; a restarted query goes on where it stopped."""

    def batch(df: DataFrame, n: int) -> None:
        score(df).write.mode("overwrite").parquet(f"{path}/batch={n}")  # a repeated batch replaces itself

    return triples.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
