from kgspark.streaming import incremental
from pyspark.sql import functions as F


def test_filtered_stream(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    (folder / "a.json").write_text('{"subject": "C:1", "predicate": "biolink:treats", "object": "P:1"}\n{"subject": "CAID:1", "predicate": "p", "object": "P:1"}\n')
    edges = incremental.filter_stream(incremental.edge_stream(spark, str(folder)), None, "original")
    q = incremental.write_scored(edges, lambda df: df.withColumn("score", F.lit(1.0)), str(tmp_path / "out"), str(tmp_path / "ck"))
    q.awaitTermination()
    assert spark.read.parquet(str(tmp_path / "out")).count() == 1
    # a second start only takes what is new
    (folder / "b.json").write_text('{"subject": "C:2", "predicate": "biolink:treats", "object": "P:1"}\n')
    edges = incremental.filter_stream(incremental.edge_stream(spark, str(folder)), None, "original")
    incremental.write_scored(edges, lambda df: df.withColumn("score", F.lit(1.0)), str(tmp_path / "out"), str(tmp_path / "ck")).awaitTermination()
    assert spark.read.parquet(str(tmp_path / "out")).count() == 2


def test_windows_and_distinct(spark, tmp_path):
    src = str(tmp_path / "ev")
    spark.sql("SELECT 'a' AS subject, 'p' AS predicate, 'b' AS object, TIMESTAMP'2024-01-01 00:10:00' AS ts UNION ALL SELECT 'a', 'p', 'b', TIMESTAMP'2024-01-01 00:20:00' UNION ALL SELECT 'a', 'q', 'b', TIMESTAMP'2024-01-01 02:00:00'").write.parquet(src)
    stream = spark.readStream.schema("subject string, predicate string, object string, ts timestamp").parquet(src)
    for n, df, mode in (("once", incremental.distinct_edges(stream, "ts"), "append"), ("counts", incremental.windowed_counts(stream, "ts", "predicate"), "complete")):
        df.writeStream.format("memory").queryName(n).outputMode(mode).option("checkpointLocation", str(tmp_path / n)).trigger(availableNow=True).start().awaitTermination()
    assert spark.table("once").count() == 2
    assert sorted(r["n"] for r in spark.table("counts").collect()) == [1, 2]
