import re
import zlib
from collections import Counter, defaultdict

import pytest
from kgspark.llm import sharding


def check(rows, shards):
    slots = defaultdict(list)
    for r in rows:
        assert r["law"] == "bytes" and 0 <= r["shard"] < shards and r["grown_shard"] is None
        slots[r["shard"]].append(r["slot"])
    for s in slots.values():
        assert sorted(s) == list(range(len(s)))


def test_table(odd, local):
    rows = sharding.shard(odd).collect()
    check(rows, 16)
    want = Counter((r["doc_id"], len((r["text"] or "").encode()) + 1, zlib.crc32((r["text"] or "").encode())) for r in local)
    assert Counter((r["doc_id"], r["size"], r["text_crc32"]) for r in rows) == want


def check_law(rows, shards=16):
    """Near-equal bytes: within the tolerance and the largest row on each side."""
    sizes = Counter({s: 0 for s in range(shards)})
    for r in rows:
        sizes[r["shard"]] += r["size"]
    room = 0.002 * sum(sizes.values()) / shards + 2 * max(r["size"] for r in rows)
    assert max(sizes.values()) - min(sizes.values()) <= room


@pytest.mark.parametrize("heavy_rows", [1 << 10, 20])
@pytest.mark.parametrize(
    "rows",
    [
        [(5, "y" * 50)] * 1600 + [(i, f"t{i}") for i in range(400)],  # one row again and again
        [(None, None)] * 1600,
        [(None, "a b")] * 900 + [(i, "a b") for i in range(900)],
        [(i % 3, "x" * (i % 3)) for i in range(1200)],
    ],
)
def test_repeated_rows_are_divided(spark, monkeypatch, rows, heavy_rows):
    monkeypatch.setattr(sharding, "HEAVY_ROWS", heavy_rows)
    out = sharding.shard(spark.createDataFrame(rows, "doc_id long, text string").repartition(5)).collect()
    check(out, 16)
    check_law(out)
    assert Counter((r["doc_id"], r["size"]) for r in out) == Counter((d, len(t or "") + 1) for d, t in rows)


def test_heavy_bins_are_divided(spark, monkeypatch):
    """No numbering window holds all copies of a text, or of a row."""
    monkeypatch.setattr(sharding, "HEAVY_ROWS", 20)
    rows = [(i, "one text") for i in range(1000)] + [(7, "one row")] * 1000 + [(i, f"t{i}") for i in range(500)]
    sized = sharding.stage(sharding.sized(spark.createDataFrame(rows, "doc_id long, text string")), "sized")
    bounds = sharding.splitters(sized, 4)
    placed, counts = sharding.binned(sized.withColumn("shard", sum((sharding.after(b).cast("int") for b in bounds), sharding.F.lit(0))), 4)
    assert max(r["__rows"] for r in counts.collect()) <= 60
    assert placed.count() == len(rows) == sum(r["__rows"] for r in counts.collect())


@pytest.mark.parametrize("copies", [0, 4000])
def test_sizes_are_near_equal(spark, copies):
    """Also with a group of equal texts that holds most rows."""
    rows = [(i, f"text {i} " + "w" * (i % 50)) for i in range(6000)] + [(10_000 + i, "c" * 60) for i in range(copies)]
    out = sharding.shard(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    check(out, 16)
    sizes = Counter()
    for r in out:
        sizes[r["shard"]] += r["size"]
    assert max(sizes.values()) - min(sizes.values()) <= 0.002 * sum(sizes.values()) / 16 * 2 + 130


def test_equal_texts_stay_together_where_they_can(spark):
    rows = [(i, f"text number {i // 5}") for i in range(20_000)]
    out = sharding.shard(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    by = defaultdict(set)
    for r in out:
        by[r["text_crc32"]].add(r["shard"])
    assert sum(len(s) > 1 for s in by.values()) <= 15


def test_keys_ascend_over_shards(spark):
    rows = [(i, f"text {i}") for i in range(3000)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    keys = {r["doc_id"]: r["__first"] for r in sharding.sized(df).collect()}
    shards = defaultdict(list)
    for r in sharding.shard(df, 4).collect():
        shards[r["shard"]].append(keys[r["doc_id"]])
    assert all(max(shards[s]) < min(shards[s + 1]) for s in range(3))


@pytest.mark.parametrize("rows", [[], [(1, None)], [(None, "a"), (None, "a")], [(7, "x")] * 40])
def test_small_tables(spark, rows):
    out = sharding.shard(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert len(out) == len(rows)
    check(out, 16)


def test_empty_table_and_native_plan(odd, none):
    assert sharding.shard(none).collect() == []
    assert not re.search("Python|Pandas|Arrow", sharding.shard(odd)._jdf.queryExecution().executedPlan().toString())
