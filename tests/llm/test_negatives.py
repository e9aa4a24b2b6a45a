import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from kgspark.llm import negatives

SCHEMA = "vec_id long, embedding array<float>, label int, row string"


def plain(rows, anchor, positives=5, negatives_=3, least=50, most=95):
    """rows (vec_id, embedding, label) -> the result, by all products in Python's integers."""
    usable = [(i, [math.floor(256 * float(np.float32(x))) for x in e], y) for i, e, y, *_ in rows if i is not None and e is not None and y is not None and all(x is not None and math.isfinite(x) for x in e)]
    score = lambda a, b: sum(x * y for x, y in zip(a, b))  # noqa: E731  the shorter one's end counts as zeros
    out = []
    for n, (i, e, y) in enumerate(usable):
        if not anchor(i):
            continue
        others = sorted((-score(e, f), j, m, z) for m, (j, f, z) in enumerate(usable) if m != n)
        for p, j, _, z in [x for x in others if x[3] == y][:positives]:
            hard = [(q, k) for q, k, _, z in others if z != y and least * -p <= 100 * -q <= most * -p][:negatives_]
            out += [(i, j, r + 1, k, -p, -q) for r, (q, k) in enumerate(hard)]
    return sorted(out)


def mined(spark, rows, **options):
    df = spark.createDataFrame([(*r[:3], "x") for r in rows], SCHEMA)
    got = negatives.mine(df, F.col("vec_id") % 5 == 0, **options)
    return sorted(map(tuple, got.collect()))


def clusters(seed, n=600, dims=8, centres=12, spread=0.15, labels=3):
    rng = np.random.default_rng(seed)
    c = rng.normal(size=(centres, dims))
    at = np.where(rng.random(n) < 0.35, 0, rng.integers(0, centres, n))  # a third of all rows in one cluster
    v = c[at] + spread * rng.normal(size=(n, dims))
    return [(int(i), [float(x) for x in e], int(y)) for i, e, y in zip(rng.permutation(n), v.astype(np.float32), rng.integers(0, labels, n))]


@pytest.mark.parametrize("options", [{}, {"group_rows": 7, "slice_bytes": 3000, "pivots": 16}])
def test_against_all_products(spark, options):
    rows = clusters(1)
    want = plain(rows, lambda i: i % 5 == 0)
    assert len(want) > 500 and mined(spark, rows, **options) == want


def test_odd_rows(spark):
    rows = clusters(2, n=60, dims=3)
    rows += [(5, [1.0, 2.0, 3.0], None), (10, None, 1), (15, [1.0, None, 2.0], 1), (20, [1.0, float("nan"), 0.0], 1), (25, [float("inf"), 0.0, 0.0], 0), (None, [1.0, 0.0, 0.0], 1)]
    rows += [(1000, [0.5, 0.5, 0.5], 2)] * 4 + [(1005, [0.0, 0.0, 0.0], 1), (1010, [-0.5, -0.5, -0.5], 2), (1015, [], 0), (1020, [1.0], 0), (1025, [1.0, 1.0], 1)]
    rows += [(1030, [2.0, 0.0, 0.0], 77)]  # alone with its label
    rows += [(2000 + i, [0.25, 0.25, 0.25], i % 2) for i in range(40)]  # copies under many ids: ties
    want = plain(rows, lambda i: i % 5 == 0)
    assert mined(spark, rows, slice_bytes=200, group_rows=3, pivots=4) == want


def test_no_rows_no_anchors_one_label(spark):
    assert mined(spark, []) == []
    assert mined(spark, [(1, [1.0], 1), (2, [1.0], 2)]) == []
    assert mined(spark, [(5, [1.0], 1), (6, [1.0], 1)]) == []
    assert mined(spark, [(5, None, 1)]) == []


def test_large_components(spark):
    rows = [(5 * i, [70_000.0 * (i + 1), 3e4, -1e3 * i], i % 2) for i in range(8)] + [(1, [60_000.0, 1.0, 2.0], 1), (2, [50_000.0, 2.0, 1.0], 0)]
    held = [(i, [min(max(x, -65536.0), 65536.0) for x in e], y) for i, e, y in rows]
    assert mined(spark, rows) == plain(held, lambda i: i % 5 == 0)


def test_candidates_go_only_where_they_may_serve(spark):
    """Far clusters are left out, and what is left out wasn't needed (the result equals that of all products)."""
    rows = clusters(3, n=900, dims=16, centres=9, spread=0.01, labels=2)
    rows = [(i, (np.array(e) / np.linalg.norm(e)).astype(np.float32).tolist(), y) for i, e, y in rows]
    df = spark.createDataFrame([(*r, "x") for r in rows], SCHEMA)
    points = negatives.pointed(df, F.col("vec_id") % 5 == 0, pivots=48)
    anchors = points.placed.filter("anchor").withColumn("group", F.col("home")).withColumns({"lows": F.array(F.lit(-negatives.ANY)), "highs": F.array(F.lit(negatives.ANY))})
    found = negatives.search(points, anchors, True, 5)
    raised = found.groupBy("anchor").agg(F.array(F.min("score")).alias("lows")).withColumnRenamed("anchor", "row")
    known = anchors.drop("lows").join(raised, "row")
    members = negatives.Members.of(known, points.cells.norm2)
    sent = negatives.routed(points.placed, points.cells, members, 1, False).count()
    groups = len(set(members.group.tolist()))
    assert groups > 5 and sent < 0.5 * groups * len(rows)
    assert mined(spark, rows, group_rows=20, pivots=48) == plain(rows, lambda i: i % 5 == 0)


def test_query_changes_labels_and_has_the_columns(spark, tmp_path):
    rows = [(i, e, y) for i, e, y in clusters(4, n=400)]
    spark.createDataFrame([(*r, "x") for r in rows], SCHEMA).repartition(3).write.parquet(str(tmp_path / "embeddings.parquet"))
    got = negatives.op13_hard_negatives(spark, str(tmp_path))
    assert got.dtypes == [("anchor_id", "bigint"), ("positive_id", "bigint"), ("rank", "int"), ("negative_id", "bigint"), ("positive_score", "bigint"), ("negative_score", "bigint")]
    changed = [(i, e, (y + 1) % 10 if i % 7 == 0 else y) for i, e, y in rows]
    assert sorted(map(tuple, got.collect())) == plain(changed, lambda i: i % 50 == 0)
