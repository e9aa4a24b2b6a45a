"""Ranks over a whole table without gathering it in one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Rows that one task ranks, about, and the sample that bounds are taken from.
TASK_ROWS = 500_000
SAMPLE_ROWS = 20_000


def bounds_of(df: DataFrame, key: Column, n: int, parts: int) -> list:
    """Values of the key that cut the table into about `parts` equal ranges, from a sample."""
    sample = sorted(r[0] for r in df.select(key).sample(min(1.0, SAMPLE_ROWS / n), seed=1).collect() if r[0] is not None)
    return sorted({sample[len(sample) * i // parts] for i in range(1, parts)}) if sample else []


def dealt_by_range(df: DataFrame, key: Column, n: int, parts: int) -> DataFrame:
    """df with __part: ranges that ascend with the key, nulls before all."""
    bounds = bounds_of(df, key, n, parts)
    part = F.size(F.filter(F.array(*[F.lit(b) for b in bounds]), lambda b: b <= key)) if bounds else F.lit(0)
    return df.withColumn("__part", F.when(key.isNull(), F.lit(-1)).otherwise(part))


def global_rank(df: DataFrame, key: Column | str, *ties: Column | str, name: str = "rank", descending: bool = False, task_rows: int = TASK_ROWS) -> DataFrame:
    """1-based row number of the whole table by key (nulls first ascending, last descending), then ties.  Rows are
    dealt by bounds from a sample, ranked within their range, and moved by the number of rows in the ranges before:
    exact for any bounds."""
    key = F.col(key) if isinstance(key, str) else key
    order = [key.desc_nulls_last() if descending else key.asc_nulls_first(), *[F.col(t) if isinstance(t, str) else t for t in ties]]
    n = df.count()
    parts = -(-n // task_rows)
    if parts <= 1:
        return df.withColumn(name, F.row_number().over(Window.orderBy(*order)).cast("long"))
    dealt = dealt_by_range(df, key, n, parts)
    counts = dealt.groupBy("__part").agg(F.count("*").alias("__rows"))
    side = Window.orderBy(F.col("__part").desc() if descending else F.col("__part").asc()).rowsBetween(Window.unboundedPreceding, -1)
    before = counts.withColumn("__moved", F.coalesce(F.sum("__rows").over(side), F.lit(0))).drop("__rows")  # one row a range
    within = F.row_number().over(Window.partitionBy("__part").orderBy(*order))
    # no caller asks for a rank of these names, and many for __n
    return dealt.withColumn("__within", within).join(F.broadcast(before), "__part").withColumn(name, (F.col("__within") + F.col("__moved")).cast("long")).drop("__part", "__within", "__moved")


def running_sums(df: DataFrame, key: str, sums: dict[str, str], descending: bool = False, task_rows: int = TASK_ROWS) -> DataFrame:
    """df (a row for each value of key) with the running sum of columns, {column: name}, up to and with each row, and
    their totals as <name>_total.  Ranges are summed apart and moved by the sums of the ranges before."""
    order = F.col(key).desc_nulls_last() if descending else F.col(key).asc_nulls_first()
    n = df.count()
    parts = max(-(-n // task_rows), 1)
    dealt = dealt_by_range(df, F.col(key), n, parts) if parts > 1 else df.withColumn("__part", F.lit(0))
    each = dealt.groupBy("__part").agg(*[F.sum(c).alias(f"__s_{name}") for c, name in sums.items()])
    side = Window.orderBy(F.col("__part").desc() if descending else F.col("__part").asc()).rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy()
    before = each.select("__part", *[F.coalesce(F.sum(f"__s_{x}").over(side), F.lit(0)).alias(f"__b_{x}") for x in sums.values()], *[F.sum(f"__s_{x}").over(whole).alias(f"{x}_total") for x in sums.values()])
    within = Window.partitionBy("__part").orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    out = dealt.select("*", *[F.sum(c).over(within).alias(f"__w_{x}") for c, x in sums.items()]).join(F.broadcast(before), "__part")  # one row a range
    return out.withColumns({x: F.col(f"__w_{x}") + F.col(f"__b_{x}") for x in sums.values()}).drop("__part", *[f"__{k}_{x}" for k in "wb" for x in sums.values()])


def hash_order(seed: int, *columns: str) -> Column:
    """A stable pseudo-random order: md5 of the seed and the columns as text."""
    return F.md5(F.concat_ws("|", F.lit(str(seed)), *[F.col(c).cast("string") for c in columns]))


def top_k(df: DataFrame, by: list[str], k: int, *order: Column, name: str = "rank") -> DataFrame:
    """The first k rows of each group; Spark drops further rows before the shuffle."""
    return df.withColumn(name, F.row_number().over(Window.partitionBy(*by).orderBy(*order))).filter(F.col(name) <= k)
