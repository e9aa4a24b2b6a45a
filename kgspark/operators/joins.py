"""Markers, alignments and co-membership joins."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def mark(df: DataFrame, lookup: DataFrame, keys: list[str], name: str, as_int: bool = False) -> DataFrame:
    """df with a flag: does lookup have its keys?  Keys of lookup are taken in the same order."""
    found = lookup.select(*[F.col(c).alias(k) for c, k in zip(lookup.columns, keys)]).distinct().withColumn("__hit", F.lit(True))
    flag = F.coalesce("__hit", F.lit(False))
    return df.join(found, keys, "left").withColumn(name, flag.cast("int") if as_int else flag).drop("__hit")


def align(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of a and b with common keys, side by side; of repeated keys the row whose other columns come first."""

    def one(df: DataFrame) -> DataFrame:
        rest = [c for c in df.columns if c not in keys]
        if not rest:
            return df.distinct()
        return df.groupBy(*keys).agg(F.min(F.struct(*rest)).alias("__row")).select(*keys, *[F.col(f"__row.{c}").alias(c) for c in rest])

    return one(a).join(one(b), keys)


def first_by(df: DataFrame, keys: list[str], *order) -> DataFrame:
    """One row for each key, the first in the given order."""
    return df.withColumn("__n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter("__n = 1").drop("__n")


def combine_keep_first(parts: list[DataFrame], keys: list[str], *order) -> DataFrame:
    """Union of the parts; of repeated keys the row of the earliest part stays."""
    tagged = [p.withColumn("__part", F.lit(i)) for i, p in enumerate(parts)]
    out = tagged[0]
    for t in tagged[1:]:
        out = out.unionByName(t)
    return first_by(out, keys, F.col("__part"), *order).drop("__part")


def comembership(members: DataFrame, pairs: DataFrame, key: str = "path_id") -> DataFrame:
    """(pair, key) for pairs whose two ends are both members of one key: equi-joins on the member, not a
    loop over keys and pairs.  members: key, node; pairs: drug, disease."""
    m = members.select(key, "node").distinct()
    a = pairs.join(m.withColumnRenamed("node", "drug"), "drug")
    return a.join(m.withColumnRenamed("node", "disease"), [key, "disease"]).select("drug", "disease", key).distinct()


#: Rows that one task of matrix() makes, about.
TASK_PAIRS = 4_000_000


def matrix(drugs: DataFrame, diseases: DataFrame, predicate: str, task_pairs: int = TASK_PAIRS) -> DataFrame:
    """Every drug with every disease: the result itself is the product of two lists.  The drugs are dealt over as many tasks as the product asks
    for, not as their own few rows do."""
    a, b = drugs.distinct().persist(), diseases.distinct().persist()
    n = a.count()
    tasks = min(-(-n * b.count() // task_pairs), n)
    return (a.repartition(tasks) if tasks > 1 else a).crossJoin(b).withColumn("relation", F.lit(predicate))


def compare_sets(a: DataFrame, b: DataFrame) -> DataFrame:
    """One row: rows in both, in a only, in b only, and the share of both in the larger set."""
    both = a.distinct().withColumn("__a", F.lit(1)).join(b.distinct().withColumn("__b", F.lit(1)), a.columns, "full")
    counts = both.agg(F.count_if(F.col("__a").isNotNull() & F.col("__b").isNotNull()).alias("in_both"), F.count_if(F.col("__b").isNull()).alias("only_first"), F.count_if(F.col("__a").isNull()).alias("only_second"))
    larger = F.greatest(F.col("in_both") + F.col("only_first"), F.col("in_both") + F.col("only_second"))
    return counts.withColumn("match_percent", F.coalesce(F.round(100.0 * F.col("in_both") / F.nullif(larger, F.lit(0)), 6), F.lit(0.0)))
