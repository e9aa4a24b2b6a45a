"""Counts, degree statistics and summaries."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from kgspark.operators.filters import degrees
from kgspark.operators.ranking import running_sums


def frequency(df: DataFrame, column: str, total: int | None = None) -> DataFrame:
    """value, n and percent of all rows (or of `total`); rows without a value are not listed."""
    all_rows = F.lit(total) if total is not None else F.sum("__all").over(Window.partitionBy())
    counted = df.groupBy(F.col(column).alias("value")).agg(F.count("*").alias("n")).withColumn("__all", F.col("n"))
    return counted.withColumn("percent", F.round(100.0 * F.col("n") / all_rows, 6)).filter(F.col("value").isNotNull()).drop("__all")


def degree_histogram(triples: DataFrame) -> DataFrame:
    return degrees(triples, "head", "tail").groupBy("degree").agg(F.count("*").alias("nodes"))


def graph_stats(triples: DataFrame) -> DataFrame:
    """One row: triples, entities, relations, their ratio, and the nodes of greatest out- and in-degree."""
    counts = triples.agg(F.count("*").alias("triples"), F.countDistinct("relation").alias("relations"))
    entities = triples.select(F.explode(F.array("head", "tail")).alias("n")).agg(F.countDistinct("n").alias("entities"))

    def most(c: str, name: str):
        d = triples.groupBy(c).agg(F.count("*").alias("d"))
        return d.agg(F.min_by(c, F.struct(-F.col("d"), F.col(c))).alias(f"{name}_node"), F.max("d").alias(f"{name}_degree"))

    out = counts.join(entities, F.lit(True)).join(most("head", "out"), F.lit(True)).join(most("tail", "in"), F.lit(True))  # one row each
    return out.withColumn("triples_per_entity", F.round(F.try_divide(F.col("triples"), F.col("entities")), 6))


def top_relations(triples: DataFrame, k: int = 10) -> DataFrame:
    return frequency(triples, "relation").orderBy(F.col("n").desc(), "value").limit(k)


def split_stats(parts: DataFrame) -> DataFrame:
    """Triples, entities and relations of each part."""
    ends = parts.select("part", F.explode(F.array("head", "tail")).alias("e")).groupBy("part").agg(F.countDistinct("e").alias("entities"))
    return parts.groupBy("part").agg(F.count("*").alias("triples"), F.countDistinct("relation").alias("relations")).join(ends, "part")


def filter_stats(kept: DataFrame) -> DataFrame:
    """Per test: triples, entities, relations, mean, least and greatest degree of what a filter kept."""
    d = kept.select("test_id", F.explode(F.array("head", "tail")).alias("node")).groupBy("test_id", "node").agg(F.count("*").alias("d"))
    d = d.groupBy("test_id").agg(F.count("*").alias("entities"), F.round(F.avg("d"), 6).alias("mean_degree"), F.min("d").alias("least_degree"), F.max("d").alias("greatest_degree"))
    return kept.groupBy("test_id").agg(F.count("*").alias("triples"), F.countDistinct("relation").alias("relations")).join(d, "test_id")


def union_of_lists(rows: DataFrame, keys: list[str], items: str) -> DataFrame:
    """One row a key with the sorted union of its lists."""
    flat = rows.select(*keys, F.explode_outer(items).alias("__x"))
    return flat.groupBy(*keys).agg(F.array_sort(F.collect_set("__x")).alias(items))


def path_summary(members: DataFrame) -> DataFrame:
    """One row over the paths (path_id, drug, disease, node): paths, pairs, mean, least and greatest number of nodes, both
    ends among them."""
    each = members.groupBy("path_id").agg(F.min(F.struct("drug", "disease")).alias("pair"), (F.countDistinct("node") + 2).alias("n"))
    return each.agg(F.count("*").alias("paths"), F.countDistinct("pair").alias("pairs"), F.round(F.avg("n"), 6).alias("mean_nodes"), F.min("n").alias("least_nodes"), F.max("n").alias("most_nodes"))


def frequent(df: DataFrame, column: str, name: str, k: int) -> DataFrame:
    """The k most frequent values with their numbers and ranks."""
    counted = df.groupBy(column).agg(F.count("*").alias(name)).orderBy(F.col(name).desc(), column).limit(k)
    return counted.withColumn("rank", F.row_number().over(Window.orderBy(F.col(name).desc(), column)))  # k rows


def report_lines(df: DataFrame, by: list[str], what: str, number: str, share: str) -> DataFrame:
    """Lines of a text report, numbered within their group: what it is, how many, and which share in percent."""
    order = Window.partitionBy(*by).orderBy(F.col(number).desc(), what)
    text = F.concat(F.col(what), F.lit(": "), F.col(number).cast("string"), F.lit(" ("), F.round(share, 2).cast("string"), F.lit(" %)"))
    return df.select(*by, F.row_number().over(order).alias("line"), text.alias("text"))


def summary_of_groups(df: DataFrame, by: list[str], value: str, large: int) -> DataFrame:
    """One row over the summaries of all groups."""
    each = df.groupBy(*by).agg(F.count("*").alias("n"), F.avg(value).alias("m"))
    return each.agg(F.count("*").alias("groups"), F.count_if(F.col("n") >= large).alias("large"), F.round(F.avg("m"), 6).alias("mean_of_means"), F.round(F.median("m"), 6).alias("median_of_means"), F.max("n").alias("most_rows"))


def describe(df: DataFrame, by: list[str], value: str) -> DataFrame:
    x = F.col(value)
    return df.groupBy(*by).agg(F.count(x).alias("n"), F.round(F.avg(x), 6).alias("mean"), F.round(F.stddev_samp(x), 6).alias("sd"), F.round(F.stddev_pop(x), 6).alias("sd_population"), F.round(F.median(x), 6).alias("median"), F.min(x).alias("least"), F.max(x).alias("greatest"))


def percentiles(df: DataFrame, value: str, at: list[float]) -> DataFrame:
    """Interpolated percentiles, a row each: from running counts of distinct values, so no task holds them all."""
    by = running_sums(df.filter(F.col(value).isNotNull()).groupBy(value).agg(F.count("*").alias("__n")), value, {"__n": "__upto"})
    shares = F.explode(F.array(*[F.lit(float(a)) for a in at])).alias("share")
    n = df.agg(F.count(value).alias("__all")).select("__all", shares).withColumn("__at", F.col("share") * (F.col("__all") - 1))
    wanted = n.select("share", "__at", F.explode(F.array_distinct(F.array(F.floor("__at"), F.ceil("__at")))).alias("__i"))
    # two places for each share: the pair of values that it lies between
    found = by.join(F.broadcast(wanted), (F.col("__i") < F.col("__upto")) & (F.col("__i") >= F.col("__upto") - F.col("__n")))
    weight = F.when(F.floor("__at") == F.ceil("__at"), F.lit(1.0)).when(F.col("__i") == F.floor("__at"), F.ceil("__at") - F.col("__at")).otherwise(F.col("__at") - F.floor("__at"))
    return found.groupBy("share").agg(F.round(F.sum(F.col(value) * weight), 6).alias("value"))


def histogram(df: DataFrame, value: str, bins: int = 50) -> DataFrame:
    """bin (0 to bins - 1) and n over equal steps from the least to the greatest value, which is in the last."""
    bounds = df.agg(F.min(value).alias("lo"), F.max(value).alias("hi"))
    b = F.floor((F.col(value) - F.col("lo")) / F.nullif((F.col("hi") - F.col("lo")) / bins, F.lit(0.0)))
    rows = df.select(value).join(F.broadcast(bounds), F.lit(True))  # one row
    return rows.withColumn("bin", F.least(F.coalesce(b, F.lit(0)), F.lit(bins - 1)).cast("int")).groupBy("bin").agg(F.count("*").alias("n"))
