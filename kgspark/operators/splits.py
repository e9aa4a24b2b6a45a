"""Splits, samples and leakage-safe candidates.  Pseudo-random orders are md5 of a seed and the row."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from kgspark.operators.ranking import TASK_ROWS, global_rank, hash_order, running_sums, top_k
from kgspark.sources.staging import stage

KEY = ["head", "relation", "tail"]


def split(triples: DataFrame, ratio: float = 0.9, seed: int = 42) -> DataFrame:
    """triples with part: the first floor(n x ratio) in hash order are train, the rest valid."""
    n = triples.count()
    ranked = global_rank(triples.withColumn("__h", hash_order(seed, *KEY)), "__h", *KEY, name="__n")
    return ranked.withColumn("part", F.when(F.col("__n") <= int(n * ratio), "train").otherwise("valid")).drop("__h", "__n")


def sample_fraction(rows: DataFrame, fraction: float, seed: int = 42) -> DataFrame:
    """floor(n x fraction) rows, the first in hash order."""
    n = rows.count()
    ranked = global_rank(rows.withColumn("__h", hash_order(seed, *rows.columns)), "__h", *rows.columns, name="__n")
    return ranked.filter(F.col("__n") <= int(n * fraction)).drop("__h", "__n")


def sample_per_stratum(rows: DataFrame, strata: list[str], fraction: float, seed: int = 42) -> DataFrame:
    """ceil(fraction) of each stratum in hash order, one row at least."""
    w = Window.partitionBy(*strata)
    key = hash_order(seed, *rows.columns)
    ranked = rows.withColumns({"__n": F.row_number().over(w.orderBy(key, *rows.columns)), "__all": F.count("*").over(w)})
    return ranked.filter(F.col("__n") <= F.ceil(F.col("__all") * fraction)).drop("__n", "__all")


def categorize(treats: DataFrame, compat: bool = False) -> DataFrame:
    """treats (head, relation, tail) with category one_to_one, one_to_many, many_to_one or many_to_many, and
    group, the end that the rows of a group share.  Edges whose two ends both repeat are many_to_many, with
    all edges that touch their nodes.  one_to_many is one head with several tails; compat gives the two
    names the other way round, and groups by the end that does not repeat."""
    heads = treats.groupBy("head").agg(F.count("*").alias("__hs"))
    tails = treats.groupBy("tail").agg(F.count("*").alias("__ts"))
    counted = treats.join(heads, "head").join(tails, "tail")
    core = counted.filter("__hs > 1 AND __ts > 1")
    nodes = core.select(F.explode(F.array("head", "tail")).alias("node")).distinct().withColumn("__nm", F.lit(True))
    marked = counted.join(nodes.withColumnsRenamed({"node": "head", "__nm": "__nh"}), "head", "left").join(nodes.withColumnsRenamed({"node": "tail", "__nm": "__nt"}), "tail", "left")
    many_tails, many_heads = ("many_to_one", "one_to_many") if compat else ("one_to_many", "many_to_one")
    category = (
        F.when(F.coalesce("__nh", "__nt", F.lit(False)), "many_to_many")
        .when((F.col("__hs") == 1) & (F.col("__ts") == 1), "one_to_one")
        .when((F.col("__hs") > 1) & (F.col("__ts") == 1), many_tails)
        .otherwise(many_heads)
    )
    out = marked.withColumn("category", category)
    shared = {many_tails: "tail" if compat else "head", many_heads: "head" if compat else "tail"}
    group = F.when(F.col("category") == many_tails, F.col(shared[many_tails])).when(F.col("category") == many_heads, F.col(shared[many_heads])).otherwise(F.concat_ws("|", *KEY))
    return out.withColumn("group", group).select(*KEY, "category", "group")


def group_sample(categorized: DataFrame, shares: dict[str, float], seed: int = 42, overshoot: float = 1.5, task_rows: int = TASK_ROWS) -> DataFrame:
    """Test edges by category: groups in hash order, whole, until the target is reached; a group with which a category would have
    more than overshoot x target is passed over.

    A group no larger than what may go beyond the target is never passed over, so such groups are taken by their prefix sums, which come
    from ranges of the order.  Only larger ones may be; each that is taken brings the sum so much nearer the target that few are: they are
    found one after another, by an aggregate each (1 / (overshoot - 1) + 2 at most).  The driver holds those."""
    if overshoot < 1.1:
        raise ValueError("overshoot must be 1.1 at least")
    groups = categorized.groupBy("category", "group").agg(F.count("*").alias("size"))
    groups = stage(groups.withColumn("__key", F.concat_ws("|", "category", hash_order(seed, "category", "group"), "group")), "groups")
    total = groups.agg(F.sum("size")).first()[0] or 0
    target = {c: int(total * s) for c, s in shares.items()}
    limit = {c: max(n, int(n * overshoot)) for c, n in target.items()}

    def of(values: dict):
        return F.coalesce(*[F.when(F.col("category") == c, F.lit(v)) for c, v in values.items()], F.lit(0)).cast("long")

    small = F.col("size") <= of(limit) - of(target)
    summed = running_sums(groups.withColumn("__small", F.when(small, F.col("size")).otherwise(0)), "__key", {"__small": "__upto"}, task_rows=task_rows)
    start = summed.groupBy("category").agg(F.min(F.col("__upto") - F.col("__small")).alias("__start"))  # a row a category
    each = summed.join(F.broadcast(start), "category").withColumn("__before", F.col("__upto") - F.col("__small") - F.col("__start")).drop("__upto", "__upto_total", "__start")
    each = stage(each, "walked")
    taken: dict[str, list[tuple[str, int]]] = {c: [] for c in shares}
    while True:
        last = {c: v[-1][0] if v else "" for c, v in taken.items()}
        so_far = F.col("__before") + of({c: sum(n for _, n in v) for c, v in taken.items()})
        after = F.col("__key") > F.coalesce(*[F.when(F.col("category") == c, F.lit(k)) for c, k in last.items()], F.lit(""))
        fits = each.filter(~small & after & (so_far < of(target)) & (so_far + F.col("size") <= of(limit)))
        found = fits.groupBy("category").agg(F.min(F.struct("__key", "size")).alias("g")).collect()
        if not found:
            break
        for r in found:
            taken[r["category"]].append((r["g"]["__key"], r["g"]["size"]))
    large = [(c, k, n) for c, v in taken.items() for k, n in v]
    earlier = sum((F.when((F.col("category") == c) & (F.col("__key") > k), F.lit(n)).otherwise(0) for c, k, n in large), F.lit(0))
    chosen = each.filter(F.when(small, F.col("__before") + earlier < of(target)).otherwise(F.col("__key").isin([k for _, k, _ in large])))
    return categorized.join(chosen.select("category", "group"), ["category", "group"], "left_semi").select(categorized.columns)


def negatives(scores: DataFrame, positives: DataFrame, per_tail: int = 20, seed: int = 42) -> DataFrame:
    """Up to per_tail pairs of each tail that are no positives, in hash order."""
    pairs = scores.join(positives.select("head", "tail"), ["head", "tail"], "left_anti")
    return top_k(pairs, ["tail"], per_tail, hash_order(seed, "head", "tail"), F.col("head"), name="__n").drop("__n")


def without_triples(triples: DataFrame, test: DataFrame) -> DataFrame:
    """Triples that are not in test; repeats stay."""
    return triples.join(test, KEY, "left_anti")


def without_pairs(triples: DataFrame, test: DataFrame) -> DataFrame:
    """Triples without those that join the two ends of a test triple in its direction, by any relation."""
    return triples.join(test, ["head", "tail"], "left_anti").select(KEY)


def train_candidates(triples: DataFrame, test: DataFrame) -> DataFrame:
    """Distinct triples without test triples and without any on a test pair."""
    return without_pairs(without_triples(triples.distinct(), test), test)


def removed_predicates(triples: DataFrame, test: DataFrame) -> DataFrame:
    """What without_pairs takes away beyond the test triples, by relation."""
    return without_triples(triples, test).join(test, ["head", "tail"], "left_semi").groupBy("relation").agg(F.count("*").alias("removed"))
