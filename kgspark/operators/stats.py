"""Outliers, two-sample statistics, permutation tests, densities."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kgspark.functions import two_sample as T
from kgspark.operators.ranking import TASK_ROWS, global_rank, running_sums
from kgspark.sources.staging import stage


def mad_outliers(rows: DataFrame, group: list[str], value: str, times: float = 3.0) -> DataFrame:
    """Per group: median, median absolute deviation (unscaled), threshold, rows over it."""
    m = rows.groupBy(*group).agg(F.median(value).alias("median"))
    d = rows.join(m, group).withColumn("__d", F.abs(F.col(value) - F.col("median")))
    mad = d.groupBy(*group).agg(F.first("median").alias("median"), F.median("__d").alias("mad"))
    over = d.drop("median").join(mad, group).groupBy(*group).agg(F.max("median").alias("median"), F.max("mad").alias("mad"), F.count_if(F.col(value) > F.col("median") + times * F.col("mad")).alias("outliers"))
    return over.select(*group, F.round("median", 6).alias("median"), F.round("mad", 6).alias("mad"), F.round(F.col("median") + times * F.col("mad"), 6).alias("threshold"), "outliers")


def sigma_outliers(rows: DataFrame, group: list[str], value: str, times: float = 3.0) -> DataFrame:
    s = rows.groupBy(*group).agg(F.avg(value).alias("mean"), F.stddev_samp(value).alias("sd"))
    over = rows.join(s, group).groupBy(*group).agg(F.max("mean").alias("mean"), F.max("sd").alias("sd"), F.count_if(F.col(value) > F.col("mean") + times * F.col("sd")).alias("outliers"))
    return over.select(*group, F.round("mean", 6).alias("mean"), F.round("sd", 6).alias("sd"), "outliers")


def two_sample(rows: DataFrame, value: str, flag: str, digits: int = 6) -> DataFrame:
    """One row of size, mean, median, sd and quartiles of flagged and other rows, and Cohen's d."""
    yes = F.col(flag) == 1

    def side(cond, name: str):
        x = F.when(cond, F.col(value))
        return [F.count(x).alias(f"n_{name}"), F.avg(x).alias(f"mean_{name}"), F.median(x).alias(f"median_{name}"), F.stddev_samp(x).alias(f"sd_{name}"), F.percentile(x, 0.25).alias(f"q25_{name}"), F.percentile(x, 0.75).alias(f"q75_{name}")]

    out = rows.agg(*side(yes, "on"), *side(~yes, "off"))
    pooled = F.sqrt(((F.col("n_on") - 1) * F.col("sd_on") * F.col("sd_on") + (F.col("n_off") - 1) * F.col("sd_off") * F.col("sd_off")) / F.nullif(F.col("n_on") + F.col("n_off") - 2, F.lit(0)))
    out = out.withColumn("cohens_d", F.try_divide(F.col("mean_on") - F.col("mean_off"), pooled))
    return out.select(*[F.round(c, digits).alias(c) if not c.startswith("n_") else F.col(c) for c in out.columns])


def by_value(rows: DataFrame, value: str, flag: str) -> DataFrame:
    """Each distinct value with __a and __b, its flagged and other rows, and a and b, those up to it."""
    by = rows.groupBy(value).agg(F.count_if(F.col(flag) == 1).alias("__a"), F.count_if(F.col(flag) != 1).alias("__b"))
    return running_sums(by, value, {"__a": "a", "__b": "b"})


def mann_whitney_u(rows: DataFrame, value: str, flag: str, digits: int = 6) -> DataFrame:
    """U of the flagged rows: other rows below each, ties by half."""
    u = F.col("__a") * (F.col("b") - F.col("__b") / 2.0)
    return by_value(rows, value, flag).agg(F.sum("__a").alias("n_on"), F.sum("__b").alias("n_off"), F.round(F.sum(u), digits).alias("u"))


def ks_statistic(rows: DataFrame, value: str, flag: str, digits: int = 6) -> DataFrame:
    """Greatest distance of the two empirical distributions."""
    gap = F.abs(F.try_divide("a", "a_total") - F.try_divide("b", "b_total"))
    return by_value(rows, value, flag).agg(F.round(F.max(gap), digits).alias("ks"))


REPORT = "group string, n_on long, n_off long, shapiro_on double, shapiro_on_p double, shapiro_off double, shapiro_off_p double, levene double, levene_p double, t double, t_p double, welch boolean, u double, u_p double, ks double, ks_p double, cohens_d double, effect string, dip double, dip_tail double"


def distribution_report(rows: DataFrame, group: str, value: str, flag: str) -> DataFrame:
    """Two-sample tests for each group (a result file of one test triple, so a group fits a task).  Normality is tested on
    all rows; beyond 5,000 its p extrapolates the approximation."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        nan = float("nan")
        pdf = pdf.sort_values([value, flag], kind="stable")
        x = pdf[value].to_numpy(dtype=float)
        on, off = x[pdf[flag].to_numpy() == 1], x[pdf[flag].to_numpy() != 1]
        out = {f.split()[0]: nan if f.endswith("double") else None for f in REPORT.split(", ")}
        out |= {"group": str(pdf[group].iloc[0]), "n_on": len(on), "n_off": len(off), "dip": T.dip(x) if len(x) >= 4 else nan}
        tail = x[x >= np.quantile(x, 0.75)] if len(x) else x
        out["dip_tail"] = T.dip(tail) if len(tail) >= 10 else nan
        (out["shapiro_on"], out["shapiro_on_p"]), (out["shapiro_off"], out["shapiro_off_p"]) = (T.shapiro_wilk(a) if len(a) else (nan, nan) for a in (on, off))
        if len(on) >= 2 and len(off) >= 2:
            out["levene"], out["levene_p"] = T.levene(on, off)
            out["welch"] = bool(out["levene_p"] <= 0.05)
            out["t"], out["t_p"] = T.t_test(on, off, not out["welch"])
            out["u"], out["u_p"] = T.mann_whitney(on, off)
            out["ks"], out["ks_p"] = T.ks_two_sample(on, off)
            pooled = np.sqrt(((len(on) - 1) * on.var(ddof=1) + (len(off) - 1) * off.var(ddof=1)) / (len(on) + len(off) - 2))
            out["cohens_d"] = float((on.mean() - off.mean()) / pooled) if pooled else nan
            out["effect"] = T.effect_label(out["cohens_d"]) if pooled else None
        return pd.DataFrame([out]).astype({"group": object, "effect": object, "welch": object})

    return rows.select(F.col(group).cast("string"), value, flag).groupBy(group).applyInPandas(run, REPORT)


#: Rows of a block of permutation_test(), about.
BLOCK_ROWS = 500_000
#: The most blocks a table is cut into; what blocks report reaches the driver (numbers: blocks x permutations).
MOST_BLOCKS = 1000


def ranked_in_tests(by_value: DataFrame, task_rows: int = TASK_ROWS) -> DataFrame:
    """by_value (t, x, f, v) with the rank s by t, then x descending, then f and v.  More rows than a task ranks are dealt by the number of their test
    and their rank by value together, so that a large test is many ranges."""
    n = by_value.count()
    if n <= task_rows:
        return global_rank(by_value, "t", F.col("x").desc(), "f", "v", name="s", task_rows=task_rows)
    tests = global_rank(by_value.select("t").distinct(), "t", name="__test", task_rows=task_rows).withColumnRenamed("t", "__t")
    falling = global_rank(by_value, "x", "f", "v", name="__falling", descending=True, task_rows=task_rows)
    both = falling.join(tests, F.col("t").eqNullSafe(F.col("__t"))).drop("__t")
    both = stage(both.withColumn("__key", F.col("__test").cast("decimal(20,0)") * F.lit(n + 1) + F.col("__falling")), "falling")
    return global_rank(both, "__key", name="s", task_rows=task_rows).drop("__test", "__falling", "__key")


def permutation_test(rows: DataFrame, test: str, value: str, flag: str, permutations: int = 1000, seed: int = 42, block_rows: int = BLOCK_ROWS, task_rows: int = TASK_ROWS) -> DataFrame:
    """Do flagged rows score higher than chance would have it?  The flag is shuffled over all rows; the
    differences of means and medians are two-sided, U, mean reciprocal rank, average precision and KS one-sided.

    The table is ranked once by value and once by (test, value descending) and cut into blocks of consecutive ranks.  A
    permutation is a function of a row's rank, so each block knows its flags under every permutation without a shuffle of
    rows.  Sums add up over blocks; what needs an order (medians, KS, ranks within a test that spans blocks) takes the
    counts of the blocks before as its start, in a second pass.  No task holds more than a block."""
    base = rows.select(F.col(test).cast("string").alias("t"), F.col(value).cast("double").alias("x"), (F.col(flag).cast("int") == 1).alias("f"))
    by_value = stage(global_rank(stage(base, "permuted"), "x", "t", "f", name="v", task_rows=task_rows), "by-value")
    ranked = stage(ranked_in_tests(by_value, task_rows).withColumns({"v": F.col("v") - 1, "s": F.col("s") - 1}), "ranked")
    n, flagged = ranked.agg(F.count("*"), F.count_if("f")).first()
    schema = "id long, metric string, value double"
    if not flagged or flagged == n:
        return rows.sparkSession.createDataFrame([], "metric string, observed double, mean_permuted double, p double")
    size = max(block_rows, -(-n // MOST_BLOCKS))
    blocks = -(-n // size)
    parts = max(1, min(32 // blocks, permutations + 1))
    ids = [np.arange(permutations + 1)[p::parts] for p in range(parts)]

    def each(df: DataFrame, column: str, work, ddl: str) -> DataFrame:
        """work(block's number, its rows in order, permutation -> flags, numbers of permutations) for every block."""

        def run(pdf: pd.DataFrame) -> pd.DataFrame:
            pdf = pdf.sort_values(column)
            own, places = pdf["f"].to_numpy(dtype=bool), pdf["s"].to_numpy()
            return pd.DataFrame(work(int(pdf["block"].iloc[0]), pdf, lambda i: own if i == 0 else T.shuffled(places, n, seed * 1_000_003 + i) < flagged, ids[int(pdf["part"].iloc[0])].tolist()), columns=[c.split()[0] for c in ddl.split(", ")])

        dealt = df.withColumn("block", F.floor(F.col(column) / size)).withColumn("part", F.explode(F.array(*[F.lit(p) for p in range(parts)])))
        return dealt.groupBy("block", "part").applyInPandas(run, ddl)

    def table(found: DataFrame, name: str) -> np.ndarray:
        """[permutation, block] of a reported number."""
        out = np.zeros((permutations + 1, blocks))
        for batch in found.select("id", "block", name).toLocalIterator(prefetchPartitions=True):
            out[batch[0], batch[1]] = batch[2]
        return out

    # by value: sums of values and ranks, then medians and KS
    ties = ranked.groupBy("x").agg(F.min("v").alias("low"), F.max("v").alias("high"))
    values = stage(ranked.join(ties, "x"), "values")

    def sums(block, pdf, flags, some):
        x, rank = pdf["x"].to_numpy(), (pdf["low"].to_numpy() + pdf["high"].to_numpy()) / 2 + 1
        return [(i, block, float(on.sum()), x[on].sum(), rank[on].sum(), x.sum()) for i in some for on in [flags(i)]]

    first = stage(each(values, "v", sums, "id long, block long, on double, sum_x double, sum_rank double, all_x double"), "sums")
    on = table(first, "on")
    before = rows.sparkSession.sparkContext.broadcast(np.cumsum(on, axis=1) - on)
    middle = {"on": [(flagged - 1) // 2, flagged // 2], "off": [(n - flagged - 1) // 2, (n - flagged) // 2]}

    def orders(block, pdf, flags, some):
        x, ends, out = pdf["x"].to_numpy(), pdf["v"].to_numpy() == pdf["high"].to_numpy(), []
        for i in some:
            now = flags(i)
            start = {"on": before.value[i, block], "off": block * size - before.value[i, block]}
            gap = np.abs((start["on"] + np.cumsum(now)) / flagged - (start["off"] + np.cumsum(~now)) / (n - flagged))[ends]
            out.append((i, "ks", float(gap.max()) if len(gap) else 0.0))
            for side, mask in (("on", now), ("off", ~now)):
                held = x[mask]
                out += [(i, f"median_{side}", float(held[int(k - start[side])]) / 2) for k in middle[side] if 0 <= k - start[side] < len(held)]
        return out

    second = stage(each(values, "v", orders, schema), "orders")

    # by test: the flagged rows before a block in the test that goes on into it, then precision and reciprocal ranks
    starts = ranked.groupBy("t").agg(F.min("s").alias("start"), F.max("s").alias("end"))
    tests = stage(ranked.join(starts, "t"), "tests")

    def edges(block, pdf, flags, some):
        start = pdf["start"].to_numpy()
        last, whole = start == start[-1], float(start[0] == start[-1])
        goes = float(pdf["end"].iloc[-1] > pdf["s"].iloc[-1])
        return [(i, block, float(flags(i)[last].sum()) * goes, whole) for i in some]

    third = stage(each(tests, "s", edges, "id long, block long, tail double, whole double"), "edges")
    tail, whole = table(third, "tail"), table(third, "whole")
    carry = np.zeros_like(tail)
    for b in range(1, blocks):
        carry[:, b] = np.where(tail[:, b - 1] + whole[:, b - 1] > 0, tail[:, b - 1] + whole[:, b - 1] * carry[:, b - 1], 0)
    carried = rows.sparkSession.sparkContext.broadcast(carry)

    def precisions(block, pdf, flags, some):
        s, start, end = (pdf[c].to_numpy() for c in ("s", "start", "end"))
        rank, out = s - start + 1, []
        at = np.flatnonzero(np.r_[True, start[1:] != start[:-1]])
        inside = (start[at] >= s[0]) & (end[at] <= s[-1])
        for i in some:
            now = flags(i)
            count = np.add.reduceat(now.astype(float), at)
            held = np.cumsum(now) - np.repeat(np.cumsum(count) - count, np.diff(np.r_[at, len(s)]))
            held = held + np.where(start < s[0], carried.value[i, block], 0)
            precision = np.add.reduceat(np.where(now, held / rank, 0.0), at)
            best = np.maximum.reduceat(np.where(now, 1.0 / rank, 0.0), at)
            done = inside & (count > 0)
            out.append((i, -1, float(done.sum()), float((precision[done] / count[done]).sum()), float(best[done].sum())))
            out += [(i, int(start[at[j]]), float(count[j]), float(precision[j]), float(best[j])) for j in np.flatnonzero(~inside)]
        return out

    parts_of = stage(each(tests, "s", precisions, "id long, test long, hits double, precision double, best double"), "precisions")
    spanning = parts_of.filter("test >= 0").groupBy("id", "test").agg(F.sum("hits").alias("h"), F.sum("precision").alias("p"), F.max("best").alias("b")).filter("h > 0")
    whole_tests = parts_of.filter("test < 0").select("id", F.col("hits").alias("k"), "precision", "best")
    together = whole_tests.unionByName(spanning.select("id", F.lit(1.0).alias("k"), (F.col("p") / F.col("h")).alias("precision"), F.col("b").alias("best"))).groupBy("id").agg(*[F.sum(c).alias(c) for c in ("k", "precision", "best")])

    total = first.groupBy("id").agg(*[F.sum(c).alias(c) for c in ("sum_x", "sum_rank", "all_x")])
    medians = second.groupBy("id").pivot("metric", ["ks", "median_on", "median_off"]).agg(F.struct(F.max("value").alias("most"), F.sum("value").alias("sum")))
    wide = total.join(medians, "id").join(together, "id").select(
        "id",
        F.expr(
            f"""stack(6, 'mean_difference', sum_x / {flagged} - (all_x - sum_x) / {n - flagged}, 'median_difference', median_on.sum - median_off.sum,
            'mrr', best / k, 'map', precision / k, 'u', sum_rank - {flagged} * ({flagged} + 1D) / 2, 'ks', ks.most) AS (metric, value)"""
        ),
    )
    wide = stage(wide, "permutations")  # one row a permutation and metric
    observed = wide.filter("id = 0").select("metric", F.col("value").alias("observed"))
    two_sided = F.col("metric").endswith("difference")
    slack = 1e-9 * (1 + F.abs("observed"))  # sums of one multiset in different orders
    extreme = F.when(two_sided, F.abs("value") >= F.abs("observed") - slack).otherwise(F.col("value") >= F.col("observed") - slack)
    return wide.filter("id > 0").join(F.broadcast(observed), "metric").groupBy("metric").agg(F.max("observed").alias("observed"), F.avg("value").alias("mean_permuted"), (F.count_if(extreme) / F.count("*")).alias("p"))


def kde(rows: DataFrame, value: str, points: int = 500, digits: int = 9) -> DataFrame:
    """Gaussian kernel density on a grid from the least to the greatest value, by Scott's bandwidth.  Equal
    values are one kernel with a weight."""
    by = rows.groupBy(F.col(value).cast("double").alias("__v")).agg(F.count("*").alias("__w"))
    s = rows.agg(F.count(value).alias("__n"), F.stddev_samp(value).alias("__sd"), F.min(value).cast("double").alias("__lo"), F.max(value).cast("double").alias("__hi"))
    grid = rows.sparkSession.range(points).select(F.col("id").cast("int").alias("i")).join(s, F.lit(True))
    grid = grid.select("i", (F.col("__lo") + (F.col("__hi") - F.col("__lo")) * F.col("i") / float(points - 1)).alias("x"), "__n", (F.col("__sd") * F.pow(F.col("__n"), F.lit(-0.2))).alias("__h"))
    z = (F.col("x") - F.col("__v")) / F.col("__h")
    return by.join(F.broadcast(grid), F.lit(True)).groupBy("i", "x").agg((F.sum(F.col("__w") * F.exp(-0.5 * z * z)) / F.max(F.col("__n") * F.col("__h") * float(np.sqrt(2 * np.pi)))).alias("density")).select("i", F.round("x", digits).alias("x"), F.round("density", digits).alias("density"))
