"""Scores of candidate links from embeddings, link-prediction ranks, a convolutional scorer."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from kgspark.functions.scalars import dot, sigmoid
from kgspark.operators.blocks import STEP, first_k, inner, matrix, product, scored_tiles
from kgspark.operators.ranking import top_k


#: How scores of a left block's rows with the vectors of a right one are made.
Scores = Callable[[pa.Table, np.ndarray], np.ndarray]


def score_pairs(pairs: DataFrame, entities: DataFrame, digits: int = 6) -> DataFrame:
    """pairs (head, tail, ...) with score, the inner product of the embeddings (id, vector) of both ends."""
    h = entities.select(F.col("id").alias("head"), F.col("vector").alias("__h"))
    t = entities.select(F.col("id").alias("tail"), F.col("vector").alias("__t"))
    scored = pairs.join(h, "head").join(t, "tail").withColumn("score", F.round(dot("__h", "__t"), digits))
    return scored.withColumn("sigmoid_score", F.round(sigmoid("score"), digits)).drop("__h", "__t")


def all_scores(queries: DataFrame, entities: DataFrame, digits: int = 6) -> DataFrame:
    """query_id, tail, score for each query vector (query_id, vector) with each entity: the whole product, for what needs
    all scores; best_tails() gives the best ones without it.  The entities stay where they are, the queries are
    broadcast if there are no more than 10,000."""
    q = queries.select("query_id", F.col("vector").alias("__q"))
    e = entities.select(F.col("id").alias("tail"), F.col("vector").alias("__e"))
    side = F.broadcast(q) if q.count() <= 10_000 else q
    return e.join(side, F.lit(True)).select("query_id", "tail", F.round(dot("__q", "__e"), digits).alias("score"))


def best_tails(queries: DataFrame, entities: DataFrame, k: int = 10, digits: int = 6, known: DataFrame | None = None, scores: Scores = inner, **rows: int | str) -> DataFrame:
    """query_id, tail, score, rank: the k entities (id, vector) with the greatest score (inner product) with each query (query_id,
    vector), ties by id; without known pairs (query_id, tail), and without those of equal `group` if both tables have one.  In blocks: each
    pair of blocks reports k rows a query."""

    def fold(a: pa.Table, b: pa.Table, skip) -> pa.Table:
        ids, out = b["id"].to_numpy(), []
        for at, s in scored_tiles(a, b, skip, digits, scores):
            i, j = first_k(s, ids, k)
            out.append(pa.table({"query_id": a["id"].take(pa.array(at + i)).combine_chunks(), "tail": ids[j], "score": s[i, j]}))
        return pa.concat_tables(out)

    found = product(as_left(queries), entities, fold, "query_id long, tail long, score double", as_pairs(known), **rows)
    return top_k(found, ["query_id"], k, F.col("score").desc(), F.col("tail"))


def as_left(queries: DataFrame) -> DataFrame:
    return queries.withColumn("id", F.col("query_id").cast("long")).drop("query_id")


def as_pairs(known: DataFrame | None) -> DataFrame | None:
    return known if known is None else known.select(F.col("query_id").cast("long").alias("left_id"), F.col("tail").cast("long").alias("right_id")).distinct()


def count_ranks(queries: DataFrame, entities: DataFrame, truth: DataFrame, known: DataFrame | None = None, ties: str = "ordinal", digits: int = 6, scores: Scores = inner, **rows: int | str) -> DataFrame:
    """query_id, tail, score, rank: filtered rank of the true tails (truth: query_id, tail) of each query (query_id, vector) among
    the entities (id, vector), counted inside blocks: no pair leaves its task but for the true and the known ones.  Known pairs
    (query_id, tail), and entities of the query's `group` if both tables have one, don't count.  ordinal: 1 + better ones; pessimistic: equal ones are better.  With scores that
    aren't inner products, truth has the true tails' own (score)."""
    left = queries.join(truth.distinct(), "query_id")
    if "score" in truth.columns:
        left = left.withColumn("target", F.round("score", digits)).drop("score")
    else:
        left = left.join(entities.select(F.col("id").alias("tail"), F.col("vector").alias("__e")), "tail").withColumn("target", F.round(dot("vector", "__e"), digits)).drop("__e")

    def fold(a: pa.Table, b: pa.Table, skip) -> pa.Table:
        ids, tail, goal = b["id"].to_numpy(), a["tail"].to_numpy(), a["target"].to_numpy()
        ahead = np.zeros(len(a), dtype=np.int64)
        for at, s in scored_tiles(a, b, skip, digits, scores):
            t = goal[at : at + len(s), None]
            better = (s >= t) if ties == "pessimistic" else (s > t)
            ahead[at : at + len(s)] = (better & (ids[None] != tail[at : at + len(s), None])).sum(axis=1)
        return pa.table({"query_id": a["id"].combine_chunks(), "tail": tail, "ahead": ahead})

    counted = product(as_left(left), entities, fold, "query_id long, tail long, ahead long", as_pairs(known), **rows).groupBy("query_id", "tail").agg(F.sum("ahead").alias("__ahead"))
    return left.select(F.col("query_id"), "tail", F.col("target").alias("score")).join(counted, ["query_id", "tail"]).select("query_id", "tail", "score", (F.col("__ahead") + 1).alias("rank"))


def block_loss(queries: DataFrame, entities: DataFrame, truth: DataFrame, smoothing: float = 0.0, digits: int = 6, **rows: int) -> DataFrame:
    """bce_loss() over all entities as tails, from sums inside blocks: the scores of true tails (query_id, tail) are the only pairs
    made."""

    def fold(a: pa.Table, b: pa.Table, skip) -> pa.Table:
        soft, total = np.zeros(len(a)), np.zeros(len(a))
        for at, s in scored_tiles(a, b, skip, digits):
            soft[at : at + len(s)] = (np.maximum(s, 0) + np.log1p(np.exp(-np.abs(s)))).sum(axis=1)
            total[at : at + len(s)] = s.sum(axis=1)
        return pa.table({"query_id": a["id"].combine_chunks(), "soft": soft, "total": total, "n": np.full(len(a), len(b), dtype=np.int64)})

    sums = product(as_left(queries), entities, fold, "query_id long, soft double, total double, n long", **rows).groupBy("query_id").agg(F.sum("soft").alias("soft"), F.sum("total").alias("total"), F.sum("n").alias("n"))
    pairs = truth.distinct().join(queries.select("query_id", F.col("vector").alias("__q")), "query_id").join(entities.select(F.col("id").alias("tail"), F.col("vector").alias("__e")), "tail")
    true = pairs.groupBy("query_id").agg(F.sum(F.round(dot("__q", "__e"), digits)).alias("true"))
    labelled = (1.0 - smoothing) * F.coalesce("true", F.lit(0.0)) + smoothing * F.col("total") / F.col("n")
    return sums.join(true, "query_id", "left").select("query_id", F.round((F.col("soft") - labelled) / F.col("n"), digits).alias("loss"))


def rank_tails(scores: DataFrame, truth: DataFrame, known: DataFrame, ties: str = "ordinal") -> DataFrame:
    """Filtered rank of the true tail of each query: scores (query_id, tail, score), truth (query_id, tail),
    known (query_id, tail): other true tails, which don't count.  ordinal: 1 + better ones; pessimistic:
    equal ones count as better too."""
    target = scores.join(truth, ["query_id", "tail"]).select("query_id", F.col("tail").alias("__t"), F.col("score").alias("__s"))
    others = scores.join(known, ["query_id", "tail"], "left_anti").join(target, "query_id").filter(F.col("tail") != F.col("__t"))
    better = F.col("score") >= F.col("__s") if ties == "pessimistic" else F.col("score") > F.col("__s")
    ahead = others.groupBy("query_id").agg(F.count_if(better).alias("__ahead"))
    return target.join(ahead, "query_id", "left").select("query_id", F.col("__t").alias("tail"), F.col("__s").alias("score"), (F.coalesce("__ahead", F.lit(0)) + 1).alias("rank"))


def link_metrics(ranks: DataFrame, ks: tuple[int, ...] = (1, 3, 5, 10)) -> DataFrame:
    """One row: queries, mean and median rank, mean reciprocal rank, hits at each k."""
    hits = [F.round(F.avg((F.col("rank") <= k).cast("double")), 6).alias(f"hits_at_{k}") for k in ks]
    return ranks.agg(F.count("*").alias("queries"), F.round(F.avg("rank"), 6).alias("mean_rank"), F.round(F.median("rank"), 6).alias("median_rank"), F.round(F.avg(1.0 / F.col("rank")), 6).alias("mrr"), *hits)


def top_tails(scores: DataFrame, k: int = 10, known: DataFrame | None = None) -> DataFrame:
    """The k best tails of each query, without known ones."""
    if known is not None:
        scores = scores.join(known, ["query_id", "tail"], "left_anti")
    return top_k(scores, ["query_id"], k, F.col("score").desc(), F.col("tail"))


def bce_loss(scores: DataFrame, smoothing: float = 0.0, digits: int = 6) -> DataFrame:
    """Mean binary cross entropy of each query (query_id, tail, score, is_true) over all its tails, the labels
    smoothed by `smoothing`: sums of softplus(score) - label x score, so no label matrix exists."""
    x = F.col("score")
    softplus = F.greatest(x, F.lit(0.0)) + F.log1p(F.exp(-F.abs(x)))
    n = F.count("*")
    on, off = (1.0 - smoothing), smoothing
    label = F.when(F.col("is_true"), F.lit(on)).otherwise(F.lit(0.0)) + F.lit(off) / F.count("*").over(Window.partitionBy("query_id"))
    return scores.withColumn("__l", softplus - label * x).groupBy("query_id").agg(F.round(F.sum("__l") / n, digits).alias("loss"))


class ConvScorer:
    """Forward pass of a convolutional link predictor with given weights (a dict of numpy arrays):
    entities (E, d), relations (R, d), conv (C, 1, kh, kw), conv_bias (C), fc (F, d), fc_bias (d), and the scale and
    shift of the three normalisations bn0 (1), bn1 (C), bn2 (d)."""

    def __init__(self, weights: dict[str, np.ndarray], height: int, width: int):
        self.w, self.height, self.width = weights, height, width
        if height * width != weights["relations"].shape[1]:
            raise ValueError("height x width must be the embedding's dimension")

    def without_entities(self) -> ConvScorer:
        """What is sent to tasks where entities are a table: its size doesn't depend on their number."""
        return ConvScorer({k: v for k, v in self.w.items() if k != "entities"}, self.height, self.width)

    def norm(self, x: np.ndarray, name: str, axis: int) -> np.ndarray:
        shape = [1] * x.ndim
        shape[axis] = -1
        return x * self.w[f"{name}_scale"].reshape(shape) + self.w[f"{name}_shift"].reshape(shape)

    def hidden(self, head: np.ndarray, relation: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(input of the linear layer, its normalised output before the last ramp)."""
        return self.hidden_of(self.w["entities"][head], self.w["relations"][relation])

    def hidden_of(self, head: np.ndarray, relation: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The same from the vectors of head and relation."""
        image = np.concatenate([head.reshape(-1, 1, self.height, self.width), relation.reshape(-1, 1, self.height, self.width)], axis=3)
        image = self.norm(image, "bn0", 1)
        kernel = self.w["conv"]
        windows = np.lib.stride_tricks.sliding_window_view(image[:, 0], kernel.shape[2:], axis=(1, 2))
        maps = np.einsum("nijkl,ckl->ncij", windows, kernel[:, 0]) + self.w["conv_bias"][None, :, None, None]
        flat = np.maximum(self.norm(maps, "bn1", 1), 0).reshape(len(head), -1)
        return flat, self.norm(flat @ self.w["fc"] + self.w["fc_bias"], "bn2", 1)

    def score(self, head: np.ndarray, relation: np.ndarray, tail: np.ndarray) -> np.ndarray:
        return (np.maximum(self.hidden(head, relation)[1], 0) * self.w["entities"][tail]).sum(axis=1)

    def all_tails(self, head: np.ndarray, relation: np.ndarray) -> np.ndarray:
        return np.maximum(self.hidden(head, relation)[1], 0) @ self.w["entities"].T


def conv_scores(triples: DataFrame, scorer: ConvScorer) -> DataFrame:
    """triples (h, r, t) with score, in Arrow batches; the weights are broadcast once."""
    sent = triples.sparkSession.sparkContext.broadcast(scorer)

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in parts:
            yield p.assign(score=sent.value.score(p["h"].to_numpy(), p["r"].to_numpy(), p["t"].to_numpy()).astype(float))

    return triples.select("h", "r", "t").mapInPandas(run, "h long, r long, t long, score double")


def conv_features(triples: DataFrame, scorer: ConvScorer) -> DataFrame:
    """triples (h, r, t) with x and delta, the features of the closed-form influence of the linear layer."""
    sent = triples.sparkSession.sparkContext.broadcast(scorer)

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in parts:
            s = sent.value
            x, z = s.hidden(p["h"].to_numpy(), p["r"].to_numpy())
            tail = s.w["entities"][p["t"].to_numpy()]
            score = (np.maximum(z, 0) * tail).sum(axis=1)
            delta = (1 / (1 + np.exp(-score)) - 1)[:, None] * tail * (z > 0) * s.w["bn2_scale"]
            yield p.assign(x=list(x.astype(float)), delta=list(delta.astype(float)))

    return triples.select("h", "r", "t").mapInPandas(run, "h long, r long, t long, x array<double>, delta array<double>")


def conv_queries(queries: DataFrame, entities: DataFrame, scorer: ConvScorer) -> DataFrame:
    """query_id, vector for queries (query_id, h, r): the vector whose inner product with that of an entity (id, vector) is
    the convolutional score of (h, r, entity).  best_tails(), count_ranks() and block_loss() take it."""
    sent = queries.sparkSession.sparkContext.broadcast(scorer.without_entities())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            part = pa.Table.from_batches([batch])
            z = np.maximum(sent.value.hidden_of(matrix(part["vector"]), sent.value.w["relations"][part["r"].to_numpy()])[1], 0) if len(part) else np.zeros((0, 0))
            yield pa.RecordBatch.from_arrays([part["query_id"].combine_chunks(), pa.array(list(z), pa.list_(pa.float64()))], names=["query_id", "vector"])

    rows = queries.join(entities.select(F.col("id").alias("h"), "vector"), "h").select(F.col("query_id").cast("long").alias("query_id"), F.col("r").cast("int").alias("r"), "vector")
    return rows.mapInArrow(run, "query_id long, vector array<double>")


def conv_truth(queries: DataFrame, entities: DataFrame, scorer: ConvScorer, side: str = "tail") -> DataFrame:
    """query_id, tail, score of the true answers of queries (query_id, h, r, t): t for side tail; h, as `tail`, for side head."""
    vectors = conv_queries(queries, entities, scorer).join(queries.select("query_id", "h", "t"), "query_id")
    found = vectors.join(entities.select(F.col("id").alias("t"), F.col("vector").alias("__e")), "t")
    return found.select("query_id", F.col("t" if side == "tail" else "h").alias("tail"), dot("vector", "__e").alias("score"))


def head_scores(scorer: ConvScorer) -> Scores:
    """Convolutional scores of every entity as the head of (r, t): left rows have r and the vector of t.  The forward pass of a
    block of heads runs inside the task, and the last relation's is kept: once for a pair of blocks if the left rows of a block share
    their relation (by="r")."""
    layers = scorer.without_entities()
    last: dict = {"heads": None, "r": None, "z": None}

    def forward(heads: np.ndarray, r: int) -> np.ndarray:
        if last["heads"] is not heads or last["r"] != r:
            parts = (heads[at : at + STEP] for at in range(0, len(heads), STEP))
            z = np.concatenate([np.maximum(layers.hidden_of(x, np.broadcast_to(layers.w["relations"][r], x.shape))[1], 0) for x in parts])
            last.update(heads=heads, r=r, z=z)
        return last["z"]

    def scores(a: pa.Table, heads: np.ndarray) -> np.ndarray:
        relation, tails = a["r"].to_numpy(), matrix(a["vector"])
        out = np.empty((len(a), len(heads)))
        for r in np.unique(relation):
            out[relation == r] = tails[relation == r] @ forward(heads, r).T
        return out

    return scores


def head_queries(queries: DataFrame, entities: DataFrame) -> DataFrame:
    """query_id, r, vector for queries (query_id, r, t), as head_scores() takes them."""
    return queries.join(entities.select(F.col("id").alias("t"), "vector"), "t").select(F.col("query_id").cast("long").alias("query_id"), F.col("r").cast("int").alias("r"), "vector")
