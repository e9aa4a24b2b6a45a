import numpy as np
import pytest
from kgspark.operators import gradients, influence, score, training
from kgspark.operators.score import ConvScorer
from pyspark.sql import functions as F

HEIGHT, WIDTH, CHANNELS, ENTITIES, RELATIONS = 2, 3, 2, 12, 3


@pytest.fixture(scope="module")
def weights():
    w = training.initial_weights(ENTITIES, RELATIONS, HEIGHT, WIDTH, channels=CHANNELS, seed=1)
    rng = np.random.default_rng(2)
    return {k: w[k] + rng.normal(0, 0.4, w[k].shape) for k in w}


@pytest.fixture(scope="module")
def scorer(weights):
    return ConvScorer(weights, HEIGHT, WIDTH)


@pytest.fixture(scope="module")
def entities(spark, weights):
    return spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(weights["entities"])], "id long, vector array<double>")


def triples(seed, n, first=0):
    rng = np.random.default_rng(seed)
    return [(first + i, int(h), int(r), int(t)) for i, (h, r, t) in enumerate(zip(rng.integers(0, ENTITIES, n), rng.integers(0, RELATIONS, n), rng.integers(0, ENTITIES, n)))]


def by_differences(weights, h, r, t, layers):
    """The whole gradient of one triple's loss over the layers, from differences."""
    out = []
    for name in layers:
        g = np.zeros_like(weights[name])
        for at in np.ndindex(g.shape):
            losses = []
            for step in (1e-5, -1e-5):
                changed = weights | {name: weights[name].copy()}
                changed[name][at] += step
                s = ConvScorer(changed, HEIGHT, WIDTH).score(np.array([h]), np.array([r]), np.array([t]))[0]
                losses.append(np.log1p(np.exp(-s)))
            g[at] = (losses[0] - losses[1]) / 2e-5
        out.append(g.ravel())
    return np.concatenate(out)


@pytest.mark.parametrize("layers", [gradients.LAYERS, gradients.last_layers(), gradients.last_layers(5), ("conv", "entities"), ("relations",)])
def test_influence_equals_differences(spark, weights, scorer, entities, layers):
    a, b = [*triples(3, 3), (3, 5, 1, 5)], [*triples(4, 4, 100), (104, 5, 1, 5), (105, 2, 0, 5)]
    ddl = "id long, h long, r long, t long"
    test, train = (gradients.gradients(spark.createDataFrame(x, ddl), entities, scorer, layers) for x in (a, b))
    got = {(r["test_id"], r["train_id"]): r["influence"] for r in influence.best_influences(test, train, 6, rate=1.0, digits=12, left_rows=2, right_rows=3).collect()}
    assert len(got) == 24
    ga, gb = ({i: by_differences(weights, h, r, t, layers) for i, h, r, t in x} for x in (a, b))
    for (i, j), value in got.items():
        assert value == pytest.approx(float(ga[i] @ gb[j]), abs=1e-6)
    for r in test.collect():
        assert r["norm"] == pytest.approx(float(np.linalg.norm(ga[r["id"]])), abs=1e-6)


def test_last_layers():
    assert gradients.last_layers(2) == gradients.last_layers(1) == ("fc", "fc_bias")
    assert gradients.last_layers(4) == ("bn1_scale", "bn1_shift", "fc", "fc_bias")
    assert gradients.last_layers(99)[0] == "bn0_scale" and "entities" not in gradients.last_layers(99)
    with pytest.raises(ValueError):
        gradients.check(("fc", "nothing"))


def test_sketches_keep_inner_products(weights, scorer):
    rows = triples(5, 40)
    h, r, t = (np.array([x[i] for x in rows]) for i in (1, 2, 3))
    found = gradients.row_gradients(scorer, weights["entities"][h], weights["relations"][r], weights["entities"][t])
    exact = np.stack([by_differences(weights, *x[1:], gradients.LAYERS) for x in rows[:8]])
    exact = exact @ exact.T
    mean = np.mean([(s := gradients.sketch(found, h, r, t, gradients.LAYERS, 64, seed)[:8]) @ s.T for seed in range(200)], axis=0)
    assert np.abs(mean - exact).max() < 0.1 * np.abs(exact).max()


def test_strongest_of_blocks_and_pruning(spark):
    """Rows of very different lengths: the same ten as all products give, signed and not, ties by id."""
    rng = np.random.default_rng(6)
    rows = [(i, (rng.normal(size=4) * 10.0 ** rng.integers(-3, 2)).tolist(), rng.normal(size=3).tolist()) for i in range(3000)] + [(3000 + i, [1.0] * 4, [2.0] * 3) for i in range(20)]
    df = spark.createDataFrame(rows, "train_id long, x array<double>, delta array<double>")
    index = influence.indexed(df, "train_id")
    test = index.filter("id % 500 = 0")
    d, x = np.array([r[2] for r in rows]), np.array([r[1] for r in rows])
    own = np.arange(0, len(rows), 500)
    every = np.round(0.001 * (d[own] @ d.T) * (1 + x[own] @ x.T), 9)
    for signed in (False, True):
        got = influence.best_influences(test, index, 10, signed=signed, left_rows=3, right_rows=1700).collect()
        for row, i in enumerate(own.tolist()):
            order = np.lexsort((np.arange(len(rows)), -(every[row] if signed else np.abs(every[row]))))[:10]
            assert [(r["train_id"], r["influence"]) for r in sorted((r for r in got if r["test_id"] == i), key=lambda r: r["rank"])] == [(int(j), pytest.approx(float(every[row, j]), abs=2e-9)) for j in order]


def test_ranks_of_tails_and_heads(spark, weights, scorer, entities):
    """Filtered ranks and best answers of the convolutional model on both sides, against all scores."""
    rows = triples(7, 25)
    df = spark.createDataFrame(rows, "query_id long, h long, r long, t long")
    every = np.array([[scorer.score(np.full(ENTITIES, h), np.full(ENTITIES, r), np.arange(ENTITIES)) for r in range(RELATIONS)] for h in range(ENTITIES)]).round(6)
    sizes = {"left_rows": 4, "right_rows": 5}
    for side in ("tail", "head"):
        known = [(q, (q * 7 + j) % ENTITIES) for q, *_ in rows for j in range(3)]
        known_df = spark.createDataFrame(known, "query_id long, tail long")
        truth = score.conv_truth(df, entities, scorer, side)
        left, options = (score.conv_queries(df, entities, scorer), {}) if side == "tail" else (score.head_queries(df, entities), {"scores": score.head_scores(scorer)})
        for ties in ("ordinal", "pessimistic"):
            got = {r["query_id"]: r for r in score.count_ranks(left, entities, truth, known_df, ties, **options, **sizes).collect()}
            for q, h, r, t in rows:
                line, own = (every[h, r], t) if side == "tail" else (every[:, r, t], h)
                out = {e for i, e in known if i == q} | {own}
                ahead = sum((line[e] >= line[own] if ties == "pessimistic" else line[e] > line[own]) for e in range(ENTITIES) if e not in out)
                assert (got[q]["tail"], got[q]["rank"]) == (own, 1 + ahead) and got[q]["score"] == pytest.approx(line[own], abs=2e-6)
        best = score.best_tails(left, entities, 3, known=known_df, **options, **sizes).collect()
        for q, h, r, t in rows:
            line = every[h, r] if side == "tail" else every[:, r, t]
            open_ = [e for e in range(ENTITIES) if (q, e) not in set(known)]
            want = sorted(open_, key=lambda e: (-line[e], e))[:3]
            assert [x["tail"] for x in sorted((x for x in best if x["query_id"] == q), key=lambda x: x["rank"])] == want


def test_block_plans_have_no_nested_loop(spark, entities):
    q = entities.select(F.col("id").alias("query_id"), "vector")
    truth = q.select("query_id", F.col("query_id").alias("tail"))
    for df in (score.count_ranks(q, entities, truth, truth), score.best_tails(q, entities, known=truth), score.block_loss(q, entities, truth, 0.1)):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_block_loss(spark, weights, entities):
    q = entities.filter("id < 5").select(F.col("id").alias("query_id"), "vector")
    truth = spark.createDataFrame([(0, 3), (0, 4), (2, 2)], "query_id long, tail long")
    got = {r["query_id"]: r["loss"] for r in score.block_loss(q, entities, truth, 0.1, left_rows=2, right_rows=5).collect()}
    e = weights["entities"]
    for i in range(5):
        s = (e[i] @ e.T).round(6)
        y = np.array([0.9 * ((i, j) in {(0, 3), (0, 4), (2, 2)}) + 0.1 / ENTITIES for j in range(ENTITIES)])
        assert got[i] == pytest.approx(float(np.mean(np.maximum(s, 0) + np.log1p(np.exp(-np.abs(s))) - y * s)), abs=2e-6)


@pytest.mark.parametrize("name", ["filtered_rank", "pessimistic_rank", "link_metrics", "topk_tails", "bce_loss", "influence_topk", "influence_topk_signed", "conv_tail_ranks", "conv_head_ranks", "layer_influence_all"])
def test_query_plans_make_no_pairs(spark, name):
    from kgspark.plans.queries import QUERIES

    plan = QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "NestedLoop" not in plan


def test_layer_queries_against_the_whole_gradients(spark):
    """The registered queries on the smallest table, held against all products of gradients made one after another."""
    from kgspark.plans import queries

    e = spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"), "label")
    links = sorted((r["id"], r["h"], r["r"], r["t"]) for r in queries.labelled_links(e).collect())
    vectors = {r["id"]: np.array(r["vector"], dtype=float) for r in e.collect()}
    scorer = queries.conv_model()
    test, train = [x for x in links if x[2] == 0], [x for x in links if x[2] != 0]

    def whole(rows, layers):
        found = gradients.row_gradients(scorer, np.stack([vectors[x[1]] for x in rows]), scorer.w["relations"][[x[2] for x in rows]], np.stack([vectors[x[3]] for x in rows]))
        return np.concatenate([found["x"][:, :, None] * found["delta"][:, None] if x == "fc" else found[x][:, None] for x in layers if x not in gradients.EMBEDDINGS], axis=1).reshape(len(rows), -1)

    a, b = (whole(rows, gradients.last_layers()[::-1][:1]) for rows in (test, train))  # the bias; the weights as factors
    fa, fb = (gradients.row_gradients(scorer, np.stack([vectors[x[1]] for x in rows]), scorer.w["relations"][[x[2] for x in rows]], np.stack([vectors[x[3]] for x in rows])) for rows in (test, train))
    every = np.round(0.001 * (a @ b.T + (fa["delta"] @ fb["delta"].T) * (fa["x"] @ fb["x"].T)), 9)
    got = queries.QUERIES["layer_influence_last"](spark, "/root/testdata/sf0.001").collect()
    assert len(got) == 10 * len(test)
    best = {}
    for r in got:
        best.setdefault(r["test_id"], []).append((r["rank"], r["influence"]))
    for i, x in enumerate(test):
        want = sorted(np.abs(every[i]), reverse=True)[:10]
        assert [abs(v) for _, v in sorted(best[x[0]])] == pytest.approx(want, abs=2e-9)


def test_a_block_of_heads_runs_forward_once(scorer, weights, monkeypatch):
    """The rows of a left block share their relation, and all their tiles share one forward pass of the heads."""
    import pyarrow as pa

    seen = []
    plain = ConvScorer.hidden_of
    monkeypatch.setattr(ConvScorer, "hidden_of", lambda self, h, r: (seen.append(len(h)), plain(self, h, r))[1])
    scores, heads = score.head_scores(scorer), weights["entities"].copy()
    tiles = [pa.table({"r": [1, 1], "vector": weights["entities"][at : at + 2].tolist()}) for at in range(0, 6, 2)]
    found = np.concatenate([scores(t, heads) for t in tiles])
    assert sum(seen) == len(heads)
    want = [scorer.score(np.arange(ENTITIES), np.full(ENTITIES, 1), np.full(ENTITIES, t)) for t in range(6)]
    assert np.allclose(found, want)


def test_head_ranks_in_blocks_of_one_relation(spark, scorer, entities):
    df = spark.createDataFrame(triples(9, 40), "query_id long, h long, r long, t long")
    known = df.select("query_id", F.pmod(F.col("query_id") * 5, F.lit(ENTITIES)).alias("tail"))
    truth, left = score.conv_truth(df, entities, scorer, "head"), score.head_queries(df, entities)
    ranks = [sorted(tuple(x) for x in score.count_ranks(left, entities, truth, known, scores=score.head_scores(scorer), left_rows=4, right_rows=5, **by).collect()) for by in ({}, {"by": "r"})]
    assert len(ranks[0]) == 40 and ranks[0] == ranks[1]


def test_whole_product_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(influence, "TEST_ROWS", 4, raising=False)
    monkeypatch.setattr(influence, "TRAIN_ROWS", 3, raising=False)
    rng = np.random.default_rng(5)
    rows = [(i, rng.normal(size=3).tolist(), rng.normal(size=2).tolist()) for i in range(40)]
    # no vector, a null component, another length, no influence at all, and rows that are alike
    rows += [(40, None, [1.0, 2.0]), (41, [1.0, None, 2.0], [1.0, 2.0]), (42, [1.0, 2.0], [1.0, 2.0]), (43, [0.0] * 3, [-0.0] * 2), (44, *rows[0][1:]), (45, *rows[0][1:])]
    e = spark.createDataFrame(rows, "id int, x array<float>, delta array<double>").coalesce(1)
    test = e.filter("id % 3 = 0 OR id > 39").select(e["id"].alias("test_id"), "x", "delta")
    train = e.select(e["id"].cast("string").alias("train_id"), "x", "delta")
    found = influence.influences(test, train)
    assert found.schema.simpleString() == "struct<test_id:int,train_id:string,influence:double>"
    assert found.rdd.getNumPartitions() > 4  # it was as many as the training table has
    pair = train.withColumnsRenamed({"x": "__x", "delta": "__d"}).crossJoin(test)
    want = {(r["test_id"], r["train_id"]): r["v"] for r in pair.select("test_id", "train_id", influence.influence_of("__x", "__d", "x", "delta").alias("v")).collect()}
    got = {(r["test_id"], r["train_id"]): r["influence"] for r in found.collect()}
    assert got.keys() == want.keys() and {k for k, v in got.items() if v is None} == {k for k, v in want.items() if v is None} != set()
    assert all(got[k] == pytest.approx(v, abs=6e-10) for k, v in want.items() if v is not None)


@pytest.mark.parametrize("layers", [gradients.LAYERS, gradients.last_layers(), ("relations",)])
def test_gradients_made_where_they_are_used(spark, scorer, entities, layers):
    ddl = "id long, h long, r long, t long"
    a, b = spark.createDataFrame(triples(3, 5), ddl), spark.createDataFrame(triples(4, 7, 100), ddl)
    sizes = {"left_rows": 2, "right_rows": 3}
    want = influence.best_influences(*(gradients.gradients(x, entities, scorer, layers) for x in (a, b)), 4, **sizes)
    got = influence.best_influences(*(gradients.inputs_of(x, entities) for x in (a, b)), 4, late=gradients.late_gradients(a, scorer, layers), **sizes)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect())) and want.count() == 20


def test_layer_influence_sends_vectors_and_no_gradients(spark):
    from kgspark.plans.queries import QUERIES

    sent = QUERIES["layer_influence_all"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert "FlatMapCoGroupsInArrow" in sent and "grad_" not in sent and "MapInArrow" not in sent
