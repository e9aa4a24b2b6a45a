"""Operators on small graphs with known answers, readers and writers on small files."""

import json
import math

import numpy as np
import pytest
from kgspark.functions import scalars
from kgspark.functions import two_sample as tests
from kgspark.operators import annotate, encode, graph, influence, joins, metrics, ranking, score, splits, stats
from kgspark.sources import readers, writers
from pyspark.sql import functions as F

#: Two islands: a ladder between k0 and m0 with a dead end at each rung, and a pair with one way between its ends.
LADDER = [("k0", "binds", "p1"), ("p1", "binds", "p2"), ("p2", "binds", "m0"), ("k0", "blocks", "q1"), ("q1", "blocks", "p2"), ("p1", "near", "x1"), ("x1", "near", "x2"), ("p2", "near", "y1")]
ISLAND = [("k9", "binds", "r9"), ("r9", "raises", "m9"), ("z1", "like", "z2")]


@pytest.fixture(scope="module")
def triples(spark):
    return spark.createDataFrame([*LADDER, *ISLAND], "head string, relation string, tail string").persist()


def pairs_under_test(spark, *rows):
    return spark.createDataFrame(rows, "test_id string, head string, relation string, tail string")


def ends(df):
    return sorted((r["head"], r["tail"]) for r in df.collect())


def test_edge_filter_of_two_islands(spark, triples):
    t = pairs_under_test(spark, ("near", "k0", "binds", "m0"), ("far", "k9", "binds", "m9"))
    for engine in ("pyg", "networkx", "igraph"):
        kept = graph.edge_filter(triples, t, n_hops=2, engine=engine)
        assert ends(kept.filter("test_id = 'far'")) == [("k9", "r9"), ("r9", "m9")]
        ladder = ends(kept.filter("test_id = 'near'"))
        assert ("p1", "p2") in ladder and not set(ladder) & {("z1", "z2"), ("k9", "r9"), ("x1", "x2")}


@pytest.mark.parametrize("engine", ["pyg", "networkx", "igraph"])
def test_path_filter_keeps_the_way(spark, triples, engine):
    t = pairs_under_test(spark, ("near", "k0", "binds", "m0"))
    kept = ends(graph.edge_filter(triples, t, n_hops=3, engine=engine, path_filter=True, max_length=3))
    ways = {(a, b) for a, _, b in LADDER[:5]}
    assert set(kept) >= ways
    if engine != "pyg":
        assert set(kept) == ways


def test_hops_of_a_chain(spark):
    chain = spark.createDataFrame([(str(i), "r", str(i + 1)) for i in range(4)], "head string, relation string, tail string")
    t = pairs_under_test(spark, ("x", "0", "r", "1"))
    assert set(ends(graph.edge_filter(chain, t, n_hops=1))) == {("0", "1")}
    seeds = spark.createDataFrame([("x", "0")], "test_id string, node string")
    got = {r["node"]: r["hops"] for r in graph.hop_distances(graph.undirected(chain), seeds, 3).collect()}
    assert got == {"0": 0, "1": 1, "2": 2, "3": 3}


def test_simple_paths_and_cycles(spark):
    rows = [("a", "b"), ("b", "c"), ("a", "d"), ("d", "c"), ("b", "d"), ("c", "e")]
    t = spark.createDataFrame([(x, "r", y) for x, y in rows], "head string, relation string, tail string")
    got = lambda **o: sorted("".join(r["nodes"]) for r in graph.simple_paths(t, pairs_under_test(spark, ("x", "a", "r", "c")), 3, **o).collect())
    assert got() == ["abc", "abdc", "adbc", "adc"]
    assert got(directed=True) == ["abc", "abdc", "adc"]


def test_parallel_and_loop_edges(spark):
    t = spark.createDataFrame([("a", "r", "b"), ("a", "s", "b"), ("b", "r", "a"), ("a", "r", "a")], "head string, relation string, tail string")
    assert graph.one_triple_per_edge(t, F.col("relation")).count() == 2
    assert graph.edge_filter(t, pairs_under_test(spark, ("x", "a", "r", "b")), n_hops=1).count() == 4


def test_path_scores(spark):
    df = spark.createDataFrame([(1, [1.0, 2.0, 4.0]), (2, [-1.0, 2.0]), (3, [-1.0, -2.0]), (4, [0.0, 2.0]), (5, [])], "id int, s array<double>")
    got = {r["id"]: r for r in df.withColumns(scalars.path_scores("s")).collect()}
    assert math.isclose(got[1]["score_geometric_mean"], 2) and math.isclose(got[1]["score_harmonic_mean"], 3 / 1.75)
    assert got[2]["score_geometric_mean"] < 0 < got[2]["score_harmonic_mean"]
    assert got[3]["score_geometric_mean"] > 0 > got[3]["score_harmonic_mean"]
    assert got[4]["score_geometric_mean"] == got[4]["score_harmonic_mean"] == 0
    assert got[5]["score_mean"] == got[5]["score_sum"] == 0


def test_lists_in_text(spark):
    rows = ["[A:1, B:22, C.D:333, E:4]", "[only:1]", "[]", "[a(1, 2), b]", "[not closed", None, ""]
    df = spark.createDataFrame([(i, r) for i, r in enumerate(rows)], "i int, s string").select("i", F.size(scalars.parse_list("s")).alias("n"))
    assert [r["n"] for r in df.orderBy("i").collect()] == [4, 1, 0, 3, 0, 0, 0]


def test_relations_and_types(spark):
    df = spark.createDataFrame([('{"predicate": "biolink:treats", "x": ""}',), ("predicate:27",), ('{"x": 1}',)], "r string").select(scalars.predicate_of("r").alias("p"))
    assert [r["p"] for r in df.collect()] == ["biolink:treats", "predicate:27", '{"x": 1}']
    c = spark.createDataFrame([("CHEBI:1",), ("hgnc:2",), ("XYZ:3",), ("none",)], "c string").select(scalars.entity_type("c").alias("t"))
    assert [r["t"] for r in c.collect()] == ["C", "G", "XY", "Unknown"]
    names = spark.createDataFrame([("a/b/run_tracin_with_gt.csv", "X:1/y z")], "f string, s string")
    assert tuple(names.select(scalars.base_name("f"), scalars.sanitize_name("s")).first()) == ("run", "X_1_y_z")


def test_mrr_example(spark):
    rows = [(g, 10.0 - i, int(i + 1 == first)) for g, first in enumerate([3, 1, 5]) for i in range(6)]
    got = metrics.mrr_map(spark.createDataFrame(rows, "g int, s double, f int"), ["g"], "s", "f").first()
    assert got["mrr"] == pytest.approx(0.5111, abs=1e-4) and got["coverage"] == 1


def test_group_sample_keeps_groups_whole(spark):
    rows = [(f"h{i}", "r", f"t{i}") for i in range(50)] + [(f"m{i % 5}", "r", f"u{i}") for i in range(20)]
    c = splits.categorize(spark.createDataFrame(rows, "head string, relation string, tail string")).persist()
    kinds = {r["category"]: r["count"] for r in c.groupBy("category").count().collect()}
    assert kinds == {"one_to_one": 50, "one_to_many": 20}
    picked = splits.group_sample(c, {"one_to_one": 0.1, "one_to_many": 0.1})
    sizes = {r["group"]: r["count"] for r in picked.filter("category = 'one_to_many'").groupBy("group").count().collect()}
    assert sum(sizes.values()) in (4, 8) and set(sizes.values()) == {4}
    assert picked.filter("category = 'one_to_one'").count() == 7


def test_compat_names(spark):
    t = spark.createDataFrame([("a", "r", "x"), ("a", "r", "y")], "head string, relation string, tail string")
    assert {r["category"] for r in splits.categorize(t, compat=True).collect()} == {"many_to_one"}


def test_global_rank_over_ranges(spark):
    df = spark.range(1000).select((F.col("id") * 37 % 500).alias("k"), "id").unionByName(spark.createDataFrame([(None, -1)], "k long, id long"))
    for descending in (False, True):
        got = ranking.global_rank(df, "k", "id", descending=descending, task_rows=100).orderBy("rank").collect()
        assert [r["rank"] for r in got] == list(range(1, 1002))
        keys = [r["k"] for r in got if r["k"] is not None]
        assert keys == sorted(keys, reverse=descending)


def test_global_rank_over_ranges_by_any_name(spark):
    """The name that dictionaries, splits and samples give the rank (__n) is no helper column's."""
    df = spark.range(300).select(F.concat(F.lit("k"), F.col("id")).alias("label"))
    for name in ("__n", "__before", "rank"):
        got = ranking.global_rank(df, "label", name=name, task_rows=50).collect()
        assert [r["label"] for r in sorted(got, key=lambda r: r[name])] == sorted(f"k{i}" for i in range(300))
        assert {r[name] for r in got} == set(range(1, 301))


def test_exact_mean(spark):
    """Ten times 0.1 are 1, in any order of rows, and nulls don't count."""
    rows = spark.createDataFrame([(0.1,)] * 10 + [(None,)], "x double").coalesce(1)
    assert rows.agg(metrics.exact_mean("x")).first()[0] == 0.1


def test_running_sums_over_ranges(spark):
    rng = np.random.default_rng(3)
    keys = rng.permutation(700).tolist()
    df = spark.createDataFrame([(k, k % 7) for k in keys], "k long, v long")
    for descending in (False, True):
        got = ranking.running_sums(df, "k", {"v": "s"}, descending=descending, task_rows=60).collect()
        for r in got:
            assert r["s"] == sum(k % 7 for k in range(700) if (k >= r["k"] if descending else k <= r["k"])) and r["s_total"] == sum(k % 7 for k in range(700))


def test_influence_is_the_gradients_product(spark):
    """Against finite differences of the loss of one linear layer."""
    rng = np.random.default_rng(0)
    w, b = rng.normal(size=(6, 4)), rng.normal(size=4)

    def loss(w, b, x, e):
        return math.log1p(math.exp(-float(np.maximum(x @ w + b, 0) @ e)))

    def grad(x, e, h=1e-6):
        g = []
        for p, at in [(w, i) for i in np.ndindex(w.shape)] + [(b, i) for i in np.ndindex(b.shape)]:
            old = p[at]
            p[at] = old + h
            up = loss(w, b, x, e)
            p[at] = old - h
            g.append((up - loss(w, b, x, e)) / (2 * h))
            p[at] = old
        return np.array(g)

    rows, grads = [], []
    for i in range(3):
        x, e = rng.normal(size=6), rng.normal(size=4)
        z = x @ w + b
        s = np.maximum(z, 0) @ e
        delta = (1 / (1 + math.exp(-s)) - 1) * e * (z > 0)
        rows.append((i, x.tolist(), delta.tolist()))
        grads.append(grad(x, e))
    df = spark.createDataFrame(rows, "id int, x array<double>, delta array<double>")
    got = influence.influences(df.withColumnRenamed("id", "test_id"), df.withColumnRenamed("id", "train_id"), rate=1.0).collect()
    for r in got:
        assert r["influence"] == pytest.approx(float(grads[r["test_id"]] @ grads[r["train_id"]]), abs=1e-5)
    own = {r["train_id"]: r["self_influence"] for r in influence.self_influence(df.withColumnRenamed("id", "train_id"), rate=1.0).collect()}
    assert own[0] == pytest.approx(float(grads[0] @ grads[0]), abs=1e-5)


def test_projection_keeps_lengths(spark):
    df = spark.createDataFrame([(1, [1.0] * 64)], "id int, x array<double>")
    v = np.array(influence.project(df, "x", 256).first()["x"])
    assert v @ v == pytest.approx(64, rel=0.4)


def conv_weights():
    rng = np.random.default_rng(4)
    w = {"entities": rng.normal(size=(9, 6)), "relations": rng.normal(size=(3, 6)), "conv": rng.normal(size=(2, 1, 2, 2)), "conv_bias": rng.normal(size=2)}
    return w | {"fc": rng.normal(size=(2 * 1 * 5, 6)), "fc_bias": rng.normal(size=6)} | {f"{n}_{k}": rng.normal(size=s) for n, s in (("bn0", 1), ("bn1", 2), ("bn2", 6)) for k in ("scale", "shift")}


def test_conv_scorer(spark):
    w = conv_weights()
    scorer = score.ConvScorer(w, 2, 3)
    h, r, t = np.array([0, 4]), np.array([1, 2]), np.array([3, 8])
    # one score by loops
    image = np.concatenate([w["entities"][0].reshape(2, 3), w["relations"][1].reshape(2, 3)], axis=1) * w["bn0_scale"] + w["bn0_shift"]
    maps = [[max(((image[0:2, j : j + 2] * w["conv"][c, 0]).sum() + w["conv_bias"][c]) * w["bn1_scale"][c] + w["bn1_shift"][c], 0) for j in range(5)] for c in range(2)]
    z = np.concatenate(maps) @ w["fc"] + w["fc_bias"]
    want = np.maximum(z * w["bn2_scale"] + w["bn2_shift"], 0) @ w["entities"][3]
    assert scorer.score(h, r, t)[0] == pytest.approx(want)
    assert scorer.all_tails(h, r)[1, 8] == pytest.approx(scorer.score(h, r, t)[1])
    df = spark.createDataFrame([(0, 1, 3), (4, 2, 8)], "h long, r long, t long")
    assert [x["score"] for x in score.conv_scores(df, scorer).orderBy("h").collect()] == pytest.approx(scorer.score(h, r, t).tolist())
    assert score.conv_features(df, scorer).count() == 2
    with pytest.raises(ValueError):
        score.ConvScorer(w, 2, 2)


def test_annotation(spark):
    rows = [("D", "X", "D", "r", "m1"), ("D", "X", "m2", "r", "m1"), ("D", "X", "D", "r", "m2"), ("E", "X", "D", "r", "m1")]
    df = spark.createDataFrame(rows, "TestHead string, TestTail string, TrainHead string, TrainRel_label string, TrainTail string")
    paths = spark.createDataFrame([("D", "X", ["zz"], 0), ("D", "X", ["m1", "m2"], 1)], "drug string, disease string, nodes array<string>, pos int")
    got = {(r["TestHead"], r["TrainHead"], r["TrainTail"]): (r["In_path"], r["On_specific_path"]) for r in annotate.path_flags(df, annotate.paths_of_pairs(paths)).collect()}
    assert got == {("D", "D", "m1"): (1, 1), ("D", "m2", "m1"): (1, 1), ("D", "D", "m2"): (1, 0), ("E", "D", "m1"): (0, 0)}
    truth = spark.createDataFrame([("D", "r", "m1"), ("m1", "r", "m2")], "subject string, predicate string, object string")
    assert {(r["TrainHead"], r["TrainTail"]): r["IsGroundTruth"] for r in annotate.is_ground_truth(df, truth).collect()} == {("D", "m1"): 1, ("m2", "m1"): 0, ("D", "m2"): 0}


def test_readers_and_writers(spark, tmp_path):
    (tmp_path / "t.tsv").write_text("a\tr\tb\nbad line\na\tr\tb\nc\tr\td\textra\n")
    assert readers.triples(spark, str(tmp_path / "t.tsv")).count() == 2 and readers.triples(spark, str(tmp_path / "t.tsv"), exact=False).count() == 3
    (tmp_path / "e.jsonl").write_text('{"subject": "C:1", "predicate": "p", "object": "P:1", "affinity": 6.5}\nnot json\n{"subject": "C:2", "predicate": "p", "object": "P:2", "object_aspect_qualifier": "x"}\n')
    e = readers.edges(spark, str(tmp_path / "e.jsonl"))
    assert e.count() == 2 and readers.corrupt_lines(spark, str(tmp_path / "e.jsonl")).count() == 1
    mapping = encode.edge_map(e)
    text = writers.edge_map_text(encode.edge_map_json(mapping))
    keys = list(json.loads(text))
    assert json.loads(keys[0])["predicate"] == "p" and json.loads(text)[keys[0]] == "predicate:0"
    assert keys[0] == json.dumps(json.loads(keys[0]), sort_keys=True)
    (tmp_path / "map.json").write_text(text)
    assert sorted(map(tuple, readers.edge_map(spark, str(tmp_path / "map.json")).select("predicate_id", "object_aspect_qualifier").collect())) == [("predicate:0", ""), ("predicate:1", "x")]
    writers.triples(encode.translate(e, mapping), str(tmp_path / "out"))
    assert readers.triples(spark, str(tmp_path / "out")).count() == 2
    (tmp_path / "d.tsv").write_text("x\t5\ny\t6\n")
    assert readers.dictionary(spark, str(tmp_path / "d.tsv")).count() == 2
    for name in ("Intermediate_Nodes", "[Intermediate Nodes]", "Intermediate Nodes"):
        (tmp_path / "p.csv").write_text(f'Drug,Disease,{name},drugmechdb_path_id\nA,B,"[x, y]",P1\nA,C,[],P2\n')
        assert [r["nodes"] for r in readers.mechanistic_paths(spark, str(tmp_path / "p.csv")).orderBy("pos").collect()] == [["x", "y"], []]
    (tmp_path / "treats.tsv").write_text("Drug\tPredicate\tDisease\n a \tp\tb\n")
    assert readers.treats_pairs(spark, str(tmp_path / "treats.tsv")).first()["head"] == "a"


def test_influence_csv_with_commas(spark, tmp_path):
    df = spark.createDataFrame([("a", "name, with comma", 0.5)], "TestHead string, TestHead_label string, TracInScore double")
    writers.csv(df, str(tmp_path / "i"))
    assert tuple(readers.influence(spark, str(tmp_path / "i")).first()) == ("a", "name, with comma", 0.5)
    many = readers.many_csv(spark, str(tmp_path), "*.csv")
    assert many.select("file").first()["file"].endswith(".csv")


def test_resolution(spark):
    nodes = spark.createDataFrame([("X:1", "One", ["Y:1", "X:1"]), ("X:2", None, None)], "id string, name string, equivalent_identifiers array<string>")
    c = spark.createDataFrame([("X:1",), ("Y:1",), ("Z:9",)], "curie string")
    assert {r["curie"]: r["preferred"] for r in encode.resolve(c, nodes).collect()} == {"X:1": "X:1", "Y:1": "X:1", "Z:9": "not exist"}
    names = spark.createDataFrame([(" ONE",), ("two",)], "Drug string")
    assert [r["Drug_CURIE"] for r in readers.resolve_names(names, readers.synonyms(nodes), "Drug").orderBy("Drug").collect()] == ["X:1", None]


def test_distributions():
    assert tests.t_two_sided(2.0, 10) == pytest.approx(0.07339, abs=1e-4)
    assert tests.f_sf(4.96, 1, 10) == pytest.approx(0.05, abs=1e-3)
    assert tests.kolmogorov_sf(1.36) == pytest.approx(0.049, abs=2e-3)
    assert tests.mann_whitney(np.array([1.0, 2, 3]), np.array([4.0, 5, 6]))[0] == 0
    rng = np.random.default_rng(0)
    assert tests.shapiro_francia(rng.normal(size=200))[1] > 0.01 > tests.shapiro_francia(rng.exponential(size=200))[1]
    two = np.r_[rng.normal(-4, 1, 300), rng.normal(4, 1, 300)]
    assert tests.dip(two) > 2 * tests.dip(rng.normal(size=600))
    assert tests.levene(rng.normal(size=100), 5 * rng.normal(size=100))[1] < 0.01


def test_shapiro_wilk(spark):
    """Published values: Royston's weights (n = 11) and two samples of 20."""
    x = [148, 154, 158, 160, 161, 162, 166, 170, 182, 195, 236]
    y = [0.11, 7.87, 4.61, 10.14, 7.95, 3.14, 0.46, 4.43, 0.21, 4.75, 0.71, 1.52, 3.24, 0.93, 0.42, 4.97, 9.53, 4.55, 0.47, 6.66]
    z = [1.36, 1.14, 2.92, 2.55, 1.46, 1.06, 5.27, -1.11, 3.48, 1.10, 0.88, -0.51, 1.46, 0.52, 6.20, 1.69, 0.08, 3.67, 2.81, 3.49]
    assert tests.shapiro_wilk(np.array(x, dtype=float)) == pytest.approx((0.79, 0.0067), abs=0.005)
    assert tests.shapiro_wilk(np.array(y)) == pytest.approx((0.900473, 0.04209), abs=1e-4)
    assert tests.shapiro_wilk(np.array(z)) == pytest.approx((0.959027, 0.5246), abs=1e-4)
    rows = spark.createDataFrame([("g", v, 1) for v in y] + [("g", v, 0) for v in z], "g string, v double, f int")
    got = stats.distribution_report(rows, "g", "v", "f").first()
    assert (got["shapiro_on"], got["shapiro_off"]) == pytest.approx((0.900473, 0.959027), abs=1e-4)


def plain_statistics(rows):
    """The observed statistics, one row after another: rows (test, value, flag)."""
    on, off = ([x for _, x, f in rows if f == want] for want in (1, 0))
    xs = sorted(x for _, x, _ in rows)
    rank = {x: (xs.index(x) + 1 + len(xs) - xs[::-1].index(x)) / 2 for x in set(xs)}
    best, precision = [], []
    for t in {t for t, _, _ in rows}:
        flags = [f for _, f in sorted(((x, f) for u, x, f in rows if u == t), key=lambda r: (-r[0], r[1]))]
        hits = [i + 1 for i, f in enumerate(flags) if f]
        if hits:
            best.append(1 / hits[0])
            precision.append(np.mean([(k + 1) / i for k, i in enumerate(hits)]))
    ks = max(abs(sum(a <= x for a in on) / len(on) - sum(a <= x for a in off) / len(off)) for x in xs)
    return {"mean_difference": np.mean(on) - np.mean(off), "median_difference": np.median(on) - np.median(off), "mrr": np.mean(best), "map": np.mean(precision), "u": sum(rank[x] for x in on) - len(on) * (len(on) + 1) / 2, "ks": ks}


@pytest.mark.parametrize("block_rows", [500_000, 23])
def test_permutations(spark, block_rows):
    """Also in blocks that cut through tests and ties: the same observed statistics and the same p."""
    rng = np.random.default_rng(1)
    rows = [("hot" if i % 3 == 0 else f"t{i % 7}", round(float(rng.normal() + 1.5 * (i % 4 == 0)), 1), int(i % 4 == 0)) for i in range(200)]
    got = {r["metric"]: r for r in stats.permutation_test(spark.createDataFrame(rows, "t string, v double, f int"), "t", "v", "f", 200, block_rows=block_rows).collect()}
    want = plain_statistics(rows)
    assert got.keys() == want.keys()
    for m, r in got.items():
        assert r["observed"] == pytest.approx(want[m], abs=1e-9)
    assert got["mean_difference"]["p"] < 0.02 and got["u"]["p"] < 0.02 and abs(got["mean_difference"]["mean_permuted"]) < 0.1
    assert got["u"]["mean_permuted"] == pytest.approx(50 * 150 / 2, rel=0.03)


def test_ranks_of_a_large_test_come_from_ranges(spark):
    """One test with nearly all rows, ties and a null test: the same ranks in ranges of 17 as in one."""
    rng = np.random.default_rng(4)
    rows = [("hot" if i % 9 else f"t{i % 5}" if i % 2 else None, float(rng.integers(0, 12)), bool(rng.integers(0, 2)), i + 1) for i in range(300)]
    df = spark.createDataFrame(rows, "t string, x double, f boolean, v long")
    small, whole = ({r["v"]: r["s"] for r in stats.ranked_in_tests(df, n).collect()} for n in (17, 1000))
    assert small == whole and sorted(small.values()) == list(range(1, 301))


def test_permutations_without_a_choice(spark):
    for flags in ([], [0, 0], [1, 1]):
        assert stats.permutation_test(spark.createDataFrame([("a", 1.0, f) for f in flags], "t string, v double, f int"), "t", "v", "f", 9).collect() == []


def test_shuffles_are_permutations():
    for n in (1, 2, 7, 100, 1013):
        seen = [tests.shuffled(np.arange(n), n, k) for k in range(30)]
        assert all(sorted(s.tolist()) == list(range(n)) for s in seen)
    assert abs(np.mean([s[0] for s in seen]) / 1012 - 0.5) < 0.2 and len({tuple(s.tolist()) for s in seen}) == 30


def test_mark_and_matrix(spark):
    a = spark.createDataFrame([(1, None), (2, "x")], "k int, v string")
    assert [r["hit"] for r in joins.mark(a, spark.createDataFrame([(2,), (2,)], "j int"), ["k"], "hit", as_int=True).orderBy("k").collect()] == [0, 1]
    assert joins.matrix(a.select("k"), a.select("v"), "p").count() == 4


@pytest.mark.parametrize("task_rows", [9, 500_000])
@pytest.mark.parametrize("overshoot", [1.2, 1.5, 3.0])
def test_group_sample_is_the_walk(spark, task_rows, overshoot):
    """Groups of very different sizes, in ranges of a few: what a walk in hash order takes, step by step."""
    import hashlib
    import random

    rng = random.Random(int(overshoot * 10))
    rows, n = [], 0
    for category in ("a", "b", "c", "d"):
        for group in range(60):
            for _ in range(rng.choice([1, 1, 2, 3, 9, 25, 60])):
                rows.append((str(n := n + 1), "r", "t", category, f"{category}{group}"))
    shares = {"a": 0.05, "b": 0.02, "c": 0.001, "d": 0.9}
    sizes, want = {}, set()
    for *_, category, group in rows:
        sizes[category, group] = sizes.get((category, group), 0) + 1
    for category, share in shares.items():
        target = int(len(rows) * share)
        taken, limit = 0, max(target, int(target * overshoot))
        for group in sorted((g for c, g in sizes if c == category), key=lambda g: (hashlib.md5(f"42|{category}|{g}".encode()).hexdigest(), g)):
            if taken >= target:
                break
            if taken + sizes[category, group] <= limit:
                taken += sizes[category, group]
                want.add((category, group))
    df = spark.createDataFrame(rows, "head string, relation string, tail string, category string, group string")
    got = splits.group_sample(df, shares, overshoot=overshoot, task_rows=task_rows).collect()
    assert {(r["category"], r["group"]) for r in got} == want and len(got) == sum(sizes[x] for x in want)


def test_paths_and_degrees_walk_through_no_hub(spark):
    """A hub of 400 neighbours one step from the tail: the rows made on the way don't follow its size."""
    import random

    from kgspark.operators import graph
    from kgspark.sources.staging import staged_paths

    rng = random.Random(4)
    rows = [("c", "r", "p"), ("p", "r", "s1"), ("s0", "r", "hub"), ("s1", "r", "hub"), ("c", "r", "q"), ("q", "r", "s0")] + [(f"x{i}", "r", "hub") for i in range(400)]
    triples = spark.createDataFrame(rows, "head string, relation string, tail string")
    tests = spark.createDataFrame([("t", "c", "s0"), ("t", "c", "s0"), ("u", "c", "hub")], "test_id string, head string, tail string")
    before = set(staged_paths(spark))
    got = sorted((r["test_id"], ">".join(r["nodes"])) for r in graph.simple_paths(triples, tests, 4).collect())
    ways = ["c>p>s1>hub>s0", "c>q>s0"]
    assert got == sorted([("t", w) for w in ways for _ in range(2)] + [("u", "c>p>s1>hub"), ("u", "c>q>s0>hub")])
    made = sum(spark.read.parquet(p).count() for p in set(staged_paths(spark)) - before if "/links-" not in p)
    assert made < 100
    lower = [tuple(r) for r in graph.from_lower(graph.undirected(triples)).collect()]
    assert len(lower) == len(rows) and not [r for r in lower if r[0] == "hub"]
    # all simple paths of a dense little graph, either way and directed, against plain recursion
    links = {(f"n{rng.randrange(7)}", "r", f"n{rng.randrange(7)}") for _ in range(22)}

    def plain(path, goal, most, directed):
        if path[-1] == goal:
            return [path]
        near = {t for h, _, t in links if h == path[-1]} | (set() if directed else {h for h, _, t in links if t == path[-1]})
        return [x for n in near - set(path) for x in plain([*path, n], goal, most, directed)] if len(path) <= most else []

    for directed in (False, True):
        for most in (1, 2, 3, 5):
            got = sorted(tuple(r["nodes"]) for r in graph.simple_paths(spark.createDataFrame(sorted(links), "head string, relation string, tail string"), spark.createDataFrame([("t", "n0", "n1"), ("u", "n2", "n5")], "test_id string, head string, tail string"), most, directed).collect())
            assert got == sorted(tuple(p) for h, t in (("n0", "n1"), ("n2", "n5")) for p in plain([h], t, most, directed))


def test_categories_travel_as_bits(spark):
    """A node's rows are put together, unknown categories and nodes have no bit, and a subject without a fitting category is left behind."""
    from kgspark.operators import filters

    nodes = spark.createDataFrame([("c", [filters.CHEMICAL]), ("c", [filters.GENE]), ("d", [filters.DISEASE]), ("n", ["other"]), ("z", None)], "id string, category array<string>")
    edges = spark.createDataFrame([("c", "x", "d"), ("n", "x", "d"), ("z", "biolink:treats", "n"), ("d", "x", "gone")], "subject string, predicate string, object string")
    typed = {r["subject"]: (r["__s"], r["__o"]) for r in filters.with_types(edges, nodes).collect()}
    assert typed == {"c": (5, 2), "n": (0, 2), "z": (0, 0), "d": (2, 0)}
    assert {r["subject"] for r in filters.with_types(edges, nodes, "cd").collect()} == {"c", "z", "d"}
    assert {r["subject"] for r in filters.style_filter(edges, nodes, "cd").collect()} == {"c", "z"}


def test_a_product_of_lists_is_dealt_over_tasks(spark):
    from kgspark.operators import joins

    a, b = spark.range(40).toDF("drug"), spark.range(30).toDF("disease")
    made = joins.matrix(a, b, "p", task_pairs=100)
    sizes = [n for n in made.rdd.mapPartitions(lambda rows: [sum(1 for _ in rows)]).collect() if n]
    assert sum(sizes) == 1200 and made.distinct().count() == 1200 and len(sizes) >= 8 and max(sizes) <= 200
