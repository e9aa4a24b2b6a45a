import random
from collections import defaultdict

import pytest
from kgspark.operators import graph, reach
from kgspark.plans.views import view
from kgspark.sources.staging import buckets_joined, staged_paths


@pytest.fixture(scope="module")
def hubs(spark):
    """A graph with two hubs, loops and repeated links, and tests whose ids repeat; more than 64 of them."""
    rng = random.Random(3)
    rows = [("hub", "r", f"n{i}") for i in range(90)] + [(f"n{i}", "s", "hub2") for i in range(40, 130)]
    rows += [(f"n{rng.randrange(130)}", rng.choice("rs"), f"n{rng.randrange(130)}") for _ in range(60)] + [("n1", "r", "n1"), ("hub", "x", "n1"), ("far", "r", "further")]
    tests = [(f"t{i}", f"n{rng.randrange(130)}", "r", f"n{rng.randrange(130)}") for i in range(90)] + [("t1", "n3", "r", "far"), ("t2", "nowhere", "r", "n2")]
    return spark.createDataFrame(rows, "head string, relation string, tail string"), spark.createDataFrame(tests, "test_id string, head string, relation string, tail string")


def plain_hops(triples, seeds, most):
    near = defaultdict(set)
    for h, _, t in triples:
        near[h].add(t)
        near[t].add(h)
    out = {}
    for test in {x for x, _ in seeds}:
        at = {n for x, n in seeds if x == test}
        seen = dict.fromkeys(at, 0)
        for hop in range(1, most + 1):
            at = {m for n in at for m in near[n]} - set(seen)
            seen |= dict.fromkeys(at, hop)
        out |= {(test, n): d for n, d in seen.items()}
    return out


@pytest.mark.parametrize("block", [7, 1024])
def test_hops_with_split_hubs(hubs, block):
    triples, tests = hubs
    seeds = tests.selectExpr("test_id", "head AS node")
    got = {(r["test_id"], r["node"]): r["hops"] for r in reach.hop_distances(triples, seeds, 3, block).collect()}
    assert got == plain_hops([tuple(r) for r in triples.collect()], [tuple(r) for r in seeds.collect()], 3)


def test_no_row_of_the_adjacency_holds_a_hub(hubs):
    links = reach.adjacency(hubs[0], 10)
    sizes = {(r["a"], r["part"]): len(r["neighbours"]) for r in links.blocks.collect()}
    assert sum(a == "hub" for a, _ in sizes) >= 8 and max(sizes.values()) < 30
    assert {r["a"] for r in links.hubs.collect()} >= {"hub", "hub2"}


@pytest.mark.parametrize("engine", ["networkx", "igraph"])
@pytest.mark.parametrize("preserve", [True, False])
def test_proximity_equals_the_filter_by_rows(hubs, engine, preserve):
    triples, tests = hubs
    once = triples.distinct()
    want = {tuple(r) for r in graph.edge_filter(once, tests, 1, 3, preserve, engine).collect()}
    got = reach.by_test(*reach.proximity(once, tests, 1, 3, preserve, engine, block=8)).select("test_id", "head", "relation", "tail").collect()
    assert len(got) == len({tuple(r) for r in got}) and {tuple(r) for r in got} == want and want


def test_shortest_ways_meet_half_way(hubs):
    triples, tests = hubs
    once = tests.dropDuplicates(["test_id"])
    rows = [tuple(r) for r in once.collect()]
    hops = plain_hops([tuple(r) for r in triples.collect()], [(r[0], r[1]) for r in rows], 3)
    want = {r[0]: hops[r[0], r[3]] for r in rows if (r[0], r[3]) in hops}
    assert {r["test_id"]: r["length"] for r in reach.shortest(triples, once, 3, block=9).collect()} == want


def test_words_share_rows_and_ends_share_a_pass(hubs, monkeypatch):
    triples, tests = hubs
    staged, stage = [], reach.stage
    monkeypatch.setattr(reach, "stage", lambda df, name: staged.append((name, stage(df, name))) or staged[-1][1])
    reach.proximity(triples, tests, 2, block=8)
    frontiers = [df for name, df in staged if name == "reached"]
    assert len(frontiers) == 3 and "links" not in {name for name, _ in staged}
    for df in frontiers:  # 90 tests are two words
        assert df.count() == df.select("node", "side").distinct().count()


@pytest.mark.parametrize("few", [0, 200_000])
def test_shortest_ways_of_odd_length_and_words_beyond_a_row(hubs, monkeypatch, few):
    monkeypatch.setattr(reach, "FEW", few)
    triples, tests = hubs
    many = tests.dropDuplicates(["test_id"]).selectExpr("explode(sequence(1, 4)) AS i", "*").selectExpr("test_id || '-' || i AS test_id", "head", "relation", "tail")
    rows = [tuple(r) for r in many.collect()]
    hops = plain_hops([tuple(r) for r in triples.collect()], [(r[0], r[1]) for r in rows], 3)
    want = {r[0]: hops[r[0], r[3]] for r in rows if (r[0], r[3]) in hops}
    assert len(rows) > reach.BITS * reach.WIDE
    assert {r["test_id"]: r["length"] for r in reach.shortest(triples, many, 3, block=9).collect()} == want


def test_engines_with_local_degrees_are_refused(hubs):
    with pytest.raises(ValueError):
        reach.proximity(*hubs, engine="pyg")


def test_no_hop_moves_the_adjacency(hubs, monkeypatch):
    monkeypatch.setattr(reach, "FEW", 0)
    monkeypatch.setattr(reach, "CELL", 20)
    monkeypatch.setattr(reach, "ENDING", 1)
    triples, tests = hubs
    seeds = tests.selectExpr("test_id", "head AS node")
    spark = triples.sparkSession
    threshold = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        got = {(r["test_id"], r["node"]): r["hops"] for r in reach.hop_distances(triples, seeds, 3, 8).collect()}
        links = reach.adjacency(triples, 8)
        with buckets_joined(spark):
            sent = links.blocks.select("cell", "a", "part").join(links.blocks.select("cell", "a", "part", "neighbours"), ["cell", "a", "part"])
            assert "Exchange" not in sent._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
    assert got == plain_hops([tuple(r) for r in triples.collect()], [tuple(r) for r in seeds.collect()], 3)
    assert links.crowded.count() and links.blocks.select("cell").distinct().count() > 3


def test_nothing_stays_on_disk_but_the_result(hubs):
    triples, tests = hubs
    spark = triples.sparkSession
    before, tables = set(staged_paths(spark)), spark.catalog.listTables()
    reach.hop_distances(triples, tests.selectExpr("test_id", "head AS node"), 2, 8)
    left = {p.rsplit("/", 1)[-1].split("-")[0] for p in set(staged_paths(spark)) - before}
    assert left == {"tests", "reached"} and spark.catalog.listTables() == tables


def test_links_are_the_pairs_of_all_triples(spark):
    links, triples = (view(spark, "/root/testdata/sf0.001", name) for name in ("all_links", "all_triples"))
    assert links.columns == ["head", "tail"] and "Aggregate" not in links._jdf.queryExecution().optimizedPlan().toString()
    assert {tuple(r) for r in links.collect()} == {tuple(r) for r in triples.select("head", "tail").collect()}
