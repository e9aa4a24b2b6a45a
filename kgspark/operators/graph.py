"""Traversal of triples: neighbourhoods, proximity filters, simple paths, metapaths.

Everything is keyed by test_id, so many test triples run in one plan.  Distances carry one row a node and
hop (never paths); each hop joins the frontier alone and drops nodes already seen.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kgspark.functions.scalars import entity_type, path_scores
from kgspark.operators.ranking import top_k
from kgspark.sources.staging import stage

ENGINES = ("python", "pyg", "networkx", "igraph")


def undirected(triples: DataFrame) -> DataFrame:
    """a, b: each neighbouring pair in both directions, once; kept, since every hop reads it."""
    return triples.select(F.col("head").alias("a"), F.col("tail").alias("b")).union(triples.select(F.col("tail").alias("a"), F.col("head").alias("b"))).distinct().persist()


def from_lower(links: DataFrame) -> DataFrame:
    """Of the links (a, b) of undirected() each pair once: from the end of fewer neighbours, of equal ones from the lesser name."""
    degree = links.groupBy("a").agg(F.count("*").alias("n"))
    both = links.join(degree, "a").join(degree.toDF("b", "m"), "b")
    return both.filter((F.col("n") < F.col("m")) | ((F.col("n") == F.col("m")) & (F.col("a") <= F.col("b")))).select("a", "b")


def hop_distances(neighbours: DataFrame, seeds: DataFrame, max_hops: int) -> DataFrame:
    """seeds (test_id, node) -> test_id, node, hops for every node within max_hops, the seeds at 0."""
    seen = stage(seeds.select("test_id", "node").distinct().withColumn("hops", F.lit(0)), "seeds")
    frontier = seen
    for hop in range(1, max_hops + 1):
        step = frontier.join(neighbours, frontier["node"] == neighbours["a"]).select("test_id", F.col("b").alias("node")).distinct()
        frontier = step.join(seen.select("test_id", "node"), ["test_id", "node"], "left_anti").withColumn("hops", F.lit(hop))
        # read by the next hop, by its anti-join and by the result: written once, so plans stay short
        frontier = stage(frontier, "frontier")
        seen = seen.unionByName(frontier)
    return seen


def khop_edges(triples: DataFrame, seeds: DataFrame, hops: int) -> DataFrame:
    """test_id and triples that touch a node nearer than `hops`."""
    near = hop_distances(undirected(triples), seeds, hops - 1).select("test_id", "node")
    return near.join(triples, near["node"] == triples["head"]).drop("node").unionByName(near.join(triples, near["node"] == triples["tail"]).drop("node")).distinct()


def distances_of(triples: DataFrame, tests: DataFrame, hops: int) -> DataFrame:
    """tests (test_id, head, tail) -> test_id, node, dh, dt: hops from the test heads and from the tails, null
    beyond `hops`; one row for each node near either."""
    links = undirected(triples)
    h = hop_distances(links, tests.select("test_id", F.col("head").alias("node")), hops).withColumnRenamed("hops", "dh")
    t = hop_distances(links, tests.select("test_id", F.col("tail").alias("node")), hops).withColumnRenamed("hops", "dt")
    return h.join(t, ["test_id", "node"], "full")


def edge_filter(triples: DataFrame, tests: DataFrame, n_hops: int = 2, min_degree: int = 2, preserve: bool = True, engine: str = "pyg", path_filter: bool = False, max_length: int | None = None, reasons: bool = False) -> DataFrame:
    """test_id and the training triples near both ends of the test triples (rows of one test_id are pooled).

    An edge stays if both its ends are within n_hops of a test head and of a test tail (test nodes count
    as such, except with igraph), and it touches a test node (with preserve) or one end has min_degree.  What a
    degree is depends on the engine: occurrences in the n-hop edges (python), distinct neighbours in the two
    neighbourhoods together (pyg), in the whole graph (networkx), or incident edges in the whole graph
    (igraph).  python keeps all edges within n_hops of any test node and asks for the degree alone.
    path_filter keeps edges on the way from head to tail: by distances (pyg) or as part of a simple path of at
    most max_length edges (networkx, igraph; 2 x n_hops by default).  With reasons, dropped edges stay
    too, with the rule that decided."""
    assert engine in ENGINES, engine
    ends = tests.select("test_id", F.explode(F.array("head", "tail")).alias("node")).distinct()
    if engine == "python":
        near = khop_edges(triples, ends, n_hops)
        degree = near.select("test_id", F.explode(F.array("head", "tail")).alias("node")).groupBy("test_id", "node").agg(F.count("*").alias("degree"))
        inside = degree.join(ends.withColumn("__test", F.lit(True)), ["test_id", "node"], "left")
        candidates = near
    else:
        d = distances_of(triples, tests, n_hops)
        links = undirected(triples)
        if engine == "pyg":
            side = d.select("test_id", "node", F.col("dh").isNotNull().alias("__h"), F.col("dt").isNotNull().alias("__t"))
            # each link once, from the end of fewer neighbours: a hub's links are found from their other ends
            pairs = side.withColumnsRenamed({"node": "a", "__h": "__ha", "__t": "__ta"}).join(from_lower(links), "a")
            other = side.withColumnsRenamed({"node": "b", "__h": "__hb", "__t": "__tb"})
            pairs = pairs.join(other, ["test_id", "b"]).filter((F.col("__ha") & F.col("__hb")) | (F.col("__ta") & F.col("__tb")))
            pairs = pairs.select("test_id", F.explode(F.array_distinct(F.array("a", "b"))).alias("node"))
            degree = pairs.groupBy("test_id", "node").agg(F.count("*").alias("degree"))
            inside = d.join(degree, ["test_id", "node"], "left")
        else:
            if engine == "networkx":
                whole = links.filter("a <> b").groupBy("a").agg(F.count("*").alias("degree"))
                loops = links.filter("a = b").select("a", F.lit(2).alias("__loop"))  # a loop adds two
                whole = whole.join(loops, "a", "full").select("a", (F.coalesce("degree", F.lit(0)) + F.coalesce("__loop", F.lit(0))).alias("degree"))
            else:
                whole = triples.select(F.explode(F.array("head", "tail")).alias("a")).groupBy("a").agg(F.count("*").alias("degree"))
            inside = d.join(whole.withColumnRenamed("a", "node"), "node", "left")
        inside = inside.join(ends.withColumn("__test", F.lit(True)), ["test_id", "node"], "left")
        both = F.col("dh").isNotNull() & F.col("dt").isNotNull()
        inside = inside.filter(both if engine == "igraph" else both | F.col("__test"))
        candidates = triples
    columns = [c for c in ("degree", "__test", "dh", "dt") if c in inside.columns]
    s = inside.select("test_id", F.col("node").alias("head"), *[F.col(c).alias(f"s_{c}") for c in columns])
    o = inside.select("test_id", F.col("node").alias("tail"), *[F.col(c).alias(f"o_{c}") for c in columns])
    rows = candidates.join(s, ["test_id", "head"] if engine == "python" else "head").join(o, ["test_id", "tail"])
    enough = (F.coalesce("s_degree", F.lit(0)) >= min_degree) | (F.coalesce("o_degree", F.lit(0)) >= min_degree)
    touches = F.coalesce("s___test", "o___test", F.lit(False)) if preserve else F.lit(False)
    reason = F.when(touches, "touches_test").when(enough, "degree").otherwise("low_degree")
    if path_filter and engine == "pyg":
        reason = F.when(reason != "low_degree", F.when(on_way(max_length), reason).otherwise("off_path")).otherwise(reason)
    rows = rows.withColumn("reason", reason)
    if path_filter and engine in ("networkx", "igraph"):
        paths = simple_paths(triples, tests, max_length or 2 * n_hops)
        on = path_edges(paths).withColumn("__on", F.lit(True))
        rows = rows.withColumns({"low": F.least("head", "tail"), "high": F.greatest("head", "tail")}).join(on, ["test_id", "low", "high"], "left")
        rows = rows.withColumn("reason", F.when((F.col("reason") != "low_degree") & F.col("__on").isNull(), "off_path").otherwise(F.col("reason"))).drop("low", "high", "__on")
    out = rows.select("test_id", "head", "relation", "tail", "reason")
    return out if reasons else out.filter(F.col("reason").isin("touches_test", "degree")).drop("reason")


def on_way(max_length: int | None) -> Column:
    """Does the edge lead from head to tail without going back, in one of its directions?"""

    def way(a: str, b: str) -> Column:
        c = (F.col(f"{a}_dh") <= F.col(f"{b}_dh")) & (F.col(f"{b}_dt") <= F.col(f"{a}_dt"))
        return c if max_length is None else c & (F.col(f"{a}_dh") + F.col(f"{b}_dt") <= max_length)

    return F.coalesce(way("s", "o"), F.lit(False)) | F.coalesce(way("o", "s"), F.lit(False))


def strict_path_edges(triples: DataFrame, tests: DataFrame, max_length: int) -> DataFrame:
    """Triples on simple paths between the test nodes, whatever their degrees."""
    on = path_edges(simple_paths(triples, tests, max_length))
    t = triples.withColumns({"low": F.least("head", "tail"), "high": F.greatest("head", "tail")})
    return t.join(on, ["low", "high"]).select("test_id", "head", "relation", "tail")


def one_triple_per_edge(triples: DataFrame, *order: Column) -> DataFrame:
    """The first triple of each unordered pair of nodes."""
    pair = Window.partitionBy(F.least("head", "tail"), F.greatest("head", "tail")).orderBy(*order)
    return triples.withColumn("__n", F.row_number().over(pair)).filter("__n = 1").drop("__n")


def simple_paths(triples: DataFrame, tests: DataFrame, max_length: int, directed: bool = False) -> DataFrame:
    """test_id, nodes: all paths without repeated nodes of 1 to max_length edges from head to tail.  Prefixes grow from the head and suffixes
    from the tail, by max_length steps in all: each step grows the side of a test whose ends have fewer neighbours together, so a hub is not
    walked through where the other side can get to it.  A path of more edges than the prefixes have is a prefix and a suffix that meet."""
    if directed:
        there = triples.select(F.lit(True).alias("forward"), F.col("head").alias("a"), F.col("tail").alias("b"))
        links = there.union(triples.select(F.lit(False), "tail", "head")).distinct()
    else:
        links = undirected(triples)
    by = ["forward", "a"] if directed else ["a"]
    degree = links.groupBy(*by).agg(F.count("*").alias("n"))
    # n: neighbours of b the same way
    ends = links.join(degree.withColumnRenamed("a", "b"), ["forward", "b"] if directed else ["b"], "left").withColumn("n", F.coalesce("n", F.lit(0)))
    links = stage(ends, "links")
    t = stage(tests.select("test_id", "head", "tail").filter("head <> tail").withColumn("__p", F.monotonically_increasing_id()), "pairs")
    start = t.select("__p", F.explode(F.array(F.struct(F.lit(True).alias("forward"), F.col("head").alias("a"), F.col("tail").alias("goal")), F.struct(F.lit(False).alias("forward"), F.col("tail").alias("a"), F.col("head").alias("goal")))).alias("e"))
    start = start.select("__p", "e.forward", "e.a", "e.goal").join(degree, by, "left")
    front = start.select("__p", "forward", "a", "goal", F.coalesce("n", F.lit(0)).alias("n"), F.array("a").alias("nodes"))
    found, suffixes = [], []
    for _ in range(max_length):
        cost = [F.coalesce(F.sum(F.when(F.col("forward") == way, F.col("n"))), F.lit(0)) for way in (True, False)]
        marked = front.join(front.groupBy("__p").agg((cost[0] <= cost[1]).alias("turn")), "__p")
        grown = marked.filter(F.col("forward") == F.col("turn")).drop("turn", "n").join(links, by).filter(~F.array_contains("nodes", F.col("b")))
        # read by the result and by the next step
        grown = stage(grown.select("__p", "forward", F.col("b").alias("a"), "goal", "n", F.concat("nodes", F.array("b")).alias("nodes")), "paths")
        found.append(grown.filter("forward AND a = goal").select("__p", "nodes"))
        suffixes.append(grown.filter("NOT forward").select("__p", "a", F.reverse("nodes").alias("__rest")))
        front = stage(marked.filter(F.col("forward") != F.col("turn")).select(front.columns).unionByName(grown.filter("a <> goal")), "front")
    met = front.filter("forward").join(reduce(DataFrame.unionByName, suffixes), ["__p", "a"])
    met = met.filter(~F.arrays_overlap(F.slice("nodes", 1, F.size("nodes") - 1), "__rest"))
    found.append(met.select("__p", F.concat("nodes", F.slice("__rest", 2, max_length)).alias("nodes")))
    return reduce(DataFrame.unionByName, found).join(t.select("__p", "test_id"), "__p").select("test_id", "nodes")


def path_edges(paths: DataFrame) -> DataFrame:
    """test_id, low, high: distinct unordered edges on the paths."""
    step = paths.select("test_id", F.explode(F.arrays_zip(F.slice("nodes", 1, F.size("nodes") - 1).alias("x"), F.slice("nodes", 2, F.size("nodes") - 1).alias("y"))).alias("e"))
    return step.select("test_id", F.least("e.x", "e.y").alias("low"), F.greatest("e.x", "e.y").alias("high")).distinct()


def path_stats(paths: DataFrame) -> DataFrame:
    length = F.size("nodes") - 1
    return paths.groupBy("test_id").agg(F.count("*").alias("paths"), F.min(length).cast("long").alias("shortest"), F.max(length).cast("long").alias("longest"), F.round(F.avg(length), 6).alias("mean_length"))


def khop_paths(links: DataFrame, tests: DataFrame, k: int, directed: bool = True, connecting: bool = False) -> DataFrame:
    """All paths of exactly k edges without repeated nodes from either test node, over links (source,
    relation, target, score): test_id, start_from, nodes, relations, edge_scores, connects, the four path
    scores.  Repeated links of one (source, relation, target) are each walked.  With connecting only the paths from
    head to tail are grown: none begins at the tail, none passes through it, and the last step is a join on it."""
    hop = links.select("test_id", F.col("source").alias("a"), "relation", F.col("target").alias("b"), F.coalesce("score", F.lit(0.0)).alias("score"))
    if not directed:
        hop = hop.unionByName(hop.select("test_id", F.col("b").alias("a"), "relation", F.col("a").alias("b"), "score"))
    empty_text, empty_score = F.array().cast("array<string>"), F.array().cast("array<double>")
    starts = tests.select("test_id", F.col("head").alias("__h"), F.col("tail").alias("__t"), F.explode(F.array(F.struct(F.lit("Test Head").alias("l"), F.col("head").alias("n")), F.struct(F.lit("Test Tail").alias("l"), F.col("tail").alias("n")))).alias("s"))
    front = starts.select("test_id", "__h", "__t", F.col("s.l").alias("start_from"), F.col("s.n").alias("__at"), F.array("s.n").alias("nodes"), empty_text.alias("relations"), empty_score.alias("edge_scores"))
    if connecting:
        front = front.filter((F.col("start_from") == "Test Head") & (F.col("__h") != F.col("__t")))
    for step in range(1, k + 1):
        if connecting and step == k:
            front = front.withColumn("b", F.col("__t")).withColumnRenamed("__at", "a").join(hop, ["test_id", "a", "b"])
        else:
            front = front.withColumnRenamed("__at", "a").join(hop, ["test_id", "a"]).filter(~F.array_contains("nodes", F.col("b")))
            if connecting:
                front = front.filter(F.col("b") != F.col("__t"))
        front = front.select("test_id", "__h", "__t", "start_from", F.col("b").alias("__at"), F.concat("nodes", F.array("b")).alias("nodes"), F.concat("relations", F.array("relation")).alias("relations"), F.concat("edge_scores", F.array("score")).alias("edge_scores"))
    out = front.withColumn("connects", (F.element_at("nodes", 1) == F.col("__h")) & (F.col("__at") == F.col("__t"))).drop("__h", "__t", "__at")
    return out.withColumns(path_scores("edge_scores"))


def path_string(nodes: Column | str = "nodes", relations: Column | str = "relations") -> Column:
    """A -> r -> B -> ..."""
    n, r = (F.col(c) if isinstance(c, str) else c for c in (nodes, relations))
    steps = F.flatten(F.zip_with(r, F.slice(n, 2, F.size(r)), lambda a, b: F.array(a, b)))
    return F.concat_ws(" -> ", F.element_at(n, 1), F.array_join(steps, " -> "))


def ranked_path_edges(paths: DataFrame) -> DataFrame:
    """Connecting paths ranked by mean score within their test, a row an edge."""
    order = Window.partitionBy("test_id").orderBy(F.col("score_mean").desc(), path_string().asc())
    ranked = paths.filter("connects").withColumn("path_string", path_string()).withColumn("path_rank", F.row_number().over(order))
    step = ranked.select("test_id", "path_rank", "path_string", "score_mean", "nodes", F.posexplode(F.arrays_zip("relations", "edge_scores")).alias("edge_pos", "e"))
    return step.select("test_id", "path_rank", "path_string", F.col("edge_pos").cast("int"), F.element_at("nodes", F.col("edge_pos") + 1).alias("TrainHead"), F.col("e.relations").alias("TrainRel_label"), F.element_at("nodes", F.col("edge_pos") + 2).alias("TrainTail"), F.col("e.edge_scores").alias("TracInScore"), F.col("score_mean").alias("path_score_mean"))


def metapaths(paths: DataFrame, examples: int = 3) -> DataFrame:
    """Type sequences of connecting paths with counts, percentages and a few examples."""
    types = F.transform("nodes", lambda n: entity_type(n))
    m = paths.filter("connects").select("test_id", path_string(types, "relations").alias("metapath"), path_string().alias("__p"))
    by = ["test_id", "metapath"]
    counted = m.groupBy(*by).agg(F.count("*").alias("paths"))
    # only the examples themselves are gathered
    few = top_k(m.distinct(), by, examples, F.col("__p")).groupBy(*by).agg(F.array_sort(F.collect_list("__p")).alias("examples"))
    out = counted.join(few, by)
    return out.withColumn("percentage", F.round(100.0 * F.col("paths") / F.sum("paths").over(Window.partitionBy("test_id")), 6))
