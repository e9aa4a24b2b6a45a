"""Neighbourhoods of many tests at once in graphs with hubs.

A frontier is a row for each (node, word): `bits` has a bit for each of 64 tests, so a node that is near to many tests is a few rows, and
rows that meet in a node are combined by bit_or before they are shuffled.  Adjacency is rows of (node, part, up to BLOCK
neighbours): a hub is many rows, a frontier's row at a hub is repeated once for each of its parts, and both are joined by (node, part), so
no task gets a hub whole.  The adjacency is written in buckets of cells, nodes whose names differ in the last characters alone: no hop
moves it, and where such nodes have neighbours in common, as those of one source do, what a task finds is combined before it is
shuffled.  What is staged on the way goes as soon as nothing reads it.  Nodes that a test has seen go out by bits & ~seen.  On the way WIDE words travel in one row, and both ends of a
test in one pass, so that the adjacency moves once a hop.
"""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kgspark.operators.ranking import global_rank
from kgspark.sources.staging import buckets_joined, stage_buckets, unstage
from kgspark.sources.staging import stage_tidily as stage

#: Neighbours in a row of an adjacency, about.
BLOCK = 1024
BITS = 64
#: Words of a frontier that travel in a row.
WIDE = 4
#: Rows of a frontier that are sent to all tasks, so that the adjacency stays where it is.
FEW = 200_000
#: Last characters of a name that its cell leaves out, one less in cells of more than so many links; links in a bucket of cells, about.
ENDING, CELL, BUCKET, MOST_BUCKETS = 4, 1 << 20, 1 << 23, 20_000


@dataclass
class Adjacency:
    """blocks: cell, a, part, neighbours; hubs: a, parts of the nodes with more than one part; crowded: stem of the cells with shorter endings."""

    blocks: DataFrame
    hubs: DataFrame
    crowded: DataFrame

    def placed(self, rows: DataFrame) -> DataFrame:
        """rows (a, ...) with parts, null if there is one, and crowded, null if the cell is not."""
        return rows.withColumn("stem", stem("a")).join(self.hubs, "a", "left").join(self.crowded, "stem", "left").drop("stem")


def stem(name: str, less: int = 0) -> Column:
    return F.left(F.col(name), F.length(name) - (ENDING - less))


def cell() -> Column:
    """Of a row (a, part, parts, crowded); a part of a hub is a cell of its own."""
    return F.when(F.col("parts").isNotNull(), F.concat_ws("#", "a", "part")).when(F.col("crowded"), stem("a", 1)).otherwise(stem("a")).alias("cell")


def adjacency(triples: DataFrame, block: int = BLOCK, directed: bool = False) -> Adjacency:
    """Distinct neighbours of every node (head, tail; either way unless directed).  The triples are read twice: stage what is not a table."""
    there = triples.select(F.col("head").alias("a"), F.col("tail").alias("b"))
    links = there if directed else there.union(triples.select(F.col("tail").alias("a"), F.col("head").alias("b")))
    # one row for each 1,024 links at most; repeated links count here and go out where a part is gathered
    hubs = stage(links.groupBy("a").agg(F.ceil(F.count("*") / block).cast("int").alias("parts")).filter("parts > 1"), "hubs")
    crowded = stage(links.groupBy(stem("a").alias("stem")).agg(F.count("*").alias("n")).filter(F.col("n") > CELL).select("stem", F.lit(True).alias("crowded")), "crowded")
    found = Adjacency(links, hubs, crowded)
    dealt = found.placed(links).withColumn("part", F.pmod(F.xxhash64("b"), F.coalesce("parts", F.lit(1))).cast("int"))
    blocks = dealt.select(cell(), "a", "part", "b").groupBy("cell", "a", "part").agg(F.collect_set("b").alias("neighbours"))
    return replace(found, blocks=stage_buckets(blocks, "adjacency", ["cell"], buckets(triples, 1 if directed else 2)))


def buckets(triples: DataFrame, times: int) -> int:
    """Of about BUCKET links each, and no fewer than there are cores."""
    return min(max(-(-triples.count() * times // BUCKET), triples.sparkSession.sparkContext.defaultParallelism), MOST_BUCKETS)


def numbered_tests(tests: DataFrame) -> DataFrame:
    """test_id with word and bit; equal test_ids share them.  Ids of a length come together, so that numbers in them ascend and tests that
    lie close share words."""
    each = global_rank(tests.select("test_id").distinct(), F.concat(F.lpad(F.length("test_id").cast("string"), 10, "0"), F.col("test_id")), name="__n")
    return each.select("test_id", F.floor((F.col("__n") - 1) / BITS).cast("int").alias("word"), F.pmod(F.col("__n") - 1, F.lit(BITS)).cast("int").alias("bit"))


def mask(bit: Column) -> Column:
    return F.call_function("shiftleft", F.lit(1).cast("long"), bit)


def ors(rows: DataFrame, *more: str, bits: tuple[str, ...] = ("bits",)) -> DataFrame:
    return rows.groupBy("node", "word", *more).agg(*[F.bit_or(b).alias(b) for b in bits])


def seeded(seeds: DataFrame, numbers: DataFrame, *more: str) -> DataFrame:
    """seeds (test_id, node, more) -> node, word, more, bits."""
    return ors(seeds.join(numbers, "test_id").select("node", "word", *more, mask(F.col("bit")).alias("bits")), *more)


def both_ends(tests: DataFrame, numbers: DataFrame) -> DataFrame:
    """Heads and tails of tests as seeds that keep apart: node, word, side, bits."""
    sides = F.explode(F.array(*[F.struct(F.lit(c).alias("side"), F.col(c).alias("node")) for c in ("head", "tail")]))
    return seeded(tests.select("test_id", sides.alias("end")).select("test_id", "end.*"), numbers, "side")


def reached(links: Adjacency, start: DataFrame, hops: int, goes: Column | None = None) -> DataFrame:
    """node, word, bits, hops: the tests (bits) that first reach the node after so many hops; start: node, word, bits, and columns that
    keep rows apart.  goes: whether a row goes on after so many hops, all do by default."""
    zero = F.lit(0).cast("long")
    apart = [c for c in start.columns if c not in ("node", "word", "bits")]
    wide = tuple(f"__b{i}" for i in range(WIDE))
    place = F.pmod(F.col("word"), F.lit(WIDE))
    spread = start.select("node", F.floor(F.col("word") / WIDE).cast("int").alias("word"), *apart, *[F.when(place == i, F.col("bits")).otherwise(zero).alias(b) for i, b in enumerate(wide)])
    seen = frontier = stage(ors(spread, *apart, bits=wide).withColumn("hops", F.lit(0)), "reached")
    for hop in range(1, hops + 1):
        parts = links.placed((frontier if goes is None else frontier.filter(goes)).withColumnRenamed("node", "a"))
        sent = parts.withColumn("part", F.explode(F.sequence(F.lit(0), F.coalesce("parts", F.lit(1)) - 1))).select(cell(), "a", "part", "word", *apart, *wide)
        if frontier.count() <= FEW and sent.count() <= FEW:
            sent = F.broadcast(sent)
        step = ors(sent.join(links.blocks, ["cell", "a", "part"]).select(F.explode("neighbours").alias("node"), "word", *apart, *wide), *apart, bits=wide)
        before = ors(seen, *apart, bits=wide).withColumnsRenamed({b: f"{b}_seen" for b in wide})
        fresh = step.join(before, ["node", "word", *apart], "left").withColumns({b: F.col(b).bitwiseAND(F.bitwise_not(F.coalesce(f"{b}_seen", zero))) for b in wide})
        with buckets_joined(start.sparkSession):
            frontier = stage(fresh.filter(" OR ".join(f"{b} <> 0" for b in wide)).select("node", "word", *apart, *wide, F.lit(hop).alias("hops")), "reached")
        seen = seen.unionByName(frontier)
    words = F.explode(F.filter(F.array(*[F.struct((F.col("word") * WIDE + i).cast("int").alias("word"), F.col(b).alias("bits")) for i, b in enumerate(wide)]), lambda w: w["bits"] != 0))
    return seen.select("node", *apart, words.alias("at"), "hops").select("node", "at.word", *apart, "at.bits", "hops")


def reached_in(triples: DataFrame, start: DataFrame, hops: int, goes: Column | None = None, block: int = BLOCK) -> DataFrame:
    """reached() along triples (head, tail), repeats or not, of which nothing stays on disk but the result."""
    pairs = stage(triples.select("head", "tail"), "triples")
    links = adjacency(pairs, block)
    unstage(pairs)
    near = reached(links, start, hops, goes)
    unstage(links.blocks, links.hubs, links.crowded)
    return near


def by_test(rows: DataFrame, numbers: DataFrame) -> DataFrame:
    """Rows of (word, bits, ...) as a row for each test_id of the bits."""
    each = rows.withColumn("bit", F.explode(F.filter(F.sequence(F.lit(0), F.lit(BITS - 1)), lambda i: F.col("bits").bitwiseAND(mask(i)) != 0)))
    return each.join(numbers, ["word", "bit"]).drop("word", "bit", "bits")


def hop_distances(triples: DataFrame, seeds: DataFrame, max_hops: int, block: int = BLOCK) -> DataFrame:
    """seeds (test_id, node) -> test_id, node, hops for every node within max_hops, the seeds at 0."""
    numbers = stage(numbered_tests(seeds), "tests")
    return by_test(reached_in(triples, seeded(seeds, numbers), max_hops, block=block), numbers).select("test_id", "node", "hops")


def proximity(triples: DataFrame, tests: DataFrame, n_hops: int = 2, min_degree: int = 2, preserve: bool = True, engine: str = "networkx", block: int = BLOCK) -> tuple[DataFrame, DataFrame]:
    """(head, relation, tail, word, bits: the tests that keep the triple; the tests' numbers, for by_test()).  Rules as in
    graph.edge_filter() where a degree is that of the whole graph: networkx and igraph.  Triples that no test keeps are left out."""
    if engine not in ("networkx", "igraph"):
        raise ValueError("degrees of a test's own neighbourhood aren't bits: graph.edge_filter() has those engines")
    numbers = stage(numbered_tests(tests), "tests")
    triples = stage(triples.select("head", "relation", "tail"), "triples")
    links = adjacency(triples, block)
    zero = F.lit(0).cast("long")

    def found(where: Column) -> Column:
        return F.bit_or(F.when(where, F.col("bits")).otherwise(zero))

    near = reached(links, both_ends(tests, numbers), n_hops)
    both = near.groupBy("node", "word").agg(found(F.col("hops") == 0).alias("own"), found(F.col("side") == "head").bitwiseAND(found(F.col("side") == "tail")).alias("bits"))
    if engine == "networkx":
        both = both.withColumn("bits", F.col("bits").bitwiseOR(F.col("own")))
        # neighbours of a node, a loop counting as two
        degree = links.blocks.groupBy("a").agg((F.sum(F.size("neighbours")) + F.max(F.array_contains("neighbours", F.col("a")).cast("int"))).alias("degree"))
    else:
        ends = triples.select(F.explode(F.array("head", "tail")).alias("a"))
        degree = ends.groupBy("a").agg(F.count("*").alias("degree"))
    many = degree.filter(F.col("degree") >= min_degree).select(F.col("a").alias("node"), F.lit(True).alias("many"))
    inside = both.filter("bits <> 0").join(many, "node", "left")
    # words of a node are gathered: as many as there are 64s of tests, so that a hub's triples meet one row of it.  A triple takes its
    # head's words along, so they hold little: bits, and own where it can count
    words = [F.map_from_entries(F.collect_list(F.when(where, F.struct("word", c)))).alias(name) for c, name, where in (("bits", "at", F.lit(True)), ("own", "own", (F.col("own") != 0) & F.lit(preserve) & F.col("many").isNull()))]
    gathered = stage(inside.groupBy("node").agg(*words, F.max("many").alias("many")), "inside")
    unstage(links.blocks, links.hubs, links.crowded)
    rows = triples.join(gathered.toDF("head", "__s", "__s_own", "__s_many"), "head").join(gathered.toDF("tail", "__o", "__o_own", "__o_many"), "tail")
    rows = rows.withColumn("word", F.explode(F.array_intersect(F.map_keys("__s"), F.map_keys("__o"))))
    s, o, s_own, o_own = (F.try_element_at(c, F.col("word")) for c in ("__s", "__o", "__s_own", "__o_own"))
    touched = F.coalesce(s_own, zero).bitwiseOR(F.coalesce(o_own, zero))
    kept = s.bitwiseAND(o).bitwiseAND(F.when(F.coalesce("__s_many", "__o_many", F.lit(False)), F.lit(-1).cast("long")).otherwise(touched))
    return rows.select("head", "relation", "tail", "word", kept.alias("bits")).filter("bits <> 0"), numbers


def shortest(triples: DataFrame, tests: DataFrame, max_length: int, block: int = BLOCK) -> DataFrame:
    """test_id, length: edges of the shortest way from head to tail, of at most max_length; the frontiers of both ends meet half way, so
    each goes only that far."""
    numbers = stage(numbered_tests(tests), "tests")
    half = -(-max_length // 2)
    near = reached_in(triples, both_ends(tests, numbers), half, (F.col("side") == "head") | (F.col("hops") < max_length - half), block)
    h, t = (near.filter(F.col("side") == c) for c in ("head", "tail"))
    met = h.join(t.select("node", "word", F.col("bits").alias("__b"), F.col("hops").alias("__n")), ["node", "word"])
    met = met.withColumn("bits", F.col("bits").bitwiseAND(F.col("__b"))).filter("bits <> 0").groupBy("word", (F.col("hops") + F.col("__n")).alias("length")).agg(F.bit_or("bits").alias("bits"))
    return by_test(met, numbers).groupBy("test_id").agg(F.min("length").alias("length"))
