"""Mixing sources to target weights by pivotal dependent rounding, in DataFrame functions alone.

Every document of a source should be taken f = target / size-of-source times: floor(f) copies surely, one
more with probability p = f - floor(f).  Dependent rounding decides these probabilities together: two
undecided documents are paired and words (probability x size) pass from one to the other, in one of
the two directions that make one probability 0 or 1, each with the chance that leaves all expectations
as they are.  The source's expected words never change, so its total ends within one document of the
target.

The pairing runs as a reduction tree.  A source's documents are dealt by hash into blocks of about FAN
rows; each block is folded to at most one undecided document; the rest of all blocks are dealt again,
until a source has one block.  So a source with a third of all rows is many blocks, levels grow with the
logarithm of the rows, and chance comes from hashes: reruns and repeated tasks agree.

Targets: the sources' shares by weight of all sizes, no target above `cap` times its source's size, the
excess shared out by weight among the others until none is above.

Repeated rows are one item with a number of rows: of n equal rows with probability p, floor(n p) get a copy
more, and what is left of n p is the item's probability.  So a row repeated without end is one item.

Cases: null text: size 0, taken 0.  Null doc_id: a document like any other.  Null source: a source of its own, last in
order.  A source without words: target 0.  Repeated rows: each has its own copies, which differ by one at most.  Ties:
none, as items differ in doc_id, source, size or the hash of the text.  Empty table: no rows.  Very long texts: only
their sizes and hashes travel.  Columns but doc_id, source and text, whatever their names, are not read; take() returns
them as they are.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kgspark.llm.common import documents, free_names, one_row_each, stage
from kgspark.operators.ranking import TASK_ROWS, global_rank, running_sums

CAP = 3
WEIGHTS = (1, 2, 3)
FAN = 64
WORD = r"[^\x20\x09-\x0D]+"
#: Fields of an item beside its probability.
FIELDS = ("__h", "doc_id", "size", "__key", "rows", "__sure")
ITEM = "struct<" + ",".join(f"{f}:bigint" for f in FIELDS) + ",__p:double>"
#: Rows of one item that are written out together, and the number of rows of an item from which they are dealt anew.
TOGETHER = 1 << 16
MANY = 1 << 20


def sizes(docs: DataFrame) -> DataFrame:
    """doc_id, source, size in words, and a hash of the text that tells rows of one doc_id apart."""
    return docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.col("source").cast("string").alias("source"),
        F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long").alias("size"),
        F.xxhash64("text").alias("__key"),
    )


def items_of(rows: DataFrame) -> DataFrame:
    """rows (of sizes()) with equal ones as one, and their number in rows."""
    return rows.groupBy("doc_id", "source", "size", "__key").agg(F.count("*").alias("rows"))


def targets(items: DataFrame, weights: tuple[int, ...] = WEIGHTS, cap: float = CAP, task_rows: int = TASK_ROWS) -> DataFrame:
    """source, source_size, items, target.  With all sources ordered by cap x size / weight, those that reach their cap are a prefix: source
    i is capped if the level that the uncapped rest would get is above its own ratio.  Places and prefix sums come from ranges of about
    task_rows sources, so more of them than that are no single task's."""
    each = stage(items.groupBy("source").agg(F.sum(F.col("size") * F.col("rows")).alias("source_size"), F.count("*").alias("items")), "sources")
    # UTF-8 bytes order as code points do; null comes last
    named = global_rank(each.filter("source IS NOT NULL"), "source", name="__place", task_rows=task_rows)
    none = each.filter("source IS NULL").withColumn("__place", F.lit(each.filter("source IS NOT NULL").count() + 1))
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.pmod(F.col("__place") - 1, F.lit(len(weights))) + 1).cast("int"))
    each = named.unionByName(none).withColumn("__w", weight).withColumn("__cap", F.lit(float(cap)) * F.col("source_size")).withColumn("__ratio", F.col("__cap") / F.col("__w"))
    ranked = stage(global_rank(each, "__ratio", "__place", name="__order", task_rows=task_rows), "ratios")
    sums = running_sums(ranked, "__order", {"__cap": "__caps", "__w": "__ws", "source_size": "__sizes"}, task_rows=task_rows)
    earlier = lambda total, own: F.col(total) - F.col(own)
    level = (F.col("__sizes_total").cast("double") - earlier("__caps", "__cap")) / (F.col("__ws_total") - earlier("__ws", "__w"))
    sums = stage(sums.withColumn("__level", level), "levels")
    # the first source in this order that keeps below its cap fixes the level for all after it
    first = sums.filter(F.col("__ratio") > F.col("__level")).agg(F.min_by("__level", "__order").alias("__share"))
    capped = F.col("__share").isNull() | (F.col("__ratio") <= F.col("__share"))
    return sums.join(F.broadcast(first), F.lit(True)).select("source", "source_size", "items", F.when(capped, F.col("__cap")).otherwise(F.col("__share") * F.col("__w")).alias("target"))  # one row


def uniform(*columns: Column) -> Column:
    """A number from 0 to 1 from a hash."""
    return F.shiftrightunsigned(F.xxhash64(*columns), 11).cast("double") / F.lit(float(1 << 53))


def step(seed: int):
    """Fold one document into the state (undecided document or null, decided documents)."""
    item = "struct(" + ", ".join(f"x.{f} AS {f}" for f in FIELDS) + ", {p} AS __p)"
    kept = "struct(" + ", ".join(f"s.rest.{f} AS {f}" for f in FIELDS) + ", {p} AS __p)"
    # u words may leave the rest for x, v words may leave x for the rest, until one of the two is 0 or 1
    u = "least(s.rest.__p * s.rest.size, (1 - x.__p) * x.size)"
    v = "least(x.__p * x.size, (1 - s.rest.__p) * s.rest.size)"
    chance = f"shiftrightunsigned(xxhash64(s.rest.__key, x.__key, s.rest.doc_id, x.doc_id, s.rest.__h, x.__h, {seed}), 11) / {float(1 << 53)!r}D"
    up = f"({chance}) * ({u} + {v}) < {v}"  # then u words pass from the rest to x
    rest_p = f"CASE WHEN {up} THEN s.rest.__p - {u} / s.rest.size ELSE s.rest.__p + {v} / s.rest.size END"
    x_p = f"CASE WHEN {up} THEN x.__p + {u} / x.size ELSE x.__p - {v} / x.size END"
    # which one becomes integral follows from the amounts, not from rounded sums
    rest_done = f"CASE WHEN {up} THEN s.rest.__p * s.rest.size <= (1 - x.__p) * x.size ELSE (1 - s.rest.__p) * s.rest.size <= x.__p * x.size END"
    rest_value = f"CASE WHEN {up} THEN 0.0D ELSE 1.0D END"
    x_value = f"CASE WHEN {up} THEN 1.0D ELSE 0.0D END"
    moved = (
        f"CASE WHEN {rest_done} THEN struct({item.format(p=x_p)} AS rest, concat(s.done, array({kept.format(p=rest_value)})) AS done) "
        f"ELSE struct({kept.format(p=rest_p)} AS rest, concat(s.done, array({item.format(p=x_value)})) AS done) END"
    )
    return (
        f"aggregate(__items, struct(CAST(NULL AS {ITEM}) AS rest, CAST(array() AS array<{ITEM}>) AS done), (s, x) -> "
        f"CASE WHEN x.__p <= 0 OR x.__p >= 1 THEN struct(s.rest AS rest, concat(s.done, array(x)) AS done) "
        f"WHEN s.rest IS NULL OR s.rest.__p <= 0 OR s.rest.__p >= 1 THEN struct(x AS rest, CASE WHEN s.rest IS NULL THEN s.done ELSE concat(s.done, array(s.rest)) END AS done) "
        f"ELSE {moved} END)"
    )


def decide(rows: DataFrame, weights: tuple[int, ...] = WEIGHTS, cap: float = CAP, fan: int = FAN, seed: int = 42) -> DataFrame:
    """rows (of sizes()) -> doc_id, source, size, __key, rows, source_size, target, __base and __more: each of the rows
    is taken __base times, __more of them once more."""
    items = stage(items_of(rows), "items")
    goals = stage(targets(items, weights, cap), "targets")
    few = goals.count() <= 100_000
    goal = F.broadcast(goals) if few else goals
    largest = goals.agg(F.max("items")).first()[0] or 0
    same = items["source"].eqNullSafe(goals["source"])
    factor = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    more = F.col("rows") * (factor - F.floor(factor))
    todo = items.join(goal, same).select(items["doc_id"], items["source"], "size", "__key", "rows", "items", "source_size", "target", F.floor(factor).alias("__base"), F.floor(more).alias("__sure"), (more - F.floor(more)).alias("__p"))
    common = ["source", "items", "source_size", "target", "__base"]
    own = [f for f in FIELDS if f != "__h"]
    done = [todo.filter((F.col("size") == 0) | (F.col("__p") <= 0)).withColumn("__x", F.lit(0.0)).select(*common, *own, "__x")]
    todo = todo.filter((F.col("size") > 0) & (F.col("__p") > 0))
    level, blocks = 0, largest
    while True:
        level += 1
        blocks = -(-blocks // fan)
        # every source has blocks in proportion to its items at this level
        part = F.greatest(F.ceil(F.col("items") / F.lit(float(fan) ** level)), F.lit(1))
        item = F.struct(F.xxhash64("doc_id", "__key", F.lit(seed)).alias("__h"), *own, "__p")
        grouped = (
            todo.withColumn("__block", F.pmod(F.xxhash64("doc_id", "__key", "size", F.lit(seed + level)), part))
            .groupBy(*common, "__block")
            .agg(F.sort_array(F.collect_list(item)).alias("__items"))
        )
        folded = grouped.select(*common, F.expr(step(seed)).alias("__s"))
        folded = stage(folded, f"level{level}")
        decided = folded.select(*common, F.explode("__s.done").alias("__d")).select(*common, *[f"__d.{f}" for f in own], F.col("__d.__p").alias("__x"))
        done.append(decided)
        todo = folded.filter(F.col("__s.rest").isNotNull()).select(*common, *[f"__s.rest.{f}" for f in own], "__s.rest.__p")
        if blocks <= 1:
            break
    # one undecided item of each source is left: chance decides it alone
    last = todo.withColumn("__x", (uniform(F.col("__key"), F.col("doc_id"), F.lit(seed)) < F.col("__p")).cast("double")).select(*common, *own, "__x")
    out = done[0]
    for d in [*done[1:], last]:
        out = out.unionByName(d)
    return out.select("doc_id", "source", "size", "__key", "rows", "source_size", "target", "__base", (F.col("__sure") + F.round("__x")).cast("long").alias("__more"))


def repeated(rows: DataFrame, times: str, number: str, most: int) -> DataFrame:
    """Each row as often as the column times says, numbered from 1.  Rows with very many repeats (most: the greatest number)
    are dealt to all tasks in parts."""
    (part,) = free_names(rows, "__part")
    parts = rows.withColumn(part, F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col(times) - 1) / TOGETHER))))
    if most > MANY:
        parts = parts.repartition(max(rows.sparkSession.sparkContext.defaultParallelism, min(most // MANY * 4, 1 << 15)))
    ends = F.col(part) * TOGETHER + 1, F.least(F.col(times), (F.col(part) + 1) * TOGETHER)
    return parts.withColumn(number, F.explode(F.sequence(*ends))).drop(part)


def mix(rows: DataFrame, **options) -> DataFrame:
    """rows (of sizes()) -> doc_id, size, source_size, target, taken, copies, source, __key: a row each."""
    decided = decide(rows, **options)
    most = decided.agg(F.max("rows")).first()[0] or 0
    each = repeated(decided, "rows", "__i", most) if most > 1 else decided.withColumn("__i", F.lit(1))
    copies = F.col("__base") + (F.col("__i") <= F.col("__more")).cast("long")
    return each.select("doc_id", "size", "source_size", "target", (copies * F.col("size")).alias("taken"), copies.alias("copies"), "source", "__key")


def mix_documents(docs: DataFrame, **options) -> DataFrame:
    return mix(sizes(docs), **options)


def take(docs: DataFrame, **options) -> DataFrame:
    """docs with each row as often as the mix takes it.  Equal rows of one doc_id and source share their copies: one of
    them stands for all, if they differ in further columns the one with the least hash."""
    doc, source, key, rows, copies, number = free_names(docs, "__doc", "__source", "__k", "__rows", "__copies", "__i")
    total = F.col("__base") * F.col("rows") + F.col("__more")
    taken = decide(sizes(docs), **options).select(F.col("doc_id").alias(doc), F.col("source").alias(source), F.col("__key").alias(key), F.col("rows").alias(rows), total.alias(copies))
    taken = stage(taken.filter(F.col(copies) > 0), "copies")
    same = docs["doc_id"].cast("long").eqNullSafe(taken[doc]) & docs["source"].cast("string").eqNullSafe(taken[source]) & (F.xxhash64(docs["text"]) == taken[key])
    once = docs.join(taken.filter(taken[rows] == 1), same)
    out = once.drop(doc, source, key, rows)
    again = taken.filter(taken[rows] > 1)
    if not again.isEmpty():
        found = docs.join(again, same)
        out = out.unionByName(one_row_each(found, *[F.col(c) for c in (doc, source, key)]).drop(doc, source, key, rows))
    most = taken.agg(F.max(copies)).first()[0] or 0
    return repeated(out, copies, number, most).drop(copies, number) if most > 1 else out.drop(copies)


def op7_mixing(spark, sf_dir):
    return mix_documents(documents(spark, sf_dir)).select("doc_id", "size", "source_size", "target", "taken", "copies")
