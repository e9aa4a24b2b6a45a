"""Shards of near-equal bytes by histogram sort, in DataFrame functions alone.

Method: rows are ordered by three 60-bit numbers: a hash of the text (equal texts are neighbours), one of the text
and the doc_id, and one of the row's number, by which even identical rows differ.  Exact bytes below
candidate boundaries are counted over all partitions at once; each round divides only the intervals in which
a splitter still has to lie, until the bytes of every such interval are within the tolerance or the
interval is a single key.  A key too heavy for the tolerance (a large group of equal texts) is divided by the
next number in the same way, so no group unbalances a shard.  With the splitters known, every row is
exchanged once, to (shard, bin), and numbered there; the bins of a shard follow each other, so slots have no
gap.  Bins with too many rows (equal texts, repeated rows) are divided by the second and the third number
before that exchange, so no task holds a whole shard or a whole group.

The driver holds counts of at most (shards - 1) x 4096 intervals a round and of the bins, whose number depends on
the shards and not on the rows.

Cases: null or empty text: size 1.  Null doc_id: a row like any other.  Repeated rows: a row each, in as many shards as
their bytes need.  Ties: rows equal in the first number keep together, and are cut by the second, then by the third.
Empty table: no rows.  Fewer rows than shards: some shards stay empty.  Very long texts: only their sizes and
hashes travel; a text larger than a shard goes to the nearer side.  Columns but doc_id and text, whatever their
names, are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kgspark.llm.common import documents, stage

SHARDS = 16
#: Bits by which an interval is divided in a round.
STEP = 12
WIDTH = 60
#: Bins of the first number, over all shards.
BIN_BITS = 12
#: Rows from which a bin is divided: at least, and as a share of a shard's rows.
HEAVY_ROWS = 1 << 10
HEAVY_SHARE = 64
#: Bytes by which a splitter may miss its target, as a share of a shard.
TOLERANCE = 0.001
LEVELS = ("__first", "__second", "__third")


def key(*columns: str | Column) -> Column:
    """A hash as a number from 0 to 2^60 - 1, so that order and bits agree without signs."""
    return F.shiftrightunsigned(F.xxhash64(*columns), 64 - WIDTH)


def sized(docs: DataFrame) -> DataFrame:
    """What is exchanged; to be staged, as row numbers hold only for what has been written."""
    return docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        (F.coalesce(F.octet_length("text"), F.lit(0)) + 1).cast("long").alias("size"),
        F.crc32(F.coalesce("text", F.lit("")).cast("binary")).alias("text_crc32"),
        key("text").alias("__first"),
        key("doc_id", "text").alias("__second"),
        key(F.monotonically_increasing_id()).alias("__third"),
    )


def refine(rows: DataFrame, column: str, targets: dict[int, float], tolerance: float) -> dict[int, tuple[int, float, int]]:
    """For each target (bytes below it) the boundary nearest to it: {splitter: (key, bytes below the key, bytes of the
    key itself or 0 if the boundary is good enough)}.  Rows at or above the key go after the splitter."""
    # splitter -> (prefix of its interval, bits of the prefix, bytes below the interval)
    open_ = {s: (0, 0, 0.0) for s in targets}
    done: dict[int, tuple[int, float, int]] = {}
    while open_:
        bits = next(iter(open_.values()))[1]
        into = min(bits + STEP, WIDTH)
        counted = rows
        if bits:
            counted = rows.filter(F.shiftrightunsigned(column, WIDTH - bits).isin(sorted({p for p, _, _ in open_.values()})))
        bins = sorted((r["bin"], int(r["bytes"]), r["rows"]) for r in counted.groupBy(F.shiftrightunsigned(column, WIDTH - into).alias("bin")).agg(F.sum("size").alias("bytes"), F.count("*").alias("rows")).collect())
        following = {}
        for s, (prefix, _, below) in open_.items():
            at, left = None, below
            for b, n, count in (x for x in bins if x[0] >> (into - bits) == prefix):
                if left + n >= targets[s]:
                    at = (b, n, count)
                    break
                left += n
            if at is None:  # nothing lies above the target
                done[s] = ((prefix + 1) << (WIDTH - bits), left, 0)
                continue
            b, n, count = at
            low, high = targets[s] - left, left + n - targets[s]
            if min(low, high) <= tolerance or count == 1:  # a single row goes to the nearer side
                done[s] = (b << (WIDTH - into), left, 0) if low <= high else ((b + 1) << (WIDTH - into), left + n, 0)
            elif into == WIDTH:
                done[s] = (b, left, n)
            else:
                following[s] = (b, into, left)
        open_ = following
    return done


def divide(rows: DataFrame, targets: dict[int, float], allowed: float, levels: tuple[str, ...] = LEVELS) -> dict[int, tuple[int, ...]]:
    """Boundaries, one number a level, for targets in bytes below them; a key too heavy is divided by the next level."""
    found = refine(rows, levels[0], targets, allowed)
    rest = (0,) * (len(levels) - 1)
    out = {s: (k, *rest) for s, (k, _, heavy) in found.items() if not heavy}
    heavy: dict[int, dict[int, float]] = {}
    for s, (k, below, size) in found.items():
        if size and rest:
            heavy.setdefault(k, {})[s] = targets[s] - below
        elif size:  # rows whose numbers are equal at all levels go to the nearer side
            out[s] = (k + (targets[s] - below > size / 2),)
    for k, group in heavy.items():
        inner = divide(rows.filter(F.col(levels[0]) == k), group, allowed, levels[1:])
        out |= {s: (k, *keys) for s, keys in inner.items()}
    return out


def splitters(rows: DataFrame, shards: int, tolerance: float = TOLERANCE) -> list[tuple[int, ...]]:
    """Boundaries: a row lies after a boundary if its three numbers, in order, are not smaller."""
    total = rows.agg(F.sum("size")).first()[0] or 0
    found = divide(rows, {s: total * s / shards for s in range(1, shards)}, tolerance * total / shards)
    return [found[s] for s in sorted(found)]


def after(bound: tuple[int, ...], levels: tuple[str, ...] = LEVELS) -> Column:
    own = F.col(levels[0])
    if len(levels) == 1:
        return own >= bound[0]
    return (own > bound[0]) | ((own == bound[0]) & after(bound[1:], levels[1:]))


def binned(placed: DataFrame, shards: int) -> tuple[DataFrame, DataFrame]:
    """(placed with __bin, rows of each (shard, __bin)): bins follow the first number; heavy ones are divided by the
    second and, where that leaves them heavy (repeated rows), by the third."""
    placed = placed.withColumn("__bin", F.shiftrightunsigned("__first", WIDTH - BIN_BITS).cast("long"))
    counts = stage(placed.groupBy("shard", "__bin").agg(F.count("*").alias("__rows")), "bins")
    limit = max(HEAVY_ROWS, (counts.agg(F.sum("__rows")).first()[0] or 0) // (shards * HEAVY_SHARE))
    for column in LEVELS[1:]:
        heavy = counts.filter(F.col("__rows") > limit).select(F.col("shard").alias("__s"), F.col("__bin").alias("__b"), F.ceil(F.col("__rows") / limit).cast("long").alias("__parts"))
        if heavy.isEmpty():
            break
        # at most shards x HEAVY_SHARE heavy bins exist, whatever the number of rows
        placed = placed.join(F.broadcast(heavy), (F.col("shard") == F.col("__s")) & (F.col("__bin") == F.col("__b")), "left")
        part = F.pmod(F.col(column), F.coalesce("__parts", F.lit(1)))
        placed = placed.withColumn("__bin", F.shiftleft("__bin", 20) + part).drop("__s", "__b", "__parts")
        counts = stage(placed.groupBy("shard", "__bin").agg(F.count("*").alias("__rows")), "bins")
    return placed, counts


def shard(docs: DataFrame, shards: int = SHARDS, tolerance: float = TOLERANCE) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard for every row."""
    rows = stage(sized(docs), "sized")
    bounds = splitters(rows, shards, tolerance)
    placed, counts = binned(rows.withColumn("shard", sum((after(b).cast("int") for b in bounds), F.lit(0))), shards)
    before = Window.partitionBy("shard").orderBy("__bin").rowsBetween(Window.unboundedPreceding, -1)
    # bins of a range of the first number lie in one shard but at the boundaries; heavy ones add shards x HEAVY_SHARE
    offsets = counts.withColumn("__before", F.coalesce(F.sum("__rows").over(before), F.lit(0))).drop("__rows")
    number = F.row_number().over(Window.partitionBy("shard", "__bin").orderBy(*LEVELS[:2], "doc_id"))
    return (
        placed.withColumn("__n", number)
        .join(F.broadcast(offsets), ["shard", "__bin"])
        .select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", (F.col("__before") + F.col("__n") - 1).alias("slot"), F.lit(None).cast("int").alias("grown_shard"))
    )


def op10_sharding(spark, sf_dir):
    return shard(documents(spark, sf_dir))
