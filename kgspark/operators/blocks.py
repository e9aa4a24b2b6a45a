"""Products of two tables of vectors, block by block: what is shuffled and returned doesn't grow with left rows times right rows.

Each table is dealt into blocks of about so many rows by a hash of its id, and each pair of blocks meets in one task as two
Arrow tables.  Pairs that don't count (known answers) are rows of two ids: such a pair has one place, the block pair of
its ids, and is sent there alone.  A fold turns two blocks into a result whose size follows the left block: the best of each row, a
count, a sum.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Rows of a block of either side, about.
LEFT_ROWS, RIGHT_ROWS = 4096, 1 << 14
#: Rows of the left block that are multiplied at a time, and of the right one where an order allows to stop.
STEP = 256


def matrix(column: pa.ChunkedArray) -> np.ndarray:
    """An array column (all of one length) as rows of a matrix."""
    if not len(column):
        return np.zeros((0, 0))
    return column.combine_chunks().flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)


def blocks(df: DataFrame, rows: int) -> int:
    return -(-max(df.count(), 1) // rows)


def numbered(id_column: str, n: int):
    return F.pmod(F.xxhash64(id_column), F.lit(n)).cast("int")


def pairs_out(a: pa.Table, b: pa.Table, out: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """(row of a, row of b) of the pairs of ids in `out`; a's ids may repeat."""
    ids_a, ids_b = a["id"].to_numpy(), b["id"].to_numpy()
    order_a, order_b = np.argsort(ids_a, kind="stable"), np.argsort(ids_b, kind="stable")
    left, right = out["id"].to_numpy(), out["__other"].to_numpy()
    at = np.searchsorted(ids_b[order_b], right)
    there = at < len(ids_b)
    there[there] = ids_b[order_b][at[there]] == right[there]
    left, at = left[there], at[there]
    first, last = (np.searchsorted(ids_a[order_a], left, side=s) for s in ("left", "right"))
    times = last - first
    place = np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)
    return order_a[np.repeat(first, times) + place], order_b[np.repeat(at, times)]


def product(left: DataFrame, right: DataFrame, fold: Callable[[pa.Table, pa.Table, tuple], pa.Table], schema: str, out: DataFrame | None = None, left_rows: int = LEFT_ROWS, right_rows: int = RIGHT_ROWS, by: str | None = None) -> DataFrame:
    """fold(a, b, (rows of a, rows of b that don't count)) of every pair of blocks.  left and right: id (long) and further columns;
    out (left_id, right_id): pairs that don't count; right's ids are unique.
    schema has long and double columns only.  With by (few values), the rows of a left block are equal in that column."""
    m = blocks(right, right_rows)
    if by is None:
        n, own_block = blocks(left, left_rows), lambda n: numbered("id", n)
    else:
        n, dealt = 0, []
        for value, count in left.groupBy(by).count().collect():
            dealt.append((value, n, -(-count // left_rows)))
            n += dealt[-1][2]
        if not dealt:
            dealt, n = [(None, 0, 1)], 1

        def own_block(n):
            block = F.lit(0)
            for value, first, size in dealt:
                block = F.when(F.col(by).eqNullSafe(F.lit(value)), F.lit(first) + numbered("id", size)).otherwise(block)
            return block.cast("int")

        if out is not None:
            out = out.join(left.select(F.col("id").alias("left_id"), by).distinct(), "left_id").withColumn("id", F.col("left_id"))
    every = lambda k: F.explode(F.sequence(F.lit(0), F.lit(k - 1)))
    a = left.select("*", F.lit(None).cast("long").alias("__other"), own_block(n).alias("__l"), every(m).alias("__r"))
    if out is not None:
        sent = out.select(F.col("left_id").alias("id"), F.col("right_id").alias("__other"), (numbered("left_id", n) if by is None else own_block(n)).alias("__l"), numbered("right_id", m).alias("__r"))
        a = a.unionByName(sent, allowMissingColumns=True)
    # columns of their own: where both sides come from one table, the optimizer would prune those of the right side
    b = right.select(*[F.col(c).alias(c) for c in right.columns]).select("*", numbered("id", m).alias("__r"), every(n).alias("__l"))

    kinds = {"long": pa.int64(), "double": pa.float64()}
    nothing = pa.schema([(name, kinds[kind]) for name, kind in (c.split() for c in schema.split(", "))]).empty_table()

    def run(a: pa.Table, b: pa.Table) -> pa.Table:
        if not len(a) or not len(b):  # such a table has no columns either
            return nothing
        known = a["__other"].is_valid()
        own, gone = a.filter(pc.invert(known)), a.filter(known)
        return fold(own, b, pairs_out(own, b, gone)) if len(own) else nothing

    return a.groupBy("__l", "__r").cogroup(b.groupBy("__l", "__r")).applyInArrow(run, schema)


def first_k(scores: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, column) of the k greatest of each row, ties by id; -inf doesn't count.  Rows' places ascend, best first."""
    k = min(k, scores.shape[1])
    least = -np.partition(-scores, k - 1, axis=1)[:, k - 1] if k else np.zeros(len(scores))
    i, j = np.nonzero((scores >= least[:, None]) & np.isfinite(scores))
    order = np.lexsort((ids[j], -scores[i, j], i))
    i, j = i[order], j[order]
    kept = np.arange(len(i)) - np.searchsorted(i, i, side="left") < k
    return i[kept], j[kept]


def inner(a: pa.Table, b: np.ndarray) -> np.ndarray:
    """Scores of the rows of a with the vectors b: inner products."""
    return matrix(a["vector"]) @ b.T


def scored_tiles(a: pa.Table, b: pa.Table, skip: tuple[np.ndarray, np.ndarray], digits: int, scores: Callable[[pa.Table, np.ndarray], np.ndarray] = inner):
    """(first row of a, scores of STEP rows of a with all of b), -inf for pairs that don't count: listed ones, and those of
    equal `group` if both tables have that column."""
    right = matrix(b["vector"])
    order = np.argsort(skip[0], kind="stable")
    rows, columns = skip[0][order], skip[1][order]
    grouped = "group" in a.column_names and "group" in b.column_names
    ga, gb = (t["group"].to_numpy() if grouped else None for t in (a, b))
    for at in range(0, len(a), STEP):
        part = a.slice(at, STEP)
        s = np.round(scores(part, right), digits)
        lo, hi = np.searchsorted(rows, [at, at + len(part)])
        s[rows[lo:hi] - at, columns[lo:hi]] = -np.inf
        if grouped:
            s[ga[at : at + len(part)][:, None] == gb[None]] = -np.inf
        yield at, s
