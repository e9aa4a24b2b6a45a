"""Hard negatives by a Voronoi-partitioned distributed nearest-neighbour join, exact in integers.

Method: components are floored to integers, so that scores (inner products) are exact.  A candidate gets one more coordinate, which gives
all candidates the norm of the longest; an anchor gets 0 there.  Then a greater score is a smaller distance.  Pivots are
rows chosen by hash (PIVOTS at most); every row belongs to the cell of its nearest pivot, and anchors of near cells form groups of
about GROUP_ROWS (a cell with more is several groups).  A first pass compares anchors with their own cells only; the k-th score that it
finds bounds what can still matter.  From the cells' radii and the distances of pivots follows how near and how far a candidate
can be to the anchors of a group; a candidate is sent only to groups it might serve.  A group's candidates are dealt into
slices by hash of the row, so no task holds a cell, a group or a hot vector whole; each task multiplies its anchors with its slice, exactly,
and reports k rows for each anchor and window of scores; Spark picks the first k of these.

Positives are such a search among rows of the same label, negatives one among the others with a window of scores for each
positive.  The driver holds the pivots, and one line for each cell and group.  Where vectors have no clusters (random ones of 64
components, say), bounds of cells exclude little and the join is one of blocks: the stated anchors against all rows.

Cases: rows with a null vec_id, label or vector, or with a null or non-finite component, take no part.  Vectors of different
lengths: the shorter are filled with zeros.  Components beyond +-65,536 count as that, so that scores stay in a long.  Repeated rows,
or rows of one vec_id: rows of their own, also as each other's positives.  Ties: smaller vec_id first, then the row's
number.  Positive scores of 0 or less: the window is empty, or 0 alone.  Anchors with fewer positives, or positives with fewer negatives, than asked
for: all there are.  Empty table or no anchors: no rows.  Further columns are not read, whatever their names.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from kgspark.llm.common import stage
from kgspark.operators.ranking import top_k

SCALE = 256
#: Greatest component after scaling.
MOST = 1 << 24
#: Pivots at most; rows for each of them at least.
PIVOTS = 1024
CELL_ROWS = 16
#: Anchors of a group, about; bytes of the candidates of a slice, about.
GROUP_ROWS = 4096
SLICE_BYTES = 1 << 21
#: Scores that a task makes at a time.
TILE = 1 << 21
#: Stands for no bound; scores are smaller.
ANY = 1 << 62

RESULT_DDL = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"


def quantised(vectors: DataFrame, anchor: Column, width: int) -> DataFrame:
    """row, vec_id, label, anchor, vector (32-bit integers), norm2, peak of the rows that take part; to be staged, since row
    numbers hold only for what has been written."""
    schema = pa.schema([("vec_id", pa.int64()), ("label", pa.int64()), ("anchor", pa.bool_()), ("vector", pa.binary()), ("norm2", pa.int64()), ("peak", pa.int64())])

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 2000):
                part = batch.slice(at, 2000)
                lists = part.column("vector")
                sizes = np.diff(lists.offsets.to_numpy())
                flat = lists.flatten().to_numpy(zero_copy_only=False).astype(np.float64)  # nulls become nan
                row = np.repeat(np.arange(len(sizes)), sizes)
                m = np.zeros((len(sizes), width))
                m[row, np.arange(len(row)) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = flat
                fine = np.isfinite(m).all(axis=1)
                m = np.clip(np.floor(SCALE * m[fine]), -MOST, MOST).astype(np.int64)
                own = part.filter(pa.array(fine))
                raw = m.astype("<i4")
                peak = np.abs(m).max(axis=1, initial=0)
                yield pa.RecordBatch.from_arrays([own.column("vec_id"), own.column("label"), own.column("anchor"), pa.array([r.tobytes() for r in raw], pa.binary()), pa.array((m * m).sum(axis=1)), pa.array(peak)], schema=schema)

    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("long").alias("label"), F.coalesce(anchor, F.lit(False)).alias("anchor"), F.col("embedding").alias("vector"))
    rows = rows.filter(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.col("vector").isNotNull())
    out = rows.mapInArrow(run, "vec_id long, label long, anchor boolean, vector binary, norm2 long, peak long")
    return out.withColumn("row", F.monotonically_increasing_id())


def matrix(column: pa.Array | pa.ChunkedArray, width: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), dtype="<i4").reshape(len(column), width)


@dataclass
class Cells:
    """Pivots with their additional coordinate, the squared norm that all candidates have, and distances of pivots."""

    width: int
    norm2: int
    pivots: np.ndarray

    def __post_init__(self):
        self.squares = (self.pivots**2).sum(axis=1)
        self.between = np.sqrt(np.maximum(self.squares[:, None] + self.squares[None] - 2 * self.pivots @ self.pivots.T, 0))

    @classmethod
    def of(cls, width: int, norm2: int, rows: np.ndarray, norms: np.ndarray) -> Cells:
        return cls(width, norm2, np.column_stack([rows, np.sqrt(norm2 - norms)]).astype(np.float64))

    def nearest(self, rows: np.ndarray, norms: np.ndarray, anchors: bool) -> tuple[np.ndarray, np.ndarray]:
        """Each row's cell and its distance to the pivot."""
        more = np.zeros(len(rows)) if anchors else np.sqrt(np.maximum(self.norm2 - norms, 0.0))
        d2 = (norms if anchors else np.full(len(rows), float(self.norm2)))[:, None] + self.squares[None] - 2 * np.column_stack([rows, more]) @ self.pivots.T
        cell = d2.argmin(axis=1)
        return cell, np.sqrt(np.maximum(d2[np.arange(len(rows)), cell], 0))

    @property
    def slack(self) -> float:
        """More than rounding can amount to."""
        return 1e-5 * float(np.sqrt(self.norm2 + 1.0))


def in_cells(points: DataFrame, cells: Cells) -> DataFrame:
    """points with the cell and distance as a candidate, and, for anchors, as an anchor (home, away)."""
    sent = points.sparkSession.sparkContext.broadcast(cells)
    schema = pa.schema([("row", pa.int64()), ("vec_id", pa.int64()), ("label", pa.int64()), ("anchor", pa.bool_()), ("vector", pa.binary()), ("norm2", pa.int64()), ("cell", pa.int32()), ("far", pa.float64()), ("home", pa.int32()), ("away", pa.float64())])

    def run(batches):
        c = sent.value
        for batch in batches:
            for at in range(0, batch.num_rows, 2000):
                part = batch.slice(at, 2000)
                rows, norms = matrix(part.column("vector"), c.width).astype(np.float64), part.column("norm2").to_numpy().astype(np.float64)
                own = c.nearest(rows, norms, False)
                home = c.nearest(rows, norms, True)
                yield pa.RecordBatch.from_arrays([*(part.column(x) for x in schema.names[:6]), pa.array(own[0].astype(np.int32)), pa.array(own[1]), pa.array(home[0].astype(np.int32)), pa.array(home[1])], schema=schema)

    return points.select(*schema.names[:6]).mapInArrow(run, "row long, vec_id long, label long, anchor boolean, vector binary, norm2 long, cell int, far double, home int, away double")


def grouped(counts: dict[int, int], between: np.ndarray, group_rows: int) -> list[tuple[int, int, int]]:
    """(cell, first group, groups) for anchors' numbers by cell: cells of many are several groups of their own, others share
    groups along a chain from each cell to the nearest one not yet in it."""
    out, group, filled = [], 0, 0
    left = sorted(counts)
    at = left[0] if left else 0
    while left:
        at = min(left, key=lambda c: between[at, c])
        left.remove(at)
        parts = -(-counts[at] // group_rows)
        if filled and filled + counts[at] > group_rows:
            group, filled = group + 1, 0
        out.append((at, group, parts))
        filled += counts[at]
        if parts > 1:
            group, filled = group + parts, 0
    return out


@dataclass
class Members:
    """Anchors of one cell in one group: how far they lie from the pivot, and from what to what distance a candidate matters."""

    group: np.ndarray
    cell: np.ndarray
    radius: np.ndarray
    near: np.ndarray
    far: np.ndarray

    @classmethod
    def of(cls, anchors: DataFrame, norm2: int) -> Members:
        # distance^2 = |anchor|^2 + norm2 - 2 score
        away2 = F.col("norm2") + F.lit(float(norm2))
        low, high = F.array_min("lows"), F.array_max("highs")
        far2 = F.when(low <= -ANY, F.lit(float("inf"))).otherwise(away2 - 2 * low)
        near2 = F.when(high >= ANY, F.lit(0.0)).otherwise(away2 - 2 * high)
        rows = anchors.groupBy("group", "home").agg(F.max("away").alias("radius"), F.min(near2).alias("near"), F.max(far2).alias("far")).collect()
        columns = [np.array([r[c] for r in rows]) for c in ("group", "home", "radius", "near", "far")]
        return cls(*columns[:3], *(np.sqrt(np.maximum(c, 0)) for c in columns[3:]))


def routed(placed: DataFrame, cells: Cells, members: Members, slices: int, home: bool) -> DataFrame:
    """A row for each candidate and group it might serve (home: groups with anchors of the candidate's own cell)."""
    sent = placed.sparkSession.sparkContext.broadcast((cells, members))
    schema = pa.schema([("group", pa.int64()), ("row", pa.int64()), ("vec_id", pa.int64()), ("label", pa.int64()), ("vector", pa.binary())])

    def run(batches):
        c, m = sent.value
        order = np.argsort(m.group, kind="stable")
        group, first = np.unique(m.group[order], return_index=True) if len(order) else (m.group, order)
        for batch in batches:
            for at in range(0, batch.num_rows, max(1, TILE // max(len(order), 1))):
                part = batch.slice(at, max(1, TILE // max(len(order), 1)))
                cell, far = part.column("cell").to_numpy(), part.column("far").to_numpy()
                if home:
                    serves = cell[:, None] == m.cell[order][None]
                else:
                    apart, reach = c.between[cell][:, m.cell[order]], far[:, None] + m.radius[order][None]
                    serves = (apart - reach <= m.far[order][None] + c.slack) & (apart + reach >= m.near[order][None] - c.slack)
                found = np.logical_or.reduceat(serves, first, axis=1) if len(order) else serves
                i, g = np.nonzero(found)
                taken = part.select(schema.names[1:]).take(pa.array(i))
                yield pa.RecordBatch.from_arrays([pa.array(group[g].astype(np.int64)), *taken.columns], schema=schema)

    out = placed.select("row", "vec_id", "label", "vector", "cell", "far").mapInArrow(run, "group long, row long, vec_id long, label long, vector binary")
    return out.withColumn("slice", F.pmod(F.xxhash64("row"), F.lit(slices)).cast("int"))


def first_in_windows(a: dict, c: dict, same: bool, k: int, kind: type, limit: int) -> tuple[np.ndarray, ...]:
    """The first k candidates of every anchor and window of scores: anchor's place, window, candidate's place, score.  a: rows,
    labels, vectors, lows, highs (anchors x windows); c: rows, labels, vectors, in the order that breaks ties."""
    q, windows = a["lows"].shape
    none = kind(-limit)
    high = np.clip(a["highs"], -limit, limit).astype(kind)
    least = np.clip(a["lows"] - 1, -limit, limit).astype(kind)  # scores must be greater
    best = [(np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64), np.zeros(0, dtype=kind)) for _ in range(windows)]
    left = a["vectors"].astype(kind)
    own = {int(r): i for i, r in enumerate(a["rows"])}
    at, step = 0, 128
    while at < len(c["rows"]):
        to = min(at + step, len(c["rows"]))
        scores = left @ c["vectors"][at:to].astype(kind).T
        equal = a["labels"][:, None] == c["labels"][at:to][None]
        scores[~equal if same else equal] = none
        if same:
            for j, r in enumerate(c["rows"][at:to].tolist()):
                if r in own:
                    scores[own[r], j] = none
        for w in range(windows):
            i, j = np.nonzero((scores > least[:, w, None]) & (scores <= high[:, w, None]))
            if not len(i):
                continue
            i, j, s = np.concatenate([best[w][0], i]), np.concatenate([best[w][1], j + at]), np.concatenate([best[w][2], scores[i, j]])
            order = np.lexsort((j, -s, i))
            i, j, s = i[order], j[order], s[order]
            place = np.arange(len(i)) - np.searchsorted(i, i, side="left")
            i, j, s, place = (x[place < k] for x in (i, j, s, place))
            best[w] = i, j, s
            least[i[place == k - 1], w] = s[place == k - 1]
        at, step = to, max(128, min(step * 4, TILE // max(q, 1)))
    return tuple(np.concatenate([b[x] for b in best]) for x in (0, 1, 2)) + (np.repeat(np.arange(windows), [len(b[0]) for b in best]),)


@dataclass
class Points:
    """What a search needs: candidates in cells, and how to multiply their vectors."""

    placed: DataFrame
    cells: Cells
    slices: int
    peak: int

    def kind(self) -> tuple[type, int]:
        """The quickest type in which scores are exact, and a number greater than all of them."""
        most = self.cells.width * self.peak**2
        return (np.float32, 1 << 24) if most < 1 << 23 else (np.float64, 1 << 53) if most < 1 << 52 else (np.int64, ANY)


def found_in(points: Points, anchors: DataFrame, members: Members, same: bool, k: int, home: bool) -> DataFrame:
    """anchor (row), window, candidate (row), vec_id, score: the first k of each anchor and window."""
    width, (kind, limit) = points.cells.width, points.kind()
    schema = pa.schema([("anchor", pa.int64()), ("window", pa.int32()), ("candidate", pa.int64()), ("vec_id", pa.int64()), ("score", pa.int64())])

    def run(a: pa.Table, c: pa.Table) -> pa.Table:
        if not len(a) or not len(c):
            return schema.empty_table()
        c = c.sort_by([("vec_id", "ascending"), ("row", "ascending")])
        rows, ids = c["row"].to_numpy(), c["vec_id"].to_numpy()
        own = a["row"].to_numpy()
        # anchors of a group may have different numbers of windows: empty ones fill up
        windows = max(len(x) for x in a["lows"].to_pylist())
        lows, highs = (np.array([[*x, *[fill] * (windows - len(x))] for x in a[side].to_pylist()], dtype=np.int64) for side, fill in (("lows", ANY), ("highs", -ANY)))
        i, j, s, w = first_in_windows(
            {"rows": own, "labels": a["label"].to_numpy(), "vectors": matrix(a["vector"], width), "lows": lows, "highs": highs},
            {"rows": rows, "labels": c["label"].to_numpy(), "vectors": matrix(c["vector"], width)},
            same, k, kind, limit,
        )
        return pa.table([pa.array(own[i]), pa.array(w.astype(np.int32)), pa.array(rows[j]), pa.array(ids[j]), pa.array(s.astype(np.int64))], schema=schema)

    right = routed(points.placed, points.cells, members, points.slices, home).groupBy("group", "slice")
    every = F.explode(F.sequence(F.lit(0), F.lit(points.slices - 1)))
    left = anchors.select(F.col("group").cast("long").alias("group"), "row", "label", "vector", "lows", "highs", every.alias("slice")).groupBy("group", "slice")
    found = left.cogroup(right).applyInArrow(run, "anchor long, window int, candidate long, vec_id long, score long")
    return top_k(found, ["anchor", "window"], k, F.col("score").desc(), "vec_id", "candidate")


def search(points: Points, anchors: DataFrame, same: bool, k: int) -> DataFrame:
    """found_in() over all cells.  anchors: row, label, vector, norm2, home, away, group, lows, highs (a window of scores each).  The
    anchors' own cells are looked at first: with k found there, lower scores needn't be looked for."""
    norm2 = points.cells.norm2
    own = found_in(points, anchors, Members.of(anchors, norm2), same, k, True)
    raised = own.groupBy("anchor", "window").agg(F.count("*").alias("n"), F.min("score").alias("least")).filter(F.col("n") == k)
    raised = raised.groupBy("anchor").agg(F.map_from_entries(F.collect_list(F.struct("window", "least"))).alias("raised"))  # windows of one anchor
    lows = F.when(F.col("raised").isNull(), F.col("lows")).otherwise(F.transform("lows", lambda x, w: F.coalesce(F.element_at("raised", w), x)))
    known = stage(anchors.join(raised.withColumnRenamed("anchor", "row"), "row", "left").withColumn("lows", lows).drop("raised"), "anchors")
    # equal scores may still come first by their vec_id: a low itself is inside its window
    return stage(found_in(points, known, Members.of(known, norm2), same, k, False), "found")


def pointed(vectors: DataFrame, anchor: Column, pivots: int = PIVOTS, slice_bytes: int = SLICE_BYTES) -> Points | None:
    """The table in cells; None if no row takes part."""
    width = vectors.agg(F.max(F.size("embedding"))).first()[0] or 0
    width = max(width, 1)
    rows = stage(quantised(vectors, anchor, width), "quantised")
    n, norm2, peak = rows.agg(F.count("*"), F.max("norm2"), F.max("peak")).first()
    if not n:
        return None
    most = max(1, min(pivots, n // CELL_ROWS))
    chosen = rows.orderBy(F.xxhash64("vec_id", "row"), "row").limit(most).select("vector", "norm2").toArrow()  # pivots rows at most
    cells = Cells.of(width, norm2, matrix(chosen["vector"], width), chosen["norm2"].to_numpy().astype(np.float64))
    return Points(stage(in_cells(rows, cells), "in-cells"), cells, -(-n * width * 4 // slice_bytes), peak)


def mine(vectors: DataFrame, anchor: Column, positives: int = 5, negatives: int = 3, least: int = 50, most: int = 95, group_rows: int = GROUP_ROWS, **options) -> DataFrame:
    """For every anchor (rows of vectors: vec_id, embedding, label, where the column `anchor` is true) and each of its first `positives`
    rows of the same label, the first `negatives` rows of other labels whose score is from `least` to `most` hundredths of the
    positive's."""
    spark: SparkSession = vectors.sparkSession
    points = pointed(vectors, anchor, **options)
    own = points and points.placed.filter("anchor")
    counts = {r["home"]: r["n"] for r in own.groupBy("home").agg(F.count("*").alias("n")).collect()} if points else {}
    if not counts:
        return spark.createDataFrame([], RESULT_DDL)
    groups = spark.createDataFrame(grouped(counts, points.cells.between, group_rows), "home int, first int, parts int")
    whole = own.join(F.broadcast(groups), "home").withColumn("group", F.col("first") + F.pmod(F.xxhash64("row"), F.col("parts")))  # a line a cell
    one = lambda x: F.array(F.lit(x).cast("long"))
    anchors = stage(whole.select("row", "vec_id", "label", "vector", "norm2", "home", "away", "group", one(-ANY).alias("lows"), one(ANY).alias("highs")), "anchors")
    near = search(points, anchors, True, positives).select(F.col("anchor").alias("row"), F.col("rank").alias("number"), F.col("vec_id").alias("positive_id"), F.col("score").alias("p"))
    # rounded inwards, for scores of either sign
    low = F.expr(f"({least} * p + pmod(-{least} * p, 100L)) div 100L")
    high = F.expr(f"({most} * p - pmod({most} * p, 100L)) div 100L")
    windows = near.groupBy("row").agg(F.sort_array(F.collect_list(F.struct("number", low.alias("low"), high.alias("high")))).alias("w"))  # `positives` of each
    asked = anchors.drop("lows", "highs").join(windows, "row").withColumns({"lows": F.col("w.low"), "highs": F.col("w.high")}).drop("w")
    hard = search(points, stage(asked, "anchors"), False, negatives)
    hard = hard.select(F.col("anchor").alias("row"), (F.col("window") + 1).alias("number"), F.col("rank").cast("int").alias("rank"), F.col("vec_id").alias("negative_id"), F.col("score").alias("negative_score"))
    named = near.join(anchors.select("row", F.col("vec_id").alias("anchor_id")), "row")
    return hard.join(named, ["row", "number"]).select("anchor_id", "positive_id", "rank", "negative_id", F.col("p").alias("positive_score"), "negative_score")


def op13_hard_negatives(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return mine(rows.select("vec_id", "embedding", label.alias("label")), F.col("vec_id") % 50 == 0)
